"""Single JSON documents read in parallel.

A file that holds one JSON value, on one line or many, is read by Spark's text source in byte ranges, cut at every closing
brace. A first pass finds, for each range, whether it holds an odd number of unescaped quotes and by how much it
changes the nesting depth (for both cases, begun inside and outside a string); a running sum over the ranges, one row each,
then tells every range its state at its start. The second pass cuts the text at the brackets and commas of depth
``depth``: what lies between them are the records, what lies above is the skeleton. Records that cross a border are joined
by their number. A record, not the file, must fit in memory.

``depth`` counts brackets: 1 for the members of the outermost object or list, 3 for the elements of lists in its objects. In the
skeleton the content of each container of records is replaced by the container's number.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from annoscope.session import written

_END = ord("}")
_RUN_BYTES = 1 << 17  # characters scanned at a time, or one row; the scan takes about fifty bytes for each


@dataclass(frozen=True)
class JsonDocument:
    """``records`` (file, container, number, value) and ``skeleton`` (file, value), one row a file."""

    records: DataFrame
    skeleton: DataFrame


def _scan(data: np.ndarray, inside: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(depth changes at every byte, commas outside strings, whether the text ends inside a string)."""
    at = np.arange(len(data))
    other = np.maximum.accumulate(np.where(data != ord("\\"), at, -1))
    before = np.concatenate([[-1], other[:-1]])  # the last byte before each that is no backslash
    quote = (data == ord('"')) & ((at - 1 - before) % 2 == 0)
    count = np.cumsum(quote) + inside
    plain = (count - quote) % 2 == 0
    change = np.where(plain, ((data == ord("{")) | (data == ord("["))).astype(np.int64) - ((data == _END) | (data == ord("]"))), 0)
    return change, plain & (data == ord(",")), int(count[-1] % 2) if len(data) else inside


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], int, bytes]]:
    """((file, range), size of the file, text) of consecutive rows of one range, about ``_RUN_BYTES`` at a time; every row ends with the
    brace at which it was cut, so none begins after a backslash."""
    for batch in batches:
        keys = list(zip(batch.column("file").to_pylist(), batch.column("block").to_pylist()))
        values, sizes, i = batch.column("value").to_pylist(), batch.column("file_size").to_pylist(), 0
        while i < len(keys):
            j, size = i, 0
            while j < len(keys) and keys[j] == keys[i] and (j == i or size + len(values[j]) < _RUN_BYTES):
                size += len(values[j]) + 1
                j += 1
            yield keys[i], sizes[i], "".join(v + "}" for v in values[i:j]).encode()
            i = j


def _states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[tuple[str, int], list[int]] = {}
    for key, size, text in _runs(batches):
        data, kept = np.frombuffer(text, np.uint8), found.setdefault(key, [0, 0, 0, 0, 0])
        kept[3] += len(data)
        kept[4] = size
        for start in (0, 1):  # the range begun outside and inside a string
            change, _, end = _scan(data, (start + kept[0]) % 2)
            kept[1 + start] += int(change.sum())
        kept[0] = (kept[0] + _scan(data, 0)[2]) % 2
    yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.int64()),
                                      *[pa.array([v[i] for v in found.values()], pa.int64()) for i in range(5)]], ["file", "block", "odd", "outside", "within", "size", "file_size"])


def _pieces(starts: dict[tuple[str, int], tuple[int, int, int]], depth: int):
    """Cut each range into pieces, numbered within the range, of segments and containers, counted from 0 within the range; a
    piece is whole if it begins and ends at a cut."""
    names = ["file", "rank", "piece", "segment", "container", "element", "whole", "text"]
    types = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict[tuple[str, int], tuple] = {}
        for key, _, text in _runs(batches):
            rank, inside, deep = starts[key]
            inside, deep, piece, segment, container, element = state.get(key, (inside, deep, 0, 0, 0, deep >= depth))
            data = np.frombuffer(text, np.uint8)
            change, comma, inside = _scan(data, inside)
            after = deep + np.cumsum(change)
            raw = np.where(after < 0, ord(" "), data).astype(np.uint8).tobytes()  # the brace that ends the file's last row
            opens, closes = (change > 0) & (after == depth), (change < 0) & (after == depth - 1)
            rows, at, whole = [], 0, False
            for cut in np.flatnonzero(opens | closes | (comma & (after == depth))).tolist():
                # brackets belong to the skeleton, commas to nothing
                rows.append((key[0], rank, piece, segment, container, element, whole, raw[at:cut + int(opens[cut])].decode()))
                piece, segment, container, element, whole, at = piece + 1, segment + 1, container + int(opens[cut]), not closes[cut], True, cut + int(not closes[cut])
            rows.append((key[0], rank, piece, segment, container, element, False, raw[at:].decode()))
            state[key] = (inside, int(after[-1]), piece + 1, segment, container, element)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return run


def _check(ranges: list) -> None:
    """Every file ends outside strings at depth 0; a file that does not end with a brace was given one more."""
    read, last = Counter(), {}
    for r in sorted(ranges, key=lambda r: r["rank"]):
        read[r["file"]] += r["size"]
        last[r["file"]] = r
    for file, r in last.items():
        more = read[file] - r["file_size"]
        if (r["inside"] + r["odd"]) % 2 or r["deep"] + r["gain"] not in ((-more,) if more in (0, 1) else (0, -1)):
            raise ValueError(f"{file} is not a complete JSON document")


def read_json_document(spark: SparkSession, path: str, depth: int = 1) -> JsonDocument:
    """The records of depth ``depth`` of the JSON documents at ``path`` as texts, and their skeletons. A member of an object is the
    text ``"key": value``. A file that is no complete JSON value raises ``ValueError``."""
    lines = spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.col("_metadata.file_size").alias("file_size"), "value")
    ranges = lines.mapInArrow(_states, "file string, block long, odd long, outside long, within long, size long, file_size long")
    order = Window.partitionBy("file").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("inside", F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2).withColumn("rank", F.row_number().over(order) - 1)
    ranges = ranges.withColumn("gain", F.when(F.col("inside") == 1, F.col("within")).otherwise(F.col("outside")))
    ranges = ranges.withColumn("deep", F.coalesce(F.sum("gain").over(before), F.lit(0)))
    found = ranges.select("file", "block", "rank", "inside", "odd", "deep", "gain", "size", "file_size").collect()  # one row for each range of a file
    _check(found)
    starts = {(r["file"], r["block"]): (r["rank"], r["inside"], r["deep"]) for r in found}

    schema = "file string, rank int, piece long, segment long, container long, element boolean, whole boolean, text string"
    pieces = written(lines.mapInArrow(_pieces(starts, depth), schema), "json-pieces")
    totals = pieces.groupBy("file", "rank").agg(F.max("segment").alias("_s"), F.max("container").alias("_c"))
    earlier = Window.partitionBy("file").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    offsets = written(totals.select("file", "rank", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c) for c in ("_s", "_c")]), "json-offsets")
    placed = pieces.join(offsets, ["file", "rank"]).select(
        "file", "rank", "piece", (F.col("segment") + F.col("_s")).alias("number"), (F.col("container") + F.col("_c")).alias("container"), "element", "whole",
        F.col("text").alias("value"))
    key = ["file", "container", "number"]

    def joined(rows: DataFrame, by: list[str], *sort: str) -> DataFrame:
        parts = F.sort_array(F.collect_list(F.struct(*sort, "value")))
        return rows.groupBy(*by).agg(F.array_join(F.transform(parts, lambda p: p["value"]), "").alias("value"))

    records = placed.where("element AND whole").select(*key, "value").unionByName(joined(placed.where("element AND NOT whole"), key, "rank", "piece"))
    above = joined(placed.where("NOT element"), key, "rank", "piece")
    inner = (F.col("container") + 1).cast("string")
    above = above.withColumn("value", F.when(F.col("value").endswith("["), F.concat("value", inner))
                             .when(F.col("value").endswith("{"), F.concat("value", F.lit('"":'), inner)).otherwise(F.col("value")))
    return JsonDocument(records.where(F.col("value").rlike(r"\S")), joined(above, ["file"], "number"))
