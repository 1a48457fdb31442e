"""Mixing sources to target weights by a time-varying curriculum.

Every source has a weight schedule over training time 0..1 (piecewise linear knots). Its integral is
the source's weight; the weights share ``budget`` times all words, and a target stops at ``cap`` times
the size of its source, the excess going to the others by weight until none is above. A source is
a stream of words: its documents in the order of a hash of id and text, again from the start in a second pass. The stream's
first ``target`` words are taken, so the last document taken may be cut. The word at offset c of the
stream is trained at the time t at which the source's cumulative demand reaches c: t inverts the
integral of the schedule. Placements are range-sorted by that position.

The running offsets need no window over a whole source: documents are summed per (source, hash
bucket), buckets per source, and the window runs inside one bucket. Only the table of sources (one row
each) is ordered as a whole.

Defined cases: a null text has size 0; a null source is a source of its own, last in order; a null
id is hashed as an empty string, together with the text; documents of size 0 take nothing; rows that repeat an id are
documents of their own. Every document gets a row even if nothing of it is taken.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from annoscope.session import written as saved

Schedule = Sequence[tuple[float, float]]

WORDS = r"[^\x20\x09-\x0D]+"
#: Integrals 3, 1 and 2: falling, rising, and strongest in the middle.
SCHEDULES: tuple[Schedule, ...] = (((0.0, 4.0), (1.0, 2.0)), ((0.0, 0.5), (1.0, 1.5)), ((0.0, 1.0), (0.5, 3.0), (1.0, 1.0)))
_BUCKET_WORDS = 1 << 22  # words of a bucket, about


def integral(schedule: Schedule) -> float:
    return sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(schedule, schedule[1:]))


def _check(schedules: Sequence[Schedule]) -> None:
    for s in schedules:
        times = [t for t, _ in s]
        if len(s) < 2 or times[0] != 0 or times[-1] != 1 or times != sorted(set(times)) or min(w for _, w in s) < 0 or integral(s) <= 0:
            raise ValueError("a schedule needs knots from time 0 to 1 with weights of 0 or more, not all 0")


def inverse_demand(share: Column, schedule: Schedule) -> Column:
    """The time at which the integral of the schedule reaches ``share`` (0..1) of its total."""
    need = share * F.lit(integral(schedule))
    out, done = None, 0.0
    for (t0, w0), (t1, w1) in zip(schedule, schedule[1:]):
        area, slope = (t1 - t0) * (w0 + w1) / 2, (w1 - w0) / (t1 - t0)
        a = F.greatest(need - F.lit(done), F.lit(0.0))
        root = F.lit(w0) + F.sqrt(F.greatest(F.lit(w0 * w0) + 2 * slope * a, F.lit(0.0)))
        t = F.least(F.lit(t0) + F.when(root > 0, 2 * a / root).otherwise(F.lit(0.0)), F.lit(t1))
        out = F.when(need <= F.lit(done + area), t) if out is None else out.when(need <= F.lit(done + area), t)
        done += area
    return out.otherwise(F.lit(1.0))


def targets(sources: DataFrame, schedules: Sequence[Schedule] = SCHEDULES, budget: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size) -> source, slot (its schedule), weight, target."""
    weights = F.array(*[F.lit(float(integral(s))) for s in schedules])
    ranked = sources.withColumn("_slot", (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(schedules))
    ranked = (ranked.withColumn("_w", F.element_at(weights, F.col("_slot").cast("int") + 1))
              .withColumn("_top", F.col("source_size").cast("double") * F.lit(float(cap))))
    by_need = Window.orderBy((F.col("_top") / F.col("_w")).asc(), F.col("source").asc_nulls_last())
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rest = by_need.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    capped = F.coalesce(F.sum("_top").over(by_need.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    total = F.sum(F.col("source_size").cast("double")).over(whole)
    step = (ranked.withColumn("_k", F.row_number().over(by_need))
            .withColumn("_rate", (total * F.lit(float(budget)) - capped) / F.sum("_w").over(rest)))
    fits = F.when(F.col("_rate") * F.col("_w") <= F.col("_top"), F.struct("_k", "_rate"))
    return (step.withColumn("_level", F.min(fits).over(whole)["_rate"])
            .select("source", F.col("_slot").cast("int").alias("_slot"), F.col("_w").alias("weight"),
                    F.when(F.col("_level").isNull(), F.col("_top"))
                    .otherwise(F.least(F.col("_top"), F.col("_level") * F.col("_w"))).alias("target")))


def _bucket_digits(docs: DataFrame, text: str) -> int:
    """Hexadecimal digits of the hash that name a bucket: at least 3 (4096 buckets a source), more for larger corpora."""
    size = int(docs.agg(F.sum(F.octet_length(text))).first()[0] or 0)
    return max(3, len(f"{size // (6 * _BUCKET_WORDS):x}"))


def curriculum(docs: DataFrame, schedules: Sequence[Schedule] = SCHEDULES, budget: float = 1.5, cap: float = 2.0,
               doc_id: str = "doc_id", text: str = "text", source: str = "source", keep: Sequence[str] = ()) -> DataFrame:
    """Placements, range-sorted by ``position`` (0..1): doc_id, source, size, source_size, target, bucket and
    number (of the document in its source's bucket: no two documents share all three), offset (of the document in its source's stream), copy (0, 1, ...), take (words taken from this copy), position. A
    document of which nothing is taken has one row with take 0 and no position. ``keep`` names columns of ``docs``
    to carry along, as one struct ``kept`` (say the text itself)."""
    _check(schedules)
    key = F.md5(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(" "), F.md5(F.coalesce(F.col(text), F.lit("")))))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), key.alias("_key"),
                       F.substring(key, 1, _bucket_digits(docs, text)).alias("_bucket"),
                       F.coalesce(F.regexp_count(F.col(text), F.lit(WORDS)), F.lit(0)).cast("long").alias("size"),
                       *([F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept")] if keep else []))
    rows = rows if keep else saved(rows, "mix-sizes")  # without texts to carry, they are read once
    buckets = rows.groupBy("source", "_bucket").agg(F.sum("size").alias("_n"))
    in_source = Window.partitionBy("source").orderBy("_bucket")
    goal = targets(buckets.groupBy("source").agg(F.sum("_n").alias("source_size")), schedules, budget, cap)
    buckets = buckets.select("source", "_bucket",
                             (F.sum("_n").over(in_source.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_from"),
                             F.sum("_n").over(Window.partitionBy("source")).alias("source_size"))
    same = F.col("b.source").eqNullSafe(F.col("g.source"))
    buckets = buckets.alias("b").join(goal.alias("g"), same).select("b.*", "g._slot", "g.target")
    r, b = rows.alias("r"), buckets.alias("b")
    joined = r.join(b, F.col("r.source").eqNullSafe(F.col("b.source")) & (F.col("r._bucket") == F.col("b._bucket"))) \
        .select("r.*", "b._from", "b.source_size", "b._slot", "b.target")
    local = Window.partitionBy("source", "_bucket").orderBy("_key", F.col("doc_id").asc_nulls_first(), "size")
    offset = (F.col("_from") + F.sum("size").over(local.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).alias("offset")
    kept = ["kept"] if keep else []
    number = F.row_number().over(local).alias("number")
    placed = joined.select("doc_id", "source", "size", "source_size", "target", "_slot", F.col("_bucket").alias("bucket"), number, offset, *kept)
    return _placements(placed, schedules, cap, kept)


def _placements(placed: DataFrame, schedules: Sequence[Schedule], cap: float, kept: list[str]) -> DataFrame:
    demand = F.floor(F.col("target") + F.lit(0.5)).cast("long")
    copies = [F.lit(k).cast("long") for k in range(max(1, -int(-cap // 1)))]

    def one(k: Column) -> Column:
        at = F.col("offset") + k * F.col("source_size")
        take = F.greatest(F.least(F.col("size"), demand - at), F.lit(0).cast("long"))
        share = at.cast("double") / F.when(F.col("target") > 0, F.col("target"))
        time = F.lit(None).cast("double")
        for slot, s in enumerate(schedules):
            time = F.when(F.col("_slot") == slot, inverse_demand(share, s)).otherwise(time)
        return F.struct(k.alias("copy"), take.alias("take"), F.when(take > 0, time).alias("position"))

    taken = F.filter(F.array(*[one(k) for k in copies]), lambda x: x["take"] > 0)
    out = (placed.withColumn("_p", F.explode_outer(taken))
           .select("doc_id", "source", "size", "source_size", "target", "bucket", "number", "offset", F.col("_p.copy").alias("copy"),
                   F.coalesce(F.col("_p.take"), F.lit(0).cast("long")).alias("take"), F.col("_p.position").alias("position"), *kept))
    order = [F.col("position").asc_nulls_last(), F.col("source").asc_nulls_last(), F.col("offset").asc(), F.col("doc_id").asc_nulls_first()]
    return out.repartitionByRange(*order).sortWithinPartitions(*order)


def digest(placements: DataFrame) -> DataFrame:
    """One row per document: size, source_size, target, taken (words over all copies), and the first and last of its positions."""
    return (placements.groupBy("source", "bucket", "number", "doc_id", "size", "source_size", "target", "offset")
            .agg(F.sum("take").alias("taken"), F.min("position").alias("first_position"),
                 F.max("position").alias("last_position"))
            .select("doc_id", "size", "source_size", "target", "taken", "first_position", "last_position"))
