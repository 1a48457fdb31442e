"""Isotonic regression of grouped, weighted points by pooled violators, without a group in one task.

Points are dealt to range slices of (group, x). Each slice pools its own violators; what is left rises within every
slice, so only the borders between neighbouring slices can still violate. Rounds over a written table join the pools at such
borders: two neighbouring slices of a group meet in one task, their border pools are merged with as many pools of either
side as violate, and all others stay where they are. A round takes every second border, those that leave no pool
in a slice join the next ones, and the rounds end when no border violates. A task holds two slices at most, whatever the size
of a group.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from annoscope.operators.prefix import _partitions
from annoscope.session import per_group, written

_POOL = "gid long, slice int, low double, total double, weight double, first int, last int"
_NAMES = ("gid", "slice", "low", "total", "weight", "first", "last")


def _pooled(total: list[float], weight: list[float], new_group: list[bool]) -> list[int]:
    """Where the pools of ordered points begin; ``total`` and ``weight`` get the pools' sums at those places."""
    starts: list[int] = []
    for i in range(len(total)):
        starts.append(i)
        while len(starts) > 1 and not new_group[starts[-1]] and total[starts[-2]] * weight[starts[-1]] >= total[starts[-1]] * weight[starts[-2]]:
            last = starts.pop()
            total[starts[-1]] += total[last]
            weight[starts[-1]] += weight[last]
    return starts


def _first_pools(table: pa.Table) -> pa.Table:
    """One slice's pools."""
    table = table.sort_by([("gid", "ascending"), ("x", "ascending")])
    gid = table.column("gid").to_numpy()
    total, weight = table.column("total").to_pylist(), table.column("weight").to_pylist()
    starts = _pooled(total, weight, [True, *(gid[1:] != gid[:-1]).tolist()] if len(gid) else [])
    rows = table.take(pa.array(starts, pa.int64()))
    own = rows.column("slice")
    return pa.table([rows.column("gid"), own, rows.column("x"), pa.array([total[i] for i in starts]), pa.array([weight[i] for i in starts]), own, own], list(_NAMES))


def _merge_border(table: pa.Table) -> pa.Table:
    """The pools of two neighbouring slices of one group, merged at their border."""
    rows = table.select(list(_NAMES)).sort_by("low").to_pylist()
    left_slice = rows[0]["slice"]
    left = [r for r in rows if r["slice"] == left_slice]
    right = [r for r in rows if r["slice"] != left_slice][::-1]  # the nearest last

    def above(a: dict, b: dict) -> bool:
        return a["total"] * b["weight"] >= b["total"] * a["weight"]

    pool = left.pop()
    while True:
        if right and above(pool, right[-1]):
            other = right.pop()
            pool["last"] = other["last"]
        elif left and above(left[-1], pool):
            other = left.pop()
            pool["low"], pool["first"] = other["low"], other["first"]
        else:
            break
        pool["total"] += other["total"]
        pool["weight"] += other["weight"]
    out = [*left, pool, *right[::-1]]
    return pa.table({n: [r[n] for r in out] for n in _NAMES}, schema=pa.schema(
        [("gid", pa.int64()), ("slice", pa.int32()), ("low", pa.float64()), ("total", pa.float64()), ("weight", pa.float64()), ("first", pa.int32()), ("last", pa.int32())]))


def _cells(pools: DataFrame) -> DataFrame:
    """The slices of each group that hold pools, numbered in order, and whether the border to the next one violates. At most one row
    for each slice and group."""
    mean = F.col("total") / F.col("weight")
    cells = pools.groupBy("gid", "slice").agg(F.min_by(mean, "low").alias("lowest"), F.max_by(mean, "low").alias("highest"))
    order = Window.partitionBy("gid").orderBy("slice")
    return cells.select("gid", "slice", (F.row_number().over(order) - 1).alias("k"), (F.col("highest") > F.lead("lowest").over(order)).alias("bad"))


def _pools(sliced: DataFrame) -> DataFrame:
    pools = written(sliced.groupBy("slice").applyInArrow(lambda t: _first_pools(t), _POOL), "pools")
    while True:
        cells = written(_cells(pools), "cells")
        bad = cells.where("bad").agg(F.count_if(F.col("k") % 2 == 0).alias("even"), F.count_if(F.col("k") % 2 == 1).alias("odd")).first()
        if not bad["even"] and not bad["odd"]:
            return pools
        odd = int(bad["odd"] > bad["even"])
        pair = F.floor((F.col("k") + odd) / 2).cast("int")
        chosen = cells.where(F.col("bad") & (F.col("k") % 2 == odd)).select("gid", pair.alias("pair"))
        touched = cells.withColumn("pair", pair).join(chosen, ["gid", "pair"], "left_semi").select("gid", "slice", "pair")
        joined = pools.join(per_group(touched, "touched"), ["gid", "slice"], "left")
        merged = joined.where("pair IS NOT NULL").groupBy("gid", "pair").applyInArrow(lambda t: _merge_border(t), _POOL)
        pools = written(joined.where("pair IS NULL").select(*_NAMES).unionByName(merged), "pools")


def _look_up(points: pa.Table, pools: pa.Table) -> pa.Table:
    """The mean of the pool of each point of one slice."""
    gid, x = points.column("gid").to_numpy(), points.column("x").to_numpy()
    pools = pools.sort_by([("gid", "ascending"), ("low", "ascending")])
    p_gid, low = pools.column("gid").to_numpy(), pools.column("low").to_numpy()
    mean = pools.column("total").to_numpy() / pools.column("weight").to_numpy()
    order = np.lexsort((np.concatenate([np.zeros(len(low)), np.ones(len(x))]), np.concatenate([low, x]), np.concatenate([p_gid, gid])))
    at = np.maximum.accumulate(np.where(order < len(low), order, -1))  # the last pool that begins at or before it
    value = np.empty(len(x))
    mine = order >= len(low)
    value[order[mine] - len(low)] = mean[at[mine]] if len(low) else np.nan
    return pa.table([points.column("gid"), points.column("x"), pa.array(value)], ["gid", "x", "value"])


def fitted_values(points: DataFrame, group_cols: Sequence[str], x: str, total: str, weight: str, out: str, partitions: int | None = None) -> DataFrame:
    """``(group..., x, out)``: the increasing fit to the means total / weight of points with distinct (group, x)."""
    g = list(group_cols)
    schema = {f.name: f.dataType for f in points.schema.fields}
    groups = per_group(points.select(*g).distinct().withColumn("gid", F.monotonically_increasing_id())) if g else None
    if groups is not None:
        renamed = groups.select(*[F.col(c).alias(f"_g_{c}") for c in g], "gid")
        points = points.join(renamed, [F.col(c).eqNullSafe(F.col(f"_g_{c}")) for c in g])
    else:
        points = points.withColumn("gid", F.lit(0).cast("long"))
    rows = points.select("gid", *[F.col(a).cast("double").alias(b) for a, b in ((x, "x"), (total, "total"), (weight, "weight"))]).where("x IS NOT NULL AND weight > 0")
    ranged = rows.repartitionByRange(_partitions(points, partitions), "gid", "x")
    sliced = written(ranged.withColumn("slice", F.spark_partition_id()), "slices")
    pools = _pools(sliced)
    spread = pools.select("gid", "low", "total", "weight", F.explode(F.sequence("first", "last")).alias("slice"))
    values = sliced.groupBy("slice").cogroup(spread.groupBy("slice")).applyInArrow(lambda a, b: _look_up(a, b), "gid long, x double, value double")
    if groups is not None:
        values = values.join(groups, "gid")
    return values.select(*g, F.col("x").cast(schema[x]).alias(x), F.col("value").alias(out))
