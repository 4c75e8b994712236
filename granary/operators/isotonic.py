"""Isotonic calibration by mergeable pools, for any number of different confidences.

A pool is a range of confidences with the sum and the weight of its outcomes. Neighbouring pools whose means fall are joined; in
whatever order that's done, the same pools are left. So every task pools its own range of confidences, then the ranges are dealt
anew with other borders, until no border has a falling mean: work that stays within ranges is done once, and pools that grow
over a border are few. No task has to hold all pools, and the driver sees two pools a range."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.operators.intervals import interval_join
from granary.operators.scan import Scan, scan
from granary.sources.shared import cut

POOL = "low double, high double, total double, weight double"
#: Pools of a range.
RANGE = 200_000


def _pooled(batches):
    """Rows (low, high, total, weight, part) in order of low: neighbours with falling means joined."""
    stack, part = [], 0
    for b in batches:
        for low, high, total, weight, part in zip(*(c.to_pylist() for c in b.columns)):
            # means total / weight, compared crosswise
            while stack and stack[-1][2] * weight >= total * stack[-1][3]:
                low, _, t, w = stack.pop()
                total, weight = total + t, weight + w
            stack.append((low, high, total, weight))
    cols = list(zip(*stack)) if stack else [[]] * 4
    yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.float64()) for c in cols), pa.array([part] * len(stack), pa.int32())], names=["low", "high", "total", "weight", "part"])


def isotonic_pools(rows: DataFrame, raw: str, correct: str, weight: str | None = None, size: int = RANGE) -> DataFrame:
    """(low, high, value, weight): the pools of the least-squares fit that doesn't fall, in ranges of ``size`` pools. Rows with a null or
    NaN confidence, a null outcome or no weight are left out."""
    x, w = F.col(raw).cast("double"), F.lit(1.0) if weight is None else F.col(weight).cast("double")
    known = rows.select(x.alias("x"), F.col(correct).cast("double").alias("y"), w.alias("w")).where("x IS NOT NULL AND NOT isnan(x) AND y IS NOT NULL AND w > 0")
    points = known.groupBy("x").agg(F.sum(F.col("y") * F.col("w")).alias("total"), F.sum("w").alias("weight"))
    pools, turn, parts = cut(points.select(F.col("x").alias("low"), F.col("x").alias("high"), "total", "weight")), 0, None
    while True:
        least = -(-pools.count() // size) or 1
        # Borders at other shares of the pools each turn; fewer of them after some turns, so there's an end to it.
        parts = least if parts is None else max(1, min(parts, least) // 2) if turn % 4 == 0 else least + turn % 2 if least > 1 else 1
        dealt = pools.drop("part").repartitionByRange(parts, "low").sortWithinPartitions("low").withColumn("part", F.spark_partition_id())
        pools = cut(dealt.mapInArrow(_pooled, f"{POOL}, part int"))
        mean = F.col("total") / F.col("weight")
        ends = pools.groupBy("part").agg(F.min_by(mean, "low").alias("first"), F.max_by(mean, "low").alias("last")).orderBy("part").collect()  # one a range
        if all(a.last <= b.first for a, b in zip(ends, ends[1:])):
            return pools.select("low", "high", mean.alias("value"), "weight")
        turn += 1


class Before(Scan):
    """The pool before each pool."""

    inputs = ("high", "value")
    fields = "end double, level double"

    def initial(self):
        return None, None

    def step(self, state, row):
        return row, state

    def unchanged(self):
        return None

    def add(self, summary, row):
        return row

    def after(self, summary, state):
        return summary


def isotonic(rows: DataFrame, raw: str, pools: DataFrame, out: str = "isotonic") -> DataFrame:
    """Rows with the fit's value: a pool's own within it, on the line between two pools, the ends' values beyond them; null for a null
    confidence."""
    chained = scan(pools.select("low", "high", "value").withColumn("all", F.lit(0)), "all", ["low"], Before()).drop("all")
    pieces = chained.select(F.col("end").alias("_after"), F.col("high").alias("_upto"), F.col("low").alias("_low"), F.col("value").alias("_value_here"), F.col("level").alias("_level_before"))
    top = pools.agg(F.max_by("value", "high")).first()[0]  # the last pool's value
    x = F.col(raw).cast("double")
    met = interval_join(rows, raw, pieces, "_after", "_upto", closed="right")
    line = F.col("_level_before") + (F.col("_value_here") - F.col("_level_before")) * (x - F.col("_after")) / (F.col("_low") - F.col("_after"))
    beyond = F.when(x.isNotNull() & ~F.isnan(x), F.lit(top))
    value = F.when(F.col("_upto").isNull(), beyond).when((x >= F.col("_low")) | F.col("_after").isNull(), F.col("_value_here")).otherwise(line)
    return met.withColumn(out, value).select(*[c for c in rows.columns if c != out], out)
