"""Joins of values with the intervals that hold them, and of times with the version in force, as equi-joins on bins.

An interval is put into the bins, some power of two wide, of the smallest width that's at least its length: into two of them at most,
however long it is. A value is looked up in its bin of each width that some interval has. So the joined keys are exact matches that
shuffle and spread like any others, and neither side is compared with all of the other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.sources.shared import cut


def _number(df: DataFrame, c: str) -> Column:
    return (F.unix_micros(c) if dict(df.dtypes)[c] == "timestamp" else F.col(c)).cast("double")


def _bin(x: Column, level: Column) -> Column:
    return F.floor(x / F.pow(F.lit(2.0), level)).cast("long")


def interval_join(rows: DataFrame, value: str, intervals: DataFrame, low: str = "low", high: str = "high", by: tuple[str, ...] = (), closed: str = "left", how: str = "left") -> DataFrame:
    """Rows with the fields of each interval (of equal ``by`` columns) that their value lies in; with ``left`` rows in none too.

    closed: ``left`` for low <= value < high, ``right`` for low < value <= high. A null bound is open; an interval that is
    empty or has a NaN bound holds nothing, as a value that's null, NaN or infinite lies in none. Values and bounds are numbers, or
    timestamps on both sides. ``by`` columns are the rows', the intervals' other fields must have names of their own."""
    if closed not in ("left", "right") or how not in ("left", "inner"):
        raise ValueError("closed: left or right; how: left or inner")
    fields = [c for c in intervals.columns if c not in by]
    held = intervals.select(*[F.col(b).alias(f"_by{i}") for i, b in enumerate(by)], _number(intervals, low).alias("_low"), _number(intervals, high).alias("_high"), F.struct(*fields).alias("_fields"))
    asked = rows.withColumn("_value", _number(rows, value))
    finite = F.col("_value").isNotNull() & ~F.isnan("_value") & (F.abs("_value") < float("inf"))
    least, most = asked.where(finite).agg(F.min("_value"), F.max("_value")).first()  # two numbers
    if least is None:
        least = most = 0.0
    # An open end is put where no value is beyond it; the bounds themselves decide.
    start, end = F.greatest(F.coalesce("_low", F.lit(least)), F.lit(least)), F.least(F.coalesce("_high", F.lit(most)), F.lit(most))
    clipped = held.where(~F.isnan(F.coalesce("_low", F.lit(0.0))) & ~F.isnan(F.coalesce("_high", F.lit(0.0)))).withColumns({"_start": start, "_end": end}).where("_start <= _end")
    length = F.col("_end") - F.col("_start")
    level = F.when(length > 0, F.ceil(F.log2(length)).cast("int")).otherwise(F.lit(-30))
    leveled = clipped.withColumn("_level", F.greatest(level, F.lit(-30)))
    bins = F.sequence(_bin(F.col("_start"), F.col("_level")), _bin(F.col("_end"), F.col("_level")))
    placed = cut(leveled.withColumn("_bin", F.explode(bins)).drop("_start", "_end"))
    levels = sorted(r[0] for r in placed.select("_level").distinct().collect())  # some dozens at most
    found_in = (lambda v, a, b: (a.isNull() | (a <= v)) & (b.isNull() | (v < b))) if closed == "left" else (lambda v, a, b: (a.isNull() | (a < v)) & (b.isNull() | (v <= b)))
    if not levels:
        none = rows.select("*", *[F.lit(None).cast(kind).alias(c) for c, kind in intervals.select(*fields).dtypes])
        return none if how == "left" else none.where("false")
    asked = asked.withColumn("_row", F.monotonically_increasing_id()) if how == "left" else asked
    asked = cut(asked) if how == "left" else asked
    looked = asked.where(finite).withColumn("_level", F.explode(F.array(*[F.lit(x) for x in levels]))).withColumn("_bin", _bin(F.col("_value"), F.col("_level")))
    on = (F.col("r._level") == F.col("i._level")) & (F.col("r._bin") == F.col("i._bin"))
    for i, b in enumerate(by):
        on = on & (F.col(f"r.`{b}`") == F.col(f"i._by{i}"))
    met = looked.alias("r").join(placed.alias("i"), on).where(found_in(F.col("r._value"), F.col("i._low"), F.col("i._high")))
    own = [F.col(f"r.`{c}`").alias(c) for c in rows.columns]
    if how == "inner":
        return met.select(*own, "i._fields.*")
    hits = met.select(F.col("r._row").alias("_row"), "i._fields")
    return asked.join(hits, "_row", "left").select(*rows.columns, "_fields.*")


def in_force(versions: DataFrame, since: str, by: tuple[str, ...] = (), until: str = "until") -> DataFrame:
    """Versions with the time at which the next one of the same ``by`` follows them; null for the last. A ``by`` key's versions are
    ordered in one task."""
    return versions.withColumn(until, F.lead(since).over(Window.partitionBy(*(by or (F.lit(0),))).orderBy(since)))


def policy_actions(rows: DataFrame, policies: DataFrame, value: str = "confidence", at: str = "at", policy: str = "policy", default: str = "refuse", rank: tuple[str, ...] = ("action",)) -> DataFrame:
    """Rows with ``version`` and ``action``: the action of the highest bound that the value reaches, in the version of the row's policy
    that was in force; ``default`` below all bounds, before the first version, without a policy, and for an unknown value.

    policies: (policy, version, since, low, action), a row a bound. Versions and bounds are found by interval joins, so there may be any
    number of both. Of equal bounds of a version the last one by ``rank``, columns of policies, decides."""
    versions = in_force(policies.select(policy, "version", "since").distinct(), "since", (policy,))
    dated = interval_join(rows, at, versions, "since", "until", (policy,)).drop("since", "until")
    best = F.max_by("action", F.struct(*rank))
    bounds = policies.groupBy(policy, "version", "low").agg(best.alias("action"))
    bounds = bounds.withColumn("high", F.lead("low").over(Window.partitionBy(policy, "version").orderBy("low")))
    return interval_join(dated, value, bounds, "low", "high", (policy, "version")).drop("low", "high").withColumn("action", F.coalesce("action", F.lit(default)))
