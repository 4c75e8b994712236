"""Calibration of confidences: reliability bins, losses, Platt and isotonic fits, reports."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.text import platt

#: Fixed value: above this error a calibrated model is reported with a warning.
ECE_TARGET = 0.08


def bin_of(conf: Column, bins: int = 10) -> Column:
    """Equal-width bin by comparing with the edges i * (1 / bins), lower edge included; NaN is in the last one."""
    edges = [i * (1 / bins) for i in range(1, bins)]
    return reduce(lambda x, e: x + (conf >= F.lit(e)).cast("int"), edges, F.lit(0))


def reliability(rows: DataFrame, conf: str, correct: str, bins: int = 10) -> DataFrame:
    """All bins with their bounds, n, accuracy, mean confidence and gap; empty ones have nulls."""
    got = rows.groupBy(bin_of(F.col(conf), bins).alias("bin")).agg(F.count("*").alias("n"), F.avg(F.col(correct).cast("double")).alias("accuracy"), F.avg(conf).alias("mean_confidence"))
    every = rows.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    out = every.join(F.broadcast(got), "bin", "left")  # a row a bin
    lo = lambda i: F.when(i == bins, 1.0).otherwise(i * F.lit(1 / bins))
    return out.select("bin", lo(F.col("bin")).alias("lo"), lo(F.col("bin") + 1).alias("hi"), F.coalesce("n", F.lit(0).cast("long")).alias("n"), "accuracy", "mean_confidence", F.abs(F.col("accuracy") - F.col("mean_confidence")).alias("gap"))


def ece(bins: DataFrame) -> DataFrame:
    """Expected calibration error of reliability bins: the gaps' mean, weighted by n; 0 without any row."""
    return bins.agg(F.coalesce(F.try_divide(F.sum(F.col("n") * F.coalesce("gap", F.lit(0.0))), F.sum("n")), F.lit(0.0)).alias("ece"))


def losses(rows: DataFrame, conf: str, correct: str) -> DataFrame:
    """Brier score and log loss (probabilities clipped to 1e-6)."""
    y, p = F.col(correct).cast("double"), F.least(F.greatest(F.col(conf), F.lit(1e-6)), F.lit(1 - 1e-6))
    return rows.agg(F.avg(F.pow(F.col(conf) - y, 2)).alias("brier"), F.avg(-(y * F.log(p) + (1 - y) * F.log(1 - p))).alias("log_loss"))


def plot_points(bins: DataFrame) -> DataFrame:
    """(center, accuracy, mean_confidence, n) of the bins with rows."""
    return bins.where("n > 0").select(((F.col("lo") + F.col("hi")) / 2).alias("center"), "accuracy", "mean_confidence", "n")


def table_lines(bins: DataFrame) -> list[str]:
    """The bins as aligned text; empty ones show dashes."""
    show = lambda x: f"{'--' if x is None else f'{x:.3f}':>7}"
    rows = bins.orderBy("bin").collect()  # a row a bin
    return [f"{'bin':>3} {'range':>14} {'n':>6} {'acc':>7} {'conf':>7} {'gap':>7}", *(f"{r.bin:>3} [{r.lo:.2f}, {r.hi:.2f}) {r.n:>6} {show(r.accuracy)} {show(r.mean_confidence)} {show(r.gap)}" for r in rows)]


def _weighted(rows: DataFrame, raw: str, correct: str) -> DataFrame:
    """Equal (confidence, outcome) pairs as one weighted row, so a fit's passes don't grow with repeated confidences."""
    return rows.groupBy((F.col(raw).cast("double") / 100).alias("x"), F.col(correct).cast("double").alias("label")).agg(F.count("*").cast("double").alias("w"))


def fit_platt(rows: DataFrame, raw: str, correct: str) -> dict:
    """An L2 logistic fit (C = 1, intercept free) on raw / 100: coef, intercept, the feature's mean and population deviation,
    n_train, train_ece and train_brier. Rows of one class only raise."""
    n, low, high, mean, std = rows.agg(F.count("*"), F.min(correct), F.max(correct), F.avg(F.col(raw) / 100), F.stddev_pop(F.col(raw) / 100)).first()
    if not n or low == high:
        raise ValueError("calibration needs right and wrong answers")
    data = VectorAssembler(inputCols=["x"], outputCol="v").transform(_weighted(rows, raw, correct))
    fit = LogisticRegression(featuresCol="v", weightCol="w", regParam=1 / n, elasticNetParam=0.0, standardization=False, maxIter=1000, tol=1e-12).fit(data)
    model = {"coef": float(fit.coefficients[0]), "intercept": float(fit.intercept), "feature_mean": float(mean), "feature_std": float(std), "n_train": int(n)}
    told = calibrated(rows, raw, model)
    return model | {"train_ece": ece(reliability(told, "calibrated", correct)).first()[0], "train_brier": losses(told, "calibrated", correct).first()[0]}


def calibrated(rows: DataFrame, raw: str, model: dict, out: str = "calibrated") -> DataFrame:
    return rows.withColumn(out, platt(F.col(raw), model["coef"], model["intercept"]))


def _report(rows: DataFrame, conf: str, correct: str) -> dict:
    return {"n": rows.count(), "ece": ece(reliability(rows, conf, correct)).first()[0], **losses(rows, conf, correct).first().asDict()}


def train_report(rows: DataFrame, raw: str, correct: str) -> tuple[dict, dict]:
    """(model, report): the share of right answers, errors before and after, the improvement, and a warning if it is negative."""
    model = fit_platt(rows, raw, correct)
    before = _report(rows.withColumn("_c", F.col(raw) / 100), "_c", correct)
    share = rows.agg(F.avg(F.col(correct).cast("double"))).first()[0]
    gain = before["ece"] - model["train_ece"]
    return model, {"n": model["n_train"], "share_correct": share, "raw_ece": before["ece"], "raw_brier": before["brier"], "train_ece": model["train_ece"], "train_brier": model["train_brier"], "improvement": gain, "warning": "calibration made it worse" if gain < 0 else None}


def inspect_report(rows: DataFrame, raw: str, correct: str, model: dict) -> dict:
    """n, ece, brier, log_loss, coef and intercept of a fitted model on other rows, and a warning above ECE_TARGET."""
    got = _report(calibrated(rows, raw, model), "calibrated", correct)
    return got | {"coef": model["coef"], "intercept": model["intercept"], "warning": f"ece is above {ECE_TARGET}" if got["ece"] > ECE_TARGET else None}


def fit_isotonic(rows: DataFrame, raw: str, correct: str):
    """A monotone fit for comparison: a function from rows to rows with ``isotonic``."""
    data = VectorAssembler(inputCols=["x"], outputCol="v").transform(_weighted(rows, raw, correct))
    fit = IsotonicRegression(featuresCol="v", weightCol="w", predictionCol="isotonic").fit(data)

    def apply(df: DataFrame) -> DataFrame:
        scaled = VectorAssembler(inputCols=["_x"], outputCol="v").transform(df.withColumn("_x", F.col(raw).cast("double") / 100))
        return fit.transform(scaled).drop("_x", "v")

    return apply
