"""Retrieval, agreement and refusal metrics as aggregations. An undefined figure is null inside and NaN where it is reported."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NAN = float("nan")


def or_nan(c: Column) -> Column:
    return F.coalesce(c, F.lit(NAN))


def recall_at(retrieved: Column, truth: Column, k: int) -> Column:
    """1 if any of the first k retrieved is true, else 0; null without a truth."""
    any_hit = F.exists(F.slice(retrieved, 1, k), lambda x: F.array_contains(truth, x)).cast("double")
    return F.when(F.size(truth) > 0, any_hit)


def precision_at(retrieved: Column, truth: Column, k: int) -> Column:
    """Hits among the first k over k, however few were retrieved; repeated hits count; 0 for k of 0 or less."""
    if k <= 0:
        return F.lit(0.0)
    return F.size(F.filter(F.slice(retrieved, 1, k), lambda x: F.array_contains(truth, x))) / k


def reciprocal_rank(retrieved: Column, truth: Column) -> Column:
    """1 over the place of the first hit, 0 without one."""
    hits = F.transform(retrieved, lambda x, i: F.when(F.array_contains(truth, x), 1.0 / (i + 1)).otherwise(0.0))
    return F.coalesce(F.array_max(hits), F.lit(0.0))


def retrieval_cases(cases: DataFrame, ks=(5, 20)) -> DataFrame:
    """Cases (query_id, retrieved array, truth array; nulls are empty) with recall_k, precision_k and rr."""
    none = F.array().cast(cases.schema["retrieved"].dataType)
    r, t = F.coalesce("retrieved", none), F.coalesce("truth", none)
    each = [c for k in ks for c in (recall_at(r, t, k).alias(f"recall_{k}"), precision_at(r, t, k).alias(f"precision_{k}"))]
    return cases.select("query_id", *each, reciprocal_rank(r, t).alias("rr"))


def aggregate_retrieval(cases: DataFrame, ks=(5, 20)) -> DataFrame:
    """One row: n, mean recalls over the cases with a truth, mean precisions and mrr over all. Without any case all means are
    null; without any truth the recalls are NaN."""
    per = retrieval_cases(cases, ks)
    means = [c for k in ks for c in (F.when(F.count("*") > 0, or_nan(F.avg(f"recall_{k}"))).alias(f"recall_{k}"), F.avg(f"precision_{k}").alias(f"precision_{k}"))]
    return per.agg(F.count("*").alias("n"), *means, F.avg("rr").alias("mrr"))


def document_recall(names: Column, truth: Column, k: int) -> Column:
    """recall_at over the document names of the first k retrieved chunks; a null list counts as nothing retrieved."""
    return recall_at(F.coalesce(names, F.array().cast("array<string>")), truth, k)


def truth_names(chunks: Column) -> Column:
    """Sorted distinct document names of truth entries, without ``.pdf`` in any case; blank ones are left out."""
    names = F.transform(chunks, lambda c: F.regexp_replace(F.coalesce(c["document"], F.lit("")), r"(?i)\.pdf\z", ""))
    return F.array_sort(F.array_distinct(F.filter(names, lambda n: n != "")))


def kappa(rows: DataFrame, a: str, b: str, categories=(0, 1, 2)) -> DataFrame:
    """One row: n and Cohen's kappa; NaN when there is no row or chance agreement is 1. A null label, or one outside the
    categories, raises."""
    n = F.count("*")
    share = lambda c, k: F.try_divide(F.count_if(F.col(c) == k), n)
    known = F.coalesce(F.col(a).isin(*categories) & F.col(b).isin(*categories), F.lit(False))
    chance = reduce(Column.__add__, [share(a, k) * share(b, k) for k in categories])
    got = rows.agg(n.alias("n"), F.count_if(~known).alias("bad"), F.try_divide(F.count_if(F.col(a) == F.col(b)), n).alias("po"), chance.alias("pe"))
    value = or_nan(F.try_divide(F.col("po") - F.col("pe"), 1 - F.col("pe")))
    raised = F.raise_error(F.concat(F.col("bad").cast("string"), F.lit(f" rows have a label outside {tuple(categories)}"))).cast("double")
    return got.select("n", F.when(F.col("bad") > 0, raised).otherwise(value).alias("kappa"))


def refusal(rows: DataFrame) -> DataFrame:
    """Rows (is_ood, refused): counts, rates and F1 (NaN when precision or recall is zero or undefined)."""
    ood, no = F.col("is_ood"), F.col("refused")
    got = rows.agg(F.count("*").alias("n"), F.count_if(ood & no).alias("tp"), F.count_if(~ood & no).alias("fp"), F.count_if(ood & ~no).alias("fn"), F.count_if(~ood & ~no).alias("tn"))
    p, r = F.try_divide("tp", F.col("tp") + F.col("fp")), F.try_divide("tp", F.col("tp") + F.col("fn"))
    in_scope = F.try_divide("fp", F.col("fp") + F.col("tn"))
    return got.select(
        "*", (F.col("tp") + F.col("fn")).alias("n_ood"), (F.col("fp") + F.col("tn")).alias("n_in_scope"), or_nan(r).alias("ood_refusal_rate"), or_nan(in_scope).alias("in_scope_refusal_rate"),
        or_nan(p).alias("precision"), or_nan(r).alias("recall"), or_nan(F.when((p > 0) & (r > 0), 2 * p * r / (p + r))).alias("f1"),
    )
