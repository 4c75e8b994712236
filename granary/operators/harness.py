"""Evaluation runs: results, judging, summary, judge validation, splits, gates, targets, failure buckets, logs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.operators.metrics import document_recall, kappa, or_nan, refusal, truth_names
from granary.operators.serving import JUDGE, SCORES, judge, render

#: How far a metric may move for the worse (negative: it should be high).
GATES = {"recall_5": -0.03, "faithfulness": -0.15, "relevance": -0.15, "ece": 0.03, "ood_f1": -0.05}
#: What a release has to reach (metric: bound, whether the bound is a least value).
TARGETS = {
    "recall_5": (0.85, True), "recall_20": (0.95, True), "mrr": (0.55, True), "faithfulness": (1.7, True), "relevance": (1.7, True), "citation_accuracy": (1.6, True),
    "kappa": (0.6, True), "ece": (0.08, False), "ood_refusal_rate": (0.95, True), "in_scope_refusal_rate": (0.10, False), "ood_f1": (0.85, True),
}
#: Planned questions of each category.
DISTRIBUTION = {"single_doc_factual": 50, "multi_doc_synthesis": 50, "procedural": 40, "definitional": 40, "ood": 20}


def dry_run(cases: DataFrame) -> DataFrame:
    """(id, category, difficulty, question): the question set alone, nothing is asked."""
    return cases.select("id", "category", "difficulty", "question")


def run_harness(cases: DataFrame, responses: DataFrame, judge_by=None) -> DataFrame:
    """Cases (see sources.files.CASES) and their responses (query_id = id) to one result row each.

    Recall is by documents, over the first 5 and 20 retrieved chunks: null without a truth, 0 where nothing was retrieved.
    judge_by (a provider) rates answers that weren't refused and have passages; a reply that can't be read gives nulls.
    A failed case keeps its error, an empty answer, no recall and no score. is_ood_true is the case's, is_ood_pred the response's."""
    rows = cases.withColumn("_truth", truth_names(F.col("ground_truth_chunks"))).join(responses.withColumnRenamed("query_id", "id").drop("question"), "id", "left")
    rows = rows.withColumn("error", F.when(F.col("answer").isNull(), "no response").otherwise(F.col("error")))
    fine = F.col("error").isNull()
    names = F.transform("retrieved_chunks", lambda c: c["doc_name"])
    recall = lambda k: F.when(fine, document_recall(names, F.col("_truth"), k))
    rows = rows.withColumns({"recall_5": recall(5), "recall_20": recall(20)})
    none = F.lit(None).cast(f"struct<{','.join(f'{s}:int' for s in SCORES)},rationale:string>")
    if judge_by is not None:
        asked = rows.where(fine & ~F.col("refused") & (F.size("ranked_chunks") > 0))
        numbered = F.array_join(F.transform("ranked_chunks", lambda c, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), c["text"])), "\n\n")
        prompts = asked.select("id", render(JUDGE, question=F.col("question"), chunks=numbered, answer=F.col("answer")).alias("prompt"))
        told = judge_by(prompts.withColumn("query_id", F.col("id")), "prompt", "_reply").select("id", judge(F.col("_reply")["value"]).alias("_judge"))
        rows = rows.join(told, "id", "left")
    else:
        rows = rows.withColumn("_judge", none)
    or_else = lambda c, x: F.when(fine, F.col(c)).otherwise(F.lit(x)).alias(c)
    return rows.select(
        F.col("id").alias("case_id"), "category", "difficulty", "question", or_else("answer", ""), (F.col("category") == "ood").alias("is_ood_true"), F.coalesce("is_ood", F.lit(False)).alias("is_ood_pred"),
        or_else("refused", False), or_else("raw_confidence", 0), or_else("calibrated_confidence", 0.0), or_else("intent", "unknown"),
        F.coalesce(F.transform("retrieved_chunks", lambda c: c["chunk_id"].cast("string")), F.array().cast("array<string>")).alias("retrieved_chunk_ids"), F.col("_truth").alias("ground_truth_doc_names"), "recall_5", "recall_20",
        *[F.col("_judge")[s].alias(f"judge_{s}") for s in SCORES], F.col("_judge")["rationale"].alias("judge_rationale"), F.round("latency_s", 3).alias("latency_s"), "error",
    )


def summary(results: DataFrame) -> DataFrame:
    """One row over results (category, error, refused, recall_5, recall_20, judge_faithfulness, judge_relevance, latency_s).
    Means skip nulls and are NaN without any value; refusal figures and latency leave out rows with an error."""
    fine = F.col("error").isNull()
    means = [or_nan(F.avg(c)).alias(a) for c, a in (("recall_5", "recall_5"), ("recall_20", "recall_20"), ("judge_faithfulness", "faithfulness"), ("judge_relevance", "relevance"))]
    head = results.agg(F.count("*").alias("n"), F.count_if(~fine).alias("errors"), F.count_if(F.coalesce("refused", F.lit(False))).alias("n_refused"), *means, or_nan(F.avg(F.when(fine, F.col("latency_s")))).alias("latency_s"))
    cases = results.where(fine).select(F.coalesce(F.col("category") == "ood", F.lit(False)).alias("is_ood"), F.coalesce("refused", F.lit(False)).alias("refused"))
    rates = refusal(cases).select(F.col("f1").alias("ood_f1"), "ood_refusal_rate", "in_scope_refusal_rate")
    return head.join(F.broadcast(rates), F.lit(True))  # one row each


def validate_judge(rows: DataFrame, dimensions: dict[str, tuple[str, str]], least: float = 0.6) -> DataFrame:
    """(dimension, n, kappa, passed) for each pair of rater columns; an undefined kappa fails."""
    each = [kappa(rows, a, b).select(F.lit(name).alias("dimension"), "n", "kappa", (~F.isnan("kappa") & (F.col("kappa") >= least)).alias("passed")) for name, (a, b) in dimensions.items()]
    return reduce(DataFrame.unionByName, each)


def split_of(key: Column) -> Column:
    """train, dev or holdout (2 : 1 : 1), always the same for a key."""
    part = F.conv(F.substring(F.sha1(key.cast("string").cast("binary")), 1, 4), 16, 10).cast("int") % 4
    return F.when(part < 2, "train").when(part == 2, "dev").otherwise("holdout")


def gates(current: DataFrame, baseline: DataFrame, allowed: dict[str, float] = GATES) -> DataFrame:
    """Rows (metric, value) of two runs to (metric, value, baseline, change, passed); a missing value fails."""
    limit = F.coalesce(*[F.when(F.col("metric") == m, F.lit(x)) for m, x in allowed.items()])
    old = baseline.select("metric", F.col("value").alias("baseline"))
    got = old.where(F.col("metric").isin(*allowed)).join(current.select("metric", "value"), "metric", "left").withColumn("change", F.col("value") - F.col("baseline"))
    fine = F.when(limit < 0, F.col("change") >= limit).otherwise(F.col("change") <= limit)
    return got.select("metric", "value", "baseline", "change", F.coalesce(fine & ~F.isnan("change"), F.lit(False)).alias("passed"))


def ship_targets(metrics: DataFrame, targets: dict = TARGETS) -> DataFrame:
    """Every target (metric, bound, value, passed) against rows (metric, value); a missing or undefined value fails."""
    spark = metrics.sparkSession
    wanted = spark.createDataFrame([(m, b, least) for m, (b, least) in targets.items()], "metric string, bound double, least boolean")
    got = wanted.join(metrics, "metric", "left")
    reached = F.when(F.col("least"), F.col("value") >= F.col("bound")).otherwise(F.col("value") <= F.col("bound"))
    return got.select("metric", "bound", "value", F.coalesce(reached & ~F.isnan("value"), F.lit(False)).alias("passed"))


def failure_bucket(reranked_hit: Column) -> Column:
    """The first cause that fits a failed result row, else null. reranked_hit: whether a true document is among the reranked."""
    c = F.col
    low = lambda s: c(f"judge_{s}") < 2
    return (
        F.when(c("is_ood_true") != c("is_ood_pred"), "query_parsing").when(c("recall_20") == 0, "retrieval_miss").when((c("recall_20") == 1) & ~reranked_hit, "reranker")
        .when(low("faithfulness"), "hallucination").when(low("citation_accuracy"), "citation")
        .when((c("judge_relevance") == 0) & (c("calibrated_confidence") >= 0.85) | (c("refused") & ~c("is_ood_true")), "calibration").when(c("judge_relevance") < 2, "ambiguity")
    )


def distribution(cases: DataFrame, planned: dict = DISTRIBUTION) -> DataFrame:
    """(category, n, planned): questions of each category, planned or present."""
    plan = cases.sparkSession.createDataFrame(list(planned.items()), "category string, planned int")
    have = cases.groupBy("category").agg(F.count("*").alias("n"))
    return plan.join(have, "category", "full").select("category", F.coalesce("n", F.lit(0).cast("long")).alias("n"), "planned")


def query_log(responses: DataFrame) -> DataFrame:
    """(query_id, log): a JSON record a question: hits, rerank scores, confidences, action, latency."""
    what = F.when(F.col("error").isNotNull(), "error").when(F.col("is_ood"), "out_of_scope").when(F.col("refused"), "refuse").when(F.col("calibrated_confidence") < 0.85, "notice").otherwise("answer")
    fields = F.struct("query_id", "question", F.transform("retrieved_chunks", lambda c: c["chunk_id"]).alias("hits"), F.transform("ranked_chunks", lambda c: c["score"]).alias("rerank_scores"), "raw_confidence", "calibrated_confidence", what.alias("action"), "latency_s")
    return responses.select("query_id", F.to_json(fields).alias("log"))


def expected_cost(rows: DataFrame, action: Column, correct: Column, wrong: float = 10.0, delayed: float = 1.0, refused: float = 3.0) -> DataFrame:
    """(action, n, cost): what a policy's decisions cost: wrong answers that pass, right ones delayed by a check, refusals."""
    checked = action.isin("verify")
    cost = F.when(action == "refuse", refused).when(checked, F.when(correct == 1, delayed).otherwise(wrong / 2)).when(correct == 1, 0.0).otherwise(wrong)
    return rows.groupBy(action.alias("action")).agg(F.count("*").alias("n"), F.sum(cost).alias("cost"))
