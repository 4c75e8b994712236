"""Queries over evaluation runs, agreement and calibration."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.functions import text as T
from granary.operators import calibration as K
from granary.operators import harness as H
from granary.operators import metrics as M
from granary.operators import providers as P
from granary.operators.isotonic import isotonic, isotonic_pools
from granary.plans.registry import query
from granary.plans.serving import SERVED, questions, responses
from granary.sources.tables import table

LABELLED = "WITH x AS (SELECT doc_id, quality, toxic, n_chars % 101 AS raw, (n_chars % 101) / 100.0::DOUBLE AS c FROM documents JOIN labels USING (doc_id))\n"


def labelled(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    return rows.withColumn("raw", F.col("n_chars") % 101).withColumn("c", F.col("raw") / 100)


def rounded(df, *names):
    return df.withColumns({c: F.round(c, 6) for c in names})


def one_row(spark, values: dict, kinds: str, digits: int = 6):
    names = [x.split()[0] for x in kinds.split(", ")]
    return spark.createDataFrame([tuple(round(values[c], digits) if isinstance(values[c], float) else values[c] for c in names)], kinds)


KAPPA = """r AS (SELECT doc_id % 3 AS a, CASE WHEN quality = 1 THEN doc_id % 3 ELSE (doc_id + 1) % 3 END AS b FROM labels),
t AS (SELECT count(*) AS n, avg(CAST(a = b AS INTEGER)) AS po, avg(CAST(a = 0 AS INTEGER)) * avg(CAST(b = 0 AS INTEGER)) + avg(CAST(a = 1 AS INTEGER)) * avg(CAST(b = 1 AS INTEGER)) + avg(CAST(a = 2 AS INTEGER)) * avg(CAST(b = 2 AS INTEGER)) AS pe FROM r)"""


def raters(spark, sf_dir):
    return table(spark, sf_dir, "labels").selectExpr("doc_id % 3 AS a", "CASE WHEN quality = 1 THEN doc_id % 3 ELSE (doc_id + 1) % 3 END AS b", "2 AS same")


@query(f"WITH {KAPPA} SELECT n, round((po - pe) / (1 - pe), 6) AS kappa FROM t")
def kappa(spark, sf_dir):
    return rounded(M.kappa(raters(spark, sf_dir), "a", "b"), "kappa")


@query(f"WITH {KAPPA} SELECT 'faithfulness' AS dimension, n, round((po - pe) / (1 - pe), 6) AS kappa, (po - pe) / (1 - pe) >= 0.6 AS passed FROM t UNION ALL SELECT 'relevance', n, NULL, false FROM t")
def judge_validation(spark, sf_dir):
    """A judge that always agrees on one label has no kappa, and fails."""
    got = H.validate_judge(raters(spark, sf_dir), {"faithfulness": ("a", "b"), "relevance": ("same", "same")})
    return got.withColumn("kappa", F.round(F.nanvl("kappa", F.lit(None).cast("double")), 6))


@query(
    """WITH t AS (SELECT count(*) AS n, count(*) FILTER (toxic = 1 AND quality = 0) AS tp, count(*) FILTER (toxic = 0 AND quality = 0) AS fp, count(*) FILTER (toxic = 1 AND quality = 1) AS fn, count(*) FILTER (toxic = 0 AND quality = 1) AS tn FROM labels)
SELECT n, tp, fp, fn, tn, tp + fn AS n_ood, fp + tn AS n_in_scope, round(tp / (tp + fn), 6) AS ood_refusal_rate, round(fp / (fp + tn), 6) AS in_scope_refusal_rate, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM t"""
)
def refusal(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").select((F.col("toxic") == 1).alias("is_ood"), (F.col("quality") == 0).alias("refused"))
    return rounded(M.refusal(rows), "ood_refusal_rate", "in_scope_refusal_rate", "precision", "recall", "f1")


EDGES = " + ".join(f"CAST(c >= {i * 0.1!r}::DOUBLE AS INTEGER)" for i in range(1, 10))
BINNED = LABELLED + f", e AS (SELECT CAST({EDGES} AS INTEGER) AS bin, count(*) AS n, avg(quality) AS a, avg(c) AS m FROM x WHERE c < 0.4 OR c >= 0.5 GROUP BY 1)\n"


def but_one_bin(spark, sf_dir):
    """Without the rows of one bin, so that an empty bin is there."""
    return K.reliability(labelled(spark, sf_dir).where("c < 0.4 OR c >= 0.5"), "c", "quality")


@query(BINNED + "SELECT CAST(b AS INTEGER) AS bin, round(b / 10.0, 6) AS lo, round((b + 1) / 10.0, 6) AS hi, coalesce(n, 0) AS n, round(a, 6) AS accuracy, round(m, 6) AS mean_confidence, round(abs(a - m), 6) AS gap FROM range(0, 10) r(b) LEFT JOIN e ON e.bin = b")
def reliability_bins(spark, sf_dir):
    return rounded(but_one_bin(spark, sf_dir), "lo", "hi", "accuracy", "mean_confidence", "gap")


@query(BINNED + "SELECT round(bin / 10.0 + 0.05, 6) AS center, round(a, 6) AS accuracy, round(m, 6) AS mean_confidence, n FROM e")
def plot_points(spark, sf_dir):
    return rounded(K.plot_points(but_one_bin(spark, sf_dir)), "center", "accuracy", "mean_confidence")


@query(BINNED + "SELECT round(sum(n * abs(a - m)) / sum(n), 6) AS ece FROM e")
def calibration_error(spark, sf_dir):
    return rounded(K.ece(but_one_bin(spark, sf_dir)), "ece")


@query(LABELLED + "SELECT round(avg(pow(c - quality, 2)), 6) AS brier, round(avg(-(quality * ln(least(greatest(c, 1e-6), 1 - 1e-6)) + (1 - quality) * ln(1 - least(greatest(c, 1e-6), 1 - 1e-6)))), 6) AS log_loss FROM x")
def brier_logloss(spark, sf_dir):
    return rounded(K.losses(labelled(spark, sf_dir), "c", "quality"), "brier", "log_loss")


#: Newton's method on the fit's objective, 25 steps from 0.
NEWTON = (
    "WITH RECURSIVE"
    + LABELLED[4:].rstrip()
    + """, g AS (SELECT c, quality AS y, count(*) AS w FROM x GROUP BY ALL),
it AS (SELECT 0 AS step, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b UNION ALL
  SELECT step + 1, a - (hbb * ga - hab * gb) / (haa * hbb - hab * hab), b - (haa * gb - hab * ga) / (haa * hbb - hab * hab) FROM (
    SELECT step, a, b, sum(w * (p - y) * c) + a AS ga, sum(w * (p - y)) AS gb, sum(w * p * (1 - p) * c * c) + 1 AS haa, sum(w * p * (1 - p) * c) AS hab, sum(w * p * (1 - p)) AS hbb
    FROM (SELECT it.*, g.*, 1 / (1 + exp(-(a * c + b))) AS p FROM it, g WHERE step < 25) GROUP BY step, a, b)),
f AS (SELECT a, b FROM it WHERE step = 25),
z AS (SELECT quality AS y, x.c AS raw_c, 1 / (1 + exp(-(a * x.c + b))) AS c, a, b FROM x, f),
"""
    + f"zb AS (SELECT {EDGES} AS bin, count(*) AS n, abs(avg(y) - avg(c)) AS gap FROM z GROUP BY 1), rb AS (SELECT {EDGES} AS bin, count(*) AS n, abs(avg(quality) - avg(c)) AS gap FROM x GROUP BY 1),\n"
    + "m AS (SELECT any_value(a) AS coef, any_value(b) AS intercept, avg(raw_c) AS feature_mean, stddev_pop(raw_c) AS feature_std, count(*) AS n_train, (SELECT sum(n * gap) / sum(n) FROM zb) AS train_ece, avg(pow(c - y, 2)) AS train_brier, avg(y) AS share, avg(pow(raw_c - y, 2)) AS raw_brier, avg(-(y * ln(c) + (1 - y) * ln(1 - c))) AS log_loss FROM z)\n"
)


@query(NEWTON + "SELECT " + ", ".join(f"round({c}, 4) AS {c}" if c != "n_train" else c for c in "coef intercept feature_mean feature_std n_train train_ece train_brier".split()) + " FROM m")
def platt_fit(spark, sf_dir):
    from granary.sources.files import MODEL

    return one_row(spark, K.fit_platt(labelled(spark, sf_dir), "raw", "quality"), MODEL, 4)


@query(NEWTON + "SELECT n_train AS n, round(share, 4) AS share_correct, round((SELECT sum(n * gap) / sum(n) FROM rb), 4) AS raw_ece, round(raw_brier, 4) AS raw_brier, round(train_ece, 4) AS train_ece, round(train_brier, 4) AS train_brier FROM m")
def train_report(spark, sf_dir):
    _, got = K.train_report(labelled(spark, sf_dir), "raw", "quality")
    return one_row(spark, got, "n long, share_correct double, raw_ece double, raw_brier double, train_ece double, train_brier double", 4)


@query(
    LABELLED
    + f""", z AS (SELECT quality AS y, 1 / (1 + exp(-(2.0 * c - 1.0))) AS c FROM x), e AS (SELECT {EDGES} AS bin, count(*) AS n, abs(avg(y) - avg(c)) AS gap FROM z GROUP BY 1)
SELECT count(*) AS n, round((SELECT sum(n * gap) / sum(n) FROM e), 6) AS ece, round(avg(pow(c - y, 2)), 6) AS brier, round(avg(-(y * ln(c) + (1 - y) * ln(1 - c))), 6) AS log_loss, CASE WHEN (SELECT sum(n * gap) / sum(n) FROM e) > 0.08 THEN 'ece is above 0.08' END AS warning FROM z"""
)
def inspect_report(spark, sf_dir):
    got = K.inspect_report(labelled(spark, sf_dir), "raw", "quality", {"coef": 2.0, "intercept": -1.0})
    return one_row(spark, got, "n long, ece double, brier double, log_loss double, warning string")


@query("SELECT doc_id, round(1 / (1 + exp(-(2.0 * (n_chars % 101) / 100 - 1.0))), 6) AS probability FROM documents")
def platt_predict(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.round(T.platt(F.col("n_chars") % 101, 2.0, -1.0), 6).alias("probability"))


@query(
    """WITH p AS (SELECT n_chars % 101 AS raw, sum(quality) AS s, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY 1),
m AS (SELECT a.raw AS j, b.raw AS k, sum(p.s) / sum(p.n) AS mean FROM p a JOIN p b ON a.raw <= b.raw JOIN p ON p.raw BETWEEN a.raw AND b.raw GROUP BY 1, 2),
least AS (SELECT i.raw, m.j, min(mean) AS lo FROM p i JOIN m ON m.j <= i.raw AND m.k >= i.raw GROUP BY 1, 2) SELECT raw, round(max(lo), 6) AS isotonic FROM least GROUP BY raw"""
)
def isotonic_fit(spark, sf_dir):
    """The monotone fit at each confidence, pooled over ranges; in SQL, the highest of the lowest means around it."""
    rows = labelled(spark, sf_dir)
    got = isotonic(rows.select("raw").distinct(), "raw", isotonic_pools(rows, "raw", "quality", size=20))
    return got.select("raw", F.round("isotonic", 6).alias("isotonic"))


@query("SELECT doc_id, CASE WHEN CAST('0x' || substr(sha1(CAST(doc_id AS VARCHAR)), 1, 4) AS INTEGER) % 4 < 2 THEN 'train' WHEN CAST('0x' || substr(sha1(CAST(doc_id AS VARCHAR)), 1, 4) AS INTEGER) % 4 = 2 THEN 'dev' ELSE 'holdout' END AS split FROM documents")
def splits(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", H.split_of(F.col("doc_id")).alias("split"))


@query(
    """WITH c AS (SELECT count(*) AS n, count(*) FILTER (doc_id % 11 = 0) AS errors, count(*) FILTER (quality = 0) AS n_refused, round(avg(quality), 6) AS recall_5, round(avg((doc_id % 100) / 10.0::DOUBLE) FILTER (doc_id % 11 > 0), 6) AS latency_s FROM labels),
t AS (SELECT count(*) FILTER (toxic = 1 AND quality = 0) AS tp, count(*) FILTER (toxic = 0 AND quality = 0) AS fp, count(*) FILTER (toxic = 1 AND quality = 1) AS fn, count(*) FILTER (toxic = 0 AND quality = 1) AS tn FROM labels WHERE doc_id % 11 > 0)
SELECT n, errors, n_refused, recall_5, latency_s, round(2 * tp / (2 * tp + fp + fn), 6) AS ood_f1, round(fp / (fp + tn), 6) AS in_scope_refusal_rate FROM c, t"""
)
def run_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").selectExpr(
        "CASE WHEN toxic = 1 THEN 'ood' ELSE 'factual' END AS category", "CASE WHEN doc_id % 11 = 0 THEN 'failed' END AS error", "quality = 0 AS refused",
        "CAST(quality AS DOUBLE) AS recall_5", "CAST(quality AS DOUBLE) AS recall_20", "toxic AS judge_faithfulness", "toxic AS judge_relevance", "(doc_id % 100) / 10D AS latency_s",
    )
    got = H.summary(rows)
    return got.select("n", "errors", "n_refused", *[F.round(c, 6).alias(c) for c in ("recall_5", "latency_s", "ood_f1", "in_scope_refusal_rate")])


# An evaluation run over all user turns, with the served responses and recorded judge replies.
CATEGORY = "CASE WHEN query_id % 10 = 0 THEN 'ood' WHEN query_id % 3 = 0 THEN 'procedural' ELSE 'definitional' END"
EVALUATED = f"""{SERVED},
cs AS (SELECT *, {CATEGORY} AS category, CASE query_id % 4 WHEN 0 THEN ['b1', 'b3'] WHEN 1 THEN ['b4'] WHEN 2 THEN [] ELSE ['absent'] END AS truth, error IS NULL AS fine FROM served),
res AS (SELECT query_id, category, answer, category = 'ood' AS is_ood_true, is_ood AS is_ood_pred, refused, raw_confidence, calibrated_confidence, CASE WHEN fine THEN intent ELSE 'unknown' END AS intent, coalesce(retrieved, '') AS retrieved, array_to_string(truth, ',') AS truth_names,
  CASE WHEN fine AND len(truth) > 0 THEN CAST(list_has_any(coalesce(names, [])[1:5], truth) AS DOUBLE) END AS recall_5, CASE WHEN fine AND len(truth) > 0 THEN CAST(list_has_any(coalesce(names, [])[1:20], truth) AS DOUBLE) END AS recall_20,
  CASE WHEN fine AND NOT refused AND ranked IS NOT NULL AND query_id % 19 > 0 THEN CAST(query_id % 3 AS DOUBLE) END AS judge_faithfulness, CASE WHEN fine AND NOT refused AND ranked IS NOT NULL AND query_id % 19 > 0 THEN CAST(query_id // 3 % 3 AS DOUBLE) END AS judge_relevance, error FROM cs)"""


def results(spark, sf_dir):
    asked = questions(spark, sf_dir)
    truth = """CASE query_id % 4 WHEN 0 THEN array(named_struct('document', 'b3.pdf', 'section', 's'), named_struct('document', 'b1.PDF', 'section', 't'), named_struct('document', 'b1', 'section', 'u')) WHEN 1 THEN array(named_struct('document', 'b4', 'section', 's'))
      WHEN 2 THEN array(named_struct('document', '', 'section', 's')) ELSE array(named_struct('document', 'absent.pdf', 'section', 's')) END"""
    cases = asked.selectExpr("query_id AS id", f"{CATEGORY} AS category", "1 AS difficulty", "question", f"{truth} AS ground_truth_chunks")
    told = asked.selectExpr("query_id", """CASE WHEN query_id % 19 = 0 THEN 'cannot say' ELSE concat('{"faithfulness": ', query_id % 3, ', "relevance": ', query_id DIV 3 % 3, ', "citation_accuracy": 2}') END AS value""")
    return H.run_harness(cases, responses(spark, sf_dir), P.Replay(told))


@query(f"WITH {EVALUATED} SELECT * FROM res")
def eval_results(spark, sf_dir):
    got = results(spark, sf_dir).withColumnRenamed("case_id", "query_id")
    lists = {"retrieved": F.array_join("retrieved_chunk_ids", ","), "truth_names": F.array_join("ground_truth_doc_names", ",")}
    scores = {c: F.col(c).cast("double") for c in ("judge_faithfulness", "judge_relevance")}
    names = "query_id category answer is_ood_true is_ood_pred refused raw_confidence calibrated_confidence intent retrieved truth_names recall_5 recall_20 judge_faithfulness judge_relevance error"
    return got.withColumns(lists | scores).select(*names.split())


@query(
    f"""WITH {EVALUATED}, t AS (SELECT count(*) FILTER (is_ood_true AND refused) AS tp, count(*) FILTER (NOT is_ood_true AND refused) AS fp, count(*) FILTER (is_ood_true AND NOT refused) AS fn, count(*) FILTER (NOT is_ood_true AND NOT refused) AS tn FROM res WHERE error IS NULL)
SELECT count(*) AS n, count(error) AS errors, count(*) FILTER (refused) AS n_refused, round(avg(recall_5), 6) AS recall_5, round(avg(recall_20), 6) AS recall_20, round(avg(judge_faithfulness), 6) AS faithfulness, round(avg(judge_relevance), 6) AS relevance,
  any_value(round(2 * tp / (2 * tp + fp + fn), 6)) AS ood_f1, any_value(round(tp / (tp + fn), 6)) AS ood_refusal_rate, any_value(round(fp / (fp + tn), 6)) AS in_scope_refusal_rate FROM res, t"""
)
def eval_summary(spark, sf_dir):
    got = H.summary(results(spark, sf_dir))
    return rounded(got, "recall_5", "recall_20", "faithfulness", "relevance", "ood_f1", "ood_refusal_rate", "in_scope_refusal_rate").drop("latency_s")


@query(
    f"""WITH {EVALUATED} SELECT CASE WHEN is_ood_true <> is_ood_pred THEN 'query_parsing' WHEN recall_20 = 0 THEN 'retrieval_miss' WHEN judge_faithfulness < 2 THEN 'hallucination'
  WHEN judge_relevance = 0 AND calibrated_confidence >= 0.85 OR refused AND NOT is_ood_true THEN 'calibration' WHEN judge_relevance < 2 THEN 'ambiguity' END AS bucket, count(*) AS n FROM res WHERE error IS NULL GROUP BY 1"""
)
def failure_buckets(spark, sf_dir):
    rows = results(spark, sf_dir).where("error IS NULL")
    return rows.groupBy(H.failure_bucket(F.lit(True)).alias("bucket")).agg(F.count("*").alias("n"))


@query(
    """WITH r AS (SELECT doc_id, doc_id % 23 = 0 AS is_ood_true, doc_id % 29 = 0 AS is_ood_pred, CASE WHEN doc_id % 31 = 0 THEN NULL WHEN doc_id % 5 = 0 THEN 0.0 ELSE 1.0 END AS recall_20, doc_id % 7 <> 3 AS hit, least(2, doc_id % 11) AS faith, least(2, doc_id % 13) AS cite, CASE WHEN quality = 0 THEN doc_id % 3 ELSE 2 END AS relevance, (doc_id % 101) / 100.0::DOUBLE AS c, doc_id % 17 = 4 AS refused FROM labels)
SELECT doc_id, CASE WHEN is_ood_true <> is_ood_pred THEN 'query_parsing' WHEN recall_20 = 0 THEN 'retrieval_miss' WHEN recall_20 = 1 AND NOT hit THEN 'reranker' WHEN faith < 2 THEN 'hallucination' WHEN cite < 2 THEN 'citation'
  WHEN relevance = 0 AND c >= 0.85 OR refused AND NOT is_ood_true THEN 'calibration' WHEN relevance < 2 THEN 'ambiguity' END AS bucket FROM r"""
)
def failure_causes(spark, sf_dir):
    """Rows of every kind: each of the seven causes is found, and some rows have none."""
    rows = table(spark, sf_dir, "labels").selectExpr(
        "doc_id", "doc_id % 23 = 0 AS is_ood_true", "doc_id % 29 = 0 AS is_ood_pred", "CASE WHEN doc_id % 31 = 0 THEN NULL WHEN doc_id % 5 = 0 THEN 0D ELSE 1D END AS recall_20", "doc_id % 7 <> 3 AS hit", "least(2, doc_id % 11) AS judge_faithfulness",
        "least(2, doc_id % 13) AS judge_citation_accuracy", "IF(quality = 0, doc_id % 3, 2) AS judge_relevance", "(doc_id % 101) / 100D AS calibrated_confidence", "doc_id % 17 = 4 AS refused",
    )
    return rows.select("doc_id", H.failure_bucket(F.col("hit")).alias("bucket"))


@query("SELECT coalesce(c, p) AS category, coalesce(n, 0) AS n, coalesce(planned, 0) AS planned FROM (SELECT 'c' || doc_id % 3 AS c, count(*) AS n FROM labels GROUP BY 1) FULL JOIN (VALUES ('c0', 50), ('c1', 40), ('c9', 20)) v(p, planned) ON c = p")
def category_distribution(spark, sf_dir):
    cases = table(spark, sf_dir, "labels").selectExpr("concat('c', doc_id % 3) AS category")
    return H.distribution(cases, {"c0": 50, "c1": 40, "c9": 20}).fillna(0, ["planned"])


def _metric_rows(spark, sf_dir):
    """A run's figures as (metric, value): shares of labelled documents in their places."""
    got = table(spark, sf_dir, "labels").agg(F.avg("quality").alias("recall_5"), F.avg("toxic").alias("ece"), (1 + F.avg("quality")).alias("faithfulness"), F.lit(float("nan")).alias("ood_f1"))
    return got.unpivot([], ["recall_5", "ece", "faithfulness", "ood_f1"], "metric", "value")


@query(
    """WITH m AS (SELECT avg(quality) AS q, avg(toxic) AS t FROM labels) SELECT metric, round(value, 6) AS value, baseline, passed FROM (
SELECT 'recall_5' AS metric, q AS value, 0.9 AS baseline, q - 0.9 >= -0.03 AS passed FROM m UNION ALL SELECT 'ece', t, 0.01, t - 0.01 <= 0.03 FROM m UNION ALL SELECT 'faithfulness', 1 + q, 1.5, 1 + q - 1.5 >= -0.15 FROM m
UNION ALL SELECT 'ood_f1', NULL, 0.5, false FROM m UNION ALL SELECT 'relevance', NULL, 1.5, false FROM m)"""
)
def regression_gates(spark, sf_dir):
    """An undefined and a missing figure fail."""
    base = spark.createDataFrame([("recall_5", 0.9), ("ece", 0.01), ("faithfulness", 1.5), ("ood_f1", 0.5), ("relevance", 1.5)], "metric string, value double")
    got = H.gates(_metric_rows(spark, sf_dir), base)
    return got.select("metric", F.round(F.nanvl("value", F.lit(None).cast("double")), 6).alias("value"), "baseline", "passed")


@query(
    """WITH m AS (SELECT avg(quality) AS q, avg(toxic) AS t FROM labels) SELECT metric, bound, coalesce(CASE metric WHEN 'recall_5' THEN q >= 0.85 WHEN 'ece' THEN t <= 0.08 WHEN 'faithfulness' THEN 1 + q >= 1.7 END, false) AS passed FROM m,
(VALUES ('recall_5', 0.85), ('recall_20', 0.95), ('mrr', 0.55), ('faithfulness', 1.7), ('relevance', 1.7), ('citation_accuracy', 1.6), ('kappa', 0.6), ('ece', 0.08), ('ood_refusal_rate', 0.95), ('in_scope_refusal_rate', 0.1), ('ood_f1', 0.85)) v(metric, bound)"""
)
def ship_targets(spark, sf_dir):
    return H.ship_targets(_metric_rows(spark, sf_dir)).select("metric", "bound", "passed")


@query(
    LABELLED
    + """, a AS (SELECT quality, CASE WHEN c < 0.45 THEN 'refuse' WHEN c < 0.65 THEN 'verify' WHEN c < 0.85 THEN 'caveat' ELSE 'answer' END AS action FROM x)
SELECT action, count(*) AS n, CAST(sum(CASE WHEN action = 'refuse' THEN 3 WHEN action = 'verify' THEN CASE WHEN quality = 1 THEN 1 ELSE 5 END WHEN quality = 1 THEN 0 ELSE 10 END) AS DOUBLE) AS cost FROM a GROUP BY action"""
)
def policy_cost(spark, sf_dir):
    rows = labelled(spark, sf_dir)
    return H.expected_cost(rows, T.policy_action(F.col("c"), T.DOCUMENTED_POLICY), F.col("quality"))
