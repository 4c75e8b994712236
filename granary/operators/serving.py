"""Routing replies, point ids, prompts, and the flow that answers a table of questions."""

from __future__ import annotations

import json
import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.text import confidence, guarded, platt, without_tag

#: The name space for point ids (RFC 4122, DNS) and the intents.
DNS = "6ba7b8109dad11d180b400c04fd430c8"
INTENTS = ("lookup", "procedural", "definitional", "synthesis", "ood")
ROUTE = "intent string, is_ood boolean, ood_confidence double, doc_scope array<string>"
SCORES = ("faithfulness", "relevance", "citation_accuracy")
NOTICES = {
    "refusal": "This could not be answered with enough confidence from the documents at hand; please ask a specialist.",
    "notice": "Note: the passages found answer this in part only; please check the cited documents.",
    "ood": "This question is outside the documents that this service covers.",
}
GENERATE = "Context passages:\n{context}\n\nQuestion: {question}\n"
JUDGE = """Rate the answer by the passages alone. Give each of faithfulness, relevance and citation_accuracy as 0, 1 or 2:
faithfulness: 2 every claim is in a passage, 1 small additions, 0 unsupported claims;
relevance: 2 answers the question, 1 in part, 0 not at all;
citation_accuracy: 2 all citations fit, 1 some, 0 none.
Reply with one JSON object of these three and a short rationale.

Question:
{question}

Passages:
{chunks}

Answer:
{answer}
"""
CHUNK = ("chunk_id", "doc_name", "section_path", "page_num", "text", "token_count")


def point_id(chunk_id: Column) -> Column:
    """UUID version 5 of a chunk id."""
    h = F.sha1(F.concat(F.unhex(F.lit(DNS)), chunk_id.cast("string").cast("binary")))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def json_object(reply: str | None) -> dict:
    """The object between a reply's first and last brace, as strict JSON; none raises ValueError."""
    found = re.search(r"\{.*\}", reply or "", re.DOTALL)
    got = json.loads(found[0]) if found else None
    if not isinstance(got, dict):
        raise ValueError("no JSON object")
    return got


def parse_route(reply: str | None) -> tuple:
    """A model's reply to (intent, is_ood, ood_confidence, doc_scope).

    A reply without a strict JSON object, or with a field of a wrong type (is_ood no boolean, ood_confidence no finite number,
    doc_scope neither null nor a list of texts), takes the default route: lookup over all documents. Missing fields take
    their defaults, an unknown intent is lookup, an empty scope is none."""
    default = ("lookup", False, 0.0, None)
    try:
        got = json_object(reply)
    except ValueError:
        return default
    ood, sure, scope, intent = got.get("is_ood", False), got.get("ood_confidence", 0.0), got.get("doc_scope"), got.get("intent")
    typed = isinstance(ood, bool) and isinstance(sure, int | float) and not isinstance(sure, bool) and math.isfinite(sure)
    if not typed or not (scope is None or isinstance(scope, list) and all(isinstance(x, str) for x in scope)):
        return default
    return (intent if intent in INTENTS else "lookup", ood, float(sure), scope or None)


def route(reply: Column) -> Column:
    """A struct of intent, is_ood, ood_confidence and doc_scope. Spark's own JSON functions accept a tail after the object, so
    the strict parse is an Arrow function."""
    return F.udf(parse_route, ROUTE, useArrow=True)(reply)


def parse_judge(reply: str | None) -> tuple | None:
    """A judge's reply to (faithfulness, relevance, citation_accuracy, rationale); null without three whole numbers."""
    try:
        got = json_object(reply)
        return (*(int(got[s]) for s in SCORES), str(got.get("rationale", "")))
    except (ValueError, TypeError, KeyError, OverflowError):
        return None


def judge(reply: Column) -> Column:
    return F.udf(parse_judge, f"{' int, '.join(SCORES)} int, rationale string", useArrow=True)(reply)


def correct(scores: Column) -> Column:
    """1 when the answer is fully faithful and at least partly relevant."""
    return ((scores["faithfulness"] == 2) & (scores["relevance"] >= 1)).cast("int")


def refused_early(routes: DataFrame, least: float = 0.85) -> tuple[DataFrame, DataFrame]:
    """(questions refused without retrieval, the others). An unknown confidence goes on."""
    out = F.coalesce(F.col("is_ood") & (F.col("ood_confidence") >= least), F.lit(False))
    return routes.where(out), routes.where(~out)


def without_hits(questions: DataFrame, ranked: DataFrame) -> DataFrame:
    """Questions for which nothing was retrieved: they are refused."""
    return questions.join(ranked.select("query_id").distinct(), "query_id", "left_anti")


def _passages(rows: Column) -> Column:
    numbered = lambda r, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] ("), r["doc_name"], F.lit(" | "), F.array_join(F.slice(r["path"], 2, F.greatest(F.size(r["path"]) - 1, F.lit(0))), " > "), F.lit(")\n"), r["text"])
    return F.array_join(F.transform(rows, numbered), "\n\n")


def context(ranked: DataFrame) -> DataFrame:
    """Rows (query_id, rank, doc_name, path, text) to (query_id, context): numbered passages in rank order. The rows of
    a query are its top k, so they fit one task."""
    rows = F.array_sort(F.collect_list(F.struct("rank", "doc_name", "path", "text")))
    return ranked.groupBy("query_id").agg(rows.alias("rows")).select("query_id", _passages(F.col("rows")).alias("context"))


def render(template: str, **values: Column) -> Column:
    """The template with each {name} replaced at once: what a value holds is never replaced again."""
    parts: list = [template]
    for name in values:
        cut = [[x] if not isinstance(x, str) else reduce(lambda a, b: [*a, (name,), b], x.split("{" + name + "}")[1:], [x.split("{" + name + "}")[0]]) for x in parts]
        parts = [y for x in cut for y in x]
    return F.concat(*[F.lit(x) if isinstance(x, str) else F.coalesce(values[x[0]].cast("string"), F.lit("")) for x in parts])


def chunks_of(ranked: DataFrame, rank: str, score: str) -> DataFrame:
    """(query_id, chunks): a query's chunks in rank order, with their scores."""
    held = F.struct(F.col(rank).alias("rank"), *CHUNK, F.col(score).alias("score"))
    return ranked.groupBy("query_id").agg(F.array_sort(F.collect_list(held)).alias("chunks"))


def serve(questions: DataFrame, corpus: DataFrame, route_by, generate_by, embed, score, calibrator: dict | None = None, notices: dict = NOTICES, template: str = GENERATE, least_ood: float = 0.85, k: int = 20, best: int = 5) -> DataFrame:
    """Questions (query_id, question) to responses, a row each.

    route_by, generate_by: providers (see providers.py) that add a reply struct; embed: adds an ``embedding`` of ``question``;
    score: the reranker's column over question and text; corpus: chunks (CHUNK fields, embedding). The three exits are
    branches: out of scope by the route (no retrieval), nothing retrieved, and answered, where the calibrated confidence
    decides. Replies are saved before they are used, so that no branch asks a model again. A failed call gives an
    error row. raw confidence 0-100 is divided by 100 once, or goes through the calibrator (coef, intercept)."""
    from granary.operators.providers import CALL, USAGE
    from granary.operators.retrieval import cosine_topk, rerank, with_payload
    from granary.sources.shared import shared_root

    shared_root(questions.sparkSession)
    if not questions.sparkSession.sparkContext.getCheckpointDir():
        questions.sparkSession.sparkContext.setCheckpointDir(shared_root(questions.sparkSession))
    asked = route_by(questions.select("query_id", "question"), "question", "_route").checkpoint()
    asked = asked.withColumn("r", F.when(F.col("_route")["error"].isNull(), route(F.col("_route")["value"]))).select("query_id", "question", "r.*", F.col("_route")["error"].alias("error"), F.col("_route")["latency_s"].alias("route_s")).checkpoint()
    failed = asked.where("error IS NOT NULL")
    out, going = refused_early(asked.where("error IS NULL"), least_ood)
    found = with_payload(cosine_topk(embed(going), corpus, k, key="chunk_id", query_key="query_id", scope="doc_scope", name="doc_name"), corpus).checkpoint()
    ranked = rerank(found.join(going.select("query_id", "question"), "query_id"), score(F.col("question"), F.col("text")), best).checkpoint()
    none = without_hits(going, ranked)
    texts = context(ranked.select("query_id", F.col("rerank").alias("rank"), "doc_name", F.col("section_path").alias("path"), "text"))
    prompts = going.join(texts, "query_id").withColumn("prompt", render(template, context=F.col("context"), question=F.col("question"))).drop("context")
    told = generate_by(prompts, "prompt", "_reply").checkpoint()
    raw = confidence(F.col("_reply")["value"])
    sure = platt(raw, calibrator["coef"], calibrator["intercept"]) if calibrator else raw / 100
    fine = F.col("_reply")["error"].isNull()
    final = guarded(without_tag(F.col("_reply")["value"]), sure, notices["refusal"], notices["notice"])
    answered = told.withColumns({"g": F.when(fine, final), "raw": F.when(fine, raw), "sure": F.when(fine, sure)})

    def response(df, answer, is_ood, refused, raw=F.lit(0), sure=F.lit(0.0), error=F.lit(None).cast("string"), used=F.lit(None).cast(USAGE), seconds=F.lit(None).cast("double")):
        return df.select("query_id", "question", answer.alias("answer"), F.lit(is_ood).alias("is_ood"), refused.alias("refused"), raw.cast("int").alias("raw_confidence"), sure.cast("double").alias("calibrated_confidence"), "intent", "doc_scope", used.alias("usage"), error.alias("error"), (F.coalesce("route_s", F.lit(0.0)) + F.coalesce(seconds, F.lit(0.0))).alias("latency_s"))

    no = F.lit(True)
    reply = F.col("_reply").cast(CALL)
    branches = [
        response(failed, F.lit(""), False, F.lit(False), error=F.col("error")),
        response(out, F.lit(notices["ood"]), True, no),
        response(none, F.lit(notices["refusal"]), False, no),
        response(answered, F.coalesce(F.col("g")["answer"], F.lit("")), False, F.coalesce(F.col("g")["refused"], F.lit(False)), F.coalesce("raw", F.lit(0)), F.coalesce("sure", F.lit(0.0)), reply["error"], reply["usage"], reply["latency_s"]),
    ]
    every = reduce(DataFrame.unionByName, branches)
    got = every.join(chunks_of(found, "rank", "score").withColumnRenamed("chunks", "retrieved_chunks"), "query_id", "left")
    return got.join(chunks_of(ranked, "rerank", "rerank_score").withColumnRenamed("chunks", "ranked_chunks"), "query_id", "left")
