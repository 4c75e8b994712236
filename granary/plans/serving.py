"""Queries over routing, guardrails and the serving flow."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from granary.functions import text as T
from granary.operators import harness as H
from granary.operators import providers as P
from granary.operators import serving as S
from granary.operators.intervals import policy_actions as actions_in_force
from granary.operators.ledger import Ledger, call_key
from granary.operators.retrieval import overlap
from granary.plans.registry import query
from granary.plans.retrieval import ASKED, WORDS, questions
from granary.sources.shared import new_folder
from granary.sources.tables import table


@query("SELECT doc_id, CASE WHEN n_chars % 7 = 0 THEN 50 ELSE least(100, CAST(n_chars % 150 AS INTEGER)) END AS confidence, 'answer' AS answer FROM documents")
def confidence_tag(spark, sf_dir):
    reply = F.when(F.col("n_chars") % 7 == 0, F.lit("answer  ")).otherwise(F.concat(F.lit("answer <Confidence> "), (F.col("n_chars") % 150).cast("string"), F.lit("</confidence>\n")))
    rows = table(spark, sf_dir, "documents").select("doc_id", reply.alias("reply"))
    return rows.select("doc_id", T.confidence(F.col("reply")).alias("confidence"), T.without_tag(F.col("reply")).alias("answer"))


@query("SELECT CASE WHEN n_chars % 101 < 70 THEN 'refuse' WHEN n_chars % 101 < 85 THEN 'notice' ELSE 'answer' END AS action, count(*) AS n FROM documents GROUP BY 1")
def guardrail(spark, sf_dir):
    conf = (F.col("n_chars") % 101) / 100
    return table(spark, sf_dir, "documents").groupBy(T.action(conf).alias("action")).agg(F.count("*").alias("n"))


@query(
    """SELECT doc_id, CASE WHEN doc_id % 13 = 0 OR n_chars % 101 < 70 THEN 'NO' WHEN n_chars % 101 < 85 THEN 'a' || doc_id || chr(10) || chr(10) || 'CHECK' ELSE 'a' || doc_id || '  ' END AS answer, doc_id % 13 = 0 OR n_chars % 101 < 70 AS refused FROM documents"""
)
def guarded_answers(spark, sf_dir):
    """The refusal in place of the answer, or the notice below it; an unknown confidence refuses."""
    conf = F.when(F.col("doc_id") % 13 != 0, (F.col("n_chars") % 101) / 100)
    g = T.guarded(F.concat(F.lit("a"), F.col("doc_id"), F.lit("  ")), conf, "NO", "CHECK")
    return table(spark, sf_dir, "documents").select("doc_id", g.alias("g")).select("doc_id", "g.answer", "g.refused")


@query("SELECT CASE WHEN n_chars % 101 < 45 THEN 'refuse' WHEN n_chars % 101 < 65 THEN 'verify' WHEN n_chars % 101 < 85 THEN 'caveat' ELSE 'answer' END AS action, count(*) AS n FROM documents GROUP BY 1")
def policy_actions(spark, sf_dir):
    """The documented four actions."""
    conf = (F.col("n_chars") % 101) / 100
    return table(spark, sf_dir, "documents").groupBy(T.policy_action(conf, T.DOCUMENTED_POLICY).alias("action")).agg(F.count("*").alias("n"))


@query("""WITH h AS (SELECT doc_id, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(CAST(doc_id AS VARCHAR))) AS x FROM documents)
SELECT doc_id, concat(substr(x, 1, 8), '-', substr(x, 9, 4), '-5', substr(x, 14, 3), '-', substr('89ab', CAST(CAST('0x' || substr(x, 17, 1) AS INTEGER) % 4 + 1 AS INTEGER), 1), substr(x, 18, 3), '-', substr(x, 21, 12)) AS point_id FROM h""")
def point_ids(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", S.point_id(F.col("doc_id")).alias("point_id"))


@query(
    """SELECT doc_id, CASE WHEN doc_id % 7 > 2 AND doc_id % 5 < 4 THEN 'synthesis' ELSE 'lookup' END AS intent, doc_id % 7 > 2 AND doc_id % 3 = 0 AS is_ood,
  CASE WHEN doc_id % 7 > 2 THEN (doc_id % 100) / 100.0::DOUBLE ELSE 0.0 END AS confidence, CASE WHEN doc_id % 7 > 2 AND doc_id % 2 = 0 THEN source END AS scope FROM documents"""
)
def routes(spark, sf_dir):
    """Of seven replies one has a tail, one a comma too many and one a boolean as text: they take the default route."""
    body = "concat('Sure: {\"intent\": \"', CASE WHEN doc_id % 5 < 4 THEN 'synthesis' ELSE 'other' END, '\", \"is_ood\": ', IF(doc_id % 7 = 2, '\"true\"', CAST(doc_id % 3 = 0 AS STRING)), ', \"ood_confidence\": ', (doc_id % 100) / 100D, ', \"doc_scope\": [', CASE WHEN doc_id % 2 = 0 THEN concat('\"', source, '\"') ELSE '' END, ']}', CASE doc_id % 7 WHEN 0 THEN ' junk {}' WHEN 1 THEN ',}' ELSE ' ok' END)"
    got = table(spark, sf_dir, "documents").select("doc_id", S.route(F.expr(body)).alias("r"))
    return got.select("doc_id", "r.intent", "r.is_ood", F.col("r.ood_confidence").alias("confidence"), F.array_join("r.doc_scope", ",").alias("scope"))


@query(
    """SELECT event_id, CAST(CASE WHEN event_id % 5 < 3 THEN CAST(json_extract_string(props, '$.k') AS INTEGER) % 3 END AS DOUBLE) AS faithfulness, CAST(CASE WHEN event_id % 5 < 3 THEN event_id % 3 END AS DOUBLE) AS relevance,
  CAST(CASE WHEN event_id % 5 < 3 THEN CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) % 3 = 2 AND event_id % 3 >= 1 AS INTEGER) END AS DOUBLE) AS correct FROM events"""
)
def judge_replies(spark, sf_dir):
    """Judge replies of three forms that can be read, one without a field, and one without JSON."""
    k = "get_json_object(props, '$.k') % 3"
    reply = f"""CASE event_id % 5 WHEN 3 THEN concat('{{"faithfulness": 2, "relevance": ', event_id % 3, '}}') WHEN 4 THEN 'no object'
      ELSE concat('Scores:\\n{{"faithfulness": ', CAST({k} AS INT), ', "relevance": "', event_id % 3, '", "citation_accuracy": 1.0', IF(event_id % 5 = 1, '', ', "rationale": "r"'), '}} end') END"""
    got = table(spark, sf_dir, "events").select("event_id", S.judge(F.expr(reply)).alias("j"))
    each = {"faithfulness": F.col("j.faithfulness"), "relevance": F.col("j.relevance"), "correct": S.correct(F.col("j"))}
    return got.select("event_id", *[c.cast("double").alias(n) for n, c in each.items()])


# The serving flow over all user turns, with recorded routes and answers, the stand-in vectors, and word overlap as reranker.
ROUTED = """CASE WHEN query_id % 11 = 0 THEN 'no route' ELSE concat('{"intent": "', CASE query_id % 4 WHEN 0 THEN 'procedural' WHEN 1 THEN 'lookup' ELSE 'synthesis' END, '", "is_ood": ', CASE WHEN query_id % 5 = 0 THEN 'true' ELSE 'false' END,
 ', "ood_confidence": ', CASE WHEN query_id % 10 = 0 THEN '0.9' ELSE '0.5' END, ', "doc_scope": ', CASE query_id % 7 WHEN 1 THEN '["nowhere"]' WHEN 2 THEN '["b1", "b2"]' WHEN 3 THEN '[]' ELSE 'null' END, '}') END"""
SERVED = f"""{ASKED},
b AS (SELECT item_id, 'c' || item_id AS chunk_id, 'b' || item_id % 5 AS doc_name, {WORDS.format(t="text")} AS w FROM benchmark),
vec AS (SELECT w, [len(list_filter(p, lambda x: x = i)) FOR i IN range(0, 64)] AS e FROM (SELECT w, list_transform(w, lambda x: CAST('0x' || substr(md5(x), 1, 8) AS BIGINT) % 64) AS p FROM (SELECT w FROM b UNION SELECT qw FROM q))),
rt AS (SELECT *, query_id % 13 = 5 AS failed, query_id % 11 = 0 AS dflt, query_id % 11 <> 0 AND query_id % 10 = 0 AS ood, CASE WHEN query_id % 11 = 0 THEN 'lookup' ELSE CASE query_id % 4 WHEN 0 THEN 'procedural' WHEN 1 THEN 'lookup' ELSE 'synthesis' END END AS intent,
  CASE WHEN query_id % 11 = 0 THEN NULL WHEN query_id % 7 = 1 THEN ['nowhere'] WHEN query_id % 7 = 2 THEN ['b1', 'b2'] END AS scope FROM q),
go AS (SELECT rt.*, vec.e FROM rt JOIN vec ON rt.qw = vec.w WHERE NOT failed AND NOT ood),
sc AS (SELECT go.query_id, b.chunk_id, b.doc_name, len(list_intersect(list_distinct(go.qw), list_distinct(b.w))) AS shared,
  list_inner_product(go.e::DOUBLE[], v.e::DOUBLE[]) / (sqrt(list_inner_product(v.e::DOUBLE[], v.e::DOUBLE[])) * sqrt(list_inner_product(go.e::DOUBLE[], go.e::DOUBLE[]))) AS score
  FROM go JOIN b ON go.scope IS NULL OR list_contains(go.scope, b.doc_name) JOIN vec v ON v.w = b.w WHERE len(go.qw) > 0 AND len(b.w) > 0),
fd AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM sc QUALIFY rank <= 20),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY shared DESC, rank) AS rr FROM fd QUALIFY rr <= 5),
fs AS (SELECT query_id, string_agg(chunk_id, ',' ORDER BY rank) AS retrieved, list(doc_name ORDER BY rank) AS names FROM fd GROUP BY query_id),
rs AS (SELECT query_id, string_agg(chunk_id, ',' ORDER BY rr) AS ranked FROM rk GROUP BY query_id),
ex AS (SELECT rt.*, retrieved, names, ranked, NOT failed AND NOT ood AND ranked IS NULL AS nohit, NOT failed AND NOT ood AND ranked IS NOT NULL AND query_id % 17 = 3 AS broke FROM rt LEFT JOIN fs USING (query_id) LEFT JOIN rs USING (query_id)),
sv AS (SELECT *, CASE WHEN failed OR ood OR nohit OR broke THEN 0 ELSE query_id % 101 END AS raw FROM ex),
served AS (SELECT query_id, CASE WHEN failed OR broke THEN '' WHEN ood THEN 'OOD' WHEN nohit OR raw < 70 THEN 'NO' WHEN raw < 85 THEN 'Answer ' || query_id || ' [1]' || chr(10) || chr(10) || 'CHECK' ELSE 'Answer ' || query_id || ' [1]' END AS answer, ood AND NOT failed AS is_ood,
  NOT failed AND NOT broke AND (ood OR nohit OR raw < 70) AS refused, CAST(raw AS INTEGER) AS raw_confidence, raw / 100.0::DOUBLE AS calibrated_confidence, CASE WHEN NOT failed THEN intent END AS intent, CASE WHEN NOT failed THEN array_to_string(scope, ',') END AS doc_scope, retrieved, names, ranked,
  CASE WHEN failed OR broke THEN 'no recorded reply' END AS error FROM sv)"""


def corpus(spark, sf_dir):
    rows = table(spark, sf_dir, "benchmark").selectExpr("concat('c', item_id) AS chunk_id", "concat('b', item_id % 5) AS doc_name", "array('root', concat('S', item_id % 3)) AS section_path", "1 AS page_num", "text", "CAST(greatest(1, length(text) DIV 4) AS INT) AS token_count")
    return rows.withColumn("embedding", P.hashed_counts(F.col("text")))


def responses(spark, sf_dir):
    asked = questions(spark, sf_dir)
    recorded = asked.where("query_id % 13 <> 5").select("query_id", F.expr(ROUTED).alias("value"))
    told = asked.where("query_id % 17 <> 3").selectExpr("query_id", "concat('Answer ', query_id, ' [1]\\n<confidence>', query_id % 101, '</confidence>') AS value", "named_struct('input_tokens', 10L, 'output_tokens', 5L, 'cache_read_input_tokens', 0L, 'cache_creation_input_tokens', 0L) AS usage")
    embed = lambda df: df.withColumn("embedding", P.hashed_counts(F.col("question")))
    notices = {"refusal": "NO", "notice": "CHECK", "ood": "OOD"}
    return S.serve(asked, corpus(spark, sf_dir), P.Replay(recorded), P.Replay(told), embed, overlap, notices=notices)


@query(f"WITH {SERVED} SELECT * EXCLUDE (names) FROM served")
def serve_flow(spark, sf_dir):
    """Every exit is taken: a failed call, out of scope, nothing found, refused, with a notice, answered."""
    joined = lambda c: F.array_join(F.transform(c, lambda x: x["chunk_id"]), ",").alias(c.split("_")[0])
    return responses(spark, sf_dir).select("query_id", "answer", "is_ood", "refused", "raw_confidence", "calibrated_confidence", "intent", F.array_join("doc_scope", ",").alias("doc_scope"), joined("retrieved_chunks"), joined("ranked_chunks"), "error")


@query(f"WITH {SERVED} SELECT query_id, CASE WHEN error IS NOT NULL THEN 'error' WHEN is_ood THEN 'out_of_scope' WHEN refused THEN 'refuse' WHEN calibrated_confidence < 0.85 THEN 'notice' ELSE 'answer' END AS action, coalesce(retrieved, '') AS hits FROM served")
def query_logs(spark, sf_dir):
    """The log records, read back."""
    got = H.query_log(responses(spark, sf_dir)).select("query_id", F.from_json("log", "action string, hits array<string>").alias("l"))
    return got.select("query_id", "l.action", F.array_join(F.coalesce("l.hits", F.array().cast("array<string>")), ",").alias("hits"))


def _echo():
    """A model that repeats what it's asked, and is never reached for some prompts."""

    def call(prompt):
        if len(prompt) % 7 == 0:
            raise OSError("unreachable")
        return f"You said: {prompt}", {"input_tokens": len(prompt), "output_tokens": 2}

    return call


@query(
    """WITH c AS (SELECT conv_id * 1000 + turn AS query_id, text, length(text) % 7 = 0 AS fails, max(CAST(conv_id % 2 = 0 AS INTEGER)) OVER (PARTITION BY text) AS twice FROM conversations WHERE text IS NOT NULL)
SELECT query_id, CASE WHEN NOT fails THEN 'You said: ' || text END AS answer, CASE WHEN fails THEN 'OSError: unreachable' END AS error, CASE WHEN NOT fails THEN length(text) END::DOUBLE AS input_tokens, CASE WHEN fails THEN 2 + 2 * twice ELSE 1 END AS tries FROM c"""
)
def ledger_calls(spark, sf_dir):
    """Half of the conversations are asked, then all of them: a text is asked once, however many turns have it and however often
    the run is repeated; texts that fail are tried twice in each run."""
    turns = table(spark, sf_dir, "conversations").where("text IS NOT NULL").selectExpr("conv_id", "conv_id * 1000 + turn AS query_id", "text")
    ledger = Ledger(spark, new_folder(spark, "ledger"), "echo", _echo, group=20_000, tasks=4, tries=2, pause=0.0)
    ledger.ask(turns.where("conv_id % 2 = 0").select(F.col("text").alias("prompt")))
    got = ledger(turns, "text", "r")
    tries = ledger.entries().groupBy("key").agg(F.sum("tries").alias("tries"))
    named = got.withColumn("key", call_key("echo", F.col("text"))).join(tries, "key")
    return named.select("query_id", F.col("r.value").alias("answer"), F.col("r.error").alias("error"), F.col("r.usage.input_tokens").cast("double").alias("input_tokens"), "tries")


#: Policies in five versions, with as many bounds as there are parts.
POLICIES = "SELECT p_partkey % 20 AS policy, CAST((p_partkey // 20) % 5 AS INTEGER) AS version, TIMESTAMP '2024-01-03 00:00:00' + INTERVAL 6 DAY * CAST((p_partkey // 20) % 5 AS INTEGER) AS since, (p_partkey * 7919 % 10007) / 10007.0::DOUBLE AS low, 'a' || p_partkey AS action FROM part"


@query(
    f"""WITH p AS ({POLICIES}), e AS (SELECT event_id, ts, user_id % 21 AS policy, CASE WHEN event_id % 17 > 0 THEN (event_id * 31 % 1000) / 1000.0::DOUBLE END AS confidence FROM events),
v AS (SELECT event_id, policy, confidence, max_by(version, since) AS version FROM e LEFT JOIN (SELECT DISTINCT policy, version, since FROM p) USING (policy) WHERE since <= ts GROUP BY ALL),
a AS (SELECT event_id, max_by(action, low) AS action FROM v JOIN p USING (policy, version) WHERE low <= confidence GROUP BY event_id)
SELECT event_id, CAST(v.version AS DOUBLE) AS version, coalesce(action, 'refuse') AS action FROM e LEFT JOIN v USING (event_id) LEFT JOIN a USING (event_id)"""
)
def policy_versions(spark, sf_dir):
    """Each event's action by the bounds of the version that was in force. One policy of 21 has no versions. From 1,000,700 parts on
    bounds repeat, which the SQL leaves open: the larger part decides."""
    policies = table(spark, sf_dir, "part").selectExpr("p_partkey", "p_partkey % 20 AS policy", "CAST((p_partkey DIV 20) % 5 AS INT) AS version", "timestampadd(DAY, 6 * CAST((p_partkey DIV 20) % 5 AS INT), TIMESTAMP '2024-01-03 00:00:00') AS since", "(p_partkey * 7919 % 10007) / 10007D AS low", "concat('a', p_partkey) AS action")
    asked = table(spark, sf_dir, "events").selectExpr("event_id", "CAST(ts AS TIMESTAMP) AS at", "user_id % 21 AS policy", "IF(event_id % 17 > 0, (event_id * 31 % 1000) / 1000D, NULL) AS confidence")
    return actions_in_force(asked, policies, rank=("p_partkey",)).select("event_id", F.col("version").cast("double").alias("version"), "action")


def _judge_sql() -> str:
    """The judge's template with its fields as SQL."""
    fields = {"question": "question", "chunks": "'[1] (' || source || ')' || chr(10) || coalesce(text, '')", "answer": "'About ' || doc_id"}
    parts = re.split(r"\{(question|chunks|answer)\}", S.JUDGE)
    return " || ".join(fields[p] if i % 2 else "'" + p.replace("'", "''") + "'" for i, p in enumerate(parts))


@query(f"WITH d AS (SELECT *, 'What of {{answer}} and {{chunks}} in ' || doc_id || '?' AS question FROM documents WHERE source IS NOT NULL) SELECT doc_id, length({_judge_sql()}) AS n, sha256({_judge_sql()}) AS prompt_sha FROM d")
def judge_prompts(spark, sf_dir):
    """The judge's prompt for each document as its own passage. The questions hold the names of fields, which stay as they are."""
    rows = table(spark, sf_dir, "documents").where("source IS NOT NULL").selectExpr("doc_id", "concat('What of {answer} and {chunks} in ', doc_id, '?') AS question", "concat('[1] (', source, ')\n', coalesce(text, '')) AS chunks", "concat('About ', doc_id) AS answer")
    prompt = S.render(S.JUDGE, question=F.col("question"), chunks=F.col("chunks"), answer=F.col("answer"))
    return rows.select("doc_id", F.length(prompt).cast("long").alias("n"), F.sha2(prompt.cast("binary"), 256).alias("prompt_sha"))


@query("SELECT source, sum(n_chars // 4) AS input_tokens, sum(doc_id % 50) AS output_tokens, sum(CASE WHEN doc_id % 3 > 0 THEN doc_id % 10 ELSE 0 END) AS cache_read, 0 AS cache_creation, count(*) AS n FROM documents GROUP BY source")
def usage_counts(spark, sf_dir):
    """Token counters of replies, by source; cache counters that a reply lacks are 0."""
    reply = F.struct((F.expr("n_chars DIV 4")).alias("input_tokens"), (F.col("doc_id") % 50).alias("output_tokens"), F.when(F.col("doc_id") % 3 > 0, F.col("doc_id") % 10).alias("cache_read_input_tokens"), F.lit(None).alias("cache_creation_input_tokens"))
    used = table(spark, sf_dir, "documents").select("source", P.usage(reply).alias("u"))
    total = {"input_tokens": "input_tokens", "output_tokens": "output_tokens", "cache_read": "cache_read_input_tokens", "cache_creation": "cache_creation_input_tokens"}
    return used.groupBy("source").agg(*[F.sum(f"u.{c}").alias(n) for n, c in total.items()], F.count("*").alias("n"))
