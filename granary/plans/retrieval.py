"""Queries over vectors: search, metrics, reranking, prompts, keyword scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.operators import metrics as M
from granary.operators import providers as P
from granary.operators import serving as S
from granary.operators.keywords import index as keyword_index
from granary.operators.keywords import keyword_topk
from granary.operators.keywords import parts as keyword_parts
from granary.operators.retrieval import bm25 as keyword_search
from granary.operators.retrieval import cosine_topk, rerank, weak_retrieval
from granary.operators.vectors import VectorIndex
from granary.plans.registry import query
from granary.sources.shared import cut, new_folder
from granary.sources.tables import table

#: Every row whose id is divisible by 50 asks; all rows are candidates.
NEAR = """
WITH n AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id, q.label = c.label AS hit, list_cosine_similarity(q.e, c.e) AS score FROM n q JOIN n c ON q.vec_id % 50 = 0 {on}),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
"""
ALL = NEAR.format(on="")
OTHERS = NEAR.format(on="AND q.vec_id <> c.vec_id")


def vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings")


def near(spark, sf_dir, k=20, **more):
    rows = vectors(spark, sf_dir)
    return cosine_topk(rows.where("vec_id % 50 = 0"), rows, k, **more)


def rounded(got):
    return got.withColumn("score", F.round("score", 6))


@query(ALL + "SELECT query_id, rank, vec_id, round(score, 6) AS score FROM r WHERE rank <= 20")
def topk_cosine(spark, sf_dir):
    return rounded(near(spark, sf_dir))


@query(OTHERS + "SELECT query_id, rank, vec_id, round(score, 6) AS score FROM r WHERE rank <= 10")
def topk_bounded(spark, sf_dir):
    """The ten nearest others by an index that skips blocks by their bounds."""
    rows = vectors(spark, sf_dir)
    index = VectorIndex(spark, new_folder(spark, "vectors")).build(rows, pivots=16, size=1024)
    got, _ = index.topk(rows.where("vec_id % 50 = 0"), 10, "vec_id", skip_self=True)
    return rounded(got.withColumnRenamed("key", "vec_id"))


@query(ALL + "SELECT query_id, rank, vec_id, round(score, 6) AS score FROM r WHERE rank <= 5")
def topk_prototype(spark, sf_dir):
    return rounded(near(spark, sf_dir, 5))


@query(NEAR.format(on="AND CASE WHEN q.vec_id % 200 = 0 THEN true WHEN q.vec_id % 200 = 50 THEN false ELSE c.label IN (q.label, 3) END") + "SELECT query_id, rank, vec_id, round(score, 6) AS score FROM r WHERE rank <= 20")
def topk_scoped(spark, sf_dir):
    """Scopes: null or empty (no filter), an unknown name (nothing found), two names."""
    rows = vectors(spark, sf_dir).withColumn("name", F.col("label").cast("string"))
    scope = F.expr("CASE WHEN vec_id % 400 = 0 THEN NULL WHEN vec_id % 200 = 0 THEN CAST(array() AS array<string>) WHEN vec_id % 200 = 50 THEN array('nowhere') ELSE array(name, '3') END")
    return rounded(cosine_topk(rows.where("vec_id % 50 = 0").withColumn("scope", scope), rows, 20, scope="scope", name="name"))


CASES = """, c AS (SELECT query_id, list(hit ORDER BY rank) AS h FROM r WHERE rank <= 20 GROUP BY query_id),
x AS (SELECT query_id, CASE WHEN query_id % 300 = 0 THEN NULL WHEN list_contains(h[1:5], true) THEN 1.0 ELSE 0.0 END AS recall, CASE WHEN query_id % 300 = 0 THEN 0 ELSE len(list_filter(h[1:5], lambda y: y)) / 5.0 END AS prec,
  CASE WHEN query_id % 300 = 0 THEN 0.0 ELSE coalesce(1.0 / list_position(h, true), 0.0) END AS rr FROM c)
"""


def _cases(spark, sf_dir):
    """Retrieved ids; the ids of the query's label among them are true. Every sixth query has no truth."""
    label = vectors(spark, sf_dir).select(F.col("vec_id").alias("id"), "label")
    found = near(spark, sf_dir, skip_self=True)
    found = found.join(label.select(F.col("id").alias("query_id"), F.col("label").alias("q")), "query_id").join(label.withColumnRenamed("id", "vec_id"), "vec_id")
    hit = F.when((F.col("q") == F.col("label")) & (F.col("query_id") % 300 != 0), F.col("vec_id"))
    # A true id that wasn't retrieved stands for the others of the label.
    truth = F.when(F.col("query_id") % 300 != 0, F.concat(F.collect_list(hit), F.array(F.lit(-1).cast("long"))))
    return found.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "vec_id"))), lambda x: x["vec_id"]).alias("retrieved"), truth.alias("truth"))


@query(OTHERS + CASES + "SELECT query_id, CAST(recall AS DOUBLE) AS recall_5, round(CAST(prec AS DOUBLE), 6) AS precision_5, round(CAST(rr AS DOUBLE), 6) AS rr FROM x")
def retrieval_cases(spark, sf_dir):
    got = M.retrieval_cases(_cases(spark, sf_dir), (5,))
    return got.select("query_id", "recall_5", F.round("precision_5", 6).alias("precision_5"), F.round("rr", 6).alias("rr"))


@query(OTHERS + CASES + "SELECT count(*) AS n, round(avg(CAST(recall AS DOUBLE)), 6) AS recall_5, round(avg(CAST(prec AS DOUBLE)), 6) AS precision_5, round(avg(CAST(rr AS DOUBLE)), 6) AS mrr FROM x")
def recall_precision_mrr(spark, sf_dir):
    got = M.aggregate_retrieval(_cases(spark, sf_dir), (5,))
    return got.select("n", *[F.round(c, 6).alias(c) for c in ("recall_5", "precision_5", "mrr")])


@query(ALL + ", k AS (SELECT query_id, vec_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY vec_id % 7 DESC, rank) AS INTEGER) AS rerank FROM r WHERE rank <= 20) SELECT * FROM k WHERE rerank <= 5")
def reranked(spark, sf_dir):
    return rerank(near(spark, sf_dir), (F.col("vec_id") % 7).cast("double")).select("query_id", "vec_id", "rerank")


@query(ALL + "SELECT query_id, round(max(score), 6) AS top_score, max(score) < 0.5 AS weak FROM r WHERE rank BETWEEN 2 AND 20 GROUP BY query_id")
def weak_search(spark, sf_dir):
    got = near(spark, sf_dir).where("rank > 1").withColumn("rerank_score", F.col("score"))
    return weak_retrieval(got, 0.5).withColumn("top_score", F.round("top_score", 6))


@query(
    ALL
    + """SELECT query_id, 'Context: ' || string_agg('[' || rank || '] (v' || vec_id || ' | a > {question})' || chr(10) || score_text, chr(10) || chr(10) ORDER BY rank) || ' Question: q' || query_id AS prompt
FROM (SELECT *, 'text ' || vec_id AS score_text FROM r WHERE rank <= 5) GROUP BY query_id"""
)
def prompts(spark, sf_dir):
    rows = near(spark, sf_dir, 5).select("query_id", "rank", F.concat(F.lit("v"), F.col("vec_id")).alias("doc_name"), F.array(F.lit("root"), F.lit("a"), F.lit("{question}")).alias("path"), F.concat(F.lit("text "), F.col("vec_id")).alias("text"))
    prompt = S.render("Context: {context} Question: {question}", context=F.col("context"), question=F.concat(F.lit("q"), F.col("query_id")))
    return S.context(rows).select("query_id", prompt.alias("prompt"))


WORDS = "list_filter(string_split_regex(trim(lower({t})), '\\s+'), lambda w: w <> '')"


@query(
    f"""WITH b AS (SELECT item_id, {WORDS.format(t="text")} AS w FROM benchmark), u AS (SELECT item_id, unnest(w) AS x FROM b),
p AS (SELECT item_id, CAST('0x' || substr(md5(x), 1, 8) AS BIGINT) % 64 AS place, count(*) AS n FROM u GROUP BY ALL), s AS (SELECT item_id, sqrt(sum(n * n)) AS norm FROM p GROUP BY item_id)
SELECT item_id, CAST(place AS INTEGER) AS place, round(n / norm, 6) AS weight FROM p JOIN s USING (item_id)"""
)
def embedded(spark, sf_dir):
    """The stand-in's vectors, by their places that aren't zero."""
    rows = P.embed_passages(table(spark, sf_dir, "benchmark")).select("item_id", F.posexplode("embedding").alias("place", "weight"))
    return rows.where("weight <> 0").withColumn("weight", F.round("weight", 6))


ASKED = f"q AS (SELECT conv_id * 1000 + turn AS query_id, text AS question, {WORDS.format(t='text')} AS qw FROM conversations WHERE role = 'user')"


def questions(spark, sf_dir):
    return table(spark, sf_dir, "conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.col("text").alias("question"))


@query(
    f"""WITH {ASKED}, b AS (SELECT item_id, {WORDS.format(t="text")} AS w FROM benchmark), n AS (SELECT count(*) AS docs, avg(len(w)) AS mean FROM b),
tf AS (SELECT item_id, len(w) AS l, x AS term, count(*) AS tf FROM (SELECT item_id, w, unnest(w) AS x FROM b) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
a AS (SELECT DISTINCT query_id, unnest(qw) AS term FROM q),
s AS (SELECT query_id, item_id, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / mean))), 6) AS score FROM a JOIN tf USING (term) JOIN df USING (term), n GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM s) SELECT query_id, CAST(rank AS INTEGER) AS rank, score FROM r WHERE rank <= 3"""
)
def bm25(spark, sf_dir):
    """The scores of each question's three best items."""
    got = keyword_search(questions(spark, sf_dir), table(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "doc_id"), 3)
    return got.select("query_id", "rank", F.round("score", 6).alias("score"))


@query(
    f"""WITH {ASKED}, b AS (SELECT item_id AS doc_id, {WORDS.format(t="text")} AS w FROM benchmark), n AS (SELECT count(*) AS docs, avg(len(w)) AS mean FROM b),
tf AS (SELECT doc_id, len(w) AS l, x AS term, count(*) AS tf FROM (SELECT doc_id, w, unnest(w) AS x FROM b) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
a AS (SELECT DISTINCT query_id, unnest(qw) AS term FROM q),
s AS (SELECT query_id, doc_id, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / mean))), 6) AS score FROM a JOIN tf USING (term) JOIN df USING (term), n GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) SELECT query_id, CAST(rank AS INTEGER) AS rank, score FROM r WHERE rank <= 5"""
)
def bm25_index(spark, sf_dir):
    """The scores of each question's five best items, by an index with bounds."""
    blocks = cut(keyword_index(keyword_parts(table(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "doc_id"))))
    got, _ = keyword_topk(questions(spark, sf_dir), blocks, 5)
    return got.select("query_id", "rank", F.round("score", 6).alias("score"))
