"""Exact similarity top-k, reranking, keyword scores."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.text import words

#: A group of queries that is sent to all rows has at most so many bytes of vectors; more queries mean more passes.
QUERY_BYTES = 64 << 20
ROWS, QUERIES, PAIRS, NEAR = 4096, 512, 200_000, 1e-9
#: Names of a search's scopes that go into the scan's filter; more are joined.
NAMES = 1000


def vectors(col: pa.Array, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, matrix) of the vectors with that many finite components that aren't all zero."""
    right = np.asarray(pc.fill_null(pc.equal(pc.list_value_length(col), dimension), False))
    places = np.flatnonzero(right)
    flat = pc.list_flatten(col.filter(pa.array(right)))
    x = np.asarray(flat.to_numpy(zero_copy_only=False), np.float64).reshape(len(places), dimension)  # a null component is NaN
    fine = np.isfinite(x).all(1) & (x != 0).any(1)
    return places[fine], x[fine]


def _best(parts: list[tuple], k: int) -> tuple:
    """The k best (query, id, score) of each query: higher scores first, then smaller ids."""
    q, ids, s = (np.concatenate(c) for c in zip(*parts))
    order = np.lexsort((ids, -s, q))
    q, ids, s = q[order], ids[order], s[order]
    kept = np.arange(len(q)) - np.searchsorted(q, q) < k
    return q[kept], ids[kept], s[kept]


def _scan(shared, k: int, dimension: int, skip_self: bool, kinds):
    """Best rows of one task for every query. Products of blocks find what may be among the best; their scores are then
    computed one by one, so that equal vectors have equal scores wherever they stand."""

    def run(batches):
        asked = shared.value
        asked = asked if isinstance(asked, pa.Table) else pa.table(asked)
        at, y = vectors(asked.column(1).combine_chunks(), dimension)
        q_ids = asked.column(0).to_numpy()[at]
        scopes = [asked.column(2)[int(i)].as_py() for i in at] if asked.num_columns > 2 else None
        y_norm = np.sqrt(np.einsum("ij,ij->i", y, y))
        unit = (y / y_norm[:, None]).T
        best, floor = {}, np.full(len(y), -np.inf)
        for b in batches:
            for start in range(0, b.num_rows, ROWS):
                part = b.slice(start, ROWS)
                place, x = vectors(part.column(1), dimension)
                if not len(x):
                    continue
                ids = part.column(0).to_numpy(zero_copy_only=False)[place]
                ids = ids.astype(str) if ids.dtype == object else ids
                norm = np.sqrt(np.einsum("ij,ij->i", x, x))
                names = part.column(2).to_pylist() if scopes is not None else None
                ux = x / norm[:, None]
                for lo in range(0, len(y), QUERIES):
                    hi = min(lo + QUERIES, len(y))
                    s = ux @ unit[:, lo:hi]
                    if skip_self:
                        s[ids[:, None] == q_ids[None, lo:hi]] = -np.inf
                    if scopes is not None:
                        s[~_in_scope([names[i] for i in place], scopes[lo:hi])] = -np.inf
                    if len(x) > k:
                        least = np.partition(s, len(x) - k, axis=0)[len(x) - k]
                        least = np.maximum(least, floor[lo:hi]) - NEAR
                    else:
                        least = floor[lo:hi] - NEAR
                    row, q = np.nonzero((s >= least) & np.isfinite(s))
                    if not len(row):
                        continue
                    q = q + lo
                    score = np.concatenate([np.einsum("ij,ij->i", x[row[i : i + PAIRS]], y[q[i : i + PAIRS]]) for i in range(0, len(row), PAIRS)]) / (norm[row] * y_norm[q])
                    now = _best([*([best[lo]] if lo in best else []), (q, ids[row], score)], k)
                    best[lo] = now
                    full = np.flatnonzero(np.bincount(now[0] - lo, minlength=hi - lo) >= k)
                    last = np.searchsorted(now[0], full + lo, side="right") - 1
                    floor[full + lo] = now[2][last]
        for q, ids, score in best.values():
            yield pa.RecordBatch.from_arrays([pa.array(q_ids[q], kinds[0]), pa.array(ids, kinds[1]), pa.array(score, pa.float64())], names=["query_id", "id", "score"])

    return run


def _in_scope(names: list, scopes: list) -> np.ndarray:
    """Whether each row's name is in each query's scope; a null or empty scope takes all."""
    known = {n: i for i, n in enumerate(dict.fromkeys(names))}
    ok = np.array([[not s or n in s for s in scopes] for n in known], bool)
    return ok[[known[n] for n in names]]


def cosine_topk(queries: DataFrame, corpus: DataFrame, k: int = 20, key: str = "vec_id", vector: str = "embedding", query_key: str | None = None, scope: str | None = None, name: str | None = None, skip_self: bool = False) -> DataFrame:
    """(query_id, rank, key, score): each query's k corpus rows of highest cosine, ties to the smaller key.

    Exact: every query meets every row. Queries go out in groups of at most QUERY_BYTES, one pass over the corpus a group;
    a task keeps k rows a query. scope: a query column of names; a null or empty one means no filter, else the row's ``name``
    must be among them. skip_self: a row isn't compared with the query of its own key. Vectors that are null, all zero, of
    another length than most queries' or with null or non-finite components take no part."""
    from pyspark.sql.pandas.types import to_arrow_type

    spark = corpus.sparkSession
    query_key = query_key or key
    own = queries.select(query_key, vector, *([scope] if scope else []))
    sized = own.where(F.size(vector) > 0).groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), "d").first()
    kinds = [queries.schema[query_key].dataType, corpus.schema[key].dataType]
    schema = f"query_id {kinds[0].simpleString()}, id {kinds[1].simpleString()}, score double"
    if sized is None:
        return spark.createDataFrame([], schema).selectExpr("query_id", "CAST(0 AS INT) AS rank", f"id AS `{key}`", "score")
    groups = max(1, -(-sized["count"] * sized.d * 8 // QUERY_BYTES))
    rows = corpus.select(key, vector, *([name] if scope else []))
    found = None
    for g in range(groups):
        part = own.where(F.pmod(F.xxhash64(query_key), F.lit(groups)) == g) if groups > 1 else own
        shared = spark.sparkContext.broadcast(part.toArrow())
        got = rows.mapInArrow(_scan(shared, k, sized.d, skip_self, [to_arrow_type(t) for t in kinds]), schema)
        found = got if found is None else found.unionByName(got)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(key), "score")


def search(queries: DataFrame, collection, k: int = 20, scope: str | None = None, query_key: str = "query_id") -> DataFrame:
    """(query_id, rank, chunk_id, score): ``cosine_topk`` over a collection's points. Where all queries have a scope (a column of
    document names), only the files that its index gives for these names are read; names it doesn't know cost nothing."""
    names = None
    if scope and queries.where(F.col(scope).isNull() | (F.size(scope) == 0)).isEmpty():
        names = queries.select(F.explode(scope).alias("term")).distinct()
        few = [r.term for r in names.limit(NAMES + 1).collect()]
        names = few if len(few) <= NAMES else names
    return cosine_topk(queries, collection.points(names), k, key="chunk_id", query_key=query_key, scope=scope, name="doc_name" if scope else None)


def with_payload(ranked: DataFrame, corpus: DataFrame, key: str = "chunk_id", fields: tuple = ("doc_name", "section_path", "page_num", "text", "token_count")) -> DataFrame:
    """Ranked rows with the typed fields of their chunks."""
    return ranked.join(corpus.select(key, *fields), key)


def overlap(question: Column, text: Column) -> Column:
    """A stand-in for a trained reranker: distinct lower-case words that question and text share."""
    return F.size(F.array_intersect(words(F.lower(question)), words(F.lower(text)))).cast("double")


def rerank(candidates: DataFrame, score: Column, k: int = 5) -> DataFrame:
    """A query's k best candidates by a new score; ties keep the candidates' order."""
    best = Window.partitionBy("query_id").orderBy(F.col("rerank_score").desc_nulls_last(), "rank")
    return candidates.withColumn("rerank_score", score).withColumn("rerank", F.row_number().over(best)).where(F.col("rerank") <= k)


def weak_retrieval(ranked: DataFrame, least: float) -> DataFrame:
    """(query_id, top_score, weak): whether a query's best rerank score stays below ``least``."""
    got = ranked.groupBy("query_id").agg(F.max("rerank_score").alias("top_score"))
    return got.withColumn("weak", F.col("top_score") < least)


def bm25(queries: DataFrame, docs: DataFrame, k: int = 20, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query_id, rank, doc_id, score): keyword search over lower-case words; queries (query_id, question), docs (doc_id, text).

    Term counts are aggregated a document before the join, and only terms that some query has are kept."""
    own = queries.select("query_id", F.explode(F.array_distinct(words(F.lower("question")))).alias("term"))
    listed = docs.select("doc_id", words(F.lower("text")).alias("w")).select("doc_id", F.size("w").alias("n"), F.explode("w").alias("term"))
    total = docs.agg(F.count("*").alias("docs"), F.avg(F.size(words(F.lower("text")))).alias("mean"))
    tf = listed.join(own.select("term").distinct(), "term", "left_semi").groupBy("term", "doc_id", "n").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    asked = own.join(df, "term").join(F.broadcast(total))  # one row
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("n") / F.col("mean")))
    score = asked.join(tf, "term").groupBy("query_id", "doc_id").agg(F.sum(part).alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "doc_id")
    return score.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")
