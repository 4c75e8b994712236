"""Keyword search by an inverted index with bounds: exact BM25 top-k without reading the postings of frequent words.

The index has each term's postings (document, score part) in blocks of about equal parts, each block with its best part. A search
takes a lower bound for each query from its terms' best blocks, and then asks which terms a document must have to reach it: terms
whose best parts together stay below the bound (usually the frequent ones) can't bring a document in on their own. Of the others
only blocks are read whose best part would do with the best of all other terms. What is found so is scored in full, by
(term, document), so a frequent word is never joined with all documents that have it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.text import words
from granary.sources.shared import cut

#: Postings of a block; how far rounding may bring a sum below a bound.
BLOCK, NEAR = 128, 1e-9


def parts(docs: DataFrame, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(term, doc_id, part): what each term adds to a document's score; docs (doc_id, text)."""
    listed = docs.select("doc_id", words(F.lower("text")).alias("w"))
    total = cut(listed.agg(F.count("*").alias("docs"), F.avg(F.size("w")).alias("mean")))
    tf = listed.select("doc_id", F.size("w").alias("n"), F.explode("w").alias("term")).groupBy("term", "doc_id", "n").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("n") / F.col("mean")))
    return tf.join(df, "term").join(F.broadcast(total), how="cross").select("term", "doc_id", part.alias("part"))  # one row


def index(scored: DataFrame, block: int = BLOCK) -> DataFrame:
    """(term, place, best, n, postings) of rows (term, doc_id, part): a term's postings in blocks of about equal parts.

    A list is dealt into bands of parts, a sixteenth of an octave each, and a band by a hash into blocks of some ``block`` postings, so
    no list is sorted, however long. ``place``: about how many postings have better parts."""
    banded = scored.withColumn("band", F.floor(-16 * F.log2("part")).cast("int"))
    sizes = banded.groupBy("term", "band").agg(F.count("*").alias("size"))
    before = F.sum("size").over(Window.partitionBy("term").orderBy("band").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("term", "band", "size", F.coalesce(before, F.lit(0)).alias("before"))
    dealt = banded.join(starts, ["term", "band"]).withColumn("slice", F.pmod(F.xxhash64("doc_id"), F.expr(f"(size + {block - 1}) div {block}")))
    blocked = dealt.groupBy("term", "band", "slice").agg(F.first("before").alias("before"), F.max("part").alias("best"), F.count("*").alias("n"), F.collect_list(F.struct("doc_id", "part")).alias("postings"))
    return blocked.select("term", (F.col("before") + F.col("slice") * block).alias("place"), "best", "n", "postings")


def _sum_in_order(terms: Column) -> Column:
    """The parts (term, part) added up in the order of their terms, so that equal documents have equal scores."""
    return F.aggregate(F.array_sort(terms), F.lit(0.0), lambda s, x: s + x["part"])


def _kth(scores: DataFrame, k: int) -> DataFrame:
    """(query_id, least): each query's k-th best partial score, if it has as many."""
    best = Window.partitionBy("query_id").orderBy(F.col("partial").desc())
    return scores.withColumn("r", F.row_number().over(best)).where(F.col("r") == k).select("query_id", F.col("partial").alias("least"))


def keyword_topk(queries: DataFrame, blocks: DataFrame, k: int = 20) -> tuple[DataFrame, DataFrame]:
    """((query_id, rank, doc_id, score), (query_id, postings, read)): each query's k best documents, and how many postings its terms
    have and were read to find candidates. queries (query_id, question); ``blocks`` as ``index`` makes them."""
    asked = queries.select("query_id", F.explode(F.array_distinct(words(F.lower("question")))).alias("term"))
    wanted = cut(asked.select("term").distinct())
    own = cut(blocks.join(wanted, "term", "left_semi"))
    terms = own.groupBy("term").agg(F.max("best").alias("top"), F.sum("n").alias("df"))
    asked = cut(asked.join(terms, "term"))
    # A lower bound from the best blocks of each term: partial scores are never above the whole ones.
    seeds = asked.select("query_id", "term").join(own.where(F.col("place") < BLOCK).select("term", "n", "postings"), "term")
    first = seeds.select("query_id", F.explode("postings").alias("p")).groupBy("query_id", "p.doc_id").agg(F.sum("p.part").alias("partial"))
    least = _kth(first, k)
    known = asked.join(least, "query_id", "left").withColumn("least", F.coalesce("least", F.lit(0.0)) - NEAR)
    up = Window.partitionBy("query_id").orderBy("top", "term")
    bounded = known.withColumns({"below": F.sum("top").over(up.rowsBetween(Window.unboundedPreceding, 0)), "all": F.sum("top").over(Window.partitionBy("query_id"))})
    # Terms that together stay below the bound bring no document in; of the others, blocks that can't reach it aren't read.
    needed = cut(bounded.where("below >= least").select("query_id", "term", "top", (F.col("least") - F.col("all") + F.col("top")).alias("floor")))
    taken = needed.join(own, "term").where("best >= floor").select("query_id", "top", "n", "postings")
    each = taken.select("query_id", "top", F.explode("postings").alias("p"))
    found = cut(each.groupBy("query_id", "p.doc_id").agg(F.sum("p.part").alias("partial"), F.sum("top").alias("seen")))
    # The bound again, from all that was found; what can't reach it with the best of the terms that it wasn't found by isn't scored.
    spare = bounded.groupBy("query_id").agg(F.first("all").alias("all"))
    higher = found.join(_kth(found, k), "query_id", "left").join(spare, "query_id")
    able = higher.where(F.col("least").isNull() | (F.col("partial") + F.col("all") - F.col("seen") >= F.col("least") - NEAR)).select("query_id", "doc_id")
    flat = own.select("term", F.explode("postings").alias("p")).select("term", "p.doc_id", "p.part")
    scored = able.join(asked.select("query_id", "term"), "query_id").join(flat, ["term", "doc_id"])
    score = scored.groupBy("query_id", "doc_id").agg(_sum_in_order(F.collect_list(F.struct("term", "part"))).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "doc_id")
    ranked = score.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")
    # A first block that's needed too counts twice: it's read twice.
    reads = seeds.select("query_id", "n").unionAll(taken.select("query_id", "n")).groupBy("query_id").agg(F.sum("n").alias("read"))
    report = asked.groupBy("query_id").agg(F.sum("df").alias("postings")).join(reads, "query_id")
    return ranked, report
