"""Text blocks of pages: extraction with a line fallback, page texts, order, font sizes, profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.text import is_heading, strip, words


def page_blocks(pages: DataFrame) -> DataFrame:
    """Rows (doc_name, page_num, spans array<struct<text, font_size>>, plain, failed) to blocks (doc_name, page_num, block_ord,
    text, font_size): stripped spans with text, an unknown size being 0. Where the extraction failed, the lines of the
    plain text follow the spans that were found before (so text may be there twice)."""
    lines = F.transform(F.split(F.coalesce("plain", F.lit("")), r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"), lambda t: F.struct(t.alias("text"), F.lit(0.0).alias("font_size")))
    none = F.array().cast("array<struct<text:string,font_size:double>>")
    found = F.coalesce("spans", none)
    every = F.when(F.coalesce("failed", F.lit(False)), F.concat(found, lines)).otherwise(found)
    texts = F.transform(every, lambda x: F.struct(strip(x["text"]).alias("text"), F.coalesce(x["font_size"], F.lit(0.0)).alias("font_size")))
    kept = F.filter(texts, lambda x: F.coalesce(x["text"] != "", F.lit(False)))
    return pages.select("doc_name", "page_num", F.posexplode(kept).alias("block_ord", "b")).select("doc_name", "page_num", "block_ord", "b.text", "b.font_size")


def line_blocks(docs: DataFrame) -> DataFrame:
    """(doc_id, block_ord, text): the non-blank lines of each document."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("block_ord", "line"))
    return lines.select("doc_id", F.col("block_ord").cast("long").alias("block_ord"), strip(F.col("line")).alias("text")).where("text <> ''")


def page_texts(blocks: DataFrame) -> DataFrame:
    """(doc_name, page_num, text): a page's blocks in order, joined by blanks."""
    ordered = F.array_sort(F.collect_list(F.when(strip(F.col("text")) != "", F.struct("block_ord", "text"))))
    return blocks.groupBy("doc_name", "page_num").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), " ").alias("text"))


def flatten(blocks: DataFrame) -> DataFrame:
    """Blocks with ``ord``, their place in the document from 0: pages in order, blocks within."""
    order = Window.partitionBy("doc_name").orderBy("page_num", "block_ord")
    return blocks.withColumn("ord", (F.row_number().over(order) - 1).cast("long"))


def median_size(blocks: DataFrame, key: str, size: str) -> DataFrame:
    """A document's median font size over known (positive) sizes; 0 without any."""
    return blocks.groupBy(key).agg(_median(F.col(size)).alias("median_size"))


def _median(size: Column) -> Column:
    return F.coalesce(F.median(F.when(size > 0, size)), F.lit(0.0))


def with_headings(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Blocks (key, text, font_size) with ``heading``, by the document's own median size."""
    median = F.coalesce(F.median(F.when(F.col("font_size") > 0, F.col("font_size"))).over(Window.partitionBy(key)), F.lit(0.0))
    sized = blocks.withColumn("_median", median)
    return sized.withColumn("heading", is_heading(F.col("text"), F.col("font_size"), F.col("_median"))).drop("_median")


def block_profile(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per document: blocks, median size, headings, body blocks, shortest and longest heading (0 without one), and how many
    blocks have one, two, three and more words."""
    marked = with_headings(blocks, key).withColumn("_n", F.size(words(F.col("text")))).withColumn("_len", F.when(F.col("heading"), F.length("text")))
    counts = [F.count_if(F.col("_n") == i).alias(f"words_{i}") for i in (1, 2, 3)]
    return marked.groupBy(key).agg(
        F.count("*").alias("n_blocks"), _median(F.col("font_size")).alias("median_size"), F.count_if("heading").alias("n_headings"), F.count_if(~F.col("heading")).alias("n_body"),
        F.coalesce(F.min("_len"), F.lit(0)).alias("min_heading"), F.coalesce(F.max("_len"), F.lit(0)).alias("max_heading"), *counts, F.count_if(F.col("_n") > 3).alias("words_more"),
    )


def content_pages(pages: DataFrame, least: int = 50) -> DataFrame:
    """Pages with stripped texts longer than ``least`` characters."""
    return pages.withColumn("text", strip(F.coalesce("text", F.lit("")))).where(F.length("text") > least)
