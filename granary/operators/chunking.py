"""Sections and chunks.

A document's blocks depend on those before them, so they are folded in order: each document is gathered in one row and
folded by an Arrow function that joins its texts once, at a cost in proportion to its length. Documents are independent.
One document must fit a task.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.functions.text import chunk_id, strip, token_count, window_words, windows
from granary.operators.blocks import content_pages, with_headings

NUMBER = re.compile(r"(\d+(?:\.\d+)*)\s")


def tokens(chars: int) -> int:
    return max(1, chars // 4)


def path_below(path: tuple, heading: str) -> tuple:
    """A numbered heading of depth d keeps the root and d - 1 levels of the path before it; others stand below the root."""
    number = NUMBER.match(heading)
    return (*path[: number[1].count(".") + 1 if number else 1], heading)


def sections_of(blocks: Iterable[dict]) -> Iterator[tuple]:
    """(section, path, page, text) of the sections with text; section 0 stands before the first heading."""
    section, path, page, held = 0, ("root",), 1, []
    for b in [*blocks, None]:
        if b is not None and not b["heading"]:
            held.append(b["text"])
            continue
        if text := " ".join(held).strip():
            yield section, path, page, text
        if b is not None:
            section, path, page, held = section + 1, path_below(path, b["text"].strip()), b["page_num"], []


def pieces(text: str, most: int, overlap: int) -> list[str]:
    """The windows of functions.text.windows for one text."""
    width, step = window_words(most, overlap)
    w = text.split() if tokens(len(text)) > most else []
    return [" ".join(w[i : i + width]) for i in range(0, max(1, len(w) - width + step), step)] if w else [text]


def runs(parts: Iterable[tuple], takes) -> list[list]:
    """Parts (head, text) as runs [head of the first, characters joined by blanks, texts]; a run takes the next part while
    takes(run, head, text) holds."""
    out: list[list] = []
    for head, text in parts:
        if out and takes(out[-1], head, text):
            out[-1][1] += 1 + len(text)
            out[-1][2].append(text)
        else:
            out.append([head, len(text), [text]])
    return out


def _folded(rows: DataFrame, fold, schema: str) -> DataFrame:
    """fold(key, items) yields output tuples for each row (key, items)."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        for b in batches:
            out = [row for key, items in zip(b[0].to_pylist(), b[1].to_pylist()) for row in fold(key, items)]
            cols = list(zip(*out)) if out else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=names)

    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType

    kinds = [to_arrow_type(f.dataType) for f in StructType.fromDDL(schema)]
    return rows.mapInArrow(run, schema)


def _gathered(rows: DataFrame, key: str, order: str, fields: list[str]) -> DataFrame:
    return rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, *fields))).alias("items"))


def _kind(df: DataFrame, c: str) -> str:
    return df.schema[c].dataType.simpleString()


def sections(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Blocks (key, block_ord, page_num, text, heading) to sections with text: ordinal, path, the page of the heading
    (1 before any), and the body texts joined by blanks. Headings aren't part of a text."""
    rows = _gathered(blocks, key, "block_ord", ["page_num", "text", "heading"])
    schema = f"{key} {_kind(blocks, key)}, section bigint, section_path array<string>, page_num int, text string"
    return _folded(rows, lambda k, items: ((k, s, list(p), n, t) for s, p, n, t in sections_of(items)), schema)


def _joins_small(least: int, most: int, across: bool = True):
    def takes(run, head, text):
        return tokens(run[1]) < least and tokens(run[1] + 1 + len(text)) <= most and (across or run[0][1] == head[1])

    return takes


def merge_small(parts: DataFrame, least: int = 100, most: int = 512) -> DataFrame:
    """Rows (doc_id, ord, text) to chunks (doc_id, chunk, text): a pending chunk under ``least`` tokens takes the next one
    while the joined text has at most ``most`` tokens."""
    rows = _gathered(parts, "doc_id", "ord", ["text"])
    takes = _joins_small(least, most)

    def fold(key, items):
        return ((key, i, " ".join(texts)) for i, (_, _, texts) in enumerate(runs(((None, x["text"]) for x in items), takes)))

    return _folded(rows, fold, f"doc_id {_kind(parts, 'doc_id')}, chunk int, text string")


def chunk_documents(blocks: DataFrame, most: int = 512, overlap: int = 64, least: int = 100, merge_across_sections: bool = True, key: str = "doc_id") -> DataFrame:
    """Blocks (key, block_ord, page_num, text, font_size) to chunks (key, chunk, chunk_id, section_path, page_num, text,
    token_count).

    Headings by the document's median size or by pattern; sections; windows of long sections; a window under ``least``
    tokens joins the chunk before it if both have equal paths (whatever its size then); then chunks under ``least`` tokens
    take their successors while both fit ``most``, across sections unless merge_across_sections is false. A joined chunk
    keeps its first part's id, path and page."""
    rows = _gathered(with_headings(blocks, key), key, "block_ord", ["page_num", "text", "heading"])
    small = _joins_small(least, most, merge_across_sections)

    def tail(run, head, text):
        return tokens(len(text)) < least and run[0][0] == head[0]

    def fold(k, items):
        cut = (((path, page), piece) for _, path, page, text in sections_of(items) for piece in pieces(text, most, overlap))
        ended = [((i, *run[0]), " ".join(run[2])) for i, run in enumerate(runs(cut, tail))]
        for n, ((i, path, page), _, texts) in enumerate(runs(ended, small)):
            yield k, n, i, list(path), page, " ".join(texts)

    got = _folded(rows, fold, f"{key} {_kind(blocks, key)}, chunk int, number int, section_path array<string>, page_num int, text string")
    named = chunk_id(F.col(key).cast("string"), F.col("section_path"), F.col("number"))
    return got.select(key, "chunk", named.alias("chunk_id"), "section_path", "page_num", "text", token_count(F.col("text")).alias("token_count"))


def text_windows(docs: DataFrame, most: int = 512, overlap: int = 64) -> DataFrame:
    """(doc_id, window_no, text): the windows of every text."""
    return docs.select("doc_id", F.posexplode(windows(F.col("text"), most, overlap)).alias("window_no", "text"))


def fixed_windows(docs: DataFrame, size: int = 800, overlap: int = 150, least: int = 80, keys: tuple = ("doc_id",)) -> DataFrame:
    """(keys, chunk, text): windows of so many characters, stripped, those longer than ``least``; only they are numbered."""
    if overlap >= size:
        raise ValueError("overlap must be smaller than the window")
    n, step = F.length("text"), size - overlap
    count = F.when(n <= size, 1).otherwise(F.ceil((n - size) / step).cast("int") + 1)
    every = F.transform(F.sequence(F.lit(0), count - 1), lambda i: strip(F.substring(F.col("text"), i * step + 1, F.lit(size))))
    return docs.select(*keys, F.posexplode(F.filter(every, lambda t: F.length(t) > least)).alias("chunk", "text"))


def build_corpus(pages: DataFrame) -> DataFrame:
    """Pages (document, page, text) to fixed windows (document, page, chunk, text); pages of little text are left out."""
    return fixed_windows(content_pages(pages), keys=("document", "page"))


def chunk_stats(chunks: DataFrame) -> DataFrame:
    """(doc_id, n, mean_tokens): a document's chunks and their mean size, rounded down."""
    each = token_count(F.col("text"))
    return chunks.groupBy("doc_id").agg(F.count("*").alias("n"), F.floor(F.sum(each) / F.count("*")).alias("mean_tokens"))


def ingest_summary(status: DataFrame) -> DataFrame:
    """One row over (doc_name, n_chunks, error): documents processed (those without a chunk too), failed, chunks in all, and
    the errors by name. Only failed documents are gathered."""
    pairs = F.collect_list(F.when(F.col("error").isNotNull(), F.struct("doc_name", "error")))
    failed = F.count("error")
    return status.agg((F.count("*") - failed).alias("processed"), failed.alias("failed"), F.coalesce(F.sum(F.when(F.col("error").isNull(), F.col("n_chunks"))), F.lit(0)).cast("long").alias("total_chunks"), F.map_from_entries(F.array_sort(pairs)).alias("errors"))


def chunk_ablation(semantic: DataFrame, fixed: DataFrame) -> DataFrame:
    """(strategy, n, mean_tokens, least_tokens, most_tokens) of two chunk tables with a text column."""
    size = token_count(F.col("text"))
    rows = semantic.select(F.lit("semantic").alias("strategy"), size.alias("t")).unionByName(fixed.select(F.lit("fixed").alias("strategy"), size.alias("t")))
    return rows.groupBy("strategy").agg(F.count("*").alias("n"), F.avg("t").alias("mean_tokens"), F.min("t").alias("least_tokens"), F.max("t").alias("most_tokens"))
