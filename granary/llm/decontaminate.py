"""Benchmark decontamination: word n-grams of test items, found in and removed from training texts.

The items go out as a broadcast set of their windows: hashes of all windows in order, checked word by word on a hit. A Python
worker builds it once and keeps it for all its tasks. Items with more than BLOCK_WORDS words together go out in several
sets, one pass over the documents each.

Nulls: a null text has no words and no hits; an item of no words has no window. Repeated items count as one id.
Words are ASCII-lower-cased runs of digits, letters and non-ASCII characters; other columns are passed on untouched. Empty
tables give empty results; repeated rows are judged alike.
"""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import item_words, rolling, table

BASE = 0x9E3779B97F4A7C15
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Words of items in one broadcast set. Measured: 230 MB for 2 million words, 60,000 of them different.
BLOCK_WORDS = 1_000_000
_built: dict = {}


class Windows:
    """The items' windows by length: sorted hashes of all windows, where each stands in the items' words, and whose it is."""

    def __init__(self, items: list[tuple], n: int):
        self.vocab: dict[bytes, int] = {}
        self.names = sorted({str(i) for i, _ in items})
        number = {s: k for k, s in enumerate(self.names)}
        texts = [(number[str(i)], w) for i, t in items if (w := item_words(t))]
        ids = [np.array([self.vocab.setdefault(x, len(self.vocab) + 1) for x in w], np.uint32) for _, w in texts]
        self.stream = np.concatenate(ids) if ids else np.empty(0, np.uint32)
        first = np.cumsum([0, *map(len, ids)])
        self.sets = []
        for k in sorted({min(n, len(x)) for x in ids}):
            mine = [j for j, x in enumerate(ids) if min(n, len(x)) == k]
            starts = np.concatenate([np.arange(first[j], first[j] + len(ids[j]) - k + 1) for j in mine])
            owner = np.concatenate([np.full(len(ids[j]) - k + 1, texts[j][0], np.int32) for j in mine])
            h = np.concatenate([rolling(ids[j], k, BASE) for j in mine])
            order = np.argsort(h, kind="stable")
            bits = np.zeros(1 << 22, bool)
            bits[h >> np.uint64(42)] = True
            self.sets.append((k, bits, h[order], starts[order].astype(np.int32), owner[order]))

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, set]:
        """Which words a window covers, and the items that have occurring windows."""
        hit, items = np.zeros(len(words) + 1, np.int32), set()
        get = self.vocab.get
        ids = np.fromiter((get(w, 0) for w in words), np.uint32, len(words))
        for k, bits, known, starts, owner in self.sets:
            h = rolling(ids, k, BASE)
            at = np.flatnonzero(bits[h >> np.uint64(42)])
            if not len(at):
                continue
            lo, hi = np.searchsorted(known, h[at]), np.searchsorted(known, h[at], side="right")
            for i, a, b in zip(at.tolist(), lo.tolist(), hi.tolist()):
                # Windows of equal hash are told apart by their words.
                same = [j for j in range(a, b) if np.array_equal(self.stream[starts[j] : starts[j] + k], ids[i : i + k])]
                if same:
                    hit[i] += 1
                    hit[i + k] -= 1
                    items.update(owner[same].tolist())
        return np.cumsum(hit[:-1]) > 0, {self.names[j] for j in items}


def scan_hits(docs: DataFrame, benchmark: DataFrame, n: int = 13, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document row: doc_id, text, n_words, hits (hit word positions) and item_ids.

    The items' words are counted first; several sets mean as many passes over the documents, whose hits are merged row by row."""
    spark = docs.sparkSession
    items = benchmark.select("item_id", "text").where("item_id IS NOT NULL AND text IS NOT NULL")
    count = F.size(F.split(F.col("text"), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"))
    words = items.agg(F.coalesce(F.sum(count), F.lit(0))).first()[0]
    blocks = max(1, -(-words // BLOCK_WORDS))
    kept = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kept = kept.withColumns({"n_words": F.lit(0).cast("long"), "hits": F.array().cast("array<bigint>"), "item_ids": F.array().cast("array<string>")})
    for b in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        shared = spark.sparkContext.broadcast([tuple(r) for r in part])
        kept = kept.mapInArrow(_scanner(shared, n, uuid.uuid4().hex), kept.schema)
    return kept


def _scanner(shared, n: int, name: str):
    def run(batches):
        from granary.llm import decontaminate as own

        if name not in own._built:
            own._built.clear()  # one set a worker
            own._built[name] = Windows(shared.value, n)
        windows = own._built[name]
        for batch in batches:
            rows = []
            for text, hits, items in zip(batch[1], batch[3], batch[4]):
                words = item_words(text.as_py())
                covered, found = windows.scan(words)
                rows.append((len(words), sorted({*np.flatnonzero(covered).tolist(), *hits.as_py()}), sorted({*found, *items.as_py()})))
            cols = list(zip(*rows)) if rows else ([], [], [])
            yield pa.RecordBatch.from_arrays(
                [batch[0], batch[1], pa.array(cols[0], pa.int64()), pa.array(cols[1], batch.schema[3].type), pa.array(cols[2], batch.schema[4].type)],
                schema=batch.schema,
            )

    return run


def is_contaminated(n_words="n_words", hits="hits", least_twentieths: int = 1):
    """Hit words are at least so many twentieths of the words."""
    return (F.size(hits) > 0) & (20 * F.size(hits) >= least_twentieths * F.col(n_words))


def without_spans(text: str | None, hits: list[int]) -> str | None:
    """The text without its hit words (and what stands between two neighbouring ones)."""
    if text is None or not hits:
        return text
    gone, out, at = set(hits), [], 0
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    for i, m in enumerate(WORD.finditer(lowered)):
        if i in gone:
            if i - 1 not in gone:
                out.append(text[at : m.start()])
            at = m.end()
    return "".join(out) + text[at:]


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 13, remove: str = "documents") -> DataFrame:
    """Documents (all their columns) without contaminated ones, or with the hit spans cut out of each text."""
    names = docs.columns
    # Rows are told apart by all columns they came with: the text rides along, so no join back is needed.
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("doc_id"), F.col("text"))
    found = scan_hits(packed, benchmark, n)
    if remove == "documents":
        return found.where(~is_contaminated()).select(*[F.col("doc_id")[c].alias(c) for c in names])
    if remove != "spans":
        raise ValueError("remove: documents or spans")
    cleaned = F.udf(without_spans, "string", useArrow=True)("text", "hits")
    return found.select(*[cleaned.alias("text") if c == "text" else F.col("doc_id")[c].alias(c) for c in names])


def op1_decontaminate(spark, sf_dir: str) -> DataFrame:
    found = scan_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        F.size("hits").cast("long").alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("item_ids"), ","), 256).alias("items_sha256"),
        is_contaminated().alias("contaminated"),
    )


#: The same by joining all windows of every length that an item has.
OP1_SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
bs AS (SELECT item_id, w, least(13, len(w)) AS k, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM bs),
ds AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM bw) WHERE len(w) >= k),
hits AS (SELECT doc_id, item_id, i, bw.k FROM ds JOIN bw ON ds.k = bw.k AND array_to_string(w[i:i + ds.k - 1], ' ') = s),
pos AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY doc_id),
it AS (SELECT doc_id, count(DISTINCT item_id) AS n, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM hits GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(pos.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(it.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(pos.n, 0) > 0 AND 20 * coalesce(pos.n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN it USING (doc_id)
"""
