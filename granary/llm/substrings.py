"""Substring dedup: passages whose 13-word windows start in an earlier document are cut.

First pass. Each task counts the distinct windows of each of its documents into a count-min sketch's cells (DEPTH rows of
2**bits cells); the tasks' counts are merged cell block by cell block in executors. A cell's count is never under that of any
of its windows, so keeping "two documents or more" (a bit a cell) loses none. The number of cells follows the data, twice
the corpus's words, up to 2**MOST_BITS a row: the broadcast has at most DEPTH * 2**MOST_BITS bits (64 MiB). Beyond some 10**8
windows the filter lets more and more through; the second pass stays exact whatever it lets through.
Second pass. Windows whose cells all say "two or more" are grouped by two independent hashes of their words, of 64 and 31 bits (for
10**10 windows a chance of about 10**-9 that any two differ and agree; the words are not compared). Documents that a task meets together, up to GROUP windows
of them, ask about a window once, by the smallest of them; the others know already that it repeats, and their windows
travel packed. So a window has no more askers than there are such groups, however many documents have it.

The texts meet their windows in a join; for the way there each is packed.

Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. Null and empty texts have none; shorter texts have no window. Rows that
repeat a doc_id are judged as that one document. A null doc_id comes after all others: it owns nothing, and loses nothing.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.llm.common import WordCodes, rolling, table

BASES = (0xD1342543DE82EF95, 0x9E3779B97F4A7C15)
DEPTH, BLOCK_BITS, LEAST_BITS, MOST_BITS, GROUP = 2, 16, 20, 28, 1_500_000
MIX = (0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F)
LOW = (1 << 64) - 1


class WindowHashes:
    """Two independent hashes of each window of n words, of 64 and 31 bits."""

    def __init__(self, n: int):
        self.n, self.one, self.two = n, WordCodes(BASES[0]), WordCodes(*BASES)

    def __call__(self, data: bytes, both: bool = True) -> tuple[np.ndarray, ...]:
        ids = (self.two if both else self.one)(data)
        out = [rolling(x, self.n, BASES[k]) for k, x in enumerate(ids)]
        return (out[0], (out[1] >> np.uint64(33)).astype(np.int32)) if both else (out[0],)


def text_bytes(text: pa.StringScalar) -> bytes:
    """A text's UTF-8; null has none."""
    return text.as_buffer().to_pybytes() if text.is_valid else b""


def cells(window: np.ndarray, row: int, bits: int) -> np.ndarray:
    mixed = (window ^ (window >> np.uint64(31))) * np.uint64(MIX[row])
    return ((mixed ^ (mixed >> np.uint64(29))) * np.uint64(BASES[row]) >> np.uint64(64 - bits)).astype(np.uint32)


def gaps(cells: np.ndarray) -> bytes:
    """Rising numbers as bytes: the steps from one to the next, 255 for each whole 255 of a step, then its rest."""
    step = np.diff(cells.astype(np.int64), prepend=0)
    out = np.full(len(step) + int((step // 255).sum()), 255, np.uint8)
    out[np.cumsum(step // 255 + 1) - 1] = step % 255
    return out.tobytes()


def from_gaps(data: bytes) -> np.ndarray:
    x = np.frombuffer(data, np.uint8)
    return np.cumsum(x, dtype=np.int64)[x != 255]


def _counts(n: int, bits: int):
    def run(batches):
        hashes, low = WindowHashes(n), np.uint32((1 << BLOCK_BITS) - 1)
        for b in batches:
            found = [np.unique(hashes(text_bytes(t), False)[0]) for d, t in zip(b[0], b[1]) if d.is_valid]
            if not found:
                continue
            each = np.concatenate(found)
            rows = []
            for row in range(DEPTH):
                # A document's windows that share a cell count as many times: an overestimate, as count-min allows.
                cell, count = np.unique(cells(each, row, bits), return_counts=True)
                block = cell >> np.uint32(BLOCK_BITS)
                edges = np.flatnonzero(np.diff(block, prepend=np.uint32(2**31)))
                part = cell & low
                for lo, hi in zip(edges, [*edges[1:], len(cell)]):
                    once = count[lo:hi] == 1
                    rows.append((row << 16 | int(block[lo]), gaps(part[lo:hi][once]), gaps(part[lo:hi][~once])))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())],
                names=["block", "once", "more"],
            )

    return run


def _merge(batches):
    """Rows of a block come one after another; each block's counts are folded as they come."""
    at, seen, twice = None, None, None

    def full():
        return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([np.packbits(twice).tobytes()], pa.binary())], names=["block", "bits"])

    for b in batches:
        for block, once, more in zip(b[0].to_pylist(), b[1].to_pylist(), b[2].to_pylist()):
            if block != at:
                if at is not None:
                    yield full()
                at, seen, twice = block, np.zeros(1 << BLOCK_BITS, bool), np.zeros(1 << BLOCK_BITS, bool)
            x = from_gaps(once)
            twice[x[seen[x]]] = True
            seen[x] = True
            x = from_gaps(more)
            seen[x] = twice[x] = True
    if at is not None:
        yield full()


class Sketch:
    """A bit a cell, set where its count is two or more; blocks: rows (row << 16 | block, bits)."""

    def __init__(self, blocks: pa.Table, bits: int):
        self.bits, size = bits, 1 << (BLOCK_BITS - 3)
        self.rows = np.zeros((DEPTH, 1 << (bits - 3)), np.uint8)
        for block, held in zip(blocks[0].to_pylist(), blocks[1]):
            k = block & 0xFFFF
            self.rows[block >> 16, k * size : (k + 1) * size] = np.frombuffer(held.as_buffer(), np.uint8)

    def repeated(self, window: np.ndarray) -> np.ndarray:
        """Places of windows that every row counts twice or more."""
        out = np.arange(len(window))
        for row in range(DEPTH):
            c = cells(window[out], row, self.bits)
            out = out[(self.rows[row][c >> np.uint32(3)] >> (7 - (c & np.uint32(7))).astype(np.uint8)) & 1 == 1]
        return out


ASKS = "w bigint, v int, packed binary"


def _told(group: list[tuple], kind) -> pa.RecordBatch:
    """Rows (doc_id, w, v, packed) of documents met together: (id, windows, their second hashes) of each."""
    ids = sorted({d for d, _, _ in group})
    rank = {d: i for i, d in enumerate(ids)}
    group = sorted(group, key=lambda g: rank[g[0]])
    row = np.repeat(np.arange(len(group), dtype=np.int32), [len(w) for _, w, _ in group])
    w, v = np.concatenate([g[1] for g in group]), np.concatenate([g[2] for g in group])
    order = np.argsort(w, kind="stable")  # equal windows in the order of their documents
    w, v, row = w[order], v[order], row[order]
    doc = np.array([rank[d] for d, _, _ in group], np.int32)[row]
    new = np.ones(len(w), bool)
    new[1:] = (w[1:] != w[:-1]) | (v[1:] != v[:-1])
    first = doc[new][np.cumsum(new) - 1]
    again = np.zeros(len(w), bool)
    again[1:] = ~new[1:] & (doc[1:] == doc[:-1])  # the document has asked already
    asks, knows = (doc == first) & ~again, doc > first
    at = np.argsort(doc[knows], kind="stable")
    held, whose = w[knows][at], doc[knows][at]
    edges = np.flatnonzero(np.diff(whose, prepend=-1))
    packed = [held[lo:hi].tobytes() for lo, hi in zip(edges, [*edges[1:], len(held)])]
    named = pa.array(ids, kind)
    docs = pa.concat_arrays([named.take(pa.array(doc[asks])), named.take(pa.array(whose[edges]))])
    # Packed rows are spread by their bytes; no window's second hash is negative, so they share a group with none.
    extra = np.array([xxhash.xxh64_intdigest(p, i) - 2**63 for i, p in enumerate(packed)], np.int64)
    return pa.RecordBatch.from_arrays(
        [docs, pa.array(np.concatenate([w[asks].view(np.int64), extra])), pa.array(np.concatenate([v[asks], np.full(len(extra), -1, np.int32)])), pa.array([None] * int(asks.sum()) + packed, pa.binary())],
        names=["doc_id", "w", "v", "packed"],
    )


def _windows(shared, n: int, most: int):
    """Rows (doc_id, w, v, packed): windows a document asks about, and, packed, those of which it knows that they repeat."""

    def run(batches):
        sketch, hashes = shared.value, WindowHashes(n)
        group, size = [], 0
        for b in batches:
            for d, t in zip(b[0], b[1]):
                if not d.is_valid:
                    continue
                w, v = hashes(text_bytes(t))
                if len(at := sketch.repeated(w)):
                    group.append((d.as_py(), w[at], v[at]))
                    size += len(at)
                if size > most:
                    yield _told(group, b.schema[0].type)
                    group, size = [], 0
        if group:
            yield _told(group, b.schema[0].type)

    return run


def repeated_windows(docs: DataFrame, n: int = 13, most_bits: int = MOST_BITS, group: int = GROUP) -> DataFrame:
    """(doc_id, windows, packed): the first hashes of a document's windows that a document with a smaller doc_id also has."""
    spark = docs.sparkSession
    texts = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    chars = texts.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    bits = min(most_bits, max(LEAST_BITS, int(chars // 6 * 2).bit_length()))
    counted = texts.mapInArrow(_counts(n, bits), "block int, once binary, more binary")
    merged = counted.repartition("block").sortWithinPartitions("block").mapInArrow(_merge, "block int, bits binary")
    shared = spark.sparkContext.broadcast(Sketch(merged.toArrow(), bits))  # at most DEPTH * 2**most_bits bits
    found = texts.mapInArrow(_windows(shared, n, group), f"doc_id {kind}, {ASKS}")
    first = F.min("doc_id").over(Window.partitionBy("w", "v"))
    later = found.withColumn("first", first).where("packed IS NOT NULL OR first < doc_id")
    return later.groupBy("doc_id").agg(F.collect_list(F.when(F.col("packed").isNull(), F.col("w"))).alias("windows"), F.collect_list("packed").alias("packed"))


def pack(data: bytes) -> bytes:
    """A text's length in 8 bytes, then its bytes as zstd makes them."""
    return len(data).to_bytes(8, "little") + pa.Codec("zstd", compression_level=1).compress(data, asbytes=True)


def unpack(data: bytes) -> bytes:
    return pa.Codec("zstd").decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True)


def _packed(text_at: int):
    """Texts packed for their way to the windows that are cut from them."""

    def run(batches):
        for b in batches:
            cols = list(b.columns)
            cols[text_at] = pa.array([pack(text_bytes(t)) if t.is_valid else None for t in b[text_at]], pa.binary())
            yield pa.RecordBatch.from_arrays(cols, names=b.schema.names)

    return run


def _strip(n: int, text_at: int):
    """Texts come packed."""

    def run(batches):
        hashes = WindowHashes(n)
        for b in batches:
            rows = []
            for i in range(b.num_rows):
                text = b[text_at][i]
                data = unpack(text.as_py()) if text.is_valid else b""
                words = left = data.split()
                windows, packed = b[b.num_columns - 2][i], b[b.num_columns - 1][i]
                if windows.is_valid:
                    known = np.concatenate([np.asarray(windows.values, np.int64).view(np.uint64), *(np.frombuffer(p, np.uint64) for p in packed.as_py())])
                    starts = np.flatnonzero(np.isin(hashes(data, False)[0], known))
                    mark = np.zeros(len(words) + 1, np.int32)
                    np.add.at(mark, starts, 1)
                    np.add.at(mark, starts + n, -1)
                    gone = np.cumsum(mark[:-1]) > 0
                    left = [x for x, g in zip(words, gone.tolist()) if not g]
                whole = b" ".join(left)
                rows.append(((data if text.is_valid else None) if len(left) == len(words) else whole, len(words), len(words) - len(left), hashlib.sha256(whole).hexdigest()))
            cols = [b[i] for i in range(b.num_columns - 2)]
            cols[text_at] = pa.array([None if r[0] is None else r[0].decode("utf-8", "surrogatepass") for r in rows], pa.string())
            cols += [pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=[f"c{i}" for i in range(len(cols))])

    return run


def dedup_substrings(docs: DataFrame, n: int = 13, details: tuple = (), **more) -> DataFrame:
    """The documents with repeated passages cut from text (texts without any stay as they are). details: three names of
    columns that are added (words, removed words, SHA-256 of the kept ones), in place of input columns of those names. Rows
    and all other columns stay, whatever their names."""
    names = docs.columns
    cut_of = repeated_windows(docs.select("doc_id", "text"), n, **more).toDF("id", "windows", "packed")
    kinds, text_at = [f.dataType.simpleString() for f in docs.schema], names.index("text")
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    plain = plain.mapInArrow(_packed(text_at), ", ".join(f"c{i} {'binary' if i == text_at else k}" for i, k in enumerate(kinds)))
    joined = plain.join(cut_of, plain[f"c{names.index('doc_id')}"] == cut_of["id"], "left").drop("id")
    kinds += ["bigint", "bigint", "string"]
    out = joined.mapInArrow(_strip(n, text_at), ", ".join(f"c{i} {k}" for i, k in enumerate(kinds)))
    kept = [F.col(f"c{i}").alias(c) for i, c in enumerate(names) if c not in details]
    return out.select(*kept, *[F.col(f"c{len(names) + i}").alias(c) for i, c in enumerate(details)])


def op10_substrings(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_substrings(docs, details=("n_words", "n_removed", "kept_sha256")).select("doc_id", "n_words", "n_removed", "kept_sha256")


#: The same by hand: every window, its smallest document, the words under later ones.
OP10_SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 11, 1))) AS i FROM d WHERE len(w) >= 13),
g AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 12], ' ')) AS m FROM s),
f AS (SELECT m, min(doc_id) AS first FROM g GROUP BY m),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM g JOIN f USING (m) WHERE first < doc_id),
x AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(list_filter(w, lambda t, i: ps IS NULL OR NOT list_contains(ps, i)), ' ')) AS kept_sha256
FROM d LEFT JOIN x USING (doc_id)
"""
