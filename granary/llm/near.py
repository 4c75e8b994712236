"""Near-duplicate documents: SimHash of WORDS-word shingle sets, for Jaccard similarity SIMILAR or more.

At similarity 0.8 two sets' fingerprints differ at about 15 % of their bits. No key made of segments selects there, so
candidates come from minima of the same shingle hashes: BANDS keys of ROWS minima each; a pair of similarity 0.8
shares no key with a chance of (1 - 0.8**ROWS)**BANDS, below 1 in 10,000. All pairs that share a key are then pruned by
SimHash: BITS-bit fingerprints pass the pigeonring rule, then the full Hamming check, at MOST differing bits. That is five
standard deviations above what similarity 0.8 gives (78 of 512, deviation 8), and below what 0.5 gives (137). What is left is
compared by whole shingle sets (32 bits of each shingle's hash), so no pair below SIMILAR is linked.

Only different sets are compared. A key of up to BUCKET sets compares all its pairs. In larger ones (clouds of near
copies) each member is compared with one leader, another one in each band, so the work does not grow with the square. What
the leaders leave apart is then compared exactly: of each member of such keys the rarest shingles, as many as a set of
similarity SIMILAR can't miss all, are joined, and members that share one but are in different groups are compared. A cloud
is one group by then but for a few, so only those few meet it, and texts that merely share a frame have no rare shingle in common.

Words are split at ASCII blanks, ASCII letters lowered; texts of fewer than WORDS words are one shingle. Null and empty
texts have no shingle and are one group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import WordCodes, cut, rolling, spread_join
from granary.llm.simhash import bit_counts, components, ring_passes

WORDS, SIMILAR = 5, 0.8
BITS, MOST = 512, 118
ROWS, BANDS, BUCKET, PART, SLICE = 5, 24, 64, 1024, 512
BASE, MIX = 0xD1342543DE82EF95, np.uint64(0x9FB21C651E98DF25)
_rng = np.random.default_rng(6)
TURN, SHIFT = (_rng.integers(0, 2**64, (ROWS * BANDS, 1), np.uint64) | np.uint64(1) for _ in range(2))
JOIN = _rng.integers(0, 2**64, (BANDS, ROWS), np.uint64) | np.uint64(1)
WIDE = _rng.integers(0, 2**64, BITS // 64, np.uint64) | np.uint64(1)


def shingles(text: str | None, codes: WordCodes) -> np.ndarray:
    """Sorted different hashes of a text's shingles."""
    (words,) = codes((text or "").encode("utf-8", "surrogatepass").lower())
    if not len(words):
        return np.empty(0, np.uint64)
    runs = rolling(words, min(WORDS, len(words)), BASE)
    runs = (runs ^ (runs >> np.uint64(32))) * MIX
    return np.unique(runs ^ (runs >> np.uint64(29)))


def wide_print(own: np.ndarray) -> bytes:
    """The SimHash of a set in BITS bits."""
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(own), 1 << 16):
        h = own[i : i + (1 << 16), None] * WIDE
        h ^= h >> np.uint64(32)
        h *= MIX
        h ^= h >> np.uint64(29)
        ones += bit_counts(h)
    return np.packbits(2 * ones > len(own), bitorder="little").tobytes()


def band_keys(own: np.ndarray) -> np.ndarray:
    low = np.full(ROWS * BANDS, 2**64 - 1, np.uint64)
    for i in range(0, len(own), PART):
        low = np.minimum(low, (own[i : i + PART] * TURN + SHIFT).min(1))
    low = low.reshape(BANDS, ROWS)
    keys = ((low ^ (low >> np.uint64(31))) * JOIN).sum(1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)
    return ((keys ^ (keys >> np.uint64(32))) * MIX).view(np.int64)


def sliced(batches):
    for b in batches:
        for i in range(0, b.num_rows, SLICE):
            yield b.slice(i, SLICE)


def _sets(batches):
    codes = WordCodes(BASE)
    for b in sliced(batches):
        nodes, keys, prints, sets = [], [], [], []
        for t in b[2]:
            own = shingles(t.as_py(), codes)
            nodes.append(xxhash.xxh64_intdigest(own.tobytes()) - 2**63)
            keys.append(band_keys(own) if len(own) else None)
            prints.append(wide_print(own) if len(own) else None)
            sets.append((own >> np.uint64(32)).astype(np.uint32).tobytes())
        cols = [b[0], b[1], pa.array(nodes, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(prints, pa.binary()), pa.array(sets, pa.binary())]
        yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "h", "node", "keys", "print", "own"])


def similarity(a: bytes, b: bytes) -> float:
    x, y = (np.unique(np.frombuffer(s, np.uint32)) for s in (a, b))
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both)


def _pruned(batches):
    """Pairs (a, b, x, y) whose fingerprints x and y pass the ring, then the full Hamming check."""
    for b in batches:
        x, y = (np.frombuffer(b"".join(c.to_pylist()), np.uint16).reshape(b.num_rows, -1) for c in (b[2], b[3]))
        at = np.flatnonzero(ring_passes(x, y, MOST))
        at = at[np.bitwise_count(x[at] ^ y[at]).sum(1, dtype=np.int64) <= MOST]
        yield pa.RecordBatch.from_arrays([b[0], b[1]], names=["a", "b"]).take(pa.array(at))


def _verify(batches):
    for b in sliced(batches):
        ok = [similarity(x.as_py(), y.as_py()) >= SIMILAR for x, y in zip(b[2], b[3])]
        yield pa.RecordBatch.from_arrays([b[0], b[1]], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))


def _with_both(pairs: DataFrame, values: DataFrame, value: str, salts: int = 1) -> DataFrame:
    """Pairs (a, b) with the values x of a and y of b; rows (node, value), one a node. A leader is in many pairs: small values are
    there ``salts`` times, so that its pairs are dealt over as many tasks."""
    first = spread_join(pairs, values.select(F.col("node").alias("a"), F.col(value).alias("x")), "a", "b", "inner", salts)
    return spread_join(first, values.select(F.col("node").alias("b"), F.col(value).alias("y")), "b", "a", "inner", salts).select("a", "b", "x", "y")


def candidate_pairs(sets: DataFrame, bucket: int = BUCKET) -> tuple[DataFrame, DataFrame]:
    """(pairs a < b to compare, nodes of keys with more than ``bucket`` sets) of rows (node, keys, print, own)."""
    nodes = sets.where("keys IS NOT NULL").groupBy("node").agg(F.first("keys").alias("keys"))
    keyed = nodes.select("node", F.explode("keys").alias("key"))
    # The leader is another one in each band: the smallest by a hash of key and node.
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct(F.xxhash64("key", "node"), "node"))["node"].alias("leader")).where("n > 1")
    shared = cut(keyed.join(sizes, "key"))
    small = shared.where(F.col("n") <= bucket)
    near = small.select("key", F.col("node").alias("a")).join(small.select("key", F.col("node").alias("b")), "key").where("a < b").select("a", "b")
    crowded = shared.where(F.col("n") > bucket)
    stars = crowded.where(F.col("node") != F.col("leader")).select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b"))
    return cut(near.unionByName(stars).distinct()), cut(crowded.select("node").distinct())


def compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of pairs (a, b), those of similar sets: by SimHash first, what is left by the sets."""
    needed = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    prints = cut(sets.select("node", "print").join(needed, "node", "left_semi").groupBy("node").agg(F.first("print").alias("print")))
    pairs = cut(_with_both(pairs, prints, "print", 8).mapInArrow(_pruned, "a bigint, b bigint"))
    needed = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    own = cut(sets.select("node", "own").join(needed, "node", "left_semi").groupBy("node").agg(F.first("own").alias("own")))
    return cut(_with_both(pairs, own, "own").mapInArrow(_verify, "a bigint, b bigint"))


def _bins(batches):
    """Of one task's sets, how many have a shingle in each of 2**20 bins, in blocks."""
    count = np.zeros(1 << 20, np.int32)
    for b in batches:
        for own in b[0]:
            x = np.frombuffer(own.as_py(), np.uint32)
            np.add.at(count, np.unique(x >> np.uint32(12)), 1)
    live = [k for k in range(256) if count[k << 12 : (k + 1) << 12].any()]
    yield pa.RecordBatch.from_arrays([pa.array(live, pa.int32()), pa.array([count[k << 12 : (k + 1) << 12].tobytes() for k in live], pa.binary())], names=["block", "bins"])


def _added(batches):
    """Rows of a block come one after another; their counts are added."""
    at, total = None, None
    row = lambda: pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([total.astype(np.int64).tobytes()], pa.binary())], names=["block", "bins"])
    for b in batches:
        for block, bins in zip(b[0].to_pylist(), b[1].to_pylist()):
            if block != at:
                if at is not None:
                    yield row()
                at, total = block, np.zeros(1 << 12, np.int64)
            total += np.frombuffer(bins, np.int32)
    if at is not None:
        yield row()


def _rarest(shared):
    """Rows (token, at, node, root, size) of each set's rarest shingles, by the one order that all tasks have."""

    def run(batches):
        count = np.zeros(1 << 20, np.int64)
        for block, bins in shared.value:
            count[block << 12 : (block + 1) << 12] = np.frombuffer(bins, np.int64)
        for b in sliced(batches):
            cols = [[], [], [], [], []]
            for node, root, own in zip(b[0].to_pylist(), b[1].to_pylist(), b[2]):
                x = np.unique(np.frombuffer(own.as_py(), np.uint32))
                need = int(np.ceil(SIMILAR * len(x) - 1e-9))
                first = x[np.lexsort((x, count[x >> np.uint32(12)]))[: len(x) - need + 1]]
                for col, values in zip(cols, (first.astype(np.int64), np.arange(len(first)), *(np.full(len(first), v, np.int64) for v in (node, root, len(x))))):
                    col.append(values)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, np.int64), *c]), pa.int64()) for c in cols], names=["token", "at", "node", "root", "size"])

    return run


def apart(crowded: DataFrame, sets: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs a < b of crowded nodes in different groups that share one of their rarest shingles and differ in size as similar
    sets may."""
    spark = sets.sparkSession
    own = sets.select("node", "own").join(crowded, "node", "left_semi").groupBy("node").agg(F.first("own").alias("own"))
    own = cut(spread_join(own, roots, "node", "node", salts=1).select("node", F.coalesce("root", "node").alias("root"), "own"))
    bins = own.select("own").mapInArrow(_bins, "block int, bins binary").repartition("block").sortWithinPartitions("block").mapInArrow(_added, "block int, bins binary")
    shared = spark.sparkContext.broadcast([tuple(r) for r in bins.collect()])  # 8 MB at most
    rare = cut(own.mapInArrow(_rarest(shared), "token bigint, at bigint, node bigint, root bigint, size bigint"))
    groups = rare.groupBy("token", "root").agg(F.count("*").alias("n"))
    # Of each shingle the largest group; members of the others meet all that have it.
    main = groups.groupBy("token").agg(F.count("*").alias("k"), F.max_by("root", "n").alias("main")).where("k > 1").select("token", "main")
    members = cut(spread_join(rare, main, "token", "node", "inner"))
    few = members.where("root <> main").select("token", F.col("node").alias("x"), F.col("root").alias("rx"), F.col("size").alias("sx"), F.col("at").alias("ax"))
    met = spread_join(members.select("token", "at", "node", "root", "size"), few, "token", "node", "inner").where(F.col("root") != F.col("rx"))
    met = met.where((F.col("size") >= F.col("sx") * (SIMILAR - 1e-9)) & (F.col("sx") >= F.col("size") * (SIMILAR - 1e-9)))
    # By position: what can be shared from this shingle on, were it the first shared one, must be enough for similarity.
    least = (F.col("size") + F.col("sx")) * (SIMILAR / (1 + SIMILAR)) - 1e-6
    met = met.where(F.least(F.col("size") - F.col("at"), F.col("sx") - F.col("ax")) >= least)
    return met.select(F.least("node", "x").alias("a"), F.greatest("node", "x").alias("b")).distinct()


def groups(sets: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(node, root) of all nodes that are linked to another."""
    pairs, crowded = candidate_pairs(sets, bucket)
    edges = compared(pairs, sets)
    roots = components(edges)
    if crowded.isEmpty():
        return roots
    more = compared(cut(apart(crowded, sets, roots)), sets)
    return roots if more.isEmpty() else components(edges.unionByName(more))


def near_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, h, root) of every row: h is a hash of its text, root names its group."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.xxhash64("text").alias("h"), "text")
    sets = cut(rows.mapInArrow(_sets, f"doc_id {kind}, h bigint, node bigint, keys array<bigint>, print binary, own binary"))
    roots = groups(sets.where("doc_id IS NOT NULL"))
    return spread_join(sets.select("doc_id", "h", "node"), roots, "node", "h").select("doc_id", "h", F.coalesce("root", "node").alias("root"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each near-duplicate group: that of the smallest doc_id, then of the smallest text hash; null ids stay.

    Rows that repeat an id are judged each by its own text."""
    first = F.min(F.struct("doc_id", "h"))
    kept = near_rows(docs).where("doc_id IS NOT NULL").groupBy("root").agg(first.alias("r")).select(F.col("r.doc_id").alias("_id"), F.col("r.h").alias("_h")).distinct()
    names = docs.columns
    rows = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_h"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"))
    once = rows.join(kept, ["_id", "_h"], "left_semi").groupBy("_id", "_h").agg(F.min("_row").alias("_row"))
    return once.select(*[F.col("_row")[c].alias(c) for c in names]).unionByName(docs.where("doc_id IS NULL"))
