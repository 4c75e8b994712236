"""SimHash near-duplicate groups, candidates found and pruned by the pigeonring rule.

A fingerprint is a ring of segments. When two fingerprints differ at d <= D bits in all, some segment starts a chain in
which, for every length k, the first k of m segments differ at no more than floor(k * D / m) bits together (pigeonring; plain
pigeonholes only give the first of these conditions).

Exact links of 64-bit fingerprints at D = 2 (``near_duplicates``): three segments of 22, 21 and 21 bits have budgets 0, 1
and 2, so a chain's first segment is equal, and its second within one bit; so one half of the second is equal too. Each
fingerprint stands under six keys of 31 to 33 bits (start, half: first segment and that half), which are counted in one
shuffle; those it shares with none go no further, the others' pairs meet the full Hamming check, the chain's last
condition. Only different fingerprints are compared. Where a half key has more than HALVES * BUCKET fingerprints, the whole
chain makes its members' candidates: each stands under its three exact keys (start, next) and is looked for under the keys
whose second segment is changed in one bit or none, 42 bits and more. Members of those keys with more than BUCKET fingerprints
(clouds of near copies) are linked without pairs and exactly: two fingerprints differ at 2 bits or fewer just when some value
lies within one bit of both, so each member emits its 65 values and links to the smallest member of each. Nothing is capped or
dropped.

Texts of similarity 0.8 or more (``granary.llm.near``) differ at about 15 % of their bits, where no key made of segments
selects; there the rule prunes candidate pairs of wide fingerprints (``ring_passes``).

Tables that grow with the data are joined by sorting (``merge``): the planner would broadcast each that is still small, and the
driver builds and keeps every one of them.

Texts: null and empty texts have no words and fingerprint zero, linked like any other; fewer than three words are
one shingle. Rows with a null doc_id get a null component and link nothing; repeated ids share a row's group.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.llm.common import cut, spread_join, table

#: (lowest bit, width) of the three segments of 64 bits.
RING, BUCKET = ((0, 22), (22, 21), (43, 21)), 64
#: Half keys bear so many times BUCKET: pairs cost less there than the 70 rows of the whole chain's keys.
HALVES = 4
BITS_OF_BYTE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the rows of (n, words) uint64 hashes have each bit."""
    parts = hashes.view(np.uint8).reshape(len(hashes), -1)
    if len(hashes) > 1000 and parts.shape[1] == 8:
        return np.concatenate([np.bincount(parts[:, k], minlength=256) @ BITS_OF_BYTE for k in range(8)])
    out = np.zeros(8 * parts.shape[1], np.int64)
    for i in range(0, len(parts), 255):  # 255 rows' counts fit a byte
        out += np.add.reduce(np.unpackbits(parts[i : i + 255], axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return out


def fingerprint(text: str | None, n: int = 3) -> int:
    """Signed 64-bit fingerprint of a text's shingles, repeats included."""
    words = [] if text is None else text.encode("utf-8", "surrogatepass").lower().split()  # ASCII letters alone
    if not words:
        return 0
    if len(words) <= n:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), 42)]
    else:
        whole = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = (ends[: 1 - n] - np.fromiter(map(len, words[: 1 - n]), np.int64, len(words) - n + 1) - 1).tolist()
        hash_of = functools.partial(xxhash.xxh64_intdigest, seed=42)
        hashes = [hash_of(whole[a:b]) for a, b in zip(starts, (ends[n - 1 :] - 1).tolist())]
    return int(np.packbits(2 * bit_counts(np.array(hashes, np.uint64)[:, None]) > len(hashes), bitorder="little").view(np.int64)[0])


def ring_passes(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Which pairs of fingerprints (rows of uint16 segments) have a chain that keeps its proportional budget at every length."""
    m = a.shape[1]
    differ = np.bitwise_count(a ^ b).astype(np.int32)
    sums = np.cumsum(np.concatenate([differ, differ[:, :-1]], 1), 1)
    before = np.concatenate([np.zeros((len(a), 1), np.int32), sums], 1)
    budget = np.arange(1, m + 1) * most // m
    ok = np.zeros(len(a), bool)
    for start in range(m):
        ok |= (sums[:, start : start + m] - before[:, start : start + 1] <= budget).all(1)
    return ok


def _prints(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([b[0], pa.array([fingerprint(t.as_py()) for t in b[1]], pa.int64())], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_prints, f"doc_id {kind}, fp bigint")


def _key(start: int) -> Column:
    """A chain's first two segments and where it starts: start | first | second."""
    first, second = (F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << width) - 1)) for low, width in (RING[start], RING[(start + 1) % 3]))
    return F.shiftleft(first, 22).bitwiseOR(second).bitwiseOR(F.lit(start << 60))


def half_keys(prints: DataFrame) -> DataFrame:
    """Rows (fp, key): a chain's start, its first segment and one half of its second, for each start and half."""
    low = [(1 << (RING[(start + 1) % 3][1] + 1) // 2) - 1 for start in range(3)]
    halves = [_key(start).bitwiseAND(F.lit(~hidden)).bitwiseOR(F.lit(half << 62)) for start in range(3) for half, hidden in enumerate((low[start], ((1 << 22) - 1) ^ low[start]))]
    return prints.select("fp", F.explode(F.array(*halves)).alias("key"))


def chain_keys(prints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (fp, key): the exact keys, and the keys with the second segment as it is and with each bit turned."""
    exact = prints.select("fp", F.explode(F.array(*[_key(s) for s in range(3)])).alias("key"))

    def turned(start: int) -> Column:
        bits = F.array(*[F.lit(x).cast("long") for x in (0, *(1 << j for j in range(RING[(start + 1) % 3][1])))])
        return F.transform(bits, lambda bit: _key(start).bitwiseXOR(bit))

    return exact, prints.select("fp", F.explode(F.concat(*[turned(s) for s in range(3)])).alias("key"))


def links(prints: DataFrame, most: int = 2) -> DataFrame:
    """Edges (a, b), a < b, that join all fingerprints linked at up to ``most`` = 2 differing bits (and only those)."""
    if most != 2:
        raise ValueError("the segments are laid out for 2 bits")
    within = lambda pairs: pairs.where("a < b").where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= most).select("a", "b")
    shared = cut(half_keys(prints).withColumn("n", F.count("*").over(Window.partitionBy("key"))).where("n > 1"))
    few = shared.where(F.col("n") <= HALVES * BUCKET)
    met = within(few.select("key", F.col("fp").alias("a")).join(few.select("key", F.col("fp").alias("b")).hint("merge"), "key"))
    exact, looked = chain_keys(shared.where(F.col("n") > HALVES * BUCKET).select("fp").distinct())
    large = cut(exact.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > BUCKET).select("key")).hint("merge")
    near = within(exact.join(large, "key", "left_anti").withColumnRenamed("fp", "a").join(looked.withColumnRenamed("fp", "b").hint("merge"), "key"))
    crowded = looked.join(large, "key", "left_semi").select("fp").distinct()
    ball = F.concat(F.array("fp"), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))))
    around = crowded.select("fp", F.explode(ball).alias("mid"))
    least = around.groupBy("mid").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1").select("mid", "a")
    stars = around.join(least.hint("merge"), "mid").where(F.col("a") < F.col("fp")).select("a", F.col("fp").alias("b"))
    return met.unionByName(near).unionByName(stars).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges: each round every node moves to its smallest neighbour, then the
    edges between the nodes that are left are taken; they at least halve, and the mapping is carried along. Joins on
    a root or a hub are spread, as one may have a large share of all rows."""
    edges = cut(edges)
    roots = None
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        move = cut(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("to")))
        if roots is None:
            roots = move.select(F.col("a").alias("node"), F.col("to").alias("root"))
        else:
            roots = spread_join(roots, move.withColumnRenamed("a", "root").hint("merge"), "root", "node").select("node", F.coalesce("to", "root").alias("root"))
        roots = cut(roots)
        x, y = move.select("a", F.col("to").alias("x")), move.select(F.col("a").alias("b"), F.col("to").alias("y"))
        moved = spread_join(spread_join(edges, x.hint("merge"), "a", "b", "inner"), y.hint("merge"), "b", "a", "inner")
        edges = cut(moved.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    return roots if roots is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per document row: doc_id, fp (signed 64 bits), component_id (smallest doc_id reachable)."""
    prints = cut(fingerprints(docs))
    firsts = prints.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(links(firsts.select("fp")))
    mapped = firsts.join(roots.hint("merge"), firsts.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "first")
    # Which fingerprint ends as root is arbitrary; the component is named by its smallest doc_id.
    names = mapped.groupBy("root").agg(F.min("first").alias("component_id"))
    by_print = spread_join(mapped, names.hint("merge"), "root", "fp", "inner").select("fp", "component_id")
    return spread_join(prints, by_print.hint("merge"), "fp", "doc_id").select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def op6_simhash(spark, sf_dir: str) -> DataFrame:
    got = near_duplicates(table(spark, sf_dir, "documents"))
    return got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
