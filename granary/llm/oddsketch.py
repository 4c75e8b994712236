"""Near-duplicate documents by MinHash, with odd sketches for the candidates.

A document's set are its different WORDS-word shingles (ASCII letters lowered, words split at ASCII blanks; fewer words: all as
one). Documents are linked if the sets' intersection is at least SIMILAR hundredths of their union.

SAMPLES minima of the set's hashes are taken. BANDS keys of ROWS of them each make the candidates; a pair of similarity 0.8
shares no key with a chance of (1 - 0.8**ROWS)**BANDS, 3 in a million. All samples are folded into an odd sketch, BITS
bits that tell how often, odd or even, a sample hashed there. The XOR of two sketches is the sketch of the samples that differ, and z
ones in it mean some -BITS/2 ln(1 - 2z/BITS) differing samples. Pairs of similarity 0.8 have 84 ones (deviation 10); those
with more than MOST, six deviations above, are dropped. What is left is compared by its words, set by set.

Only different sets are compared, each standing for its copies. First each set meets one leader a key: the set that shares most keys
with others, all keys counted, as one in the middle of a cloud of copies does. Nearly all that belongs to a cloud is linked by then.
What a key still has in different groups is compared exactly, without a cap: sets of such keys are joined by their rarest
shingles, of which two similar sets share one (``near.apart``); what a cloud's far members have of their own is rare, so
they hardly meet, while all pairs of a key would be the square of a cloud.

Compared texts travel once a pair, sets of many pairs in slices of SLICE, and are read one by one.

Defined cases: null, empty and blank texts have an empty set and are linked with nothing. Rows with a null id have a set size, but link
nothing and have neither component nor ``kept``. Rows that repeat an id are one document as to links: what any of its texts
is linked with. Ids are integers. Empty tables give no rows; columns but doc_id and text are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import WordCodes, cut, rolling, table
from granary.llm.near import apart
from granary.llm.simhash import components

WORDS, SIMILAR = 4, 80
ROWS, BANDS, SAMPLES, BITS, MOST = 5, 32, 256, 512, 144
SLICE, PART, BATCH = 64, 1024, 512
#: Values of the hash that says which texts are moved at all: a table of so many rows at most is broadcast.
SIEVE = 1 << 19
BASE, MIX = 0xD1342543DE82EF95, np.uint64(0x9FB21C651E98DF25)
_rng = np.random.default_rng(12)
TURN, SHIFT = (_rng.integers(0, 2**32, (SAMPLES, 1), np.uint32) | np.uint32(1) for _ in range(2))
JOIN = _rng.integers(0, 2**64, (BANDS, ROWS), np.uint64) | np.uint64(1)
PLACE = _rng.integers(0, 2**64, SAMPLES, np.uint64)


def shingle_hashes(data: bytes, codes: WordCodes) -> np.ndarray:
    """Sorted different 64-bit hashes of the shingles."""
    (words,) = codes(data.lower())
    if not len(words):
        return np.empty(0, np.uint64)
    runs = rolling(words, min(WORDS, len(words)), BASE)
    runs = (runs ^ (runs >> np.uint64(32))) * MIX
    return np.unique(runs ^ (runs >> np.uint64(29)))


def shingle_set(text: str) -> set:
    """The shingles themselves."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    return set(zip(*(words[i:] for i in range(WORDS)))) if len(words) >= WORDS else {tuple(words)} if words else set()


def samples(own: np.ndarray) -> np.ndarray:
    x, low = (own >> np.uint64(32)).astype(np.uint32), np.full(SAMPLES, 2**32 - 1, np.uint32)
    for i in range(0, len(x), PART):
        low = np.minimum(low, (x[i : i + PART] * TURN + SHIFT).min(1))
    return low.astype(np.uint64)


def band_keys(low: np.ndarray) -> np.ndarray:
    keys = (low[: ROWS * BANDS].reshape(BANDS, ROWS) * JOIN).sum(1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)
    keys = (keys ^ (keys >> np.uint64(32))) * MIX
    return (keys ^ (keys >> np.uint64(29))).view(np.int64)


def odd_sketch(low: np.ndarray) -> np.ndarray:
    """For each bit, whether an odd number of samples falls on it; as 64-bit numbers."""
    at = (low ^ PLACE) * MIX
    at = ((at ^ (at >> np.uint64(32))) * MIX) >> np.uint64(64 - BITS.bit_length() + 1)
    return np.packbits(np.bincount(at.astype(np.int64), minlength=BITS) & 1, bitorder="little").view(np.int64)


def _sketched(batches):
    codes, lists = WordCodes(BASE), pa.list_(pa.int64())
    for batch in batches:
        for i in range(0, batch.num_rows, BATCH):
            b = batch.slice(i, BATCH)
            digests, sizes, keys, sketches = [], [], [], []
            for t in b[1]:
                own = shingle_hashes((t.as_py() or "").encode("utf-8", "surrogatepass"), codes)
                low = samples(own) if len(own) else None
                sizes.append(len(own))
                digests.append(hashlib.blake2b(own, digest_size=16).digest() if len(own) else None)
                keys.append(band_keys(low) if len(own) else None)
                sketches.append(odd_sketch(low) if len(own) else None)
            yield pa.RecordBatch.from_arrays([b[0], pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(keys, lists), pa.array(sketches, lists)], names=["doc_id", "digest", "n", "keys", "sketch"])


def differing(x: str, y: str) -> Column:
    """Ones in the XOR of two sketches."""
    return sum((F.bit_count(F.get(x, i).bitwiseXOR(F.get(y, i))) for i in range(BITS // 64)), F.lit(0))


def with_bits(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) with z, if their sketches are near enough."""
    x, y = nodes.select(F.col("node").alias("a"), F.col("sketch").alias("x")), nodes.select(F.col("node").alias("b"), F.col("sketch").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", differing("x", "y").alias("z")).where(F.col("z") <= MOST)


def _confirmed(batches):
    """Rows come by hub and slice, the hub's text first (kind 0): pairs of hub and other with similar sets."""
    at, own = None, []
    for b in batches:
        found = []
        for hub, part, kind, other, text in zip(*(c.to_pylist() for c in b.columns[:4]), b.column(4)):
            if (hub, part) != at:
                at, own = (hub, part), []
            mine = shingle_set(text.as_py())
            if kind == 0:
                own.append(mine)
                continue
            for x in own:
                both = len(x & mine)
                if 100 * both >= SIMILAR * (len(x) + len(mine) - both):
                    found.append((hub, other))
                    break
        cols = list(zip(*found)) if found else ([], [])
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["a", "b"])


def confirmed(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Of pairs (a, b), those of similar texts. a's text goes once to each slice of its pairs."""
    sized = pairs.join(pairs.groupBy("a").agg(F.count("*").alias("n")), "a")
    dealt = cut(sized.select("a", "b", F.pmod(F.xxhash64("b"), F.expr(f"(n + {SLICE - 1}) div {SLICE}")).alias("part")))
    hubs = dealt.select(F.col("a").alias("doc_id"), F.col("a").alias("hub"), "part", F.lit(0).alias("kind")).distinct()
    others = dealt.select(F.col("b").alias("doc_id"), F.col("a").alias("hub"), "part", F.lit(1).alias("kind"))
    sent = only(docs, dealt.select(F.explode(F.array("a", "b")).alias("doc_id"))).join(hubs.unionByName(others), "doc_id")
    sent = sent.select("hub", "part", "kind", F.col("doc_id").alias("other"), "text").repartition("hub", "part").sortWithinPartitions("hub", "part", "kind")
    return cut(sent.mapInArrow(_confirmed, "a bigint, b bigint").distinct())


def shared_keys(nodes: DataFrame) -> DataFrame:
    """(key, node, leader) of keys that several sets have. A key's leader is the one with the most company in all its keys."""
    keyed = nodes.select("node", F.explode("keys").alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = cut(keyed.join(sizes, "key"))
    company = shared.groupBy("node").agg(F.sum("n").alias("company"))
    leaders = shared.join(company, "node").groupBy("key").agg(F.max(F.struct("company", "node"))["node"].alias("leader"))
    return cut(shared.select("key", "node").join(leaders, "key"))


def mixed(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """The sets of keys whose sets are in different groups."""
    rooted = shared.select("key", "node").join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    several = rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
    return cut(rooted.join(several, "key").select("node").distinct())


def only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows with texts, without most of those whose ids aren't among ``ids``: a hash of the ids sifts them where they're read."""
    of = lambda c: F.pmod(F.xxhash64(c), F.lit(SIEVE))
    held = ids.select(of("doc_id").alias("sieve")).distinct()
    return docs.select("doc_id", "text").where("text IS NOT NULL").withColumn("sieve", of("doc_id")).join(F.broadcast(held), "sieve", "left_semi").drop("sieve")


def _own(batches):
    codes = WordCodes(BASE)
    for b in batches:
        sets = [(shingle_hashes(t.as_py().encode("utf-8", "surrogatepass"), codes) >> np.uint64(32)).astype(np.uint32).tobytes() for t in b[1]]
        yield pa.RecordBatch.from_arrays([b[0], pa.array(sets, pa.binary())], names=["node", "own"])


def links(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """Pairs (a, b) that join all sets (node, keys, sketch) linked by similarity. A node is the id of a document with that set."""
    shared = shared_keys(nodes)
    stars = shared.where("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    edges = confirmed(cut(with_bits(stars, nodes).select("a", "b")), docs)
    roots = components(edges)
    rest = mixed(shared, roots)
    if rest.isEmpty():
        return edges
    texts = only(docs, rest.withColumnRenamed("node", "doc_id")).withColumnRenamed("doc_id", "node").join(rest, "node", "left_semi")
    pairs = apart(rest, cut(texts.mapInArrow(_own, "node bigint, own binary")), roots)
    return edges.unionByName(confirmed(cut(with_bits(pairs, nodes).select("a", "b")), docs))


def near_documents(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id (the smallest id reachable by links)."""
    if docs.schema["doc_id"].dataType.simpleString() not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError("ids must be integers")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = cut(docs.mapInArrow(_sketched, "doc_id bigint, digest binary, n bigint, keys array<bigint>, sketch array<bigint>"))
    able = rows.where("digest IS NOT NULL AND doc_id IS NOT NULL")
    sets = cut(able.groupBy("digest").agg(F.min_by(F.struct("doc_id", "keys", "sketch"), "doc_id").alias("s")).select("digest", F.col("s.doc_id").alias("node"), "s.keys", "s.sketch"))
    members = cut(rows.select("doc_id", "n", "digest").join(sets.select("digest", "node"), "digest", "left").select("doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.col("node")).alias("node")))
    # An id that is repeated with other texts joins their sets.
    ids = members.where("node IS NOT NULL").groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("most")).where("a <> most").select("doc_id", "a")
    same = members.join(ids, "doc_id").where("node <> a").select("a", F.col("node").alias("b"))
    roots = components(links(sets.drop("digest"), docs).unionByName(same))
    names = roots.groupBy("root").agg(F.min("node").alias("component_id"))
    known = roots.join(names, "root").select("node", "component_id")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.coalesce("component_id", "node"))
    return members.join(known, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_documents(table(spark, sf_dir, "documents")).withColumn("kept", F.col("doc_id") == F.col("component_id"))


#: The same by all pairs of documents that share a shingle.
OP12_SQL = """
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s FROM d),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
pairs AS MATERIALIZED (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
edges AS MATERIALIZED (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, min(b) AS component_id, d.doc_id = min(b) AS kept FROM d LEFT JOIN n USING (doc_id) JOIN reach ON a = d.doc_id GROUP BY d.doc_id, n
"""
