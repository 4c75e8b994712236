"""Merkle manifest of a dataset: a tree a source over its rows in order of their ids, and one tree over the sources' roots.

The leaves are sorted once by (source, id), in ranges over many tasks, and numbered there; a few numbers a partition say where
a source goes on from the partition before. From then on a node is known by its coordinate (tree, level, place). Trees grow
in passes of LEVELS levels: FAN ** LEVELS consecutive nodes are a chunk, a whole subtree, so a task needs no other. Each pass
reads the level that the pass before ended with and writes its nodes to Parquet files partitioned by level (the node store).
Proofs come down the same way: chunk by chunk the stored levels are merged with the path of the chunk's top, which gives the
paths of its lowest nodes; the last pass down has the leaves. A task holds one chunk, so neither memory nor tasks grow with a
source; a source of a third of all rows is as many chunks as it needs. The root is the one digest that the driver sees.

Defined cases: a null field is ``-``, so null and empty text differ; the null source is a tree of its own, the first one. A null id
comes before all others; rows that repeat an id are all leaves, in order of their digests. A source of one row has its leaf as
root, a table of one source that source's root. An empty table has no rows (and no root). Extra columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import cut, shared_dir, table
from granary.sources.shared import delete

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FAN, LEVELS = 3, 6
NODE = "tree string, pos bigint, digest binary, last boolean, top boolean, more boolean, level int"


def digest_of(*values: Column) -> Column:
    """sha256 of the values: each ``-`` if null, else its length in bytes, a colon and its text."""
    parts = [F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in (x.cast("string") for x in values)]
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


def tree_of(source: Column) -> Column:
    """Names a source's tree; names sort as sources do, bytewise and null first."""
    return F.coalesce(F.concat(F.lit("1"), source.cast("string")), F.lit("0"))


def joined(nodes: list[str]) -> str:
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def _numbered(batches):
    """Of a partition's rows, sorted by tree (the first column): the tree's number here, the place in it, whether it's the last."""
    held, seg, at = None, 0, 0

    def given(rows, segs, places, lasts):
        return pa.RecordBatch.from_arrays([*rows.columns, pa.array(segs, pa.int64()), pa.array(places, pa.int64()), pa.array(lasts, pa.bool_())], names=[*rows.schema.names, "seg", "at", "last"])

    for b in batches:
        if not b.num_rows:
            continue
        rows = b if held is None else pa.concat_batches([held, b])
        n, tree = rows.num_rows, rows.column(0)
        new = pc.not_equal(tree.slice(1), tree.slice(0, n - 1)).to_numpy(zero_copy_only=False).astype(bool)
        starts, index = np.concatenate([[False], new]), np.arange(n)
        segs, places = seg + np.cumsum(starts), index - np.maximum.accumulate(np.where(starts, index, -at))
        yield given(rows.slice(0, n - 1), segs[:-1], places[:-1], new)
        held, seg, at = rows.slice(n - 1), int(segs[-1]), int(places[-1])
    if held is not None:
        yield given(held, [seg], [at], [True])


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """Rows (tree, ...) with pos, their place in the tree by ``order``, and last."""
    spark = rows.sparkSession
    dealt = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "tree", *order).sortWithinPartitions("tree", *order)
    parted = dealt.withColumn("part", F.spark_partition_id())
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in parted.schema)
    placed = cut(parted.mapInArrow(_numbered, f"{kinds}, seg bigint, at bigint, last boolean"))
    ends = placed.groupBy("part").agg(F.min(F.struct("seg", "tree"))["tree"].alias("first"), F.max(F.struct("seg", "at", "tree")).alias("end")).orderBy("part").collect()  # one row a partition
    known, before, total = [], None, 0
    for i, (part, first, (seg, at, tree)) in enumerate(ends):
        start = total if first == before else 0
        known.append((part, start, seg if i + 1 < len(ends) and ends[i + 1]["first"] == tree else -1))
        before, total = tree, at + 1 + (start if seg == 0 else 0)
    offsets = F.broadcast(spark.createDataFrame(known, "part int, start bigint, open bigint"))
    pos = F.col("at") + F.when(F.col("seg") == 0, F.col("start")).otherwise(0)
    return placed.join(offsets, "part").withColumns({"pos": pos, "last": F.col("last") & (F.col("seg") != F.col("open"))}).drop("part", "seg", "at", "start", "open")


def chunk_of(base: int, fan: int, levels: int) -> Column:
    """The chunk, in the pass that starts at level ``base``, of a node."""
    return F.expr(f"pos div CAST(pow({fan}, {levels} - (level - {base})) AS BIGINT)")


def _grown(base: int, fan: int, levels: int):
    """All nodes above a chunk's, up to its top."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("pos")
        nodes, first, ends = [d.hex() for d in rows["digest"].to_pylist()], rows["pos"][0].as_py(), rows["last"][-1].as_py()
        tree, whole, out = rows["tree"][0].as_py(), ends and first == 0, []
        if whole and len(nodes) == 1:  # a tree of one leaf
            out.append((tree, 0, nodes[0], True, True, False, base))
        for level in range(base + 1, base + levels + 1):
            if whole and len(nodes) == 1:
                break
            nodes, first = [joined(nodes[i : i + fan]) for i in range(0, len(nodes), fan)], first // fan
            n = len(nodes)
            out += [(tree, first + i, d, ends and i == n - 1, whole and n == 1, not whole and level == base + levels, level) for i, d in enumerate(nodes)]
        cols = list(zip(*out))
        cols[2] = [bytes.fromhex(d) for d in cols[2]]
        kinds = [pa.string(), pa.int64(), pa.binary(), pa.bool_(), pa.bool_(), pa.bool_(), pa.int32()]
        return pa.table([pa.array(c, k) for c, k in zip(cols, kinds)], names=["tree", "pos", "digest", "last", "top", "more", "level"])

    return run


def grow(leaves: DataFrame, store: str, fan: int = FAN, levels: int = LEVELS) -> list[DataFrame]:
    """Write all nodes above the leaves (tree, pos, digest, last) to ``store``; the passes' nodes, read from there."""
    spark, passes, base = leaves.sparkSession, [], 0
    below = leaves.select("tree", "pos", "digest", "last", F.lit(0).alias("level"))
    while True:
        made = below.withColumn("chunk", chunk_of(base, fan, levels)).groupBy("tree", "chunk").applyInArrow(_grown(base, fan, levels), NODE)
        made.write.partitionBy("level").parquet(f"{store}/pass={len(passes)}")
        passes.append(spark.read.schema(NODE).parquet(f"{store}/pass={len(passes)}"))
        base += levels
        below = passes[-1].where("more").select("tree", "pos", "digest", "last", "level")
        if below.isEmpty():
            return passes


def folded(leaf: str, path: str) -> str:
    """The root that a leaf and its siblings (left|right, level by level, comma-joined) give."""
    for level in path.split(",") if path else ():
        left, right = level.split("|")
        leaf = joined([left, leaf, right])
    return leaf


def _paths(base: int, fan: int, levels: int, ids: bool, proofs: bool):
    """Paths of a chunk's lowest nodes, from the path of its top. With ``ids`` those are leaves with their ids and changed
    digests, whose paths are folded."""

    def run(rows: pa.Table) -> pa.Table:
        tops, rows = rows.filter(pc.is_valid(rows["path"])), rows.filter(pc.is_null(rows["path"])).sort_by([("level", "ascending"), ("pos", "ascending")])
        path, sub = tops["path"][0].as_py(), tops["sub"][0].as_py()
        level, digest = rows["level"].to_pylist(), rows["digest"].to_pylist()
        held = {}
        for l, d in zip(level, digest):  # noqa: E741
            held.setdefault(l, []).append(d.hex())
        paths = [path]
        for l in range(max(held), base - 1, -1):  # noqa: E741
            nodes = held[l]
            if len(nodes) == 1 and l == max(held) and tops["level"][0].as_py() == l:
                continue  # the top itself
            above, paths = paths, []
            for i in range(len(nodes)):
                run_at = i - i % fan
                own, up = f"{''.join(nodes[run_at:i])}|{''.join(nodes[i + 1 : run_at + fan])}", above[i // fan]
                paths.append(f"{own},{up}" if up else own)
        low = rows.slice(0, len(held[base]))
        if not ids:
            return pa.table([low["tree"], low["pos"], pa.array(paths, pa.string()), pa.array([sub] * len(paths), pa.string())], names=["tree", "pos", "path", "sub"])
        changed = [d if c is None else c.hex() for d, c in zip(held[base], low["changed"].to_pylist())]
        found = [folded(d, p) for d, p in zip(changed, paths)]
        hashes = [hashlib.sha256(p.replace(",", "").replace("|", "").encode()).hexdigest() for p in paths]
        cols = [low["doc_id"], low["tree"], low["pos"], *(pa.array(c, pa.string()) for c in (held[base], changed, [sub] * len(paths), paths if proofs else [None] * len(paths), hashes, found))]
        return pa.table(cols, names=["doc_id", "tree", "pos", "leaf", "changed", "subroot", "path", "proof_sha256", "folded_root"])

    return run


def descend(leaves: DataFrame, passes: list[DataFrame], tops: DataFrame, ids: bool, proofs: bool = False, fan: int = FAN, levels: int = LEVELS) -> DataFrame:
    """The leaves' paths. ``tops``: (tree, path, sub), the path from each tree's top on; leaves as for ``grow``, with doc_id and
    changed if they have ids."""
    kind = leaves.schema["doc_id"].dataType.simpleString() if ids else ""
    paths = None
    for k in range(len(passes) - 1, -1, -1):
        base = k * levels
        ended = passes[k].where("top").select("tree", "pos", "level").join(tops, "tree").select("tree", F.lit(0).cast("long").alias("chunk"), "level", "path", "sub")
        if paths is not None:  # of this pass' tops that the pass above took on
            ended = ended.unionByName(paths.select("tree", F.col("pos").alias("chunk"), F.lit(base + levels).alias("level"), "path", "sub"))
        nodes = passes[k].where(F.col("level").between(base + 1, base + levels - 1)).select("tree", "level", "pos", "digest")
        low = leaves.withColumn("level", F.lit(0)) if k == 0 else passes[k - 1].where("more").select("tree", "level", "pos", "digest")
        every = low.drop("last").unionByName(nodes, allowMissingColumns=True).withColumn("chunk", chunk_of(base, fan, levels)).unionByName(ended, allowMissingColumns=True)
        last = ids and k == 0
        schema = f"doc_id {kind}, tree string, pos bigint, leaf string, changed string, subroot string, path string, proof_sha256 string, folded_root string" if last else "tree string, pos bigint, path string, sub string"
        paths = every.groupBy("tree", "chunk").applyInArrow(_paths(base, fan, levels, last, proofs), schema)
    return paths


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, changed: Column | None = None, proofs: bool = True, store: str | None = None, fan: int = FAN, levels: int = LEVELS) -> DataFrame:
    """Per row of docs (doc_id, source and the other ``fields``): doc_id, tree, pos, leaf, changed, subroot, root, path (siblings
    left|right, level by level; null without ``proofs``), proof_sha256, folded_root, verified.

    ``changed``: the digest of a row as it is found today (null: as it was); folded_root is what that gives with the original's
    siblings. The node store is kept if ``store`` names its folder."""
    spark = docs.sparkSession
    kept, store = store is not None, store or shared_dir(spark, "merkle")
    own = docs.select("doc_id", tree_of(F.col("source")).alias("tree"), digest_of(*[F.col(f) for f in fields]).alias("digest"), (F.lit(None) if changed is None else changed).cast("binary").alias("changed"))
    leaves = cut(numbered(cut(own.select("tree", "doc_id", "digest", "changed")), "doc_id", "digest"))
    passes = grow(leaves, f"{store}/sources", fan, levels)
    subroots = passes[0].where("top")
    for p in passes[1:]:
        subroots = subroots.unionByName(p.where("top"))
    order = cut(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("source"), "digest"))
    roots = cut(numbered(order, "source"))
    upper = grow(roots, f"{store}/root", fan, levels)
    root = next((r.digest.hex() for p in upper for r in p.where("top").select("digest").collect()), None)  # one digest
    above = spark.createDataFrame([("", "", None)], "tree string, path string, sub string")
    at = descend(roots.drop("source"), upper, above, False, False, fan, levels)
    named = roots.select("pos", "source", F.lower(F.hex("digest")).alias("sub")).join(at.select("pos", "path"), "pos")
    tops = cut(named.select(F.col("source").alias("tree"), "path", "sub"))
    out = descend(leaves, passes, tops, True, proofs, fan, levels)
    out = out.select("doc_id", "tree", "pos", "leaf", "changed", "subroot", F.lit(root).cast("string").alias("root"), "path", "proof_sha256", "folded_root", (F.col("folded_root") == root if root else F.lit(None).cast("boolean")).alias("verified"))
    if kept:
        return out
    out = cut(out)
    delete(spark, store)
    return out


def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of even checksum have lost the line breaks of their texts since the manifest was made."""
    docs = table(spark, sf_dir, "documents")
    cleaned = digest_of(*[F.replace(F.col(f), F.lit("\n"), F.lit("")) if f == "text" else F.col(f) for f in FIELDS])
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, cleaned)
    return manifest(docs, changed=tampered, proofs=False).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


#: crc32 isn't there in this SQL: it is folded over the id's digits, by a table of its 256 steps. A level is a grouping by runs of three.
OP11_SQL = """
WITH RECURSIVE steps AS MATERIALIZED (SELECT list(list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END) ORDER BY n) AS t FROM range(256) r(n)),
d AS MATERIALIZED (SELECT *, coalesce('1' || source, '0') AS tree, hex(encode(doc_id::VARCHAR)) AS x, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos,
  concat(strlen(doc_id::VARCHAR), ':', doc_id, coalesce(strlen(source) || ':' || source, '-'), coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-')) AS head FROM documents),
l AS MATERIALIZED (SELECT doc_id, tree, pos, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
  CASE WHEN xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, len(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % 2 = 0
    THEN sha256(head || coalesce(strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-')) END AS changed FROM d, steps),
nodes AS (SELECT tree, 0 AS lv, pos, leaf AS h, count(*) OVER (PARTITION BY tree) AS n FROM l
  UNION ALL SELECT tree, lv + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (max(n) + 2) // 3 FROM nodes WHERE n > 1 GROUP BY tree, lv, pos // 3),
subs AS MATERIALIZED (SELECT tree, h, row_number() OVER (ORDER BY encode(tree)) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1),
uppers AS (SELECT 0 AS lv, pos, h, n FROM subs UNION ALL SELECT lv + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (max(n) + 2) // 3 FROM uppers WHERE n > 1 GROUP BY lv, pos // 3),
every AS MATERIALIZED (SELECT tree, lv, pos, h, n FROM nodes UNION ALL SELECT '' AS tree, lv, pos, h, n FROM uppers),
runs AS MATERIALIZED (SELECT tree, lv, pos, n, list(h ORDER BY pos) OVER (PARTITION BY tree, lv, pos // 3 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS run FROM every),
climb AS (SELECT doc_id, tree AS own, tree, 0 AS lv, pos, coalesce(changed, leaf) AS h, '' AS proof FROM l
  UNION ALL SELECT c.doc_id, c.own, CASE WHEN r.n = 1 THEN '' ELSE c.tree END, CASE WHEN r.n = 1 THEN 0 ELSE c.lv + 1 END, CASE WHEN r.n = 1 THEN s.pos ELSE c.pos // 3 END,
    CASE WHEN r.n = 1 THEN c.h ELSE sha256(array_to_string(run[1:c.pos % 3], '') || c.h || array_to_string(run[c.pos % 3 + 2:], '')) END,
    CASE WHEN r.n = 1 THEN proof ELSE proof || array_to_string(run[1:c.pos % 3], '') || array_to_string(run[c.pos % 3 + 2:], '') END
  FROM climb c JOIN runs r ON r.tree = c.tree AND r.lv = c.lv AND r.pos = c.pos LEFT JOIN subs s ON s.tree = c.own WHERE NOT (r.n = 1 AND c.tree = ''))
SELECT c.doc_id, leaf, s.h AS subroot, u.h AS root, sha256(proof) AS proof_sha256, c.h AS folded_root, c.h = u.h AS verified
FROM climb c JOIN l USING (doc_id) JOIN subs s ON s.tree = c.own JOIN uppers u ON u.n = 1 AND c.tree = '' AND c.lv = u.lv
"""
