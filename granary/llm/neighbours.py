"""Approximate nearest neighbours: a robust-pruned directed graph per shard, searched by beams.

Equal vectors are one node that keeps its smallest ids (as many as a result can hold), so a vector of any frequency
costs one node and ties go to smaller ids. Nodes are dealt to shards of about SHARD by a hash, a shard to each partition. Within a
shard a random graph is improved in rounds: greedy searches from the medoid propose neighbours, and relaxed distance pruning
(a candidate goes when a kept one is nearer to it by the factor ALPHA than the node is) keeps at most DEGREE diverse
edges; reverse edges join and are pruned again. The stated queries travel to the shards, in groups of at most QUERY_BYTES that
are sent out once each, while the index stays where it is; a query's beam search of every shard gives its best nodes, whose
distances are exact, and the shards' bests are merged. The index holds every valid row; recall is measured in the tests.

Vectors that are null, zero, or hold null or non-finite components take no part, as queries too. Vectors of different lengths
are never compared: each length has shards of its own. Rows that repeat an id with other vectors are one candidate, at the
least of their distances; as a query, the smallest of their vectors asks. No rows, or no queries, give an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.llm.common import cut, table

SHARD, DEGREE, BEAM, ALPHA, ROUNDS, QUERY_BLOCK, QUERY_BYTES = 4000, 24, 64, 1.2, 2, 256, 64 << 20


def distances(x: np.ndarray, of: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Squared distances from rows ``of`` (B,) vectors (B, d) to nodes ``to`` (B, R)."""
    near = x[to]
    return np.einsum("brd,brd->br", near - of[:, None, :], near - of[:, None, :])


def beam_search(x: np.ndarray, graph: np.ndarray, start: int, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """The beam's nodes and squared distances for each query, nearest first; all queries go step by step together."""
    n, b = len(x), len(queries)
    size = min(beam, n)
    nodes = np.full((b, size), -1)
    dist = np.full((b, size), np.inf)
    done = np.ones((b, size), bool)
    nodes[:, 0], done[:, 0] = start, False
    dist[:, 0] = np.einsum("bd,bd->b", queries - x[start], queries - x[start])
    seen = np.zeros((b, n), bool)
    seen[:, start] = True
    alive = np.arange(b)
    while len(alive):
        at = np.argmin(done[alive], 1)  # the nearest node that hasn't been expanded
        done[alive, at] = True
        out = graph[nodes[alive, at]]
        new = (out >= 0) & ~seen[alive[:, None], out]
        seen[alive[:, None], np.where(out >= 0, out, start)] = True
        d = np.where(new, distances(x, queries[alive], np.maximum(out, 0)), np.inf)
        every = np.concatenate([dist[alive], d], 1)
        best = np.argsort(every, 1, kind="stable")[:, :size]
        rows = np.arange(len(alive))[:, None]
        dist[alive] = every[rows, best]
        nodes[alive] = np.concatenate([nodes[alive], out], 1)[rows, best]
        done[alive] = np.concatenate([done[alive], ~new], 1)[rows, best] | np.isinf(dist[alive])
        alive = alive[~done[alive].all(1)]
    return nodes, dist


def robust_prune(x: np.ndarray, own: np.ndarray, found: np.ndarray) -> np.ndarray:
    """At most DEGREE diverse neighbours (B, DEGREE; -1 fills) out of candidates (B, C; -1 fills)."""
    found = np.sort(found, 1)
    bad = (found < 0) | (found == own[:, None])
    bad[:, 1:] |= found[:, 1:] == found[:, :-1]
    d = np.where(bad, np.inf, distances(x, x[own], np.maximum(found, 0)))
    order = np.argsort(d, 1, kind="stable")
    rows = np.arange(len(own))
    found, d = found[rows[:, None], order], d[rows[:, None], order]
    near = x[np.maximum(found, 0)]
    square = np.einsum("bcd,bcd->bc", near, near)
    # All distances among a node's candidates at once; each pick below only looks them up.
    among = square[:, :, None] + square[:, None, :] - 2 * (near @ near.transpose(0, 2, 1))
    out = np.full((len(own), DEGREE), -1)
    for k in range(DEGREE):
        at = np.argmax(np.isfinite(d), 1)
        live = np.isfinite(d[rows, at])
        if not live.any():
            break
        out[live, k] = found[rows, at][live]
        d = np.where(ALPHA * ALPHA * among[rows, at] <= d, np.inf, d)
        d[rows, at] = np.inf
    return out


def build(x: np.ndarray, seed: int = 7) -> tuple[np.ndarray, int]:
    """(graph, start) over the vectors of a shard."""
    n = len(x)
    start = int(np.argmin(((x - x.mean(0)) ** 2).sum(1)))
    graph = np.random.default_rng(seed).integers(0, n, (n, DEGREE))
    graph.sort(1)
    graph[:, 1:][graph[:, 1:] == graph[:, :-1]] = -1  # no list repeats a node
    graph[graph == np.arange(n)[:, None]] = -1
    for _ in range(ROUNDS):
        fresh = np.empty_like(graph)
        for lo in range(0, n, 256):
            own = np.arange(lo, min(lo + 256, n))
            near, _ = beam_search(x, graph, start, x[own], BEAM)
            fresh[own] = robust_prune(x, own, np.concatenate([near, graph[own]], 1))
        # Reverse edges, grouped by target; beyond 2 * DEGREE the nearest come first.
        src, dst = np.repeat(np.arange(n), DEGREE), fresh.ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        order = np.lexsort((((x[src] - x[dst]) ** 2).sum(1), dst))
        src, dst = src[order], dst[order]
        place = np.arange(len(dst)) - np.searchsorted(dst, dst)
        back = np.full((n, 2 * DEGREE), -1)
        back[dst[place < 2 * DEGREE], place[place < 2 * DEGREE]] = src[place < 2 * DEGREE]
        graph = np.empty_like(fresh)
        for lo in range(0, n, 256):
            own = np.arange(lo, min(lo + 256, n))
            graph[own] = robust_prune(x, own, np.concatenate([fresh[own], back[own]], 1))
    return graph.astype(np.int32), start


def _index(batches):
    """Rows of one shard after another; a finished shard is one row."""
    at, rows = None, []

    def packed():
        x = np.array([r[1] for r in rows], np.float64)
        graph, start = build(x)
        keep = [np.array(r[2], np.int64) for r in rows]
        sizes = np.array([len(k) for k in keep], np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array([at], pa.int64()), pa.array([len(x)], pa.int64()), pa.array([start], pa.int64()), *[pa.array([a.tobytes()], pa.binary()) for a in (x, graph, sizes, np.concatenate(keep))]],
            names=["shard", "n", "start", "x", "graph", "sizes", "ids"],
        )

    for b in batches:
        for r in zip(*(c.to_pylist() for c in b.columns)):
            if r[0] != at:
                if rows:
                    yield packed()
                at, rows = r[0], []
            rows.append(r)
    if rows:
        yield packed()


def valid(df: DataFrame) -> DataFrame:
    v = F.col("embedding")
    fine = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists(v, lambda x: x != 0)
    return df.select(F.col("vec_id").cast("long").alias("vec_id"), v.cast("array<double>").alias("embedding")).where(F.col("vec_id").isNotNull() & v.isNotNull() & fine)


def build_index(rows: DataFrame, ids: int, shard: int = SHARD) -> DataFrame:
    """One row per shard: vectors, graph, start and the smallest ``ids`` ids of each vector."""
    first = Window.partitionBy("embedding").orderBy("vec_id")
    nodes = rows.groupBy("embedding", "vec_id").agg(F.lit(0)).withColumn("place", F.row_number().over(first)).where(F.col("place") <= ids)
    nodes = cut(nodes.groupBy("embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")))
    sizes = {r.d: r["count"] for r in nodes.groupBy(F.size("embedding").alias("d")).count().orderBy("d").collect()}  # an entry a length
    number, base = F.lit(None).cast("long"), 0
    for d, n in sizes.items():
        own = max(1, -(-n // shard))
        number = F.when(F.size("embedding") == d, F.pmod(F.xxhash64("embedding"), F.lit(own)) + base).otherwise(number)
        base += own
    dealt = nodes.select(number.alias("shard"), "embedding", "ids")
    # By exact numbers: hashing them would put several shards in one task.
    dealt = dealt.repartitionById(max(1, base), F.col("shard").cast("int")).sortWithinPartitions("shard", F.get("ids", 0))
    return cut(dealt.mapInArrow(_index, "shard bigint, n bigint, start bigint, x binary, graph binary, sizes binary, ids binary"))


def _search(shared, k: int, beam: int):
    def run(batches):
        asked = shared.value
        lengths = np.array([len(v) for v in asked[1]])
        for b in batches:
            for r in b.to_pylist():
                x = np.frombuffer(r["x"]).reshape(r["n"], -1)
                graph = np.frombuffer(r["graph"], np.int32).reshape(r["n"], -1)
                sizes, ids = np.frombuffer(r["sizes"], np.int64), np.frombuffer(r["ids"], np.int64)
                starts = np.cumsum(sizes) - sizes
                mine = np.flatnonzero(lengths == x.shape[1])
                for lo in range(0, len(mine), QUERY_BLOCK):
                    at, out = mine[lo : lo + QUERY_BLOCK], []
                    nodes, dist = beam_search(x, graph, r["start"], np.array([asked[1][i] for i in at], np.float64), max(beam, 2 * k))
                    for q, own, d in zip(asked[0][at].tolist(), nodes, dist):
                        got = [(float(np.sqrt(s)), int(i)) for j, s in zip(own[: 2 * k + 2], d) if np.isfinite(s) for i in ids[starts[j] : starts[j] + sizes[j]] if i != q]
                        out += [(q, i, s) for s, i in sorted(got)[:k]]
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "vec_id", "score"])

    return run


def search(queries: DataFrame, index: DataFrame, k: int = 10, beam: int = BEAM) -> DataFrame:
    """(query_id, rank, vec_id, score): the stated queries against every shard, merged. The index must keep k + 1 ids of a vector."""
    schema = "query_id bigint, vec_id bigint, score double"
    one = queries.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    size = one.agg(F.coalesce(F.sum(8 * F.size("embedding") + 16), F.lit(0))).first()[0]
    groups, found = max(1, -(-size // QUERY_BYTES)), None
    for g in range(groups):
        part = (one.where(F.pmod(F.xxhash64("vec_id"), F.lit(groups)) == g) if groups > 1 else one).toArrow()
        asked = (part["vec_id"].to_numpy(), [np.asarray(v.values, np.float64) for v in part["embedding"]])
        got = index.mapInArrow(_search(queries.sparkSession.sparkContext.broadcast(asked), k, beam), schema)
        found = got if found is None else found.unionByName(got)
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    once = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    return once.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_neighbours(spark, sf_dir: str) -> DataFrame:
    rows = valid(table(spark, sf_dir, "embeddings"))
    index = build_index(rows, ids=11)
    return search(rows.where("vec_id % 100 = 0"), index)
