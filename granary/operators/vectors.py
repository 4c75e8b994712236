"""Exact cosine top-k with bounds: blocks that can't hold one of a query's k best are never read.

Rows are put to the nearest of some pivots and, by their angle to it, into rings; a ring of a pivot is a block. A row's angle to a query
is at least the difference of its ring's angles and the query's own angle to the pivot, so each block has a highest possible cosine
for each query. A search first visits each query's most promising blocks, which gives a score that the k-th best reaches at
least; then only blocks that may beat it. Queries travel to the blocks by joins on the block, in slices of at most some thousand
rows, so no query is sent to all rows and no block is one task's."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from granary.operators.retrieval import NEAR, _best, vectors
from granary.sources.shared import cut

#: Rings of a half turn; rows that pivots are chosen from; rows of a slice; promising blocks that are visited first.
RINGS, SAMPLE, SLICE, FIRST = 48, 10_000, 4096, 4


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def choose_pivots(rows: DataFrame, key: str, vector: str, n: int, sample: int = SAMPLE, turns: int = 6) -> np.ndarray:
    """n directions from at most ``sample`` rows, those of the smallest hashes of their keys: means of the nearest ones, some turns
    over. Pivots only decide how much is skipped."""
    few = rows.where(F.size(vector) > 0).orderBy(F.xxhash64(key), key).limit(sample).select(vector).toArrow()
    if not few.num_rows:
        return np.zeros((0, 0))
    lengths = np.asarray(pc.list_value_length(few.column(0).combine_chunks()))
    _, x = vectors(few.column(0).combine_chunks(), int(np.bincount(lengths).argmax()))
    if not len(x):
        return np.zeros((0, 0))
    x = unit(x)
    pivots = [x[0]]
    far = x @ x[0]
    while len(pivots) < min(n, len(x)):  # the farthest row from those chosen
        at = int(far.argmin())
        pivots.append(x[at])
        far = np.maximum(far, x @ x[at])
    pivots = np.array(pivots)
    for _ in range(turns):
        near = (x @ pivots.T).argmax(1)
        sums = np.zeros_like(pivots)
        np.add.at(sums, near, x)
        fine = np.sqrt(np.einsum("ij,ij->i", sums, sums)) > 1e-9
        pivots[fine] = unit(sums[fine])
    return pivots


def _placed(shared):
    """Rows (key, vector) with their pivot, ring and angle; rows that take no part are left out."""

    def run(batches):
        pivots = shared.value
        for b in batches:
            place, x = vectors(b.column(1), pivots.shape[1])
            cosine = np.clip(unit(x) @ pivots.T, -1, 1) if len(x) else np.zeros((0, len(pivots)))
            near = cosine.argmax(1) if len(x) else np.zeros(0, np.int64)
            angle = np.arccos(cosine[np.arange(len(x)), near]) if len(x) else np.zeros(0)
            kept = b.take(pa.array(place))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(near * RINGS + np.minimum((angle * RINGS / np.pi).astype(np.int64), RINGS - 1), pa.int64()), pa.array(angle)], names=["key", "vector", "block", "angle"])

    return run


class VectorIndex:
    """Rows (key, vector, block, slice, angle), saved below ``place`` in folders by pivot; blocks with their ranges of angles, of which
    there are at most pivots times RINGS."""

    def __init__(self, spark: SparkSession, place: str):
        self.spark, self.place = spark, place.rstrip("/")

    def build(self, rows: DataFrame, key: str = "vec_id", vector: str = "embedding", pivots: int = 32, size: int = SLICE) -> VectorIndex:
        chosen = choose_pivots(rows, key, vector, pivots)
        kinds = rows.select(F.col(key).alias("key"), F.col(vector).alias("vector")).schema
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kinds) + ", block bigint, angle double"
        if chosen.size:
            shared = self.spark.sparkContext.broadcast(chosen)
            placed = cut(rows.select(F.col(key).alias("key"), F.col(vector).alias("vector")).mapInArrow(_placed(shared), schema))
        else:
            placed = self.spark.createDataFrame([], schema)
        blocks = placed.groupBy("block").agg(F.count("*").alias("n"), F.min("angle").alias("lo"), F.max("angle").alias("hi"))
        blocks = blocks.withColumn("slices", F.expr(f"(n + {size - 1}) div {size}"))
        blocks.write.mode("overwrite").parquet(f"{self.place}/blocks")
        dealt = placed.drop("angle").join(F.broadcast(blocks.select("block", "slices")), "block").withColumn("slice", F.pmod(F.xxhash64("key"), F.col("slices")))
        out = dealt.withColumn("pivot", F.expr(f"CAST(block div {RINGS} AS INT)")).select("key", "vector", "block", "slice", "pivot")
        out.repartition("block", "slice").sortWithinPartitions("pivot", "block", "slice").write.mode("overwrite").partitionBy("pivot").parquet(f"{self.place}/rows")
        pairs = [(i, [float(v) for v in p]) for i, p in enumerate(chosen)]
        self.spark.createDataFrame(pairs, "pivot int, direction array<double>").coalesce(1).write.mode("overwrite").parquet(f"{self.place}/pivots")
        return self

    def blocks(self) -> DataFrame:
        return self.spark.read.schema("block bigint, n bigint, lo double, hi double, slices bigint").parquet(f"{self.place}/blocks")

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.place}/rows")

    def pivots(self) -> np.ndarray:
        got = self.spark.read.schema("pivot int, direction array<double>").parquet(f"{self.place}/pivots").orderBy("pivot").collect()
        return np.array([r.direction for r in got])

    def topk(self, queries: DataFrame, k: int = 20, query_key: str = "query_id", vector: str = "embedding", skip_self: bool = False, first: int = FIRST) -> tuple[DataFrame, DataFrame]:
        """((query_id, rank, key, score), (query_id, blocks, visited, rows, read)): each query's k rows of highest cosine, ties to the
        smaller key; and how many blocks and rows there are and it visited."""
        pivots, asked = self.pivots(), queries.select(F.col(query_key).alias("query_id"), F.col(vector).cast("array<double>").alias("q"))
        blocks = self.blocks().collect() if pivots.size else []  # at most pivots times RINGS
        bounds = np.array([(b.block, b.lo, b.hi, b.slices, b.n) for b in blocks], np.float64).reshape(-1, 5)
        bounds = bounds[np.lexsort((bounds[:, 0],))]
        kind, key_kind = asked.schema["query_id"].dataType, self.rows().schema["key"].dataType if pivots.size else kind_of(queries, query_key)
        found_schema = f"query_id {kind.simpleString()}, key {key_kind.simpleString()}, score double"
        shared = self.spark.sparkContext.broadcast((pivots, bounds))
        visits = f"query_id {kind.simpleString()}, q array<double>, block bigint, slice bigint, size bigint"
        own = asked.withColumn("least", F.lit(-2.0))
        one = self._visited(own.mapInArrow(_visits(shared, 0, first), visits), k, skip_self, found_schema) if pivots.size else None
        if one is None:
            none = self.spark.createDataFrame([], f"query_id {kind.simpleString()}, rank int, key {key_kind.simpleString()}, score double")
            return none, self.spark.createDataFrame([], f"query_id {kind.simpleString()}, blocks bigint, visited bigint, rows bigint, read bigint")
        got, went = one
        best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "key")
        kth = got.withColumn("r", F.row_number().over(best)).where(F.col("r") == k).select("query_id", F.col("score").alias("least"))
        rest = asked.join(kth, "query_id", "left").withColumn("least", F.coalesce("least", F.lit(-2.0)))
        more, went_on = self._visited(rest.mapInArrow(_visits(shared, first, None), visits), k, skip_self, found_schema)
        every = got.unionByName(more).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        read = went.unionByName(went_on).groupBy("query_id").agg(F.count_distinct("block").alias("visited"), F.sum("size").alias("read"))
        report = read.select("query_id", F.lit(len(blocks)).cast("long").alias("blocks"), "visited", F.lit(int(bounds[:, 4].sum())).cast("long").alias("rows"), "read")
        return every.select("query_id", "rank", "key", "score"), report

    def _visited(self, visits: DataFrame, k: int, skip_self: bool, schema: str) -> tuple[DataFrame, DataFrame]:
        """(best rows of each visit, (query_id, block, size)). Only rows of visited blocks are read and shuffled."""
        visits = cut(visits)
        asked = F.broadcast(visits.select("block").distinct())  # at most pivots times RINGS
        pivots = [r[0] for r in visits.selectExpr(f"CAST(block div {RINGS} AS INT) AS p").distinct().collect()]
        rows = self.rows().where(F.col("pivot").isin(pivots)).join(asked, "block", "left_semi").select("block", "slice", "key", "vector")
        both = rows.groupBy("block", "slice").cogroup(visits.select("block", "slice", "query_id", "q").groupBy("block", "slice"))
        key_kind = to_arrow_type(rows.schema["key"].dataType)
        return cut(both.applyInArrow(_compared(k, skip_self, key_kind), schema)), visits.select("query_id", "block", "size")


def kind_of(df: DataFrame, c: str):
    return df.schema[c].dataType


def _visits(shared, skip: int, most: int | None):
    """Rows (query_id, q, least) to the slices of the blocks that may hold a cosine of ``least`` or more, without the ``skip`` most
    promising blocks, and at most ``most`` of them."""

    def run(batches):
        pivots, bounds = shared.value
        pivot = (bounds[:, 0] // RINGS).astype(np.int64)
        for b in batches:
            place, x = vectors(b.column(1), pivots.shape[1])
            least = np.asarray(b.column(2))[place]
            ids, flat, at = b.column(0), b.column(1), []
            for i, row, low in zip(place, unit(x) if len(x) else x, least):
                angle = np.arccos(np.clip(pivots @ row, -1, 1))[pivot]
                apart = np.maximum(0, np.maximum(bounds[:, 1] - angle, angle - bounds[:, 2]))
                highest = np.cos(np.maximum(0, apart - NEAR))
                order = np.lexsort((bounds[:, 0], -highest))[skip:most]
                for j in order[highest[order] >= low - NEAR]:
                    n, slices = int(bounds[j, 4]), int(bounds[j, 3])
                    at += [(int(i), int(bounds[j, 0]), s, n if s == 0 else 0) for s in range(slices)]
            cols = list(zip(*at)) if at else ([], [], [], [])
            pick = pa.array(cols[0], pa.int64())
            yield pa.RecordBatch.from_arrays([ids.take(pick), flat.take(pick), *(pa.array(c, pa.int64()) for c in cols[1:])], names=["query_id", "q", "block", "slice", "size"])

    return run


def _compared(k: int, skip_self: bool, key_kind: pa.DataType):
    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        parts = []
        if rows.num_rows and asked.num_rows:
            dimension = len(asked["q"][0].as_py())
            _, x = vectors(rows["vector"].combine_chunks(), dimension)
            _, y = vectors(asked["q"].combine_chunks(), dimension)
            ids, q_ids = rows["key"].to_numpy(), asked["query_id"].to_numpy()
            nx, ny = np.sqrt(np.einsum("ij,ij->i", x, x)), np.sqrt(np.einsum("ij,ij->i", y, y))
            for j in range(len(y)):
                score = np.einsum("ij,j->i", x, y[j]) / (nx * ny[j])
                own = np.flatnonzero(ids != q_ids[j]) if skip_self else np.arange(len(ids))
                if len(own) > k:
                    floor = np.partition(score[own], len(own) - k)[len(own) - k]
                    own = own[score[own] >= floor]
                parts.append(_best([(np.full(len(own), j), ids[own], score[own])], k))
        j, ids, score = (np.concatenate(c) for c in zip(*parts)) if parts else ([], [], [])
        pick = pa.array(np.asarray(j, np.int64))
        return pa.table([asked["query_id"].take(pick), pa.array(ids, key_kind), pa.array(score, pa.float64())], names=["query_id", "key", "score"])

    return run
