"""Mixing sources to target weights by Pfair scheduling.

The k-th block of a source of weight w is released at slot floor(k / w) and due by slot ceil((k + 1) / w). Earliest
deadline first among released blocks keeps every source within one block of its target share after each slot. Weights are
exact fractions: numbers as they are written in decimals (0.1 is a tenth), and nothing is rounded to a period. When the
whole numbers they stand for sum to fewer slots than the rows need, that one period is computed and block j of a source
with q slots a period goes to slot (j div q) * period + its (j mod q)-th slot. Else the slots are computed up to the
last block. One task computes them as a stream (its memory is an entry a source) into the shared folder.

Rows of a source are ordered by a hash of doc_id (ties: doc_id, then the other columns) and cut into blocks. They are
numbered in buckets of hash prefixes, whose sizes are summed in two levels, so a source that holds a third of all rows is
spread over many tasks. Every row is kept: where a source has run out, its later slots stay empty and the others go on in
their order. A null source is a source of its own (named null); rows with a null doc_id are ordered by their other columns; rows
with equal doc_id get different numbers; an empty table gives an empty result. There may be any number of sources; the driver
and one task hold an entry each.
"""

from __future__ import annotations

import heapq
import itertools
import math
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from granary.llm.common import cut, shared_dir, table

BLOCK, BUCKET_ROWS, SUPER, BATCH = 64, 1000, 1024, 10_000


def whole(shares: dict) -> dict:
    """The smallest whole numbers in the shares' exact proportions."""
    exact = {s: Fraction(str(x)) if isinstance(x, float) else Fraction(x) for s, x in shares.items()}
    common = math.lcm(*(x.denominator for x in exact.values()))
    out = {s: int(x * common) for s, x in exact.items()}
    least = math.gcd(*out.values())
    return {s: x // least for s, x in out.items()}


def pfair(slots: dict):
    """(source, k) of each slot in turn, without end; slots are whole numbers of slots a period."""
    period, due, waiting = sum(slots.values()), [], []
    name = dict(enumerate(sorted(slots, key=lambda s: (s is not None, str(s)))))
    for i in name:
        heapq.heappush(waiting, (0, i, 0))
    for t in itertools.count():
        while waiting and waiting[0][0] <= t:
            _, i, k = heapq.heappop(waiting)
            heapq.heappush(due, (-(-(k + 1) * period // slots[name[i]]), i, k))
        _, i, k = heapq.heappop(due)
        yield name[i], k
        heapq.heappush(waiting, ((k + 1) * period // slots[name[i]], i, k + 1))


def planned(spark, slots: dict, blocks: dict, kind) -> tuple[DataFrame, dict, int]:
    """Rows (s, _k, t): the _k-th of a source's blocks in a period is at slot t; its blocks a period; and the period.

    Without a period short enough, a source's period has all its blocks and is never passed."""
    period = sum(slots.values())
    last = max(-(-blocks[s] * period // x) for s, x in slots.items())
    each = slots if period <= last else blocks
    length = min(period, last)
    types = [to_arrow_type(kind), pa.int64(), pa.int64()]

    def run(batches):
        for _ in batches:
            turns = ((s, k, t) for t, (s, k) in enumerate(itertools.islice(pfair(slots), length)) if k < min(each[s], blocks[s]))
            while part := list(itertools.islice(turns, BATCH)):
                yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(zip(*part), types)], names=["s", "_k", "t"])

    path = shared_dir(spark, "mixing")
    spark.range(0, 1, 1, 1).mapInArrow(run, schema := f"s {kind.simpleString()}, _k long, t long").write.parquet(path)
    return spark.read.schema(schema).parquet(path), each, length


def _before(sizes: DataFrame) -> DataFrame:
    """(_s, _b, first): the rows of a source in the buckets before; sums of SUPER buckets first, then within them, so that no
    task orders all buckets of a source."""
    named = sizes.select(F.col("source").alias("_s"), F.col("b").alias("_b"), "n", F.floor(F.col("b") / SUPER).alias("_o"))
    run = lambda *keys: (lambda by: F.sum("n").over(Window.partitionBy(*keys).orderBy(by)) - F.col("n"))
    outer = named.groupBy("_s", "_o").agg(F.sum("n").alias("n")).select(F.col("_s").alias("_s2"), F.col("_o").alias("_o2"), run("_s")("_o").alias("base"))
    inner = named.withColumn("within", run("_s", "_o")("_b"))
    joined = inner.join(outer, inner._s.eqNullSafe(outer._s2) & (inner._o == outer._o2))
    return joined.select("_s", "_b", (F.col("base") + F.col("within")).alias("first"))


def mix(docs: DataFrame, weights: dict | None = None, block: int = BLOCK, keep: bool = False, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Per row: doc_id, source, source_row, block, slot, position (slot * block + place in block: the mixed order). keep: all
    columns of docs before these four, which replace input columns of their names.

    weights: target shares by source. None takes the square root of each source's rows, so that no source rules."""
    spark, added = docs.sparkSession, ["source_row", "block", "slot", "position"]
    fields = [c for c in docs.columns if c not in added] if keep else ["doc_id", "source"]
    total = docs.count()
    if not total:
        return docs.select(*[F.col(f"`{c}`") for c in fields], *[F.lit(0).cast("long").alias(c) for c in added])
    bits = max(0, (total // bucket_rows).bit_length())
    seen = F.xxhash64("doc_id")
    if not docs.where("doc_id IS NULL").select("doc_id").isEmpty():
        # Rows without an id must not all fall in one bucket: there the other columns decide.
        others = [F.col(f"`{f.name}`") for f in docs.schema if f.name != "doc_id" and "map<" not in f.dataType.simpleString()]
        seen = F.when(F.col("doc_id").isNull(), F.xxhash64(*others)).otherwise(seen)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in fields]).alias("r"), "source", seen.alias("h"))
    rows = rows.withColumn("b", F.shiftrightunsigned("h", 64 - bits) if bits else F.lit(0).cast("long"))
    sizes = cut(rows.groupBy("source", "b").agg(F.count("*").alias("n")))
    counts = {r.source: r.n for r in sizes.groupBy("source").agg(F.sum("n").alias("n")).collect()}  # an entry a source
    shares = {s: (weights or {}).get(s, 0) if weights else n**0.5 for s, n in counts.items()}
    if bad := [s for s, x in shares.items() if x <= 0]:
        raise ValueError(f"no positive weight for sources {bad[:5]}")
    kind = docs.schema["source"].dataType
    plan, each, length = planned(spark, whole(shares), {s: -(-n // block) for s, n in counts.items()}, kind)
    # Hashes in unsigned order, as their prefixes.
    ties = [F.col("r")[c].asc() for c in ["doc_id", *(c for c in fields if c != "doc_id" and "map<" not in docs.schema[c].dataType.simpleString())]]
    order = [F.col("h").bitwiseXOR(F.lit(-(1 << 63))).asc(), *ties]
    before = _before(sizes)
    own = rows.withColumn("place", F.row_number().over(Window.partitionBy("source", "b").orderBy(*order)))
    own = own.join(before, own.source.eqNullSafe(before._s) & (own.b == before._b)).withColumn("source_row", F.col("first") + F.col("place") - 1)
    own = own.withColumn("block", F.floor(F.col("source_row") / block))
    per = spark.createDataFrame([(s, min(q, (1 << 63) - 1)) for s, q in each.items()], f"s {kind.simpleString()}, q long")
    own = own.join(F.broadcast(per) if len(each) <= 100_000 else per, own.source.eqNullSafe(per.s)).drop("s")
    own = own.withColumn("k", F.col("block") % F.col("q"))
    out = own.join(plan, own.source.eqNullSafe(F.col("s")) & (own.k == F.col("_k")))
    slot = F.floor(F.col("block") / F.col("q")) * length + F.col("t")
    return out.select(*[F.col("r")[c].alias(c) for c in fields], "source_row", "block", slot.alias("slot"), (slot * block + F.col("source_row") % block).alias("position"))


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))
