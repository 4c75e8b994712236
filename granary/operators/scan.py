"""Folds over ordered rows of a key, in two passes over ranges of them, so that one key's rows can lie in many tasks.

The rows are dealt out once, in ranges by key and order, and kept there (a checkpoint). The first pass sums each range up: what its
last key's rows do to whatever state they are met with. These summaries are one a range; put behind one another they give the state
that each range begins with, and the second pass folds the rows from there. Nothing depends on where the ranges are cut."""

from __future__ import annotations

import pickle
import uuid
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.sources.shared import cut_packed


class Scan:
    """A fold. ``inputs``: columns it sees; ``fields``: columns it adds, as DDL. Summaries are functions on states, as data."""

    inputs: tuple[str, ...] = ()
    fields: str = ""

    def initial(self) -> Any:
        """The state before a key's first row."""
        raise NotImplementedError

    def step(self, state: Any, row: tuple) -> tuple[Any, tuple]:
        """(state after a row, the row's new fields)."""
        raise NotImplementedError

    def unchanged(self) -> Any:
        """The summary of no rows."""
        raise NotImplementedError

    def add(self, summary: Any, row: tuple) -> Any:
        """The summary of the rows so far and one more."""
        raise NotImplementedError

    def after(self, summary: Any, state: Any) -> Any:
        """The state after summed-up rows that were met with ``state``."""
        raise NotImplementedError


def _rows(batch: pa.RecordBatch):
    """(key, inputs) of each row; the key is the first column."""
    cols = [c.to_pylist() for c in batch.columns]
    return zip(cols[0], zip(*cols[1:])) if len(cols) > 1 else ((k, ()) for k in cols[0])


def _summaries(how: Scan):
    def run(batches):
        part, first, key, summary, seen, single = None, None, None, None, False, True
        for b in batches:
            for k, row in _rows(b):
                at, row = row[0], row[1:]
                if not seen:
                    part, first, key, summary, seen = at, k, k, how.unchanged(), True
                elif k != key:
                    key, summary, single = k, how.unchanged(), False
                summary = how.add(summary, row)
        if seen:
            names = ["part", "first", "last", "single", "summary"]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((part, pickle.dumps(first), pickle.dumps(key), single, pickle.dumps(summary)), (pa.int32(), pa.binary(), pa.binary(), pa.bool_(), pa.binary()))], names=names)

    return run


def _applied(how: Scan, shared, n_inputs: int, kinds: list, names: list[str]):
    """Columns come as key, part, inputs, then all columns of the input."""

    def run(batches):
        starts, state, key, seen = shared.value, None, None, False
        for b in batches:
            head, out = pa.RecordBatch.from_arrays(b.columns[: 2 + n_inputs], names=[str(i) for i in range(2 + n_inputs)]), []
            for k, row in _rows(head):
                if not seen:
                    state, key, seen = pickle.loads(starts[row[0]]), k, True
                elif k != key:
                    state, key = how.initial(), k
                state, new = how.step(state, row[1:])
                out.append(new)
            cols = list(zip(*out)) if out else [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([*b.columns[2 + n_inputs :], *(pa.array(c, t) for c, t in zip(cols, kinds))], names=names)

    return run


def scan(rows: DataFrame, key: str, order: list[str], how: Scan, parts: int | None = None) -> DataFrame:
    """Rows with the fold's fields; a key's rows are taken in ``order``, which must tell them apart. parts: ranges (as many as
    shuffle partitions)."""
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType

    spark, part = rows.sparkSession, f"_part_{uuid.uuid4().hex}"
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = cut_packed(rows.repartitionByRange(parts, key, *order).sortWithinPartitions(key, *order).withColumn(part, F.spark_partition_id()))
    light = placed.select(F.col(key).alias("k"), F.col(part).alias("p"), *[F.col(c).alias(f"i{i}") for i, c in enumerate(how.inputs)])
    found = light.mapInArrow(_summaries(how), "part int, first binary, last binary, single boolean, summary binary").orderBy("part").collect()  # one a range
    starts, state, before = {}, None, None
    for r in found:
        first, last, summary = (pickle.loads(x) for x in (r.first, r.last, r.summary))
        begin = state if before is not None and before[0] == first else how.initial()
        starts[r.part] = pickle.dumps(begin)
        state, before = how.after(summary, begin if r.single else how.initial()), (last,)
    shared = spark.sparkContext.broadcast(starts)
    new = StructType.fromDDL(how.fields)
    every = placed.select(F.col(key).alias("k"), F.col(part).alias("p"), *[F.col(c).alias(f"i{i}") for i, c in enumerate(how.inputs)], *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rows.columns)])
    names = [*(f"c{i}" for i in range(len(rows.columns))), *new.names]
    schema = ", ".join([*(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(rows.schema)), *(f"{f.name} {f.dataType.simpleString()}" for f in new)])
    out = every.mapInArrow(_applied(how, shared, len(how.inputs), [to_arrow_type(f.dataType) for f in new], names), schema)
    fresh = set(new.names)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(rows.columns) if c not in fresh], *new.names)
