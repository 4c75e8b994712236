"""Helpers shared by the training-data operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.sources.shared import new_folder, shared_root

#: Lower-cases A-Z, keeps 0-9, a-z and every non-ASCII byte, makes the rest spaces.
WORD_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def item_words(text: str | None) -> list[bytes]:
    """Lower-cased words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` as UTF-8; null has none."""
    return [] if text is None else text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()


def rolling(ids: np.ndarray, width: int, base: int) -> np.ndarray:
    """Polynomial hash (mod 2**64) of every run of ``width`` consecutive ids, by doubling runs."""
    n = len(ids) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    up = lambda k: np.uint64(pow(base, k, 1 << 64))
    run, span, out, have = ids.astype(np.uint64), 1, None, 0
    while True:
        if width & span:
            if out is None:
                out, have = run, span
            else:
                m = min(len(out), len(run) - have)
                out, have = out[:m] * up(span) + run[have : have + m], have + span
        if span * 2 > width:
            return out[:n]
        run, span = run[:-span] * up(span) + run[span:], span * 2


SPACE_BYTES = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


class WordCodes:
    """64-bit hashes of a text's words (runs of bytes that are no ASCII blank), for each of some odd bases: a word's bytes as a
    polynomial of the base, from sums over all bytes at once, then mixed. Texts are read in pieces of about ``piece`` bytes."""

    def __init__(self, *bases: int, piece: int = 1 << 20):
        self.bases, self.piece, self.tables = bases, piece, []
        self._grow(1 << 14)

    def _grow(self, n: int) -> None:
        one = np.ones(1, np.uint64)
        power = lambda b: np.cumprod(np.concatenate([one, np.full(n, b, np.uint64)]))
        self.tables = [(power(b), power(pow(b, -1, 1 << 64))) for b in self.bases]

    def _pieces(self, data: bytes):
        """The text cut at blanks."""
        at = 0
        while len(data) - at > self.piece:
            size, blanks = self.piece, ()
            while not len(blanks) and at + size < len(data):
                blanks = np.flatnonzero(SPACE_BYTES[np.frombuffer(data, np.uint8, min(size, len(data) - at), at)])
                size *= 2
            end = at + int(blanks[-1]) + 1 if len(blanks) else len(data)
            yield np.frombuffer(data, np.uint8, end - at, at)
            at = end
        yield np.frombuffer(data, np.uint8, len(data) - at, at)

    def __call__(self, data: bytes) -> list[np.ndarray]:
        found = [self._codes(x) for x in self._pieces(data)]
        return found[0] if len(found) == 1 else [np.concatenate(c) for c in zip(*found)]

    def _codes(self, x: np.ndarray) -> list[np.ndarray]:
        edge = np.flatnonzero(np.diff(SPACE_BYTES[x], prepend=True, append=True))
        starts, ends = edge[::2], edge[1::2]
        if len(x) > len(self.tables[0][0]):
            self._grow(max(len(x), 2 * len(self.tables[0][0])))
        value, out = x.astype(np.uint64) + np.uint64(1), []
        for power, inverse in self.tables:
            total = np.zeros(len(x) + 1, np.uint64)
            np.cumsum(value * power[: len(x)], out=total[1:])
            h = (total[ends] - total[starts]) * inverse[starts]
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            out.append(h ^ (h >> np.uint64(32)))
        return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below the one all executors share (spark.checkpoint.dir); a cluster without one raises."""
    return new_folder(spark, name)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with an eager checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_root(df.sparkSession))
    return df.checkpoint(eager=True)


def spread_join(left: DataFrame, right: DataFrame, key: str, by: str, how: str = "left", salts: int = 8) -> DataFrame:
    """left joined with right on key, where one key may have a large share of left's rows: they are dealt over ``salts``
    tasks by a hash of ``by``, and right's rows (few a key) are there once for each."""
    if salts == 1:
        return left.join(right, key, how)
    a = left.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(salts)))
    b = right.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return a.join(b, [key, "_salt"], how).drop("_salt")


def appended(docs: DataFrame, run, added: str) -> DataFrame:
    """docs through ``run`` (an Arrow map that sees columns c0, c1, ... and appends those of ``added``). An input column of
    an added name gives way to the new one; all other columns stay as they are."""
    names, new = docs.columns, [x.split(" ") for x in added.split(", ")]
    kinds = [f.dataType.simpleString() for f in docs.schema] + [k for _, k in new]
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    out = plain.mapInArrow(run, ", ".join(f"c{i} {k}" for i, k in enumerate(kinds)))
    fresh = [n for n, _ in new]
    kept = [F.col(f"c{i}").alias(n) for i, n in enumerate(names) if n not in fresh]
    return out.select(*kept, *[F.col(f"c{len(names) + i}").alias(n) for i, n in enumerate(fresh)])


def in_fold(doc_id: str, folds: int, fold: int):
    """Whether crc32 of the id as text falls in a fold; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))


def batch_of(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, schema)], schema=schema)


def training_rows(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, most: int) -> DataFrame:
    """At most ``most`` labelled documents (doc_id, text, y, place) outside the held-out fold.

    The labels are chosen by the order of a hash of the id, which is their place from 0, so the same ones at every run. A null
    label or id is left out; an id labelled twice takes the larger label; of rows that repeat an id, the text of the smallest
    hash counts. The chosen ids are at most ``most``, so they are broadcast.
    """
    known = (
        labels.select(F.col("doc_id"), F.col(label).alias("y"))
        .where(F.col("y").isNotNull() & F.col("doc_id").isNotNull() & ~in_fold("doc_id", folds, held))
        .groupBy("doc_id")
        .agg(F.max("y").alias("y"))
    )
    first = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    chosen = first.withColumn("place", F.row_number().over(Window.orderBy(F.xxhash64("doc_id"), "doc_id")).cast("long") - 1)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    one = F.min(F.struct(F.xxhash64("text").alias("h"), "text"))["text"]
    return rows.groupBy("doc_id").agg(one.alias("text"), F.max("y").alias("y"), F.max("place").alias("place"))
