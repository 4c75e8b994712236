"""Model providers: recorded replies, functions loaded once a task, and stand-ins without a model.

The stand-ins (hashed word counts, word overlap) exercise the dataflow; their scores say nothing about a real model's quality."""

from __future__ import annotations

import time

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.text import words

#: Fixed value: what stands before a question (passages have no prefix).
QUERY_PREFIX = "Represent this sentence for searching relevant passages: "
USAGE = "struct<input_tokens:bigint,output_tokens:bigint,cache_read_input_tokens:bigint,cache_creation_input_tokens:bigint>"
CALL = f"struct<value:string,error:string,latency_s:double,usage:{USAGE}>"


def usage(reply: Column) -> Column:
    """Token counters of a reply struct; the two cache counters are 0 where they are unknown."""
    zero = F.lit(0).cast("long")
    return F.struct(reply["input_tokens"].cast("long").alias("input_tokens"), reply["output_tokens"].cast("long").alias("output_tokens"), F.coalesce(reply["cache_read_input_tokens"].cast("long"), zero).alias("cache_read_input_tokens"), F.coalesce(reply["cache_creation_input_tokens"].cast("long"), zero).alias("cache_creation_input_tokens"))


class Replay:
    """Recorded replies (key, value and, if known, error, latency_s, usage), joined by key; a missing one is an error."""

    def __init__(self, recorded: DataFrame, key: str = "query_id"):
        self.recorded, self.key = recorded, key

    def __call__(self, rows: DataFrame, prompt: str, out: str) -> DataFrame:
        have = set(self.recorded.columns)
        field = lambda c, kind: (F.col(c) if c in have else F.lit(None)).cast(kind).alias(c)
        given = self.recorded.select(self.key, F.struct(field("value", "string"), field("error", "string"), field("latency_s", "double"), field("usage", USAGE)).alias(out))
        missing = F.struct(F.lit(None).cast("string"), F.lit("no recorded reply"), F.lit(None).cast("double"), F.lit(None).cast(USAGE)).cast(CALL)
        return rows.join(given, self.key, "left").withColumn(out, F.coalesce(F.col(out), missing))


class Model:
    """``factory()`` is called once a task and returns a function from a prompt to (text, usage dict); a failing call makes an
    error of that row alone. The seconds of each call are kept, to three decimals."""

    def __init__(self, factory):
        self.factory = factory

    def __call__(self, rows: DataFrame, prompt: str, out: str) -> DataFrame:
        factory, fields = self.factory, [x.split(":")[0] for x in USAGE[7:-1].split(",")]
        kind = pa.struct([("value", pa.string()), ("error", pa.string()), ("latency_s", pa.float64()), ("usage", pa.struct([(f, pa.int64()) for f in fields]))])
        at = rows.columns.index(prompt)

        def run(batches):
            call = None
            for b in batches:
                call = call or factory()
                got = []
                for p in b[at].to_pylist():
                    began = time.monotonic()
                    try:
                        text, used = call(p)
                        got.append({"value": text, "error": None, "usage": {f: (used or {}).get(f, 0 if f.startswith("cache") else None) for f in fields}})
                    except Exception as e:  # one question's failure must not end the others
                        got.append({"value": None, "error": f"{type(e).__name__}: {e}", "usage": None})
                    got[-1]["latency_s"] = round(time.monotonic() - began, 3)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, kind)], names=[*b.schema.names, out])

        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
        return rows.mapInArrow(run, f"{kinds}, `{out}` {CALL}")


def hashed_counts(text: Column, dimension: int = 64) -> Column:
    """Stand-in embedding: lower-case words counted at the place that their MD5 names; one word at least weighs place 0."""
    places = F.transform(words(F.lower(text)), lambda w: (F.conv(F.substring(F.md5(w.cast("binary")), 1, 8), 16, 10).cast("long") % dimension).cast("int"))
    held = lambda p: F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), lambda i: F.size(F.filter(p, lambda x: x == i)).cast("double"))
    return F.get(F.transform(F.array(places), held), 0)


def normalized(vector: Column) -> Column:
    """The vector at length 1 (unchanged when it is zero)."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    unit = lambda n: F.transform(vector, lambda x: F.when(n > 0, x / n).otherwise(x.cast("double")))
    return F.get(F.transform(F.array(norm), unit), 0)


def embed_passages(rows: DataFrame, text: str = "text", out: str = "embedding", factory=None, batch: int = 32) -> DataFrame:
    """Rows with vectors of length 1 of their texts. ``factory()`` is called once a task and returns a function from a list of
    texts to vectors; without one the stand-in is used."""
    if factory is None:
        return rows.withColumn(out, normalized(hashed_counts(F.col(text))))
    at = rows.columns.index(text)

    def run(batches):
        model = None
        for b in batches:
            model = model or factory()
            texts = [t or "" for t in b[at].to_pylist()]
            got = [[float(x) for x in v] for i in range(0, len(texts), batch) for v in model(texts[i : i + batch])]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.list_(pa.float64()))], names=[*b.schema.names, "_raw"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{kinds}, _raw array<double>").withColumn(out, normalized(F.col("_raw"))).drop("_raw")


def embed_queries(rows: DataFrame, question: str = "question", out: str = "embedding", factory=None) -> DataFrame:
    """As embed_passages, with the prefix before each question (the stand-in counts the question's own words alone)."""
    if factory is None:
        return embed_passages(rows, question, out)
    asked = rows.withColumn("_asked", F.concat(F.lit(QUERY_PREFIX), F.col(question)))
    return embed_passages(asked, "_asked", out, factory).drop("_asked")


def dimension_of(factory) -> int:
    """Components of a model's vectors."""
    return len(factory()(["x"])[0])


def score_pairs(rows: DataFrame, factory, question: str = "question", text: str = "text", out: str = "score") -> DataFrame:
    """Rows with a cross-encoder's score: ``factory()`` is called once a task and returns a function from a list of
    (question, text) pairs to scores."""
    a, b_ = rows.columns.index(question), rows.columns.index(text)

    def run(batches):
        model = None
        for b in batches:
            model = model or factory()
            got = [float(x) for x in model(list(zip(b[a].to_pylist(), b[b_].to_pylist())))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.float64())], names=[*b.schema.names, out])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{kinds}, `{out}` double")
