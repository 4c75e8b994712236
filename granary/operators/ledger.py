"""A ledger of model calls: each prompt is asked once, whatever is run again.

Replies are kept in a folder under a hash of model and prompt. A run asks only for prompts that have no reply there yet, each of
them once, in groups by their hash; a group's replies are written before the next group is asked. What is lost with an executor, or
with a run that ends, is at most what the group at hand had not written. Calls that fail are tried again with growing pauses, and
are kept as failed ones: the run gives its rows their error, a later run asks them again."""

from __future__ import annotations

import random
import time
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.operators.providers import CALL, USAGE
from granary.sources.shared import cut, delete

ENTRY = f"key string, value string, error string, latency_s double, usage {USAGE}, tries int, at timestamp"


def call_key(model: str, prompt: Column) -> Column:
    """The model's name and the prompt, so told apart that no two pairs run together; null without a prompt."""
    return F.sha2(F.concat(F.lit(f"{len(model.encode())}:{model}:"), prompt).cast("binary"), 256)


class Pace:
    """At most so many calls a second in this task; None: no limit."""

    def __init__(self, per_second: float | None, clock=time.monotonic, sleep=time.sleep):
        self.gap, self.next, self.clock, self.sleep = 1 / per_second if per_second else 0.0, None, clock, sleep

    def wait(self) -> None:
        now = self.clock()
        if self.next is not None and now < self.next:
            self.sleep(self.next - now)
            now = self.next
        self.next = now + self.gap


def tried(call, prompt: str, tries: int, pause: float, pace: Pace, sleep=time.sleep, chance=random.random) -> tuple:
    """(value, usage, error, tries taken). The n-th pause lies between half and all of pause * 2 ** n, so that tasks which were refused
    together don't come back together."""
    error = None
    for n in range(tries):
        if n:
            sleep(pause * 2 ** (n - 1) * (0.5 + chance() / 2))
        pace.wait()
        try:
            text, used = call(prompt)
            return text, used, None, n + 1
        except Exception as e:  # one prompt's failure must not end the others
            error = f"{type(e).__name__}: {e}"
    return None, None, error, tries


class Ledger:
    """A provider (see ``providers``) with a memory. ``factory()`` is called once a task and returns a function from a prompt to (text,
    usage dict). group: calls between two writes; tasks: how many of them ask at the same time; per_second: calls a second of all
    tasks together."""

    def __init__(self, spark: SparkSession, place: str, model: str, factory, group: int = 1000, tasks: int = 8, per_second: float | None = None, tries: int = 3, pause: float = 1.0):
        self.spark, self.place, self.model, self.factory = spark, place.rstrip("/"), model, factory
        self.group, self.tasks, self.per_second, self.tries, self.pause = group, tasks, per_second, tries, pause

    def _folders(self) -> list[str]:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.place}/calls-*")
        return [s.getPath().toString() for s in p.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(p) or []]

    def entries(self) -> DataFrame:
        """All calls made, failed ones too."""
        folders = self._folders()
        return self.spark.read.schema(ENTRY).parquet(*folders).distinct() if folders else self.spark.createDataFrame([], ENTRY)

    def replies(self) -> DataFrame:
        """One reply a key: of repeated ones (two runs at once) the first."""
        known = self.entries().where("error IS NULL").groupBy("key").agg(F.min(F.struct("at", "value", "latency_s", "usage")).alias("r"))
        return known.select("key", "r.value", F.lit(None).cast("string").alias("error"), "r.latency_s", "r.usage")

    def _asked(self):
        factory, tries, pause = self.factory, self.tries, self.pause
        each = self.per_second / self.tasks if self.per_second else None
        fields = [x.split(":")[0] for x in USAGE[7:-1].split(",")]
        kinds = [pa.string(), pa.string(), pa.string(), pa.float64(), pa.struct([(f, pa.int64()) for f in fields]), pa.int32(), pa.timestamp("us", tz="UTC")]

        def run(batches):
            call, pace = None, Pace(each)
            for b in batches:
                out = []
                for key, prompt in zip(b[0].to_pylist(), b[1].to_pylist()):
                    call = call or factory()
                    began = time.monotonic()
                    text, used, error, n = tried(call, prompt, tries, pause, pace)
                    usage = None if error else {f: (used or {}).get(f, 0 if f.startswith("cache") else None) for f in fields}
                    out.append((key, text, error, round(time.monotonic() - began, 3), usage, n, int(time.time() * 1e6)))
                cols = list(zip(*out)) if out else [[] for _ in kinds]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["key", "value", "error", "latency_s", "usage", "tries", "at"])

        return run

    def ask(self, prompts: DataFrame) -> DataFrame:
        """Ask what has no reply yet of a column ``prompt``; the keys that failed now, with their errors (key, error)."""
        keyed = prompts.where("prompt IS NOT NULL").select(call_key(self.model, F.col("prompt")).alias("key"), "prompt").groupBy("key").agg(F.first("prompt").alias("prompt"))
        todo = cut(keyed.join(self.replies().select("key"), "key", "left_anti"))
        n = todo.count()
        began = self.spark.sql("SELECT current_timestamp()").first()[0]
        groups = -(-n // self.group)
        for g in range(groups):
            part = todo.where(F.pmod(F.xxhash64("key"), F.lit(groups)) == g).repartition(self.tasks, "key")
            part.mapInArrow(self._asked(), ENTRY).write.mode("append").parquet(f"{self.place}/calls-new")
        failed = self.entries().where(F.col("error").isNotNull() & (F.col("at") >= F.lit(began)))
        return failed.join(todo.select("key"), "key", "left_semi").groupBy("key").agg(F.max_by("error", "at").alias("error"))

    def __call__(self, rows: DataFrame, prompt: str, out: str) -> DataFrame:
        failed = self.ask(rows.select(F.col(prompt).cast("string").alias("prompt")))
        none = lambda kind: F.lit(None).cast(kind)
        every = self.replies().unionByName(failed.join(self.replies(), "key", "left_anti").select("key", none("string").alias("value"), "error", none("double").alias("latency_s"), none(USAGE).alias("usage")))
        given = every.select(F.col("key").alias("_key"), F.struct("value", "error", "latency_s", "usage").cast(CALL).alias(out))
        missing = F.struct(none("string"), F.lit("no prompt"), none("double"), none(USAGE)).cast(CALL)
        joined = rows.withColumn("_of", call_key(self.model, F.col(prompt).cast("string"))).join(given, F.col("_of") == F.col("_key"), "left")
        return joined.withColumn(out, F.coalesce(F.col(out), missing)).drop("_of", "_key")

    def compact(self) -> None:
        """Write the calls anew in few files, then remove the old ones: at no time is a call in neither. No run may be asking meanwhile."""
        old = self._folders()
        self.entries().repartition(self.tasks, "key").write.parquet(f"{self.place}/calls-{uuid.uuid4().hex}")
        for folder in old:
            delete(self.spark, folder)
