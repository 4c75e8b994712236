"""Query traces as a stream: spans in any order become one row a trace.

A trace is given out as soon as all the spans that its root announces are there, or, without them, once the watermark is ``gap`` past
its last span. Spans that come again are counted and not added. What comes for a trace that was given out is late: it's
kept count of, and told in a row of its own when the trace is forgotten, ``keep`` later. Spans older than the watermark never get
that far; Spark counts them (``dropped``). State is a row a trace, with the sums by kind
and, while it's open, the ids of its spans, which fit a row."""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import Row

#: What a stream of spans has: ``spans`` is set on a trace's root alone.
SPAN = "trace_id string, span_id string, kind string, ts timestamp, seconds double, error string, spans int"
TRACE = "trace_id string, status string, started bigint, ended bigint, n_spans int, n_repeated int, n_errors int, n_late int, seconds double, kinds array<struct<kind:string,n:int,seconds:double>>"
HEAD = "started bigint, ended bigint, expected int, repeated int, late int, given boolean, errors int, kinds array<struct<kind:string,n:int,seconds:double>>, ids array<string>"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Traces(StatefulProcessor):
    """Times are microseconds, timers milliseconds. A trace has one timer from its first row on. Spans leave it where it is, as each call
    to the state store costs; one that fires too early is set anew."""

    def __init__(self, gap_s: float, keep_s: float):
        self.gap, self.keep = int(gap_s * 1000), int(keep_s * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", HEAD)

    def _due(self, head) -> int:
        return head[1] // 1000 + self.gap + (self.keep if head[5] else 0)

    def _row(self, key, status, head):
        started, ended, _, repeated, late, _, errors, kinds, ids = head
        listed = [Row(kind=k, n=n, seconds=s) for k, n, s in sorted(map(tuple, kinds), key=lambda x: (x[0] is not None, x[0]))]
        return Row(trace_id=key[0], status=status, started=started, ended=ended, n_spans=len(ids), n_repeated=repeated, n_errors=errors, n_late=late, seconds=float(sum(x.seconds for x in listed)), kinds=listed)

    def _give(self, key, status, head):
        """The trace's row; its spans go, its head stays as a mark."""
        started, ended, expected, repeated = head[:4]
        kept = (started, ended, expected, repeated, 0, True, 0, [], [])
        self.head.update(kept)
        return self._row(key, status, head), kept

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802
        head = self.head.get()
        started, ended, expected, repeated, late, given, errors, kinds, ids = tuple(head) if head is not None else (None, None, None, 0, 0, False, 0, [], [])
        sums, known = {k: (n, s) for k, n, s in kinds}, dict.fromkeys(ids)
        for r in rows:
            if given:
                late += 1
                continue
            if r.span_id in known:
                repeated += 1
                continue
            known[r.span_id] = None
            n, s = sums.get(r.kind, (0, 0.0))
            sums[r.kind] = n + 1, s + (r.seconds or 0.0)
            errors += r.error is not None
            started, ended = min(started or r.at, r.at), max(ended or r.at, r.at)
            expected = r.spans if r.spans is not None else expected
        new, head = head is None, (started, ended, expected, repeated, late, given, errors, [(k, n, s) for k, (n, s) in sums.items()], list(known))
        if not given and expected is not None and len(known) >= expected:
            row, head = self._give(key, "complete", head)
            yield row
        else:
            self.head.update(head)
        if new:
            self.handle.registerTimer(self._due(head))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802
        head = self.head.get()
        if head is None:
            return
        head = tuple(head)
        if self._due(head) > timerValues.getCurrentWatermarkInMs():
            self.handle.registerTimer(self._due(head))
            return
        if not head[5]:
            row, head = self._give(key, "incomplete", head)
            yield row
            self.handle.registerTimer(self._due(head))
            return
        if head[4]:
            yield self._row(key, "late", head)
        self.head.clear()

    def close(self) -> None:
        pass


def traces(spans: DataFrame, gap_s: float, keep_s: float, delay: str) -> DataFrame:
    """A stream of spans (SPAN) to a stream of traces (TRACE). delay: how far spans may lag behind the newest one. Spans without a trace,
    an id or a time are left out. Sets the session's state store to one that has timers."""
    spans.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    # The driver's own worker, which asks for the state's schema, doesn't see files that were sent to the others.
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    known = spans.where("trace_id IS NOT NULL AND span_id IS NOT NULL AND ts IS NOT NULL").withWatermark("ts", delay)
    rows = known.select("trace_id", "span_id", "kind", "ts", F.unix_micros("ts").alias("at"), "seconds", "error", "spans")
    return rows.groupBy("trace_id").transformWithState(Traces(gap_s, keep_s), TRACE, "Append", "EventTime")


def write_traces(spans: DataFrame, path: str, checkpoint: str, gap_s: float = 60, keep_s: float = 600, delay: str = "10 minutes", once: bool = True) -> StreamingQuery:
    """Start a query that writes traces to Parquet files, each of them once, over restarts too. once: stop when what is there now has been
    read."""
    out = traces(spans, gap_s, keep_s, delay).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if once else out).start()


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TRACE).parquet(path)


def dropped(query: StreamingQuery) -> int:
    """Spans that came after the watermark, in the batches that the query still reports."""
    return sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])
