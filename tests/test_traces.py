import datetime
import os
import random
import time

from pyspark.sql import Row
from pyspark.sql import functions as F

from granary.sources.shared import new_folder, ship_package
from granary.streaming.traces import SPAN, Traces, dropped, read_traces, write_traces

START = datetime.datetime(2024, 1, 1)


def span(trace, no, at_s, kind="k", spans=None, error=None):
    return (trace, f"{trace}.{no}", kind, START + datetime.timedelta(seconds=at_s), 0.5, error, spans)


def put(spark, folder, no, rows):
    """One file, which is one batch; files are read in order of their times."""
    df = spark.createDataFrame(rows, SPAN).coalesce(1)
    df.write.mode("overwrite").parquet(f"file://{folder}/.made")
    (name,) = [f for f in os.listdir(f"{folder}/.made") if f.endswith(".parquet")]
    os.rename(f"{folder}/.made/{name}", f"{folder}/{no:03d}.parquet")
    os.utime(f"{folder}/{no:03d}.parquet", (time.time() + no, time.time() + no))


def run(spark, folder, out, checkpoint, **more):
    stream = spark.readStream.schema(SPAN).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "*.parquet").parquet(f"file://{folder}")
    q = write_traces(stream, out, checkpoint, **more)
    q.awaitTermination()
    return q


def test_traces_in_any_order_and_over_a_restart(spark, tmp_path):
    ship_package(spark)
    r = random.Random(3)
    rows = [span(f"t{t}", i, 10 * t + i, "root" if i == 0 else "ab"[i % 2], 4 if i == 0 else None, "x" if i == 3 and t % 2 else None) for t in range(20) for i in range(4)]
    rows = [x for x in rows if x[1] not in ("t5.0", "t6.2")]  # a trace without its root, one without a span
    rows += [span("t1", 2, 12, "a"), span("t7", 3, 73, "b")]  # spans that come again
    r.shuffle(rows)
    out, checkpoint = new_folder(spark, "traces"), new_folder(spark, "stream")
    for i in range(3):
        put(spark, tmp_path, i, rows[i * 28 : (i + 1) * 28])
    more = {"gap_s": 60, "keep_s": 600, "delay": "10 minutes"}
    run(spark, tmp_path, out, checkpoint, **more)
    done = {t.trace_id for t in read_traces(spark, out).collect()}
    put(spark, tmp_path, 3, rows[84:] + [span("t2", 9, 900, "c"), span("flush", 0, 1000)])
    put(spark, tmp_path, 4, [span("flush", 1, 4000)])
    put(spark, tmp_path, 5, [span("flush", 2, 9000), span("t3", 9, 1, "c")])  # the second one is too old
    q = run(spark, tmp_path, out, checkpoint, **more)
    got = read_traces(spark, out).where("trace_id <> 'flush'").collect()
    whole = {t.trace_id: t for t in got if t.status != "late"}
    assert 0 < len(done) < 20 and len(whole) == 20 == sum(t.status != "late" for t in got)
    assert {t for t, x in whole.items() if x.status == "incomplete"} == {"t5", "t6"} and {x.n_spans for x in whole.values()} == {3, 4}
    assert whole["t9"].n_errors == 1 and whole["t8"].n_errors == 0
    t = whole["t8"]
    assert (t.ended - t.started, t.seconds, [(k.kind, k.n) for k in t.kinds]) == (3_000_000, 2.0, [("a", 1), ("b", 2), ("root", 1)])
    # A span for a trace that was given out is told of later; one behind the watermark is counted by Spark.
    late = {t.trace_id: t.n_late for t in got if t.status == "late"}
    assert late.get("t2") == 1 and dropped(q) == 1
    assert sum(x.n_repeated for x in whole.values()) + sum(late.values()) == 3
    # Nothing is given out again.
    run(spark, tmp_path, out, checkpoint, **more)
    assert read_traces(spark, out).where("trace_id <> 'flush'").agg(F.count("*")).first()[0] == len(got)


def test_a_trace_has_one_timer_and_keeps_sums():
    """Each call to the state costs; a timer that fires before the trace is due is set anew."""
    calls, held = [], {}

    class Head:
        get = staticmethod(lambda: held.get("head"))
        update = staticmethod(lambda v: held.update(head=v))
        clear = staticmethod(held.clear)

    class Handle:
        getValueState = staticmethod(lambda *_: Head)  # noqa: N815
        registerTimer = staticmethod(calls.append)  # noqa: N815

    class Now:
        def __init__(self, ms):
            self.getCurrentWatermarkInMs = lambda: ms

    t = Traces(60, 600)
    t.init(Handle)
    for i in range(3):
        row = Row(span_id=f"s{i}", kind="k", at=(100 + 10 * i) * 1_000_000, seconds=0.5, error=None, spans=None)
        assert list(t.handleInputRows(("t",), [row, row], Now(0))) == []
    assert calls == [160_000] and held["head"][7] == [("k", 3, 1.5)]
    assert list(t.handleExpiredTimer(("t",), Now(170_000), None)) == [] and calls == [160_000, 180_000]
    (given,) = t.handleExpiredTimer(("t",), Now(180_000), None)
    assert (given.status, given.n_spans, given.n_repeated, given.seconds) == ("incomplete", 3, 3, 1.5) and calls[2:] == [780_000]
    assert list(t.handleExpiredTimer(("t",), Now(780_000), None)) == [] and not held
