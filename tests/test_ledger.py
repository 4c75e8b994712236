import os

import pytest
from pyspark.sql import functions as F

from granary.operators.ledger import Ledger, Pace, call_key, tried
from granary.sources.shared import new_folder, ship_package


def counting(folder, fails=(), dies=None):
    """A model that leaves a line a call in a file, fails for some prompts, and kills its task once for one of them."""

    def factory():
        def call(prompt):
            with open(f"{folder}/calls.txt", "a") as f:
                f.write(f"{prompt}\n")
            if prompt in fails and not os.path.exists(f"{folder}/mended"):
                raise OSError("busy")
            if prompt == dies and not os.path.exists(f"{folder}/died"):
                open(f"{folder}/died", "w").close()
                raise SystemExit("lost")
            return prompt.upper(), {"input_tokens": len(prompt), "output_tokens": 1}

        return call

    return factory


def calls(folder):
    return sorted(open(f"{folder}/calls.txt").read().split()) if os.path.exists(f"{folder}/calls.txt") else []


def prompts(spark, n=30):
    return spark.createDataFrame([(i, f"p{i % n}") for i in range(2 * n)] + [(1000, None)], "id int, q string")


def test_each_prompt_is_asked_once(spark, tmp_path):
    ship_package(spark)
    ledger = Ledger(spark, new_folder(spark, "ledger"), "m", counting(tmp_path), group=7, tasks=2, pause=0.0)
    half = prompts(spark).where("id % 30 < 12")
    assert ledger(half, "q", "r").where("r.value = upper(q) AND r.usage.input_tokens = length(q)").count() == half.where("q IS NOT NULL").count()
    assert len(calls(tmp_path)) == 12
    got = ledger(prompts(spark), "q", "r").collect()
    assert calls(tmp_path) == sorted(f"p{i}" for i in range(30)) and len(got) == 61
    assert {r.r.error for r in got if r.q is None} == {"no prompt"} and all(r.r.value == r.q.upper() and r.r.usage.cache_read_input_tokens == 0 for r in got if r.q)
    ledger.compact()
    ledger(prompts(spark), "q", "r").collect()
    assert len(calls(tmp_path)) == 30
    # Another model is asked for itself.
    Ledger(spark, ledger.place, "m2", counting(tmp_path), tasks=2).ask(prompts(spark).select(F.col("q").alias("prompt")))
    assert len(calls(tmp_path)) == 60


def test_a_run_that_dies_keeps_what_it_wrote(spark, tmp_path):
    ship_package(spark)
    ledger = Ledger(spark, new_folder(spark, "ledger"), "m", counting(tmp_path, dies="p17"), group=5, tasks=1, pause=0.0)
    with pytest.raises(Exception, match="lost|crash|exit|Exit"):
        ledger(prompts(spark), "q", "r")
    kept = ledger.entries().count()
    before = calls(tmp_path)
    got = ledger(prompts(spark), "q", "r").collect()
    assert all(r.r.value == r.q.upper() for r in got if r.q)
    after = calls(tmp_path)
    # What had been written isn't asked again: at most the group at hand is.
    assert len(after) - len(before) == 30 - kept and len(before) - kept <= 10 and ledger.entries().count() == 30


def test_failures_are_tried_again(spark, tmp_path):
    ship_package(spark)
    ledger = Ledger(spark, new_folder(spark, "ledger"), "m", counting(tmp_path, fails=("p3", "p4")), tasks=2, tries=3, pause=0.0)
    got = {r.q: r.r for r in ledger(prompts(spark), "q", "r").where("q IS NOT NULL").collect()}
    assert got["p3"].error == "OSError: busy" and got["p3"].value is None and got["p5"].value == "P5"
    assert calls(tmp_path).count("p3") == 3 and ledger.entries().where("error IS NOT NULL AND tries = 3").count() == 2
    (tmp_path / "mended").touch()
    assert {r.r.error for r in ledger(prompts(spark), "q", "r").where("q IS NOT NULL").collect()} == {None}
    assert calls(tmp_path).count("p3") == 4 and calls(tmp_path).count("p5") == 1


def test_pauses_and_pace():
    slept, now = [], [0.0]

    def sleep(s):
        slept.append(s)
        now[0] += s

    def call(p):
        raise OSError("no")

    assert tried(call, "x", 4, 1.0, Pace(None), sleep, lambda: 1.0) == (None, None, "OSError: no", 4) and slept == [1.0, 2.0, 4.0]
    slept.clear()
    pace = Pace(4, lambda: now[0], sleep)
    for _ in range(5):
        pace.wait()
    assert slept == [0.25] * 4
    now[0] += 10
    pace.wait()
    assert len(slept) == 4


def test_keys_tell_models_and_prompts_apart(spark):
    rows = spark.createDataFrame([("a",), ("b:a",)], "p string")
    keys = {r[0] for m in ("m", "m:b", "1:m") for r in rows.select(call_key(m, F.col("p"))).collect()}
    assert len(keys) == 6
