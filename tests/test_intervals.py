import bisect
import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.operators.intervals import in_force, interval_join, policy_actions
from granary.operators.isotonic import isotonic, isotonic_pools
from granary.sources.shared import ship_package

NAN, INF = float("nan"), float("inf")


@pytest.mark.parametrize("closed", ["left", "right"])
def test_intervals_equal_brute_force(spark, closed):
    r = random.Random(closed)
    spans = [(i, r.choice("ab"), None if r.random() < 0.1 else r.uniform(-50, 50), None) for i in range(150)]
    spans = [(i, k, lo, None if r.random() < 0.1 else (lo or 0.0) + r.choice([0.0, 1e-9, 0.5, 3, 8, 8.0000001, 64, 1000, -1])) for i, k, lo, _ in spans] + [(900, "a", NAN, 5.0), (901, "a", 1.0, 1.0), (902, None, 0.0, 9.0)]
    values = [(i, r.choice(["a", "b", "c", None]), r.choice([None, NAN, INF, -INF, 0.0, r.choice(spans[:150])[2], r.uniform(-60, 60)])) for i in range(200)] + [(7, "a", 1.0), (7, "a", 1.0)]
    rows, held = spark.createDataFrame(values, "id int, k string, v double"), spark.createDataFrame(spans, "no int, k string, low double, high double")

    def within(v, lo, hi):
        if v is None or v != v or abs(v) == INF or lo != lo or hi != hi:
            return False
        return (lo is None or (lo <= v if closed == "left" else lo < v)) and (hi is None or (v < hi if closed == "left" else v <= hi))

    want = []
    for i, k, v in values:
        hits = [no for no, s, lo, hi in spans if k is not None and s == k and within(v, lo, hi)]
        want += [(i, str(v), no) for no in hits or [-1]]
    got = interval_join(rows, "v", held, by=("k",), closed=closed)
    assert got.columns == ["id", "k", "v", "no", "low", "high"]
    assert sorted((x.id, str(x.v), -1 if x.no is None else x.no) for x in got.collect()) == sorted(want)
    inner = interval_join(rows, "v", held, by=("k",), closed=closed, how="inner")
    assert sorted((x.id, str(x.v), x.no) for x in inner.collect()) == sorted(w for w in want if w[2] >= 0)
    assert interval_join(rows, "v", held.where("false"), by=("k",)).where("no IS NULL").count() == len(values)
    assert interval_join(rows.where("false"), "v", held, by=("k",)).count() == 0


def test_many_bounds_and_versions(spark):
    """A hundred thousand bounds in several versions."""
    rng = np.random.default_rng(5)
    start = datetime.datetime(2024, 1, 1)
    since = {(p, v): start + datetime.timedelta(days=int(10 * v + p)) for p in range(5) for v in range(4)}
    bounds = {k: np.unique(rng.random(5000)) for k in since}
    bounds[4, 3] = np.array([0.5])
    policies = spark.createDataFrame([(p, v, since[p, v], float(b), f"{p}.{v}.{i}") for (p, v), bs in bounds.items() for i, b in enumerate(bs)], "policy int, version int, since timestamp, low double, action string")
    asked = [(i, int(rng.integers(0, 6)), start + datetime.timedelta(days=float(rng.random() * 50 - 3)), None if i % 50 == 0 else float(rng.random())) for i in range(2000)] + [(9000, 1, since[1, 2], float(bounds[1, 2][7])), (9001, 1, since[1, 2], NAN)]
    got = {r.id: (r.version, r.action) for r in policy_actions(spark.createDataFrame(asked, "id int, policy int, at timestamp, confidence double"), policies).collect()}
    for i, p, at, c in asked:
        v = max((v for (q, v), s in since.items() if q == p and s <= at), default=None)
        n = bisect.bisect_right(bounds[p, v], c) if v is not None and c is not None and c == c else 0
        assert got[i] == (v, f"{p}.{v}.{n - 1}" if n else "refuse"), (i, p, at, c)
    assert got[9000] == (2, "1.2.7") and len(got) == len(asked)
    assert in_force(policies.select("policy", "since").distinct(), "since", ("policy",)).where("until IS NULL").count() == 5


def brute_isotonic(points):
    pools = []
    for x, y, w in sorted(points):
        pools.append([x, x, y * w, w])
        while len(pools) > 1 and pools[-2][2] * pools[-1][3] >= pools[-1][2] * pools[-2][3]:
            b, a = pools.pop(), pools.pop()
            pools.append([a[0], b[1], a[2] + b[2], a[3] + b[3]])
    return pools


@pytest.mark.parametrize("shape", ["noise", "rising", "falling", "one fall"])
def test_pools_equal_one_pass_over_all(spark, shape):
    ship_package(spark)
    r = random.Random(shape)
    n = 240
    y = {"noise": lambda i: r.random() + i / 200, "rising": lambda i: i, "falling": lambda i: -i, "one fall": lambda i: i if i != 120 else -500}[shape]
    points = [(float(i), float(y(i)), float(r.randrange(1, 4))) for i in range(n)]
    rows = spark.createDataFrame(points + [(None, 1.0, 1.0), (NAN, 1.0, 1.0), (3.0, None, 1.0), (3.0, 9.0, 0.0)], "x double, y double, w double")
    pools = isotonic_pools(rows, "x", "y", "w", size=25)
    got = sorted((p.low, p.high, p.value, p.weight) for p in pools.collect())
    want = [(a, b, s / w, w) for a, b, s, w in brute_isotonic(points)]
    assert len(got) == len(want) and np.allclose(got, want)
    asked = [-5.0, 0.0, 0.5, 119.5, 120.0, 121.25, 77.7, 239.0, 500.0]
    told = {p.x: p.isotonic for p in isotonic(spark.createDataFrame([(x,) for x in [*asked, None, NAN]], "x double"), "x", pools).where("x IS NOT NULL AND NOT isnan(x)").collect()}
    xs, ys = zip(*sorted({(a, v) for a, _, v, _ in want} | {(b, v) for _, b, v, _ in want}))
    assert np.allclose([told[x] for x in asked], np.interp(asked, xs, ys))


def test_pools_of_nothing(spark):
    ship_package(spark)
    assert isotonic_pools(spark.createDataFrame([], "x double, y double"), "x", "y").collect() == []
    rows = spark.createDataFrame([(1.0, 1.0)], "x double, y double")
    got = isotonic(rows.unionByName(rows.withColumn("x", F.lit(None).cast("double"))), "x", isotonic_pools(rows, "x", "y")).collect()
    assert sorted(str(r.isotonic) for r in got) == ["1.0", "None"]


def test_equal_bounds_are_decided_by_rank(spark):
    """The last of equal bounds decides, in whatever order and partition they come; the SQL on one thread takes the larger part too."""
    since = datetime.datetime(2024, 1, 1)
    rows = [(i, i % 2, 0, since, (i % 40) / 40, f"a{i}") for i in range(400)]
    asked = spark.createDataFrame([(i, i % 2, since, (i % 40) / 40 + 0.001) for i in range(40)], "id int, policy int, at timestamp, confidence double")
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        policies = spark.createDataFrame(rows, "part int, policy int, version int, since timestamp, low double, action string").repartition(5)
        got = {r.id: r.action for r in policy_actions(asked, policies, rank=("part",)).collect()}
        assert got == {i: f"a{360 + i}" for i in range(40)}
        got = {r.id: r.action for r in policy_actions(asked, policies.drop("part")).collect()}
        assert got == {i: max(f"a{k}" for k in range(i, 400, 40)) for i in range(40)}
