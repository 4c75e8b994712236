import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.llm import merkle, oddsketch, resample

BASE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
#: Extra columns whose names the operators use themselves.
CLASHES = "h string, at string, bucket string, gram string, gain string, part string, tree string, pos string, digest string, node string, key string, keys string, n string, a string, b string"


def made(spark, rows):
    """Rows (doc_id, text, source) as documents with extra columns of clashing names."""
    extra = ["x"] * len(CLASHES.split(", "))
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), *extra) for i, t, s in rows], f"doc_id bigint, text string, lang string, source string, n_chars bigint, {CLASHES}")


def odd_rows():
    rows = [(i, t, "a" if i % 2 else None) for i, t in enumerate([None, "", " \n", "one", BASE, BASE + " end", "x " + BASE.upper(), BASE, "Été ÉTÉ été " * 9, "long " * 30_000, "a\nb\nc"])]
    return [*rows, (3, BASE, "b"), (3, BASE, "b"), (None, BASE, None), (None, None, "c"), (4, BASE, None)]


def brute_resample(docs, bench, most, buckets, least):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    grams = lambda w: [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, most + 1) for i in range(len(w) - n + 1)]
    s, t = (Counter(x for text in texts for x in grams(words(text))) for texts in ([d[1] for d in docs], bench))
    all_s, all_t = s.total(), t.total()
    gain = [math.floor(1000 * math.log(float(t[b] + 1) * (float(all_s) + buckets) / (float(s[b] + 1) * (float(all_t) + buckets)))) for b in range(buckets)]
    out = []
    for d, text, *_ in docs:
        w = words(text)
        weight = sum(gain[b] for b in grams(w))
        h = int(hashlib.sha256(f"2024:{d}".encode()).hexdigest()[:8], 16)
        score = None if d is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([d, len(grams(w)), weight, score, len(w) >= least and d is not None])
    able = sorted((-r[3], r[0]) for r in out if r[4])
    drawn = able[: 10 * len(able) // 20]
    ranks = {}
    for i, k in enumerate(drawn):
        ranks.setdefault(k, []).append(i + 1)
    out.sort(key=str)
    return sorted((str(d), n, w, str(x), (ranks[(-x, d)].pop() if ok and ranks.get((-x, d)) else None)) for d, n, w, x, ok in out), len(drawn)


@pytest.mark.parametrize("most, buckets", [(1, 10_000), (1, 7), (3, 500)])
def test_resample_equals_brute_force(spark, monkeypatch, most, buckets):
    monkeypatch.setattr(resample, "COPIES", 2)
    rng = np.random.default_rng(13)
    rows = odd_rows() + [(100 + i, " ".join(rng.choice(BASE.split(), int(rng.integers(0, 60)))), "s") for i in range(40)] + [(99, BASE, "s")] * 7
    bench = [" ".join(BASE.split()[::2]), None, "", "Zeta eta-theta"]
    want, n = brute_resample(rows, bench, most, buckets, 20)
    target = spark.createDataFrame([(i, t) for i, t in enumerate(bench)], "item_id int, text string")
    got = resample.resample(made(spark, rows).repartition(3), target, most, buckets, tenths=(10, 20)).collect()
    key = lambda r: (r[0], r[1], r[2], r[3], -1 if r[4] is None else r[4])
    assert sorted(((str(r.doc_id), r.n_features, r.weight, str(r.score), r["rank"]) for r in got), key=key) == sorted(want, key=key)
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, n + 1)) and n > 10


def test_resample_of_empty_tables(spark):
    docs, target = made(spark, odd_rows()), spark.createDataFrame([], "item_id int, text string")
    assert resample.resample(docs.where("false"), target).collect() == []
    assert len(resample.resample(docs, target).collect()) == len(odd_rows())
    assert resample.resample(docs.where("text IS NULL"), target).agg(F.max("weight")).first()[0] == 0


def brute_merkle(rows, fan, changed):
    H = lambda *x: hashlib.sha256("".join(x).encode()).hexdigest()  # noqa: E731, N806
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda d, t, s: H(part(d), part(s), part("en"), part(None if t is None else len(t)), part(t))
    other = lambda d, t, s: H(part(d), part(s), part("en"), part(None if t is None else len(t)), part(t.replace("\n", "") if t else t))

    def tree(nodes):
        """The root, and each leaf's siblings level by level."""
        paths, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for i, p in enumerate(at):
                paths[i].append((nodes[p - p % fan : p], nodes[p + 1 : p - p % fan + fan]))
            nodes, at = [H(*nodes[i : i + fan]) for i in range(0, len(nodes), fan)], [p // fan for p in at]
        return nodes[0], paths

    by = {}
    for r in rows:
        by.setdefault(r[2], []).append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        own = sorted(by[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
        trees[s] = own, *tree([leaf(*r) for r in own])
    root, uppers = tree([trees[s][1] for s in names])
    out = []
    for s, up in zip(names, uppers):
        own, sub, paths = trees[s]
        for r, path in zip(own, paths):
            h = other(*r) if changed(r[0]) else leaf(*r)
            for a, b in path + up:
                h = H(*a, h, *b)
            out.append((str(r[0]), leaf(*r), sub, root, H(*(x for a, b in path + up for x in a + b)), h, h == root))
    return sorted(out)


@pytest.mark.parametrize("fan, levels", [(3, 1), (3, 6), (2, 2)])
def test_manifest_equals_brute_force(spark, fan, levels):
    rng = np.random.default_rng(11)
    rows = odd_rows() + [(200 + i, f"t\n{i % 9}", ["hot", "hot", "é", "z"][int(rng.integers(0, 4))]) for i in range(90)]
    docs = made(spark, rows).repartition(4)
    cleaned = merkle.digest_of(*[F.replace(F.col(f), F.lit("\n"), F.lit("")) if f == "text" else F.col(f) for f in merkle.FIELDS])
    got = merkle.manifest(docs, changed=F.when(F.col("doc_id") % 2 == 0, cleaned), fan=fan, levels=levels).collect()
    want = brute_merkle(rows, fan, lambda d: d is not None and d % 2 == 0)
    assert sorted((str(r.doc_id), r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in got) == want
    assert {r.verified for r in got} == {True, False}
    # The proofs themselves fold to the root.
    assert all(merkle.folded(r.leaf, r.path) == r.root for r in got)


def test_manifest_small(spark, tmp_path):
    docs = made(spark, odd_rows())
    assert merkle.manifest(docs.where("false")).collect() == []
    (one,) = merkle.manifest(docs.where("doc_id = 10")).collect()
    assert one.leaf == one.subroot == one.root == one.folded_root and one.path == "" and one.verified and one.proof_sha256 == hashlib.sha256(b"").hexdigest()
    # A null and an empty text differ; the store stays where it's named.
    two = {r.leaf for r in merkle.manifest(docs.where("doc_id < 2"), fields=("text",), store=f"file://{tmp_path}/store").collect()}
    assert len(two) == 2 and (tmp_path / "store" / "sources").exists()


def test_numbers_go_on_over_partitions(spark):
    rows = spark.createDataFrame([("a" if i < 500 else f"b{i % 7}" if i < 600 else "c", i) for i in range(1000)], "tree string, i int")
    got = merkle.numbered(rows.repartition(5), "i").collect()
    for t in {r.tree for r in got}:
        own = sorted((r.i, r.pos, r["last"]) for r in got if r.tree == t)
        assert [p for _, p, _ in own] == list(range(len(own))) and [x for _, _, x in own] == [False] * (len(own) - 1) + [True]


def brute_near(rows):
    sets = [oddsketch.shingle_set(t or "") for _, t, _ in rows]
    ids = sorted({d for d, _, _ in rows if d is not None})
    up = {d: d for d in ids}

    def top(d):
        while up[d] != d:
            d = up[d]
        return d

    for i, (d, _, _) in enumerate(rows):
        for j in range(i):
            e, x, y = rows[j][0], sets[i], sets[j]
            if d is not None and e is not None and x and y and 100 * len(x & y) >= 80 * len(x | y):
                a, b = sorted((top(d), top(e)))
                up[b] = a
    return sorted((str(d), len(s), str(d if d is None or not s else top(d))) for (d, _, _), s in zip(rows, sets))


def copies(rng, n, groups, words=120):
    """Texts of groups in which similarities lie around 0.8."""
    out = []
    for g in range(groups):
        first = [f"g{g}w{int(x)}" for x in rng.integers(0, 400, words)]
        for _ in range(n):
            own = list(first)
            for p in rng.integers(0, words, int(rng.integers(0, 5))):
                own[p] = f"v{int(rng.integers(0, 10**6))}"
            out.append(" ".join(own).title() if rng.random() < 0.2 else "  ".join(own))
    return out


def test_near_documents_equal_brute_force(spark):
    rng = np.random.default_rng(17)
    frame = " ".join(f"f{i}" for i in range(80))
    texts = copies(rng, 12, 6) + [f"{frame} {' '.join(f'u{int(x)}' for x in rng.integers(0, 10**6, int(rng.integers(5, 60))))}" for _ in range(60)]
    rows = odd_rows() + [(50 + int(i), t, None) for i, t in zip(rng.permutation(len(texts)), texts)] + [(60, texts[0], None), (61, "a b", None), (62, "A  b", None)]
    got = oddsketch.near_documents(made(spark, rows).repartition(4)).collect()
    # Null, empty and blank texts are alone; an id that is repeated joins what its texts are linked with.
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute_near(rows)
    assert len({r.component_id for r in got}) < len(got) - 40
    assert oddsketch.near_documents(made(spark, rows).where("false")).collect() == []


def test_odd_sketches_tell_similarities(spark):
    rng = np.random.default_rng(3)
    ones = {}
    for share in (0.95, 0.8, 0.4):
        got = []
        for _ in range(60):
            x = rng.integers(0, 2**63, 900).astype(np.uint64)
            both = int(round(2 * 450 * share / (1 + share)))
            a, b = np.sort(x[:450]), np.sort(np.concatenate([x[:both], x[450 : 900 - both]]))
            z = np.bitwise_count((oddsketch.odd_sketch(oddsketch.samples(a)) ^ oddsketch.odd_sketch(oddsketch.samples(b))).view(np.uint64)).sum()
            got.append(int(z))
        ones[share] = got
    # (1 - exp(-4 k (1 - J) / n)) n / 2 ones for k samples in n bits
    for share, got in ones.items():
        want = oddsketch.BITS / 2 * (1 - math.exp(-4 * oddsketch.SAMPLES * (1 - share) / oddsketch.BITS))
        assert abs(np.mean(got) - want) < 5
    assert max(ones[0.8]) <= oddsketch.MOST < min(ones[0.4])
