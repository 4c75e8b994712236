import importlib.util
import re
import sys

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from granary.llm import decontaminate, licenses, near, neighbours, quality, simhash, stages, toxicity
from granary.llm.queries import QUERIES
from granary.plans.registry import QUERIES as OTHERS

DATA = "/root/testdata/sf0.01"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
GOOD = "The first line of a good document says something.\nThe second line says something else, and more."


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    """A small data folder: documents with nulls, empties, a long text, copies, repeated ids and clashing column names."""
    top = f"file://{tmp_path_factory.mktemp('sf')}"
    item = " ".join(f"bench{i}" for i in range(20))
    shared = " ".join(f"s{i}" for i in range(40))
    own = lambda k, n=60: " ".join(f"{k}w{i}" for i in range(n))
    texts = [None, "", " \n ", "one", GOOD, GOOD, own("a") + " " + shared, own("b") + " " + shared, own("c", 20) + " " + item, own("d", 3000), shared, "x " * 20_000, GOOD.upper(), own("e"), own("f")]
    rows = [(i, t, "en", "s1" if i % 3 else None, len(t or "")) for i, t in enumerate(texts)] + [(13, own("g"), "en", "s2", 1), (13, own("e"), "en", "s2", 1), (None, own("h"), None, None, None), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'k' AS h", "'k' AS node", "1 AS n_words", "2 AS quality_score", "array(1) AS hits", "'k' AS `_row`", "'k' AS `a.b`")
    docs.write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame([(i, int(i % 2 == 0), 0) for i in range(15)], "doc_id bigint, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id bigint, text string").write.parquet(f"{top}/benchmark.parquet")
    return top


def key(r):
    return (str(r.doc_id), str(r.text), str(r.source))


def test_each_stage_keeps_what_it_should(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    rows, out = docs.collect(), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, sf)
        assert got.columns == names and got.schema == docs.schema, name
        out[name] = got.collect()
        assert {(r.h, r.n_words, r["a.b"]) for r in out[name]} <= {("k", 1, "k")}, name

    kept = sorted(map(key, out["quality"]))
    model = quality.fit_quality(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    assert kept == sorted(key(r) for r, s in zip(rows, model.score([r.text for r in rows])) if s >= 0.3)

    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    low = lambda t: tuple(re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in words(t))
    sets = [{low(r.text)[i : i + 5] for i in range(max(1, len(words(r.text)) - 4))} if words(r.text) else set() for r in rows]
    want = []
    for i, r in enumerate(rows):
        like = [o for o, s in zip(rows, sets) if o.doc_id is not None and (s == sets[i] or s and sets[i] and len(s & sets[i]) >= 0.8 * len(s | sets[i]))]
        if r.doc_id is None or r.doc_id == min(o.doc_id for o in like):
            want.append(key(r)[:2])
    assert sorted(key(r)[:2] for r in out["near_dedup"]) == sorted(set(want))

    cut = {key(r)[0]: r for r in out["substring_dedup"] if r.doc_id not in (None, 13)}
    shared = " ".join(f"s{i}" for i in range(40))
    assert cut["6"].text.endswith(shared) and shared not in cut["7"].text and cut["7"].n_chars == len(cut["7"].text) and "10" not in cut and "5" not in cut and cut["4"].text == GOOD and cut["0"].text is None

    assert {key(r)[0] for r in out["decontaminate"]} == {str(r.doc_id) for r in rows} - {"8"}

    mixed = stages.mixed(spark, docs, sf)
    assert mixed.columns == [*names, "source_row", "block", "slot", "position"] and sorted(map(key, mixed.collect())) == sorted(map(key, rows))
    assert mixed.select("position").distinct().count() == len(rows) and stages.mixed(spark, docs.where("false"), sf).count() == 0


def test_stages_of_empty_tables(spark, sf):
    none = spark.read.parquet(f"{sf}/documents.parquet").where("false")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, sf).count() == 0, name


def test_run_chains_the_stages_and_cleans_up(spark, sf, tmp_path):
    got = corpus_pipeline.run(spark, sf, f"file://{tmp_path}/out")
    rows = got.collect()
    assert got.columns[-4:] == ["source_row", "block", "slot", "position"] and "text" in got.columns and rows
    # No copy, no benchmark passage, no repeated passage is left.
    texts = [r.text for r in rows if r.text]
    assert len(texts) == len(set(texts)) and not any("bench0" in t for t in texts) and sum("s5 s6 s7" in t for t in texts) <= 1
    assert [p.name for p in (tmp_path / "out").iterdir()] == ["mixing"]


@pytest.mark.parametrize("op, label, fold, held", [("op2_toxicity", "toxic", 4, 2), ("op9_quality", "quality", 5, 0)])
def test_held_out_labels_are_not_learned(spark, tmp_path, op, label, fold, held):
    at = f"file://{tmp_path}"
    spark.read.parquet(f"{DATA}/documents.parquet").withColumns({"lang": F.lit("x"), "source": F.lit("y")}).write.parquet(f"{at}/documents.parquet")
    out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(fold)) == held
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    labels.withColumn(label, F.when(out, 1 - F.col(label)).otherwise(F.col(label))).write.parquet(f"{at}/labels.parquet")
    score = lambda d: {r.doc_id: (r.held_out, r.score) for r in QUERIES[op](spark, d).collect()}
    a, b = score(DATA), score(at)
    assert a == b and any(h for h, _ in a.values()) and all(0 <= s <= 1 for _, s in a.values())


def test_classifiers_of_odd_texts(spark):
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(60)], "doc_id bigint, toxic int, quality int")
    rows = [(i, f"you idiot {i} fool" if i % 2 else f"a kind word {i}") for i in range(60)]
    odd = [(100, None), (101, ""), (102, " \n"), (103, "you idiot fool " * 40_000), (104, "fine " * 200_000), (104, "fine " * 200_000), (None, "x")]
    docs = spark.createDataFrame(rows + odd, "doc_id bigint, text string").withColumn("toxicity", F.lit("clash"))
    model = toxicity.fit_toxicity(docs, labels)
    got = [(r.doc_id, r.toxicity) for r in toxicity.score_toxicity(docs, model).collect()]
    assert len(got) == 67
    by = dict(got)
    assert by[100] == by[101] and by[103] > 0.5 > by[104] and all(0 <= s <= 1 for _, s in got)
    assert toxicity.score_toxicity(docs.where("false"), model).count() == 0
    none = toxicity.fit_toxicity(docs, labels.where("false"))
    assert {r.toxicity for r in toxicity.score_toxicity(docs, none).collect()} == {0.5}
    same = toxicity.fit_toxicity(docs, labels.where("toxic = 1"))
    assert len({r.toxicity for r in toxicity.score_toxicity(docs, same).collect()}) == 1
    assert quality.score_quality(docs.where("false"), quality.fit_quality(docs, labels)).count() == 0


@pytest.mark.parametrize("n", [5, 2000])
def test_simhash_query_equals_brute_force(spark, tmp_path, n):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where(f"doc_id < {n}")
    extra = spark.createDataFrame([(5000, None), (5001, ""), (5001, "a b"), (None, "a b"), (5002, "A  b"), (5003, "z " * 50_000)], "doc_id bigint, text string")
    docs = docs.select("doc_id", "text").unionByName(extra).withColumns({"fp": F.lit(1), "key": F.lit(2), "root": F.lit(3)})
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    got = QUERIES["op6_simhash"](spark, f"file://{tmp_path}").collect()
    rows = docs.collect()
    prints = {r.text: simhash.fingerprint(r.text) % 2**64 for r in rows}
    first = {}
    for r in rows:
        if r.doc_id is not None:
            first[prints[r.text]] = min(first.get(prints[r.text], r.doc_id), r.doc_id)
    root, known = {}, sorted(first)
    todo = set(known)
    while todo:
        group, edge = set(), {todo.pop()}
        while edge:
            group |= edge
            edge = {b for b in todo if any((a ^ b).bit_count() <= 2 for a in edge)}
            todo -= edge
        root |= {p: min(first[x] for x in group) for p in group}
    want = sorted((str(r.doc_id), f"{prints[r.text]:016x}", str(None if r.doc_id is None else root[prints[r.text]])) for r in rows)
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == want


def test_ring_keeps_all_pairs_within_the_distance():
    import numpy as np

    rng = np.random.default_rng(12)
    a = rng.integers(0, 2**16, (400, 32), np.uint16)
    bits = np.unpackbits(a.view(np.uint8), axis=1)
    for far in (0, 40, 118, 160, 256):
        turned = bits.copy()
        for row in turned:
            at = rng.choice(512, far, False)
            row[at] ^= 1
        b = np.packbits(turned, axis=1).view(np.uint16)
        passed = simhash.ring_passes(a, b, 118)
        assert passed.all() if far <= 118 else passed.mean() < (0.2 if far >= 160 else 1)


def test_chain_keys_prune(spark):
    import numpy as np

    rng = np.random.default_rng(13)
    prints = spark.createDataFrame([(int(x),) for x in rng.integers(-(2**63), 2**63 - 1, 3000)], "fp bigint")
    exact, looked = simhash.chain_keys(prints)
    assert exact.count() == 9000 and looked.count() == 3000 * (22 + 22 + 23)
    assert exact.withColumnRenamed("fp", "a").join(looked.withColumnRenamed("fp", "b"), "key").where("a <> b").count() == 0


def test_near_groups_with_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert near.keep_one(none).count() == 0 and simhash.near_duplicates(none).count() == 0
    bench = spark.createDataFrame([], "item_id bigint, text string")
    some = spark.createDataFrame([(1, "a", "en", "s", 1)], SCHEMA)
    assert decontaminate.decontaminate(some, bench).count() == 1 and decontaminate.scan_hits(none, bench).count() == 0
    assert licenses.scan_licenses(none).count() == 0
    assert neighbours.valid(spark.createDataFrame([], "vec_id bigint, embedding array<double>")).count() == 0


def test_every_operator_has_its_query():
    assert sorted(QUERIES) == sorted(["pipeline", *(f"op{i}_{n}" for i, n in enumerate("decontaminate toxicity warc licenses neighbours simhash mixing urls quality substrings manifest minhash resample".split(), 1))])
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "substring_dedup", "decontaminate", "mixing"]
    assert importlib.util.find_spec("granary.llm") is not None and not set(QUERIES) & set(OTHERS)
    assert not [m for m in sys.modules if m.startswith("granary.") and not m.startswith("granary.llm") and "llm" in vars(sys.modules[m])]
