import pytest
from pyspark.sql import functions as F

from granary.plans.storage import POINT, points
from granary.sources import files as S
from granary.sources import store
from granary.sources.shared import new_folder

QUESTIONS = """
questions:
  - id: a1
    category: procedural
    difficulty: 2
    question: How?
    ground_truth_chunks:
      - document: m.PDF
        section: s
  - {id: a2, category: ood, difficulty: 1, question: "What?", ground_truth_chunks: null}
"""


def test_question_set(spark, tmp_path):
    (tmp_path / "q.yaml").write_text(QUESTIONS)
    got = S.read_cases(spark, f"file://{tmp_path}/q.yaml").orderBy("id").collect()
    assert got[0].ground_truth_chunks[0].document == "m.PDF" and got[1].ground_truth_chunks == [] and got[1].notes == ""
    from granary.operators.harness import dry_run

    assert dry_run(S.read_cases(spark, f"file://{tmp_path}/q.yaml")).columns == ["id", "category", "difficulty", "question"]
    (tmp_path / "bad.yaml").write_text("questions: [{id: 1}]")
    with pytest.raises(KeyError):
        S.read_cases(spark, f"file://{tmp_path}/bad.yaml")
    (tmp_path / "p.yaml").write_text("version: '1'\nmodel: m\nmax_tokens: 5\nsystem: s\nuser_template: '{q}'\n")
    assert S.read_prompt(spark, f"file://{tmp_path}/p.yaml")["max_tokens"] == 5
    with pytest.raises(ValueError, match="ood"):
        S.read_prompt(spark, f"file://{tmp_path}/p.yaml", ("ood",))


def test_models_and_results(spark, tmp_path):
    model = {"coef": 1.5, "intercept": -0.25, "feature_mean": 0.5, "feature_std": 0.1, "n_train": 7, "train_ece": 0.01, "train_brier": 0.2}
    S.save_model(spark, model, f"file://{tmp_path}/m.json")
    S.save_model(spark, model | {"coef": 2.0}, f"file://{tmp_path}/m.json")
    assert S.load_model(spark, f"file://{tmp_path}/m.json") == model | {"coef": 2.0}
    lines = ['{"case_id": "a", "raw_confidence": 80, "judge_faithfulness": 2, "judge_relevance": 1}', '{"raw_confidence": 70, "faithfulness": 2, "relevance": 0}', "", '{"raw_confidence": null, "faithfulness": 2, "relevance": 1}', '{"raw_confidence": "high", "faithfulness": 2, "relevance": 1}', "{broken", "[1]"]
    (tmp_path / "r.jsonl").write_text("\n".join(lines))
    rows, rejected = S.read_results(spark, f"file://{tmp_path}/r.jsonl")
    assert rejected == 4 and sorted((r.raw_confidence, r.correct) for r in rows.collect()) == [(70.0, 0), (80.0, 1)]


def test_download_and_files(spark, tmp_path):
    (tmp_path / "from").mkdir()
    (tmp_path / "from" / "x").write_bytes(b"page one\fpage two")
    entries = [{"name": n, "category": "manual", "url": f"file://{tmp_path}/from/{u}", "filename": f"{n}.txt", "description": ""} for n, u in (("a", "x"), ("b", "absent"))]
    listed = S.catalog(spark, entries)
    got = {r.name: r for r in S.download(listed, f"{tmp_path}/to").collect()}
    assert got["a"].ok and "17 bytes" in got["a"].message and not got["b"].ok and (tmp_path / "to/manual/a.txt").read_bytes() == b"page one\fpage two"
    assert not list((tmp_path / "to/manual").glob("*.tmp"))
    again = S.download(listed, f"{tmp_path}/to")
    assert {r.ok: r.n for r in S.tally(again).collect()} == {True: 1, False: 1} and again.where("name = 'a'").first().message.startswith("exists")
    assert {r.name: r.status for r in S.manifest(spark, listed, f"file://{tmp_path}/to").collect()} == {"a": "exists", "b": "missing"}
    found = S.files(spark, f"file://{tmp_path}/to/manual", "*.txt")
    assert [r.doc_name for r in found.collect()] == ["a"]
    pages = S.parse_files(found, S.text_pages).orderBy("page_num").collect()
    assert [(r.page_num, r.plain) for r in pages] == [(1, "page one"), (2, "page two")]

    def fails(content):
        raise OSError("unreadable")
        yield

    assert S.parse_files(found, fails).first().error == "OSError: unreadable"
    with pytest.raises(ValueError):
        S.files(spark, f"file://{tmp_path}/to/manual")


@pytest.mark.parametrize("kind", ["path", "table"])
def test_collection(spark, kind):
    place = new_folder(spark, "c") if kind == "path" else "granary_test_points"
    if kind == "table":
        spark.sql(f"DROP TABLE IF EXISTS {place}")
    c = store.Collection(spark, place, buckets=4)
    assert c.info() is None
    c.ensure(2, POINT)
    c.ensure(2, POINT)
    with pytest.raises(ValueError, match="vectors of 2"):
        c.ensure(3, POINT)
    rows = points(spark.createDataFrame([(i, [float(i), 1.0], i % 3) for i in range(12)], "vec_id int, embedding array<double>, label int"))
    assert c.count() == 0 and c.upsert(rows) == 12 and c.upsert(rows) == 12 and c.count() == 12
    twice = rows.where("chunk_id = 'c1'").withColumn("text", F.lit("last")).withColumn("at", F.lit(2)).unionByName(rows.where("chunk_id = 'c1'").withColumn("at", F.lit(1)))
    assert c.upsert(twice, order="at") == 1 and c.points().where("chunk_id = 'c1'").first().text == "last" and c.count() == 12
    with pytest.raises(ValueError):
        c.upsert(rows.withColumn("embedding", F.array(F.lit(1.0).cast("float"))))
    assert c.upsert(rows.where("doc_name = 'd0'").limit(1), replace_documents=True) == 1 and c.count() == 9
    assert c.upsert(rows.where("false")) == 0
    info = c.collection_info().first()
    assert (info.points_count, info.vector_size, info.distance) == (9, 2, "cosine")
    if kind == "table":
        spark.sql(f"DROP TABLE {place}")


def vecs(spark, rows):
    """(id, document, text) as chunks with a vector."""
    made = spark.createDataFrame([(f"c{i}", d, ["root", f"s{i % 3}"], 1, t, 1, [float(i), 1.0]) for i, d, t in rows], f"{POINT}, embedding array<float>")
    return made


def held(c):
    return sorted((r.chunk_id, r.doc_name, r.text) for r in c.points().collect())


def opened(spark, buckets=4):
    c = store.Collection(spark, new_folder(spark, "c"), buckets)
    c.ensure(2, POINT)
    return c


def bytes_below(spark, path):
    fs, p = store.Collection(spark, path)._at(path)
    return fs.getContentSummary(p).getLength() if fs.exists(p) else 0


def test_a_moved_chunk_is_one_point(spark):
    c = opened(spark)
    c.upsert(vecs(spark, [(1, "a", "old"), (2, "a", "x")]))
    c.upsert(vecs(spark, [(1, "b", "new")]))
    assert held(c) == [("c1", "b", "new"), ("c2", "a", "x")]
    # The old place is gone for good: the new document's removal doesn't bring it back.
    c.remove_documents(spark.createDataFrame([("b",)], "doc_name string"))
    assert held(c) == [("c2", "a", "x")]
    c.compact()
    assert held(c) == [("c2", "a", "x")]
    c.compact(full=True)
    assert held(c) == [("c2", "a", "x")] and not c.compact(full=True) and len(c._live()[0]) == 1


def test_random_logs_equal_a_dictionary(spark):
    import random

    rng, c, want = random.Random(4), opened(spark, 2), {}
    for step in range(9):
        what = rng.choice(["upsert", "upsert", "replace", "remove", "documents", "fold", "base"])
        rows = [(i, f"d{rng.randrange(4)}", f"t{step}") for i in rng.sample(range(12), 4)]
        if what in ("upsert", "replace"):
            if what == "replace":
                want = {i: v for i, v in want.items() if v[0] not in {d for _, d, _ in rows}}
            c.upsert(vecs(spark, rows), replace_documents=what == "replace")
            want |= {i: (d, t) for i, d, t in rows}
        elif what == "remove":
            c.remove(vecs(spark, rows))
            want = {i: v for i, v in want.items() if i not in {r[0] for r in rows}}
        elif what == "documents":
            c.remove_documents(vecs(spark, rows[:1]))
            want = {i: v for i, v in want.items() if v[0] != rows[0][1]}
        else:
            c.compact(full=what == "base")
            c.vacuum()
        assert held(c) == sorted((f"c{i}", d, t) for i, (d, t) in want.items()), (step, what)


def test_a_batch_costs_its_own_size(spark):
    c = opened(spark)
    c.upsert(vecs(spark, [(i, f"d{i % 50}", "x" * 300) for i in range(4000)]))
    c.compact(full=True)
    before = bytes_below(spark, f"{c.place}/data")
    c.upsert(vecs(spark, [(i, "d1", "y") for i in range(100)]))
    new = bytes_below(spark, f"{c.place}/data") - before
    assert 0 < new < 20_000 < before and c.count() == 4000
    assert [e["rows"] for e in c.log()][-1] == 100 and c.vacuum() == 1


def test_commits_are_exclusive_and_seen_whole(spark, monkeypatch):
    c = opened(spark)
    c.upsert(vecs(spark, [(1, "a", "x")]))
    with pytest.raises(store.Conflict):
        c._commit({"number": 1})
    # A writer that dies before its commit leaves nothing to be seen.
    monkeypatch.setattr(store.Collection, "_commit", lambda *_: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        c.upsert(vecs(spark, [(2, "a", "y")]))
    monkeypatch.undo()
    assert held(c) == [("c1", "a", "x")] and c.vacuum() == 1
    # A stream's batch that is run again is in the log already; folding keeps what is known of the stream.
    assert c.upsert(vecs(spark, [(3, "a", "z")]), stream=("s", 0)) == 1 and c.upsert(vecs(spark, [(3, "a", "other")]), stream=("s", 0)) == 0
    c.compact(full=True)
    assert c.upsert(vecs(spark, [(3, "a", "other")]), stream=("s", 0)) == 0 and c.upsert(vecs(spark, [(4, "a", "w")]), stream=("s", 1)) == 1
    assert held(c) == [("c1", "a", "x"), ("c3", "a", "z"), ("c4", "a", "w")]


def scanned(df):
    """Rows that the scans of vectors gave out, and their files."""
    df.collect()
    plan, rows, files = df._jdf.queryExecution().executedPlan(), 0, 0
    plan = plan.finalPhysicalPlan() if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else plan
    stack = [plan]
    while stack:
        p = stack.pop()
        name = p.getClass().getSimpleName()
        if name.endswith("QueryStageExec"):
            stack.append(p.plan())
        if name == "FileSourceScanExec" and "embedding" in p.requiredSchema().simpleString():
            rows, files = rows + p.metrics().apply("numOutputRows").value(), files + p.metrics().apply("numFiles").value()
        stack += [p.children().apply(i) for i in range(p.children().size())]
    return rows, files


def test_a_scope_reads_its_files(spark):
    from granary.operators.retrieval import cosine_topk, search

    c = opened(spark, 16)
    c.upsert(vecs(spark, [(i, f"d{i % 16:02d}", "x") for i in range(1600)]))
    c.compact(full=True)
    c.upsert(vecs(spark, [(5, "d03", "moved"), (3, "d99", "gone")]))
    every, some, none = (c.points(s) for s in (None, ["d03"], ["nowhere"]))
    assert scanned(none) == (0, 0) and none.collect() == []
    want = sorted(r.chunk_id for r in every.where("doc_name = 'd03'").collect())
    assert sorted(r.chunk_id for r in some.collect()) == want and "c5" in want and "c3" not in want and len(want) == 100
    (rows, files), (all_rows, all_files) = scanned(some), scanned(every)
    assert all_rows == 1602 and all_files >= 17 and files <= 3 and rows <= 350
    # Path entries, and names as a table.
    assert len(c.points(["s1"], "section_path").collect()) == every.where("array_contains(section_path, 's1')").count()
    names = spark.createDataFrame([("d03",), ("d99",), ("no",)], "term string")
    assert sorted(r.chunk_id for r in c.points(names).collect()) == sorted([*want, "c3"])
    assert c.points(spark.createDataFrame([("s2",)], "term string"), "section_path").count() == every.where("array_contains(section_path, 's2')").count()
    with pytest.raises(ValueError, match="not indexed"):
        c.points(["x"], "text")
    asked = spark.createDataFrame([(1, [3.0, 1.0], ["d03", "d99"]), (2, [9.0, 2.0], ["d07"]), (3, [1.0, 1.0], ["no"])], "query_id int, embedding array<float>, scope array<string>")
    key = lambda df: sorted((r.query_id, r["rank"], r.chunk_id, r.score) for r in df.collect())
    got = search(asked, c, 5, scope="scope")
    assert key(got) == key(cosine_topk(asked, every, 5, key="chunk_id", query_key="query_id", scope="scope", name="doc_name")) and {r.query_id for r in got.collect()} == {1, 2}
    open_ = asked.unionByName(spark.createDataFrame([(4, [1.0, 1.0], None)], asked.schema))
    assert {r.query_id for r in search(open_, c, 5, scope="scope").collect()} == {1, 2, 4}
