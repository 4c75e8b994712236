import math
import re
from statistics import median

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from granary.functions import text as T
from granary.operators import blocks as B
from granary.operators import calibration as K
from granary.operators import chunking as C
from granary.operators import harness as H
from granary.operators import metrics as M
from granary.operators import providers as P
from granary.operators import retrieval as R
from granary.operators import serving as S

PATTERNS = [r"^\d+(\.\d+)*\s{1,4}\S", r"^[A-Z][A-Z0-9\-\.]*(?:\s+[A-Z0-9\-\.]+){1,10}$", r"^[A-Z][a-zA-Z\s]{2,60}:$"]
HEADING = {
    "RULE 3.70": True, "A.B CODE": True, "Some heading:": True, "1. Overview": False, "1.     Over": False, "1      Wide gap": False, "FILING/REQ A&B": False,
    "1 Overview": True, "1.2 Field Layout": True, "3.1.4 Sub-section": True, "FILING REQUIREMENTS": True, "RULE 37": True, "A": False, "Filing Requirements:": True, "": False,
    "  1 Padded  ": True, "1 Wide": True, "٤ Arabic digit": True, "1\x1cUnit": True, "A " * 12: False, "Ab:": False, "No colon": False, "AB\x1fCD": True, "1 " + "x" * 118: True, "1 " + "x" * 119: False,
}


def by_python(text, size=0.0, middle=0.0):
    text = text.strip()
    if not text or len(text) > 120:
        return False
    return size > 0 and middle > 0 and size >= middle * 1.15 or any(re.match(p, text) for p in PATTERNS)


def test_headings(spark):
    rows = spark.createDataFrame([(t,) for t in HEADING], "t string")
    got = {r.t: r.h for r in rows.select("t", T.is_heading(F.col("t"), F.lit(0.0), F.lit(0.0)).alias("h")).collect()}
    assert got == HEADING == {t: by_python(t) for t in HEADING}
    sizes = [("Introduction", 14.0, 10.0, True), ("Body text here.", 10.0, 10.0, False), ("x" * 130, 20.0, 10.0, False), ("", 14.0, 10.0, False), ("body", 11.5, 10.0, True), ("body", 14.0, 0.0, False), ("body", None, None, False)]
    df = spark.createDataFrame(sizes, "t string, s double, m double, want boolean")
    assert all(r.got == r.want for r in df.select("want", T.is_heading(F.col("t"), F.col("s"), F.col("m")).alias("got")).collect())


def split(text, most, overlap):
    if max(1, len(text) // 4) <= most:
        return [text]
    w, out, start = text.split(), [], 0
    while start < len(w):
        out.append(" ".join(w[start : start + int(most * 0.8)]))
        if start + int(most * 0.8) >= len(w):
            break
        start += int(most * 0.8) - int(overlap * 0.8)
    return out or [text]


def test_windows(spark):
    texts = ["short  text", "", " \n", "word " * 700, " ".join(f"w{i}" for i in range(333)), "x" * 5000, "  " + "ab " * 163 + "\n", " " * 3000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    for most, overlap in ((512, 64), (100, 20), (50, 0)):
        got = {}
        for r in C.text_windows(df, most, overlap).orderBy("doc_id", "window_no").collect():
            got.setdefault(r.doc_id, []).append(r.text)
        assert got == {i: split(t, most, overlap) for i, t in enumerate(texts)}
        assert all(C.pieces(t, most, overlap) == split(t, most, overlap) for t in texts)
    with pytest.raises(ValueError):
        T.windows(F.col("text"), 10, 10)
    with pytest.raises(ValueError):
        C.fixed_windows(df, 10, 10)


def by_hand(blocks, most, overlap, least, across=True):
    """Chunks of blocks (page, text, size) by walking them one after another."""
    count = lambda t: max(1, len(t) // 4)
    sizes = [s for _, _, s in blocks if s > 0]
    middle = median(sizes) if sizes else 0.0
    path, page, held, out = ["root"], 1, [], []

    def close():
        text = " ".join(held).strip()
        held.clear()
        for p in split(text, most, overlap) if text else []:
            if count(p) < least and out and out[-1]["path"] == path:
                out[-1]["text"] += " " + p
            else:
                out.append({"n": len(out), "path": list(path), "page": page, "text": p})

    for number, text, size in blocks:
        if not by_python(text, size, middle):
            held.append(text)
            continue
        close()
        title = text.strip()
        m = re.match(r"^(\d+(?:\.\d+)*)\s", title)
        path = path[: m[1].count(".") + 1] + [title] if m else [path[0], title]
        page = number
    close()
    merged = []
    for c in out:
        joined = merged[-1]["text"] + " " + c["text"] if merged else ""
        if merged and count(merged[-1]["text"]) < least and count(joined) <= most and (across or merged[-1]["path"] == c["path"]):
            merged[-1]["text"] = joined
        else:
            merged.append(dict(c))
    return [(c["n"], c["path"], c["page"], c["text"], count(c["text"])) for c in merged]


def body(n):
    return " ".join(f"w{i}" for i in range(n))


DOCS = {
    "a": [(1, "before", 0.0), (1, "1 ONE", 0.0), (2, body(30), 0.0), (2, "1.2 SUB", 0.0), (3, body(300), 0.0), (3, "1.2.1 DEEP", 0.0), (4, body(3), 0.0), (4, "OTHER ONE", 0.0), (4, "OTHER ONE", 0.0), (5, body(70), 0.0), (5, "3.1.1 SKIP", 0.0), (6, "end", 0.0)],
    "b": [(1, "only", 10.0)],
    "c": [(1, "ALL ALONE", 0.0)],
    "d": [(1, body(1000), 10.0), (1, "same", 14.0), (2, body(20), 10.0), (2, "same", 14.0), (2, body(2), 10.0), (3, "other", 11.5), (3, body(90), 10.0)],
    "e": [(1, "1 Introduction", 14.0), (1, "This is it.", 10.0), (2, "2 Layout", 14.0), (2, "Field A.", 10.0)],
}


@pytest.mark.parametrize("across", [True, False])
def test_chunks_equal_a_walk(spark, across):
    rows = [(d, i, *b) for d, bs in DOCS.items() for i, b in enumerate(bs)]
    df = spark.createDataFrame(rows, "doc_id string, block_ord int, page_num int, text string, font_size double")
    got = {}
    for r in C.chunk_documents(df, 100, 20, 25, across).orderBy("doc_id", "chunk").collect():
        got.setdefault(r.doc_id, []).append((r.section_path, r.page_num, r.text, r.token_count, r.chunk_id))
    want = {d: by_hand(bs, 100, 20, 25, across) for d, bs in DOCS.items()}
    assert {d: [x[:4] for x in xs] for d, xs in got.items()} == {d: [x[1:] for x in xs] for d, xs in want.items() if xs}
    import hashlib

    for d, xs in got.items():
        assert [x[4] for x in xs] == [hashlib.sha1("|".join([d, *p, str(n)]).encode()).hexdigest()[:16] for n, p, *_ in want[d]]
    assert C.chunk_documents(df.where("false")).count() == 0


def test_merge_counts_the_joined_text(spark):
    for sizes, n in (((399, 1655), 2), ((399, 1651), 1), ((399, 1652), 2), ((400, 4), 2), ((396, 4), 1)):
        df = spark.createDataFrame([(1, i, "x" * s) for i, s in enumerate(sizes)], "doc_id int, ord int, text string")
        assert C.merge_small(df).count() == n


def test_page_blocks(spark):
    spans = "array<struct<text:string,font_size:double>>"
    rows = [("a", 1, [(" x ", 9.0), ("\x1c", 1.0), ("y", None)], "p\r\n q\x0br", False), ("a", 2, [("x", 9.0)], "x\n \nz", True), ("a", 3, None, None, None)]
    df = spark.createDataFrame(rows, f"doc_name string, page_num int, spans {spans}, plain string, failed boolean")
    got = [(r.page_num, r.text, r.font_size) for r in B.page_blocks(df).orderBy("page_num", "block_ord").collect()]
    assert got == [(1, "x", 9.0), (1, "y", 0.0), (2, "x", 9.0), (2, "x", 0.0), (2, "z", 0.0)]
    lines = spark.createDataFrame([("a", 1, [], "p\r\n q\x0br", True)], f"doc_name string, page_num int, spans {spans}, plain string, failed boolean")
    assert [r.text for r in B.page_blocks(lines).orderBy("block_ord").collect()] == ["p", "q", "r"]


def test_routes():
    assert S.parse_route('x {"intent": "ood", "is_ood": true, "ood_confidence": 0.9, "doc_scope": ["a"]} y') == ("ood", True, 0.9, ["a"])
    assert S.parse_route('{"intent": "odd", "doc_scope": []}') == ("lookup", False, 0.0, None)
    assert S.parse_route('{"intent": "synthesis", "ood_confidence": 1}') == ("synthesis", False, 1.0, None)
    for bad in (None, "", "none", '{"a":1} junk {"b":2}', "{'a': 1}", '{"a": 1,}', '{"ood_confidence": NaN}', '{"doc_scope": "a"}', '{"ood_confidence": "high"}'):
        assert S.parse_route(bad) == ("lookup", False, 0.0, None)
    for field in ('"is_ood": "false"', '"is_ood": 1', '"ood_confidence": "0.9"', '"ood_confidence": true', '"ood_confidence": null', '"doc_scope": [null]', '"doc_scope": ["a", 1]', '"doc_scope": {}'):
        assert S.parse_route('{"intent": "ood", %s}' % field) == ("lookup", False, 0.0, None)


def test_judge_replies():
    assert S.parse_judge('ok {"faithfulness": 2, "relevance": "1", "citation_accuracy": 0.0}') == (2, 1, 0, "")
    for bad in (None, "no", '{"faithfulness": 2}', '{"faithfulness": "x", "relevance": 1, "citation_accuracy": 0}', '{"faithfulness": null, "relevance": 1, "citation_accuracy": 0}', "[1]"):
        assert S.parse_judge(bad) is None


def test_short_circuits(spark):
    rows = spark.createDataFrame([(1, True, 0.85), (2, True, 0.84), (3, False, 1.0), (4, None, None)], "query_id int, is_ood boolean, ood_confidence double")
    no, go = S.refused_early(rows)
    assert [r.query_id for r in no.collect()] == [1] and {r.query_id for r in go.collect()} == {2, 3, 4}
    hits = spark.createDataFrame([(2,), (2,)], "query_id int")
    assert {r.query_id for r in S.without_hits(go, hits).collect()} == {3, 4}


def test_render_is_single_pass(spark):
    df = spark.range(1).select(S.render("{a}-{b}-{a}", a=F.lit("{b}"), b=F.lit("{a}")).alias("x"))
    assert df.first().x == "{b}-{a}-{b}"


def test_confidence_and_bounds(spark):
    tags = {"<confidence>7</confidence> <CONFIDENCE> 9 </confidence>": 7, "none": 50, "<confidence>101</confidence>": 100, "<confidence>" + "9" * 20 + "</confidence>": 100, "<confidence>-3</confidence>": 50, "<confidence>x</confidence>": 50}
    df = spark.createDataFrame([(t,) for t in tags], "t string")
    assert {r.t: r.c for r in df.select("t", T.confidence(F.col("t")).alias("c")).collect()} == tags
    acts = spark.createDataFrame([(0.69999,), (0.70,), (0.84999,), (0.85,), (None,), (float("nan"),)], "c double")
    assert [r[0] for r in acts.select(T.action(F.col("c"))).collect()] == ["refuse", "notice", "notice", "answer", "refuse", "refuse"]
    assert [r[0] for r in acts.select(T.policy_action(F.col("c"), T.POLICY)).collect()] == ["refuse", "notice", "notice", "answer", "refuse", "refuse"]


CASES = "query_id string, retrieved array<string>, truth array<string>"


def test_retrieval_metrics(spark):
    rows = [("q1", list("abcde"), ["c"]), ("q2", list("abc"), ["x", "y"]), ("q3", ["a", "a", "b"], ["a"]), ("q4", list("abc"), []), ("q5", list("abc"), None), ("q6", None, ["a"]), ("q7", [], ["a"])]
    got = {r.query_id: r for r in M.retrieval_cases(spark.createDataFrame(rows, CASES), (2, 5)).collect()}
    assert (got["q1"].recall_2, got["q1"].recall_5, got["q1"].precision_5) == (0.0, 1.0, 0.2) and got["q1"].rr == pytest.approx(1 / 3)
    assert (got["q2"].recall_5, got["q2"].rr) == (0.0, 0.0) and got["q3"].precision_5 == 0.4 and got["q3"].precision_2 == 1.0
    assert got["q4"].recall_5 is None and got["q5"].recall_5 is None and got["q4"].precision_5 == 0.0 and got["q6"].recall_5 == got["q7"].recall_5 == 0.0
    mean = M.aggregate_retrieval(spark.createDataFrame([("q1", list("abc"), ["a"]), ("q2", list("xya"), ["a"]), ("q3", list("xyz"), ["a"])], CASES)).first()
    assert mean.n == 3 and mean.recall_5 == pytest.approx(2 / 3) and mean.mrr == pytest.approx(4 / 9)
    none = M.aggregate_retrieval(spark.createDataFrame([("q", ["a"], [])], CASES)).first()
    assert math.isnan(none.recall_5) and none.precision_5 == 0.0 and none.mrr == 0.0
    empty = M.aggregate_retrieval(spark.createDataFrame([], CASES)).first()
    assert empty.n == 0 and empty.recall_5 is None and empty.mrr is None
    assert M.precision_at(F.col("a"), F.col("b"), 0)._jc.toString() == F.lit(0.0)._jc.toString()


def test_kappa(spark):
    frame = lambda rows: spark.createDataFrame(rows, "a int, b int")
    assert M.kappa(frame([(0, 1), (0, 1)]), "a", "b").first().kappa == 0
    assert M.kappa(frame([(0, 0), (1, 1), (2, 2)]), "a", "b").first().kappa == 1
    assert math.isnan(M.kappa(frame([(1, 1)]), "a", "b").first().kappa) and math.isnan(M.kappa(frame([]), "a", "b").first().kappa)
    for bad in ([(3, 3), (0, 1)], [(0, None)]):
        with pytest.raises(PySparkException, match="label outside"):
            M.kappa(frame(bad), "a", "b").collect()


def test_refusal(spark):
    rows = [(True, True), (True, True), (True, False), (False, False), (False, False), (False, True)]
    got = M.refusal(spark.createDataFrame(rows, "is_ood boolean, refused boolean")).first()
    assert (got.n_ood, got.n_in_scope) == (3, 3) and got.ood_refusal_rate == got.f1 == pytest.approx(2 / 3) and got.in_scope_refusal_rate == pytest.approx(1 / 3)
    assert math.isnan(M.refusal(spark.createDataFrame([(True, False)], "is_ood boolean, refused boolean")).first().f1)


def test_calibration(spark):
    rows = spark.createDataFrame([(r, int((r * 7919) % 100 < r)) for r in range(0, 101)] * 3, "raw int, y int")
    got = K.fit_platt(rows, "raw", "y")
    data = [(r.raw / 100, r.y) for r in rows.collect()]
    a = b = 0.0
    for _ in range(50):  # Newton's method
        p = [1 / (1 + math.exp(-(a * x + b))) for x, _ in data]
        ga, gb = sum((q - y) * x for q, (x, y) in zip(p, data)) + a, sum(q - y for q, (_, y) in zip(p, data))
        w = [q * (1 - q) for q in p]
        aa, ab, bb = sum(v * x * x for v, (x, _) in zip(w, data)) + 1, sum(v * x for v, (x, _) in zip(w, data)), sum(w)
        a, b = a - (bb * ga - ab * gb) / (aa * bb - ab * ab), b - (aa * gb - ab * ga) / (aa * bb - ab * ab)
    assert got["coef"] == pytest.approx(a, abs=1e-4) and got["intercept"] == pytest.approx(b, abs=1e-4) and got["n_train"] == 303
    mean = sum(x for x, _ in data) / 303
    assert got["feature_std"] == pytest.approx(math.sqrt(sum((x - mean) ** 2 for x, _ in data) / 303)) and got["train_brier"] > 0
    model, report = K.train_report(rows, "raw", "y")
    assert model == got and report["improvement"] == pytest.approx(report["raw_ece"] - got["train_ece"]) and (report["warning"] is None) == (report["improvement"] >= 0)
    with pytest.raises(ValueError):
        K.fit_platt(rows.where("y = 1"), "raw", "y")
    sure = spark.createDataFrame([(1.0, 0)] * 3, "c double, y int")
    assert K.ece(K.reliability(sure, "c", "y")).first().ece == 1.0
    assert K.ece(K.reliability(sure.where("false"), "c", "y")).first().ece == 0.0
    edges = spark.createDataFrame([(x / 100,) for x in range(101)], "c double").select(K.bin_of(F.col("c")).alias("b"), "c").collect()
    assert [r.b for r in edges if round(r.c * 100) in (30, 60, 70)] == [2, 5, 6] and edges[100].b == 9
    lines = K.table_lines(K.reliability(sure, "c", "y"))
    assert len(lines) == 11 and "--" in lines[1] and lines[10].split()[-3:] == ["0.000", "1.000", "1.000"]


def test_gates_and_judge(spark):
    frame = lambda **m: spark.createDataFrame(list(m.items()), "metric string, value double")
    got = {r.metric: r.passed for r in H.gates(frame(recall_5=0.8, faithfulness=1.0, ece=0.09), frame(recall_5=0.82, faithfulness=1.2, ece=0.05, ood_f1=0.9)).collect()}
    assert got == {"recall_5": True, "faithfulness": False, "ece": False, "ood_f1": False}
    raters = spark.createDataFrame([(0, 0, 1, 1), (1, 1, 1, 1), (2, 2, 1, 1)], "a int, b int, c int, d int")
    judged = {r.dimension: r for r in H.validate_judge(raters, {"x": ("a", "b"), "y": ("c", "d")}).collect()}
    assert judged["x"].passed and not judged["y"].passed and math.isnan(judged["y"].kappa)
    empty = H.summary(spark.createDataFrame([], "category string, error string, refused boolean, recall_5 double, recall_20 double, judge_faithfulness int, judge_relevance int, latency_s double")).first()
    assert empty.n == 0 and math.isnan(empty.recall_5) and math.isnan(empty.ood_f1)


def test_topk(spark, monkeypatch):
    vec = lambda i: None if i == 3 else [0.0, 0.0] if i == 4 else [1.0] if i == 5 else [float("nan"), 1.0] if i == 6 else [1.0, None] if i == 7 else [1.0, float(i % 4)]
    df = spark.createDataFrame([(i, vec(i), f"n{i % 2}", ["n1"] if i == 1 else []) for i in range(40)], "vec_id bigint, embedding array<double>, name string, scope array<string>")
    live = [i for i in range(40) if i not in (3, 4, 5, 6, 7)]

    def want(q, scoped):
        cos = lambda i: sum(a * b for a, b in zip(vec(q), vec(i))) / math.hypot(*vec(q)) / math.hypot(*vec(i))
        pool = [i for i in live if i != q and (not scoped or q != 1 or i % 2)]
        return sorted(pool, key=lambda i: (-round(cos(i), 12), i))[:6]

    for size in (64 << 20, 32):  # one group of queries, and many
        monkeypatch.setattr(R, "QUERY_BYTES", size)
        for scoped in (False, True):
            got = {}
            for r in R.cosine_topk(df.where("vec_id < 8"), df, 6, skip_self=True, **({"scope": "scope", "name": "name"} if scoped else {})).orderBy("query_id", "rank").collect():
                got.setdefault(r.query_id, []).append(r.vec_id)
            assert got == {q: want(q, scoped) for q in (0, 1, 2)}
    assert R.cosine_topk(df.where("vec_id = 3"), df).count() == 0
    assert R.cosine_topk(df.where("vec_id = 0"), df.where("false")).count() == 0


def test_providers(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "fail"), (3, None)], "query_id int, prompt string")

    def factory():
        def call(p):
            if p == "fail":
                raise RuntimeError("no")
            return f"re {p}", {"input_tokens": 3}

        return call

    got = {r.query_id: r.out for r in P.Model(factory)(rows, "prompt", "out").collect()}
    assert got[1].value == "re a" and got[1].usage.input_tokens == 3 and got[1].usage.cache_read_input_tokens == 0 and got[2].error == "RuntimeError: no" and got[2].latency_s >= 0
    told = P.Replay(spark.createDataFrame([(1, "x")], "query_id int, value string"))
    got = {r.query_id: r.out for r in told(rows, "prompt", "out").collect()}
    assert got[1].value == "x" and got[2].error == "no recorded reply"
    embed = lambda: lambda texts: [[3.0, 4.0 * len(t)] for t in texts]
    assert P.embed_passages(rows.where("query_id = 1"), "prompt", factory=embed).first().embedding == [0.6, 0.8] and P.dimension_of(embed) == 2
    assert P.embed_queries(rows.where("query_id = 1"), "prompt", factory=embed).columns == ["query_id", "prompt", "embedding"]
    scored = P.score_pairs(rows.withColumn("text", F.lit("abc")), lambda: lambda pairs: [len(t) for _, t in pairs], "prompt")
    assert {r.score for r in scored.collect()} == {3.0}
    assert P.embed_passages(rows.where("query_id = 3"), "prompt").first().embedding == [0.0] * 64
    used = spark.range(1).select(P.usage(F.struct(*[F.lit(x).alias(n) for x, n in ((1, "input_tokens"), (2, "output_tokens"), (None, "cache_read_input_tokens"), (None, "cache_creation_input_tokens"))])).alias("u")).first().u
    assert tuple(used) == (1, 2, 0, 0)


def test_failed_calls_are_rows_of_their_own(spark):
    asked = spark.createDataFrame([("q1", "one"), ("q2", "two")], "query_id string, question string")
    corpus = spark.createDataFrame([("c1", "d", ["root"], 1, "one", 1, [1.0, 0.0])], "chunk_id string, doc_name string, section_path array<string>, page_num int, text string, token_count int, embedding array<double>")
    routes = P.Replay(spark.createDataFrame([("q1", "{}"), ("q2", "{}")], "query_id string, value string"))
    told = P.Replay(spark.createDataFrame([("q1", "yes <confidence>80</confidence>")], "query_id string, value string"))
    got = S.serve(asked, corpus, routes, told, lambda df: df.withColumn("embedding", F.array(F.lit(1.0), F.lit(1.0))), R.overlap, calibrator={"coef": 10.0, "intercept": 0.0})
    got = {r.query_id: r for r in got.collect()}
    assert got["q1"].answer == "yes" and got["q1"].calibrated_confidence == pytest.approx(1 / (1 + math.exp(-8))) and got["q2"].error and got["q2"].answer == "" and not got["q2"].refused
    assert [c.chunk_id for c in got["q1"].ranked_chunks] == ["c1"] and got["q1"].retrieved_chunks[0].score == pytest.approx(math.sqrt(0.5))
