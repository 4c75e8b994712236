import gzip
import hashlib
import itertools
import random
import re
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from granary.llm import common, decontaminate, licenses, mixing, near, neighbours, quality, simhash, substrings, toxicity, urls, warc

BASE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, fp string")


def few(spark):
    texts = [None, "", "one", BASE, BASE + " end", "x " + BASE.upper(), BASE, "long " * 30_000, "short a b"]
    return docs(spark, [(i, t, "en", "a" if i % 2 else None, 1, "clash") for i, t in enumerate(texts)] + [(3, BASE, "en", "a", 1, "clash"), (None, BASE, None, None, None, None)])


@pytest.mark.parametrize("piece", [1 << 20, 64])
def test_word_codes_tell_words_apart(piece):
    rng = np.random.default_rng(15)
    words = [bytes(rng.integers(33, 256, int(rng.integers(1, 12)), np.uint8)) for _ in range(3000)] + [b"a", b"aa", b"b" * 300, b"\0", b"\0\0"]
    data = b"".join(w + bytes([9, 10, 11, 12, 13, 32][int(x)] for x in rng.integers(0, 6, int(rng.integers(1, 4)))) for w in words)
    code = common.WordCodes(0xD1342543DE82EF95, 0x9E3779B97F4A7C15, piece=piece)
    for got in code(b" \n" + data):
        assert len(got) == len(words) == len(data.split()) and len(set(got.tolist())) == len(set(words))
        assert len({(w, g) for w, g in zip(words, got.tolist())}) == len(set(words))
    assert [len(x) for x in code(b"")] == [len(x) for x in code(b" \t")] == [0, 0] and len(code(b"x" * 1000)[0]) == 1


def test_gaps_round_trip():
    for x in ([], [0], [254], [255], [65535], [0, 1, 255, 256, 511, 1021, 65535], list(range(0, 65536, 7))):
        assert substrings.from_gaps(substrings.gaps(np.array(x, np.uint32))).tolist() == x


def brute_substrings(every, n=13):
    owner, want = {}, []
    for d, w in every:
        for i in range(len(w) - n + 1):
            if d is not None:
                k = tuple(w[i : i + n])
                owner[k] = min(owner.get(k, d), d)
    for d, w in every:
        gone = {p for i in range(len(w) - n + 1) if d is not None and owner[tuple(w[i : i + n])] < d for p in range(i, i + n)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        want.append((str(d), len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(want)


@pytest.mark.parametrize("more", [{}, {"group": 3}, {"most_bits": 17}])
def test_substrings_equal_brute_force(spark, more):
    rng = np.random.default_rng(11)
    passages = [[f"w{int(x)}" for x in rng.integers(0, 50, int(rng.integers(5, 60)))] for _ in range(12)]
    made = [" ".join(sum((passages[int(j)] for j in rng.integers(0, 12, int(rng.integers(1, 5)))), [])) for _ in range(60)]
    df = few(spark).unionByName(docs(spark, [(int(rng.integers(0, 50)), t, None, None, None, None) for t in made])).repartition(3)
    df = df.withColumnsRenamed({"lang": "n_words", "source": "windows", "fp": "packed"})
    every = [(r.doc_id, re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in df.collect()]
    got = substrings.dedup_substrings(df, details=("n_words", "n_removed", "kept_sha256"), **more).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted((str(r[0]), *r[1:]) for r in got) == brute_substrings(every) and any(r.n_removed for r in got)
    assert substrings.dedup_substrings(df, **more).columns == df.columns
    assert substrings.dedup_substrings(df.where("false"), **more).count() == 0
    named = substrings.dedup_substrings(df.withColumn("doc_id", F.col("doc_id").cast("string")), details=("a", "b", "c"), **more)
    assert sorted((str(r.doc_id), r.a, r.b, r.c) for r in named.collect()) == brute_substrings([(None if d is None else str(d), w) for d, w in every])


def test_decontaminate(spark):
    bench = spark.createDataFrame([(1, BASE), (2, "One!"), (3, None), (1, BASE)], "item_id bigint, text string")
    got = {str(r.doc_id): r for r in decontaminate.scan_hits(few(spark), bench).collect()}
    assert got["5"].hits == list(range(1, 21)) and got["5"].item_ids == ["1"]
    assert got["2"].item_ids == ["2"] and got["0"].n_words == 0 and not got["7"].hits
    kept = decontaminate.decontaminate(few(spark), bench)
    assert kept.columns == few(spark).columns and {r.doc_id for r in kept.collect()} == {0, 1, 7, 8}
    assert {r.text for r in decontaminate.decontaminate(few(spark), bench, remove="spans").where("doc_id = 4").collect()} == {" end"}


@pytest.mark.parametrize("block", [1_000_000, 40])
def test_hits_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block)
    rng = np.random.default_rng(5)
    word = lambda n: " ".join(rng.choice(["a", "B", "cé", "d4"], n))
    items = [(i, word(int(rng.integers(0, 25)))) for i in range(12)] + [(20, None), (21, "--"), (3, word(20)), (None, word(15))]
    texts = [word(int(rng.integers(0, 400))) for _ in range(20)] + [", ".join([word(30), items[5][1], word(9), items[5][1].upper()]), None, "", "x" * 100_000, word(60_000)]
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    owners = {}
    for i, t in items:
        w = words(t)
        k = min(13, len(w))
        for j in range(len(w) - k + 1 if k and i is not None else 0):
            owners.setdefault(tuple(w[j : j + k]), set()).add(str(i))
    got = {r.doc_id: r for r in decontaminate.scan_hits(docs(spark, [(i, t, None, None, None, None) for i, t in enumerate(texts)]), spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    for i, t in enumerate(texts):
        w, hits, found = words(t), set(), set()
        for k in {len(x) for x in owners}:
            for j in range(len(w) - k + 1):
                if own := owners.get(tuple(w[j : j + k])):
                    hits.update(range(j, j + k))
                    found |= own
        assert (got[i].n_words, got[i].hits, got[i].item_ids) == (len(w), sorted(hits), sorted(found))
    assert any(r.hits for r in got.values())


def fingerprint(text):
    w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    s = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints(spark):
    for r in simhash.fingerprints(few(spark)).join(few(spark).drop("fp"), "doc_id").collect():
        assert r.fp % 2**64 == fingerprint(r.text)


@pytest.mark.parametrize("bucket", [2, 64])
def test_components_equal_brute_force(spark, monkeypatch, bucket):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rng = np.random.default_rng(1)
    seeds = rng.integers(-(2**62), 2**62, 6)
    prints = list({int(s) ^ sum(1 << int(b) for b in rng.choice(62, rng.integers(0, 4), False)) for s in seeds for _ in range(40)})
    near = {(a, b) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= 2}
    root = {p: p for p in prints}
    for _ in prints:
        for a, b in near:
            root[a] = root[b] = min(root[a], root[b])
    df = spark.createDataFrame([(p,) for p in prints], "fp bigint")
    got = {r.node: r.root for r in simhash.components(simhash.links(df)).collect()}
    groups = lambda m: {frozenset(x for x in m if m[x] == v) for v in m.values()}
    assert near and groups({p: got.get(p, p) for p in prints}) == groups(root)


def test_mixing(spark):
    got = mixing.mix(few(spark), block=2).collect()
    assert len(got) == 11 and len({r.position for r in got}) == 11
    assert mixing.mix(few(spark).where("false")).count() == 0
    kept = mixing.mix(few(spark).withColumnRenamed("fp", "slot"), block=2, keep=True, bucket_rows=1)
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars", "source_row", "block", "slot", "position"]
    rows = kept.collect()
    assert sorted(map(str, (r.text for r in rows))) == sorted(str(r.text) for r in few(spark).collect()) and len({r.position for r in rows}) == 11


@pytest.mark.parametrize("n", [1, 3, 1500])
def test_pfair_keeps_target_weights_over_many_periods(n):
    weights = {"a": 2**0.5, "b": 1.0, "c": 5**0.5, "d": 0.0005} if n > 1 else {"a": 0.3}
    weights |= {f"s{i}": 0.001 + i * 1e-6 for i in range(n)} if n > 3 else {}
    total, met = sum(weights.values()), dict.fromkeys(weights, 0)
    exact = mixing.whole(weights)
    for t, (s, k) in enumerate(itertools.islice(mixing.pfair(exact), 20_000 if n > 3 else 200_000), 1):
        assert k == met[s]
        met[s] += 1
        if t % 997 == 0 or t < 3000:
            assert all(abs(met[x] - t * w / total) < 1 for x, w in weights.items())


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(2)
    sizes, trans = np.array([3, 1, 7, 4]), rng.normal(size=(2, 2))
    scores, weight = rng.normal(size=15) * 3, rng.random(15)
    good, pairs = quality.marginals(scores, sizes, trans, weight)
    at, want = 0, np.zeros((2, 2))
    for n in sizes:
        total, each, two = 0.0, np.zeros(n), np.zeros((2, 2))
        for labels in np.ndindex(*[2] * int(n)):
            w = np.exp(sum(scores[at + i] * labels[i] for i in range(n)) + sum(trans[labels[i], labels[i + 1]] for i in range(n - 1)))
            total += w
            each += w * np.array(labels)
            for i in range(n - 1):
                two[labels[i], labels[i + 1]] += w * weight[at + i + 1]
        assert np.allclose(good[at : at + n], each / total)
        want += two / total
        at += n
    assert np.allclose(pairs, want)


def test_gradient_climbs_the_likelihood():
    rng = np.random.default_rng(4)
    data = []
    for y in (0, 1) * 40:
        n = int(rng.integers(1, 9))
        own = rng.normal(size=(n, quality.OWN))
        own[:, 3] += 2 * y
        data.append((own, np.ones(n), y))
    model = quality.LineField().fit(data)
    assert model.w[3] > 0.3 and model.w[quality.OWN + 3] > 0.1 and model.w[2 * quality.OWN + 3] > 0.1 and model.trans[1, 1] > model.trans[0, 1]


def test_quality_of_very_long_and_odd_texts():
    model = quality.LineField().fit([(own, n, y) for y, t in ((1, "A good line.\nAnd more."), (0, "!!! ###\n$$$")) for own, n in quality.line_blocks(t)])
    long = "\n".join("A good line." if i % 3 else "!!! ###" for i in range(200_000))
    got = model.score([None, "", " \n", long, "x", long])
    assert len(got) == 6 and np.isfinite(got).all() and got[0] == got[1] == got[2] and got[3] == got[5]


def test_classifiers(spark):
    d = "/root/testdata/sf0.01"
    labels = {r.doc_id: r for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    for op, label, least in ((quality.op9_quality, "quality", 0.95), (toxicity.op2_toxicity, "toxic", 0.85)):
        held = [r for r in op(spark, d).collect() if r.held_out and r.doc_id in labels]
        assert np.mean([r.predicted == labels[r.doc_id][label] for r in held]) >= least
    m = toxicity.fit_toxicity(few(spark), spark.createDataFrame([], "doc_id bigint, toxic int, quality int"))
    assert toxicity.score_toxicity(few(spark), m).count() == 11
    q = quality.fit_quality(few(spark), spark.createDataFrame([], "doc_id bigint, toxic int, quality int"))
    assert quality.score_quality(few(spark), q).count() == 11


@pytest.mark.parametrize("version, size", [(1, 16 << 20), (2, 16 << 20), (None, 900)])
def test_warc_round_trip(spark, tmp_path, version, size):
    html = ["<p>é\n\n</p>", None, "", "<p>é\n\n</p>", "WARC/1.0\r\n\r\n x", "y" * 300_000, "<p>é\n\n</p>", "alone", "alone", "\0 z"]
    ids = [0, 1, 2, 3, 4, 5, None, None, None, 9]
    pages = spark.createDataFrame([(i, None if i == 4 else f"http://h/{i} x", h) for i, h in zip(ids, html)] + [(3, "http://h/again", html[3])], "page_id bigint, url string, html string").coalesce(1)
    warc.write_arcs(pages.withColumn("file", F.lit("clash")), f"{tmp_path}/arc", version, size)
    warc.convert_arcs(spark, f"{tmp_path}/arc", f"{tmp_path}/warc", file_bytes=size)
    got = warc.read_warcs(spark, f"{tmp_path}/warc").collect()
    kinds = sorted((str(r.page_id), r.record_type, str(r.refers_to)) for r in got)
    assert kinds == sorted([("0", "revisit", "3"), ("1", "revisit", "2"), ("2", "response", "None"), ("3", "response", "None"), ("3", "response", "None"), ("4", "response", "None"), ("5", "response", "None"), ("None", "revisit", "3"), ("None", "response", "None"), ("None", "response", "None"), ("9", "response", "None")])
    by = {r.page_id: r for r in got if r.page_id is not None}
    assert all(r.payload_bytes == len((html[i] or "").encode()) and r.payload in (None, html[i] or "") for i, r in by.items())
    assert by[0].refers_to_id in {r.record_id for r in got if r.page_id == 3} and len({r.record_id for r in got}) >= 9
    files = list((tmp_path / "warc").glob("*.txt"))
    assert all(list(warc.parse_warc(gzip.decompress(f.read_bytes())))[0][0]["WARC-Type"] == "warcinfo" for f in files) and (len(files) > 3) == (size == 900)
    arcs = [gzip.decompress(f.read_bytes()) for f in (tmp_path / "arc").glob("*.txt")]
    assert all(x.startswith(b"filedesc://") and x.count(b"filedesc://") == 1 for x in arcs)
    assert {int(x.split(b"\n")[1][:1]) for x in arcs} == ({version} if version else {1, 2})
    none = spark.createDataFrame([], "page_id bigint, url string, html string")
    warc.write_arcs(none, f"{tmp_path}/none/arc")
    warc.convert_arcs(spark, f"{tmp_path}/none/arc", f"{tmp_path}/none/warc")
    assert warc.read_warcs(spark, f"{tmp_path}/none/warc").count() == 0


def test_arc_versions_and_damage():
    body = b"HTTP/1.0 200 OK\r\n\r\nhi"
    for version, line in ((1, b"http://h 1.2.3.4 20010203040506 text/html %d"), (2, b"http://h 1.2.3.4 20010203040506 text/html 200 - - 0 f.arc %d")):
        data = warc.filedesc(version) + b"\n" + line % len(body) + b"\n" + body + b"\n"
        ((arc, block),) = warc.parse_arc(data)
        assert arc == {"url": "http://h", "ip": "1.2.3.4", "date": "20010203040506", "type": "text/html"} and block == body
    for bad in (b"http://h 0 1 text/html 99\nshort", b"no header line\n", warc.filedesc(2) + b"\nhttp://h 0 1 text/html 2\nhi"):
        with pytest.raises(ValueError):
            list(warc.parse_arc(bad))
    record = warc.warc_record(arc, b"HTTP/1.0 200 OK\r\n\r\n", b"hi", None)
    with pytest.raises(ValueError):
        list(warc.parse_warc(record.replace(b"hi", b"ho")))


def best_blocks(text, wordings, least=0.8):
    """Labels and best containments over all blocks of all paragraphs, one after another."""
    got = {}
    for p in re.split(r"\n[ \t\r\x0B\x0C]*\n", text or ""):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), p))
        for label, t in wordings:
            full, span = set(t.split()), 2 * len(t.split())
            for i in range(len(w)):
                share = len(full & set(w[i : i + span])) / len(full)
                if share >= least - 1e-9:
                    got[label] = max(got.get(label, 0), share)
    return got


def test_licenses(spark):
    words = licenses.WORDINGS[4][1].split()
    wrapped = "see below: " + " ".join(words[:7]) + "\n" + " ".join(words[7:13]) + "\n" + " ".join(words[13:]) + " and more"
    gpl = "This work is licensed under the GNU General Public License, version 3."
    cc = "This work is licensed under a\r\nCreative Commons Attribution-NonCommercial 4.0 International License."
    split = " ".join(words[:10]) + "\n \n" + " ".join(words[10:])
    scattered = " filler text that goes on and on with many words between them all so far apart ".join(words)
    texts = ["Under the MIT License", "cc-by-nc cc by nc", wrapped, "a\n" + gpl + "\nb", cc, split, "this work\nis a work", None, "", "plain words", scattered, "é " * 50_000 + gpl] + [gpl] * 40
    df = docs(spark, [(i, t, None, None, None, None) for i, t in enumerate(texts)]).withColumn("matches", F.lit("clash"))
    got = {r.doc_id: r for r in licenses.scan_licenses(df).collect()}
    assert len(got) == len(texts) and [(h.label, h.start) for h in got[1].hits] == [("cc-by-nc", 0), ("cc-by-nc", 3)]
    assert got[7].n_words == got[8].n_words == 0 and not got[5].matches and not got[10].matches
    assert [m.label for m in got[2].matches] == ["bsd"] and [m.label for m in got[11].matches] == ["gpl-3"] and got[50].matches[0].score == 1.0
    for i, t in enumerate(texts[:11]):
        assert {m.label: pytest.approx(m.score) for m in got[i].matches} == best_blocks(t, licenses.WORDINGS)
    assert licenses.scan_licenses(df.where("false")).count() == 0
    assert {tuple(r.matches) for r in licenses.scan_licenses(df, wordings=[]).collect()} == {()}


def test_license_join_loses_nothing(spark):
    rng = np.random.default_rng(8)
    word = lambda n, m: " ".join(f"w{int(x)}" for x in rng.zipf(1.3, n) % m)
    wordings = [(f"l{i % 40}", word(int(rng.integers(3, 12)), 60)) for i in range(150)]
    texts = [word(int(rng.integers(0, 120)), 60) + ("\n\n" if i % 3 else "\n") + word(int(rng.integers(0, 60)), 90) for i in range(60)]
    got = {r.doc_id: r.matches for r in licenses.scan_licenses(docs(spark, [(i, t, None, None, None, None) for i, t in enumerate(texts)]), wordings).collect()}
    want = [best_blocks(t, wordings) for t in texts]
    assert all({m.label: pytest.approx(m.score) for m in got[i]} == w for i, w in enumerate(want)) and 0 < sum(map(len, want)) < 60 * 40


URLS = ["http://A.org/x", "https://m.example.org/es/1", "example.org/es/", None, "http://example.com/de/?q=://", "http://xorg/a", "http://b.com/fr/2#f", "http://a..org/y", "://com/de/x", "http://com/deep", "http://e.com/de/" + "1/" * 5000, ""]


def by_rule(url, rules):
    """(host, path, rule) of one url."""
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [r for r in rules if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
    return host, path, max(fits, key=lambda r: (len(r), r), default=None)


@pytest.mark.parametrize("more", [0, 500])
def test_urls(spark, more):
    rules = urls.RULES | {f"h{i}.net/{i % 7}": "block" for i in range(more)}
    rows = URLS + [f"http://x.h{i}.net/{i % 5}/a" for i in range(0, more, 7)]
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(rows)] + [(0, URLS[0], "again"), (None, None, None)], "page_id bigint, url string, host string")
    got = urls.judge_urls(df, rules).collect()
    assert len(got) == len(rows) + 2 and sorted(r.page_id for r in got if r.page_id is not None)[:2] == [0, 0]
    for r in got:
        want = by_rule(rows[r.page_id] if r.page_id is not None else None, rules)
        assert (r.host, r.path, r.rule) == want and r.verdict == rules.get(r.rule, r.verdict) and r.verdict in ("allow", "block")
        assert (r.block_probability is None) == (r.rule is not None)
    assert urls.judge_urls(df.where("false")).count() == 0


def test_trees_learn_and_leave_out_the_own_label(spark):
    rng = np.random.default_rng(9)
    rows = [(f"http://{'x' * int(rng.integers(1, 9))}{i % 3}.info/{'7' * 12 if i % 2 else 'abc'}/{i if i % 2 else ''}", i % 2) for i in range(400)]
    labelled = spark.createDataFrame(rows, "url string, blocked int")
    pages = spark.createDataFrame([(i, f"http://new{i}.biz/{'7' * 12 + '/' + str(i) if i % 2 else 'abc/'}") for i in range(100)], "page_id bigint, url string")
    got = {r.page_id: r.verdict for r in urls.judge_urls(pages, labelled=labelled).collect()}
    assert sum(v == ("block" if i % 2 else "allow") for i, v in got.items()) >= 95
    # With labels by chance, nothing in the features tells them.
    noise = spark.createDataFrame([(f"http://s{i}.t{i}.info/p", int(rng.integers(0, 2))) for i in range(400)], "url string, blocked int")
    p = [r.block_probability for r in urls.judge_urls(spark.createDataFrame([(i, f"http://s{i}.t{i}.info/q") for i in range(400)], "page_id bigint, url string"), labelled=noise).collect()]
    assert np.std(p) < 0.2


def brute_neighbours(x, ids, q, of, k=10):
    d = np.sqrt(((x - of) ** 2).sum(1))
    return [(int(ids[i]), d[i]) for i in np.lexsort((ids, d)) if ids[i] != q][:k]


@pytest.mark.parametrize("dims, shard", [(16, 800), (64, 500)])
def test_neighbours_recall_and_ties(spark, monkeypatch, dims, shard):
    monkeypatch.setattr(neighbours, "QUERY_BYTES", 2000)  # several groups of queries
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, dims)).round(3)
    x[1000:1200] = x[999]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5100, [0.0] * dims), (5200, [float("nan")] * dims), (5300, [1.0, None])]
    df = neighbours.valid(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"))
    index = neighbours.build_index(df, 11, shard=shard)
    assert index.count() >= 3 and index.select(F.spark_partition_id()).distinct().count() == index.count()
    got = neighbours.search(df.where("vec_id % 100 = 0"), index).toPandas()
    hit = 0
    for q, g in got.groupby("query_id"):
        want = brute_neighbours(x, np.arange(3000), q, x[q])
        hit += len({i for i, _ in want} & set(g.vec_id))
        assert np.allclose(g.sort_values("rank").score, np.sqrt(((x[g.sort_values("rank").vec_id] - x[q]) ** 2).sum(1)), rtol=1e-12)
    assert got.query_id.nunique() == 30 and hit / 300 >= 0.9
    assert got[got.query_id == 1100].sort_values("rank").vec_id.tolist() == list(range(999, 1009))


def test_neighbours_of_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (100, [0.0, 2.0]), (1, [1.0, 1.0]), (1, [1.0, 0.5]), (2, [3.0, 3.0, 3.0]), (200, [1.0, 1.0, 1.0]), (3, [1.0, 0.0]), (0, [5.0, 5.0]), (None, [1.0, 0.0]), (300, [])]
    df = neighbours.valid(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"))
    got = neighbours.search(df.where("vec_id % 100 = 0"), neighbours.build_index(df, 11)).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in got] == [(0, 1, 3), (0, 2, 1), (0, 3, 100), (100, 1, 1), (100, 2, 0), (100, 3, 3), (200, 1, 2)]
    assert got[1].score == 0.5
    none = df.where("false")
    assert neighbours.search(none, neighbours.build_index(none, 11)).count() == 0 and neighbours.search(none, neighbours.build_index(df, 11)).count() == 0


def test_keep_one_links_similarity_of_four_fifths(spark):
    words = [f"w{i}" for i in range(300)]
    far = [*words[:50], *[f"x{i}" for i in range(60)], *words[110:]]
    edit = lambda places: " ".join("new" if i in places else w for i, w in enumerate(words))
    texts = [edit(()), edit((100, 200)), edit((20, 70, 150, 220, 280)), " ".join(far), None, "", "one", "ONE"]
    got = near.keep_one(docs(spark, [(i, t, None, None, None, None) for i, t in enumerate(texts)]))
    assert sorted(r.doc_id for r in got.collect()) == [0, 3, 4, 6]


@pytest.mark.parametrize("bucket", [64, 2])
def test_near_links_equal_brute_force(spark, monkeypatch, bucket):
    monkeypatch.setattr(near.groups, "__defaults__", (bucket,))
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    sets = {}
    for r in d.collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text or ""))
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    want = {x: x for x in sets}
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if min(len(x), len(y)) >= 0.8 * max(len(x), len(y)) and len(x & y) >= 0.8 * len(x | y):
                old, new = sorted((want[a], want[b]), reverse=True)
                want = {k: new if v == old else v for k, v in want.items()} if old != new else want
    kept = {r.doc_id for r in near.keep_one(d).collect()}
    assert kept == set(want.values()) and len(kept) < len(ids)


@pytest.mark.parametrize("others", [9, 19, 200])
def test_mixing_keeps_the_given_weights(spark, monkeypatch, others):
    monkeypatch.setattr(mixing, "BATCH", 700)
    monkeypatch.setattr(mixing, "SUPER", 4)
    weights = {"a": Fraction(1, 2)} | {f"s{i}": Fraction(1, 2 * others) for i in range(others)}
    met = dict.fromkeys(weights, 0)
    for t, (s, k) in enumerate(itertools.islice(mixing.pfair(mixing.whole(weights)), 3000), 1):
        assert k == met[s]
        met[s] += 1
        assert all(abs(met[x] - t * w) < 1 for x, w in weights.items())
    rows = [(i, "x", None, "a" if i % 2 else f"s{i // 2 % others}", 1, None) for i in range(4000)]
    for given in (weights, None, {s: float(w) ** 0.7 for s, w in weights.items()}):
        got = sorted((r.slot, r.source, r.block) for r in mixing.mix(docs(spark, rows), given, block=1, bucket_rows=100).collect())
        shares = mixing.whole(given or {s: n**0.5 for s, n in [("a", 2000), *[(f"s{i}", len(range(i, 2000, others))) for i in range(others)]]})
        want = {(s, k): t for t, (s, k) in enumerate(itertools.islice(mixing.pfair(shares), 200_000))}
        assert len(got) == 4000 and all(t == want[s, k] for t, s, k in got)


def test_clouds_of_near_copies_are_whole(spark):
    """Chains of copies of copies, where no leader is similar to all; and texts that share a frame alone."""
    rng = np.random.default_rng(14)
    words, texts = [f"w{i}" for i in range(120)], []
    for i in range(150):
        words[int(rng.integers(0, 120))] = f"n{i}"
        texts.append(" ".join(words))
    frame = " ".join(f"f{i}" for i in range(80))
    texts += [frame + " " + " ".join(f"u{i}x{j}" for j in range(40)) for i in range(100)]
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(texts)), 2):
        if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
            a, b = sorted((find(i), find(j)))
            root[b] = a
    got = {r.doc_id for r in near.keep_one(docs(spark, [(i, t, None, None, None, None) for i, t in enumerate(texts)])).collect()}
    assert got == {find(i) for i in range(len(texts))} and len(got) < 150


def test_keep_one_judges_repeated_ids_by_row(spark):
    other = BASE.replace("a", "o")
    rows = [(1, BASE), (2, BASE + " end"), (2, other), (2, other), (3, "one of a kind"), (3, "of another kind"), (None, BASE)]
    got = near.keep_one(docs(spark, [(i, t, None, None, None, None) for i, t in rows])).collect()
    assert sorted((r.doc_id or 0, r.text) for r in got) == sorted([(0, BASE), (1, BASE), (2, other), (3, "one of a kind"), (3, "of another kind")])


def test_quality_fit_reads_every_line(spark):
    text = "\n".join(f"line {i}" for i in range(9000))
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([text]), pa.array([1]), pa.array([0])], names=["doc_id", "text", "y", "place"])
    (got,) = quality._features([batch])
    assert len(got[0][0].as_py()) == 9000 * quality.OWN * 4 and got[3][0].as_py() == 9000


def test_training_rows_are_one_a_document(spark):
    df = docs(spark, [(i % 7 or None, f"text {i}", None, None, None, None) for i in range(100)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 7)] + [(3, None), (None, 1), (4, 1)], "doc_id bigint, y int")
    got = common.training_rows(df, labels, "y", 1, 5, 4).collect()
    assert len(got) == 4 and sorted(r.place for r in got) == [0, 1, 2, 3] and all(r.y == 1 for r in got if r.doc_id == 4)


def test_simhash_broadcasts_no_table_that_grows(spark, monkeypatch):
    """At the planner's own limits each of these small tables would be broadcast from the driver."""
    from granary.llm import simhash

    plans, real = [], simhash.cut

    def seen(df):
        df.collect()
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df)

    monkeypatch.setattr(simhash, "cut", seen)
    docs = spark.createDataFrame([(i, f"w{i % 40 // 2} is here with {'a few words more ' * 30} {i % 40}") for i in range(120)], "doc_id bigint, text string")
    got = simhash.near_duplicates(docs)
    assert got.where("component_id < doc_id").count() >= 80
    seen(got)
    assert sum("Join" in p for p in plans) >= 3 and not any("Broadcast" in p for p in plans)


@pytest.mark.parametrize("bucket, halves", [(1 << 20, 4), (2, 1), (2, 0)])
def test_simhash_half_keys_lose_no_link(spark, monkeypatch, bucket, halves):
    """Every way to turn one or two bits, by half keys, by the whole chain's keys, and by values within one bit of both."""
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    monkeypatch.setattr(simhash, "HALVES", halves)
    base = 0x1234_5678_9ABC_DEF0
    turned = np.array([base ^ (1 << i) ^ (1 << j if j < i else 0) for i in range(64) for j in range(i + 1)] + [base], np.uint64)
    prints = np.unique(turned.view(np.int64))
    got = {(r.a, r.b) for r in simhash.links(spark.createDataFrame([(int(x),) for x in prints], "fp bigint")).collect()}
    far = np.bitwise_count((prints[:, None] ^ prints[None, :]).view(np.uint64))
    want = {(int(prints[i]), int(prints[j])) for i, j in zip(*np.nonzero(far <= 2)) if i < j}
    assert len(prints) == 2081 and got <= want
    assert got == want if bucket > 2 else len({r.root for r in simhash.components(spark.createDataFrame(sorted(got), "a bigint, b bigint")).collect()}) == 1


def test_simhash_shuffles_few_rows_a_fingerprint(spark):
    """Of fingerprints that link with nothing, six keys are moved for each."""
    sc = spark.sparkContext

    def moved():
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    rng = np.random.default_rng(14)
    prints = spark.createDataFrame([(int(x),) for x in rng.integers(-(2**63), 2**63 - 1, 3000)], "fp bigint")
    before = moved()
    assert simhash.links(prints).collect() == []
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    assert 6 * 3000 <= moved() - before < 7 * 3000


def test_substring_texts_travel_packed(spark):
    """What is moved to the windows is under two thirds of a prose; null and empty texts come back as they are."""
    words = [f"{a}{b}" for a in ("river", "stone", "quiet", "market", "after") for b in ("", "s", "ing", "ed", "ly", "less")]
    pick = random.Random(4)
    texts = [" ".join(pick.choice(words) for _ in range(300)) for _ in range(20)] + ["", None, "é 😀".encode("utf-16", "surrogatepass").decode("utf-16")]
    for t in filter(None, texts):
        assert substrings.unpack(substrings.pack(t.encode())) == t.encode()
    assert sum(len(substrings.pack(t.encode())) for t in texts[:20]) < sum(map(len, texts[:20])) * 2 / 3
    docs = spark.createDataFrame([(i, t, i * 2) for i, t in enumerate(texts + texts[:1])], "doc_id bigint, text string, more int")
    got = {r.doc_id: (r.text, r.more) for r in substrings.dedup_substrings(docs).collect()}
    assert got == {**{i: (t, i * 2) for i, t in enumerate(texts)}, 23: ("", 46)}
