"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A text's features are the distinct n-grams (GRAMS bytes long, ASCII lower case, spaces folded, padded with a space at
both ends), hashed to a number of places. r = log((p / |p|) / (q / |q|)) of smoothed counts in toxic and other texts
scales them; a logistic fit with L2 weighs the scaled features. Only features whose shares in the two classes differ by some
standard errors take part, so the bulk of a long text adds nothing and whole texts of any length can be scored.

How many standard errors and how many places is chosen at every fit by cross-validation among the training rows alone (GRID,
FOLDS parts by the rows' order, smallest mean log loss); held-out rows have no part in it.

The fit takes at most MOST labelled documents (by a hash of the id). Counts of features are aggregated in executors; the
driver gets a row for each feature that may take part (at most as many as places), and each training text's features
among them. Scoring reads whole texts, in pieces. Null and empty texts have no n-gram and score by the intercept; rows
that repeat get equal scores. With no labelled text, or one class only, every score is the (smoothed) share.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import cut, in_fold, rolling, table, training_rows

MOST, GRAMS, BASE, PIECE = 6000, (4, 6), 0x9E3779B97F4A7C15, 1 << 20
#: Places (as a power of 2) and least standard errors that the fit chooses from; the parts of the cross-validation.
GRID, FOLDS = tuple((bits, z) for bits in (18, 20) for z in (3.0, 4.0, 5.0, 6.0)), 4
#: A feature counts when so many texts have it; the weights' penalty.
LEAST_TEXTS, L2 = 4, 1e-3
BITS = max(bits for bits, _ in GRID)
FOLD = bytes(c + 32 if 65 <= c <= 90 else 32 if c <= 47 or 58 <= c <= 64 or 91 <= c <= 96 or 123 <= c <= 127 else c for c in range(256))
SPACES = re.compile(rb" +")


def places(text: str | None, bits: int):
    """Arrays of feature places (with repeats) of one piece of the text after another."""
    if not text:
        return
    data = b" " + SPACES.sub(b" ", text.encode("utf-8", "surrogatepass").translate(FOLD)) + b" "
    codes = np.frombuffer(data, np.uint8)
    for start in range(0, len(codes), PIECE):
        for n in GRAMS:
            h = rolling(codes[start : start + PIECE + n - 1] + np.uint64(1), n, BASE)
            yield ((h * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(64 - bits)).astype(np.int32)


def grams(text: str | None, bits: int = BITS) -> np.ndarray:
    """Sorted distinct feature places."""
    mark = np.zeros(1 << bits, bool)
    for p in places(text, bits):
        mark[p] = True
    return np.flatnonzero(mark).astype(np.int32)


def errors(pos, neg, ones, zeros):
    """By how many standard errors the shares of two classes differ."""
    both = (pos + neg) / (ones + zeros)
    return (pos / ones - neg / zeros) / np.sqrt(both * (1 - both) * (1 / ones + 1 / zeros) + 1e-12)


def logistic(own: list[np.ndarray], y: np.ndarray, r: np.ndarray, steps: int = 150) -> tuple[np.ndarray, float]:
    """Weights and intercept of texts with features ``own`` (indices into r), each of value r."""
    share = (y.sum() + 1) / (len(y) + 2)
    x, of = np.concatenate([np.empty(0, np.int64), *own]).astype(np.int64), np.repeat(np.arange(len(own)), [len(p) for p in own])
    scale = r[x]
    w, b, m, v = np.zeros(len(r)), float(np.log(share / (1 - share))), np.zeros(len(r) + 1), np.zeros(len(r) + 1)
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(of, w[x] * scale, len(y)) + b, -50, 50)))
        g = np.append(np.bincount(x, (p - y)[of] * scale, len(r)) / len(y) + L2 * w, (p - y).mean())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
        # A weight below zero would turn a feature against its own ratio.
        w, b = np.maximum(w - step[:-1], 0), b - step[-1]
    return w, b


class RatioModel:
    """Weights by place; plain arrays, so it can be sent to the executors."""

    def __init__(self, bits: int, kept: np.ndarray, weights: np.ndarray, bias: float):
        self.bits, self.bias = bits, float(bias)
        self.w, self.live = np.zeros(1 << bits, np.float32), np.zeros(1 << bits, bool)
        self.w[kept], self.live[kept] = weights, weights != 0

    def score(self, text: str | None) -> float:
        found = [p[self.live[p]] for p in places(text, self.bits)]
        total = self.w[np.unique(np.concatenate(found))].sum(dtype=np.float64) if found else 0.0
        return float(1 / (1 + np.exp(-np.clip(total + self.bias, -50, 50))))


class Candidates:
    """Counts (features x parts x classes) of the features of one number of places, and the texts' features among them."""

    def __init__(self, places: np.ndarray, counts: np.ndarray, texts: list[np.ndarray], y: np.ndarray, part: np.ndarray):
        self.places, self.counts, self.y, self.part = places, counts, y, part
        self.texts = [np.searchsorted(places, t) for t in texts]

    def fit(self, least_z: float, without: int | None = None):
        """(kept features, their ratios times weights, intercept), of all rows or of those outside one part."""
        use = np.ones(len(self.y), bool) if without is None else self.part != without
        y = self.y[use]
        ones, zeros = y.sum(), len(y) - y.sum()
        if not ones or not zeros:
            return None
        counts = self.counts.sum(1) if without is None else self.counts.sum(1) - self.counts[:, without]
        neg, pos = counts[:, 0], counts[:, 1]
        kept = np.flatnonzero((np.abs(errors(pos, neg, ones, zeros)) >= least_z) & (pos + neg >= LEAST_TEXTS))
        r = np.log((pos[kept] + 1) / (ones + 2)) - np.log((neg[kept] + 1) / (zeros + 2))
        at = np.full(len(self.places), -1)
        at[kept] = np.arange(len(kept))
        w, b = logistic([(p := at[t])[p >= 0] for t, u in zip(self.texts, use) if u], y, r)
        return kept, w * r, b

    def loss(self, least_z: float) -> float:
        """Mean log loss of each part by a fit to the others."""
        total = []
        for f in range(FOLDS):
            got, own = self.fit(least_z, f), self.part == f
            if got is None:
                continue
            w = np.zeros(len(self.places))
            w[got[0]] = got[1]
            z = np.array([w[t].sum() for t, u in zip(self.texts, own) if u]) + got[2]
            total += np.logaddexp(0, np.where(self.y[own] > 0, -z, z)).tolist()
        return float(np.mean(total)) if total else np.inf


def _features(batches):
    for b in batches:
        bits = sorted({x for x, _ in GRID})
        found = [(k, grams(t, k).tolist(), int(y > 0), p, p % FOLDS) for t, y, p in zip(b[1].to_pylist(), b[2].to_pylist(), b[3].to_pylist()) for k in bits]
        kinds = (pa.int32(), pa.list_(pa.int32()), pa.int32(), pa.int64(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)] if found else [pa.array([], k) for k in kinds], names=["bits", "grams", "y", "place", "part"])


def _among(shared):
    def run(batches):
        for b in batches:
            live = shared.value
            got = [np.asarray(g.values, np.int32) for g in b[1]]
            own = [g[live[k][g]].tobytes() for k, g in zip(b[0].to_pylist(), got)]
            yield pa.RecordBatch.from_arrays([b[0], pa.array(own, pa.binary()), b[2], b[3], b[4]], names=["bits", "f", "y", "place", "part"])

    return run


def candidates(rows: DataFrame) -> dict[int, Candidates]:
    """rows: _features of the training texts. Only features that some part of the grid can keep are gathered."""
    each = [F.count_if((F.col("part") == f) & (F.col("y") == y)).alias(f"n{f}_{y}") for f in range(FOLDS) for y in (0, 1)]
    sizes = {(r.part, r.y): r.n for r in rows.where(F.col("bits") == BITS).groupBy("part", "y").agg(F.count("*").alias("n")).collect()}
    total = [np.array([sizes.get((f, y), 0) for f in range(FOLDS)]) for y in (0, 1)]
    counts = rows.select("bits", "part", "y", F.explode("grams").alias("place")).groupBy("bits", "place").agg(*each)
    least = min(z for _, z in GRID)
    tests = [errors_column(None, total)] + [errors_column(f, total) for f in range(FOLDS)]
    wanted = F.lit(False)
    for t in tests:
        wanted = wanted | (F.coalesce(F.abs(t), F.lit(0.0)) >= least)
    enough = sum((F.col(f"n{f}_{y}") for f in range(FOLDS) for y in (0, 1)), F.lit(0)) >= LEAST_TEXTS
    found = counts.where(enough & wanted).toPandas().sort_values(["bits", "place"])
    bits = sorted({x for x, _ in GRID})
    live = {k: np.zeros(1 << k, bool) for k in bits}
    for k in bits:
        live[k][found.place[found.bits == k].to_numpy()] = True
    own = sorted(rows.mapInArrow(_among(rows.sparkSession.sparkContext.broadcast(live)), "bits int, f binary, y int, place bigint, part int").collect(), key=lambda r: r.place)
    out = {}
    for k in bits:
        mine, texts = found[found.bits == k], [r for r in own if r.bits == k]
        shaped = mine[[f"n{f}_{y}" for f in range(FOLDS) for y in (0, 1)]].to_numpy(np.float64).reshape(-1, FOLDS, 2)
        out[k] = Candidates(mine.place.to_numpy(), shaped, [np.frombuffer(r.f, np.int32) for r in texts], np.array([float(r.y) for r in texts]), np.array([r.part for r in texts]))
    return out


def errors_column(without: int | None, total):
    """``errors`` of the counts outside one part, as a column."""
    parts = [f for f in range(FOLDS) if f != without]
    zeros, ones = (float(sum(total[y][f] for f in parts)) for y in (0, 1))
    neg, pos = (sum((F.col(f"n{f}_{y}") for f in parts), F.lit(0.0)) for y in (0, 1))
    if not ones or not zeros:
        return F.lit(0.0)
    both = (pos + neg) / (ones + zeros)
    return (pos / ones - neg / zeros) / F.sqrt(both * (1 - both) * (1 / ones + 1 / zeros) + 1e-12)


def fit_toxicity(docs: DataFrame, labels: DataFrame, most: int = MOST) -> RatioModel:
    rows = cut(training_rows(docs, labels, "toxic", 4, 2, most).mapInArrow(_features, "bits int, grams array<int>, y int, place bigint, part int"))
    sets = candidates(rows)
    y = sets[BITS].y
    share = (y.sum() + 1) / (len(y) + 2)
    if not y.sum() or y.sum() == len(y):
        return RatioModel(BITS, np.empty(0, int), np.empty(0), np.log(share / (1 - share)))
    bits, z = min(GRID, key=lambda g: sets[g[0]].loss(g[1]))
    kept, weights, bias = sets[bits].fit(z)
    return RatioModel(bits, sets[bits].places[kept], weights, bias)


def score_toxicity(docs: DataFrame, model: RatioModel) -> DataFrame:
    """(doc_id, toxicity), a row for each of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b[0], pa.array([shared.value.score(t.as_py()) for t in b[1]], pa.float64())], names=["doc_id", "toxicity"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, toxicity double")


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    got = score_toxicity(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))
    return got.select("doc_id", in_fold("doc_id", 4, 2).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.3).cast("int").alias("predicted"))
