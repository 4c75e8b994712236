"""Quality: a linear-chain conditional random field over a document's lines.

Every line is good or bad. A line's features are its own and its neighbours' (the line before and after); the chain
adds weights for two neighbouring labels. The field is fitted by maximum likelihood with each labelled document's
quality as the label of its lines. A document's quality is the mean of its lines' forward-backward marginals,
weighted by their lengths, set to the labels' scale by a logistic curve fitted on the same documents. Forward and backward
messages are prefix products of 2 x 2 matrices, taken for all lines at once in as many steps as the longest text's lines have
binary digits, so one very long text costs no more than its lines do.

The fit takes the features of all lines of labelled documents to the driver, at most MOST documents with MOST_LINES lines together,
chosen by a hash of the id (a document is taken whole or not at all; of rows that repeat an id one trains). Scoring reads
every line of every text. Texts without a line (null, empty, blank) count as one empty line; repeated rows get equal scores.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import appended, cut, in_fold, table, training_rows

MOST, MOST_LINES, GROUP, BLOCK = 6000, 400_000, 100_000, 8192
UPPER = bytes(range(65, 91))
DIGIT = bytes(range(48, 58))
SPACE = b" \t\r\x0b\x0c"
COMMON = bytes([*range(48, 58), *range(65, 91), *range(97, 123), *b" .,\t\r", *range(128, 256)])
OWN = 13


def line_blocks(text: str | None):
    """(lines x OWN features, line lengths in bytes, at least 1) of BLOCK lines after another."""
    data = (text or "").encode("utf-8", "surrogatepass")
    lines = [x for x in data.split(b"\n") if x.strip()] or [b""]
    seen: dict[bytes, int] = {}
    for start in range(0, len(lines), BLOCK):
        rows = []
        for line in lines[start : start + BLOCK]:
            n = len(line) or 1
            words = line.split()
            count = len(words) or 1
            odd = len(line.translate(None, COMMON))
            before = seen.get(line, 0)
            seen[line] = before + 1
            rows.append((
                (n - len(line.translate(None, UPPER))) / n, (n - len(line.translate(None, DIGIT))) / n, odd / n, odd > 0,
                min(odd / count, 4.0), min(line.count(b"!") / count, 2.0), min(line.count(b"|") / count, 1.0), len(line.translate(None, SPACE)) / count,
                count, before, len(set(words)) / count, line.rstrip().endswith((b".", b"?")), n,
            ))
        out = np.array(rows, np.float64)
        out[:, 7] = np.minimum(out[:, 7], 30) / 10
        out[:, 8:10] = np.log1p(out[:, 8:10])
        lengths = out[:, 12].copy()
        out[:, 12] = np.log1p(lengths)
        yield out, lengths


def marginals(scores: np.ndarray, sizes: np.ndarray, trans: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """P(good) of every line of chains laid end to end, and the expected counts of label pairs (each line's pair with the line
    before it, times the line's weight).

    scores: a line's log-odds of good. trans[a, b]: weight of label b after a."""
    starts = np.cumsum(sizes) - sizes
    place = np.arange(len(scores)) - np.repeat(starts, sizes)
    rest = np.repeat(sizes, sizes) - 1 - place
    u1 = 1 / (1 + np.exp(-np.clip(scores, -300, 300)))
    unary = np.stack([1 - u1, u1], 1) + 1e-300
    step = np.exp(trans - trans.max())
    fwd = unary[:, None, :] * step
    fwd[starts] = unary[starts][:, None, :]
    bwd = np.ones_like(fwd)
    inner = np.flatnonzero(rest > 0)
    bwd[inner] = unary[inner + 1][:, None, :] * step
    alpha = _products(fwd, place, -1)[:, 0, :]
    beta = _products(bwd, rest, 1)[:, :, 0]
    both = alpha * beta
    good = both[:, 1] / both.sum(1)
    at = np.flatnonzero(place > 0)
    pair = alpha[at - 1][:, :, None] * step * (unary[at] * beta[at])[:, None, :]
    pair /= pair.sum((1, 2), keepdims=True)
    return good, (pair if weight is None else pair * weight[at][:, None, None]).sum(0)


def _products(m: np.ndarray, reach: np.ndarray, side: int) -> np.ndarray:
    """Products of each line's matrix with all those of its chain before it (side -1) or after it (1); reach: how many these
    are. Scaled to sum to 1; each round doubles the span."""
    m = m / m.sum((1, 2), keepdims=True)
    span, at = 1, np.flatnonzero(reach >= 1)
    while len(at):
        near, far = m[at], m[at + side * span]
        x, y = (far, near) if side < 0 else (near, far)
        out = np.empty_like(near)
        for i in range(2):
            for j in range(2):
                out[:, i, j] = x[:, i, 0] * y[:, 0, j] + x[:, i, 1] * y[:, 1, j]
        m[at] = out / (out.sum((1, 2), keepdims=True) + 1e-300)
        span *= 2
        at = at[reach[at] >= span]
    return m


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -700, 700)))


class LineField:
    """Fitted weights; plain arrays, so it can be sent to the executors. w: a line's own features, those of the line before and
    after, first line, last line, constant."""

    def fit(self, docs: list[tuple[np.ndarray, np.ndarray, int]], steps: int = 120) -> LineField:
        own = np.vstack([d[0] for d in docs]) if docs else np.zeros((1, OWN))
        self.mean, self.std = own.mean(0), own.std(0) + 1e-6
        self.trans, self.curve = np.zeros((2, 2)), (1.0, 0.0)
        self.w = np.zeros(3 * OWN + 3)
        if not docs:
            return self
        sizes = np.array([len(d[0]) for d in docs])
        starts = np.cumsum(sizes) - sizes
        normal = (own - self.mean) / self.std
        y = np.repeat([float(d[2]) for d in docs], sizes)
        # Each document counts alike, however many lines it has.
        weight = np.repeat(1 / sizes, sizes)
        theta, m, v = np.zeros(len(self.w) + 4), 0.0, 0.0
        same = np.zeros((2, 2))
        labels = np.array([int(d[2]) for d in docs])
        np.add.at(same, (labels, labels), (sizes - 1) / sizes)
        for t in range(1, steps + 1):
            self.w, self.trans = theta[:-4], theta[-4:].reshape(2, 2)
            p, q = marginals(self._joined(self._parts(normal), sizes), sizes, self.trans, weight)
            e = (y - p) * weight
            after, before = np.append(e[1:], 0.0), np.append(0.0, e[:-1])
            after[starts[1:] - 1] = after[-1:] = 0
            before[starts] = 0
            gw = np.concatenate([normal.T @ e, normal.T @ after, normal.T @ before, [e[starts].sum(), e[starts + sizes - 1].sum(), e.sum()]])
            g = np.concatenate([gw, (same - q).ravel()]) / len(docs) - 1e-3 * theta
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            theta = theta + 0.08 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        self.w, self.trans = theta[:-4], theta[-4:].reshape(2, 2)
        means = self._means(self._parts(normal), sizes, np.concatenate([d[1] for d in docs]))
        a, b, truth = 1.0, 0.0, np.array([float(d[2]) for d in docs])
        odds = np.log((means + 1e-4) / (1 - means + 1e-4))
        for _ in range(30):  # Newton steps, slightly damped
            p = sigmoid(a * odds + b)
            s = p * (1 - p) + 1e-6
            h = np.array([[np.sum(s * odds * odds) + 1e-3, np.sum(s * odds)], [np.sum(s * odds), np.sum(s) + 1e-3]])
            a, b = np.array([a, b]) + np.linalg.solve(h, [np.sum((truth - p) * odds), np.sum(truth - p)])
        self.curve = (float(max(a, 1e-3)), float(b))
        return self

    def _parts(self, normal: np.ndarray) -> np.ndarray:
        """What each line adds to its own score, to the next line's and to the one's before (lines x 3)."""
        return normal @ self.w[: 3 * OWN].reshape(3, OWN).T

    def _joined(self, parts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The lines' scores out of _parts."""
        starts = np.cumsum(sizes) - sizes
        ends = starts + sizes - 1
        from_before, from_after = np.append(0.0, parts[:-1, 1]), np.append(parts[1:, 2], 0.0)
        from_before[starts] = 0
        from_after[ends] = 0
        out = parts[:, 0] + from_before + from_after + self.w[3 * OWN + 2]
        out[starts] += self.w[3 * OWN]
        out[ends] += self.w[3 * OWN + 1]
        return out

    def _means(self, parts: np.ndarray, sizes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        good, _ = marginals(self._joined(parts, sizes), sizes, self.trans)
        starts = np.cumsum(sizes) - sizes
        return np.add.reduceat(good * lengths, starts) / np.add.reduceat(lengths, starts)

    def score(self, texts) -> np.ndarray:
        """Scores of texts; of each line only three sums are kept, and texts are taken together up to GROUP lines."""
        out, parts, lengths, sizes = [], [], [], []

        def flush():
            if sizes:
                means = self._means(np.vstack(parts), np.array(sizes), np.concatenate(lengths))
                out.append(sigmoid(self.curve[0] * np.log((means + 1e-4) / (1 - means + 1e-4)) + self.curve[1]))
            parts.clear(), lengths.clear(), sizes.clear()

        for t in texts:
            n = 0
            for own, size in line_blocks(t):
                parts.append(self._parts((own - self.mean) / self.std))
                lengths.append(size)
                n += len(own)
            sizes.append(n)
            if sum(map(len, lengths)) >= GROUP or len(sizes) >= 2048:
                flush()
        flush()
        return np.concatenate(out) if out else np.empty(0)


def _features(batches):
    for b in batches:
        found = [np.vstack([own for own, _ in line_blocks(t)]) for t in b[1].to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([f.astype(np.float32).tobytes() for f in found], pa.binary()), b[2].cast(pa.int32()), b[3], pa.array([len(f) for f in found], pa.int64())], names=["f", "y", "place", "n"]
        )


def fit_quality(docs: DataFrame, labels: DataFrame, most: int = MOST, most_lines: int = MOST_LINES) -> LineField:
    rows = cut(training_rows(docs, labels, "quality", 5, 0, most).mapInArrow(_features, "f binary, y int, place bigint, n bigint"))
    kept, lines = [], 0
    for r in sorted(rows.select("place", "n").collect()):  # at most ``most`` rows
        if lines + r.n <= most_lines:
            kept.append(r.place)
            lines += r.n
    parsed = sorted((bytes(r.f), r.y) for r in rows.where(F.col("place").isin(kept)).select("f", "y").collect()) if kept else []  # an order of its own: the same model at every run
    got = [(f := np.frombuffer(x, np.float32).reshape(-1, OWN).astype(np.float64), np.expm1(f[:, 12]), int(y > 0)) for x, y in parsed]
    return LineField().fit(got)


def score_quality(docs: DataFrame, model: LineField, out: str = "quality_score") -> DataFrame:
    """The rows with a column ``out``, in place of an input column of that name; all others stay."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches):
        for b in batches:
            cols = [*b.columns, pa.array(shared.value.score(b[at].to_pylist()), pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, names=[f"c{i}" for i in range(len(cols))])

    return appended(docs, run, f"{out} double")


def op9_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = score_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")))
    return got.select("doc_id", in_fold("doc_id", 5, 0).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.3).cast("int").alias("predicted"))
