"""Document quality by a linear-chain conditional random field over lines.

Every line gets a state, bad or good, from features of itself and of its
neighbours.  Forward-backward marginals, weighted by line length, and a logistic
calibration make the score of a document.  The model is fitted on at most
``TRAIN_DOCS`` labelled documents, whose line features alone reach the driver;
scoring is one map over all documents.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_bytes

#: Bound of the sample of labelled rows that the model is fitted on: those of least hash.
TRAIN_DOCS = 4000
#: Lines of a training document that are used: one run of neighbours, its place drawn by a hash of the text.
TRAIN_LINES = 200
OWN = 12
WIDTH = 1 + 3 * OWN
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_DIGIT = bytes(range(48, 58))
_MARKS = b"#*$%&|<>{}[]\\^~=_@"


def _without(line: bytes, chars: bytes) -> int:
    return len(line) - len(line.translate(None, chars))


def line_features(line: bytes, seen: set[bytes]) -> tuple[float, ...]:
    """Twelve numbers between 0 and 1 (mostly), of one line; ``seen`` holds the lines before it."""
    words = line.split()
    n, size = len(words), max(1, len(line))
    upper, lower = _without(line, _UPPER), _without(line, _LOWER)
    again = float(n > 0 and line in seen)
    seen.add(line)
    if not n:
        return (0.0,) * 10 + (1.0, 0.0)
    return (
        min(1.0, 8 * _without(line, _MARKS) / size),
        upper / max(1, upper + lower),
        min(1.0, 4 * line.count(b"!") / n),
        min(1.0, 4 * _without(line, _DIGIT) / size),
        1 - len(set(words)) / n if n > 8 else 0.0,
        sum(map(eq, words, words[1:])) / n,
        min(1.0, line.count(b"|") / n),
        min(1.0, n / 40),
        min(2.0, size / n / 8),
        again,
        0.0,
        float(words[-1][-1:] in b".!?:;,"),
    )


def document_features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Features by (line, WIDTH), with those of the neighbours, and line weights."""
    lines, seen = text.split(b"\n"), set()
    own = np.array([line_features(x, seen) for x in lines])
    x = np.zeros((len(lines), WIDTH))
    x[:, 0] = 1
    x[:, 1 : 1 + OWN] = own
    x[1:, 1 + OWN : 1 + 2 * OWN] = own[:-1]
    x[:-1, 1 + 2 * OWN :] = own[1:]
    return x, np.array([len(line) + 1.0 for line in lines])


def marginals(unary: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """P(line is good) by forward-backward.  ``unary``: score of good over bad; ``pair``: 2 x 2 scores."""
    n = len(unary)
    move = np.exp(pair - pair.max())
    (m00, m01), (m10, m11) = move.tolist()
    good = (1 / (1 + np.exp(-np.clip(unary, -30, 30)))).tolist()
    ahead, a0, a1 = [], 0.5, 0.5
    for k, g in enumerate(good):
        if k:
            a0, a1 = a0 * m00 + a1 * m10, a0 * m01 + a1 * m11
        a0, a1 = a0 * (1 - g), a1 * g
        total = a0 + a1
        a0, a1 = a0 / total, a1 / total
        ahead.append(a1)
    out, b0, b1 = np.zeros(n), 1.0, 1.0
    for k in range(n - 1, -1, -1):
        p1, p0 = ahead[k] * b1, (1 - ahead[k]) * b0
        out[k] = p1 / (p0 + p1)
        g = good[k]
        c0, c1 = b0 * (1 - g), b1 * g
        b0, b1 = m00 * c0 + m01 * c1, m10 * c0 + m11 * c1
        total = b0 + b1
        b0, b1 = b0 / total, b1 / total
    return out


@dataclass
class Model:
    weights: np.ndarray
    pair: np.ndarray
    calibration: np.ndarray  # of what _summary returns

    def score(self, text: bytes) -> tuple[float, float, int]:
        """Score, share of bad text, lines."""
        x, size = document_features(text)
        p = marginals(x @ self.weights, self.pair)
        mean = float((p * size).sum() / size.sum())
        z = float(self.calibration @ _summary(p, size))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30)))), 1 - mean, len(size)


def _summary(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    mean = float((p * size).sum() / size.sum())
    bad_long = float(((p < 0.5) * size).sum() / size.sum())
    logit = np.log((mean + 0.01) / (1.01 - mean))
    return np.array([1.0, mean, bad_long, logit])


def _chain_gradient(x: list[np.ndarray], y: list[np.ndarray], weights: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient of the mean log-likelihood per line, over documents padded to a common length."""
    n, longest = len(x), max(map(len, x))
    length = np.array(list(map(len, x)))
    flat = np.concatenate(x)
    u = np.zeros((n, longest, 2))
    inside = np.arange(longest)[None, :] < length[:, None]
    u[..., 1][inside] = flat @ weights
    move = np.exp(pair)
    e = np.exp(np.clip(u, -30, 30))
    a = np.zeros((n, longest, 2))
    a[:, 0] = e[:, 0] / e[:, 0].sum(1, keepdims=True)
    for t in range(1, longest):
        step = (a[:, t - 1] @ move) * e[:, t]
        a[:, t] = step / step.sum(1, keepdims=True)
    b = np.ones((n, longest, 2))
    pairs = np.zeros((2, 2))
    truth = np.zeros((2, 2))
    for t in range(longest - 2, -1, -1):
        on = inside[:, t + 1]
        back = (e[:, t + 1] * b[:, t + 1]) @ move.T
        back /= back.sum(1, keepdims=True)
        b[:, t] = np.where(on[:, None], back, 1.0)
        joint = a[:, t, :, None] * move[None] * (e[:, t + 1] * b[:, t + 1])[:, None, :]
        joint /= joint.sum((1, 2), keepdims=True)
        pairs += joint[on].sum(0)
    p = a * b
    p = (p / p.sum(2, keepdims=True))[..., 1][inside]
    target = np.concatenate(y)
    for labels in y:
        np.add.at(truth, (np.round(labels[:-1]).astype(int), np.round(labels[1:]).astype(int)), 1.0)
    return (target - p) @ flat / len(p), (truth - pairs) / len(p)


def fit(docs: list[tuple[np.ndarray, np.ndarray, int]], turns: int = 3, steps: int = 60, rate: float = 0.2, decay: float = 1e-4) -> Model:
    """``docs``: features, line weights, label.

    Lines start with the label of their document; after each turn the lines of
    bad documents take what the model believes, but the worst stay bad.  Without
    documents of both labels every score is the share of good ones.
    """
    labels = np.array([label for *_, label in docs], float)
    if not len(docs) or labels.min() == labels.max():
        share = float(labels.mean()) if len(docs) else 0.5
        return Model(np.zeros(WIDTH), np.zeros((2, 2)), np.array([np.log((share + 0.01) / (1.01 - share)), 0.0, 0.0, 0.0]))
    docs = sorted(docs, key=lambda d: len(d[0]))
    labels = np.array([label for *_, label in docs], float)
    x = [d[0] for d in docs]
    y = [np.full(len(f), float(label)) for f, _, label in docs]
    weights, pair = np.zeros(WIDTH), np.zeros((2, 2))
    groups = [range(i, min(i + 250, len(docs))) for i in range(0, len(docs), 250)]
    momentum = [np.zeros(WIDTH), np.zeros((2, 2))]
    square = [np.zeros(WIDTH), np.zeros((2, 2))]
    k = 0
    for turn in range(turns):
        for _ in range(steps // turns):
            for g in groups:
                k += 1
                grads = _chain_gradient([x[i] for i in g], [y[i] for i in g], weights, pair)
                for j, (value, grad) in enumerate(zip((weights, pair), grads, strict=True)):
                    grad = grad - decay * value
                    momentum[j] = 0.9 * momentum[j] + 0.1 * grad
                    square[j] = 0.99 * square[j] + 0.01 * grad**2
                    step = rate * (momentum[j] / (1 - 0.9**k)) / (np.sqrt(square[j] / (1 - 0.99**k)) + 1e-6)
                    if j == 0:
                        weights = weights + 0.25 * step
                    else:
                        pair = pair + 0.25 * step
        if turn < turns - 1:
            for i, (f, _, label) in enumerate(docs):
                if not label:
                    p = marginals(f @ weights, pair)
                    y[i] = (p > max(0.7, float(p.min()) + 1e-9)).astype(float)
    s = np.array([_summary(marginals(f @ weights, pair), w) for f, w, _ in docs])
    c = np.zeros(s.shape[1])
    for _ in range(40):  # Newton steps of a lightly penalised logistic regression
        p = 1 / (1 + np.exp(-np.clip(s @ c, -30, 30)))
        h = (s * (p * (1 - p))[:, None]).T @ s + 0.1 * np.eye(len(c))
        c = c + np.linalg.solve(h, s.T @ (labels - p) - 0.1 * c)
    return Model(weights, pair, c)


def held_out(doc_id: Column) -> Column:
    """Whether a row may not be learned from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def _run(text: bytes, x: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """TRAIN_LINES neighbouring lines."""
    at = zlib.crc32(text) % (len(x) - TRAIN_LINES + 1)
    return x[at : at + TRAIN_LINES], w[at : at + TRAIN_LINES]


def train(docs: DataFrame, labels: DataFrame, bound: int = TRAIN_DOCS) -> Model:
    """Fit on at most ``bound`` labelled rows that are not held out; conflicting labels of an id count by their mean."""
    usable = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    usable = usable.groupBy("doc_id").agg(F.avg("quality").alias("quality"))
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    rows = docs.select("doc_id", text_bytes().alias("bytes")).join(F.broadcast(chosen), "doc_id")  # no more than ``bound`` rows

    def run(batches):
        for batch in batches:
            out = []
            for text in batch.column("bytes").to_pylist():
                x, w = document_features(text)
                if len(x) > TRAIN_LINES:
                    x, w = _run(text, x, w)
                out.append((x.astype(np.float32).tobytes(), w.astype(np.float32).tobytes()))
            columns = [batch.column("quality"), pa.array([a for a, _ in out], pa.binary()), pa.array([b for _, b in out], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["quality", "x", "w"])

    got = rows.select("quality", "bytes").mapInArrow(run, "quality double, x binary, w binary").limit(bound).collect()
    got = sorted((bytes(r["x"]), bytes(r["w"]), r["quality"]) for r in got)
    return fit([(np.frombuffer(x, np.float32).reshape(-1, WIDTH).astype(float), np.frombuffer(w, np.float32).astype(float), int(q >= 0.5)) for x, w, q in got])


def score_documents(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """One row per input row: doc_id, score, predicted, bad_share, n_lines.

    Null text counts as empty: one empty line.  Repeated rows score alike.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("bytes"))
    held = docs.sparkSession.sparkContext.broadcast(model)  # a few hundred numbers

    def run(batches):
        m = held.value
        for batch in batches:
            got = [m.score(text) for text in batch.column("bytes").to_pylist()]
            score = pa.array([g[0] for g in got], pa.float64())
            predicted = pa.array([int(g[0] >= threshold) for g in got], pa.int32())
            rest = [pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), score, predicted, *rest], ["doc_id", "score", "predicted", "bad_share", "n_lines"])

    return source.mapInArrow(run, "doc_id long, score double, predicted int, bad_share double, n_lines long")
