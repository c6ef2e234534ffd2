"""Document quality by a linear-chain conditional random field over lines.

Every line is good or bad. Its features are its own shape and that of its neighbours; a start weight and a
transition table tie neighbours together. Forward-backward marginals of "good", weighted by line length, give
a document's quality; a logistic curve fitted on the training documents turns that into a probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwork.llm.common import batches, held_out, stage

#: Labelled documents that the model learns from at most, those with the least hash of their id.
#: Lines of one of them that its chains are learnt from at most: runs of neighbours, evenly spread, the first at
#: the beginning and the last at the end. The calibration sees all lines of them.
TRAIN_DOCS, TRAIN_LINES, RUN = 4000, 64, 16
GOOD = 1

_LETTERS = bytes(range(65, 91)) + bytes(range(97, 123))
_SYMBOLS = b"#$%&*|<>{}[]()=+_\\/^~@"


def line_shape(line: str) -> tuple[float, ...]:
    """What a line looks like, as numbers that are about 0 to 1."""
    raw = line.encode("utf-8", "surrogatepass")
    n = len(raw)
    words = raw.split()
    k = len(words)
    if not k:
        return (1.0,) + (0.0,) * 15
    plain = len(raw.translate(None, _LETTERS))
    upper = n - len(raw.translate(None, _LETTERS[:26]))
    digits = n - len(raw.translate(None, b"0123456789"))
    symbols = n - len(raw.translate(None, _SYMBOLS))
    ascii_ = len(raw.translate(None, bytes(range(128, 256))))
    others = sum(1 for a, b in zip(words, words[1:], strict=False) if a == b)
    return (
        0.0,
        min(1.0, np.log1p(n) / 8),
        min(1.0, np.log1p(k) / 6),
        min(1.0, n / k / 16),
        plain / n,
        upper / n,
        float(upper > 0.5 * (n - plain)),
        digits / n,
        symbols / n,
        float(symbols > 0),
        (n - ascii_) / n,
        1 - len(set(words)) / k,
        others / k,
        float(raw[-1:] in (b".", b"!", b"?")),
        raw.count(b".") / k,
        min(1.0, max(map(len, words)) / 64),
    )


SHAPES = 16
FEATURES = 3 * SHAPES + 2


def line_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """``(lines x FEATURES, weights)``: own and neighbours' shapes, a constant, only line; length weights."""
    lines = (text or "").split("\n")
    shape = np.array([line_shape(x) for x in lines], np.float32)
    out = np.zeros((len(lines), FEATURES), np.float32)
    out[:, :SHAPES] = shape
    out[1:, SHAPES : 2 * SHAPES] = shape[:-1]
    out[:-1, 2 * SHAPES : 3 * SHAPES] = shape[1:]
    out[:, -2] = 1
    out[:, -1] = len(lines) == 1
    return out, np.array([len(x) + 1 for x in lines], np.float64)


@dataclass(frozen=True)
class Model:
    """Weights of "good" against "bad": features, start, transitions [from][to]; curve: slope, offset."""

    weights: np.ndarray
    start: np.ndarray
    moves: np.ndarray
    curve: tuple[float, ...] = (1.0, 0.0, 0.0)


def marginals(
    model: Model, scores: np.ndarray, sizes: np.ndarray, pairs: bool = False, opens: np.ndarray | None = None
) -> tuple:
    """Forward-backward over many chains at once: P(good) by line, and those of neighbours if ``pairs``.

    ``scores`` are the lines' scores of "good", chain after chain; ``sizes`` the chains' lengths, all above 0.
    Chains that aren't in ``opens`` begin within a text, without a start weight.
    """
    order = np.argsort(-sizes, kind="stable")
    begins = (np.cumsum(sizes) - sizes)[order]
    length = sizes[order]
    longest = int(length[0])
    live = np.searchsorted(-length, -np.arange(longest), "left")  # chains longer than t
    own = np.zeros((len(scores), 2))
    own[:, 1] = scores
    ahead, back = np.zeros((len(scores), 2)), np.zeros((len(scores), 2))
    ahead[begins] = own[begins] + (model.start if opens is None else model.start * opens[order, None])
    for t in range(1, longest):
        at = begins[: live[t]] + t
        ahead[at] = np.logaddexp(ahead[at - 1, 0, None] + model.moves[0], ahead[at - 1, 1, None] + model.moves[1]) + own[at]
    total = np.empty(len(sizes))
    ends = begins + length - 1
    total[order] = np.logaddexp(ahead[ends, 0], ahead[ends, 1])
    for t in range(longest - 1, 0, -1):
        at = begins[: live[t]] + t
        after = own[at] + back[at]
        back[at - 1] = np.logaddexp(after[:, 0, None] + model.moves[:, 0], after[:, 1, None] + model.moves[:, 1])
    z = np.repeat(total, sizes)
    good = np.exp(np.minimum(0, ahead[:, 1] + back[:, 1] - z))
    if not pairs:
        return good, None
    first = np.zeros(len(scores), bool)
    first[np.cumsum(sizes) - sizes] = True
    later = np.flatnonzero(~first)
    pair = np.exp(
        ahead[later - 1][:, :, None] + model.moves[None] + (own[later] + back[later])[:, None, :] - z[later, None, None]
    )
    return good, pair


def _ascent(
    x: np.ndarray, labels: np.ndarray, sizes: np.ndarray, opens: np.ndarray, rounds: int, decay: float
) -> Model:
    """Maximum likelihood with a penalty, by Adam on the whole training set."""
    first = np.cumsum(sizes) - sizes
    later = np.setdiff1d(np.arange(len(x)), first)
    first = first[opens]
    seen_moves = np.zeros((2, 2))
    np.add.at(seen_moves, (labels[later - 1], labels[later]), 1)
    seen_start = np.bincount(labels[first], minlength=2).astype(float)
    seen = x.T @ labels
    theta = np.zeros(x.shape[1] + 6)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, rounds + 1):
        model = Model(theta[:-6], theta[-6:-4], theta[-4:].reshape(2, 2))
        good, pair = marginals(model, x @ model.weights, sizes, pairs=True, opens=opens)
        starts = np.array([(1 - good[first]).sum(), good[first].sum()])
        gradient = np.concatenate((seen - x.T @ good, seen_start - starts, (seen_moves - pair.sum(0)).ravel()))
        gradient = gradient / len(x) - decay * theta
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
        theta = theta + 0.15 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    return Model(theta[:-6], theta[-6:-4], theta[-4:].reshape(2, 2))


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Newton's method with a small penalty; the last column of ``x`` is the constant."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x.T * (p * (1 - p))) @ x + 1e-2 * np.eye(x.shape[1])
        w += np.linalg.solve(hessian, x.T @ (y - p) - 1e-2 * w)
    return w


def _summary(good: np.ndarray, weight: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """By document: log odds of the length-weighted mean marginal, those of its worst line, a constant."""
    begins = np.cumsum(sizes) - sizes
    mean = np.add.reduceat(good * weight, begins) / np.add.reduceat(weight, begins)
    odds = lambda p: np.log(np.clip(p, 1e-4, 1 - 1e-4) / np.clip(1 - p, 1e-4, 1))
    return np.column_stack((odds(mean), odds(np.minimum.reduceat(good, begins)), np.ones(len(sizes))))


def _flat(y: np.ndarray) -> Model:
    """Nothing to tell apart: every document gets the share of label 1."""
    share = (y.sum() + 1) / (len(y) + 2)
    return Model(np.zeros(FEATURES), np.zeros(2), np.zeros((2, 2)), (0.0, 0.0, float(np.log(share / (1 - share)))))


def runs(lines: int) -> list[tuple[int, int]]:
    """First line and length of the runs that are learnt from: the whole text, or as many as ``TRAIN_LINES`` allows."""
    if lines <= TRAIN_LINES:
        return [(0, lines)]
    begins = np.linspace(0, lines - RUN, TRAIN_LINES // RUN).astype(int).tolist()
    # Runs that touch or overlap are one.
    out: list[tuple[int, int]] = []
    for begin in begins:
        if out and begin <= sum(out[-1]):
            out[-1] = (out[-1][0], begin + RUN - out[-1][0])
        else:
            out.append((begin, RUN))
    return out


def train(features: list[np.ndarray], chains: list[list[tuple[int, int]]], labels: list[int], rounds: int = 150) -> Model:
    """The chains' weights, without a curve.

    Lines of a bad document start as bad. Those that look good are then taken as good, and it learns again.
    """
    y = np.array(labels)
    x = np.concatenate(features).astype(np.float64)
    lines = np.array([len(f) for f in features])
    sizes = np.array([n for own in chains for _, n in own])
    opens = np.array([begin == 0 for own in chains for begin, _ in own])
    line = np.repeat(y, lines)
    model = _ascent(x, line, sizes, opens, rounds, 1e-5)
    for _ in range(2):
        alone = 1 / (1 + np.exp(-np.clip(x @ model.weights + model.start[1] - model.start[0], -30, 30)))
        worst = np.repeat(np.minimum.reduceat(alone, np.cumsum(lines) - lines), lines)
        line = np.where(np.repeat(y, lines) == 1, 1, (alone > 0.5) & (alone > worst)).astype(int)
        model = _ascent(x, line, sizes, opens, rounds, 1e-5)
    return model


def summaries(model: Model, texts: list[str | None]) -> np.ndarray:
    """What is calibrated, of whole texts; there has to be one."""
    rows = [line_features(t) for t in texts]
    sizes = np.array([len(w) for _, w in rows])
    x = np.concatenate([f for f, _ in rows]).astype(np.float64)
    good, _ = marginals(model, x @ model.weights, sizes)
    return _summary(good, np.concatenate([w for _, w in rows]), sizes)


def scores(model: Model, texts: list[str | None]) -> np.ndarray:
    """P(label 1) of whole texts."""
    if not texts:
        return np.empty(0)
    odds = summaries(model, texts) @ np.array(model.curve)
    return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """``doc_id, text, label`` of ``most`` labelled documents at most, none of them held out.

    They have the least hashes of their ids. Labels other than 0 and 1 and null ids don't count; of several
    labels or texts of one id, the least is taken.
    """
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
        .where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull())
        .where(~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.min("label").alias("label"))
    )
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    chosen = stage(
        known.join(docs.select("doc_id"), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    )
    # ``most`` rows of two numbers: a broadcast of known size, so no text is shuffled but theirs.
    return docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))


def _training_lines(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches(rows):
        x, chains = [], []
        for text in batch["text"].to_pylist():
            features, _ = line_features(text)
            own = runs(len(features))
            x.append(np.concatenate([features[begin : begin + n] for begin, n in own]).tobytes())
            chains.append([v for pair in own for v in pair])
        yield pa.record_batch(
            [batch["label"], pa.array(x, pa.binary()), pa.array(chains, pa.list_(pa.int32()))],
            names=["label", "x", "chains"],
        )


def _calibration_rows(rows: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches(rows, 2 << 20):
        found = summaries(model, batch["text"].to_pylist())
        yield pa.record_batch(
            [batch["label"], pa.array(found.tolist(), pa.list_(pa.float64()))], names=["label", "x"]
        )


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Model:
    """The model of ``labels(doc_id, <label>)``.

    Features of some lines of at most ``TRAIN_DOCS`` documents reach the driver, then three numbers of each whole one.
    """
    chosen = stage(training_rows(docs, labels, label, TRAIN_DOCS))
    rows = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").select("label", "text")
    lines = rows.mapInArrow(_training_lines, "label int, x binary, chains array<int>").collect()
    y = np.array([r.label for r in lines])
    if len(np.unique(y)) < 2:
        return _flat(y)
    model = train(
        [np.frombuffer(r.x, np.float32).reshape(-1, FEATURES) for r in lines],
        [list(zip(r.chains[::2], r.chains[1::2], strict=True)) for r in lines],
        y.tolist(),
    )
    del lines
    whole = rows.mapInArrow(partial(_calibration_rows, model=model), "label int, x array<double>").collect()
    curve = _logistic(np.array([r.x for r in whole]), np.array([r.label for r in whole]))
    return Model(model.weights, model.start, model.moves, tuple(curve.tolist()))


def _score_rows(rows: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches(rows, 2 << 20):
        yield pa.record_batch(
            [batch["doc_id"], batch["held_out"], pa.array(scores(model, batch["text"].to_pylist()), pa.float64())],
            names=["doc_id", "held_out", "score"],
        )


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row of ``docs(doc_id, text)``; other columns are ignored.

    A null text is empty; an empty text is one empty line and gets a score like any other. Rows that repeat get
    equal scores, rows without an id too. An empty table gives no rows; without labels of both kinds, every
    document gets the share of label 1.
    """
    return (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
        .mapInArrow(partial(_score_rows, model=model), "doc_id long, held_out boolean, score double")
        .withColumn("predicted", (F.col("score") >= threshold).cast("int"))
    )


def _chosen_rows(rows: Iterator[pa.RecordBatch], model: Model, threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in batches(rows, 2 << 20):
        yield batch.filter(pa.array(scores(model, batch["text"].to_pylist()) >= threshold))


def good(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` with a score of ``threshold`` at least, as they are."""
    return docs.mapInArrow(partial(_chosen_rows, model=model, threshold=threshold), docs.schema)
