"""Toxicity by compression distance: one zstandard dictionary of toxic text and one of ordinary text.

A text is cut into windows of one word each. A window's distance is how many bytes fewer it takes with the
toxic dictionary than with the ordinary one. How many windows reach which distance, beside how many there are,
is calibrated on documents that the dictionaries haven't seen.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwork.llm.common import batches, held_out, stage
from tillwork.llm.line_crf import _logistic, training_rows

#: Labelled documents that the model learns from at most, by label: toxic and ordinary ones, those with
#: the least hash of their id. Words of one of them that it learns from at most, from anywhere in it. The calibration
#: sees all words of the documents that it uses.
TRAIN_TOXIC, TRAIN_ORDINARY, TRAIN_WORDS = 1500, 4500, 2000
#: Toxic samples are words that this many toxic documents use, with this log odds against ordinary ones.
LEAST_DOCS, LEAST_ODDS = 4, 2.5
TOXIC_BYTES, ORDINARY_BYTES = 4096, 32768
DISTANCES = (2, 3, 4, 5, 6)
#: The compressor looks for no match in the last bytes of its input and stores tiny blocks as they are.
#: Known bytes at the end of each dictionary and each window give short windows their true length.
CARRIER = hashlib.sha256(b"carrier").digest()[:24]
CACHE = 200_000


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


@dataclass(frozen=True)
class Model:
    toxic: bytes
    ordinary: bytes
    curve: tuple[float, ...]


def _trained(samples: list[bytes], size: int, segment: int, gram: int) -> bytes:
    """A trained dictionary; the samples themselves where they are too few to train one."""
    try:
        return zstandard.train_dictionary(size, samples, k=segment, d=gram).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


class Distances:
    """Distances of windows; those of frequent ones are remembered, ``CACHE`` at most."""

    def __init__(self, model: Model):
        self.toxic, self.ordinary = (self._compressor(x) for x in (model.toxic, model.ordinary))
        self.known: dict[bytes, int] = {}

    @staticmethod
    def _compressor(dictionary: bytes):
        given = zstandard.ZstdCompressionDict(dictionary + CARRIER, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        settings = zstandard.ZstdCompressionParameters.from_level(
            3, source_size=64, dict_size=20000, write_content_size=False, write_checksum=False, write_dict_id=False
        )
        return zstandard.ZstdCompressor(compression_params=settings, dict_data=given).compress

    def of(self, window: bytes) -> int:
        found = self.known.get(window)
        if found is None:
            if len(self.known) >= CACHE:
                self.known.clear()
            text = b" " + window + b" " + CARRIER
            found = self.known[window] = len(self.ordinary(text)) - len(self.toxic(text))
        return found


def summary(distances: Distances, windows: list[bytes]) -> list[float]:
    """What is calibrated: windows by distance as logarithms and shares, the largest distances, the length."""
    found = np.fromiter(map(distances.of, windows), np.int64, len(windows))
    n = len(found)
    top = np.sort(found)[-3:].mean() if n else 0.0
    by = [int((found >= d).sum()) for d in DISTANCES]
    return [math.log1p(c) for c in by] + [min(1.0, 20 * c / max(n, 20)) for c in by] + [top / 8, math.log1p(n) / 8, 1.0]


def _share(labels: list[int], prior: float | None) -> float:
    share = prior if prior is not None else (sum(labels) + 1) / (len(labels) + 2)
    return min(max(share, 1e-4), 1 - 1e-4)


def _flat(share: float) -> Model:
    return Model(b"", b"", (*[0.0] * (2 * len(DISTANCES) + 2), math.log(share / (1 - share))))


def dictionaries(made: list[tuple[list[bytes], int]]) -> Model:
    """The dictionaries of ``(words, label)`` samples of both labels, without a curve."""
    seen = {0: Counter(), 1: Counter()}
    for ws, label in made:
        seen[label].update(set(ws))
    docs = Counter(label for _, label in made)

    def odds(word: bytes) -> float:
        return math.log((seen[1][word] + 0.5) / (docs[1] + 1)) - math.log((seen[0][word] + 0.5) / (docs[0] + 1))

    telling = {w for w, c in seen[1].items() if c >= min(LEAST_DOCS, docs[1]) and odds(w) > LEAST_ODDS}
    toxic = [b" " + b" ".join(w for w in ws if w in telling) + b" " for ws, label in made if label]
    ordinary = [b" " + b" ".join(ws) + b" " for ws, label in made if not label]
    return Model(
        _trained([s for s in toxic if len(s) > 2], TOXIC_BYTES, 24, 6), _trained(ordinary, ORDINARY_BYTES, 64, 8), ()
    )


def calibrated(model: Model, x: np.ndarray, y: np.ndarray, share: float) -> Model:
    """``model`` with the curve of summaries and labels, moved to the ``share`` of label 1."""
    curve = _logistic(x, y)
    inside = y.mean()
    curve[-1] += math.log(share / (1 - share)) - math.log(inside / (1 - inside))
    return Model(model.toxic, model.ordinary, tuple(curve.tolist()))


def train(samples: list[tuple[list[bytes], int]], prior: float | None = None) -> Model:
    """The model of ``(words, label)`` samples. Two thirds make the dictionaries, the rest the calibration.

    ``prior`` is the share of label 1 among all labelled documents, where the samples have another one.
    """
    made, kept = [s for i, s in enumerate(samples) if i % 3], samples[::3]
    y = np.array([label for _, label in kept])
    share = _share([label for _, label in samples], prior)
    if len(np.unique(y)) < 2 or len({label for _, label in made}) < 2:
        return _flat(share)
    model = dictionaries(made)
    distances = Distances(model)
    return calibrated(model, np.array([summary(distances, ws) for ws, _ in kept]), y, share)


def scores(model: Model, texts: list[str | None], distances: Distances | None = None) -> np.ndarray:
    """P(label 1) of whole texts."""
    distances = distances or Distances(model)
    odds = np.array([summary(distances, words(t)) for t in texts]).reshape(len(texts), -1) @ np.array(model.curve)
    return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def _training_words(rows: Iterator[pa.RecordBatch], kept: frozenset[int]) -> Iterator[pa.RecordBatch]:
    for batch in batches(rows):
        batch = batch.filter(pa.array([i not in kept for i in batch["doc_id"].to_pylist()], pa.bool_()))
        out = []
        for text in batch["text"].to_pylist():
            ws = words(text)
            if len(ws) > TRAIN_WORDS:
                ws = [ws[i] for i in np.linspace(0, len(ws) - 1, TRAIN_WORDS).astype(int)]
            out.append(b" ".join(ws))
        yield pa.record_batch([batch["label"], pa.array(out, pa.binary())], names=["label", "words"])


def _calibration_rows(rows: Iterator[pa.RecordBatch], kept: frozenset[int], model: Model) -> Iterator[pa.RecordBatch]:
    distances = Distances(model)
    for batch in batches(rows):
        batch = batch.filter(pa.array([i in kept for i in batch["doc_id"].to_pylist()], pa.bool_()))
        found = [summary(distances, words(t)) for t in batch["text"].to_pylist()]
        yield pa.record_batch([batch["label"], pa.array(found, pa.list_(pa.float64()))], names=["label", "x"])


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Model:
    """The model of ``labels(doc_id, <label>)``.

    Of a bounded number of documents, words of two thirds reach the driver, then 13 numbers of each whole other one.
    """
    parts, samples, count = [], [], []
    for value, most in ((1, TRAIN_TOXIC), (0, TRAIN_ORDINARY)):
        own = labels.where(F.col(label) == value)
        chosen = stage(training_rows(docs, own, label, most))
        rows = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").select("doc_id", "label", "text")
        kept = frozenset([r.doc_id for r in rows.select("doc_id").collect()][::3])
        found = rows.mapInArrow(partial(_training_words, kept=kept), "label int, words binary").collect()
        samples += [(r.words.split(), r.label) for r in found]
        parts.append((rows, kept))
        count.append(own.where(~held_out(F.col("doc_id"))).count())
    share = _share([], (count[0] + 1) / (sum(count) + 2))
    if len({known for _, known in samples}) < 2:
        return _flat(share)
    model = dictionaries(samples)
    del samples
    x, y = [], []
    for rows, kept in parts:
        whole = partial(_calibration_rows, kept=kept, model=model)
        for r in rows.mapInArrow(whole, "label int, x array<double>").collect():
            x.append(r.x)
            y.append(r.label)
    return calibrated(model, np.array(x), np.array(y), share)


def _score_rows(rows: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    distances = Distances(model)
    for batch in batches(rows):
        found = scores(model, batch["text"].to_pylist(), distances)
        yield pa.record_batch(
            [batch["doc_id"], batch["held_out"], pa.array(found, pa.float64())], names=["doc_id", "held_out", "score"]
        )


def score(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row of ``docs(doc_id, text)``; other columns are ignored.

    A null text is empty; an empty text has no window and gets a score like any other. Rows that repeat get equal
    scores, rows without an id too. An empty table gives no rows; without labels of both kinds, every document
    gets the share of label 1.
    """
    return (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
        .mapInArrow(partial(_score_rows, model=model), "doc_id long, held_out boolean, score double")
        .withColumn("predicted", (F.col("score") >= threshold).cast("int"))
    )


def _clean_rows(rows: Iterator[pa.RecordBatch], model: Model, threshold: float) -> Iterator[pa.RecordBatch]:
    distances = Distances(model)
    for batch in batches(rows):
        yield batch.filter(pa.array(scores(model, batch["text"].to_pylist(), distances) < threshold))


def clean(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` with a score below ``threshold``, as they are."""
    return docs.mapInArrow(partial(_clean_rows, model=model, threshold=threshold), docs.schema)
