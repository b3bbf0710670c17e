"""Document quality from a linear-chain conditional random field over lines.

Each line is good or bad. Its evidence is its own features and those of the lines before and
behind it; transition weights tie neighbouring labels. Forward-backward gives the probability
that each line is good, the mean weighted by line length the quality of the document, and a
logistic curve fitted on the same sample turns that into the probability of label 1.

The model is fitted on at most ``SAMPLE`` labelled documents of each label (those with the
smallest hash of their id), never on rows of the held-out fold; only their line features come to the driver. Scoring is
one pass over the texts without a shuffle.

Defined cases: a null or empty text has no good line and gets the curve's value at quality 0;
repeated rows are scored alike; a null id is never held out; labels other than 0 and 1, null
labels and ids that several labels disagree on are not learned from; without labels every score
is 0.5; labels, language, source and id are no inputs of a score. Other columns pass through
``keep_good`` unchanged.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeworks.llm.common import SPACED_WORDS, Words, text_bytes, text_slices

SAMPLE = 2000
FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.7
STEPS, RATE, RIDGE = 150, 0.1, 1e-3

_CLASS = np.zeros((4, 256), dtype=bool)
_CLASS[0, 0x41:0x5B] = True  # capitals
_CLASS[1, 0x61:0x7B] = _CLASS[1, 0x80:] = True  # other letters
_CLASS[2, 0x30:0x3A] = True  # digits
_CLASS[3, [ord(c) for c in "!#$%&*+/<=>@[\\]^_`{|}~"]] = True  # signs that prose seldom has
WEIGHTS = 9  # features of a line by itself


def line_features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of every line with its neighbours', line lengths in bytes, and text bounds."""
    data, offsets = text_bytes(column)
    filled = offsets[:-1][np.diff(offsets) > 0]
    starts = np.unique(np.concatenate((filled, np.flatnonzero(data == 0x0A) + 1)))
    starts = starts[starts < len(data)]
    bounds = np.searchsorted(starts, offsets)
    lines = np.append(starts, len(data))
    n = len(starts)
    if not n:
        return np.zeros((0, 3 * WEIGHTS + 1)), np.zeros(0), bounds
    capitals, small, digits, signs = (
        np.add.reduceat(c[data], starts, dtype=np.int64).astype(float) for c in _CLASS
    )
    words = Words(data, lines, SPACED_WORDS)
    count = words.counts.astype(float)
    owner = words.owner
    hashes = words.hashes

    def share(flags: np.ndarray) -> np.ndarray:
        return np.bincount(owner[flags], minlength=n) / np.maximum(count, 1)

    again = np.zeros(len(hashes), dtype=bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    second = np.zeros(len(hashes), dtype=bool)
    second[2:] = (hashes[2:] == hashes[:-2]) & (owner[2:] == owner[:-2])
    signed = _CLASS[3][words.data[words.ends - 1]] if len(hashes) else again
    size = np.maximum(np.diff(lines), 1).astype(float)
    own = np.column_stack(
        (
            np.log1p(count),
            np.diff(lines) / np.maximum(count, 1) / 10,
            capitals / np.maximum(capitals + small, 1),
            signs / size,
            digits / size,
            share(again),
            share(second),
            share(signed),
            count == 0,
        )
    )
    first = np.zeros(n, dtype=bool)
    first[bounds[:-1][np.diff(bounds) > 0]] = True
    before = np.vstack((np.zeros((1, WEIGHTS)), own[:-1]))
    before[first] = 0
    behind = np.vstack((own[1:], np.zeros((1, WEIGHTS))))
    behind[np.append(first[1:], True)] = 0
    return np.hstack((own, before, behind, np.ones((n, 1)))), np.diff(lines).astype(float), bounds


def chain(evidence: np.ndarray, transition: np.ndarray, bounds: np.ndarray):
    """Forward-backward over many chains at once: the probability that each line is good, and
    the expected transitions. ``evidence`` is the log-odds of good from the features."""
    counts = np.diff(bounds)
    by = np.argsort(-counts, kind="stable")
    starts, counts = bounds[:-1][by], counts[by]
    n = len(evidence)
    state = np.column_stack((np.zeros(n), evidence))
    forward, backward = np.zeros((n, 2)), np.zeros((n, 2))
    steps = int(counts[0]) if len(counts) else 0
    active = np.searchsorted(-counts, -np.arange(steps), side="left")  # chains longer than t
    for t in range(steps):
        at = starts[: active[t]] + t
        if t:
            into = forward[at - 1][:, :, None] + transition
            forward[at] = np.logaddexp(into[:, 0], into[:, 1])
        forward[at] += state[at]
        forward[at] -= forward[at].max(axis=1, keepdims=True)
    for t in range(steps - 2, -1, -1):
        at = starts[: active[t + 1]] + t
        out = transition + (state[at + 1] + backward[at + 1])[:, None, :]
        backward[at] = np.logaddexp(out[:, :, 0], out[:, :, 1])
        backward[at] -= backward[at].max(axis=1, keepdims=True)
    odds = (forward + backward) @ np.array([-1.0, 1.0])
    good = 0.5 * (1 + np.tanh(odds / 2))
    inner = np.ones(n, dtype=bool)
    inner[bounds[:-1][np.diff(bounds) > 0]] = False
    at = np.flatnonzero(inner)
    pair = forward[at - 1][:, :, None] + transition + (state[at] + backward[at])[:, None, :]
    pair = np.exp(pair - pair.max(axis=(1, 2), keepdims=True))
    pair /= pair.sum(axis=(1, 2), keepdims=True)
    return good, pair.sum(axis=0), at


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    transition: np.ndarray
    slope: float
    offset: float

    def quality(self, features, lengths, bounds) -> np.ndarray:
        """The share of each text, by length, that lies in good lines."""
        evidence = ((features - self.mean) / self.scale) @ self.weights
        good, _, _ = chain(evidence, self.transition, bounds)
        mass = np.concatenate(([0.0], np.cumsum(lengths)))
        held = np.concatenate(([0.0], np.cumsum(lengths * good)))
        total = mass[bounds[1:]] - mass[bounds[:-1]]
        return (held[bounds[1:]] - held[bounds[:-1]]) / np.maximum(total, 1.0)

    def score(self, column: pa.Array) -> np.ndarray:
        return sigmoid(self.slope * self.quality(*line_features(column)) + self.offset)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(np.asarray(x) / 2))


def fit(features: np.ndarray, lengths: np.ndarray, bounds: np.ndarray, labels: np.ndarray) -> Model:
    """Maximum likelihood of the document's label on each of its lines, with a ridge."""
    width = features.shape[1]
    mean, scale = np.zeros(width), np.ones(width)
    weights, transition = np.zeros(width), np.zeros((2, 2))
    if not len(features):
        return Model(mean, scale, weights, transition, 0.0, 0.0)
    mean[:-1], scale[:-1] = features[:, :-1].mean(axis=0), features[:, :-1].std(axis=0) + 1e-6
    x = (features - mean) / scale
    y = np.repeat(labels, np.diff(bounds)).astype(float)
    params = np.zeros(width + 4)
    first, second = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, STEPS + 1):
        weights, transition = params[:width], params[width:].reshape(2, 2)
        good, pairs, inner = chain(x @ weights, transition, bounds)
        seen = np.zeros((2, 2))
        np.add.at(seen, (y[inner - 1].astype(int), y[inner].astype(int)), 1)
        slope = np.concatenate((x.T @ (good - y), (pairs - seen).ravel())) / len(x) + RIDGE * params
        first = 0.9 * first + 0.1 * slope
        second = 0.99 * second + 0.01 * slope**2
        params = params - RATE * (first / (1 - 0.9**step)) / (
            np.sqrt(second / (1 - 0.99**step)) + 1e-8
        )
    model = Model(mean, scale, params[:width], params[width:].reshape(2, 2), 0.0, 0.0)
    quality = model.quality(features, lengths, bounds)
    curve = np.zeros(2)
    basis = np.column_stack((quality, np.ones(len(quality))))
    for _ in range(50):
        p = sigmoid(basis @ curve)
        hessian = (basis * (p * (1 - p))[:, None]).T @ basis / len(p) + RIDGE * np.eye(2)
        curve = curve - np.linalg.solve(hessian, basis.T @ (p - labels) / len(p) + RIDGE * curve)
    model.slope, model.offset = float(curve[0]), float(curve[1])
    return model


def held_out(doc_id: str = "doc_id"):
    """The fold that no label is learned from."""
    fold = F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS
    return F.coalesce(fold == HELD_OUT, F.lit(False))


def train(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fits the model on at most ``sample`` documents of each label."""
    agreed = (
        labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"), F.max("quality").alias("most"))
        .where("quality = most")
    )
    order = [F.xxhash64(F.col("doc_id").cast("long")), "doc_id"]
    picked = agreed.where("quality = 0").orderBy(*order).limit(sample).unionByName(
        agreed.where("quality = 1").orderBy(*order).limit(sample)
    ).select(F.col("doc_id").alias("_id"), F.col("quality").cast("double").alias("quality"))

    def extract(batches):
        for part in text_slices(batches):
            features, lengths, bounds = line_features(part.column("text"))
            values = np.column_stack((features, lengths))
            rows = [values[a:b].astype("<f8").tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("quality"), pa.array(rows, pa.binary())],
                ["doc_id", "quality", "lines"],
            )

    # At most 2 * sample ids are broadcast, and as many feature tables come back.
    rows = (
        documents.select("doc_id", "text")
        .join(F.broadcast(picked), F.col("doc_id") == F.col("_id"))
        .select("doc_id", "text", "quality")
        .mapInArrow(extract, "doc_id long, quality double, lines binary")
        .dropDuplicates(["doc_id"])
        .collect()
    )
    rows.sort(key=lambda r: r.doc_id)
    width = 3 * WEIGHTS + 2
    tables = [np.frombuffer(r.lines, dtype="<f8").reshape(-1, width) for r in rows]
    bounds = np.concatenate(([0], np.cumsum([len(t) for t in tables]))).astype(int)
    values = np.vstack([np.zeros((0, width)), *tables])
    return fit(values[:, :-1], values[:, -1], bounds, np.array([r.quality for r in rows]))


def score_documents(documents: DataFrame, model: Model) -> DataFrame:
    """``doc`` (all columns of a document) and its ``score``."""
    shared = documents.sparkSession.sparkContext.broadcast(model)  # a few hundred numbers
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("doc"))

    def run(batches):
        for batch in batches:
            texts = batch.column("doc").field("text")
            flat = pa.RecordBatch.from_arrays([batch.column("doc"), texts], ["doc", "text"])
            for part in text_slices([flat]):
                score = pa.array(shared.value.score(part.column("text")), pa.float64())
                yield pa.RecordBatch.from_arrays([part.column("doc"), score], ["doc", "score"])

    schema = T.StructType([rows.schema["doc"], T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(run, schema)


def keep_good(documents: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score at least ``threshold``, with their columns as they were."""
    return score_documents(documents, model).where(F.col("score") >= threshold).select("doc.*")
