"""Quality classifier: random-indexing word vectors pooled per document, a two-layer network, and
probabilities calibrated by temperature.

Every word has a sparse random vector of its own, drawn from its hash. A word's learned vector sums
those of its neighbours over a sample of labelled texts, scaled to length one and joined with its
own. Words that the sample has seldom are learned together by their shape (lower, capitalised, upper
and mixed case, number, punctuation), which stands in for all unknown words too. A document is the
mean of the vectors of all its words and the mean product of neighbours' vectors; a network with one hidden layer, trained in numpy, gives a
logit, and a temperature fitted on rows that the network has not seen makes it a probability.

The fit takes at most SAMPLE_ROWS labelled rows, those of smallest hash, with texts of at most
SAMPLE_CHARS. The model is bounded by TERMS and DIMENSIONS and sent to all tasks.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from quaestor.llm.common import map_arrow, slices

SAMPLE_ROWS = 5_000
SAMPLE_CHARS = 50_000
TERMS = 20_000
LEAST_COUNT = 5
DIMENSIONS = 32
NONZERO = 4
REACH = 2
HIDDEN = 32
EPOCHS = 60
THRESHOLD = 0.3
PART_CHARS = 250_000
BATCH_CHARS = 1_000_000

TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")
SHAPES = ("<lower>", "<capitalised>", "<upper>", "<mixed>", "<number>", "<punctuation>")


def shape(token: str) -> str:
    first = token[0]
    if first.isdigit():
        return "<number>"
    if not first.isalpha():
        return "<punctuation>"
    if token.islower():
        return "<lower>"
    if token.isupper() and len(token) > 1:
        return "<upper>"
    return "<capitalised>" if token[1:].islower() or len(token) == 1 else "<mixed>"


class Terms(dict):
    """Row of every term; an unknown word has its shape's row, kept for the next time within bounds."""

    def __missing__(self, token: str) -> int:
        row = dict.__getitem__(self, shape(token))
        if len(self) < 10 * TERMS and len(token) < 100:
            self[token] = row
        return row


@dataclass
class QualityModel:
    """The constant `prior` is the score where no network could be trained."""

    prior: float = 0.5
    terms: dict[str, int] | None = None
    vectors: np.ndarray | None = None
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    layers: list[np.ndarray] | None = None
    temperature: float = 1.0

    def pooled(self, texts: list[str | None], terms: Terms) -> np.ndarray:
        """Mean vector of each text's words and mean product of neighbours; zero without words."""
        out = np.zeros((len(texts), DIMENSIONS + 1), "f4")
        start = 0
        while start < len(texts):
            end, chars = start, 0
            while end < len(texts) and (end == start or chars + len(texts[end] or "") <= PART_CHARS):
                chars += len(texts[end] or "")
                end += 1
            tokens = [TOKEN.findall(t or "") for t in texts[start:end]]
            counts = np.array([len(t) for t in tokens])
            rows = np.fromiter(map(terms.__getitem__, chain.from_iterable(tokens)), "i4", counts.sum())
            owner = np.repeat(np.arange(start, end), counts)
            for i in range(0, len(rows), PART_CHARS):  # a very long text in several steps
                part, own = self.vectors[rows[i : i + PART_CHARS + 1]], owner[i : i + PART_CHARS + 1]
                near = np.append(np.einsum("ij,ij->i", part[:-1], part[1:]) * (own[:-1] == own[1:]), 0)
                last = PART_CHARS if len(part) > PART_CHARS else len(part)
                begins = np.flatnonzero(np.diff(own[:last], prepend=-1))
                out[own[begins], :-1] += np.add.reduceat(part[:last], begins, axis=0)
                out[own[begins], -1] += np.add.reduceat(near[:last], begins)
            out[start:end, :-1] /= np.maximum(counts, 1)[:, None]
            out[start:end, -1] /= np.maximum(counts - 1, 1)
            start = end
        return out

    def logits(self, features: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.tanh((features - self.mean) / self.scale @ w1 + b1) @ w2 + b2

    def scores(self, texts: list[str | None], terms: Terms) -> np.ndarray:
        if self.layers is None:
            return np.full(len(texts), self.prior)
        z = self.logits(self.pooled(texts, terms)).astype("f8") / self.temperature
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def index_vectors(terms: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Dimensions and signs of each term's random vector, drawn from the term itself."""
    places = np.empty((len(terms), NONZERO), "i8")
    signs = np.empty((len(terms), NONZERO), "f8")
    for i, t in enumerate(terms):
        draw = np.random.default_rng(zlib.crc32(t.encode()))
        places[i] = draw.choice(DIMENSIONS, NONZERO, replace=False)
        signs[i] = draw.choice((-1.0, 1.0), NONZERO)
    return places, signs


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)


def word_vectors(texts: list[str]) -> tuple[dict[str, int], np.ndarray]:
    """Terms and vectors learned from the neighbours of each word."""
    counted: Counter[str] = Counter()
    for text in texts:
        counted.update(TOKEN.findall(text))
    common = sorted((t for t, n in counted.items() if n >= LEAST_COUNT), key=lambda t: (-counted[t], t))
    counted.clear()
    names = [*SHAPES, *common[:TERMS]]
    terms = Terms({t: i for i, t in enumerate(names)})
    places, signs = index_vectors(names)
    # neighbours don't reach over the gaps between documents
    gap = [-1] * REACH
    sums = np.zeros(len(names) * DIMENSIONS)
    for start in range(0, len(texts), 200):  # a part of the tokens in memory at once
        part = texts[start : start + 200]
        rows = np.fromiter(
            chain.from_iterable(chain(map(terms.__getitem__, TOKEN.findall(t)), gap) for t in part), "i8"
        )
        for step in range(1, REACH + 1):
            for a, b in ((rows[:-step], rows[step:]), (rows[step:], rows[:-step])):
                both = (a >= 0) & (b >= 0)
                a, b = a[both], b[both]
                for k in range(NONZERO):
                    sums += np.bincount(a * DIMENSIONS + places[b, k], signs[b, k], len(sums))
    own = np.zeros((len(names), DIMENSIONS))
    np.put_along_axis(own, places, signs, axis=1)
    learned = unit(unit(sums.reshape(own.shape)) + 0.5 * unit(own))
    return {t: i for i, t in enumerate(names)}, learned.astype("f4")


def train(features: np.ndarray, labels: np.ndarray) -> list[np.ndarray]:
    """Weights of the two layers: Adam on the log loss with a little weight decay."""
    draw = np.random.default_rng(7)
    sizes = (features.shape[1], HIDDEN)
    layers = [
        draw.normal(0, 1 / np.sqrt(sizes[0]), sizes), np.zeros(HIDDEN),
        draw.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1),
    ]
    first, second = ([np.zeros_like(w) for w in layers] for _ in range(2))
    step = 0
    for _ in range(EPOCHS):
        order = draw.permutation(len(labels))
        for i in range(0, len(order), 128):
            x, y = features[order[i : i + 128]], labels[order[i : i + 128]]
            hidden = np.tanh(x @ layers[0] + layers[1])
            error = (1 / (1 + np.exp(-(hidden @ layers[2] + layers[3]))) - y) / len(y)
            back = np.outer(error, layers[2]) * (1 - hidden**2)
            slopes = [x.T @ back + 1e-4 * layers[0], back.sum(0), hidden.T @ error + 1e-4 * layers[2], error.sum(keepdims=True)]
            step += 1
            for k, g in enumerate(slopes):
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                scaled = first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
                layers[k] = layers[k] - 0.003 * scaled
    return layers


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of the logits with the least log loss, by search over a fixed grid."""
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 61))
    z = logits[None] / grid[:, None]
    loss = (np.logaddexp(0, z) - labels * z).mean(1)
    return float(grid[loss.argmin()])


def fit_rows(texts: list[str], labels: list[int]) -> QualityModel:
    """A model of the given rows; without both labels the score is their smoothed share."""
    y = np.array(labels, "f8")
    prior = float((y.sum() + 1) / (len(y) + 2))
    held = np.arange(len(y)) % 5 == 4
    if len(set(y[~held])) < 2:
        return QualityModel(prior)
    terms, vectors = word_vectors(texts)
    model = QualityModel(prior, terms, vectors)
    features = model.pooled(texts, Terms(terms)).astype("f8")
    model.mean, model.scale = features[~held].mean(0), np.maximum(features[~held].std(0), 1e-6)
    model.layers = train((features[~held] - model.mean) / model.scale, y[~held])
    if held.any():
        model.temperature = temperature(model.logits(features[held]), y[held])
    return model


def fit(docs: DataFrame, labels: DataFrame) -> QualityModel:
    """A model from labelled rows. Of several labels of one id the smallest counts; rows with a null
    id, label or text are left out. Of several texts of one id each is a row."""
    known = (
        labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy(F.col("doc_id").alias("label_id"))
        .agg(F.min("quality").alias("label"))
        .orderBy(F.xxhash64("label_id"), "label_id")
        .limit(SAMPLE_ROWS)
    )
    rows = (
        docs.select("doc_id", "text")
        .filter(F.length("text") <= SAMPLE_CHARS)
        .join(F.broadcast(known), F.col("doc_id") == F.col("label_id"))
        .orderBy(F.xxhash64("doc_id"), "doc_id", "text")
        .select("text", "label")
        .limit(SAMPLE_ROWS)
        .toPandas()
    )
    return fit_rows(rows["text"].tolist(), rows["label"].tolist())


def score(docs: DataFrame, model: QualityModel, threshold: float = THRESHOLD) -> DataFrame:
    """The documents with score, 0 to 1, and predicted, 1 from `threshold` on.

    Null and empty texts have the score of a text without words. Only the whole text counts; lang,
    source and ids are not looked at. Repeated rows score alike. Columns of those names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    new = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    kept = docs.drop("score", "predicted")
    place = kept.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        terms = Terms(own.terms or {})
        for batch in batches:
            for start, end in slices(batch.column(place), BATCH_CHARS):
                part = batch.slice(start, end - start)
                found = own.scores(part.column(place).to_pylist(), terms)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(found, pa.float64()), pa.array((found >= threshold).astype("i4"))],
                    names=[*part.schema.names, "score", "predicted"],
                )

    return map_arrow(kept, run, T.StructType([*kept.schema.fields, *new]))
