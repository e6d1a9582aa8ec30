"""Quality classifier: n-gram indicators scaled by naive Bayes ratios, then a linear hinge-loss model.

The n-grams are of word shapes, one to three, and of words, one and two; whether a word is the one
before it is part of a pair of shapes. The
hinge-loss model is fitted by dual coordinate descent, its margin turned into a probability by a
logistic fit on rows that the model did not see.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.llm.common import held_out, labelled_sample, parts

#: Hashed feature space.
BITS = 20
MASK = (1 << BITS) - 1
#: Texts whose words are made distinct together.
BATCH_ROWS = 1024
LETTERS = re.compile(r"[^\W\d_]+")
DIGITS = re.compile(r"[0-9]+")
RUNS = re.compile(r"(\W)\1+")


def shape(word: str) -> str:
    """The word with its letters and digits as classes, runs as one."""
    plain = DIGITS.sub("9", LETTERS.sub(lambda m: "X" if len(m[0]) > 1 and m[0].isupper() else "C" if m[0][0].isupper() else "x", word))
    return RUNS.sub(r"\1\1", plain)


def bucket(key: str) -> int:
    return zlib.crc32(key.encode("utf-8", "surrogatepass")) & MASK


def features(texts: pa.Array) -> Iterator[np.ndarray]:
    """For each text the sorted buckets of the n-grams that occur in it, each once.

    Words are made distinct over all the texts first, so each one's shape and bucket are taken once.
    """
    lists = pc.utf8_split_whitespace(pc.utf8_trim_whitespace(texts))
    coded = lists.flatten().dictionary_encode()
    number = coded.indices.to_numpy()
    names = coded.dictionary.to_pylist()
    shapes = np.fromiter((bucket(shape(w)) for w in names), "i8", len(names))[number]
    words = np.fromiter((bucket("word " + w.lower()) for w in names), "i8", len(names))[number]
    bound = lists.offsets.to_numpy().tolist()
    for x, y in zip(bound[:-1], bound[1:], strict=True):
        own, word, plain = shapes[x:y], number[x:y], words[x:y]
        doubled = word[1:] == word[:-1]
        pairs = (own[:-1] * 0x9E3779B1 + own[1:] * 0x85EBCA6B + 0x27D4EB2F + doubled * 0x165667B1) >> 7
        triples = (pairs[:-1] * 0xC2B2AE3D + pairs[1:]) >> 9
        beside = (plain[:-1] * 0x9E3779B1 + plain[1:] * 0x85EBCA6B + 0x165667B1) >> 5
        yield np.unique(np.concatenate([own, pairs & MASK, triples & MASK, plain, beside & MASK])).astype("int32")


@dataclass
class Model:
    """Weights with the ratios in them, the ratios, and the logistic line over the margin."""

    weight: np.ndarray
    ratio: np.ndarray
    bias: float
    slope: float
    offset: float

    def margin(self, features: np.ndarray) -> float:
        """Distance from the plane for a row scaled to unit length, as in the fit."""
        length = float(np.sqrt((self.ratio[features] ** 2).sum() + 1))
        return (float(self.weight[features].sum()) + self.bias) / length

    def score(self, features: np.ndarray) -> float:
        return 1 / (1 + float(np.exp(-np.clip(self.slope * self.margin(features) + self.offset, -35, 35))))


def ratios(rows: list[np.ndarray], label: np.ndarray, smooth: float) -> np.ndarray:
    """Log ratio of each bucket's share of the rows of label 1 and of label 0."""
    counts = [np.full(1 << BITS, smooth) for _ in range(2)]
    for x, y in zip(rows, label, strict=True):
        counts[y][x] += 1
    return np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())


def dual_coordinate_descent(rows: list[np.ndarray], r: np.ndarray, label: np.ndarray, cost: float, rounds: int) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear hinge-loss model over indicators scaled by r.

    Each class has the same total cost. A row of unit length keeps long texts from ruling.
    """
    norm = [1 / max(1e-9, float(np.sqrt((r[x] ** 2).sum() + 1))) for x in rows]
    sign = 2.0 * label - 1
    limit = np.where(label == 1, cost / max(1, label.sum()), cost / max(1, (1 - label).sum())) * len(rows) / 2
    w, bias, alpha = np.zeros(len(r)), 0.0, np.zeros(len(rows))
    order = np.random.default_rng(7)
    for _ in range(rounds):
        moved = 0.0
        for i in order.permutation(len(rows)):
            x, n, y = rows[i], norm[i], sign[i]
            slope = y * n * (float(w[x] @ r[x]) + bias) - 1
            new = min(max(alpha[i] - slope, 0.0), limit[i])  # the row's length is 1
            step = (new - alpha[i]) * y * n
            if step:
                w[x] += step * r[x]
                bias += step
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-4:
            break
    return w * r, bias


def logistic_line(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic fit by Newton steps, classes weighted alike, kept finite by a small penalty."""
    a, b = 1.0, 0.0
    weight = np.where(label == 1, 0.5 / max(1, label.sum()), 0.5 / max(1, (1 - label).sum())) * len(label)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -35, 35)))
        d, h = weight * (p - label), weight * np.maximum(p * (1 - p), 1e-9)
        g = np.array([(d * margin).sum() + 0.01 * a, d.sum() + 0.01 * b])
        m = np.array([[(h * margin**2).sum() + 0.01, (h * margin).sum()], [(h * margin).sum(), h.sum() + 0.01]])
        step = np.linalg.solve(m, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return float(a), float(b)


def fit(rows: list[np.ndarray], label: np.ndarray, cost: float = 1.0, rounds: int = 20) -> Model:
    """The model of training rows. With one class only, every score is that class's share."""
    weight = np.zeros(1 << BITS)
    if len(rows) == 0 or label.min() == label.max():
        share = (label.sum() + 0.5) / (len(rows) + 1)
        return Model(weight, weight, 0.0, 0.0, float(np.log(share / (1 - share))))
    fold = np.arange(len(rows)) % 4 == 3
    if len(set(label[fold])) == 2 and len(set(label[~fold])) == 2:
        seen, out = np.flatnonzero(~fold), np.flatnonzero(fold)
    else:
        seen = out = np.arange(len(rows))
    train = [rows[i] for i in seen]
    r = ratios(train, label[seen], 1.0)
    w, bias = dual_coordinate_descent(train, r, label[seen], cost, rounds)
    model = Model(w.astype("float32"), r.astype("float32"), bias, 1.0, 0.0)
    model.slope, model.offset = logistic_line(np.array([model.margin(rows[i]) for i in out]), label[out])
    return model


def train_quality(docs: DataFrame, labels: DataFrame, sample_rows: int = 6000) -> Model:
    """Fits on at most sample_rows labelled documents whose crc32(doc_id) mod 4 isn't 2.

    Only their feature numbers reach the driver. Rows are taken in the order of doc_id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, "text", BATCH_ROWS):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), pa.array(list(features(part.column("text"))), pa.list_(pa.int32()))], names=["doc_id", "label", "features"])

    sample = labelled_sample(docs, labels, "quality", 4, 2, sample_rows)
    table = sample.mapInArrow(run, "doc_id long, label int, features array<int>").toArrow().sort_by([("doc_id", "ascending"), ("label", "ascending")])
    return fit([np.asarray(x.values) for x in table.column("features")], table.column("label").to_numpy().astype("int64"))


def score_quality(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """docs with `column`, the probability of label 1, as the last column; all others stay.

    Null texts score as empty ones. Scores depend on the text alone, so copies score alike.
    """
    send = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = send.value
        for batch in batches:
            for part in parts(batch, "text", BATCH_ROWS):
                scores = [own.score(x) for x in features(pc.fill_null(part.column(at), ""))]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, column])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType())]))


def classify_quality(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted of docs (doc_id, text), a row per row."""
    scored = score_quality(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    return scored.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
