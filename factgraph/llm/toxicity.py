"""Toxicity by a classifier chain over whole texts.

Features are whole words (runs of ASCII letters, lower-cased, and of bytes beyond
ASCII) and word heads of 4 to 10 bytes. Out of a bounded sample of labelled
documents (``TRAIN_ROWS``, those with the smallest hashes of doc_id) the features
whose share among toxic documents differs most are kept (at most ``FEATURES``). The
chain predicts one category after the other; each later model also reads the earlier
categories' probabilities, which are out-of-fold predictions while it is trained:

    toxic        the document is labelled toxic
    toxic_prose  it is labelled toxic and of good quality
    toxic_junk   it is labelled toxic and of bad quality

A document is rejected if the calibrated chance of a category reaches ``THRESHOLD``.

A null text counts as empty and has no features; repeated labels of a document count
once, by the largest toxic and the smallest quality; a null label is left out;
without documents of both classes nothing is rejected and all chances are 0. Every
document gets one row, extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factgraph.llm.linear import fit, folds, margins, platt, sigmoid
from factgraph.llm.words import Spans, lower_ascii, rows_of, text_slices

CATEGORIES = ("toxic", "toxic_prose", "toxic_junk")
TRAIN_ROWS = 6000
FEATURES = 1024
MIN_DOCS, MIN_Z = 4, 4.0
FOLDS = 5
THRESHOLD = 0.5
HEADS = (4, 5, 6, 7, 8, 9, 10)
LETTER = np.zeros(256, bool)
LETTER[97:123] = True
LETTER[128:] = True


def text_features(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, row of each feature, its hash) for runs of rows."""
    for first, data, offsets in text_slices(column):
        data = lower_ascii(data)
        n = len(offsets) - 1
        if not len(data):
            yield first, n, np.zeros(0, np.int64), np.zeros(0, np.uint64)
            continue
        inside = LETTER[data]
        begin, last = inside.copy(), inside.copy()
        begin[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        full = offsets[:-1] < offsets[1:]
        begin[offsets[:-1][full]] = inside[offsets[:-1][full]]
        last[offsets[1:][full] - 1] = inside[offsets[1:][full] - 1]
        start, end = np.flatnonzero(begin), np.flatnonzero(last) + 1
        rows = rows_of(np.searchsorted(start, offsets))
        spans = Spans(data)
        owner, found = [rows], [spans.hashes(start, end, 1)]
        for size in HEADS:
            own = end - start > size
            owner.append(rows[own])
            found.append(spans.hashes(start[own], start[own] + size, 2))
        yield first, n, np.concatenate(owner), np.concatenate(found)


class Chain:
    """Selected features (sorted hashes) and one calibrated logistic model for each category."""

    def __init__(self, features: np.ndarray):
        self.features, self.models = features, []

    def rows(self, n: int, owner: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Compressed rows of the selected features, valued log(1 + count)."""
        if not len(self.features):
            return np.zeros(n + 1, np.int64), np.zeros(0, np.int64), np.zeros(0)
        at = np.minimum(np.searchsorted(self.features, hashes), len(self.features) - 1)
        hit = self.features[at] == hashes
        key, count = np.unique(owner[hit] * len(self.features) + at[hit], return_counts=True)
        row, index = np.divmod(key, len(self.features))
        return np.searchsorted(row, np.arange(n + 1)), index, np.log1p(count)

    def fit(self, x: tuple[np.ndarray, np.ndarray, np.ndarray], y: np.ndarray, keys: np.ndarray) -> None:
        """y: a row for each document, a column for each category; the folds go by the keys' hashes."""
        fold = folds(keys, y @ (1 << np.arange(y.shape[1])), FOLDS)
        earlier = np.zeros((len(y), 0))
        for k in range(y.shape[1]):
            if not 2 * FOLDS <= y[:, k].sum() <= len(y) - 2 * FOLDS:
                self.models.append(None)
                earlier = np.column_stack((earlier, np.zeros(len(y))))
                continue
            out = np.zeros(len(y))
            for f in range(FOLDS):
                weights, bias = self._fit(x, earlier, y[:, k], fold != f)
                out[fold == f] = self._margin(x, earlier, weights, bias)[fold == f]
            a, b = platt(out, y[:, k])
            self.models.append((*self._fit(x, earlier, y[:, k], np.ones(len(y), bool)), a, b))
            earlier = np.column_stack((earlier, sigmoid(a * out + b)))

    def _fit(self, x: tuple, earlier: np.ndarray, y: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, float]:
        indptr, index, value = self._joined(x, earlier)
        keep = np.repeat(own, np.diff(indptr))
        return fit(np.concatenate(([0], np.cumsum(np.diff(indptr)[own]))), index[keep], value[keep], y[own], len(self.features) + len(CATEGORIES), 1e-4, 150, 0.1)

    def _joined(self, x: tuple, earlier: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        indptr, index, value = x
        n, more = earlier.shape
        at = np.repeat(indptr[1:], more)
        return indptr + np.arange(n + 1) * more, np.insert(index, at, np.tile(len(self.features) + np.arange(more), n)), np.insert(value, at, earlier.reshape(-1))

    def _margin(self, x: tuple, earlier: np.ndarray, weights: np.ndarray, bias: float) -> np.ndarray:
        return margins(*self._joined(x, earlier), weights) + bias

    def chances(self, n: int, owner: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Calibrated probabilities, a column for each category."""
        x = self.rows(n, owner, hashes)
        out = np.zeros((n, 0))
        for model in self.models:
            if model is None:
                out = np.column_stack((out, np.zeros(n)))
                continue
            weights, bias, a, b = model
            out = np.column_stack((out, sigmoid(a * self._margin(x, out, weights, bias) + b)))
        return out


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Chain | None:
    """Fit the chain; None without both classes. Broadcast and collected rows are bounded by ``rows`` and ``FEATURES``."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"), F.coalesce(F.min(F.col("quality").cast("int")), F.lit(1)).alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            toxic = np.asarray(b.column("toxic").to_numpy())
            for first, _, owner, hashes in text_features(b.column("text")):
                order = np.lexsort((hashes, owner))
                new = np.ones(len(order), bool)
                new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (owner[order][1:] != owner[order][:-1])
                own = order[new]
                yield pa.RecordBatch.from_pydict({"feature": pa.array(hashes[own].view(np.int64)), "toxic": pa.array(toxic[first + owner[own]].astype(np.int32))})

    counts = sample.groupBy().agg(F.sum("toxic"), F.count("*")).first()
    bad, total = int(counts[0] or 0), int(counts[1])
    if not 2 * FOLDS <= bad <= total - 2 * FOLDS:
        return None
    share = F.col("n") / F.lit(total)
    z = (F.col("bad") / F.lit(bad) - share) / F.sqrt(share * (1 - share) / F.lit(bad) + F.lit(1e-12))
    found = sample.mapInArrow(distinct, "feature long, toxic int").groupBy("feature").agg(F.sum("toxic").alias("bad"), F.count("*").alias("n")).where(F.col("n") >= MIN_DOCS).withColumn("z", F.abs(z)).where(F.col("z") >= MIN_Z)
    picked = found.orderBy(F.desc("z"), "feature").limit(FEATURES).select("feature").toArrow()
    chain = Chain(np.sort(np.asarray(picked.column(0).to_numpy()).astype(np.int64).view(np.uint64)))

    def selected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [chain.rows(n, owner, hashes) for _, n, owner, hashes in text_features(b.column("text"))]
            parts = [(index[p:q], value[p:q]) for indptr, index, value in got for p, q in zip(indptr[:-1], indptr[1:], strict=True)]
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "toxic": b.column("toxic"), "quality": b.column("quality"), "index": pa.array([x.astype(np.int32).tobytes() for x, _ in parts], pa.binary()), "value": pa.array([x.astype(np.float64).tobytes() for _, x in parts], pa.binary())})

    got = sample.mapInArrow(selected, "doc_id long, toxic int, quality int, index binary, value binary").toArrow().sort_by("doc_id")
    toxic, quality = (np.asarray(got.column(c).to_numpy()) > 0 for c in ("toxic", "quality"))
    index = [np.frombuffer(x, np.int32) for x in got.column("index").to_pylist()]
    value = [np.frombuffer(x, np.float64) for x in got.column("value").to_pylist()]
    x = np.concatenate(([0], np.cumsum([len(i) for i in index]))), np.concatenate(index).astype(np.int64), np.concatenate(value)
    chain.fit(x, np.column_stack((toxic, toxic & quality, toxic & ~quality)).astype(float), np.asarray(got.column("doc_id").to_numpy()))
    return chain


def assess(docs: DataFrame, chain: Chain | None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, a chance for each category, rejected; one row for each document."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, n, owner, hashes in text_features(b.column("text")):
                chance = shared.value.chances(n, owner, hashes) if shared.value else np.zeros((n, len(CATEGORIES)))
                yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id").slice(first, n)} | {c: pa.array(chance[:, i]) for i, c in enumerate(CATEGORIES)} | {"rejected": pa.array((chance >= threshold).any(axis=1))})

    return docs.select("doc_id", "text").mapInArrow(score, "doc_id long, " + ", ".join(f"{c} double" for c in CATEGORIES) + ", rejected boolean")
