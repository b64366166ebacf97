"""Quality rules: exact counters and a hashed n-gram logistic model over whole texts.

The model reads word unigrams and bigrams and character 3- and 4-grams of every text,
hashed to ``BUCKETS`` places; a feature's value is its share of the text's n-grams
of that kind. It is fitted on at most ``TRAIN_ROWS`` labelled documents (those with
the smallest hashes of doc_id; a fifth of them calibrates the probability) and
scores every document in Arrow batches against a fixed threshold.

A null text counts as empty; documents without labels are scored all the same;
repeated labels of a document count once, the worse one; without two classes of
labels the verdict is the base rule's alone. Columns besides doc_id and text are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factgraph.llm.linear import fit, folds, margins, platt, sigmoid
from factgraph.llm.words import combine, rows_of, text_slices, word_bounds, word_hashes

BUCKETS = 1 << 18
TRAIN_ROWS = 3000
THRESHOLD = 0.5
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True


def per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many of the flags are set in each row."""
    sums = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return sums[offsets[1:]] - sums[offsets[:-1]]


def seen_before(rows: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry: whether its key stands earlier in its row, and whether it stands there twice or more."""
    pair = combine(rows.astype(np.uint64), keys)
    order = np.argsort(pair, kind="stable")
    same = pair[order][1:] == pair[order][:-1]
    again, shared = np.zeros(len(pair), bool), np.zeros(len(pair), bool)
    again[order[1:]] = same
    shared[order[1:]] = same
    shared[order[:-1]] |= same
    return again, shared


def repeated_words(words: np.ndarray, bounds: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Words of each row that stand in a window found twice or more in the row."""
    n = len(words) - window + 1
    if n <= 0:
        return np.zeros(len(bounds) - 1, np.int64)
    rows = rows_of(bounds)
    whole = np.flatnonzero(rows[:n] == rows[window - 1 :])
    _, shared = seen_before(rows[whole], combine(*(words[i : i + n] for i in range(window)))[whole])
    edge = np.zeros(len(words) + 1, np.int64)
    edge[whole[shared]] += 1
    edge[whole[shared] + window] -= 1
    return per_row(np.cumsum(edge[:-1]) > 0, bounds)


def duplicate_lines(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray) -> np.ndarray:
    r"""Lines (split at \n) of each row that hold a word and equal an earlier line of the row."""
    if not len(data):
        return np.zeros(len(offsets) - 1, np.int64)
    cut = np.zeros(len(data) + 1, bool)
    cut[np.flatnonzero(data == 10) + 1] = True
    cut[offsets[:-1]] = True
    begin = np.flatnonzero(cut[:-1])
    end = np.concatenate((begin[1:], [len(data)]))
    end = end - (data[end - 1] == 10)
    worded = np.searchsorted(starts, end) > np.searchsorted(starts, begin)
    begin, end = begin[worded], end[worded]
    rows = np.searchsorted(offsets, begin, "right") - 1
    again, _ = seen_before(rows, word_hashes(data, begin, end))
    return np.bincount(rows[again], minlength=len(offsets) - 1).astype(np.int64)


def counters(data: np.ndarray, offsets: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """Base counters of each row, with the word hashes and where each row's words begin."""
    starts, ends, bounds = word_bounds(data, offsets)
    words = word_hashes(data, starts, ends)
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    return {
        "n_words": np.diff(bounds),
        "word_chars": per_row(~blank & ((data & 0xC0) != 0x80), offsets),
        "n_symbols": per_row(SYMBOLS[data], offsets),
        "n_dup_lines": duplicate_lines(data, offsets, starts),
        "n_repeat_words": repeated_words(words, bounds),
    }, words, bounds


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the bytes, and where the rows begin in them; a byte that isn't UTF-8 is one replacement point or more."""
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    at = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[offsets]
    if len(points) == at[-1]:
        return points, at
    rows = [np.frombuffer(data[p:q].tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32) for p, q in zip(offsets[:-1], offsets[1:], strict=True)]
    return np.concatenate([*rows, np.zeros(0, np.uint32)]), np.concatenate(([0], np.cumsum([len(x) for x in rows])))


def buckets(data: np.ndarray, offsets: np.ndarray, words: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket of every n-gram, row offsets in them) for each kind of n-gram; none crosses rows."""
    mask = np.uint64(BUCKETS // 4 - 1)
    yield (words & mask).astype(np.int64), bounds
    rows = rows_of(bounds)
    same = rows[1:] == rows[:-1]
    got = combine(words[:-1], words[1:])[same] if len(words) > 1 else words[:0]
    yield (got & mask).astype(np.int64) + BUCKETS // 4, np.concatenate(([0], np.cumsum(np.maximum(np.diff(bounds) - 1, 0))))
    wide, offsets = code_points(data, offsets)
    for kind, n in ((2, 3), (3, 4)):
        count = np.maximum(np.diff(offsets) - n + 1, 0)
        if len(wide) < n:
            yield np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
            continue
        gram = wide[: len(wide) - n + 1].copy()
        for i in range(1, n):
            gram = gram * np.uint32(16777619) + wide[i : len(wide) - n + 1 + i]
        spread = (gram * np.uint32(2654435769)) >> np.uint32(16)
        keep = np.ones(len(gram) + n - 1, bool)
        for i in range(1, n):
            at = offsets[1:] - i
            keep[at[at >= offsets[:-1]]] = False
        yield spread[keep[: len(gram)]].astype(np.int64) + kind * (BUCKETS // 4), np.concatenate(([0], np.cumsum(count)))


def sparse_rows(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct buckets and values of each text."""
    for _, data, offsets in text_slices(column):
        _, words, bounds = counters(data, offsets)
        kinds = list(buckets(data, offsets, words, bounds))
        for r in range(len(offsets) - 1):
            index, value = [], []
            for got, at in kinds:
                own, n = np.unique(got[at[r] : at[r + 1]], return_counts=True)
                index.append(own)
                value.append(n / max(1, n.sum()))
            yield np.concatenate(index).astype(np.int32), np.concatenate(value).astype(np.float32)


def labelled(docs: DataFrame, labels: DataFrame, columns: list[str], rows: int) -> DataFrame:
    """At most ``rows`` labelled documents, those with the smallest hashes of doc_id; the broadcast is bounded by ``rows``."""
    found = labels.where(" and ".join(f"{c} is not null" for c in ["doc_id", *columns])).groupBy("doc_id").agg(*(F.min(c).alias(c) for c in columns))
    chosen = found.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")


class Model:
    """Hashed weights with the calibration; ``chance`` gives the probability of good quality for rows of n-gram buckets."""

    def __init__(self, weights: np.ndarray, bias: float, a: float, b: float):
        self.weights, self.bias, self.a, self.b = weights.astype(np.float32), bias, a, b

    def chance(self, kinds: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        total = 0.0
        for got, at in kinds:
            sums = np.concatenate(([0.0], np.cumsum(self.weights[got], dtype=np.float64)))
            total = total + (sums[at[1:]] - sums[at[:-1]]) / np.maximum(1, np.diff(at))
        return sigmoid(self.a * (total + self.bias) + self.b)


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model | None:
    """Fit on the bounded sample; None without both classes."""

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = list(sparse_rows(b.column("text")))
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "y": b.column("quality").cast(pa.int64()), "index": pa.array([x.tobytes() for x, _ in got], pa.binary()), "value": pa.array([x.tobytes() for _, x in got], pa.binary())})

    sample = labelled(docs, labels, ["quality"], rows).mapInArrow(features, "doc_id long, y long, index binary, value binary").toArrow().sort_by("doc_id")
    y = (np.asarray(sample.column("y").to_numpy()) > 0).astype(float)
    if not 1 < y.sum() < len(y) - 1:
        return None
    index = [np.frombuffer(x, np.int32) for x in sample.column("index").to_pylist()]
    value = [np.frombuffer(x, np.float32) for x in sample.column("value").to_pylist()]
    held = folds(np.asarray(sample.column("doc_id").to_numpy()), y, 5) == 4
    if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
        held = np.ones(len(y), bool)

    def rows_in(which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        own = np.flatnonzero(which)
        return np.concatenate(([0], np.cumsum([len(index[i]) for i in own]))), np.concatenate([index[i] for i in own]), np.concatenate([value[i] for i in own])

    learn = ~held if not held.all() else held
    weights, bias = fit(*rows_in(learn), y[learn], BUCKETS, 1e-7, 120, 2.0)
    a, b = platt(margins(*rows_in(held), weights) + bias, y[held])
    return Model(weights, bias, a, b)


def assess(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, the base counters, base_failed, chance (calibrated probability of good quality) and kept, for every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column("doc_id")
            for first, data, offsets in text_slices(b.column("text")):
                got, words, bounds = counters(data, offsets)
                failed = (got["n_words"] < MIN_WORDS) | (100 * got["n_repeat_words"] > MAX_REPEAT_PERCENT * got["n_words"])
                chance = shared.value.chance(buckets(data, offsets, words, bounds)) if shared.value else np.ones(len(failed))
                yield pa.RecordBatch.from_pydict({"doc_id": keys.slice(first, len(failed))} | {k: pa.array(got[k].astype(np.int64)) for k in names} | {"base_failed": pa.array(failed), "chance": pa.array(chance), "kept": pa.array(~failed & (chance >= threshold))})

    return docs.select("doc_id", "text").mapInArrow(score, "doc_id long, " + ", ".join(f"{k} long" for k in names) + ", base_failed boolean, chance double, kept boolean")
