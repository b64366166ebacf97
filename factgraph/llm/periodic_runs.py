"""Periodic runs of words, found by probing a harmonic grid.

A run is a stretch of consecutive words with smallest period q and a length of at least
max(LEAST, POWER * q) words that no neighbour extends. For every period p the words at
the grid points jp and (j+1)p are compared, n/p tests for each p. A run of POWER periods
or more holds POWER grid points, so POWER - 1 tests in a row succeed; such survivors are
extended to both sides by comparing the text with itself p words on, in chunks of
doubling length. Grid points inside a stretch that was extended already, or inside a run
whose period divides p (which is the same run), are skipped.

Words are runs of bytes outside ``[\\x20\\x09-\\x0D]`` and are told apart by their bytes.
A text is one row of one task, in memory that grows with its words; the grid is probed in
parts of at most PROBES tests. A null or empty text has no words and no runs. Every row is
judged by itself, so repeated rows give repeated results, an empty table gives none, and
other columns are not read. Of runs with equal exponents the one that starts first counts,
then the one of the smaller period.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

LEAST = 6
POWER = 4
#: Grid points that are probed at once; a bound of memory only.
PROBES = 1 << 22
#: Words of the first chunk of an extension.
CHUNK = 64


def numbered(words: list[bytes]) -> np.ndarray:
    """A number for each word; equal words have equal ones."""
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int32, len(words))


def _equal_run(a: np.ndarray, b: np.ndarray) -> int:
    """How many leading items of both arrays are equal."""
    at, size, n = 0, CHUNK, min(len(a), len(b))
    while at < n:
        until = min(n, at + size)
        same = a[at:until] == b[at:until]
        if not same.all():
            return at + int(np.argmin(same))
        at, size = at + len(same), size * 2
    return n


def stretch(ids: np.ndarray, at: int, p: int) -> tuple[int, int]:
    """First word and end of the maximal stretch of period p around the equal words ``at`` and ``at + p``."""
    right = _equal_run(ids[at:], ids[at + p :])
    left = _equal_run(ids[:at][::-1], ids[: at + p][::-1])
    return at - left, at + right + p


def survivors(ids: np.ndarray, power: int = POWER) -> Iterator[tuple[int, np.ndarray]]:
    """For each period with any, the grid points that begin ``power - 1`` successful tests in a row."""
    n = len(ids)
    last = n // power
    points = n // np.arange(1, last + 1)  # of period p: 0, p, .., (points - 1) p
    first = 0
    while first < last:
        total = np.cumsum(points[first:])
        until = first + max(1, int(np.searchsorted(total, PROBES, "right")))
        counts = points[first:until]
        begin = np.cumsum(counts) - counts
        period = np.repeat(np.arange(first + 1, until + 1), counts)
        grid = (np.arange(int(counts.sum())) - np.repeat(begin, counts)) * period
        onward = grid + period
        same = ids[grid] == ids[np.minimum(onward, n - 1)]
        same &= onward < n
        row = same.copy()
        for i in range(1, power - 1):
            # the last grid point of a period never succeeds, so runs of successes don't cross periods
            row[:-i] &= same[i:]
            row[-i:] = False
        hit = np.flatnonzero(row)
        periods = period[hit]
        for part in np.split(np.arange(len(hit)), np.flatnonzero(np.diff(periods)) + 1) if len(hit) else ():
            yield int(periods[part[0]]), grid[hit[part]]
        first = until


def runs(ids: np.ndarray, least: int = LEAST, power: int = POWER) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start and then period."""
    found: list[tuple[int, int, int]] = []
    by_period: dict[int, tuple[list[int], list[int]]] = {}  # starts and ends of the runs of a period, ascending
    for p, points in survivors(ids, power):
        known = [by_period[q] for q in by_period if p % q == 0]
        own: tuple[list[int], list[int]] = ([], [])
        i = 0
        while i < len(points):
            at = int(points[i])
            end = 0
            for starts, ends in known:
                k = bisect_right(starts, at) - 1
                if k >= 0 and at + p < ends[k]:
                    end = max(end, ends[k])
            if not end:
                start, end = stretch(ids, at, p)
                if end - start >= max(least, power * p):
                    own[0].append(start)
                    own[1].append(end)
                    found.append((start, end - start, p))
            # grid points whose next one is inside the stretch as well would find it again
            i = max(i + 1, int(np.searchsorted(points, end - p)))
        if own[0]:
            by_period[p] = own
    return sorted(found, key=lambda r: (r[0], r[2]))


def strongest(found: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of the greatest exact length/period; ties by start, then period."""
    best = None
    for r in found:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return best


def kept(n: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """False for each word that a run holds behind its first period."""
    depth = np.zeros(n + 1, np.int64)
    if found:
        rows = np.array(found)
        np.add.at(depth, rows[:, 0] + rows[:, 2], 1)
        np.add.at(depth, rows[:, 0] + rows[:, 1], -1)
    return np.cumsum(depth[:-1]) == 0


def repeated(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words with the repetition that one document of ten is given by its doc_id; a null doc_id is given none."""
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


SCHEMA = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def _examine(words: list[bytes]) -> tuple:
    found = runs(numbered(words))
    best = strongest(found)
    stay = kept(len(words), found)
    rest = b" ".join(words if stay.all() else [w for w, ok in zip(words, stay.tolist(), strict=True) if ok])
    listed = "".join(f"{s},{n},{p}\n" for s, n, p in found)
    top = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
    return (len(words), [dict(zip(("start", "length", "period"), r, strict=True)) for r in found], *top, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(rest).hexdigest())


def find(docs: DataFrame, planted: bool = False) -> DataFrame:
    """Runs of every row of ``docs(doc_id, text)``, the strongest one, and digests of all runs and of the text without repetitions.

    ``planted`` first gives one document of ten a repetition, by its doc_id.
    """
    schema = pa.schema([
        ("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))),
        *((c, pa.int64()) for c in ("start", "length", "period", "exponent_milli")), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string()),
    ])

    def examine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()), strict=True):
                words = (text.as_py() or b"").split()
                rows.append((doc_id, *_examine(repeated(words, doc_id) if planted else words)))
            columns = list(zip(*rows, strict=True)) or [[] for _ in schema]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(examine, SCHEMA)
