"""Vectorised word splitting and hashing over Arrow string columns.

A word is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]``. Words are told
apart by polynomial hashes of their UTF-8 bytes modulo two primes below 2**31, 62 bits
in all (two different words of a corpus with V distinct ones meet with a chance of about
V*V / 2**63; modulo a power of two, words with a pattern could meet whatever the
multiplier is). A null text
counts as empty. Work goes over slices of a bounded number of bytes, so one batch
of long texts does not need memory for all of them at once; a single text is
never cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2_000_000
_MULT = 0x9E3779B97F4A7C15
#: Prime moduli of the hashes, the multiplier of each, and the value that each byte stands for is one more than it.
MODULI = ((2_147_483_647, 1_640_531_527), (2_147_483_629, 1_235_791_113))
#: Bytes whose terms (below 2**40) can be summed up in 64 bits.
SUMMED = 1 << 23
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(prime: int, base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least the first n powers of the base and of its inverse."""
    have = _POWERS.get(prime)
    if have is None or len(have[0]) < n:
        out = []
        for b in (base, pow(base, -1, prime)):
            values = np.ones(1, np.uint32)
            while len(values) < max(n, SLICE_BYTES + 1):
                more = values.astype(np.uint64) * np.uint64(pow(b, len(values), prime)) % np.uint64(prime)
                values = np.concatenate((values, more.astype(np.uint32)))
            out.append(values)
        have = _POWERS[prime] = tuple(out)
    return have


def _sums(data: np.ndarray, prime: int, base: int) -> np.ndarray:
    """Sums of the terms of all bytes in front of each place."""
    terms = np.empty(len(data) + 1, np.uint64)
    terms[0] = 0
    np.add(data, 1, out=terms[1:], dtype=np.uint64)
    terms[1:] *= _powers(prime, base, len(data) + 1)[0][: len(data)]
    if len(data) > SUMMED:
        terms %= np.uint64(prime)
    return np.cumsum(terms, out=terms)


def _part(sums: np.ndarray, prime: int, base: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return (sums[ends] - sums[starts]) % np.uint64(prime) * _powers(prime, base, len(sums))[1][starts] % np.uint64(prime)


def _joined(a: np.ndarray, b: np.ndarray, kind: int = 0) -> np.ndarray:
    return mix((a << np.uint64(31) | b) + np.uint64(kind << 62))


class Spans:
    """Hashes of any spans of the same bytes, by prefix sums that are held for both moduli."""

    def __init__(self, data: np.ndarray):
        self.sums = [_sums(data, *m) for m in MODULI]

    def hashes(self, starts: np.ndarray, ends: np.ndarray, kind: int = 0) -> np.ndarray:
        """uint64 hash of each span; different kinds give different ones."""
        return _joined(*(_part(sums, *m, starts, ends) for sums, m in zip(self.sums, MODULI, strict=True)), kind)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of uint64 values."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets of the rows in the bytes) for runs of rows of at most ``limit`` bytes, one row at least."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        last = min(last, n)
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words, and where each row's words begin in them (one entry more than rows)."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[heads] = inside[heads]
    tails = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    ends[tails] = inside[tails]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """uint64 hash of every word."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    # one modulus after the other, so only one array of sums is held
    return _joined(*(_part(_sums(data, *m), *m, starts, ends) for m in MODULI))


def combine(*parts: np.ndarray) -> np.ndarray:
    """uint64 hash of a tuple of uint64 columns."""
    h = np.zeros(len(parts[0]), np.uint64)
    for p in parts:
        h = mix(h * np.uint64(_MULT) + p)
    return h


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words; empty when there are fewer."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    return combine(*(words[i : i + n] for i in range(k)))


def rows_of(bounds: np.ndarray) -> np.ndarray:
    """Row number of each word, from where rows' words begin."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
