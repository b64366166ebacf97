"""Encoding of many rows by their distinct pieces.

A text is cut where no token of the tokenizer at hand can cross; each distinct piece is
encoded once and kept in a cache, which is emptied when full. A piece is looked up by its
hash and taken from the cache only if its bytes are equal.
"""

from __future__ import annotations

import os
from itertools import chain

import numpy as np

from factgraph.llm.words import word_hashes

STOPS = np.frombuffer(b".,:;!?", np.uint8)
#: Entries of a worker's cache of encoded pieces, about 130 bytes each; it is emptied when full, which changes speed only.
CACHE_PIECES = 1_500_000


class Pieces:
    """Ids of rows through a cache of at most ``most`` pieces; subclasses say where pieces begin and encode them."""

    def __init__(self, most: int = CACHE_PIECES):
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.keys, self.entry = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.start, self.length = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.raw_start, self.raw_length = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat, self.raw = np.zeros(0, np.uint32), np.zeros(0, np.uint8)

    def cuts(self, data: np.ndarray) -> np.ndarray:
        """Whether a piece begins at each byte; rows begin pieces in any case."""
        raise NotImplementedError

    def ids(self, pieces: list[str]) -> list[list[int]]:
        raise NotImplementedError

    def hashes(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return word_hashes(data, begin, end)

    def learn(self, pieces: list[bytes]) -> np.ndarray:
        """Numbers of new entries for the pieces."""
        ids = self.ids([p.decode("utf-8", "replace") for p in pieces])
        first = len(self.start) + np.arange(len(pieces))
        length = np.fromiter(map(len, ids), np.int64, len(ids))
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        self.start = np.concatenate((self.start, len(self.flat) + np.cumsum(length) - length))
        self.raw_start = np.concatenate((self.raw_start, len(self.raw) + np.cumsum(size) - size))
        self.length, self.raw_length = np.concatenate((self.length, length)), np.concatenate((self.raw_length, size))
        self.flat = np.concatenate((self.flat, np.fromiter(chain.from_iterable(ids), np.uint32, int(length.sum()))))
        self.raw = np.concatenate((self.raw, np.frombuffer(b"".join(pieces), np.uint8)))
        return first

    def other(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray, entry: np.ndarray) -> np.ndarray:
        """Whether each piece's bytes are others than its entry's; the pieces cover the data."""
        at = np.arange(len(data)) + np.repeat(self.raw_start[entry] - begin, size)
        same = self.raw[np.minimum(at, len(self.raw) - 1)] == data
        return (self.raw_length[entry] != size) | ~np.logical_and.reduceat(same, begin)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows of a slice, and how many each row has."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        cut = self.cuts(data)
        cut[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
        begin = np.flatnonzero(cut)
        end = np.concatenate((begin[1:], [len(data)]))
        keys, first, back = np.unique(self.hashes(data, begin, end), return_index=True, return_inverse=True)
        if len(self.keys) + len(keys) > self.most:
            self.clear()
        at = np.searchsorted(self.keys, keys)
        new = np.ones(len(keys), bool)
        inside = at < len(self.keys)
        new[inside] = self.keys[at[inside]] != keys[inside]
        if new.any():
            raw = data.tobytes()
            made = self.learn([raw[begin[i] : end[i]] for i in first[new]])
            self.keys, self.entry = np.insert(self.keys, at[new], keys[new]), np.insert(self.entry, at[new], made)
            at = np.searchsorted(self.keys, keys)
        entry = self.entry[at][back]
        wrong = np.flatnonzero(self.other(data, begin, end - begin, entry))
        if len(wrong):  # pieces whose hash is another piece's; their entries have no key
            raw = data.tobytes()
            entry[wrong] = self.learn([raw[begin[i] : end[i]] for i in wrong])
        start, length = self.start[entry], self.length[entry]
        until = np.cumsum(length)
        ids = self.flat[np.repeat(start - until + length, length) + np.arange(until[-1])]
        until = np.concatenate(([0], until))
        return ids, np.diff(until[np.searchsorted(begin, offsets)])


class BytePieces(Pieces):
    """Byte-level BPE of the tokenizers library.

    Texts are cut into pieces where white space follows another character, and where
    an ASCII letter is followed by one of ``.,:;!?``. The byte-level
    pre-tokenizer always begins a token at such places, so a text's ids are those of
    its pieces, one after the other. A place behind a white-space character beyond
    ASCII isn't cut. Special tokens must hold neither white space nor those characters;
    with ``special`` false their strings are plain text.
    """

    def __init__(self, path: str, special: bool = True, most: int = CACHE_PIECES):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        super().__init__(most)

    def cuts(self, data: np.ndarray) -> np.ndarray:
        blank = (data == 32) | ((data >= 9) & (data <= 13))
        letter = ((data | 32) >= 97) & ((data | 32) <= 122)
        cut = np.zeros(len(data), bool)
        cut[1:] = (blank[1:] & ~blank[:-1]) | (letter[:-1] & np.isin(data[1:], STOPS))
        wide = np.flatnonzero(cut & np.concatenate(([False], data[:-1] >= 128)))
        if len(wide):
            a, b = data[wide - 1], data[wide - 2]
            c = data[np.maximum(wide - 3, 0)]
            far = ((b == 0xC2) & ((a == 0xA0) | (a == 0x85))) | ((b == 0x80) & (c == 0xE2)) | ((b == 0x81) & (c == 0xE2)) | ((b == 0x9A) & (c == 0xE1)) | ((b == 0x80) & (c == 0xE3))
            cut[wide[far]] = False
        return cut

    def ids(self, pieces: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
