"""Byte-level BPE by dynamic programming over prefixes.

The pre-tokenizer cuts a text into pieces. For every prefix of a piece, exactly one token
can be the last one of the prefix's encoding: a token that is a suffix of the prefix and
may follow the last token of what is in front of it. An automaton over the vocabulary
(Aho-Corasick: tokens with suffix links) gives the tokens that are suffixes of each
prefix; a pair test says whether two tokens may stand side by side, so the one that fits
is stored, and back-pointers from the whole piece give the ids. Time is linear in the
piece's length, however its bytes repeat.

Two tokens may stand side by side unless some merge would have joined across their border
first: each token was put together by merges in order of rank, so its border part at any
rank is known (the right spine of the left token, the left spine of the right one), and a
merge of the two border parts must not come before both parts are used up. A token whose
own merges don't give it back is never emitted.

Pieces of a text are found in chunks, each of white space and what follows it up to the
next white space, which the pre-tokenizer never joins; the ids of chunks and of pieces are
kept in caches that are emptied when full, which changes speed only.

A null text is empty and has no tokens; every row is encoded by itself, so repeated rows
give repeated results, an empty table none; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: The pre-tokenizer's pattern; a fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CHUNK = re.compile(r"\s*\S+|\s+")
#: Characters that only one of the two pattern engines takes for white space.
SPLITTERS = re.compile("[\x1c-\x1f]")
CACHE_CHUNKS, CACHE_PIECES, CACHE_PAIRS = 1_000_000, 1_000_000, 2_000_000
#: Stand-ins for letters, numbers, white space and others beyond ASCII.
STAND_INS = ("é", "²", "　", "†")


def byte_characters() -> list[str]:
    """The character by which the vocabulary writes each byte: itself if printable in Latin-1, else the next one from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return [chr(b) if b in own else chr(256 + rest.index(b)) for b in range(256)]


class Vocabulary:
    """Tokens, merges and the automaton of a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, before = spec["model"], spec["pre_tokenizer"] or {}
        plain = not any(model.get(c) for c in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")) and spec["normalizer"] is None and spec["post_processor"] is None
        if model["type"] != "BPE" or not plain or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True) or spec["decoder"]["type"] != "ByteLevel":
            raise ValueError("not a plain byte-level BPE")
        code = {c: b for b, c in enumerate(byte_characters())}
        size = 1 + max([*model["vocab"].values(), *(t["id"] for t in spec["added_tokens"])])
        self.bytes = [b""] * size
        for token, i in model["vocab"].items():
            self.bytes[i] = bytes(code[c] for c in token)
        self.added: dict[str, int] = {}
        for t in spec["added_tokens"]:
            if t["lstrip"] or t["rstrip"] or t["single_word"]:
                raise ValueError("an added token that takes its surroundings in")
            self.added[t["content"]] = t["id"]
            self.bytes[t["id"]] = t["content"].encode()
        self.size = size
        self._merges(model)
        self._automaton(model)
        self.split_added = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.length = list(map(len, self.bytes))

    def _merges(self, model: dict) -> None:
        """Rank and parts of each token; rank 0 for bytes, the first merge has rank 1."""
        vocab = model["vocab"]
        self.rank, self.parts = [0] * self.size, [None] * self.size
        self.joins: dict[int, int] = {}
        for n, pair in enumerate(model["merges"], 1):
            left, right = (vocab[x] for x in (pair.split(" ") if isinstance(pair, str) else pair))
            token = vocab["".join(pair.split(" ") if isinstance(pair, str) else pair)]
            if self.parts[token] is not None or max(self.rank[left], self.rank[right]) >= n:
                raise ValueError("a token of two merges, or of later ones")
            self.rank[token], self.parts[token] = n, (left, right)
            self.joins[left * self.size + right] = n

    def apart(self, left: int, right: int, before: int | None = None) -> bool:
        """Whether no merge joins the two tokens across their border, or none of a rank below ``before``."""
        end = len(self.joins) + 1 if before is None else before
        left_end = right_end = end  # ranks at which the border parts are taken into larger ones
        while True:
            n = self.joins.get(left * self.size + right)
            # of two places for one merge the one further left goes first
            if n is not None and n < left_end and n <= right_end and n < end:
                return False
            # go back in time to where the later of the two parts was made
            if self.rank[left] >= self.rank[right]:
                if self.parts[left] is None:
                    return True
                left_end, left = self.rank[left], self.parts[left][1]
            else:
                right_end, right = self.rank[right], self.parts[right][0]

    def _automaton(self, model: dict) -> None:
        whole = [False] * self.size
        self.tokens = ahocorasick.Automaton()
        for token in sorted(model["vocab"].values(), key=lambda t: self.rank[t]):
            parts = self.parts[token]
            if parts is None:
                whole[token] = len(self.bytes[token]) == 1
            else:
                whole[token] = whole[parts[0]] and whole[parts[1]] and self.apart(*parts, before=self.rank[token])
            if whole[token]:
                self.tokens.add_word(self.bytes[token].decode("latin-1"), token)
        self.tokens.make_automaton()


class Bpe:
    """Encodes and decodes texts; ``special`` says whether added tokens' strings in a text are those tokens."""

    def __init__(self, path: str, special: bool = True):
        from tokenizers import Tokenizer

        self.vocabulary = Vocabulary(path)
        self.special = special and self.vocabulary.split_added is not None
        self.pre_tokenizer = Tokenizer.from_file(path).pre_tokenizer
        self.pattern = regex.compile(PATTERN)
        self.pairs: dict[int, bool] = {}
        self.chunks: dict[str, bytes] = {}
        self.known: dict[str, bytes] = {}
        self.looked_at = {chr(c) for c in range(128)}
        self.odd: dict[int, str] = {}

    def piece(self, piece: bytes) -> list[int]:
        """Ids of one piece by the table of last tokens."""
        v, pairs = self.vocabulary, self.pairs
        size, length = v.size, v.length
        last = [-1] * (len(piece) + 1)
        for end, token in v.tokens.iter(piece.decode("latin-1")):
            if last[end + 1] >= 0:
                continue
            at = end + 1 - length[token]
            if at:
                key = last[at] * size + token
                fits = pairs.get(key)
                if fits is None:
                    if len(pairs) >= CACHE_PAIRS:
                        pairs.clear()
                    fits = pairs[key] = v.apart(last[at], token)
                if not fits:
                    continue
            last[end + 1] = token
        ids, at = [], len(piece)
        while at:
            ids.append(last[at])
            at -= length[last[at]]
        return ids[::-1]

    def _kind(self, c: str) -> int:
        """Which of letter, number, white space and other the library's pre-tokenizer takes a character for."""
        for kind, mate in enumerate("a1"):
            if len(self.pre_tokenizer.pre_tokenize_str(mate + c)) == 1:
                return kind
        return 3 if len(self.pre_tokenizer.pre_tokenize_str("!" + c)) == 1 else 2

    def _look_at(self, text: str) -> None:
        """Note characters that the library takes for another kind than the pattern engine at hand, whose character tables can be of another version."""
        for c in set(text) - self.looked_at:
            self.looked_at.add(c)
            own = next((k for k, p in enumerate((r"\p{L}", r"\p{N}", r"\s")) if regex.fullmatch(p, c)), 3)
            kind = self._kind(c)
            if own != kind or bool(re.fullmatch(r"\s", c)) != (kind == 2):
                self.odd[ord(c)] = STAND_INS[kind]

    def pieces(self, text: str) -> list[str]:
        """The pieces of a text or chunk."""
        if self.odd and not text.isascii():
            shown = text.translate(self.odd)
            return [text[m.start() : m.end()] for m in self.pattern.finditer(shown)]
        return self.pattern.findall(text)

    def piece_ids(self, piece: str) -> bytes:
        found = self.known.get(piece)
        if found is None:
            if len(self.known) >= CACHE_PIECES:
                self.known.clear()
            found = self.known[piece] = np.array(self.piece(piece.encode()), "<u4").tobytes()
        return found

    def chunk(self, chunk: str) -> bytes:
        found = b"".join(map(self.piece_ids, self.pieces(chunk)))
        if len(self.chunks) >= CACHE_CHUNKS:
            self.chunks.clear()
        self.chunks[chunk] = found
        return found

    def _plain(self, text: str) -> list[bytes]:
        if not text.isascii():
            self._look_at(text)
        known, chunk = self.chunks.get, self.chunk
        if SPLITTERS.search(text) or any(chr(c) in text for c in self.odd):
            return [self.piece_ids(p) for p in self.pieces(text)]
        return [known(c) or chunk(c) for c in CHUNK.findall(text)]

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text."""
        if not self.special:
            return np.frombuffer(b"".join(self._plain(text)), "<u4")
        out: list[bytes] = []
        for n, part in enumerate(self.vocabulary.split_added.split(text)):
            if n % 2:
                out.append(np.array([self.vocabulary.added[part]], "<u4").tobytes())
            elif part:
                out += self._plain(part)
        return np.frombuffer(b"".join(out), "<u4")

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD."""
        return decoded(self.vocabulary.bytes, ids).decode("utf-8", "replace")


def decoded(tokens: list[bytes], ids: np.ndarray) -> bytes:
    """The bytes of all ids, one after the other."""
    return b"".join(map(tokens.__getitem__, ids.tolist()))


_CODERS: dict[tuple[str, bool], Bpe] = {}


def coder(path: str, special: bool = True) -> Bpe:
    """The worker's coder of a vocabulary file."""
    return _CODERS.get((path, special)) or _CODERS.setdefault((path, special), Bpe(path, special))


def encoded(docs: DataFrame, path: str, special: bool = True) -> DataFrame:
    """Ids of each row: doc_id, ids."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path, special)
        return _by_row(batches, lambda text: bpe.encode(text), pa.list_(pa.int32()), "ids")

    return docs.select("doc_id", "text").mapInArrow(encode, "doc_id long, ids array<int>")


def _by_row(batches: Iterator[pa.RecordBatch], f: Callable, kind: pa.DataType, name: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array([f(t.as_py() or "") for t in batch.column(1)], kind)], ["doc_id", name])


def digests(docs: DataFrame, path: str, special: bool = True) -> DataFrame:
    """Encode each row and decode it again: doc_id, n_tokens, and digests of the ids and of the decoded text."""
    kind = pa.struct([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path, special)

        def one(text: str) -> dict:
            ids = bpe.encode(text)
            listed = ",".join(map(str, ids.tolist()))
            return {"n_tokens": len(ids), "ids_sha256": hashlib.sha256(listed.encode()).hexdigest(), "decoded_sha256": hashlib.sha256(bpe.decode(ids).encode()).hexdigest()}

        return _by_row(batches, one, kind, "found")

    found = docs.select("doc_id", "text").mapInArrow(digest, "doc_id long, found struct<n_tokens:long,ids_sha256:string,decoded_sha256:string>")
    return found.select("doc_id", "found.*")
