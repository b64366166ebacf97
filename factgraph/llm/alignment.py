"""Alignment of two tokenizers' tokens over the same bytes, and how often their ids meet in a corpus.

Both tokenizers encode a space and the text. The B tokens of a text are a static interval
index: their byte starts and ends, sorted. Each A token stabs it by two bisections and gets
the list of the B tokens that it overlaps; where the last of them ends with the A token,
no token spans the gap behind it, and a group ends. All A and B tokens of a group are linked.

How many documents hold a pair of ids linked is counted over the whole corpus:

1. Tasks align their rows and write blocks of a bounded number of bytes: what is known of
   each row, the block's distinct pairs with the number of rows that hold them, and which
   pairs each row holds how often.
2. The blocks' pairs are added up by pair, and the highest count of each A id is taken.
3. Each block gets the counts of its pairs back and adds them up by row.

A text has no tokens (zeros, an empty digest) if it is null or empty, or if the joined bytes of either
tokenizer's tokens differ from the space and the text. Every row is a document of its own,
repeated ones and those without a doc_id too; an empty table gives no rows; other columns
are not read. All ids of the highest count are best ones.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factgraph.llm.bpe import byte_characters
from factgraph.llm.packing import expand, squeeze
from factgraph.llm.pieces import BytePieces, Pieces
from factgraph.llm.tables import saved
from factgraph.llm.words import text_slices

#: Bytes of the texts of a block, about; a longer text is a block of its own.
BLOCK_BYTES = 8_000_000
#: Entries of a worker's cache for each of the two tokenizers.
CACHE_PIECES = 300_000
#: Bytes that are aligned at once.
SLICE_BYTES = 1_000_000
SPACE = "▁"


class BpePieces(BytePieces):
    """The byte-level tokenizer with the bytes of each of its tokens."""

    def __init__(self, path: str):
        super().__init__(path, special=False, most=CACHE_PIECES)
        code = {c: b for b, c in enumerate(byte_characters())}
        self.tokens = [b""] * self.tokenizer.get_vocab_size()
        for token, i in self.tokenizer.get_vocab().items():
            self.tokens[i] = bytes(code[c] for c in token) if all(c in code for c in token) else token.encode()


class SentencePieces(Pieces):
    """The sentencepiece tokenizer, for texts behind a space, with the bytes of each of its tokens.

    No piece of its vocabulary has a space behind another character, so texts are cut at
    such spaces; a text is one piece with a vocabulary that has.
    """

    def __init__(self, path: str):
        self.processor = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.processor.id_to_piece(i) for i in range(self.processor.get_piece_size())]
        self.separable = not any(SPACE in n.lstrip(SPACE) for n in names)
        self.space = self.processor.piece_to_id(SPACE)
        self.tokens = [bytes([int(n[1:-1], 16)]) if self.processor.is_byte(i) else n.replace(SPACE, " ").encode() for i, n in enumerate(names)]
        super().__init__(CACHE_PIECES)

    def cuts(self, data: np.ndarray) -> np.ndarray:
        cut = np.zeros(len(data), bool)
        if self.separable:
            cut[1:] = (data[1:] == 32) & (data[:-1] != 32)
        return cut

    def ids(self, pieces: list[str]) -> list[list[int]]:
        # the processor puts a space in front of a text, but gives nothing for an empty one
        return [x if len(p) > 1 else [self.space] for p, x in zip(pieces, self.processor.encode([p[1:] for p in pieces], num_threads=1), strict=True)]


class Table:
    """Bytes of the tokens of one tokenizer, for gathering."""

    def __init__(self, tokens: list[bytes]):
        self.length = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.start = np.cumsum(self.length) - self.length
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)

    def rows_that_differ(self, ids: np.ndarray, counts: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Whether the joined bytes of each row's tokens are others than the row's."""
        size = self.length[ids]
        until = np.concatenate(([0], np.cumsum(size)))
        ends = until[np.cumsum(counts)]
        begins = np.concatenate(([0], ends[:-1]))
        wanted = np.diff(offsets)
        differs = ends - begins != wanted
        if differs.any():
            keep = np.repeat(~differs, counts)
            ids, size = ids[keep], size[keep]
            data = data[np.repeat(~differs, wanted)]
        until = np.cumsum(size)
        bytes_ = self.flat[np.repeat(self.start[ids] - until + size, size) + np.arange(len(data))]
        wrong = np.flatnonzero(bytes_ != data)
        if len(wrong):
            rows = np.repeat(np.flatnonzero(~differs), wanted[~differs])
            differs[rows[wrong]] = True
        return differs


def aligned(a_start: np.ndarray, a_end: np.ndarray, b_start: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Last A and last B token of each group, of tokens that cover the same bytes without a gap."""
    # the B tokens that an A token overlaps are those from the first that ends behind its start to the last that begins before its end
    last = np.searchsorted(b_start, a_end, "left") - 1
    border = b_end[last] == a_end
    return np.flatnonzero(border), last[border]


class Aligner:
    def __init__(self, a_path: str, b_path: str):
        self.coders = (BpePieces(a_path), SentencePieces(b_path))
        self.tables = tuple(Table(c.tokens) for c in self.coders)
        self.sizes = tuple(len(c.tokens) for c in self.coders)
        self.names = [f"{i},".encode() for i in range(max(self.sizes))] + [f"{i}|".encode() for i in range(max(self.sizes))] + [f"{i};".encode() for i in range(max(self.sizes))]

    def slice(self, data: np.ndarray, offsets: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """For rows (a space and the text): n_a, n_b, n_groups, n_links of each, digests, and rows, pairs and numbers of its distinct linked pairs."""
        n = len(offsets) - 1
        got = [c.encode(data, offsets) for c in self.coders]
        drop = ~there
        for table, (ids, counts) in zip(self.tables, got, strict=True):
            drop = drop | table.rows_that_differ(ids, counts, data, offsets)
        ids, counts, starts, ends = [], [], [], []
        for table, (own, each) in zip(self.tables, got, strict=True):
            if drop.any():
                own, each = own[~np.repeat(drop, each)], np.where(drop, 0, each)
            until = np.cumsum(table.length[own])
            ids.append(own.astype(np.int64))
            counts.append(each)
            ends.append(until)
            starts.append(until - table.length[own])
        last_a, last_b = aligned(starts[0], ends[0], starts[1], ends[1])
        size_a, size_b = (np.diff(x, prepend=-1) for x in (last_a, last_b))
        row = np.searchsorted(np.cumsum(counts[0]), last_a, "right")
        numbers = np.stack((*counts, np.bincount(row, minlength=n), np.bincount(row, size_a * size_b, n).astype(np.int64)))
        digests = self._digests(ids, last_a, last_b, size_a, size_b, row, n)
        # every A token of a group meets the B tokens of it
        each = np.repeat(size_b, size_a)
        first_b = np.repeat(last_b - size_b + 1, size_a)
        until = np.cumsum(each)
        b = ids[1][np.repeat(first_b - until + each, each) + np.arange(until[-1] if len(until) else 0)]
        pair = np.repeat(ids[0], each) * self.sizes[1] + b
        whole = np.repeat(np.repeat(row, size_a), each) * (self.sizes[0] * self.sizes[1]) + pair
        whole, times = np.unique(whole, return_counts=True)
        rows, pairs = np.divmod(whole, self.sizes[0] * self.sizes[1])
        return numbers, digests, rows, pairs, times

    def _digests(self, ids: list[np.ndarray], last_a: np.ndarray, last_b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, row: np.ndarray, n: int) -> list[str]:
        """Digest of each row's groups, written a1,a2|b1;a3|b2,b3; empty without tokens."""
        shift = max(self.sizes)
        codes = np.empty(len(ids[0]) + len(ids[1]), np.int64)
        a, b = ids[0].copy(), ids[1].copy()
        a[last_a] += shift
        b[last_b] += 2 * shift
        # a group's A tokens stand behind all B tokens of earlier groups, its B tokens behind all A tokens up to its own
        codes[np.arange(len(a)) + np.repeat(last_b + 1 - size_b, size_a)] = a
        codes[np.arange(len(b)) + np.repeat(last_a + 1, size_b)] = b
        out, at = [""] * n, 0
        per_row = np.bincount(row, size_a + size_b, n).astype(np.int64).tolist()
        codes, names = codes.tolist(), self.names
        for r, size in enumerate(per_row):
            if size:
                out[r] = hashlib.sha256(b"".join(map(names.__getitem__, codes[at : at + size]))[:-1]).hexdigest()
                at += size
        return out


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(a_path: str, b_path: str) -> Aligner:
    """The worker's aligner of two vocabulary files."""
    key = (a_path, b_path)
    return _ALIGNERS.get(key) or _ALIGNERS.setdefault(key, Aligner(*key))


DOC = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
KINDS = pa.struct([(c, pa.string() if c == DOC[-1] else pa.int64()) for c in DOC])
DOCS = f"array<struct<{','.join(c + (':string' if c == DOC[-1] else ':long') for c in DOC)}>>"


def blocks(docs: DataFrame, a_path: str, b_path: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Align ``docs(doc_id, text)`` and write the blocks: block, docs, pairs with their number of docs, and the docs' entries (positions of pairs, how often, how many of each doc)."""

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, seq = aligner(a_path, b_path), TaskContext.get().partitionId(), 0
        held: list[tuple] = []
        size = 0

        def block() -> pa.RecordBatch:
            rows, pairs, times = (np.concatenate([h[i] for h in held]) for i in (1, 2, 3))
            pairs, at = np.unique(pairs, return_inverse=True)
            columns = {
                "block": pa.array([part << 32 | seq], pa.int64()),
                "docs": pa.array([[d for h in held for d in h[0]]], pa.list_(KINDS)),
                "pairs": pa.array([pairs], pa.list_(pa.int64())),
                "held_by": pa.array([np.bincount(at, minlength=len(pairs))], pa.list_(pa.int64())),
                "at": pa.array([squeeze(at.astype(np.uint32))], pa.binary()),
                "times": pa.array([squeeze(times.astype(np.uint32))], pa.binary()),
                "entries": pa.array([squeeze(rows.astype(np.uint32))], pa.binary()),
            }
            return pa.RecordBatch.from_pydict(columns)

        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), pc.fill_null(batch.column(1).cast(pa.large_string()), "")
            lead = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts, pa.scalar("", pa.large_string()))
            there = np.asarray(pc.greater(pc.binary_length(texts), 0))
            for first, data, offsets in text_slices(lead, SLICE_BYTES):
                n = len(offsets) - 1
                numbers, digests, rows, pairs, times = own.slice(data, offsets, there[first : first + n])
                found = [dict(zip(DOC, (k, *x, d), strict=True)) for k, x, d in zip(keys[first : first + n], numbers.T.tolist(), digests, strict=True)]
                held.append((found, np.bincount(rows, minlength=n), pairs, times))
                size += len(data)
                if size >= block_bytes:
                    yield block()
                    held, size, seq = [], 0, seq + 1
        if held:
            yield block()

    found = docs.select("doc_id", "text").mapInArrow(align, f"block long, docs {DOCS}, pairs array<long>, held_by array<long>, at binary, times binary, entries binary")
    return saved(found, "aligned")


def counts(written: DataFrame, size_b: int) -> DataFrame:
    """pair, n (documents that hold it linked) and best (no other pair of the A id has more) of all pairs of the blocks."""
    rows = written.select(F.explode(F.arrays_zip("pairs", "held_by")).alias("p")).select(F.col("p.pairs").alias("pair"), F.col("p.held_by").alias("held_by"))
    found = saved(rows.groupBy("pair").agg(F.sum("held_by").alias("n")).withColumn("a", F.expr(f"pair div {size_b}")), "pair-counts")
    top = found.groupBy("a").agg(F.max("n").alias("top"))
    return found.join(top, "a").select("pair", "n", (F.col("n") == F.col("top")).alias("best"))


def align(docs: DataFrame, a_path: str, b_path: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Align every row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    written = blocks(docs, a_path, b_path, block_bytes)
    size_b = sentencepiece.SentencePieceProcessor(model_file=b_path).get_piece_size()
    asked = written.select("block", F.posexplode("pairs").alias("place", "pair"))
    told = asked.join(counts(written, size_b), "pair").groupBy("block").agg(F.sort_array(F.collect_list(F.struct("place", "n", "best"))).alias("told"))
    rows = written.select("block", "docs", "at", "times", "entries").join(told, "block", "left").select("docs", "at", "times", "entries", F.col("told.n").alias("n"), F.col("told.best").alias("best"))
    schema = pa.schema([(c, pa.string() if c == DOC[-1] else pa.int64()) for c in (*DOC[:-1], "n_best", "count_sum", DOC[-1])])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                found = batch.column(0)[i].values
                at, times, entries = (expand(batch.column(c)[i].as_py(), np.uint32).astype(np.int64) for c in (1, 2, 3))
                n, best = (np.asarray(batch.column(c)[i].values).astype(np.int64) if batch.column(c)[i].is_valid else np.zeros(0, np.int64) for c in (4, 5))
                until = np.cumsum(entries)
                sums = [np.diff(np.concatenate(([0], np.cumsum(times * x[at])))[np.concatenate(([0], until))]) for x in (best, n)]
                parts = dict(zip(DOC, found.flatten(), strict=True)) | {"n_best": pa.array(sums[0]), "count_sum": pa.array(sums[1])}
                yield pa.RecordBatch.from_arrays([parts[f.name] for f in schema], schema=schema)

    return rows.mapInArrow(add_up, ", ".join(f"{f.name} {'string' if f.name == DOC[-1] else 'long'}" for f in schema))
