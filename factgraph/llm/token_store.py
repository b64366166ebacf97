"""Token ids in patched frame-of-reference files.

Documents are range-partitioned and sorted by ``doc_id``; every partition writes
its ids as a run of shards (one row with one file image each, put in place by
Spark's own writer, so a lost executor's half-written shard is never seen). A shard:

    magic "PFR1" | u32 docs | u64 tokens | u32 blocks
    i64 doc ids (docs) | u8 doc id present (docs) | u64 tokens of each document (docs)
    u64 byte where each block starts in the body (blocks + 1)
    body; a block holds 128 ids (the last one is padded with its minimum):
        u32 minimum | u8 width | u8 exceptions
        128 x width bits, least significant first
        u8 position, u32 value less the minimum, for each exception

The width is that of the value at the given percentile of the block's differences;
values that need more bits stand in the exception list.

Null texts are empty documents (one end id); a null ``doc_id`` sorts first and is
kept; repeated rows are all written, ordered by text; an empty table gives no shard.
A document of any length stays whole in one shard.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factgraph.llm.pieces import BytePieces
from factgraph.llm.tables import partitions, saved
from factgraph.llm.words import text_slices

BLOCK = 128
MAGIC = b"PFR1"
SHARD_TOKENS = 1_000_000
PERCENTILE = 90


def bit_length(values: np.ndarray) -> np.ndarray:
    """Bits that each non-negative integer needs."""
    return np.frexp(values.astype(np.float64))[1]


def pack(ids: np.ndarray, percentile: int = PERCENTILE) -> tuple[np.ndarray, bytes]:
    """Byte starts of the blocks (one more than blocks) and the body."""
    n = len(ids)
    if not n:
        return np.zeros(1, np.uint64), b""
    blocks = -(-n // BLOCK)
    grid = np.empty(blocks * BLOCK, np.int64)
    grid[:n] = ids
    grid[n:] = ids[n - n % BLOCK :].min() if n % BLOCK else 0
    grid = grid.reshape(blocks, BLOCK)
    low = grid.min(axis=1)
    grid -= low[:, None]
    at = min(BLOCK - 1, BLOCK * percentile // 100)
    width = bit_length(np.partition(grid, at, axis=1)[:, at])
    over = grid >> width[:, None] != 0
    outliers = over.sum(axis=1)
    size = 6 + BLOCK // 8 * width + 5 * outliers
    starts = np.zeros(blocks + 1, np.int64)
    np.cumsum(size, out=starts[1:])
    body = np.zeros(starts[-1], np.uint8)
    head = np.empty((blocks, 6), np.uint8)
    head[:, :4] = low.astype("<u4").view(np.uint8).reshape(-1, 4)
    head[:, 4], head[:, 5] = width, outliers
    body[starts[:-1, None] + np.arange(6)] = head
    for w in np.unique(width):
        if w:
            own = np.flatnonzero(width == w)
            part = (grid[own] & ((1 << int(w)) - 1)).astype("<u4").view(np.uint8).reshape(len(own), BLOCK, 4)
            bits = np.unpackbits(part, axis=2, count=int(w), bitorder="little")
            body[starts[own][:, None] + 6 + np.arange(BLOCK // 8 * w)] = np.packbits(bits.reshape(len(own), -1), axis=1, bitorder="little")
    row, column = np.nonzero(over)
    if len(row):
        nth = np.arange(len(row)) - np.repeat(np.cumsum(outliers) - outliers, outliers)
        base = starts[row] + 6 + BLOCK // 8 * width[row]
        body[base + nth] = column
        body[(base + outliers[row] + 4 * nth)[:, None] + np.arange(4)] = grid[row, column].astype("<u4").view(np.uint8).reshape(-1, 4)
    return starts.astype(np.uint64), body.tobytes()


def unpack(starts: np.ndarray, body: bytes, n: int) -> np.ndarray:
    """The first n ids of a run of blocks."""
    starts = starts.astype(np.int64)
    blocks = len(starts) - 1
    if not n or not blocks:
        return np.zeros(0, np.uint32)
    data = np.frombuffer(body, np.uint8)
    head = data[starts[:-1, None] + np.arange(6)]
    low = np.ascontiguousarray(head[:, :4]).view("<u4")[:, 0].astype(np.int64)
    width, outliers = head[:, 4].astype(np.int64), head[:, 5].astype(np.int64)
    grid = np.zeros((blocks, BLOCK), np.int64)
    for w in np.unique(width):
        if w:
            own = np.flatnonzero(width == w)
            bits = np.unpackbits(data[starts[own][:, None] + 6 + np.arange(BLOCK // 8 * w)], axis=1, bitorder="little").reshape(len(own), BLOCK, w)
            padded = np.zeros((len(own), BLOCK, 4), np.uint8)
            got = np.packbits(bits, axis=2, bitorder="little")
            padded[:, :, : got.shape[2]] = got
            grid[own] = padded.view("<u4")[:, :, 0]
    if outliers.any():
        row = np.repeat(np.arange(blocks), outliers)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(outliers) - outliers, outliers)
        base = starts[row] + 6 + BLOCK // 8 * width[row]
        grid[row, data[base + nth]] = np.ascontiguousarray(data[(base + outliers[row] + 4 * nth)[:, None] + np.arange(4)]).view("<u4")[:, 0]
    return (grid + low[:, None]).reshape(-1)[:n].astype(np.uint32)


def write_shard(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    starts, body = pack(ids)
    return b"".join((
        MAGIC, np.array([len(doc_ids)], "<u4").tobytes(), np.array([len(ids)], "<u8").tobytes(), np.array([len(starts) - 1], "<u4").tobytes(),
        np.array([x or 0 for x in doc_ids], "<i8").tobytes(), np.array([x is not None for x in doc_ids], np.uint8).tobytes(),
        np.asarray(lengths, "<u8").tobytes(), starts.astype("<u8").tobytes(), body,
    ))


def read_shard(image: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, tokens of each, and all ids of a shard."""
    if image[:4] != MAGIC:
        raise ValueError("not a token shard")
    docs, tokens, blocks = (int(np.frombuffer(image, kind, 1, at)[0]) for kind, at in (("<u4", 4), ("<u8", 8), ("<u4", 16)))
    at = 20
    found = np.frombuffer(image, "<i8", docs, at).tolist()
    there = np.frombuffer(image, np.uint8, docs, at + 8 * docs)
    lengths = np.frombuffer(image, "<u8", docs, at + 9 * docs).astype(np.int64)
    at += 17 * docs
    starts = np.frombuffer(image, "<u8", blocks + 1, at)
    return [x if ok else None for x, ok in zip(found, there, strict=True)], lengths, unpack(starts, image[at + 8 * (blocks + 1) :], tokens)


_ENCODERS: dict[str, BytePieces] = {}


def encode_docs(path: str, end_id: int, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, ids with the end id behind each document, tokens of each document) for runs of rows."""
    coder = _ENCODERS.get(path) or _ENCODERS.setdefault(path, BytePieces(path))
    for first, data, offsets in text_slices(column):
        ids, counts = coder.encode(data, offsets)
        yield first, np.insert(ids, np.cumsum(counts), end_id), counts + 1


def write(docs: DataFrame, tokenizer_path: str, end_id: int, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Encode ``docs(doc_id, text)`` and write the shards; rows part, seq, before (tokens of the part's earlier shards), n_tokens, image.

    ``part`` and ``seq`` follow ascending ``doc_id``.
    """

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, before = TaskContext.get().partitionId(), 0, 0
        names: list[int | None] = []
        ids: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            image = write_shard(names, np.concatenate(counts), np.concatenate(ids))
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "before": pa.array([before], pa.int64()), "n_tokens": pa.array([held], pa.int64()), "image": pa.array([image], pa.binary())})

        for batch in batches:
            keys = batch.column(0).to_pylist()
            for first, got, each in encode_docs(tokenizer_path, end_id, batch.column(1)):
                names += keys[first : first + len(each)]
                ids.append(got)
                counts.append(each)
                held += len(got)
                if held >= shard_tokens:
                    yield flush()
                    seq, before, held = seq + 1, before + held, 0
                    names, ids, counts = [], [], []
        if names:
            yield flush()

    rows = docs.select("doc_id", "text").repartitionByRange(partitions(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")
    return saved(rows.mapInArrow(shards, "part int, seq int, before long, n_tokens long, image binary"), "token-shards")


def read(shards: DataFrame) -> DataFrame:
    """Decode written shards: doc_id, start, n_tokens, ids_crc32 of every document.

    The driver holds one number for each partition of the writer.
    """
    total, base = 0, {}
    for part, n in sorted(tuple(x) for x in shards.groupBy("part").agg(F.sum("n_tokens")).collect()):
        base[part], total = total, total + n

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, before, image in zip(*(batch.column(c).to_pylist() for c in ("part", "before", "image")), strict=True):
                names, counts, ids = read_shard(image)
                until = np.cumsum(counts)
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * (e - c) : 4 * e]) for e, c in zip(until.tolist(), counts.tolist(), strict=True)]
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(names, pa.int64()), "start": pa.array(until - counts + (base[part] + before), pa.int64()), "n_tokens": pa.array(counts, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())})

    return shards.select("part", "before", "image").mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")
