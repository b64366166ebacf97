"""Mix sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Documents are dealt to shards by a hash of their doc_id and text, those of a small
source to so few that each of them holds about ``CELL_WORDS`` words of it. A cell is the
documents of one source in one shard; they stand in seeded order as one stream of words,
cut into blocks of ``BLOCK_WORDS`` (the last block of a cell is shorter). For each shard
the sources' targets, in proportion to what the shard holds of each, are apportioned to
block quotas: seats go to the highest quotients votes / (2 * seats + 1), ties to the
smaller source. A quota counts as so many words: whole passes over its cell first, then
the blocks with the smallest seeded hashes, as many as come nearest. No cell is passed
more than ``MAX_EPOCHS`` times, and the cells of a source whose target is that are passed
so often.

Targets: the sources in code-point order (null last) weigh 5, 2, 1, repeating; they
share the words of all documents, and a source stops at ``MAX_EPOCHS`` times its
words while the others share the excess by weight.

A null text has size 0; a null source is a source of its own; every row is a document of
its own, repeated ones and those without a doc_id too; an empty table gives no rows; other columns can have any name. A shard has about
``SHARD_DOCS`` documents, whatever the input, so a hot source is split over all
shards; the driver holds one number for each weight round, never a row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factgraph.llm.tables import saved, text_or_empty
from factgraph.llm.words import combine
from factgraph.operators.ranks import ranked

WEIGHTS = (5, 2, 1)
BLOCK_WORDS = 32
SHARD_DOCS = 512
CELL_WORDS = 64 * BLOCK_WORDS
MAX_EPOCHS = 3
SEED = 20240607
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, key (never null), size (words) and code (hash) of the text, rows (equal in these) and copy (a number among them); one row for each document."""
    words = F.size(F.filter(F.split(text_or_empty(), "[ \\x09-\\x0D]+"), lambda w: w != ""))
    key = F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), "source"))
    own = docs.select("doc_id", "source", key.alias("key"), words.cast("long").alias("size"), F.xxhash64("text").alias("code"))
    return own.groupBy("doc_id", "source", "key", "size", "code").agg(F.count("*").alias("rows")).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "rows")))


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = MAX_EPOCHS) -> DataFrame:
    """key, source_size, target. One row for each source passes through the window that ranks them."""
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source"))
    found = sized.groupBy("source", "key").agg(F.sum("size").alias("source_size")).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((rank - 1) % len(weights) + 1).cast("int")).cast("double"))
    found = saved(found.coalesce(1), "sources")
    most = F.col("source_size") * float(epochs)
    total = float(found.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0])
    unit = 0.0
    while True:  # the level of words for a unit of weight rises until no further source is at its bound
        full = F.col("weight") * unit >= most
        taken, weight = found.agg(F.coalesce(F.sum(F.when(full, most)), F.lit(0.0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0))).first()
        level = (total - taken) / weight if weight else unit
        if level <= unit:
            break
        unit = level
    return found.select("key", "source_size", F.least(F.col("weight") * unit, most).alias("target"))


def apportion(votes: np.ndarray, seats: int) -> np.ndarray:
    """Sainte-Lague: seats by highest quotients votes / (2 * won + 1); ties go to the first."""
    won = np.zeros(len(votes), np.int64)
    if seats <= 0 or votes.sum() <= 0:
        return won
    # below the share less the number of parties nobody can end; the rest goes seat by seat
    won = np.maximum(0, np.floor(votes / votes.sum() * (seats - len(votes))).astype(np.int64) - 1)
    for _ in range(int(seats - won.sum())):
        won[np.argmax(votes / (2 * won + 1))] += 1
    return won


def mix(docs: DataFrame, seed: int = SEED, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, pieces, and code, rows and copy of its text for every document.

    ``pieces`` are the runs of words (first, words) that the last, partial pass takes; whole passes are taken // size.
    """
    sized = saved(sizes(docs), "sizes")
    count = sized.count()
    shards = max(1, -(-count // SHARD_DOCS))
    goal = targets(sized)
    dealt = goal.select("key", F.greatest(F.lit(1), F.least(F.lit(shards), F.expr(f"source_size div {CELL_WORDS}"))).alias("cells"))
    place = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "code", "copy"), F.col("cells")) + F.pmod(F.xxhash64("key"), F.lit(shards))
    # one row for each source meets the documents
    cell = sized.join(dealt, "key").withColumn("shard", F.pmod(place, F.lit(shards))).drop("cells")
    plan = cell.groupBy("shard", "key").agg(F.sum("size").alias("cell_size")).join(goal, "key")

    def quotas(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("key")
        size, whole, target = (np.asarray(rows.column(c).to_numpy(), float) for c in ("cell_size", "source_size", "target"))
        full = target >= MAX_EPOCHS * whole
        votes = np.where(~full & (whole > 0), target * size / np.maximum(whole, 1), 0.0)
        won = apportion(votes, int(round(votes.sum() / block_words)))
        return pa.table({"shard": rows.column("shard"), "key": rows.column("key"), "quota": pa.array(np.where(full, MAX_EPOCHS * size.astype(np.int64), won * block_words))})

    quota = plan.groupBy("shard").applyInArrow(quotas, "shard long, key string, quota long")
    rows = cell.join(quota, ["shard", "key"]).select("shard", "key", "source", "doc_id", "size", "code", "rows", "copy", "quota")

    def select(key: tuple, rows: pa.Table) -> pa.Table:
        names = np.asarray(rows.column("doc_id").fill_null(-1).to_numpy())
        size = np.asarray(rows.column("size").to_numpy())
        code, copy = (np.asarray(rows.column(c).to_numpy()) for c in ("code", "copy"))
        order = np.lexsort((copy, code, np.asarray(rows.column("doc_id").is_null()), names, seeded(names, seed)))
        ends = np.cumsum(size[order])
        total = int(ends[-1])
        quota = int(rows.column("quota")[0].as_py())
        blocks = -(-total // block_words)
        passes, rest = divmod(quota, total) if blocks else (0, 0)
        if passes >= MAX_EPOCHS:
            passes, rest = MAX_EPOCHS, 0
        shard = rows.column("shard")[0].as_py()
        taken = size[order] * passes
        pieces: list[list[dict]] = [[] for _ in order]
        if rest:
            rank = np.argsort(seeded(np.arange(blocks), seed + 1 + shard), kind="stable")
            words = np.minimum(block_words, total - np.arange(blocks) * block_words)
            chosen = np.zeros(blocks, np.int64)
            chosen[rank[np.cumsum(words[rank]) - words[rank] / 2 <= rest]] = 1
            words = words * chosen
            until = np.concatenate(([0], np.cumsum(words)))

            def before(at: np.ndarray) -> np.ndarray:
                """Chosen words among the first ``at`` words of the stream."""
                b = np.minimum(at // block_words, blocks - 1)
                return until[b] + (at - b * block_words) * chosen[b]

            begins = ends - size[order]
            part = before(ends) - before(begins)
            taken = taken + part
            for i in np.flatnonzero((part > 0) & (part < size[order])):
                at, until = begins[i], ends[i]
                own = np.flatnonzero(chosen[at // block_words : -(-until // block_words)]) + at // block_words
                pieces[i] = [{"first": int(max(at, b * block_words) - at), "words": int(min(until, (b + 1) * block_words) - max(at, b * block_words))} for b in own]
        return pa.table({"key": rows.column("key"), "source": rows.column("source"), "doc_id": rows.column("doc_id").take(order), "size": pa.array(size[order]), "code": rows.column("code").take(order), "rows": rows.column("rows").take(order), "copy": rows.column("copy").take(order), "taken": pa.array(taken), "pieces": pa.array(pieces, pa.list_(pa.struct([("first", pa.int64()), ("words", pa.int64())])))})

    picked = rows.groupBy("shard", "key").applyInArrow(select, "key string, source string, doc_id long, size long, code long, rows long, copy long, taken long, pieces array<struct<first: long, words: long>>")
    return picked.join(goal, "key").select("doc_id", "source", "size", "source_size", "target", "taken", "pieces", "code", "rows", "copy")


def cut(text: str, pieces: list[dict]) -> str:
    """The words of the pieces with what stands between them in the text; a line break where words are left out."""
    at = [m.span() for m in WORD.finditer(text)]
    runs: list[list[int]] = []
    for p in pieces:
        if runs and runs[-1][1] == p["first"]:
            runs[-1][1] += p["words"]
        else:
            runs.append([p["first"], p["first"] + p["words"]])
    return "\n".join(text[at[a][0] : at[b - 1][1]] for a, b in runs)


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a row for each whole pass over a document, and one for the words of a partial pass."""
    names = docs.columns
    doc, source, pieces, passes, code, rows, copy = (next(n for i in range(len(names) + 1) if (n := f"_{c}{i}") not in names) for c in ("doc", "source", "pieces", "passes", "code", "rows", "copy"))
    plan = mix(docs, **options)
    plan = plan.select(F.col("doc_id").alias(doc), F.col("source").alias(source), F.col("pieces").alias(pieces), F.when(F.col("taken") > 0, F.expr("taken div size")).otherwise(0).cast("int").alias(passes), F.col("code").alias(code), F.col("rows").alias(rows), F.col("copy").alias(copy), (F.col("taken") > 0).alias(f"{copy}_in"))
    same = lambda: F.col("doc_id").eqNullSafe(F.col(doc)) & F.col("source").eqNullSafe(F.col(source)) & (F.xxhash64("text") == F.col(code))
    found = docs.join(plan.where((F.col(rows) == 1) & F.col(f"{copy}_in")), same()).select(*names, pieces, passes)
    # only rows of equal doc_id, source and text have to be numbered to meet the copies of the plan
    twice = saved(plan.where(F.col(rows) > 1), "copies")
    if not twice.isEmpty():
        first = twice.where(F.col(copy) == 1).select(doc, source, code)
        again = saved(docs.join(first, same(), "left_semi").withColumn(code, F.xxhash64("text")), "again")
        numbered = ranked(again, ["doc_id", "source", code, *(n for n in names if n not in ("doc_id", "source"))], copy, ["doc_id", "source", code]).drop(code)
        both = numbered.withColumnRenamed(copy, f"{copy}_n").join(twice.where(f"{copy}_in"), same() & (F.col(f"{copy}_n") + 1 == F.col(copy)))
        found = found.unionByName(both.select(*names, pieces, passes))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, texts = [], []
            for i, (text, own, n) in enumerate(zip(*(b.column(c).to_pylist() for c in ("text", pieces, passes)), strict=True)):
                if own:
                    texts.append(cut(text, own))
                    at.append(i)
                texts += [text] * n
                at += [i] * n
            new = {"text": pa.array(texts, pa.string())}
            if "n_chars" in names:
                new["n_chars"] = pa.array([len(t) for t in texts], b.column("n_chars").type)
            taken = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([new[c] if c in new else b.column(c).take(taken) for c in names], names=names)

    return found.mapInArrow(build, docs.schema)


def seeded(values: np.ndarray, seed: int) -> np.ndarray:
    values = np.asarray(values).astype(np.int64).view(np.uint64)
    return combine(np.full(len(values), seed & (2**64 - 1), np.uint64), values)


