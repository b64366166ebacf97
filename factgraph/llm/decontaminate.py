"""Benchmark decontamination with DataFrame functions only.

Words are the lower-cased runs outside ``[\\x20\\x09-\\x0D]``. A window has as many words
as a benchmark item. Windows are laid where they can matter: a window whose shingles
are similar enough to an item's shares a shingle with it, so every position where a
document holds an item's shingle puts windows of that item's size on the item's
diagonal; no other window can pass the last step. Each window and each item gets a
64-bit SimHash of its words (a word counts as often as it stands there). Fingerprints
of one window size meet by multi-index blocks: two that differ in at most ``RADIUS``
bits agree in one of ``RADIUS + 1`` blocks. Pairs within the radius are verified by
the exact weighted-shingle similarity, the sum of the smaller counts over the sum of
the larger counts of all five-word shingles (of the whole item, if it is shorter).

A null or empty text has no windows, a null or empty item matches nothing, repeated
documents give repeated windows of which the best counts once per (doc_id, item_id);
ties take the first window; empty tables give no rows. A row without a doc_id or an
item_id can't be named in a result and is left out (the pipeline numbers its rows first).
Only doc_id and text, item_id and text are read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factgraph.llm.tables import saved

K = 5
#: Of 64 bits. At similarity 0.8 a ninth of the words differs at most: 9.7 bits expected for distinct words, 13.3 if the changed ones are all the same word; over 21 lie under 1 % of either.
RADIUS = 21
SIMILARITY = 0.8
#: Rows up to which a side may be broadcast; beyond it, joins shuffle.
BROADCAST_ROWS = 500_000


def words(column: str) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(F.col(column), F.lit(""))), "[ \\x09-\\x0D]+"), lambda w: w != "")


def shingles(array: Column, k: Column | int) -> Column:
    """All runs of k words, as strings; none if there are fewer."""
    k = F.lit(k) if isinstance(k, int) else k
    return F.when(F.size(array) >= k, F.transform(F.sequence(F.lit(1), F.size(array) - k + 1), lambda i: F.array_join(F.slice(array, i, k), " "))).otherwise(F.array().cast("array<string>"))


def hashes(array: Column, k: int) -> Column:
    """64-bit hashes of all runs of k words."""
    return F.when(F.size(array) >= k, F.transform(F.sequence(F.lit(1), F.size(array) - k + 1), lambda i: F.xxhash64(F.slice(array, i, k)))).otherwise(F.array().cast("array<bigint>"))


def ones(b: int) -> Column:
    """How many codes have bit b."""
    return F.size(F.filter("codes", lambda h: F.shiftright(h, b).bitwiseAND(F.lit(1)) == 1))


def simhash(array: Column) -> tuple[Column, Column]:
    """Hashes of the words (to be named ``codes``) and the 64-bit fingerprint made of them: a bit is set if at least half of the words' hashes have it."""
    codes = F.transform(array, lambda w: F.xxhash64(w))
    bits = [F.when(2 * ones(b) >= F.size("codes"), F.lit((1 << b) if b < 63 else -(1 << 63))).otherwise(F.lit(0).cast("long")) for b in range(64)]
    return codes, reduce(lambda a, b: a.bitwiseOR(b), bits)


def fingerprinted(rows: DataFrame, array: str) -> DataFrame:
    codes, bits = simhash(F.col(array))
    return rows.withColumn("codes", codes).withColumn("print", bits).drop("codes")


def blocks(radius: int) -> Column:
    """(block, bits) of the fingerprint; two prints within the radius share one."""
    n = radius + 1
    edges = [64 * i // n for i in range(n + 1)]
    return F.array(*(F.struct(F.lit(i).alias("block"), F.shiftrightunsigned("print", lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)).alias("bits")) for i, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False))))


def small(rows: DataFrame, count: int) -> DataFrame:
    return F.broadcast(rows) if count <= BROADCAST_ROWS else rows


def similarity(a: Column, b: Column) -> Column:
    """Sum of smaller over sum of larger counts of two arrays of shingles."""
    common = F.aggregate(F.array_distinct(a), F.lit(0), lambda n, x: n + F.least(F.size(F.filter(a, lambda y: y == x)), F.size(F.filter(b, lambda y: y == x))))
    return common / (F.size(a) + F.size(b) - common)


def find(docs: DataFrame, benchmark: DataFrame, k: int = K, radius: int = RADIUS, threshold: float = SIMILARITY) -> DataFrame:
    """doc_id, item_id, similarity, start (word) and n_words of the best window of each contaminated document and item."""
    items = benchmark.select("item_id", words("text").alias("item_words")).withColumn("n_words", F.size("item_words")).where("n_words > 0")
    items = saved(fingerprinted(items.withColumn("k", F.least(F.lit(k), "n_words")), "item_words"), "items")
    held = docs.select("doc_id", words("text").alias("words"))
    found = []
    for size in sorted(x[0] for x in items.select("k").distinct().collect()):
        own = items.where(F.col("k") == size).select("n_words", F.posexplode(hashes(F.col("item_words"), size)).alias("at", "code")).distinct()
        rows = held.select("doc_id", F.posexplode(hashes(F.col("words"), size)).alias("pos", "code"))
        found.append(rows.join(small(own, own.count()), "code").select("doc_id", F.greatest(F.col("pos") - F.col("at"), F.lit(0)).alias("start"), "n_words"))
    if not found:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, similarity double, start int, n_words int")
    windows = saved(reduce(DataFrame.union, found).distinct(), "windows")
    places = docs.select("doc_id", "text").join(small(windows, windows.count()), "doc_id")
    cut = places.select("doc_id", "start", "n_words", F.slice(words("text"), F.col("start") + 1, F.col("n_words")).alias("window"))
    windows = saved(fingerprinted(cut, "window"), "prints")
    keys = windows.select("doc_id", "start", "n_words", "print", F.inline(blocks(radius)))
    others = items.select("item_id", "n_words", F.col("print").alias("item_print"), F.inline(blocks(radius)))
    near = keys.join(small(others, items.count() * (radius + 1)), ["n_words", "block", "bits"]).where(F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= radius).select("doc_id", "start", "n_words", "item_id").distinct()
    pairs = near.join(windows.select("doc_id", "start", "n_words", "window").distinct(), ["doc_id", "start", "n_words"]).join(small(items.select("item_id", "item_words", "k"), items.count()), "item_id")
    pairs = pairs.select("doc_id", "item_id", "start", "n_words", shingles(F.col("window"), F.col("k")).alias("a"), shingles(F.col("item_words"), F.col("k")).alias("b"))
    kept = pairs.withColumn("similarity", similarity(F.col("b"), F.col("a"))).where(F.col("similarity") >= threshold)
    best = kept.groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("start"), "n_words")).alias("best"))
    return best.select("doc_id", "item_id", F.col("best.similarity").alias("similarity"), (-F.col("best.start")).alias("start"), F.col("best.n_words").alias("n_words"))
