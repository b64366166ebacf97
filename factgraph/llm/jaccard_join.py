"""N-gram Jaccard join: all links between documents whose word-shingle sets overlap enough.

Texts are lower-cased (A-Z); a document's set holds its distinct ``k``-word shingles
(64-bit hashes), or the whole word sequence if it has fewer words; without words it is
empty and linked with nothing. Two documents link if 100 * intersection >= percent *
union.

1. Documents of equal sets become one class, carried by its smallest doc_id.
   A set of n tokens has at most (100 - percent) * n / 100 that a linked set lacks. Of a
   share of all tokens, told by their hashes, those that two classes hold are counted for
   each class; a set with more lone ones is linked with nothing and goes no further.
2. Sets that link differ in at most D tokens, so of D + 1 + s parts of the tokens at
   least s + 1 are equal. Each set gives the signatures of its parts of two tokens or
   more (of one, where too many parts would have fewer than two); linked sets share one
   of them (a set with more than s thinner parts gives all).
   Signatures go, sorted and packed, to buckets by ranges of their hashes; of the
   documents of one signature each meets the next, and the components of these meetings
   are the groups in which all links lie.
3. The sets of a group are the leaves of signature trees. A group of more than
   ``chunk`` sets is cut into cells by size and smallest token hash, whose nodes (the OR
   of the bitmaps, the range of sizes) are met first; only the sets of pairs of nodes
   that can have overlap enough go to a task, which goes on down their trees. Links are
   exact intersections of whole sets.
4. Components of the links, and the number of links of each document.

A null text is empty; of the rows of a doc_id that have different sets the one with most
shingles counts (then the largest hash), and a document is one row however often it is
repeated; null doc_ids are one document; an empty table gives no rows; other columns are
not read. Two nodes of a group meet in one narrow row if their sizes allow a link.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factgraph.llm import signature_tree
from factgraph.llm.components import components
from factgraph.llm.packing import bucket_edges, expand, expand_sorted, squeeze, squeeze_sorted
from factgraph.llm.tables import bounded, lookup, saved
from factgraph.llm.words import combine, lower_ascii, mix, shingle_hashes, text_slices, word_bounds, word_hashes

K = 3
PERCENT = 90
CHUNK = 2048
#: Tokens of a cell's sets, about.
CELL_TOKENS = 1 << 21
#: Signatures that leave a task at once, and about how many a bucket holds.
SENT, HELD = 1 << 20, 1 << 21
#: Bits of a node's bitmap above the trees of one task.
NODE_BITS = 1 << 14
#: Part of all tokens that are counted, in multiples of the part that linked sets may lack.
COUNTED = 2
#: Low bits of a token's mixed hash that choose the counted ones (the other bits tell them apart), and bits of a set's hash that tell classes apart.
CHOICE_BITS, CLASS_BITS = 16, 48


def token_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    for _, data, offsets in text_slices(column):
        data = lower_ascii(data)
        starts, ends, bounds = word_bounds(data, offsets)
        words = word_hashes(data, starts, ends)
        for r in range(len(offsets) - 1):
            own = words[bounds[r] : bounds[r + 1]]
            if not len(own):
                yield own
            elif len(own) < k:
                yield combine(*(own[i : i + 1] for i in range(len(own))))
            else:
                yield np.unique(shingle_hashes(own, k))


@lru_cache(8)
def bands(percent: int, limit: int = 1 << 31) -> list[int]:
    """Lower ends of the size bands; linked sets are in one band or in two next to each other."""
    out = [1]
    while out[-1] <= limit:
        out.append(max(out[-1] + 1, -(-out[-1] * 100 // percent)))
    return out


@lru_cache(1 << 16)
def spare_parts(differ: int, fewest: int) -> tuple[int, int]:
    """(spare, least): parts more than tokens that may differ, so that a set of the ``fewest`` tokens seldom has more parts of under ``least`` tokens; two, if there are so many spare parts, else one."""
    best = (float("inf"), 2)
    for least in (2, 1):
        for spare in range(2, 2 * differ + 12):
            parts = differ + 1 + spare
            full = fewest / parts
            thin = np.exp(-full) * (1 + full * (least > 1))
            over = parts * thin + 3 * np.sqrt(parts * thin * (1 - thin)) - spare
            if over <= 0:
                return spare, least
            if least == 1:
                best = min(best, (over / parts, spare))
    return best[1], 1


def signatures(tokens: np.ndarray, percent: int) -> np.ndarray:
    """Signatures that a set shares with every other set it is linked with, unless they are equal."""
    n = len(tokens)
    if not n:
        return np.zeros(0, np.uint64)
    lower = bands(percent)
    band = bisect_right(lower, n) - 1
    out = []
    for scheme in (band, band + 1):
        if scheme > band and n * 100 // percent < lower[scheme]:
            continue
        largest = lower[scheme + 1] - 1
        differ = 2 * largest * (100 - percent) // (100 + percent)
        if not differ:
            continue
        spare, least = spare_parts(differ, -(-lower[scheme] * percent // 100))
        parts = differ + 1 + spare
        part = ((tokens >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)
        count = np.bincount(part, minlength=parts)
        sums = np.zeros(parts, np.uint64)
        order = np.argsort(part, kind="stable")
        used = np.flatnonzero(count)
        sums[used] = np.add.reduceat(mix(tokens[order] ^ np.uint64(0xA5A5A5A5)), (np.cumsum(count) - count)[used])
        # of the spare + 1 equal parts of linked sets one has tokens enough, unless a set has more thin parts; such a set gives all
        kept = np.flatnonzero(count >= least)
        kept = kept if parts - len(kept) <= spare else np.arange(parts)
        tag = np.uint64((scheme << 40) + parts)
        out.append(combine(sums[kept], np.full(len(kept), tag), kept.astype(np.uint64)))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def digests(tokens: np.ndarray) -> tuple[int, int]:
    """Two hashes of a whole set."""
    return int(mix(tokens).sum(dtype=np.uint64).astype(np.int64)), int(mix(tokens ^ np.uint64(0x5BD1E995)).sum(dtype=np.uint64).astype(np.int64))


def counted(tokens: np.ndarray, percent: int) -> np.ndarray:
    """Mixed hashes of the tokens that are counted, without the bits that choose them."""
    mixed = mix(tokens)
    chosen = (mixed & np.uint64((1 << CHOICE_BITS) - 1)) * np.uint64(100) < np.uint64(COUNTED * (100 - percent) << CHOICE_BITS)
    return mixed[chosen] >> np.uint64(CHOICE_BITS) << np.uint64(CHOICE_BITS)


def class_of(one: Column) -> Column:
    return F.shiftrightunsigned(one, 64 - CLASS_BITS)


def described(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, two hashes of the set, a hash of its smallest token and its number of counted tokens, written to the shared folder."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, one, two, low, chosen = [], [], [], [], []
            for s in token_sets(b.column("text"), k):
                x, y = digests(s)
                size.append(len(s))
                one.append(x)
                two.append(y)
                low.append(int(mix(mix(s).min(keepdims=True))[0] >> np.uint64(32)) if len(s) else 0)
                chosen.append(len(counted(s, percent)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(x, pa.int64()) for x in (size, one, two, low, chosen))], names=["doc_id", "n_shingles", "one", "two", "low", "chosen"])

    rows = docs.select("doc_id", "text").mapInArrow(look, "doc_id long, n_shingles long, one long, two long, low long, chosen long")
    return saved(rows.groupBy("doc_id").agg(F.max(F.struct("n_shingles", "one", "two", "low", "chosen")).alias("s")).select("doc_id", "s.*"), "sets")


def held_twice(docs: DataFrame, k: int, percent: int, buckets: int) -> DataFrame:
    """class, twice: how many of a class's counted tokens another class holds as well; classes without any aren't listed."""

    def send(key: np.ndarray, owner: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(key, kind="stable")
        key, owner = key[order], owner[order]
        edges = bucket_edges(key, buckets)
        own = np.flatnonzero(np.diff(edges))
        packed = [[f(x[edges[i] : edges[i + 1]]) for i in own] for f, x in ((squeeze_sorted, key), (squeeze, owner))]
        return pa.RecordBatch.from_pydict({"bucket": pa.array(own, pa.int32()), "a": pa.array(packed[0], pa.binary()), "b": pa.array(packed[1], pa.binary())})

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, owner, held = [], [], 0
        for b in batches:
            for s in token_sets(b.column("text"), k):
                own = counted(s, percent)
                key.append(own)
                owner.append(np.full(len(own), digests(s)[0], np.int64).view(np.uint64) >> np.uint64(64 - CLASS_BITS))
                held += len(own)
                if held >= SENT:
                    yield send(np.concatenate(key), np.concatenate(owner))
                    key, owner, held = [], [], 0
        if held:
            yield send(np.concatenate(key), np.concatenate(owner))

    def meet(_: tuple, part: pa.Table) -> pa.Table:
        key = np.concatenate([expand_sorted(x) for x in part.column("a").to_pylist()])
        owner = np.concatenate([expand(x, np.uint64) for x in part.column("b").to_pylist()])
        order = np.lexsort((owner, key))
        key, owner = key[order], owner[order]
        new = np.append(True, (key[1:] != key[:-1]) | (owner[1:] != owner[:-1]))
        key, owner = key[new], owner[new]
        same = key[1:] == key[:-1]
        # a class once for each of its tokens that isn't alone, by ranges of the classes' hashes
        owner = np.sort(owner[np.append(False, same) | np.append(same, False)]) << np.uint64(64 - CLASS_BITS)
        edges = bucket_edges(owner, buckets)
        own = np.flatnonzero(np.diff(edges))
        return pa.table({"range": pa.array(own, pa.int32()), "owners": pa.array([squeeze_sorted(owner[edges[i] : edges[i + 1]]) for i in own], pa.binary())})

    def count(_: tuple, part: pa.Table) -> pa.Table:
        owner, n = np.unique(np.concatenate([expand_sorted(x) for x in part.column("owners").to_pylist()]), return_counts=True)
        return pa.table({"class": (owner >> np.uint64(64 - CLASS_BITS)).view(np.int64), "twice": n})

    rows = docs.select("text").where("doc_id is not null").mapInArrow(look, "bucket int, a binary, b binary")
    return rows.groupBy("bucket").applyInArrow(meet, "range int, owners binary").groupBy("range").applyInArrow(count, "class long, twice long")


def meetings(docs: DataFrame, k: int, percent: int, buckets: int) -> DataFrame:
    """a, b: documents next to each other among those that share a signature."""

    def send(sign: np.ndarray, owner: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((owner, sign))
        sign, owner = sign[order], owner[order]
        again = np.flatnonzero(sign[1:] == sign[:-1]) + 1
        near = np.unique(np.stack((owner[again - 1], owner[again])), axis=1)
        # of equal signatures of one task the first goes on; the others are linked with it here
        first = np.ones(len(sign), bool)
        first[again] = False
        sign, owner = sign[first], owner[first]
        edges = bucket_edges(sign, buckets)
        own = np.flatnonzero(np.diff(edges))
        keys, owners = ([f(x[edges[i] : edges[i + 1]]) for i in own] for f, x in ((squeeze_sorted, sign), (squeeze, owner)))
        place = int(mix(np.array([len(sign)], np.uint64))[0] % np.uint64(buckets))
        return pa.RecordBatch.from_pydict({"bucket": pa.array([*own, place], pa.int32()), "met": pa.array([False] * len(own) + [True]), "a": pa.array([*keys, squeeze(near[0])], pa.binary()), "b": pa.array([*owners, squeeze(near[1])], pa.binary())})

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sign, owner, held = [], [], 0
        for b in batches:
            for name, s in zip(b.column("doc_id").to_numpy(), token_sets(b.column("text"), k), strict=True):
                own = signatures(s, percent)
                sign.append(own)
                owner.append(np.full(len(own), name, np.int64))
                held += len(own)
                if held >= SENT:
                    yield send(np.concatenate(sign), np.concatenate(owner))
                    sign, owner, held = [], [], 0
        if held:
            yield send(np.concatenate(sign), np.concatenate(owner))

    def meet(key: tuple, part: pa.Table) -> pa.Table:
        met = np.asarray(part.column("met").to_pylist(), bool)
        a, b = part.column("a").to_pylist(), part.column("b").to_pylist()
        pairs = [np.stack((expand(a[i], np.int64), expand(b[i], np.int64))) for i in np.flatnonzero(met)]
        rest = np.flatnonzero(~met)
        if len(rest):
            sign, owner = np.concatenate([expand_sorted(a[i]) for i in rest]), np.concatenate([expand(b[i], np.int64) for i in rest])
            order = np.lexsort((owner, sign))
            sign, owner = sign[order], owner[order]
            again = np.flatnonzero((sign[1:] == sign[:-1]) & (owner[1:] != owner[:-1]))
            pairs.append(np.stack((owner[again], owner[again + 1])))
        found = np.unique(np.concatenate(pairs, axis=1), axis=1)
        return pa.table({"a": found[0], "b": found[1]})

    rows = docs.select("doc_id", "text").where("doc_id is not null").mapInArrow(look, "bucket int, met boolean, a binary, b binary")
    return rows.groupBy("bucket").applyInArrow(meet, "a long, b long")


def labels_of(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable by the pairs."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            break
    return label


def parts(rows: DataFrame, on: list[str], chunk: int, by: Column) -> DataFrame:
    """``rows`` with ``part``: for each key, so many parts that about ``chunk`` rows and CELL_TOKENS tokens fall in each, by a hash below 2**32."""
    pieces = F.ceil(F.greatest(F.count("*") / F.lit(chunk), F.sum("n_shingles") / F.lit(CELL_TOKENS)))
    large = rows.groupBy(*on).agg(F.count("*").alias("m"), pieces.alias("pieces")).where("pieces > 1")
    cut = lookup(rows, large, on, "m").withColumn("part", F.when(F.col("m").isNull(), 0).otherwise((by * F.col("pieces") / F.lit(float(1 << 32))).cast("int")))
    return saved(cut.drop("m", "pieces"), "parts")


def placed(rows: DataFrame, percent: int, chunk: int) -> DataFrame:
    """``rows`` (doc_id, grp, n_shingles, low, ...) with band and cell; a group of at most ``chunk`` sets is one cell."""
    sized = rows.groupBy("grp").agg(F.count("*").alias("m"))
    rows = saved(lookup(rows, sized, ["grp"], "m").where("m > 1"), "grouped")
    small = rows.where(F.col("m") <= chunk).select(*rows.columns, F.lit(0).alias("band"), F.col("grp").alias("cell"))
    # linked sets are in one band or in two next to each other
    large = saved(rows.where(F.col("m") > chunk).withColumn("band", F.floor(F.log(F.col("n_shingles").cast("double")) / F.log(F.lit(100.0 / percent))).cast("int")), "large")
    if large.isEmpty():
        return small.drop("m")
    cut = parts(large.drop("m"), ["grp", "band"], chunk, F.col("low")).withColumnRenamed("part", "slice")
    cut = parts(cut, ["grp", "band", "slice"], chunk, F.xxhash64("doc_id").bitwiseAND(F.lit((1 << 32) - 1)))
    cut = cut.withColumn("cell", F.xxhash64("grp", "band", "slice", "part")).drop("slice", "part")
    return small.drop("m").unionByName(cut)


def node_pairs(held: DataFrame, percent: int) -> DataFrame:
    """p, q: cells of one group that can hold linked sets, judged by their nodes; a cell alone in its group isn't listed."""

    def node(key: tuple, rows: pa.Table) -> pa.Table:
        tokens = [np.frombuffer(x, np.uint64) for x in rows.column("tokens").to_pylist()]
        bits, low, high, few = signature_tree.Tree(tokens, NODE_BITS).levels[-1]
        return pa.table({"grp": pa.array([key[0].as_py()], pa.int64()), "band": pa.array([key[1].as_py()], pa.int32()), "cell": pa.array([key[2].as_py()], pa.int64()), "least": pa.array(low), "most": pa.array(high), "few": pa.array(few), "bits": pa.array([bits[0].tobytes()], pa.binary())})

    nodes = saved(held.where("cell <> grp").groupBy("grp", "band", "cell").applyInArrow(node, "grp long, band int, cell long, least long, most long, few long, bits binary"), "nodes")
    one = nodes.select("grp", F.explode(F.array("band", F.col("band") + 1)).alias("other"), "band", F.col("cell").alias("p"), *(F.col(c).alias(f"{c}_p") for c in ("least", "most", "few", "bits")))
    two = nodes.select("grp", F.col("band").alias("other"), F.col("cell").alias("q"), *(F.col(c).alias(f"{c}_q") for c in ("least", "most", "few", "bits")))
    both = one.join(two, ["grp", "other"]).where("(other > band or p <= q) and 100 * most_p >= %d * least_q and 100 * most_q >= %d * least_p" % (percent, percent))

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sides = []
            for s in "pq":
                bits = np.array([np.frombuffer(x, np.uint64) for x in b.column(f"bits_{s}").to_pylist()], np.uint64).reshape(b.num_rows, -1)
                sides.append((bits, *(np.asarray(b.column(f"{c}_{s}").to_numpy()) for c in ("least", "most", "few"))))
            keep = signature_tree.overlap_possible(*sides, percent) if b.num_rows else np.zeros(0, bool)
            keep |= np.asarray(b.column("p").to_numpy()) == np.asarray(b.column("q").to_numpy())
            at = pa.array(np.flatnonzero(keep))
            yield pa.RecordBatch.from_arrays([b.column(c).take(at) for c in "pq"], names=["p", "q"])

    return saved(both.mapInArrow(test, "p long, q long"), "pairs")


def compared(percent: int) -> Callable[[tuple, pa.Table], pa.Table]:
    def compare(key: tuple, part: pa.Table) -> pa.Table:
        names, at = np.unique(np.asarray(part.column("doc_id").to_numpy()), return_index=True)
        copies, cell = (np.asarray(part.column(c).to_numpy())[at] for c in ("copies", "cell"))
        column = part.column("tokens").combine_chunks()
        tokens = [np.frombuffer(column[int(i)].as_buffer(), np.uint64) for i in at]
        p, q = key[0].as_py(), key[1].as_py()
        if p == q:
            a, b = signature_tree.join(tokens, None, percent)
        else:
            left, right = np.flatnonzero(cell == p), np.flatnonzero(cell == q)
            a, b = signature_tree.join([tokens[x] for x in left], [tokens[x] for x in right], percent)
            a, b = left[a], right[b]
        links = np.zeros(len(names), np.int64)
        np.add.at(links, a, copies[b])
        np.add.at(links, b, copies[a])
        hit = np.flatnonzero(links)
        root = labels_of(len(names), a, b)
        return pa.table({"doc_id": names[hit], "links": links[hit], "root": names[root[hit]]})

    return compare


def join(docs: DataFrame, k: int = K, percent: int = PERCENT, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links for every document."""
    sets = described(docs, k, percent)
    equal = ["n_shingles", "one", "two"]
    filled = sets.where("n_shingles > 0 and doc_id is not null")
    classes = saved(filled.groupBy(*equal).agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")).where("copies > 1"), "classes")
    members = saved(lookup(sets, classes, equal, "copies").select("doc_id", *equal, "low", "chosen", F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")).alias("rep"), F.coalesce(F.when(F.col("doc_id").isNotNull(), F.col("copies")), F.lit(1)).alias("copies")), "members")
    own = members.where("doc_id = rep and n_shingles > 0")
    size = lambda rows, share: max(1, -(-int(rows.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0] * share) // HELD))
    twice = held_twice(docs, k, percent, size(members, COUNTED * (100 - percent) / 100))
    lone = F.col("chosen") - F.coalesce("twice", F.lit(0))
    own = saved(own.join(twice, class_of(F.col("one")) == F.col("class"), "left").where(100 * lone <= (100 - percent) * F.col("n_shingles")).select("doc_id", "n_shingles", "one", "two", "low", "copies"), "own")
    docs = saved(docs.select("doc_id", "text").join(bounded(own.select("doc_id")), "doc_id", "left_semi"), "texts")
    # a set has about three signatures for each token that may differ
    groups = components(meetings(docs, k, percent, size(own, 3.1 * (100 - percent) / 100))).withColumnRenamed("node", "doc_id").withColumnRenamed("component", "grp")
    leaves = placed(saved(own.join(groups, "doc_id"), "leaves"), percent, chunk)
    wanted = bounded(leaves.select("doc_id", "one", "two", "grp", "band", "cell", "copies"))

    def attach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [np.asarray(b.column(c).to_numpy()) for c in ("one", "two")]
            keep, held = [], []
            for i, s in enumerate(token_sets(b.column("text"), k)):
                if digests(s) == (own[0][i], own[1][i]):
                    keep.append(i)
                    held.append(s.tobytes())
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(at) for c in ("doc_id", "grp", "band", "cell", "copies")), pa.array(held, pa.binary())], names=["doc_id", "grp", "band", "cell", "copies", "tokens"])

    held = docs.select("doc_id", "text").join(wanted, "doc_id").mapInArrow(attach, "doc_id long, grp long, band int, cell long, copies long, tokens binary")
    if not leaves.where("cell <> grp").isEmpty():
        held = saved(held, "leaves")
        pairs = node_pairs(held, percent)
        ways = pairs.select("p", "q", F.explode(F.array_distinct(F.array("p", "q"))).alias("cell"))
        tasks = held.where("cell = grp").select("doc_id", "copies", "cell", "tokens", F.col("cell").alias("p"), F.col("cell").alias("q"))
        tasks = tasks.unionByName(held.where("cell <> grp").join(ways, "cell").select(*tasks.columns))
    else:
        tasks = held.select("doc_id", "copies", "cell", "tokens", F.col("cell").alias("p"), F.col("cell").alias("q"))
    found = saved(tasks.groupBy("p", "q").applyInArrow(compared(percent), "doc_id long, links long, root long"), "found")
    reached = components(found.select("doc_id", "root"), "doc_id", "root")
    degree = saved(found.groupBy(F.col("doc_id").alias("rep")).agg(F.sum("links").alias("links")).join(reached.withColumnRenamed("node", "rep"), "rep", "left").join(members.where("doc_id = rep").select("rep", F.col("copies").alias("met")), "rep"), "degrees")
    return lookup(members, degree, ["rep"], "met").select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
