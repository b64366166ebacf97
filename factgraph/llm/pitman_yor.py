"""Language-model scores by a hierarchical Pitman-Yor model of bigrams.

Tokens are the words outside ``[\\x20\\x09-\\x0D]`` (A-Z lower-cased) and one end token
for each text. The word before is the context (a start mark before the first one); each
context is a restaurant, and all of them share the unigram restaurant as parent, whose
base gives every training token and one unknown token the same chance.

Texts are read once, into blocks of about ``BLOCK_TOKENS`` tokens of packed word codes.
A block's distinct bigrams (64-bit hashes) and words go, sorted and packed, to buckets
by ranges of their hashes, which are even for any data, however hot a context or a word
is: what a block says of a hot word is one number. Buckets add up and answer each block
in the order it asked in. A block names its words once; later it sends numbers alone, and
buckets read the names again.

Seating: the customers of a context are its training bigrams; a restaurant's tables are
the parent's customers. Each sweep seats the customers of all dishes (a dish is a word
in a restaurant) by Gibbs steps with the other restaurants as the sweep before left
them: a customer of a dish gets up, who had a table alone with chance S(c-1, t-1) /
S(c, t) (generalized Stirling numbers: the share of such seatings among those of c
customers at t tables), and sits down at a new table with weight (strength + discount *
tables of the restaurant) * parent chance or at one of the dish's with weight c - 1 -
discount * t. The state of a dish is its number of tables. Dishes of more than ``SINGLE``
customers take steps of an ``LEAP``-th of them at once, rates held within a step, and of
more than ``STIRLING`` customers the chance of a table alone is that of many customers.
Random numbers are hashes of dish, sweep and step, so every block that holds a dish
would seat it alike; the first one that trains on it does, and buckets give its tables
to the others for the scores. The first sweep starts with one table for a dish.

Predictive chances of the seatings after each of the ``SWEEPS`` are averaged; each takes
the totals that count the very tables it uses, so a context's chances sum to one.

score = sum of log10 of the predictive chances of a text's tokens. Held-out documents
(crc32 of doc_id as text, modulo 7, is 2) give no counts. base_score is the add-one
unigram score over the same training tokens.

A null or empty text has one token, the end; a null doc_id counts as an empty string in
the split; repeated rows count as often as they stand there; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factgraph.llm.packing import bucket_edges, expand, expand_sorted, squeeze, squeeze_sorted
from factgraph.llm.tables import partitions
from factgraph.llm.words import combine, lower_ascii, mix, text_slices, word_bounds, word_hashes

DISCOUNT, STRENGTH = 0.8, 1.0
PARENT_DISCOUNT, PARENT_STRENGTH = 0.5, 1.0
SWEEPS = 2
BLOCK_TOKENS = 2_400_000
#: Steps of one sweep for each customer, and at most.
STEPS, MOST_STEPS = 2, 24
SINGLE, LEAP, STIRLING = 24, 8, 400
END, START = np.uint64(0x0E0D0E0D0E0D0E0D), np.uint64(0x57A7757A7757A775)


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, where each of them stands, and the number of each key among them; which of equal ones is named doesn't matter."""
    order = np.argsort(keys)
    ranked = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    number = np.empty(len(keys), np.int64)
    number[order] = np.cumsum(new) - 1
    return ranked[new], order[new], number


@lru_cache(4)
def alone_chances(discount: float) -> np.ndarray:
    """By customers and tables up to STIRLING: the chance S(c-1, t-1) / S(c, t) that a customer has a table alone."""
    out = np.zeros((STIRLING + 1, STIRLING + 1), np.float32)
    log = np.full(STIRLING + 1, -np.inf)
    log[1] = 0.0
    out[1, 1] = 1
    t = np.arange(STIRLING + 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        for c in range(2, STIRLING + 1):
            fewer = np.append(-np.inf, log[:-1])
            new = np.logaddexp(fewer, np.log(np.maximum(c - 1 - discount * t, 0)) + log)
            new[(t < 1) | (t > c)] = -np.inf
            out[c] = np.where(np.isfinite(new), np.exp(fewer - new), 0)
            log = new
    return out


def alone(count: np.ndarray, tables: np.ndarray, discount: float) -> np.ndarray:
    """Chance that one of a dish's customers has a table alone; for very many customers, of which few tables hold one, its limit."""
    small = count <= STIRLING
    out = np.minimum(1.0, discount * (tables - 1) / np.maximum(count - 1, 1) * (1 + discount / np.maximum(count, 1)))
    out[small] = alone_chances(discount)[count[small], np.minimum(tables[small], STIRLING)]
    return out


def uniforms(key: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers between 0 and 1 by key and step, of 32 bits each."""
    drawn = mix(key + np.uint64(step * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
    return (drawn >> np.uint64(32)).astype(float) * 2.0**-32, (drawn & np.uint64(0xFFFFFFFF)).astype(float) * 2.0**-32


def events(mean: np.ndarray, draw: np.ndarray) -> np.ndarray:
    """Poisson numbers by inversion, of means above 12 by their normal approximation (a logistic quantile)."""
    out = np.maximum(0, np.rint(mean + np.sqrt(mean) * np.log(np.maximum(draw, 1e-12) / np.maximum(1 - draw, 1e-12)) / 1.702))
    low = mean <= 12
    if low.any():
        m, d = mean[low], draw[low]
        part = np.exp(-m)
        until, n = part.copy(), np.zeros(len(m))
        for k in range(1, 40):
            more = d > until
            if not more.any():
                break
            n += more
            part = part * m / k
            until += part
        out[low] = n
    return out.astype(np.int64)


def seated(count: np.ndarray, tables: np.ndarray, weight: np.ndarray, key: np.ndarray, discount: float, sweep: int) -> np.ndarray:
    """Tables of each dish after a sweep of Gibbs steps from ``tables``; ``weight``: of a new table."""
    out = np.minimum(count, tables).astype(np.int64)
    more = np.flatnonzero(count > 1)
    more = more[np.argsort(-count[more], kind="stable")]
    c, q, k = count[more].astype(np.int64), weight[more], key[more]
    t = np.maximum(out[more], 1)
    steps = np.minimum(STEPS * c, MOST_STEPS)
    single = int(np.searchsorted(-c, -SINGLE))  # dishes before it have more customers than SINGLE
    for step in range(MOST_STEPS):
        n = int(np.searchsorted(-steps, -step))  # those with more steps than this
        if not n:
            break
        first, second = uniforms(k[:n], sweep * MOST_STEPS + step)
        gone = alone(c[:n], t[:n], discount)
        if single:
            s = min(single, n)
            leap = np.maximum(1, c[:s] // LEAP)
            # tables fall as the power of the customers left that the discount is; new ones come at the rate half-way back
            share = leap / c[:s]
            down = np.minimum(events(gone[:s] * c[:s] * (1 - (1 - share) ** discount) / discount, first[:s]), t[:s] - 1)
            left = t[:s] - down
            up = events(leap * q[:s] / (q[:s] + np.maximum(c[:s] - leap / 2 - discount * left, 0.1)), second[:s])
            t[:s] = np.minimum(left + np.minimum(up, leap), c[:s])
        if n > single:
            s = slice(single, n)
            left = t[s] - (first[s] < gone[s])
            t[s] = left + (second[s] * (q[s] + c[s] - 1 - discount * left) < q[s])
    out[more] = t
    return out


def by_use(uses: np.ndarray) -> np.ndarray:
    """Words from the most used one on; places in this order pack better than places among their hashes."""
    return np.argsort(-uses.astype(np.int64), kind="stable")


def packed(docs: DataFrame) -> DataFrame:
    """Blocks of documents: block, names, held, sizes (tokens), words (sorted hashes), uses (tokens of each), codes (places of the tokens' words by use)."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, null, held, codes, sizes, total, made = [], [], [], [], [], 0, 0
        part = TaskContext.get().partitionId()

        def block() -> pa.RecordBatch:
            words, code = np.unique(np.concatenate(codes), return_inverse=True)
            uses = np.bincount(code).astype(np.uint32)
            out = {"names": squeeze(np.concatenate(names)), "nulls": squeeze(np.concatenate(null)), "held": squeeze(np.concatenate(held)), "sizes": squeeze(np.concatenate(sizes)), "words": squeeze_sorted(words), "uses": squeeze(uses), "codes": squeeze(np.argsort(by_use(uses)).astype(np.uint32)[code])}
            return pa.RecordBatch.from_pydict({"block": pa.array([(part << 24) + made], pa.int64())} | {k: pa.array([v], pa.binary()) for k, v in out.items()})

        for b in batches:
            column, first = b.column("doc_id"), 0
            own, flags = column.fill_null(0).to_numpy(), b.column("held").to_numpy(zero_copy_only=False)
            for _, data, offsets in text_slices(b.column("text")):
                data = lower_ascii(data)
                starts, ends, bounds = word_bounds(data, offsets)
                codes.append(np.insert(word_hashes(data, starts, ends), bounds[1:], END))
                sizes.append((np.diff(bounds) + 1).astype(np.uint32))
                rows = slice(first, first + len(offsets) - 1)
                names.append(own[rows])
                null.append(np.asarray(column.is_null())[rows].astype(np.uint8))
                held.append(flags[rows].astype(np.uint8))
                first, total = rows.stop, total + len(codes[-1])
                if total >= BLOCK_TOKENS:
                    yield block()
                    names, null, held, codes, sizes, total, made = [], [], [], [], [], 0, made + 1
        if codes:
            yield block()

    held = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(7)) == 2
    return docs.select("doc_id", "text", held.alias("held")).mapInArrow(look, "block long, names binary, nulls binary, held binary, sizes binary, words binary, uses binary, codes binary")


class Block:
    """The tokens of a block of documents, with its distinct words and bigrams in the order of their hashes."""

    def __init__(self, part: pa.Table):
        row = {c: part.column(c)[0].as_py() for c in part.column_names}
        self.id = row["block"]
        self.names, self.nulls = expand(row["names"], np.int64), expand(row["nulls"], np.uint8).astype(bool)
        self.held, self.sizes = expand(row["held"], np.uint8).astype(bool), expand(row["sizes"], np.uint32).astype(np.int64)
        words, code = expand_sorted(row["words"]), expand(row["codes"], np.uint32).astype(np.int64)
        if "uses" in row:  # else places among the hashes
            code = by_use(expand(row["uses"], np.uint32))[code]
        self.doc = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.start = int(np.searchsorted(words, START))
        self.words = words if self.start < len(words) and words[self.start] == START else np.insert(words, self.start, START)
        self.word = code + ((code >= self.start) & (len(self.words) > len(words)))
        self.context = np.concatenate(([self.start], self.word[:-1]))
        self.context[np.cumsum(self.sizes) - self.sizes] = self.start
        self.pairs, first, self.pair = distinct(combine(self.words[self.context], self.words[self.word]))
        self.pair_context, self.pair_word = self.context[first], self.word[first]
        self.known = ~self.held[self.doc]

    def pair_counts(self) -> np.ndarray:
        return np.bincount(self.pair[self.known], minlength=len(self.pairs)).astype(np.uint32)

    def word_counts(self) -> np.ndarray:
        """Training tokens of each word; the start mark counts training documents."""
        out = np.bincount(self.word[self.known], minlength=len(self.words))
        out[self.start] = (~self.held).sum()
        return out.astype(np.uint32)


ASKED = "bucket int, block long, seats double, distinct long, keys binary, a binary, b binary, c binary, pairs boolean"
COLUMNS = ("a", "b", "c", "d")
#: training tokens, distinct training words, the parent's customers, the parent's tables
TOTALS = ("tokens", "distinct", "tables", "seats")
ANSWER = "block long, sweep int, bucket int, a binary, b binary, c binary, d binary, tokens long, distinct long, tables double, seats double"


def spread(keys: np.ndarray, buckets: int, block: int, *columns: np.ndarray, seats: float = 0.0, distinct: int = 0, named: bool = True, pairs: bool = False) -> pa.Table:
    """Rows of ASKED: sorted keys (left out if they are ``named`` already) and values aligned to them, cut by bucket; ``pairs``: tables of bigrams."""
    edges = bucket_edges(keys, buckets)
    own = np.flatnonzero(np.diff(edges))
    cut = [(edges[i], edges[i + 1]) for i in own]
    n = len(own)
    data = {"bucket": pa.array(own, pa.int32()), "block": pa.array(np.full(n, block), pa.int64()), "seats": pa.array(np.full(n, float(seats))), "distinct": pa.array(np.full(n, distinct), pa.int64()), "keys": pa.array([squeeze_sorted(keys[p:q]) if named else b"" for p, q in cut], pa.binary()), "pairs": pa.array(np.full(n, pairs))}
    for name, values in zip("abc", [*columns, *[None] * (3 - len(columns))], strict=True):
        data[name] = pa.array([squeeze(values[p:q]) for p, q in cut] if values is not None else [b""] * n, pa.binary())
    return pa.table(data)


def answers(sweep: int, bucket: int, part: pa.Table, results: list[list[np.ndarray]], totals: tuple[float, ...] | None = None) -> pa.Table:
    """A row for each asking block; with totals also one for no block, the bucket's part of them."""
    blocks = part.column("block").to_pylist()
    rows = {c: [squeeze(r[i]) if i < len(r) else b"" for r in results] for i, c in enumerate(COLUMNS)}
    if totals is not None:
        blocks, rows = [*blocks, -1], {c: [*v, b""] for c, v in rows.items()}
    n = len(blocks)
    sums = {c: pa.array([0] * (n - 1) + [x] if totals is not None else [0] * n, pa.int64() if c in TOTALS[:2] else pa.float64()) for c, x in zip(TOTALS, totals or (0, 0, 0.0, 0.0), strict=True)}
    return pa.table({"block": pa.array(blocks, pa.int64()), "sweep": pa.array([sweep] * n, pa.int32()), "bucket": pa.array([bucket] * n, pa.int32())} | {c: pa.array(v, pa.binary()) for c, v in rows.items()} | sums)


def add_pairs(key: tuple, part: pa.Table) -> pa.Table:
    """Training count of each bigram, and whether the asking block is the first that trains on it."""
    part = part.sort_by("block")
    asked = [expand_sorted(x) for x in part.column("keys").to_pylist()]
    own = np.concatenate([expand(x, np.uint32) for x in part.column("a").to_pylist()]).astype(np.int64)
    _, back = np.unique(np.concatenate(asked), return_inverse=True)
    total = np.bincount(back, own).astype(np.uint32)
    trained = np.flatnonzero(own)
    _, at = np.unique(back[trained], return_index=True)
    first = np.zeros(len(own), np.uint8)
    first[trained[at]] = 1
    cuts = np.cumsum([len(x) for x in asked])[:-1]
    return answers(-1, key[0].as_py(), part, [list(x) for x in zip(np.split(total[back], cuts), np.split(first, cuts), strict=True)])


def adding(sweep: int):
    def add_words(key: tuple, part: pa.Table) -> pa.Table:
        """Training count of each word, tables of its restaurant, and its customers and tables in the parent; totals of the bucket."""
        part = part.sort_by("block")
        asked = [expand_sorted(x) for x in part.column("keys").to_pylist()]
        keys, back = np.unique(np.concatenate(asked), return_inverse=True)
        count, tables, guests = (np.rint(np.bincount(back, np.concatenate([expand(x, np.uint32) for x in part.column(c).to_pylist()]), len(keys))).astype(np.int64) for c in "abc")
        seats, distinct = part.column("seats")[0].as_py(), part.column("distinct")[0].as_py()
        weight = (PARENT_STRENGTH + PARENT_DISCOUNT * seats) / (distinct + 1) if distinct else PARENT_DISCOUNT
        own = seated(guests, np.minimum(guests, 1), np.full(len(keys), weight), keys, PARENT_DISCOUNT, sweep)
        real = keys != START
        cuts = np.cumsum([len(x) for x in asked])[:-1]
        columns = [x.astype(np.uint32) for x in (count, tables, guests, own)]
        return answers(sweep, key[0].as_py(), part, [list(x) for x in zip(*(np.split(c[back], cuts) for c in columns), strict=True)], (int(count[real].sum()), int((count[real] > 0).sum()), float(guests.sum()), float(own.sum())))

    return add_words


def add_named(sweep: int):
    def add(key: tuple, named: pa.Table, part: pa.Table) -> pa.Table:
        """As ``adding``, where the words and their counts stand in what the same blocks asked first."""
        part = part.filter(pc.invert(part.column("pairs"))).sort_by("block")
        named = named.sort_by("block")
        for c in ("keys", "a"):
            part = part.set_column(part.column_names.index(c), c, named.column(c))
        return adding(sweep)(key, part)

    return add


def share(key: tuple, named: pa.Table, part: pa.Table) -> pa.Table:
    """For each block the tables of its bigrams after each sweep, as the block that seats a bigram tells them."""
    named, part = named.sort_by("block"), part.filter(part.column("pairs")).sort_by("block")
    asked = [expand_sorted(x) for x in named.column("keys").to_pylist()]
    _, back = np.unique(np.concatenate(asked), return_inverse=True)
    cuts = np.cumsum([len(x) for x in asked])[:-1]
    tables = [np.rint(np.bincount(back, np.concatenate([expand(x, np.uint32) for x in part.column(c).to_pylist()]))).astype(np.uint32)[back] for c in COLUMNS[:SWEEPS]]
    return answers(-2, key[0].as_py(), part, [list(x) for x in zip(*(np.split(t, cuts) for t in tables), strict=True)])


class State:
    """What a block knows: counts of its bigrams, and of each sweep the counts and tables of its words and the corpus totals."""

    def __init__(self, block: Block, rows: pa.Table):
        self.block = block
        rows = rows.sort_by([("sweep", "ascending"), ("bucket", "ascending")])
        sweep = np.asarray(rows.column("sweep").to_numpy())

        def column(own: int, name: str, form: type) -> np.ndarray:
            parts = [expand(x, form) for x, k in zip(rows.column(name).to_pylist(), sweep, strict=True) if k == own]
            return np.concatenate(parts) if parts else np.zeros(0, form)

        self.count = column(-1, "a", np.uint32).astype(np.int64)
        self.first = column(-1, "b", np.uint8).astype(bool)
        self.shared = [column(-2, c, np.uint32).astype(np.int64) for c in COLUMNS[:SWEEPS]] if (sweep == -2).any() else None
        self.sweeps = []
        for own in range(int(sweep.max()) + 1):
            at = int(np.flatnonzero(sweep == own)[0])
            self.sweeps.append([column(own, c, np.uint32).astype(np.int64) for c in COLUMNS] + [rows.column(c)[at].as_py() for c in TOTALS])

    def parent_chance(self, sweep: int) -> np.ndarray:
        """Chance of each of the block's words in the shared parent restaurant."""
        _, _, guests, own, _, distinct, tables, seats = self.sweeps[sweep]
        return (guests - PARENT_DISCOUNT * own + (PARENT_STRENGTH + PARENT_DISCOUNT * seats) / (distinct + 1)) / (PARENT_STRENGTH + tables)

    def weight(self, sweep: int, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        """Weight of a new table for each of the block's bigrams (those ``at`` the places)."""
        b = self.block
        return (STRENGTH + DISCOUNT * self.sweeps[sweep][1][b.pair_context[at]]) * self.parent_chance(sweep)[b.pair_word[at]]

    def own_seatings(self) -> list[np.ndarray]:
        """As ``seatings``, for the bigrams that the block is the first to train on; the others have none."""
        at = np.flatnonzero(self.first)
        made = [np.minimum(self.count[at], 1)]
        for sweep in range(len(self.sweeps)):
            made.append(seated(self.count[at], made[-1], self.weight(sweep, at), self.block.pairs[at], DISCOUNT, sweep))
        out = np.zeros((len(made), len(self.count)), np.int64)
        out[:, at] = made
        return list(out)

    def seatings(self, sweeps: int | None = None) -> list[np.ndarray]:
        """Tables of each of the block's bigrams at the start and after each sweep (that the totals known allow)."""
        out = [np.minimum(self.count, 1)]
        for sweep in range(len(self.sweeps) if sweeps is None else sweeps):
            out.append(seated(self.count, out[-1], self.weight(sweep), self.block.pairs, DISCOUNT, sweep))
        return out

    def token_chances(self) -> np.ndarray:
        """Predictive chance of each token, the mean over the seatings after each sweep."""
        b = self.block
        made = [None, *self.shared] if self.shared else self.seatings(len(self.sweeps) - 1)
        chance = np.zeros(len(b.pairs))
        for sweep in range(1, len(self.sweeps)):
            chance += (self.count - DISCOUNT * made[sweep] + self.weight(sweep)) / (STRENGTH + self.sweeps[sweep][0][b.pair_context])
        return (chance / (len(self.sweeps) - 1))[b.pair]


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document.

    One plan: the documents are packed into blocks once, and Spark reuses that exchange for every step.
    """
    n = partitions(docs.sparkSession)
    rows = packed(docs)

    def ask_pairs(key: tuple, part: pa.Table) -> pa.Table:
        b = Block(part)
        return spread(b.pairs, n, b.id, b.pair_counts())

    def asking(sweep: int):
        def ask_words(key: tuple, part: pa.Table, got: pa.Table) -> pa.Table:
            b = Block(part)
            state = State(b, got)
            made = state.own_seatings()
            context, word = (np.bincount(at, made[-1], len(b.words)).astype(np.uint32) for at in (b.pair_context, b.pair_word))
            _, _, _, _, _, distinct, _, seats = state.sweeps[-1] if state.sweeps else [0] * 8
            if not sweep:
                return spread(b.words, n, b.id, b.word_counts(), context, word, seats=seats, distinct=distinct)
            asked = spread(b.words, n, b.id, b.words[:0], context, word, seats=seats, distinct=distinct, named=False)
            if sweep < SWEEPS:
                return asked
            return pa.concat_tables([asked, spread(b.pairs, n, b.id, *(x.astype(np.uint32) for x in made[1:]), named=False, pairs=True)])

        return ask_words

    def final(key: tuple, part: pa.Table, got: pa.Table) -> pa.Table:
        b = Block(part)
        state = State(b, got)
        words, _, _, _, tokens, distinct, _, _ = state.sweeps[-1]
        per_doc = [np.bincount(b.doc, x, len(b.sizes)) for x in (np.log10(state.token_chances()), np.log10((words[b.word] + 1) / (tokens + (distinct + 1))), words[b.word] > 0)]
        return pa.table({"doc_id": pa.array(b.names, pa.int64(), mask=b.nulls), "held_out": pa.array(b.held), "n_tokens": pa.array(b.sizes), "n_known": pa.array(np.rint(per_doc[2]).astype(np.int64)), "train_tokens": pa.array(np.full(len(b.sizes), tokens), pa.int64()), "base_score": pa.array(per_doc[1]), "score": pa.array(per_doc[0])})

    def with_totals(found: DataFrame) -> DataFrame:
        sums = found.where("block < 0").groupBy("sweep").agg(*(F.sum(c).alias(c) for c in TOTALS))
        return found.where("block >= 0").drop(*TOTALS).join(F.broadcast(sums), "sweep").select("block", "sweep", "bucket", *COLUMNS, *TOTALS)

    pairs = rows.groupBy("block").applyInArrow(ask_pairs, ASKED).groupBy("bucket")
    known, words = pairs.applyInArrow(add_pairs, ANSWER), None
    for sweep in range(SWEEPS + 1):
        asked = rows.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(asking(sweep), ASKED).groupBy("bucket")
        added = words.cogroup(asked).applyInArrow(add_named(sweep), ANSWER) if words else asked.applyInArrow(adding(sweep), ANSWER)
        known, words = known.union(with_totals(added)), words or asked
    known = known.union(pairs.cogroup(asked).applyInArrow(share, ANSWER))
    return rows.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(final, RESULT)
