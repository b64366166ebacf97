import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pytest

from factgraph.llm import pitman_yor
from factgraph.llm.packing import squeeze, squeeze_sorted
from factgraph.llm.words import word_bounds, word_hashes
from tests.llm.conftest import prose


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), None]


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2


def test_base_columns_match_brute_force(docs, texts):
    count = Counter(t for i, x in texts.items() if not held(i) for t in tokens(x))
    n, v = sum(count.values()), len(count)
    rows = pitman_yor.score(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        own = tokens(texts[r.doc_id])
        assert (r.held_out, r.n_tokens, r.train_tokens, r.n_known) == (held(r.doc_id), len(own), n, sum(t in count for t in own))
        assert math.isclose(r.base_score, sum(math.log10((count[t] + 1) / (n + v + 1)) for t in own), rel_tol=1e-9)
        assert r.score < 0


def one_block(rows):
    """The state of a single block, by the functions that Spark runs."""
    docs = pa.table({"doc_id": [i for i, _ in rows], "text": [x for _, x in rows]})
    codes, sizes = [], []
    for _, x in rows:
        own = [(x or "").lower().encode()]
        data = np.frombuffer(own[0], np.uint8)
        starts, ends, _ = word_bounds(data, np.array([0, len(data)]))
        codes.append(np.append(word_hashes(data, starts, ends), pitman_yor.END))
        sizes.append(len(codes[-1]))
    words, code = np.unique(np.concatenate(codes), return_inverse=True)
    ids = docs.column("doc_id").to_numpy()
    packed = {"names": squeeze(ids), "nulls": squeeze(np.zeros(len(ids), np.uint8)), "held": squeeze(np.array([held(i) for i in ids], np.uint8)), "sizes": squeeze(np.array(sizes, np.uint32)), "words": squeeze_sorted(words), "codes": squeeze(code.astype(np.uint32))}
    block = pitman_yor.Block(pa.table({"block": pa.array([5], pa.int64())} | {k: pa.array([v], pa.binary()) for k, v in packed.items()}))

    class Key:
        def __init__(self, i):
            self.i = i

        def as_py(self):
            return self.i

    def answered(asked, add):
        return pa.concat_tables([add((Key(i),), asked.filter(pa.compute.equal(asked.column("bucket"), i))) for i in sorted(set(asked.column("bucket").to_pylist()))])

    known = answered(pitman_yor.spread(block.pairs, 3, 5, block.pair_counts()), pitman_yor.add_pairs)
    for sweep in range(pitman_yor.SWEEPS + 1):
        state = pitman_yor.State(block, known)
        own = np.where(state.first, state.seatings()[-1], 0)
        context, word = (np.bincount(at, own, len(block.words)).astype(np.uint32) for at in (block.pair_context, block.pair_word))
        distinct, seats = (state.sweeps[-1][5], state.sweeps[-1][7]) if state.sweeps else (0, 0)
        got = answered(pitman_yor.spread(block.words, 3, 5, block.word_counts(), context, word, seats=seats, distinct=distinct), pitman_yor.adding(sweep))
        total = {c: pa.compute.sum(got.column(c)).as_py() for c in pitman_yor.TOTALS}
        got = got.filter(pa.compute.greater_equal(got.column("block"), 0))
        for c in pitman_yor.TOTALS:
            got = got.set_column(got.column_names.index(c), c, pa.array([total[c]] * len(got)))
        known = pa.concat_tables([known, got])
    return block, pitman_yor.State(block, known)


def small_corpus():
    vocabulary = sorted({w for i in range(40) for w in prose(i, 8).split()})[:25]
    rng = np.random.default_rng(3)
    chance = 1 / np.arange(1, len(vocabulary) + 1)
    train = [(i, " ".join(rng.choice(vocabulary, 12, p=chance / chance.sum()))) for i in range(400) if not held(i)][:80]
    asked = [i for i in range(1000, 9000) if held(i)]
    return vocabulary, train, asked


def test_chances_of_a_context_sum_to_one():
    vocabulary, train, asked = small_corpus()
    known = sorted({t for _, x in train for t in tokens(x)[:-1]})
    for context in (vocabulary[0], known[-1]):
        pairs = [(i, f"{context} {w}") for i, w in zip(asked, [*known, "unseen-word"], strict=False)]
        block, state = one_block([*train, *pairs, (asked[-1], context)])
        code = word_hashes(np.frombuffer(context.encode(), np.uint8), np.array([0]), np.array([len(context.encode())]))[0]
        own = block.pair_context == np.searchsorted(block.words, code)
        chance = np.zeros(len(block.pairs))
        chance[block.pair] = state.token_chances()
        assert own.sum() == len(known) + 2 and abs(chance[own].sum() - 1) < 1e-9


class Restaurants:
    """The same model with every customer at a table of its own restaurant, seated one after the other by plain Gibbs sampling."""

    def __init__(self, rows, seed):
        self.rng = random.Random(seed)
        self.tokens = [p for _, x in rows for p in zip([..., *tokens(x)], tokens(x), strict=False)]
        self.v = len({w for _, w in self.tokens})
        self.tables = {}  # (restaurant, dish) -> sizes; restaurant None is the parent
        self.all = Counter()
        self.guests = Counter()
        for u, w in self.tokens:
            self.sit(u, w)

    def chance(self, u, w):
        d, strength = (pitman_yor.PARENT_DISCOUNT, pitman_yor.PARENT_STRENGTH) if u is None else (pitman_yor.DISCOUNT, pitman_yor.STRENGTH)
        base = 1 / (self.v + 1) if u is None else self.chance(None, w)
        own = self.tables.get((u, w), [])
        return (sum(own) - d * len(own) + (strength + d * self.all[u]) * base) / (strength + self.guests[u])

    def sit(self, u, w):
        d, strength = (pitman_yor.PARENT_DISCOUNT, pitman_yor.PARENT_STRENGTH) if u is None else (pitman_yor.DISCOUNT, pitman_yor.STRENGTH)
        own = self.tables.setdefault((u, w), [])
        new = (strength + d * self.all[u]) * (1 / (self.v + 1) if u is None else self.chance(None, w))
        at = self.rng.choices(range(len(own) + 1), [*(n - d for n in own), new])[0]
        self.guests[u] += 1
        if at < len(own):
            own[at] += 1
        else:
            own.append(1)
            self.all[u] += 1
            if u is not None:
                self.sit(None, w)

    def leave(self, u, w):
        own = self.tables[u, w]
        at = self.rng.choices(range(len(own)), own)[0]
        self.guests[u] -= 1
        own[at] -= 1
        if not own[at]:
            del own[at]
            self.all[u] -= 1
            if u is not None:
                self.leave(None, w)

    def sweep(self):
        for u, w in self.tokens:
            self.leave(u, w)
            self.sit(u, w)


def test_scores_follow_customers_seated_one_by_one(spark):
    """A sampler that keeps every table, and shares no code with the operator, gives nearly the same scores."""
    vocabulary, train, asked = small_corpus()
    rng = np.random.default_rng(4)
    new = [(i, " ".join(rng.choice(vocabulary, 10))) for i in asked[:40]]
    got = {r.doc_id: r.score for r in pitman_yor.score(spark.createDataFrame([*train, *new], "doc_id long, text string")).collect()}
    model, sums, n = Restaurants(train, 9), Counter(), 60
    for s in range(20 + n):
        model.sweep()
        if s >= 20:
            for i, x in [*train, *new]:
                for u, w in zip([..., *tokens(x)], tokens(x), strict=False):
                    sums[i, u, w] += model.chance(u, w) / n
        for k in sums if s < 20 else ():
            sums[k] = 0
    error = []
    for i, x in [*train, *new]:
        want = sum(math.log10(sums[i, u, w] / sum((i, u, w) == (i, a, b) for a, b in zip([..., *tokens(x)], tokens(x), strict=False))) for u, w in zip([..., *tokens(x)], tokens(x), strict=False))
        error.append((got[i] - want) / len(tokens(x)))
    assert abs(np.mean(error)) < 0.02 and np.abs(error).max() < 0.12, (np.mean(error), np.abs(error).max())


def exact(c, q, d):
    """Chances of 1 to c tables: generalized Stirling numbers times weight**tables."""
    log = np.full(c + 2, -np.inf)
    log[1] = 0
    t = np.arange(c + 2)
    for n in range(1, c):
        with np.errstate(divide="ignore", invalid="ignore"):
            log = np.logaddexp(np.append(-np.inf, log[:-1]), np.where(t <= n, np.log(np.maximum(n - d * t, 1e-300)) + log, -np.inf))
    out = log + t * math.log(q)
    out = np.exp(out - out.max())
    return out / out.sum()


@pytest.mark.parametrize(("c", "q", "d"), [(2, 0.7, 0.5), (4, 0.7, 0.5), (9, 3.0, 0.8), (20, 0.05, 0.8)])
def test_gibbs_steps_follow_the_exact_posterior(c, q, d):
    keys = np.random.default_rng(1).integers(0, 2**63, 20000).astype(np.uint64)
    t = np.ones(20000, np.int64)
    for sweep in range(6):
        t = pitman_yor.seated(np.full(20000, c), t, np.full(20000, q), keys, d, sweep)
    assert np.abs(np.bincount(t, minlength=c + 2) / 20000 - exact(c, q, d)).max() < 0.015


@pytest.mark.parametrize(("c", "q"), [(40, 2.0), (300, 0.5), (300, 20.0), (3000, 4.0)])
def test_steps_of_many_customers_keep_the_mean_of_the_posterior(c, q):
    keys = np.random.default_rng(2).integers(0, 2**63, 4000).astype(np.uint64)
    t = np.ones(4000, np.int64)
    for sweep in range(6):
        t = pitman_yor.seated(np.full(4000, c), t, np.full(4000, q), keys, 0.8, sweep)
    want = (exact(c, q, 0.8) * np.arange(c + 2)).sum()
    assert abs(t.mean() - want) < 0.08 * want + 0.05, (t.mean(), want)


def test_repeated_text_scores_better_than_the_base(spark):
    rows = [(i, prose(i % 20, 40)) for i in range(140)]
    got = pitman_yor.score(spark.createDataFrame(rows, "doc_id long, text string")).where("held_out").toPandas()
    assert (got.score > got.base_score).all()


def test_empty(empty):
    assert pitman_yor.score(empty).count() == 0


def test_a_bigram_is_seated_by_the_first_block_that_trains_on_it():
    """Other blocks get its tables from the bucket; words are named once, and what comes later is aligned to them."""
    block, state = one_block(small_corpus()[1])
    whole = state.seatings(2)
    state.sweeps = state.sweeps[:2]
    state.first = np.arange(len(block.pairs)) % 3 == 0
    own = state.own_seatings()
    assert len(own) == 3 and all((a == np.where(state.first, b, 0)).all() for a, b in zip(own, whole, strict=True))

    half = len(block.pairs) // 2
    keys = {1: block.pairs, 2: block.pairs[:half]}
    named = pa.concat_tables([pitman_yor.spread(k, 1, i, np.ones(len(k), np.uint32)) for i, k in keys.items()])
    told = {1: [np.where(np.arange(len(x)) < half, 0, x) for x in whole[1:]], 2: [x[:half] for x in whole[1:]]}
    asked = pa.concat_tables([pitman_yor.spread(keys[i], 1, i, *(x.astype(np.uint32) for x in t), named=False, pairs=True) for i, t in reversed(told.items())])
    got = {r["block"]: r for r in pitman_yor.share((pa.scalar(0),), named, asked).to_pylist()}
    for i, n in ((1, len(block.pairs)), (2, half)):
        assert got[i]["sweep"] == -2 and all((pitman_yor.expand(got[i][c], np.uint32) == x[:n]).all() for c, x in zip("ab", whole[1:], strict=True))
    guests, tables = (np.arange(len(block.words), dtype=np.uint32) % m for m in (5, 3))
    first = pitman_yor.spread(block.words, 1, 1, block.word_counts(), guests, tables, seats=3.0, distinct=9)
    later = pitman_yor.spread(block.words, 1, 1, block.words[:0], guests, tables, seats=3.0, distinct=9, named=False)
    assert later.column("keys").to_pylist() == later.column("a").to_pylist() == [b""]
    assert pitman_yor.add_named(1)((pa.scalar(0),), first, later).equals(pitman_yor.adding(1)((pa.scalar(0),), first))
