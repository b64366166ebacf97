"""Secret scan: base patterns, and a character convolutional network over every candidate.

Candidates are the spans of the base patterns and all other runs of
``[A-Za-z0-9+/_.=-]`` with 12 characters and a digit or with 24 characters. The
network reads windows of characters: what stands before, the candidate, what stands
behind; a long candidate has several windows and takes the highest chance of them.
It is trained on all distinct windows, in blocks of about ``BLOCK``: each epoch, every block
takes its steps from the same network, and the mean of the blocks' networks, weighed by their
windows, goes on. Findings of the base patterns are labelled secret, other candidates
are not. As these labels alone only teach the base patterns, ``MADE`` labelled findings
of either class are made by rule (``made``): keys of other alphabets, shapes and names,
and numbers, addresses, hosts, paths and words, and every base finding also stands as
secret with another finding's surroundings, both in every block. A candidate's own characters decide by their hash
what it serves for, so copies never stand on two sides: three fifths train, one fifth
calibrates the chance (Platt) and gives the threshold, the highest one that keeps
``RECALL`` of the fifth's corpus findings and as much of its made ones, from how many of
all windows have each score (to a thousandth); the last fifth
measures (``Detector.measured``: shares of the corpus's and the made secrets that are
accepted, and of the other candidates). Base spans always stay; the network adds spans of
kind ``cnn``.

A null or empty text has no findings; without findings or without other candidates
nothing is added; repeated rows give repeated results. Positions are code points,
ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factgraph.llm.linear import platt, sigmoid
from factgraph.llm.tables import saved
from factgraph.llm.words import lower_ascii, mix, text_slices

# fixed values of the base patterns
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 6, 20, 24
KINDS = ("assign", "access", "hex", "cnn")

BEFORE, INSIDE, BEHIND = 24, 48, 16
WIDTH = BEFORE + INSIDE + BEHIND
#: Windows that a block of training holds about, and blocks whose networks are added up at once.
BLOCK, TOGETHER = 4000, 64
EPOCHS = 14
MADE = 1200
RECALL = 0.98


def _members(text: str) -> np.ndarray:
    flags = np.zeros(256, bool)
    flags[list(text.encode())] = True
    return flags


DIGITS = _members("0123456789")
HEX = _members("0123456789abcdef")
RUN = _members("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")


def runs(flags: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of set flags; none crosses rows."""
    edge = np.zeros(len(flags) + 1, np.int8)
    edge[:-1] = flags
    begin = flags.copy()
    begin[1:] &= ~flags[:-1]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    begin[heads] = flags[heads]
    last = flags & (edge[1:] == 0)
    tails = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    last[tails] = flags[tails]
    return np.flatnonzero(begin), np.flatnonzero(last) + 1


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of assign and access findings."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    return found + [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]


def windows(text: str, start: int, end: int) -> list[str]:
    """Character windows of a candidate; together they cover it."""
    out = []
    for at in range(start, end, INSIDE):
        left = text[max(0, at - BEFORE) : at].rjust(BEFORE, "\x00")
        inside = text[at : min(end, at + INSIDE)].ljust(INSIDE, "\x00")
        out.append(left + inside + text[min(end, at + INSIDE) : min(end, at + INSIDE) + BEHIND].ljust(BEHIND, "\x00"))
    return out


def scan(column: pa.Array) -> Iterator[tuple[list[tuple[int, int, int]], list[tuple[int, int]], list[tuple[int, int, str]]]]:
    """For each text: base spans (start, kind, end), other candidates (start, end), and (candidate or -1 for a base span, span, window)."""
    for _, data, offsets in text_slices(column):
        n = len(offsets) - 1
        raw = data.tobytes()
        low = lower_ascii(data).tobytes()
        look = np.zeros(n, bool)
        for where, words in ((low, KEYWORDS), (raw, (b"AKIA",))):
            for word in words:
                at = where.find(word)
                while at >= 0:
                    look[np.searchsorted(offsets, at, "right") - 1] = True
                    at = where.find(word, at + 1)
        hex_at, hex_end = runs(HEX[data], offsets)
        keep = hex_end - hex_at >= MIN_HEX
        hex_at, hex_end = hex_at[keep], hex_end[keep]
        run_at, run_end = runs(RUN[data], offsets)
        size = run_end - run_at
        digits = np.concatenate(([0], np.cumsum(DIGITS[data])))
        keep = (size >= 24) | ((size >= 12) & (digits[run_end] > digits[run_at]))
        run_at, run_end = run_at[keep], run_end[keep]
        hex_row = np.searchsorted(hex_at, offsets)
        run_row = np.searchsorted(run_at, offsets)
        for r in range(n):
            if not look[r] and hex_row[r] == hex_row[r + 1] and run_row[r] == run_row[r + 1]:
                yield [], [], []
                continue
            head = int(offsets[r])
            text = raw[head : offsets[r + 1]].decode("utf-8", "replace")
            points = np.concatenate(([0], np.cumsum((data[head : offsets[r + 1]] & 0xC0) != 0x80)))
            base = base_spans(text) if look[r] else []
            base += [(int(points[hex_at[i] - head]), 2, int(points[hex_end[i] - head])) for i in range(hex_row[r], hex_row[r + 1])]
            base.sort()
            other = []
            for i in range(run_row[r], run_row[r + 1]):
                a, b = int(points[run_at[i] - head]), int(points[run_end[i] - head])
                if not any(s < b and a < e for s, _, e in base):
                    other.append((a, b))
            views = [(-1, i, w) for i, (s, _, e) in enumerate(base) for w in windows(text, s, e)]
            yield base, other, views + [(i, i, w) for i, (s, e) in enumerate(other) for w in windows(text, s, e)]


def codes(texts: list[str]) -> np.ndarray:
    """Windows as rows of symbols 0 to 95; what lies beyond ASCII is one symbol."""
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).reshape(len(texts), WIDTH).astype(np.int64)
    return np.where(points == 0, 0, np.where((points >= 32) & (points < 127), points - 31, 0))


class Network:
    """Embedding, one convolution, the maximum over all places, two dense layers."""

    EMBED, FILTERS, SPAN, HIDDEN = 8, 24, 5, 16

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        fan = self.EMBED * self.SPAN
        self.p = {
            "embed": rng.normal(0, 0.3, (96, self.EMBED)), "conv": rng.normal(0, (2 / fan) ** 0.5, (fan, self.FILTERS)), "conv_b": np.zeros(self.FILTERS),
            "one": rng.normal(0, (1 / self.FILTERS) ** 0.5, (3 * self.FILTERS, self.HIDDEN)), "one_b": np.zeros(self.HIDDEN), "two": rng.normal(0, 0.3, self.HIDDEN), "two_b": np.zeros(1),
        }
        #: Adam's means and how many steps they are of
        self.first, self.second = ({k: np.zeros_like(a) for k, a in self.p.items()} for _ in range(2))
        self.t = 0
        #: the places of the three parts: before, inside and behind the candidate
        self.parts = (slice(0, BEFORE - self.SPAN + 1), slice(BEFORE - self.SPAN + 1, BEFORE + INSIDE - self.SPAN + 1), slice(BEFORE + INSIDE - self.SPAN + 1, WIDTH - self.SPAN + 1))

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, tuple]:
        p = self.p
        seen = p["embed"][x]
        patches = np.concatenate([seen[:, i : WIDTH - self.SPAN + 1 + i] for i in range(self.SPAN)], axis=2)
        act = np.maximum(patches @ p["conv"] + p["conv_b"], 0)
        top = [act[:, s].argmax(axis=1) + s.start for s in self.parts]
        pooled = np.concatenate([np.take_along_axis(act, t[:, None], 1)[:, 0] for t in top], axis=1)
        hidden = np.maximum(pooled @ p["one"] + p["one_b"], 0)
        return hidden @ p["two"] + p["two_b"][0], (x, patches, top, pooled, hidden)

    def backward(self, wrong: np.ndarray, kept: tuple) -> dict[str, np.ndarray]:
        p, (x, patches, top, pooled, hidden) = self.p, kept
        grad = {"two": hidden.T @ wrong, "two_b": np.array([wrong.sum()])}
        dh = wrong[:, None] * p["two"] * (hidden > 0)
        grad |= {"one": pooled.T @ dh, "one_b": dh.sum(axis=0)}
        dp = (dh @ p["one"].T) * (pooled > 0)
        rows, f = np.arange(len(x))[:, None], self.FILTERS
        conv, bias, embed = np.zeros_like(p["conv"]), np.zeros(f), np.zeros_like(p["embed"])
        for i, t in enumerate(top):
            d = dp[:, i * f : (i + 1) * f]
            own = patches[rows, t]
            conv += np.einsum("nfc,nf->cf", own, d)
            bias += d.sum(axis=0)
            back = np.einsum("nf,cf->nfc", d, p["conv"]).reshape(len(x), f, self.SPAN, self.EMBED)
            for k in range(self.SPAN):
                np.add.at(embed, x[rows, t + k].reshape(-1), back[:, :, k].reshape(-1, self.EMBED))
        return grad | {"conv": conv, "conv_b": bias, "embed": embed}

    def state(self) -> np.ndarray:
        """All numbers of the network and its means in one row."""
        return np.concatenate([*(a.ravel() for part in (self.p, self.first, self.second) for a in part.values()), [self.t]])

    def load(self, state: np.ndarray) -> Network:
        at = 0
        for part in (self.p, self.first, self.second):
            for k, a in part.items():
                part[k] = state[at : at + a.size].reshape(a.shape).copy()
                at += a.size
        self.t = round(float(state[at]))
        return self

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, batch: int = 64, rate: float = 0.004, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        first, second, t = self.first, self.second, self.t
        weight = np.where(y > 0, 0.5 / max(y.mean(), 1e-3), 0.5 / max(1 - y.mean(), 1e-3))
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(x), batch):
                own, t = order[i : i + batch], t + 1
                score, kept = self.forward(x[own])
                for k, g in self.backward((sigmoid(score) - y[own]) * weight[own] / len(own), kept).items():
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    self.p[k] -= rate * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
        self.t = t

    def score(self, x: np.ndarray, batch: int = 512) -> np.ndarray:
        return np.concatenate([self.forward(x[i : i + batch])[0] for i in range(0, len(x), batch)]) if len(x) else np.zeros(0)


#: Parts of made findings: names that keys have, marks between name and key, first letters of known kinds of keys.
NAMES = ("client_key", "private key", "access", "auth", "credential", "signing_key", "session", "bearer", "pwd", "key", "apikey", "webhook", "license_key", "conn", "jwt", "hmac", "salt", "encryption_key")
MARKS = (" = ", "=", ": ", ' = "', "='", ':"', " ")
HEADS = ("", "", "", "", "sk_live_", "ghp_", "xoxb-", "eyJ", "SG.", "AIza", "pk_")
ALPHABETS = ("0123456789ABCDEF", "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "abcdefghijklmnopqrstuvwxyz0123456789_-")


def made(n: int, seed: int = 20240811) -> tuple[list[str], list[str]]:
    """Windows of n secrets and of n other candidates, made by rule."""
    rng = np.random.default_rng(seed)
    pick = lambda of: of[int(rng.integers(len(of)))]
    some = lambda alphabet, low, high: "".join(alphabet[i] for i in rng.integers(0, len(alphabet), int(rng.integers(low, high))))
    word = lambda: some("etaoinshrdlucmfwypbgkv", 2, 9)
    digits = lambda low, high: some("0123456789", low, high)

    def secret() -> str:
        body = pick(HEADS) + some(pick(ALPHABETS), 24, 56)
        return body if any(c.isdigit() for c in body) else body + digits(2, 3)

    others = (
        lambda: digits(12, 20), lambda: ".".join(digits(1, 4) for _ in range(4)) + digits(6, 9), lambda: f"{word()}.{digits(1, 4)}", lambda: f"{word()}{digits(1, 3)}.{word()}.com/{word()}/{word()}-{digits(1, 6)}.html",
        lambda: f"20{digits(2, 3)}-{digits(2, 3)}-{digits(2, 3)}T{digits(6, 7)}", lambda: "".join(word() for _ in range(6)) + digits(0, 2), lambda: "/".join(word() for _ in range(5)) + f"/{word()}{digits(1, 3)}.py", lambda: "_".join(word() for _ in range(5)) + digits(1, 3),
        lambda: some("=", 24, 60), lambda: some("-", 24, 60), lambda: "-".join(word() for _ in range(7)), lambda: "+".join(digits(2, 5) for _ in range(6)), lambda: f"v{digits(1, 3)}.{digits(1, 3)}.{digits(1, 3)}-{word()}.{digits(3, 7)}",
    )
    out: tuple[list[str], list[str]] = ([], [])
    for i in range(2 * n):
        before = " ".join(word() for _ in range(4)) + pick((" ", "\n", ". "))
        own = secret() if i % 2 else pick(others)()
        if i % 2 and rng.random() < 0.8:
            before += pick(NAMES) + pick(MARKS)
        text = before + own + pick((" ", "\n", '"', "'", ", ", "")) + " ".join(word() for _ in range(3))
        out[1 - i % 2].append(windows(text, len(before), len(before) + len(own))[0])
    return out


def sides(views: list[str]) -> np.ndarray:
    """0 to 4 for each window, by the candidate's own characters alone."""
    own = np.array([int.from_bytes(hashlib.sha256(v[BEFORE : BEFORE + INSIDE].encode()).digest()[:8], "little") for v in views], np.uint64)
    return (mix(own) % np.uint64(5)).astype(np.int64)


#: What a window of a block is: a base finding, one where another finding stands, a made secret, another candidate, a made one.
GROUPS = {"corpus_secrets": 1.0, "moved_secrets": 1.0, "made_secrets": 1.0, "corpus_others": 0.0, "made_others": 0.0}


def coded(views: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return codes(views), sides(views)


@cache
def beside() -> list[tuple[np.ndarray, np.ndarray]]:
    """Codes and sides of the made findings of either class; once for each worker."""
    return [coded(views) for views in made(MADE)]


def examples(secret: list[str], other: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes, group (a place in GROUPS) and side of a block's windows and of what is made beside them."""
    new, plain = beside()
    # the same candidates where another finding stands: no keyword tells them
    moved = [w[:BEFORE] + v[BEFORE : BEFORE + INSIDE] + w[BEFORE + INSIDE :] for v, w in zip(secret, other * (len(secret) // len(other) + 1), strict=False)] if other else []
    groups = [coded(secret), coded(moved), new, coded(other), plain]
    return np.concatenate([g[0] for g in groups]), np.repeat(np.arange(5), [len(g[1]) for g in groups]), np.concatenate([g[1] for g in groups])


class Detector:
    """The network with its calibration, its threshold, how many windows it is of, and what it reaches on candidates that served for neither."""

    def __init__(self, network: Network, windows: dict[str, int], group: np.ndarray, side: np.ndarray, score: np.ndarray, n: np.ndarray):
        """``n`` windows of each group, side and score."""
        self.network, self.windows = network, windows
        held = side == 3
        self.a, self.b = platt(score[held], np.array(list(GROUPS.values()))[group[held]], n[held])
        chance = self.chance(score)

        def lowest(own: np.ndarray) -> float:
            order = np.flatnonzero(own)[np.argsort(chance[own], kind="stable")]
            return float(chance[order[np.searchsorted(np.cumsum(n[order]), int((1 - RECALL) * n[own].sum()), "right")]])

        self.threshold = min((lowest(held & (group == g)) for g in (0, 2) if n[held & (group == g)].sum()), default=0.5)
        taken = chance >= self.threshold
        last = [(side == 4) & (group == g) for g in range(5)]
        self.measured = {name: float(n[own & taken].sum() / n[own].sum()) if n[own].sum() else None for name, own in zip(GROUPS, last, strict=True)}

    def chance(self, score: np.ndarray) -> np.ndarray:
        return sigmoid(self.a * score + self.b)

    def accepts(self, texts: list[str], owner: list[int], n: int) -> np.ndarray:
        best = np.zeros(n)
        if texts:
            np.maximum.at(best, owner, self.chance(self.network.score(codes(texts))))
        return best >= self.threshold


def candidates(docs: DataFrame) -> DataFrame:
    """Base spans, other candidates and the windows of both for every document, written to the shared folder."""
    schema = "doc_id long, base array<struct<start: long, kind: int, end: long>>, other array<struct<start: long, end: long>>, views array<struct<other: int, window: string>>"
    names = pa.schema([("doc_id", pa.int64()), ("base", pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))), ("other", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("views", pa.list_(pa.struct([("other", pa.int32()), ("window", pa.string())])))])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            base, other, views = [], [], []
            for x, y, z in scan(b.column("text")):
                base.append([{"start": s, "kind": k, "end": e} for s, k, e in x])
                other.append([{"start": s, "end": e} for s, e in y])
                views.append([{"other": i, "window": w} for i, _, w in z])
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "base": base, "other": other, "views": views}, schema=names)

    return saved(docs.select("doc_id", "text").mapInArrow(look, schema), "candidates")


def train(found: DataFrame, block: int = BLOCK, epochs: int = EPOCHS) -> Detector | None:
    """Fit on all distinct windows, about ``block`` of them to a task; None if a class has fewer than ten."""
    views = saved(found.select(F.explode("views").alias("v")).select(F.col("v.window").alias("window"), (F.col("v.other") < 0).alias("secret")).distinct(), "windows")
    counts = {r.secret: r["count"] for r in views.groupBy("secret").count().collect()}
    if min(counts.get(kind, 0) for kind in (True, False)) < 10:
        return None
    blocks = -(-sum(counts.values()) // block)
    dealt = views.withColumn("block", F.pmod(F.xxhash64("window"), F.lit(blocks))).repartition(blocks, "block")
    spark = found.sparkSession

    def of(part: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rows = sorted(zip(part.column("window").to_pylist(), part.column("secret").to_pylist(), strict=True))
        return examples([w for w, secret in rows if secret], [w for w, secret in rows if not secret])

    # one block takes all its steps at once
    rounds, each = (epochs, 1) if blocks > 1 else (1, epochs)

    def stepped(state: np.ndarray, seed: int) -> DataFrame:
        start = spark.sparkContext.broadcast(state)

        def step(key: tuple, part: pa.Table) -> pa.Table:
            x, group, side = of(part)
            own = Network().load(start.value)
            own.train(x[side < 3], np.array(list(GROUPS.values()))[group[side < 3]], each, seed=seed)
            return pa.table({"block": [key[0].as_py()], "n": pa.array([len(x)], pa.int64()), "state": [own.state().tolist()]})

        return dealt.groupBy("block").applyInArrow(step, "block long, n long, state array<double>")

    def add(key: tuple, part: pa.Table) -> pa.Table:
        part = part.sort_by("block")
        n = part.column("n").to_numpy()
        sums = sum(w * np.array(row) for w, row in zip(n, part.column("state").to_pylist(), strict=True))
        return pa.table({"lot": [key[0].as_py()], "n": [int(n.sum())], "state": [sums.tolist()]})

    network = Network()
    for i in range(rounds):
        lots = stepped(network.state(), 11 + i).groupBy(F.floor(F.col("block") / TOGETHER).alias("lot")).applyInArrow(add, "lot long, n long, state array<double>").orderBy("lot").collect()
        network.load(sum(np.array(r.state) for r in lots) / sum(r.n for r in lots))
    last = spark.sparkContext.broadcast(network.state())

    def score(key: tuple, part: pa.Table) -> pa.Table:
        x, group, side = of(part)
        kept = np.flatnonzero(side > 2)
        found = np.floor(np.clip(Network().load(last.value).score(x[kept]), -100, 100) * 1000).astype(np.int64)
        rows, n = np.unique(np.stack((group[kept], side[kept], found)), axis=1, return_counts=True)
        return pa.table({"g": rows[0], "side": rows[1], "score": rows[2], "n": n.astype(np.int64)})

    scored = dealt.groupBy("block").applyInArrow(score, "g long, side long, score long, n long").groupBy("g", "side", "score").agg(F.sum("n").alias("n")).orderBy("g", "side", "score")
    table = scored.toArrow()
    group, side, bins, n = (table.column(c).to_numpy() for c in ("g", "side", "score", "n"))
    return Detector(network, {"secret": counts[True], "other": counts[False]}, group, side, bins / 1000, n)


def report(found: DataFrame, detector: Detector | None) -> DataFrame:
    """doc_id, counts and digest of the base spans, and all spans, for every document."""
    shared = found.sparkSession.sparkContext.broadcast(detector)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[str, list] = {k: [] for k in ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_added")}
            others, views = b.column("other").to_pylist(), b.column("views").to_pylist()
            at = np.concatenate(([0], np.cumsum([len(x) for x in others])))
            texts, owner = [], []
            for i, own in enumerate(views):
                for v in own:
                    if v["other"] >= 0:
                        texts.append(v["window"])
                        owner.append(int(at[i]) + v["other"])
            taken = shared.value.accepts(texts, owner, int(at[-1])) if shared.value else np.zeros(int(at[-1]), bool)
            for i, base in enumerate(b.column("base").to_pylist()):
                spans = [(x["start"], x["kind"], x["end"]) for x in base]
                joined = [",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(x)) for x in (spans, spans + [(x["start"], 3, x["end"]) for j, x in enumerate(others[i]) if taken[at[i] + j]])]
                for k, name in enumerate(("n_assign", "n_access", "n_hex")):
                    out[name].append(sum(x[1] == k for x in spans))
                out["base_sha256"].append(hashlib.sha256(joined[0].encode()).hexdigest())
                out["spans"].append(joined[1])
                out["n_added"].append(int(taken[at[i] : at[i + 1]].sum()))
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id")} | {k: pa.array(v, pa.string() if k in ("base_sha256", "spans") else pa.int64()) for k, v in out.items()})

    return found.mapInArrow(judge, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_added long")
