import hashlib
import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from factgraph.llm import secrets_scan

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def brute(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6] + [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20] + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["password", "Token", "api_key", "secret: token", "=", " = ", '"', ":", "AKIA" + "Z9" * 9, "AKIA12", "0123456789abcdef" * 2, "deadbeef", "é ", "\n", "x", "日", "ABC123xyz"]), max_size=14))
def test_base_spans_match_brute_force(parts):
    import pyarrow as pa

    text = "".join(parts)
    assert next(iter(secrets_scan.scan(pa.array([text]))))[0] == brute(text)


def test_report_keeps_base_and_adds_by_network(spark, texts, empty):
    rng = random.Random(5)
    token = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    rows = dict(texts)
    for i in range(60):
        rows[100 + i] = f"some words here token = \"{token(40)}\" and more"
        rows[200 + i] = f"call {rng.randrange(10**15, 10**16)} or see mail{i}.example.com2 now"
    docs = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    found = secrets_scan.candidates(docs)
    detector = secrets_scan.train(found)
    assert detector is not None and 0 < detector.threshold <= 1
    assert detector.measured["corpus_secrets"] >= 0.9 and detector.measured["made_secrets"] >= 0.9 and detector.measured["made_others"] <= 0.05
    got = {r.doc_id: r for r in secrets_scan.report(found, detector).collect()}
    assert len(got) == len(rows)
    for i, text in rows.items():
        joined = ",".join(f"{secrets_scan.KINDS[k]}:{s}:{e}" for s, k, e in brute(text))
        assert got[i].base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert set(filter(None, joined.split(","))) <= set(got[i].spans.split(","))
    assert got[100].n_assign == 1 and got[100].n_hex == 1
    assert sum(got[200 + i].n_added for i in range(60)) <= 3
    # keys that no base pattern finds, in documents that nothing was learnt from
    rows = {}
    for i in range(20):
        rows[300 + i] = f"we call it with client_key: {''.join(rng.choice('ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnpqrstuvwxyz23456789') for _ in range(40))} and go on"
    found = secrets_scan.candidates(spark.createDataFrame(list(rows.items()), "doc_id long, text string"))
    got = {r.doc_id: r for r in secrets_scan.report(found, detector).collect()}
    assert all(got[300 + i].n_assign + got[300 + i].n_hex == 0 for i in range(20)) and sum(got[300 + i].n_added == 1 for i in range(20)) >= 18
    none = secrets_scan.candidates(empty)
    assert secrets_scan.train(none) is None and secrets_scan.report(none, None).count() == 0


def test_gradients():
    network, rng = secrets_scan.Network(), np.random.default_rng(0)
    x, y = rng.integers(0, 96, (3, secrets_scan.WIDTH)), np.array([1.0, 0, 1])

    def loss():
        s, _ = network.forward(x)
        return (np.logaddexp(0, s) - y * s).sum()

    score, kept = network.forward(x)
    grad = network.backward(1 / (1 + np.exp(-score)) - y, kept)
    for name, values in network.p.items():
        at = np.unravel_index(np.abs(grad[name]).argmax(), values.shape)
        old = values[at]
        values[at] = old + 1e-5
        up = loss()
        values[at] = old - 1e-5
        down = loss()
        values[at] = old
        assert abs((up - down) / 2e-5 - grad[name][at]) < 1e-3 * max(1, abs(grad[name][at]))


def test_long_candidates_are_covered():
    text = "ab " + "k9" * 120 + " cd"
    views = secrets_scan.windows(text, 3, 243)
    assert "".join(v[secrets_scan.BEFORE : secrets_scan.BEFORE + secrets_scan.INSIDE].rstrip("\x00") for v in views) == text[3:243]


def test_all_windows_train_in_blocks(spark):
    rng = random.Random(3)
    token = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    rows = [(i, f'words {i} here token = "{token(40)}" and more') for i in range(90)] + [(100 + i, f"call {rng.randrange(10**15, 10**16)} or see mail{i}.example.com2 now") for i in range(90)]
    found = secrets_scan.candidates(spark.createDataFrame(rows, "doc_id long, text string"))
    views = {(v.window, v.other < 0) for r in found.collect() for v in r.views}
    detector, again = (secrets_scan.train(found, block=64, epochs=5) for _ in range(2))
    assert detector.windows == {"secret": sum(s for _, s in views), "other": sum(not s for _, s in views)} and len(views) > 3 * 64
    assert (detector.network.state() == again.network.state()).all() and detector.threshold == again.threshold
    assert detector.measured["corpus_secrets"] >= 0.9 and detector.measured["made_secrets"] >= 0.9 and detector.measured["made_others"] <= 0.2


def test_calibration_counts_rows():
    from factgraph.llm.linear import platt

    score, y, n = np.array([-2.0, 0.5, 1.0, 3.0]), np.array([0.0, 0, 1, 1]), np.array([3, 1, 2, 5])
    assert np.allclose(platt(score, y, n), platt(np.repeat(score, n), np.repeat(y, n)))
