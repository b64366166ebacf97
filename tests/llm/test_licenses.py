import textwrap

from factgraph.llm import licenses
from tests.llm.conftest import prose


def test_notices_are_found_by_wording(spark, texts, empty):
    rows = dict(texts) | {100 + i: f"{prose(i, 30)}\n{text}\n{prose(i + 50, 30)}" for i, text in enumerate(licenses.TEMPLATES.values())}
    rows |= {200: "a text about a license to fish in the lake, and nothing else", 201: "RELEASED UNDER THE MIT LICENSE.\n\n\n\n" + "Licensed under CC BY-NC 4.0.", 202: "licensed"}
    docs = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan(docs).collect()}
    assert len(got) == len(rows)
    for i, name in enumerate(licenses.TEMPLATES):
        if got[100 + i].n_blocks:
            assert got[100 + i].licenses == name, (name, got[100 + i])
    assert got[200].n_blocks == 1 and got[200].n_confirmed == 0
    assert got[201].licenses == "CC-BY-NC-4.0,MIT" and got[201].findings.split(",")[1].split(":")[1:3] == ["4", "5"]
    assert got[0].n_blocks == 0 and got[1].licenses == "" and got[20].n_blocks == 0
    assert licenses.scan(empty).count() == 0


def test_ranking_prefers_the_template_that_saves_most():
    scanner = licenses.Scanner(licenses.TEMPLATES)
    won = scanner.judge("This work is licensed under the GNU General Public License, version 2.")
    assert won[0][0] == "GPL-2.0" and won[0][2] == 0


def test_wrapped_and_neighbouring_notices_are_found(spark):
    def wrapped(name, width):
        return "\n".join("# " + line for line in textwrap.wrap(licenses.TEMPLATES[name], width, break_on_hyphens=False, break_long_words=False))

    rows = {i: prose(i, 300) + "\n" + wrapped(name, width) + "\n" + prose(i + 50, 300) for i, (name, width) in enumerate((n, w) for n in ("MIT-text", "GPL-3.0-header", "Apache-2.0-header", "BSD-text", "ISC-text") for w in (40, 76))}
    rows[50] = "Released under the MIT License.\nLicensed under the Apache License, Version 2.0.\n" + wrapped("BSD-text", 70)
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(list(rows.items()), "doc_id long, text string")).collect()}
    for i, name in enumerate(n for n in ("MIT-text", "GPL-3.0-header", "Apache-2.0-header", "BSD-text", "ISC-text") for _ in (40, 76)):
        assert got[i].licenses == name and got[i].findings.endswith(":0") and got[i].findings.split(":")[1] == "1", got[i]
    assert got[50].licenses == "Apache-2.0,BSD-text,MIT" and got[50].n_confirmed == 3


def test_compression_decides_between_overlapping_notices():
    """Many short words against a few long ones: the words' number doesn't tell which one explains more of the text."""
    scanner = licenses.Scanner({"short": "a b c d e f g h", "long": "g h incomprehensibilities counterrevolutionaries electroencephalograph"})
    won = scanner.judge("a b c d e f g h incomprehensibilities counterrevolutionaries electroencephalograph")
    assert [w[0] for w in won] == ["long"]
