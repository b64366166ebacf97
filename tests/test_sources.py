from __future__ import annotations

import pytest

from factgraph.operators.index import FactError
from factgraph.operators.textsearch import QueryError, TextQuery
from factgraph.sources import diffs, files, snapshots, tests
from factgraph.streaming import search

GIT = """diff --git a/x/a.cpp b/x/b.cpp
similarity index 90%
rename from x/a.cpp
rename to x/b.cpp
--- a/x/a.cpp
+++ b/x/b.cpp
@@ -1,2 +1,2 @@ head
 keep
--- old
+new
\\ No newline at end of file
diff --git a/n b/n
new file mode 100644
--- /dev/null
+++ b/n
@@ -0,0 +1 @@
+one
diff --git a/m b/m
old mode 100644
new mode 100755
"""


def test_diff_rows():
    rows = diffs.parse(GIT)
    assert [(r["file_no"], r["change"], r.get("kind"), r.get("old_start"), r.get("new_start")) for r in rows] == [
        (1, "rename", "context", 1, 1), (1, "rename", "delete", 1, 1), (1, "rename", "add", 1, 1), (1, "rename", "no_newline", 1, 1), (2, "add", "add", 1, 1), (3, "modify", None, None, None),
    ]
    assert diffs.parse("") == []


@pytest.mark.parametrize(
    ("raw", "status"),
    [("--- a\n+++ b\n", "invalid"), ("--- x\n+++ x\n@@ -1 +1 @@\n-a\n", "invalid"), ("--- x\n+++ x\n@@ -1 +1 @@\n-a\n+b\n+c\n", "invalid"), ("Binary files a and b differ\n", "unsupported"), ("diff --cc x\n", "unsupported"), ('diff --git "a/x" b/x\n', "unsupported"), ("--- ../x\n+++ ../x\n@@ -1 +1 @@\n-a\n+b\n", "invalid"), ("words\n", "invalid"), ("a\rb", "invalid")],
)
def test_refused_diffs(spark, raw, status):
    rows = diffs.diff_lines(spark.createDataFrame([("d", raw)], "diff_id string, content string")).collect()
    assert [(r.status, r.kind) for r in rows] == [(status, None)]


@pytest.mark.parametrize(
    "head",
    ["index 12..zz\n", "similarity index 999%\n", "old mode 100644\n", "old mode 100644\nold mode 100644\nnew mode 100755\n", "new file mode 100644\ndeleted file mode 100644\n", "rename from x\n", "--- a/y\n+++ b/x\n", "--- /dev/null\n+++ b/x\n"],
)
def test_headers_that_are_refused(head):
    marks = "" if "---" in head else "--- a/x\n+++ b/x\n"
    with pytest.raises(diffs.Refused):
        diffs.parse(f"diff --git a/x b/x\n{head}{marks}@@ -1 +1 @@\n-a\n+b\n")
    for odd in ("\\ some words\n", "\u2028\n", "\f\n"):
        with pytest.raises(diffs.Refused):
            diffs.parse(f"--- x\n+++ x\n@@ -1 +1 @@\n-a\n+b\n{odd}")
    good = diffs.parse("diff --git a/x b/x\nold mode 100644\nnew mode 100755\nindex 12ab..34cd 100755\n--- a/x\n+++ b/x\n@@ -1 +1 @@\n-a\n+b\n")
    assert [r["kind"] for r in good] == ["delete", "add"]


SOURCE = """class Fix {};
/* TEST_F(Fix, Hidden) {} */
TEST_F(Fix, One)
{
    auto a = "}"; auto b = R"x( } )x"; // }
}
struct Fix {};
  HWTEST_P ( Fix , Two ) { if (x) { y(); } }
TEST_F(Other, Three);
"""


def test_macros():
    rows = tests.discover_in("t.cpp", SOURCE)
    cases = {r[2]: r for r in rows if r[0] == "case"}
    assert set(cases) == {"One", "Two", "Three"}
    assert SOURCE[cases["One"][9] : cases["One"][10]].endswith("// }\n}")
    assert SOURCE[cases["Two"][9] : cases["Two"][10]].strip().endswith("} }") and cases["Three"][10] is None
    assert cases["One"][3] != cases["Two"][3]
    fixtures = [r for r in rows if r[0] == "fixture"]
    assert [(r[2], r[5], r[6]) for r in fixtures] == [("Fix", 1, 7), ("Fix", 7, 8), ("Other", 9, 8)]


def test_scan_and_inventory(spark, tmp_path):
    for name, text in (("src/a.cpp", "int a;"), ("src/build/b.cpp", "no"), ("tests/c.cc", "é"), (".git/x", "no"), ("d.bin", b"\xff\xfe")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(text if isinstance(text, bytes) else text.encode())
    found = files.scan(spark, str(tmp_path))
    assert [r.path for r in found.select("path").collect()] == ["d.bin", "src/a.cpp", "tests/c.cc"]
    assert [r.path for r in files.scan(spark, str(tmp_path), include=["src*"], types=["source"]).collect()] == ["src/a.cpp"]
    assert files.text_files(found).count() == 2 and files.inventory(found).count() == 3


def test_compile_database(spark, tmp_path):
    (tmp_path / "c.json").write_text('[{"directory": "/b", "file": "a.cpp", "command": "cc -c a.cpp"}, {"directory": "/b", "file": "a.cpp", "arguments": ["cc", "-O2"]}, {"directory": "/b", "file": "z.cpp", "arguments": ["cc"]}]')
    got = files.compile_contexts(files.compile_commands(spark, str(tmp_path / "c.json")))
    assert sorted((r.source, r.contexts) for r in got.collect()) == [("a.cpp", 2), ("a.cpp", 2), ("z.cpp", 1)]


def test_depfile(spark):
    rows = spark.createDataFrame([("x.d", "o/a.o: src/a.cpp \\\n  inc/b\\ c.h \\\r\n d.h\n")], "path string, content string")
    assert [(r.target, r.dependency) for r in files.depfile_rules(rows).collect()] == [("o/a.o", "src/a.cpp"), ("o/a.o", "inc/b c.h"), ("o/a.o", "d.h")]


def test_snapshots(spark, tmp_path):
    store = snapshots.SnapshotStore(spark, f"file://{tmp_path}/snap")
    rows = spark.createDataFrame([("a", "1"), ("b", "2")], "path string, sha256 string")
    print_ = snapshots.fingerprint(rows)
    assert print_ == snapshots.fingerprint(rows.orderBy("sha256", ascending=False)) != snapshots.fingerprint(rows.limit(1))
    assert snapshots.freshness(store.manifest(), "r", "c1", print_, "k")[0] == "unknown"
    first = snapshots.Snapshot("r", "c1", "g1", "selected", print_, "k")
    manifest = store.publish(first, {"files": rows})
    assert store.read("files").count() == 2 and manifest.last_usable.tables == ("files",) and store.manifest() == manifest
    assert snapshots.freshness(manifest, "r", "c1", print_, "k") == ("fresh", "fresh", "sufficient", ())
    assert snapshots.freshness(manifest, "r", "c2", "other", "z")[1:] == ("stale", "sufficient", ("revision_mismatch", "source_drift", "configuration_mismatch"))
    assert snapshots.freshness(manifest, "r", None, print_, "k", "full")[1:3] == ("unknown", "insufficient")
    with pytest.raises(Exception, match="."):
        store.publish(snapshots.Snapshot("r", "c2", "g1", "selected", print_, "k"), {"files": rows})
    assert store.manifest().latest_attempt == "failed" and store.read("files").count() == 2
    assert snapshots.freshness(store.manifest(), "r", "c1", print_, "k")[:2] == ("failed", "fresh")
    with pytest.raises(FactError):
        store.read("else")


def test_stream_search(spark, tmp_path):
    at = f"{tmp_path}/in"
    spark.createDataFrame([("a", "x que que"), ("b", "none")], "path string, content string").write.parquet(at)
    stream = spark.readStream.schema("path string, content string").parquet(at)
    q = search.matches(stream, TextQuery("que")).writeStream.format("memory").queryName("hits").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select * from hits").count() == 2
    with pytest.raises(QueryError):
        search.matches(stream, TextQuery("que", limit=1))
