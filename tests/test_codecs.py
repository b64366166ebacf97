"""Strict JSON forms, and fact sources of landed tables."""

import json

import pytest

from factgraph.sources import codecs, facts
from factgraph.sources.dependencies import normalized_changes
from factgraph.operators.index import FactError

CASE = {"id": "c1", "kind": "search_text", "text": "x", "match": None, "path_scope": None, "limit": 5, "files": ["a"], "symbols": [{"identity": "i", "qualified_name": "n::i"}], "tests": None, "relations": []}
SUITE = {"schema_version": 1, "suite_id": "s", "repository": "r", "revision": "v1", "cases": [CASE]}


def test_suite(spark):
    cases, expected = codecs.load_suite(spark, json.dumps(SUITE), "v1")
    assert cases.first().evaluated == ["files", "symbols", "relations"]
    assert {tuple(r) for r in expected.collect()} == {("c1", "files", "a"), ("c1", "symbols", "i|n::i")}


@pytest.mark.parametrize("change", [{"extra": 1}, {"schema_version": 2}, {"schema_version": True}, {"cases": [CASE, CASE]}, {"cases": [CASE | {"limit": "5"}]}, {"suite_id": None}])
def test_refused_suites(spark, change):
    with pytest.raises(codecs.CodecError):
        codecs.load_suite(spark, json.dumps(SUITE | change))
    with pytest.raises(codecs.CodecError):
        codecs.load_suite(spark, json.dumps(SUITE), "v2")
    with pytest.raises(codecs.CodecError):
        codecs.loads('{"a": 1, "a": 2}', codecs.SUITE)


def test_domain_map_and_report(spark, tmp_path):
    rows = [{"identity": "a", "status": "recognized", "role": "model", "component": None}]
    assert codecs.domain_map(json.dumps({"schema_version": 1, "rows": rows}), spark).count() == 1
    with pytest.raises(codecs.CodecError):
        codecs.domain_map(json.dumps({"schema_version": 1, "rows": rows * 2}), spark)
    codecs.write_report({"b": 1, "a": 2}, str(tmp_path / "r.json"))
    assert json.loads((tmp_path / "r.json").read_text()) == {"a": 2, "b": 1} and len(list(tmp_path.iterdir())) == 1


def test_landed_facts(spark, tmp_path):
    spark.createDataFrame([("p", "declaration", "f.h", 1, 1, 2, 1)], facts.TABLES["symbol_ranges"]).write.parquet(str(tmp_path / "symbol_ranges"))
    spark.createDataFrame([("p", "class", "P", "n::P", None, None)], facts.TABLES["symbols"]).write.parquet(str(tmp_path / "symbols"))
    source = facts.ParquetFacts(spark, str(tmp_path), ("symbols", "symbol_ranges"))
    assert [r.identity for r in source.symbols_in_file("f.h").collect()] == ["p"] and source.related("p", "caller").count() == 0 and source.place("p", "definition").count() == 0


def test_changes_that_conflict(spark):
    shape = "old_path string, new_path string, kind string"
    assert normalized_changes(spark.createDataFrame([("a", "a", "modify"), ("a", "a", "modify"), (None, "b", "add")], shape)).count() == 2
    with pytest.raises(FactError):
        normalized_changes(spark.createDataFrame([("a", "b", "rename"), ("a", "a", "modify")], shape))
