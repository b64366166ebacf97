"""Strict JSON forms of small inputs and results: nothing unknown, nothing missing, nothing twice."""

from __future__ import annotations

import json
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, DoubleType, LongType, StringType, StructField, StructType


class CodecError(ValueError):
    """A document that doesn't have the form it should."""


def once(pairs: list[tuple[str, Any]]) -> dict[str, Any]:
    """An object whose keys stand there once."""
    out = dict(pairs)
    if len(out) != len(pairs):
        raise CodecError("a key stands there twice")
    return out


def loads(text: str, schema: StructType) -> dict[str, Any]:
    """A document of the schema, checked field by field; booleans aren't numbers, unknown keys are refused."""
    try:
        value = json.loads(text, object_pairs_hook=once)
    except json.JSONDecodeError as e:
        raise CodecError(str(e)) from e
    check(value, schema, "$")
    return value


SCALARS: dict[type[DataType], tuple[type, ...]] = {StringType: (str,), LongType: (int,), BooleanType: (bool,), DoubleType: (int, float)}


def check(value: Any, kind: DataType, at: str, nullable: bool = False) -> None:
    if value is None:
        if not nullable:
            raise CodecError(f"{at} is null")
    elif isinstance(kind, StructType):
        if not isinstance(value, dict):
            raise CodecError(f"{at} isn't an object")
        odd = sorted(set(value) ^ set(kind.fieldNames()))
        if odd:
            raise CodecError(f"{at}: unknown or missing {', '.join(odd)}")
        for f in kind.fields:
            check(value[f.name], f.dataType, f"{at}.{f.name}", f.nullable)
    elif isinstance(kind, ArrayType):
        if not isinstance(value, list):
            raise CodecError(f"{at} isn't a list")
        for i, x in enumerate(value):
            check(x, kind.elementType, f"{at}[{i}]", kind.containsNull)
    elif type(value) not in SCALARS[type(kind)]:
        raise CodecError(f"{at} isn't a {kind.simpleString()}")


def dumps(value: Any, schema: StructType) -> str:
    """Canonical text: sorted keys, no spaces; what doesn't fit the schema is refused."""
    check(value, schema, "$")
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=True)


TEXT, NUMBER, TEXTS = StringType(), LongType(), ArrayType(StringType(), False)


def record(**fields: DataType) -> StructType:
    """A struct; a field whose name ends in an underscore may be null (the underscore isn't part of it)."""
    return StructType([StructField(n.removesuffix("_"), kind, n.endswith("_")) for n, kind in fields.items()])


CASE = record(
    id=TEXT, kind=TEXT, text_=TEXT, match_=TEXT, path_scope_=TEXT, limit_=NUMBER, files_=TEXTS, symbols_=ArrayType(record(identity=TEXT, qualified_name=TEXT), False), tests_=TEXTS,
    relations_=ArrayType(record(caller=TEXT, callee=TEXT), False),
)
SUITE = record(schema_version=NUMBER, suite_id=TEXT, repository=TEXT, revision=TEXT, cases=ArrayType(CASE, False))
PREPARATION = record(semantic_files=TEXTS, test_files=TEXTS, include_directories=TEXTS)
DOMAIN_ROW = record(identity=TEXT, status=TEXT, role_=TEXT, component_=TEXT)
DOMAIN = record(schema_version=NUMBER, rows=ArrayType(DOMAIN_ROW, False))


def load_suite(spark: SparkSession, text: str, revision: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(cases, expected items) of a suite; another revision than the one given fails before any query.

    expected: case_id, dimension, item. A dimension that is null isn't evaluated and gives no row in ``cases.evaluated``.
    """
    suite = loads(text, SUITE)
    if suite["schema_version"] != 1:
        raise CodecError("unknown schema version")
    if revision is not None and suite["revision"] != revision:
        raise CodecError(f"the suite is of revision {suite['revision']}")
    if len({c["id"] for c in suite["cases"]}) != len(suite["cases"]):
        raise CodecError("a case id stands there twice")
    rows = spark.createDataFrame([tuple(c[n] for n in CASE.fieldNames()) for c in suite["cases"]], CASE)
    dims = ("files", "symbols", "tests", "relations")
    cases = rows.select(F.col("id").alias("case_id"), "kind", "text", "match", "path_scope", "limit", F.array_compact(F.array(*(F.when(F.col(d).isNotNull(), F.lit(d)) for d in dims))).alias("evaluated"))
    item = {"files": F.col("x"), "tests": F.col("x"), "symbols": F.concat_ws("|", "x.identity", "x.qualified_name"), "relations": F.concat_ws(">", "x.caller", "x.callee")}
    parts = [rows.select(F.col("id").alias("case_id"), F.lit(d).alias("dimension"), F.explode(d).alias("x")).select("case_id", "dimension", item[d].alias("item")) for d in dims]
    return cases, parts[0].union(parts[1]).union(parts[2]).union(parts[3])


def prepared_files(text: str, files: DataFrame) -> DataFrame:
    """path and role of exactly the files that a preparation names; one that the tree lacks fails."""
    from factgraph.operators.index import refuse

    plan = loads(text, PREPARATION)
    spark = files.sparkSession
    wanted = spark.createDataFrame([(p, r) for r, own in (("semantic", plan["semantic_files"]), ("test", plan["test_files"])) for p in own], "path string, role string").distinct()
    refuse(wanted.join(files.select("path"), "path", "left_anti"), "path", "a prepared file is missing")
    return wanted


def domain_map(text: str, spark: SparkSession) -> DataFrame:
    """identity, status, role, component rows of a domain map; an identity stands there once."""
    value = loads(text, DOMAIN)
    if value["schema_version"] != 1:
        raise CodecError("unknown schema version")
    names = [r["identity"] for r in value["rows"]]
    if len(set(names)) != len(names):
        raise CodecError("an identity stands there twice")
    if any(r["status"] not in ("recognized", "ambiguous", "unknown") for r in value["rows"]):
        raise CodecError("unknown status")
    return spark.createDataFrame([tuple(r[f] for f in DOMAIN_ROW.fieldNames()) for r in value["rows"]], DOMAIN_ROW)


def write_report(value: dict[str, Any], path: str) -> None:
    """A report of a suite as JSON, written beside its place and then put there in one step."""
    target = Path(path)
    draft = target.with_name(target.name + ".draft")
    draft.write_text(json.dumps(value, sort_keys=True, indent=2) + "\n", encoding="utf-8")
    draft.replace(target)
