"""Runs a suite of retrieval cases and scores it."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factgraph.operators import index, metrics, textsearch
from factgraph.operators.ranks import ranked
from factgraph.sources.workspace import written

#: What each kind of query finds.
DIMENSION = {"search_symbol": "symbol", "callers": "relation", "callees": "relation", "tests": "test"}
KINDS = ("text_search", "search_symbol", "declaration", "definition", "references", "callers", "callees", "tests")


def execute(kind: str, text: str, tables: dict[str, DataFrame], qualified: bool = False, limit: int | None = None) -> DataFrame:
    """Items that one query finds, in order: item, rank."""
    if kind not in KINDS:
        raise ValueError(f"unknown retrieval kind {kind}")
    if kind == "text_search":
        found = textsearch.search(tables["files"], textsearch.TextQuery(text, limit=limit)).select(F.concat_ws(":", "path", F.lpad("start_line", 9, "0"), F.lpad("start_column", 9, "0")).alias("item"))
    elif kind == "search_symbol":
        found = (index.by_qualified_name if qualified else index.by_name)(tables["symbols"], text).select(F.col("identity").alias("item"))
    elif kind in ("declaration", "definition"):
        found = tables["symbol_ranges"].where((F.col("symbol_identity") == text) & (F.col("role") == kind)).select(F.concat_ws(":", "file_path", "start_line").alias("item"))
    elif kind == "references":
        found = index.references_of(tables["symbol_references"], text).select(F.concat_ws(":", "file_path", F.lpad("start_line", 9, "0")).alias("item"))
    elif kind in ("callers", "callees"):
        one, other = ("callee", "caller") if kind == "callers" else ("caller", "callee")
        found = index.calls(tables["symbol_relations"], tables["symbols"], tables["symbol_ranges"], kind[:-1]).where(F.col(one) == text).select(F.col(other).alias("item"))
    else:
        found = index.contained_references(tables["references"], tables["test_case_bodies"]).where(F.col("symbol_identity") == text).select(F.col("case_identity").alias("item")).distinct()
    found = found.distinct() if limit is None else found.distinct().orderBy("item").limit(limit)
    return ranked(found.select("item"), ["item"]).withColumn("rank", F.col("rank") + 1)


def run(spark: SparkSession, suite: list[dict], tables: dict[str, DataFrame], clock: Callable[[], float] = time.perf_counter) -> DataFrame:
    """One row for each case (case_id, kind, text, expected items): metrics, failure classes, seconds.

    A query that fails is an error of its case, not of the suite.
    """
    rows, found = [], None
    for case in suite:
        began = clock()
        try:
            got = written(execute(case["kind"], case["text"], tables, case.get("qualified", False), case.get("limit")).select(F.lit(case["case_id"]).alias("case_id"), "item", "rank"))
            found, error = got if found is None else found.union(got), None
        except ValueError:
            error = "query_rejected"
        except (KeyError, AnalysisException):
            error = "index_failure"
        except OSError:
            error = "backend_unavailable"
        except PySparkException:
            error = "backend_failure"
        except Exception:  # noqa: BLE001  whatever else a backend raises counts against its case
            error = "unexpected_error"
        rows.append((case["case_id"], case["kind"], DIMENSION.get(case["kind"], "file"), error, clock() - began))
    observed = found if found is not None else spark.createDataFrame([], "case_id string, item string, rank long")
    expected = spark.createDataFrame([(c["case_id"], x) for c in suite for x in c["expected"]], "case_id string, item string")
    cases = spark.createDataFrame(rows, "case_id string, kind string, dimension string, failed string, seconds double").withColumn("error", F.col("failed").isNotNull())
    n = observed.groupBy("case_id").agg(F.count("*").alias("n_observed"))
    wanted = expected.groupBy("case_id").agg(F.count("*").alias("n_expected"))
    first = metrics.matched(expected, observed).groupBy("case_id").agg(F.min("rank").alias("first_rank"))
    full = cases.join(metrics.recall_at(expected, observed), "case_id", "left").join(metrics.reciprocal_rank(expected, observed), "case_id", "left").join(metrics.correctness(expected, observed), "case_id", "left")
    for t in (n, wanted, first):
        full = full.join(t, "case_id", "left")
    full = full.fillna(0, ["n_observed", "n_expected", "missing", "unexpected"])
    typed = lambda items: items.join(cases.select("case_id", "dimension"), "case_id").select("case_id", "dimension", "item", F.col("item").alias("identity"), F.col("item").alias("name"))
    failures = metrics.failure_classes(cases.select("case_id", F.col("failed").alias("error"), F.array("dimension").alias("evaluated")), typed(expected), typed(observed))
    return full.drop("dimension", "failed").join(failures, "case_id")
