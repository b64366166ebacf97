"""Planned, bounded retrieval over many channels, with explicit states for what wasn't found or looked at."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Channels whose facts aren't recorded: always unsupported, never called.
UNSUPPORTED_CHANNELS = ("inherit", "override", "mock")
SEED_CHANNELS = ("symbol", "declaration", "definition", "reference", "callers", "callees", "tests_for_symbol")
HINT_KINDS = ("component", "symbol", "property", "action", "test_intent")
NAMED_HINTS = ("component", "symbol", "property")


@dataclass(frozen=True)
class Bounds:
    """Budgets of one request; all are positive, None is no bound."""

    queries: int | None = 64
    calls_per_channel: int | None = 64
    names: int | None = 20
    results_per_query: int | None = 100
    records_per_query: int | None = 500
    candidates_per_channel: int | None = 200
    candidates: int | None = 500
    query_chars: int | None = 4096

    def __post_init__(self) -> None:
        for f in fields(self):
            value = getattr(self, f.name)
            if value is not None and (isinstance(value, bool) or not isinstance(value, int) or value < 1):
                raise ValueError(f"{f.name} must be a positive integer")


def stable_id(*columns: Column | str) -> Column:
    """SHA-256 over the canonical JSON of the columns."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def hints(tasks: DataFrame) -> DataFrame:
    """Labels ``[kind:value]`` of each task, in order: task_id, ordinal, kind, value (trimmed; an empty one is invalid)."""
    pattern = r"\[(" + "|".join(HINT_KINDS) + r"):([^\[\]\r\n]*)\]"
    found = F.zip_with(F.regexp_extract_all("text", F.lit(pattern), F.lit(1)), F.regexp_extract_all("text", F.lit(pattern), F.lit(2)), lambda k, v: F.struct(k.alias("kind"), F.regexp_replace(v, r"^\s+|\s+$", "").alias("value")))
    return tasks.select("task_id", F.posexplode(found).alias("at", "hint")).select("task_id", (F.col("at") + 1).cast("long").alias("ordinal"), F.col("hint.kind").alias("kind"), F.col("hint.value").alias("value"), (F.col("hint.value") != "").alias("valid"))


def plan_queries(tasks: DataFrame, found: DataFrame, seed_channels: tuple[str, ...] = SEED_CHANNELS) -> DataFrame:
    """Queries of each task: every line and hint as text, named hints for each seed channel, components for the domain.

    Rows task_id, query_id, channel, selector, qualified, origins (sorted). Equal queries are one, with all their origins.
    """
    text = tasks.select("task_id", F.posexplode(F.split("text", r"\r\n|\r|\n")).alias("at", "selector")).where(F.trim("selector") != "").select("task_id", F.lit("text").alias("channel"), "selector", F.lit(False).alias("qualified"), F.concat(F.lit("line:"), F.lpad(F.col("at") + 1, 6, "0")).alias("origin"))
    origin = F.concat(F.lit("hint:"), F.lpad("ordinal", 6, "0"))
    good = found.where("valid")
    by_text = good.select("task_id", F.lit("text").alias("channel"), F.col("value").alias("selector"), F.lit(False).alias("qualified"), origin.alias("origin"))
    seeds = good.where(F.col("kind").isin(*NAMED_HINTS)).select("task_id", F.explode(F.array(*map(F.lit, seed_channels))).alias("channel"), F.col("value").alias("selector"), F.col("value").contains("::").alias("qualified"), origin.alias("origin"))
    domain = good.where("kind = 'component'").select("task_id", F.lit("domain_component").alias("channel"), F.col("value").alias("selector"), F.lit(False).alias("qualified"), origin.alias("origin"))
    rows = text.union(by_text).union(seeds).union(domain)
    return rows.groupBy("task_id", "channel", "selector", "qualified").agg(F.array_sort(F.collect_set("origin")).alias("origins")).select("task_id", stable_id("channel", "selector", "qualified").alias("query_id"), "channel", "selector", "qualified", "origins")


def guarded(queries: DataFrame, bounds: Bounds) -> DataFrame:
    """Adds ``refusal``: unsupported channel or several lines, truncated if too long, else null."""
    long = F.lit(False) if bounds.query_chars is None else F.length("selector") > bounds.query_chars
    return queries.withColumn("refusal", F.when(F.col("channel").isin(*UNSUPPORTED_CHANNELS), "unsupported").when(long, "truncated").when(F.col("selector").rlike(r"[\r\n]"), "unsupported"))


def first_n(rows: DataFrame, group: list[str], order: list[str], n: int | None) -> DataFrame:
    """The first n rows of each group (all for None), with ``total`` and ``truncated`` of the group."""
    w = Window.partitionBy(*group)
    if n is None:
        return rows.withColumn("total", F.count("*").over(w)).withColumn("truncated", F.lit(False))
    return rows.withColumn("position", F.row_number().over(w.orderBy(*order))).withColumn("total", F.count("*").over(w)).where(F.col("position") <= n).withColumn("truncated", F.col("total") > n)


def within_fingerprint(facts: DataFrame, bound: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Facts all of whose paths are bound, and queries that lost a fact by that (unresolved)."""
    loose = facts.select("query_id", "fact_key", F.explode("paths").alias("path")).join(bound.select("path").distinct(), "path", "left_anti").select("query_id", "fact_key").distinct()
    return facts.join(loose, ["query_id", "fact_key"], "left_anti"), loose.select("query_id").distinct()


def merged(observations: DataFrame) -> DataFrame:
    """One candidate for each (fact_type, fact_key): all queries and channels that saw it, flags or-ed."""
    return observations.groupBy("fact_type", "fact_key").agg(F.array_sort(F.collect_set("query_id")).alias("queries"), F.array_sort(F.collect_set("channel")).alias("channels"), F.bool_or("ambiguous").alias("ambiguous"), F.bool_or("unresolved").alias("unresolved")).withColumn("candidate_id", stable_id("fact_type", "fact_key"))


def symbol_channel(queries: DataFrame, symbols: DataFrame, bounds: Bounds) -> DataFrame:
    """Symbols that each query names, all candidates up to the bound: query_id, identity, ambiguous, truncated."""
    own = queries.where("channel = 'symbol'").select("query_id", "selector", "qualified").distinct()
    pairs = own.where("qualified").join(symbols, F.col("selector") == F.col("qualified_name")).select("query_id", "identity").union(own.where("not qualified").join(symbols, F.col("selector") == F.col("display_name")).select("query_id", "identity"))
    return first_n(pairs, ["query_id"], ["identity"], bounds.names).select("query_id", "identity", (F.col("total") > 1).alias("ambiguous"), "truncated")


def result_status(reports: DataFrame, truncated: bool = False, diagnostics: bool = False) -> str:
    """failure > truncated result > truncated > unresolved > unsupported > diagnostics (unresolved) > ok or empty."""
    found = {r[0] for r in reports.select("status").distinct().collect()}
    if "failure" in found:
        return "failure"
    if truncated or "truncated" in found:
        return "truncated"
    if "unresolved" in found:
        return "unresolved"
    if "unsupported" in found:
        return "unsupported"
    if diagnostics:
        return "unresolved"
    return "ok" if "ok" in found else "empty"


def expansion_seeds(candidates: DataFrame) -> DataFrame:
    """Graph seeds out of candidates that are identities; text hits, relation ends and components give none."""
    own = candidates.where(F.col("fact_type").isin("symbol", "test", "graph_node"))
    return own.groupBy(F.lit("symbol").alias("namespace"), F.col("fact_key").alias("key")).agg(F.array_sort(F.collect_set("candidate_id")).alias("candidates"))
