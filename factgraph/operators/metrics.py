"""Scores of retrieval results against expected ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CUTS = (1, 5, 10)


def matched(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """case_id, item, wanted, rank (null where it wasn't found)."""
    return expected.select("case_id", "item").distinct().join(observed.groupBy("case_id", "item").agg(F.min("rank").alias("rank")), ["case_id", "item"], "left")


def recall_at(expected: DataFrame, observed: DataFrame, cuts: tuple[int, ...] = CUTS) -> DataFrame:
    """Share of each case's expected items among its first k, and at all."""
    n = F.count("*").cast("double")
    return matched(expected, observed).groupBy("case_id").agg(*((F.count_if(F.col("rank") <= k) / n).alias(f"recall_at_{k}") for k in cuts), (F.count("rank") / n).alias("recall"))


def reciprocal_rank(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """One over the first matching rank of each case, 0 without a match."""
    return matched(expected, observed).groupBy("case_id").agg(F.coalesce(F.lit(1.0) / F.min("rank"), F.lit(0.0)).alias("mrr"))


def correctness(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """Per case: correct (equal sets), missing and unexpected items; a case without expected items is one that expects none."""
    both = expected.select("case_id", "item", F.lit(1).alias("want")).distinct().join(observed.select("case_id", "item", F.lit(1).alias("have")).distinct(), ["case_id", "item"], "full")
    return both.groupBy("case_id").agg(F.count_if(F.col("have").isNull()).alias("missing"), F.count_if(F.col("want").isNull()).alias("unexpected")).withColumn("correct", (F.col("missing") == 0) & (F.col("unexpected") == 0))


def relation_coverage(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """Per case: expected, present, missing and incorrect relations and the share present."""
    both = expected.select("case_id", "item", F.lit(1).alias("want")).distinct().join(observed.select("case_id", "item", F.lit(1).alias("have")).distinct(), ["case_id", "item"], "full")
    return both.groupBy("case_id").agg(F.count("want").alias("expected"), F.count_if(F.col("want").isNotNull() & F.col("have").isNotNull()).alias("present"), F.count_if(F.col("have").isNull()).alias("missing"), F.count_if(F.col("want").isNull()).alias("incorrect"))


def chain_correct(expected: DataFrame, observed: DataFrame, states: DataFrame) -> DataFrame:
    """1 for a case whose trace is complete and exhaustive with one path, no gaps, and the expected relations in order.

    expected, observed: case_id, ordinal, item; states: case_id, status, exhaustive, paths, gaps.
    """
    ordered = lambda rows, name: rows.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "item"))).alias(name))
    rows = states.join(ordered(expected, "want"), "case_id", "left").join(ordered(observed, "have"), "case_id", "left")
    good = (F.col("status") == "complete") & F.col("exhaustive") & (F.col("paths") == 1) & (F.col("gaps") == 0) & F.transform("want", lambda x: x["item"]).eqNullSafe(F.transform("have", lambda x: x["item"]))
    return rows.select("case_id", F.when(good, 1).otherwise(0).cast("long").alias("chain_correct"))


def suite_summary(cases: DataFrame, metrics: list[str]) -> DataFrame:
    """Unweighted means over the cases that have the metric, and how many have it."""
    return cases.agg(F.count("*").alias("cases"), *(F.avg(m).alias(f"mean_{m}") for m in metrics), *(F.count(m).alias(f"n_{m}") for m in metrics))


#: Classes of failures of a case, in the order they are told: what kept it from running, then what its results lack or have too much.
ERRORS = ("query_rejected", "backend_unavailable", "backend_failure", "index_failure", "unexpected_error")
DIMENSIONS = ("file", "symbol", "test", "relation")


def failure_classes(cases: DataFrame, expected: DataFrame, observed: DataFrame) -> DataFrame:
    """case_id and its failures, comma-joined in a fixed order (15 classes).

    cases: case_id, error (of ERRORS, null if it ran), evaluated (dimensions that have an annotation, maybe an empty one);
    expected, observed: case_id, dimension (of DIMENSIONS), item, and for symbols identity and name. A case that didn't run
    has its error alone. Only relations are wrong by every item too many; of other dimensions only where none is expected.
    A symbol of which only the identity or only the name is right is a mismatch.
    """
    own = lambda rows, flag: rows.select("case_id", "dimension", "item", F.lit(1).alias(flag)).distinct()
    both = own(expected, "want").join(own(observed, "have"), ["case_id", "dimension", "item"], "full")
    each = both.groupBy("case_id", "dimension").agg(F.count("want").alias("wanted"), F.count("have").alias("had"), F.count_if(F.col("have").isNull()).alias("missing"), F.count_if(F.col("want").isNull()).alias("extra"))
    of = lambda d, c: F.coalesce(F.max(F.when(F.col("dimension") == d, F.col(c))), F.lit(0)).alias(f"{d}_{c}")
    counts = each.groupBy("case_id").agg(*(of(d, c) for d in DIMENSIONS for c in ("wanted", "had", "missing", "extra")))
    want, have = (rows.where("dimension = 'symbol'").select("case_id", F.col("identity").alias(f"{n}_identity"), F.col("name").alias(f"{n}_name")).distinct() for rows, n in ((expected, "want"), (observed, "have")))
    # one of the two is the same, the other isn't; a case's pairs are never formed
    same = lambda c, other: want.join(have, (want["case_id"] == have["case_id"]) & (F.col(f"want_{c}") == F.col(f"have_{c}"))).where(f"want_{other} <> have_{other}").select(want["case_id"])
    half = same("identity", "name").union(same("name", "identity")).distinct().withColumn("half", F.lit(True))
    rows = cases.join(counts, "case_id", "left").join(half, "case_id", "left").na.fill(0)
    c = F.col
    had, wanted = (sum((c(f"{d}_{n}") for d in DIMENSIONS[1:]), c(f"file_{n}")) for n in ("had", "wanted"))
    judged = lambda d: F.array_contains("evaluated", d)
    tests = [("empty_result", (had == 0) & (wanted > 0))]
    for d in ("file", "symbol", "test"):
        tests.append((f"target_{d}_miss", judged(d) & (c(f"{d}_missing") > 0)))
        if d == "symbol":
            tests.append(("symbol_identity_mismatch", judged(d) & F.coalesce(c("half"), F.lit(False))))
        tests.append((f"unexpected_{d}", judged(d) & (c(f"{d}_wanted") == 0) & (c(f"{d}_had") > 0)))
    tests += [("direct_relation_miss", judged("relation") & (c("relation_missing") > 0)), ("unexpected_direct_relation", judged("relation") & (c("relation_extra") > 0))]
    found = F.array_compact(F.array(*(F.when(t, F.lit(n)) for n, t in tests)))
    return rows.select("case_id", F.when(c("error").isNotNull(), c("error")).otherwise(F.array_join(found, ",")).alias("failures"))


def coverage_counts(rows: DataFrame, by: list[str], size: str) -> DataFrame:
    """How many rows, and how much of ``size``, each group has in each status: not_covered (null), complete (1) or partial."""
    status = F.when(F.col("covered").isNull(), "not_covered").when(F.col("covered") == 1, "complete").otherwise("partial")
    return rows.groupBy(*by, status.alias("status")).agg(F.count("*").alias("n"), F.sum(size).alias(size))


def relation_summary(cases: DataFrame, states: DataFrame) -> DataFrame:
    """One row: cases, pooled relation coverage (1 without targets), mean chain score and counts of traces, missing and incorrect relations.

    cases: case_id, expected, present, missing, incorrect; states: case_id, chain_correct (null for a case that is no trace).
    """
    rows = cases.join(states, "case_id", "full")
    n = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return rows.agg(F.count("*").alias("cases"), F.count("chain_correct").alias("traces"), F.coalesce(F.avg("chain_correct"), F.lit(0.0)).alias("chain_accuracy"), F.coalesce(F.try_divide(n("present").cast("double"), n("expected").cast("double")), F.lit(1.0)).alias("relation_coverage"), n("missing").alias("missing"), n("incorrect").alias("incorrect"))


def label_counts(cases: DataFrame, columns: list[str]) -> DataFrame:
    """what, label and n: how often each label stands in array columns (statuses, gaps, failures) over all cases."""
    parts = [cases.select(F.lit(c).alias("what"), F.explode(c).alias("label")) for c in columns]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.groupBy("what", "label").agg(F.count("*").alias("n"))
