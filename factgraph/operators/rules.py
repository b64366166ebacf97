"""Role mapping by exact rules over classes of a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factgraph.operators.index import with_ranges


def role_mapping(nodes: DataFrame, symbols: DataFrame, symbol_ranges: DataFrame, rules: DataFrame) -> DataFrame:
    """Status of every symbol node: recognized, ambiguous or unknown, with reason and candidates ``role/component``.

    rules: rule_id, role, qualified_name, file_path, component (null for none). A class's definition is its authority, or
    else its declaration; a rule counts where its file is the authority's or, once that file is allowed, another range's.
    """
    known = with_ranges(symbols, symbol_ranges).select("identity", F.col("kind").alias("symbol_kind"), "qualified_name", "declaration", "definition", F.coalesce("definition", "declaration")["file_path"].alias("authority"), F.lit(True).alias("found"))
    own = nodes.where("namespace = 'symbol'").select(F.col("key").alias("identity"), F.col("kind").alias("node_kind")).join(known, "identity", "left")
    eligible = own.where("symbol_kind = 'class' and node_kind = 'class'")
    ruled = eligible.select("identity", "qualified_name", "authority", F.array_compact(F.array("declaration.file_path", "definition.file_path")).alias("files")).join(rules.select("role", "qualified_name", F.col("file_path").alias("rule_file"), F.coalesce("component", F.lit("")).alias("component")), "qualified_name")
    summed = ruled.groupBy("identity").agg(
        F.bool_or(F.col("authority") == F.col("rule_file")).alias("allowed"),
        F.array_sort(F.collect_set(F.when(F.expr("array_contains(files, rule_file)"), F.concat_ws("/", "role", "component")))).alias("candidates"),
    )
    rows = own.join(summed, "identity", "left")
    some = F.size("candidates")
    reason = (
        F.when(F.col("found").isNull(), "missing_symbol").when((F.col("symbol_kind") != "class") | (F.col("node_kind") != "class"), "unsupported_symbol_kind")
        .when(F.col("candidates").isNull(), "no_qualified_name_rule").when(~F.col("allowed"), "source_file_mismatch")
        .when(some == 1, "exact_catalog_match").otherwise("conflicting_role_or_component_rules")
    )
    status = F.when(reason == "exact_catalog_match", "recognized").when(reason == "conflicting_role_or_component_rules", "ambiguous").otherwise("unknown")
    return rows.select("identity", status.alias("status"), reason.alias("reason"), F.when(status != "unknown", F.array_join("candidates", ",")).otherwise("").alias("candidates"))


def component_members(mapping: DataFrame) -> DataFrame:
    """Components that hold at least one recognized symbol: component, members, first member."""
    own = mapping.where("status = 'recognized'").select("identity", F.substring_index("candidates", "/", -1).alias("component")).where("component <> ''")
    return own.groupBy("component").agg(F.count("*").alias("members"), F.min("identity").alias("first_member"))
