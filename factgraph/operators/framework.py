"""Relations between methods and classes that source templates and exact references prove together.

A template is a regular expression for the text at a method's definition, with what stands in front of the target in its
first group and the target in its second; the target's place follows from the definition's place and the first group, and
the references with exactly that range say what the target is. A relation that can't be proved is a row with the reason.

Tables: symbols (identity, kind, qualified_name, parent_identity), symbol_ranges (symbol_identity, role and range), references
(symbol_identity and range), calls (caller, callee), files (path, content), mapping (identity, status, role, component; status is
recognized, ambiguous or unknown, and role and component count for recognized ones).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factgraph.operators.snippets import line_offsets
from factgraph.operators.traces import WINDOW_CHARS
from factgraph.sources.workspace import written

#: What may stand between a method's name and its body; a fixed value.
PARAMETERS = "\\([^(){};\"'#]*\\)(?:\\s+override)?\\s*\\{\\s*"


def windows(places: DataFrame, files: DataFrame, line_start: bool = False) -> DataFrame:
    """Adds ``window``: the text from each place (file_path, start_line, start_column) on; null if the file has no such place."""
    source = files.select(F.col("path").alias("file_path"), "content")
    lines = line_offsets(files.join(places.select(F.col("file_path").alias("path")).distinct(), "path", "left_semi")).select(F.col("path").alias("file_path"), F.col("line").alias("start_line"), "offset")
    at = F.col("offset") + (1 if line_start else F.col("start_column"))
    held = places.join(lines, ["file_path", "start_line"], "left").join(source, "file_path", "left")
    return held.withColumn("window", F.substring(F.col("content"), at.cast("int"), F.lit(WINDOW_CHARS))).drop("offset", "content")


def names(symbols: DataFrame) -> DataFrame:
    """Symbols with ``name``, the last part of their qualified name."""
    return symbols.withColumn("name", F.substring_index("qualified_name", "::", -1))


def matched(rows: DataFrame, pattern: Column) -> DataFrame:
    """Adds ``before`` and ``target``, the groups of each row's pattern in its window, null where it doesn't match."""
    found = rows.withColumn("_pattern", pattern).withColumn("_hit", F.coalesce(F.expr("window rlike _pattern"), F.lit(False)))
    group = lambda n: F.when(F.col("_hit"), F.expr(f"regexp_extract(window, _pattern, {n})"))
    return found.withColumn("before", group(1)).withColumn("target", group(2)).drop("_pattern", "_hit")


def target_range(rows: DataFrame) -> DataFrame:
    """Replaces before and target by the target's range: at_line, at_column, at_end, from the place the window begins at."""
    down = F.length("before") - F.length(F.replace("before", F.lit("\n"), F.lit("")))
    column = F.when(down == 0, F.col("start_column") + F.length("before")).otherwise(F.length(F.substring_index("before", "\n", -1)) + 1)
    return rows.withColumn("at_line", F.col("start_line") + down).withColumn("at_column", column.cast("long")).withColumn("at_end", (column + F.length("target")).cast("long"))


def referred(rows: DataFrame, references: DataFrame, key: str) -> DataFrame:
    """key, refs (distinct symbols that the target's range refers to) and ref (the smallest of them) of rows with a target."""
    placed = target_range(rows.where("target is not null"))
    own = references.select("symbol_identity", "file_path", F.col("start_line").alias("at_line"), F.col("start_column").alias("at_column"), F.col("end_column").alias("at_end"), F.col("end_line").alias("_end_line"))
    met = placed.join(own, ["file_path", "at_line", "at_column", "at_end"]).where("_end_line = at_line")
    return met.groupBy(key).agg(F.count_distinct("symbol_identity").alias("refs"), F.min("symbol_identity").alias("ref"), F.array_sort(F.collect_set("symbol_identity")).alias("candidates"))


def proved_macros(macros: DataFrame, files: DataFrame) -> DataFrame:
    """template of the macros (template, file_path, name, expansion) whose only definition in its file is the given one, white space and line joints apart."""
    source = macros.join(files.select(F.col("path").alias("file_path"), "content"), "file_path", "left")
    pattern = F.concat(F.lit("(?m)^#define "), "name", F.lit("\\([^\\n]*\\)(?:[^\\n]*\\\\\\n)*[^\\n]*"))
    found = source.withColumn("_p", pattern).withColumn("found", F.expr("regexp_extract_all(content, _p, 0)"))
    squeezed = F.regexp_replace(F.replace(F.col("found")[0], F.lit("\\\n"), F.lit("")), "\\s+", "")
    good = found.withColumn("good", F.coalesce((F.size("found") == 1) & (squeezed == F.col("expansion")), F.lit(False)))
    return good.groupBy("template").agg(F.bool_and("good").alias("good")).where("good").select("template")


def proved_factories(symbols: DataFrame, symbol_ranges: DataFrame, files: DataFrame, factories: DataFrame) -> DataFrame:
    """identity of the symbols that factories (qualified_name, file_path, pattern) name and whose source is the given one."""
    own = symbols.join(factories.select("qualified_name", F.col("file_path").alias("_file"), "pattern"), "qualified_name").select("identity", "_file", "pattern")
    ranges = symbol_ranges.select(F.col("symbol_identity").alias("identity"), "role", "file_path", "start_line", "start_column")
    first = own.join(ranges, "identity").groupBy("identity", "_file", "pattern").agg(F.max_by(F.struct("file_path", "start_line", "start_column"), F.col("role") == "definition").alias("p"))
    placed = first.where("p.file_path = _file").select("identity", "pattern", "p.file_path", "p.start_line", "p.start_column")
    return windows(placed, files).where("window rlike pattern").select("identity").distinct()


def framework_relations(symbols: DataFrame, symbol_ranges: DataFrame, references: DataFrame, calls: DataFrame, files: DataFrame, mapping: DataFrame, tests: DataFrame, operations: DataFrame, bodies: DataFrame, factories: DataFrame, macros: DataFrame) -> DataFrame:
    """source, target, relation, rule and diagnostic (null for a proved relation) of methods, their classes and tests.

    operations: role, name, relation, pattern (of a declaration, from its line's begin, the method's name in group 2): bind a
    class of a role to its own method. bodies: template, role, relation, pattern (of a body), target_roles, backing (factory,
    macro or null): bind a method to the class that its body names. factories and macros: see proved_factories and
    proved_macros. tests: case_identity, symbol_identity of direct references of test cases.

    Diagnostics: missing_semantic_parent, missing_role, unknown, ambiguous, unsupported_declaration_template,
    missing_definition, unsupported_body_template, missing_reference, ambiguous_reference,
    unknown_ambiguous_or_cross_component_target, missing_or_ambiguous_semantic_factory_call, unsupported_macro_definition,
    unsupported_mock_facts.
    """
    c = F.col
    none = F.lit(None).cast("string")
    methods = names(symbols).where("kind = 'method'").select("identity", "name", c("parent_identity").alias("owner"))
    roles = mapping.select("identity", "status", F.when(c("status") == "recognized", c("role")).alias("role"), F.when(c("status") == "recognized", c("component")).alias("component"))
    row = lambda df, source, target, relation, rule, diagnostic: df.select(source.alias("source"), target.alias("target"), relation.alias("relation"), F.lit(rule).alias("rule"), diagnostic.alias("diagnostic"))
    orphans = row(methods.where("owner is null"), c("identity"), none, none, "owner", F.lit("missing_semantic_parent"))
    owned = methods.where("owner is not null").join(roles.withColumnRenamed("identity", "owner"), "owner", "left")
    why = F.coalesce(c("status"), F.lit("missing_role"))
    loose = row(owned.where("role is null").select("owner", "status").distinct(), c("owner"), none, none, "role", why)
    owned = owned.where("role is not null")
    # a class of a role and its declared operation
    declared = symbol_ranges.where("role = 'declaration'").select(c("symbol_identity").alias("identity"), "file_path", "start_line", "start_column")
    wanted = owned.join(operations.select("role", "name", "relation", "pattern"), ["role", "name"])
    seen = matched(windows(wanted.join(declared, "identity", "left"), files, line_start=True), c("pattern"))
    # the declaration that the facts name is the one that matched, no overload on a nearby line
    fits = c("target").isNotNull() & ~F.contains("before", F.lit("\n")) & (F.length("before") + 1 == c("start_column"))
    operated = row(seen, c("owner"), c("identity"), c("relation"), "operation", F.when(F.coalesce(fits, F.lit(False)), none).otherwise("unsupported_declaration_template"))
    # a method and the class that its body names
    rest = owned.join(operations.select("role", "name").distinct(), ["role", "name"], "left_anti").join(bodies.select("role").distinct(), "role", "left_semi")
    defined = symbol_ranges.where("role = 'definition'").select(c("symbol_identity").alias("identity"), "file_path", "start_line", "start_column")
    placed = written(windows(rest.join(defined, "identity", "left"), files))
    bare = placed.where("file_path is null")
    tried = matched(placed.where("file_path is not null").join(bodies.withColumnRenamed("pattern", "body"), "role"), F.concat(F.lit("^(\\Q"), "name", F.lit("\\E" + PARAMETERS), "body", F.lit("\\s*\\}")))
    best = written(tried.where("target is not null").groupBy("identity").agg(F.min("template").alias("template")))
    hits = written(tried.join(best, ["identity", "template"]).drop("window"))
    misses = row(placed.where("file_path is not null").join(best, "identity", "left_anti"), c("identity"), none, none, "body", F.lit("unsupported_body_template"))
    refs = referred(hits.select("identity", "file_path", "start_line", "start_column", "before", "target"), references, "identity")
    goal = roles.select(c("identity").alias("ref"), c("status").alias("goal_status"), c("role").alias("goal_role"), c("component").alias("goal_component"))
    bound = hits.select("identity", "component", "relation", "template", "target_roles", "backing").join(refs, "identity", "left").join(goal, "ref", "left")
    made = calls.join(proved_factories(symbols, symbol_ranges, files, factories).select(c("identity").alias("callee")), "callee", "left_semi").groupBy(c("caller").alias("identity")).agg(F.count_distinct("callee").alias("made"))
    kept = proved_macros(macros, files).withColumn("kept", F.lit(True))
    bound = written(bound.join(made, "identity", "left").join(kept, "template", "left"))
    unfit = ~F.coalesce(F.array_contains("target_roles", c("goal_role")) & (c("goal_component") == c("component")), F.lit(False))
    reason = (
        F.when(c("refs").isNull(), "missing_reference").when(c("refs") > 1, "ambiguous_reference").when(unfit, "unknown_ambiguous_or_cross_component_target")
        .when((c("backing") == "factory") & (F.coalesce("made", F.lit(0)) != 1), "missing_or_ambiguous_semantic_factory_call").when((c("backing") == "macro") & c("kept").isNull(), "unsupported_macro_definition")
    )
    associated = row(bound, c("identity"), F.when(c("refs") == 1, c("ref")), c("relation"), "body", reason)
    strange = row(bound.where("refs = 1 and goal_role is null").select("ref", "goal_status").distinct(), c("ref"), none, none, "role", F.coalesce(c("goal_status"), F.lit("missing_role")))
    # a test and what it refers to, told by the role of the symbol or of the method's class
    tested = tests.select("case_identity", "symbol_identity").distinct().join(methods.where("owner is not null").select(c("identity").alias("symbol_identity"), "owner"), "symbol_identity", "left").withColumn("told", F.coalesce("owner", "symbol_identity"))
    tested = tested.join(roles.withColumnRenamed("identity", "told"), "told", "left")
    proved = row(tested.where("role is not null"), c("case_identity"), c("symbol_identity"), F.lit("test"), "test", none)
    untold = row(tested.where("role is null").select("told", "status").distinct(), c("told"), none, none, "role", why)
    mock = row(symbols.sparkSession.range(1), F.lit("mock"), none, none, "mock", F.lit("unsupported_mock_facts"))
    out = orphans
    for part in (loose, operated, row(bare, c("identity"), none, none, "body", F.lit("missing_definition")), misses, associated, strange, proved, untold, mock):
        out = out.union(part)
    return out.distinct()
