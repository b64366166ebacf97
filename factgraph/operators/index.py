"""The symbol index: validation, derived tables and lookups over ten fact tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factgraph.functions import ranges
from factgraph.operators import intervals
from factgraph.sources.workspace import dealt

RANGE = list(ranges.FIELDS)


class FactError(ValueError):
    """Facts that contradict each other."""


def conflicting(rows: DataFrame, key: str) -> DataFrame:
    """Keys whose distinct rows differ; rows are dealt by their key once, and both counts are made where they lie."""
    return dealt(rows, rows.count(), key).distinct().groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key, "n")


def dangling(rows: DataFrame, column: str, known: DataFrame, key: str) -> DataFrame:
    """Rows whose column names nothing known."""
    return rows.join(known.select(F.col(key).alias(column)).distinct(), column, "left_anti")


def refuse(rows: DataFrame, column: str, message: str) -> None:
    """Raise if there are rows; the message names the smallest one."""
    found = rows.agg(F.min(column)).first()[0]
    if found is not None:
        raise FactError(f"{message}: {found}")


def with_ranges(symbols: DataFrame, symbol_ranges: DataFrame) -> DataFrame:
    """Symbols with their declaration and definition, null where there is none."""
    place = F.struct(*RANGE)
    pivot = symbol_ranges.groupBy("symbol_identity").agg(*(F.max(F.when(F.col("role") == r, place)).alias(r) for r in ("declaration", "definition")))
    return symbols.join(pivot, symbols["identity"] == pivot["symbol_identity"], "left").drop("symbol_identity")


def get(symbols: DataFrame, symbol_ranges: DataFrame, identity: str) -> DataFrame:
    return with_ranges(symbols.where(F.col("identity") == identity), symbol_ranges.where(F.col("symbol_identity") == identity))


def by_name(symbols: DataFrame, name: str) -> DataFrame:
    """All candidates of a display name, never one for several."""
    return symbols.where(F.col("display_name") == name).orderBy("qualified_name", "kind", "identity")


def by_qualified_name(symbols: DataFrame, name: str) -> DataFrame:
    return symbols.where(F.col("qualified_name") == name).orderBy("display_name", "kind", "identity")


def in_file(symbols: DataFrame, symbol_ranges: DataFrame, path: str) -> DataFrame:
    own = symbol_ranges.where(F.col("file_path") == path).select(F.col("symbol_identity").alias("identity"))
    return symbols.join(own, "identity", "left_semi")


def all_files(*tables: DataFrame) -> DataFrame:
    """Every path that a fact names."""
    found = [t.select(F.col("file_path" if "file_path" in t.columns else "path").alias("path")) for t in tables]
    out = found[0]
    for x in found[1:]:
        out = out.union(x)
    return out.distinct()


def references_of(references: DataFrame, identity: str) -> DataFrame:
    return references.where(F.col("symbol_identity") == identity).select(*RANGE).distinct().orderBy(*RANGE)


def calls(relations: DataFrame, symbols: DataFrame, symbol_ranges: DataFrame, kind: str) -> DataFrame:
    """Direct calls caller -> callee of one stored side, endpoints unresolved where they dangle.

    The range is the caller's definition, or else its declaration; the other side is never inferred.
    """
    source, target = ("target_identity", "source_identity") if kind == "caller" else ("source_identity", "target_identity")
    pairs = relations.where(F.col("relation_kind") == kind).select(F.col(source).alias("caller"), F.col(target).alias("callee")).distinct()
    known = with_ranges(symbols, symbol_ranges)
    left = known.select(F.col("identity").alias("caller"), F.lit(True).alias("caller_known"), F.coalesce("definition", "declaration").alias("place"))
    right = symbols.select(F.col("identity").alias("callee"), F.lit(True).alias("callee_known"))
    found = pairs.join(left, "caller", "left").join(right, "callee", "left")
    return found.select("caller", "callee", F.coalesce("caller_known", F.lit(False)).alias("caller_known"), F.coalesce("callee_known", F.lit(False)).alias("callee_known"), *(F.col(f"place.{c}").alias(c) for c in RANGE))


def test_cases(entities: DataFrame, fixture_cases: DataFrame, bodies: DataFrame) -> DataFrame:
    """Cases with their fixture and, if known, their body."""
    own = entities.where("kind = 'case'")
    body = bodies.select("case_identity", *(F.col(c).alias(f"body_{c}") for c in RANGE))
    return own.join(fixture_cases, own["identity"] == fixture_cases["case_identity"]).drop("case_identity").join(body, own["identity"] == body["case_identity"], "left").drop("case_identity")


def contained_references(references: DataFrame, bodies: DataFrame) -> DataFrame:
    """References that stand inside a test's body: ranges that share a line, joined by buckets of lines, with the exact test behind it."""
    lines = ("start_line", "end_line")
    met = intervals.overlapping(references.select("symbol_identity", *RANGE), bodies.select("case_identity", *RANGE), [("file_path", "file_path")], lines, lines)
    inside = met.where(ranges.contains(ranges.start(met, "right."), ranges.end(met, "right."), ranges.start(met, "left."), ranges.end(met, "left.")))
    return inside.select("right.case_identity", "left.symbol_identity", *(f"left.{c}" for c in RANGE)).distinct()


def tested_symbols(test_references: DataFrame) -> DataFrame:
    """Each case and symbol with all its references as provenance, in order."""
    return test_references.groupBy("case_identity", "symbol_identity").agg(F.array_sort(F.collect_set(F.struct(*RANGE))).alias("references"))


def referenced_symbols(test_references: DataFrame, symbols: DataFrame | None = None) -> DataFrame:
    """case_identity and identity of the symbols that each case refers to directly (those of ``symbols``, if given)."""
    own = test_references.select("case_identity", F.col("symbol_identity").alias("identity")).distinct()
    return own if symbols is None else own.join(symbols.select("identity"), "identity", "left_semi").select("case_identity", "identity")


def at_exact_range(references: DataFrame, evidence: DataFrame) -> DataFrame:
    """References whose whole range equals an evidence's range, with the evidence's other columns."""
    return references.join(evidence, RANGE)


def nearest_before(rows: DataFrame, group: list[str], order: str, is_declaration: Column, at: str) -> DataFrame:
    """Adds ``at``: the order of the last declaration before each row of its group, in one ordered pass."""
    before = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(at, F.last(F.when(is_declaration, F.col(order)), ignorenulls=True).over(before))


def mixed_kinds(entities: DataFrame) -> DataFrame:
    """Identities that are both a fixture and a case."""
    return entities.where("kind = 'fixture'").select("identity").intersect(entities.where("kind = 'case'").select("identity"))


def merge_facts(facts: DataFrame) -> DataFrame:
    """Union of the items of each (identity, kind), sorted."""
    return facts.groupBy("identity", "kind").agg(F.array_sort(F.collect_set("item")).alias("items"))


def canonical(observations: DataFrame) -> DataFrame:
    """One row for each identity from all its observations; ``conflict`` names the first field that can't be reconciled.

    observations: identity, kind, display_name, qualified_name, parent_identity, namespace_identity, declaration,
    definition (structs of the range fields), site (struct), parent_kind. A namespace takes its smallest range, other
    kinds at most one. Differing display names or parents need declaration-site proof: observations whose site overlaps
    the declaration and whose parent is a class or struct agree on one (name, parent), for a method or field only; others
    may show the missing parent, or the namespace presentation outside the class.
    """
    one = lambda c: F.array_compact(F.collect_set(c))
    shape = F.struct("display_name", "parent_identity")
    grouped = observations.groupBy("identity").agg(
        F.collect_set("kind").alias("kinds"), F.collect_set("qualified_name").alias("names"), one("declaration").alias("declarations"), one("definition").alias("definitions"),
        one("namespace_identity").alias("namespaces"), one("parent_identity").alias("parents"), F.collect_set("display_name").alias("displays"), F.collect_set(shape).alias("shapes"),
        F.collect_set(F.struct("display_name", "parent_identity", "site", "parent_kind")).alias("facts"),
    )
    kind, names = F.col("kinds")[0], lambda c: F.size(c) > 1
    space = kind == "namespace"
    declaration, definition = (F.array_min(c) for c in ("declarations", "definitions"))
    namespace = F.try_element_at("namespaces", F.lit(1))

    def point(r, side):
        return F.struct(r[f"{side}_line"].alias("line"), r[f"{side}_column"].alias("column"))

    at_declaration = F.filter("facts", lambda f: declaration.isNotNull() & f["site"].isNotNull() & f["parent_identity"].isNotNull() & f["parent_kind"].isNotNull() & (f["site"]["file_path"] == declaration["file_path"]) & (F.greatest(point(f["site"], "start"), point(declaration, "start")) < F.least(point(f["site"], "end"), point(declaration, "end"))))
    grouped = grouped.withColumn("proof", at_declaration)
    proven = F.array_distinct(F.transform("proof", lambda f: F.struct(f["display_name"].alias("display_name"), f["parent_identity"].alias("parent_identity"))))
    grouped = grouped.withColumn("proven", proven)
    truth = F.try_element_at("proven", F.lit(1))
    simple = (F.size("displays") == 1) & (F.size("parents") <= 1)
    sound = kind.isin("method", "field") & (F.size("proof") > 0) & (F.size("proven") == 1) & F.forall("proof", lambda f: f["parent_kind"].isin("class", "struct"))
    agrees = F.forall("facts", lambda f: ((f["display_name"] == truth["display_name"]) & (f["parent_identity"].isNull() | (f["parent_identity"] == truth["parent_identity"]))) | (f["site"].isNotNull() & F.coalesce(f["parent_kind"] == "namespace", F.lit(False)) & F.coalesce(f["parent_identity"] == namespace, F.lit(False)) & (f["display_name"] != truth["display_name"])))
    conflict = (
        F.when(names("kinds"), "kind").when(names("names"), "qualified_name").when(~space & names("declarations"), "declaration").when(~space & names("definitions"), "definition")
        .when(names("namespaces"), "namespace_identity").when(simple, None).when(F.size("displays") == 1, "parent_identity")
        .when(F.coalesce(~sound, F.lit(True)), "declaration_site_containment").when(F.coalesce(~agrees, F.lit(True)), "related_symbol_metadata")
    )
    return grouped.select("identity", kind.alias("kind"), F.when(simple, F.col("displays")[0]).otherwise(truth["display_name"]).alias("display_name"), F.col("names")[0].alias("qualified_name"), declaration.alias("declaration"), definition.alias("definition"), F.when(simple, F.try_element_at("parents", F.lit(1))).otherwise(truth["parent_identity"]).alias("parent_identity"), namespace.alias("namespace_identity"), conflict.alias("conflict"))


def canonical_or_fail(observations: DataFrame) -> DataFrame:
    """The canonical symbols; one conflict fails the whole collection."""
    found = canonical(observations)
    refuse(found.where("conflict is not null").select(F.concat("identity", F.lit(" "), "conflict").alias("c")), "c", "symbols conflict")
    return found.drop("conflict")
