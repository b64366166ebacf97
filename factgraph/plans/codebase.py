"""A code base out of the driver's tables: a class for each supplier, a method for each part, texts and facts that fit each other.

Method p belongs to class p % suppliers and stands in its file, in blocks of five lines in the order of the part keys;
p_size says what is odd about it, as ODD tells. A nation is a property class with a writer, a field, a reader and consumers;
its number modulo 5 says what the chain lacks (1: a call of the writer, 2: a plain write, 3: a consumer; 4 has two). Each
method has an entry, whose calls lead to it or not by the remainders of its part key. Each part also has a method that makes a
frame with a view as its pattern; p_size modulo 14 says what is odd about that one, as MADE tells.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factgraph.sources.workspace import written

#: p_size % 10 of a part, and what its method lacks.
ODD = {1: "no definition", 2: "another body", 3: "no reference", 4: "two references", 5: "no call of the factory", 6: "a target of another component", 7: "an operation", 8: "an operation declared otherwise", 9: "no class"}
#: p_size % 14 of a part, and what its making of a frame lacks.
MADE = {1: "no definition", 2: "another body", 3: "no reference to the factory", 4: "two patterns", 5: "no allocation", 6: "two allocations", 7: "a pattern of no role", 8: "a pattern of two roles", 9: "a pattern of another component", 10: "a callback", 11: "no frame", 12: "no source"}
#: Lines of a method's block.
BLOCK = 5
FACTORY, FACTORY_FILE = "core::MakeRef", "core/factory.h"
MACRO_FILE = "core/macros.h"
MACROS = {k: f"#defineSET_{k}(target,name,value)do{{target->Update##name(value);}}while(false)" for k in ("LAYOUT", "PAINT")}
FACTORY_PATTERN = "^MakeRef\\(\\)\\s*\\{\\s*return new T\\(\\);\\s*\\}"

METHODS = """SELECT p_partkey AS p, CAST(p_partkey % s AS bigint) AS class_no, p_size % 10 AS odd, p_size % 14 AS v, p_size, CAST(row_number() OVER (PARTITION BY p_partkey % s ORDER BY p_partkey) - 1 AS bigint) AS k FROM {part}, (SELECT count(*) AS s FROM {supplier}) x"""
#: Roles of classes by their number: pattern, model, pattern of no known role, model of two roles, none at all.
CLASS_ROLE = "CASE WHEN class_no % 8 = 5 THEN 'unknown' WHEN class_no % 8 = 6 THEN 'ambiguous' WHEN class_no % 8 = 7 THEN 'missing_role' WHEN class_no % 2 = 0 THEN 'pattern' ELSE 'model' END"


def methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = METHODS.format(part="{part}", supplier="{supplier}")
    rows = spark.sql(sql, part=spark.read.parquet(f"{sf_dir}/part.parquet"), supplier=spark.read.parquet(f"{sf_dir}/supplier.parquet"))
    kind = F.when(F.col("p") % 2 == 0, "LAYOUT").otherwise("PAINT")
    # nations 0 to 4 and 5 to 9 are the properties of the two components, layout before paint; 10 to 14 are algorithms of the first
    target = F.when(F.col("odd") == 6, F.lit(24)).when(kind == "LAYOUT", F.col("p") % 5).otherwise(5 + F.col("p") % 5)
    return rows.withColumn("kind", kind).withColumn("target", target).withColumn("role", F.expr(CLASS_ROLE)).withColumn("name", F.when(F.col("odd").isin(7, 8), F.lit("Measure")).otherwise(F.concat(F.lit("Op"), "p"))).withColumn("line", BLOCK * F.col("k") + 1).withColumn("view", F.when(F.col("v") == 7, 2).when(F.col("v") == 8, 3).when(F.col("v") == 9, 1).otherwise(0))


def path(ending: str):
    return F.concat(F.lit("cls/"), "class_no", F.lit(ending))


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The tables that framework relations and traces read, written once as a code base's facts are."""
    c, lit = F.col, F.lit
    rows = methods(spark, sf_dir)
    before = F.when(c("role") == "model", F.concat(lit("  SET_"), "kind", lit("("))).otherwise(lit("  return MakeRef<"))
    target = F.concat(lit("N"), "target")
    body = F.when(c("odd") == 2, lit("  return;")).otherwise(F.concat(before, target, F.when(c("role") == "model", lit(", Width, v);")).otherwise(lit(">();"))))
    block = F.concat("name", lit("(int v)\n{\n"), body, lit("\n}\n\n"))
    declared = F.concat(F.when(c("odd") == 8, lit("  int ")).otherwise(lit("  void ")), "name", lit("(int v) override;\n"))

    def joined(text, ending):
        return rows.withColumn("block", text).groupBy("class_no").agg(F.array_sort(F.collect_list(F.struct("p", "block"))).alias("blocks")).select(path(ending).alias("path"), F.array_join(F.transform("blocks", lambda b: b["block"]), "").alias("content"))

    paint = "#define SET_PAINT(target, name, value) do { target->Update##name(value); } while (false)\n#define SET_PAINT(other, value)\n"
    core = spark.createDataFrame([(FACTORY_FILE, "template<class T>\nT MakeRef() {\n  return new T();\n}\ntemplate<class U>\nU MakeRef() {\n  return new T();\n}\n"), (MACRO_FILE, "#define SET_LAYOUT(target, name, value) \\\n  do { target->Update##name(value); } \\\n  while (false)\n" + paint)], "path string, content string")
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet").select(c("n_nationkey").cast("long").alias("n"))
    own_file = F.concat(lit("prop/"), "n", lit(".cpp"))
    members = F.concat(lit("UpdateWidth(int v)\n{\n  width_ = v"), F.when(c("n") % 5 == 2, " + 1").otherwise(""), lit(";\n}\n\nGetWidth()\n{\n  return width_;\n}\n"))
    making = F.concat(lit("Make"), "p", lit("(int v)\n{\n"), F.when(c("v") == 2, lit("  return;")).otherwise(F.concat(lit("  auto n = Frame::CreateFrameNode(TAG, v, MakeRef<V"), "view", lit(">());"))), lit("\n}\n\n"))
    make_file = F.concat(lit("make/"), "class_no", lit(".cpp"))
    files = joined(block, ".cpp").union(joined(declared, ".h")).union(joined(making, ".cpp").withColumn("path", F.regexp_replace("path", "^cls", "make"))).union(core).union(nation.select(own_file, members))
    classes = rows.select("class_no", "role").distinct()
    own = F.when(c("odd") != 9, F.concat(lit("class:"), "class_no"))
    symbols = (
        rows.select(F.concat(lit("method:"), "p").alias("identity"), lit("method").alias("kind"), F.concat(lit("C"), "class_no", lit("::"), "name").alias("qualified_name"), own.alias("parent_identity"))
        .union(classes.select(F.concat(lit("class:"), "class_no"), lit("class"), F.concat(lit("C"), "class_no"), lit(None).cast("string")))
        .union(nation.select(F.concat(lit("nation:"), "n"), lit("class"), F.concat(lit("N"), "n"), lit(None).cast("string")))
        .union(spark.createDataFrame([("factory", "function", FACTORY, None)], "identity string, kind string, qualified_name string, parent_identity string"))
    )
    of = lambda kind: F.concat(lit(f"{kind}:"), "n")
    null = lit(None).cast("string")
    for kind, sort, name, parent in (("update", "method", "::UpdateWidth", of("nation")), ("get", "method", "::GetWidth", of("nation")), ("width", "field", "::width_", of("nation")), ("consumer", "function", "Use", null), ("consumer2", "function", "UseToo", null)):
        symbols = symbols.union(nation.select(of(kind), lit(sort), F.concat(lit("N"), "n", lit(name)), parent))
    make = F.concat(lit("make:"), "p")
    symbols = symbols.union(rows.select(make, lit("method"), F.concat(lit("C"), "class_no", lit("::Make"), "p"), F.concat(lit("class:"), "class_no")))
    more = [("factory2", "function", FACTORY, None), ("frame", "class", "core::Frame", None), ("frame:create", "method", "core::Frame::CreateFrameNode", "frame"), ("frame:get", "method", "core::Frame::GetOrCreateFrameNode", "frame")]
    symbols = symbols.union(spark.createDataFrame(more + [(f"view:{i}", "class", f"V{i}", None) for i in range(4)], "identity string, kind string, qualified_name string, parent_identity string"))
    for kind in ("entry", "mid", "start"):
        symbols = symbols.union(rows.select(F.concat(lit(f"{kind}:"), "p"), lit("function"), F.concat(lit(kind), "p"), null))
    spot = lambda df, identity, role, file, line, column, width: df.select(identity.alias("symbol_identity"), lit(role).alias("role"), file.alias("file_path"), line.cast("long").alias("start_line"), column.cast("long").alias("start_column"), line.cast("long").alias("end_line"), (column + width).cast("long").alias("end_column"))
    method = F.concat(lit("method:"), "p")
    ranges = spot(rows.where("odd <> 1"), method, "definition", path(".cpp"), c("line"), lit(1), lit(1)).union(spot(rows, method, "declaration", path(".h"), c("k") + 1, F.when(c("odd") == 8, lit(7)).otherwise(lit(8)), lit(1)))
    ranges = ranges.union(spot(spark.range(1), lit("factory"), "declaration", lit(FACTORY_FILE), lit(2), lit(3), lit(7)))
    for kind, line in (("update", 1), ("get", 6)):
        ranges = ranges.union(spot(nation, of(kind), "definition", own_file, lit(line), lit(1), lit(1)))
    for kind in ("nation", "width", "consumer", "consumer2"):
        ranges = ranges.union(spot(nation, of(kind), "declaration", lit(f"{kind}.h"), c("n") + 1, lit(1), lit(1)))
    ranges = ranges.union(spot(rows.where("p % 11 <> 0"), F.concat(lit("entry:"), "p"), "declaration", lit("entry.h"), c("p") + 1, lit(1), lit(1))).union(spot(rows, F.concat(lit("mid:"), "p"), "declaration", lit("mid.h"), c("p") + 1, lit(1), lit(1)))
    one = spark.range(1)
    ranges = ranges.union(spot(rows.where("v not in (1, 12)"), make, "definition", make_file, c("line"), lit(1), lit(1))).union(spot(rows.where("v = 1"), make, "declaration", make_file, c("line"), lit(1), lit(1)))
    for node, role, file, line in (("factory2", "declaration", FACTORY_FILE, 6), ("frame", "definition", "core/frame.h", 1), ("frame:create", "declaration", "core/frame.h", 2), ("frame:get", "declaration", "core/frame.h", 3)):
        ranges = ranges.union(spot(one, lit(node), role, lit(file), lit(line), lit(3), lit(7)))
    ranges = ranges.union(spot(rows, F.concat(lit("start:"), "p"), "declaration", lit("start.h"), c("p") + 1, lit(1), lit(1)))
    at = (c("line") + 2, F.length(before) + 1, F.length(target))
    referring = rows.where("odd not in (2, 3)")
    references = spot(referring, F.concat(lit("nation:"), "target"), "use", path(".cpp"), *at).union(spot(rows.where("odd = 4"), lit("nation:10"), "use", path(".cpp"), *at)).drop("role")
    references = references.union(spot(nation, of("width"), "use", own_file, lit(3), lit(3), lit(6)).union(spot(nation, of("width"), "use", own_file, lit(8), lit(10), lit(6))).drop("role"))
    made_at, view_at = (c("line") + 2, lit(19), lit(15)), (c("line") + 2, lit(51), lit(2))
    references = references.union(spot(rows.where("v not in (2, 3)"), lit("frame:create"), "use", make_file, *made_at).union(spot(rows.where("v <> 2"), F.concat(lit("view:"), "view"), "use", make_file, *view_at)).union(spot(rows.where("v = 4"), lit("view:3"), "use", make_file, *view_at)).drop("role"))
    calls = rows.where("role <> 'model' and odd <> 5").select(method.alias("caller"), lit("factory").alias("callee"))
    calls = calls.union(rows.where("role = 'model' and target % 5 <> 1").select(method, F.concat(lit("update:"), "target")))
    calls = calls.union(nation.where("n % 5 <> 3").select(of("consumer"), of("get"))).union(nation.where("n % 5 = 4").select(of("consumer2"), of("get")))
    calls = calls.union(rows.where("v <> 11").select(make, F.when(c("v") == 10, "frame:get").otherwise("frame:create"))).union(rows.where("v <> 5").select(make, lit("factory"))).union(rows.where("v = 6").select(make, lit("factory2")))
    calls = calls.union(rows.where("p % 4 <> 3").select(F.concat(lit("start:"), "p"), make))
    entry, mid = F.concat(lit("entry:"), "p"), F.concat(lit("mid:"), "p")
    calls = calls.union(rows.where("p % 3 = 1 or p % 7 = 0").select(entry, method)).union(rows.where("p % 3 = 0 or p % 7 = 0").select(F.explode(F.array(F.struct(entry.alias("a"), mid.alias("b")), F.struct(mid.alias("a"), method.alias("b")))).alias("e")).select("e.a", "e.b"))
    mapped = classes.where("role <> 'missing_role'").select(F.concat(lit("class:"), "class_no").alias("identity"), F.when(c("role").isin("unknown", "ambiguous"), c("role")).otherwise("recognized").alias("status"), "role", F.lit("comp0").alias("component"))
    goal = F.when(c("n") < 5, "layout_property").when(c("n") < 10, "paint_property").otherwise("layout_algorithm")
    mapped = mapped.union(nation.select(F.concat(lit("nation:"), "n"), lit("recognized"), goal, F.when(c("n") < 15, "comp0").otherwise("comp1")))
    views = [("view:0", "recognized", "pattern", "comp0"), ("view:1", "recognized", "pattern", "comp1"), ("view:3", "ambiguous", None, None)]
    mapped = mapped.union(spark.createDataFrame(views, "identity string, status string, role string, component string"))
    return {name: written(rows) for name, rows in (("symbols", symbols), ("symbol_ranges", ranges), ("references", references), ("calls", calls), ("files", files), ("mapping", mapped))}


def templates(spark: SparkSession) -> dict[str, DataFrame]:
    roles = {"pattern": ["layout_property", "paint_property", "layout_algorithm"], "LAYOUT": ["layout_property"], "PAINT": ["paint_property"]}
    return {
        "operations": spark.createDataFrame([(role, "Measure", "measure", "^(\\s*void\\s+)(Measure)\\(int v\\) override;") for role in ("pattern", "model")], "role string, name string, relation string, pattern string"),
        "bodies": spark.createDataFrame(
            [("create", "pattern", "create", "return MakeRef<)(\\w+)>\\(\\);", roles["pattern"], "factory")] + [(k, "model", "update_property", f"SET_{k}\\()(\\w+), \\w+, \\w+\\);", roles[k], "macro") for k in ("LAYOUT", "PAINT")],
            "template string, role string, relation string, pattern string, target_roles array<string>, backing string",
        ),
        "factories": spark.createDataFrame([(FACTORY, FACTORY_FILE, FACTORY_PATTERN)], "qualified_name string, file_path string, pattern string"),
        "macros": spark.createDataFrame([(k, MACRO_FILE, f"SET_{k}", text) for k, text in MACROS.items()], "template string, file_path string, name string, expansion string"),
    }


#: Idioms of setters: name, pattern and the role of what they set.
SETTERS = [(k, f"SET_{k}\\()(\\w+), (\\w+), \\w+\\);", role) for k, role in (("LAYOUT", "layout_property"), ("PAINT", "paint_property"))]

FRAME_CLASS, FRAME_FILE = "core::Frame", "core/frame.h"
#: A body that makes a frame, from its parameters on.
MAKING = "\\([^{};()]*\\)\\s*\\{\\s*auto\\s+\\w+\\s*=\\s*Frame::)(CreateFrameNode)(\\(\\s*\\w+\\s*,\\s*\\w+\\s*,\\s*MakeRef<)(\\w+)>\\(\\)\\s*\\);"

#: p_size % 15 of a part, and what its pane lacks: a pattern with a factory, an algorithm with two operations, and a nation as the property they read.
PANES = {
    1: "no factory", 2: "two factories", 3: "no definition of the factory", 4: "another factory body", 5: "no reference to the algorithm", 6: "two algorithms", 7: "an algorithm of no role", 8: "no proved creation", 9: "no operation to measure", 10: "no proved layout",
    11: "a measure without definition", 12: "another preamble", 13: "two properties", 14: "a property of another component",
}
ALLOCATION, FACTORY_BODY = "MakeRef<", "\\(\\)\\s*\\{\\s*return [^;{}]*;\\s*\\}"
PREAMBLE = "auto p = Cast<)(\\w+)>\\(\\);"


def panes(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Tables of the panes, and the relations that are proved of them (create, measure, layout)."""
    c, lit = F.col, F.lit
    rows = methods(spark, sf_dir).withColumn("u", F.expr("p_size % 15")).withColumn("file", F.concat(lit("pane/"), "class_no", lit(".cpp"))).withColumn("at", 15 * c("k") + 1)
    rows = rows.withColumn("nation", F.when(c("u") == 14, lit(24)).otherwise(c("p") % 5))
    of = lambda kind: F.concat(lit(f"{kind}:"), "p")
    name = lambda kind: F.concat(lit(f"P{kind}"), "p")
    made = F.when(c("u") == 4, lit("  Other();")).otherwise(F.concat(lit("  return MakeRef<"), name("a"), F.when(c("u") == 6, F.concat(lit(">() ?: MakeRef<"), name("b"))).otherwise(""), lit(">();")))
    factory = F.concat(lit("CreateAlgorithm()\n{\n"), made, lit("\n}\n\n"))
    body = lambda n, what: F.concat(lit(f"{n}(int v)\n{{\n  "), what, lit("\n}\n\n"))
    cast = F.concat(lit("auto p = Cast<N"), "nation", lit(">();"))
    block = F.concat(factory, body("Measure", F.when(c("u") == 12, lit("int q;")).otherwise(cast)), body("Layout", cast))
    files = rows.withColumn("block", block).groupBy("file").agg(F.array_sort(F.collect_list(F.struct("p", "block"))).alias("blocks")).select(c("file").alias("path"), F.array_join(F.transform("blocks", lambda b: b["block"]), "").alias("content"))
    null = lit(None).cast("string")
    one = lambda df, kind, sort, qualified, owner: df.select(of(kind).alias("identity"), lit(sort).alias("kind"), qualified.alias("qualified_name"), owner.alias("parent_identity"))
    member = lambda kind, n: F.concat(name(kind), lit(f"::{n}"))
    symbols = one(rows, "pane", "class", name("p"), null).union(one(rows, "alg", "class", name("a"), null)).union(one(rows.where("u = 6"), "alt", "class", name("b"), null))
    symbols = symbols.union(one(rows.where("u <> 1"), "fac", "method", member("p", "CreateAlgorithm"), of("pane"))).union(one(rows.where("u = 2"), "fac2", "method", member("p", "CreateAlgorithm"), of("pane")))
    symbols = symbols.union(one(rows.where("u <> 9"), "mea", "method", member("a", "Measure"), of("alg"))).union(one(rows, "lay", "method", member("a", "Layout"), of("alg")))
    spot = lambda df, identity, role, line, column, width: df.select(identity.alias("symbol_identity"), lit(role).alias("role"), c("file").alias("file_path"), line.cast("long").alias("start_line"), column.cast("long").alias("start_column"), line.cast("long").alias("end_line"), (column + width).cast("long").alias("end_column"))
    ranges = spot(rows.where("u not in (1, 3)"), of("fac"), "definition", c("at"), lit(1), lit(1)).union(spot(rows.where("u not in (9, 11)"), of("mea"), "definition", c("at") + 5, lit(1), lit(1))).union(spot(rows, of("lay"), "definition", c("at") + 10, lit(1), lit(1)))
    width = F.length(name("a"))
    references = spot(rows.where("u not in (4, 5)"), of("alg"), "use", c("at") + 2, lit(18), width).union(spot(rows.where("u = 6"), of("alt"), "use", c("at") + 2, 18 + width + 15, width))
    nation, n_width = F.concat(lit("nation:"), "nation"), F.length(F.concat(lit("N"), "nation"))
    for shift, where in ((7, "u <> 12"), (12, "true")):
        references = references.union(spot(rows.where(where), nation, "use", c("at") + shift, lit(17), n_width))
    references = references.union(spot(rows.where("u = 13"), lit("nation:4"), "use", c("at") + 12, lit(17), n_width)).drop("role")
    mapped = rows.select(of("pane").alias("identity"), lit("recognized").alias("status"), lit("pattern").alias("role"), lit("comp0").alias("component")).union(rows.where("u <> 7").select(of("alg"), lit("recognized"), lit("layout_algorithm"), lit("comp0")))
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").select(c("n_nationkey").cast("long").alias("n"))
    mapped = mapped.union(n.select(F.concat(lit("nation:"), "n"), lit("recognized"), lit("layout_property"), F.when(c("n") < 15, "comp0").otherwise("comp1")))
    proved = lambda df, a, b, relation: df.select(of(a).alias("source"), of(b).alias("target"), lit(relation).alias("relation"))
    relations = proved(rows.where("u <> 8"), "fac", "alg", "create").union(proved(rows, "alg", "mea", "measure")).union(proved(rows.where("u <> 10"), "alg", "lay", "layout"))
    calls = rows.select(of("fac").alias("caller"), lit("factory").alias("callee")).union(rows.select(of("lay"), of("alg")))
    return {k: written(v) for k, v in (("symbols", symbols), ("symbol_ranges", ranges), ("references", references), ("calls", calls), ("files", files), ("mapping", mapped), ("relations", relations))}
