"""Simple paths from many starts at once, each with limits of its own, in the order of a depth-first search.

Depth-first preorder is the order of the arrays of nodes, so paths grow level by level and are numbered by their ranks;
each level keeps the ``max_states`` smallest states of each start, which no later one can come before.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factgraph.operators.ranks import ranked
from factgraph.sources.workspace import written


@dataclass(frozen=True)
class Walks:
    """paths: trace, scope, path (nodes), length, ended, state, before (the weight of the paths in front of it); notes: trace and issue."""

    paths: DataFrame
    notes: DataFrame


def reaching(steps: DataFrame, targets: DataFrame) -> DataFrame:
    """scope and node of what a target (scope, node) can be reached from by steps (src, dst; with a scope if they have one), the targets among them."""
    own = ["scope"] if "scope" in steps.columns else []
    found = fresh = written(targets.select("scope", "node").distinct())
    while True:
        back = steps.join(fresh.withColumnRenamed("node", "dst"), [*own, "dst"]).select("scope", F.col("src").alias("node")).distinct()
        fresh = written(back.join(found, ["scope", "node"], "left_anti"))
        if fresh.isEmpty():
            return found
        found = found.union(fresh)


def walk(steps: DataFrame, starts: DataFrame, flags: DataFrame, max_depth: int = 8, max_paths: int = 32, max_states: int = 1000) -> Walks:
    """Paths of distinct nodes from each start (trace, scope, node) along the steps (scope, src, dst) of its scope.

    flags: scope, node, ends, blocked and weight of the nodes that are no plain ones. A path ends at a node that ends or is
    blocked, at ``max_depth``, or where no step leads to a node that it doesn't have. Paths stop once their weights sum up to
    ``max_paths``. Issues: cycle_cut where a step back was left out, depth_limit where steps would lead on, and
    state_or_path_limit where states were left over.
    """
    steps = written(steps.select("scope", "src", "dst").distinct())
    flags = flags.select("scope", F.col("node").alias("at"), "ends", "blocked", F.col("weight").cast("long").alias("weight"))
    level = starts.select("trace", "scope", F.array("node").alias("path"))
    no = lambda c: F.coalesce(F.col(c), F.lit(False))
    states = None
    for depth in range(max_depth + 1):
        level = level.withColumn("at", F.element_at("path", -1)).join(flags, ["scope", "at"], "left")
        level = written(level.select("trace", "scope", "path", "at", no("ends").alias("ends"), no("blocked").alias("blocked"), F.coalesce("weight", F.lit(1)).alias("weight")))
        onward = level.join(steps.withColumnRenamed("src", "at"), ["scope", "at"]).withColumn("back", F.expr("array_contains(path, dst)"))
        seen = onward.groupBy("trace", "path").agg(F.count("*").alias("steps"), F.count_if("back").alias("back"))
        open_ = ~F.col("ends") & ~F.col("blocked") & F.lit(depth < max_depth)
        rows = level.join(seen, ["trace", "path"], "left").fillna(0, ["steps", "back"])
        own = rows.select(
            "trace", "scope", "path", "ends", "weight", F.lit(depth).alias("length"), (~open_ | (F.col("steps") == F.col("back"))).alias("leaf"), (open_ & (F.col("back") > 0)).alias("cycle"),
            (~F.col("ends") & (F.col("steps") > 0) & F.lit(depth == max_depth)).alias("deep"),
        )
        own = written(own)
        states = own if states is None else states.union(own)
        children = onward.where(open_ & ~F.col("back")).select("trace", "scope", F.concat("path", F.array("dst")).alias("path"))
        # of each start, no state behind so many of its level can be one of the first
        first = F.row_number().over(Window.partitionBy("trace").orderBy("path"))
        level = written(children.withColumn("n", first).where(F.col("n") <= max_states).drop("n"))
        if depth == max_depth or level.isEmpty():
            break
    rows = ranked(states, ["trace", "path"], "state", ["trace"], {"before": F.when(F.col("leaf"), F.col("weight"))})
    taken = (F.col("state") < max_states) & (F.col("before") < max_paths)
    rows = written(rows.withColumn("taken", taken))
    issues = [("cycle_cut", F.col("taken") & F.col("cycle")), ("depth_limit", F.col("taken") & F.col("leaf") & F.col("deep")), ("state_or_path_limit", ~F.col("taken"))]
    notes = rows.select("trace", F.explode(F.array_compact(F.array(*(F.when(hit, name) for name, hit in issues)))).alias("issue")).distinct()
    return Walks(rows.where("taken and leaf").select("trace", "scope", "path", "length", F.col("ends").alias("ended"), "state", "before"), notes)


def summed(paths: DataFrame, notes: DataFrame, traces: DataFrame) -> DataFrame:
    """trace, status, exhaustive and diagnostics (comma-joined) of each trace (trace) from its paths (trace, gaps) and notes (trace, issue).

    Several paths, or a gap that begins with ambiguous, make a trace ambiguous; one path without gaps of an exhaustive
    search makes it complete; else it is incomplete.
    """
    vague = F.exists("gaps", lambda g: g.startswith("ambiguous_"))
    of = paths.groupBy("trace").agg(F.count("*").alias("n"), F.bool_or(vague).alias("vague"), F.bool_or(F.size("gaps") == 0).alias("whole"))
    said = notes.groupBy("trace").agg(F.array_sort(F.collect_set("issue")).alias("issues"))
    rows = traces.select("trace").distinct().join(of, "trace", "left").join(said, "trace", "left")
    exhaustive = F.col("issues").isNull()
    status = F.when((F.col("n") > 1) | F.coalesce("vague", F.lit(False)), "ambiguous").when(exhaustive & F.coalesce("whole", F.lit(False)), "complete").otherwise("incomplete")
    return rows.select("trace", status.alias("status"), exhaustive.alias("exhaustive"), F.coalesce(F.array_join("issues", ","), F.lit("")).alias("diagnostics"), F.coalesce("n", F.lit(0)).alias("n_paths"))
