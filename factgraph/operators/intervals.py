"""Joins of line ranges that meet, by buckets of several widths.

A range belongs to the level of the smallest power of two that holds it, and lies in one or
two buckets of that width. Of two ranges that meet, the narrower one looks the wider one up
at each level that the other side has, so a row is copied at most twice for each of these
levels, and the rows of one file are dealt out by their places in it. A pair is reported in
the first bucket that both have.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _level(lo: Column, hi: Column) -> Column:
    """Bits of the smallest power of two that is no less than the number of lines."""
    return F.when(hi == lo, 0).otherwise(F.length(F.bin(hi - lo)))


def _sided(rows: DataFrame, side: str, on: list[str], lines: tuple[str, str]) -> DataFrame:
    lo, hi = (f(*(F.col(c).cast("long") for c in lines)) for f in (F.least, F.greatest))
    known = rows.select(F.struct("*").alias(side), *(F.col(c).alias(f"_on{i}") for i, c in enumerate(on)), lo.alias(f"_{side}_lo"), hi.alias(f"_{side}_hi"))
    known = known.where(" and ".join([*(f"{side}.{c} is not null" for c in lines), *(f"_on{i} is not null" for i in range(len(on)))]))
    return known.withColumn(f"_{side}_level", _level(F.col(f"_{side}_lo"), F.col(f"_{side}_hi")))


def _dealt(rows: DataFrame, side: str, level: Column | str) -> DataFrame:
    """Rows for each bucket of the given level."""
    at = rows.withColumn("_level", level if isinstance(level, Column) else F.col(level))
    bucket = F.sequence(F.expr(f"shiftright(_{side}_lo, _level)"), F.expr(f"shiftright(_{side}_hi, _level)"))
    return at.withColumn("_bucket", F.explode(bucket))


def overlapping(left: DataFrame, right: DataFrame, on: list[tuple[str, str]], left_lines: tuple[str, str], right_lines: tuple[str, str]) -> DataFrame:
    """Pairs (structs left and right) equal in ``on`` whose line ranges, ends included, have a line in common; each pair once.

    A row with a null among these columns meets nothing. The levels of both sides, at most 63, are looked up first.
    """
    a, b = _sided(left, "left", [x for x, _ in on], left_lines), _sided(right, "right", [y for _, y in on], right_lines)
    out = None
    for narrow, wide, sides in ((a, b, ("left", "right")), (b, a, ("right", "left"))):
        n, w = sides
        levels = sorted(r[0] for r in wide.select(f"_{w}_level").distinct().collect())
        # ranges of one level meet in the first of the two rounds only
        probes = narrow.withColumn("_probe", F.explode(F.array(*map(F.lit, levels)).cast("array<int>"))).where(f"_{n}_level {'<=' if n == 'left' else '<'} _probe")
        probed = _dealt(probes, n, "_probe").drop("_probe")
        stored = _dealt(wide, w, f"_{w}_level")
        keys = [*(f"_on{i}" for i in range(len(on))), "_level", "_bucket"]
        # a side's rows are many more than its files' sizes tell, so neither goes through the driver
        met = probed.join(stored.hint("merge"), keys).where("_left_lo <= _right_hi and _right_lo <= _left_hi and _bucket = greatest(shiftright(_left_lo, _level), shiftright(_right_lo, _level))")
        found = met.select("left", "right")
        out = found if out is None else out.unionByName(found)
    return out
