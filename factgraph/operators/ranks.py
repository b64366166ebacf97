"""Ranks and running sums over whole tables, without a task that sees all rows.

The rows are sorted by range partitions and written; each partition counts its rows, and
what the partitions in front of it hold is added. Only one number for each partition (and
sum) meets the driver.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factgraph.sources.workspace import written

#: Bits of a row's number within its partition, as monotonically_increasing_id() has them.
ROW_BITS = 33


def ranked(rows: DataFrame, by: list[str], name: str = "rank", within: list[str] | None = None, sums: dict[str, Column] | None = None) -> DataFrame:
    """Adds ``name``: the 0-based place of each row in the order of ``by``, and for each of ``sums`` the sum over all rows in front of it.

    ``by`` must tell all rows apart, nulls come first. With ``within``, which ``by`` begins with, places and sums begin
    anew in each group; a group may be as large as the table.
    """
    sums = sums or {}
    within = within or []
    if by[: len(within)] != within:
        raise ValueError("a group's columns come first in the order")
    placed = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())
    for n, c in sums.items():
        placed = placed.withColumn(f"_of_{n}", F.coalesce(c.cast("long"), F.lit(0)))
    held = written(placed)
    part = F.shiftright("_at", ROW_BITS)
    totals = held.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"), *(F.sum(f"_of_{n}").alias(f"_of_{n}") for n in sums)).orderBy("_part").collect()
    before = [accumulate([r[c] for r in totals], initial=0) for c in ("_n", *(f"_of_{n}" for n in sums))]
    offsets = [(r["_part"], *found) for r, found in zip(totals, zip(*before, strict=False), strict=False)]
    columns = ", ".join(["_part long", "_n long", *(f"_before_{n} long" for n in sums)])
    # one row for each partition
    offsets = F.broadcast(rows.sparkSession.createDataFrame(offsets, columns))
    out = held.withColumn("_part", part).join(offsets, "_part").withColumn(name, F.col("_n") + F.col("_at") - F.shiftleft(F.col("_part"), ROW_BITS))
    if sums:
        own = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
        for n in sums:
            out = out.withColumn(n, F.col(f"_before_{n}") + F.coalesce(F.sum(f"_of_{n}").over(own), F.lit(0)))
    kept = [*rows.columns, name, *sums]
    out = out.select(*kept)
    if not within:
        return out
    first = out.groupBy(*(F.col(c).alias(f"_group{i}") for i, c in enumerate(within))).agg(*(F.min(c).alias(f"_first_{c}") for c in (name, *sums)))
    met = out.join(first, [F.col(c).eqNullSafe(F.col(f"_group{i}")) for i, c in enumerate(within)])
    return met.select(*rows.columns, *((F.col(c) - F.col(f"_first_{c}")).alias(c) for c in (name, *sums)))
