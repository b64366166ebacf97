"""Half-open source ranges [start, end) in 1-based lines and code-point columns, held as flat columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FIELDS = ("file_path", "start_line", "start_column", "end_line", "end_column")


def at(frame, line: str, column: str) -> Column:
    return F.struct(frame[line].cast("long").alias("line"), frame[column].cast("long").alias("column"))


def start(frame, prefix: str = "") -> Column:
    return at(frame, prefix + "start_line", prefix + "start_column")


def end(frame, prefix: str = "") -> Column:
    return at(frame, prefix + "end_line", prefix + "end_column")


def contains(outer_start: Column, outer_end: Column, inner_start: Column, inner_end: Column) -> Column:
    """Whether the outer range holds the inner one, ends included."""
    return (outer_start <= inner_start) & (inner_end <= outer_end)


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Strict overlap of two ranges: the later start lies before the earlier end."""
    return (a_start < a_end) & (a_start < b_end) & (b_start < a_end) & (b_start < b_end)


def extent_relation(c_start: Column, c_end: Column, e_start: Column, e_end: Column) -> Column:
    """How a changed range meets a symbol's extent: point_interior, enclosing, intersecting, or null."""
    empty = e_start == e_end
    point = c_start == c_end
    return (
        F.when(empty, None)
        .when(point, F.when((e_start < c_start) & (c_start < e_end), "point_interior"))
        .when((e_start <= c_start) & (c_end <= e_end), "enclosing")
        .when(F.greatest(c_start, e_start) < F.least(c_end, e_end), "intersecting")
    )


def offset_line(content: Column, offset: Column) -> Column:
    """1-based line of a 0-based code-point offset."""
    head = F.substring(content, F.lit(1), offset.cast("int"))
    return F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))) + 1


def offset_column(content: Column, offset: Column) -> Column:
    """1-based column of a 0-based code-point offset."""
    return F.length(F.substring_index(F.substring(content, F.lit(1), offset.cast("int")), "\n", -1)) + 1


def diff_start(first: Column, count: Column) -> Column:
    """First line of a hunk side; a side of no lines N means the gap behind line N."""
    return F.when(count == 0, first + 1).otherwise(first)
