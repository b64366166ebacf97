"""Exact and regex text search with code-point positions."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factgraph.functions import paths

RESULT = ("path", "start_line", "start_column", "end_line", "end_column", "matched_text", "line_text")


class QueryError(ValueError):
    """A query that can't be answered as stated."""


@dataclass(frozen=True)
class TextQuery:
    text: str
    regex: bool = False
    case_sensitive: bool = True
    scope: str = "."
    globs: tuple[str, ...] = field(default=())
    limit: int | None = None

    def __post_init__(self) -> None:
        if not self.text or re.search(r"[\r\n]", self.text):
            raise QueryError("the text must be one line that is not empty")
        if self.limit is not None and (isinstance(self.limit, bool) or self.limit < 1):
            raise QueryError("the limit must be a positive integer")


def lines(files: DataFrame) -> DataFrame:
    """path, line (1-based), line_text without its line end; what follows the last line end only if it isn't empty."""
    cut = files.select("path", F.posexplode(F.split("content", "\n")).alias("at", "raw"), F.size(F.split("content", "\n")).alias("n"))
    return cut.where("not (at = n - 1 and raw = '')").select("path", (F.col("at") + 1).cast("long").alias("line"), F.regexp_replace("raw", "\r+$", "").alias("line_text"))


def chosen(files: DataFrame, query: TextQuery) -> DataFrame:
    """Files in the scope whose path a glob matches."""
    found = files.where(paths.in_scope("path", query.scope))
    return found.where(paths.matches_any("path", [paths.component_pattern(g) for g in query.globs])) if query.globs else found


def search(files: DataFrame, query: TextQuery) -> DataFrame:
    """Non-overlapping matches, left to right; with a limit, the first ones by path and position."""
    found = chosen(files, query)
    if not query.regex and query.case_sensitive:
        found = _literal(lines(found.where(F.col("content").contains(query.text))), query.text)
    elif not query.regex and query.text.isascii():
        found = _folded(lines(found), query.text)
    else:
        found = _regex(lines(found), query)
    found = found.select(*RESULT)
    if query.limit is None:
        return found.distinct()
    # each path with a match has one at least, so the first matches stand in as many first paths; only theirs are sent
    first = found.select("path").distinct().orderBy("path").limit(query.limit)
    return found.join(first, "path", "left_semi").select(*RESULT).distinct().orderBy(*RESULT[:6]).limit(query.limit)


def _placed(rows: DataFrame, starts) -> DataFrame:
    """Rows of matches from (0-based start, length) pairs of each line."""
    return rows.withColumn("m", F.explode(starts)).select("path", F.col("line").alias("start_line"), (F.col("m.at") + 1).cast("long").alias("start_column"), F.col("line").alias("end_line"), (F.col("m.at") + F.col("m.size") + 1).cast("long").alias("end_column"), F.substring("line_text", F.col("m.at") + 1, F.col("m.size")).alias("matched_text"), "line_text")


def _literal(rows: DataFrame, text: str) -> DataFrame:
    """Where a literal stands: behind the pieces that it separates."""
    rows = rows.where(F.col("line_text").contains(text))
    pieces = F.split("line_text", "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E")
    ends = F.aggregate(F.slice(pieces, F.lit(1), F.size(pieces) - 1), F.array().cast("array<struct<at:int,size:int>>"), lambda done, p: F.concat(done, F.array(F.struct((F.coalesce(F.try_element_at(done, F.lit(-1))["at"] + len(text), F.lit(0)) + F.length(p)).cast("int").alias("at"), F.lit(len(text)).alias("size")))))
    return _placed(rows, ends)


def _folded(rows: DataFrame, text: str) -> DataFrame:
    """An ASCII literal in any case; lines where lower-casing moves positions go the slow way."""
    whole = F.lower("line_text")
    slow = F.array_join(F.transform(F.split("line_text", ""), lambda c: F.when(F.length(F.lower(c)) == 1, F.lower(c)).otherwise(c)), "")
    hit = rows.where(whole.contains(text.lower()))
    folded = hit.withColumn("low", F.when(F.length(whole) == F.length("line_text"), whole).otherwise(slow)).where(F.col("low").contains(text.lower()))
    pieces = F.split("low", "\\Q" + text.lower() + "\\E")
    ends = F.aggregate(F.slice(pieces, F.lit(1), F.size(pieces) - 1), F.array().cast("array<struct<at:int,size:int>>"), lambda done, p: F.concat(done, F.array(F.struct((F.coalesce(F.try_element_at(done, F.lit(-1))["at"] + len(text), F.lit(0)) + F.length(p)).cast("int").alias("at"), F.lit(len(text)).alias("size")))))
    return _placed(folded, ends)


def _regex(rows: DataFrame, query: TextQuery) -> DataFrame:
    """Regex positions need the match itself; Arrow batches of lines that Spark's own regex may prefilter."""
    pattern = re.compile(query.text if query.regex else re.escape(query.text), 0 if query.case_sensitive else re.IGNORECASE)
    shape = pa.list_(pa.struct([("at", pa.int32()), ("size", pa.int32())]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [[{"at": m.start(), "size": m.end() - m.start()} for m in pattern.finditer(x) if m.end() > m.start()] for x in b.column("line_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, shape)], names=[*b.schema.names, "starts"])

    got = rows.mapInArrow(find, "path string, line long, line_text string, starts array<struct<at:int,size:int>>")
    return _placed(got.where(F.size("starts") > 0), F.col("starts"))
