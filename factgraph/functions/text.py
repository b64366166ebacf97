"""Checks and forms of text values as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_sha256(value: Column) -> Column:
    """Whether a value is 64 lower-case hex digits; false for null."""
    return F.coalesce(value.rlike(r"\A[0-9a-f]{64}\z"), F.lit(False))


def is_timestamp(value: Column) -> Column:
    """Whether a value is an ISO date and time with an offset; a naive one isn't."""
    shaped = value.rlike(r"\A\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:?\d{2})\z")
    return F.coalesce(shaped & F.try_to_timestamp(value).isNotNull(), F.lit(False))


def normalized_newlines(value: Column) -> Column:
    return F.regexp_replace(value, "\r\n?", "\n")


def normalized_sha256(value: Column) -> Column:
    """SHA-256 of the text with all line breaks as one line feed."""
    return F.sha2(normalized_newlines(value), 256)


def bounded_message(value: Column, limit: int) -> Column:
    """Head and tail of a message that is longer than the limit, with a mark between them."""
    half = (limit - 9) // 2
    return F.when(F.length(value) <= limit, value).otherwise(F.concat(F.substring(value, 1, half), F.lit(" [cut:] "), F.right(value, F.lit(half))))


def qualified_name(container: Column, name: Column) -> Column:
    """container::name, without colons that the container already ends in; the name alone without a container."""
    inside = F.regexp_replace(container, ":+$", "")
    return F.when(F.coalesce(inside, F.lit("")) == "", name).otherwise(F.concat_ws("::", inside, name))


def source_proof(rule: Column, path: Column, content: Column, start: Column, end: Column) -> Column:
    """Evidence that a rule matched characters start to end of a file: rule, path, places and the hash of the normalized text."""
    return F.struct(rule.alias("rule"), path.alias("path"), start.alias("start"), end.alias("end"), normalized_sha256(content).alias("sha256"))
