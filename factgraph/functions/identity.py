"""Stable identities: SHA-256 over canonical forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def zero() -> Column:
    return F.decode(F.unhex(F.lit("00")), "utf-8")


def joined_sha(prefix: str, *parts: Column) -> Column:
    """prefix followed by the hex SHA-256 of the parts joined by a zero character."""
    return F.concat(F.lit(prefix), F.sha2(_chain(parts), 256))


def _chain(parts: tuple[Column, ...]) -> Column:
    out: list[Column] = []
    for p in parts:
        out += [zero(), p.cast("string")] if out else [p.cast("string")]
    return F.concat(*out)


def test_identity(kind: str, path: Column, *parts: Column) -> Column:
    return joined_sha("test-entity:", F.lit(kind), path, *parts)


def escaped(text: Column) -> Column:
    """A JSON string with ASCII only: quotes, backslashes and control characters escaped, others as UTF-16 units."""
    quoted = F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), '"', '\\\\"')
    short = quoted
    for raw, mark in (("\b", "\\\\b"), ("\f", "\\\\f"), ("\n", "\\\\n"), ("\r", "\\\\r"), ("\t", "\\\\t")):
        short = F.regexp_replace(short, raw, mark)
    units = F.regexp_extract_all(short, F.lit(r"(?s)([\x20-\x7e]+|[^\x20-\x7e])"), F.lit(1))

    def unit(code: Column) -> Column:
        return F.concat(F.lit("\\u"), F.lower(F.lpad(F.hex(code), 4, "0")))

    def one(x: Column) -> Column:
        code = F.conv(F.hex(F.encode(x, "UTF-32")), 16, 10).cast("long")
        pair = F.concat(unit(F.lit(0xD800) + F.shiftright(code - 0x10000, 10)), unit(F.lit(0xDC00) + (code - 0x10000) % 1024))
        return F.when(x.rlike(r"^[\x20-\x7e]+$"), x).when(code > 0xFFFF, pair).otherwise(unit(code))

    return F.concat(F.lit('"'), F.array_join(F.transform(units, one), ""), F.lit('"'))


def node_value(namespace: Column, key: Column) -> Column:
    """Text form of a graph node: a version mark and the canonical JSON of both parts."""
    return F.concat(F.lit("graph-node:v1:["), escaped(namespace), F.lit(","), escaped(key), F.lit("]"))


def usr_id(usr: Column) -> Column:
    """Short id of a symbol's unified name: 16 upper-case hex digits of its SHA-1."""
    return F.upper(F.substring(F.sha1(usr), 1, 16))


def unqualified(qualified: Column) -> Column:
    return F.substring_index(qualified, "::", -1)
