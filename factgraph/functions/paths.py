"""Paths: validity, classes, excluded directories, globs and scopes. A path is relative, with ``/`` and no ``..``."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values
EXCLUDED_DIRECTORIES = (".cache", ".git", ".hg", ".svn", "__pycache__", "build", "dist", "gen", "generated", "node_modules", "out", "target", "var")
SOURCE_EXTENSIONS = ("c", "cc", "cpp", "cxx", "m", "mm")
HEADER_EXTENSIONS = ("h", "hh", "hpp", "hxx", "inc")
TEST_DIRECTORIES = ("test", "tests")


def as_column(path: Column | str) -> Column:
    return F.col(path) if isinstance(path, str) else path


def valid(path: Column | str) -> Column:
    """Whether a path is canonical and stays below the root."""
    path = as_column(path)
    return (path != "") & ~path.rlike(r"^/|\\|//|/$|(^|/)\.{1,2}(/|$)|^[A-Za-z]:|[\x00-\x1f]")


def name(path: Column | str) -> Column:
    return F.substring_index(as_column(path), "/", -1)


def extension(path: Column | str) -> Column:
    """Lower-case text behind the last dot of the name; empty without one or for a leading dot alone."""
    return F.lower(F.regexp_extract(name(path), r"^.+\.([^.]+)$", 1))


def stem(path: Column | str) -> Column:
    return F.regexp_replace(name(path), r"^(.+)\.[^.]+$", "$1")


def directories(path: Column | str) -> Column:
    parts = F.split(as_column(path), "/")
    return F.slice(parts, 1, F.size(parts) - 1)


def file_type(path: Column | str) -> Column:
    """source, header, test or other; a test directory or name wins over the extension's class."""
    ext, low = extension(path), F.lower(stem(path))
    code = ext.isin(*SOURCE_EXTENSIONS, *HEADER_EXTENSIONS)
    test = F.exists(directories(path), lambda d: F.lower(d).isin(*TEST_DIRECTORIES)) | low.startswith("test_") | low.endswith("_test") | low.endswith("_unittest")
    return F.when(~code, "other").when(test, "test").when(ext.isin(*HEADER_EXTENSIONS), "header").otherwise("source")


def excluded_directory(path: Column | str) -> Column:
    """The first ancestor that scans leave out, or null."""
    return F.try_element_at(F.filter(directories(path), lambda d: F.lower(d).isin(*EXCLUDED_DIRECTORIES)), F.lit(1))


def _wildcards(pattern: str, star: str, one: str) -> str:
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        close = pattern.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out.append(star)
        elif c == "?":
            out.append(one)
        elif close > 0:
            body = pattern[i + 1 : close].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            out.append("[" + ("^" + body[1:] if body[0] == "!" else body.replace("^", "\\^", 1) if body[0] == "^" else body) + "]")
            i = close
        else:
            out.append(re.escape(c))
        i += 1
    return "".join(out)


def component_pattern(glob: str) -> str:
    """Regex of a glob matched from the right, component by component; no wildcard crosses ``/`` and ``**`` is one component."""
    return "(^|/)" + "/".join(_wildcards(part, "[^/]*", "[^/]") if part != "**" else "[^/]+" for part in glob.split("/")) + "$"


def whole_pattern(glob: str) -> str:
    """Regex of a glob over the whole path, whose ``*`` crosses ``/``."""
    return "^(?s:" + _wildcards(glob, ".*", ".") + ")$"


def matches_any(path: Column | str, patterns: list[str]) -> Column:
    """Whether one of the regexes matches; false for none."""
    return F.lit(False) if not patterns else as_column(path).rlike("|".join(f"(?:{p})" for p in patterns))


def in_scope(path: Column | str, scope: str) -> Column:
    """Whether a path is the scope's file or lies in its directory; ``.`` holds all."""
    path = as_column(path)
    return F.lit(True) if scope == "." else (path == scope) | path.startswith(scope + "/")
