"""File scans and inventories through Spark's own readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factgraph.functions import paths


def scan(spark: SparkSession, root: str, include: list[str] | None = None, exclude: list[str] | None = None, types: list[str] | None = None) -> DataFrame:
    """path, content (binary), length, modified of the files below a root, by path; excluded directories and links out of it aren't entered."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.split("://", 1)[-1].rstrip("/") + "/"
    rows = raw.select(F.substring_index(F.col("path"), base, -1).alias("path"), "content", "length", F.col("modificationTime").alias("modified"))
    return filtered(rows, include, exclude, types).orderBy("path")


def filtered(files: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None, types: list[str] | None = None) -> DataFrame:
    """Valid paths outside excluded directories that an include pattern matches (if any are given), no exclude pattern does, of the types."""
    out = files.where(paths.valid("path") & paths.excluded_directory("path").isNull())
    if include:
        out = out.where(paths.matches_any("path", [paths.whole_pattern(g) for g in include]))
    if exclude:
        out = out.where(~paths.matches_any("path", [paths.whole_pattern(g) for g in exclude]))
    return out if types is None else out.where(paths.file_type("path").isin(*types) if types else F.lit(False))


def inventory(files: DataFrame) -> DataFrame:
    """path and SHA-256 of the content."""
    return files.select("path", F.sha2(F.col("content").cast("binary"), 256).alias("sha256"))


def text_files(files: DataFrame) -> DataFrame:
    """Binary files as text; content that isn't UTF-8 is left out."""
    text = F.col("content").cast("string")
    return files.where(F.is_valid_utf8(text)).select("path", text.alias("content"))


def depfile_rules(files: DataFrame) -> DataFrame:
    """Make dependency files (path, content) as rows target, dependency: lines joined at backslashes, escapes resolved."""
    flat = F.regexp_replace("content", r"\\\r?\n", " ")
    body = F.regexp_extract(flat, r"(?s)^(.*?):(?:\s+(.*))?$", 2)
    names = F.regexp_extract_all(body, F.lit(r"((?:\\.|[^\s\\])+)"), F.lit(1))
    return files.select("path", F.trim(F.regexp_extract(flat, r"(?s)^(.*?):(\s|$)", 1)).alias("target"), F.explode(names).alias("raw")).select("path", "target", F.regexp_replace("raw", r"\\(.)", "$1").alias("dependency"))


def compile_commands(spark: SparkSession, path: str) -> DataFrame:
    """Compilation database rows: directory, file, arguments; a row without arguments or command has none."""
    rows = spark.read.schema("directory string, file string, command string, arguments array<string>").json(path, multiLine=True)
    return rows.select("directory", "file", F.coalesce("arguments", F.split(F.trim("command"), r"\s+")).alias("arguments"))


def compile_contexts(rows: DataFrame) -> DataFrame:
    """tu (stable over equal contexts), source and how many contexts the source has."""
    tu = F.sha2(F.to_json(F.struct("file", "directory", "arguments")), 256)
    own = rows.select(tu.alias("tu"), F.col("file").alias("source")).distinct()
    return own.join(own.groupBy("source").agg(F.count("*").alias("contexts")), "source")
