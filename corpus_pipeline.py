"""A training-data pipeline over ``documents``: five stages, each written as Parquet and read as the next one's input.

A stage that drops documents judges each row by itself: repeated rows and rows of a doc_id with several texts are told
apart, rows without a doc_id take part, null texts are empty, an empty table stays empty, other columns stay as they are.

All but the last return the columns of ``documents``. ``ORACLE_SQL`` is None, as SQL can't
express the classifier chain or the encoder; the tests check every stage on planted rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factgraph.llm import decontaminate, jaccard_join, mixture, token_store, toxicity
from factgraph.llm.tables import bounded, saved, table

#: A column's name that no document has.
ROW = "_row of the stage"


def scanned(docs: DataFrame) -> bool:
    """Whether the rows come straight from files, in whose order they can be numbered again and again."""
    plan = docs._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() == "Project":
        plan = plan.child()
    return plan.nodeName() == "LogicalRelation" or plan.nodeName().startswith("Relation")


def numbered(docs: DataFrame) -> DataFrame:
    """The documents with a number for each row, ``ROW``: its place in the scan; rows that no scan gives are written first."""
    return (docs if scanned(docs) else saved(docs, "rows")).withColumn(ROW, F.monotonically_increasing_id())


def by_row(rows: DataFrame) -> DataFrame:
    """doc_id (the row's number) and text, for operators that tell documents apart by their doc_id."""
    return rows.select(F.col(ROW).alias("doc_id"), "text")


def without(rows: DataFrame, gone: DataFrame, columns: list[str]) -> DataFrame:
    """The rows whose number isn't among those of ``gone`` (doc_id)."""
    return rows.join(bounded(gone.select(F.col("doc_id").alias(ROW)).distinct()), ROW, "left_anti").select(*columns)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain rejects go."""
    chain, rows = toxicity.train(docs, table(spark, sf_dir, "labels")), numbered(docs)
    return without(rows, toxicity.assess(by_row(rows), chain).where("rejected"), docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones stays, the one of the smallest doc_id (rows without one last); five words and 80 %, op5's own contract is narrower."""
    rows = numbered(docs)
    groups = saved(jaccard_join.join(by_row(rows), k=5, percent=80).where("n_links > 0").select(F.col("doc_id").alias(ROW), "component_id"), "groups")
    # a component's first row, told by narrow columns and added up before they are sent
    own = groups.join(rows.select(ROW, F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", ROW).alias("place")), ROW)
    first = own.groupBy("component_id").agg(F.min("place").alias("place")).select(F.col(f"place.`{ROW}`").alias(ROW))
    return without(rows, groups.join(first, ROW, "left_anti").select(F.col(ROW).alias("doc_id")), docs.columns)


def contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    rows = numbered(docs)
    return without(rows, decontaminate.find(by_row(rows), table(spark, sf_dir, "benchmark", "item_id", "text")), docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix at target weights: whole passes over documents, and the words of partial ones."""
    return mixture.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids written as shards and read back: doc_id, start, n_tokens, ids_crc32."""
    import public_tokenizers

    return token_store.read(token_store.write(docs, public_tokenizers.path("byte_bpe_50k.json"), 2))


STAGES = [("toxicity", toxic), ("ngram_jaccard_join", near_duplicates), ("benchmark_decontamination", contaminated), ("source_mixture", mixed), ("token_store", tokens)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of the folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
