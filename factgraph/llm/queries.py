"""One query for each operator, over its whole table; ``QUERIES`` and ``ORACLES`` are what ``__spark_entry__`` adds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factgraph.llm import alignment, bpe, decontaminate, jaccard_join, licenses, mixture, passages, periodic_runs, pitman_yor, quality, secrets_scan, token_store, toxicity
from factgraph.llm.tables import table


def op1_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and model scores of every document."""
    return pitman_yor.score(table(spark, sf_dir, "documents", "doc_id", "text"))


def op2_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages that each document shares with an earlier one."""
    return passages.passages(table(spark, sf_dir, "documents", "doc_id", "text"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best window of each contaminated document and benchmark item."""
    return decontaminate.find(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents, written as patched frame-of-reference shards and read back."""
    import public_tokenizers

    return token_store.read(token_store.write(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 2))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class, set size and number of links of every document."""
    return jaccard_join.join(table(spark, sf_dir, "documents", "doc_id", "text"))


def op6_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    return mixture.mix(table(spark, sf_dir, "documents", "doc_id", "source", "text")).drop("pieces", "code", "rows", "copy")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counters and the calibrated verdict for every document."""
    docs = table(spark, sf_dir, "documents")
    return quality.assess(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chain's chances and the verdict for every document."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return toxicity.assess(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confirmed license notices of every document."""
    return licenses.scan(table(spark, sf_dir, "documents", "doc_id", "text"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base findings and those that the network adds, for every document."""
    found = secrets_scan.candidates(table(spark, sf_dir, "documents", "doc_id", "text"))
    return secrets_scan.report(found, secrets_scan.train(found)).drop("n_added")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of runs, the strongest one, and digests of runs and collapsed words of every document."""
    found = periodic_runs.find(table(spark, sf_dir, "documents", "doc_id", "text"), planted=True)
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens, groups, links and corpus-wide counts of linked ids of every document."""
    import public_tokenizers

    return alignment.align(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and digest of the ids of every document, and the digest of what they decode to."""
    import public_tokenizers

    return bpe.digests(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {
    "op1_pitman_yor": op1_pitman_yor,
    "op2_passages": op2_passages,
    "op3_decontaminate": op3_decontaminate,
    "op4_token_store": op4_token_store,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_mixture": op6_mixture,
    "op7_toxicity": op7_toxicity,
    "op8_licenses": op8_licenses,
    "op9_quality": op9_quality,
    "op10_secrets": op10_secrets,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_alignment": op12_alignment,
    "op13_bpe": op13_bpe,
}
ORACLES: dict[str, str] = {}
