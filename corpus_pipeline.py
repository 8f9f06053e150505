"""A training corpus from documents: each stage reads the Parquet that the stage before it wrote.

Defined cases, in every stage: an empty table gives an empty one; null or empty
texts are kept by the filters, have no personal data and no words to train on
(the mix takes none of them); equal rows are treated alike, but for near
duplicates, of which one row stays; ids may be null or repeat; columns of any
other name go along, whatever their names; texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerspark.llm import bpe, mixing, near_dedup, pii, toxicity
from ledgerspark.llm.common import forget, materialize, table


def _measured(docs: DataFrame) -> DataFrame:
    """n_chars, where there is one, follows the text."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def fresh(name: str, docs: DataFrame) -> str:
    """A column name that docs doesn't have."""
    while name in docs.columns:
        name += "_"
    return name


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects go; without labels its seed words alone decide."""
    score, toxic = fresh("score", docs), fresh("toxic", docs)
    scored = toxicity.score_documents(docs, table(spark, sf_dir, "labels"), names=(score, toxic))
    return scored.where(F.col(f"`{toxic}`") == 0).select(*[f"`{c}`" for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, that of the smallest id (a null id is the largest)."""
    return near_dedup.drop_near_duplicates(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data give way to the name of their kind; a null text stays null."""
    return _measured(pii.redact_documents(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks, in training order; a source that is null is one of its own."""
    return _measured(mixing.mix_documents(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian uint32) and their decoded text, of each row that the mix took."""
    coded = bpe.encode_documents(docs)
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("drop_toxic", drop_toxic),
    ("drop_near_duplicates", drop_near_duplicates),
    ("redact_personal_data", redact_personal_data),
    ("mix_sources", mix_sources),
    ("encode", encode),
]

#: The stages' verdicts come from trained models, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        done = materialize(stage(spark, docs, sf_dir), f"corpus-{name}")
        forget(docs)
        docs = done
    return docs
