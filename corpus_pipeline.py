"""The corpus pipeline: five operators of tidewatch.llm over documents, each stage on all that the one before it kept.

Every stage takes (spark, docs, sf_dir), docs a table that can be read again, and returns a DataFrame, which is written
as Parquet and read as the next stage's docs. All stages but the last return the columns of documents.

In every stage extra columns, whatever their names, go along untouched (the last returns its own only), rows with a null
id are rows like others, and an empty table gives an empty table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import bpe, jaccard, mixing, pii, quality_fm, workspace
from tidewatch.llm.queries import MULTI_RANKS, held_out, table

#: A stage as SQL isn't possible: models, hash functions and a library's merges aren't SQL. tests/llm tests every stage.
ORACLE_SQL = None


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars follows the text where a stage rewrites it."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below 0.3 go; one at 0.3 stays. Null and empty texts are scored as such, a null
    n_chars counts as the training rows' mean, very long texts are scored whole, repeated rows alike; with no labelled
    row every score is 0.5 and all stay."""
    model = quality_fm.fit(docs, table(spark, sf_dir, "labels").where(~held_out()))
    return docs.where(quality_fm.score_of(docs, model) >= 0.3)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies stays: the first in the table. Null, empty and white texts are
    nobody's copies and all stay; very long texts are compared whole; of repeated rows one stays."""
    return jaccard.keep_first(docs)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to its kind in angle brackets; n_chars follows. Null and empty texts stay as they are, very
    long ones are searched whole, repeated rows change alike; spans that overlap go as one, under the longest's kind, the
    first of equally long ones."""
    return _counted(pii.redact(docs))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in code-point order, null last, weigh 5, 2, 1, repeating; documents repeat, or stay in part, as the mix takes
    them; n_chars follows. Texts without words, and those that no slot takes, go; very long texts are cut over many
    blocks; repeated rows are each a document of their own."""
    return _counted(mixing.mixed(docs, mixing.mix(docs, weights=(5, 2, 1))))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every whole text, however long, and whether they decode to it; a null text counts as empty. Repeated rows give
    repeated rows."""
    out = bpe.round_trip(docs, public_tokenizers.path(MULTI_RANKS), public_tokenizers.PATTERN, keep=("source", "lang"), decoded=False)
    return out.select("doc_id", "source", "lang", "n_tokens", "ids", F.col("exact").alias("decodes"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("private_data", private_data), ("mix", mix), ("tokens", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = workspace.materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
