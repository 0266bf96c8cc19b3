"""The corpus pipeline: quality rules, exact deduplication, near-deduplication, personal data, packing.

Every stage takes (spark, docs, sf_dir), works on all rows of ``docs`` and returns a DataFrame, which is written as
Parquet before the next stage reads it. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import exact, packing, pii, quality, simhash
from lodestone.llm.common import Scratch, table


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the likelihood-ratio threshold.

    Null, empty and blank texts fail the base rules; rows that repeat are judged alike, whatever their ids; a null id or other null column
    is no reason to go; an empty table stays empty. Columns are those of ``docs``."""
    return quality.keep_good(spark, docs, quality.fit(spark, docs, table(spark, sf_dir, "labels")))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id.

    Null texts equal empty ones; a null id loses to any other; rows that repeat the kept id and text stay with it; an empty table stays
    empty. Columns are those of ``docs``."""
    return exact.drop_duplicates(spark, docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the one with the smallest doc_id.

    Texts without words, null or not, are copies of each other; any id comes before a null one, ties of ids go by text hash; rows that
    repeat the kept id and text stay with it; an empty table stays empty. Columns are those of ``docs``."""
    return simhash.keep_one(spark, docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the personal data in their texts masked.

    A null text stays null and an empty one empty; repeated rows and null ids keep their rows; an empty table stays empty. Columns are
    those of ``docs``."""
    return pii.redact(spark, docs)


def batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each document in the padded batches.

    A null text has the length of an empty one; repeated rows and null ids have places of their own, told apart by length and text; an empty
    table gives an empty result. Columns are those of ``packing.pack``."""
    return packing.pack(spark, docs)


STAGES = [("quality rules", rules), ("exact dedup", exact_copies), ("simhash near-dedup", near_copies), ("personal data", personal_data), ("packing", batches)]
#: The stages include a fitted model, SimHash and a dynamic program, which SQL does not express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        docs = out if i == len(STAGES) - 1 else scratch.save(out, f"stage{i}")
    return docs
