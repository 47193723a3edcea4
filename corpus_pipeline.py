"""A training-data pipeline over `documents`: rejects toxic texts, exact copies, near copies and repeated passages, and packs the rest.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; every stage but the last returns the columns
of documents. `run` writes each stage's result as Parquet in the shared checkpoint folder and reads it again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from brushwork.llm import exact, near, packing, substring, toxicity
from brushwork.llm.common import table
from brushwork.session import materialise


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, learned from `labels`, does not reject."""
    return toxicity.reject(docs, table(spark, sf_dir, "labels"))


def unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal text, up to white space, the one with the least id."""
    return exact.exact_dedup(docs)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies, the one with the least id."""
    return near.one_of_each(docs)


def unrepeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words under windows that occur twice or more."""
    return substring.without_repeats(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences."""
    return packing.pack(docs)


STAGES = [("toxicity", clean), ("exact_dedup", unique), ("near_dedup", distinct), ("substring_dedup", unrepeated), ("packing", packed)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        out = materialise(stage(spark, out, sf_dir), f"stage-{name}")
    return out


def queries():
    return {"pipeline": run}


def oracle_sql():
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
