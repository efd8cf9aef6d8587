"""A training corpus from documents: judged, deduplicated, decontaminated, without personal data, packed.

Each stage takes (spark, docs, folder), works on all that the stage before kept, and returns a
DataFrame that is written as Parquet and read again as the next stage's docs. All but the last
return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from mastwire.llm import jaccard, packing, pii, quality, templates
from mastwire.llm.store import saved, table


def judged(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the quality model does not reject; it is fitted on the labels' training fold."""
    return quality.keep(docs, table(spark, folder, "labels"))


def deduplicated(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group that five-word shingles link at 0.8 or more: the smallest doc_id."""
    return jaccard.first_of_each(docs, size=5, percent=80)


def decontaminated(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that hold no benchmark item, as it stands or with other values."""
    return templates.without_leaks(docs, table(spark, folder, "benchmark"))


def anonymous(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """All documents, personal data in their texts replaced by marks and n_chars counted anew."""
    return pii.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Token sequences of at most 4096: one row for each piece of a document, with its place."""
    return packing.pack(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality", judged),
    ("near duplicates", deduplicated),
    ("decontamination", decontaminated),
    ("personal data", anonymous),
    ("packing", packed),
]

#: SQL cannot express the fitted model, the templates or the search over bins.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = table(spark, folder, "documents")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, folder))
    return STAGES[-1][1](spark, docs, folder)
