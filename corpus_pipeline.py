"""A corpus pipeline of five stages, each written and read again as the next one's documents.

In every stage an empty table gives an empty result, null and empty texts and null ids are allowed, texts are read whole
however long they are, repeated rows are documents of their own, and columns of any name come through unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestar.llm.common import stored, table
from lodestar.llm.cotraining import drop_rejected
from lodestar.llm.decontamination import drop_contaminated
from lodestar.llm.line_dedup import without_recurring_lines
from lodestar.llm.mixing import mixed
from lodestar.llm.near_dedup import drop_near_duplicates


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; those without a word do too."""
    return drop_rejected(docs, table(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates are dropped, but for the first; a document stays, with what is left of its text."""
    return without_recurring_lines(docs, n_chars="n_chars")


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the smallest id, of repeated rows one. Documents without words stay."""
    return drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; those without text stay."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources at their target weights: a document appears as often as it is taken, so one without words goes."""
    return mixed(docs)


STAGES = [
    ("quality classifier", classify),
    ("line dedup", dedup_lines),
    ("MinHash near-dedup", dedup_documents),
    ("benchmark decontamination", decontaminate),
    ("source mix", mix_sources),
]

#: A trained classifier and edit distances are beyond SQL; the tests compare each stage with brute force or, for the
#: classifier, with the operator's scores, whose accuracy on labels held out is tested.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
