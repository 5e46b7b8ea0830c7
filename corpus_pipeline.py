"""A corpus cleaning pipeline: each stage is one operator of ``corpuslab.llm``.

``run`` applies the stages to ``documents``; every stage reads what the one before wrote
(Parquet in the shared folder), so a lost executor costs at most one stage.

Cases: null, empty and blank texts have no words and fail the quality rules; a null doc_id, lang or
source is kept (a null doc_id is never a duplicate, a null source is a source); of rows with equal
doc_id and text near dedup keeps one, repeated lines of different documents go from the later one;
very long texts are taken whole; extra columns are carried along, whatever their names (the mix
adds `copy` and `copy_words` in place of columns of these names); an empty table gives an empty
table. Ties have no effect but in the mix, where places by hash decide.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpuslab.llm import decontamination, lines, minhash, mixing, quality
from corpuslab.llm.common import read, shared_table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a quality rule rejects go."""
    return quality.apply_rules(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier line (fuzzily) are cut out; all documents stay."""
    return lines.remove_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays (5-word shingles, 0.8)."""
    return minhash.remove_near_duplicates(docs, width=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark window go."""
    return decontamination.remove_documents(docs, read(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each repetition of a document that the source's target takes."""
    return mixing.repeat_documents(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("decontamination", decontaminate),
    ("mixing", mix),
]

#: Line and near dedup (similarity graphs) have no SQL form; tests hold a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = shared_table(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
