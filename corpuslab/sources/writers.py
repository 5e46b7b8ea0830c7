"""Sinks K1-K8. Every writer empties its target first (``overwrite``, K7)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_articles(df: DataFrame, path: str) -> None:
    """K1: ``{"id","title","text"}`` JSON lines per language, non-ASCII kept."""
    df.select("lang", "id", "title", "text").write.mode("overwrite").partitionBy("lang").json(path)


def write_lines(df: DataFrame, path: str, col: str = "paragraph", order: list[str] | None = None) -> None:
    """K2: one kept paragraph per record, newline-terminated, a folder per language
    (``lang=..``); with ``order``, files and lines in them follow it."""
    if order:
        df = df.repartitionByRange("lang", *order).sortWithinPartitions("lang", *order)
    df.select("lang", F.col(col).alias("value")).write.mode("overwrite").partitionBy("lang").text(path)


def write_shards(df: DataFrame, path: str) -> None:
    """K3: Parquet ``text`` per (lang, split, shard), rows in input order inside a file. Rows are
    dealt by ranges of the index, so a large shard (validation has one) is several files, whose
    names follow the order."""
    (df.repartitionByRange("lang", "split", "shard", "idx").sortWithinPartitions("lang", "split", "shard", "idx")
     .select("lang", "split", "shard", "text")
     .write.mode("overwrite").partitionBy("lang", "split", "shard").parquet(path))


def write_report(df: DataFrame, path: str) -> None:
    """K4: JSON report rows (struct columns nest)."""
    df.write.mode("overwrite").json(path)


def write_vocab(vocab: DataFrame, merges: DataFrame, path: str) -> None:
    """K6: vocabulary and merge tables, keyed by language."""
    vocab.write.mode("overwrite").partitionBy("lang").parquet(f"{path}/vocab")
    merges.write.mode("overwrite").partitionBy("lang").parquet(f"{path}/merges")


def write_tokens(coded: DataFrame, path: str) -> None:
    """K8: ``ids ARRAY<INT>`` per document, by language, variant (`bpe` or `byte`) and split."""
    (coded.select("lang", "variant", "split", "doc_id", "ids")
     .write.mode("overwrite").partitionBy("lang", "variant", "split").parquet(path))
