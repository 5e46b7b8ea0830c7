"""Articles -> documents -> train/val split -> numbered shards, plus counts (second script).

At scale, materialise ``docs`` once (a written table under the checkpoint
folder) before the split: the split scans its input three times, and every
later step (shards, word counts, token totals) reads the same labelled table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.operators import order as od
from corpuslab.operators.filters import doc_kept


def load_docs(articles: DataFrame, lang_col: str = "lang", ord_col: str = "doc_id") -> DataFrame:
    """S3 + F7: ``(lang, doc_id, text)``; missing text reads as ''; keep stripped length > 50."""
    d = articles.select(F.col(lang_col).alias("lang"), F.col(ord_col).alias("doc_id"),
                        F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return d.where(doc_kept(F.col("text")))


def split_docs(docs: DataFrame, seed: int = od.SPLIT_SEED, frac: float = od.VAL_FRACTION) -> DataFrame:
    """G3 per language."""
    return od.split_train_val(docs, "doc_id", ["lang"], seed, frac)


def assign_shards(split: DataFrame, docs_per_shard: int = od.DOCS_PER_SHARD, start: int = 0,
                  val_shard: int = od.VAL_SHARD, num_partitions: int | None = None) -> DataFrame:
    """G1 + G2: train docs numbered in input order per language and cut into shards;
    validation docs all go to ``val_shard``."""
    idx = od.with_global_index(split, ["doc_id"], ["lang", "split"], "idx", num_partitions)
    shard = F.when(F.col("split") == "val", F.lit(val_shard)).otherwise(
        od.shard_number(F.col("idx"), docs_per_shard, start, val_shard))
    return idx.withColumn("shard", shard.cast("int"))


def split_counts(split: DataFrame) -> DataFrame:
    """A2: loaded, train and validation counts per language, and the split percentage."""
    return split.groupBy("lang").agg(
        F.count("*").cast("bigint").alias("loaded"),
        F.sum(F.when(F.col("split") == "train", 1).otherwise(0)).cast("bigint").alias("train"),
        F.sum(F.when(F.col("split") == "val", 1).otherwise(0)).cast("bigint").alias("val"),
    ).withColumn("val_pct", F.round(F.col("val") * 100.0 / F.col("loaded"), 2))


def byte_totals(split: DataFrame) -> DataFrame:
    """A3: UTF-8 bytes per language and split, with per-language and grand totals (rollup)."""
    return split.rollup("lang", "split").agg(
        F.sum(F.octet_length("text")).cast("bigint").alias("bytes"),
        F.count("*").cast("bigint").alias("docs"),
    )


def match_token_budget(docs: DataFrame, n_col: str = "n_tokens", order: str = "doc_id",
                       by: str = "lang") -> DataFrame:
    """L3: cut every corpus to the smallest corpus's token total.

    Running token starts per language come from ``with_running_sum`` (no
    unpartitioned window); the budget is one row, attached by a broadcast on a
    constant key. Documents starting below the budget are kept; the boundary
    document keeps ``budget - start`` tokens (``kept_tokens``; slice ids with it).
    """
    starts = od.with_running_sum(docs, [order], n_col, [by], "start")
    budget = docs.groupBy(by).agg(F.sum(n_col).alias("tot")).agg(F.min("tot").alias("budget"))
    j = starts.withColumn("__k", F.lit(0)).join(
        F.broadcast(budget.withColumn("__k", F.lit(0))), "__k").drop("__k")
    return j.where(F.col("start") < F.col("budget")).withColumn(
        "kept_tokens", F.least(F.col(n_col), F.col("budget") - F.col("start")).cast("bigint"))
