"""Dump -> articles -> paragraphs -> stats (the first reference script as one Spark job).

Order of work: cheap title filters (F1, F4) -> cleaning (T1-T23) -> F2/F3 on the
cleaned text -> paragraphs (P1, F6). Everything is narrow; the only shuffles are
the final per-language aggregates (partial aggregation on the map side).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.operators.clean import clean_text
from corpuslab.operators.explode import kept_paragraph_array, paragraphs
from corpuslab.operators.filters import keep_titled_articles, keep_valid_cleaned
from corpuslab.profiles import ENGLISH, Profile

MB = 1_048_576  # fixed value: bytes per MB in the stats line


def articles(pages: DataFrame, prof: Profile = ENGLISH, lang_col: str | None = "lang",
             profiles: dict[str, Profile] | None = None) -> DataFrame:
    """Pages ``(…, title, text)`` -> valid cleaned articles, same columns."""
    kept = keep_titled_articles(pages, prof, lang_col, profiles)
    cleaned = clean_text(kept, "text", prof=prof, lang_col=lang_col, profiles=profiles)
    return keep_valid_cleaned(cleaned, prof, lang_col, profiles)


def article_paragraphs(arts: DataFrame) -> DataFrame:
    """P1 + F6 on cleaned articles."""
    return paragraphs(arts, "text")


def _sum_over(arr, fn):
    return F.aggregate(arr, F.lit(0).cast("bigint"), lambda acc, p: acc + fn(p).cast("bigint"))


def corpus_slice(arts: DataFrame) -> DataFrame:
    """Per language: articles, kept paragraphs, their characters and UTF-8 bytes.

    Paragraph figures are computed per article in one projection, then one
    grouped aggregate (partial on the map side) per language.
    """
    kept = F.col("kept")
    per_article = arts.select("lang", kept_paragraph_array(F.col("text")).alias("kept")).select(
        "lang",
        F.size(kept).alias("n_par"),
        _sum_over(kept, F.char_length).alias("n_chars"),
        _sum_over(kept, F.octet_length).alias("n_bytes"),
    )
    return per_article.groupBy("lang").agg(
        F.count("*").cast("bigint").alias("articles"),
        F.sum("n_par").cast("bigint").alias("paragraphs"),
        F.sum("n_chars").cast("bigint").alias("chars"),
        F.sum("n_bytes").cast("bigint").alias("bytes"),
    )


def corpus_stats(arts: DataFrame) -> DataFrame:
    """A1: article count and paragraph-file size in MB (one decimal), per language.

    Each written paragraph is followed by a newline, hence ``+ 1`` per paragraph.
    """
    kept = kept_paragraph_array(F.col("text"))
    per_article = arts.select("lang", _sum_over(kept, lambda p: F.octet_length(p) + 1)
                              .alias("file_bytes"))
    return per_article.groupBy("lang").agg(
        F.count("*").cast("bigint").alias("articles"),
        F.round(F.sum("file_bytes") / MB, 1).alias("paragraph_mb"),
    )
