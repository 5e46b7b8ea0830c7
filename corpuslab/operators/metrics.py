"""Aggregations A4-A6 (efficiency and comparison) and A8-A11 on runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab.functions.text import strip
from corpuslab.operators.filters import line_not_blank
from corpuslab.session import written_table

TRAIN_SAMPLE_LINES = 10_000  # fixed values: head sample sizes (training, evaluation)
EVAL_SAMPLE_LINES = 5_000


def efficiency(lines: DataFrame, count_tokens, by: list[str] | None = None,
               error: str = "no tokens produced") -> DataFrame:
    """A4: per group, after F8 on the sampled lines: ratios (4 dp, tokens/line 2 dp),
    totals, and an ``error`` row when no token was produced.

    ``count_tokens`` maps the stripped line Column to its token count Column.
    """
    by = list(by or ["lang"])
    s = stripped_lines(lines, by)
    per = s.select(*by, count_tokens(F.col("line")).cast("bigint").alias("t"), "line")
    return _ratios(_totals(per, by, F.sum("t").alias("total_tokens")), by, error)


def stripped_lines(lines: DataFrame, by: list[str] | None = None) -> DataFrame:
    """F8: the stripped lines that aren't blank, as measured."""
    return lines.select(*(by or ["lang"]), strip(F.col("line")).alias("line")).where(line_not_blank(F.col("line")))


def efficiency_learned(lines: DataFrame, tokens: DataFrame, by: list[str] | None = None,
                       error: str = "no tokens produced") -> DataFrame:
    """A4 on a learned vocabulary: ``lines`` are ``stripped_lines``, ``tokens`` the ``tokens`` of all of
    them per group (B5: frequencies of distinct words times their ids, so only words are shuffled)."""
    by = list(by or ["lang"])
    totals = _totals(lines, by).join(tokens.select(*by, F.col("tokens").alias("total_tokens")), by, "left") \
        .na.fill(0, ["total_tokens"])
    return _ratios(totals, by, error)


def _totals(lines: DataFrame, by: list[str], *more: Column) -> DataFrame:
    return lines.groupBy(*by).agg(
        *more, F.sum(F.char_length("line").cast("bigint")).alias("total_chars"),
        F.sum(F.octet_length("line").cast("bigint")).alias("total_bytes"), F.count("*").cast("bigint").alias("lines_processed"))


def _ratios(agg: DataFrame, by: list[str], error: str) -> DataFrame:
    ok = F.col("total_tokens") > 0

    def ratio(num: str, den: str, dp: int) -> Column:
        return F.when(ok, F.round(F.col(num) / F.col(den), dp))

    return agg.select(
        *by,
        ratio("total_bytes", "total_tokens", 4).alias("bytes_per_token"),
        ratio("total_chars", "total_tokens", 4).alias("chars_per_token"),
        ratio("total_tokens", "lines_processed", 2).alias("tokens_per_line"),
        F.when(ok, F.col("total_tokens")).alias("total_tokens"),
        F.when(ok, F.col("total_chars")).alias("total_chars"),
        F.when(ok, F.col("total_bytes")).alias("total_bytes"),
        F.when(ok, F.col("lines_processed")).alias("lines_processed"),
        F.when(~ok, F.lit(error)).alias("error"),
    )


def efficiency_report(eff: DataFrame, baseline: str, vocab_size: int) -> DataFrame:
    """K4: one record per language: its metrics with the vocabulary size, and the comparison with
    ``baseline`` (null for the baseline itself)."""
    eff = written_table(eff, "efficiency")
    c = compare(eff, baseline).select("lang", F.struct("baseline", "bytes_per_token_delta", "bytes_per_token_ratio").alias("comparison"))
    metrics = F.struct(*[x for x in eff.columns if x != "lang"], F.lit(vocab_size).alias("vocab_size"))
    return eff.select("lang", metrics.alias("metrics")).join(c, "lang", "left")


def efficiency_eval(lines: DataFrame, count_tokens, by: list[str] | None = None) -> DataFrame:
    """A5: the evaluation variant: three ratios and its own error text."""
    return eval_columns(efficiency(lines, count_tokens, by, error="no tokens"), by)


def eval_columns(e: DataFrame, by: list[str] | None = None) -> DataFrame:
    return e.select(*(by or ["lang"]), "bytes_per_token", "chars_per_token", "tokens_per_line", "error")


def compare(eff: DataFrame, baseline: str, lang_col: str = "lang") -> DataFrame:
    """Every other language against ``baseline``: delta and ratio of the already
    rounded bytes/token (4 dp); null when either side has no value."""
    eff = written_table(eff, "efficiency")  # both sides read a row a language, measured once
    # the baseline is one row per language table; join on a constant key
    base = eff.where(F.col(lang_col) == baseline).select(
        F.lit(1).alias("__k"), F.col("bytes_per_token").alias("base_bpt"))
    other = eff.where(F.col(lang_col) != baseline).select(F.lit(1).alias("__k"), lang_col,
                                                          "bytes_per_token")
    j = other.join(F.broadcast(base), "__k", "left")
    return j.select(
        F.lit(baseline).alias("baseline"), F.col(lang_col).alias(lang_col),
        F.round(F.col("bytes_per_token") - F.col("base_bpt"), 4).alias("bytes_per_token_delta"),
        F.round(F.col("bytes_per_token") / F.col("base_bpt"), 4).alias("bytes_per_token_ratio"),
    )
