"""Operator 10, quality rules: a table of thresholds compiled into one Spark projection.

Method: text statistics (lengths, symbols, stop words, lines, repeated word windows) are
native expressions over the text and its word array; ``RULES`` is a table of
(name, value expression, lowest, highest); ``kept`` is the conjunction of its comparisons.
No user function, no shuffle, one pass: every row is judged from itself alone.

Cases: a null or blank text has no words and fails the base rule; ties, repeated rows and
extra columns change nothing (each row is judged alone, other columns are carried along by
``apply_rules``); an empty table gives an empty table; very long texts cost n log n.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CHARS, quoted, words

#: Function words of the four languages of the corpus.
STOP_WORDS = list(dict.fromkeys(("the of and to in is that it for was with as be by on not "
              "der die und den von zu das mit sich des auf für ist im dem nicht ein eine "
              "le la les de des et en un une du est que qui dans pour "
              "el los las y del se por con para una no su al").split()))

SYMBOLS = "[#*$%&|<>]"
WINDOW = 5

#: name, SQL over the statistics, lowest and highest value (either may be None).
RULES = (
    ("words", "n_words", 10, 200_000),
    ("repeated words", "100 * n_repeat_words / n_words", None, 20),
    ("symbols a word", "n_symbols / n_words", None, 0.1),
    ("characters a word", "word_chars / n_words", 2, 15),
    ("repeated lines", "n_dup_lines / n_lines", None, 0.5),
    ("words a line", "n_words / n_lines", None, 20_000),
    ("stop words of long texts", "if(n_words < 100, 1, n_stop / n_words)", 0.005, None),
)

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop")


def _repeat_words(sorted_windows: str, positions: str) -> tuple[Column, Column]:
    """Positions of windows equal to another one (from windows sorted by hash), and how
    many words such windows cover together."""
    s = F.col(sorted_windows)
    same = F.filter(s, lambda x, i: (F.when(i > 0, F.get(s, i - 1)["h"] == x["h"]).otherwise(False))
                    | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)))
    starts = F.sort_array(F.transform(same, lambda x: x["i"]))
    p = F.col(positions)
    covered = F.aggregate(
        F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW)))),
        F.lit(0).cast("long"), lambda a, x: a + x)
    return starts, covered


def with_statistics(docs: DataFrame, text: str = "text", prefix: str = "_q_") -> DataFrame:
    """All columns of ``docs`` plus ``{prefix}{stat}`` for every name of ``STATS`` (long)."""
    t, w = f"{prefix}t", f"{prefix}w"
    c = lambda name: F.col(prefix + name)
    spaced = F.coalesce(F.col(text), F.lit(""))
    out = docs.withColumn(t, spaced).withColumn(w, words(F.col(t)))
    lines = F.filter(F.split(F.col(t), "\n", -1), lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != "")
    wc = F.col(w)
    out = out.withColumns({f"{prefix}lines": lines, f"{prefix}h": F.transform(wc, lambda x: F.xxhash64(x))})
    # an array that a lambda visits is used more than once here, or the optimizer would move
    # its expression into the lambda and build it again for every element
    windows = F.slice(F.transform(c("h"), lambda x, i: F.xxhash64(F.slice(c("h"), i + 1, F.lit(WINDOW)))),
                      F.lit(1), F.greatest(F.size(c("h")) - WINDOW + 1, F.lit(0)))
    out = out.withColumn(f"{prefix}h", windows)
    # most texts repeat no window: a hash set tells, and only the others are sorted
    repeats = F.size(F.array_distinct(c("h"))) < F.size(c("h"))
    out = out.withColumn(f"{prefix}s", F.when(repeats, F.sort_array(F.transform(
        c("h"), lambda x, i: F.struct(x.alias("h"), i.alias("i"))))).otherwise(
        F.array().cast("array<struct<h:bigint,i:int>>")))
    starts, covered = _repeat_words(f"{prefix}s", f"{prefix}p")
    out = out.withColumn(f"{prefix}p", starts)
    values = {
        "n_words": F.size(wc), "word_chars": F.length(F.array_join(wc, "")),
        "n_symbols": F.regexp_count(F.col(t), F.lit(SYMBOLS)),
        "n_lines": F.size(c("lines")),
        "n_dup_lines": F.size(c("lines")) - F.size(F.array_distinct(c("lines"))),
        "n_repeat_words": covered,
        "n_stop": F.size(F.filter(wc, lambda x: F.lower(x).isin(STOP_WORDS))),
    }
    # a generator of one row: a filter on the statistics isn't pushed below it, where their
    # arrays would be built again for every element that a lambda visits
    stats = F.inline(F.array(F.struct(*[v.cast("long").alias(prefix + k) for k, v in values.items()])))
    return out.select(*map(quoted, docs.columns), stats)


def base_failed(prefix: str = "") -> Column:
    n, r = F.col(f"{prefix}n_words"), F.col(f"{prefix}n_repeat_words")
    return (n < 10) | (100 * r > 20 * n)


def verdict(prefix: str = "", rules=RULES) -> Column:
    """The rules as one boolean expression over the statistics."""
    ok = F.lit(True)
    for _, value, low, high in rules:
        for name in STATS:
            value = value.replace(name, f"`{prefix}{name}`") if prefix else value
        v = F.expr(value)
        if low is not None:
            ok = ok & (v >= low)
        if high is not None:
            ok = ok & (v <= high)
    return F.coalesce(ok, F.lit(False))


def quality_digest(docs: DataFrame, rules=RULES) -> DataFrame:
    """One row per document: its statistics, ``base_failed`` and ``kept``."""
    d = with_statistics(docs.select("doc_id", "text"), prefix="")
    return d.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "n_lines", "n_stop", base_failed().alias("base_failed"),
        F.when(base_failed(), False).otherwise(verdict(rules=rules)).alias("kept"))


def apply_rules(docs: DataFrame, rules=RULES) -> DataFrame:
    """The documents that every rule accepts, with their columns as they are."""
    prefix = "_q_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix = "_" + prefix
    d = with_statistics(docs, prefix=prefix)
    return d.where(~base_failed(prefix) & verdict(prefix, rules)).select(*map(quoted, docs.columns))


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    from .common import read
    return quality_digest(read(spark, sf_dir, "documents"))


_W = r"[^\x20\x09-\x0D]+"
_STOP_SQL = ", ".join(f"'{x}'" for x in STOP_WORDS)

OP10_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '{_W}') AS w FROM documents),
win AS (
  SELECT rid, i, array_to_string(w[i:i + 4], ' ') AS g
  FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
rep AS (
  SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt
  FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT rid, sum(least(5, coalesce(nxt - i, 5))) AS n FROM rep GROUP BY rid),
st AS (
  SELECT d.rid, doc_id, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_W}')) AS ls,
         coalesce(cov.n, 0) AS n_repeat_words,
         len(list_filter(w, lambda x: lower(x) IN ({_STOP_SQL}))) AS n_stop
  FROM d LEFT JOIN cov ON d.rid = cov.rid),
s AS (SELECT *, len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
             n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM st)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
       n_lines::BIGINT AS n_lines, n_stop::BIGINT AS n_stop, base_failed,
       CASE WHEN base_failed THEN false ELSE
         n_words <= 200000 AND n_symbols / n_words <= 0.1
         AND word_chars / n_words BETWEEN 2 AND 15 AND n_dup_lines / n_lines <= 0.5
         AND n_words / n_lines <= 20000
         AND CASE WHEN n_words < 100 THEN 1 ELSE n_stop / n_words END >= 0.005 END AS kept
FROM s
"""
