"""Explode operators: article -> paragraphs (P1), paragraph -> physical lines.

Both are generators inside one narrow stage; no shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.functions.text import strip
from corpuslab.operators.filters import paragraph_kept

PARAGRAPH_SEP = "\n\n"          # fixed value: paragraphs are split on a blank line
LINE_SEP = r"\r\n|\r|\n"         # Python text mode reads \r\n, \r and \n as line ends


def paragraphs(df: DataFrame, text_col: str = "text", keep: bool = True) -> DataFrame:
    """P1 (+F6): one row per kept paragraph, ``para_pos`` its position in the article,
    ``paragraph`` the stripped text. Other columns are carried along."""
    others = [c for c in df.columns if c != text_col]
    out = df.select(*others, F.posexplode(F.split(F.col(text_col), PARAGRAPH_SEP, -1))
                    .alias("para_pos", "paragraph"))
    out = out.withColumn("paragraph", strip(F.col("paragraph")))
    return out.where(paragraph_kept(F.col("paragraph"))) if keep else out


def physical_lines(df: DataFrame, text_col: str = "paragraph") -> DataFrame:
    """A written paragraph read back line by line (``line_pos`` within it)."""
    others = [c for c in df.columns if c != text_col]
    return df.select(*others, F.posexplode(F.split(F.col(text_col), LINE_SEP, -1))
                     .alias("line_pos", "line"))


def kept_paragraph_array(text):
    """P1 + F6 as one array expression per article."""
    parts = F.transform(F.split(text, PARAGRAPH_SEP, -1), lambda p: strip(p))
    return F.filter(parts, lambda p: paragraph_kept(p))


def article_line_array(text):
    """All physical lines of an article's kept paragraphs, in file order."""
    return F.flatten(F.transform(kept_paragraph_array(text),
                                 lambda p: F.split(p, LINE_SEP, -1)))


def line_sample(arts: DataFrame, n: int, order: str = "doc_id", by: list[str] | None = None,
                text_col: str = "text", num_partitions: int | None = None) -> DataFrame:
    """L2: the first ``n`` physical lines per group of the paragraph file, in file order.

    Only a narrow ``(group, order, line count)`` table is range-partitioned to find
    each article's first line number; at most ``n`` articles per group can start
    below ``n``, so that table is small for a small ``n`` (adaptive execution
    broadcasts it then). Only those articles are exploded.
    """
    from corpuslab.operators.order import with_running_sum

    by = list(by or ["lang"])
    a = arts.select(*by, order, article_line_array(F.col(text_col)).alias("__lines"))
    counts = a.select(*by, order, F.size("__lines").alias("__nl")).where(F.col("__nl") > 0)
    starts = with_running_sum(counts, [order], "__nl", by, "__start", num_partitions)
    starts = starts.where(F.col("__start") < n).select(*by, order, "__start")
    lines = a.join(starts, [*by, order]).select(
        *by, order, "__start", F.posexplode("__lines").alias("__pos", "line"))
    lines = lines.withColumn("line_no", F.col("__start") + F.col("__pos"))
    return lines.where(F.col("line_no") < n).select(*by, order, "line_no", "line")
