"""Cleaning as a DataFrame operator: the T1-T23 chain in a few projections.

The chain is split where an intermediate value is referenced more than once
(the fixpoint guards and the per-profile link step), so each intermediate is a
column reference and Catalyst does not duplicate the expression tree. All
projections are narrow: no shuffle, one pass per partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.functions import text as tx
from corpuslab.functions.entities import unescape_html
from corpuslab.profiles import ENGLISH, Profile

_TMP = "__clean"


def clean_text(df: DataFrame, col: str = "text", out: str | None = None,
               prof: Profile = ENGLISH, lang_col: str | None = None,
               profiles: dict[str, Profile] | None = None,
               decode_entities: bool = True) -> DataFrame:
    """Replace (or add, with ``out``) the cleaned text column."""
    out = out or col
    lang = F.col(lang_col) if lang_col else None
    c = F.col(_TMP)
    d = df.withColumn(_TMP, tx.fixpoint_head(F.col(col), tx.TEMPLATE_INNER))
    d = d.withColumn(_TMP, tx.fixpoint_head(
        tx._sub(tx._sub(tx.fixpoint_tail(c, tx.TEMPLATE_INNER, tx.TEMPLATE_PASSES - 3),
                        tx.TEMPLATE_UNCLOSED), tx.TEMPLATE_LAZY),
        tx.TABLE_INNER))
    d = d.withColumn(_TMP, tx._sub(tx._sub(tx.fixpoint_tail(c, tx.TABLE_INNER, tx.TABLE_PASSES - 3),
                                           tx.TABLE_LAZY), tx.TABLE_ROW_LINE))
    links = tx.remove_media_links(c, prof, lang, profiles)
    links = tx._sub(tx._sub(tx._sub(links, tx.INTERNAL_LINK, "$1"), tx.EXTERNAL_LINK_LABEL, "$1"),
                    tx.EXTERNAL_LINK_BARE)
    d = d.withColumn(_TMP, tx.remove_tags(links))
    # T12-T23 as the single element of a generator: a filter on the cleaned text
    # cannot be pushed below a Generate, so Catalyst does not inline the T13-T23
    # chain into every filter predicate (it would evaluate it once per reference).
    tail = tx.clean_after_entities(unescape_html(c) if decode_entities else c)
    keep = [x for x in d.columns if x != _TMP]
    d = d.select(*keep, F.explode(F.array(tail)).alias(_TMP))
    if out == col:
        return d.withColumn(col, c).drop(_TMP)
    return d.withColumnRenamed(_TMP, out)
