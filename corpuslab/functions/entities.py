"""HTML entity decoding, once, after tag removal.

Spark has no built-in for the HTML5 entity table, so this is the one Python step
of the cleaning chain: an Arrow-batched ``pandas_udf`` over the entities of a text
(what ``html.unescape`` would match). The texts stay in the JVM, which cuts them at the
entities and puts them together again, so a worker holds entities only, whatever the texts'
size. It is marked non-deterministic so Catalyst evaluates it once
(a deterministic Python UDF used by both a filter and a projection runs twice);
put cheap filters that do not need it before the cleaning step.
"""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: the pattern of ``html.unescape``.
ENTITY = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"


def _unescape_series(s: pd.Series) -> pd.Series:
    known = {x: html.unescape(x) for x in {x for found in s if found is not None for x in found}}
    return pd.Series([None if found is None else [known[x] for x in found] for found in s], dtype=object)


_unescape = F.pandas_udf(_unescape_series, T.ArrayType(T.StringType())).asNondeterministic()


def unescape_html(c: Column) -> Column:
    """``c`` is referenced twice, so pass a column reference, not a long expression."""
    decoded = _unescape(F.regexp_extract_all(c, F.lit(ENTITY), 0))
    # a text has one piece more than entities
    return F.array_join(F.zip_with(F.split(c, ENTITY, -1), decoded, lambda piece, x: F.concat(piece, F.coalesce(x, F.lit("")))), "")
