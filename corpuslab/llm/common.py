"""Helpers shared by the operators: reading, shared-folder tables, checked broadcasts, tokens.

Word rules that several operators share:
``SPACE_WORD`` words are runs of anything but ASCII white space (tab, line feed,
vertical tab, form feed, carriage return, space). ``bytes.split()`` splits on exactly
these six bytes, so the Python helpers work on UTF-8 bytes.
"""

from __future__ import annotations

import uuid

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.session import checkpoint_dir

#: ASCII white space as Spark string functions take it.
SPACE_CHARS = " \t\n\x0b\x0c\r"
SPACE_WORD = r"[^\x20\x09-\x0D]+"

#: A broadcast is hinted only for tables counted at or below this many rows.
MAX_BROADCAST_ROWS = 100_000

#: Distinct words a worker remembers before it starts afresh (bounds its memory).
MAX_CACHED_WORDS = 500_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared checkpoint folder and read it back.

    The files outlive lost executors, cut the lineage, and later readers prune columns.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to and read from the shared folder, to cut its lineage. A checkpoint
    would keep the constraints of its plan, and loops that join and rename pile these up until
    planning takes longer than the work."""
    return shared_table(df, "cut")


def broadcast_if_small(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """``df`` (materialised, narrow) with a broadcast hint if it has at most ``max_rows``
    rows; a larger one is joined by shuffle. The rows of the result are the same."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def quoted(column: str) -> Column:
    """The column of exactly this name, dots and backticks included."""
    return F.col("`" + column.replace("`", "``") + "`")


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with as many underscores behind it as make it a name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only (``lower`` would also change other alphabets)."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: Column) -> Column:
    """Array of the words of ``text``; null and blank texts have none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")) \
        .otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))


def n_words(text: Column) -> Column:
    """Number of words without building them."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(SPACE_WORD)).cast("long")


# ---------------------------------------------------------------- inside tasks


class WordIds(dict):
    """Word (bytes) -> 64-bit hash, remembered per worker up to a bound."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(self) >= MAX_CACHED_WORDS:
            self.clear()
        self[word] = value
        return value

    def of(self, tokens: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, tokens), np.uint64, len(tokens))


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser with good avalanche for 64-bit values (wraps modulo 2**64)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_hashes(ids: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``width`` word ids; fewer words make one
    run, no word none."""
    n = len(ids)
    if n == 0:
        return ids
    if n < width:
        width = n
    h = np.zeros(n - width + 1, np.uint64)
    for k in range(width):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + ids[k:n - width + 1 + k] + np.uint64(k + 1))
    return np.unique(h)

