"""Operator 5, benchmark decontamination: a broadcast hash set of test n-grams.

Method: benchmark items give windows of ``width`` words (a shorter item is one window).
Their normalised words and window hashes are broadcast; every document is scanned once,
whole, with a rolling hash over its words, each hash hit is verified word by word, and the
hit words are counted, so spans or documents can be removed.

Bound: a broadcast holds at most ``max_words`` benchmark words, counted first. A larger
benchmark is cut into blocks of whole items (a hash of the item decides its block), the
documents are scanned with every block, and the hits of a document are merged. The result is
the same.

Cases: null texts have no words; items without words have no window; items with equal windows
are all reported; a null item_id is reported as the empty string; repeated documents are
judged alike; an empty benchmark or document table gives clean or no rows. Other columns are
not read.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, quoted, read

WIDTH = 10
#: Bound of one broadcast, in benchmark words (about 100 bytes each once hashed).
MAX_BROADCAST_WORDS = 2_000_000

#: A-Z lower-cased; 0-9, a-z and all bytes of non-ASCII characters stay; the rest separates.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
              for c in range(256))
MULTIPLIER = 0x9E3779B97F4A7C15


def normal_words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(TABLE).split() if text else []


class WindowIndex:
    """Windows of some benchmark items: vocabulary, items by window, hashes by length."""

    def __init__(self, vocabulary: dict[bytes, int], items: dict[bytes, set[str]], by_length: dict[int, np.ndarray]):
        self.vocabulary, self.items, self.by_length = vocabulary, items, by_length

    @classmethod
    def parts(cls, benchmark: list[tuple[str, str | None]], width: int) -> tuple[dict, dict, dict]:
        """The arguments of an index (plain values, to be broadcast)."""
        vocabulary: dict[bytes, int] = {}
        items: dict[bytes, set[str]] = {}
        lengths: dict[int, set[int]] = {}
        for item, text in benchmark:
            w = normal_words(text)
            if not w:
                continue
            ids = np.fromiter((vocabulary.setdefault(x, len(vocabulary) + 1) for x in w), np.uint64, len(w))
            n = min(width, len(w))
            for i, h in enumerate(cls.hashes(ids, n).tolist()):
                lengths.setdefault(n, set()).add(h)
                items.setdefault(b" ".join(w[i:i + n]), set()).add(item)
        return vocabulary, items, {n: np.array(sorted(x), np.uint64) for n, x in lengths.items()}

    @staticmethod
    def hashes(ids: np.ndarray, n: int) -> np.ndarray:
        h = np.zeros(len(ids) - n + 1, np.uint64)
        for k in range(n):
            h = h * np.uint64(MULTIPLIER) + ids[k:len(ids) - n + 1 + k]
        return h

    def scan(self, text: str | None) -> tuple[int, np.ndarray, set[str]]:
        """Number of words, which of them are hit, items with an occurring window."""
        w = normal_words(text)
        hit, found = np.zeros(len(w), bool), set()
        get = self.vocabulary.get
        ids = np.fromiter((get(x, 0) for x in w), np.uint64, len(w))
        for n, known in self.by_length.items():
            if len(w) < n:
                continue
            # only windows without an unknown word can occur
            unknown = np.concatenate(([0], np.cumsum(ids == 0)))
            starts = np.flatnonzero(unknown[n:] == unknown[:-n])
            if not len(starts):
                continue
            h = self.hashes(ids, n)[starts]
            for i in starts[np.isin(h, known)].tolist():
                items = self.items.get(b" ".join(w[i:i + n]))
                if items:
                    hit[i:i + n] = True
                    found |= items
        return len(w), hit, found


def _blocks(benchmark: DataFrame, max_words: int) -> list[DataFrame]:
    """The benchmark in blocks of about half of ``max_words`` words each, by item hash."""
    words = F.size(F.split(F.coalesce("text", F.lit("")), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"))
    total = benchmark.select(F.sum(words)).first()[0] or 0
    n = max(1, math.ceil(2 * total / max_words)) if total > max_words else 1
    if n == 1:
        return [benchmark]
    return [benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) for k in range(n)]


def scan_documents(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH,
                   max_words: int = MAX_BROADCAST_WORDS) -> DataFrame:
    """``docs`` plus ``scan``: struct of n_words, hits (start, end word of each hit run, as
    arrays) and items (sorted ids with an occurring window)."""
    sc = docs.sparkSession.sparkContext
    kind = "struct<n_words:bigint,starts:array<int>,ends:array<int>,items:array<string>>"
    bench = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text")

    def scanner(index):
        @F.pandas_udf(kind)
        def scan(texts: pd.Series) -> pd.DataFrame:
            rows, windows = [], WindowIndex(*index.value)
            for text in texts:
                n, hit, items = windows.scan(text)
                edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
                rows.append((n, edge[::2].tolist(), edge[1::2].tolist(), sorted(items)))
            return pd.DataFrame(rows, columns=["n_words", "starts", "ends", "items"])
        return scan

    indexes = [sc.broadcast(WindowIndex.parts([tuple(r) for r in block.toLocalIterator()], width))
               for block in _blocks(bench, max_words)]
    columns = [scanner(index)(F.col("text")) for index in indexes]
    out = docs.withColumn("_scans", F.array(*columns))
    if len(columns) == 1:
        return out.withColumn("scan", F.col("_scans")[0]).drop("_scans")

    @F.pandas_udf(kind)
    def merge(scans: pd.Series) -> pd.DataFrame:
        rows = []
        for parts in scans:
            n = parts[0]["n_words"]
            hit = np.zeros(n, np.int8)
            for p in parts:
                for a, b in zip(p["starts"], p["ends"], strict=True):
                    hit[a:b] = 1
            edge = np.flatnonzero(np.diff(np.concatenate(([0], hit, [0]))))
            rows.append((n, edge[::2].tolist(), edge[1::2].tolist(), sorted({x for p in parts for x in p["items"]})))
        return pd.DataFrame(rows, columns=["n_words", "starts", "ends", "items"])

    return out.withColumn("scan", merge("_scans")).drop("_scans")


def decontamination_digest(docs: DataFrame, benchmark: DataFrame, **params) -> DataFrame:
    d = scan_documents(docs.select("doc_id", "text"), benchmark, **params).select("doc_id", "scan")
    n_hit = F.aggregate(F.arrays_zip("scan.starts", "scan.ends"), F.lit(0).cast("long"),
                        lambda a, x: a + x["ends"] - x["starts"])
    d = d.select("doc_id", F.col("scan.n_words").alias("n_words"), n_hit.alias("n_hit"),
                 F.col("scan.items").alias("items"))
    return d.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def remove_documents(docs: DataFrame, benchmark: DataFrame, **params) -> DataFrame:
    """The documents without any hit word, with their columns as they are."""
    own = docs.columns
    d = scan_documents(docs.select(F.struct(*map(quoted, own)).alias("own"), "text"), benchmark, **params)
    return d.where(F.size("scan.starts") == 0).select("own.*")


def remove_spans(docs: DataFrame, benchmark: DataFrame, **params) -> DataFrame:
    """All documents with the hit words cut out of ``text`` (from the first character of a
    run's first word to the last of its last word); other columns stay."""
    own = docs.columns
    d = scan_documents(docs.select(F.struct(*map(quoted, own)).alias("own"), "text"), benchmark, **params)

    @F.pandas_udf("string")
    def without(texts: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
        import re
        word = re.compile(rb"[^ ]+")
        out = []
        for text, a, b in zip(texts, starts, ends, strict=True):
            if text is None or not len(a):
                out.append(text)
                continue
            raw = text.encode("utf-8", "surrogatepass")
            at = [m.span() for m in word.finditer(raw.translate(TABLE))]
            kept, last = [], 0
            for x, y in zip(a, b, strict=True):
                kept.append(raw[last:at[x][0]])
                last = at[y - 1][1]
            out.append(b"".join([*kept, raw[last:]]).decode("utf-8", "surrogatepass"))
        return pd.Series(out, dtype=object)

    text = without("text", "scan.starts", "scan.ends")
    rows = d.select("own.*", text.alias(free_name(docs, "left")))
    return rows.select(*[quoted(free_name(docs, "left")).alias("text") if c == "text" else quoted(c) for c in own])


def op5_decontamination(spark, sf_dir: str) -> DataFrame:
    return decontamination_digest(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


_W = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP5_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id,
             regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_W}') AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item,
             regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_W}') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS g
       FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT rid, i, n, array_to_string(w[i:i + n - 1], ' ') AS g
       FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
hits AS (SELECT rid, i, n, item FROM dw JOIN bw USING (n, g)),
hw AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM hits) GROUP BY rid),
it AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY encode(item)) AS items
       FROM (SELECT DISTINCT rid, item FROM hits) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (rid) LEFT JOIN it USING (rid)
"""
