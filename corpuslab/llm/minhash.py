"""Operator 1, MinHash near-dedup.

Method: one-permutation hashing of a document's shingle set into ``BINS`` bins, optimal
densification (every empty bin takes the value of the first filled bin in its own fixed
random order), bands of ``ROWS`` bins as bucket keys, star-shaped candidate pairs (see
``stars``): every member of a bucket with its most central one. Exact confirmation on the full sets,
connected components. What the stars leave in buckets of several components is settled in families
of buckets that share members: a task takes two blocks of a family's sets, counts their overlaps
and passes on the smallest member that each reaches (see ``overlap.family_roots``), so that no
bucket gives a row for every pair of its members.

Recall: a pair of similarity ``s`` shares a bucket with probability 1 - (1 - s**6)**32, so it is
missed with 2.6e-7 at 0.85 and 6e-5 at 0.8. Small sets fill few bins, which makes bands depend
on each other; sets under 256 and 64 shingles therefore get two and four sketches of different
seeds. Sets too small to be linked with a different set get no key.

Scale: documents of one equal shingle set are one class from the start (two 64-bit hashes over
the set; pre-aggregated), so a third of all rows being copies of one text costs one node.
Only ids, sizes and keys are shuffled for the search; texts are read a second time for classes
that share a bucket, and only their sets are joined. Nothing but counts reaches the driver.

Cases: null, empty and blank texts have an empty set, are linked with nothing and are their own
component; rows with a null doc_id can't be named and are treated the same; rows sharing a
doc_id are one document, which links what any of its texts links; equal texts are linked whatever their length; an empty table gives an
empty table; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordIds, broadcast_if_small, cut, mix, quoted, read, shared_table, shingle_hashes
from .components import connected_components
from .overlap import blocked, family_roots
from .stars import shared_buckets, star_links

BANDS, ROWS = 32, 6
BINS = BANDS * ROWS
#: Sets under so many shingles get so many sketches.
SKETCHES = ((64, 4), (256, 2))
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
SEEDS = GOLDEN * np.arange(1, 9, dtype=np.uint64)
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def fill_order() -> np.ndarray:
    """For every bin, the order in which it looks for a filled bin (itself first)."""
    rng = np.random.default_rng(20240607)
    order = np.argsort(rng.random((BINS, BINS)), axis=1)
    return np.array([[i, *row[row != i]] for i, row in enumerate(order)])


def sketch_keys(shingles: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Bucket keys of a non-empty sorted set of 64-bit shingle hashes."""
    n = len(shingles)
    seeds = next((k for least, k in SKETCHES if n < least), 1)
    bands = np.arange(BANDS, dtype=np.uint64)
    keys = []
    for seed in range(seeds):
        g = np.sort(mix(shingles + SEEDS[seed]))[::-1]
        v = np.full(BINS, NONE)
        v[(g >> np.uint64(8)) % np.uint64(BINS)] = g  # descending: the smallest of a bin stays
        full = v != NONE
        if not full.all():
            empty = np.flatnonzero(~full)
            o = order[empty]
            v[empty] = v[o[np.arange(len(empty)), full[o].argmax(axis=1)]]
        v = v.reshape(BANDS, ROWS)
        k = mix(bands + np.uint64(seed * BANDS + 1))
        for j in range(ROWS):
            k = mix(k * GOLDEN + v[:, j])
        keys.append(k)
    return np.concatenate(keys)


def linkable(n: int, percent: int) -> bool:
    """Whether a set of ``n`` can reach the threshold with a different set at all."""
    return 100 * n >= percent * (n + 1)


def _set_of(text: str | None, ids: WordIds, width: int) -> np.ndarray:
    return shingle_hashes(ids.of((text or "").encode("utf-8", "surrogatepass").lower().split()), width)


def _signed(x: int) -> int:
    x &= (1 << 64) - 1
    return x - (1 << 64) * (x >> 63)


def sketches(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """``(doc_id, n, h1, h2, keys)`` of every document; ``h1, h2`` identify its set."""

    @F.pandas_udf("struct<n:bigint,h1:bigint,h2:bigint,keys:array<bigint>>")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        ids, order = WordIds(), fill_order()
        for batch in texts:
            rows = []
            for text in batch:
                s = _set_of(text, ids, width)
                n = len(s)
                keys = sketch_keys(s, order).view(np.int64) if n and linkable(n, percent) else None
                rows.append((n, _signed(int(mix(s).sum())), _signed(int(mix(s ^ GOLDEN).sum()) + n), keys))
            yield pd.DataFrame(rows, columns=["n", "h1", "h2", "keys"])

    return docs.select("doc_id", run("text").alias("s")).select("doc_id", "s.*")


def shingle_sets(docs: DataFrame, width: int) -> DataFrame:
    """``(node, shingles)``: the sorted 64-bit hashes of a document's set, as bytes."""

    @F.pandas_udf("binary")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        ids = WordIds()
        for batch in texts:
            yield pd.Series([_set_of(x, ids, width).tobytes() for x in batch], dtype=object)

    return docs.select(F.col("doc_id").alias("node"), run("text").alias("shingles"))


def set_links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sets reach ``percent`` of their union."""

    @F.pandas_udf("boolean")
    def linked(a: pd.Series, b: pd.Series) -> pd.Series:
        out = np.zeros(len(a), bool)
        for i, (x, y) in enumerate(zip(a, b, strict=True)):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = np.sort(np.concatenate((x, y)))
            inter = int((both[1:] == both[:-1]).sum())
            out[i] = 100 * inter >= percent * (len(both) - inter)
        return pd.Series(out)

    size = F.length("shingles")
    one = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"), size.alias("na"))
    two = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"), size.alias("nb"))
    near = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    sizes = pairs.join(one.select("a", "na"), "a").join(two.select("b", "nb"), "b").where(near)
    full = sizes.select("a", "b").distinct().join(one, "a").join(two, "b")
    return full.where(linked("sa", "sb")).select("a", "b")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``(doc_id, n_shingles, component_id)``, one row per row of ``docs``."""
    d = shared_table(sketches(docs, width, percent), "minhash-sketches")
    named = d.where("n > 0 and doc_id is not null")
    classes = shared_table(named.groupBy("h1", "h2").agg(
        F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("rows"), F.first("keys").alias("keys")), "minhash-classes")
    keys = classes.where("keys is not null").select(F.explode("keys").alias("key"), F.col("rep").alias("node"))
    members = cut(shared_buckets(keys))
    nodes = cut(members.select(F.col("node").alias("doc_id")).distinct())
    texts = cut(named.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"), F.min("h1").alias("one"), F.max("h1").alias("two"))
                .where("rows > 1"))
    repeated = texts.limit(1).count() > 0
    wanted = docs.where("doc_id is not null").select("doc_id", "text").join(
        broadcast_if_small(nodes), "doc_id", "left_semi")
    wanted = wanted.distinct() if repeated else wanted  # copies of a row give one set
    sets = shared_table(shingle_sets(wanted, width), "minhash-sets")

    def finish(left: DataFrame) -> DataFrame:
        first = cut(left.groupBy("key").agg(F.min("node").alias("a")))
        near = left.join(first, "key").where("a <> node").select("a", F.col("node").alias("b")).distinct()
        family = cut(connected_components(near).withColumnRenamed("root", "family"))
        rows = sets.withColumnRenamed("shingles", "hashes").join(cut(blocked(family, family)), "node")
        found = family_roots(shared_table(rows, "minhash-families"), percent)
        return cut(found.select(F.col("root").alias("a"), F.col("node").alias("b")))

    links, roots = star_links(members, lambda pairs: set_links(pairs, sets, percent), finish)
    if repeated:  # the sets of one doc_id belong together
        own = named.join(texts.where("one <> two").select("doc_id"), "doc_id").select("doc_id", "h1", "h2") \
            .join(classes.select("h1", "h2", "rep"), ["h1", "h2"])
        own = own.select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
        roots = cut(connected_components(links.unionByName(own)))
    merged = (classes.select("h1", "h2", "rep", "rows").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
              .where("rows > 1 or root is not null").select("h1", "h2", F.coalesce("root", "rep").alias("component")))
    out = d.select("doc_id", "n", "h1", "h2").join(cut(merged), ["h1", "h2"], "left")
    own = (F.col("n") == 0) | F.col("doc_id").isNull()
    return out.select("doc_id", F.col("n").alias("n_shingles"),
                      F.when(own, F.col("doc_id")).otherwise(F.coalesce("component", "doc_id")).alias("component_id"))


def remove_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group (the smallest doc_id) with its columns; of rows sharing
    doc_id and text one stays. Rows without words or doc_id stay."""
    own = [quoted(c) for c in docs.columns]
    found = shared_table(near_duplicates(docs, width, percent), "minhash-groups")
    gone = cut(found.where("component_id <> doc_id").select("doc_id").distinct())
    again = cut(found.where("doc_id is not null and n_shingles > 0").groupBy("doc_id").count().where("count > 1")
                .select("doc_id"))
    kept = docs.join(broadcast_if_small(gone), "doc_id", "left_anti").select(*own)
    if again.limit(1).count() == 0:
        return kept
    repeated = broadcast_if_small(again)
    return (kept.join(repeated, "doc_id", "left_anti")
            .unionByName(kept.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])).select(*own))


def op1_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    """Links on 3-word shingles at 85 % of the union."""
    d = near_duplicates(read(spark, sf_dir, "documents"), width=3, percent=85)
    return d.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
