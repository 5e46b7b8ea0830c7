"""Operator 11, n-gram Jaccard join.

Method: a blocked sparse matrix product of the document by n-gram incidence matrix. Rows are the
different shingle sets, columns the n-grams.

1. Column blocks say which rows meet. Sets that reach the threshold differ in a number
   of n-grams that their sizes bound. The columns are cut into one block more, so
   two such rows agree in a whole column block: the key of a row is a block with its n-grams. Rows
   are keyed in size ranges a threshold apart, with their own and the next smaller one, so that
   both rows of a pair use the same cut. A key is about ten n-grams wide whatever the size, so
   unlike rows hardly ever share one, even those with a passage in common.
2. Rows that share keys form families (connected components over stars around a key's
   smallest row); all links lie inside families.
3. A family is dealt into row blocks of ``ROW_BLOCK``. A task owns a (row block, row block) cell: it
   accumulates overlap counts over slices of columns as products of incidence blocks, drops the
   pairs whose sizes or overlaps are below the bound, unites the rest and passes on the smallest
   row that each row reaches in the cell, not all pairs.
4. A family of one row block is done. In a larger one, first each block is a cell with itself, then
   one row of each component found, then all cells of the families that still have several.

All steps are exact on 64-bit hashes of n-grams; there is no cap. Equal sets are one row from the
start, so copies cost nothing. A family of K different sets that stay apart costs the cells of
K / ROW_BLOCK row blocks with each other, and its sets are sent to as many tasks.

Column blocks without an n-gram of a row agree with any other such row; their keys are cut again by
a second dealing of the columns.

Cases: null, empty and blank texts have an empty set, are linked with nothing and are their own
component; rows with a null doc_id can't be named and are treated the same; rows sharing a doc_id
are one document and link what their texts link; equal texts are linked whatever their length; very
long texts are taken whole; a similarity of exactly the threshold links; an empty table gives an
empty table; extra columns are not read.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordIds, broadcast_if_small, cut, mix, read, shared_table, shingle_hashes
from .components import connected_components

#: Rows of a block of a family, and columns whose products are accumulated at a time.
ROW_BLOCK = 256
COLUMNS = 4096
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
SECOND = np.uint64(0xD6E8FEB86659FD93)


def overlap_bound(a, b, percent: int):
    """The least common n-grams of linked sets of sizes ``a`` and ``b``: 100 i >= percent (a + b - i)."""
    return -((-percent * (a + b)) // (100 + percent))


class SizeRanges:
    """Ranges of set sizes such that linked sets lie in one range or in neighbouring ones."""

    def __init__(self, percent: int):
        self.percent, self.starts, self.counts = percent, [1], {}

    def of(self, n: int) -> int:
        """The range of a size."""
        while self.starts[-1] <= n:
            self.starts.append(self.starts[-1] * 100 // self.percent + 1)
        return bisect_right(self.starts, n) - 1

    def blocks(self, r: int) -> int:
        """Column blocks for linked sets of which the smaller is in range ``r``: one more than the
        n-grams that only one of them has."""
        if r not in self.counts:
            while len(self.starts) < r + 3:
                self.of(self.starts[-1])
            small = self.starts[r + 1] - 1
            large = min(self.starts[r + 2] - 1, small * 100 // self.percent)
            self.counts[r] = (small + large) * (100 - self.percent) // (100 + self.percent) + 1
        return self.counts[r]


def block_sums(hashes: np.ndarray, blocks: int, seed: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """Per column block a hash of the n-grams in it, and their number."""
    dealt = mix(hashes * SECOND + seed)
    block = (dealt >> np.uint64(32)) % np.uint64(blocks)
    order = np.argsort(block, kind="stable")
    edges = np.searchsorted(block[order], np.arange(blocks + 1, dtype=np.uint64))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(dealt + GOLDEN)[order], dtype=np.uint64)))
    return total[edges[1:]] - total[edges[:-1]], np.diff(edges)


def block_keys(hashes: np.ndarray, ranges: SizeRanges) -> np.ndarray:
    """Keys of a set: a hash of (size range, column block, n-grams in it) for both ranges of the set."""
    at, keys = ranges.of(len(hashes)), []
    for r in (at, at - 1):
        if r < 0:
            continue
        blocks = ranges.blocks(r)
        sums, filled = block_sums(hashes, blocks, np.uint64(r))
        names = mix(np.arange(blocks, dtype=np.uint64) * GOLDEN + np.uint64(r + 1))
        keys.append(mix(names * SECOND + sums)[filled > 0])
        for empty in names[filled == 0]:
            again, _ = block_sums(hashes, blocks, np.uint64(r) + GOLDEN)
            keys.append(mix(mix(names + empty) * GOLDEN + again))
    return np.concatenate(keys)


def _set_of(text: str | None, ids: WordIds, width: int) -> np.ndarray:
    return shingle_hashes(ids.of((text or "").encode("utf-8", "surrogatepass").lower().split()), width)


def _signed(x: int) -> int:
    x &= (1 << 64) - 1
    return x - (1 << 64) * (x >> 63)


def set_rows(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """``(doc_id, n, h1, h2, keys)`` of every row of ``docs``; ``h1, h2`` identify its set."""

    @F.pandas_udf("struct<n:bigint,h1:bigint,h2:bigint,keys:array<bigint>>")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        ids, ranges = WordIds(), SizeRanges(percent)
        for batch in texts:
            rows = []
            for text in batch:
                s = _set_of(text, ids, width)
                n = len(s)
                alone = 100 * n < percent * (n + 1)  # no other set is near enough
                rows.append((n, _signed(int(mix(s).sum())), _signed(int(mix(s ^ GOLDEN).sum()) + n),
                             None if alone else block_keys(s, ranges).view(np.int64)))
            yield pd.DataFrame(rows, columns=["n", "h1", "h2", "keys"])

    return docs.select("doc_id", run("text").alias("s")).select("doc_id", "s.*")


def wanted_sets(docs: DataFrame, wanted: DataFrame, width: int, repeated: bool) -> DataFrame:
    """``wanted`` (by ``node``) with the set of each of these documents as ``hashes``. A set counts
    once if its row is ``repeated``."""

    @F.pandas_udf("binary")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        ids = WordIds()
        for batch in texts:
            yield pd.Series([_set_of(x, ids, width).tobytes() for x in batch], dtype=object)

    rows = docs.where("doc_id is not null").select(F.col("doc_id").alias("node"), "text")
    if repeated:
        rows = rows.distinct()
    return rows.join(broadcast_if_small(wanted), "node").select(*wanted.columns, run("text").alias("hashes"))


def smallest_reached(pairs: np.ndarray, n: int) -> np.ndarray:
    """For each of 0 .. n - 1 the smallest that the links ``pairs`` reach, by a union-find."""
    parent = list(range(n))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    for a, b in pairs.tolist():
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return np.array([root(i) for i in range(n)], np.int64)


def linked_rows(sets: list[np.ndarray], other: np.ndarray, percent: int) -> np.ndarray:
    """The linked pairs of ``sets``: of a row not ``other`` with one that is, or of any two if none
    is. Overlap counts are sums of products of incidence blocks."""
    nothing = np.zeros((0, 2), np.int64)
    sizes = np.array([len(s) for s in sets], np.int64)
    order = np.argsort(sizes, kind="stable")
    rows, cols = (order[~other[order]], order[other[order]]) if other.any() else (order, order)
    if len(sets) < 2 or not len(rows) or not len(cols):
        return nothing
    if len(sets) == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return np.array([[0, 1]]) if both >= overlap_bound(sizes[0], sizes[1], percent) else nothing
    # columns that a single row has add nothing
    flat = np.concatenate(sets)
    at = np.repeat(np.arange(len(sets)), sizes)
    _, column, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = times > 1
    number = np.cumsum(shared) - 1
    keep = shared[column]
    column, at = number[column[keep]], at[keep]
    n_columns = int(shared.sum())
    place_row, place_col = np.full(len(sets), -1), np.full(len(sets), -1)
    place_row[rows], place_col[cols] = np.arange(len(rows)), np.arange(len(cols))
    exact = np.float32 if sizes.max() < 1 << 24 else np.float64  # for whole numbers of this size
    count = np.zeros((len(rows), len(cols)), exact)
    by_column = np.argsort(column, kind="stable")
    column, at = column[by_column], at[by_column]
    for first in range(0, n_columns, COLUMNS):
        lo, hi = np.searchsorted(column, [first, first + COLUMNS])
        c, r = column[lo:hi] - first, at[lo:hi]
        width = min(COLUMNS, n_columns - first)
        left, right = (np.zeros((len(x), width), exact) for x in (rows, cols))
        mine, theirs = place_row[r] >= 0, place_col[r] >= 0
        left[place_row[r[mine]], c[mine]] = 1
        right[place_col[r[theirs]], c[theirs]] = 1
        count += left @ right.T
    bound = overlap_bound(sizes[rows][:, None], sizes[cols][None, :], percent)
    i, j = np.nonzero(count >= bound)
    a, b = rows[i], cols[j]
    return np.stack((a, b), axis=1)[a != b]


def cell_roots(cells: DataFrame, percent: int) -> DataFrame:
    """``(node, root, whole)``: for the rows of each cell of ``(family, i, j, other, whole, node,
    hashes)`` that are linked with another one, the smallest node that links in the cell reach."""

    def run(cell: pd.DataFrame) -> pd.DataFrame:
        cell = cell[cell["hashes"].str.len() > 0].sort_values("node")  # a node may have an empty text too
        sets = [np.frombuffer(x, np.uint64) for x in cell["hashes"]]
        node = cell["node"].to_numpy()
        same = np.flatnonzero(node[1:] == node[:-1])  # several texts of one node
        pairs = np.concatenate((linked_rows(sets, cell["other"].to_numpy(bool), percent),
                                np.stack((same, same + 1), axis=1)))
        root = smallest_reached(pairs, len(sets))
        linked = np.bincount(root, minlength=len(sets))[root] > 1
        return pd.DataFrame({"node": node[linked], "root": node[root[linked]], "whole": cell["whole"].to_numpy()[linked]})

    kind = cells.schema["node"].dataType.simpleString()
    return cut(cells.groupBy("family", "i", "j").applyInPandas(run, f"node {kind}, root {kind}, whole boolean"))


def blocked(rows: DataFrame, family: DataFrame) -> DataFrame:
    """``rows`` with the number of row blocks of their family (counted in ``family``), and theirs."""
    n = family.groupBy("family").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") > ROW_BLOCK)
    blocks = F.ceil(F.col("members") / ROW_BLOCK).cast("int")
    n = cut(n.select("family", blocks.alias("blocks")))
    return rows.join(broadcast_if_small(n), "family", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))) \
        .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))


def square(rows: DataFrame, diagonal: bool) -> DataFrame:
    """The cells of all two row blocks of a family, or of each row block with itself; ``whole`` if
    that is all of the family."""
    if diagonal:
        return rows.select("family", F.col("block").alias("i"), F.col("block").alias("j"), F.lit(False).alias("other"),
                           (F.col("blocks") == 1).alias("whole"), "node", "hashes")
    spread = rows.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("with <> block")
    return spread.select("family", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"),
                         (F.col("block") > F.col("with")).alias("other"), F.lit(False).alias("whole"), "node", "hashes")


def family_roots(rows: DataFrame, percent: int) -> DataFrame:
    """``(node, root)`` of the linked nodes of ``rows(node, family, blocks, block, hashes)``: the
    smallest node that the links of the family reach."""
    first = cell_roots(square(rows, True), percent)
    rows = rows.where("blocks > 1")
    done = first.where("whole and node <> root").select("node", "root")
    if rows.limit(1).count() == 0:
        return done
    # one row of each component of a block, then whatever is still apart
    label = F.coalesce("root", "node").alias("label")
    inside = first.where("not whole").select("node", "root")
    members = cut(rows.select("node", "family").distinct().join(inside, "node", "left").select("node", "family", label))
    heads = members.where("node = label").select("node", "family")
    reps = rows.select("node", "hashes").join(cut(blocked(heads, heads)), "node")
    reps = shared_table(reps, "overlap-representatives")
    across = connected_components(cell_roots(square(reps, True).unionByName(square(reps, False)), percent)
                                  .select(F.col("node").alias("a"), F.col("root").alias("b")))
    members = members.join(across.select(F.col("node").alias("label"), "root"), "label", "left") \
        .select("node", "family", F.coalesce("root", "label").alias("label"))
    members = cut(members)
    apart = cut(members.groupBy("family").agg(F.min("label").alias("first"), F.max("label").alias("last"))
                .where("first <> last").select("family"))
    if apart.limit(1).count():
        rest = cell_roots(square(rows.join(broadcast_if_small(apart), "family", "left_semi"), False), percent)
        links = rest.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(
            members.select(F.col("node").alias("a"), F.col("label").alias("b")))
        return done.unionByName(connected_components(links))
    return done.unionByName(members.where("node <> label").select("node", F.col("label").alias("root")))


def jaccard_join(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``(doc_id, n_shingles, component_id)``, one row per row of ``docs``: documents whose shingle
    sets reach ``percent`` of their union are linked, ``component_id`` is the smallest doc_id
    that links reach."""
    d = shared_table(set_rows(docs, width, percent), "overlap-rows")
    named = d.where("n > 0 and doc_id is not null")
    classes = shared_table(named.groupBy("h1", "h2").agg(
        F.min("doc_id").alias("node"), F.max("doc_id").alias("last"), F.first("keys").alias("keys")), "overlap-classes")
    keys = classes.where("keys is not null").select(F.explode("keys").alias("key"), "node")
    stars = cut(keys.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a <> z").drop("z"))
    near = keys.join(stars, "key").where("a <> node").select("a", F.col("node").alias("b")).distinct()
    family = cut(connected_components(near).withColumnRenamed("root", "family"))
    texts = cut(named.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"), F.min("h1").alias("one"), F.max("h1").alias("two"))
                .where("rows > 1"))
    repeated = texts.limit(1).count() > 0
    sets = shared_table(wanted_sets(docs, cut(blocked(family, family)), width, repeated), "overlap-sets")
    roots = family_roots(sets, percent)
    if repeated:  # the sets of one doc_id belong together
        own = named.join(texts.where("one <> two").select("doc_id"), "doc_id").select("doc_id", "h1", "h2") \
            .join(classes.select("h1", "h2", "node"), ["h1", "h2"])
        links = own.select(F.col("doc_id").alias("a"), F.col("node").alias("b")).unionByName(
            roots.select(F.col("node").alias("a"), F.col("root").alias("b")))
        roots = connected_components(links)
    shown = classes.join(roots, "node", "left").where("node <> last or root is not null") \
        .select("h1", "h2", F.coalesce("root", "node").alias("component"))
    out = d.select("doc_id", "n", "h1", "h2").join(cut(shown), ["h1", "h2"], "left")
    alone = (F.col("n") == 0) | F.col("doc_id").isNull()
    return out.select("doc_id", F.col("n").alias("n_shingles"),
                      F.when(alone, F.col("doc_id")).otherwise(F.coalesce("component", "doc_id")).alias("component_id"))


def op11_ngram_join(spark, sf_dir: str) -> DataFrame:
    """Documents linked on 3-word shingles at 90 % of the union."""
    return jaccard_join(read(spark, sf_dir, "documents"), width=3, percent=90)
