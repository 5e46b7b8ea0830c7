"""Operator 12, periodic run detection.

Method: descending-LCP Kruskal, per text. The suffixes of a text are sorted by prefix doubling,
and the classes of suffixes with a common prefix are united by decreasing LCP with a union-find
whose classes are ordered sets of positions; the smaller set is merged into the larger. Two
positions i < j that a union at LCP l makes neighbours in the merged set are a seed if j - i <= l:
words i .. j + l - 1 then have period j - i.

Why the seeds are exact: let a run of length L and smallest period q start at a, L >= 2 q + q.
The suffixes at a and a + q have the LCP L - q >= 2 q, as the run ends there. A position between
them in a class of that LCP would shift a repeated block of q words by less than q, which only a
shorter period allows. So the two become neighbours when that LCP is reached, and the other way
round neighbours at distance d with an LCP of 2 d or more have smallest period d (else a position
between them had been in the class before). A seed whose words before i and j differ starts a run.
Runs of an exponent e have LCPs of (e - 1) q and, by the least length, of ``least_length`` - q; the
unions end at the least LCP that can seed one, so only words whose n-gram of that length occurs
twice in a text are sorted out at all.

Scale: each text is a job of its own inside a task; nothing is shuffled. Time is O(n log n) sorts and
set moves for n words; memory is a few arrays of a text's words, ordered sets in blocks, and one
batch of texts.

Cases: null, empty and blank texts have no words and no runs, and their collapsed text is empty; all
rows, repeated ones and those with a null doc_id included, are judged alone; very long texts are
taken whole; a longer run never hides one of another period, both are reported; of runs with equal
exponents the one with the smallest start, then period, is `best`; an empty table gives an empty
table; extra columns are carried along, and those named like a new column are replaced.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import MAX_CACHED_WORDS, free_name, mix, n_words, quoted, read, words

#: Positions of a block of an ordered set.
BLOCK = 1024
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
#: What a text has: the places of runs are word numbers from 0.
RESULT = "struct<n_words:bigint,runs:array<struct<start:bigint,length:bigint,period:bigint>>,best:int,collapsed:string>"


class Numbers(dict):
    """Word -> number, in order of appearance."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class Positions:
    """A set of positions in order, in blocks, so that an added position moves one block at most."""

    __slots__ = ("blocks", "firsts", "size")

    def __init__(self, position: int):
        self.blocks, self.firsts, self.size = [[position]], [position], 1

    def __iter__(self) -> Iterator[int]:
        return chain.from_iterable(self.blocks)

    def around(self, x: int) -> tuple[int, int]:
        """The neighbours before and after ``x``, which is not in the set; -1 if there is none."""
        b = max(bisect_right(self.firsts, x) - 1, 0)
        block = self.blocks[b]
        k = bisect_left(block, x)
        after = block[k] if k < len(block) else self.firsts[b + 1] if b + 1 < len(self.firsts) else -1
        return block[k - 1] if k else -1, after

    def add(self, x: int) -> None:
        b = max(bisect_right(self.firsts, x) - 1, 0)
        block = self.blocks[b]
        insort(block, x)
        self.firsts[b] = block[0]
        self.size += 1
        if len(block) > BLOCK:
            half = len(block) // 2
            self.blocks.insert(b + 1, block[half:])
            self.firsts.insert(b + 1, block[half])
            del block[half:]


def repeated(x: np.ndarray, width: int) -> np.ndarray:
    """Sorted positions whose run of ``width`` words occurs again (by hash, so some others too)."""
    n = len(x) - width + 1
    if n < 2:
        return np.zeros(0, np.int64)
    h = np.zeros(n, np.uint64)
    for k in range(width):
        h = mix(h * GOLDEN + x[k:n + k].astype(np.uint64) + np.uint64(k + 1))
    order = np.argsort(h, kind="stable")
    same = np.zeros(n + 1, bool)
    same[1:n] = h[order[1:]] == h[order[:-1]]
    return np.sort(order[same[:-1] | same[1:]])


def suffix_ranks(x: np.ndarray) -> np.ndarray:
    """The rank of each suffix of ``x`` in their order, by prefix doubling."""
    rank = np.unique(x, return_inverse=True)[1].astype(np.int64) + 1
    n, width = len(x), 1
    while True:
        after = np.zeros(n, np.int64)
        after[:n - width] = rank[width:]
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.empty(n, np.int64)
        new[order] = np.concatenate(([1], 1 + np.cumsum(key[1:] != key[:-1])))
        if new[order[-1]] == n or 2 * width >= n:
            return new - 1
        rank, width = new, 2 * width


def common_prefixes(x: list, rank: list, suffixes: list, at: list, least: int) -> list[tuple[int, int, int]]:
    """``(lcp, before, position)`` for the positions ``at`` (in order) that have ``least`` words or
    more in common with the suffix ``before`` them in the order of suffixes."""
    n, out, h, last = len(x), [], 0, -2
    for i in at:
        h = h - 1 if h and last == i - 1 else 0
        last = i
        if rank[i] == 0:
            h = 0
            continue
        j = suffixes[rank[i] - 1]
        most = n - max(i, j)
        while h < most and x[i + h] == x[j + h]:
            h += 1
        if h >= least:
            out.append((h, j, i))
    return out


def find_runs(x: np.ndarray, least_length: int = 6, least_exponent: int = 4) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of all runs of the numbers ``x`` by start, then period: maximal
    stretches of smallest period q and a length of ``least_length`` and ``least_exponent`` * q at least."""
    if least_exponent < 3:
        raise ValueError("least_exponent must be 3 or more")
    # the least LCP of a seed: length - q of the shortest run of a period q
    least = min(max(least_length, least_exponent * q) - q for q in range(1, least_length + 1))
    at = repeated(x, least)
    if not len(at):
        return []
    rank = suffix_ranks(x)
    suffixes = np.empty(len(x), np.int64)
    suffixes[rank] = np.arange(len(x))
    words = x.tolist()
    steps = common_prefixes(words, rank.tolist(), suffixes.tolist(), at.tolist(), least)
    steps.sort(key=lambda s: -s[0])
    parent: dict[int, int] = {}
    sets: dict[int, Positions] = {}

    def root(i: int) -> int:
        if i not in parent:
            parent[i], sets[i] = i, Positions(i)
            return i
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    runs = []

    def seed(i: int, j: int, lcp: int) -> None:
        d = j - i
        if lcp >= (least_exponent - 1) * d and lcp + d >= least_length and (i == 0 or words[i - 1] != words[j - 1]):
            runs.append((i, lcp + d, d))

    for lcp, a, b in steps:
        a, b = root(a), root(b)
        if a == b:
            continue
        if sets[a].size < sets[b].size:
            a, b = b, a
        large, small = sets[a], list(sets.pop(b))
        parent[b] = a
        for k, i in enumerate(small):
            before, after = large.around(i)
            if before >= 0 and (k == 0 or small[k - 1] < before):
                seed(before, i, lcp)
            if after >= 0 and (k + 1 == len(small) or small[k + 1] > after):
                seed(i, after, lcp)
        for i in small:
            large.add(i)
    return sorted(runs, key=lambda r: (r[0], r[2]))


def best_run(runs: list[tuple[int, int, int]]) -> int | None:
    """Index of the run of the greatest length / period; the first of equal ones."""
    best = None
    for k, (_, length, period) in enumerate(runs):
        if best is None or length * runs[best][2] > runs[best][1] * period:
            best = k
    return best


def periodic_runs(docs: DataFrame, text: str = "text", least_length: int = 6, least_exponent: int = 4) -> DataFrame:
    """``docs`` with ``n_words``, ``runs`` (by start, then period), ``best`` (index of the run of the
    greatest exponent, null without runs) and ``collapsed``: the words, joined by one space, without
    those that a run has after its first period."""

    @F.pandas_udf(RESULT)
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        numbers = Numbers()
        for batch in texts:
            rows = []
            for value in batch:
                tokens = (value or "").encode("utf-8", "surrogatepass").split()
                if len(numbers) > MAX_CACHED_WORDS:
                    numbers.clear()
                x = np.fromiter(map(numbers.__getitem__, tokens), np.int64, len(tokens))
                runs = find_runs(x, least_length, least_exponent)
                if runs:
                    kept = np.ones(len(tokens), bool)
                    for start, length, period in runs:
                        kept[start + period:start + length] = False
                    collapsed = b" ".join([tokens[i] for i in np.flatnonzero(kept).tolist()])
                else:
                    collapsed = b" ".join(tokens)
                rows.append((len(tokens), runs, best_run(runs), collapsed.decode("utf-8", "surrogatepass")))
            out = pd.DataFrame(rows, columns=["n_words", "runs", "best", "collapsed"])
            yield out.astype({"best": "Int32"})

    new = ["n_words", "runs", "best", "collapsed"]
    own = [quoted(c) for c in docs.columns if c.lower() not in new]
    found = free_name(docs, "found_runs")
    return docs.select(*own, run(quoted(text)).alias(found)).select(*own, f"{found}.*")


def planted(doc_id: Column, text: Column) -> Column:
    """``text``, for a tenth of the documents (by crc32 of the id) with a periodic end: word i >= a
    becomes word a + (i - a) % p. A null id or a text without words changes nothing."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def turned(w: Column) -> Column:
        a = (g % F.size(w)).cast("int")
        p = (1 + F.floor((F.size(w) - a) / (3 + g % 8))).cast("int")
        return F.transform(w, lambda x, i: F.when(i < a, x).otherwise(F.get(w, a + (i - a) % p)))

    # bound by an array of one, so that the words are split once and not for each of them
    changed = F.array_join(F.get(F.transform(F.array(words(text)), turned), 0), " ")
    return F.when((h % 10 == 0) & (n_words(text) > 0), changed).otherwise(text)


def op12_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """Digests of the runs and of the collapsed text of every document, a tenth of them made periodic."""
    # a generator of one row, so that the changed text is a column of its own before the Python step
    changed = F.explode(F.array(planted(F.col("doc_id"), F.col("text")))).alias("text")
    docs = read(spark, sf_dir, "documents").select("doc_id", changed)
    d = periodic_runs(docs)
    best = F.get("runs", "best")
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    return d.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"),
        best["length"].alias("length"), best["period"].alias("period"),
        F.call_function("div", 1000 * best["length"], best["period"]).alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
