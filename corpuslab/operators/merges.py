"""Learning byte-pair merges over a table of distinct words.

Greedy learning takes the most frequent pair, merges it in all words and starts again:
thousands of steps, each of which needs counts over all words. Here a round of Spark jobs
settles many steps at once, exactly:

1. *Count.* The counts of all pairs over all words. Two neighbouring symbols, however they were merged,
   were once the pair at the same place, so a pair that a later step makes is no more frequent than
   the pair it grew from. While the best count is ``t`` or more, no step merges across a pair of
   a count under ``t``.
2. *Cut.* So words are cut between the symbols of such pairs. Equal pieces are added up (most words
   share theirs), pieces of one symbol dropped. ``t`` is the lowest of some levels at which a language
   has no more than ``sample_words`` pieces, counted by a sample of their hashes; at the highest
   level only the most frequent pairs are left, and their pieces are few.
3. *Merge.* Greedy learning over the pieces, in a task a language, is that over all words down to a
   count of ``t``.
4. The steps are applied to the word table, and the next round starts from there.

The result is that of one step at a time, whatever the number of pieces: more only mean fewer
rounds, and one round if all words may be held. Order of steps: count desc, left id, right id.

What the driver holds is bounded by parameters: merges, and the ``MAX_PAIRS`` most frequent pairs a language.
Symbols 0-255 are bytes, merges get 256, 257, ...
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuslab.session import drop_table, written_table

#: Pieces of a language that its task may hold (about 0.8 kB each); changes the number of rounds only.
SAMPLE_WORDS = 600_000
#: Most frequent pairs of a language among which words may stay uncut, and those of the highest level;
#: a level has twice the pairs of the one above.
MAX_PAIRS, LEAST_PAIRS = 1 << 17, 8
#: One in so many hashes of pieces is counted.
HASHES = 64
#: Bits of a symbol id in packed pairs and steps (ids stay below 2 ** 20).
BITS = 20
MASK = (1 << BITS) - 1
#: Words up to so many symbols are searched step by step, longer ones with a heap.
SHORT_WORD = 24


@dataclass
class Merges:
    """Learned merges per language: ``lang -> [(left, right, new_id, count)]`` in rank order, and
    the byte symbols of its words."""
    merges: dict[str, list[tuple[int, int, int, int]]] = field(default_factory=dict)
    alphabet: dict[str, list[int]] = field(default_factory=dict)
    rounds: int = 0

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(lang, rank, *m) for lang, ms in self.merges.items() for rank, m in enumerate(ms)]
        return spark.createDataFrame(
            rows, "lang string, rank int, left_id int, right_id int, new_id int, freq bigint")


# ---------------------------------------------------------------- inside tasks


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser with good avalanche for 64-bit values (wraps modulo 2**64)."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def merge_word(s: list[int], ranks: dict[int, tuple[int, int]], changes: dict | None = None, weight: int = 0) -> list[int]:
    """``s`` after all merges of ``ranks`` (packed pair -> (step, new id)), lowest step first and
    left to right. With ``changes``, what each step does to pair counts is added there, by
    ``step + 1`` and packed pair."""
    n = len(s)
    if n < 2:
        return s
    if n > SHORT_WORD:
        return _merge_long(s, ranks, changes, weight)
    get = ranks.get
    while n > 1:
        best = None
        a = s[0]
        for b in s[1:]:
            found = get(a << BITS | b)
            if found is not None and (best is None or found < best):
                best, left, right = found, a, b
            a = b
        if best is None:
            break
        step, new = best
        out, i = [], 0
        while i < n:
            if i + 1 < n and s[i] == left and s[i + 1] == right:
                if changes is not None:
                    note(changes, step, out[-1] if out else -1, left, right, s[i + 2] if i + 2 < n else -1, new, weight)
                out.append(new)
                i += 2
            else:
                out.append(s[i])
                i += 1
        s, n = out, len(out)
    return s


def note(changes: dict, step: int, before: int, left: int, right: int, after: int, new: int, weight: int) -> None:
    """What merging one ``left right`` between ``before`` and ``after`` does to pair counts."""
    base = (step + 1) << 2 * BITS
    changes[base | left << BITS | right] += -weight
    if before >= 0:
        changes[base | before << BITS | left] += -weight
        changes[base | before << BITS | new] += weight
    if after >= 0:
        changes[base | right << BITS | after] += -weight
        changes[base | new << BITS | after] += weight


def _merge_long(s: list[int], ranks: dict[int, tuple[int, int]], changes: dict | None, weight: int) -> list[int]:
    """``merge_word`` for long words: places with a merge in a heap by (step, place), symbols in a
    linked list; time is n log n."""
    n = len(s)
    s = list(s)
    after, before = [*range(1, n), -1], list(range(-1, n - 1))
    heap = []

    def offer(i: int) -> None:
        j = after[i]
        if j >= 0:
            found = ranks.get(s[i] << BITS | s[j])
            if found is not None:
                heapq.heappush(heap, (found[0], i, s[i], s[j], found[1]))

    for i in range(n - 1):
        offer(i)
    while heap:
        step, i, left, right, new = heapq.heappop(heap)
        j = after[i]
        if s[i] != left or j < 0 or s[j] != right:
            continue  # changed since
        k, h = after[j], before[i]
        if changes is not None:
            note(changes, step, s[h] if h >= 0 else -1, left, right, s[k] if k >= 0 else -1, new, weight)
        s[i], s[j] = new, -1
        after[i] = k
        if k >= 0:
            before[k] = i
        offer(i)
        if h >= 0:
            offer(h)
    return [x for x in s if x >= 0]


def propose(words: list[list[int]], freqs: list[int], true: dict[int, int] | None, steps: int, first_id: int,
            min_freq: int) -> list[tuple[int, int]]:
    """The next ``steps`` pairs that greedy learning over ``words`` takes. ``true`` holds the counts
    of pairs over all words, if these are only some."""
    return [(a, b) for a, b, _ in greedy(words, freqs, true, steps, first_id, min_freq)]


def greedy(words: list[list[int]], freqs: list[int], true: dict[int, int] | None, steps: int, first_id: int,
           min_freq: int) -> list[tuple[int, int, int]]:
    """``propose`` with the pairs' counts: ``(left, right, count)``."""
    counts: dict[int, float] = defaultdict(int)
    where: dict[int, set[int]] = defaultdict(set)
    for k, (s, f) in enumerate(zip(words, freqs, strict=True)):
        for a, b in zip(s, s[1:]):
            counts[a << BITS | b] += f
            where[a << BITS | b].add(k)
    guess = counts if true is None else defaultdict(float, true)
    heap = [(-n, p) for p, n in guess.items()]
    heapq.heapify(heap)
    out = []
    while heap and len(out) < steps:
        n, pair = heapq.heappop(heap)
        n = -n
        if guess[pair] != n:
            continue  # changed since
        if n < min_freq or n == 0:
            break
        left, right, new = pair >> BITS, pair & MASK, first_id + len(out)
        out.append((left, right, n))
        ratio = 1 if true is None or counts[pair] <= 0 else n / counts[pair]
        changes: dict[int, int] = defaultdict(int)
        for k in where.pop(pair, ()):
            old = words[k]
            words[k] = s = merge_word(old, {pair: (-1, new)}, changes, freqs[k])
            if len(s) < len(old):
                for a, b in zip(s, s[1:]):
                    if a == new or b == new:
                        where[a << BITS | b].add(k)
        for p, change in changes.items():
            counts[p] += change
            if true is not None:
                guess[p] += change * ratio
            if guess[p] > 0:
                heapq.heappush(heap, (-guess[p], p))
        counts[pair] = guess[pair] = 0
    return out


class Pieces:
    """Pieces as flat arrays: the symbol at each place, the places before and after it (-1 at an end), and the frequency
    of the piece. A merge changes all its places at once. A pair's count is highest when its newer symbol is made, so the
    places of pairs of a count under ``least`` are not kept."""

    def __init__(self, flat: np.ndarray, lengths: np.ndarray, freqs: np.ndarray, least: int = 1):
        self.least = least
        n = len(flat)
        self.sym = flat.astype(np.int64)
        self.freq = np.repeat(freqs.astype(np.int64), lengths)
        at = np.arange(n, dtype=np.int32)
        ends = np.cumsum(lengths)
        some = lengths > 0
        self.after, self.before = at + np.int32(1), at - np.int32(1)
        self.after[ends[some] - 1] = self.before[(ends - lengths)[some]] = -1
        left = np.flatnonzero(self.after >= 0).astype(np.int32)
        pair = self.pairs(left)
        pairs, self.left, first, total = self.grouped(left)
        self.counts: dict[int, int] = dict(zip(pairs, total, strict=True))
        #: Places where a pair was at first, and where merges made it (some have changed since).
        self.span = dict(zip(pairs, zip(first, [*first[1:], len(left)])))
        self.made: dict[int, list[np.ndarray]] = defaultdict(list)

    def grouped(self, left: np.ndarray) -> tuple[list[int], np.ndarray, list[int], list[int]]:
        """The pairs at the places ``left``, the places by pair, where each pair's begin, and its frequency there."""
        if not len(left):
            return [], left, [], []
        pair = self.pairs(left)
        order = np.argsort(pair, kind="stable")
        pair, left = pair[order], left[order]
        first = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1])))
        return pair[first].tolist(), left, first.tolist(), np.add.reduceat(self.freq[left], first).tolist()

    def pairs(self, left: np.ndarray) -> np.ndarray:
        return self.sym[left] << BITS | self.sym[self.after[left]]

    def places(self, pair: int) -> np.ndarray:
        """Where ``pair`` is merged: its places from left to right, none within another."""
        start, end = self.span.pop(pair, (0, 0))
        at = np.concatenate((self.left[start:end], *self.made.pop(pair, ())))
        at = np.unique(at[self.after[at] >= 0])
        at = at[self.pairs(at) == pair]
        if pair >> BITS == pair & MASK and len(at):
            # in a run of one symbol every other place
            place = np.arange(len(at))
            starts = np.concatenate(([True], self.after[at[:-1]] != at[1:]))
            at = at[(place - np.maximum.accumulate(np.where(starts, place, 0))) % 2 == 0]
        return at

    def merge(self, pair: int, new: int) -> set[int]:
        """Merges ``pair`` everywhere; the other pairs whose counts have changed."""
        at = self.places(pair)
        right, before = self.after[at], self.before[at]
        old = np.concatenate((at, before[before >= 0], right[self.after[right] >= 0]))
        changed = self._add(np.unique(old), -1)
        after = self.after[right]
        self.sym[at], self.sym[right] = new, -1
        self.after[at], self.after[right] = after, -1
        self.before[after[after >= 0]] = at[after >= 0]
        before = self.before[at]
        changed |= self._add(np.unique(np.concatenate((at[after >= 0], before[before >= 0]))), 1, self.made)
        self.counts.pop(pair, None)
        return changed - {pair}

    def _add(self, left: np.ndarray, sign: int, made: dict | None = None) -> set[int]:
        pairs, left, first, total = self.grouped(left)
        for p, change in zip(pairs, total, strict=True):
            self.counts[p] = self.counts.get(p, 0) + sign * change
        if made is not None:
            for p, start, end in zip(pairs, first, [*first[1:], len(left)]):
                if self.counts[p] >= self.least:
                    made[p].append(left[start:end].copy())
        return set(pairs)


def greedy_pieces(flat: np.ndarray, lengths: np.ndarray, freqs: np.ndarray, steps: int, first_id: int,
                  min_freq: int) -> list[tuple[int, int, int]]:
    """``greedy`` over pieces that lie in ``flat`` one after the other."""
    pieces = Pieces(flat, lengths, freqs, min_freq)
    counts = pieces.counts
    heap = [(-n, p) for p, n in counts.items()]
    heapq.heapify(heap)
    out = []
    while heap and len(out) < steps:
        n, pair = heapq.heappop(heap)
        n = -n
        if counts.get(pair) != n:
            continue  # changed since
        if n < min_freq or n == 0:
            break
        changed = pieces.merge(pair, first_id + len(out))
        out.append((pair >> BITS, pair & MASK, n))
        for p in changed:
            if counts[p] > 0:
                heapq.heappush(heap, (-counts[p], p))
            else:
                del counts[p]
    return out


def first_beaten(counts: np.ndarray, pairs: np.ndarray, pair: np.ndarray, value: np.ndarray, start: np.ndarray,
                 end: np.ndarray) -> np.ndarray:
    """For each row the first step in ``start .. end`` at which ``pair`` with a count of ``value`` comes
    before the chosen of ``pairs`` with ``counts``; len(counts) if there is none."""
    n = len(counts)
    low = np.minimum.accumulate(counts)
    at = np.maximum(np.searchsorted(-low, -value, "left"), start)    # first step of a count of value or less
    under = np.maximum(np.searchsorted(-low, -value, "right"), start)  # and of less
    out = np.where(under <= end, under, n)
    for k in np.flatnonzero((at < under) & (at <= end)):
        tied = pairs[at[k]:min(under[k], end[k] + 1)] > pair[k]
        if tied.any():
            out[k] = at[k] + int(tied.argmax())
    return out


# ---------------------------------------------------------------- jobs


def _pair_counts(words: DataFrame) -> DataFrame:
    n = F.size("syms")
    left, right = F.slice("syms", 1, n - 1), F.slice("syms", 2, n - 1)
    pair = F.zip_with(left, right, lambda a, b: F.shiftleft(a.cast("bigint"), BITS).bitwiseOR(b.cast("bigint")))
    return words.where(n > 1).select("lang", "freq", F.explode(pair).alias("pair")) \
        .groupBy("lang", "pair").agg(F.sum("freq").alias("n"))


def _levels(pairs: DataFrame, min_freq: int) -> dict[str, list[int]]:
    """Per language the counts, rising, that pairs of a level have at least; the first is ``min_freq`` if no
    more than ``MAX_PAIRS`` pairs have it. Languages without such pairs are left out."""
    per = pairs.where(F.col("n") >= max(min_freq, 1)).groupBy("lang", "n").agg(F.count(F.lit(1)).alias("pairs"))
    down = Window.partitionBy("lang").orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, 0)
    per = per.select("lang", "n", F.sum("pairs").over(down).alias("upto"))
    sizes = [LEAST_PAIRS << k for k in range((MAX_PAIRS // LEAST_PAIRS).bit_length())]
    lowest = [F.min(F.when(F.col("upto") <= size, F.col("n"))).alias(f"n{size}") for size in sizes]
    out = {}
    for r in per.groupBy("lang").agg(F.max("n").alias("top"), F.max("upto").alias("all"), *lowest).collect():  # a row a language
        found = {r.top} | {r[f"n{size}"] for size in sizes if r[f"n{size}"] is not None}
        if r["all"] <= MAX_PAIRS:
            found.add(max(min_freq, 1))
        out[r.lang] = sorted(found)
    return out


class _Cutter:
    """What a task needs to cut words: the pairs of the lowest levels and their counts."""

    def __init__(self, pairs: DataFrame, levels: dict[str, list[int]]):
        self.langs = {lang: k for k, lang in enumerate(levels)}
        lowest = None
        for lang, counts in levels.items():
            mine = (F.col("lang") == lang) & (F.col("n") >= counts[0])
            lowest = mine if lowest is None else lowest | mine
        rows = pairs.where(lowest).toArrow()  # at most MAX_PAIRS a language, or those of the best count
        lang = np.array([self.langs[x] for x in rows["lang"].to_pylist()], np.int64)
        key = lang << 2 * BITS | rows["pair"].to_numpy()
        order = np.argsort(key)
        self.key, self.n = key[order], rows["n"].to_numpy()[order]

    def symbols(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The symbols of all words, their words and languages, and the counts of the pairs that they end
        (0 for the first of a word)."""
        column = batch.column("syms")
        lengths = column.value_lengths().to_numpy(zero_copy_only=False)
        flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        word = np.repeat(np.arange(len(lengths)), lengths)
        lang = np.array([self.langs[x] for x in batch.column("lang").to_pylist()], np.int64)[word]
        n = np.zeros(len(flat), np.int64)
        if len(flat) > 1:
            key = lang[1:] << 2 * BITS | flat[:-1] << BITS | flat[1:]
            at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            n[1:] = np.where((self.key[at] == key) & (word[1:] == word[:-1]), self.n[at], 0)
        return flat, word, lang, n


def _pieces(n: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of two or more symbols whose pairs have a count of ``least``."""
    start = np.flatnonzero(n < least)
    end = np.append(start[1:], len(n))
    some = end - start > 1
    return start[some], end[some]


def _cutting_counts(words: DataFrame, cutter, levels: dict[str, list[int]], most: int) -> dict[str, int]:
    """Per language the lowest level with at most ``most`` different pieces, by a sample of their hashes."""
    step = np.uint64(0x9E3779B97F4A7C15)
    back = np.uint64(pow(int(step), -1, 1 << 64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = cutter.value
        table = np.zeros((len(levels), max(map(len, levels.values()))), np.int64)
        for lang, k in cut.langs.items():
            table[k] = 1 << 62
            table[k, :len(levels[lang])] = levels[lang]
        for batch in batches:
            flat, _, lang, n = cut.symbols(batch)
            if not len(flat):
                continue
            # a piece's hash: the sum of its symbols' hashes times powers by place, from its start on
            power, inverse = np.full(len(flat), step), np.full(len(flat), back)
            power[0] = inverse[0] = 1
            power, inverse = np.multiply.accumulate(power), np.multiply.accumulate(inverse)
            total = np.append(np.uint64(0), np.cumsum(mix(flat.astype(np.uint64) + np.uint64(1)) * power))
            for level in range(table.shape[1]):
                start, end = _pieces(n, table[lang, level])
                h = mix((total[end] - total[start]) * inverse[start])
                some = h % np.uint64(HASHES) == 0
                found = np.unique(np.stack((lang[start][some], h[some].view(np.int64))), axis=1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found[0]), pa.array(np.full(found.shape[1], level)), pa.array(found[1])], ["k", "level", "h"])

    rows = words.select("lang", "syms").mapInArrow(run, "k bigint, level bigint, h bigint") \
        .groupBy("k", "level").agg(F.count_distinct("h").alias("n")).collect()  # a row a language and level
    count = {(r.k, r.level): r.n * HASHES for r in rows}
    return {lang: next((t for j, t in enumerate(levels[lang]) if count.get((k, j), 0) <= most), levels[lang][-1])
            for k, lang in enumerate(levels)}


def _cut_words(words: DataFrame, cutter, least: dict[str, int]) -> DataFrame:
    """``(lang, syms, freq)``: the different pieces of all words, cut at pairs of a count under ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = cutter.value
        table = np.array([least[lang] for lang in cut.langs], np.int64)
        for batch in batches:
            flat, word, lang, n = cut.symbols(batch)
            if not len(flat):
                continue
            start, end = _pieces(n, table[lang])
            inside = np.zeros(len(flat) + 1, np.int64)
            inside[start] += 1
            np.subtract.at(inside, end, 1)
            offsets = np.append(0, np.cumsum(end - start)).astype(np.int32)
            syms = pa.ListArray.from_arrays(offsets, pa.array(flat[np.cumsum(inside[:-1]) > 0].astype(np.int32)))
            at = pa.array(word[start])
            yield pa.RecordBatch.from_arrays([batch.column("lang").take(at), syms, batch.column("freq").take(at)],
                                             ["lang", "syms", "freq"])

    return words.select("lang", "freq", "syms").mapInArrow(run, "lang string, syms array<int>, freq bigint") \
        .groupBy("lang", "syms").agg(F.sum("freq").alias("freq"))


def _next_steps(pieces: DataFrame, least: dict[str, int], steps: dict[str, int], first_id: dict[str, int]
                ) -> dict[str, list[tuple[int, int, int]]]:
    """The next steps of each language down to its least count, from one task a language over its pieces."""

    def run(mine: pa.Table) -> pa.Table:
        lang = mine["lang"][0].as_py()
        syms = mine["syms"].combine_chunks()
        found = greedy_pieces(syms.flatten().to_numpy(zero_copy_only=False), syms.value_lengths().to_numpy(zero_copy_only=False),
                              mine["freq"].to_numpy(), steps[lang], first_id[lang], least[lang])
        left, right, n = zip(*found, strict=True) if found else ((), (), ())
        return pa.table([pa.array([lang] * len(found), pa.string()), pa.array(range(len(found)), pa.int32()), pa.array(left, pa.int32()),
                         pa.array(right, pa.int32()), pa.array(n, pa.int64())], ["lang", "step", "l", "r", "n"])

    rows = pieces.groupBy("lang").applyInArrow(run, "lang string, step int, l int, r int, n bigint").collect()  # at most the vocabulary size
    out = {lang: [] for lang in steps}
    for r in sorted(rows, key=lambda r: (r.lang, r.step)):
        out[r.lang].append((r.l, r.r, r.n))
    return out


def _applied(words: DataFrame, steps: dict[str, list[tuple[int, int, int]]], first_id: dict[str, int]) -> DataFrame:
    """``words`` after the steps; languages without any stay."""
    ranks = words.sparkSession.sparkContext.broadcast({
        lang: {a << BITS | b: (k, first_id[lang] + k) for k, (a, b, _) in enumerate(s)} for lang, s in steps.items()})

    @F.pandas_udf("array<int>")
    def run(lang: pd.Series, syms: pd.Series) -> pd.Series:
        return pd.Series([merge_word(s.tolist(), ranks.value.get(x, {})) for x, s in zip(lang, syms, strict=True)], dtype=object)

    return words.withColumn("syms", run("lang", "syms"))


def learn_merges(words: DataFrame, num_merges: int | dict[str, int], min_freq: int = 1,
                 sample_words: int = SAMPLE_WORDS, first_batch: int | None = None) -> Merges:
    """Up to ``num_merges`` merges per language from ``(lang, freq, syms)``, fewer where no pair of a
    count of ``min_freq`` is left. ``sample_words``, the pieces a task may hold, and ``first_batch``, the
    steps of a round if not as many as come, change the rounds, not the result."""
    sc = words.sparkSession.sparkContext
    state = written_table(words.where("lang is not null").select("lang", "freq", "syms").repartition("lang", "syms"), "bpe-words")
    # a row per language and byte
    symbols = state.select("lang", F.explode(F.array_distinct("syms")).alias("b")).groupBy("lang") \
        .agg(F.collect_set("b").alias("bytes")).collect()
    result = Merges({r.lang: [] for r in symbols}, {r.lang: sorted(r.bytes) for r in symbols})
    wanted = num_merges if isinstance(num_merges, dict) else dict.fromkeys(result.merges, num_merges)
    active = [lang for lang in result.merges if wanted.get(lang, 0) > 0]
    while active:
        result.rounds += 1
        pairs = written_table(_pair_counts(state.where(F.col("lang").isin(active))), "bpe-pairs")
        levels = _levels(pairs, min_freq)
        if not levels:
            break
        mine = state.where(F.col("lang").isin(list(levels)))
        first_id = {lang: 256 + len(result.merges[lang]) for lang in levels}
        left = {lang: wanted[lang] - len(result.merges[lang]) for lang in levels}
        if first_batch is not None:
            left = {lang: min(n, first_batch) for lang, n in left.items()}
        cutter = sc.broadcast(_Cutter(pairs, levels))
        drop_table(pairs)
        least = _cutting_counts(mine, cutter, levels, sample_words)
        steps = _next_steps(_cut_words(mine, cutter, least), least, left, first_id)
        for lang, s in steps.items():
            result.merges[lang] += [(a, b, first_id[lang] + k, n) for k, (a, b, n) in enumerate(s)]
        # a language ends at its size or without a frequent pair
        active = [lang for lang in steps if len(result.merges[lang]) < wanted[lang]
                  and (len(steps[lang]) == left[lang] or least[lang] > max(min_freq, 1))]
        if active:
            old, state = state, written_table(_applied(state.where(F.col("lang").isin(active)), steps, first_id), "bpe-words")
            drop_table(old)
        cutter.unpersist()
    drop_table(state)
    return result
