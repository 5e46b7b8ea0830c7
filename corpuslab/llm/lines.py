"""Operator 9, line dedup of fuzzy lines.

Method: lines are normalised (lower case, digits as 0, ASCII punctuation as space) and equal lines
made one node. Each distinct line gets a SimHash of its words; lines that agree in one of
``BLOCKS`` blocks of ``WIDTH`` bits, and fall in one cell of lengths, share a bucket (pigeonhole; the
cells of each block are shifted, so that few similar lines fall apart in many). Buckets are
searched in sorted order (``bucket_matches``), candidates verified by edit similarity in words, and
one occurrence of each connected group is kept: the first by (doc_id, line number).

Lines under ``SHORT`` words also get keys of word pairs: an edit changes at most two pairs, so
similar lines have most in common, and the first few of each (``n_keys``), from the rarest on, must
share one (prefix filter). A SimHash of few words differs too much after one edit. Members of such a bucket
are candidates if 64 bits, one set by each word, differ in no more than the allowed edits can change (two each).

No candidate is a pair whose word counts or word parities (``bags``) differ by more than the allowed edits can change:
the lines that a SimHash brings together by chance grow with the square of a bucket, and would all be read again.

``similarity`` is 1 - (word edits) / (words of the longer line), 0.8 by default. ``least_words`` (1)
leaves shorter lines alone; lines too short for an edit are linked if equal.

Scale: one row a block and line is shuffled (key, node, twice 64 bits), once; a second round reads only the
rows with candidates left. A bucket of any size is searched whole: it is read as a stream, each member compared
with all before it. Keys of many thousand members, by a sample, are dealt out in ``GROUPS`` groups, every
two of which meet in a task. The members of a key that a task compares are held there (40 bytes each). Texts are read again
for lines with a candidate. A 64-bit line hash that two different lines share (seen by a second
hash) is left alone.

Cases: null texts have no lines; rows with a null doc_id are left as they are; rows sharing a
doc_id are one document, whose texts are told apart by their hash, so that a line goes only from
the text it was found in; equal rows keep and lose the same lines; of lines of equal place in the order the
smaller text hash leads; blank lines stay; very long lines and texts are taken whole; a document whose lines all go stays with the rest
of its text (its kept copies hold the lines); an empty table gives an empty table; extra
columns are carried along.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WordIds, broadcast_if_small, cut, mix, shared_table
from .components import connected_components

SIMILARITY = 0.8
LEAST_WORDS = 1
#: Bits of a SimHash, and its blocks. The last 64 bits order a bucket and filter its pairs.
BITS, BLOCKS, WIDTH = 192, 12, 12
#: Cells of lengths: a cell's longest lines have so many times the words of its shortest.
CELL_RATIO = 1.5
#: Of the last 64 bits so many agree in a candidate.
AGREE = 48
#: Low bits of a bag, which have the number of words; the others have a parity each. MANY: so many words or more.
COUNT_BITS, MANY = 6, 63
#: Groups of the members of a key that is dealt out.
GROUPS = 8
#: Lines under so many words have keys of word pairs, too.
SHORT = 12
#: In a key's place for the block: the key is a word pair.
PAIR_KEY = 31
#: A key is dealt out if a sample of one in HOT_SAMPLE nodes has more than HOT members of it.
HOT_SAMPLE, HOT = 16, 512
#: Cells of the table of word pair counts, and the share of documents counted (1 / SAMPLE).
CELLS = 1 << 20
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
SAMPLE = 8
#: Distinct words whose digests a worker keeps between batches.
MAX_WORDS = 400_000
#: Words split at a time (the words of a batch of texts would take hundreds of MB).
HELD_WORDS = 200_000
#: Rows of word bits summed at once (BITS bytes each).
CHUNK = 8_192
#: Digits read 0; ASCII letters and all bytes of other characters stay; the rest separates.
TABLE = bytes(48 if 48 <= c <= 57 else c if c >= 128 or chr(c).isalpha() or c == 10 else 32 for c in range(256))


def line_words(text: str) -> list[list[bytes]]:
    """Normalised words of every line of a text."""
    return [x.split() for x in text.lower().encode("utf-8", "surrogatepass").translate(TABLE).split(b"\n")]


def normalised(line: str) -> str:
    return b" ".join(line_words(line)[0]).decode("utf-8", "surrogatepass")


def edit_distance(a: list, b: list) -> int:
    """Levenshtein distance of two sequences, bit-parallel over ``a`` (Myers, Hyyro)."""
    if not a or not b:
        return len(a) + len(b)
    at: dict = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | (1 << i)
    full, last = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, score = full, 0, len(a)
    for y in b:
        eq = at.get(y, 0)
        d0 = (((eq & up) + up) ^ up) | eq | down
        right = down | (full & ~(d0 | up))
        left = up & d0
        score += bool(right & last) - bool(left & last)
        right = (right << 1) | 1
        left <<= 1
        up = (left | ~(d0 | right)) & full
        down = right & d0 & full
    return score


def most_edits(n: int, similarity: float) -> int:
    """Word edits allowed to a pair whose longer line has ``n`` words."""
    return int((1 - similarity) * n + 1e-9)


def similar(a: str, b: str, similarity: float) -> bool:
    x, y = a.split(), b.split()
    longest = max(len(x), len(y))
    most = most_edits(longest, similarity)
    # each word that only one line has takes an edit
    return (abs(len(x) - len(y)) <= most and len(set(x).difference(y)) <= most and len(set(y).difference(x)) <= most
            and edit_distance(x, y) <= most)


class WordBits(dict):
    """Word -> row of a growing table: a byte a bit, the word's weight where its digest has the bit."""

    #: A long word says more of a line than a short one. Words of a piece: their sums fit a byte.
    LIGHT, HEAVY = 1, 4
    PIECE = 255 // HEAVY

    def __init__(self):
        super().__init__()
        self.new: list[bytes] = []
        self.lanes, self.weights = np.zeros((0, BITS // 8), np.uint64), np.zeros(0, np.int32)
        self.marks, self.odd = np.zeros(0, np.uint64), np.zeros(0, bool)

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n

    def add_new(self) -> None:
        raw = b"".join(xxhash.xxh3_128_digest(w) + xxhash.xxh64_digest(w) for w in self.new)
        weights = np.array([self.HEAVY if len(w) > 4 else self.LIGHT for w in self.new], np.uint8)
        bits = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, BITS // 8), axis=1) * weights[:, None]
        old, n = len(self) - len(self.new), len(self)
        if n > len(self.lanes):  # room for twice as many, so that rows are seldom copied
            self.lanes = np.concatenate((self.lanes[:old], np.empty((2 * n - old, BITS // 8), np.uint64)))
            self.weights = np.concatenate((self.weights[:old], np.empty(2 * n - old, np.int32)))
            self.marks = np.concatenate((self.marks[:old], np.empty(2 * n - old, np.uint64)))
            self.odd = np.concatenate((self.odd[:old], np.empty(2 * n - old, bool)))
        self.lanes[old:n], self.weights[old:n] = bits.view(np.uint64), weights
        place = np.frombuffer(raw, np.uint64).reshape(-1, BITS // 64)[:, -1] % np.uint64(64 - COUNT_BITS)
        self.marks[old:n] = np.uint64(1) << (place + np.uint64(COUNT_BITS))
        # white space beyond ASCII parts words when lines are compared
        self.odd[old:n] = [not w.isascii() and len(w.decode("utf-8", "surrogatepass").split()) != 1 for w in self.new]
        self.new = []

    def simhashes(self, lines: list[list[bytes]]) -> np.ndarray:
        """One row of BITS / 8 bytes a line; all lines have words."""
        return self.simhashes_and_bags(lines)[0]

    def bags(self, at: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Per line the number of its words, and bits that each say if words of that bit's place come an odd number of times.
        Lines that may have other words when compared count as long."""
        first = np.cumsum(lengths) - lengths
        n = np.where(np.logical_or.reduceat(self.odd[at], first), MANY, np.minimum(lengths, MANY))
        return np.bitwise_xor.reduceat(self.marks[at], first) | n.astype(np.uint64)

    def simhashes_and_bags(self, lines: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        if not lines:
            return np.zeros((0, BITS // 8), np.uint8), np.zeros(0, np.uint64)
        if len(self) > MAX_WORDS:
            self.clear()
            self.__init__()
        lengths = np.fromiter(map(len, lines), np.int64, len(lines))
        at = np.fromiter(map(self.__getitem__, chain.from_iterable(lines)), np.int64, lengths.sum())
        if self.new:
            self.add_new()
        # lines in pieces whose sums fit a byte, so that eight bytes are added at once
        n_pieces = -(-lengths // self.PIECE)
        first = np.cumsum(n_pieces) - n_pieces
        size = np.full(n_pieces.sum(), self.PIECE, np.int64)
        size[first + n_pieces - 1] = lengths - (n_pieces - 1) * self.PIECE
        ends = np.cumsum(size)
        sums = np.empty((len(size), BITS // 8), np.uint64)
        done = 0
        while done < len(size):
            start = ends[done] - size[done]
            last = int(np.searchsorted(ends, start + CHUNK, "right"))
            sums[done:last] = np.add.reduceat(self.lanes[at[start:ends[last - 1]]], ends[done:last] - size[done:last] - start, axis=0)
            done = last
        weight = np.add.reduceat(self.weights[at], np.cumsum(lengths) - lengths)
        sums = sums.view(np.uint8)
        out = sums[first] > (weight >> 1)[:, None]  # a bit that more than half of the weight has
        for i in np.flatnonzero(n_pieces > 1):
            out[i] = sums[first[i]:first[i] + n_pieces[i]].sum(axis=0, dtype=np.int64) > weight[i] >> 1
        return np.packbits(out, axis=1), self.bags(at, lengths)


def block_keys(signatures: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Key and ordering bits per line and block: two arrays of (lines, BLOCKS)."""
    bits = np.unpackbits(signatures, axis=1)[:, :BLOCKS * WIDTH].reshape(-1, BLOCKS, WIDTH)
    value = bits.astype(np.int64) @ (1 << np.arange(WIDTH))
    block = np.arange(BLOCKS)
    shift = block / BLOCKS
    cell = np.floor(np.log(lengths)[:, None] / np.log(CELL_RATIO) + shift).astype(np.int64)
    rest = np.ascontiguousarray(signatures[:, -8:]).view(np.uint64)
    turn = (64 // BLOCKS * block).astype(np.uint64)
    rest = (rest << turn) | (rest >> ((np.uint64(64) - turn) % np.uint64(64)))
    return ((cell << WIDTH | value) << 5) | block, rest.view(np.int64)


def line_hash(words: list[bytes], seed: int = 0) -> int:
    """Signed 64-bit hash of a normalised line."""
    h = xxhash.xxh64_intdigest(b" ".join(words), seed)
    return h - (1 << 64) if h >> 63 else h


def run_width(similarity: float, least_words: int) -> int:
    """Words of a run: two, or one if edits may change all pairs of a line."""
    return 2 if (2 * similarity - 1) * least_words >= 2 else 1


def n_keys(n: int, similarity: float, width: int) -> int:
    """So many first runs of a line of ``n`` words share one with those of any similar line.

    Lines of n and n + d words within k edits have at least n + d - width + 1 - k * width runs
    in common, so the shorter one may lack as many as k * width - d of its own."""
    slope, best, d = width * (1 - similarity), 0, 0
    while d * (1 - slope) <= width:
        best = max(best, width * most_edits(n + d, similarity) - d + 1)
        d += 1
    return best


def runs_of(lines: list[list[bytes]], ids: WordIds, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words, and the number of the line of each."""
    flat = ids.of([w for line in lines for w in line])
    at = np.repeat(np.arange(len(lines)), [len(x) for x in lines])
    if width == 1:
        return mix(flat), at
    inside = at[:-1] == at[1:]
    return mix(flat[:-1] * GOLDEN + flat[1:])[inside], at[:-1][inside]


def line_keys(lines: list[list[bytes]], ids: WordIds, ranks: np.ndarray, similarity: float, width: int) -> list[bytes]:
    """Per line the bits of its words and its first runs, by rank and hash, as bytes; a repeated run counts by its
    number."""
    if not lines:
        return []
    g, at = runs_of(lines, ids, width)
    bits = np.uint64(1) << (mix(ids.of([w for line in lines for w in line])) >> np.uint64(58))
    bits = np.bitwise_or.reduceat(bits, np.cumsum([0, *[len(x) for x in lines[:-1]]]))
    order = np.lexsort((g, at))
    g, at = g[order], at[order]
    place = np.arange(len(g))
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (at[1:] != at[:-1])
    number = (place - np.maximum.accumulate(np.where(new, place, 0))).astype(np.uint64)
    g = np.where(number > 0, mix(g + GOLDEN * number), g)
    g = g[np.lexsort((g, ranks[g % np.uint64(CELLS)], at))]
    lengths = [len(x) for x in lines]
    wanted = {n: n_keys(n, similarity, width) for n in set(lengths)}
    starts = np.searchsorted(at, np.arange(len(lines))).tolist()
    return [bits[k:k + 1].tobytes() + g[i:i + min(wanted[n], n - width + 1)].tobytes()
            for k, (i, n) in enumerate(zip(starts, lengths, strict=True))]


def fuzzy_words(similarity: float) -> int:
    """Words of the shortest line that may be similar to an unequal one."""
    n = 1
    while not most_edits(n + 1, similarity) and n < SHORT:
        n += 1
    return n


def run_ranks(docs: DataFrame, least_words: int, width: int) -> np.ndarray:
    """Rank of frequency per cell of run hashes of short lines, over a sample of the documents."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, total, held, n = WordIds(), np.zeros(CELLS, np.int64), [], 0

        def flush() -> None:
            if held:
                g, _ = runs_of(held, ids, width)
                total[:] += np.bincount((g % np.uint64(CELLS)).astype(np.int64), minlength=CELLS)
                held.clear()

        for pdf in batches:
            for text in pdf["text"]:
                for words in line_words(text):
                    if least_words <= len(words) < SHORT:
                        held.append(words)
                        n += len(words)
                if n > HELD_WORDS:
                    flush()
                    n = 0
        flush()
        at = np.flatnonzero(total)
        yield pd.DataFrame({"cell": at, "n": total[at]})

    some = docs.where("doc_id is not null and text is not null") \
        .where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0).select("text")
    rows = (some.mapInPandas(run, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n"))
            .toArrow())  # at most CELLS rows
    ranks = np.zeros(CELLS, np.uint8)
    ranks[rows["cell"].to_numpy()] = np.minimum(4 * np.log2(rows["n"].to_numpy() + 1.0), 255).astype(np.uint8)
    return ranks


def line_table(docs: DataFrame, similarity: float, least_words: int) -> DataFrame:
    """``(doc_id, version, lines)``: per document the number, two hashes, the number of words, the SimHash and the
    keys of word pairs (as bytes) of each line with enough words. Lines too short for an edit have no SimHash; its bag stands behind it."""
    least = max(least_words, fuzzy_words(similarity))
    width = run_width(similarity, least)
    ranks = docs.sparkSession.sparkContext.broadcast(run_ranks(docs, least, width))

    @F.pandas_udf("array<struct<pos:int,h:bigint,h2:bigint,n:int,sig:binary,runs:binary>>")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        ids, bits = WordIds(), WordBits()

        def flush(held: list, out: list) -> None:
            fuzzy = [x for _, _, x in held if len(x) >= least]
            short = [x for x in fuzzy if len(x) < SHORT]
            signatures, bags = bits.simhashes_and_bags(fuzzy)
            signatures = iter(np.hstack((signatures, bags.view(np.uint8).reshape(-1, 8))))
            runs = iter(line_keys(short, ids, ranks.value, similarity, width))
            for k, pos, words in held:
                n = len(words)
                out[k].append((pos, line_hash(words), line_hash(words, 1), n,
                               next(signatures).tobytes() if n >= least else None, next(runs) if least <= n < SHORT else None))
            held.clear()

        for batch in texts:
            out, held, n = [[] for _ in range(len(batch))], [], 0
            for k, text in enumerate(batch):
                for pos, words in enumerate(line_words(text or "")):
                    if words and len(words) >= least_words:
                        held.append((k, pos, words))
                        n += len(words)
                if n > HELD_WORDS:
                    flush(held, out)
                    n = 0
            flush(held, out)
            yield pd.Series(out, dtype=object)

    return docs.where("doc_id is not null and text is not null").select(
        "doc_id", version("text").alias("version"), run("text").alias("lines"))


def bucket_rows(classes: DataFrame) -> DataFrame:
    """``(key, node, rest, bag)``: a row for each block, and each word pair key, of ``(h, n, sig, runs)``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            node = pdf["h"].to_numpy(np.int64)
            signatures = np.frombuffer(b"".join(pdf["sig"]), np.uint8).reshape(-1, BITS // 8 + 8)
            bag = np.ascontiguousarray(signatures[:, -8:]).view(np.int64)[:, 0]
            key, rest = block_keys(signatures[:, :-8], pdf["n"].to_numpy(np.float64))
            yield pd.DataFrame({"key": key.reshape(-1), "node": np.repeat(node, BLOCKS), "rest": rest.reshape(-1),
                                "bag": np.repeat(bag, BLOCKS)})
            has = np.flatnonzero(pdf["runs"].notna().to_numpy())
            raw = [np.frombuffer(pdf["runs"].iat[i], np.int64) for i in has]
            if raw:
                many = [len(x) - 1 for x in raw]
                yield pd.DataFrame({"key": np.concatenate([x[1:] for x in raw]) | PAIR_KEY, "node": node[np.repeat(has, many)],
                                    "rest": np.repeat([x[0] for x in raw], many), "bag": bag[np.repeat(has, many)]})

    return classes.where("sig is not null").select("h", "n", "sig", "runs") \
        .mapInPandas(run, "key bigint, node bigint, rest bigint, bag bigint")


def may_be_similar(one: np.ndarray, two: np.ndarray, allowed: np.ndarray) -> np.ndarray:
    """If lines of these bags may be similar: ``k`` edits change ``2 * k`` words at most, and one less for each word
    that the longer line has more. ``allowed``: edits by words of the longer line. Lines of ``MANY`` words always may."""
    n, m = one & MANY, two & MANY
    longest, more = np.maximum(n, m), np.abs(n - m)
    edits = allowed[longest]
    unlike = np.bitwise_count((one ^ two).view(np.uint64) >> np.uint64(COUNT_BITS))
    return (longest == MANY) | ((more <= edits) & (unlike <= 2 * edits - more))


def bucket_matches(batches: Iterator[pd.DataFrame], first_round: bool, most_unlike: int = 64,
                   similarity: float = SIMILARITY) -> Iterator[pd.DataFrame]:
    """Candidates of rows ``(key, node, rest[, bag][, label][, tile])`` sorted by key, tile and rest.

    A row is compared with all rows of its key (and tile) before it; those of a word pair are candidates if no more
    than ``most_unlike`` bits differ. In the first
    round the pairs with the row just before and with the first one are returned as ``(a, b)``, and the rows of other candidates
    as ``(node, null, key, rest, bag)`` for a second round, which returns the candidates of unlike labels."""
    columns, told = None, np.zeros(0, bool)
    allowed = np.array([most_edits(n, similarity) for n in range(MANY + 1)])
    for pdf in batches:
        if not len(pdf):
            continue
        if columns is None:
            names = [c for c in ("key", "node", "rest", "bag", "label", "tile") if c in pdf.columns]
            columns = {c: np.zeros(0, np.int64) for c in names}
        fresh = len(told)
        columns = {c: np.concatenate((t, pdf[c].to_numpy(np.int64))) for c, t in columns.items()}
        key, node, rest = columns["key"], columns["node"], columns["rest"]
        label = node if first_round else columns["label"]
        told = np.concatenate((told, np.zeros(len(pdf), bool)))
        live = told.copy()
        a, b = [], []
        most = np.where((key & 31) == PAIR_KEY, most_unlike, 64 - AGREE)

        def alike(i, j):
            """Those of the places ``i`` that are candidates with their place of ``j``."""
            some = (label[i] != label[j]) & (np.bitwise_count(rest[i] ^ rest[j]) <= most[i])
            i, j = i[some], j[some]
            if "bag" in columns and len(i):
                i = i[may_be_similar(columns["bag"][i], columns["bag"][j], allowed)]
            return i

        new_run = key[1:] != key[:-1]
        if "tile" in columns:
            new_run |= columns["tile"][1:] != columns["tile"][:-1]
        start = np.flatnonzero(np.concatenate(([True], new_run)))
        lead = np.repeat(start, np.diff(np.append(start, len(key))))
        # with the key's first row
        i = np.arange(fresh, len(key))
        i = alike(i, lead[i])
        a.append(node[i])
        b.append(node[lead[i]])
        # with those before
        i = np.arange(fresh, len(key))
        d = 0
        while len(i):
            d += 1
            i = i[i - lead[i] >= d]
            hit = alike(i, i - d)
            if first_round and d > 1:
                hit = hit[node[hit - d] != node[lead[hit]]]
                live[hit] = live[hit - d] = True
            else:
                a.append(node[hit])
                b.append(node[hit - d])
        a, b = np.concatenate(a), np.concatenate(b)
        if len(a):
            yield pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b), "key": None, "rest": None, "bag": None})
        new = np.flatnonzero(live & ~told)
        if len(new):
            bag = columns["bag"][new] if "bag" in columns else None
            yield pd.DataFrame({"a": node[new], "b": None, "key": key[new], "rest": rest[new], "bag": bag})
        # the last key may go on
        columns, told = {c: x[start[-1]:] for c, x in columns.items()}, live[start[-1]:]


def searched(rows: DataFrame, hot: DataFrame, first_round: bool, most_unlike: int = 64, similarity: float = SIMILARITY) -> DataFrame:
    """Candidates of the buckets of ``rows``; ``hot`` keys are dealt out in tiles, one of every two groups of members."""
    group = F.pmod(F.xxhash64("node"), F.lit(GROUPS))
    tiles = F.transform(F.sequence(F.lit(0), F.lit(GROUPS - 1)), lambda x: (F.least(x, group) * GROUPS + F.greatest(x, group)).cast("bigint"))
    tile = F.explode(F.when(F.col("hot").isNotNull(), tiles).otherwise(F.array(F.lit(0).cast("bigint"))))
    rows = rows.join(hot, "key", "left").withColumn("tile", tile).drop("hot")
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(n, "key", "tile").sortWithinPartitions("key", "tile", "rest", "node")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return bucket_matches(batches, first_round, most_unlike, similarity)

    return rows.mapInPandas(run, "a bigint, b bigint, key bigint, rest bigint, bag bigint")


def version(text) -> Column:
    """Hash that tells the texts of one doc_id apart."""
    return F.xxhash64(text)


def line_texts(docs: DataFrame, least_words: int) -> DataFrame:
    """``(node, words)``: the normalised text of the wanted lines of ``(text, wanted)``."""

    @F.pandas_udf("array<struct<node:bigint,words:string>>")
    def run(texts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for text_batch, wanted_batch in texts:
            out = []
            for text, wanted in zip(text_batch, wanted_batch, strict=True):
                wanted, found = set(wanted.tolist()), []
                for words in line_words(text):
                    if len(words) >= least_words and (h := line_hash(words)) in wanted:
                        wanted.discard(h)
                        found.append((h, b" ".join(words).decode("utf-8", "surrogatepass")))
                out.append(found)
            yield pd.Series(out, dtype=object)

    return docs.select(F.explode(run("text", "wanted")).alias("x")).select("x.*")


def duplicate_lines(docs: DataFrame, similarity: float = SIMILARITY, least_words: int = LEAST_WORDS) -> DataFrame:
    """``(doc_id, version, gone)``: numbers of the lines that repeat a kept line, of the texts
    (``version`` of them) that have some."""
    table = shared_table(line_table(docs, similarity, least_words), "lines")
    lines = table.select("doc_id", "version", F.explode("lines").alias("l")).select("doc_id", "version", "l.*")
    classes = (lines.groupBy("h").agg(
        F.min("h2").alias("h2"), F.max("h2").alias("other"), F.min("doc_id").alias("first_doc"),
        F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("runs").alias("runs"))
        .where("h2 = other").drop("h2", "other"))
    classes = shared_table(classes, "line-classes")
    some = bucket_rows(classes.where(F.pmod(F.xxhash64("h"), F.lit(HOT_SAMPLE)) == 0))
    hot = cut(some.groupBy("key").agg(F.count(F.lit(1)).alias("hot")).where(F.col("hot") > HOT))
    hot = broadcast_if_small(hot)
    # an edit changes the bits of two words at most
    most_unlike = 2 * most_edits(SHORT - 1, similarity)
    found = shared_table(searched(bucket_rows(classes), hot, True, most_unlike, similarity), "line-candidates")
    pairs = found.where("b is not null").select("a", "b").distinct()
    # the rows of a key that was dealt out come from several tiles
    left = found.where("b is null").select(F.col("a").alias("node"), "key", "rest", "bag").dropDuplicates(["key", "node"])

    nodes = found.select(F.explode(F.array("a", "b")).alias("h")).where("h is not null").distinct()
    wanted = cut(classes.select("h", F.col("first_doc").alias("doc_id")).join(nodes, "h", "left_semi")
                 .groupBy("doc_id").agg(F.collect_set("h").alias("wanted")))
    texts = docs.where("text is not null").select("doc_id", "text").join(wanted, "doc_id")
    # copies of a row give the same line twice
    texts = shared_table(line_texts(texts, least_words).dropDuplicates(["node"]), "line-texts")

    @F.pandas_udf("boolean")
    def near(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([similar(x, y, similarity) for x, y in zip(a, b, strict=True)], dtype=bool)

    def verify(pairs: DataFrame) -> DataFrame:
        one, two = (texts.select(F.col("node").alias(x), F.col("words").alias(f"w{x}")) for x in "ab")
        return cut(pairs.join(one, "a").join(two, "b").where(near("wa", "wb")).select("a", "b"))

    links = verify(pairs)
    roots = cut(connected_components(links))
    left = left.join(roots, "node", "left").withColumn("label", F.coalesce("root", "node")).drop("root")
    more = searched(left, hot, False, most_unlike, similarity).select("a", "b").distinct()
    links = links.unionByName(verify(more))
    roots = cut(connected_components(links))
    group = (classes.select("h", "copies", "first_doc").join(roots.withColumnRenamed("node", "h"), "h", "left")
             .where("copies > 1 or root is not null").withColumn("root", F.coalesce("root", "h")))
    group = shared_table(group, "line-groups")
    owner = cut(group.groupBy("root").agg(F.min("first_doc").alias("owner")))
    group = cut(group.select("h", "root").join(owner, "root"))
    # the owner keeps the first line of the group, every other line goes
    # (that line of every copy of the row, as copies have one version)
    hit = lines.select("doc_id", "version", "pos", "h").join(group, "h")
    first = Window.partitionBy("doc_id", "root").orderBy("pos", "version")
    mine = hit.where("doc_id = owner").withColumn("k", F.dense_rank().over(first)).where("k > 1")
    gone = hit.where("doc_id <> owner").select("doc_id", "version", "pos")
    return (gone.unionByName(mine.select("doc_id", "version", "pos"))
            .groupBy("doc_id", "version").agg(F.collect_set("pos").alias("gone")))


def remove_lines(docs: DataFrame, similarity: float = SIMILARITY, least_words: int = LEAST_WORDS) -> DataFrame:
    """``docs`` with the repeated lines cut out of ``text`` (and ``n_chars``, if there,
    counted anew where a line went); all rows and other columns stay."""
    own = docs.columns
    gone = cut(duplicate_lines(docs, similarity, least_words))
    same = (F.col("d.doc_id") == F.col("g.doc_id")) & (version("d.text") == F.col("g.version"))
    d = docs.alias("d").join(gone.alias("g"), same, "left")
    kept = F.array_join(F.filter(F.split("d.text", "\n", -1), lambda x, i: ~F.array_contains(F.col("g.gone"), i)), "\n")
    text = F.when(F.col("g.gone").isNull(), F.col("d.text")).otherwise(kept)
    new = {"text": text}
    if "n_chars" in own:
        new["n_chars"] = F.when(F.col("g.gone").isNull(), F.col("d.n_chars")).otherwise(F.length(kept).cast("long"))
    return d.select(*[new.get(c, F.col(f"d.`{c}`")).alias(c) for c in own])


def op9_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Per document: number of lines, of removed lines, and their numbers."""
    from .common import read
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    gone = cut(duplicate_lines(docs))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n", -1))).cast("long")
    d = docs.select("doc_id", version("text").alias("version"), n_lines.alias("n_lines"))
    d = d.join(gone, ["doc_id", "version"], "left")
    gone = F.coalesce(F.array_sort("gone"), F.array().cast("array<int>"))
    return d.select("doc_id", "n_lines", F.size(gone).cast("long").alias("n_removed"),
                    F.array_join(gone, ",").alias("removed"))
