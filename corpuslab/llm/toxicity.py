"""Operator 2, toxicity of deobfuscated text.

Method: a noisy channel turns letters into look-alikes (``1d1ot``), puts separators between
them (``i.d.i.o.t``, ``i d i o t``) or repeats them. Each suspicious token is a lattice: every
character may stand for some letters, for nothing, or be one of a run; Viterbi finds the
cheapest letters under a character trigram model. The restored words are scored by a
logistic model over the words and word stems that separate the labels.

The trigram model counts all documents (a table of at most ``SYMBOLS**3`` cells over a fixed
alphabet reaches the driver, whatever the corpus). Labels are learnt from at most
``max_train`` labelled rows, in the order of a hash of their id; rows whose crc32 of doc_id,
modulo 4, is 2 are held out. Labels, lang, source and doc_id are no inputs of a score.

Scale: two scans of the texts (counting, scoring), no shuffle of texts; training rows are
taken by a broadcast of at most ``max_train`` ids.

Cases: null, empty and wordless texts get the score of a text without evidence; repeated rows
score alike; several labels of a doc_id count as toxic if one is; without labels of both
values every score is 0.5 shrunk to the share of toxic labels; an empty table gives an empty
table; extra columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, cut, read

MAX_TRAIN = 20_000
MAX_WORDS = 2_000
#: Least log-likelihood ratio of a word: about twice the logarithm of the number of words tried.
LEAST_EVIDENCE = 16.0
THRESHOLD = 0.3
STEMS = (5, 7)
#: Restored tokens a worker remembers before it starts afresh.
MAX_CACHED = 300_000

#: 0 is the word boundary, 1 any other character.
ALPHABET = "abcdefghijklmnopqrstuvwxyzäöüßàâæçéèêëîïôœùûÿáíóúñ"
SYMBOLS = 2 + len(ALPHABET)
SYMBOL = {c: i + 2 for i, c in enumerate(ALPHABET)}

#: Letters that a character may stand for.
LOOKALIKES = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
              "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i",
              "µ": "u", "¥": "y", "*": "aeiou", "#": "h", "%": ""}
SEPARATORS = "._-~'`^,;:/\\=\"[]{}()&?"
COST_LOOKALIKE, COST_GAP, COST_VOWEL, COST_FEWER, COST_DROP = 0.7, 0.3, 1.5, 4.0, 10.0

SUSPICIOUS = re.compile(r"[^\W\d_][^\w\s]+[^\W_]|[0-9@$!|+€£*#][^\W\d_]|[^\W\d_][0-9@$!|+€£*#]|_|([^\W\d_])\1\1")
REPEATED = re.compile(r"(.)\1\1")
PUNCTUATION = ".,;:?!\"'()"
SPACED = re.compile(r"(?<!\S)[a-z0-9@$!|](?: [a-z0-9@$!|]){2,}(?!\S)")
HEAD, TAIL, MARKS = re.compile(r"[^\w@$!|+]+"), re.compile(r"[^\w@$]+"), re.compile(r"[@$!]{3,}")


def without_edges(token: str) -> str:
    """``token`` without punctuation at its ends, in time linear in its length: the end is matched on the
    reversed token, as a search for a run up to the end would start at every mark of a long ruler."""
    found = HEAD.match(token)
    token = token[found.end():] if found else token
    back = token[::-1]
    ends = [m.end() for m in (TAIL.match(back), MARKS.match(back)) if m]
    return token[:len(token) - max(ends, default=0)]


class Decoder:
    """Restores tokens under a trigram table of counts."""

    def __init__(self, cost: np.ndarray):
        self.cost = cost
        self.known: dict[str, str] = {}

    @staticmethod
    def costs(counts: np.ndarray) -> np.ndarray:
        """Negative logarithms of p(third | first, second), smoothed by shorter contexts."""
        c = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS).astype(float)
        pair, one = c.sum(2), c.sum((0, 2)) + 1
        back = (c.sum(0) + 5 * one / one.sum()) / (c.sum((0, 2))[:, None] + 5)
        return -np.log((c + 5 * back[None]) / (pair[:, :, None] + 5)).astype(np.float32)

    def word(self, token: str) -> str:
        """The word of a lower-case token."""
        found = self.known.get(token)
        if found is None:
            bare = token.strip(PUNCTUATION)
            if bare.isalpha():
                odd = REPEATED.search(bare)
            else:
                bare = without_edges(token)
                odd = SUSPICIOUS.search(bare)
            found = self.decode(bare) if odd else bare
            if len(self.known) >= MAX_CACHED:
                self.known.clear()
            self.known[token] = found
        return found

    def lattice(self, token: str) -> list[list[tuple[str, float]]]:
        """Per run of one character: what it may stand for, and at which cost."""
        out, i = [], 0
        while i < len(token):
            c, j = token[i], i
            while j < len(token) and token[j] == c:
                j += 1
            n, i = j - i, j
            letters = LOOKALIKES.get(c)
            if c in SYMBOL:
                options = [(c * n, 0.0)] if n <= 2 else [(c, COST_GAP), (c * 2, COST_GAP)]
            elif letters is not None:
                cost = COST_VOWEL if c == "*" else COST_LOOKALIKE
                options = [(x * k, cost + (k < n == 2) * COST_FEWER) for x in letters for k in ((1,) if n == 1 else (1, 2))]
                if not options or i == n or i == len(token):  # at an edge it may be punctuation or a number
                    options.append(("", COST_DROP))
            elif c in SEPARATORS or not c.isalnum():
                options = [("", COST_GAP)]
            else:
                options = [(c, 0.0)]
            out.append(options)
        return out

    def decode(self, token: str) -> str:
        """Viterbi over the last two symbols."""
        cost, symbol = self.cost, SYMBOL.get
        states: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
        for options in self.lattice(token):
            new: dict[tuple[int, int], tuple[float, str]] = {}
            for (a, b), (total, text) in states.items():
                for letters, price in options:
                    x, y, t = a, b, total + price
                    for c in letters:
                        z = symbol(c, 1)
                        t += cost[x, y, z]
                        x, y = y, z
                    if (best := new.get((x, y))) is None or t < best[0]:
                        new[x, y] = (t, text + letters)
            states = new
        return min((t + cost[a, b, 0], text) for (a, b), (t, text) in states.items())[1]

    def restored(self, text: str | None) -> Counter:
        """Counts of the restored words of a text."""
        if not text:
            return Counter()
        text = text.lower()
        tokens = Counter(text.split())
        for m in SPACED.finditer(text):
            tokens.update([re.sub(r"\s+", ".", m.group())])
        out: Counter = Counter()
        for token, n in tokens.items():
            w = self.word(token)
            if w:
                out[w] += n
        return out


def evidence(words: Counter) -> list[str]:
    """Features of a text: its words, the stems (first 5 and 7 letters) of its longer words,
    and stems that occur twice and three times."""
    stems: Counter = Counter()
    for w, n in words.items():
        for k in STEMS:
            if len(w) > k:
                stems[w[:k]] += n
    out = list(words)
    for stem, n in stems.items():
        out.append(stem + "*")
        if n > 1:
            out.append(stem + "*2")
            if n > 2:
                out.append(stem + "*3")
    return out


def trigram_counts(docs: DataFrame) -> np.ndarray:
    """Counts of (symbol, symbol, symbol) over the lower-cased texts of all documents."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = np.ones(0x250, np.int64)
        table[[ord(c) for c in " \t\n\r\x0b\x0c"]] = 0
        for c, i in SYMBOL.items():
            table[ord(c)] = i
        total = np.zeros(SYMBOLS**3, np.int64)
        for pdf in batches:
            for text in pdf["text"]:
                if text:
                    cp = np.frombuffer(("  " + text.lower() + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
                    s = table[np.where(cp < 0x250, cp, 1)]
                    # a word starts from two boundaries, whatever came before
                    first, second = s[:-2], s[1:-1]
                    first = np.where(second == 0, 0, first)
                    total += np.bincount((first * SYMBOLS + second) * SYMBOLS + s[2:], minlength=SYMBOLS**3)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"cell": at, "n": total[at]})

    rows = (docs.select("text").mapInPandas(run, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n"))
            .collect())  # at most SYMBOLS ** 3 rows
    counts = np.zeros(SYMBOLS**3, np.int64)
    for r in rows:
        counts[r["cell"]] = r["n"]
    return counts


def is_held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, cost, max_train: int) -> tuple[dict[str, int], np.ndarray]:
    """Word -> weight number, and the weights (the bias last), from labelled rows not held out."""
    y = (labels.where("toxic is not null and doc_id is not null").where(~is_held_out(F.col("doc_id")))
         .groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("y"))
         .orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").limit(max_train))
    rows = docs.select("doc_id", "text").join(broadcast_if_small(cut(y), max_train), "doc_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        decoder = Decoder(cost.value)
        for pdf in batches:
            words = [evidence(decoder.restored(x)) for x in pdf["text"]]
            yield pd.DataFrame({"y": pdf["y"], "words": pd.Series(words, dtype=object)})

    rows = cut(rows.select("y", "text").mapInPandas(run, "y int, words array<string>")
               .withColumn("row", F.monotonically_increasing_id()))
    n, pos = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()
    share = (pos + 0.5) / (n + 1)
    # words by the log-likelihood ratio of their share of toxic rows against the whole
    part = lambda k, q: F.when(F.col(k) > 0, F.col(k) * F.log(F.col(k) / (F.col("n") * q))).otherwise(0.0)
    stat = (rows.select("y", F.explode("words").alias("word")).groupBy("word")
            .agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("p")).withColumn("c", F.col("n") - F.col("p"))
            .withColumn("g", 2 * (part("p", share) + part("c", 1 - share))).where(F.col("g") >= LEAST_EVIDENCE)
            .orderBy(F.desc("g"), "word").limit(MAX_WORDS).select("word").collect())
    vocabulary = {r["word"]: i for i, r in enumerate(stat)}
    wanted = F.array(*[F.lit(w) for w in vocabulary]) if vocabulary else F.array().cast("array<string>")
    found = rows.select("y", F.array_intersect("words", wanted).alias("words")).orderBy("row").collect()  # bounded rows
    return vocabulary, fit([[vocabulary[w] for w in r["words"]] for r in found],
                           np.array([r["y"] for r in found], float), len(vocabulary), share)


def fit(rows: list[list[int]], y: np.ndarray, n_words: int, share: float, ridge: float = 0.02,
        rounds: int = 400) -> np.ndarray:
    """Logistic regression on word presence by accelerated gradient steps on sparse rows."""
    w = np.zeros(n_words + 1)
    w[-1] = np.log(share / (1 - share))
    if not rows:
        return w
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    word = np.fromiter((x for r in rows for x in r), np.int64, len(at))
    freq = np.bincount(word, minlength=n_words) / len(rows) + 1 / len(rows)
    step = np.append(1 / (freq + ridge / 10), 4.0) * 0.5 / (1 + len(at) / len(rows)) ** 0.5
    v, last = w.copy(), w.copy()
    for k in range(rounds):
        s = np.bincount(at, v[word], len(rows)) + v[-1]
        e = 1 / (1 + np.exp(-np.clip(s, -30, 30))) - y
        g = np.append(np.bincount(word, e[at], n_words) / len(rows) + ridge / len(rows) * v[:-1], e.mean())
        w = v - step * g
        v, last = w + k / (k + 3) * (w - last), w
    return w


def score_documents(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """``doc_id, held_out, score, predicted`` per row of ``docs``."""
    sc = docs.sparkSession.sparkContext
    # broadcasts hold plain values, so that workers need no module of ours
    cost = sc.broadcast(Decoder.costs(trigram_counts(docs)))
    vocabulary, weights = train(docs, labels, cost, max_train)
    model = sc.broadcast((vocabulary, weights))

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        decoder, (number, w) = Decoder(cost.value), model.value
        for batch in texts:
            out = []
            for text in batch:
                found = [number[x] for x in evidence(decoder.restored(text)) if x in number]
                out.append(1 / (1 + np.exp(-np.clip(w[found].sum() + w[-1], -30, 30))))
            yield pd.Series(out, dtype=float)

    return docs.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), F.round(score("text"), 6).alias("score")) \
        .withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    return score_documents(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels"))
