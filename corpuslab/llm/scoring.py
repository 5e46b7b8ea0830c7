"""Operator 7, language-model scoring by masked pseudo-likelihood.

Method: a window network predicts every token from the ``REACH`` tokens on both sides of it
(the token itself is masked): embeddings of the neighbours, one weight matrix a position,
a tanh layer, and a two-level softmax (class of the token, then the token in its class). A
document's score is the sum of the conditional log-probabilities of all its words.

Vocabulary: words (runs between ASCII white space, A-Z lower-cased) are counted over all
documents by their 64-bit hash. The most frequent are tokens of the network, every other word
belongs to one of the tokens left, by its hash. The network has ``classes ** 2`` tokens,
``classes`` being the fourth root of the number of distinct words and ``LEAST_CLASSES`` at least, so
vocabulary and network grow with the corpus. A word outside the vocabulary has
p(word | both sides) = p(its token | both sides) * count of the word / count of the token's words:
the probabilities of all words of the corpus sum to one, and a rare word isn't as likely as all words
that share its token.

Jobs: (1) counts of all words, kept as a table; (2) documents become arrays of token numbers, written
once in blocks of about ``BLOCK`` tokens, each with a list of the outside words that it uses; (3)
``ROUNDS`` rounds of training; (4) the lists are joined to the counts by hash, and every block is
scored together with its own list. No task holds more of the counts than its block's words.

Training in numpy inside Spark tasks: each round takes its share of all documents (a hash of the
text), every task runs gradient steps over its rows from the same parameters, and the tasks'
parameters are averaged, weighted by tokens, with a shuffle on the parameter's position (a
sum that Spark aggregates; no task or driver holds the parameters of many tasks). With
``ROUNDS`` rounds every document is trained on exactly once. What is shuffled - word counts, lists
of words and one parameter vector a task - grows with the input; the driver gets one vector, the
vocabulary's hashes and a count a token.

Cases: null, empty and blank texts have no tokens and score 0; repeated rows score alike; words of
equal count enter the vocabulary by hash; long texts are scored whole, in windows of tokens; an empty
table gives an empty table; extra columns are not read. Parameters are averaged over tasks, so scores
depend slightly on how the input is split into tasks; on equal splits reruns agree up to rounding.
"""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import MAX_CACHED_WORDS, read, shared_table

LEAST_CLASSES = 32
REACH = 2
DIM, HIDDEN = 12, 16
ROUNDS = 2
BATCH, RATE = 8_192, 0.04
CHUNK = 32_768
BLOCK = 1 << 21
SEED = 7
OFFSETS = [k for k in range(-REACH, REACH + 1) if k]


class Net:
    """Sizes of a network over ``classes ** 2`` tokens: words of their own, shared tokens, the padding."""

    def __init__(self, classes: int):
        self.classes = c = classes
        self.n_tokens = c * c
        self.pad = c * c - 1
        self.n_other = c * c // 16 - 1
        self.n_words = c * c - 1 - self.n_other
        self.number = np.dtype(np.uint16 if c * c <= 1 << 16 else np.int32)  # how a token is written
        self.shapes = {"embed": (c * c, DIM), "inner": (2 * REACH * DIM, HIDDEN), "inner_b": (HIDDEN,),
                       "cls": (HIDDEN, c), "cls_b": (c,), "word": (c, HIDDEN, c), "word_b": (c, c)}
        self.size = sum(int(np.prod(s)) for s in self.shapes.values())

    def unpack(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for name, shape in self.shapes.items():
            n = int(np.prod(shape))
            out[name] = flat[at:at + n].reshape(shape)
            at += n
        return out

    def initial(self) -> np.ndarray:
        rng = np.random.default_rng(SEED)
        flat = np.zeros(self.size, np.float32)
        p = self.unpack(flat)
        for name, scale in (("embed", 0.3), ("inner", 0.3), ("cls", 0.1), ("word", 0.1)):
            p[name][...] = rng.normal(0, scale, p[name].shape)
        return flat


def net_for(distinct: int) -> Net:
    """The network for a corpus of ``distinct`` different words."""
    classes = LEAST_CLASSES
    while classes ** 4 < distinct:
        classes += 1
    return Net(classes)


def split_words(text: bytes | None) -> list[bytes]:
    return text.lower().split() if text else []


# ---------------------------------------------------------------- the network


def padded(tokens: np.ndarray, lengths: np.ndarray, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of documents with ``REACH`` paddings around each, and the places of the tokens in it."""
    document = np.repeat(np.arange(len(lengths)), lengths)
    places = np.arange(len(tokens)) + REACH * (document + 1)
    out = np.full(len(tokens) + REACH * (len(lengths) + 1), pad, np.int32)
    out[places] = tokens
    return out, places


def windows(tokens: np.ndarray, lengths: np.ndarray, pad: int, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(tokens, their neighbours) in pieces of ``size`` tokens; neighbours don't cross documents."""
    row, places = padded(tokens, lengths, pad)
    for at in range(0, len(tokens), size):
        p = places[at:at + size]
        yield row[p], np.stack([row[p + k] for k in OFFSETS], axis=1)


def by_class(net: Net, tokens: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """An order that puts tokens of a class next to each other, and (class, start, end) of each."""
    cls = (tokens // net.classes).astype(np.uint16)
    order = np.argsort(cls, kind="stable")
    ends = np.searchsorted(cls[order], np.arange(net.classes + 1)).tolist()
    return order, [(c, ends[c], ends[c + 1]) for c in range(net.classes) if ends[c] < ends[c + 1]]


def hidden(p: dict, around: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Embeddings (a row a token) and the hidden layer (a column a token, so that softmaxes run along rows)."""
    x = p["embed"].take(around, axis=0).reshape(len(around), -1)
    return x, np.tanh(p["inner"].T @ x.T + p["inner_b"][:, None])


def picked(z: np.ndarray, at: np.ndarray) -> np.ndarray:
    """log softmax of each column at one row; changes ``z``."""
    z -= z.max(axis=0)
    chosen = z[at, np.arange(len(at))].astype(np.float64)
    np.exp(z, out=z)
    return chosen - np.log(z.sum(axis=0))


def slope(z: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Gradient of the loss by the logits ``z``, in place."""
    z -= z.max(axis=0)
    np.exp(z, out=z)
    z /= z.sum(axis=0)
    z[at, np.arange(len(at))] -= 1
    return z


def log_probabilities(net: Net, p: dict, tokens: np.ndarray, around: np.ndarray) -> np.ndarray:
    """log p(token | both sides) for every token."""
    order, groups = by_class(net, tokens)
    tokens = tokens[order]
    _, h = hidden(p, around[order])
    out = picked(p["cls"].T @ h + p["cls_b"][:, None], tokens // net.classes)
    for c, s, e in groups:
        out[s:e] += picked(p["word"][c].T @ h[:, s:e] + p["word_b"][c][:, None], tokens[s:e] - c * net.classes)
    back = np.empty_like(out)
    back[order] = out
    return back


class Trainer:
    """Adagrad steps over batches of tokens, in place on one parameter vector."""

    def __init__(self, net: Net, flat: np.ndarray):
        self.net = net
        self.flat = flat.copy()
        self.p = net.unpack(self.flat)
        self.square = net.unpack(np.full(net.size, 0.01, np.float32))
        self.seen = 0

    def update(self, name: str, grad: np.ndarray, at=slice(None)) -> None:
        s = self.square[name]
        s[at] += grad * grad
        self.p[name][at] -= RATE * grad / np.sqrt(s[at])

    def step(self, tokens: np.ndarray, around: np.ndarray) -> None:
        net, p, n = self.net, self.p, len(tokens)
        order, groups = by_class(net, tokens)
        tokens, around = tokens[order], around[order]
        x, h = hidden(p, around)
        scale = np.float32(32 / n)
        g = slope(p["cls"].T @ h + p["cls_b"][:, None], tokens // net.classes)
        dh = p["cls"] @ g
        self.update("cls", h @ g.T * scale)
        self.update("cls_b", g.sum(1) * scale)
        for c, s, e in groups:
            g = slope(p["word"][c].T @ h[:, s:e] + p["word_b"][c][:, None], tokens[s:e] - c * net.classes)
            dh[:, s:e] += p["word"][c] @ g
            self.update("word", h[:, s:e] @ g.T * scale, c)
            self.update("word_b", g.sum(1) * scale, c)
        dz = dh * (1 - h * h)
        dx = (dz.T @ p["inner"].T).reshape(-1).astype(np.float64)
        self.update("inner", (dz @ x).T * scale)
        self.update("inner_b", dz.sum(1) * scale)
        cells = (around.astype(np.int64).reshape(-1, 1) * DIM + np.arange(DIM)).reshape(-1)
        g = np.bincount(cells, dx, net.n_tokens * DIM).astype(np.float32).reshape(-1, DIM)
        self.update("embed", g * scale)
        self.seen += n


# ---------------------------------------------------------------- the jobs


def word_counts(docs: DataFrame) -> DataFrame:
    """Table of ``h`` (64-bit hash of a word), ``n`` (its occurrences in all documents)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def rows() -> pa.RecordBatch:
            h = np.fromiter(map(xxhash.xxh64_intdigest, counts), np.uint64, len(counts)).view(np.int64)
            n = np.fromiter(counts.values(), np.int64, len(counts))
            counts.clear()
            return pa.record_batch({"h": h, "n": n})

        for batch in batches:
            for text in batch.column("text").to_pylist():
                counts.update(split_words(text))
                if len(counts) > MAX_CACHED_WORDS:
                    yield rows()
        yield rows()

    counted = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(run, "h long, n long")
    return shared_table(counted.groupBy("h").agg(F.sum("n").alias("n")), "lm-counts")


def vocabulary_of(counts: DataFrame, net: Net) -> list[int]:
    """Hashes of the most frequent words, ties by the hash."""
    return [r["h"] for r in counts.orderBy(F.desc("n"), "h").limit(net.n_words).collect()]


def shared_counts(counts: DataFrame, net: Net, vocabulary: list[int]) -> np.ndarray:
    """Occurrences of the words outside the vocabulary, by their token (``n_other`` numbers)."""
    spark = counts.sparkSession
    own = spark.createDataFrame([(h,) for h in vocabulary], "h long")
    rest = counts.join(F.broadcast(own), "h", "left_anti")
    shared = F.shiftrightunsigned("h", 1) % net.n_other  # without the sign bit, as in Codes.tokens
    out = np.zeros(net.n_other)
    for r in rest.groupBy(shared.cast("int").alias("k")).agg(F.sum("n").alias("n")).collect():
        out[r["k"]] = r["n"]
    return out


class Codes(dict):
    """Word (bytes) -> its token, or ``n_tokens`` + its number among the outside words of the block."""

    def __init__(self, net: Net, vocabulary: list[int]):
        super().__init__()
        self.net = net
        self.own = {h % 2 ** 64: i for i, h in enumerate(vocabulary)}
        self.outside = array("Q")

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        code = self.own.get(h, -1)
        if code < 0:
            code = self.net.n_tokens + len(self.outside)
            self.outside.append(h)
        self[word] = code
        return code

    def hashes(self) -> np.ndarray:
        return np.array(self.outside, np.uint64)

    def next_block(self) -> None:
        self.clear()
        self.outside = array("Q")

    def tokens(self, codes: np.ndarray) -> np.ndarray:
        """The network's token of each code."""
        out = codes.astype(np.int32)
        other = np.flatnonzero(codes >= self.net.n_tokens)
        shared = ((self.hashes() >> np.uint64(1)) % np.uint64(self.net.n_other)).astype(np.int32) + self.net.n_words
        out[other] = shared[codes[other] - self.net.n_tokens]
        return out


def numbered(docs: DataFrame, net: Net, vocabulary: list[int], rounds: int) -> DataFrame:
    """Documents as token numbers, written once.

    Rows of documents: ``block, doc_id, turn`` (the training round), ``tokens`` (numbers of type ``net.number``),
    ``outside`` (32-bit numbers of the outside words in the block, in order of occurrence). One row
    a block holds ``hashes`` of its outside words instead.
    """
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("doc_id", docs.schema["doc_id"].dataType),
                           T.StructField("turn", T.IntegerType()), T.StructField("tokens", T.BinaryType()),
                           T.StructField("outside", T.BinaryType()), T.StructField("hashes", T.ArrayType(T.LongType()))])
    start = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = Codes(net, start.value)
        block, size, ids_type = TaskContext.get().partitionId() << 32, 0, None

        def table(doc_id, turn, tokens, outside, hashes) -> pa.RecordBatch:
            return pa.record_batch([pa.array([block] * len(doc_id), pa.int64()), doc_id, pa.array(turn, pa.int32()),
                                    pa.array(tokens, pa.binary()), pa.array(outside, pa.binary()),
                                    pa.array(hashes, pa.list_(pa.int64()))], names=schema.names)

        def documents(doc_id, held) -> pa.RecordBatch:
            lengths = [len(x) for _, x in held]
            codes = np.fromiter((c for _, x in held for c in x), np.int64, sum(lengths))
            tokens, other = ids.tokens(codes).astype(net.number), codes >= net.n_tokens
            ends = np.cumsum(lengths)
            out = ([], [])
            for s, e in zip(ends - lengths, ends, strict=True):
                out[0].append(tokens[s:e].tobytes())
                out[1].append((codes[s:e][other[s:e]] - net.n_tokens).astype(np.int32).tobytes())
            return table(doc_id, [t for t, _ in held], *out, [None] * len(held))

        def words() -> pa.RecordBatch:
            return table(pa.nulls(1, ids_type), [None], [None], [None], [ids.hashes().view(np.int64)])

        for batch in batches:
            doc_id, first, held = batch.column("doc_id"), 0, []
            ids_type = doc_id.type
            for k, text in enumerate(batch.column("text").to_pylist()):
                codes = list(map(ids.__getitem__, split_words(text)))
                held.append((xxhash.xxh64_intdigest(text or b"") % rounds, codes))
                size += len(codes)
                if size >= BLOCK:
                    yield documents(doc_id.slice(first, len(held)), held)
                    yield words()
                    ids.next_block()
                    block, size, first, held = block + 1, 0, k + 1, []
            if held:
                yield documents(doc_id.slice(first, len(held)), held)
        if size:
            yield words()

    return shared_table(docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, schema), "lm-tokens")


def joined(column: pa.ChunkedArray | pa.Array, number: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all rows of a binary column, and how many each row has."""
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), number), np.array([len(r) // number.itemsize for r in rows], np.int64)


def trained(table: DataFrame, net: Net, rounds: int = ROUNDS) -> np.ndarray:
    """Parameters after each document of the numbered ``table`` was used once."""
    sc = table.sparkSession.sparkContext
    flat = net.initial()
    for k in range(rounds):
        start = sc.broadcast(flat)

        def run(batches: Iterator[pa.RecordBatch], start=start) -> Iterator[pa.RecordBatch]:
            t = Trainer(net, start.value)
            for batch in batches:
                tokens, lengths = joined(batch.column("tokens"), net.number)
                for piece, around in windows(tokens, lengths, net.pad, BATCH):
                    t.step(piece, around)
            if t.seen:  # position -1 holds the weight
                yield pa.record_batch({"at": np.arange(-1, net.size, dtype=np.int32),
                                       "x": np.concatenate(([1.0], t.flat.astype(np.float64))) * t.seen})

        got = (table.where(F.col("turn") == k).select("tokens").mapInArrow(run, "at int, x double")
               .groupBy("at").agg(F.sum("x").alias("x")).toArrow())  # net.size + 1 rows
        if got.num_rows:
            total = np.empty(net.size + 1)
            total[got["at"].to_numpy() + 1] = got["x"].to_numpy()
            flat = (total[1:] / total[0]).astype(np.float32)
    return flat


def score_documents(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``doc_id, n_tokens, log_likelihood, per_token`` per row of ``docs``."""
    spark = docs.sparkSession
    counts = word_counts(docs)
    net = net_for(counts.count())
    vocabulary = vocabulary_of(counts, net)
    with np.errstate(divide="ignore"):
        log_shared = np.log(shared_counts(counts, net, vocabulary))
    table = numbered(docs, net, vocabulary, rounds)
    model = spark.sparkContext.broadcast((trained(table, net, rounds), log_shared))

    def score(block: pa.Table, outside: pa.Table) -> pa.Table:
        flat, log_shared = model.value
        p = net.unpack(flat)
        log_n = np.zeros(len(outside))
        log_n[outside["at"].to_numpy()] = np.log(outside["n"].to_numpy())
        tokens, lengths = joined(block["tokens"], net.number)
        total = np.zeros(len(tokens))
        at = 0
        for piece, around in windows(tokens, lengths, net.pad, CHUNK):
            total[at:at + len(piece)] = log_probabilities(net, p, piece, around)
            at += len(piece)
        other = np.flatnonzero(tokens >= net.n_words)
        total[other] += log_n[joined(block["outside"], np.dtype(np.int32))[0]] - log_shared[tokens[other] - net.n_words]
        ends = np.cumsum(lengths)
        sums = np.concatenate(([0.0], np.cumsum(total)))
        s = sums[ends] - sums[ends - lengths]
        per = pa.array(s / np.maximum(lengths, 1), mask=lengths == 0)
        return pa.table({"doc_id": block["doc_id"], "n_tokens": lengths, "s": s, "per": per})

    words = (table.where(F.col("hashes").isNotNull()).select(F.col("block").alias("of"), F.posexplode("hashes").alias("at", "h"))
             .join(counts, "h").select("of", "at", "n"))
    texts = table.where(F.col("hashes").isNull()).select("block", "doc_id", "tokens", "outside")
    # as many partitions as asked for: few bytes of tokens are much work, so none are merged
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("n_tokens", T.LongType()),
                           T.StructField("s", T.DoubleType()), T.StructField("per", T.DoubleType())])
    scored = (texts.repartition(n, "block").groupBy("block").cogroup(words.repartition(n, "of").groupBy("of"))
              .applyInArrow(score, schema))
    return scored.select("doc_id", "n_tokens", F.round("s", 4).alias("log_likelihood"), F.round("per", 6).alias("per_token"))


def op7_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return score_documents(read(spark, sf_dir, "documents").select("doc_id", "text"))
