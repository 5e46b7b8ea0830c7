"""Byte-pair vocabularies as Spark jobs (B1, B4-B7, B9; learning, B2/B3, is in ``merges``).

B1 ``word_freqs``: pre-tokens of the training texts, counted with a distributed
   ``groupBy(lang, word)`` -- the heavy pass over the corpus.
B2 ``learn_eval_merges``: the evaluation variant: specials, the bytes seen, then merges of a
   count of two or more, up to the vocabulary size. B3 ``learn_train_merges``: 256 bytes, merges,
   specials last.
B4 ``encode_words``: each *distinct* word once; ``encode_docs``: the ids of whole documents, in the
   tasks that hold them, with a bounded cache of encoded words. No shuffle of tokens.
B5 ``token_counts``: ``sum(freq * n_ids)`` over words joined with their encodings.
B6 ``decode``: ids back to text, a built-in expression over a table of a row per language.
B7 ``vocab_table``: token bytes per id, true and decoded-alone lengths; the bytes of merges come
   from repeated substitution over the merge table (its depth halves each time).
B9 unknown symbols (evaluation variant): bytes not seen in training map to [UNK].

Symbols 0-255 are bytes, merges get 256, 257, ...; final token ids differ per variant.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.functions.text import prefix
from corpuslab.functions.tokens import BYTE_LEVEL_PATTERN, TRAIN_SPLIT_PATTERN, byte_ids, pretokens
from corpuslab.operators.merges import Merges, learn_merges, merge_word
from corpuslab.session import drop_table, written_table

# Vocabulary size and specials of the two variants.
VOCAB_SIZE = 8192
TRAIN_SPECIALS = [f"<|reserved_{i}|>" for i in range(4)]   # appended after the merges
EVAL_SPECIALS = ["[PAD]", "[UNK]", "[BOS]", "[EOS]"]       # ids 0-3, before the alphabet
UNK = EVAL_SPECIALS.index("[UNK]")
EVAL_MIN_FREQ = 2
TRAIN_PREFIX_CHARS = 10_000
#: Encoded words that a task remembers.
MAX_CACHED_WORDS = 200_000


def word_freqs(texts: DataFrame, text_col: str = "text", by: list[str] | None = None,
               pattern: str = TRAIN_SPLIT_PATTERN, prefix_chars: int | None = None
               ) -> DataFrame:
    """B1: ``(by…, word, freq, syms)`` with ``syms`` the UTF-8 bytes of the word, over whole
    texts; ``prefix_chars`` applies T25 (the reference job passes ``TRAIN_PREFIX_CHARS``)."""
    by = list(by or ["lang"])
    t = F.col(text_col)
    if prefix_chars:
        t = prefix(t, prefix_chars)
    w = texts.select(*by, F.explode(pretokens(t, pattern)).alias("word"))
    return w.groupBy(*by, "word").agg(F.count("*").cast("bigint").alias("freq")) \
        .withColumn("syms", byte_ids(F.col("word")))


def learn_train_merges(words: DataFrame, vocab_size: int = VOCAB_SIZE, **kw) -> Merges:
    """Merges up to ``vocab_size`` entries with the 256 bytes and the specials."""
    return learn_merges(words, vocab_size - len(TRAIN_SPECIALS) - 256, **kw)


def learn_eval_merges(words: DataFrame, vocab_size: int = VOCAB_SIZE, **kw) -> Merges:
    """B2: merges up to ``vocab_size`` entries with the specials and the bytes seen, of pairs that
    occur ``EVAL_MIN_FREQ`` times."""
    seen = words.select("lang", F.explode(F.array_distinct("syms")).alias("b")).groupBy("lang") \
        .agg(F.count_distinct("b").alias("n")).collect()  # a row a language
    room = {r.lang: max(0, vocab_size - len(EVAL_SPECIALS) - r.n) for r in seen}
    return learn_merges(words, room, min_freq=EVAL_MIN_FREQ, **kw)


# ---------------------------------------------------------------------------
# Vocabulary
# ---------------------------------------------------------------------------

def _binary(symbols: Column) -> Column:
    """Byte symbols put together."""
    return F.unhex(F.array_join(F.transform(symbols, lambda x: F.lpad(F.hex(x.cast("bigint")), 2, "0")), ""))


def merged_bytes(merges: DataFrame) -> DataFrame:
    """``(lang, id, token)``: the bytes of every merge. All parts that are merges themselves are
    replaced by their parts, until only bytes are left: log2(depth) rounds over the merge table."""
    parts = written_table(merges.select("lang", F.col("new_id").alias("id"), F.array("left_id", "right_id").alias("parts")),
                          "token-parts")
    while parts.where(F.exists("parts", lambda x: x > 255)).limit(1).count():
        each = parts.select("lang", "id", F.posexplode("parts").alias("pos", "part"))
        inner = parts.select("lang", F.col("id").alias("part"), F.col("parts").alias("inner"))
        spread = each.join(inner, ["lang", "part"], "left").select(
            "lang", "id", F.struct("pos", F.coalesce("inner", F.array("part")).alias("p")).alias("s"))
        longer = spread.groupBy("lang", "id").agg(F.array_sort(F.collect_list("s")).alias("s")) \
            .select("lang", "id", F.flatten(F.transform("s", lambda x: x["p"])).alias("parts"))
        old, parts = parts, written_table(longer, "token-parts")
        drop_table(old)
    return parts.select("lang", "id", _binary(F.col("parts")).alias("token"))


def vocab_table(spark: SparkSession, m: Merges, variant: str = "train") -> DataFrame:
    """``(lang, token_id, token BINARY, is_special, n_bytes, n_bytes_decoded)``.

    ``train``: bytes, merges, specials; ``eval``: specials, the bytes seen, merges. ``n_bytes`` is
    the true length (specials 0); ``n_bytes_decoded`` that of the token decoded alone, where
    broken UTF-8 reads as replacement characters.
    """
    merges = m.frame(spark)
    langs = spark.createDataFrame([(lang, symbols) for lang, symbols in m.alphabet.items()], "lang string, seen array<int>")
    sizes = langs.join(merges.groupBy("lang").agg(F.count(F.lit(1)).cast("int").alias("n")), "lang", "left").na.fill(0, ["n"])
    names = TRAIN_SPECIALS if variant == "train" else EVAL_SPECIALS
    first_byte = 0 if variant == "train" else len(names)
    alphabet = F.sequence(F.lit(0), F.lit(255)) if variant == "train" else F.array_sort("seen")
    plain = sizes.select("lang", F.size(alphabet).alias("width"), F.posexplode(alphabet).alias("pos", "b")) \
        .select("lang", (F.col("pos") + first_byte).alias("token_id"), _binary(F.array("b")).alias("token"))
    first_merge = sizes.select("lang", (F.size(alphabet) + first_byte - 256).alias("shift"))
    merged = merged_bytes(merges).join(F.broadcast(first_merge), "lang") \
        .select("lang", (F.col("id") + F.col("shift")).alias("token_id"), "token")
    base = F.size(alphabet) + F.col("n") if variant == "train" else F.lit(0)
    special = sizes.select("lang", base.alias("base"), F.posexplode(F.array(*map(F.lit, names))).alias("pos", "name")) \
        .select("lang", (F.col("base") + F.col("pos")).alias("token_id"), F.encode("name", "UTF-8").alias("token"))
    every = plain.unionByName(merged).withColumn("is_special", F.lit(False)) \
        .unionByName(special.withColumn("is_special", F.lit(True)))

    def unless_special(n: Column) -> Column:
        return F.when(F.col("is_special"), 0).otherwise(n).cast("int")

    return every.select(
        "lang", F.col("token_id").cast("int"), "token", "is_special", unless_special(F.octet_length("token")).alias("n_bytes"),
        unless_special(F.octet_length(F.make_valid_utf8(F.col("token").cast("string")))).alias("n_bytes_decoded"))


# ---------------------------------------------------------------------------
# Encoding, counting, decoding
# ---------------------------------------------------------------------------

class Encoder:
    """What a task needs to encode: merge ranks and final ids of every language (bounded by the
    vocabulary size)."""

    def __init__(self, m: Merges, variant: str):
        self.ranks, self.ids = {}, {}
        for lang, merges in m.merges.items():
            self.ranks[lang] = {a << 20 | b: (rank, new) for rank, (a, b, new, _) in enumerate(merges)}
            if variant == "train":
                self.ids[lang] = None
            else:
                ids = {b: len(EVAL_SPECIALS) + k for k, b in enumerate(m.alphabet[lang])}
                first = len(EVAL_SPECIALS) + len(ids) - 256
                self.ids[lang] = ids | {new: new + first for _, _, new, _ in merges}

    def __call__(self, lang: str, word: str) -> list[int]:
        found = merge_word(list(word.encode("utf-8", "surrogatepass")), self.ranks[lang])
        ids = self.ids[lang]
        return found if ids is None else [ids.get(x, UNK) for x in found]


def encode_words(words: DataFrame, m: Merges, variant: str = "train", vocab_lang: str | None = None) -> DataFrame:
    """B4 (+B9): ``(lang, word, ids ARRAY<INT>)`` for each distinct word, with the vocabulary of its
    language or of ``vocab_lang``; words of a language without a vocabulary are left out. In the
    ``eval`` variant bytes never seen in training encode as [UNK]."""
    spark = words.sparkSession
    encoder = spark.sparkContext.broadcast(Encoder(m, variant))

    @F.pandas_udf("array<int>")
    def run(lang: pd.Series, word: pd.Series) -> pd.Series:
        encode = encoder.value
        return pd.Series([encode(x, w) for x, w in zip(lang, word, strict=True)], dtype=object)

    by = F.col("lang") if vocab_lang is None else F.lit(vocab_lang)
    distinct = words.select("lang", "word").distinct().where(by.isin(list(m.merges)))
    return distinct.select("lang", "word", run(by, "word").alias("ids"))


def encode_docs(docs: DataFrame, m: Merges, variant: str = "train", pattern: str = TRAIN_SPLIT_PATTERN,
                text_col: str = "text") -> DataFrame:
    """B4 for whole documents of ``docs(lang, ...)``: ``ids`` in place of the text. Tasks encode their
    own documents, and a word that they meet again comes from a cache."""
    encoder = docs.sparkSession.sparkContext.broadcast(Encoder(m, variant))

    @F.pandas_udf("array<int>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        encode, known = encoder.value, {}
        for langs, texts in batches:
            out = []
            for lang, tokens in zip(langs, texts, strict=True):
                if len(known) > MAX_CACHED_WORDS:
                    known.clear()
                ids = []
                for word in tokens:
                    found = known.get((lang, word))
                    if found is None:
                        found = known[lang, word] = encode(lang, word)
                    ids += found
                out.append(ids)
            yield pd.Series(out, dtype=object)

    others = [c for c in docs.columns if c != text_col]
    return docs.where(F.col("lang").isin(list(m.merges))) \
        .select(*others, run("lang", pretokens(F.coalesce(F.col(text_col), F.lit("")), pattern)).alias("ids"))


def decode(docs: DataFrame, vocab: DataFrame) -> DataFrame:
    """``docs(lang, ids, ...)`` with ``decoded``, the text of the ids. ``vocab`` becomes one row
    per language (as many tokens as the vocabulary size) and is broadcast."""
    tokens = vocab.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("token_id", "token"))),
                                                   lambda t: F.hex(t["token"])).alias("__hex"))
    joined = docs.join(F.broadcast(tokens), "lang", "left")
    text = F.decode(F.unhex(F.array_join(F.transform("ids", lambda i: F.get("__hex", i)), "")), "UTF-8")
    return joined.withColumn("decoded", text).drop("__hex")


def token_counts(words: DataFrame, encoded: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Tokens per group = sum(freq * number of ids) over distinct words."""
    by = by or ["lang"]
    j = words.join(encoded.select("lang", "word", F.size("ids").alias("n_ids")), ["lang", "word"])
    return j.groupBy(*by).agg(F.sum(F.col("freq") * F.col("n_ids")).cast("bigint").alias("tokens"),
                              F.sum("freq").cast("bigint").alias("words"))


def unknown_counts(words: DataFrame, encoded: DataFrame) -> DataFrame:
    """Per language all tokens and those that are [UNK], weighted by word frequency."""
    j = words.join(encoded, ["lang", "word"]).select(
        "lang", "freq", F.size("ids").alias("n"), F.size(F.filter("ids", lambda x: x == UNK)).alias("u"))
    return j.groupBy("lang").agg(F.sum(F.col("freq") * F.col("n")).cast("bigint").alias("tokens"),
                                 F.sum(F.col("freq") * F.col("u")).cast("bigint").alias("unk_tokens"))


__all__ = [
    "word_freqs", "learn_merges", "learn_train_merges", "learn_eval_merges", "vocab_table", "merged_bytes", "encode_words",
    "encode_docs", "decode", "token_counts", "unknown_counts", "Merges", "BYTE_LEVEL_PATTERN",
]
