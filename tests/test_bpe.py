"""Learning merges in rounds equals one merge at a time; encoding, vocabularies, round trips."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslab.functions.tokens import byte_ids
from corpuslab.operators import bpe, merges


def naive_merges(words, num_merges, min_freq=1):
    """One merge at a time: (left, right, new id, count) by count desc, left, right."""
    seqs, out = [(list(w), f) for w, f in words], []
    for new in range(256, 256 + num_merges):
        counts = {}
        for s, f in seqs:
            for pair in zip(s, s[1:]):
                counts[pair] = counts.get(pair, 0) + f
        if not counts:
            break
        (left, right), c = min(counts.items(), key=lambda kv: (-kv[1], kv[0]))
        if c < min_freq:
            break
        out.append((left, right, new, c))
        seqs = [(naive_apply(s, left, right, new), f) for s, f in seqs]
    return out


def naive_apply(s, left, right, new):
    out, i = [], 0
    while i < len(s):
        hit = s[i:i + 2] == [left, right]
        out.append(new if hit else s[i])
        i += 1 + hit
    return out


def naive_bytes(learned):
    tokens = {i: bytes([i]) for i in range(256)}
    for left, right, new, _ in learned:
        tokens[new] = tokens[left] + tokens[right]
    return tokens


def _table(seed, n=60, alphabet="abcde", longest=7):
    rng, table = random.Random(seed), {}
    for lang in ("x", "y"):
        for _ in range(n):
            w = "".join(rng.choice(alphabet) for _ in range(rng.randint(1, longest)))
            table[lang, w] = table.get((lang, w), 0) + rng.randint(1, 9)
    return [(lang, w, f) for (lang, w), f in table.items()]


def _words(spark, table):
    df = spark.createDataFrame(table, "lang string, word string, freq bigint")
    return df.withColumn("syms", byte_ids(F.col("word")))


def _naive(table, lang, num_merges, min_freq=1):
    return naive_merges([(w.encode(), f) for x, w, f in table if x == lang], num_merges, min_freq)


@pytest.mark.parametrize("sample_words,first_batch", [(10**6, 256), (12, 8), (1, 3)])
def test_learn_equals_naive(spark, sample_words, first_batch):
    """All words proposed in one round; a sample, in several rounds; hardly any sample."""
    table = _table(7)
    got = bpe.learn_merges(_words(spark, table), 40 if sample_words > 1 else 8, min_freq=2, sample_words=sample_words,
                           first_batch=first_batch)
    for lang in ("x", "y"):
        assert got.merges[lang] == _naive(table, lang, 40 if sample_words > 1 else 8, 2)
    assert got.rounds == 1 if sample_words > 100 else got.rounds > 1


def test_learn_until_pairs_run_out(spark):
    table = [("x", "abab", 3), ("x", "aaaa", 2), ("y", "q", 5), ("y", "zz", 1)]
    got = bpe.learn_merges(_words(spark, table), 100)
    assert got.merges["x"] == _naive(table, "x", 100) and got.merges["y"] == _naive(table, "y", 100)
    assert bpe.learn_merges(_words(spark, table), 100, min_freq=2).merges["y"] == []
    assert bpe.learn_merges(_words(spark, table), {"x": 1, "y": 0}).merges == {"x": _naive(table, "x", 1), "y": []}
    empty = bpe.learn_merges(_words(spark, table).limit(0), 5)
    assert empty.merges == {} and empty.frame(spark).count() == 0


@pytest.mark.parametrize("seed", range(40))
def test_proposals_from_true_counts(seed):
    """The first proposal is exact from any sample; all are if the sample is all words."""
    table = [(list(w.encode()), f) for lang, w, f in _table(seed, 30, "ab", 30) if lang == "x"]
    want = [(a, b) for a, b, _, _ in naive_merges(table, 25, 2)]
    assert merges.propose([list(s) for s, _ in table], [f for _, f in table], None, 25, 256, 2) == want
    true = {}
    for s, f in table:
        for a, b in zip(s, s[1:]):
            true[a << 20 | b] = true.get(a << 20 | b, 0) + f
    some = table[::7]
    assert merges.propose([list(s) for s, _ in some], [f for _, f in some], true, 5, 256, 2)[0] == want[0]


@pytest.mark.parametrize("seed", range(40))
def test_pieces_merged_all_at_once(seed):
    """Flat arrays, runs of one symbol and merges side by side included, give one merge at a time."""
    rng = random.Random(seed)
    alphabet = "abcde"[:1 + seed % 5]
    table = {"".join(rng.choices(alphabet, k=rng.randint(0, 40))): rng.randint(1, 9) for _ in range(rng.randint(0, 30))}
    table = [(list(w.encode()), f) for w, f in table.items()]
    least = 1 + seed % 3
    want = [(a, b, n) for a, b, _, n in naive_merges(table, 60, least)]
    flat, lengths = np.array([x for s, _ in table for x in s], np.int32), np.array([len(s) for s, _ in table], np.int64)
    assert merges.greedy_pieces(flat, lengths, np.array([f for _, f in table], np.int64), 60, 256, least) == want


def test_pieces_of_half_a_million_words_in_one_round(spark):
    """More than 400,000 pieces, held as numbers: one round (there were several)."""
    words = spark.range(450_000).select(F.lit("x").alias("lang"), F.lit(1).cast("bigint").alias("freq"), F.array(
        *[(97 + F.floor(F.col("id") / 26 ** k) % 26).cast("int") for k in range(4)]).alias("syms"))
    got = bpe.learn_merges(words, 60)
    assert got.rounds == 1 and len(got.merges["x"]) == 60


def test_first_beaten():
    counts, pairs = np.array([9, 7, 7, 5, 5, 5]), np.array([30, 10, 20, 40, 50, 60])

    def first(pair, value, start=0, end=99):
        return merges.first_beaten(counts, pairs, *(np.array([x]) for x in (pair, value, start, end)))[0]

    assert first(99, 10) == 0 and first(99, 8) == 1 and first(99, 4) == 6
    assert first(5, 7) == 1 and first(15, 7) == 2 and first(99, 7) == 3
    assert first(45, 5) == 4 and first(45, 5, end=3) == 6 and first(45, 5, start=5) == 5
    assert first(99, 7, end=2) == 6


@pytest.mark.parametrize("alphabet,longest", [("ab", 60), ("aé", 40), ("abc d", 90)])
def test_long_words_encode_like_short_ones(alphabet, longest, monkeypatch):
    rng = random.Random(longest)
    learned = naive_merges([(w.encode(), f) for _, w, f in _table(3, 40, alphabet, longest)], 60)
    ranks = {a << 20 | b: (k, new) for k, (a, b, new, _) in enumerate(learned)}
    for _ in range(100):
        word = list("".join(rng.choice(alphabet) for _ in range(rng.randrange(longest))).encode())
        want = word
        for a, b, new, _ in learned:
            want = naive_apply(want, a, b, new)
        assert merges.merge_word(word, ranks) == want
        notes = []
        for short in (10**6, 0):  # both ways note the same changes
            monkeypatch.setattr(merges, "SHORT_WORD", short)
            changes = merges.defaultdict(int)
            assert merges.merge_word(word, ranks, changes, 3) == want
            notes.append({k: v for k, v in changes.items() if v})
        monkeypatch.undo()
        assert notes[0] == notes[1]


def test_a_very_long_word_is_fast():
    ranks = {97 << 20 | 98: (0, 256), 256 << 20 | 256: (1, 257)}
    start = time.time()
    assert merges.merge_word([97, 98] * 50_000, ranks) == [257] * 25_000
    assert time.time() - start < 5


TEXTS = [("en", 1, "Hello world! Saluton mondo! Ĉu vi parolas Esperanton? hello  hello\n\n world " + "ab" * 30_000),
         ("en", 2, ""), ("en", 3, None), ("eo", 4, "Ĉu vi parolas Esperanton? Jes, mi parolas. la la la 🙂")]


@pytest.fixture(scope="module")
def trained(spark):
    docs = spark.createDataFrame(TEXTS, "lang string, doc_id long, text string")
    words = bpe.word_freqs(docs)
    return docs, words, bpe.learn_train_merges(words, 256 + 4 + 40)


def test_vocabulary(spark, trained, tmp_path):
    from corpuslab.sources import readers, writers
    _, _, m = trained
    for variant, specials in (("train", bpe.TRAIN_SPECIALS), ("eval", bpe.EVAL_SPECIALS)):
        vocab = bpe.vocab_table(spark, m, variant)
        writers.write_vocab(vocab, m.frame(spark), str(tmp_path / variant))
        vocab, merge_table = readers.read_vocab(spark, str(tmp_path / variant))
        assert sorted(tuple(r) for r in merge_table.select("lang", "rank", "left_id", "right_id", "new_id", "freq").collect()) == \
            sorted((lang, k, *x) for lang, xs in m.merges.items() for k, x in enumerate(xs))
        for lang, learned in m.merges.items():
            tokens = naive_bytes(learned)
            if variant == "train":
                want = [tokens[i] for i in range(256 + len(learned))] + [s.encode() for s in specials]
            else:
                want = [s.encode() for s in specials] + [bytes([b]) for b in m.alphabet[lang]] + [tokens[x[2]] for x in learned]
            rows = vocab.where(F.col("lang") == lang).orderBy("token_id").collect()
            assert [r.token_id for r in rows] == list(range(len(want)))
            assert [bytes(r.token) for r in rows] == want
            for r in rows:
                own = bytes(r.token)
                assert r.is_special == (own.decode("utf-8", "replace") in specials)
                assert r.n_bytes == (0 if r.is_special else len(own))
                assert r.n_bytes_decoded == (0 if r.is_special else len(own.decode("utf-8", "replace").encode()))


def test_encode_decode_and_counts(spark, trained):
    docs, words, m = trained
    vocab = bpe.vocab_table(spark, m)
    coded = bpe.encode_docs(docs, m)
    got = {r.doc_id: (r.decoded, r.ids) for r in bpe.decode(coded, vocab).collect()}
    assert {k: v[0] for k, v in got.items()} == {k: t or "" for _, k, t in TEXTS}
    assert len(got[1][1]) < 2_000  # the long word is made of few tokens
    counts = {r.lang: r.tokens for r in bpe.token_counts(words, bpe.encode_words(words, m)).collect()}
    assert counts == {"en": len(got[1][1]), "eo": len(got[4][1])}


def test_eval_variant(spark):
    texts = spark.createDataFrame([("en", "aaa bbb aaa"), ("eo", "zz zz")], "lang string, text string")
    words = bpe.word_freqs(texts, pattern=bpe.BYTE_LEVEL_PATTERN)
    m = bpe.learn_eval_merges(words, 4 + 3 + 2)
    assert m.alphabet == {"en": [32, 97, 98], "eo": [32, 122]}
    # "aa" (4), then "bb" (2, before "aa" "a" of the same count); the limits of size and of frequency
    assert [x[:2] for x in m.merges["en"]] == [(97, 97), (98, 98)] and len(m.merges["eo"]) == 1
    other = bpe.word_freqs(spark.createDataFrame([("en", "abc zzz"), ("eo", "az é")], "lang string, text string"),
                           pattern=bpe.BYTE_LEVEL_PATTERN)
    rows = {r.lang: (r.tokens, r.unk_tokens) for r in bpe.unknown_counts(other, bpe.encode_words(other, m, "eval")).collect()}
    assert rows == {"en": (7, 4), "eo": (5, 3)}
    rows = {r.lang: r.unk_tokens for r in bpe.unknown_counts(other, bpe.encode_words(other, m, "eval", "en")).collect()}
    assert rows == {"en": 4, "eo": 3}


@pytest.mark.parametrize("seed", range(3))
def test_few_rounds_from_few_pieces(spark, seed, monkeypatch):
    """Words cut at rare pairs give the same merges, and many of them a round, though the task holds
    a tenth of the words."""
    rng = random.Random(seed)
    table = [("x", w, rng.choice([1, 1, 2, 3, 9])) for w in sorted({"".join(rng.choices("abcdefgh", range(8, 0, -1), k=rng.randint(2, 9)))
                                                                   for _ in range(1_500)})]
    monkeypatch.setattr(merges, "HASHES", 1)
    got = bpe.learn_merges(_words(spark, table), 150, min_freq=2, sample_words=len(table) // 10)
    assert got.merges["x"] == _naive(table, "x", 150, 2)
    assert 1 < got.rounds < 15
