"""MinHash, lines, components: against brute force, and their edge cases."""

from __future__ import annotations

import random
import sys
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from corpuslab.llm import components, lines, minhash, stars  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts, schema=DOCS):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts], schema)


def words(rng, n, size=5000):
    return [f"w{rng.randrange(size)}" for _ in range(n)]


def edited(rng, w, n):
    w = list(w)
    for i in rng.sample(range(len(w)), n):
        w[i] = f"new{rng.randrange(10**6)}"
    return w


def test_components_against_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)]
    edges += [(i, i + 1) for i in range(1000, 1060)] + [(5000, i) for i in range(2000, 2100)] + [(7, 7)]
    df = spark.createDataFrame([*edges, (None, 3)], "a long, b long")
    got = {r["node"]: r["root"] for r in components.connected_components(df).collect()}
    want = brute.groups({x for e in edges for x in e}, edges)
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {k: v for k, v in want.items() if k in linked}
    assert components.connected_components(df.limit(0)).count() == 0


@pytest.mark.parametrize("width,percent", [(3, 85), (5, 80)])
def test_minhash_equals_brute_force_on_documents(spark, sf01, width, percent):
    docs = spark.read.parquet(f"{sf01}/documents.parquet")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"])
           for r in minhash.near_duplicates(docs, width, percent).collect()}
    assert got == brute.near_duplicates({r["doc_id"]: r["text"] for r in docs.collect()}, width, percent)


def test_minhash_large_groups_of_edited_copies(spark):
    """Copies two edits from a base link only through it; small sets; chains; ties."""
    rng = random.Random(5)
    texts = {}

    def add(w):
        texts[len(texts)] = " ".join(w)

    base = words(rng, 100)
    for _ in range(300):
        add(edited(rng, base, 2))
    add(base)
    small = words(rng, 16)
    add(small)
    add([*small, "tail"])
    add(["head", *small])
    chain = words(rng, 120)
    for _ in range(12):
        add(chain)
        chain = edited(rng, chain, 2)
    shared = words(rng, 90)
    for _ in range(200):
        add(words(rng, 60) + shared + words(rng, 60))
    for t in ("", "  \t\n", "one", "one", "one two", "One Two"):
        texts[len(texts)] = t
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"])
           for r in minhash.near_duplicates(frame(spark, texts.items()), 3, 85).collect()}
    assert got == brute.near_duplicates(texts, 3, 85)


def test_minhash_edges(spark):
    text = " ".join(words(random.Random(1), 50))
    rows = [(1, None), (2, ""), (None, text), (4, text), (3, text.upper()), (4, text), (9, "x " * 300_000), (5, "é")]
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in
                  minhash.near_duplicates(frame(spark, rows).withColumn("n", F.lit(1)), 3, 85).collect()), key=repr)
    assert got == sorted([(1, 0, 1), (2, 0, 2), (None, 48, None), (4, 48, 3), (3, 48, 3), (4, 48, 3), (9, 1, 9),
                          (5, 1, 5)], key=repr)
    kept = minhash.remove_near_duplicates(frame(spark, rows), 5, 80)
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1, 2, 3, 5, 9]
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert minhash.near_duplicates(frame(spark, rows).limit(0), 3, 85).count() == 0


def test_edit_distance():
    rng = random.Random(2)
    for _ in range(400):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(9))] for _ in range(2))
        assert lines.edit_distance(a, b) == brute.edits(a, b)


def test_lines(spark):
    rng = random.Random(8)
    long = words(rng, 80)
    near = edited(rng, long, 1)
    texts = [
        (1, "A first line of words here.\nOf.\n\n" + " ".join(long)),
        (2, "Of.\na first LINE of words, here\nanother line that stays as it is"),
        (3, "  a first line of words here!  \nA first line of words here."),
        (4, " ".join(near) + "\nOf."),
        (5, None), (6, ""), (None, "A first line of words here."),
    ]
    df = frame(spark, texts).withColumn("pos", F.lit(0)).withColumn("gone", F.lit(0)).withColumn("h", F.lit(0))
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in lines.remove_lines(df, least_words=5).collect()}
    assert got[1][0] == texts[0][1] and got[5][0] is None and got[6][0] == ""
    assert got[None][0] == texts[6][1]
    assert got[2] == ("Of.\nanother line that stays as it is", 36)
    assert got[3] == ("", 0)
    both = lines.WordBits().simhashes([[x.encode() for x in w] for w in (long, near)])
    keys, _ = lines.block_keys(both, np.array([len(long), len(near)], float))
    assert (keys[0] == keys[1]).any() and got[4][0] == "Of."
    short = {r["doc_id"]: r["text"] for r in lines.remove_lines(df).collect()}
    assert short[2] == "another line that stays as it is" and short[4] == ""
    assert lines.remove_lines(df.limit(0)).count() == 0
    assert lines.remove_lines(df).columns == df.columns


def test_minhash_texts_of_one_doc_id(spark):
    """All texts of a doc_id are one document, whose smallest reachable id all its links share."""
    x, y, z = "one two three four", "five six seven eight", "nine ten eleven twelve"
    rows = [(5, x), (7, x), (7, y), (9, y), (9, y), (3, z), (None, x), (4, "")]
    got = {(r["doc_id"], r["component_id"]) for r in minhash.near_duplicates(frame(spark, rows), 3, 85).collect()}
    assert got == {(5, 5), (7, 5), (9, 5), (3, 3), (None, None), (4, 4)}


def test_minhash_unlike_members_of_a_bucket(spark):
    """Texts with most of their words in common: some linked by a third one only, most not at all."""
    rng, base = random.Random(17), words(random.Random(18), 200)
    texts = {i: " ".join(edited(rng, base, 3 + i % 12)) for i in range(120)}
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"])
           for r in minhash.near_duplicates(frame(spark, texts.items()), 3, 85).collect()}
    want = brute.near_duplicates(texts, 3, 85)
    assert got == want and 3 < len({c for _, c in want.values()}) < 120


def test_lines_of_repeated_rows(spark):
    """Equal rows keep their lines; texts of one doc_id lose only their own."""
    one, two = "A first line of words here", "Another line that stays as it is"
    rows = [(1, f"{one}\n{two}"), (1, f"{one}\n{two}"), (2, one),
            (3, "Some five words stand here\ntail"), (3, f"{two}\ntail"),
            (4, f"{one}\n{one}"), (5, "Only copies hold these words"), (5, "Only copies hold these words")]
    got = sorted((r["doc_id"], r["text"]) for r in lines.remove_lines(frame(spark, rows), least_words=5).collect())
    assert got == sorted([*rows[:2], (2, ""), rows[3], (3, "tail"), (4, ""), *rows[6:]])


def line_links(texts, similarity):
    """All pairs of lines by edit similarity alone."""
    return {(a, b) for i, a in enumerate(texts) for b in texts[:i] if lines.similar(a, b, similarity)}


@pytest.mark.parametrize("similarity,least", [(0.8, 5), (0.7, 5), (0.9, 5), (0.55, 3)])
def test_line_keys_meet_for_all_similar_lines(similarity, least):
    """Whatever the order of the runs, similar lines share a key; few words, so runs repeat."""
    rng = random.Random(11)
    texts = set()
    for n in [*range(least, 26), 40, 60]:
        for size in (3, 400):
            w = words(rng, n, size)
            texts.add(" ".join(w))
            for _ in range(6):
                e = list(w)
                for _ in range(rng.randint(1, lines.most_edits(n + 2, similarity) + 1)):
                    i = rng.randrange(len(e))
                    e[i:i + rng.randint(0, 1)] = [f"x{rng.randrange(9)}"] * rng.randint(0, 1)
                if len(e) >= least:
                    texts.add(" ".join(e))
    texts = sorted(texts)
    links = line_links(texts, similarity)
    assert len(links) > 100
    width = lines.run_width(similarity, least)
    for seed in range(3):
        ranks = np.random.default_rng(seed).integers(0, 9, lines.CELLS).astype(np.uint8)
        keys = lines.line_keys([x.encode().split() for x in texts], lines.WordIds(), ranks, similarity, width)
        of = {x: set(np.frombuffer(k, np.uint64).tolist()) for x, k in zip(texts, keys, strict=True)}
        assert all(of[a] & of[b] for a, b in links)


def test_short_lines_are_searched_fuzzily(spark):
    """Lines of 5 to 11 words: as many edits as the similarity allows link, one more doesn't."""
    rng, rows = random.Random(12), []
    for n in range(5, 12):
        w = ["".join(rng.choices("abcdefgh", k=8)) for _ in range(n)]
        rows += [(10 * n, " ".join(w)), (10 * n + 1, " ".join([*w[:-(n // 5)], *"xy"[:n // 5]])),
                 (10 * n + 2, " ".join([*"pqr"[:n // 5 + 1], *w[n // 5 + 1:]]))]
    got = {r["doc_id"]: r["text"] for r in lines.remove_lines(frame(spark, rows)).collect()}
    assert got == {i: "" if i % 10 == 1 else t for i, t in rows}


def test_lines_by_edit_similarity_alone(spark, sf001):
    """Against the definition (equal lines, or edit similarity, whatever keys they have): nothing else goes, and
    nine in ten of the lines that go by an unequal line are found."""
    df = spark.read.parquet(f"{sf001}/documents.parquet")
    docs = {r["doc_id"]: r["text"] for r in df.collect()}
    at = [(d, i, lines.normalised(x)) for d, t in sorted(docs.items()) for i, x in enumerate(t.split("\n"))]
    at = [x for x in at if len(x[2].split()) >= lines.LEAST_WORDS]
    names = sorted({x for _, _, x in at})

    def gone(links):
        root, first, out = brute.groups(names, links), {}, set()
        for d, i, x in at:
            if first.setdefault(root[x], (d, i)) != (d, i):
                out.add((d, i))
        return out

    equal, want = gone([]), gone(line_links(names, 0.8))
    got = {(r["doc_id"], i) for r in lines.duplicate_lines(df).collect() for i in r["gone"]}
    assert equal < want and equal <= got <= want
    assert len(got - equal) >= 0.9 * len(want - equal)


def matches(rows, first_round, batch):
    """Candidates of ``(key, node, rest)`` rows, and the rows left for a second round."""
    names = ["key", "node", "rest"] + ([] if first_round else ["label"])
    df = pd.DataFrame(sorted(rows, key=lambda r: (r[0], r[2], r[1])), columns=names)
    out = pd.concat(lines.bucket_matches((df.iloc[i:i + batch] for i in range(0, len(df), batch)), first_round))
    pairs, left = out[out["b"].notna()], out[out["b"].isna()]
    return set(zip(pairs["a"], pairs["b"], strict=True)), list(zip(left["key"], left["a"], left["rest"], strict=True))


@pytest.mark.parametrize("batch", [1, 7, 10_000])
def test_bucket_matches_are_all_pairs(batch):
    """Buckets up to the window: both rounds give each pair that agrees; batches may cut a bucket anywhere."""
    rng, rows = random.Random(3), []
    for key, size in ((0, 1), (1, 2), (2, 3), (3, 40), (lines.PAIR_KEY, 9), (32, 200)):
        base = rng.getrandbits(62)
        for _ in range(size):
            flips = sum(1 << rng.randrange(62) for _ in range(rng.randrange(20)))
            rows.append((key, rng.randrange(1000), (base ^ flips) & (1 << 62) - 1))
    want = {(min(x[1], y[1]), max(x[1], y[1])) for x in rows for y in rows if x[0] == y[0] and x[1] != y[1]
            and (x[0] & 31 == lines.PAIR_KEY or (x[2] ^ y[2]).bit_count() <= 64 - lines.AGREE)}
    first, left = matches(rows, True, batch)
    assert first <= want and len(first) < len(want) and len(set(left)) <= len(set(rows))
    second, _ = matches([(*r, r[1]) for r in left], False, batch)
    assert first | second == want


def test_bags_lose_no_similar_pair():
    """Lines of one key that agree in all 64 bits are candidates only if their words allow so few edits; words parted by
    other white space count when lines are compared."""
    rng, allowed = random.Random(8), np.array([lines.most_edits(n, 0.8) for n in range(lines.MANY + 1)])
    vocabulary = [f"w{i}" for i in range(300)] + ["a\u00a0b\u2003c", "\u00a0", "caf\u00e9"]
    near, far = [], []
    for _ in range(3000):
        one = rng.choices(vocabulary, k=rng.randint(4, 80))
        two = list(one)
        for _ in range(rng.randint(0, len(one) // 4 + 1)):
            at = rng.randrange(len(two) + 1)
            two[at:at + rng.randint(0, 1)] = rng.choices(vocabulary, k=rng.randint(0, 1))
        if two and lines.similar(" ".join(one), " ".join(two), 0.8):
            near.append((one, two))
        far.append((one[:40], rng.choices(vocabulary[:300], k=len(one[:40]))))
    assert len(near) > 500
    of = lines.WordBits().simhashes_and_bags
    one, two = (of([[w.encode() for w in x[k]] for x in near])[1].view(np.int64) for k in (0, 1))
    assert lines.may_be_similar(one, two, allowed).all()
    one, two = (of([[w.encode() for w in x[k] if w.isascii()] or [b"x"] for x in far])[1].view(np.int64) for k in (0, 1))
    assert lines.may_be_similar(one, two, allowed).mean() < 0.05
    # one bucket of lines with a word in common: hardly any is left for a second round
    bag = of([[b"same", *(f"x{k}y{i}".encode() for i in range(15))] for k in range(100)])[1].view(np.int64)
    rows = pd.DataFrame({"key": 11, "node": range(100), "rest": 5, "bag": bag})
    assert sum(map(len, lines.bucket_matches(iter([rows]), True))) < 10


@pytest.mark.parametrize("hot", [False, True])
def test_large_buckets_lose_no_pair(spark, hot):
    """Like rows far apart in a bucket of 900, in one task and dealt out: both rounds give each pair."""
    rng = random.Random(5)
    rests = [rng.getrandbits(63) for _ in range(870)]
    rests += [x ^ (1 << 61) ^ (1 << 3) for x in rests[:30]]
    rows = [(64, i, x) for i, x in enumerate(rests)]
    near = {(i, j) for i in range(900) for j in range(i + 1, 900) if (rests[i] ^ rests[j]).bit_count() <= 64 - lines.AGREE}
    assert len(near) >= 30
    hot = spark.createDataFrame([(64, 9)] if hot else [(1, 9)], "key long, hot long")
    found = lines.searched(spark.createDataFrame(rows, "key long, node long, rest long"), hot, True).collect()
    first = {(r.a, r.b) for r in found if r.b is not None}
    left = {(r.key, r.a, r.rest, r.a) for r in found if r.b is None}
    left = spark.createDataFrame(sorted(left), "key long, node long, rest long, label long")
    assert first | {(r.a, r.b) for r in lines.searched(left, hot, False).collect()} == near


def test_word_bits_keep_all_similar_lines():
    """Lines of a word pair within the edits allowed differ in no more bits than these can change."""
    rng, ids = random.Random(6), lines.WordIds()
    ranks = np.zeros(lines.CELLS, np.uint8)
    for _ in range(300):
        one = [rng.choice("abcdefghij").encode() for _ in range(rng.randint(5, 11))]
        two = list(one)
        for _ in range(rng.randint(0, 2)):
            k = rng.randrange(len(two))
            two[k:k + rng.randint(0, 1)] = [rng.choice("klmnop").encode()] * rng.randint(0, 1)
        if not 2 <= len(two) < lines.SHORT or lines.edit_distance(one, two) > lines.most_edits(max(len(one), len(two)), 0.8):
            continue
        a, b = (np.frombuffer(x, np.uint64)[0] for x in lines.line_keys([one, two], ids, ranks, 0.8, 2))
        assert int(a ^ b).bit_count() <= 2 * lines.most_edits(lines.SHORT - 1, 0.8)


def test_line_families_in_one_bucket(spark):
    """A thousand variants of one line and a thousand of another: a family each, none lost, the rest stays."""
    rng, rows = random.Random(21), []
    for f in range(2):
        base = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(40)]  # digits would all read 0
        for k in range(1000):
            w = list(base)
            for _ in range(1 + k % 2):
                w[rng.randrange(40)] = "".join(rng.choices("ijklmnop", k=6))
            rows.append((f * 5000 + k, " ".join(w)))
    got = {r["doc_id"]: r["text"] for r in lines.remove_lines(frame(spark, rows)).collect()}
    assert {i for i, t in got.items() if t} == {0, 5000}


@pytest.mark.parametrize("linked", [[], [(700, 900)], [(i, i + 1) for i in range(200, 260)] + [(40, 990), (41, 991)]])
def test_stars_test_all_pairs_of_a_bucket(spark, linked):
    """One bucket of 1,000 unlike members but for a few links that no leader need witness."""
    members = spark.range(1000).selectExpr("1L as key", "id as node", "1000L as members").unionByName(
        spark.sql("select 2L as key, id as node, 3L as members from range(3)"))
    truth = spark.createDataFrame([*linked, (-1, -1)], "a long, b long")
    _, roots = stars.star_links(members, lambda pairs: pairs.join(truth, ["a", "b"]))
    want = brute.groups(range(1000), linked)
    in_links = {x for e in linked for x in e}
    assert {r["node"]: r["root"] for r in roots.collect()} == {k: want[k] for k in in_links}
