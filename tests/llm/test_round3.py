"""N-gram join, periodic runs, divergence audit: against brute force, and their edge cases."""

from __future__ import annotations

import hashlib
import random
import sys
import time
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from corpuslab.llm import divergence, overlap, periods  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts, schema=DOCS):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts], schema)


# ---------------------------------------------------------------- n-gram join


@pytest.mark.parametrize("width,percent", [(3, 90), (5, 80)])
def test_join_equals_brute_force_on_documents(spark, sf01, width, percent):
    docs = spark.read.parquet(f"{sf01}/documents.parquet")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in overlap.jaccard_join(docs, width, percent).collect()}
    assert got == brute.near_duplicates({r["doc_id"]: r["text"] for r in docs.collect()}, width, percent)


@pytest.mark.parametrize("percent", [50, 80, 90, 97])
def test_linked_sets_share_a_key(percent):
    """Any two sets at the threshold share a column block, sizes from one up and at the bounds."""
    rng, ranges = np.random.default_rng(percent), overlap.SizeRanges(percent)
    for n in [*range(1, 60), 100, 333, 1000]:
        for _ in range(6):
            more = int(rng.integers(0, n * 100 // percent - n + 1))
            both = max(-(-percent * (2 * n + more) // (100 + percent)), 0)
            if both > n:
                continue
            x = rng.integers(0, 2**64, 2 * n + more - both, np.uint64)
            a, b = np.sort(x[:n]), np.sort(x[n - both:])
            assert len(b) == n + more
            assert np.intersect1d(overlap.block_keys(a, ranges), overlap.block_keys(b, ranges)).size


def test_join_of_large_families(spark, monkeypatch):
    """Row blocks: variants linked only through a base, chains, and a family that stays in parts."""
    monkeypatch.setattr(overlap, "ROW_BLOCK", 8)
    rng, texts = random.Random(11), {}
    base = [f"b{i}" for i in range(80)]
    for k in range(60):  # two edits from the base: linked with it, hardly with each other
        w = list(base)
        for i in rng.sample(range(80), 1 if k % 2 else 2):
            w[i] = f"new{rng.randrange(10**6)}"
        texts[100 + k] = " ".join(w)
    texts[160] = " ".join(base)
    chain = [f"c{i}" for i in range(100)]
    for k in range(30):
        texts[500 - k] = " ".join(chain)
        chain[k * 3] = f"z{k}"
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"])
           for r in overlap.jaccard_join(frame(spark, texts.items()), 3, 90).collect()}
    assert got == brute.near_duplicates(texts, 3, 90)


def test_join_cases(spark):
    texts = [(1, None), (2, ""), (3, " \n "), (4, "a b"), (5, "A  B"), (6, "a b c"), (None, "a b"), (7, "x y z w"), (8, "x y z w"),
             (8, "x y z w"), (8, "p q r s t"), (9, "P q r s t"), (10, "w " * 50000), (11, "w w w w")]
    df = frame(spark, texts).withColumn("key", F.lit(1)).withColumn("node", F.lit(2)).withColumn("a.b", F.lit(3))
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in overlap.jaccard_join(df, 3, 90).collect()}
    assert got == {(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (6, 1, 6), (None, 1, None), (7, 2, 7), (8, 2, 7),
                   (8, 3, 7), (9, 3, 7), (10, 1, 10), (11, 1, 10)}
    assert overlap.jaccard_join(df, 3, 90).count() == len(texts)
    assert overlap.jaccard_join(df.limit(0), 3, 90).count() == 0


# ---------------------------------------------------------------- periodic runs


def brute_runs(x, least_length=6, least_exponent=4):
    """All maximal stretches of each period, and of those of one place the smallest period."""
    found, n = {}, len(x)
    for q in range(1, n // least_exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and x[j] == x[j + q]:
                j += 1
            if j + q - i >= max(least_length, least_exponent * q) and (i, j + q) not in found:
                found[i, j + q] = q
            i = j + 1
    return sorted(((a, b - a, q) for (a, b), q in found.items()), key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("least_length,least_exponent", [(6, 4), (2, 3), (9, 5)])
def test_runs_against_brute_force(least_length, least_exponent):
    rng = random.Random(least_exponent)
    for k in range(400):
        x = [rng.randrange(1 + k % 4) for _ in range(rng.randrange(60))]
        for _ in range(k % 3):
            part = [rng.randrange(3) for _ in range(rng.randrange(1, 5))]
            x += part * rng.randrange(1, 8) + part[:rng.randrange(len(part))]
        assert periods.find_runs(np.array(x, np.int64), least_length, least_exponent) == \
            brute_runs(x, least_length, least_exponent), x


def test_long_texts_in_blocks(monkeypatch):
    monkeypatch.setattr(periods, "BLOCK", 4)
    x = ([1, 2] * 40 + [3]) * 12 + [1] * 50
    assert periods.find_runs(np.array(x)) == brute_runs(x)
    monkeypatch.undo()
    start = time.time()
    assert periods.find_runs(np.zeros(100_000, np.int64)) == [(0, 100_000, 1)]
    assert time.time() - start < 20


def brute_row(doc_id, text):
    w = brute.SPACE.findall(text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(w), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None, None, None))
    return (doc_id, len(runs), *best, None if best[0] is None else 1000 * best[1] // best[2],
            brute.sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)),
            hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest())


def test_runs_query_against_brute_force(spark, sf001, tmp_path):
    got = sorted(tuple(r) for r in periods.op12_periodic_runs(spark, sf001).collect())
    rows = spark.read.parquet(f"{sf001}/documents.parquet").collect()
    assert got == sorted(brute_row(r["doc_id"], r["text"]) for r in rows)
    assert sum(r[1] > 0 for r in got) >= 5


def test_runs_cases(spark):
    texts = [(1, None), (2, ""), (3, " \t\n"), (4, "a " * 6), (4, "a " * 6), (None, "x y " * 4), (6, "a b a b a b a"),
             (7, "é é é é é é b c b c b c b c"), (8, "a b c " * 4 + "d d d d d d")]
    df = frame(spark, texts).withColumn("runs", F.lit(1)).withColumn("found_runs", F.lit(2)).withColumn("a.b", F.lit(3))
    rows = periods.periodic_runs(df).collect()
    assert len(rows) == len(texts) and rows[0]["a.b"] == 3 and rows[0]["found_runs"] == 2
    got = {(r["doc_id"], r["n_words"], tuple(tuple(x) for x in r["runs"]), r["best"], r["collapsed"]) for r in rows}
    assert got == {(1, 0, (), None, ""), (2, 0, (), None, ""), (3, 0, (), None, ""), (4, 6, ((0, 6, 1),), 0, "a"),
                   (None, 8, ((0, 8, 2),), 0, "x y"), (6, 7, (), None, "a b a b a b a"),
                   (7, 14, ((0, 6, 1), (6, 8, 2)), 0, "é b c"), (8, 18, ((0, 12, 3), (12, 6, 1)), 1, "a b c d")}
    assert periods.periodic_runs(df.limit(0)).count() == 0


# ---------------------------------------------------------------- divergence audit


def same_as_sql(spark, rows, tmp_path, **blocks):
    schema = "doc_id long, text string, lang string, source string"
    df = spark.createDataFrame(rows, schema)
    df.write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/d/*.parquet'")
    want = sorted(con.sql(divergence.OP13_SQL).fetchall())
    extra = df.withColumn("term", F.lit("x")).withColumn("p", F.lit(1)).withColumn("a.b", F.lit(2))
    got = sorted(tuple(r) for r in divergence.divergence_audit(extra, **blocks).collect())
    assert got == want
    return got


def test_divergence_in_cells(spark, tmp_path):
    """Several group blocks and term blocks, groups without terms, a lang without kept terms."""
    rng = random.Random(13)
    rows = [(i, " ".join(rng.choice("abcdefgh") * rng.randrange(1, 5) for _ in range(rng.randrange(30))),
             "en" if i % 3 else "fr", f"s{rng.randrange(9)}") for i in range(300)]
    rows += [(1, None, "en", "quiet"), (2, "", "fr", None), (3, "only here", "de", "a"), (4, "1234 --", "de", "b"),
             (5, "Été été ÉTÉ", None, "a"), (5, "Été été ÉTÉ", None, "a"), (None, None, None, None)]
    got = same_as_sql(spark, rows, tmp_path, group_block=3, term_block=4)
    assert {(r[0], r[1]) for r in got} >= {("en", "quiet"), ("fr", ""), ("de", "a"), ("", "")}


def test_divergence_repeated_rows_and_empty(spark, tmp_path):
    rows = [(7, "same same other", "en", "a")] * 12 + [(8, "Other", "en", "b")]
    assert any(r[2] == "term" for r in same_as_sql(spark, rows, tmp_path))
    assert divergence.divergence_audit(spark.createDataFrame([], "text string, lang string, source string")).count() == 0


def test_shares_are_exact_for_large_counts(spark):
    n, total, terms = 5 * 10**12 + 1, 7 * 10**13, 10**7
    got = spark.range(1).select(divergence.share(F.lit(n), F.lit(total), F.lit(terms)).alias("p")).first()["p"]
    assert got == 1 + 10**9 * (n + 2) // (total + 2 * terms)
