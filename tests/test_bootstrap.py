"""The bootstrap over cells of any size: draws made in blocks, dealt to chunks of scores."""

import hashlib
import random
import re

import numpy as np
import pytest

from corpuslab.functions.md5 import md5_heads
from corpuslab.operators import stats
from corpuslab.plans import registry


def head(key):
    return int(hashlib.md5(key.encode()).hexdigest()[:8], 16)


@pytest.mark.parametrize("first, last", [(0, 12_000), (9, 11), (7, 7), (99_995, 100_010), (199_990, 200_010), (10**12 - 3, 10**12 + 3)])
def test_md5_heads(first, last):
    """Keys of every length and place of the digits in a word."""
    tables = {}
    for prefix in ("", "1:", "42:7:", "42:17:", "42:499:", "-123456:9999:"):
        got = md5_heads(prefix, first, last, tables)
        assert got.tolist() == [head(f"{prefix}{j}") for j in range(first, last)]


def test_a_key_is_one_block():
    with pytest.raises(ValueError):
        md5_heads("x" * 55, 0, 1)


def quantile(means, q):
    return float(np.quantile(means, q)) if means else None


def plain(vals, n_boot, seed):
    """One draw at a time; null scores count neither in a sum nor in its number."""
    def mean(x):
        x = [v for v in x if v is not None]
        return sum(x) / len(x) if x else None
    n = len(vals)
    means = [m for r in range(n_boot) if (m := mean([vals[head(f"{seed}:{r}:{j}") % n] for j in range(n)])) is not None]
    return mean(vals), quantile(means, 0.025), quantile(means, 0.975), n


@pytest.mark.parametrize("small", [False, True])
def test_bootstrap_rows_as_one_draw_at_a_time(spark, monkeypatch, small):
    """Cells of equal and of other sizes, null scores, a cell of nulls, one of a score."""
    if small:  # cells of many blocks and chunks, replicates and cells of many rows
        for name, value in (("DRAW_BLOCK", 100), ("CHUNK_SCORES", 16), ("ROW_REPLICATES", 3), ("ROW_CELLS", 2)):
            monkeypatch.setattr(stats, name, value)
    rng = random.Random(5)
    cells = {f"c{i}": [rng.gauss(3, 1) for _ in range(n)] for i, n in enumerate((1, 5, 5, 5, 300, 301, 301))}
    cells["some"] = [None if i % 7 == 0 else rng.gauss(3, 1) for i in range(300)]
    cells["none"] = [None] * 300
    rows = [(c, pos, v, len(vals)) for c, vals in cells.items() for pos, v in enumerate(vals)]
    scores = spark.createDataFrame(rows, "language string, pos bigint, val_bpb double, n bigint")
    got = {r.language: tuple(r)[1:] for r in stats.bootstrap_rows(scores, ["language"], n_boot=10, seed=7).collect()}
    assert got.keys() == cells.keys()
    for c, vals in cells.items():
        assert got[c] == pytest.approx(plain(vals, 10, 7)), c


def test_infinite_scores_stay_in_their_place(spark):
    """Replicates that don't draw an infinite score have finite means."""
    inf = float("inf")
    rows = [(c, pos, x if pos == 2 else 1.0, 40) for c, x in (("up", inf), ("down", -inf)) for pos in range(40)]
    scores = spark.createDataFrame(rows, "language string, pos bigint, val_bpb double, n bigint")
    got = {r.language: (r.ci_lo, r.ci_hi) for r in stats.bootstrap_rows(scores, ["language"], n_boot=50).collect()}
    assert got == {"up": (1.0, inf), "down": (-inf, 1.0)}


def test_draws_are_made_by_many_tasks(spark, sf001):
    """The rows that stand for draws are few and small, so a shuffle of them is put into one task."""
    scores = stats.score_rows(registry._runs(spark, sf001))
    text = stats.bootstrap_rows(scores, n_boot=20)._jdf.queryExecution().executedPlan().toString()
    tasks = re.search(r"Range \(0, 20, step=1, splits=(\d+)\)", text)
    assert tasks and int(tasks[1]) == min(20, spark.sparkContext.defaultParallelism)


def test_no_scores(spark):
    scores = spark.createDataFrame([], "language string, pos bigint, val_bpb double, n bigint")
    assert stats.bootstrap_rows(scores, ["language"], n_boot=5).collect() == []
