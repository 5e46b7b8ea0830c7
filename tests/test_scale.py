"""What a query does on large tables, seen in its plan or on small tables that need the same step."""

import html
import os
import random

from pyspark.sql import functions as F

from corpuslab.functions import entities
from corpuslab.operators import metrics, stats
from corpuslab.plans import registry, views
from corpuslab.sources import readers


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_draws_are_not_broadcast(spark, sf001):
    """Draws are many times the scores, however small their size is guessed."""
    scores = stats.score_rows(registry._runs(spark, sf001))
    text = plan(stats.bootstrap_rows(scores, n_boot=20))
    assert "SortMergeJoin [n" in text and "BroadcastHashJoin [n" not in text


def test_entities_as_python_decodes_them(spark):
    """Only the entities go to Python, and the text comes out as ``html.unescape`` gives it."""
    rng = random.Random(1)
    parts = ["&amp;", "&amp", "&ampx;", "&notit;", "&#65;", "&#x41", "&#0;", "&#xD800;", "&#x110000;", "&#1;", "&", "&;", "&#", "&#;", "&#x;",
             "&nosuch;", "&&lt;&gt", "&" + "é" * 40, "&🙂;", " a b", "\n", ";", "#", "<", "é🙂", "&CounterClockwiseContourIntegral;"]
    texts = ["", None, "plain", *["".join(rng.choices(parts, k=rng.randint(1, 8))) for _ in range(300)], *parts]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    out = df.select("i", entities.unescape_html(F.col("t")).alias("t"))
    got = {r.i: r.t for r in out.collect()}
    assert got == {i: None if t is None else html.unescape(t) for i, t in enumerate(texts)}
    step = next(x for x in plan(out).splitlines() if "ArrowEvalPython" in x)
    assert "(regexp_extract_all(t" in step


def test_comparison_measures_once(spark):
    """Both sides of the comparison read the measured rows, not the lines."""
    lines = spark.createDataFrame([("en", "abcd ef"), ("de", "é x")], "lang string, line string")
    out = metrics.compare(metrics.efficiency(lines, F.char_length), "en")
    assert [tuple(r) for r in out.collect()] == [("en", "de", 0.3333, 1.3333)]
    assert "HashAggregate" not in plan(out)


def test_dump_has_more_files_for_more_pages(spark, sf001, tmp_path, monkeypatch):
    monkeypatch.setattr(views, "FILE_PAGES", 5)
    path = str(tmp_path / "dump")
    views.write_dump(spark, sf001, path)
    n = spark.read.parquet(f"{sf001}/documents.parquet").count()
    assert len([x for x in os.listdir(f"{path}/lang=en") if x.startswith("file=")]) > 10
    pages = readers.read_dump(spark, path)
    assert pages.count() == n
    ids = [int(r.id) for r in pages.where("lang = 'en' and id is not null").orderBy("ord").collect()]
    assert ids == sorted(ids)
