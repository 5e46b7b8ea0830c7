"""Dump scan (plain and bz2), page-id fallback, JSON lines, text lines, runs TSV, shards."""

import tempfile

import pytest
from pyspark.sql import functions as F

from corpuslab.plans import dump_job
from corpuslab.plans import prepare_job as pj
from corpuslab.plans.views import wikified_documents, write_dump
from corpuslab.operators.order import with_global_index
from corpuslab.sources import readers, writers


@pytest.mark.parametrize("compression", ["none", "bzip2"])
def test_dump_roundtrip(spark, sf001, compression):
    """Several files per language, read in splits shorter than a page."""
    path = tempfile.mkdtemp(prefix="corpuslab-dump-") + "/dump"
    write_dump(spark, sf001, path, files=2, compression=compression)
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        pages = readers.read_dump(spark, path)
        assert pages.rdd.getNumPartitions() > 20
        got = {(r.lang, r.id, r.title, r.text) for r in pages.collect()}
        w = wikified_documents(spark, sf001).collect()
        assert got == {(r.lang, None if r.doc_id % 50 == 4 else str(r.doc_id), r.title, None if r.doc_id % 50 == 3 else r.text)
                       for r in w}
        assert len(got) == len(w) == 200 and sum(x[2] is None for x in got) > 5 and sum(x[3] is None for x in got) > 10
        arts = readers.with_page_ids(dump_job.articles(pages), ["lang"])
        rows = sorted(arts.select("lang", "ord", "id", "title").collect(), key=lambda r: (r.lang, r.ord))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    before, unnamed = {}, 0
    for r in rows:
        doc = int(r.title.split("Doc ")[1])
        assert r.id == (str(before.get(r.lang, 0)) if doc % 50 == 4 else str(doc))
        before[r.lang] = before.get(r.lang, 0) + 1
        unnamed += doc % 50 == 4
    assert unnamed


def test_dump_pages_of_odd_forms(spark, tmp_path):
    (tmp_path / "d.xml").write_text(
        "<mediawiki><siteinfo/><page><title> A </title><id>1</id><revision><text>x &amp; &lt;b&gt; </text></revision></page>\n"
        "<page><title>B</title><revision><id>5</id></revision><revision><text a='1'>second</text></revision></page>"
        "<page><id>3</id><revision><text></text></revision><revision><text>z</text></revision></page>"
        "<page><title/><revision><text><![CDATA[<raw>]]></text></revision></page><page></page></mediawiki>")
    rows = [(r.id, r.title, r.text) for r in readers.read_dump(spark, str(tmp_path)).orderBy("ord").collect()]
    assert rows == [("1", "A", "x & <b> "), (None, "B", "second"), ("3", None, None), (None, "", "<raw>"), (None, None, None)]


def test_articles_lines_runs_roundtrip(spark, sf001):
    d = tempfile.mkdtemp(prefix="corpuslab-io-")
    docs = spark.read.parquet(f"{sf001}/documents.parquet").select(
        "lang", F.col("doc_id").cast("string").alias("id"), F.lit("t").alias("title"), "text")
    writers.write_articles(docs, f"{d}/articles")
    back = readers.read_articles(spark, f"{d}/articles/lang=en")
    assert back.count() == docs.where("lang = 'en'").count()
    lines = docs.select("lang", F.col("id").cast("long").alias("ord"), F.col("text").alias("paragraph"))
    writers.write_lines(lines, f"{d}/lines", order=["ord"])
    rl = readers.read_lines(spark, f"{d}/lines/lang=en", "en")
    texts = lines.where("lang = 'en'").orderBy("ord").collect()
    want = [x for r in texts for x in r.paragraph.split("\n")]
    assert [r.line for r in rl.orderBy("line_no").collect()] == want
    assert sorted(r.line_no for r in rl.select("line_no").collect()) == list(range(len(want)))
    with open(f"{d}/runs.tsv", "w") as f:
        f.write("run_id\tlanguage\tsize\tseed\ttokenizer_type\tval_bpb\ttokens\twallclock_s\thparams_json\n")
        f.write('a\tenglish\t10M\t1\tbpe\t1.5\t100\t9.5\t{"lr": 1}\n')
        f.write('b\tesperanto\t10M\t1\tbpe\t1.25\t100\t9.5\t"{""lr"": 2}"\n')
    runs = readers.read_runs(spark, f"{d}/runs.tsv").orderBy("run_ord").collect()
    assert [r.val_bpb for r in runs] == [1.5, 1.25] and runs[1].hparams_json == '{"lr": 2}'
    assert readers.read_runs(spark, f"{d}/missing.tsv").count() == 0


def test_shards_written_in_order(spark, sf001):
    d = tempfile.mkdtemp(prefix="corpuslab-shards-")
    split = pj.split_docs(pj.load_docs(spark.read.parquet(f"{sf001}/documents.parquet")))
    sh = pj.assign_shards(split, docs_per_shard=20, start=6540)
    writers.write_shards(sh, f"{d}/shards")
    back = spark.read.parquet(f"{d}/shards")
    assert back.count() == split.count()
    shards = sorted({r.shard for r in back.where("split = 'train'").select("shard").distinct().collect()})
    assert 6542 not in shards and 6541 in shards and 6543 in shards
    assert {r.shard for r in back.where("split = 'val'").select("shard").distinct().collect()} == {6542}


def test_many_files_are_read_in_order(spark):
    d = tempfile.mkdtemp(prefix="corpuslab-order-")
    for k, (letter, n) in enumerate((("a", 10), ("b", 1000), ("c", 3))):
        with open(f"{d}/part-{k:05d}.txt", "w") as f:
            f.writelines(f"{letter}{i}\n" for i in range(n))
    got = [r.line for r in readers.read_lines(spark, d).orderBy("line_no").collect()]
    assert got == [f"{x}{i}" for x, n in (("a", 10), ("b", 1000), ("c", 3)) for i in range(n)]


def test_runs_are_read_by_name(spark):
    d = tempfile.mkdtemp(prefix="corpuslab-runs-")
    with open(f"{d}/a.tsv", "w") as f:
        f.write("run_id\tsize\tlanguage\tseed\tval_bpb_final\ttraining_tokens\tval_bpb_curve\n")
        f.write("a\t10M\tenglish\t1\t1.5\t100\t[1.0]\n")
    r = readers.read_runs(spark, f"{d}/a.tsv").first()
    assert (r.language, r.size, r.val_bpb, r.tokens, r.tokenizer_type, r.val_bpb_curve) == (
        "english", "10M", 1.5, "100", None, "[1.0]")
    with open(f"{d}/b.tsv", "w") as f:
        f.write("run_id\tval_bpb\na\toops\n")
    with pytest.raises(Exception, match="oops"):
        readers.read_runs(spark, f"{d}/b.tsv").collect()
    with open(f"{d}/c.json", "w") as f:
        f.write('{"id": "1", "text": "x"}\n{broken\n')
    with pytest.raises(Exception):
        readers.read_articles(spark, f"{d}/c.json").collect()


def test_index_with_payload_over_a_million_rows(spark):
    df = spark.range(1_200_000, numPartitions=8).select(
        F.col("id").alias("k"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("lang"),
        F.concat(F.lit("text "), F.md5(F.col("id").cast("string"))).alias("text"))
    out = with_global_index(df, ["k"], ["lang"])
    rows = out.groupBy("lang").agg(F.count("*").alias("n"), F.countDistinct("idx").alias("d"), F.max("idx").alias("m"),
                                   F.sum(F.when(F.col("idx") != F.floor(F.when(F.col("lang") == "a", F.col("k") / 3)
                                         .otherwise(F.col("k") - F.floor(F.col("k") / 3) - 1)), 1).otherwise(0)).alias("bad"))
    assert {(r.lang, r.n, r.d, r.m, r.bad) for r in rows.collect()} == {
        ("a", 400_000, 400_000, 399_999, 0), ("b", 800_000, 800_000, 799_999, 0)}
    # both branches read one materialised table: no exchange of the input is left in the plan
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and plan.count("Scan ExistingRDD") == 2
