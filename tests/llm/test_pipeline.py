"""The pipeline against a plain version of each stage, judged on that stage's own input."""

from __future__ import annotations

import sys
from pathlib import Path

from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402
import corpus_pipeline  # noqa: E402

from corpuslab.llm import common, decontamination, lines, mixing, quality  # noqa: E402


def test_stages(spark, sf001):
    docs = common.read(spark, sf001, "documents")
    bench = [(str(r["item_id"]), r["text"]) for r in common.read(spark, sf001, "benchmark").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        out = common.shared_table(stage(spark, docs, sf001), "test-stage")
        if name != "mixing":
            assert out.columns == docs.columns
        after = {r["doc_id"]: r["text"] for r in out.collect()}
        if name == "quality rules":
            kept = quality.quality_digest(docs).where("kept").collect()
            assert set(after) == {r["doc_id"] for r in kept}
        elif name == "line dedup":
            gone = {r["doc_id"]: set(r["gone"]) for r in lines.duplicate_lines(docs).collect()}
            assert after == {k: "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone.get(k, ()))
                             for k, t in before.items()}
        elif name == "near dedup":
            want = brute.near_duplicates(before, 5, 80)
            assert set(after) == {k for k, (_, c) in want.items() if c == k}
        elif name == "decontamination":
            def grams(t, n=10):
                w = [x.decode() for x in decontamination.normal_words(t)]
                return {tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()
            known = set().union(*(grams(t) for _, t in bench))
            assert set(after) == {k for k, t in before.items() if not grams(t) & known}
        else:
            taken = {r["doc_id"]: r["taken"] for r in mixing.mix(docs).where("taken > 0").collect()}
            got = {r["doc_id"]: r["n"] for r in out.groupBy("doc_id").agg(F.sum("copy_words").alias("n")).collect()}
            assert got == taken
        if name != "line dedup" and name != "mixing":
            assert all(before[k] == t for k, t in after.items())
        docs = out
    assert corpus_pipeline.run(spark, sf001).count() == docs.count()


def test_stages_with_odd_columns_and_rows(spark, sf001):
    """Clashing and dotted names, nulls, repeated rows; and empty tables. (No such text is of quality.)"""
    long = " ".join(f"the word{i} and some more of it" for i in range(60))
    rows = [(1, long), (1, long), (1, long + " but not the same text"), (2, None), (None, long + "\nwith a null id"), (3, ""),
            (4, "of the and " * 30_000), (5, " ".join(f"the other{i} line is new here" for i in range(40)))]
    docs = spark.createDataFrame([(i, t, None, None, len(t or "")) for i, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("_q_n_words", "a.b", "key", "gone", "_own_text", "node"):
        docs = docs.withColumn(name, F.lit(7))
    for name, stage in corpus_pipeline.STAGES:
        out = common.shared_table(stage(spark, docs, sf001), "test-odd")
        assert out.columns[:len(docs.columns)] == docs.columns, name
        assert {r["a.b"] for r in out.collect()} == ({7} if name != "quality rules" else set()), name
        assert stage(spark, docs.limit(0), sf001).count() == 0, name
    left = corpus_pipeline.near_dedup(spark, docs, sf001)
    assert sorted(str(r["doc_id"]) for r in left.collect()) == ["1", "1", "2", "3", "4", "5", "None"]
