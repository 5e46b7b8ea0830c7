"""Operator 6, mixing sources to target weights: capped water-filling and seeded repetitions.

Method: sources (by code point, null last) take the weights 3, 1, 2, repeating, and share a
budget of words. A target stops at ``max_epochs`` times its source's size; the excess goes
to the others in proportion to their weights until none is above its cap. That fixed point
has a closed form: with sources ordered by cap / weight, the first ``k`` are capped, and the
rest take ``level * weight``, where the level is what remains divided by the weights that
remain. Then every document of a source is taken ``whole`` times, and a seeded order of the
source's documents takes one further repetition each until the target is reached; the
documents at that point (one, or repeated rows of one key) take a fraction of a repetition.

Only DataFrame functions run. Documents are shuffled as sums of at most ``BUCKETS`` seeded
buckets a source (pre-aggregated, so a source with a third of all rows is no hot key); then
only the rows of each source's one boundary bucket are ranked, a ``1 / BUCKETS`` share. The
result row of a document follows from its own columns and one row for its source.

Cases: null text has size 0; the null source is a source; sources of size 0 have target 0;
repeated rows and ids (also null ids) share one place in the order, so reruns agree; an empty
table gives an empty table; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, cut, n_words, quoted, read, shared_table

WEIGHTS = (3, 1, 2)
BUDGET = 1.5
MAX_EPOCHS = 2
SEED = "mix-1"
BUCKETS = 4096


def _place(doc_id: Column, size: Column, seed: str) -> Column:
    """Seeded place (60 bits) of a document within its source; rows of one id and size share it."""
    key = F.concat_ws(":", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("null")), size.cast("string"))
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")


def _bucket(place: Column) -> Column:
    """The leading 12 bits, so buckets keep the order of places."""
    return F.shiftright(place, 48).cast("int")


def source_targets(sources: DataFrame, weights=WEIGHTS, budget: float = BUDGET,
                   max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """``(source, source_size)`` -> the same plus ``target``. One row per source; the order
    over all sources is part of the contract, so its windows run over this small table."""
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    everything = Window.partitionBy(F.lit(1))
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in weights]),
                          ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    s = sources.select("source", "source_size", weight.alias("w"))
    s = s.select("*", (F.col("source_size") * F.lit(float(max_epochs))).alias("cap"),
                 (F.sum("source_size").over(everything) * F.lit(float(budget))).alias("total"))
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), "source")
    from_here = order.rowsBetween(0, Window.unboundedFollowing)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    s = s.select("*", ((F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
                       / F.sum("w").over(from_here)).alias("level"))
    # capping a source raises the level of the rest until none is above its cap, and would
    # lower it after: the water stands at the highest
    target = F.least(F.col("cap"), F.max("level").over(everything) * F.col("w"))
    return s.select("source", "source_size", target.alias("target"))


def _same_source(a: str, b: str) -> Column:
    return F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))


def mixing_plan(sized: DataFrame, weights=WEIGHTS, budget: float = BUDGET,
                max_epochs: float = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """``(doc_id, source, size)`` -> one row per source: size, target, and how far the
    seeded order is taken (``whole`` repetitions of all, then up to ``cut_place``, of whose
    rows ``cut_words`` of ``cut_size`` words are taken)."""
    d = sized.select("source", "size", _place(F.col("doc_id"), F.col("size"), seed).alias("place"))
    d = d.withColumn("bucket", _bucket(F.col("place")))
    buckets = cut(d.groupBy("source", "bucket").agg(F.sum("size").alias("words")))
    t = source_targets(buckets.groupBy("source").agg(F.sum("words").alias("source_size")),
                       weights, budget, max_epochs)
    words = F.round("target").cast("long")
    whole = F.when(F.col("source_size") > 0, F.floor(words / F.col("source_size"))).otherwise(0).cast("long")
    t = cut(t.select("*", whole.alias("whole"), (words - whole * F.col("source_size")).alias("quota")))
    tb = broadcast_if_small(t)
    run = Window.partitionBy("b.source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    edge = (buckets.alias("b").join(tb.alias("t"), _same_source("b", "t"))
            .select("b.source", "bucket", "words", "quota",
                    F.coalesce(F.sum("words").over(run), F.lit(0)).alias("before"))
            .where("before < quota and quota <= before + words")
            .select("source", F.col("bucket").alias("cut_bucket"), (F.col("quota") - F.col("before")).alias("rest")))
    edge = cut(edge)
    places = (d.alias("d").join(broadcast_if_small(edge).alias("e"),
                                _same_source("d", "e") & (F.col("bucket") == F.col("cut_bucket")))
              .groupBy("d.source", "place", "rest").agg(F.sum("size").alias("words")))
    run = Window.partitionBy("source").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    point = (places.select("*", F.coalesce(F.sum("words").over(run), F.lit(0)).alias("before"))
             .where("before < rest and rest <= before + words")
             .select("source", F.col("place").alias("cut_place"), (F.col("rest") - F.col("before")).alias("cut_words"),
                     F.col("words").alias("cut_size")))
    return cut(t.alias("t").join(point.alias("p"), _same_source("t", "p"), "left")
               .select("t.source", "source_size", "target", "whole",
                       "cut_place", "cut_words", "cut_size"))


def with_taken(sized: DataFrame, plan: DataFrame, seed: str = SEED) -> DataFrame:
    """``sized`` plus ``source_size``, ``target``, ``taken`` (words, repeats counted)."""
    place = _place(F.col("doc_id"), F.col("size"), seed)
    more = (F.when(place < F.col("cut_place"), F.col("size"))
            .when(place == F.col("cut_place"), F.expr("size * cut_words div cut_size")).otherwise(0))
    taken = F.col("size") * F.col("whole") + F.coalesce(more, F.lit(0))
    return (sized.alias("d").join(broadcast_if_small(plan).alias("p"), _same_source("d", "p"))
            .select(*[f"d.{c}" for c in sized.columns], "source_size", "target", taken.alias("taken")))


def mix(docs: DataFrame, **params) -> DataFrame:
    """Per document: ``doc_id, source, size, source_size, target, taken``."""
    sized = shared_table(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")), "mix-sizes")
    return with_taken(sized, mixing_plan(sized, **params), params.get("seed", SEED))


def repeat_documents(docs: DataFrame, **params) -> DataFrame:
    """The mix itself: the columns of ``docs`` plus ``copy`` (1, 2, ...) and ``copy_words``,
    one row per repetition. The last copy of a document at the cut holds its first
    ``copy_words`` words (a fraction of a repetition); documents of no words give no row."""
    size = n_words(F.col("text"))
    own = [c for c in docs.columns if c not in ("copy", "copy_words")]
    sized = docs.select("doc_id", "source", size.alias("size"))
    sized = shared_table(sized, "mix-sizes")
    plan = mixing_plan(sized, **params)
    full = docs.select("doc_id", "source", size.alias("size"), F.struct(*map(quoted, own)).alias("row"))
    t = with_taken(full, plan, params.get("seed", SEED)).where("taken > 0")
    t = t.select("*", F.explode(F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("size")).cast("int"))).alias("copy"))
    t = t.withColumn("copy_words", F.least(F.col("size"), F.col("taken") - (F.col("copy") - 1) * F.col("size")))
    word_ends = F.split("row.text", r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    text = F.when(F.col("copy_words") == F.col("size"), F.col("row.text")).otherwise(
        F.array_join(F.slice(word_ends, 1, F.col("copy_words").cast("int")), ""))
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    return t.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in own], "copy", "copy_words")


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents")).select("doc_id", "source", "size", "source_size", "target", "taken")


OP6_SQL = """
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
p AS (SELECT *, ('0x' || substr(md5(concat_ws(':', 'mix-1', coalesce(doc_id::VARCHAR, 'null'), size::VARCHAR)), 1, 15))::BIGINT AS place FROM d),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, ([3.0, 1.0, 2.0])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)]::DOUBLE AS w,
              source_size * 2.0::DOUBLE AS cap, sum(source_size) OVER () * 1.5::DOUBLE AS total FROM s0),
s2 AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
              / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s1),
s3 AS (SELECT *, least(cap, max(level) OVER () * w) AS target FROM s2),
s4 AS (SELECT *, CASE WHEN source_size > 0 THEN round(target)::BIGINT // source_size ELSE 0 END AS whole FROM s3),
s AS (SELECT source, source_size, target, whole, round(target)::BIGINT - whole * source_size AS quota FROM s4),
g AS (SELECT source, place, sum(size) AS words FROM p GROUP BY ALL),
r AS (SELECT *, sum(words) OVER (PARTITION BY source ORDER BY place) - words AS before FROM g)
SELECT p.doc_id, p.source, p.size, s.source_size, s.target,
       (p.size * s.whole + p.size * greatest(0, least(r.words, s.quota - r.before)) // greatest(r.words, 1))::BIGINT AS taken
FROM p JOIN s ON p.source IS NOT DISTINCT FROM s.source
       JOIN r ON p.source IS NOT DISTINCT FROM r.source AND p.place = r.place
"""
