"""Operator 13, source divergence audit.

Method: three-dimensional cube partitioning. The smoothed term shares of the (lang, source)
groups form a matrix; a task owns one cell (group block, group block, term block) of the cube of
all comparisons, gets the two slices it needs (every slice is sent to the cells of its row and
column), computes the divergence of each pair of groups over its terms, and the partial sums
are added up along the term axis.

``share``: p = 1 + floor(SCALE * (count + 2) / (N + 2 V)), ``divergence`` of two shares:
floor((p - q)^2 / (p + q)), both in whole numbers, so sums don't depend on their order.

Scale: tasks count terms per group before the shuffle, so a group or a word holding a third of
all rows is a few rows a task. Cells hold at most ``2 * group_block`` groups by about
``term_block`` terms (dealt by hash); a term that neither slice of a cell holds is not sent but
added at the end, as all of those have the same divergence. Pairs are as many as the result has.

Cases: null text, lang or source read as ''; texts without terms make a group with counts of 0;
a lang without kept terms has pairs of divergence 0 and no term rows; repeated rows and rows
sharing a doc_id count as documents of their own; very long texts are counted like others (one
row's words are held at a time); ties rank by item in UTF-8 order; an empty table gives an empty
table; extra columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, read, shared_table

#: Fixed values of the audit: scale of a share, and what is added to a count.
SCALE, SMOOTH = 1_000_000_000, 2
#: Entries of the counts that a task holds before it passes them on.
HELD_TERMS = 400_000
#: Upper case to lower case; what is no ASCII letter separates terms, other characters stay.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
GROUP = ["lang", "source"]


def term_counts(docs: DataFrame) -> DataFrame:
    """``(lang, source, term, n, docs)``: occurrences and documents of a term in a group; every
    group also has a row with a null term."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[tuple, tuple[Counter, Counter]] = {}
        held = 0

        def flush() -> pd.DataFrame:
            rows = [(lang, source, term.decode("utf-8", "surrogatepass"), k, docs[term])
                    for (lang, source), (n, docs) in found.items() for term, k in n.items()]
            rows += [(lang, source, None, 0, 0) for lang, source in found]
            found.clear()
            return pd.DataFrame(rows, columns=["lang", "source", "term", "n", "docs"])

        for batch in batches:
            for lang, source, text in zip(batch["lang"], batch["source"], batch["text"], strict=True):
                terms = text.encode("utf-8", "surrogatepass").translate(TABLE).split()
                n, in_docs = found.setdefault((lang, source), (Counter(), Counter()))
                held -= len(n)
                n.update(terms)
                in_docs.update(set(terms))
                held += len(n)
                if held > HELD_TERMS:
                    yield flush()
                    held = 0
        if found:
            yield flush()

    blank = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")]
    rows = docs.select(*blank).mapInPandas(run, "lang string, source string, term string, n bigint, docs bigint")
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, total: Column, terms: Column) -> Column:
    """The share of a term with ``n`` occurrences among ``total`` of ``terms`` kept terms."""
    up = F.lit(SCALE).cast("decimal(10,0)") * (n + SMOOTH).cast("decimal(19,0)")
    down = (total + SMOOTH * terms).cast("decimal(20,0)")
    return F.when(terms > 0, 1 + F.call_function("div", up, down)).otherwise(F.lit(1)).cast("long")


def divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q).cast("long")


def shares(docs: DataFrame, min_docs: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Materialised tables: kept terms of groups ``(lang, source, term, p, q)`` with the group's
    and the lang's share, groups ``(lang, source, p0)`` with the share of a term that the group
    lacks, and langs ``(lang, terms, groups)``."""
    counts = shared_table(term_counts(docs), "divergence-counts")
    of_lang = counts.where("term is not null").groupBy("lang", "term").agg(
        F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs)
    kept = shared_table(counts.where("n > 0").select(*GROUP, "term", "n")
                        .join(of_lang.select("lang", "term", "lang_n"), ["lang", "term"]), "divergence-kept")
    totals = kept.groupBy(*GROUP).agg(F.sum("n").alias("total"))
    names = counts.where("term is null").select(*GROUP)
    terms = kept.select("lang", "term", "lang_n").distinct().groupBy("lang").agg(
        F.count(F.lit(1)).alias("terms"), F.sum("lang_n").alias("lang_total"))
    langs = shared_table(names.groupBy("lang").agg(F.count(F.lit(1)).alias("groups")).join(terms, "lang", "left")
                         .na.fill(0, ["terms", "lang_total"]), "divergence-langs")
    groups = shared_table(names.join(totals, GROUP, "left").na.fill(0, ["total"])
                          .join(broadcast_if_small(langs), "lang")
                          .withColumn("p0", share(F.lit(0), F.col("total"), F.col("terms"))), "divergence-groups")
    kept = kept.join(broadcast_if_small(groups.drop("groups")), GROUP).select(
        *GROUP, "term", "p0", share(F.col("n"), F.col("total"), F.col("terms")).alias("p"),
        share(F.col("lang_n"), F.col("lang_total"), F.col("terms")).alias("q"))
    return shared_table(kept, "divergence-shares"), groups.select(*GROUP, "p0"), langs.drop("lang_total")


def cell_divergences(cell: pd.DataFrame) -> pd.DataFrame:
    """Partial divergences of the pairs of groups of a cell: ``value`` over its ``seen`` terms,
    and ``rest``, that of a term which neither has. A group has a row with a null term."""
    names = cell[cell["term"].isna()].sort_values("source")
    place = {s: i for i, s in enumerate(names["source"])}
    entries = cell[cell["term"].notna()]
    at, terms = pd.factorize(entries["term"])
    p0 = names["p0"].to_numpy(np.int64)
    p = np.repeat(p0[:, None], len(terms), axis=1)
    p[entries["source"].map(place).to_numpy(np.int64), at] = entries["p"].to_numpy(np.int64)
    block, source = names["block"].to_numpy(), names["source"].tolist()
    diagonal = cell["row"].iloc[0] == cell["col"].iloc[0]
    lang, seen, out = cell["lang"].iloc[0], len(terms), []
    for i in range(len(names)):
        others = np.arange(i + 1, len(names))
        others = others if diagonal else others[block[others] != block[i]]
        value = ((p[others] - p[i]) ** 2 // (p[others] + p[i])).sum(axis=1)
        rest = (p0[others] - p0[i]) ** 2 // (p0[others] + p0[i])
        out += [(lang, source[i], source[j], v, seen, r)
                for j, v, r in zip(others.tolist(), value.tolist(), rest.tolist(), strict=True)]
    return pd.DataFrame(out, columns=["lang", "a", "b", "value", "seen", "rest"])


def pair_divergences(kept: DataFrame, groups: DataFrame, langs: DataFrame, group_block: int, term_block: int) -> DataFrame:
    """``(lang, a, b, value)``: the divergence of every two groups of a lang, a < b."""
    sizes = langs.select("lang", "terms", F.ceil(F.col("groups") / group_block).cast("int").alias("sides"),
                         F.greatest(F.ceil(F.col("terms") / term_block), F.lit(1)).cast("int").alias("depth"))
    sizes = broadcast_if_small(sizes)
    block = F.pmod(F.xxhash64("source"), F.col("sides")).cast("int").alias("block")
    slices = kept.join(sizes, "lang").select(*GROUP, "term", "p", "p0", "sides", block,
                                             F.pmod(F.xxhash64("term"), F.col("depth")).cast("int").alias("layer"))
    marks = groups.join(sizes, "lang").select(*GROUP, F.lit(None).cast("string").alias("term"), F.col("p0").alias("p"),
                                              "p0", "sides", block, F.explode(F.sequence(F.lit(0), F.col("depth") - 1)).alias("layer"))
    cells = (slices.unionByName(marks).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("sides") - 1)))
             .select(*GROUP, "term", "p", "p0", "block", "layer", F.least("block", "other").alias("row"),
                     F.greatest("block", "other").alias("col")))
    partial = cells.groupBy("lang", "row", "col", "layer").applyInPandas(
        cell_divergences, "lang string, a string, b string, value bigint, seen bigint, rest bigint")
    total = partial.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"),
                                                  F.max("rest").alias("rest"))
    return total.join(broadcast_if_small(langs.select("lang", "terms")), "lang").select(
        "lang", "a", "b", (F.col("value") + (F.col("terms") - F.col("seen")) * F.col("rest")).alias("value"))


def divergence_audit(docs: DataFrame, min_docs: int = 10, top: int = 10, group_block: int = 32,
                     term_block: int = 2048) -> DataFrame:
    """``(lang, source, part, item, value, rank)`` of the groups (lang, source) of ``docs``. Part
    `pair`: the divergence from each other source of the lang. Part `term`: the ``top`` terms
    that a group uses more than its lang does. Terms in fewer than ``min_docs`` documents of a
    lang are left out."""
    kept, groups, langs = shares(docs, min_docs)
    pairs = shared_table(pair_divergences(kept, groups, langs, group_block, term_block), "divergence-pairs")
    order = Window.partitionBy(*GROUP).orderBy(F.col("value").desc(), "item")
    both = (pairs.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value")
            .unionByName(pairs.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "value")))
    both = both.withColumn("rank", F.row_number().over(order))
    terms = (kept.where("p > q").select(*GROUP, F.col("term").alias("item"), divergence(F.col("p"), F.col("q")).alias("value"))
             .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top))
    return both.withColumn("part", F.lit("pair")).unionByName(terms.withColumn("part", F.lit("term"))) \
        .select(*GROUP, "part", "item", "value", "rank")


def op13_source_divergence(spark, sf_dir: str) -> DataFrame:
    """The audit of all documents."""
    return divergence_audit(read(spark, sf_dir, "documents"))


OP13_SQL = r"""
with d as (select row_number() over () as id, coalesce(lang, '') as lang, coalesce(source, '') as source,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text
           from documents),
w as (select id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
kept as (select lang, term from w group by lang, term having count(distinct id) >= 10),
n as (select lang, source, term, count(*) as n from w join kept using (lang, term) group by all),
g as (select distinct lang, source from d),
v as (select g.lang, count(distinct k.term) as v from g left join kept k on g.lang = k.lang group by g.lang),
total as (select g.lang, g.source, coalesce(sum(n.n), 0) as total from g left join n using (lang, source) group by g.lang, g.source),
p as (select t.lang, t.source, k.term, coalesce(n.n, 0) as n,
             1 + (1000000000::hugeint * (coalesce(n.n, 0) + 2)) // (t.total + 2 * v.v) as p
      from total t join v using (lang) join kept k using (lang) left join n using (lang, source, term)),
q as (select lang, term, 1 + (1000000000::hugeint * (s + 2)) // (t + 2 * v) as q
      from (select lang, term, sum(n) as s from n group by lang, term)
      join (select lang, sum(n) as t from n group by lang) using (lang) join v using (lang)),
pairs as (select a.lang, a.source, b.source as item, cast(coalesce(x.value, 0) as bigint) as value
          from g a join g b on a.lang = b.lang and a.source <> b.source
          left join (select x.lang, x.source, y.source as item, sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)) as value
                     from p x join p y on x.lang = y.lang and x.term = y.term and x.source <> y.source group by all) x
          on x.lang = a.lang and x.source = a.source and x.item = b.source),
terms as (select lang, source, term as item, cast(((p - q) * (p - q)) // (p + q) as bigint) as value
          from p join q using (lang, term) where n > 0 and p > q)
select lang, source, 'pair' as part, item, value,
       cast(row_number() over (partition by lang, source order by value desc, item) as integer) as rank from pairs
union all
select * from (select lang, source, 'term' as part, item, value,
       cast(row_number() over (partition by lang, source order by value desc, item) as integer) as rank from terms)
where rank <= 10
"""
