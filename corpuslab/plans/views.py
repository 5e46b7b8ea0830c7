"""Derived inputs built by Spark from the driver tables.

The driver tables carry no wiki markup and no run table, so the jobs read views
derived from them. Each view has a Spark definition here and an equivalent
DuckDB text in ``corpuslab.plans.oracle`` so results can be compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.session import table

NL = "\n"

# Markup appended to every original line; every cleaning step has work to do.
LINE_MARKUP = ("[[x|y]] [https://e.org z] <b>q</b> [[File:f.jpg|thumb|cap]] "
               '<span style="color:red">s</span> [[Dosiero:d.png]] width=5 #a1b2c3 ')
HEAD_MARKUP = "__TOC__ '''Bold''' text ''it'' &amp; more&nbsp;here &lt;b&gt;x&lt;/b&gt; &quot;q&quot;"
TABLE_MARKUP = ('{| class="wikitable" style="width:50%"' + NL + "|-" + NL + "! head !! more" + NL
                + "| a || b" + NL + "|}" + NL)
# For the steps that tidy pages never need: nesting beyond the unrolled passes (T1, T4),
# unclosed and broken templates (T2, T3), a broken table (T5), a stray table row (T6), a bare
# link (T10), a quoted attribute in prose (T13), a short colour (T16), a blank line inside a
# paragraph (F8).
ODD_MARKUP = ("{{1{{2{{3{{4{{5}}}}}}}}}} {{open {brace}} {{a } b}} [https://e.org] #abc style=\"a b\" end" + NL
              + "{|a{|b{|c{|d|}|}|}|} {| broken { table |} end" + NL + "| stray row" + NL + NL
              + "first half of a paragraph" + NL + " \t " + NL + "second half of a paragraph" + NL + NL)


def _s(c: Column) -> Column:
    return c.cast("string")


def wikify(doc_id: Column, text: Column) -> Column:
    """Wrap plain text in wiki markup: nested templates, tables, links, tags, entities; null
    for every 23rd page (F1)."""
    return F.when(doc_id % 23 != 5, F.concat(
        F.when(doc_id % 26 == 0, F.concat(F.lit("#ALIDIREKTU [[Target "), _s(doc_id), F.lit("]]" + NL)))
        .when(doc_id % 13 == 0, F.concat(F.lit("#REDIRECT [[Target "), _s(doc_id), F.lit("]]" + NL)))
        .otherwise(F.lit("")),
        F.lit("{{Infobox|a={{b"), _s(doc_id % 7), F.lit("}}|c={{d|{{e}}}}}}" + NL),
        F.lit("== H ==" + NL),
        F.when(doc_id % 5 == 0, F.lit(TABLE_MARKUP)).otherwise(F.lit("")),
        F.when(doc_id % 3 == 1, F.lit(ODD_MARKUP)).otherwise(F.lit("")),
        F.lit(HEAD_MARKUP + NL),
        F.replace(text, F.lit(NL), F.lit(NL + NL + LINE_MARKUP)),
        F.lit(NL + NL + NL + NL + ":" + NL + "[[Category:K]]"),
    ))


def wiki_title(doc_id: Column) -> Column:
    """Titles with namespace prefixes on some rows, for the title filter; some null (F1)."""
    pre = (F.when(doc_id % 17 == 0, F.lit("Talk:"))
           .when(doc_id % 17 == 1, F.lit("User talk:"))
           .when(doc_id % 17 == 2, F.lit("Kategorio:"))
           .otherwise(F.lit("")))
    return F.when(doc_id % 19 != 3, F.concat(pre, F.lit("Doc "), _s(doc_id)))


def wikified_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, lang, title, text)``; ``doc_id`` is the dump order."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        "doc_id", "lang",
        wiki_title(F.col("doc_id")).alias("title"),
        wikify(F.col("doc_id"), F.col("text")).alias("text"),
    )


def _escaped(c: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(char), F.lit(entity))
    return c


#: Pages of all languages between the first and the last of a dump file, if they have more than ``files`` times so many.
FILE_PAGES = 8_192


def write_dump(spark: SparkSession, sf_dir: str, path: str, files: int = 3, compression: str = "bzip2") -> None:
    """The wikified documents as XML dumps, a folder of several files per language in dump order: ``files``,
    or more where there are many pages, as a file is written by one task.
    Absent titles and texts have no element; every 50th page has an empty text, every 50th no id,
    every 50th a second revision; titles have white space around them."""
    w, k = wikified_documents(spark, sf_dir), F.col("doc_id") % 50
    text = F.concat(F.lit('<text bytes="1" xml:space="preserve">'), _escaped(F.col("text")), F.lit("</text>"))
    text = F.when(k == 3, F.lit("<text/>")).otherwise(F.coalesce(text, F.lit("")))
    title = F.concat(F.lit("    <title> "), _escaped(F.col("title")), F.lit(" " + NL + "</title>" + NL))
    page = F.concat(
        F.lit("  <page>" + NL), F.coalesce(title, F.lit("")), F.lit("    <ns>0</ns>" + NL),
        F.when(k == 4, "").otherwise(F.concat(F.lit("    <id>"), _s(F.col("doc_id")), F.lit("</id>" + NL))),
        F.lit("    <revision><id>7</id><contributor><id>9</id></contributor>"), text, F.lit("</revision>" + NL),
        F.when(k == 6, "    <revision><id>8</id><text>later</text></revision>" + NL).otherwise(""), F.lit("  </page>"))
    last, n = w.agg(F.max("doc_id") + 1, F.count(F.lit(1))).first()  # two numbers
    last, files = last or 1, max(files, n // FILE_PAGES)
    file = F.lpad(F.floor(F.col("doc_id") * files / last).cast("string"), 8, "0")  # paths in dump order
    tasks = max(files, int(spark.conf.get("spark.sql.shuffle.partitions")))
    pages = w.select("lang", file.alias("file"), F.col("doc_id").alias("place"), page.alias("value"))
    each = pages.select("lang", "file").distinct()
    head = each.select("lang", "file", F.lit(-1).cast("bigint").alias("place"), F.lit(
        '<mediawiki xmlns="http://www.mediawiki.org/xml/export-0.11/">' + NL + "  <siteinfo><sitename>x</sitename></siteinfo>").alias("value"))
    tail = each.select("lang", "file", F.lit(last).cast("bigint").alias("place"), F.lit("</mediawiki>").alias("value"))
    (pages.unionByName(head).unionByName(tail).repartition(tasks, "lang", "file").sortWithinPartitions("lang", "file", "place")
     .select("lang", "file", "value").write.partitionBy("lang", "file").option("compression", compression).text(path))


def _run_columns(k: Column) -> list[Column]:
    return [
        _s(k).alias("run_id"),
        F.when(k % 2 == 0, "english").otherwise("esperanto").alias("language"),
        F.when(F.floor(k / 2) % 2 == 0, "10M").otherwise("30M").alias("size"),
        F.floor(k / 8).cast("int").alias("seed"),
        F.when(F.floor(k / 4) % 2 == 0, "bpe").otherwise("byte").alias("tokenizer_type"),
    ]


def runs_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A runs table with one run per event: 2 languages x 2 sizes x 2 tokenizers x seeds.

    ``language`` uses the reference's two names so the default comparison applies.
    ``val_bpb_curve`` is a JSON array derived from the row (for learning curves).
    """
    eid = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        *_run_columns(eid),
        F.col("value").alias("val_bpb"),
        (F.col("user_id") * 1000).cast("bigint").alias("tokens"),
        F.col("value").alias("wallclock_s"),
        F.col("props").alias("hparams_json"),
        eid.alias("run_ord"),
        F.concat(F.lit("["), _s(F.col("value") + 3.0), F.lit(","), _s(F.col("value") + 1.0),
                 F.lit(","), _s(F.col("value")), F.lit("]")).alias("val_bpb_curve"),
    )


def logged_runs(spark: SparkSession, sf_dir: str, n_runs: int = 24) -> DataFrame:
    """All events as the log of ``n_runs`` runs: an event belongs to run ``event_id mod
    n_runs``, whose ``val_bpb`` is the mean of its events (the tests of significance compare
    a planned number of runs, however long their logs are)."""
    k = F.pmod(F.col("event_id"), F.lit(n_runs))
    runs = table(spark, sf_dir, "events").groupBy(k.alias("run_ord")).agg(F.round(F.avg("value"), 6).alias("val_bpb"))
    return runs.select(*_run_columns(F.col("run_ord")), "val_bpb", "run_ord")


#: Treatment languages of ``scenario_runs`` and what their scores are multiplied by, for bpe and for
#: byte tokens: each gives another outcome. ``sparse`` has one run a cell.
SCENARIOS = {"both_better": (0.5, 0.5), "bpe_better": (0.5, 1.0), "same": (1.0, 1.0), "worse": (2.0, 1.0), "sparse": (1.0, 1.0)}


def scenario_runs(spark: SparkSession, sf_dir: str, n_runs: int = 240) -> DataFrame:
    """All events as the log of ``n_runs`` runs of a baseline and of languages that do better or worse."""
    k = F.pmod(F.col("event_id"), F.lit(n_runs))
    runs = table(spark, sf_dir, "events").groupBy(k.cast("int").alias("run_ord")).agg(F.avg("value").alias("v"))
    names = ["english", *SCENARIOS]
    k = F.col("run_ord")
    language = F.get(F.array(*map(F.lit, names)), k % len(names))
    cell = F.floor(k / len(names)).cast("int")
    factor = F.get(F.array(*[F.array(F.lit(a), F.lit(b)) for a, b in [(1.0, 1.0), *SCENARIOS.values()]]), k % len(names))
    d = runs.select("run_ord", language.alias("language"), F.when(cell % 2 == 0, "10M").otherwise("30M").alias("size"),
                    F.floor(cell / 4).cast("int").alias("seed"), F.when(F.floor(cell / 2) % 2 == 0, "bpe").otherwise("byte").alias("tokenizer_type"),
                    F.round(F.col("v") * F.get(factor, F.floor(cell / 2).cast("int") % 2), 6).alias("val_bpb"))
    return d.where((F.col("language") != "sparse") | (F.col("seed") == 0))
