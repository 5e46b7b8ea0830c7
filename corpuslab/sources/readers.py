"""Sources S1-S6: dump XML, article JSON lines, text lines, runs TSV.

All readers are splittable scans. ``ord`` is the input order: file path, start of the
split in the file, and position in the split (Spark packs splits into tasks by size, so
the position alone would follow the packing).
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslab.operators.order import with_global_index
from corpuslab.profiles import corpus_file

log = logging.getLogger(__name__)

# The two spellings of a runs table's columns.
RUNS_NAMES = {"run_id": (), "language": (), "size": (), "seed": (), "tokenizer_type": (),
              "val_bpb": ("val_bpb_final",), "tokens": ("training_tokens",),
              "wallclock_s": ("training_wallclock",), "hparams_json": ("hyperparameters_json",)}
PAGE_OPEN = "<page>"
PAGE_CLOSE = "</page>"
PAGE_SCHEMA = "title string, id string, revision array<struct<text: array<string>>>"

def _input_order():
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
                    F.monotonically_increasing_id().alias("pos"))


RUNS_SCHEMA = T.StructType([
    T.StructField("run_id", T.StringType()), T.StructField("language", T.StringType()),
    T.StructField("size", T.StringType()), T.StructField("seed", T.IntegerType()),
    T.StructField("tokenizer_type", T.StringType()), T.StructField("val_bpb", T.DoubleType()),
    T.StructField("tokens", T.StringType()), T.StructField("wallclock_s", T.StringType()),
    T.StructField("hparams_json", T.StringType()),
])


def read_dump(spark: SparkSession, path: str) -> DataFrame:
    """Pages of (plain or bz2) XML dumps as ``(ord, id, title, text)`` and the folders' columns
    (``lang=..``).

    Files are read as records ending in ``</page>`` (splittable, unlike the XML source), also
    where a page goes on past the end of a split; each piece is cut at ``<page>`` (dropping the
    header and the namespace root) and parsed once. ``title`` is stripped; ``text`` is that of the
    first revision with a ``text`` element, null if there is none or it is empty; ``id`` is null
    when the page has none (see ``with_page_ids``).
    """
    from corpuslab.functions.text import strip

    raw = spark.read.option("lineSep", PAGE_CLOSE).text(path)
    folders = [c for c in raw.columns if c != "value"]
    pieces = raw.select(*folders, _input_order().alias("ord"), "value").where(F.instr("value", PAGE_OPEN) > 0)
    xml = F.concat(F.expr(f"substr(value, instr(value, '{PAGE_OPEN}'))"), F.lit(PAGE_CLOSE))
    page = F.from_xml(xml, PAGE_SCHEMA, {"ignoreSurroundingSpaces": "false", "excludeAttribute": "true"})
    p = pieces.select(*folders, "ord", page.alias("p"))
    texts = F.flatten(F.transform("p.revision", lambda r: F.coalesce(r["text"], F.array().cast("array<string>"))))
    text = F.get(texts, 0)
    return p.select(*folders, "ord", "p.id", strip(F.col("p.title")).alias("title"), F.when(text != "", text).alias("text"))


def with_page_ids(kept: DataFrame, by: list[str] | None = None) -> DataFrame:
    """A page without ``id`` takes the number of articles kept before it (of its ``by`` group)."""
    idx = with_global_index(kept, ["ord"], by, "__kept_before")
    return idx.withColumn("id", F.coalesce(F.col("id"), F.col("__kept_before").cast("string"))) \
        .drop("__kept_before")


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    """S3: article JSON lines ``(ord, id, title, text)``; a missing text reads as '', a
    broken line raises."""
    schema = "id string, title string, text string"
    df = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return df.select(_input_order().alias("ord"), "id", "title",
                     F.coalesce(F.col("text"), F.lit("")).alias("text"))


def _exists(spark: SparkSession, path: str) -> bool:
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hpath)


def read_corpus(spark: SparkSession, data_dir: str, name: str) -> DataFrame:
    """S4 + S3: the articles of a corpus by its name; a name without a file raises before any job."""
    path = f"{data_dir.rstrip('/')}/{corpus_file(name)}"
    if not _exists(spark, path):
        raise FileNotFoundError(f"corpus {name!r}: no file {path}")
    return read_articles(spark, path)


def read_lines(spark: SparkSession, path: str, lang: str | None = None) -> DataFrame:
    """Physical lines (``\\n``, ``\\r\\n`` and ``\\r`` end a line) with ``line_no``; a folder
    written per language (K2) is numbered per language."""
    raw = spark.read.text(path)
    folders = ["lang"] if lang is None and "lang" in raw.columns else []
    df = raw.select(*folders, _input_order().alias("__o"), F.col("value").alias("line"))
    if lang is not None:
        df = df.withColumn("lang", F.lit(lang))
    return with_global_index(df, ["__o"], ["lang"] if lang or folders else None, "line_no").drop("__o")


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """The runs TSV, columns by their name in the header (either spelling); ``seed`` and
    ``val_bpb`` typed (a value that is no number raises), the rest strings; an absent column
    is null, further ones are kept. A missing file gives an empty table and a warning."""
    if not _exists(spark, path):
        log.warning("Results file not found: %s", path)
        return spark.createDataFrame([], RUNS_SCHEMA).withColumn("run_ord", F.lit(0).cast("bigint"))
    df = (spark.read.option("sep", "\t").option("header", True).option("quote", '"')
          .option("escape", '"').option("mode", "FAILFAST").csv(path))
    names = {new: next((x for x in (new, *old) if x in df.columns), None) for new, old in RUNS_NAMES.items()}
    return df.select(
        *[(F.col(names[f.name]) if names[f.name] else F.lit(None)).cast(f.dataType).alias(f.name)
          for f in RUNS_SCHEMA],
        *[c for c in df.columns if c not in names.values()], _input_order().alias("run_ord"))


def read_vocab(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """K6 read back: the vocabulary and the merges of ``write_vocab``."""
    schema = "token_id int, token binary, is_special boolean, n_bytes int, n_bytes_decoded int, lang string"
    return (spark.read.schema(schema).parquet(f"{path}/vocab"),
            spark.read.schema("rank int, left_id int, right_id int, new_id int, freq bigint, lang string").parquet(f"{path}/merges"))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """K8 read back: ``(lang, variant, split, doc_id, ids)`` of ``write_tokens``."""
    return spark.read.schema("doc_id bigint, ids array<int>, lang string, variant string, split string").parquet(path)
