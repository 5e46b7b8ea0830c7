"""The cleaning job on a stream: F1/F4 -> T1-T23 -> F2/F3 -> paragraphs, per micro-batch.

Every step is stateless, so the batch operators run unchanged on ``readStream``;
no watermark or state store is involved. The sink commits through the query's
checkpoint location (give a shared folder on a cluster).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from corpuslab.operators.explode import paragraphs
from corpuslab.plans.dump_job import articles
from corpuslab.profiles import ENGLISH, Profile


def stream_articles(pages: DataFrame, prof: Profile = ENGLISH, lang_col: str | None = "lang",
                    profiles: dict[str, Profile] | None = None) -> DataFrame:
    """Valid cleaned articles from a streaming (or batch) page frame."""
    return articles(pages, prof, lang_col, profiles)


def stream_paragraphs(pages: DataFrame, **kw) -> DataFrame:
    return paragraphs(stream_articles(pages, **kw), "text")


def start_paragraph_stream(spark: SparkSession, source_dir: str, schema: str, sink: str,
                           checkpoint: str, fmt: str = "parquet", **kw) -> StreamingQuery:
    """Read new page files from ``source_dir`` and append kept paragraphs to ``sink``."""
    pages = spark.readStream.schema(schema).parquet(source_dir)
    out = stream_paragraphs(pages, **kw)
    writer = out.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
    if fmt == "memory":
        return writer.format("memory").queryName(sink).trigger(availableNow=True).start()
    return writer.format(fmt).option("path", sink).trigger(availableNow=True).start()
