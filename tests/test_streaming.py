"""The stateless cleaning job gives the same paragraphs on a stream as in batch."""

import tempfile

from corpuslab.plans.dump_job import article_paragraphs, articles
from corpuslab.plans.views import wikified_documents
from corpuslab.streaming.clean_stream import start_paragraph_stream


def test_stream_equals_batch(spark, sf001):
    src = tempfile.mkdtemp(prefix="corpuslab-stream-src-")
    ck = tempfile.mkdtemp(prefix="corpuslab-stream-ck-")
    pages = wikified_documents(spark, sf001)
    pages.write.mode("overwrite").parquet(src)
    q = start_paragraph_stream(spark, src, "doc_id long, lang string, title string, text string",
                               "stream_pars", ck, fmt="memory")
    q.awaitTermination(300)
    got = {(r.doc_id, r.para_pos, r.paragraph) for r in spark.table("stream_pars").collect()}
    want = {(r.doc_id, r.para_pos, r.paragraph)
            for r in article_paragraphs(articles(pages)).collect()}
    assert got == want and len(got) > 0
