"""Registered queries (Spark) and their DuckDB oracle SQL.

Every query reads the driver tables (or views Spark derives from them) in full.
Names and column aliases match between the two sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.operators.clean import clean_text
from corpuslab.operators.explode import paragraphs
from corpuslab.plans import dump_job
from corpuslab.plans import oracle as o
from corpuslab.plans.views import wikified_documents, write_dump
from corpuslab.profiles import CORPUS_FILES, ENGLISH, ESPERANTO
from corpuslab.session import cut_lineage, scratch_path, table, written_table
from corpuslab.sources import readers, writers

PROFILES = o.QUERY_PROFILES

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


# ---------------------------------------------------------------------------
# Cleaning and article filters
# ---------------------------------------------------------------------------

def _valid_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dump_job.articles(wikified_documents(spark, sf_dir), ENGLISH, "lang", PROFILES)


def _articles_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned articles written once to the checkpoint folder (the job's article
    output); order-dependent steps read it several times without re-cleaning."""
    return cut_lineage(_valid_articles(spark, sf_dir))


def _title_sql(prof) -> str:
    return " OR ".join(f"starts_with(title, {o.q(p)})" for p in prof.title_prefixes)


def _redirect_sql(prof, x: str) -> str:
    s = o.strip_sql(x)
    return " OR ".join(f"lower(substr({s}, 1, {len(m)})) = {o.q(m)}" for m in prof.redirect_markers)


_CLEANED_CTE = (
    "WITH " + o.WIKIFIED_CTE + ", "
    "kept AS (SELECT * FROM wiki WHERE title IS NOT NULL AND text IS NOT NULL AND NOT "
    f"(CASE WHEN lang = 'de' THEN ({_title_sql(ESPERANTO)}) ELSE ({_title_sql(ENGLISH)}) END)), "
    "cleaned AS (SELECT doc_id, lang, title, " + o.clean_sql("text", "lang", PROFILES)
    + " AS text FROM kept), "
    "valid AS (SELECT * FROM cleaned WHERE NOT "
    f"(CASE WHEN lang = 'de' THEN ({_redirect_sql(ESPERANTO, 'text')}) "
    f"ELSE ({_redirect_sql(ENGLISH, 'text')}) END) "
    f"AND length({o.strip_sql('text')}) >= 100) "
)


@register("clean_wikified", "WITH " + o.WIKIFIED_CTE + " SELECT doc_id, lang, "
          + o.clean_sql("text", "lang", PROFILES) + " AS text FROM wiki")
def clean_wikified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T1-T23 on every wikified document (no filters)."""
    w = wikified_documents(spark, sf_dir).select("doc_id", "lang", "text")
    return clean_text(w, "text", lang_col="lang", profiles=PROFILES)


@register("valid_articles", _CLEANED_CTE + "SELECT doc_id, lang, title, text FROM valid")
def valid_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1-F5 around the cleaning chain."""
    return _valid_articles(spark, sf_dir).select("doc_id", "lang", "title", "text")


@register("corpus_slice", _CLEANED_CTE + """,
pars AS (SELECT lang, doc_id, """ + o.strip_sql("p") + """ AS p
         FROM (SELECT lang, doc_id, unnest(string_split(text, chr(10) || chr(10))) AS p FROM valid)),
per_doc AS (SELECT v.lang, v.doc_id, count(p.p) AS n_par, coalesce(sum(length(p.p)), 0) AS n_chars,
                   coalesce(sum(strlen(p.p)), 0) AS n_bytes
            FROM valid v LEFT JOIN (SELECT * FROM pars WHERE length(p) > 20) p
              ON v.lang = p.lang AND v.doc_id = p.doc_id GROUP BY v.lang, v.doc_id)
SELECT lang, CAST(count(*) AS BIGINT) AS articles, CAST(sum(n_par) AS BIGINT) AS paragraphs,
       CAST(sum(n_chars) AS BIGINT) AS chars, CAST(sum(n_bytes) AS BIGINT) AS bytes
FROM per_doc GROUP BY lang""")
def corpus_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: per language, articles kept and their paragraph counts, chars, bytes."""
    return dump_job.corpus_slice(_valid_articles(spark, sf_dir))


@register("corpus_stats", _CLEANED_CTE + """,
pars AS (SELECT lang, doc_id, """ + o.strip_sql("p") + """ AS p
         FROM (SELECT lang, doc_id, unnest(string_split(text, chr(10) || chr(10))) AS p FROM valid)),
fb AS (SELECT lang, sum(strlen(p) + 1) AS file_bytes FROM pars WHERE length(p) > 20 GROUP BY lang),
n AS (SELECT lang, count(*) AS articles FROM valid GROUP BY lang)
SELECT n.lang, CAST(n.articles AS BIGINT) AS articles,
       round(coalesce(fb.file_bytes, 0) / 1048576.0, 1) AS paragraph_mb
FROM n LEFT JOIN fb ON n.lang = fb.lang""")
def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1: articles and paragraph-file MB per language."""
    return dump_job.corpus_stats(_valid_articles(spark, sf_dir))


@register("paragraphs", _CLEANED_CTE + """,
pars AS (SELECT lang, doc_id, CAST(generate_subscripts(arr, 1) - 1 AS INTEGER) AS para_pos,
                unnest(arr) AS p
         FROM (SELECT lang, doc_id, string_split(text, chr(10) || chr(10)) AS arr FROM valid))
SELECT lang, doc_id, para_pos, """ + o.strip_sql("p") + """ AS paragraph FROM pars
WHERE length(""" + o.strip_sql("p") + """) > 20""")
def paragraphs_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P1 + F6: kept paragraphs with their position in the article."""
    arts = _valid_articles(spark, sf_dir).select("lang", "doc_id", "text")
    return paragraphs(arts, "text")


@register("clean_pages", "SELECT page_id, " + o.clean_sql("html") + " AS text FROM pages")
def clean_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chain on real HTML pages: tags, entities, attributes, colours."""
    p = table(spark, sf_dir, "pages").select("page_id", F.col("html").alias("text"))
    return clean_text(p, "text")


# ---------------------------------------------------------------------------
# Documents, split, shards, index, heads
# ---------------------------------------------------------------------------

from corpuslab.functions import tokens as tk  # noqa: E402
from corpuslab.operators import metrics as mt  # noqa: E402
from corpuslab.operators import order as od  # noqa: E402
from corpuslab.operators.explode import article_line_array, line_sample  # noqa: E402
from corpuslab.plans import prepare_job as pj  # noqa: E402


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pj.load_docs(table(spark, sf_dir, "documents"))


_DOCS_CTE = ("WITH docs AS (SELECT lang, doc_id, coalesce(text, '') AS text FROM documents "
             f"WHERE length({o.strip_sql(chr(99) + 'oalesce(text, ' + chr(39) * 2 + ')')}) > 50), ")
_SPLIT_CTE = _DOCS_CTE + """
keyed AS (SELECT *, md5('42:' || CAST(doc_id AS VARCHAR)) AS k, count(*) OVER (PARTITION BY lang) AS n
          FROM docs),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY k, doc_id) AS rn,
                  CASE WHEN n > 0 THEN greatest(1, floor(n * CAST(0.05 AS DOUBLE))) ELSE 0 END AS nval
           FROM keyed),
split AS (SELECT lang, doc_id, text, CASE WHEN rn <= nval THEN 'val' ELSE 'train' END AS split
          FROM ranked) """


@register("docs_loaded", _DOCS_CTE[:-2] + " SELECT lang, doc_id, text FROM docs")
def docs_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3 + F7: documents kept for training (stripped length > 50)."""
    return _docs(spark, sf_dir)


@register("split_assignment", _SPLIT_CTE + "SELECT lang, doc_id, split FROM split")
def split_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact-size seeded validation split per language."""
    return pj.split_docs(_docs(spark, sf_dir)).select("lang", "doc_id", "split")


@register("split_counts", _SPLIT_CTE + """
SELECT lang, CAST(count(*) AS BIGINT) AS loaded,
       CAST(sum(CASE WHEN split = 'train' THEN 1 ELSE 0 END) AS BIGINT) AS train,
       CAST(sum(CASE WHEN split = 'val' THEN 1 ELSE 0 END) AS BIGINT) AS val,
       round(sum(CASE WHEN split = 'val' THEN 1 ELSE 0 END) * 100.0 / count(*), 2) AS val_pct
FROM split GROUP BY lang""")
def split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2: needs the ids of the loaded documents only, so their texts are read once."""
    return pj.split_counts(pj.split_docs(written_table(_docs(spark, sf_dir).select("lang", "doc_id"), "ids")))


@register("byte_totals", _SPLIT_CTE + """
SELECT lang, split, CAST(sum(strlen(text)) AS BIGINT) AS bytes, CAST(count(*) AS BIGINT) AS docs
FROM split GROUP BY ROLLUP (lang, split)""")
def byte_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3: UTF-8 bytes per language and split with rollup totals."""
    return pj.byte_totals(pj.split_docs(_docs(spark, sf_dir)))


@register("global_index", """
SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS idx
FROM documents""")
def global_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1: dense 0-based index per language in document order."""
    d = table(spark, sf_dir, "documents").select("lang", "doc_id")
    return od.with_global_index(d, ["doc_id"], ["lang"], "idx")


@register("global_index_payload", """
SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS idx, md5(text) AS text_md5
FROM documents""")
def global_index_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1 with the texts carried through the index."""
    d = table(spark, sf_dir, "documents").select("lang", "doc_id", "text")
    return od.with_global_index(d, ["doc_id"], ["lang"], "idx").select(
        "lang", "doc_id", "idx", F.md5("text").alias("text_md5"))


def _shards_sql(per: int, start: int) -> str:
    return _SPLIT_CTE + f""",
idx AS (SELECT lang, doc_id, split,
               row_number() OVER (PARTITION BY lang, split ORDER BY doc_id) - 1 AS idx FROM split),
sh AS (SELECT *, {start} + idx // {per} AS s FROM idx)
SELECT lang, doc_id, split, idx,
       CAST(CASE WHEN split = 'val' THEN 6542 ELSE s + CASE WHEN s >= 6542 THEN 1 ELSE 0 END END
            AS INTEGER) AS shard
FROM sh"""


@register("shards", _shards_sql(50_000, 0))
def shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1 + G2 with the reference constants (50,000 docs per shard, reserved 6542)."""
    return pj.assign_shards(_split_table(spark, sf_dir)).select(
        "lang", "doc_id", "split", "idx", "shard")


@register("shards_50_from_6535", _shards_sql(50, 6535))
def shards_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G2 with 50 docs per shard starting at 6535, so numbering crosses the reserved 6542."""
    return pj.assign_shards(_split_table(spark, sf_dir), 50, 6535).select(
        "lang", "doc_id", "split", "idx", "shard")


@register("head_articles_100", _CLEANED_CTE + """
SELECT doc_id, lang, title FROM
  (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rn FROM valid)
WHERE rn <= 100""")
def head_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L1: the first 100 kept articles per language in dump order."""
    arts = _articles_table(spark, sf_dir).select("doc_id", "lang", "title")
    return od.head(arts, 100, ["doc_id"], ["lang"])


_LINES_CTE = _CLEANED_CTE + """,
pars AS (SELECT lang, doc_id, CAST(generate_subscripts(arr, 1) AS INTEGER) AS para_pos,
                unnest(arr) AS p
         FROM (SELECT lang, doc_id, string_split(text, chr(10) || chr(10)) AS arr FROM valid)),
spars AS (SELECT lang, doc_id, para_pos, """ + o.strip_sql("p") + """ AS p FROM pars),
kept2 AS (SELECT * FROM spars WHERE length(p) > 20),
lns AS (SELECT lang, doc_id, para_pos, CAST(generate_subscripts(la, 1) AS INTEGER) AS line_pos,
               unnest(la) AS line
        FROM (SELECT *, regexp_split_to_array(p, '\\r\\n|\\r|\\n') AS la FROM kept2)),
numbered AS (SELECT lang, doc_id, line,
                    row_number() OVER (PARTITION BY lang ORDER BY doc_id, para_pos, line_pos) - 1
                      AS line_no FROM lns)
"""


def _line_sample_sql(n: int) -> str:
    return _LINES_CTE + f"SELECT lang, doc_id, line_no, line FROM numbered WHERE line_no < {n}"


def _lines(spark: SparkSession, sf_dir: str, n: int | None = None) -> DataFrame:
    """All physical lines of the paragraph file, or the first ``n`` per language (L2)."""
    if n is None:
        a = _valid_articles(spark, sf_dir)
        return a.select("lang", F.explode(article_line_array(F.col("text"))).alias("line"))
    return line_sample(_articles_table(spark, sf_dir).select("lang", "doc_id", "text"), n)


@register("line_sample", _line_sample_sql(mt.TRAIN_SAMPLE_LINES))
def line_sample_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L2 + P2: the first 10,000 physical lines per language of the paragraph file."""
    return _lines(spark, sf_dir, mt.TRAIN_SAMPLE_LINES)


@register("line_sample_eval", _line_sample_sql(mt.EVAL_SAMPLE_LINES))
def line_sample_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L2 + P2: the evaluation sample (5,000 lines)."""
    return _lines(spark, sf_dir, mt.EVAL_SAMPLE_LINES)


def _eff_sql(count_expr: str) -> str:
    return _LINES_CTE + f""",
s AS (SELECT lang, {o.strip_sql('line')} AS l FROM lns),
per AS (SELECT lang, CAST({count_expr} AS BIGINT) AS t, length(l) AS c, strlen(l) AS b
        FROM s WHERE l <> ''),
agg AS (SELECT lang, sum(t) AS tt, sum(c) AS tc, sum(b) AS tb, count(*) AS lp FROM per GROUP BY lang)
SELECT lang,
  CASE WHEN tt > 0 THEN round(tb / tt, 4) END AS bytes_per_token,
  CASE WHEN tt > 0 THEN round(tc / tt, 4) END AS chars_per_token,
  CASE WHEN tt > 0 THEN round(tt / lp, 2) END AS tokens_per_line,
  CAST(CASE WHEN tt > 0 THEN tt END AS BIGINT) AS total_tokens,
  CAST(CASE WHEN tt > 0 THEN tc END AS BIGINT) AS total_chars,
  CAST(CASE WHEN tt > 0 THEN tb END AS BIGINT) AS total_bytes,
  CAST(CASE WHEN tt > 0 THEN lp END AS BIGINT) AS lines_processed,
  CASE WHEN tt > 0 THEN NULL ELSE 'no tokens produced' END AS error
FROM agg"""


_SIMPLE_COUNT_SQL = f"len(regexp_extract_all(l, {o.q(tk.SIMPLE_PATTERN)}))"


@register("efficiency_bytes", _eff_sql("strlen(l)"))
def efficiency_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4 with byte-level tokens (B8) over all lines."""
    return mt.efficiency(_lines(spark, sf_dir), tk.byte_token_count)


@register("efficiency_pretokens", _eff_sql(_SIMPLE_COUNT_SQL))
def efficiency_pretokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4 with pattern pre-tokens (the look-ahead-free byte-level pattern)."""
    return mt.efficiency(_lines(spark, sf_dir), tk.pretoken_count)


@register("efficiency_eval_pretokens", "SELECT lang, bytes_per_token, chars_per_token, "
          "tokens_per_line, CASE WHEN error IS NULL THEN NULL ELSE 'no tokens' END AS error FROM ("
          + _eff_sql(_SIMPLE_COUNT_SQL) + ")")
def efficiency_eval_pretokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5: evaluation variant over all lines."""
    return mt.efficiency_eval(_lines(spark, sf_dir), tk.pretoken_count)


@register("efficiency_compare", "WITH e AS (" + _eff_sql(_SIMPLE_COUNT_SQL)
          + """), b AS (SELECT bytes_per_token AS base_bpt FROM e WHERE lang = 'en')
SELECT 'en' AS baseline, e.lang, round(e.bytes_per_token - b.base_bpt, 4) AS bytes_per_token_delta,
       round(e.bytes_per_token / b.base_bpt, 4) AS bytes_per_token_ratio
FROM e LEFT JOIN b ON true WHERE e.lang <> 'en'""")
def efficiency_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language against english ('en') on rounded bytes/token."""
    eff = mt.efficiency(_lines(spark, sf_dir), tk.pretoken_count)
    return mt.compare(eff, "en")


@register("byte_tokens", _DOCS_CTE[:-2] + """,
h AS (SELECT lang, doc_id, text, hex(encode(text)) AS h FROM docs)
SELECT lang, doc_id, CAST(strlen(text) AS INTEGER) AS n_ids,
       CAST(('0x' || substr(h, 1, 2))::INTEGER AS INTEGER) AS first_id,
       CAST(list_sum(list_transform(range(0, strlen(text)),
                                    lambda i: ('0x' || substr(h, 2 * i + 1, 2))::INTEGER)) AS BIGINT) AS id_sum
FROM h""")
def byte_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level ids of every kept document (count, first id, sum of ids)."""
    d = _docs(spark, sf_dir).select("lang", "doc_id", tk.byte_ids(F.col("text")).alias("ids"))
    return d.select("lang", "doc_id", F.size("ids").alias("n_ids"),
                    F.element_at("ids", 1).alias("first_id"),
                    F.aggregate("ids", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("id_sum"))


# ---------------------------------------------------------------------------
# Runs table: bootstrap, criterion, verdicts, summaries
# ---------------------------------------------------------------------------

from corpuslab.operators import stats as st  # noqa: E402
from corpuslab.plans.views import logged_runs, runs_from_events, scenario_runs  # noqa: E402


def _cells_sql(n_runs: int | str | None) -> str:
    """Cells of the log of so many runs, of the scenarios, or of one run per event."""
    runs = o.runs_cte() if n_runs is None else o.scenario_runs_cte() if n_runs == "scenarios" else o.logged_runs_cte(n_runs)
    return "WITH " + runs + """,
cells AS (SELECT language, size, tokenizer_type, list(val_bpb ORDER BY run_ord) AS vals,
                 count(*) AS n FROM runs GROUP BY language, size, tokenizer_type)"""


def _ci_sql(n_runs: int | str | None, n_boot: int = 10_000) -> str:
    return _cells_sql(n_runs) + f""",
reps AS (SELECT c.*, r.rep FROM cells c, range(0, {n_boot}) r(rep)),
means AS (SELECT language, size, tokenizer_type,
                 list_sum(list_transform(range(0, n), lambda j:
                   vals[(('0x' || substr(md5(concat_ws(':', '42', rep, j)), 1, 8))::BIGINT % n) + 1]))
                 / n AS m FROM reps),
q AS (SELECT language, size, tokenizer_type, quantile_cont(m, 0.025) AS lo,
             quantile_cont(m, 0.975) AS hi FROM means GROUP BY language, size, tokenizer_type),
ci AS (SELECT c.language, c.size, c.tokenizer_type, list_sum(c.vals) / c.n AS mean, q.lo AS ci_lo,
              q.hi AS ci_hi, CAST(c.n AS BIGINT) AS n
       FROM cells c JOIN q ON c.language = q.language AND c.size = q.size
                          AND c.tokenizer_type = q.tokenizer_type)"""


def _ci_query_sql(n_runs: int | None, n_boot: int = 10_000) -> str:
    return _ci_sql(n_runs, n_boot) + """
SELECT language, size, tokenizer_type, round(mean, 6) AS mean, round(ci_lo, 6) AS ci_lo,
       round(ci_hi, 6) AS ci_hi, n FROM ci"""


def _eval_sql(n_runs: int | str) -> str:
    return _ci_sql(n_runs) + """,
grid AS (SELECT DISTINCT s.size, t.tokenizer_type, l.language
         FROM (SELECT DISTINCT size FROM runs) s, (SELECT DISTINCT tokenizer_type FROM runs) t,
              (SELECT DISTINCT language FROM runs WHERE language <> 'english') l),
j AS (SELECT g.size, g.tokenizer_type, g.language,
             b.mean AS b_mean, b.ci_lo AS b_lo, b.ci_hi AS b_hi, coalesce(b.n, 0) AS bn,
             t.mean AS t_mean, t.ci_lo AS t_lo, t.ci_hi AS t_hi, coalesce(t.n, 0) AS tn
      FROM grid g
      LEFT JOIN ci b ON b.language = 'english' AND b.size = g.size AND b.tokenizer_type = g.tokenizer_type
      LEFT JOIN ci t ON t.language = g.language AND t.size = g.size AND t.tokenizer_type = g.tokenizer_type),
k AS (SELECT *, bn >= 2 AND tn >= 2 AS ok, b_lo * (1 - 0.05) AS thr,
             upper(substr(language, 1, 1)) || substr(language, 2) AS nm FROM j),
ev AS (SELECT size, tokenizer_type, language,
  CASE WHEN ok THEN 'ok' ELSE 'insufficient_seeds' END AS status,
  CAST(bn AS BIGINT) AS baseline_n, CAST(tn AS BIGINT) AS treatment_n,
  CASE WHEN ok THEN round(b_mean, 4) END AS baseline_mean,
  CASE WHEN ok THEN round(b_lo, 4) END AS baseline_ci_lo,
  CASE WHEN ok THEN round(b_hi, 4) END AS baseline_ci_hi,
  CASE WHEN ok THEN round(t_mean, 4) END AS treatment_mean,
  CASE WHEN ok THEN round(t_lo, 4) END AS treatment_ci_lo,
  CASE WHEN ok THEN round(t_hi, 4) END AS treatment_ci_hi,
  CASE WHEN ok THEN round(CASE WHEN b_mean > 0 THEN (b_mean - t_mean) / b_mean ELSE 0.0 END, 4) END
    AS relative_reduction,
  CASE WHEN ok THEN round(thr, 4) END AS threshold_for_criterion,
  CASE WHEN ok THEN t_hi < thr END AS criterion_met,
  CASE WHEN ok THEN (CASE WHEN t_hi < thr
    THEN printf('H1 SUPPORTED at %s (%s): %s CI upper (%.4f) < threshold (%.4f)',
                size, tokenizer_type, nm, t_hi, thr)
    ELSE printf('H1 NOT SUPPORTED at %s (%s): %s CI upper (%.4f) >= threshold (%.4f)',
                size, tokenizer_type, nm, t_hi, thr) END) END AS interpretation
  FROM k)"""


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs_from_events(spark, sf_dir)


@register("runs_cells", _cells_sql(None) + """
SELECT language, size, tokenizer_type, CAST(n AS BIGINT) AS n, round(list_sum(vals) / n, 6) AS mean
FROM cells""")
def runs_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores grouped by (language, size, tokenizer_type) in file order."""
    c = st.cells(_runs(spark, sf_dir))
    return c.select(*st.CELL, "n", F.round(F.aggregate("vals", F.lit(0.0), lambda a, x: a + x)
                                           / F.col("n"), 6).alias("mean"))


@register("bootstrap_ci", _ci_query_sql(24))
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """10,000-resample percentile interval of the mean per cell (3 seeds)."""
    ci = st.bootstrap(st.cells(logged_runs(spark, sf_dir)))
    return ci.select(*st.CELL, *[F.round(c, 6).alias(c) for c in ("mean", "ci_lo", "ci_hi")], "n")


@register("bootstrap_ci_50_seeds", _ci_query_sql(400))
def bootstrap_ci_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E1 on cells of 50 seeds, where the interval is narrower than [min, max]."""
    ci = st.bootstrap(st.cells(logged_runs(spark, sf_dir, 400)))
    return ci.select(*st.CELL, *[F.round(c, 6).alias(c) for c in ("mean", "ci_lo", "ci_hi")], "n")


EVENT_REPLICATES = 500


@register("bootstrap_ci_events", _ci_query_sql(None, EVENT_REPLICATES))
def bootstrap_ci_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E1 with every event a score: cells of thousands, draws made in blocks; 500 replicates."""
    ci = st.bootstrap_rows(st.score_rows(_runs(spark, sf_dir)), n_boot=EVENT_REPLICATES)
    return ci.select(*st.CELL, *[F.round(c, 6).alias(c) for c in ("mean", "ci_lo", "ci_hi")], "n")


@register("significance", _eval_sql(24) + " SELECT * FROM ev")
def significance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per size x tokenizer type, the pre-registered criterion."""
    return st.evaluate(logged_runs(spark, sf_dir))


@register("significance_sparse", _eval_sql(12) + " SELECT * FROM ev")
def significance_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells with fewer than 2 seeds give the insufficient-seeds record."""
    return st.evaluate(logged_runs(spark, sf_dir, 12))


@register("verdict", _eval_sql(24) + """
SELECT tokenizer_type, language,
       CASE WHEN sum(CASE WHEN status <> 'ok' THEN 1 ELSE 0 END) > 0 THEN NULL
            ELSE bool_and(criterion_met) END AS h1_supported,
       CAST(count(*) AS BIGINT) AS sizes
FROM ev GROUP BY tokenizer_type, language""")
def verdict_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The criterion must hold at every size."""
    return st.verdict(st.evaluate(logged_runs(spark, sf_dir))).drop("baseline_better")


_OUTCOME_SQL = """,
v AS (SELECT tokenizer_type, language,
             CASE WHEN sum(CASE WHEN status <> 'ok' THEN 1 ELSE 0 END) > 0 THEN NULL
                  ELSE bool_and(criterion_met) END AS h,
             bool_and(status = 'ok' AND baseline_ci_hi < treatment_ci_lo) AS worse
      FROM ev GROUP BY tokenizer_type, language),
p AS (SELECT language, max(CASE WHEN tokenizer_type = 'bpe' THEN h END) AS bpe,
             max(CASE WHEN tokenizer_type = 'byte' THEN h END) AS byte,
             max(CASE WHEN tokenizer_type = 'bpe' THEN worse END) AS worse
      FROM v GROUP BY language)
SELECT language, bpe AS bpe_supported, byte AS byte_supported,
       CASE WHEN bpe IS NULL OR byte IS NULL THEN 'undetermined'
            WHEN bpe AND byte THEN 'strong_positive' WHEN bpe THEN 'tokenization_only'
            WHEN worse THEN 'negative' ELSE 'null' END AS outcome
FROM p"""


@register("outcome", _eval_sql(24) + _OUTCOME_SQL)
def outcome_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcome class from the bpe and byte verdicts."""
    return st.outcome(st.evaluate(logged_runs(spark, sf_dir)))


@register("outcome_classes", _eval_sql("scenarios") + _OUTCOME_SQL)
def outcome_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E8 on languages that do better, worse or as well as the baseline: every class."""
    return st.outcome(st.evaluate(scenario_runs(spark, sf_dir)))


@register("bar_table", _ci_sql(24) + """
SELECT tokenizer_type, size, language, substr(language, 1, 2) || '-' || size AS label,
       round(mean, 6) AS mean, round(mean - ci_lo, 6) AS lo_err, round(ci_hi - mean, 6) AS hi_err,
       CASE WHEN language = 'english' THEN 0 ELSE 1 END AS baseline_last
FROM ci""")
def bar_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-cell mean and interval distances (the bar chart as a table)."""
    return st.bar_table(logged_runs(spark, sf_dir))


@register("bar_table_ordered", _ci_sql(24) + """
SELECT row_number() OVER (ORDER BY tokenizer_type, size, CASE WHEN language = 'english' THEN 0 ELSE 1 END, language) - 1
         AS row_no, tokenizer_type, size, language FROM ci""")
def bar_table_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the bar table, numbered as they come."""
    return od.with_row_order(st.bar_table(logged_runs(spark, sf_dir))).select("row_no", "tokenizer_type", "size", "language")


@register("learning_curve", "WITH " + o.runs_cte() + """,
pts AS (SELECT language, size, tokenizer_type,
               CAST(generate_subscripts(c, 1) - 1 AS INTEGER) AS step, unnest(c) AS v
        FROM (SELECT *, CAST(val_bpb_curve AS DOUBLE[]) AS c FROM runs))
SELECT language, size, tokenizer_type, step, round(avg(v), 6) AS mean, min(v) AS min, max(v) AS max,
       CAST(count(*) AS BIGINT) AS n
FROM pts GROUP BY language, size, tokenizer_type, step""")
def learning_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """val_bpb by step per cell."""
    return st.learning_curve(_runs(spark, sf_dir))


@register("cell_costs", "WITH " + o.runs_cte() + """
SELECT language, size, tokenizer_type, round(avg(wallclock_s), 6) AS avg_wallclock_s,
       CAST(sum(tokens) AS BIGINT) AS total_tokens, CAST(count(*) AS BIGINT) AS runs
FROM runs GROUP BY language, size, tokenizer_type""")
def cell_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wall clock and training tokens per cell."""
    return st.cell_costs(_runs(spark, sf_dir))


@register("side_by_side", "WITH " + o.runs_cte() + """
SELECT language, size,
       round(avg(CASE WHEN tokenizer_type = 'bpe' THEN val_bpb END), 6) AS bpe_val_bpb,
       round(avg(CASE WHEN tokenizer_type = 'byte' THEN val_bpb END), 6) AS byte_val_bpb
FROM runs GROUP BY language, size""")
def side_by_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10: byte-level and BPE results side by side."""
    return st.side_by_side(_runs(spark, sf_dir))


@register("run_count", "WITH " + o.runs_cte() + " SELECT CAST(count(*) AS BIGINT) AS runs FROM runs")
def run_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A11."""
    return st.run_count(_runs(spark, sf_dir))


@register("summary_lines", _eval_sql(24) + """,
body AS (SELECT CAST(row_number() OVER (ORDER BY size, tokenizer_type, language) + 4 AS BIGINT)
                  AS line_no,
                CASE WHEN status <> 'ok' THEN '- **' || size || '-' || tokenizer_type
                       || '**: insufficient seeds'
                     ELSE '- **' || size || '-' || tokenizer_type || '**: ' || interpretation END
                  AS line FROM ev),
info AS (SELECT (SELECT count(*) FROM runs) AS runs, (SELECT count(*) FROM ev) AS k)
SELECT * FROM body
UNION ALL SELECT 1, '""" + st.SUMMARY_TITLE + """'
UNION ALL SELECT 2, ''
UNION ALL SELECT 3, '""" + st.SUMMARY_HEADING + """'
UNION ALL SELECT 4, ''
UNION ALL SELECT CAST(k + 5 AS BIGINT), '' FROM info
UNION ALL SELECT CAST(k + 6 AS BIGINT), 'Total runs loaded: ' || runs FROM info""")
def summary_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K5: the markdown summary report as numbered lines."""
    return st.summary_lines(logged_runs(spark, sf_dir))


@register("val_bpb_from_losses", """
SELECT lang AS run_id, round(sum(length(text) * (5 + doc_id % 7) / 10.0) / (ln(2.0) * sum(strlen(text))), 9) AS val_bpb
FROM documents GROUP BY lang""")
def val_bpb_from_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A8 on a validation-loss table derived from documents (0.5 to 1.1 nats per character)."""
    d = table(spark, sf_dir, "documents")
    losses = d.select(F.col("lang").alias("run_id"), "doc_id",
                      (F.char_length("text") * (5 + F.col("doc_id") % 7) / 10.0).alias("nll_nats"), "text")
    return st.val_bpb(losses).select("run_id", F.round("val_bpb", 9).alias("val_bpb"))


# ---------------------------------------------------------------------------
# Sinks, written to the shared folder and read back
# ---------------------------------------------------------------------------

@register("articles_readback", _CLEANED_CTE + """
SELECT CAST(doc_id AS VARCHAR) AS id, title, CAST(length(text) AS INTEGER) AS n_chars, md5(text) AS text_md5
FROM valid""")
def articles_readback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1 + S3: the article files."""
    path = scratch_path(spark, "articles")
    arts = _valid_articles(spark, sf_dir)
    writers.write_articles(arts.select("lang", F.col("doc_id").cast("string").alias("id"), "title", "text"), path)
    return readers.read_articles(spark, path).select(
        "id", "title", F.char_length("text").alias("n_chars"), F.md5("text").alias("text_md5"))


@register("dump_pages", "WITH " + o.WIKIFIED_CTE + """
SELECT lang, CASE WHEN doc_id % 50 <> 4 THEN CAST(doc_id AS VARCHAR) END AS id, title,
       CASE WHEN doc_id % 50 = 3 THEN NULL WHEN doc_id % 50 = 6 AND text IS NULL THEN md5('later')
            ELSE md5(text) END AS text_md5 FROM wiki""")
def dump_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S1 + T24: all pages of bz2 dump files, several per language."""
    path = scratch_path(spark, "dump")
    write_dump(spark, sf_dir, path)
    return readers.read_dump(spark, path).select("lang", "id", "title", F.md5("text").alias("text_md5"))


@register("dump_articles", _CLEANED_CTE + """
SELECT lang, CASE WHEN doc_id % 50 = 4 THEN CAST(row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS VARCHAR)
                  ELSE CAST(doc_id AS VARCHAR) END AS id, title, md5(text) AS text_md5
FROM valid WHERE doc_id % 50 <> 3""")
def dump_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The articles of the dump files, those without an id numbered by the articles kept
    before them in their language."""
    path = scratch_path(spark, "dump")
    write_dump(spark, sf_dir, path)
    arts = dump_job.articles(readers.read_dump(spark, path), ENGLISH, "lang", PROFILES)
    return readers.with_page_ids(arts, ["lang"]).select("lang", "id", "title", F.md5("text").alias("text_md5"))


@register("articles_overwritten", _CLEANED_CTE + "SELECT CAST(doc_id AS VARCHAR) AS id, title FROM valid WHERE lang = 'fr'")
def articles_overwritten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K7: a second write to the same path leaves nothing of the first."""
    path = scratch_path(spark, "articles")
    arts = _articles_table(spark, sf_dir).select("lang", F.col("doc_id").cast("string").alias("id"), "title", "text")
    writers.write_articles(arts, path)
    writers.write_articles(arts.where("lang = 'fr'"), path)
    return readers.read_articles(spark, path).select("id", "title")


@register("corpora_by_name", _CLEANED_CTE + """
SELECT CASE lang WHEN 'en' THEN 'english' WHEN 'de' THEN 'esperanto' ELSE 'loga' END AS corpus,
       CAST(count(*) AS BIGINT) AS docs, CAST(sum(strlen(text)) AS BIGINT) AS bytes
FROM valid WHERE length(""" + o.strip_sql("text") + """) > 50 GROUP BY 1""")
def corpora_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S4 + S3 + F7: three corpora in one folder, each found by its name."""
    folder = scratch_path(spark, "corpora")
    lang = F.col("lang")
    corpus = F.when(lang == "en", "english").when(lang == "de", "esperanto").otherwise("loga")
    arts = written_table(_valid_articles(spark, sf_dir).select(
        corpus.alias("corpus"), F.col("doc_id").cast("string").alias("id"), "title", "text"), "corpora")
    out = None
    for name, file in CORPUS_FILES.items():
        arts.where(F.col("corpus") == name).select("id", "title", "text").write.json(f"{folder}/{file}")
        docs = pj.load_docs(readers.read_corpus(spark, folder, name).withColumn("lang", F.lit(name)), ord_col="ord")
        out = docs if out is None else out.unionByName(docs)
    return out.groupBy(F.col("lang").alias("corpus")).agg(
        F.count("*").cast("bigint").alias("docs"), F.sum(F.octet_length("text")).cast("bigint").alias("bytes"))


@register("runs_readback", "WITH " + o.runs_cte() + """
SELECT run_id, language, size, seed, tokenizer_type, val_bpb, hparams_json, run_ord AS row_no FROM runs""")
def runs_readback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs table as a TSV file (quoted JSON, the other spelling of the score), read by name and
    in file order."""
    path = scratch_path(spark, "runs")
    runs = _runs(spark, sf_dir).select(
        "size", "run_id", "language", "seed", "tokenizer_type", F.col("val_bpb").alias("val_bpb_final"), "hparams_json", "run_ord")
    (runs.repartitionByRange(3, "run_ord").sortWithinPartitions("run_ord").drop("run_ord").write
     .option("sep", "\t").option("header", True).option("quote", '"').option("escape", '"').csv(path))
    back = od.with_global_index(readers.read_runs(spark, path), ["run_ord"], None, "row_no")
    return back.select("run_id", "language", "size", "seed", "tokenizer_type", "val_bpb", "hparams_json", "row_no")


@register("lines_readback", _LINES_CTE + "SELECT lang, line_no, line FROM numbered")
def lines_readback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K2 + S5 + P2: the paragraph files, in dump order, read line by line."""
    path = scratch_path(spark, "lines")
    pars = paragraphs(_articles_table(spark, sf_dir).select("lang", "doc_id", "text"), "text")
    writers.write_lines(pars, path, order=["doc_id", "para_pos"])
    return readers.read_lines(spark, path).select("lang", "line_no", "line")


@register("shards_readback", _shards_sql(50, 6535).rsplit("SELECT lang, doc_id, split, idx,", 1)[0] + """
SELECT sh.lang, sh.split,
       CAST(CASE WHEN sh.split = 'val' THEN 6542 ELSE s + CASE WHEN s >= 6542 THEN 1 ELSE 0 END END
            AS INTEGER) AS shard,
       CAST(count(*) AS BIGINT) AS docs, CAST(sum(strlen(text)) AS BIGINT) AS bytes
FROM sh JOIN split USING (lang, doc_id) GROUP BY ALL""")
def shards_readback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K3 (+K7): the shard files."""
    path = scratch_path(spark, "shards")
    writers.write_shards(pj.assign_shards(_split_table(spark, sf_dir), 50, 6535), path)
    return spark.read.parquet(path).groupBy("lang", "split", "shard").agg(
        F.count("*").cast("bigint").alias("docs"), F.sum(F.octet_length("text")).cast("bigint").alias("bytes"))


@register("shards_in_order", _shards_sql(50, 6535).rsplit("SELECT lang, doc_id, split, idx,", 1)[0] + """
SELECT sh.lang, sh.split,
       CAST(CASE WHEN sh.split = 'val' THEN 6542 ELSE s + CASE WHEN s >= 6542 THEN 1 ELSE 0 END END AS INTEGER) AS shard,
       row_number() OVER (PARTITION BY sh.lang, sh.split, s + CASE WHEN sh.split = 'val' THEN NULL ELSE 0 END
                          ORDER BY doc_id) - 1 AS pos, md5(text) AS text_md5
FROM sh JOIN split USING (lang, doc_id)""")
def shards_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K3: the texts of each shard at their place in its files."""
    path = scratch_path(spark, "shards")
    writers.write_shards(pj.assign_shards(_split_table(spark, sf_dir), 50, 6535), path)
    rows = spark.read.parquet(path).select("*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    rows = od.with_global_index(rows, ["file", "row"], ["lang", "split", "shard"], "pos")
    return rows.select("lang", "split", "shard", "pos", F.md5("text").alias("text_md5"))


@register("significance_report", _eval_sql(24) + """
SELECT size || '-' || tokenizer_type AS cell, language, status, baseline_mean, baseline_ci_lo, baseline_n,
       treatment_mean, treatment_ci_hi, treatment_n, relative_reduction, criterion_met, interpretation FROM ev""")
def significance_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K4 + E6: the nested JSON report."""
    path = scratch_path(spark, "report")
    writers.write_report(st.as_records(st.evaluate(logged_runs(spark, sf_dir))), path)
    return spark.read.json(path).select(
        "cell", "language", "status", F.col("baseline.mean").alias("baseline_mean"),
        F.col("baseline.ci_lo").alias("baseline_ci_lo"), F.col("baseline.n").alias("baseline_n"),
        F.col("treatment.mean").alias("treatment_mean"), F.col("treatment.ci_hi").alias("treatment_ci_hi"),
        F.col("treatment.n").alias("treatment_n"), "relative_reduction", "criterion_met", "interpretation")


# ---------------------------------------------------------------------------
# Pre-tokens and byte-pair vocabularies (SQL can't learn merges; what it can tell without them is
# compared: round trips, byte lengths, unknown symbols)
# ---------------------------------------------------------------------------

from corpuslab.operators import bpe  # noqa: E402


def _split_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_lineage(pj.split_docs(_docs(spark, sf_dir)))


@register("pretoken_freqs_simple", _SPLIT_CTE + f""",
w AS (SELECT lang, unnest(regexp_extract_all(text, {o.q(tk.SIMPLE_PATTERN)})) AS word
      FROM split WHERE split = 'train')
SELECT lang, word, CAST(count(*) AS BIGINT) AS freq FROM w GROUP BY lang, word""")
def pretoken_freqs_simple(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B1 with the look-ahead-free pattern: pre-token frequencies of the train split."""
    train = pj.split_docs(_docs(spark, sf_dir)).where(F.col("split") == "train")
    return bpe.word_freqs(train, pattern=tk.SIMPLE_PATTERN).select("lang", "word", "freq")


@register("pretoken_freqs_prefix", _SPLIT_CTE + f""",
w AS (SELECT lang, unnest(regexp_extract_all(substr(text, 1, 10000), {o.q(tk.SIMPLE_PATTERN)})) AS word
      FROM split WHERE split = 'train')
SELECT lang, word, CAST(count(*) AS BIGINT) AS freq FROM w GROUP BY lang, word""")
def pretoken_freqs_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T25, the training job's own step: the same counts over the first 10,000 characters."""
    train = pj.split_docs(_docs(spark, sf_dir)).where(F.col("split") == "train")
    return bpe.word_freqs(train, pattern=tk.SIMPLE_PATTERN, prefix_chars=bpe.TRAIN_PREFIX_CHARS).select(
        "lang", "word", "freq")


@register("pretoken_roundtrip", _DOCS_CTE[:-2] + """
SELECT lang, CAST(count(*) AS BIGINT) AS docs, CAST(0 AS BIGINT) AS mismatches FROM docs GROUP BY lang""")
def pretoken_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B6 over whole texts: the training pattern's pre-tokens put together are the text."""
    d = _docs(spark, sf_dir)
    same = F.array_join(tk.pretokens(F.col("text")), "") == F.col("text")
    return d.groupBy("lang").agg(F.count("*").cast("bigint").alias("docs"),
                                 F.sum(F.when(same, 0).otherwise(1)).cast("bigint").alias("mismatches"))


# The training pattern for RE2, which has no look-ahead: a mark before the last white space
# of a longer run that text follows ends ``\\s+`` where ``\\s+(?!\\S)`` would; the alternatives
# that may run over it take it along, and it is dropped from the tokens.
_MARK = "\ue000"
_MARKED_PATTERN = (rf"'(?i:[sdmt]|ll|ve|re)|[^\r\n\p{{L}}\p{{N}}{_MARK}]?\p{{L}}+|\p{{N}}{{1,2}}"
                   rf"| ?[^\s\p{{L}}\p{{N}}{_MARK}]+[\r\n{_MARK}]*|[\s{_MARK}]*[\r\n]|\s+")
_MARKED_SQL = rf"regexp_replace(text, '(\s)(\s)(\S)', '\1{_MARK}\2\3', 'g')"


@register("pretoken_freqs", _SPLIT_CTE + f""",
w AS (SELECT lang, replace(unnest(regexp_extract_all({_MARKED_SQL}, {o.q(_MARKED_PATTERN)})), '{_MARK}', '') AS word
      FROM split WHERE split = 'train')
SELECT lang, word, CAST(count(*) AS BIGINT) AS freq FROM w GROUP BY lang, word""")
def pretoken_freqs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B1 with the training split pattern (possessive, look-ahead: Java only)."""
    train = pj.split_docs(_docs(spark, sf_dir)).where(F.col("split") == "train")
    return bpe.word_freqs(train).select("lang", "word", "freq")


_MARKED_BYTE_LEVEL = (rf"'s|'t|'re|'ve|'m|'ll|'d|{_MARK}? ?\p{{L}}+|{_MARK}? ?\p{{N}}+|{_MARK}? ?[^\s\p{{L}}\p{{N}}{_MARK}]+"
                      rf"|{_MARK}?\s+")


@register("pretoken_freqs_byte_level", _SPLIT_CTE + f""",
w AS (SELECT lang, replace(unnest(regexp_extract_all({_MARKED_SQL}, {o.q(_MARKED_BYTE_LEVEL)})), '{_MARK}', '') AS word
      FROM split WHERE split = 'train')
SELECT lang, word, CAST(count(*) AS BIGINT) AS freq FROM w GROUP BY lang, word""")
def pretoken_freqs_byte_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P4 + B1: the byte-level pattern with its look-ahead."""
    train = pj.split_docs(_docs(spark, sf_dir)).where(F.col("split") == "train")
    return bpe.word_freqs(train, pattern=tk.BYTE_LEVEL_PATTERN).select("lang", "word", "freq")


#: Vocabularies learned in this session (merge lists, bounded by the vocabulary size): several
#: queries read the same one, as the jobs after training do.
_LEARNED: dict[tuple, bpe.Merges] = {}


def _learned(spark: SparkSession, sf_dir: str, variant: str, learn: Callable[[], bpe.Merges]) -> bpe.Merges:
    key = (spark.sparkContext.applicationId, sf_dir, variant)
    if key not in _LEARNED:
        _LEARNED[key] = learn()
    return _LEARNED[key]


def _train_merges(spark: SparkSession, sf_dir: str, split: DataFrame) -> bpe.Merges:
    """B3 on the train split, at the full vocabulary size."""
    return _learned(spark, sf_dir, "train", lambda: bpe.learn_train_merges(
        bpe.word_freqs(split.where(F.col("split") == "train"))))


def _eval_merges(spark: SparkSession, sf_dir: str, lines: DataFrame) -> bpe.Merges:
    """B2 on the lines of the paragraph file, at the full vocabulary size."""
    return _learned(spark, sf_dir, "eval", lambda: bpe.learn_eval_merges(_line_words(lines)))


def _line_words(lines: DataFrame) -> DataFrame:
    return bpe.word_freqs(lines, "line", pattern=tk.BYTE_LEVEL_PATTERN)


def _line_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written_table(mt.stripped_lines(_lines(spark, sf_dir)), "lines")


@register("bpe_merges")
def bpe_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The merges of the 8,192-entry vocabulary of each language's train split (ranked)."""
    return _train_merges(spark, sf_dir, _split_table(spark, sf_dir)).frame(spark)


@register("bpe_token_counts")
def bpe_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B4 + B5 + A3: tokens and UTF-8 bytes per language and split."""
    split = _split_table(spark, sf_dir)
    words = written_table(bpe.word_freqs(split, by=["lang", "split"]), "words")
    counts = bpe.token_counts(words, bpe.encode_words(words, _train_merges(spark, sf_dir, split)), ["lang", "split"])
    b = split.groupBy("lang", "split").agg(F.sum(F.octet_length("text")).cast("bigint").alias("bytes"))
    return counts.join(b, ["lang", "split"]).select("lang", "split", "tokens", "bytes")


@register("token_totals")
def token_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3: tokens, UTF-8 bytes and documents per language and split, with totals (rollup)."""
    split = _split_table(spark, sf_dir)
    coded = bpe.encode_docs(split, _train_merges(spark, sf_dir, split)).select("lang", "doc_id", F.size("ids").alias("n"))
    sizes = split.select("lang", "doc_id", "split", F.octet_length("text").alias("b"))
    return sizes.join(coded, ["lang", "doc_id"]).rollup("lang", "split").agg(
        F.sum("n").cast("bigint").alias("tokens"), F.sum("b").cast("bigint").alias("bytes"),
        F.count("*").cast("bigint").alias("docs"))


@register("bpe_roundtrip", _DOCS_CTE[:-2] + """
SELECT lang, doc_id, CAST(strlen(text) AS BIGINT) AS n_bytes, md5(text) AS text_md5 FROM docs""")
def bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B4 + B6 + B7: every whole document encoded and decoded; ``n_bytes`` is the sum of its tokens'
    byte lengths."""
    split = _split_table(spark, sf_dir)
    m = _train_merges(spark, sf_dir, split)
    return _decoded(bpe.encode_docs(split, m), bpe.vocab_table(spark, m)).select("lang", "doc_id", "n_bytes", "text_md5")


def _decoded(coded: DataFrame, vocab: DataFrame) -> DataFrame:
    lengths = vocab.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("token_id", "n_bytes"))),
                                                    lambda t: t["n_bytes"]).alias("lengths"))
    # a row of vocabulary size per language
    n = F.aggregate(F.transform("ids", lambda i: F.get("lengths", i)), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return bpe.decode(coded, vocab).join(F.broadcast(lengths), "lang").withColumns(
        {"n_bytes": n, "text_md5": F.md5("decoded")})


@register("token_bytes")
def token_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vocabulary with true and decoded-alone byte lengths per token."""
    m = _train_merges(spark, sf_dir, _split_table(spark, sf_dir))
    return bpe.vocab_table(spark, m).select("lang", "token_id", "is_special", "n_bytes", "n_bytes_decoded")


@register("vocab_readback", """
SELECT lang, CAST(8192 AS BIGINT) AS tokens, CAST(4 AS BIGINT) AS specials, CAST(7932 AS BIGINT) AS merges,
       CAST(8191 AS INTEGER) AS last_id, CAST(7931 AS INTEGER) AS last_rank FROM documents GROUP BY lang""")
def vocab_readback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K6: vocabulary and merge files, read back and counted (the fixed size and its parts)."""
    m = _train_merges(spark, sf_dir, _split_table(spark, sf_dir))
    path = scratch_path(spark, "vocab")
    writers.write_vocab(bpe.vocab_table(spark, m), m.frame(spark), path)
    vocab, merges = readers.read_vocab(spark, path)
    tokens = vocab.groupBy("lang").agg(
        F.count_distinct("token_id").alias("tokens"), F.sum(F.col("is_special").cast("bigint")).alias("specials"),
        F.max("token_id").alias("last_id"))
    ranks = merges.groupBy("lang").agg(F.count("*").alias("merges"), F.max("rank").alias("last_rank"))
    return tokens.join(ranks, "lang").select("lang", "tokens", "specials", "merges", "last_id", "last_rank")


@register("token_sets_bpe", _SPLIT_CTE + """
SELECT lang, split, doc_id, CAST(strlen(text) AS BIGINT) AS n_bytes, md5(text) AS text_md5 FROM split""")
def token_sets_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K8: the tokenised train and validation sets, written, read back and decoded."""
    split = _split_table(spark, sf_dir)
    m = _train_merges(spark, sf_dir, split)
    path = scratch_path(spark, "tokens")
    writers.write_tokens(bpe.encode_docs(split, m).withColumn("variant", F.lit("bpe")), path)
    return _decoded(readers.read_tokens(spark, path), bpe.vocab_table(spark, m)).select(
        "lang", "split", "doc_id", "n_bytes", "text_md5")


@register("token_sets_byte", _SPLIT_CTE + """
SELECT lang, split, doc_id, CAST(strlen(text) AS INTEGER) AS n_tokens, md5(text) AS text_md5 FROM split""")
def token_sets_byte(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K8, byte variant: written, read back and put together again."""
    path = scratch_path(spark, "tokens")
    writers.write_tokens(_split_table(spark, sf_dir).select(
        "lang", "split", "doc_id", F.lit("byte").alias("variant"), tk.byte_ids(F.col("text")).alias("ids")), path)
    text = F.unhex(F.array_join(F.transform("ids", lambda b: F.lpad(F.hex(b.cast("bigint")), 2, "0")), ""))
    return readers.read_tokens(spark, path).select(
        "lang", "split", "doc_id", F.size("ids").alias("n_tokens"), F.md5(text).alias("text_md5"))


@register("token_budget_bpe")
def token_budget_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L3 on learned ids: train corpora cut to the smallest one's token total, in document order; the
    ids of the boundary document are cut short."""
    split = _split_table(spark, sf_dir)
    coded = written_table(bpe.encode_docs(split.where(F.col("split") == "train"), _train_merges(spark, sf_dir, split))
                          .select("lang", "doc_id", "ids", F.size("ids").cast("bigint").alias("n_tokens")), "coded")
    kept = pj.match_token_budget(coded.select("lang", "doc_id", "n_tokens")).select("lang", "doc_id", "kept_tokens")
    return coded.join(kept, ["lang", "doc_id"]).select(
        "lang", "doc_id", "kept_tokens", F.slice("ids", F.lit(1), F.col("kept_tokens").cast("int")).alias("ids"))


@register("eval_vocab")
def eval_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B2: the evaluation vocabulary of each language: specials, the bytes seen, merges."""
    m = _eval_merges(spark, sf_dir, _line_table(spark, sf_dir))
    return bpe.vocab_table(spark, m, "eval").select("lang", "token_id", F.hex("token").alias("token_hex"), "is_special")


def _efficiency_bpe(spark: SparkSession, sf_dir: str, error: str = "no tokens produced") -> DataFrame:
    lines = _line_table(spark, sf_dir)
    words = written_table(_line_words(lines), "words")
    coded = bpe.encode_words(words, _eval_merges(spark, sf_dir, lines), "eval")
    return mt.efficiency_learned(lines, bpe.token_counts(words, coded), error=error)


@register("efficiency_bpe")
def efficiency_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4 on the evaluation vocabulary, over all lines."""
    return _efficiency_bpe(spark, sf_dir)


@register("efficiency_bpe_eval")
def efficiency_bpe_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5 on the evaluation vocabulary, over all lines."""
    return mt.eval_columns(_efficiency_bpe(spark, sf_dir, "no tokens"))


@register("efficiency_bpe_compare")
def efficiency_bpe_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A6 on the evaluation vocabularies."""
    return mt.compare(_efficiency_bpe(spark, sf_dir), "en")


@register("efficiency_bpe_report", _eff_sql("0").rsplit("SELECT lang,", 1)[0] + """
SELECT lang, CAST(tc AS BIGINT) AS total_chars, CAST(tb AS BIGINT) AS total_bytes, CAST(lp AS BIGINT) AS lines_processed,
       CAST(8192 AS BIGINT) AS vocab_size, CASE WHEN lang <> 'en' THEN 'en' END AS baseline FROM agg""")
def efficiency_bpe_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K4: the nested efficiency report, read back (the columns that SQL can tell)."""
    path = scratch_path(spark, "efficiency")
    writers.write_report(mt.efficiency_report(_efficiency_bpe(spark, sf_dir), "en", bpe.VOCAB_SIZE), path)
    return spark.read.json(path).select(
        "lang", "metrics.total_chars", "metrics.total_bytes", "metrics.lines_processed", "metrics.vocab_size", "comparison.baseline")


@register("unk_rate", _LINES_CTE + f""",
s AS (SELECT lang, {o.strip_sql('line')} AS l FROM lns),
b AS (SELECT lang, unnest(regexp_extract_all(hex(encode(l)), '..')) AS b FROM s WHERE l <> ''),
seen AS (SELECT DISTINCT b FROM b WHERE lang = 'en')
SELECT b.lang, CAST(count(*) AS BIGINT) AS bytes, CAST(sum(CASE WHEN seen.b IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS unk_tokens,
       round(avg(CASE WHEN seen.b IS NULL THEN 1.0 ELSE 0.0 END), 6) AS unk_rate
FROM b LEFT JOIN seen USING (b) GROUP BY b.lang""")
def unk_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of every language under the English evaluation vocabulary: [UNK] tokens (each
    stands for one unseen byte) and their share of all bytes."""
    lines = _line_table(spark, sf_dir)
    words = written_table(_line_words(lines), "words")
    coded = bpe.encode_words(words, _eval_merges(spark, sf_dir, lines), "eval", "en")
    sizes = lines.groupBy("lang").agg(F.sum(F.octet_length("line")).cast("bigint").alias("bytes"))
    return bpe.unknown_counts(words, coded).join(sizes, "lang").select(
        "lang", "bytes", "unk_tokens", F.round(F.col("unk_tokens") / F.col("bytes"), 6).alias("unk_rate"))


@register("token_budget_bytes", _SPLIT_CTE + """,
t AS (SELECT lang, doc_id, strlen(text) AS n FROM split WHERE split = 'train'),
r AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY lang ORDER BY doc_id
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM t),
b AS (SELECT min(tot) AS budget FROM (SELECT lang, sum(n) AS tot FROM t GROUP BY lang))
SELECT lang, doc_id, CAST(least(n, budget - s) AS BIGINT) AS kept_tokens
FROM r, b WHERE s < budget""")
def token_budget_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L3: train corpora cut to the smallest one's byte-token total, in document order."""
    split = _split_table(spark, sf_dir).where(F.col("split") == "train")
    docs = split.select("lang", "doc_id", tk.byte_token_count(F.col("text")).alias("n_tokens"))
    return pj.match_token_budget(docs).select("lang", "doc_id", "kept_tokens")
