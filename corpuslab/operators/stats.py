"""Statistics on a runs table (E1-E11) and run aggregates (A7-A11), as Spark jobs.

Bootstrap (E1): replicates are rows. ``explode(sequence(0, B-1))`` makes B replicate
rows (cell key and number only) per cell, spread over tasks; then the cell's values
(its seeds in file order) are attached from the table of cells, each replicate's mean
is an ``aggregate`` over its n draws, and ``percentile`` (exact, linear interpolation)
gives the interval.
Draw ``j`` of replicate ``r`` is ``md5(seed:r:j)`` mod n: it depends on the
replicate and position only, so cells with equal n share draws (as the
reference's per-call reseeding does), and DuckDB can reproduce it exactly.
A cell's work is B x n expressions in B rows; replicates spread over tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslab.functions.md5 import md5_heads
from corpuslab.operators.order import with_global_index
from corpuslab.session import cut_lineage

# The pre-registered criterion.
RELATIVE_REDUCTION = 0.05
CI_ALPHA = 0.05
BOOTSTRAP_N = 10_000
BOOTSTRAP_SEED = 42
MIN_SEEDS = 2
MAX_BROADCAST_VALUES = 1_000_000  # scores of all cells together, 8 bytes each
BASELINE = "english"
CELL = ["language", "size", "tokenizer_type"]


def runs_with_defaults(runs: DataFrame) -> DataFrame:
    """A7 input rules: a missing or null ``tokenizer_type`` is 'bpe'; ``val_bpb_final``
    is accepted for ``val_bpb``; ``run_ord`` keeps file order when absent."""
    cols = set(runs.columns)
    if "val_bpb" not in cols and "val_bpb_final" in cols:
        runs = runs.withColumnRenamed("val_bpb_final", "val_bpb")
    if "tokenizer_type" not in cols:
        runs = runs.withColumn("tokenizer_type", F.lit("bpe"))
    runs = runs.withColumn("tokenizer_type", F.coalesce(F.col("tokenizer_type"), F.lit("bpe")))
    if "run_ord" not in cols:
        runs = runs.withColumn("run_ord", F.monotonically_increasing_id())
    return runs


def cells(runs: DataFrame) -> DataFrame:
    """Per cell, the scores in file order, and n."""
    r = runs_with_defaults(runs)
    g = r.groupBy(*CELL).agg(F.array_sort(F.collect_list(F.struct("run_ord", "val_bpb"))).alias("s"))
    return g.select(*CELL, F.transform("s", lambda x: x["val_bpb"]).alias("vals"),
                    F.size("s").cast("bigint").alias("n"))


def _draw(rep: Column, j: Column, n: Column, seed: int) -> Column:
    key = F.concat_ws(":", F.lit(str(seed)), rep.cast("string"), j.cast("string"))
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint") % n


def bootstrap(cell_df: DataFrame, keys: list[str] | None = None, n_boot: int = BOOTSTRAP_N,
              alpha: float = CI_ALPHA, seed: int = BOOTSTRAP_SEED) -> DataFrame:
    """``(keys…, mean, ci_lo, ci_hi, n)`` per row of ``cell_df(keys…, vals, n)``.

    An empty cell gives NaN for all three, like the reference.
    """
    keys = keys or CELL
    c = cell_df.where(F.col("n") > 0)
    reps = c.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))).alias("rep"))
    reps = reps.repartition(*keys, "rep")  # spread replicates of a cell over tasks
    # the values travel once per task, not once per replicate, while the cells are small
    small = (c.agg(F.sum("n")).first()[0] or 0) <= MAX_BROADCAST_VALUES
    reps = reps.join(F.broadcast(c) if small else c, keys)

    def add(acc, j):
        idx = _draw(F.col("rep"), j, F.col("n"), seed)
        return acc + F.element_at(F.col("vals"), (idx + 1).cast("int"))

    means = reps.select(*keys, (F.aggregate(F.sequence(F.lit(0), (F.col("n") - 1).cast("int")),
                                            F.lit(0.0), add) / F.col("n")).alias("m"))
    q = means.groupBy(*keys).agg(
        F.percentile("m", F.array(F.lit(100 * alpha / 2 / 100), F.lit(1 - alpha / 2))).alias("p"))
    point = cell_df.select(*keys, "n", F.aggregate("vals", F.lit(0.0), lambda a, x: a + x).alias("s"))
    out = point.join(q, keys, "left").select(
        *keys,
        F.when(F.col("n") > 0, F.col("s") / F.col("n")).otherwise(F.lit(float("nan"))).alias("mean"),
        F.coalesce(F.col("p")[0], F.lit(float("nan"))).alias("ci_lo"),
        F.coalesce(F.col("p")[1], F.lit(float("nan"))).alias("ci_hi"),
        "n",
    )
    return out


#: Draws of a replicate that are made at a time, and blocks of them a task makes.
DRAW_BLOCK = 1_048_576
TASK_BLOCKS = 8
#: What meets in a row: so many scores of each cell (places in a chunk are two bytes), about so many cells, and replicates.
CHUNK_SCORES = 8_192
ROW_CELLS = 8
ROW_REPLICATES = 32


def score_rows(runs: DataFrame) -> DataFrame:
    """A7 as rows: ``(language, size, tokenizer_type, pos, val_bpb, n)``, ``pos`` in file order; no
    cell is put into one array."""
    r = runs_with_defaults(runs).select(*CELL, "run_ord", "val_bpb")
    n = r.groupBy(*CELL).agg(F.count("*").cast("bigint").alias("n"))
    return with_global_index(r, ["run_ord"], CELL, "pos").join(n, CELL).select(*CELL, "pos", "val_bpb", "n")


def _drawn_places(spark: SparkSession, sizes: list[int], n_boot: int, seed: int) -> DataFrame:
    """``(n, chunk, rep, places)``: the draws of every replicate of cells of n scores, as 16-bit places in the
    chunks of scores they fall into. Cells of all sizes have the hashes of the draws in common."""
    blocks = -(-max(sizes, default=0) // DRAW_BLOCK)
    rows = n_boot * blocks
    # a row stands for much work, which a count of partitions chosen by its bytes would put into one task
    tasks = min(max(rows, 1), max(spark.sparkContext.defaultParallelism, -(-rows // TASK_BLOCKS)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[int, np.ndarray] = {}
        for batch in batches:
            for row in batch.column("id").to_numpy():
                rep, first = int(row) % n_boot, int(row) // n_boot * DRAW_BLOCK
                heads = md5_heads(f"{seed}:{rep}:", first, min(first + DRAW_BLOCK, sizes[-1]), tables)
                for n in sizes:
                    if n <= first:
                        continue
                    pos = heads[:n - first] % np.uint32(n) if n < 1 << 32 else heads[:n - first].copy()
                    pos.sort()
                    at = np.append(np.searchsorted(pos, np.arange(0, min(n, 1 << 32), CHUNK_SCORES, dtype=np.uint32)), len(pos))
                    some = np.flatnonzero(np.diff(at))
                    places = (pos % np.uint32(CHUNK_SCORES)).astype("<u2")
                    offsets = np.append(2 * at[some], 2 * len(pos)).astype(np.int32)
                    yield pa.record_batch({
                        "n": np.full(len(some), n), "chunk": some, "rep": np.full(len(some), rep, np.int32),
                        "places": pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer(offsets), pa.py_buffer(places)])})

    return spark.range(0, rows, 1, tasks).mapInArrow(run, "n bigint, chunk bigint, rep int, places binary")


def _chunk_sums(keys: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A row ``(cells, drawn)`` has a chunk of the scores of some cells and draws from it: for each cell and replicate the
    sum of the scores drawn and their count, without nulls."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cells, drawn in zip(batch.column("cells"), batch.column("drawn"), strict=True):
                cells, drawn = cells.values, drawn.values
                draws = [np.frombuffer(x.as_buffer(), "<u2") for x in drawn.field("places")]
                at, n_each = np.concatenate(draws), np.array([len(x) for x in draws])
                starts, sums, counts = np.cumsum(n_each) - n_each, [], []
                for place, value in zip(cells.field("place"), cells.field("value"), strict=True):
                    place, value = place.values.to_numpy(), value.values
                    there = value.is_valid().to_numpy(zero_copy_only=False)
                    total = np.bincount(place, value.fill_null(0.0).to_numpy(), CHUNK_SCORES)
                    count = np.bincount(place[there], minlength=CHUNK_SCORES)
                    with np.errstate(invalid="ignore"):  # infinite scores of both signs
                        sums.append(np.add.reduceat(total[at], starts))
                    counts.append(n_each if (count == 1).all() else np.add.reduceat(count[at], starts))
                each = pa.array(np.repeat(np.arange(len(cells)), len(drawn)))
                yield pa.RecordBatch.from_arrays(
                    [*[cells.field(k).take(each) for k in keys], pa.concat_arrays([drawn.field("rep")] * len(cells)),
                     pa.array(np.concatenate(sums)), pa.array(np.concatenate(counts))], [*keys, "rep", "s", "k"])

    return run


def bootstrap_rows(scores: DataFrame, keys: list[str] | None = None, n_boot: int = BOOTSTRAP_N,
                   alpha: float = CI_ALPHA, seed: int = BOOTSTRAP_SEED) -> DataFrame:
    """E1 for cells of any size, with the draws of ``bootstrap``: the draws of a replicate are made in blocks and
    dealt to the chunks of scores they fall into, chunks joined to those of all cells of n scores, and their sums
    added up per cell and replicate. Only the ``n_boot`` means of a cell come together."""
    keys = keys or CELL
    x = F.struct((F.col("pos") % CHUNK_SCORES).cast("smallint").alias("place"), F.col("val_bpb").cast("double").alias("val_bpb"))
    chunks = cut_lineage(  # read three times
        scores.select(*keys, "n", F.expr(f"pos div {CHUNK_SCORES}").alias("chunk"), x.alias("x"))
        .groupBy(*keys, "n", "chunk").agg(F.collect_list("x").alias("x"), F.sum("x.val_bpb").alias("s"), F.count("x.val_bpb").alias("k"))
        .select(*keys, "n", "chunk", F.col("x.place").alias("place"), F.col("x.val_bpb").alias("value"), "s", "k"))
    # a row for each size; cells of m sizes have m*m/2 scores
    cells = {r.n: r.cells for r in chunks.groupBy("n", "chunk").count().groupBy("n").agg(F.max("count").alias("cells")).collect()}
    some = F.pmod(F.hash(*keys), F.lit(-(-max(cells.values(), default=1) // ROW_CELLS)))
    met = chunks.groupBy("n", "chunk", some.alias("some")).agg(F.collect_list(F.struct(*keys, "place", "value")).alias("cells"))
    draws = (_drawn_places(scores.sparkSession, sorted(cells), n_boot, seed).repartition("n", "chunk")
             .groupBy("n", "chunk", F.expr(f"rep div {ROW_REPLICATES}").alias("part")).agg(F.collect_list(F.struct("rep", "places")).alias("drawn")))
    # the sizes of rows from Python are guessed far too small: without the hint they are broadcast through the driver
    met = draws.hint("merge").join(met, ["n", "chunk"]).select("cells", "drawn")
    sums = met.mapInArrow(_chunk_sums(keys), T.StructType([
        *[scores.schema[k] for k in keys], T.StructField("rep", T.IntegerType()), T.StructField("s", T.DoubleType()), T.StructField("k", T.LongType())]))
    means = sums.groupBy(*keys, "rep").agg(F.try_divide(F.sum("s"), F.sum("k")).alias("m"))
    q = means.groupBy(*keys).agg(F.percentile("m", F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2))).alias("p"))
    point = chunks.groupBy(*keys).agg(F.try_divide(F.sum("s"), F.sum("k")).alias("mean"), F.sum(F.size("place")).cast("bigint").alias("n"))
    return point.join(q, keys).select(*keys, "mean", F.col("p")[0].alias("ci_lo"), F.col("p")[1].alias("ci_hi"), "n")


def _grid(runs: DataFrame) -> DataFrame:
    """Every size x tokenizer type seen anywhere (two explodes of tiny arrays)."""
    r = runs_with_defaults(runs)
    sets = r.agg(F.array_sort(F.collect_set("size")).alias("sizes"),
                 F.array_sort(F.collect_set("tokenizer_type")).alias("toks"))
    return sets.select(F.explode("sizes").alias("size"), "toks").select(
        "size", F.explode("toks").alias("tokenizer_type"))


def evaluate(runs: DataFrame, baseline: str = BASELINE, treatments: list[str] | None = None,
             n_boot: int = BOOTSTRAP_N) -> DataFrame:
    """Per (size, tokenizer_type, treatment language) the evaluation record, flat.

    Columns: size, tokenizer_type, language, status, baseline_n, treatment_n,
    baseline_{mean,ci_lo,ci_hi}, treatment_{mean,ci_lo,ci_hi} (4 dp),
    relative_reduction, threshold_for_criterion (4 dp), criterion_met, interpretation.
    The criterion uses unrounded values.
    """
    cd = cells(runs)
    ci = bootstrap(cd, n_boot=n_boot)
    langs = cd.select("language").distinct().where(F.col("language") != baseline)
    if treatments is not None:
        langs = langs.where(F.col("language").isin(treatments))
    grid = _grid(runs)
    # one row per (size, tok, treatment): the language list is tiny; explode it too
    lang_arr = langs.agg(F.array_sort(F.collect_set("language")).alias("langs"))
    g2 = _with_one_row(grid, lang_arr)
    g2 = g2.select("size", "tokenizer_type", F.explode("langs").alias("language"))
    b = ci.where(F.col("language") == baseline).select(
        "size", "tokenizer_type", *[F.col(c).alias("b_" + c) for c in ("mean", "ci_lo", "ci_hi", "n")])
    t = ci.select("size", "tokenizer_type", "language",
                  *[F.col(c).alias("t_" + c) for c in ("mean", "ci_lo", "ci_hi", "n")])
    j = (g2.join(b, ["size", "tokenizer_type"], "left")
         .join(t, ["size", "tokenizer_type", "language"], "left"))
    bn = F.coalesce(F.col("b_n"), F.lit(0)).cast("bigint")
    tn = F.coalesce(F.col("t_n"), F.lit(0)).cast("bigint")
    ok = (bn >= MIN_SEEDS) & (tn >= MIN_SEEDS)
    thr = F.col("b_ci_lo") * (1 - RELATIVE_REDUCTION)
    met = F.col("t_ci_hi") < thr
    rel = F.when(F.col("b_mean") > 0, (F.col("b_mean") - F.col("t_mean")) / F.col("b_mean")) \
        .otherwise(F.lit(0.0))
    name = F.initcap(F.col("language"))
    interp = F.when(met, F.format_string(
        "H1 SUPPORTED at %s (%s): %s CI upper (%.4f) < threshold (%.4f)",
        F.col("size"), F.col("tokenizer_type"), name, F.col("t_ci_hi"), thr)).otherwise(
        F.format_string("H1 NOT SUPPORTED at %s (%s): %s CI upper (%.4f) >= threshold (%.4f)",
                        F.col("size"), F.col("tokenizer_type"), name, F.col("t_ci_hi"), thr))

    def r4(c: Column) -> Column:
        return F.when(ok, F.round(c, 4))

    return j.select(
        "size", "tokenizer_type", "language",
        F.when(ok, F.lit("ok")).otherwise(F.lit("insufficient_seeds")).alias("status"),
        bn.alias("baseline_n"), tn.alias("treatment_n"),
        r4(F.col("b_mean")).alias("baseline_mean"), r4(F.col("b_ci_lo")).alias("baseline_ci_lo"),
        r4(F.col("b_ci_hi")).alias("baseline_ci_hi"),
        r4(F.col("t_mean")).alias("treatment_mean"), r4(F.col("t_ci_lo")).alias("treatment_ci_lo"),
        r4(F.col("t_ci_hi")).alias("treatment_ci_hi"),
        r4(rel).alias("relative_reduction"), r4(thr).alias("threshold_for_criterion"),
        F.when(ok, met).alias("criterion_met"),
        F.when(ok, interp).alias("interpretation"),
    )


def as_records(ev: DataFrame) -> DataFrame:
    """E6 nested form for the JSON report: ``cell`` key and per-side structs."""
    def side(p: str) -> Column:
        return F.struct(F.col(f"{p}_mean").alias("mean"), F.col(f"{p}_ci_lo").alias("ci_lo"),
                        F.col(f"{p}_ci_hi").alias("ci_hi"), F.col(f"{p}_n").alias("n"))
    return ev.select(F.concat_ws("-", "size", "tokenizer_type").alias("cell"), "language", "status",
                     side("baseline").alias("baseline"), side("treatment").alias("treatment"),
                     "relative_reduction", "threshold_for_criterion", "criterion_met",
                     "interpretation")


def verdict(ev: DataFrame) -> DataFrame:
    """Criterion met at every size, per (tokenizer_type, language); null if any
    size has too few seeds."""
    return ev.groupBy("tokenizer_type", "language").agg(
        F.when(F.sum(F.when(F.col("status") != "ok", 1).otherwise(0)) > 0, F.lit(None).cast("boolean"))
        .otherwise(F.bool_and("criterion_met")).alias("h1_supported"),
        # the baseline is significantly better where its interval lies below the treatment's
        F.coalesce(F.bool_and((F.col("status") == "ok")
                              & (F.col("baseline_ci_hi") < F.col("treatment_ci_lo"))), F.lit(False))
        .alias("baseline_better"),
        F.count("*").cast("bigint").alias("sizes"))


def outcome(ev: DataFrame) -> DataFrame:
    """Outcome class per treatment language from the bpe and byte verdicts; too few
    seeds on either side leave it undetermined."""
    v = verdict(ev)
    p = v.groupBy("language").pivot("tokenizer_type", ["bpe", "byte"]).agg(F.first("h1_supported"))
    worse = v.where("tokenizer_type = 'bpe'").select("language", "baseline_better")
    p = p.join(worse, "language", "left")
    cls = (F.when(F.col("bpe").isNull() | F.col("byte").isNull(), "undetermined")
           .when(F.col("bpe") & F.col("byte"), "strong_positive")
           .when(F.col("bpe"), "tokenization_only")
           .when(F.col("baseline_better"), "negative")
           .otherwise("null"))
    return p.select("language", F.col("bpe").alias("bpe_supported"),
                    F.col("byte").alias("byte_supported"), cls.alias("outcome"))


def bar_table(runs: DataFrame, baseline: str = BASELINE, n_boot: int = BOOTSTRAP_N) -> DataFrame:
    """Per present cell: label, mean and distances to each interval end; ordered
    by tokenizer type, size, baseline language first."""
    ci = bootstrap(cells(runs), n_boot=n_boot).where(F.col("n") > 0)
    return ci.select(
        "tokenizer_type", "size", "language",
        F.concat(F.substring("language", 1, 2), F.lit("-"), F.col("size")).alias("label"),
        F.round("mean", 6).alias("mean"),
        F.round(F.col("mean") - F.col("ci_lo"), 6).alias("lo_err"),
        F.round(F.col("ci_hi") - F.col("mean"), 6).alias("hi_err"),
        F.when(F.col("language") == baseline, 0).otherwise(1).alias("baseline_last"),
    ).orderBy("tokenizer_type", "size", "baseline_last", "language")


def learning_curve(runs: DataFrame, curve_col: str = "val_bpb_curve") -> DataFrame:
    """val_bpb by step per cell from a JSON array column."""
    r = runs_with_defaults(runs)
    pts = r.select(*CELL, F.posexplode(F.from_json(curve_col, "array<double>")).alias("step", "v"))
    return pts.groupBy(*CELL, "step").agg(
        F.round(F.avg("v"), 6).alias("mean"), F.min("v").alias("min"), F.max("v").alias("max"),
        F.count("*").cast("bigint").alias("n"))


def cell_costs(runs: DataFrame) -> DataFrame:
    """Wall clock and training tokens per cell."""
    r = runs_with_defaults(runs)
    return r.groupBy(*CELL).agg(
        F.round(F.avg(F.col("wallclock_s").cast("double")), 6).alias("avg_wallclock_s"),
        F.sum(F.col("tokens").cast("bigint")).alias("total_tokens"),
        F.count("*").cast("bigint").alias("runs"))


def side_by_side(runs: DataFrame) -> DataFrame:
    """A10: BPE and byte-level mean val_bpb next to each other per language and size."""
    r = runs_with_defaults(runs)
    p = r.groupBy("language", "size").pivot("tokenizer_type", ["bpe", "byte"]).agg(F.avg("val_bpb"))
    return p.select("language", "size", F.round("bpe", 6).alias("bpe_val_bpb"),
                    F.round("byte", 6).alias("byte_val_bpb"))


def val_bpb(losses: DataFrame, by: list[str] | None = None) -> DataFrame:
    """sum(nll nats) / (ln 2 * UTF-8 bytes of the raw text), per run."""
    by = by or ["run_id"]
    return losses.groupBy(*by).agg(
        (F.sum("nll_nats") / (F.log(F.lit(2.0)) * F.sum(F.octet_length("text")))).alias("val_bpb"))


def run_count(runs: DataFrame) -> DataFrame:
    """A11."""
    return runs.agg(F.count("*").cast("bigint").alias("runs"))


SUMMARY_TITLE = "# English vs. Esperanto Pre-Training: Summary Report"  # fixed values: report text
SUMMARY_HEADING = "## Pre-registered criterion evaluation"
SUMMARY_EMPTY = "_No runs available yet. Execute the experiment protocol in `train/program.md`._"


def summary_lines(runs: DataFrame, n_boot: int = BOOTSTRAP_N) -> DataFrame:
    """K5: the markdown summary as ``(line_no, line)`` rows.

    With runs: title, blank, heading, blank, one line per cell (sizes then
    tokenizer types), blank, the run count. Without: title, blank, a fixed line.
    """
    ev = evaluate(runs, n_boot=n_boot)
    info = run_count(runs).select(
        "runs", F.lit(0).alias("__z")).join(
        ev.agg(F.count("*").cast("bigint").alias("k"), F.lit(0).alias("__z")), "__z").drop("__z")
    cell_lines = ev.select(
        "size", "tokenizer_type", "language",
        F.when(F.col("status") != "ok",
               F.format_string("- **%s-%s**: insufficient seeds", "size", "tokenizer_type"))
        .otherwise(F.format_string("- **%s-%s**: %s", "size", "tokenizer_type", "interpretation"))
        .alias("line"))
    w = Window.orderBy("size", "tokenizer_type", "language")  # one row per cell: tiny
    body = cell_lines.select((F.row_number().over(w) + 4).cast("bigint").alias("line_no"), "line")

    def rows(*pairs) -> Column:
        return F.array(*[F.struct(n.cast("bigint").alias("line_no"), t.alias("line"))
                         for n, t in pairs])

    fixed = info.select(F.explode(F.when(F.col("runs") > 0, rows(
        (F.lit(1), F.lit(SUMMARY_TITLE)), (F.lit(2), F.lit("")), (F.lit(3), F.lit(SUMMARY_HEADING)),
        (F.lit(4), F.lit("")), (F.col("k") + 5, F.lit("")),
        (F.col("k") + 6, F.format_string("Total runs loaded: %d", F.col("runs")))))
        .otherwise(rows((F.lit(1), F.lit(SUMMARY_TITLE)), (F.lit(2), F.lit("")),
                        (F.lit(3), F.lit(SUMMARY_EMPTY))))).alias("x"))
    return fixed.select("x.line_no", "x.line").unionByName(body)


def _with_one_row(df: DataFrame, one: DataFrame) -> DataFrame:
    """Attach the columns of a one-row aggregate to every row (broadcast, constant key)."""
    return df.withColumn("__one", F.lit(0)).join(
        F.broadcast(one.withColumn("__one", F.lit(0))), "__one").drop("__one")
