"""Order-dependent operators without a single-partition window.

G1 ``with_global_index``: dense 0-based index in a given order, per group.
   Range-partition on (group, order) with an explicit partition count (so AQE
   never coalesces it), sort inside partitions, take the position inside the
   partition from ``monotonically_increasing_id``, and write that table once (a
   reliable checkpoint), so that the counts and the rows read the very same
   partitions whatever columns each keeps. Count rows per (partition, group), turn
   the counts into offsets with a window over that small table, and broadcast the
   offsets back. The broadcast table has at most ``partitions + groups`` rows: its
   size is bounded by our own parameter.
G  ``with_running_sum``: the same with a weight instead of 1 (exclusive prefix sum).
G2 ``shard_numbers``: index -> shard number, skipping a reserved number.
G3 ``split_train_val``: exactly ``max(1, int(frac * n))`` rows per group go to
   validation, chosen by the rank of ``md5(seed:id)``. Only per-bucket counts and
   the rows of one boundary bucket per group are shuffled; the full rows get
   their label in a narrow projection against a one-row-per-group threshold.
L1/L2 heads: index (or running sum) then a filter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslab.session import cut_lineage

VAL_FRACTION = 0.05     # fixed values: validation share and seed
SPLIT_SEED = 42
DOCS_PER_SHARD = 50_000  # fixed value: documents per shard
VAL_SHARD = 6542         # fixed value: the reserved validation shard number
HASH_BUCKET_HEX = 4      # G3 buckets: first 4 hex digits of the md5 -> 65,536 buckets


def _partitions(df: DataFrame, num_partitions: int | None) -> int:
    if num_partitions:
        return num_partitions
    conf = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(conf, 1)


def _range_parts(df: DataFrame, by: list[str], order: list[str], num_partitions: int | None):
    keys = [F.col(c) for c in by + order]
    n = _partitions(df, num_partitions)
    part = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    pid = F.spark_partition_id()
    part = part.withColumn("__pid", pid).withColumn(
        "__local", F.monotonically_increasing_id() - F.shiftleft(pid.cast("bigint"), 33))
    return cut_lineage(part)


def _group_cols(by: list[str]) -> list[str]:
    return by if by else ["__all"]


def with_global_index(df: DataFrame, order: list[str], by: list[str] | None = None,
                      name: str = "idx", num_partitions: int | None = None) -> DataFrame:
    """G1: ``name`` = 0-based position of the row in ``order`` within its ``by`` group.

    ``by`` must be low-cardinality (languages, splits); ``order`` should be unique
    within a group for a reproducible result.
    """
    by = list(by or [])
    src = df if by else df.withColumn("__all", F.lit(0))
    g = _group_cols(by)
    part = _range_parts(src, g, order, num_partitions)
    stats = part.groupBy("__pid", *g).agg(F.count("*").alias("__n"),
                                          F.min("__local").alias("__first"))
    w = Window.partitionBy(*g).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stats.select("__pid", *g, "__first",
                           F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__off"))
    out = part.join(F.broadcast(offsets), ["__pid", *g])
    out = out.withColumn(name, F.col("__off") + F.col("__local") - F.col("__first"))
    drop = ["__pid", "__local", "__first", "__off"] + ([] if by else ["__all"])
    return out.drop(*drop)


def with_row_order(df: DataFrame, name: str = "row_no") -> DataFrame:
    """``name`` = place of each row as ``df`` delivers them, partition after partition: a
    witness of the order of a sorted result."""
    return with_global_index(df.withColumn("__at", F.monotonically_increasing_id()), ["__at"], None, name).drop("__at")


def with_running_sum(df: DataFrame, order: list[str], weight: str, by: list[str] | None = None,
                     name: str = "start", num_partitions: int | None = None) -> DataFrame:
    """Exclusive prefix sum of ``weight`` in ``order`` per ``by`` group.

    Offsets across range partitions as in G1; the running sum inside a range
    partition is a window keyed by (partition, group), so no group is larger than
    one range partition.
    """
    by = list(by or [])
    src = df if by else df.withColumn("__all", F.lit(0))
    g = _group_cols(by)
    part = _range_parts(src, g, order, num_partitions)
    stats = part.groupBy("__pid", *g).agg(F.sum(weight).alias("__w"))
    w = Window.partitionBy(*g).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stats.select("__pid", *g, F.coalesce(F.sum("__w").over(w), F.lit(0)).alias("__off"))
    inner = Window.partitionBy("__pid", *g).orderBy("__local").rowsBetween(
        Window.unboundedPreceding, -1)
    local = part.withColumn("__in", F.coalesce(F.sum(weight).over(inner), F.lit(0)))
    out = local.join(F.broadcast(offsets), ["__pid", *g])
    out = out.withColumn(name, (F.col("__off") + F.col("__in")).cast("bigint"))
    drop = ["__pid", "__local", "__off", "__in"] + ([] if by else ["__all"])
    return out.drop(*drop)


def shard_number(idx: Column, docs_per_shard: int = DOCS_PER_SHARD, start: int = 0,
                 reserved: int | None = VAL_SHARD) -> Column:
    """``start + idx div docs_per_shard``; numbers at or past ``reserved`` shift by one."""
    s = F.lit(start) + F.floor(idx / F.lit(docs_per_shard)).cast("bigint")
    if reserved is None:
        return s.cast("int")
    return (s + F.when(s >= reserved, 1).otherwise(0)).cast("int")


def n_validation(n: Column, frac: float = VAL_FRACTION) -> Column:
    """``max(1, int(frac * n))`` for a non-empty group (0 for an empty one)."""
    return F.when(n > 0, F.greatest(F.lit(1), F.floor(n * F.lit(float(frac))))).otherwise(0) \
        .cast("bigint")


def split_key(id_col: Column, seed: int = SPLIT_SEED) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), id_col.cast("string")))


def split_train_val(df: DataFrame, id_col: str, by: list[str] | None = None,
                    seed: int = SPLIT_SEED, frac: float = VAL_FRACTION,
                    name: str = "split") -> DataFrame:
    """Add ``split`` in {'train','val'}; exactly ``n_validation(n)`` val rows per group."""
    by = list(by or [])
    src = df if by else df.withColumn("__all", F.lit(0))
    g = _group_cols(by)
    keyed = src.withColumn("__key", split_key(F.col(id_col), seed)).withColumn(
        "__bucket", F.conv(F.substring("__key", 1, HASH_BUCKET_HEX), 16, 10).cast("int"))
    # ids and keys only, written once: the counts and the boundary bucket don't read the rows again
    narrow = cut_lineage(keyed.select(*g, "__bucket", "__key", F.col(id_col).alias("__id")))
    counts = narrow.groupBy(*g, "__bucket").agg(F.count("*").alias("__c"))
    wg = Window.partitionBy(*g)
    wc = Window.partitionBy(*g).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, 0)
    counts = (counts.withColumn("__n", F.sum("__c").over(wg))
              .withColumn("__cum", F.sum("__c").over(wc)))
    counts = counts.withColumn("__nval", n_validation(F.col("__n"), frac))
    boundary = counts.where((F.col("__cum") - F.col("__c") < F.col("__nval"))
                            & (F.col("__cum") >= F.col("__nval"))).select(
        *g, F.col("__bucket").alias("__bb"), (F.col("__nval") - F.col("__cum") + F.col("__c"))
        .alias("__need"))
    in_bucket = narrow.join(F.broadcast(boundary), g).where(F.col("__bucket") == F.col("__bb"))
    wr = Window.partitionBy(*g).orderBy("__key", "__id")
    thresholds = (in_bucket.withColumn("__r", F.row_number().over(wr))
                  .where(F.col("__r") == F.col("__need"))
                  .select(*g, F.col("__key").alias("__tkey"), F.col("__id").alias("__tid")))
    out = keyed.join(F.broadcast(thresholds), g, "left")
    is_val = (F.col("__tkey").isNotNull()
              & ((F.col("__key") < F.col("__tkey"))
                 | ((F.col("__key") == F.col("__tkey")) & (F.col(id_col) <= F.col("__tid")))))
    out = out.withColumn(name, F.when(is_val, "val").otherwise("train"))
    drop = ["__key", "__bucket", "__tkey", "__tid"] + ([] if by else ["__all"])
    return out.drop(*drop)


def head(df: DataFrame, n: int, order: list[str], by: list[str] | None = None,
         num_partitions: int | None = None) -> DataFrame:
    """L1: the first ``n`` rows per group in ``order`` (``n <= 0`` keeps all)."""
    if n <= 0:
        return df
    return with_global_index(df, order, by, "__h", num_partitions).where(
        F.col("__h") < n).drop("__h")
