"""Distributed ranks and prefix sums.

A plain ``row_number() over (partition by label order by key)`` puts a whole
class into one task; a global one puts everything into one task.  Here the
order key is cut into order-preserving buckets (the leading hex digits of an
md5 key, or any coarser column the caller gives).  Per-bucket totals form a
small table (groups x buckets rows); their running sums give each bucket's
offset, and the final window is partitioned by ``(group, bucket)``, so every
task holds about ``rows / buckets`` rows whatever the group sizes are.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqforge.session import ensure_checkpoint_dir


def hash_key(seed, *cols) -> Column:
    """Deterministic shuffle key: ``md5('<seed>:<col1>:<col2>…')`` (hex).
    Independent of partitioning; DuckDB computes the same string."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols]))


def hash_key_sql(seed, *cols) -> str:
    inner = ", ".join([f"'{seed}'"] + [f"CAST({c} AS VARCHAR)" for c in cols])
    return f"md5(concat_ws(':', {inner}))"


def prefix_rank(df: DataFrame, part_cols: list[str], order_cols: list[str], *,
                bucket: Column | None = None, weight: str | None = None,
                rank_col: str = "_rank", total_col: str | None = "_total",
                hex_digits: int = 3) -> DataFrame:
    """Adds ``rank_col``: 1-based position of the row in ``order_cols`` order
    within ``part_cols`` (with ``weight``: the inclusive running sum of the
    weight instead).  Adds ``total_col``: rows (or weight) of the group.

    ``bucket`` must be non-decreasing in the order; by default it is the
    first ``hex_digits`` characters of the first order column, which must
    then be a hex hash such as ``hash_key``."""
    b = bucket if bucket is not None else F.substr(F.col(order_cols[0]), F.lit(1), F.lit(hex_digits))
    w_val = F.col(weight).cast("long") if weight else F.lit(1).cast("long")
    d = df.withColumn("_bk", b).withColumn("_wt", w_val)
    per_bucket = d.groupBy(*part_cols, "_bk").agg(F.sum("_wt").alias("_bn"))
    before = Window.partitionBy(*part_cols).orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)
    offs = per_bucket.withColumn("_off", F.coalesce(F.sum("_bn").over(before), F.lit(0)))
    if total_col:
        offs = offs.withColumn(total_col, F.sum("_bn").over(Window.partitionBy(*part_cols)))
    offs = offs.drop("_bn")
    local = (Window.partitionBy(*part_cols, "_bk").orderBy(*order_cols)
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # null-safe on the group columns: a null label is a group of its own
    offs = offs.select(*[F.col(c).alias(f"_o_{c}") for c in part_cols], "_bk",
                       "_off", *([total_col] if total_col else []))
    cond = [d["_bk"] == offs["_bk"]] + [d[c].eqNullSafe(offs[f"_o_{c}"]) for c in part_cols]
    out = d.join(offs, cond).drop(offs["_bk"]).drop(*[f"_o_{c}" for c in part_cols])
    return (out.withColumn(rank_col, F.col("_off") + F.sum("_wt").over(local))
               .drop("_bk", "_wt", "_off"))


def group_sizes(df: DataFrame, part_cols: list[str], out: str = "_n") -> DataFrame:
    """Attach the row count of each group (aggregate + join; the aggregate
    is map-side combined and the join is broadcast by AQE when small)."""
    return df.join(df.groupBy(*part_cols).agg(F.count(F.lit(1)).alias(out)), part_cols)


def running(df: DataFrame, part_cols: list[str], order: list, *, sums=(), maxes=(),
            inclusive: bool = True, n_buckets: int | None = None) -> DataFrame:
    """Running sums (``cum_<c>``, plus ``<c>_total`` per group) and running
    maxima (``runmax_<c>``) along ``order`` within ``part_cols``.

    The rows are range-partitioned on ``(part_cols, order)``; the partition
    index is then an order-preserving bucket.  Rows and bucket numbers are
    written once to the shared folder: the cut points of a range exchange are
    sampled anew by every plan that holds one, so only stored numbers are the
    same for the totals, the rows and any later attempt.  Bucket aggregates (a
    small table) give each bucket its offset; the final window is per
    ``(group, bucket)``, so no task holds a whole group.  With
    ``inclusive=False`` the current row is left out (a lag-style value)."""
    nb = n_buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order_cols = [F.col(o) if isinstance(o, str) else o for o in order]
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/running-{uuid.uuid4().hex}"
    d = df.repartitionByRange(nb, *part_cols, *order_cols).withColumn("_bk", F.spark_partition_id())
    d.write.parquet(path)
    d = spark.read.schema(d.schema).parquet(path)
    per = d.groupBy(*part_cols, "_bk").agg(
        *[F.sum(c).alias(f"_bs_{c}") for c in sums], *[F.max(c).alias(f"_bm_{c}") for c in maxes])
    before = Window.partitionBy(*part_cols).orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*part_cols)
    offs = per.select(*[F.col(c).alias(f"_o_{c}") for c in part_cols], F.col("_bk").alias("_obk"),
                      *[F.sum(f"_bs_{c}").over(before).alias(f"_os_{c}") for c in sums],
                      *[F.max(f"_bm_{c}").over(before).alias(f"_om_{c}") for c in maxes],
                      *[F.sum(f"_bs_{c}").over(whole).alias(f"{c}_total") for c in sums])
    cond = [d["_bk"] == offs["_obk"]] + [d[c].eqNullSafe(offs[f"_o_{c}"]) for c in part_cols]
    j = d.join(offs, cond).drop("_obk", *[f"_o_{c}" for c in part_cols])
    end = Window.currentRow if inclusive else -1
    local = (Window.partitionBy(*part_cols, "_bk").orderBy(*order_cols)
             .rowsBetween(Window.unboundedPreceding, end))
    for c in sums:
        j = j.withColumn(f"cum_{c}", F.coalesce(F.col(f"_os_{c}"), F.lit(0)) +
                         F.coalesce(F.sum(c).over(local), F.lit(0)))
    for c in maxes:
        j = j.withColumn(f"runmax_{c}", F.greatest(F.col(f"_om_{c}"), F.max(c).over(local)))
    return j.drop("_bk", *[f"_os_{c}" for c in sums], *[f"_om_{c}" for c in maxes])
