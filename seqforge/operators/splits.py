"""Splits and sampling.

The reference uses Python/numpy generators; no distributed job can replay
them.  Our rule: rows are ordered by ``md5('<seed>:<key>')`` — deterministic,
independent of partitioning, and the same in DuckDB.  Sizes and guarantees
match the reference exactly; row identity follows the hash order.

Every per-class / per-group rank goes through ``prefix_rank`` (bucketed),
never through a window holding a whole class.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqforge.functions.scalar import parse_label
from seqforge.operators.corpus import window_starts
from seqforge.operators.ranking import hash_key, prefix_rank, running


def uniform(seed, *parts) -> Column:
    """Hash-uniform in [0, 1): 52 bits of ``md5('<seed>:<parts…>')``."""
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts]))
    return F.conv(F.substr(h, F.lit(1), F.lit(13)), 16, 10).cast("double") / float(1 << 52)


def _ranked(df, part_cols, key_cols, seed, rank_col="_rank", total_col="_n"):
    d = df.withColumn("_h", hash_key(seed, *key_cols))
    return prefix_rank(d, part_cols, ["_h", *key_cols], rank_col=rank_col, total_col=total_col)


# X1 ------------------------------------------------------------------------
def split_fraction(df: DataFrame, key_cols: list[str], valid: float = 0.15, test: float = 0.15,
                   seed: int = 1234) -> DataFrame:
    """``split`` in {train, valid, test}: ``n_valid = round(n*valid)``,
    ``n_test = round(n*test)`` (half to even), train first, test last.
    Fails when train would be empty."""
    r = _ranked(df, [], key_cols, seed)
    n = F.col("_n")
    nv = (F.bround(n * valid, 0) if valid > 0 else F.lit(0)).cast("long")
    nt = (F.bround(n * test, 0) if test > 0 else F.lit(0)).cast("long")
    ntr = n - nv - nt
    split = (F.when(ntr <= 0, F.raise_error(F.lit("train split would be empty")).cast("string"))
              .when(F.col("_rank") <= ntr, "train")
              .when(F.col("_rank") <= ntr + nv, "valid").otherwise("test"))
    return r.withColumn("split", split).drop("_h", "_rank", "_n")


# X2 ------------------------------------------------------------------------
def split_prefix(df: DataFrame, key_cols: list[str], max_len: int, ratio: float = 0.99,
                 seed: int = 42, mode: str = "grouped", seq_col: str = "sequence") -> DataFrame:
    """Shuffle sequences, window them (T1), cut the window list at
    ``int(n_windows*ratio)``.  ``as_reference``: the cut falls between windows,
    so a sequence can straddle train and test; ``grouped`` (default): a
    sequence goes wholly to the side of its first window."""
    from seqforge.operators.corpus import sequence_windows
    d = df.withColumn("_nw", F.size(window_starts(F.length(seq_col), max_len)))
    r = d.withColumn("_h", hash_key(seed, *key_cols))
    r = prefix_rank(r, [], ["_h", *key_cols], weight="_nw", rank_col="_cum", total_col="_N")
    w = sequence_windows(r.withColumn("_first", F.col("_cum") - F.col("_nw")), max_len, seq_col)
    cut = F.floor(F.col("_N") * ratio)
    pos = F.col("_first") + F.col("k") if mode == "as_reference" else F.col("_first")
    if mode not in ("as_reference", "grouped"):
        raise ValueError(mode)
    return (w.withColumn("split", F.when(pos < cut, "train").otherwise("test"))
             .drop("_h", "_nw", "_cum", "_N", "_first"))


# X3 ------------------------------------------------------------------------
def split_stratified(df: DataFrame, label: str, key_cols: list[str], test: float = 0.2,
                     seed: int = 42) -> DataFrame:
    """Holdout keeping class shares: per class ``round(n_class*test)`` rows
    (half to even) go to test."""
    r = _ranked(df, [label], key_cols, seed)
    nt = F.bround(F.col("_n") * test, 0)
    return r.withColumn("split", F.when(F.col("_rank") <= nt, "test").otherwise("train")) \
            .drop("_h", "_rank", "_n")


def _with_class_counts(df: DataFrame, label: str) -> DataFrame:
    """Small per-class table (label, _n) with class-level scalars added by a
    window over that small table only."""
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))


# X4 ------------------------------------------------------------------------
def balance_downsample(df: DataFrame, label: str, key_cols: list[str], seed: int = 42) -> DataFrame:
    """Every class sampled down to the smallest class size."""
    least = _with_class_counts(df.filter(F.col(label).isNotNull()), label).agg(F.min("_n").alias("_min"))
    r = _ranked(df.filter(F.col(label).isNotNull()), [label], key_cols, seed)
    return r.filter(F.col("_rank") <= least.scalar()).drop("_h", "_rank", "_n")


# X5 ------------------------------------------------------------------------
def stratified_kfold(df: DataFrame, label: str, key_cols: list[str], k: int = 5,
                     seed: int = 42, required: list[str] | None = None) -> DataFrame:
    """``fold`` in 1..k, per-class fold sizes differ by at most one.  Labels
    must be 0/1 (checked at run time); required columns checked eagerly."""
    missing = [c for c in (required or []) if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns {missing}")
    lab = parse_label(F.col(label), "strict01")
    checked = df.withColumn("_lab", F.when(lab.isNull(), F.raise_error(
        F.concat(F.lit("label outside {0,1}: "), F.col(label).cast("string")))).otherwise(lab))
    r = _ranked(checked, ["_lab"], key_cols, seed)
    return (r.withColumn("fold", (F.pmod(F.col("_rank") - 1, F.lit(k)) + 1).cast("int"))
             .drop("_h", "_rank", "_n", "_lab"))


def fold_summary(folds: DataFrame, label: str, k: int = 5) -> DataFrame:
    """Per fold and class: test size (rows in the fold) and train size (rows
    of the class outside it) — aggregates only, no row is repeated."""
    per = folds.groupBy("fold", label).agg(F.count(F.lit(1)).alias("n_test"))
    tot = per.groupBy(label).agg(F.sum("n_test").alias("_tot"))
    return (per.join(tot, label)
               .select("fold", label, "n_test", (F.col("_tot") - F.col("n_test")).alias("n_train")))


# X6 ------------------------------------------------------------------------
def leave_one_group_out(df: DataFrame, group: str, held_out=None) -> DataFrame:
    """Leave-one-group-out.  Without ``held_out``: every row gets
    ``test_fold = group`` (it is test in its own group's fold and train in
    every other fold) — the folds are never materialised as copies.  With a
    ``held_out`` value: ``split`` for that one fold."""
    if held_out is None:
        return df.withColumn("test_fold", F.col(group))
    return df.withColumn("split", F.when(F.col(group) == F.lit(held_out), "test").otherwise("train"))


def leave_one_group_out_summary(df: DataFrame, group: str, label: str) -> DataFrame:
    """Rows and positives of each side for every held-out group, from
    per-group aggregates (total minus the held-out group)."""
    per = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"),
                                F.count_if(F.col(label) == 1).alias("n_pos"))
    n, n_pos = (per.agg(F.sum(c)).scalar() for c in ("n", "n_pos"))
    return per.select(F.col(group).alias("held_out"),
                      F.col("n").alias("n_test"), F.col("n_pos").alias("n_test_pos"),
                      (n - F.col("n")).alias("n_train"), (n_pos - F.col("n_pos")).alias("n_train_pos"))


# X7 ------------------------------------------------------------------------
def split_within_group(df: DataFrame, group: str, key_cols: list[str], test: float = 0.2,
                       seed: int = 22) -> DataFrame:
    """Per group: first ``round(n*(1-test))`` rows in hash order are train."""
    r = _ranked(df, [group], key_cols, seed)
    ntr = F.bround(F.col("_n") * (1 - test), 0)
    return r.withColumn("split", F.when(F.col("_rank") <= ntr, "train").otherwise("test")) \
            .drop("_h", "_rank", "_n")


# X8 ------------------------------------------------------------------------
def tier_groups(df: DataFrame, group: str, label: str, n_min: int = 5,
                n_major: int = 100) -> DataFrame:
    """``(group, n_labeled, tier)`` by labelled rows per group: majority
    (>= n_major), backbone (n_min..n_major-1), zero_shot (1..n_min-1) and
    unlabelled (0; the reference drops these silently)."""
    n = F.count_if(parse_label(F.col(label), "is_labeled"))
    g = df.groupBy(group).agg(n.alias("n_labeled"))
    tier = (F.when(F.col("n_labeled") >= n_major, "majority")
             .when(F.col("n_labeled") >= n_min, "backbone")
             .when(F.col("n_labeled") >= 1, "zero_shot").otherwise("unlabelled"))
    return g.withColumn("tier", tier)


def attach_tiers(df: DataFrame, group: str, label: str, n_min: int = 5, n_major: int = 100):
    return df.join(tier_groups(df, group, label, n_min, n_major), group)


# X9 ------------------------------------------------------------------------
def few_shot_split(df: DataFrame, group: str, label: str, key_cols: list[str], k: int = 2,
                   seed: int = 22) -> DataFrame:
    """Per group: support = ``min(k, n_labelled)`` labelled rows in hash
    order; query = the other labelled rows plus all unlabelled rows."""
    d = df.withColumn("_lab", parse_label(F.col(label), "is_labeled"))
    r = _ranked(d, [group, "_lab"], key_cols, seed)
    return (r.withColumn("split", F.when(F.col("_lab") & (F.col("_rank") <= k), "support")
                                   .otherwise("query"))
             .drop("_h", "_rank", "_n", "_lab"))


# X10 -----------------------------------------------------------------------
def split_val_ratio(df: DataFrame, label: str, key_cols: list[str], ratio: float = 0.15,
                    neg_per_pos: int = 10, seed: int = 22) -> DataFrame:
    """Validation positives ``int(n_pos*ratio)``; validation negatives
    ``min(neg_per_pos*val_pos, n_neg)``; everything else is train."""
    n_pos, n_neg = (df.agg(F.count_if(F.col(label) == k)).scalar() for k in (1, 0))
    vp = F.floor(n_pos * ratio)
    vn = F.least(vp * neg_per_pos, n_neg)
    r = _ranked(df.filter(F.col(label).isNotNull()), [label], key_cols, seed)
    take = F.when(F.col(label) == 1, vp).when(F.col(label) == 0, vn).otherwise(F.lit(0))
    return r.withColumn("split", F.when(F.col("_rank") <= take, "val").otherwise("train")).drop("_h", "_rank", "_n")


# X11 -----------------------------------------------------------------------
def sample_weighted(df: DataFrame, label: str, key_cols: list[str], n: int | None = None,
                    seed: int = 42) -> DataFrame:
    """``n`` draws with replacement, weights ``1/count(class)`` per row, so
    each present class is equally likely and rows within a class are
    uniform.  A draw table ``range(n)`` picks (class, row rank) by hash
    uniforms and is equi-joined to the ranked rows; no row list is collected.
    ``n`` defaults to the number of rows."""
    spark = df.sparkSession
    classes = (df.groupBy(label).agg(F.count(F.lit(1)).alias("_cn"))
                 .withColumn("_ci", F.row_number().over(Window.orderBy(label)) - 1))
    n_classes = classes.count()  # a scalar: the number of classes
    r = _ranked(df, [label], key_cols, seed).drop("_h", "_n")
    total = df.count() if n is None else n  # a scalar: the number of draws
    draws = spark.range(total).withColumnRenamed("id", "draw")
    draws = (draws.withColumn("_ci", F.floor(uniform(seed, F.col("draw"), F.lit(1)) * n_classes))
                  .withColumn("_u2", uniform(seed, F.col("draw"), F.lit(2))))
    picked = (draws.join(classes, "_ci")  # one row per class; broadcast only if that is small
                   .withColumn("_rank", F.floor(F.col("_u2") * F.col("_cn")).cast("long") + 1)
                   .select("draw", label, "_rank"))
    return picked.join(r, [label, "_rank"]).drop("_rank")


#: The heaviest row weighs this many units; any other row above zero at least one.
WEIGHT_UNITS = 1 << 40


def draw_point(seed, total: int, draw: str = "draw") -> Column:
    """A whole number in [0, total), uniform by 112 bits of md5."""
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(draw).cast("string")))

    def part(at):
        return F.conv(F.substr(h, F.lit(at), F.lit(14)), 16, 10).cast("decimal(17,0)")
    wide = part(1) * F.lit(1 << 56).cast("decimal(17,0)") + part(15)
    return (wide % F.lit(total).cast("decimal(38,0)")).cast("decimal(38,0)")


def sample_by_weight(df: DataFrame, weight: str, key_cols: list[str], n: int | None = None, seed: int = 42) -> DataFrame:
    """``n`` draws with replacement (as many as rows by default); a row is
    drawn with a chance in proportion to its ``weight``.  Returns ``draw`` and
    the columns of the row.

    Rows lie side by side on a line, in hash order, each as long as its
    weight (running sums in range buckets); a draw is a point on the line
    and gets the last row that begins at or before it: rows and points
    are ordered together, and the running maximum of the rows' beginnings (range
    buckets again) passes each point its row.  No row is broadcast, and neither a heavy row
    nor many light ones gather anywhere.

    Weights are doubles, kept to 2^-40 of the largest (and never rounded to
    zero); a weight of zero or null is never drawn, a negative or infinite one
    or NaN is an error.  Without any weight above zero there are no draws.
    ``key_cols`` fix the order, rows that repeat a key stay rows of their own.
    """
    spark = df.sparkSession
    w = F.coalesce(F.col(weight).cast("double"), F.lit(0.0))
    w = F.when((w >= 0) & (w < float("inf")), w).otherwise(F.raise_error(F.lit("weights must be finite and not negative")))
    most, rows = df.agg(F.max(w), F.count(F.lit(1))).first()  # two scalars
    cols = df.columns
    if not most:
        return df.limit(0).select(F.lit(0).cast("long").alias("draw"), *cols)
    units = F.ceil(w * (WEIGHT_UNITS / most)).cast("decimal(20,0)")
    d = df.select(F.struct(*cols).alias("_row"), units.alias("_u"), hash_key(seed, *key_cols).alias("_h"),
                  *[F.col(k).alias(f"_k{i}") for i, k in enumerate(key_cols)]).filter("_u > 0")
    line = running(d, [], ["_h", *[f"_k{i}" for i in range(len(key_cols))]], sums=("_u",))
    begin = (F.col("cum__u") - F.col("_u")).cast("decimal(38,0)")
    total = int(d.agg(F.sum("_u")).first()[0])  # a scalar
    points = spark.range(rows if n is None else n).select(F.col("id").alias("draw")).withColumn("_at", draw_point(seed, total))
    there = line.select(F.lit(-1).cast("long").alias("draw"), begin.alias("_at"),
                        F.struct(begin.alias("begin"), F.col("_row").alias("row")).alias("_from"))
    both = there.unionByName(points, allowMissingColumns=True)
    drawn = running(both, [], ["_at", "draw"], maxes=("_from",)).filter("draw >= 0")
    return drawn.select("draw", *[F.col(f"runmax__from.row.{c}").alias(c) for c in cols])


# X12 -----------------------------------------------------------------------
def shard_evenly(df: DataFrame, key_cols: list[str], shards: int, epoch: int = 0,
                 seed: int = 42) -> DataFrame:
    """Per-epoch shuffle into ``shards`` equal shards; the list is padded to
    a multiple of ``shards`` by repeating its first rows; row i of the
    padded list goes to shard ``i % shards``."""
    d = df.withColumn("_h", hash_key(f"{seed}:{epoch}", *key_cols))
    r = prefix_rank(d, [], ["_h", *key_cols], rank_col="_rank", total_col="_n")
    r = r.withColumn("pos", F.col("_rank") - 1)
    pad = (F.ceil(F.col("_n") / shards) * shards) - F.col("_n")
    extra = r.filter(F.col("pos") < pad).withColumn("pos", F.col("pos") + F.col("_n"))
    both = r.unionByName(extra)
    return both.withColumn("shard", F.pmod(F.col("pos"), F.lit(shards)).cast("int")) \
               .drop("_h", "_rank", "_n")


# X13 -----------------------------------------------------------------------
def shuffle(df: DataFrame, key_cols: list[str], seed: int = 42) -> DataFrame:
    """Reproducible full shuffle: ``shuffle_rank`` (1-based) and rows sorted
    by it (a range-partitioned distributed sort)."""
    d = df.withColumn("_h", hash_key(seed, *key_cols))
    r = prefix_rank(d, [], ["_h", *key_cols], rank_col="shuffle_rank", total_col=None)
    return r.drop("_h").orderBy("shuffle_rank")


# X14 -----------------------------------------------------------------------
def split_overlap(df: DataFrame, key_cols: list[str], split_col: str = "split") -> DataFrame:
    """Keys present in more than one split, with the sorted split names.
    The per-key set is bounded by the number of splits."""
    return (df.groupBy(*key_cols).agg(F.sort_array(F.collect_set(split_col)).alias("_s"))
              .filter(F.size("_s") > 1)
              .select(*key_cols, F.array_join("_s", ",").alias("splits"),
                      F.size("_s").alias("n_splits")))


# X15 -----------------------------------------------------------------------
def take_first(df: DataFrame, order_cols: list[str], n: int = 100) -> DataFrame:
    """First ``n`` rows in an explicit order (top-k: each task keeps its
    own n best, the driver merges at most tasks x n rows)."""
    return df.orderBy(*order_cols).limit(n)
