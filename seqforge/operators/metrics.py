"""Evaluation (G1-G24): confusion counts, class metrics, ranking metrics,
fold reports, masked-token metrics, regression metrics, losses, training
logs.  All are grouped aggregations; the curve metrics first collapse rows
to distinct scores, then take running sums with ``ranking.running`` (range
buckets), so a fold of any size is spread over many tasks.
"""

from __future__ import annotations

import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from seqforge.functions.scalar import strip

from seqforge.functions.alphabet import IGNORE_INDEX, RESIDUES
from seqforge.operators.ranking import running
from seqforge.session import ensure_checkpoint_dir

def _nan() -> Column:
    return F.lit(float("nan"))


def _div0(a: Column, b: Column) -> Column:
    """a / b, 0 when b is 0 (the reference's zero_division=0)."""
    return F.when(b != 0, a.cast("double") / b).otherwise(F.lit(0.0))


# G1 ------------------------------------------------------------------------
def label_summary(df: DataFrame, label: str, by: list[str] | None = None) -> DataFrame:
    """n_pos, n_neg, n (labelled), positive rate (0 when empty) and the
    number of labels that are not 0/1, from text or numeric labels."""
    s = F.lower(strip(F.col(label).cast("string")))
    n_pos = F.count_if(s == "1")
    n_neg = F.count_if(s == "0")
    return (df.groupBy(*(by or [])).agg(n_pos.alias("n_pos"), n_neg.alias("n_neg"),
                                         F.count_if(~s.isin("0", "1") | s.isNull()).alias("n_other"))
              .withColumn("n", F.col("n_pos") + F.col("n_neg"))
              .withColumn("pos_rate", _div0(F.col("n_pos"), F.col("n"))))


# G2 ------------------------------------------------------------------------
def group_counts(df: DataFrame, by: list[str], distinct: str | None = None) -> DataFrame:
    """Rows per group, and optionally distinct values of a column per group."""
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    if distinct:
        aggs.append(F.count_distinct(distinct).alias(f"n_{distinct}"))
    return df.groupBy(*by).agg(*aggs)


# G3 ------------------------------------------------------------------------
def confusion(df: DataFrame, by: list[str], y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """tn, fp, fn, tp and the predicted / true class counts per group."""
    t, p = F.col(y_true), F.col(y_pred)
    return df.groupBy(*by).agg(
        F.count_if((t == 0) & (p == 0)).alias("tn"), F.count_if((t == 0) & (p == 1)).alias("fp"),
        F.count_if((t == 1) & (p == 0)).alias("fn"), F.count_if((t == 1) & (p == 1)).alias("tp"),
        F.count_if(p == 0).alias("pred_0"), F.count_if(p == 1).alias("pred_1"),
        F.count_if(t == 0).alias("true_0"), F.count_if(t == 1).alias("true_1"))


# G4 ------------------------------------------------------------------------
def class_metrics(conf: DataFrame, eps: float | None = None) -> DataFrame:
    """accuracy, precision, recall, f1, sensitivity, specificity, mcc from
    the G3 counts.  Zero divisions give 0; with ``eps`` every denominator
    gets ``+eps`` instead (the pair trainer's variant).  Counts are cast to
    double before the four-way MCC product (no long overflow)."""
    tn, fp, fn, tp = (F.col(c).cast("double") for c in ("tn", "fp", "fn", "tp"))

    def div(a, b):
        return a / (b + eps) if eps is not None else _div0(a, b)

    prec = div(tp, tp + fp)
    rec = div(tp, tp + fn)
    spec = div(tn, tn + fp)
    f1 = div(2 * tp, 2 * tp + fp + fn)
    mcc_den = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    mcc = div(tp * tn - fp * fn, mcc_den)
    return conf.select("*", div(tp + tn, tp + tn + fp + fn).alias("accuracy"), prec.alias("precision"),
                       rec.alias("recall"), f1.alias("f1"), rec.alias("sensitivity"),
                       spec.alias("specificity"), mcc.alias("mcc"))


# G5-G7 ---------------------------------------------------------------------
def score_curve(df: DataFrame, by: list[str], y_true: str = "y_true",
                y_score: str = "y_prob") -> DataFrame:
    """One row per group and distinct score, thresholds descending, with
    ``pos``/``neg`` at that score, inclusive running counts
    ``cum_pos``/``cum_neg`` and group totals ``pos_total``/``neg_total``."""
    g = df.groupBy(*by, y_score).agg(F.count_if(F.col(y_true) == 1).alias("pos"),
                                     F.count_if(F.col(y_true) == 0).alias("neg"))
    return running(g, by, [F.col(y_score).desc()], sums=("pos", "neg"))


def curve_metrics(df: DataFrame, by: list[str], y_true: str = "y_true",
                  y_score: str = "y_prob") -> DataFrame:
    """Per group: ``roc_auc`` (trapezoid over ROC; ties count half),
    ``pr_auc`` (trapezoid over the PR curve anchored at recall 0 /
    precision 1) and ``average_precision`` (step-wise sum of dR * P).
    NaN when a class is missing.  Each distinct score contributes one term
    computed from its own running counts, so no lag window is needed."""
    c = score_curve(df, by, y_true, y_score)
    P = F.col("pos_total").cast("double")
    N = F.col("neg_total").cast("double")
    tp, fp = F.col("cum_pos").cast("double"), F.col("cum_neg").cast("double")
    tp0, fp0 = tp - F.col("pos"), fp - F.col("neg")
    prec = tp / (tp + fp)
    prec0 = F.when(tp0 + fp0 > 0, tp0 / (tp0 + fp0)).otherwise(F.lit(1.0))
    dr = F.try_divide(F.col("pos"), P)  # a missing class gives null terms, then NaN below
    terms = c.select(*by, "pos_total", "neg_total",
                     F.try_divide(F.try_divide(F.col("neg"), N) * (tp + tp0), 2 * P).alias("_auc"),
                     (dr * (prec + prec0) / 2).alias("_pr"), (dr * prec).alias("_ap"))
    ok = (F.first("pos_total") > 0) & (F.first("neg_total") > 0)
    return terms.groupBy(*by).agg(
        F.when(ok, F.sum("_auc")).otherwise(_nan()).alias("roc_auc"),
        F.when(ok, F.sum("_pr")).otherwise(_nan()).alias("pr_auc"),
        F.when(ok, F.sum("_ap")).otherwise(_nan()).alias("average_precision"))


def evaluate(df: DataFrame, by: list[str], thr: float = 0.5, y_true: str = "y_true",
             y_prob: str = "y_prob", eps: float | None = None) -> DataFrame:
    """All fold-level classification metrics: G3 + G4 + G5-G7."""
    from seqforge.functions.scalar import binarize
    d = df.withColumn("y_pred", binarize(y_prob, thr))
    cm = class_metrics(confusion(d, by, y_true, "y_pred"), eps)
    return cm.join(curve_metrics(d, by, y_true, y_prob), by)


# G8 ------------------------------------------------------------------------
def fold_report(metrics: DataFrame, fold_col: str, value_cols: list[str], ddof: int = 1,
                sd_label: str | None = "sd", fold_prefix: str = "") -> DataFrame:
    """Per-fold rows plus an ``avg`` row and (unless ``sd_label`` is None)
    an sd row: sample sd for ``ddof=1``, population sd for ``ddof=0``, 0 for
    a single fold.  ``fold`` becomes text (``fold1``… with a prefix)."""
    rows = metrics.select(F.concat(F.lit(fold_prefix), F.col(fold_col).cast("string")).alias("fold"),
                          *[F.col(c).cast("double").alias(c) for c in value_cols])
    avg = metrics.agg(*[F.avg(c).alias(c) for c in value_cols]).select(F.lit("avg").alias("fold"), *value_cols)
    out = rows.unionByName(avg)
    if sd_label is not None:
        sd = F.stddev_samp if ddof == 1 else F.stddev_pop
        sdr = metrics.agg(*[F.when(F.count(F.lit(1)) > 1, sd(c)).otherwise(F.lit(0.0)).alias(c)
                            for c in value_cols]).select(F.lit(sd_label).alias("fold"), *value_cols)
        out = out.unionByName(sdr)
    return out


# G9 ------------------------------------------------------------------------
def ensemble_folds(df: DataFrame, example_cols: list[str], thr: float = 0.5,
                   fold_col: str = "fold", y_true: str = "y_true", y_prob: str = "y_prob") -> DataFrame:
    """Mean probability per example over folds, binarized, then scored as
    one group (``fold = 'ensemble'``)."""
    avg = df.groupBy(*example_cols).agg(F.avg(y_prob).alias(y_prob), F.first(y_true).alias(y_true))
    return evaluate(avg.withColumn(fold_col, F.lit("ensemble")), [fold_col], thr, y_true, y_prob)


# G10 -----------------------------------------------------------------------
def mean_fold_counts(metrics: DataFrame, value_cols: list[str]) -> DataFrame:
    """Mean of every metric and count over folds (the per-task "average")."""
    return metrics.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in value_cols])


# G11 -----------------------------------------------------------------------
def _beaters(scores: Column, idx: Column) -> Column:
    """Number of entries that sort after entry ``idx`` in an ascending
    (score, index) order: higher score, or equal score and higher index."""
    s_t = F.element_at(scores, idx + 1)
    return F.size(F.filter(scores, lambda x, i: (x > s_t) | ((x == s_t) & (i > idx))))


def argmax_index(scores: Column) -> Column:
    """0-based index of the largest score; ties go to the highest index
    (the last entry of an ascending argsort)."""
    mx = F.array_max(scores)
    return F.size(scores) - F.array_position(F.reverse(scores), mx)


def _letter_scores(submat: DataFrame, letters: list[str], a: str, b: str, out: str) -> DataFrame:
    """The scores of pairs of ``letters``, one row per pair (the largest, should
    a pair be listed twice): at most ``len(letters) ** 2`` rows, whatever table
    the caller gives."""
    known = submat.filter(F.col("aa1").isin(letters) & F.col("aa2").isin(letters))
    return known.groupBy(F.col("aa1").alias(a), F.col("aa2").alias(b)).agg(F.max("score").alias(out))


def masked_topn(df: DataFrame, submat: DataFrame | None, n: int = 3, scores: str = "scores",
                truth: str = "truth", tokens: list[str] | None = None) -> DataFrame:
    """Over positions whose label is not -100: top-1 and top-n accuracy and
    the mean substitution score of (truth, top-1) where both ids decode to
    residues.  Zeros when nothing is scored.  ``submat``: (aa1, aa2, score),
    a table bounded by the alphabet (broadcast)."""
    toks = tokens or list(RESIDUES)
    d = (df.filter(F.col(truth) != IGNORE_INDEX)
           .withColumn("_b", _beaters(F.col(scores), F.col(truth)))
           .withColumn("_top1", argmax_index(F.col(scores))))
    tok_map = F.create_map(*[x for i, t in enumerate(toks) for x in (F.lit(i), F.lit(t))])
    d = d.withColumn("_ta", F.try_element_at(tok_map, F.col(truth))) \
         .withColumn("_pa", F.try_element_at(tok_map, F.col("_top1")))
    if submat is not None:
        d = d.join(F.broadcast(_letter_scores(submat, toks, "_ta", "_pa", "_sub")), ["_ta", "_pa"], "left")
    else:
        d = d.withColumn("_sub", F.lit(None).cast("double"))
    agg = d.agg(F.count(F.lit(1)).alias("n_scored"), F.count_if(F.col("_b") == 0).alias("_c1"),
                F.count_if(F.col("_b") < n).alias("_cn"), F.avg("_sub").alias("_bl"))
    return agg.select("n_scored",
                      _div0(F.col("_c1"), F.col("n_scored")).alias("top1_acc"),
                      _div0(F.col("_cn"), F.col("n_scored")).alias(f"top{n}_acc"),
                      F.coalesce(F.col("_bl"), F.lit(0.0)).cast("double").alias("mean_substitution"))


# G12 -----------------------------------------------------------------------
def position_accuracy(df: DataFrame, scores: str = "scores", truth: str = "truth",
                      ignore: tuple = (21, IGNORE_INDEX)) -> DataFrame:
    """Argmax accuracy over all positions, and the count variant: correct
    predictions and scored positions with the ``ignore`` labels left out of
    both (a label of 21 counts as not scored)."""
    am = argmax_index(F.col(scores))
    t = F.col(truth)
    scored = ~t.isin(*ignore)
    return df.agg(_div0(F.count_if(am == t), F.count(F.lit(1))).alias("accuracy"),
                  F.count_if(scored & (am == t)).alias("n_correct"),
                  F.count_if(scored).alias("n_scored"))


# G13 -----------------------------------------------------------------------
def string_identity(df: DataFrame, submat: DataFrame | None, pred: str = "pred",
                    label: str = "label") -> DataFrame:
    """Decoded prediction vs label with blanks removed: matches over the
    common prefix divided by the total label length, and the mean
    substitution score over the compared positions (residue pairs only).
    One row per label position; a single aggregation gives all three."""
    d = df.select(F.split(F.replace(F.col(pred), F.lit(" "), F.lit("")), "").alias("_p"),
                  F.replace(F.col(label), F.lit(" "), F.lit("")).alias("_l"))
    pos = (d.filter(F.length("_l") > 0)
            .select("_p", F.posexplode(F.split("_l", "")).alias("_i", "la"))
            .withColumn("pa", F.try_element_at(F.col("_p"), F.col("_i") + 1))
            .withColumn("pa", F.when(F.col("pa") != "", F.col("pa"))))
    if submat is not None:
        pos = pos.join(F.broadcast(_letter_scores(submat, list(RESIDUES), "la", "pa", "_s")), ["la", "pa"], "left")
    else:
        pos = pos.withColumn("_s", F.lit(None).cast("double"))
    m = pos.agg(F.count_if(F.col("pa") == F.col("la")).alias("matches"),
                F.count(F.lit(1)).alias("total"), F.avg("_s").alias("mean_substitution"))
    return m.select("matches", "total", _div0(F.col("matches"), F.col("total")).alias("identity"),
                    F.col("mean_substitution").cast("double").alias("mean_substitution"))


# G14 -----------------------------------------------------------------------
def rounded_metrics(df: DataFrame, by: list[str], y_true: str = "y_true", y_prob: str = "y_prob") -> DataFrame:
    """Accuracy and recall after rounding the scores half to even."""
    r = F.bround(F.col(y_prob), 0)
    t = F.col(y_true)
    return df.groupBy(*by).agg(
        _div0(F.count_if(r == t), F.count(F.lit(1))).alias("accuracy"),
        _div0(F.count_if((r == 1) & (t == 1)), F.count_if(t == 1)).alias("recall"))


# G15 -----------------------------------------------------------------------
def regression_metrics(df: DataFrame, by: list[str], y: str = "y", p: str = "p",
                       eps: float = 1e-12, exact_scale: int | None = None) -> DataFrame:
    """MSE; r2 (squared correlation); r0^2 through the origin with ``eps``;
    rm2 = r2 * (1 - sqrt(|r2^2 - r0^2^2|)); Pearson.  One aggregation pass."""
    Y, P = F.col(y).cast("double"), F.col(p).cast("double")
    if exact_scale is not None:
        # inputs with at most ``exact_scale`` decimals: squared errors summed
        # as decimals are exact, so the MSE does not depend on how rows are
        # split over tasks (float sums do)
        dt = f"decimal(18,{exact_scale})"
        e = F.col(p).cast(dt) - F.col(y).cast(dt)
        mse = F.sum(e * e).cast("double") / F.count(F.lit(1))
    else:
        mse = F.avg((P - Y) * (P - Y))
    a = df.groupBy(*by).agg(mse.alias("mse"), F.corr(P, Y).alias("pearson"),
                            F.sum(P * Y).alias("_spy"), F.sum(P * P).alias("_spp"),
                            F.sum(Y * Y).alias("_syy"), F.sum(Y).alias("_sy"), F.sum(P).alias("_sp"),
                            F.count(F.lit(1)).alias("_n"))
    beta = F.col("_spy") / (F.col("_spp") + eps)
    # SSE of y - beta*p expanded into the sums above
    sse = F.col("_syy") - 2 * beta * F.col("_spy") + beta * beta * F.col("_spp")
    r0 = 1 - sse / (F.col("_syy") + eps)
    r2 = F.col("pearson") * F.col("pearson")
    return a.select(*by, "mse", r2.alias("r2"), r0.alias("r0_2"),
                    (r2 * (1 - F.sqrt(F.abs(r2 * r2 - r0 * r0)))).alias("rm2"), "pearson")


# G16 -----------------------------------------------------------------------
def average_ranks(df: DataFrame, by: list[str], col: str, out: str) -> DataFrame:
    """Average rank (1-based, ties share the mean) of ``col`` within ``by``:
    distinct values with counts, running counts (range-bucketed), joined
    back on the value."""
    g = df.groupBy(*by, col).agg(F.count(F.lit(1)).alias("_c"))
    r = running(g, by, [F.col(col)], sums=("_c",))
    r = r.select(*by, col, (F.col("cum__c") - (F.col("_c") - 1) / 2.0).alias(out))
    return df.join(r, [*by, col])


def spearman(df: DataFrame, by: list[str], y: str = "y", p: str = "p") -> DataFrame:
    """Pearson correlation of the average ranks."""
    r = average_ranks(average_ranks(df, by, y, "_ry"), by, p, "_rp")
    return r.groupBy(*by).agg(F.corr("_ry", "_rp").alias("spearman"))


# G17 -----------------------------------------------------------------------
#: Different (y, p) of a range of y or p, about.
RANGE_ROWS = 1 << 18


def _ranged(df: DataFrame, n: int, by: list[str], order: list, out: str) -> DataFrame:
    """``df`` with the number of its range along ``order``, ``n`` at most, stored
    (a range exchange samples its cut points anew in every plan)."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/ranges-{uuid.uuid4().hex}"
    d = df.repartitionByRange(n, *by, *order).withColumn(out, F.spark_partition_id())
    d.write.parquet(path)
    return spark.read.schema(d.schema).parquet(path)


def c_index(df: DataFrame, by: list[str], y: str = "y", p: str = "p") -> DataFrame:
    """Concordance index over all pairs with ``Y[i] > Y[j]``: 1 when
    ``P[i] > P[j]``, 1/2 when equal, divided by the number of such pairs (0
    when there are none).  Exact, and no pair is ever formed:

    * rows are counted per (y, p) first.  The pairs are those of all rows less
      those of equal y; the ties in p are those of equal p less those of equal
      (y, p);
    * concordant pairs have a smaller y and a smaller p at j.  Rows lie in
      ranges along (p, y falling) and along (y, p falling), so that an earlier
      range never holds a pair that must not count.  Pairs in one range of p
      are counted there (see :func:`dominated`), the others in one range of y
      there, by the rows per (y, range of p), and the rest by the
      rows per cell of ranges.  So a row is sent twice, whatever its values, and
      no task holds more than a range.

    ``c_index_ordered`` is the form that depends on the order of the rows."""
    d = df.select(*by, F.col(y).alias("_y"), F.col(p).alias("_p")).filter(
        F.col("_y").isNotNull() & F.col("_p").isNotNull())
    d = d.groupBy(*by, "_y", "_p").agg(F.count(F.lit(1)).alias("_c"))
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/counted-{uuid.uuid4().hex}"
    d.write.parquet(path)
    d = spark.read.schema(d.schema).parquet(path)
    n = max(n, -(-d.count() // RANGE_ROWS))
    d = _ranged(d, n, by, [F.col("_p"), F.desc("_y")], "_rp")
    d = _ranged(d, n, by, [F.col("_y"), F.desc("_p")], "_ry")

    def count(pdf, a, b):
        out = pdf[by].iloc[:1].copy()
        # numbers in place of values: equal ones are equal whatever their type, NaN the largest
        a, b = (np.unique(pdf[c].to_numpy(), return_inverse=True)[1] for c in (a, b))
        out["_conc"] = dominated(a, b, None, pdf["_c"].to_numpy(np.int64))
        return out

    schema = T.StructType([*[df.schema[c] for c in by], T.StructField("_conc", T.LongType())])
    cells = d.groupBy(*by, "_ry", "_rp").agg(F.sum("_c").alias("_c"))
    per_y = d.groupBy(*by, "_ry", "_y", "_rp").agg(F.sum("_c").alias("_c"))
    strict = d.select(*by, "_rp", "_y", "_p", "_c").groupBy(*by, "_rp").applyInPandas(lambda pdf: count(pdf, "_y", "_p"), schema) \
        .unionByName(per_y.groupBy(*by, "_ry").applyInPandas(lambda pdf: count(pdf, "_y", "_rp"), schema)) \
        .unionByName(cells.groupBy(*by).applyInPandas(lambda pdf: count(pdf, "_ry", "_rp"), schema))
    strict = strict.groupBy(*by).agg(F.sum("_conc").alias("_conc"))

    def square(c):
        return c.cast("decimal(18,0)") * c.cast("decimal(18,0)")
    both = d.groupBy(*by).agg(F.sum("_c").alias("_n"), F.sum(square(F.col("_c"))).alias("_same"))
    same = [d.groupBy(*by, c).agg(F.sum("_c").alias("_k")).groupBy(*by).agg(F.sum(square(F.col("_k"))).alias(f"_same{c}")) for c in ("_y", "_p")]
    out = reduce(lambda left, right: left.join(right.withColumnsRenamed({c: f"_on_{c}" for c in by}), F.lit(True) if not by else
                                               [F.col(c).eqNullSafe(F.col(f"_on_{c}")) for c in by]).drop(*[f"_on_{c}" for c in by]), [both, *same, strict])
    out = out.select(*by, ((square(F.col("_n")) - F.col("_same_y")) / 2).cast("long").alias("n_pairs"),
                     ((F.col("_same_p") - F.col("_same")) / 2).cast("double").alias("_ties"), F.col("_conc").cast("double").alias("_conc"))
    return out.select(*by, "n_pairs", F.when(F.col("n_pairs") > 0, (F.col("_conc") + 0.5 * F.col("_ties")) / F.col("n_pairs"))
                      .otherwise(F.lit(0.0)).alias("c_index"))


#: Ranges of an order, at least if they have BLOCK_ROWS rows, and rows of one beyond that, about.
BLOCKS, BLOCK_ROWS, MOST_ROWS = 64, 1 << 14, 1 << 19
#: Keys of up to 2 ** SMALL rows are not split.
SMALL = 6


def _inside(key: np.ndarray, zero: np.ndarray, one: np.ndarray) -> int:
    """Sum over rows of ``one`` times the ``zero`` of earlier rows of the same
    key; ``key`` does not fall."""
    before = np.cumsum(zero) - zero
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    start = np.repeat(before[first], np.diff(np.append(first, len(key))))
    return int(((before - start) * one).sum())


def _refined(key: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """The order of rows that splits each key by ``bit``, zeros first, and else keeps it."""
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    size = np.diff(np.append(first, len(key)))
    zeros = np.add.reduceat(1 - bit, first)
    seen = np.cumsum(bit) - bit
    ones = seen - np.repeat(seen[first], size)  # earlier ones of the key
    place = np.arange(len(key))
    to = np.where(bit == 1, np.repeat(first + zeros, size) + ones, place - ones)
    order = np.empty(len(key), np.int64)
    order[to] = place
    return order


def dominated(t, y, p, w) -> int:
    """Sum of ``w[i] * w[j]`` over pairs with smaller t, y and p at j; ``p`` may
    be None.  Two ranks first differ at one bit, where the larger one has a 1
    and the higher bits agree: rows are split by the bits of y and, inside, of
    p, and counted along t; no pair is formed."""
    along = np.lexsort((-y, t))
    n, w = len(along), w[along]

    def ranks(x):  # of equal values the later row has the smaller rank, so that they never count
        r = np.empty(n, np.int64)
        r[np.lexsort((-np.arange(n), x[along]))] = np.arange(n)
        return r
    y, found = ranks(y), 0
    if p is None:
        for level in range(int(n).bit_length() - 1, -1, -1):
            high, bit = y >> (level + 1), (y >> level) & 1
            found += _inside(high, w * (1 - bit), w * bit)
            order = _refined(high, bit)
            y, w = y[order], w[order]
        return found
    p = ranks(p)
    for level in range(int(n).bit_length() - 1, SMALL - 1, -1):
        high, bit = y >> (level + 1), (y >> level) & 1
        q = np.empty(n, np.int64)  # ranks of p among the rows of a key: no more bits than there are of y
        at = np.lexsort((p, high))
        q[at] = np.arange(n)
        q -= high << (level + 1)
        key, zero, one = high, w * (1 - bit), w * bit
        for inner in range(level, -1, -1):
            b = (q >> inner) & 1
            found += _inside(key, zero * (1 - b), one * b)
            order = _refined(key, b)
            key, q, zero, one = key[order] * 2 + b[order], q[order], zero[order], one[order]
        order = _refined(high, bit)
        y, w, p = y[order], w[order], p[order]
    key = y >> SMALL
    for back in range(1, min(1 << SMALL, n)):  # keys of few rows: each with the row so far before it
        less = (key[back:] == key[:-back]) & (y[back:] > y[:-back]) & (p[back:] > p[:-back])
        found += int((w[back:][less] * w[:-back][less]).sum())
    return found


def concordant(v: np.ndarray) -> int:
    """Pairs of places i < j with ``v[i] < v[j]``.  Values become ranks (of equal
    ones the later has the smaller) and are split by halves of their range, all
    nodes of a level at once: a node holds every rank of its range, so its size is known."""
    n = len(v)
    size = 1 << max(0, n - 1).bit_length()
    x = np.empty(size, np.int32)
    x[:size - n] = np.arange(size - 1, n - 1, -1)  # larger ones before all others make no pair
    x[size - 1 - np.argsort(v[::-1], kind="stable")] = np.arange(n)
    found, nodes = 0, 1
    while size > 1:
        half = size // 2
        high = x >= half
        low = ~high
        found += int(np.cumsum(low, dtype=np.int32)[high].sum(dtype=np.int64)) - half * half * (nodes * (nodes - 1) // 2)
        x = np.stack((x[low].reshape(nodes, half), x[high].reshape(nodes, half) - half), axis=1).ravel()
        size, nodes = half, 2 * nodes
    return found


def _orderable(col) -> np.ndarray:
    """Numbers in the order of the values, equal for equal ones (NaN the largest)."""
    x = col.to_numpy()
    if x.dtype.kind == "f" and not np.isnan(x).any() or x.dtype.kind == "i" and x.min(initial=0) > np.iinfo(x.dtype).min:
        return x
    return np.unique(x, return_inverse=True)[1]


def _groups_of(t: pa.Table, by: list[str]):
    """Places of the rows of each group."""
    code = np.zeros(len(t), np.int64)
    for c in by:
        x = pa.chunked_array([t.column(c).combine_chunks()]).dictionary_encode(null_encoding="encode").chunk(0)
        if len(x.dictionary) > 1:
            code = np.unique(code * len(x.dictionary) + x.indices.to_numpy(), return_inverse=True)[1]
    order = np.argsort(code, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(code[order])) + 1)


def _pairs_in_order(batches, by: list[str], task, passed):
    """Rows of a range go on with the columns of the schema ``passed``, then come those that ``task``
    makes of each group: a dictionary of columns, others are null."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    t = pa.Table.from_batches(held)
    if passed[1]:
        for b in held:
            yield pa.RecordBatch.from_arrays([b.column(f.name) if f.name in b.schema.names else pa.nulls(b.num_rows, f.type)
                                              for f in passed[0]], schema=passed[0])
    del held
    out = {f.name: [] for f in passed[0]}
    for at in _groups_of(t, by):
        for made in task(t.select([c for c in t.column_names if c not in by]).take(pa.array(at))):
            n = len(made["w"])
            for f in passed[0]:
                out[f.name].append(t.column(f.name).take(pa.array(np.repeat(at[:1], n))).combine_chunks() if f.name in by else
                                   pa.array(made[f.name], f.type) if f.name in made else pa.nulls(n, f.type))
    whole = pa.Table.from_arrays([pa.chunked_array(out[f.name], f.type) for f in passed[0]], schema=passed[0])
    yield from whole.combine_chunks().to_batches()


#: What a row of counts holds: pairs of o and y, other pairs, cells of (T, Y), of (T, p), of (Y, p).
PAIRS, OTHERS, CELLS_TY, CELLS_TP, CELLS_YP = range(5)


def _along_t(t: pa.Table):
    o, y, p = (_orderable(t.column(c)) for c in ("_o", "_y", "_p"))
    order = np.lexsort((p, -y, o))
    yield {"what": [PAIRS, OTHERS], "w": [concordant(y[order]), concordant(p[order])]}


def _along_y(t: pa.Table):
    o, y, p = (_orderable(t.column(c)) for c in ("_o", "_y", "_p"))
    rt, ry = t.column("_rt").to_numpy(), t.column("_ry")[0].as_py()
    yield {"what": [PAIRS, OTHERS], "w": [concordant(y[np.lexsort((-y, rt))]), concordant(p[np.lexsort((-p, -o, y))])]}
    cell, w = np.unique(rt, return_counts=True)
    yield {"what": np.full(len(w), CELLS_TY), "_rt": cell, "_ry": np.full(len(w), ry), "w": w}


def _along_p(t: pa.Table):
    p, k = _orderable(t.column("_p")), t.column("_rp")[0].as_py()
    first, last = int(p.argmin()), int(p.argmax())
    kind = np.where(p == p[first], 0, np.where(p == p[last], 2, 1))
    same = np.unique(p[kind == 1], return_counts=True)[1].astype(np.int64)
    found = int((same * (same - 1) // 2).sum())
    for what, c in ((CELLS_TP, "_rt"), (CELLS_YP, "_ry")):
        r = t.column(c).to_numpy().astype(np.int64)
        cell, w = np.unique(r * 3 + kind, return_counts=True)
        cell, edge = cell // 3, cell % 3
        found += concordant(p[np.lexsort((-p, r))]) - dominated(cell, edge, None, w)
        values = t.column("_p").take(pa.array(np.array([first, 0, last])[edge], mask=edge == 1)).combine_chunks()
        yield {"what": np.full(len(w), what), "cell": cell, "k": np.full(len(w), k), "kind": edge, "v": values, "w": w}
    yield {"what": [OTHERS], "w": [found]}


def c_index_ordered(df: DataFrame, by: list[str], order: str, y: str = "y", p: str = "p") -> DataFrame:
    """Concordance index over the pairs whose *later* row (along ``order``)
    has the larger y: 1 when its p is larger too, 1/2 when equal, divided by
    the number of such pairs (0 when there are none).

    That is dominance counting in three dimensions, and no pair is formed.  Of three orders either all
    agree on a pair or exactly two of the three pairs of orders disagree, so counts in two
    dimensions are enough.  Let T be the order along (o, y falling, p), Y along (y, o falling,
    p falling).  With A the pairs of smaller o and y, D those earlier in T and smaller in p, E those earlier in
    Y and smaller in p, S those of equal p and N all pairs, twice the wanted sum is A + D + E + S - N: that holds for
    each pair, whatever of it is equal.

    Rows lie in ranges along T, then along Y, then along p.  Pairs of one range are counted there (see
    :func:`concordant`), pairs of one range of the other order there, by the range in the first, and the rest
    by the numbers of rows per cell of ranges.  A value of p may fill many ranges: the first and the last value of a range have
    cells of their own.  So a row is sent three times, whatever its values, and no
    task holds more than a range.  Rows with a null y or p take no part; among rows of equal
    ``order`` none is the later one."""
    spark = df.sparkSession
    d = df.select(*by, F.col(order).alias("_o"), F.col(y).alias("_y"), F.col(p).alias("_p")).filter(
        F.col("_y").isNotNull() & F.col("_p").isNotNull() & F.col("_o").isNotNull())
    n = d.count()
    n = max(1, min(max(BLOCKS, -(-n // MOST_ROWS)), -(-n // BLOCK_ROWS)))
    long, keys = T.LongType(), [d.schema[c] for c in by]
    value = T.StructField("_p", d.schema["_p"].dataType)

    def through(rows, along, number, task, fields, on):
        """The table that the ranges along ``along`` make, stored (a range exchange samples its cut points anew in every plan)."""
        schema = T.StructType([*keys, *fields, *[T.StructField(c, long) for c in ("what", "w")]])
        arrow = to_arrow_schema(schema)
        path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pairs-{uuid.uuid4().hex}"
        rows.repartitionByRange(n, *by, *along).withColumn(number, F.spark_partition_id().cast("long")).mapInArrow(
            lambda batches: _pairs_in_order(batches, by, task, (arrow, on)), schema).write.parquet(path)
        return spark.read.schema(schema).parquet(path)
    rt, ry = (T.StructField(c, long) for c in ("_rt", "_ry"))
    ranged = through(d, [F.col("_o"), F.desc("_y"), F.col("_p")], "_rt", _along_t, [d.schema["_o"], d.schema["_y"], value, rt], True)
    small = [ranged.filter("what is not null")]
    ranged = through(ranged.filter("what is null").drop("what", "w"), [F.col("_y"), F.desc("_o"), F.desc("_p")], "_ry", _along_y, [value, rt, ry], True)
    small.append(ranged.filter("what is not null").withColumnsRenamed({"_rt": "cell", "_ry": "k"}))
    # rows of equal p are dealt by their other ranges, too: no value fills a task
    small.append(through(ranged.filter("what is null").drop("what", "w"), [F.col("_p"), F.xxhash64("_rt", "_ry")], "_rp", _along_p,
                         [T.StructField("v", value.dataType), *[T.StructField(c, long) for c in ("cell", "k", "kind")]], False))
    names = [*by, "what", "w", "cell", "k", "kind", "v"]
    none = {"cell": F.lit(None).cast("long"), "k": F.lit(None).cast("long"), "kind": F.lit(None).cast("long"), "v": F.lit(None).cast(value.dataType)}
    counts = reduce(DataFrame.unionByName, [x.select(*[F.col(c) if c in x.columns else none[c].alias(c) for c in names]) for x in small])

    def total(pdf):
        what, w = pdf["what"].to_numpy(np.int64), pdf["w"].to_numpy(np.int64)
        out = pdf[by].iloc[:1].copy()
        cells = pdf[what == CELLS_TY]
        pairs = int(w[what == PAIRS].sum()) + dominated(*(cells[c].to_numpy(np.int64) for c in ("cell", "k")), None, w[what == CELLS_TY])
        rows = int(w[what == CELLS_TY].sum())
        twice = pairs + int(w[what == OTHERS].sum()) - rows * (rows - 1) // 2
        for kind in (CELLS_TP, CELLS_YP):
            cells, ws = pdf[what == kind], w[what == kind]
            k, edge = (cells[c].to_numpy(np.int64) for c in ("k", "kind"))
            places, first, at = np.unique(k * 3 + edge, return_index=True, return_inverse=True)
            v, inner, rank = cells["v"].to_numpy()[first], places % 3 == 1, np.zeros(len(places), np.int64)
            for i in range(1, len(places)):
                same = not inner[i] and not inner[i - 1] and (v[i] == v[i - 1] or v[i] != v[i] and v[i - 1] != v[i - 1])
                rank[i] = rank[i - 1] + (not same)
            twice += dominated(cells["cell"].to_numpy(np.int64), rank[at], None, ws)
            if kind == CELLS_TP:
                of = np.zeros(int(rank.max(initial=-1)) + 1, np.int64)
                np.add.at(of, rank[at][edge != 1], ws[edge != 1])
                twice += sum(int(x) * (int(x) - 1) // 2 for x in of)
        out["n_pairs"], out["c_index"] = pairs, twice / 2 / pairs if pairs else 0.0
        return out

    return counts.groupBy(*by).applyInPandas(total, T.StructType([*keys, T.StructField("n_pairs", long), T.StructField("c_index", T.DoubleType())]))


# G18 -----------------------------------------------------------------------
def loss_columns(df: DataFrame, by: list[str], logit: str = "logit", target: str = "y_true",
                 pos_weight: float | None = None) -> DataFrame:
    """Mean BCE-with-logits (stable form, optional positive weight), MSE,
    L1 and smooth-L1 (beta 1) of ``sigmoid(logit)`` vs target per group."""
    x, y = F.col(logit).cast("double"), F.col(target).cast("double")
    log_sig = -(F.greatest(-x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x))))   # log(sigmoid(x))
    log_1m = -(F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x))))     # log(1-sigmoid(x))
    w = F.lit(pos_weight if pos_weight is not None else 1.0)
    bce = -(w * y * log_sig + (1 - y) * log_1m)
    prob = F.lit(1.0) / (F.lit(1.0) + F.exp(-x))
    diff = prob - y
    smooth = F.when(F.abs(diff) < 1, 0.5 * diff * diff).otherwise(F.abs(diff) - 0.5)
    return df.groupBy(*by).agg(F.avg(bce).alias("bce"), F.avg(diff * diff).alias("mse"),
                               F.avg(F.abs(diff)).alias("l1"), F.avg(smooth).alias("smooth_l1"))


def cross_entropy(df: DataFrame, scores: str = "scores", truth: str = "truth") -> DataFrame:
    """Mean cross-entropy of per-row logits arrays against the class index,
    rows labelled -100 ignored (log-sum-exp with a max shift)."""
    s = F.col(scores)
    mx = F.array_max(s)
    lse = mx + F.log(F.aggregate(s, F.lit(0.0), lambda acc, v: acc + F.exp(v - mx)))
    ce = lse - F.element_at(s, F.col(truth) + 1)
    return df.filter(F.col(truth) != IGNORE_INDEX).agg(F.avg(ce).alias("cross_entropy"))


def neg_pearson(df: DataFrame, preds: str, labels: str, as_reference: bool = False) -> DataFrame:
    """Mean of ``1 - pearson(pred_row, label_row)`` over rows of arrays.  The
    function form in the reference fixes N=1 (a bug); ``as_reference``
    reproduces it, the default uses the row length."""
    x, y = F.col(preds), F.col(labels)

    def s(arr):
        return F.aggregate(arr, F.lit(0.0), lambda a, v: a + v)

    xy = F.zip_with(x, y, lambda a, b: a * b)
    x2 = F.transform(x, lambda a: a * a)
    y2 = F.transform(y, lambda a: a * a)
    n = F.lit(1.0) if as_reference else F.size(x).cast("double")
    num = n * s(xy) - s(x) * s(y)
    den = F.sqrt((n * s(x2) - s(x) * s(x)) * (n * s(y2) - s(y) * s(y)))
    return df.agg(F.avg(1 - num / den).alias("neg_pearson"))


# G19 -----------------------------------------------------------------------
def class_weights(df: DataFrame, label: str = "y_true", mode: str = "ratio") -> DataFrame:
    """``ratio``: ``pos_weight = n_neg / n_pos`` (1.0 when a class is
    missing); ``ratio_max1``: ``n_neg / max(n_pos, 1)``; ``inverse``: per row
    ``1 / count(class)`` (sampler weights)."""
    if mode == "inverse":
        c = df.groupBy(label).agg(F.count(F.lit(1)).alias("_cn"))
        return df.join(c, label).withColumn("weight", 1.0 / F.col("_cn")).drop("_cn")
    a = df.agg(F.count_if(F.col(label) == 1).alias("n_pos"), F.count_if(F.col(label) == 0).alias("n_neg"))
    if mode == "ratio":
        w = F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0),
                   F.col("n_neg") / F.col("n_pos")).otherwise(F.lit(1.0))
    elif mode == "ratio_max1":
        w = F.col("n_neg") / F.greatest(F.col("n_pos"), F.lit(1))
    else:
        raise ValueError(mode)
    return a.withColumn("pos_weight", w.cast("double"))


# G20 -----------------------------------------------------------------------
def exact(c, scale: int):
    """A value as a decimal of ``scale`` digits; one with more digits raises."""
    d = c.cast(f"decimal(38,{scale})")
    return F.when(d.cast("double") == c.cast("double"), d).when(c.isNotNull(), F.raise_error(F.lit(f"a value has more than {scale} decimals")))


def running_average(df: DataFrame, key: str, value: str, n: str | None = None, scale: int = 6) -> DataFrame:
    """Per key: total of value*n, count of n, average (the meter).  Totals
    are exact decimal sums, so they do not depend on the task split; values
    with more than ``scale`` decimals are refused."""
    cnt = F.col(n) if n else F.lit(1)
    return df.groupBy(key).agg(F.sum(exact(F.col(value), scale) * cnt).cast("double").alias("total"),
                               F.sum(cnt).cast("long").alias("count")) \
             .withColumn("average", F.col("total") / F.col("count"))


def cumulative_average(df: DataFrame, key: str, order: str, value: str, scale: int = 6, keep_sums: bool = False) -> DataFrame:
    """Running average along ``order`` per key (range-bucketed windows,
    exact decimal running sums; ``keep_sums`` adds them as cum_total and cum_count)."""
    d = df.withColumn("_one", F.lit(1)).withColumn("_v", exact(F.col(value), scale))
    r = running(d, [key], [F.col(order)], sums=("_v", "_one"))
    r = r.withColumn("running_avg", F.col("cum__v").cast("double") / F.col("cum__one"))
    if keep_sums:
        r = r.withColumn("cum_total", F.col("cum__v")).withColumn("cum_count", F.col("cum__one"))
    return r.drop("_one", "_v", "cum__one", "_one_total", "cum__v", "_v_total")


# G21 -----------------------------------------------------------------------
def best_epoch(df: DataFrame, by: list[str], epoch: str, metric_cols: list[str]) -> DataFrame:
    """Score = mean of the first five metrics that are not NaN (-1 if none);
    per group the first epoch with the strictly greatest score wins."""
    if len(metric_cols) > 5:
        raise ValueError("the score is a mean of five metrics at most")
    cols = metric_cols
    ok = [F.when(~F.isnan(F.col(c)) & F.col(c).isNotNull(), F.col(c)) for c in cols]
    n_ok = sum((F.when(o.isNotNull(), 1).otherwise(0) for o in ok), F.lit(0))
    tot = sum((F.coalesce(o, F.lit(0.0)) for o in ok), F.lit(0.0))
    score = F.when(n_ok > 0, tot / n_ok).otherwise(F.lit(-1.0))
    d = df.withColumn("score", score)
    best = d.groupBy(*by).agg(F.max(F.struct(F.col("score"), (-F.col(epoch)).alias("_ne"))).alias("_b"))
    return best.select(*by, (-F.col("_b._ne")).alias(epoch), F.col("_b.score").alias("score"))


# G22 -----------------------------------------------------------------------
def stop_point(df: DataFrame, key: str, step: str, value: str, patience: int = 5,
               greater_is_better: bool = True) -> DataFrame:
    """Early-stopping point per key: the first evaluation at which
    ``patience`` evaluations in a row have not improved on the best so far
    (null when it never happens).  Running maxima (range-bucketed) find the
    best-before and the last improvement; no window holds a whole key."""
    v = F.col(value) if greater_is_better else -F.col(value)
    d = df.withColumn("_v", v.cast("double")).withColumn("_one", F.lit(1))
    r = running(d, [key], [F.col(step)], maxes=("_v",), sums=("_one",), inclusive=False)
    improved = F.col("runmax__v").isNull() | (F.col("_v") > F.col("runmax__v"))
    r = r.select(key, step, (F.col("cum__one") + 1).alias("_pos"), F.when(improved, F.col("cum__one") + 1).alias("_imp_pos"))
    r = running(r, [key], [F.col(step)], maxes=("_imp_pos",))
    streak = F.col("_pos") - F.col("runmax__imp_pos")
    hits = r.filter(streak >= patience)
    keys = df.select(key).distinct()
    first = hits.groupBy(key).agg(F.min(step).alias("stop_step"))
    return keys.join(first, key, "left")


# G23 -----------------------------------------------------------------------
def steps_per_second(df: DataFrame, key: str, ts: str, step: str) -> DataFrame:
    """1 / seconds since the previous step of the same key (ordered by
    time); null for the first step of a key and for step 0 (a reset).
    The previous time is a running max over strictly earlier rows."""
    d = df.withColumn("_t", F.col(ts).cast("double"))
    r = running(d, [key], [F.col(ts), F.col(step)], maxes=("_t",), inclusive=False)
    dt = F.col("_t") - F.col("runmax__t")
    rate = F.when((F.col(step) != 0) & (dt > 0), 1.0 / dt)
    return r.select(key, step, rate.alias("steps_per_sec"))


# G24 -----------------------------------------------------------------------
def dataset_fingerprint(df: DataFrame, cols: list[str]) -> DataFrame:
    """Order-free fingerprint: row count and the sum of 60-bit md5 prefixes
    of each row's ``\\x1f``-joined text (exact decimal sum, as text)."""
    row = row_text(cols)
    h = F.conv(F.substr(F.md5(row), F.lit(1), F.lit(15)), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(h).cast("string").alias("fingerprint"))


def row_text(cols: list[str]) -> Column:
    """A row as text: ``\\x1f``-joined values, each behind its length, and
    ``-`` for a null, so different rows have different texts."""
    return F.concat_ws("\u001f", *[F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")),
                                              F.lit("-")) for c in cols])


FANOUT = 64


def fingerprint_tree(df: DataFrame, order: list[str], cols: list[str], fanout: int = FANOUT) -> DataFrame:
    """Ordered fingerprint as a hash tree: ``(level, node, n_rows, first, hash)``.

    A row's place is its rank along ``order`` (range-bucketed), its leaf hash
    the md5 of :func:`row_text`.  A node of level k covers ``fanout ** k``
    consecutive places and hashes its children's hashes in order; the highest
    level has one node, the fingerprint of the table.  So the tree depends on
    the rows and their order alone, not on partitions; nodes are aggregates of at most
    ``fanout`` values, and two trees differ exactly in the nodes above rows
    that differ (:func:`changed_ranges`).  ``first`` is the place of a node's
    first row.  Rows of equal ``order`` are ordered by their text.  Level 0 is not
    returned; an empty table has no nodes."""
    rows = df.select(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], F.md5(row_text(cols)).alias("_leaf")) \
        .withColumn("_one", F.lit(1).cast("long"))
    placed = running(rows, [], [*[f"_o{i}" for i in range(len(order))], "_leaf"], sums=("_one",))
    level = placed.select((F.col("cum__one") - 1).alias("node"), F.lit(1).cast("long").alias("n_rows"), F.col("_leaf").alias("hash"))
    total, out, k, width = df.count(), None, 0, 1  # a scalar: the number of levels
    while total and (width < total or k == 0):
        k, width = k + 1, width * fanout
        parent = F.floor(F.col("node") / fanout)
        level = level.groupBy(parent.cast("long").alias("node")).agg(
            F.sum("n_rows").alias("n_rows"), F.sort_array(F.collect_list(F.struct("node", "hash"))).alias("_c"))
        level = level.select("node", "n_rows", F.md5(F.array_join(F.transform("_c", lambda c: c["hash"]), "\n")).alias("hash"))
        part = level.select(F.lit(k).alias("level"), "node", "n_rows", (F.col("node") * width).alias("first"), "hash")
        out = part if out is None else out.unionByName(part)
    return out if out is not None else level.limit(0).select(F.lit(1).alias("level"), "node", "n_rows", F.col("node").alias("first"), "hash")


def changed_ranges(a: DataFrame, b: DataFrame, level: int = 1) -> DataFrame:
    """The ranges of places (``first``, ``n_rows`` of both versions) whose nodes
    at ``level`` differ between two trees of the same fan-out."""
    def at(t, p):
        return t.filter(F.col("level") == level).select("first", F.col("hash").alias(f"{p}h"), F.col("n_rows").alias(f"n_rows_{p}"))
    both = at(a, "a").join(at(b, "b"), "first", "full")
    return both.filter(~F.col("ah").eqNullSafe(F.col("bh"))).select("first", "n_rows_a", "n_rows_b")
