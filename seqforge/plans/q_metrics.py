"""Registered evaluation queries (G*) with oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqforge.operators import metrics as G
from seqforge.operators import splits as X
from seqforge.plans import views as V
from seqforge.plans.registry import register
from seqforge.sources.matrix import derive_substitution_matrix, derive_substitution_sql


def _preds(spark, d):
    return V.preds(spark, d)


def _r6(df, cols):
    """Round doubles to 6 digits for the comparison (both sides do it)."""
    return df.select(*[F.round(c, 6).alias(c) if c in cols else F.col(c) for c in df.columns])


_CM_COLS = ["accuracy", "precision", "recall", "f1", "sensitivity", "specificity", "mcc"]
_CURVE_COLS = ["roc_auc", "pr_auc", "average_precision"]

_CONF_SQL = """SELECT fold,
  count(*) FILTER (WHERE y_true = 0 AND y_pred = 0) AS tn, count(*) FILTER (WHERE y_true = 0 AND y_pred = 1) AS fp,
  count(*) FILTER (WHERE y_true = 1 AND y_pred = 0) AS fn, count(*) FILTER (WHERE y_true = 1 AND y_pred = 1) AS tp,
  count(*) FILTER (WHERE y_pred = 0) AS pred_0, count(*) FILTER (WHERE y_pred = 1) AS pred_1,
  count(*) FILTER (WHERE y_true = 0) AS true_0, count(*) FILTER (WHERE y_true = 1) AS true_1
FROM pb GROUP BY fold"""
_PB = "SELECT *, CAST(y_prob >= 0.5 AS INTEGER) AS y_pred FROM preds"


def _d0(a, b):
    return f"CASE WHEN ({b}) <> 0 THEN CAST({a} AS DOUBLE) / ({b}) ELSE 0.0 END"


_CM_SQL = f"""SELECT *, {_d0('tp + tn', 'tp + tn + fp + fn')} AS accuracy, {_d0('tp', 'tp + fp')} AS precision,
  {_d0('tp', 'tp + fn')} AS recall, {_d0('2 * tp', '2 * tp + fp + fn')} AS f1,
  {_d0('tp', 'tp + fn')} AS sensitivity, {_d0('tn', 'tn + fp')} AS specificity,
  {_d0('CAST(tp AS DOUBLE) * tn - CAST(fp AS DOUBLE) * fn',
       'sqrt(CAST(tp + fp AS DOUBLE) * (tp + fn) * (tn + fp) * (tn + fn))')} AS mcc FROM conf"""

_CURVE_SQL = """SELECT fold,
  CASE WHEN min(P) > 0 AND min(N) > 0 THEN sum(neg / N * (tp + tp - pos) / (2 * P)) ELSE 'NaN'::DOUBLE END AS roc_auc,
  CASE WHEN min(P) > 0 AND min(N) > 0 THEN sum(pos / P * (tp / (tp + fp) + CASE WHEN tp - pos + fp - neg > 0
       THEN (tp - pos) / (tp - pos + fp - neg) ELSE 1.0 END) / 2) ELSE 'NaN'::DOUBLE END AS pr_auc,
  CASE WHEN min(P) > 0 AND min(N) > 0 THEN sum(pos / P * tp / (tp + fp)) ELSE 'NaN'::DOUBLE END AS average_precision
FROM (SELECT *, CAST(sum(pos) OVER w AS DOUBLE) AS tp, CAST(sum(neg) OVER w AS DOUBLE) AS fp,
        CAST(sum(pos) OVER (PARTITION BY fold) AS DOUBLE) AS P, CAST(sum(neg) OVER (PARTITION BY fold) AS DOUBLE) AS N
      FROM (SELECT fold, y_prob, count(*) FILTER (WHERE y_true = 1) AS pos,
                   count(*) FILTER (WHERE y_true = 0) AS neg FROM {src} GROUP BY fold, y_prob)
      WINDOW w AS (PARTITION BY fold ORDER BY y_prob DESC ROWS UNBOUNDED PRECEDING))
GROUP BY fold"""


def _r6sql(cols, others):
    return ", ".join(list(others) + [f"round({c}, 6) AS {c}" for c in cols])


@register("g1_label_summary", sql=V.with_views("pairs") + """
SELECT n_pos, n_neg, n_other, n_pos + n_neg AS n, round(CASE WHEN n_pos + n_neg > 0
       THEN CAST(n_pos AS DOUBLE) / (n_pos + n_neg) ELSE 0.0 END, 6) AS pos_rate
FROM (SELECT count(*) FILTER (WHERE lower(trim(label)) = '1') AS n_pos,
             count(*) FILTER (WHERE lower(trim(label)) = '0') AS n_neg,
             count(*) FILTER (WHERE lower(trim(label)) NOT IN ('0', '1') OR label IS NULL) AS n_other
      FROM pairs)""")
def q_g1(spark, d):
    """G1: label counts and positive rate of the pair table."""
    return _r6(G.label_summary(V.pairs(spark, d), "label"), ["pos_rate"])


@register("g2_group_counts", sql=V.with_views("pairs", extra=[
    ("t", "SELECT antigen, count(*) FILTER (WHERE label IS NOT NULL AND lower(label) <> 'unknown') AS n_labeled "
          "FROM pairs GROUP BY antigen")]) + """
SELECT tier, count(*) AS n_rows, count(DISTINCT antigen) AS n_antigen FROM (
  SELECT p.antigen, CASE WHEN n_labeled >= 15 THEN 'majority' WHEN n_labeled >= 5 THEN 'backbone'
         WHEN n_labeled >= 1 THEN 'zero_shot' ELSE 'unlabelled' END AS tier
  FROM pairs p JOIN t USING (antigen)) GROUP BY tier""")
def q_g2(spark, d):
    """Rows and antigens per tier."""
    t = X.attach_tiers(V.pairs(spark, d), "antigen", "label", n_min=5, n_major=15)
    return G.group_counts(t, ["tier"], distinct="antigen")


@register("g3_confusion", sql=V.with_views("preds", extra=[("pb", _PB)]) + _CONF_SQL)
def q_g3(spark, d):
    """Confusion counts per fold at threshold 0.5."""
    from seqforge.functions.scalar import binarize
    return G.confusion(_preds(spark, d).withColumn("y_pred", binarize("y_prob")), ["fold"])


@register("g4_class_metrics", sql=V.with_views("preds", extra=[("pb", _PB), ("conf", _CONF_SQL)]) +
          f"SELECT {_r6sql(_CM_COLS, ['fold'])} FROM ({_CM_SQL})")
def q_g4(spark, d):
    """Accuracy, precision, recall, F1, sensitivity, specificity, MCC per fold."""
    from seqforge.functions.scalar import binarize
    cm = G.class_metrics(G.confusion(_preds(spark, d).withColumn("y_pred", binarize("y_prob")), ["fold"]))
    return _r6(cm.select("fold", *_CM_COLS), _CM_COLS)


@register("g5_g7_curve_metrics", sql=V.with_views("preds") +
          f"SELECT {_r6sql(_CURVE_COLS, ['fold'])} FROM ({_CURVE_SQL.format(src='preds')})")
def q_g5(spark, d):
    """ROC AUC, trapezoid PR AUC and average precision per fold."""
    return _r6(G.curve_metrics(_preds(spark, d), ["fold"]), _CURVE_COLS)


_REPORT_COLS = ["roc_auc", "accuracy", "mcc", "f1", "pr_auc", "sensitivity", "specificity", "precision",
                "recall"]
_ALL_SQL = (f"SELECT m.*, c.roc_auc, c.pr_auc, c.average_precision FROM ({_CM_SQL}) m "
            f"JOIN ({_CURVE_SQL.format(src='preds')}) c USING (fold)")


def _report_sql(cols, sd_fn, sd_label):
    per = ", ".join(f"round({c}, 6) AS {c}" for c in cols)
    avg = ", ".join(f"round(avg({c}), 6) AS {c}" for c in cols)
    sd = ", ".join(f"round(CASE WHEN count(*) > 1 THEN {sd_fn}({c}) ELSE 0.0 END, 6) AS {c}" for c in cols)
    return (f"SELECT 'fold' || CAST(fold AS VARCHAR) AS fold, {per} FROM allm UNION ALL "
            f"SELECT 'avg' AS fold, {avg} FROM allm UNION ALL SELECT '{sd_label}' AS fold, {sd} FROM allm")


@register("g8_fold_report_sample_sd", sql=V.with_views("preds", extra=[
    ("pb", _PB), ("conf", _CONF_SQL), ("allm", _ALL_SQL)]) + _report_sql(_REPORT_COLS, "stddev_samp", "sd"))
def q_g8(spark, d):
    """Per-fold report with avg and sample sd rows (pair tasks)."""
    m = G.evaluate(_preds(spark, d), ["fold"])
    return _r6(G.fold_report(m, "fold", _REPORT_COLS, ddof=1, fold_prefix="fold"), _REPORT_COLS)


_AG_COLS = ["roc_auc", "average_precision", "accuracy", "precision", "recall", "f1", "mcc"]


@register("g8_fold_report_population_sd", sql=V.with_views("preds", extra=[
    ("pb", _PB), ("conf", _CONF_SQL), ("allm", _ALL_SQL)]) + _report_sql(_AG_COLS, "stddev_pop", "sd")
    .replace("'fold' || CAST(fold AS VARCHAR)", "CAST(fold AS VARCHAR)"))
def q_g8p(spark, d):
    """Report with population sd (antigen task; AP as its aupr)."""
    m = G.evaluate(_preds(spark, d), ["fold"])
    return _r6(G.fold_report(m, "fold", _AG_COLS, ddof=0), _AG_COLS)


@register("g9_ensemble_folds", sql=V.with_views("preds", extra=[
    ("e", "SELECT example_id, 'ensemble' AS fold, avg(y_prob) AS y_prob, first(y_true) AS y_true "
          "FROM preds GROUP BY example_id"),
    ("pb", "SELECT *, CAST(y_prob >= 0.5 AS INTEGER) AS y_pred FROM e"), ("conf", _CONF_SQL)]) +
    f"SELECT {_r6sql(_CM_COLS + _CURVE_COLS, ['fold', 'tp', 'fp', 'tn', 'fn'])} FROM ({_CM_SQL}) m "
    f"JOIN ({_CURVE_SQL.format(src='e')}) c USING (fold)")
def q_g9(spark, d):
    """Mean probability over folds per example, then scored once."""
    e = G.ensemble_folds(_preds(spark, d), ["example_id"])
    return _r6(e.select("fold", "tp", "fp", "tn", "fn", *_CM_COLS, *_CURVE_COLS), _CM_COLS + _CURVE_COLS)


_MEAN_COLS = ["tn", "fp", "fn", "tp", "pred_0", "pred_1", "true_0", "true_1"] + _CM_COLS + _CURVE_COLS


@register("g10_mean_fold_counts", sql=V.with_views("preds", extra=[
    ("pb", _PB), ("conf", _CONF_SQL), ("allm", _ALL_SQL)]) +
    "SELECT " + ", ".join(f"round(avg(CAST({c} AS DOUBLE)), 6) AS {c}" for c in _MEAN_COLS) + " FROM allm")
def q_g10(spark, d):
    """Mean of every metric and count over the folds."""
    m = G.evaluate(_preds(spark, d), ["fold"])
    return _r6(G.mean_fold_counts(m, _MEAN_COLS), _MEAN_COLS)


# G11 / G12 / G13 -----------------------------------------------------------
_TOK_CASE = "CASE " + " ".join(f"WHEN {{x}} = {i} THEN '{a}'" for i, a in enumerate(V.RESIDUES)) + " END"


@register("g11_masked_topn", sql=V.with_views("seqs", "logits", extra=derive_substitution_sql() + [
    ("lg", "SELECT *, len(list_filter(scores, lambda x, i: x > scores[truth + 1] OR "
           "(x = scores[truth + 1] AND i - 1 > truth))) AS b, "
           "len(scores) - list_position(list_reverse(scores), list_max(scores)) AS top1 "
           "FROM logits WHERE truth <> -100"),
    ("lt", f"SELECT *, {_TOK_CASE.format(x='truth')} AS ta, {_TOK_CASE.format(x='top1')} AS pa FROM lg")]) + """
SELECT count(*) AS n_scored,
  round(CASE WHEN count(*) > 0 THEN count(*) FILTER (WHERE b = 0) / count(*) ELSE 0.0 END, 6) AS top1_acc,
  round(CASE WHEN count(*) > 0 THEN count(*) FILTER (WHERE b < 3) / count(*) ELSE 0.0 END, 6) AS top3_acc,
  round(coalesce(avg(s.score), 0.0), 6) AS mean_substitution
FROM lt LEFT JOIN submat s ON s.aa1 = lt.ta AND s.aa2 = lt.pa""")
def q_g11(spark, d):
    """Top-1 / top-3 accuracy and mean substitution score of masked positions."""
    sub = derive_substitution_matrix(V.seqs(spark, d))
    return _r6(G.masked_topn(V.logits(spark, d), sub, n=3), ["top1_acc", "top3_acc", "mean_substitution"])


@register("g12_position_accuracy", sql=V.with_views("logits") + """
SELECT round(count(*) FILTER (WHERE top1 = truth) / count(*), 6) AS accuracy,
       count(*) FILTER (WHERE truth NOT IN (21, -100) AND top1 = truth) AS n_correct,
       count(*) FILTER (WHERE truth NOT IN (21, -100)) AS n_scored
FROM (SELECT *, len(scores) - list_position(list_reverse(scores), list_max(scores)) AS top1 FROM logits)""")
def q_g12(spark, d):
    """Argmax accuracy and the (correct, scored) count variant."""
    return _r6(G.position_accuracy(V.logits(spark, d)), ["accuracy"])


@register("g13_string_identity", sql=V.with_views("seqs", extra=derive_substitution_sql() + [
    ("pl", "SELECT substr(sequence, 2) AS p, sequence AS l FROM seqs WHERE length(sequence) > 0"),
    ("pos", "SELECT l[i] AS la, CASE WHEN i <= length(p) THEN p[i] END AS pa FROM pl, range(1, length(l) + 1) t(i)")]) + """
SELECT count(*) FILTER (WHERE pa = la) AS matches, count(*) AS total,
       round(CASE WHEN count(*) > 0 THEN count(*) FILTER (WHERE pa = la) / count(*) ELSE 0.0 END, 6) AS identity,
       round(avg(s.score), 6) AS mean_substitution
FROM pos LEFT JOIN submat s ON s.aa1 = pos.la AND s.aa2 = pos.pa""")
def q_g13(spark, d):
    """Identity of each sequence against itself shifted by one residue."""
    s = V.seqs(spark, d)
    pl = s.select(F.substr("sequence", F.lit(2)).alias("pred"), F.col("sequence").alias("label"))
    return _r6(G.string_identity(pl, derive_substitution_matrix(s)), ["identity", "mean_substitution"])


@register("g14_rounded_metrics", sql=V.with_views("preds") + """
SELECT fold, round(count(*) FILTER (WHERE round_even(y_prob, 0) = y_true) / count(*), 6) AS accuracy,
       round(CASE WHEN count(*) FILTER (WHERE y_true = 1) > 0 THEN
         count(*) FILTER (WHERE round_even(y_prob, 0) = 1 AND y_true = 1) / count(*) FILTER (WHERE y_true = 1)
         ELSE 0.0 END, 6) AS recall
FROM preds GROUP BY fold""")
def q_g14(spark, d):
    """Accuracy and recall after rounding half to even."""
    return _r6(G.rounded_metrics(_preds(spark, d), ["fold"]), ["accuracy", "recall"])


_REG_COLS = ["mse", "r2", "r0_2", "rm2", "pearson"]


@register("g15_regression_metrics", sql=V.with_views("reg") + """
SELECT l_linenumber, mse, round(r2, 6) AS r2, round(r0, 6) AS r0_2,
       round(r2 * (1 - sqrt(abs(r2 * r2 - r0 * r0))), 6) AS rm2, round(pearson, 6) AS pearson
FROM (SELECT *, pearson * pearson AS r2,
        1 - (syy - 2 * beta * spy + beta * beta * spp) / (syy + 1e-12) AS r0
      FROM (SELECT *, spy / (spp + 1e-12) AS beta FROM (
        SELECT l_linenumber, CAST(sum((CAST(p AS DECIMAL(18, 2)) - CAST(y AS DECIMAL(18, 2)))
                                    * (CAST(p AS DECIMAL(18, 2)) - CAST(y AS DECIMAL(18, 2)))) AS DOUBLE) / count(*) AS mse, corr(p, y) AS pearson, sum(p * y) AS spy,
               sum(p * p) AS spp, sum(y * y) AS syy FROM reg GROUP BY l_linenumber)))""")
def q_g15(spark, d):
    """MSE, r2, r0^2, rm2 and Pearson of price vs quantity per line number."""
    # mse is an exact sum over a count (same double in any engine); rounding a
    # value near 4e9 to 6 decimals would only add engine-specific noise
    return _r6(G.regression_metrics(V.reg(spark, d), ["l_linenumber"], exact_scale=2), _REG_COLS[1:])


@register("g16_spearman", sql=V.with_views("reg") + """
SELECT l_linenumber, round(corr(ry, rp), 6) AS spearman FROM (
  SELECT l_linenumber,
    rank() OVER (PARTITION BY l_linenumber ORDER BY y) + (count(*) OVER (PARTITION BY l_linenumber, y) - 1) / 2.0 AS ry,
    rank() OVER (PARTITION BY l_linenumber ORDER BY p) + (count(*) OVER (PARTITION BY l_linenumber, p) - 1) / 2.0 AS rp
  FROM reg) GROUP BY l_linenumber""")
def q_g16(spark, d):
    """Spearman correlation (Pearson of average ranks) per line number."""
    return _r6(G.spearman(V.reg(spark, d), ["l_linenumber"]), ["spearman"])


_LOSS_COLS = ["bce", "mse", "l1", "smooth_l1"]


@register("g18_loss_columns", sql=V.with_views("preds") + """
SELECT fold, round(avg(-(y * ls + (1 - y) * l1m)), 6) AS bce, round(avg((pr - y) * (pr - y)), 6) AS mse,
       round(avg(abs(pr - y)), 6) AS l1,
       round(avg(CASE WHEN abs(pr - y) < 1 THEN 0.5 * (pr - y) * (pr - y) ELSE abs(pr - y) - 0.5 END), 6) AS smooth_l1
FROM (SELECT fold, CAST(y_true AS DOUBLE) AS y, -(greatest(-x, 0.0) + ln(1 + exp(-abs(x)))) AS ls,
             -(greatest(x, 0.0) + ln(1 + exp(-abs(x)))) AS l1m, 1.0 / (1.0 + exp(-x)) AS pr
      FROM (SELECT *, (y_prob - 0.5) * 8.0 AS x FROM preds)) GROUP BY fold""")
def q_g18(spark, d):
    """BCE-with-logits, MSE, L1 and smooth-L1 per fold (logit = 8*(p-0.5))."""
    p = _preds(spark, d).withColumn("logit", (F.col("y_prob") - 0.5) * 8.0)
    return _r6(G.loss_columns(p, ["fold"]), _LOSS_COLS)


@register("g18_cross_entropy", sql=V.with_views("logits") + """
SELECT round(avg(mx + ln(list_sum(list_transform(scores, lambda v: exp(CAST(v AS DOUBLE) - mx)))) - scores[truth + 1]), 6)
       AS cross_entropy
FROM (SELECT *, CAST(list_max(scores) AS DOUBLE) AS mx FROM logits WHERE truth <> -100)""")
def q_g18ce(spark, d):
    """Mean cross-entropy of the 64-way scores against the class id."""
    return _r6(G.cross_entropy(V.logits(spark, d)), ["cross_entropy"])


@register("g19_class_weights", sql=V.with_views("preds") + """
SELECT n_pos, n_neg, CASE WHEN n_pos > 0 AND n_neg > 0 THEN CAST(n_neg AS DOUBLE) / n_pos ELSE 1.0 END AS pos_weight
FROM (SELECT count(*) FILTER (WHERE y_true = 1) AS n_pos, count(*) FILTER (WHERE y_true = 0) AS n_neg FROM preds)""")
def q_g19(spark, d):
    """Positive-class weight n_neg / n_pos."""
    return _r6(G.class_weights(_preds(spark, d)), ["pos_weight"])


@register("g20_running_average", sql=V.with_views("steps") + """
SELECT key, round(t, 6) AS total, c AS count, round(t / c, 6) AS average FROM (
  SELECT key, CAST(sum(CAST(value AS DECIMAL(38, 6))) AS DOUBLE) AS t, count(*) AS c FROM steps GROUP BY key)""")
def q_g20(spark, d):
    """Per event type total, count and average (the meter)."""
    return _r6(G.running_average(V.steps(spark, d), "key", "value"), ["total", "average"])


@register("g20_cumulative_average", sql=V.with_views("steps") + """
SELECT key, step, floor(CAST(sum(CAST(value AS DECIMAL(38, 6))) OVER w * 1000000 AS BIGINT)::DOUBLE / count(*) OVER w) / 1000000 AS running_avg
FROM steps WINDOW w AS (PARTITION BY key ORDER BY step ROWS UNBOUNDED PRECEDING)""")
def q_g20c(spark, d):
    """Running average along the step order per key, in whole millionths
    (rounding a double at a half differs between engines)."""
    c = G.cumulative_average(V.steps(spark, d), "key", "step", "value", keep_sums=True)
    units = F.round(F.col("cum_total").cast("double") * 1000000).cast("long").cast("double")
    return c.select("key", "step", (F.floor(units / F.col("cum_count")).cast("double") / 1000000.0).alias("running_avg"))


_EPOCH_SQL = ("SELECT l_linenumber AS fold, l_orderkey AS epoch, l_discount AS m1, l_tax AS m2, "
              "l_quantity / 50.0 AS m3, l_discount + l_tax AS m4, CASE WHEN l_returnflag = 'R' "
              "THEN 'NaN'::DOUBLE ELSE 0.5 END AS m5 FROM lineitem")


def _epochs(spark, d):
    li = V.table(spark, d, "lineitem")
    return li.select(F.col("l_linenumber").alias("fold"), F.col("l_orderkey").alias("epoch"),
                     F.col("l_discount").alias("m1"), F.col("l_tax").alias("m2"),
                     (F.col("l_quantity") / 50.0).alias("m3"), (F.col("l_discount") + F.col("l_tax")).alias("m4"),
                     F.when(F.col("l_returnflag") == "R", F.lit(float("nan"))).otherwise(F.lit(0.5)).alias("m5"))


@register("g21_best_epoch", sql=V.with_views(extra=[("ep", _EPOCH_SQL)]) + """
SELECT fold, epoch, round(score, 6) AS score FROM (
  SELECT fold, epoch, score, row_number() OVER (PARTITION BY fold ORDER BY score DESC, epoch) AS rn FROM (
    SELECT fold, epoch, (m1 + m2 + m3 + m4 + CASE WHEN isnan(m5) THEN 0 ELSE m5 END)
           / (4 + CASE WHEN isnan(m5) THEN 0 ELSE 1 END) AS score FROM ep)) WHERE rn = 1""")
def q_g21(spark, d):
    """Per fold, the first epoch with the best mean of five metrics."""
    return _r6(G.best_epoch(_epochs(spark, d), ["fold"], "epoch", ["m1", "m2", "m3", "m4", "m5"]), ["score"])


@register("g22_stop_point", sql=V.with_views("steps") + """
, a AS (SELECT key, step, value, max(value) OVER (PARTITION BY key ORDER BY step
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bb,
          row_number() OVER (PARTITION BY key ORDER BY step) AS pos FROM steps),
b AS (SELECT *, max(CASE WHEN bb IS NULL OR value > bb THEN pos END) OVER (PARTITION BY key ORDER BY step
          ROWS UNBOUNDED PRECEDING) AS li FROM a)
SELECT k.key, s.stop_step FROM (SELECT DISTINCT key FROM steps) k
LEFT JOIN (SELECT key, min(step) AS stop_step FROM b WHERE pos - li >= 5 GROUP BY key) s USING (key)""")
def q_g22(spark, d):
    """Early-stopping step per key, patience 5."""
    return G.stop_point(V.steps(spark, d), "key", "step", "value", patience=5)


@register("g23_steps_per_second", sql=V.with_views("steps") + """
SELECT key, step, round(CASE WHEN step <> 0 AND dt > 0 THEN 1.0 / dt END, 6) AS steps_per_sec FROM (
  SELECT key, step, epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6) OVER (PARTITION BY key ORDER BY ts, step) AS dt
  FROM steps)""")
def q_g23(spark, d):
    """Steps per second between consecutive events of a type."""
    s = V.steps(spark, d).withColumn("ts", F.unix_micros("ts") / 1e6)
    return _r6(G.steps_per_second(s, "key", "ts", "step"), ["steps_per_sec"])


_ROW_SQL = ("concat_ws(chr(31), coalesce(length(CAST(doc_id AS VARCHAR)) || ':' || CAST(doc_id AS VARCHAR), '-'), "
            "coalesce(length(sequence) || ':' || sequence, '-'))")


@register("g24_dataset_fingerprint", sql=V.with_views("seqs") + f"""
SELECT count(*) AS n_rows, CAST(sum(CAST(('0x' || substr(md5({_ROW_SQL}), 1, 15)) AS BIGINT)) AS VARCHAR) AS fingerprint FROM seqs""")
def q_g24(spark, d):
    """Order-free fingerprint of the sequence table."""
    return G.dataset_fingerprint(V.seqs(spark, d), ["doc_id", "sequence"])


@register("g24_fingerprint_tree", sql=V.with_views("seqs", extra=[
    ("l0", f"SELECT row_number() OVER (ORDER BY doc_id, md5({_ROW_SQL})) - 1 AS node, 1 AS n, md5({_ROW_SQL}) AS h FROM seqs"),
    *[(f"l{k}", f"SELECT node // {G.FANOUT} AS node, sum(n) AS n, md5(string_agg(h, chr(10) ORDER BY node)) AS h FROM l{k - 1} GROUP BY 1")
      for k in range(1, 6)]]) + " UNION ALL ".join(
    f"SELECT {k} AS level, node, CAST(n AS BIGINT) AS n_rows, CAST(node * {G.FANOUT ** k} AS BIGINT) AS first, h AS hash FROM l{k} "
    f"WHERE {k} = 1 OR (SELECT count(*) FROM l{k - 1}) > 1" for k in range(1, 6)))
def q_g24t(spark, d):
    """The ordered fingerprint of the sequence table, as a hash tree over places."""
    return G.fingerprint_tree(V.seqs(spark, d), ["doc_id"], ["doc_id", "sequence"])


@register("g17_c_index", sql=V.with_views("reg", extra=[
    ("d", "SELECT l_linenumber, y, p, count(*) AS c FROM reg WHERE y IS NOT NULL AND p IS NOT NULL GROUP BY ALL"),
    ("ys", "SELECT DISTINCT l_linenumber, y AS v FROM d"),
    ("ps", "SELECT DISTINCT l_linenumber, p FROM d"),
    ("grid", """SELECT ps.l_linenumber, ps.p, ys.v, coalesce(d.c, 0) AS n,
      coalesce(sum(d.c) OVER (PARTITION BY ps.l_linenumber, ys.v ORDER BY ps.p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
      FROM ps JOIN ys USING (l_linenumber) LEFT JOIN d ON d.l_linenumber = ps.l_linenumber AND d.p = ps.p AND d.y = ys.v"""),
]) + """
SELECT d.l_linenumber, CAST(sum(d.c * g.total) AS BIGINT) AS n_pairs,
  round(CASE WHEN sum(d.c * g.total) > 0 THEN sum(d.c * g.conc) / sum(d.c * g.total) ELSE 0 END, 6) AS c_index
FROM d JOIN (
  SELECT d.l_linenumber, d.p, d.y, sum(g.below + 0.5 * g.n)::DOUBLE AS conc, any_value(t.total) AS total
  FROM d JOIN grid g ON g.l_linenumber = d.l_linenumber AND g.p = d.p AND g.v < d.y
  JOIN (SELECT a.l_linenumber, a.y, sum(b.c) AS total FROM (SELECT DISTINCT l_linenumber, y FROM d) a
        JOIN d b ON b.l_linenumber = a.l_linenumber AND b.y < a.y GROUP BY ALL) t ON t.l_linenumber = d.l_linenumber AND t.y = d.y
  GROUP BY ALL) g ON g.l_linenumber = d.l_linenumber AND g.p = d.p AND g.y = d.y
GROUP BY d.l_linenumber""")
def q_g17(spark, d):
    """Concordance index of price vs quantity per line number, over all
    pairs of the whole table (the SQL counts per distinct quantity along the
    price, so it forms no pairs of rows either)."""
    return _r6(G.c_index(V.reg(spark, d), ["l_linenumber"]), ["c_index"])


@register("g17_c_index_ordered", sql=V.with_views("reg") + """
SELECT l_linenumber, CAST(coalesce(n, 0) AS BIGINT) AS n_pairs, round(CASE WHEN n > 0 THEN s / n ELSE 0 END, 6) AS c_index
FROM (SELECT DISTINCT l_linenumber FROM reg WHERE y IS NOT NULL AND p IS NOT NULL) LEFT JOIN (
  SELECT a.l_linenumber, count(*) AS n, sum(CASE WHEN a.p > b.p THEN 1.0 WHEN a.p = b.p THEN 0.5 ELSE 0.0 END)::DOUBLE AS s
  FROM reg a JOIN reg b ON a.l_linenumber = b.l_linenumber AND b.l_orderkey < a.l_orderkey AND b.y < a.y GROUP BY 1) USING (l_linenumber)""")
def q_g17o(spark, d):
    """The order-dependent concordance index (a pair counts when its later
    order has the larger quantity) of price vs quantity per line number."""
    return _r6(G.c_index_ordered(V.reg(spark, d), ["l_linenumber"], "l_orderkey"), ["c_index"])


@register("g18_weighted_bce", sql=V.with_views("preds") + """
SELECT fold, round(avg(-(3.5 * y * ls + (1 - y) * l1m)), 6) AS bce
FROM (SELECT fold, CAST(y_true AS DOUBLE) AS y, -(greatest(-x, 0.0) + ln(1 + exp(-abs(x)))) AS ls,
             -(greatest(x, 0.0) + ln(1 + exp(-abs(x)))) AS l1m
      FROM (SELECT *, (y_prob - 0.5) * 8.0 AS x FROM preds)) GROUP BY fold""")
def q_g18w(spark, d):
    """BCE-with-logits with a positive weight of 3.5."""
    p = _preds(spark, d).withColumn("logit", (F.col("y_prob") - 0.5) * 8.0)
    return _r6(G.loss_columns(p, ["fold"], pos_weight=3.5).select("fold", "bce"), ["bce"])


_PEARSON = """avg(1 - (n * xy - sx * sy) / sqrt((n * x2 - sx * sx) * (n * y2 - sy * sy)))"""


@register("g18_neg_pearson", sql=f"""
WITH v AS (SELECT list_transform(embedding[1:32], lambda e: CAST(e AS DOUBLE)) AS x, list_transform(embedding[33:64], lambda e: CAST(e AS DOUBLE)) AS y FROM embeddings),
m AS (SELECT 32.0::DOUBLE AS n, list_sum(x) AS sx, list_sum(y) AS sy, list_inner_product(x, y) AS xy, list_inner_product(x, x) AS x2, list_inner_product(y, y) AS y2 FROM v)
SELECT round({_PEARSON}, 6) AS neg_pearson FROM m""")
def q_g18p(spark, d):
    """Negative Pearson correlation of the two halves of each vector, mean over rows."""
    e = V.table(spark, d, "embeddings").select(F.col("embedding").cast("array<double>").alias("e"))
    return _r6(G.neg_pearson(e.select(F.slice("e", 1, 32).alias("x"), F.slice("e", 33, 32).alias("y")), "x", "y"), ["neg_pearson"])


@register("g19_ratio_max1", sql=V.with_views("preds") + """
SELECT n_pos, n_neg, CAST(n_neg AS DOUBLE) / greatest(n_pos, 1) AS pos_weight
FROM (SELECT count(*) FILTER (WHERE y_true = 1) AS n_pos, count(*) FILTER (WHERE y_true = 0) AS n_neg FROM preds)""")
def q_g19m(spark, d):
    """n_neg / max(n_pos, 1)."""
    return _r6(G.class_weights(_preds(spark, d), mode="ratio_max1"), ["pos_weight"])


@register("g19_inverse", sql=V.with_views("preds") + """
SELECT example_id, fold, round(1.0 / count(*) OVER (PARTITION BY y_true), 12) AS weight FROM preds WHERE y_true IS NOT NULL""")
def q_g19i(spark, d):
    """The sampler's weight 1 / count(class) of every row."""
    w = G.class_weights(_preds(spark, d).filter(F.col("y_true").isNotNull()), mode="inverse")
    return w.select("example_id", "fold", F.round("weight", 12).alias("weight"))
