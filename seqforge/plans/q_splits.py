"""Registered split / sampling queries (X*) with oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqforge.operators import splits as X
from seqforge.operators.metrics import class_weights
from seqforge.operators.ranking import hash_key_sql as hk
from seqforge.plans import views as V
from seqforge.plans.registry import register


def _rn(part: str, seed, keys: str) -> str:
    p = f"PARTITION BY {part} " if part else ""
    return f"row_number() OVER ({p}ORDER BY {hk(seed, keys)}, {keys})"


def _pairs(spark, d):
    return V.pairs(spark, d)


def _labelled_pairs(spark, d):
    return V.pairs(spark, d).filter(F.col("label").isin("0", "1"))


@register("x1_split_fraction", sql=V.with_views("seqs") + f"""
SELECT doc_id, CASE WHEN rk <= n - nv - nt THEN 'train' WHEN rk <= n - nt THEN 'valid'
       ELSE 'test' END AS split
FROM (SELECT doc_id, {_rn('', 1234, 'doc_id')} AS rk, count(*) OVER () AS n,
             CAST(round_even(count(*) OVER () * 0.15, 0) AS BIGINT) AS nv,
             CAST(round_even(count(*) OVER () * 0.15, 0) AS BIGINT) AS nt FROM seqs)""")
def q_x1(spark, d):
    """70/15/15 train/valid/test in md5 order."""
    return X.split_fraction(V.seqs(spark, d), ["doc_id"]).select("doc_id", "split")


_X2_SQL = V.with_views("seqs") + f"""
, s AS (SELECT doc_id, CASE WHEN length(sequence) <= 512 THEN 1
          ELSE (length(sequence) - 512) // 256 + 1
               + CASE WHEN (length(sequence) - 512) % 256 <> 0 THEN 1 ELSE 0 END END AS nw,
          {hk(42, 'doc_id')} AS h FROM seqs),
c AS (SELECT doc_id, nw, sum(nw) OVER (ORDER BY h, doc_id ROWS UNBOUNDED PRECEDING) - nw AS first,
        sum(nw) OVER () AS tot FROM s)
SELECT doc_id, CAST(k AS INTEGER) AS k,
       CASE WHEN {{pos}} < floor(tot * 0.99) THEN 'train' ELSE 'test' END AS split
FROM c, range(0, c.nw) t(k)"""


@register("x2_split_prefix_grouped", sql=_X2_SQL.replace("{pos}", "first"))
def q_x2g(spark, d):
    """X2 (grouped): a sequence's windows stay on one side of the cut."""
    return X.split_prefix(V.seqs(spark, d), ["doc_id"], 512).select("doc_id", "k", "split")


@register("x2_split_prefix_as_reference", sql=_X2_SQL.replace("{pos}", "first + k"))
def q_x2r(spark, d):
    """X2 (as_reference): cut the window list, sequences may straddle."""
    return X.split_prefix(V.seqs(spark, d), ["doc_id"], 512, mode="as_reference") \
            .select("doc_id", "k", "split")


@register("x3_split_stratified", sql=V.with_views("pairs") + f"""
SELECT row_key, label, CASE WHEN {_rn('label', 42, 'row_key')} <= round_even(count(*) OVER (PARTITION BY label) * 0.2, 0)
       THEN 'test' ELSE 'train' END AS split FROM pairs""")
def q_x3(spark, d):
    """Per-class 20% holdout."""
    return X.split_stratified(_pairs(spark, d), "label", ["row_key"]).select("row_key", "label", "split")


@register("x4_balance_downsample", sql=V.with_views("pairs") + f"""
SELECT row_key, label FROM (
  SELECT row_key, label, {_rn('label', 42, 'row_key')} AS rk FROM pairs)
WHERE rk <= (SELECT min(n) FROM (SELECT count(*) AS n FROM pairs GROUP BY label))""")
def q_x4(spark, d):
    """Every class down to the smallest class."""
    return X.balance_downsample(_pairs(spark, d), "label", ["row_key"]).select("row_key", "label")


_LP = "SELECT * FROM pairs WHERE label IN ('0', '1')"


@register("x5_stratified_kfold", sql=V.with_views("pairs", extra=[("lp", _LP)]) + f"""
SELECT row_key, CAST((({_rn('label', 42, 'row_key')}) - 1) % 5 + 1 AS INTEGER) AS fold FROM lp""")
def q_x5(spark, d):
    """Stratified 5-fold assignment of the labelled pairs."""
    return X.stratified_kfold(_labelled_pairs(spark, d), "label", ["row_key"],
                              required=["antigen", "tcr", "label"]).select("row_key", "fold")


@register("x5_fold_summary", sql=V.with_views("pairs", extra=[("lp", _LP)]) + f"""
, f AS (SELECT label, CAST((({_rn('label', 42, 'row_key')}) - 1) % 5 + 1 AS INTEGER) AS fold FROM lp),
p AS (SELECT fold, label, count(*) AS n_test FROM f GROUP BY fold, label)
SELECT fold, label, n_test, CAST(sum(n_test) OVER (PARTITION BY label) - n_test AS BIGINT) AS n_train FROM p""")
def q_x5s(spark, d):
    """X5 summary: test/train sizes per fold and class."""
    f = X.stratified_kfold(_labelled_pairs(spark, d), "label", ["row_key"])
    return X.fold_summary(f, "label")


@register("x6_leave_one_group_out", sql=V.with_views("seqs") + """
, g AS (SELECT species, count(*) AS n, count(*) FILTER (WHERE label = 1) AS n_pos FROM seqs GROUP BY species)
SELECT species AS held_out, n AS n_test, n_pos AS n_test_pos,
       CAST(sum(n) OVER () - n AS BIGINT) AS n_train, CAST(sum(n_pos) OVER () - n_pos AS BIGINT) AS n_train_pos
FROM g""")
def q_x6(spark, d):
    """Per held-out species, sizes and positives of test and train."""
    return X.leave_one_group_out_summary(V.seqs(spark, d), "species", "label")


@register("x7_split_within_group", sql=V.with_views("pairs") + f"""
SELECT row_key, CASE WHEN {_rn('antigen', 22, 'row_key')} <= round_even(count(*) OVER (PARTITION BY antigen) * 0.8, 0)
       THEN 'train' ELSE 'test' END AS split FROM pairs""")
def q_x7(spark, d):
    """Per antigen, 80/20 train/test."""
    return X.split_within_group(_pairs(spark, d), "antigen", ["row_key"]).select("row_key", "split")


_TIER_SQL = """SELECT antigen, count(*) FILTER (WHERE label IS NOT NULL AND lower(label) <> 'unknown') AS n_labeled
FROM pairs GROUP BY antigen"""
_TIER_CASE = ("CASE WHEN n_labeled >= 15 THEN 'majority' WHEN n_labeled >= 5 THEN 'backbone' "
              "WHEN n_labeled >= 1 THEN 'zero_shot' ELSE 'unlabelled' END")


@register("x8_tier_groups", sql=V.with_views("pairs", extra=[("t", _TIER_SQL)]) +
          f"SELECT antigen, n_labeled, {_TIER_CASE} AS tier FROM t")
def q_x8(spark, d):
    """Antigen tiers by labelled rows (thresholds 15 / 5)."""
    return X.tier_groups(_pairs(spark, d), "antigen", "label", n_min=5, n_major=15)


@register("x9_few_shot_split", sql=V.with_views("pairs", extra=[("t", _TIER_SQL)]) + f"""
, z AS (SELECT p.*, (p.label IS NOT NULL AND lower(p.label) <> 'unknown') AS lab FROM pairs p
        JOIN t USING (antigen) WHERE {_TIER_CASE} = 'zero_shot')
SELECT row_key, antigen, CASE WHEN lab AND {_rn('antigen, lab', 22, 'row_key')} <= 2 THEN 'support'
       ELSE 'query' END AS split FROM z""")
def q_x9(spark, d):
    """Few-shot support (2 labelled rows) / query over zero-shot antigens."""
    p = _pairs(spark, d)
    zs = X.tier_groups(p, "antigen", "label", n_min=5, n_major=15).filter("tier = 'zero_shot'")
    z = p.join(zs.select("antigen"), "antigen", "left_semi")
    return X.few_shot_split(z, "antigen", "label", ["row_key"]).select("row_key", "antigen", "split")


@register("x10_split_val_ratio", sql=V.with_views("seqs", extra=[
    ("s", "SELECT * FROM seqs WHERE label IS NOT NULL"),
    ("c", "SELECT floor(count(*) FILTER (WHERE label = 1) * 0.15) AS vp, "
          "count(*) FILTER (WHERE label = 0) AS nn FROM s")]) + f"""
SELECT doc_id, CASE WHEN {_rn('label', 22, 'doc_id')} <=
   CASE WHEN label = 1 THEN (SELECT vp FROM c) WHEN label = 0 THEN (SELECT least(vp * 10, nn) FROM c) ELSE 0 END
   THEN 'val' ELSE 'train' END AS split FROM s""")
def q_x10(spark, d):
    """15% of positives and up to 10 negatives per positive to validation."""
    s = V.seqs(spark, d).filter(F.col("label").isNotNull())
    return X.split_val_ratio(s, "label", ["doc_id"]).select("doc_id", "split")


def _u_sql(seed, expr, part):
    return (f"CAST(('0x' || substr(md5(concat_ws(':', '{seed}', CAST({expr} AS VARCHAR), '{part}')), 1, 13))"
            f" AS BIGINT) / 4503599627370496.0")


@register("x11_sample_weighted", sql=V.with_views("seqs", extra=[
    ("s", "SELECT * FROM seqs WHERE label IS NOT NULL"),
    ("cls", "SELECT label, count(*) AS cn, row_number() OVER (ORDER BY label) - 1 AS ci FROM s GROUP BY label"),
    ("r", f"SELECT doc_id, label, {_rn('label', 42, 'doc_id')} AS rk FROM s"),
    ("dr", f"SELECT range AS draw, CAST(floor({_u_sql(42, 'range', 1)} * (SELECT count(*) FROM cls)) AS BIGINT) AS ci, "
           f"{_u_sql(42, 'range', 2)} AS u2 FROM range((SELECT count(*) FROM s))")]) + """
SELECT dr.draw, cls.label, r.doc_id FROM dr JOIN cls ON dr.ci = cls.ci
JOIN r ON r.label = cls.label AND r.rk = CAST(floor(dr.u2 * cls.cn) AS BIGINT) + 1""")
def q_x11(spark, d):
    """X11: class-balanced draws with replacement, as many as rows."""
    s = V.seqs(spark, d).filter(F.col("label").isNotNull())
    return X.sample_weighted(s, "label", ["doc_id"]).select("draw", "label", "doc_id")


@register("x12_shard_evenly", sql=V.with_views("seqs") + f"""
, r AS (SELECT doc_id, row_number() OVER (ORDER BY {hk('42:3', 'doc_id')}, doc_id) - 1 AS pos,
        count(*) OVER () AS n FROM seqs),
b AS (SELECT doc_id, pos FROM r UNION ALL
      SELECT doc_id, pos + n FROM r WHERE pos < CAST(ceil(n / 8.0) * 8 AS BIGINT) - n)
SELECT doc_id, pos, CAST(pos % 8 AS INTEGER) AS shard FROM b""")
def q_x12(spark, d):
    """8 equal shards for epoch 3, padded with the first rows."""
    return X.shard_evenly(V.seqs(spark, d), ["doc_id"], 8, epoch=3).select("doc_id", "pos", "shard")


@register("x13_shuffle", sql=V.with_views("seqs") +
          f"SELECT doc_id, {_rn('', 42, 'doc_id')} AS shuffle_rank FROM seqs")
def q_x13(spark, d):
    """Reproducible shuffle rank."""
    return X.shuffle(V.seqs(spark, d), ["doc_id"]).select("doc_id", "shuffle_rank")


@register("x14_split_overlap", sql=V.with_views("pairs") + f"""
, s AS (SELECT antigen, CASE WHEN {_rn('antigen', 22, 'row_key')} <= round_even(count(*) OVER (PARTITION BY antigen) * 0.8, 0)
       THEN 'train' ELSE 'test' END AS split FROM pairs)
SELECT antigen, array_to_string(list_sort(list(DISTINCT split)), ',') AS splits,
       CAST(count(DISTINCT split) AS INTEGER) AS n_splits
FROM s GROUP BY antigen HAVING count(DISTINCT split) > 1""")
def q_x14(spark, d):
    """Antigens present in both sides of the X7 split."""
    s = X.split_within_group(_pairs(spark, d), "antigen", ["row_key"])
    return X.split_overlap(s, ["antigen"])


@register("x15_take_first", sql=V.with_views("seqs") +
          "SELECT doc_id, species FROM seqs ORDER BY doc_id LIMIT 100")
def q_x15(spark, d):
    """The first 100 sequences by id (top-k with an explicit order)."""
    return X.take_first(V.seqs(spark, d), ["doc_id"], 100).select("doc_id", "species")


def _weighted_sql(view: str, weight: str, key: str, seed: int) -> list[tuple[str, str]]:
    """Rows on a line by whole units of weight, and the points of the draws."""
    def h(at):
        return f"CAST(('0x' || substr(md5(concat_ws(':', '{seed}', CAST(range AS VARCHAR))), {at}, 14)) AS BIGINT)::HUGEINT"
    return [
        ("wt", f"SELECT *, coalesce({weight}, 0) AS w FROM {view}"),
        ("un", f"SELECT *, CAST(ceil(w * ({X.WEIGHT_UNITS} / (SELECT max(w) FROM wt))) AS HUGEINT) AS u FROM wt"),
        ("ln", f"SELECT *, sum(u) OVER (ORDER BY {hk(seed, key)}, {key} ROWS UNBOUNDED PRECEDING)::HUGEINT - u AS at FROM un WHERE u > 0"),
        ("pt", f"SELECT range AS draw, ({h(1)} * 72057594037927936::HUGEINT + {h(15)}) % (SELECT sum(u)::HUGEINT FROM un) AS at "
               "FROM range((SELECT count(*) FROM wt))")]


@register("x11_sample_by_weight", sql=V.with_views("seqs", extra=_weighted_sql(
    "seqs", "CASE WHEN doc_id % 5 = 0 THEN 0.0 ELSE length(sequence) / (3.0 + doc_id % 11) END", "doc_id", 7)) + """
SELECT pt.draw, ln.doc_id, ln.w AS weight FROM pt ASOF JOIN ln ON pt.at >= ln.at""")
def q_x11w(spark, d):
    """X11: as many draws as rows by a weight per row (zero for every fifth)."""
    n = F.length("sequence") / (3.0 + F.col("doc_id") % 11)
    s = V.seqs(spark, d).select("doc_id", F.when(F.col("doc_id") % 5 == 0, 0.0).otherwise(n).alias("weight"))
    s = s.withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    return X.sample_by_weight(s, "weight", ["doc_id"], seed=7).select("draw", "doc_id", "weight")


@register("x11_class_weights", sql=V.with_views("seqs", extra=[
    ("lab", "SELECT doc_id, label FROM seqs WHERE label IS NOT NULL"),
    *_weighted_sql("lab", "1.0::DOUBLE / count(*) OVER (PARTITION BY label)", "doc_id", 42)]) + """
SELECT pt.draw, ln.doc_id, ln.label FROM pt ASOF JOIN ln ON pt.at >= ln.at""")
def q_x11c(spark, d):
    """X11 with G19's weights: the sampler that takes 1 / count(class) per row."""
    s = V.seqs(spark, d).select("doc_id", "label").filter(F.col("label").isNotNull())
    return X.sample_by_weight(class_weights(s, "label", "inverse"), "weight", ["doc_id"]).select("draw", "doc_id", "label")
