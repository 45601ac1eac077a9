"""Registered masking queries (M*) with oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqforge.functions import scalar as S
from seqforge.functions.alphabet import RESIDUES, SPECIALS
from seqforge.operators import corpus as T
from seqforge.operators import masking as M
from seqforge.plans import views as V
from seqforge.plans.registry import register

W = 510  # structure window; ids add [CLS] and [SEP] -> 512
_IDX = "[" + ", ".join(f"'{t}'" for t in list(RESIDUES) + SPECIALS) + "]"
_STARTS = (f"CASE WHEN length(sequence) <= {W} THEN [0] ELSE list_concat(range(0, length(sequence) - {W} + 1, {W // 2}), "
           f"CASE WHEN (length(sequence) - {W}) % {W // 2} <> 0 THEN [length(sequence) - {W}] ELSE [] END) END")
_ENC_SQL = [
    ("w", f"SELECT doc_id, CAST(k AS INTEGER) AS k, substr(sequence, CAST(st AS INTEGER) + 1, {W}) AS win, "
          f"substr(ss, CAST(st AS INTEGER) + 1, {W}) AS ssw FROM (SELECT *, unnest({_STARTS}) AS st, "
          f"unnest(range(0, len({_STARTS}))) AS k FROM seqs_ss WHERE regexp_full_match(sequence, '[{RESIDUES}]+'))"),
    ("e", f"SELECT doc_id, k, ssw, CAST(doc_id AS VARCHAR) || '/' || CAST(k AS VARCHAR) AS rk, "
          f"list_resize(list_concat([24], list_transform(string_split(win, ''), "
          f"lambda c: coalesce(list_position({_IDX}, c) - 1, 22)), [23]), 512, 20) AS ids FROM w"),
]


_RS = "CAST(('0x' || substr(md5(concat_ws(':', '0', rk)), 1, 8)) AS BIGINT)"


def _mix(i, purpose, rs=_RS):
    x = f"(({rs} + CAST({i} AS BIGINT) * 40503 + {purpose * 1000003}) % 4294967296)"
    for _ in range(2):
        x = f"((xor({x}, {x} >> 16) * 73244475) % 4294967296)"
    return f"xor({x}, {x} >> 16)"


def _u(purpose, i="i - 1"):
    return f"({_mix(i, purpose)} / 4294967296.0)"


def _encoded(spark, d):
    s = V.seqs_ss(spark, d).filter(S.is_valid_sequence("sequence"))
    w = T.paired_windows(s, W)
    return T.encode_letters(w.withColumnRenamed("ss_window", "ssw"), "window", W + 2, ["doc_id", "k", "ssw"], "ids")


def _key():
    return M.row_key("doc_id", "k")


_SEL = f"(x NOT IN (24, 23, 20) AND {_u(1)} < 0.15)"


@register("m1_mask_uniform", sql=V.with_views("seqs_ss", extra=_ENC_SQL) + f"""
SELECT doc_id, k,
  array_to_string(list_transform(ids, lambda x, i: CASE WHEN NOT {_SEL} THEN x WHEN {_u(2)} < 0.8 THEN 21
     WHEN {_u(2)} < 0.9 THEN CAST(floor({_u(3)} * 25) AS INTEGER) ELSE x END), ',') AS masked_ids,
  array_to_string(list_transform(ids, lambda x, i: CASE WHEN {_SEL} THEN x ELSE -100 END), ',') AS labels
FROM e""")
def q_m1(spark, d):
    """M1: 15% uniform masking (80/10/10) of the encoded structure windows."""
    m = M.mask_uniform(_encoded(spark, d), "ids", ["doc_id", "k"], p=0.15, seed=0)
    return m.select("doc_id", "k", F.array_join("masked_ids", ",").alias("masked_ids"),
                    F.array_join("labels", ",").alias("labels"))


def _tag_sql(tag, rate):
    srt = f"list_sort(list_filter(items, lambda x: x.tag = '{tag}'))"
    k = f"CAST(floor(len(list_filter(items, lambda x: x.tag = '{tag}')) * {rate}) AS INTEGER)"
    return f"list_transform({srt}[1:{k}], lambda x: x.pos)"


_M2_SQL = _ENC_SQL + [
    ("it", "SELECT *, list_transform(string_split(ssw, '')[1:len(ids)], lambda c, i: {'h': " + _mix("i - 1", 4) +
           ", 'pos': i, 'tag': c}) AS items FROM e"),
    ("mp", f"SELECT *, list_sort(list_filter(list_concat({_tag_sql('C', 0.4)}, {_tag_sql('H', 0.15)}, {_tag_sql('E', 0.15)}), "
           f"lambda q: q < len(ids))) AS mask_pos FROM it"),
]


@register("m2_mask_by_structure", sql=V.with_views("seqs_ss", extra=_M2_SQL) +
          "SELECT doc_id, k, array_to_string(list_sort(mask_pos), ',') AS mask_pos, CAST(len(mask_pos) AS INTEGER) AS n_masked FROM mp")
def q_m2(spark, d):
    """M2: exactly floor(n_tag * rate) positions per structure tag (C .4, H .15, E .15)."""
    m = M.mask_by_structure(_encoded(spark, d), "ids", "ssw", ["doc_id", "k"], seed=0)
    return m.select("doc_id", "k", F.array_join("mask_pos", ",").alias("mask_pos"),
                    F.size("mask_pos").alias("n_masked"))


def _m3_sql(mode):
    if mode == "80_10_10":
        v = (f"CASE WHEN {_u(5)} < 0.8 THEN 21 WHEN {_u(5)} < 0.9 THEN "
             f"CAST(floor({_u(3)} * 25) AS INTEGER) ELSE x END")
    else:
        v = (f"CASE WHEN {_u(6)} < 0.5 THEN CAST(floor({_u(3)} * 25) AS INTEGER) "
             f"WHEN {_u(5)} < 0.8 THEN 21 ELSE x END")
    return (V.with_views("seqs_ss", extra=_M2_SQL) + f"""
SELECT doc_id, k, array_to_string(list_transform(ids, lambda x, i: CASE WHEN list_contains(mask_pos, i - 1) THEN {v}
  ELSE x END), ',') AS masked_ids,
  array_to_string(list_transform(ids, lambda x, i: CASE WHEN list_contains(mask_pos, i - 1) THEN x ELSE -100 END), ',') AS labels
FROM mp""")


def _m3(spark, d, mode):
    m = M.mask_by_structure(_encoded(spark, d), "ids", "ssw", ["doc_id", "k"], seed=0, carry=True)
    return M.corrupt(m, "ids", "mask", ["doc_id", "k"], seed=0, mode=mode, sep=",")


@register("m3_corrupt_80_10_10", sql=_m3_sql("80_10_10"))
def q_m3(spark, d):
    """M3: structure mask applied 80/10/10."""
    return _m3(spark, d, "80_10_10")


@register("m3_corrupt_as_reference", sql=_m3_sql("as_reference"))
def q_m3r(spark, d):
    """M3: structure mask applied as the reference does (40/50/10)."""
    return _m3(spark, d, "as_reference")


@register("m4_mask_report", sql=V.with_views("seqs_ss", extra=_M2_SQL) + """
SELECT tag, count(*) AS total, count(*) FILTER (WHERE list_contains(mask_pos, i + 1)) AS masked,
       round(count(*) FILTER (WHERE list_contains(mask_pos, i + 1)) / count(*), 6) AS rate
FROM (SELECT mask_pos, unnest(string_split(ssw, '')[1:len(ids)]) AS tag,
             unnest(range(0, len(string_split(ssw, '')[1:len(ids)]))) AS i FROM mp) GROUP BY tag""")
def q_m4(spark, d):
    """M4: per structure tag, positions, masked positions and rate."""
    m = M.mask_by_structure(_encoded(spark, d), "ids", "ssw", ["doc_id", "k"], seed=0, carry=True)
    r = M.mask_report(m, "ssw", "mask")
    return r.withColumn("rate", F.round("rate", 6))
