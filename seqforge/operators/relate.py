"""Joins, set operations and dedupe (J1-J9).  Catalyst picks the join
strategy; AQE broadcasts a side only when its measured size is under
``spark.sql.autoBroadcastJoinThreshold``.  Explicit ``broadcast`` is used
only for tables bounded by an alphabet."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from seqforge.functions.scalar import strip

from seqforge.functions.scalar import normalize_allele, normalize_peptide, split_multi
from seqforge.operators.ranking import running


def _nospace_upper(c):
    return F.replace(F.upper(strip(F.coalesce(c, F.lit("")))), F.lit(" "), F.lit(""))


# J1 ------------------------------------------------------------------------
def allele_reference(ref: DataFrame, allele: str, seq: str, order: str) -> DataFrame:
    """Lookup table ``(key, seq)``: every reference row is keyed by its raw
    upper-case name and by its normalised name; for a key given several
    times the later row (by ``order``; the normalised key after the raw one
    within a row) wins.  Rows with a blank name or sequence are skipped."""
    r = ref.select(strip(F.col(allele)).alias("_a"), strip(F.col(seq)).alias("_s"), F.col(order).alias("_o")) \
           .filter((F.length("_a") > 0) & (F.length("_s") > 0))
    keys = r.select(_nospace_upper(F.col("_a")).alias("key"), "_s", "_o", F.lit(0).alias("_k")) \
            .unionByName(r.select(_nospace_upper(normalize_allele(F.col("_a"))).alias("key"), "_s", "_o",
                                  F.lit(1).alias("_k")))
    keys = keys.filter(F.length("key") > 0)
    return keys.groupBy("key").agg(F.max_by("_s", F.struct("_o", "_k")).alias("seq"))


def lookup_alleles(df: DataFrame, key_cols: list[str], cell: str, lookup: DataFrame):
    """Split each allele cell (P12), look every allele up by its raw
    upper-case name, then by its normalised name; hits are joined with
    ``;`` in cell order (``''`` when none).  Returns ``(joined, unmatched)``:
    ``joined`` adds ``hla_sequence``; ``unmatched`` lists the distinct
    alleles without a hit, sorted."""
    parts = df.select(*key_cols, F.posexplode(split_multi(F.col(cell))).alias("_p", "_allele"))
    parts = parts.withColumn("_k1", _nospace_upper(F.col("_allele"))) \
                 .withColumn("_k2", _nospace_upper(normalize_allele(F.col("_allele"))))
    l1 = lookup.select(F.col("key").alias("_k1"), F.col("seq").alias("_h1"))
    l2 = lookup.select(F.col("key").alias("_k2"), F.col("seq").alias("_h2"))
    hits = parts.join(l1, "_k1", "left").join(l2, "_k2", "left") \
                .withColumn("_hit", F.coalesce("_h1", "_h2"))
    per_row = hits.groupBy(*key_cols).agg(
        F.sort_array(F.collect_list(F.struct("_p", "_hit"))).alias("_h"))
    joined_seq = per_row.select(*key_cols, F.array_join(
        F.filter(F.transform("_h", lambda x: x["_hit"]), lambda s: s.isNotNull() & (s != "")), ";")
        .alias("hla_sequence"))
    joined = df.join(joined_seq, key_cols, "left").withColumn(
        "hla_sequence", F.coalesce("hla_sequence", F.lit("")))
    unmatched = hits.filter(F.col("_hit").isNull()).select(F.col("_allele").alias("allele")).distinct()
    return joined, unmatched.orderBy("allele")


# J2 ------------------------------------------------------------------------
def _prepared_pairs(df: DataFrame, pep: str, hla: str) -> DataFrame:
    return (df.select(normalize_peptide(F.col(pep)).alias(pep), F.explode_outer(split_multi(F.col(hla))).alias(hla))
              .withColumn(hla, strip(F.coalesce(F.col(hla), F.lit(""))))
              .filter((F.col(pep) != "") & (F.col(hla) != "")).distinct())


def pair_intersection(a: DataFrame, b: DataFrame, pep: str, hla: str) -> DataFrame:
    """Distinct (peptide, allele-sequence) pairs present in both tables after
    normalising peptides and splitting multi-valued cells."""
    return _prepared_pairs(a, pep, hla).join(_prepared_pairs(b, pep, hla), [pep, hla], "inner").distinct()


# J3 ------------------------------------------------------------------------
def pair_label_compare(a: DataFrame, b: DataFrame, pep: str, hla: str, label: str = "label") -> DataFrame:
    """Inner join on both keys keeping both labels; duplicates are kept
    (m x n rows for a key with m and n rows).  Peptides are upper-cased and
    trimmed, sequences trimmed, on both sides."""
    def prep(df, out):
        return df.select(F.upper(strip(F.col(pep))).alias(pep), strip(F.col(hla)).alias(hla),
                         F.col(label).alias(out))
    return prep(a, "label_A").join(prep(b, "label_B"), [pep, hla], "inner")


# J4 ------------------------------------------------------------------------
def dedupe_pairs(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Keep the first row (smallest ``order``, ties broken by the rest of the
    row, so the pick is deterministic) per normalised key.  A ``min`` over
    a struct: partial aggregation map-side, so a hot key never sits whole
    in one task."""
    d = df.select(*[F.upper(strip(F.col(k))).alias(k) if i == 0 else strip(F.col(k)).alias(k)
                    for i, k in enumerate(keys)],
                  F.struct(*[c for c in df.columns if c not in keys]).alias("_row"), F.col(order).alias("_o"))
    first = d.groupBy(*keys).agg(F.min(F.struct("_o", "_row")).alias("_m"))
    return first.select(*keys, "_m._row.*")


def observed_dedupe(df: DataFrame, keys: list[str], order: str) -> tuple[DataFrame, Observation, Observation]:
    """J4 with its report: after the result is written, the observations have
    the rows ``before`` (all, and with a blank key) and ``after``, counted in
    the same pass."""
    before, after = Observation("before"), Observation("after")
    blank = F.lit(False)
    for k in keys:
        blank = blank | F.coalesce(F.length(strip(F.col(k))) == 0, F.lit(True))
    d = df.observe(before, F.count(F.lit(1)).alias("rows"), F.count_if(blank).alias("blank_keys"))
    return dedupe_pairs(d, keys, order).observe(after, F.count(F.lit(1)).alias("rows")), before, after


# J5 ------------------------------------------------------------------------
def zip_by_position(a: DataFrame, b: DataFrame, order_a: str, order_b: str) -> DataFrame:
    """Record i of ``a`` with record i of ``b`` (positions by the given
    orders), stopping at the shorter; positions come from range-bucketed
    running counts, then an equi-join on the position."""
    def pos(df, order, p):
        r = running(df.withColumn("_one", F.lit(1)), [], [F.col(order)], sums=("_one",))
        return r.select(F.col("cum__one").alias("position"),
                        *[F.col(c).alias(f"{p}{c}") for c in df.columns])
    return pos(a, order_a, "a_").join(pos(b, order_b, "b_"), "position", "inner")


def zip_report(zipped: DataFrame, id_a: str = "a_id", id_b: str = "b_id", text_a: str | None = None,
               text_b: str | None = None) -> tuple[DataFrame, Observation]:
    """J5's pairs with ``id_mismatch`` and, given two texts, ``length_mismatch``
    (null-safe); the observation counts pairs and mismatches in the pass
    that writes them."""
    seen = Observation("zipped")
    out = zipped.withColumn("id_mismatch", ~F.col(id_a).eqNullSafe(F.col(id_b)))
    flags = ["id_mismatch"]
    if text_a and text_b:
        out = out.withColumn("length_mismatch", ~F.length(text_a).eqNullSafe(F.length(text_b)))
        flags.append("length_mismatch")
    return out.observe(seen, F.count(F.lit(1)).alias("pairs"), *[F.count_if(F.col(c)).alias(c) for c in flags]), seen


# J6 ------------------------------------------------------------------------
def apply_on_distinct(df: DataFrame, key: str, fn: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Compute ``fn`` once per distinct ``key`` value and join the result
    back to every row (``fn`` receives a one-column DataFrame)."""
    out = fn(df.select(key).distinct())
    return df.join(out, key, "left")


# J7 ------------------------------------------------------------------------
def union_labelled(pos: DataFrame, neg: DataFrame, label: str = "label") -> DataFrame:
    """Positives labelled 1 and negatives 0; when the column sets differ only
    the common columns are kept, in sorted order."""
    if set(pos.columns) != set(neg.columns):
        common = sorted(set(pos.columns) & set(neg.columns))
        pos, neg = pos.select(*common), neg.select(*common)
    return pos.withColumn(label, F.lit(1)).unionByName(neg.select(*pos.columns).withColumn(label, F.lit(0)))


# J8 ------------------------------------------------------------------------
def keep_groups(df: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(groups.select(*keys), keys, "left_semi")


def drop_rows(df: DataFrame, sample: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(sample.select(*keys), keys, "left_anti")


# J9 ------------------------------------------------------------------------
def drop_missing_sequence(df: DataFrame, col: str, label: int | None = None, label_col: str = "label"):
    """Drop rows with a null or blank looked-up sequence; optionally attach
    a constant label."""
    out = df.filter(F.col(col).isNotNull() & (F.length(strip(F.col(col))) > 0))
    return out.withColumn(label_col, F.lit(label)) if label is not None else out
