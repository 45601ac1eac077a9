"""Registered join / set / dedupe queries (J*) with oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqforge.operators import relate as J
from seqforge.operators import splits as X
from seqforge.plans import views as V
from seqforge.plans.q_clean import _ALLELE_RAW_SQL, _allele_raw_spark, allele_sql
from seqforge.plans.registry import register


def _ref(spark, d):
    """Allele reference derived from ``part``: name ``HLA-X*NN:NN`` (some in
    short or padded forms) -> pseudo-sequence from the part name."""
    p = V.table(spark, d, "part")
    loc = F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("C")), (F.col("p_partkey") % 3 + 1).cast("int"))
    a = F.lpad((F.col("p_size") % 100).cast("string"), 2, "0")
    b = F.lpad((F.col("p_partkey") % 100).cast("string"), 2, "0")
    name = F.when(F.col("p_partkey") % 4 == 0, F.concat(loc, a, b)) \
            .otherwise(F.concat(F.lit("HLA-"), loc, F.lit("*"), a, F.lit(":"), b))
    return p.select(name.alias("allele"), F.upper(F.replace("p_name", F.lit(" "), F.lit(""))).alias("seq"),
                    F.col("p_partkey").alias("ord"))


_REF_SQL = """SELECT CASE WHEN p_partkey % 4 = 0 THEN loc || a || b ELSE 'HLA-' || loc || '*' || a || ':' || b END AS allele,
  upper(replace(p_name, ' ', '')) AS seq, p_partkey AS ord FROM (
  SELECT *, ['A', 'B', 'C'][p_partkey % 3 + 1] AS loc, lpad(CAST(p_size % 100 AS VARCHAR), 2, '0') AS a,
         lpad(CAST(p_partkey % 100 AS VARCHAR), 2, '0') AS b FROM part)"""


def _cells(spark, d):
    p = V.table(spark, d, "part")
    return p.select("p_partkey", F.concat_ws(";", _allele_raw_spark(None), F.concat(
        F.lit("HLA-B*"), F.lpad((F.col("p_size") % 100).cast("string"), 2, "0"), F.lit(":01"))).alias("cell"))


_LOOKUP_SQL = [
    ("ref", _REF_SQL),
    ("r", "SELECT trim(allele) AS a, trim(seq) AS s, ord FROM ref WHERE length(trim(allele)) > 0 AND length(trim(seq)) > 0"),
    ("keys", f"SELECT upper(replace(trim(a), ' ', '')) AS key, s, ord, 0 AS sub FROM r UNION ALL "
             f"SELECT upper(replace(trim({allele_sql('a')}), ' ', '')) AS key, s, ord, 1 AS sub FROM r"),
    ("lk", "SELECT key, arg_max(s, ord * 2 + sub) AS seq FROM keys WHERE length(key) > 0 GROUP BY key"),
    ("cells", f"SELECT p_partkey, concat_ws(';', {_ALLELE_RAW_SQL}, 'HLA-B*' || lpad(CAST(p_size % 100 AS VARCHAR), 2, '0') || ':01') AS cell FROM part"),
    ("parts", "SELECT p_partkey, generate_subscripts(al, 1) AS pos, unnest(al) AS allele FROM ("
              "SELECT p_partkey, list_filter(regexp_split_to_array(trim(cell), '[;,|/]+|\\s+'), lambda x: x <> '') AS al FROM cells)"),
    ("hits", f"SELECT parts.*, coalesce(l1.seq, l2.seq) AS hit FROM parts "
             f"LEFT JOIN lk l1 ON l1.key = upper(replace(trim(allele), ' ', '')) "
             f"LEFT JOIN lk l2 ON l2.key = upper(replace(trim({allele_sql('allele')}), ' ', ''))"),
]


@register("j1_lookup_alleles", sql=V.with_views(extra=_LOOKUP_SQL) + """
SELECT c.p_partkey, coalesce(string_agg(h.hit, ';' ORDER BY h.pos) FILTER (WHERE h.hit IS NOT NULL AND h.hit <> ''), '')
       AS hla_sequence
FROM cells c LEFT JOIN hits h USING (p_partkey) GROUP BY c.p_partkey""")
def q_j1(spark, d):
    """Allele cells looked up (raw name, then normalised) and re-joined."""
    lk = J.allele_reference(_ref(spark, d), "allele", "seq", "ord")
    joined, _ = J.lookup_alleles(_cells(spark, d), ["p_partkey"], "cell", lk)
    return joined.select("p_partkey", "hla_sequence")


@register("j1_unmatched_alleles", sql=V.with_views(extra=_LOOKUP_SQL) +
          "SELECT DISTINCT allele FROM hits WHERE hit IS NULL")
def q_j1u(spark, d):
    """Distinct alleles without a reference hit."""
    lk = J.allele_reference(_ref(spark, d), "allele", "seq", "ord")
    return J.lookup_alleles(_cells(spark, d), ["p_partkey"], "cell", lk)[1]


def _li_pairs(spark, d):
    li = V.table(spark, d, "lineitem")
    o = V.table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return li.join(o, li.l_orderkey == o.o_orderkey).select(
        F.concat(F.lit("a"), F.col("o_custkey").cast("string"), F.lit(" ")).alias("antigen"),
        F.concat(F.col("l_orderkey").cast("string"), F.lit(";"), (F.col("l_partkey") % 997).cast("string")).alias("tcr"),
        F.when(F.col("l_returnflag") == "R", "1").otherwise("0").alias("label"), "l_linenumber")


_LI_SQL = ("SELECT 'a' || CAST(o_custkey AS VARCHAR) || ' ' AS antigen, CAST(l_orderkey AS VARCHAR) || ';' || "
           "CAST(l_partkey % 997 AS VARCHAR) AS tcr, CASE WHEN l_returnflag = 'R' THEN '1' ELSE '0' END AS label, "
           "l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey")


def _prep_sql(src):
    return (f"SELECT DISTINCT antigen, tcr FROM (SELECT upper(replace(trim(coalesce(antigen, '')), ' ', '')) AS antigen, "
            f"trim(coalesce(unnest(CASE WHEN len(l) = 0 THEN [NULL] ELSE l END), '')) AS tcr FROM ("
            f"SELECT antigen, list_filter(regexp_split_to_array(trim(coalesce(tcr, '')), '[;,|/]+|\\s+'), lambda x: x <> '') AS l "
            f"FROM {src})) WHERE antigen <> '' AND tcr <> ''")


@register("j2_pair_intersection", sql=V.with_views("pairs", extra=[("li", _LI_SQL)]) +
          f"SELECT DISTINCT a.antigen, a.tcr FROM ({_prep_sql('pairs')}) a JOIN ({_prep_sql('li')}) b USING (antigen, tcr)")
def q_j2(spark, d):
    """(antigen, TCR) pairs present in both orders and line items."""
    return J.pair_intersection(V.pairs(spark, d), _li_pairs(spark, d), "antigen", "tcr")


@register("j3_pair_label_compare", sql=V.with_views("pairs", extra=[("li", _LI_SQL)]) + """
SELECT a.antigen, a.tcr, a.label AS label_A, b.label AS label_B FROM
  (SELECT upper(trim(antigen)) AS antigen, trim(tcr) AS tcr, label FROM pairs) a JOIN
  (SELECT upper(trim(antigen)) AS antigen, trim(split_part(tcr, ';', 1)) AS tcr, label FROM li) b USING (antigen, tcr)""")
def q_j3(spark, d):
    """Both labels of pairs found in both tables (duplicates kept)."""
    li = _li_pairs(spark, d).withColumn("tcr", F.split_part("tcr", F.lit(";"), F.lit(1)))
    return J.pair_label_compare(V.pairs(spark, d), li, "antigen", "tcr")


@register("j4_dedupe_pairs", sql=V.with_views(extra=[("li", _LI_SQL)]) + """
SELECT antigen, tcr, label, l_linenumber FROM (
  SELECT *, row_number() OVER (PARTITION BY antigen, tcr ORDER BY l_linenumber, label) AS rn FROM (
    SELECT upper(trim(antigen)) AS antigen, trim(split_part(tcr, ';', 1)) AS tcr, label, l_linenumber FROM li))
WHERE rn = 1""")
def q_j4(spark, d):
    """First line item per (antigen, order) pair."""
    li = _li_pairs(spark, d).withColumn("tcr", F.split_part("tcr", F.lit(";"), F.lit(1)))
    return J.dedupe_pairs(li, ["antigen", "tcr"], "l_linenumber")


@register("j5_zip_by_position", sql=V.with_views("seqs_ss") + """
SELECT a.position, a.doc_id AS a_doc_id, b.doc_id AS b_doc_id, a.doc_id <> b.doc_id AS id_mismatch,
       length(a.sequence) <> length(b.ss) AS length_mismatch FROM
  (SELECT row_number() OVER (ORDER BY doc_id) AS position, doc_id, sequence FROM seqs_ss) a JOIN
  (SELECT row_number() OVER (ORDER BY doc_id) AS position, doc_id, ss FROM seqs_ss WHERE label IS NOT NULL) b
  USING (position)""")
def q_j5(spark, d):
    """All sequences zipped by position with the labelled structures."""
    s = V.seqs_ss(spark, d)
    z = J.zip_by_position(s.select("doc_id", "sequence"), s.filter("label IS NOT NULL").select("doc_id", "ss"),
                          "doc_id", "doc_id")
    return z.select("position", "a_doc_id", "b_doc_id", (F.col("a_doc_id") != F.col("b_doc_id")).alias("id_mismatch"),
                    (F.length("a_sequence") != F.length("b_ss")).alias("length_mismatch"))


@register("j6_apply_on_distinct", sql=V.with_views("pairs") + """
SELECT row_key, antigen, md5(antigen) AS antigen_md5 FROM pairs""")
def q_j6(spark, d):
    """A per-antigen function computed once per distinct antigen."""
    p = V.pairs(spark, d).select("row_key", "antigen")
    return J.apply_on_distinct(p, "antigen", lambda u: u.withColumn("antigen_md5", F.md5("antigen")))


@register("j7_union_labelled", sql=V.with_views("seqs") + """
SELECT doc_id, species, 1 AS label FROM seqs WHERE label = 1 UNION ALL
SELECT doc_id, species, 0 AS label FROM seqs WHERE label = 0""")
def q_j7(spark, d):
    """Positives and negatives with different extra columns, common columns kept."""
    s = V.seqs(spark, d)
    pos = s.filter("label = 1").select("species", "doc_id", F.length("sequence").alias("n"))
    neg = s.filter("label = 0").select("doc_id", "species")
    return J.union_labelled(pos, neg)


@register("j8_keep_groups", sql=V.with_views("pairs", extra=[
    ("t", "SELECT antigen FROM pairs GROUP BY antigen HAVING count(*) FILTER (WHERE label IS NOT NULL AND lower(label) <> 'unknown') >= 15")]) +
    "SELECT row_key FROM pairs WHERE antigen IN (SELECT antigen FROM t)")
def q_j8(spark, d):
    """Rows of majority-tier antigens (left semi join)."""
    p = V.pairs(spark, d)
    maj = X.tier_groups(p, "antigen", "label", n_min=5, n_major=15).filter("tier = 'majority'")
    return J.keep_groups(p, maj, ["antigen"]).select("row_key")


@register("j8_drop_rows", sql=V.with_views("pairs") + f"""
SELECT row_key FROM pairs WHERE row_key NOT IN (
  SELECT row_key FROM (SELECT row_key, row_number() OVER (PARTITION BY label ORDER BY
     md5(concat_ws(':', '42', CAST(row_key AS VARCHAR))), row_key) AS rk FROM pairs)
  WHERE rk <= (SELECT min(n) FROM (SELECT count(*) AS n FROM pairs GROUP BY label)))""")
def q_j8d(spark, d):
    """Rows not drawn by the class-balanced sample (left anti join)."""
    p = V.pairs(spark, d)
    return J.drop_rows(p, X.balance_downsample(p, "label", ["row_key"]), ["row_key"]).select("row_key")


@register("j9_drop_missing_sequence", sql=V.with_views(extra=_LOOKUP_SQL + [
    ("joined", "SELECT c.p_partkey, coalesce(string_agg(h.hit, ';' ORDER BY h.pos) FILTER (WHERE h.hit IS NOT NULL AND h.hit <> ''), '') "
               "AS hla_sequence FROM cells c LEFT JOIN hits h USING (p_partkey) GROUP BY c.p_partkey")]) +
    "SELECT p_partkey, hla_sequence, 1 AS label FROM joined WHERE hla_sequence IS NOT NULL AND length(trim(hla_sequence)) > 0")
def q_j9(spark, d):
    """Looked-up rows with a sequence, labelled 1."""
    lk = J.allele_reference(_ref(spark, d), "allele", "seq", "ord")
    joined, _ = J.lookup_alleles(_cells(spark, d), ["p_partkey"], "cell", lk)
    return J.drop_missing_sequence(joined.select("p_partkey", "hla_sequence"), "hla_sequence", label=1)
