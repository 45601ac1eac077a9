"""Registered cleaning / scalar-rule queries (P*) with oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqforge.functions import scalar as S
from seqforge.functions.alphabet import GAP, RESIDUES
from seqforge.operators import clean as P
from seqforge.operators import corpus as T
from seqforge.plans import views as V
from seqforge.plans.registry import register

_VALID = f"regexp_full_match({{x}}, '[{RESIDUES}]+')"


def _raw_pairs(spark, d):
    o = V.table(spark, d, "orders")
    return o.select(F.concat(F.lit("A"), F.col("o_custkey").cast("string")).alias("Peptide"),
                    F.concat(F.lit(" "), F.col("o_orderkey").cast("string"), F.lit(" ")).alias("CDR3"),
                    F.col("o_orderstatus").alias("Label"), "o_totalprice")


@register("p1_normalize_columns", sql="""
SELECT 'A' || CAST(o_custkey AS VARCHAR) AS antigen, CAST(o_orderkey AS VARCHAR) AS TCR, o_orderstatus AS label
FROM orders""")
def q_p1(spark, d):
    """Aliases Peptide/CDR3/Label renamed, trimmed, projected."""
    return P.normalize_columns(_raw_pairs(spark, d))


@register("p2_rename_by_position", sql=V.with_views("pairs") +
          "SELECT row_key AS TCR, antigen, tcr AS peptide, label FROM pairs")
def q_p2(spark, d):
    """Columns 0, 2, 3 renamed by position."""
    return P.rename_by_position(V.pairs(spark, d), {0: "TCR", 2: "peptide", 3: "label"})


@register("p3_normalize_header", sql='SELECT p_partkey AS "Part Key", p_name AS "MHC Restriction Name" FROM part')
def q_p3(spark, d):
    """Header names trimmed with whitespace runs collapsed."""
    p = V.table(spark, d, "part").select(F.col("p_partkey").alias(" Part  Key"),
                                         F.col("p_name").alias("MHC Restriction\nName "))
    return P.normalize_header(p)


@register("p4_select_by_letter", sql="SELECT l_partkey, l_linenumber FROM lineitem")
def q_p4(spark, d):
    """Columns B and D of lineitem by spreadsheet letter."""
    return P.select_by_letter(V.table(spark, d, "lineitem"), ["B", "D"])


@register("p5_parse_label", sql=V.with_views("pairs") + """
SELECT row_key,
  CASE WHEN regexp_full_match(label, '[0-9]+') THEN coalesce(TRY_CAST(label AS BIGINT), 0) ELSE 0 END AS digits,
  CASE WHEN lower(trim(label)) IN ('0', '1') THEN CAST(lower(trim(label)) AS INTEGER) END AS strict01,
  (label IS NOT NULL AND lower(label) <> 'unknown') AS is_labeled,
  CASE WHEN TRY_CAST(label AS DOUBLE) > 1 THEN 1 ELSE 0 END AS gt1 FROM pairs""")
def q_p5(spark, d):
    """P5: the four label-parsing modes."""
    return V.pairs(spark, d).select("row_key", *[S.parse_label("label", m).alias(a) for m, a in (
        ("digits_else_zero", "digits"), ("strict01", "strict01"), ("is_labeled", "is_labeled"), ("gt1", "gt1"))])


@register("p6_label_from_id", sql=V.with_views("seqs") + """
SELECT doc_id, coalesce(TRY_CAST(split_part(species || '|' || coalesce(CAST(label AS VARCHAR), 'x') || '|'
       || CAST(doc_id AS VARCHAR), '|', 2) AS INTEGER), -1) AS label_id FROM seqs""")
def q_p6(spark, d):
    """Label from the second ``|`` field of a record id."""
    s = V.seqs(spark, d)
    rid = F.concat_ws("|", "species", F.coalesce(F.col("label").cast("string"), F.lit("x")), F.col("doc_id").cast("string"))
    return s.select("doc_id", S.label_from_id(rid).alias("label_id"))


@register("p7_is_valid_sequence", sql=f"""
SELECT doc_id, coalesce({_VALID.format(x="upper(regexp_replace(text, '[^A-Za-z]', '', 'g'))")}, false) AS valid,
       coalesce(regexp_full_match(upper(regexp_replace(text, '[^A-Za-z-]', '', 'g')), '[{RESIDUES}\\-]+'), false) AS valid_gap
FROM documents""")
def q_p7(spark, d):
    """Letters-only text that is a valid residue string (without / with gaps)."""
    t = V.table(spark, d, "documents")
    return t.select("doc_id", S.is_valid_sequence(F.upper(F.regexp_replace("text", "[^A-Za-z]", ""))).alias("valid"),
                    S.is_valid_sequence(F.upper(F.regexp_replace("text", "[^A-Za-z-]", "")), gap=True)
                    .alias("valid_gap"))


def _p8_input(spark, d):
    p = V.table(spark, d, "part")
    return p.select("p_partkey", F.upper(F.replace("p_name", F.lit(" "), F.lit(""))).alias("TCR"),
                    F.upper(F.replace(F.concat("p_name", "p_name", "p_name"), F.lit(" "), F.lit(""))).alias("peptide"))


_P8_TAG = f"""SELECT p_partkey, CASE WHEN NOT (coalesce({_VALID.format(x='tcr')}, false) AND coalesce({_VALID.format(x='pep')}, false))
  THEN 'invalid' WHEN greatest(length(tcr), length(pep)) > 34 THEN 'too_long' END AS reject_reason
FROM (SELECT p_partkey, trim(upper(replace(p_name, ' ', ''))) AS tcr,
             trim(upper(replace(p_name || p_name || p_name, ' ', ''))) AS pep FROM part)"""


@register("p8_clean_counts", sql=f"SELECT coalesce(reject_reason, 'kept') AS outcome, count(*) AS n FROM ({_P8_TAG}) GROUP BY 1")
def q_p8(spark, d):
    """Rows kept / rejected as invalid / rejected as too long."""
    return P.clean_with_rejects(_p8_input(spark, d), ["TCR", "peptide"])[2]


@register("p8_clean_rejects", sql=f"SELECT p_partkey, reject_reason FROM ({_P8_TAG}) WHERE reject_reason IS NOT NULL")
def q_p8r(spark, d):
    """The rejected rows with their reason."""
    return P.clean_with_rejects(_p8_input(spark, d), ["TCR", "peptide"])[1].select("p_partkey", "reject_reason")


@register("p9_drop_blank_keys", sql="""
SELECT conv_id, turn FROM conversations WHERE length(trim(role)) > 0 AND length(trim(text)) > 0""")
def q_p9(spark, d):
    """Conversation turns with a non-blank role and text."""
    return P.drop_blank_keys(V.table(spark, d, "conversations"), ["role", "text"]).select("conv_id", "turn")


@register("p10_normalize_peptide", sql="SELECT p_partkey, upper(replace(trim(coalesce(p_name, '')), ' ', '')) AS pep FROM part")
def q_p10(spark, d):
    """P10: peptides trimmed, upper-cased, without blanks."""
    return V.table(spark, d, "part").select("p_partkey", S.normalize_peptide("p_name").alias("pep"))


def _allele_raw_spark(p):
    a = F.lpad((F.col("p_size") % 100).cast("string"), 2, "0")
    b = F.lpad((F.col("p_partkey") % 100).cast("string"), 2, "0")
    c = (F.col("p_partkey") % 10).cast("string")
    k = F.col("p_partkey") % 5
    return (F.when(k == 0, F.concat(F.lit("A"), a, b))
             .when(k == 1, F.concat(F.lit("b*"), a, F.lit(":0"), c, F.lit(":01")))
             .when(k == 2, F.concat(F.lit("HLA-C"), a, F.lit("0"), c))
             .when(k == 3, F.lit("drb1*01:01"))
             .otherwise(F.concat(F.lit(" hla-a*"), a, F.lit(":"), b, F.lit(":01 "))))


_ALLELE_RAW_SQL = """CASE p_partkey % 5
  WHEN 0 THEN 'A' || lpad(CAST(p_size % 100 AS VARCHAR), 2, '0') || lpad(CAST(p_partkey % 100 AS VARCHAR), 2, '0')
  WHEN 1 THEN 'b*' || lpad(CAST(p_size % 100 AS VARCHAR), 2, '0') || ':0' || CAST(p_partkey % 10 AS VARCHAR) || ':01'
  WHEN 2 THEN 'HLA-C' || lpad(CAST(p_size % 100 AS VARCHAR), 2, '0') || '0' || CAST(p_partkey % 10 AS VARCHAR)
  WHEN 3 THEN 'drb1*01:01'
  ELSE ' hla-a*' || lpad(CAST(p_size % 100 AS VARCHAR), 2, '0') || ':' || lpad(CAST(p_partkey % 100 AS VARCHAR), 2, '0') || ':01 ' END"""


def allele_sql(x: str) -> str:
    """DuckDB form of ``normalize_allele``."""
    s0 = f"upper(replace(trim(coalesce({x}, '')), ' ', ''))"
    s1 = (f"(CASE WHEN regexp_full_match({s0}, '[ABC][0-9]{{4}}') THEN 'HLA-' || substr({s0}, 1, 1) || '*' || "
          f"substr({s0}, 2, 2) || ':' || substr({s0}, 4, 2) ELSE {s0} END)")
    s2 = (f"(CASE WHEN NOT starts_with({s1}, 'HLA-') AND regexp_matches({s1}, '^[ABC]\\*[0-9]{{2}}:[0-9]{{2}}') "
          f"THEN 'HLA-' || {s1} ELSE {s1} END)")
    four = f"regexp_extract({s2}, '^(HLA-[ABC]\\*[0-9]{{2}}:[0-9]{{2}})', 1)"
    return (f"(CASE WHEN {four} <> '' THEN {four} WHEN regexp_full_match({s2}, 'HLA-[ABC][0-9]{{4}}') "
            f"THEN regexp_replace({s2}, '^HLA-([ABC])([0-9]{{2}})([0-9]{{2}})$', 'HLA-\\1*\\2:\\3') ELSE {s2} END)")


@register("p11_normalize_allele", sql=f"SELECT p_partkey, raw, {allele_sql('raw')} AS allele FROM "
                                      f"(SELECT p_partkey, {_ALLELE_RAW_SQL} AS raw FROM part)")
def q_p11(spark, d):
    """Allele names in five written forms normalised."""
    p = V.table(spark, d, "part").select("p_partkey", _allele_raw_spark(None).alias("raw"))
    return p.select("p_partkey", "raw", S.normalize_allele("raw").alias("allele"))


_P12_CELL = "p_name || ';' || p_type || ' / ' || p_brand || ',,' || CAST(p_size AS VARCHAR)"


@register("p12_split_multi", sql=f"""
SELECT p_partkey, CAST(generate_subscripts(parts, 1) - 1 AS INTEGER) AS pos, unnest(parts) AS part FROM (
  SELECT p_partkey, list_filter(regexp_split_to_array(trim({_P12_CELL}), '[;,|/]+|\\s+'), lambda x: x <> '') AS parts
  FROM part)""")
def q_p12(spark, d):
    """Multi-valued cells split on ; , | / or blanks, one row per part."""
    p = V.table(spark, d, "part")
    cell = F.concat("p_name", F.lit(";"), "p_type", F.lit(" / "), "p_brand", F.lit(",,"), F.col("p_size").cast("string"))
    return p.select("p_partkey", F.posexplode(S.split_multi(cell)).alias("pos", "part"))


@register("p13_pad_right", sql=V.with_views("seqs") + """
SELECT doc_id, CASE WHEN length(sequence) < 34 THEN rpad(sequence, 34, '-') ELSE sequence END AS padded FROM seqs""")
def q_p13(spark, d):
    """Right-pad to 34 with '-', never truncating."""
    return V.seqs(spark, d).select("doc_id", S.pad_right("sequence", 34).alias("padded"))


@register("p14_truncate", sql=V.with_views("seqs") + "SELECT doc_id, substr(sequence, 1, 1022) AS model_input FROM seqs")
def q_p14(spark, d):
    """The model-input cut (1024 minus two special tokens)."""
    return V.seqs(spark, d).select("doc_id", S.truncate("sequence", 1022).alias("model_input"))


_SYMS = "[" + ", ".join(f"'{c}'" for c in GAP + RESIDUES) + "]"


@register("p15_encode_symbols", sql=f"""
SELECT p_partkey, array_to_string(list_transform(string_split(upper(replace(p_name, ' ', '')), ''),
       lambda c: coalesce(list_position({_SYMS}, c) - 1, 0)), ',') AS ids FROM part""")
def q_p15(spark, d):
    """Per-character ids, unknown letters to the gap id."""
    p = V.table(spark, d, "part")
    return p.select("p_partkey", F.array_join(S.encode_symbols(S.normalize_peptide("p_name")), ",").alias("ids"))


@register("p17_p18_binarize_sigmoid", sql=V.with_views("preds") + """
SELECT example_id, fold, CAST(y_prob >= 0.5 AS INTEGER) AS pred_inclusive, CAST(y_prob > 0.5 AS INTEGER) AS pred_strict,
       round(1.0 / (1.0 + exp(-((y_prob - 0.5) * 8.0))), 6) AS prob FROM preds""")
def q_p17(spark, d):
    """Inclusive and strict thresholds; sigmoid of a logit."""
    p = V.preds(spark, d)
    return p.select("example_id", "fold", S.binarize("y_prob").alias("pred_inclusive"),
                    S.binarize("y_prob", inclusive=False).alias("pred_strict"),
                    F.round(S.sigmoid((F.col("y_prob") - 0.5) * 8.0), 6).alias("prob"))


@register("p19_round_up_pow2", sql=V.with_views("seqs") + """
SELECT doc_id, CAST(CASE WHEN length(sequence) <= 1 THEN 1 ELSE pow(2, ceil(log2(length(sequence)))) END AS BIGINT) AS window
FROM seqs""")
def q_p19(spark, d):
    """Smallest power of two not below each sequence length."""
    return V.seqs(spark, d).select("doc_id", S.round_up_pow2(F.length("sequence")).alias("window"))


@register("p20_required_window", sql=V.with_views("seqs") + f"""
SELECT CAST(max(length(sequence)) AS INTEGER) AS max_tokens,
       CAST(pow(2, ceil(log2(max(length(sequence))))) AS BIGINT) AS window FROM seqs WHERE {_VALID.format(x='sequence')}""")
def q_p20(spark, d):
    """P20: longest character-token count and the window it needs."""
    s = V.seqs(spark, d).filter(S.is_valid_sequence("sequence"))
    return P.required_window(s.select(T.tokenize_chars("sequence").alias("tokens")), "tokens")
