"""The scalar rules as SQL functions, so SQL users get the same
expressions (SQL functions are inlined into the plan, no Python at run
time)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqforge.functions.alphabet import ALLELE_STEPS, GAP, RESIDUES
from seqforge.functions.scalar import SPACES

STRIPPED = "btrim(s, '{}')".format("".join(f"\\u{ord(c):04x}" for c in SPACES))

FUNCTIONS = {
    "sf_label_gt1": ("s STRING", "INT", "CASE WHEN try_cast(s AS DOUBLE) > 1 THEN 1 ELSE 0 END"),
    "sf_normalize_allele": ("s STRING", "STRING", None),
    "sf_is_valid_sequence": ("s STRING", "BOOLEAN", f"coalesce(s RLIKE r'^[{RESIDUES}]+\\z', false)"),
    "sf_parse_label_strict": ("s STRING", "INT",
                              f"CASE WHEN lower({STRIPPED}) IN ('0', '1') THEN CAST(lower({STRIPPED}) AS INT) END"),
    "sf_is_labeled": ("s STRING", "BOOLEAN", "s IS NOT NULL AND lower(s) <> 'unknown'"),
    "sf_label_digits": ("s STRING", "BIGINT",
                        "CASE WHEN s RLIKE r'^[0-9]+\\z' THEN coalesce(try_cast(s AS BIGINT), 0L) ELSE 0L END"),
    "sf_normalize_peptide": ("s STRING", "STRING", f"replace(upper(coalesce({STRIPPED}, '')), ' ', '')"),
    "sf_pad_right": ("s STRING, n INT", "STRING",
                     f"CASE WHEN length(s) < n THEN rpad(s, n, '{GAP}') ELSE s END"),
    "sf_label_from_id": ("s STRING", "INT", "coalesce(try_cast(split_part(s, '|', 2) AS INT), -1)"),
}


def allele_body() -> str:
    """The steps of ``normalize_allele`` as SQL text."""
    body = f"replace(upper(coalesce({STRIPPED}, '')), ' ', '')"
    for pattern, to in ALLELE_STEPS:
        body = f"regexp_replace({body}, r'{pattern}', '{to}')"
    return body


#: T1 as a table function: the windows of a sequence, inlined like the others.
WINDOWS = """CREATE OR REPLACE TEMPORARY FUNCTION sf_windows(s STRING, max_len INT)
RETURNS TABLE (k INT, start INT, window STRING)
RETURN SELECT pos, col, substr(s, col + 1, max_len) FROM posexplode(
  CASE WHEN s IS NULL THEN NULL WHEN length(s) <= max_len THEN array(0)
       ELSE array_distinct(concat(sequence(0, length(s) - max_len, max_len div 2), array(length(s) - max_len))) END)"""
TOKENIZERS = ("common", "fmfm", "fmfcm")


def register_tokenizer(spark: SparkSession, name: str, vocab_z: DataFrame | None = None, sizes=(2, 3),
                       alphabet: str = RESIDUES) -> str:
    """``sf_tokenize_<name>(text) -> array<string>`` for SQL, by the
    tokenizer's name: ``common`` (T7, one token per letter, an inlined
    expression), ``fmfm`` (T8) or ``fmfcm`` (T9) with a vocabulary, as Arrow
    batch functions.  The vocabulary is read once, bounded by the alphabet."""
    from seqforge.operators.corpus import token_lists, vocab_tables
    if name not in TOKENIZERS:
        raise ValueError(f"unknown tokenizer {name!r}; have {TOKENIZERS}")
    function = f"sf_tokenize_{name}"
    if name == "common":
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {function}(s STRING) RETURNS ARRAY<STRING> RETURN split(s, '')")
        return function
    if vocab_z is None:
        raise ValueError(f"tokenizer {name!r} needs a vocabulary")
    tables, overlap = vocab_tables(vocab_z, sizes, alphabet), name == "fmfcm"

    def tokens(text: pa.Array) -> pa.Array:
        return token_lists(text, tables, alphabet, overlap)
    spark.udf.register(function, F.arrow_udf(tokens, "array<string>"))
    return function


def register_functions(spark: SparkSession) -> list[str]:
    """Create (or replace) the temporary SQL functions; returns their names."""
    for name, (args, ret, body) in FUNCTIONS.items():
        body = body or allele_body()
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {ret} RETURN {body}")
    spark.sql(WINDOWS)
    return [*FUNCTIONS, "sf_windows"]
