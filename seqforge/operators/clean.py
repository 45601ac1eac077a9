"""Column-level cleaning of assay tables.

Schema operations (renames, projections, checks) are metadata only and
raise before any job runs; row rules are Catalyst expressions."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from seqforge.functions.scalar import strip

from seqforge.functions.scalar import is_valid_sequence, round_up_pow2


# P1 ------------------------------------------------------------------------
PAIR_ALIASES = {"Peptide": "antigen", "CDR3": "TCR", "Label": "label"}


def normalize_columns(df: DataFrame, aliases: dict[str, str] | None = None,
                      required: list[str] | None = None, trim: bool = True) -> DataFrame:
    """Rename known aliases, fail on missing required columns (eagerly, from
    the schema), trim text columns, and project the required columns."""
    aliases = PAIR_ALIASES if aliases is None else aliases
    d = df.withColumnsRenamed({k: v for k, v in aliases.items() if k in df.columns})
    need = required or list(dict.fromkeys(aliases.values()))
    missing = [c for c in need if c not in d.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; have {d.columns}")
    strings = {f.name for f in d.schema.fields if f.dataType.simpleString() == "string"}
    return d.select(*[strip(F.col(c)).alias(c) if trim and c in strings else F.col(c) for c in need])


# P2 ------------------------------------------------------------------------
def rename_by_position(df: DataFrame, names: dict[int, str]) -> DataFrame:
    """Rename columns by their 0-based position."""
    cols = list(df.columns)
    for i, n in names.items():
        cols[i] = n
    return df.toDF(*cols)


# P3 ------------------------------------------------------------------------
def normalize_header(df: DataFrame) -> DataFrame:
    """Trim column names and collapse whitespace runs (newlines included)."""
    return df.toDF(*[re.sub(r"\s+", " ", c.strip()) for c in df.columns])


# P4 ------------------------------------------------------------------------
def letter_to_index(letters: str) -> int:
    """Spreadsheet column letters to a 0-based index (A->0, L->11, DD->107)."""
    n = 0
    for ch in letters.strip().upper():
        n = n * 26 + (ord(ch) - ord("A") + 1)
    return n - 1


def select_by_letter(df: DataFrame, letters: list[str], fallback: list[str] | None = None) -> DataFrame:
    """Project columns by spreadsheet letter; when a letter is out of range,
    fall back to the header names given."""
    try:
        cols = [df.columns[letter_to_index(x)] for x in letters]
    except IndexError:
        if not fallback:
            raise
        cols = fallback
    return df.select(*cols)


# P8 ------------------------------------------------------------------------
def clean_with_rejects(df: DataFrame, cols: list[str], max_len: int = 34):
    """Trim the sequence columns; reject rows with an invalid column first,
    then rows with a column longer than ``max_len``.  Returns
    ``(kept, rejected, counts)``: three lazy plans over one tagged plan;
    ``rejected`` keeps its ``reject_reason`` (invalid rows before too-long
    rows when ordered by it) and ``counts`` has one row per outcome."""
    tagged = tag_rejects(df, cols, max_len)
    kept = tagged.filter(F.col("reject_reason").isNull()).drop("reject_reason")
    rejected = tagged.filter(F.col("reject_reason").isNotNull())
    counts = tagged.groupBy(F.coalesce("reject_reason", F.lit("kept")).alias("outcome")) \
                   .agg(F.count(F.lit(1)).alias("n"))
    return kept, rejected, counts


def tag_rejects(df: DataFrame, cols: list[str], max_len: int = 34) -> DataFrame:
    """Every row with its sequence columns trimmed and its ``reject_reason``
    (null: kept); works on streams."""
    d = df.select(*[strip(F.col(c)).alias(c) if c in cols else F.col(c) for c in df.columns])
    lens = [F.length(c) for c in cols]
    too_long = (F.greatest(*lens) if len(lens) > 1 else lens[0]) > max_len
    return d.withColumn("reject_reason", F.when(~_all_valid(cols), "invalid").when(too_long, "too_long"))


def observe_rejects(tagged: DataFrame, name: str = "cleaned") -> tuple[DataFrame, Observation]:
    """``tagged`` with counts of its outcomes, taken in the pass that writes
    it: after the write, ``observation.get`` has rows, kept, invalid, too_long."""
    seen, reason = Observation(name), F.col("reject_reason")
    return tagged.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(reason.isNull()).alias("kept"),
                          *[F.count_if(reason == r).alias(r) for r in ("invalid", "too_long")]), seen


def _all_valid(cols):
    ok = is_valid_sequence(cols[0])
    for c in cols[1:]:
        ok = ok & is_valid_sequence(c)
    return ok


# P9 ------------------------------------------------------------------------
def drop_blank_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Drop rows whose trimmed key is empty or null."""
    cond = F.lit(True)
    for k in keys:
        cond = cond & (F.length(strip(F.col(k))) > 0)
    return df.filter(cond)


# P20 -----------------------------------------------------------------------
def required_window(df: DataFrame, tokens_col: str) -> DataFrame:
    """One row: the longest token count in the corpus and the window length
    it needs (next power of two)."""
    return df.agg(F.max(F.size(tokens_col)).alias("max_tokens")) \
             .withColumn("window", round_up_pow2(F.col("max_tokens")))
