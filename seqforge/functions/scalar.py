"""Scalar column rules (P5-P7, P10-P19).  All are Catalyst expressions, so they
stay inside whole-stage codegen and work unchanged on streaming frames."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from seqforge.functions.alphabet import ALLELE_STEPS, GAP, RESIDUES

#: What :func:`strip` takes off: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\f\r"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    """Without leading and trailing blanks, tabs and line breaks."""
    return F.btrim(_c(c), F.lit(SPACES))


# P5 ------------------------------------------------------------------------
LABEL_MODES = ("digits_else_zero", "strict01", "is_labeled", "gt1")


def parse_label(col, mode: str = "strict01") -> Column:
    """Typed label from a text label.

    * ``digits_else_zero``: all-digit text -> its integer, anything else -> 0
      (so ``1.0`` and ``Unknown`` become 0, as in the evaluation scripts);
    * ``strict01``: trimmed, lower-cased ``0``/``1`` -> int, else null;
    * ``is_labeled``: not null and not ``unknown`` (case-insensitive) -> bool;
    * ``gt1``: numeric value > 1 -> 1, else 0.
    """
    c = _c(col)
    if mode == "digits_else_zero":
        s = c.cast("string")
        return F.when(s.rlike(r"^[0-9]+\z"), F.coalesce(s.try_cast("bigint"), F.lit(0))).otherwise(F.lit(0).cast("bigint"))
    if mode == "strict01":
        s = F.lower(strip(c.cast("string")))
        return F.when(s.isin("0", "1"), s.cast("int"))
    if mode == "is_labeled":
        return c.isNotNull() & (F.lower(c.cast("string")) != "unknown")
    if mode == "gt1":
        return F.when(c.cast("string").try_cast("double") > 1, F.lit(1)).otherwise(F.lit(0))
    raise ValueError(f"unknown label mode {mode!r}; expected one of {LABEL_MODES}")


# P6 ------------------------------------------------------------------------
def label_from_id(col) -> Column:
    """Integer of the second ``|`` field of a record id, -1 when absent or
    not an integer."""
    return F.coalesce(F.split_part(_c(col), F.lit("|"), F.lit(2)).try_cast("int"), F.lit(-1))


# P7 ------------------------------------------------------------------------
def is_valid_sequence(col, gap: bool = False) -> Column:
    """Non-empty and only the 20 upper-case residues (optionally ``-``).
    ``\\z`` anchors at the true end (``$`` would accept a final newline)."""
    cls = RESIDUES + (r"\-" if gap else "")
    return F.coalesce(_c(col).rlike(f"^[{cls}]+\\z"), F.lit(False))


# P10 -----------------------------------------------------------------------
def normalize_peptide(col) -> Column:
    """trim, upper, remove blanks; null -> ''."""
    return F.replace(F.upper(strip(F.coalesce(_c(col), F.lit("")))), F.lit(" "), F.lit(""))


# P11 -----------------------------------------------------------------------
def normalize_allele(col) -> Column:
    """HLA allele name to ``HLA-X*NN:NN`` where the rules apply, rules in order:
    short form ``A0201`` expands; a bare ``A*02:01…`` gets the ``HLA-`` prefix;
    a name with more fields is cut to two; ``HLA-B5801`` expands; anything
    else is returned upper-cased without blanks.  null/blank -> ''."""
    s0 = F.replace(F.upper(strip(F.coalesce(_c(col), F.lit("")))), F.lit(" "), F.lit(""))
    for pattern, to in ALLELE_STEPS:
        s0 = F.regexp_replace(s0, pattern, to)
    return s0


# P12 -----------------------------------------------------------------------
def split_multi(col) -> Column:
    """Parts of a multi-valued cell split on ``; , | /`` runs or blank runs,
    empty parts dropped (explode the result for one row per part)."""
    s = strip(F.coalesce(_c(col), F.lit("")))
    return F.filter(F.split(s, r"[;,|/]+|\s+"), lambda x: x != "")


# P13 -----------------------------------------------------------------------
def pad_right(col, n: int, fill: str = GAP) -> Column:
    """Right-pad to ``n`` with ``fill``; never truncates (bare rpad would)."""
    c = _c(col)
    return F.when(F.length(c) < n, F.rpad(c, n, fill)).otherwise(c)


# P14 -----------------------------------------------------------------------
def truncate(col, n: int) -> Column:
    """Prefix of at most ``n`` characters (model input limit)."""
    return F.substr(_c(col), F.lit(1), F.lit(n))


# P15 -----------------------------------------------------------------------
def symbol_map(symbols: str) -> Column:
    return F.create_map(*[x for i, ch in enumerate(symbols) for x in (F.lit(ch), F.lit(i))])


def encode_symbols(col, symbols: str = GAP + RESIDUES, on_missing: str = "gap") -> Column:
    """Per-character ids from a small alphabet (a map literal, under 30 keys).
    ``on_missing``: ``gap`` -> id of ``-``; ``zero`` -> 0; ``error`` -> fail."""
    m = symbol_map(symbols)
    if on_missing == "gap":
        dflt = F.lit(symbols.index(GAP))
    elif on_missing == "zero":
        dflt = F.lit(0)
    elif on_missing == "error":
        dflt = F.raise_error(F.lit("symbol outside the alphabet"))
    else:
        raise ValueError(on_missing)
    return F.transform(F.split(_c(col), ""),
                       lambda ch: F.coalesce(F.try_element_at(m, ch), dflt.cast("int")))


# P16 -----------------------------------------------------------------------
def space_join(tokens) -> Column:
    return F.array_join(_c(tokens), " ")


# P17 -----------------------------------------------------------------------
def binarize(prob, thr: float = 0.5, inclusive: bool = True) -> Column:
    p = _c(prob)
    return ((p >= thr) if inclusive else (p > thr)).cast("int")


# P18 -----------------------------------------------------------------------
def sigmoid(logit) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_c(logit)))


# P19 -----------------------------------------------------------------------
def round_up_pow2(n) -> Column:
    """Smallest power of two >= n (1 for n <= 1).  Uses the bit length of
    n-1, exact for all positive longs (a log2 form is off at 2^29)."""
    c = _c(n).cast("long")
    return F.when(c <= 1, F.lit(1).cast("long")).otherwise(
        F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(c - 1))))
