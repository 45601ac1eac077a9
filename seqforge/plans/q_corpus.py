"""Registered corpus queries (T*) with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqforge.functions import scalar as S
from seqforge.operators import corpus as T
from seqforge.plans import views as V
from seqforge.plans.registry import register

L = 512  # window length used by the registered corpus queries


def valid_seqs(spark, d):
    return V.seqs(spark, d).filter(S.is_valid_sequence("sequence"))


_VALID = f"regexp_full_match(sequence, '[{S.RESIDUES}]+')"

# DuckDB window starts, mirroring ``window_starts``.
_STARTS = (f"CASE WHEN length(sequence) <= {L} THEN [0] ELSE list_concat("
           f"range(0, length(sequence) - {L} + 1, {L // 2}), "
           f"CASE WHEN (length(sequence) - {L}) % {L // 2} <> 0 THEN [length(sequence) - {L}] "
           f"ELSE [] END) END")

_WIN_SQL = (f"SELECT doc_id, species, label, CAST(start AS INTEGER) AS start, "
            f"CAST(row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1 AS INTEGER) AS k, "
            f"substr(sequence, CAST(start AS INTEGER) + 1, {L}) AS window "
            f"FROM (SELECT *, unnest({_STARTS}) AS start FROM seqs WHERE {_VALID})")

_NGRAM_SQL = ('SELECT substr("window", i, 2) AS token FROM windows, '
              'range(1, length("window")) t(i) '
              'UNION ALL SELECT substr("window", i, 3) AS token FROM windows, '
              'range(1, length("window") - 1) t(i)')

_RAW_SQL = (f"SELECT substr(sequence, i, 2) AS token FROM seqs, range(1, length(sequence)) t(i) WHERE {_VALID} "
            f"UNION ALL SELECT substr(sequence, i, 3) AS token FROM seqs, range(1, length(sequence) - 1) t(i) WHERE {_VALID}")

_VOCAB_SQL = ("SELECT CAST(row_number() OVER (ORDER BY frequency DESC, token) - 1 AS INTEGER) AS idx, "
              "token, frequency FROM (SELECT token, count(*) AS frequency FROM grams GROUP BY token)")


def top_tokens(spark, d, n: int = 50):
    """Flagship: valid sequences -> 512 windows -> 2/3-grams -> vocabulary ->
    z-scores -> the n most frequent tokens."""
    w = T.sequence_windows(valid_seqs(spark, d), L)
    vocab = T.normalize_vocab(T.build_vocab(w, "window"))
    return (vocab.orderBy(F.desc("frequency"), "token").limit(n)
            .select("idx", "token", "frequency", F.round("freq_z", 6).alias("freq_z")))


register("t_flagship_top_tokens", sql=V.with_views("seqs", extra=[
    ("windows", _WIN_SQL), ("grams", _NGRAM_SQL), ("vocab", _VOCAB_SQL)]) + """
SELECT idx, token, frequency, round(freq_z, 6) AS freq_z FROM (
  SELECT *, CASE WHEN stddev_pop(frequency) OVER w > 0
     THEN (frequency - avg(frequency) OVER w) / stddev_pop(frequency) OVER w ELSE 0.0 END AS freq_z
  FROM vocab WINDOW w AS (PARTITION BY length(token)))
ORDER BY frequency DESC, token LIMIT 50""")(top_tokens)


@register("t1_sequence_windows", sql=V.with_views("seqs") + _WIN_SQL.replace(
    "SELECT doc_id, species, label,", "SELECT doc_id,"))
def q_t1(spark, d):
    """Overlapping windows of 512 at step 256 plus a flush tail window."""
    return T.sequence_windows(valid_seqs(spark, d), L).select("doc_id", "start", "k", "window")


def _windows(spark, d):
    return T.sequence_windows(valid_seqs(spark, d), L)


def _vocab_z(spark, d):
    return T.normalize_vocab(T.build_vocab(valid_seqs(spark, d)))


_ZVOCAB_SQL = ("SELECT token, CASE WHEN stddev_pop(frequency) OVER w > 0 THEN (frequency - avg(frequency) OVER w) "
               "/ stddev_pop(frequency) OVER w ELSE 0.0 END AS freq_z FROM vocab "
               "WINDOW w AS (PARTITION BY length(token))")
_TOK_VIEWS = [("windows", _WIN_SQL), ("grams", _RAW_SQL), ("vocab", _VOCAB_SQL), ("zv", _ZVOCAB_SQL)]

_CHOICE_SQL = """SELECT doc_id, k, i, CASE
    WHEN i = n - 1 OR g2 IS NULL OR (CASE WHEN g3 IS NULL THEN z2 ELSE z2 + z3 END) = 0 THEN ch
    WHEN g3 IS NULL THEN g2 WHEN z3 > z2 THEN g3 ELSE g2 END AS tok
  FROM (SELECT p.*, coalesce(v2.freq_z, 0.0) AS z2, coalesce(v3.freq_z, 0.0) AS z3 FROM (
          SELECT doc_id, k, i, length("window") AS n, substr("window", i + 1, 1) AS ch,
                 CASE WHEN i + 2 <= length("window") THEN substr("window", i + 1, 2) END AS g2,
                 CASE WHEN i + 3 <= length("window") THEN substr("window", i + 1, 3) END AS g3
          FROM windows, range(0, length("window")) t(i)) p
        LEFT JOIN zv v2 ON v2.token = p.g2 LEFT JOIN zv v3 ON v3.token = p.g3)"""


@register("t2_paired_windows", sql=V.with_views("seqs_ss") + f"""
SELECT doc_id, CAST(k AS INTEGER) AS k, CAST(start AS INTEGER) AS start, substr(sequence, CAST(start AS INTEGER) + 1, {L}) AS "window",
       substr(ss, CAST(start AS INTEGER) + 1, {L}) AS ss_window
FROM (SELECT *, unnest({_STARTS}) AS start, unnest(range(0, len({_STARTS}))) AS k FROM seqs_ss WHERE {_VALID})""")
def q_t2(spark, d):
    """The same 512-cuts on sequence and structure."""
    s = V.seqs_ss(spark, d).filter(S.is_valid_sequence("sequence"))
    return T.paired_windows(s, L).select("doc_id", "k", "start", "window", "ss_window")


@register("t3_ngrams", sql=V.with_views("seqs", extra=[("windows", _WIN_SQL)]) + """
SELECT doc_id, count(*) AS n_grams, count(DISTINCT g) AS n_distinct FROM (
  SELECT doc_id, substr("window", i, 2) AS g FROM windows, range(1, length("window")) t(i)
  UNION ALL SELECT doc_id, substr("window", i, 3) AS g FROM windows, range(1, length("window") - 1) t(i))
GROUP BY doc_id""")
def q_t3(spark, d):
    """2- and 3-grams of every window; per sequence total and distinct."""
    return T.ngrams(_windows(spark, d), "window", by=["doc_id"])


@register("t4_build_vocab", sql=V.with_views("seqs", extra=[("grams", _RAW_SQL)]) + _VOCAB_SQL)
def q_t4(spark, d):
    """T4: the full n-gram vocabulary of the sequences with frequency ranks."""
    return T.build_vocab(valid_seqs(spark, d))


@register("t5_normalize_vocab", sql=V.with_views("seqs", extra=_TOK_VIEWS[:3]) + """
SELECT idx, token, frequency, round(CASE WHEN stddev_pop(frequency) OVER w > 0
   THEN (frequency - avg(frequency) OVER w) / stddev_pop(frequency) OVER w ELSE 0.0 END, 6) AS freq_z
FROM vocab WINDOW w AS (PARTITION BY length(token))""")
def q_t5(spark, d):
    """T5: z-scored frequencies per token length."""
    return _vocab_z(spark, d).select("idx", "token", "frequency", F.round("freq_z", 6).alias("freq_z"))


_FIXED = [*S.RESIDUES, "$", ".", "?", "|", "*"]


@register("t6_token_index", sql=V.with_views("seqs", extra=_TOK_VIEWS) + """
SELECT token, CAST(max(id) AS INTEGER) AS id FROM (
  SELECT * FROM (VALUES """ + ", ".join(f"('{t}', {i})" for i, t in enumerate(_FIXED)) + f""") f(token, id)
  UNION ALL SELECT token, {len(_FIXED)} - 1 + row_number() OVER (ORDER BY freq_z DESC, token) AS id FROM zv)
GROUP BY token""")
def q_t6(spark, d):
    """Residues, specials, then vocabulary tokens by z-score."""
    return T.token_index(_vocab_z(spark, d))


@register("t7_tokenize_chars", sql=V.with_views("seqs", extra=[("windows", _WIN_SQL)]) +
          "SELECT doc_id, k, array_to_string(string_split(\"window\", ''), ' ') AS tokens FROM windows")
def q_t7(spark, d):
    """One token per character, space-joined."""
    return _windows(spark, d).select("doc_id", "k", S.space_join(T.tokenize_chars("window")).alias("tokens"))


_WALK_VIEWS = [
    ("ch", _CHOICE_SQL), ("hops", "SELECT doc_id, k, i, tok, length(tok) AS hop FROM ch"),
    ("walk", "SELECT doc_id, k, 0 AS i FROM windows UNION ALL SELECT w.doc_id, w.k, w.i + h.hop FROM walk w "
             "JOIN hops h ON h.doc_id = w.doc_id AND h.k = w.k AND h.i = w.i")]


@register("t8_tokenize_fmfm", sql=(V.with_views("seqs", extra=_TOK_VIEWS + _WALK_VIEWS)
    .replace("WITH ", "WITH RECURSIVE ", 1) + """
SELECT h.doc_id, h.k, string_agg(h.tok, ' ' ORDER BY h.i) AS tokens
FROM walk w JOIN hops h ON h.doc_id = w.doc_id AND h.k = w.k AND h.i = w.i GROUP BY h.doc_id, h.k"""))
def q_t8(spark, d):
    """Forward maximum-frequency matching of every window."""
    t = T.tokenize_fmfm(_windows(spark, d), "window", ["doc_id", "k"], _vocab_z(spark, d))
    return t.select("doc_id", "k", S.space_join("tokens").alias("tokens"))


@register("t9_tokenize_fmfcm", sql=V.with_views("seqs", extra=_TOK_VIEWS + [("ch", _CHOICE_SQL)]) +
          "SELECT doc_id, k, string_agg(tok, ' ' ORDER BY i) AS tokens FROM ch GROUP BY doc_id, k")
def q_t9(spark, d):
    """Frequency choice at every position of every window."""
    t = T.tokenize_fmfcm(_windows(spark, d), "window", ["doc_id", "k"], _vocab_z(spark, d))
    return t.select("doc_id", "k", S.space_join("tokens").alias("tokens"))


# both sides as windows of their own: k * 2 is the window, k * 2 + 1 its reverse
_PAIR_VIEWS = [("one", _WIN_SQL), *_TOK_VIEWS[1:], (
    "windows", 'SELECT doc_id, k * 2 AS k, "window" FROM one UNION ALL SELECT doc_id, k * 2 + 1 AS k, reverse("window") FROM one')]


@register("t10_tokenize_pair", sql=(V.with_views("seqs", extra=_PAIR_VIEWS + _WALK_VIEWS)
    .replace("WITH ", "WITH RECURSIVE ", 1) + """
SELECT doc_id, CAST(k // 2 AS INTEGER) AS k, string_agg(tokens, ' - ' ORDER BY k) AS tokens FROM (
  SELECT h.doc_id, h.k, string_agg(h.tok, ' ' ORDER BY h.i) AS tokens
  FROM walk w JOIN hops h ON h.doc_id = w.doc_id AND h.k = w.k AND h.i = w.i GROUP BY h.doc_id, h.k)
GROUP BY doc_id, k // 2"""))
def q_t10(spark, d):
    """Each window paired with its reverse (``w-reverse(w)``), both
    sides tokenized with a ``-`` token between."""
    w = _windows(spark, d).withColumn("pair", F.concat("window", F.lit("-"), F.reverse("window")))
    t = T.tokenize_pair(w, "pair", ["doc_id", "k"], _vocab_z(spark, d))
    return t.select("doc_id", "k", S.space_join("tokens").alias("tokens"))


_IDX = "[" + ", ".join(f"'{t}'" for t in _FIXED) + "]"


@register("t11_encode_fixed", sql=V.with_views("seqs", extra=[("windows", _WIN_SQL)]) + f"""
SELECT doc_id, k, array_to_string(list_resize(list_concat([24], ids, [23]), 514, 20), ',') AS input_ids,
       CAST(len(ids) + 2 AS INTEGER) AS n_attended
FROM (SELECT doc_id, k, list_transform(string_split("window", ''),
        lambda c: coalesce(list_position({_IDX}, c) - 1, 22)) AS ids FROM windows)""")
def q_t11(spark, d):
    """[CLS] chars [SEP] ids of whole windows, padded to L + 2, with the attention length."""
    e = T.encode_fixed(T.tokenize_chars("window"), L + 2)
    w = _windows(spark, d).select("doc_id", "k", e.alias("enc"))
    return w.select("doc_id", "k", F.array_join("enc.input_ids", ",").alias("input_ids"),
                    F.aggregate("enc.attention_mask", F.lit(0), lambda a, x: a + x).alias("n_attended"))


@register("t12_merge_corpora", sql=V.with_views("seqs") + _WIN_SQL.replace(
    "SELECT doc_id, species, label,", "SELECT doc_id, species,"))
def q_t12(spark, d):
    """English and non-English corpora concatenated, then windowed."""
    s = valid_seqs(spark, d)
    m = T.merge_corpora(s.filter("species = 'en'"), s.filter("species <> 'en'"), L)
    return m.select("doc_id", "species", "start", "k", "window")


@register("t13_corpus_size", sql=V.with_views("seqs", extra=[("windows", _WIN_SQL)]) +
          f"SELECT count(*) AS n_windows, count(*) * {L} AS n_tokens FROM windows")
def q_t13(spark, d):
    """Windows and padded token count."""
    return T.corpus_size(_windows(spark, d), L)
