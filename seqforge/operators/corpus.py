"""Corpus preparation: windows, n-grams, vocabularies, tokenizers, encoding.

Every function maps DataFrame -> DataFrame.  Per-row work stays in Catalyst
expressions (``transform``, ``sequence``, ``substring``) or, for gram counts
and the frequency tokenizers, in Arrow batch functions; the only shuffle is
the vocabulary aggregation (counts per batch, then a hash aggregate).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from seqforge.functions import arrow as A
from seqforge.functions.alphabet import CLS, GAP, PAD, RESIDUES, SEP, SPECIALS, UNK


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def window_starts(n: Column, max_len: int) -> Column:
    """0-based window starts: one window when ``n <= max_len``; otherwise
    starts 0, step, 2*step ... plus one tail window flush with the end when
    the regular windows do not reach it.  ``step = max_len // 2``."""
    if max_len < 2:
        raise ValueError("max_len must be >= 2 (the step is max_len // 2)")
    step = max_len // 2
    regular = F.sequence(F.lit(0), n - max_len, F.lit(step))
    tail = F.when((n - max_len) % step != 0, F.array(n - max_len)).otherwise(
        F.array().cast("array<int>"))
    return F.when(n <= max_len, F.array(F.lit(0))).otherwise(F.concat(regular, tail))


# T1 ------------------------------------------------------------------------
def sequence_windows(df: DataFrame, max_len: int, seq_col: str = "sequence",
                     out_col: str = "window") -> DataFrame:
    """One row per window: all input columns except the sequence, plus
    ``k`` (window number), ``start`` (0-based) and the window text.
    A map-only stage: no shuffle."""
    keep = [c for c in df.columns if c != seq_col]
    n = F.length(seq_col)
    return (df.select(*keep, F.col(seq_col), F.posexplode(window_starts(n, max_len)).alias("k", "start"))
              .select(*keep, "k", "start",
                      F.substr(F.col(seq_col), F.col("start") + 1, F.lit(max_len)).alias(out_col)))


# T2 ------------------------------------------------------------------------
def paired_windows(df: DataFrame, max_len: int, seq_col: str = "sequence",
                   ss_col: str = "ss") -> DataFrame:
    """The T1 cuts applied to a sequence and its structure string together.
    Unequal lengths raise at run time (``assert_true``)."""
    keep = [c for c in df.columns if c not in (seq_col, ss_col)]
    checked = df.withColumn("_ok", F.assert_true(F.length(seq_col) == F.length(ss_col),
                                                 "sequence and structure lengths must match"))
    n = F.length(seq_col)
    return (checked.select(*keep, seq_col, ss_col, "_ok",
                           F.posexplode(window_starts(n, max_len)).alias("k", "start"))
            .select(*keep, "k", "start",
                    F.substr(F.col(seq_col), F.col("start") + 1, F.lit(max_len)).alias("window"),
                    F.substr(F.col(ss_col), F.col("start") + 1, F.lit(max_len)).alias("ss_window")))


# T3 ------------------------------------------------------------------------
def ngram_array(col, sizes=(2, 3)) -> Column:
    """All overlapping substrings of each size, sizes in the given order.

    A zero-width lookahead ``(?=(.{n}))`` matches at every position and
    captures the next n characters, so one linear regex pass yields all
    overlapping n-grams (``substring`` at position i would rescan the UTF-8
    bytes from the start, making a window quadratic)."""
    c = _c(col)
    parts = [F.regexp_extract_all(c, F.lit(f"(?s)(?=(.{{{n}}}))"), 1) for n in sizes]
    return F.concat(*parts) if len(parts) > 1 else parts[0]


#: Bits of a bitmap of Spark's bitmap functions; rows of a block whose bitmaps are built together, at most.
BITMAP, SET_ROWS = 1 << 15, 1024


def _runs(columns: list[pa.Array], n: int) -> np.ndarray:
    """Number of the run of rows with equal keys that each row is in."""
    new = np.zeros(n, np.int64)
    for c in columns:
        code = pc.fill_null(c.dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
        new[1:] |= code[1:] != code[:-1]
    return np.cumsum(new)


def _gram_sets(by: list[str], sizes: list[int], alphabet: str, schema: pa.Schema):
    """Per run of rows with equal keys the number of its grams and the bitmap of
    the different ones: a gram's bit is its number in base ``len(alphabet)``
    behind those of the smaller sizes.  Grams with other letters, or of a size
    whose numbers do not fit, come as text in rows of their own."""
    base, place, width = len(alphabet), {}, 0
    for size in sorted(set(sizes)):
        if width + base ** size <= BITMAP:
            place[size], width = width, width + base ** size
    row_bits = -(-width // 8) * 8

    def run(batches):
        for b in A.blocks(batches, "_text", rows=SET_ROWS):
            data, start, first, points = A.letters(b.column(b.num_columns - 1))
            if not len(points):
                continue
            runs = _runs(b.columns[:-1], b.num_rows)
            head = pa.array(np.flatnonzero(np.append(True, np.diff(runs) > 0)))
            keys = [c.take(head) for c in b.columns[:-1]]
            code = np.full(max(int(points.max()) + 1, 256), -1)
            code[[ord(c) for c in alphabet]] = np.arange(base)
            code = code[points]
            left = np.repeat(first[1:], np.diff(first)) - np.arange(len(points))
            own = np.repeat(runs, np.diff(first))
            total, flags = np.zeros(len(head), np.int64), np.zeros(len(head) * row_bits, bool)
            texts = []
            for size in sorted(set(sizes)):
                at = np.flatnonzero(left >= size)
                total += np.bincount(own[at], minlength=len(head)) * sizes.count(size)
                known, number = np.full(len(at), size in place), np.zeros(len(at), np.int64)
                for j in range(size):
                    letter = code[at + j]
                    known &= letter >= 0
                    number = number * base + letter
                if size in place:
                    flags[own[at[known]] * row_bits + place[size] + number[known]] = True
                texts.append((at[~known], size))
            full = np.flatnonzero(total)
            bits = np.packbits(flags.reshape(len(head), -1), axis=1, bitorder="little")[full]
            bits = pa.Array.from_buffers(pa.binary(), len(full), [None, pa.py_buffer((np.arange(len(full) + 1) * bits.shape[1]).astype(np.int32)), pa.py_buffer(bits.tobytes())])
            yield pa.RecordBatch.from_arrays([*(k.take(pa.array(full)) for k in keys), pa.array(total[full]), bits, pa.nulls(len(full), pa.string())], schema=schema)
            for at, size in texts:
                if len(at):
                    grams = A.string_lists(data, start, at, np.full(len(at), size), np.arange(len(at) + 1)).flatten()
                    yield pa.RecordBatch.from_arrays([*(k.take(pa.array(own[at])) for k in keys), pa.array(np.zeros(len(at), np.int64)),
                                                      pa.nulls(len(at), pa.binary()), grams], schema=schema)
    return run


def ngrams(df: DataFrame, col: str = "sequence", sizes=(2, 3), by: list[str] | None = None, alphabet: str = RESIDUES) -> DataFrame:
    """One row per n-gram occurrence: ``(…keys, gram)``.

    With ``by``: ``(*by, n_grams, n_distinct)``, the occurrences and the
    different grams per key, if there are any.  No row per gram is made: rows
    of one key that follow each other send one bitmap over the grams of
    ``alphabet`` (other grams are sent as text, so any letter counts)."""
    if by is not None:
        from pyspark.sql.pandas.types import to_arrow_schema
        src = df.select(*by, F.col(col).alias("_text"))
        schema = ST.StructType([*src.schema.fields[:-1], ST.StructField("_n", ST.LongType()),
                                ST.StructField("_bits", ST.BinaryType()), ST.StructField("_gram", ST.StringType())])
        part = src.mapInArrow(_gram_sets(by, list(sizes), alphabet, to_arrow_schema(schema)), schema)
        part = part.groupBy(*by, "_gram").agg(F.sum("_n").alias("_n"), F.bitmap_or_agg("_bits").alias("_bits"))
        return part.groupBy(*by).agg(F.sum("_n").alias("n_grams"),
                                     (F.bitmap_count(F.bitmap_or_agg("_bits")) + F.count("_gram")).alias("n_distinct"))
    keep = [c for c in df.columns if c != col]
    return df.select(*keep, F.explode(ngram_array(col, sizes)).alias("gram"))


# T4 ------------------------------------------------------------------------
def _ranks(ids: np.ndarray, bound: int) -> tuple[int, np.ndarray]:
    """(number of different ids, dense rank of each id); ids lie in 0 .. bound - 1."""
    if bound > 4 * A.BLOCK:
        seen, rank = np.unique(ids, return_inverse=True)
        return len(seen), rank
    there = np.zeros(bound, bool)
    there[ids] = True
    return int(there.sum()), (np.cumsum(there) - 1)[ids]


def _count_grams(col: str, sizes):
    """Distinct grams of each block of rows with their counts.  A gram's id is
    the rank of (id of its first letters, last letter), so any size fits."""
    def run(batches):
        for b in A.blocks(batches, col):
            data, start, first, points = A.letters(b.column(col))
            if not len(points):
                continue
            left = np.repeat(first[1:], np.diff(first)) - np.arange(len(points))
            n_letters, code = _ranks(points, int(points.max()) + 1)
            n_ids, ids = n_letters, code
            for size in range(1, max(sizes) + 1):
                if size > 1:
                    ids = ids[:len(code) - size + 1] * n_letters + code[size - 1:]
                    n_ids, ids = _ranks(ids, n_ids * n_letters)
                if not len(ids):
                    break
                if size not in sizes:
                    continue
                fits = left[:len(ids)] >= size
                count = np.bincount(ids[fits], minlength=n_ids)
                where = np.zeros(n_ids, np.int64)  # a place of each gram
                at = np.flatnonzero(fits)
                where[ids[at]] = at
                seen = np.flatnonzero(count)
                tokens = A.string_lists(data, start, where[seen], np.full(len(seen), size), np.arange(len(seen) + 1)).flatten()
                yield pa.RecordBatch.from_arrays([tokens, pa.array(count[seen] * sizes.count(size), pa.int64())], names=["token", "n"])
    return run


def gram_counts(df: DataFrame, col: str = "sequence", sizes=(2, 3)) -> DataFrame:
    """``(token, frequency)``: occurrences of every n-gram in the corpus.  Each
    block of rows counts its grams before the shuffle."""
    part = df.select(F.col(col).alias("_s")).mapInArrow(_count_grams("_s", list(sizes)), "token string, n long")
    return part.groupBy("token").agg(F.sum("n").alias("frequency"))


def build_vocab(df: DataFrame, col: str = "sequence", sizes=(2, 3)) -> DataFrame:
    """``(idx, token, frequency)``: corpus counts, most frequent first, ties by
    token.  Only the distinct tokens (bounded by alphabet^max(sizes)) reach the
    final ranking window, so the single ordered window sees a bounded table."""
    counts = gram_counts(df, col, sizes)
    w = Window.orderBy(F.desc("frequency"), F.asc("token"))
    return counts.select((F.row_number().over(w) - 1).cast("int").alias("idx"), "token", "frequency")


# T5 ------------------------------------------------------------------------
def normalize_vocab(vocab: DataFrame) -> DataFrame:
    """Adds ``freq_z``: z-score of the frequency among tokens of the same
    length (population sd; 0 when the sd is 0).  The reference reads this
    column without ever writing it; this is our documented definition."""
    w = Window.partitionBy(F.length("token"))
    mu = F.avg("frequency").over(w)
    sd = F.stddev_pop("frequency").over(w)
    return vocab.withColumn("freq_z", F.when(sd > 0, (F.col("frequency") - mu) / sd).otherwise(F.lit(0.0)))


# T6 ------------------------------------------------------------------------
def token_index(vocab: DataFrame | None, hyphen: bool = False, spark=None) -> DataFrame:
    """``(token, id)``: optional gap, the 20 residues, the specials, then the
    vocabulary by ``freq_z`` descending (ties by token).  A token listed twice
    keeps its last id.  ``vocab=None`` gives the character-level index."""
    fixed = ([GAP] if hyphen else []) + list(RESIDUES) + SPECIALS
    sess = spark or vocab.sparkSession
    head = sess.createDataFrame([(t, i) for i, t in enumerate(fixed)], "token string, id int")
    if vocab is None:
        return head
    w = Window.orderBy(F.desc("freq_z"), F.asc("token"))
    tail = vocab.select("token", (F.row_number().over(w) - 1 + len(fixed)).cast("int").alias("id"))
    return head.unionByName(tail).groupBy("token").agg(F.max("id").alias("id"))


def char_index_map(hyphen: bool = False) -> Column:
    """Character-level index as a map literal (under 30 entries)."""
    fixed = ([GAP] if hyphen else []) + list(RESIDUES) + SPECIALS
    return F.create_map(*[x for i, t in enumerate(fixed) for x in (F.lit(t), F.lit(i))])


# T7 ------------------------------------------------------------------------
def tokenize_chars(col) -> Column:
    """One token per character."""
    return F.split(_c(col), "")


# T11 -----------------------------------------------------------------------
def encode_fixed(tokens, max_len: int, index_map: Column | None = None,
                 hyphen: bool = False) -> Column:
    """``struct(input_ids, attention_mask)``: ``[CLS] tokens [SEP]`` cut to
    ``max_len`` (tokens keep ``max_len - 2``), right-padded with ``[PAD]``.
    Unknown tokens map to ``[UNK]``."""
    m = index_map if index_map is not None else char_index_map(hyphen)
    off = 1 if hyphen else 0
    pad_id = off + len(RESIDUES) + SPECIALS.index(PAD)
    unk_id = off + len(RESIDUES) + SPECIALS.index(UNK)
    cls_id = off + len(RESIDUES) + SPECIALS.index(CLS)
    sep_id = off + len(RESIDUES) + SPECIALS.index(SEP)
    t = F.slice(_c(tokens), 1, max_len - 2)
    ids = F.transform(t, lambda x: F.coalesce(F.try_element_at(m, x), F.lit(unk_id)))
    body = F.concat(F.array(F.lit(cls_id)), ids, F.array(F.lit(sep_id)))
    n_pad = F.greatest(F.lit(0), F.lit(max_len) - F.size(body))
    input_ids = F.concat(body, F.array_repeat(F.lit(pad_id), n_pad))
    mask = F.concat(F.array_repeat(F.lit(1), F.size(body)), F.array_repeat(F.lit(0), n_pad))
    return F.struct(input_ids.alias("input_ids"), mask.alias("attention_mask"))


def encode_letters(df: DataFrame, col: str, max_len: int, keys: list[str], out: str = "input_ids", hyphen: bool = False) -> DataFrame:
    """``(*keys, out)``: the ``input_ids`` of ``encode_fixed(tokenize_chars(col), max_len)``
    made of whole batches of texts; a null text has null ids.  Map-only."""
    fixed = ([GAP] if hyphen else []) + list(RESIDUES) + SPECIALS
    pad, unk, cls, sep = (fixed.index(t) for t in (PAD, UNK, CLS, SEP))
    table = np.full(129, unk, np.int32)  # the last one stands for all other letters
    table[[ord(t) for t in fixed if len(t) == 1]] = [i for i, t in enumerate(fixed) if len(t) == 1]

    def run(batches):
        for b in A.blocks(batches, "_text", rows=2048):
            text = b.column(b.num_columns - 1)
            _, _, first, points = A.letters(text)
            size = np.diff(first)
            kept = np.minimum(size, max_len - 2)
            row = np.repeat(np.arange(len(size)), kept)
            i = np.arange(len(row)) - np.repeat(np.cumsum(kept) - kept, kept)
            ids = np.full((len(size), max_len), pad, np.int32)
            ids[:, 0] = cls
            ids[row, i + 1] = table[np.minimum(points[first[row] + i], 128)]
            if max_len > 2:
                ids[size == 0, 1] = unk  # an empty text has one token, the empty one
                kept = np.maximum(kept, 1)
            ids[np.arange(len(size)), kept + 1] = sep
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], A.lists(ids.ravel(), np.arange(len(size) + 1) * max_len, np.asarray(text.is_null()))],
                                             names=[*keys, out])
    src = df.select(*keys, F.col(col).alias("_text"))
    schema = ST.StructType([*src.schema.fields[:-1], ST.StructField(out, ST.ArrayType(ST.IntegerType()))])
    return src.mapInArrow(run, schema)


# T12 -----------------------------------------------------------------------
def merge_corpora(a: DataFrame, b: DataFrame, max_len: int, seq_col: str = "sequence") -> DataFrame:
    """Concatenate two raw corpora (by column name), then window again."""
    return sequence_windows(a.unionByName(b, allowMissingColumns=True), max_len, seq_col)


# T13 -----------------------------------------------------------------------
def corpus_size(windows: DataFrame, max_len: int) -> DataFrame:
    """Windows, and tokens including padding (= windows x max_len)."""
    return windows.agg(F.count(F.lit(1)).alias("n_windows"),
                       (F.count(F.lit(1)) * max_len).alias("n_tokens"))


# T8 / T9 / T10 --------------------------------------------------------------
def vocab_tables(vocab_z: DataFrame, sizes=(2, 3), alphabet: str = RESIDUES) -> dict[int, np.ndarray]:
    """``freq_z`` of all grams of each size over ``alphabet`` (0 when unseen),
    by the gram's number in base ``len(alphabet)``.  At most one row per such
    gram reaches the driver; a vocabulary token of these sizes with another
    letter, or listed twice, is an error."""
    sizes = sorted(set(sizes))
    bound = sum(len(alphabet) ** s for s in sizes)
    rows = (vocab_z.filter(F.length("token").isin(sizes))
            .select("token", F.col("freq_z").cast("double").alias("z")).limit(bound + 1).collect())
    code = {c: i for i, c in enumerate(alphabet)}
    tables, seen = {s: np.zeros(len(alphabet) ** s) for s in sizes}, set()
    for r in rows:
        if r.token in seen or not set(r.token) <= code.keys():
            raise ValueError(f"vocabulary token twice or with a letter outside the alphabet: {r.token!r}")
        seen.add(r.token)
        at = 0
        for c in r.token:
            at = at * len(alphabet) + code[c]
        tables[len(r.token)][at] = r.z or 0.0
    return tables


def choose(points: np.ndarray, first: np.ndarray, tables: dict[int, np.ndarray], alphabet: str) -> np.ndarray:
    """Length of the token chosen at every letter.  Candidates are the grams
    of each size that end within the row; their ``freq_z`` (0 when unseen)
    decide: the last letter is always single; a zero sum of the candidates'
    values gives the single letter; otherwise the highest value wins, ties go
    to the shorter token."""
    n = len(points)
    code = np.full(max(n and int(points.max()) + 1, 256), -1)
    code[[ord(c) for c in alphabet]] = np.arange(len(alphabet))
    code = np.append(code[points], np.full(max(tables), -1))
    left = np.repeat(first[1:], np.diff(first)) - np.arange(n)
    total, best, hop = np.zeros(n), np.full(n, -np.inf), np.ones(n, np.int64)
    for size, table in tables.items():
        known, at = np.ones(n, bool), np.zeros(n, np.int64)
        for j in range(size):
            known &= code[j:j + n] >= 0
            at = at * len(alphabet) + code[j:j + n]
        z = np.where(known, table[np.where(known, at, 0)], 0.0)
        fits = left >= size
        total += np.where(fits, z, 0.0)
        better = fits & (z > best)
        best[better], hop[better] = z[better], size
    return np.where((left == 1) | (total == 0), 1, hop)


def walk(hop: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Letters where a token starts if each row is walked from its first
    letter by the chosen lengths (all rows step together)."""
    taken = np.zeros(len(hop), bool)
    at, end = first[:-1], first[1:]
    while True:
        live = at < end
        if not live.any():
            return np.flatnonzero(taken)
        at, end = at[live], end[live]
        taken[at] = True
        at = at + hop[at]


def token_lists(text: pa.Array, tables: dict[int, np.ndarray], alphabet: str, overlap: bool, pair: bool = False) -> pa.Array:
    """The tokens of each text of a batch: the choice at every letter, or a
    walk by the chosen lengths; a null text has null tokens."""
    data, start, first, points = A.letters(text)
    rows = first
    if pair:
        gap = np.flatnonzero(points == ord(GAP))
        bad = np.diff(np.searchsorted(gap, first)) != 1
        if bad.any():
            raise ValueError(f"expected one hyphen: {text[int(np.argmax(bad))]}")
        first = np.sort(np.concatenate([first, gap, gap + 1]))
    hop = choose(points, first, tables, alphabet)
    at = np.arange(len(hop)) if overlap else walk(hop, first)
    return A.string_lists(data, start, at, hop[at], np.searchsorted(at, rows), np.asarray(text.is_null()))


def _tokenize(df: DataFrame, col: str, key_cols: list[str], tables: dict[int, np.ndarray], alphabet: str,
              overlap: bool, pair: bool = False) -> DataFrame:
    def run(batches):
        for b in A.blocks(batches, "_text"):
            tokens = token_lists(b.column(b.num_columns - 1), tables, alphabet, overlap, pair)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], tokens], names=[*key_cols, "tokens"])
    src = df.select(*key_cols, F.col(col).alias("_text"))
    out = ST.StructType([*src.schema.fields[:-1], ST.StructField("tokens", ST.ArrayType(ST.StringType()))])
    return src.mapInArrow(run, out)


def tokenize_fmfcm(df: DataFrame, col: str, key_cols: list[str], vocab_z: DataFrame, sizes=(2, 3),
                   alphabet: str = RESIDUES) -> DataFrame:
    """``(*keys, tokens)``, the frequency choice at every position, step 1
    (overlapping).  Unseen tokens count 0 (the reference raises).  A null text
    has null tokens, an empty one none.  Map-only."""
    return _tokenize(df, col, key_cols, vocab_tables(vocab_z, sizes, alphabet), alphabet, overlap=True)


def tokenize_fmfm(df: DataFrame, col: str, key_cols: list[str], vocab_z: DataFrame, sizes=(2, 3),
                  alphabet: str = RESIDUES) -> DataFrame:
    """Forward maximum-frequency matching — the same choice, then jump
    by the chosen token's length."""
    return _tokenize(df, col, key_cols, vocab_tables(vocab_z, sizes, alphabet), alphabet, overlap=False)


def tokenize_pair(df: DataFrame, col: str, key_cols: list[str], vocab_z: DataFrame,
                  method: str = "fmfm", sizes=(2, 3), alphabet: str = RESIDUES) -> DataFrame:
    """``a-b`` split at the hyphen, both sides tokenized, a ``-`` token
    between them.  Anything but exactly one hyphen fails the job."""
    if method not in ("fmfm", "fmfcm"):
        raise ValueError(method)
    return _tokenize(df, col, key_cols, vocab_tables(vocab_z, sizes, alphabet), alphabet,
                     overlap=method == "fmfcm", pair=True)
