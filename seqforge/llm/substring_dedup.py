"""Substring dedup: Rabin-Karp hashes of every fixed-length token window,
counted in Spark; repeated windows merge into maximal removal intervals.

Documents are dealt into chunks of ascending id.  Each chunk hashes all its
windows, keeps each distinct hash once, and sends the ascending hashes, cut
into a fixed number of ranges of the hash space, to one task per range.  That
task marks the hashes that a lower chunk holds too (all of whose documents have
smaller ids) and answers each chunk with one bit per hash; beyond 2^8 chunks
(1 GB of text) it asks a level of such tasks over groups of chunks
(``common.held_lower``).  Ties inside a chunk are decided there.  A passage
that a third of all documents share is one entry per chunk, so no range is hot.

Hashes are polynomial, modulo 2^64, over 64-bit word codes: among n windows
about n^2 / 2^62 pairs of different windows are expected to agree.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqforge.llm import common as C

#: A chunk cuts its hashes into 2^RANGE_BITS ranges, however large the input is.
RANGE_BITS = 8
ADDED = ["n_words", "n_removed", "removed", "kept_text", "kept_sha256"]


def _windows(texts, ids, window: int):
    """Words of a chunk and its windows: hash, start, rank of the document's
    id; documents without id have no windows."""
    data, offs = C.column_bytes(texts)
    starts, ends, first = C.spans_of_words(data, offs, C.SPACE)
    at, doc = C.window_starts(first, window)
    has_id = ~np.asarray(ids.is_null())
    at, doc = at[has_id[doc]], doc[has_id[doc]]
    codes = C.word_codes(data, starts, ends)
    return data, starts, ends, first, at, doc, C.range_hash(C.rolling(codes), at, at + window)


def _emit(window: int, bits: int, id_col: str, text_col: str):
    def run(key, t):
        C.release()
        *_, h = _windows(t.column(text_col), t.column(id_col), window)
        return C.packets(C.ascending(h), bits, key[0].as_py())
    return run


def _apply(window: int, bits: int, id_col: str, text_col: str, out_schema: pa.Schema):
    def run(key, t, answers):
        C.release()
        ids = t.column(id_col)
        data, starts, ends, first, at, doc, h = _windows(t.column(text_col), ids, window)
        uniq, inverse = np.unique(h, return_inverse=True)
        lower = C.bits_of(uniq, bits, answers)
        _, rank = np.unique(np.asarray(ids.fill_null(0)), return_inverse=True)
        rank = rank[doc]
        least = np.full(len(uniq), np.iinfo(np.int64).max)
        np.minimum.at(least, inverse, rank)
        gone = C.covered(at[lower[inverse] | (rank > least[inverse])], window, len(starts))
        buf = data.tobytes()
        n_words, n_removed, spans, kept, sha = [], [], [], [], []
        for a, b in zip(first[:-1], first[1:]):
            m = gone[a:b]
            lo, hi = C.runs_of(m)
            words = [buf[s:e] for s, e in zip(starts[a:b][~m].tolist(), ends[a:b][~m].tolist())]
            text = b" ".join(words)
            n_words.append(int(b - a))
            n_removed.append(int(m.sum()))
            spans.append([{"start": int(x), "end": int(y)} for x, y in zip(lo, hi)])
            kept.append(text.decode())
            sha.append(hashlib.sha256(text).hexdigest())
        new = {"n_words": n_words, "n_removed": n_removed, "removed": spans, "kept_text": kept, "kept_sha256": sha}
        cols = [t.column(f.name) if f.name in t.column_names else pa.array(new[f.name], f.type) for f in out_schema]
        return pa.Table.from_arrays([c.cast(f.type) for c, f in zip(cols, out_schema)], schema=out_schema)
    return run


def substring_dedup(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text",
                    range_bits: int = RANGE_BITS, chunk_bytes: int = C.CHUNK_BYTES) -> DataFrame:
    """Remove every word covered by a window of ``window`` consecutive words
    that also starts in a document with a smaller id.

    All columns of ``docs`` are kept; added are n_words, n_removed, removed
    (maximal word intervals [start, end)), kept_text (kept words joined by one
    blank) and kept_sha256; an input column of one of these names is replaced.
    A null text has no words; a document with a null id loses nothing and
    removes nothing; rows with the same id do not remove from one another;
    shorter texts have no window.  An empty table gives an empty result.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    docs = C.without(docs, ADDED)
    dealt, chunks, _ = C.with_chunk(docs, id_col, text_col, chunk_bytes)
    span = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    out = C.added_schema(docs, ("n_words", T.LongType()), ("n_removed", T.LongType()), ("removed", span),
                         ("kept_text", T.StringType()), ("kept_sha256", T.StringType()))
    sent = dealt.groupBy("_chunk").applyInArrow(_emit(window, range_bits, id_col, text_col), C.PACKETS_DDL)
    answers = C.held_lower(sent, chunks, range_bits)
    return dealt.groupBy("_chunk").cogroup(answers.groupBy("_chunk")).applyInArrow(
        _apply(window, range_bits, id_col, text_col, to_arrow_schema(out)), out)


def digest(docs: DataFrame) -> DataFrame:
    """The columns of query op1."""
    return substring_dedup(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")


def keep_unrepeated(docs: DataFrame) -> DataFrame:
    """Pipeline stage: the documents with the repeated passages taken out (a
    document without removed words keeps its text as it is)."""
    names = docs.columns
    done = substring_dedup(docs)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    done = done.withColumn("text", text)
    if "n_chars" in names:
        done = done.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return done.select(*names)
