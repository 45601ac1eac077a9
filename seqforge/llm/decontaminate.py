"""Benchmark decontamination with training suffix arrays.

Each task turns its training texts, shard by shard (about 8 MB), into a word
level suffix array and binary-searches every suffix of the benchmark in it:
the neighbours of the insertion point give the longest verbatim match, the
range that shares a whole window gives all its locations.  The array is
sparse: a suffix whose first words (as many as the shortest window has, two at
most) begin no benchmark suffix can match nothing and is left out.

No text is shuffled.  The benchmark is sent to the tasks in blocks of measured
size (``BLOCK_BYTES`` of text each).  If there are several, the state of the
documents is written after each one and its block released before the next, so
neither the driver nor a task ever holds more than one block.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqforge.llm import common as C

BLOCK_BYTES = 16 << 20
#: Words are runs of digits, letters (A-Z lower-cased) and bytes from 0x80 on.
BREAK = C.byte_class([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
FOLDED = C.BYTE_CODES[C.LOWER]
ADDED = ["n_words", "n_hit", "items", "hits", "longest_match", "longest_start", "longest_item", "contaminated"]
STATE = ["_starts", "_ends", "_items", "_best"]


class Suffixes:
    """Word codes in documents; ``code(pos)`` past a document's end is 0."""

    def __init__(self, data, offs):
        self.starts, self.ends, self.first = C.spans_of_words(data, offs, BREAK)
        w = C.word_codes(data, self.starts, self.ends, FOLDED)
        self.words = np.append(np.maximum(w, C.U64(1)), C.U64(0))
        self.doc = np.repeat(np.arange(len(offs) - 1), np.diff(self.first))
        self.stop = self.first[1:][self.doc]

    def code(self, pos, k):
        at = pos + k
        inside = at < self.stop[pos]
        return np.where(inside, self.words[np.where(inside, at, 0)], C.U64(0))


def suffix_array(s: Suffixes, pos: np.ndarray, depth: int) -> np.ndarray:
    """``pos`` in the order of their suffixes, to ``depth`` words: buckets are
    split by one word more until each holds one suffix."""
    order = pos[np.argsort(s.code(pos, 0), kind="stable")]
    if not len(order):
        return order
    c = s.code(order, 0)
    bucket = np.cumsum(np.append(False, c[1:] != c[:-1]))
    for k in range(1, depth):
        same = bucket[1:] == bucket[:-1]
        open_ = np.flatnonzero(np.append(False, same) | np.append(same, False))
        if not len(open_):
            break
        c = s.code(order[open_], k)
        live = np.lexsort((c, bucket[open_]))
        order[open_] = order[open_][live]
        c, b = c[live], bucket[open_]
        new = np.append(False, (c[1:] != c[:-1]) & (b[1:] == b[:-1]))
        split = np.zeros(len(order), np.int64)
        split[open_] = new
        bucket = bucket + np.cumsum(split)
    return order


def compare(s: Suffixes, at: np.ndarray, t: Suffixes, pos: np.ndarray, limit: np.ndarray):
    """(lcp, sign) of training suffix ``at`` against benchmark suffix ``pos``,
    looking at ``limit`` words at most; sign is that of training - benchmark."""
    lcp, sign = np.zeros(len(pos), np.int64), np.zeros(len(pos), np.int8)
    live, k = np.flatnonzero(limit > 0), 0
    while len(live):
        a, b = s.code(at[live], k), t.code(pos[live], k)
        sign[live] = np.where(a < b, -1, (a > b).astype(np.int8))
        go = (a == b) & (b != 0)
        live = live[go]
        k += 1
        lcp[live] = k
        live = live[limit[live] > k]
    return lcp, sign


def search(s: Suffixes, array: np.ndarray, t: Suffixes, pos: np.ndarray, limit: np.ndarray, after: bool) -> np.ndarray:
    """First index in the array whose suffix is not below (``after``: above)
    the first ``limit`` words of each benchmark suffix."""
    lo, hi = np.zeros(len(pos), np.int64), np.full(len(pos), len(array))
    while True:
        live = np.flatnonzero(lo < hi)
        if not len(live):
            return lo
        mid = (lo[live] + hi[live]) // 2
        lcp, sign = compare(s, array[mid], t, pos[live], limit[live])
        below = (sign < 0) & (lcp < limit[live])
        if after:
            below |= lcp >= limit[live]
        lo[live] = np.where(below, mid + 1, lo[live])
        hi[live] = np.where(below, hi[live], mid)


class Benchmark:
    """One block of items, their suffixes and windows."""

    def __init__(self, texts: list, ids: list, window: int):
        self.ids = [None if i is None else str(i) for i in ids]
        t = self.suffixes = Suffixes(*C.column_bytes(pa.array(texts, pa.string())))
        n = np.diff(t.first)
        self.depth = int(n.max(initial=0))
        self.pos = np.arange(len(t.words) - 1)
        need = np.minimum(n, window)[t.doc]
        self.left = t.stop - self.pos
        self.window = np.where(self.left >= need, need, 0)  # 0: no window starts here
        self.lead = int(min([2, *need]))
        keep = self.left >= self.lead
        self.heads = np.unique(self._heads(t, self.pos[keep]))

    def _heads(self, s, pos):
        h = s.words[pos]
        for k in range(1, self.lead):
            h = C.mix(h) + s.code(pos, k)
        return h

    def search(self, data, offs):
        """Hits in a shard: (start, end, document, item) of each occurrence of
        a window, and (document, start, length, item) of longest matches."""
        s, t = Suffixes(data, offs), self.suffixes
        pos = np.arange(len(s.words) - 1)
        none = np.zeros(0, np.int64)
        if not len(pos) or not len(self.pos):
            return s, (none, none, none, none), (none, none, none, none)
        pos = pos[s.stop - pos >= self.lead]
        h = self._heads(s, pos)
        i = np.minimum(np.searchsorted(self.heads, h), len(self.heads) - 1)
        array = suffix_array(s, pos[self.heads[i] == h], self.depth)
        if not len(array):
            return s, (none, none, none, none), (none, none, none, none)
        at = search(s, array, t, self.pos, self.left, False)
        found = []
        for near in (np.maximum(at - 1, 0), np.minimum(at, len(array) - 1)):
            found.append((compare(s, array[near], t, self.pos, self.left)[0], array[near]))
        pick = found[1][0] >= found[0][0]
        lcp, where = np.where(pick, found[1][0], found[0][0]), np.where(pick, found[1][1], found[0][1])
        hot = np.flatnonzero((self.window > 0) & (lcp >= self.window))
        lo = search(s, array, t, self.pos[hot], self.window[hot], False)
        hi = search(s, array, t, self.pos[hot], self.window[hot], True)
        n = hi - lo
        k = np.repeat(hot, n)
        begin = array[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)]
        hits = begin, begin + self.window[k], s.doc[begin], t.doc[k]
        # a location's longest match: its own with each benchmark suffix that reaches a window there
        full = compare(s, begin, t, self.pos[k], self.left[k])[0]
        return s, hits, (s.doc[begin], begin, full, t.doc[k])


def _scan(bench, text_col: str, window: int):
    state = [pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.string()), pa.struct([("n", pa.int32()), ("start", pa.int32()), ("item", pa.string())])]

    def run(batches):
        block = bench.value
        b = Benchmark([r[1] for r in block], [r[0] for r in block], window)
        for batch in C.batch_blocks(batches, text_col):
            names = batch.schema.names
            old = [batch.column(names.index(c)).to_pylist() for c in STATE]
            data, offs = C.column_bytes(batch.column(text_col))
            s, (lo, hi, doc, item), (bdoc, bat, blen, bitem) = b.search(data, offs)
            order = np.lexsort((hi, lo, doc))
            cut = np.searchsorted(doc[order], np.arange(batch.num_rows + 1))
            for d in np.unique(doc).tolist():
                o = order[cut[d]:cut[d + 1]]
                spans = np.unique(np.stack([lo[o], hi[o]], 1), axis=0) - s.first[d]
                old[0][d] = [*(old[0][d] or []), *spans[:, 0].tolist()]
                old[1][d] = [*(old[1][d] or []), *spans[:, 1].tolist()]
                names_ = {b.ids[i] for i in np.unique(item[o]).tolist()} - {None}
                old[2][d] = sorted({*(old[2][d] or []), *names_})
            best = np.lexsort((bitem, bat, -blen, bdoc))
            for j in best[np.append(True, np.diff(bdoc[best]) > 0)].tolist() if len(best) else []:
                d, now = int(bdoc[j]), {"n": int(blen[j]), "start": int(bat[j] - s.first[bdoc[j]]), "item": b.ids[bitem[j]]}
                if not old[3][d] or old[3][d]["n"] < now["n"]:
                    old[3][d] = now
            cols = [c for n, c in zip(names, batch.columns) if n not in (*STATE, "_n")]
            kept = [n for n in names if n not in (*STATE, "_n")]
            yield pa.RecordBatch.from_arrays(
                [*cols, pa.array(np.diff(s.first), pa.int64()), *[pa.array(v, t) for v, t in zip(old, state)]],
                names=[*kept, "_n", *STATE])
    return run


def _finish(arrow_schema):
    def run(batches):
        for b in batches:
            col = {n: b.column(i) for i, n in enumerate(b.schema.names)}
            new = {k: [] for k in ADDED}
            for n, lo, hi, items, best in zip(*[col[c].to_pylist() for c in ("_n", *STATE)]):
                mask = C.covered(np.array(lo or [], np.int64), np.array(hi or [], np.int64) - np.array(lo or [], np.int64), n)
                a, z = C.runs_of(mask)
                new["n_words"].append(n)
                new["n_hit"].append(int(mask.sum()))
                new["items"].append(items or [])
                new["hits"].append([{"start": int(x), "end": int(y)} for x, y in zip(a, z)])
                new["longest_match"].append(best["n"] if best else 0)
                new["longest_start"].append(best["start"] if best else None)
                new["longest_item"].append(best["item"] if best else None)
                new["contaminated"].append(bool(mask.any()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(new[f.name], f.type) if f.name in new else col[f.name].cast(f.type) for f in arrow_schema],
                schema=arrow_schema)
    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, text_col: str = "text",
                  item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """Find every window of ``window`` consecutive benchmark words (an item of
    fewer words is one window) in the documents.

    Keeps all columns of ``docs`` and adds n_words, n_hit (words inside any
    occurrence), items (ids as strings, sorted), hits (maximal word intervals
    [start, end)), longest_match with longest_start and longest_item (the
    longest verbatim match at a location that holds a window; 0 and nulls
    without one) and contaminated; an input column of one of these names is
    replaced.  Null texts and items have no words; an item with a null id
    counts for hits but is not named; repeated ids are named once.  An empty
    benchmark leaves every document clean, empty documents give an empty result.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    spark = docs.sparkSession
    docs = C.without(docs, ADDED)
    items = benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(item_text).alias("t")).filter("t is not null")
    size = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = max(1, math.ceil(size / BLOCK_BYTES))
    items = items.withColumn("block", F.pmod(F.xxhash64("i", "t"), F.lit(blocks)))
    ints = T.ArrayType(T.IntegerType())
    best = T.StructType([T.StructField("n", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("item", T.StringType())])
    scan = T.StructType([*docs.schema.fields, T.StructField("_n", T.LongType()), T.StructField("_starts", ints),
                         T.StructField("_ends", ints), T.StructField("_items", T.ArrayType(T.StringType())), T.StructField("_best", best)])
    out = docs.select("*", *[F.lit(None).cast(scan[c].dataType).alias(c) for c in ("_n", *STATE)])
    for k in range(blocks):
        rows = [(r.i, r.t) for r in items.filter(F.col("block") == k).collect()]
        sent = spark.sparkContext.broadcast(rows)
        out = out.mapInArrow(_scan(sent, text_col, window), scan)
        if blocks > 1:
            out = C.stored(out, f"decontaminate-{k}")
            sent.destroy()
    span = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    final = C.added_schema(docs, ("n_words", T.LongType()), ("n_hit", T.LongType()), ("items", T.ArrayType(T.StringType())),
                           ("hits", span), ("longest_match", T.IntegerType()), ("longest_start", T.IntegerType()),
                           ("longest_item", T.StringType()), ("contaminated", T.BooleanType()))
    return out.mapInArrow(_finish(to_arrow_schema(final)), final)


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The columns of query op7."""
    return decontaminate(docs.select("doc_id", "text"), benchmark).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Pipeline stage: documents without any benchmark window."""
    return decontaminate(docs, benchmark).filter(~F.col("contaminated")).select(*docs.columns)
