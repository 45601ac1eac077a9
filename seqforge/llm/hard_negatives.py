"""Hard-negative mining: exact integer inner products by Strassen's recursion,
merged into heaps of positives and heaps per score window.

Vectors become integers and are packed into chunks, anchors into blocks, both
of bounded size.  Every block meets every chunk once as a tile (a merge join
of chunk numbers, so neither side is ever broadcast or gathered).  A tile is
multiplied by Strassen's seven products down to a small leaf, on int64 with
zero padding; sums and differences modulo 2^64 are exact as long as the
result fits, which a bound on the tile decides beforehand.  What would not fit is
multiplied with whole Python numbers instead.

Two passes share the tiles: the first multiplies rows of the anchor's label
and keeps each anchor's best ones; the second multiplies the other rows and
keeps, for each positive, the best ones inside its score window.  A heap is a
sorted list of k entries; heaps of one task merge there, and those of
different tasks merge in Spark by rank, so no label and no anchor is hot.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqforge.llm import common as C

#: Numbers in a chunk, rows of an anchor block, and of the sub-tiles multiplied at once.
CHUNK_CELLS, BLOCK_ROWS, TILE_ROWS, TILE_COLS, LEAF = 1 << 22, 1024, 512, 2048, 16
#: Scores are kept within this bound, so that 100 times a score fits a long.
SCORE_LIMIT = 1 << 56
NONE = np.iinfo(np.int64).min
SCALE = 256
#: Anchor blocks whose heaps a task holds at once.
HELD = 64


# ---------------------------------------------------------------- products

def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """a @ b of int64 matrices by Strassen's recursion (modulo 2^64), or of
    matrices of doubles that are whole and small enough to stay exact."""
    m, k, n = *a.shape, b.shape[1]
    if min(m, k, n) <= leaf:
        return a @ b
    if m & 1 or k & 1 or n & 1:
        return strassen(np.pad(a, ((0, m & 1), (0, k & 1))), np.pad(b, ((0, k & 1), (0, n & 1))), leaf)[:m, :n]
    h, i, w = m // 2, k // 2, n // 2
    a11, a12, a21, a22 = a[:h, :i], a[:h, i:], a[h:, :i], a[h:, i:]
    b11, b12, b21, b22 = b[:i, :w], b[:i, w:], b[i:, :w], b[i:, w:]
    both = strassen(a11 + a22, b11 + b22, leaf)
    low = strassen(a21 + a22, b11, leaf)
    right = strassen(a11, b12 - b22, leaf)
    left = strassen(a22, b21 - b11, leaf)
    high = strassen(a11 + a12, b22, leaf)
    out = np.empty((m, n), a.dtype)
    out[:h, :w] = both + left - high + strassen(a12 - a22, b21 + b22, leaf)
    out[:h, w:] = right + high
    out[h:, :w] = low + left
    out[h:, w:] = both - low + right + strassen(a21 - a11, b11 + b12, leaf)
    return out


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of ``a`` and ``b`` (shorter rows padded by
    zeros), within SCORE_LIMIT."""
    k = min(a.shape[1], b.shape[1])
    a, b = a[:, :k], b[:, :k]
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    fits = a.dtype.kind == b.dtype.kind == "i"
    bound = k * int(np.abs(a).max()) * int(np.abs(b).max()) if fits else 0
    halvings = (min(len(a), k, len(b)) // LEAF).bit_length()  # each doubles the numbers of both sides at most
    if fits and bound << 2 * halvings + 2 < 1 << 53:
        s = strassen(a.astype(np.float64), b.T.astype(np.float64, "C")).astype(np.int64)  # whole numbers, multiplied faster
    elif fits and bound < 1 << 62:
        s = strassen(a, np.ascontiguousarray(b.T))
    else:
        whole = np.frompyfunc(int, 1, 1)
        s = np.clip(whole(a) @ whole(b).T, -SCORE_LIMIT, SCORE_LIMIT).astype(np.int64)
    return np.clip(s, -SCORE_LIMIT, SCORE_LIMIT, out=s)


# ---------------------------------------------------------------- packing

def whole_numbers(values: np.ndarray) -> np.ndarray:
    """floor(256 x) in the smallest type that holds all (doubles beyond 2^62)."""
    with np.errstate(over="ignore"):
        v = np.nan_to_num(np.floor(SCALE * values.astype(np.float64)))
    top = np.abs(v).max(initial=0)
    kind = "<i2" if top < 1 << 15 else "<i4" if top < 1 << 31 else "<i8" if top < 1 << 62 else "<f8"
    return v.astype(kind)


def matrix(kind: str, raw: bytes, rows: int) -> np.ndarray:
    m = np.frombuffer(raw, kind).reshape(rows, -1) if rows else np.zeros((0, 0))
    return m.astype(np.int64) if kind != "<f8" else m


PACKED = pa.schema([("chunk", pa.int64()), ("n", pa.int32()), ("anchors", pa.int32()), ("kind", pa.string()), ("ids", pa.binary()),
                    ("labels", pa.binary()), ("is_anchor", pa.binary()), ("vectors", pa.binary())])
PACKED_DDL = "chunk long, n int, anchors int, kind string, ids binary, labels binary, is_anchor binary, vectors binary"


def _rows(t: pa.Table):
    """(ids, labels, is anchor, matrix of doubles) of the rows that take part."""
    vec = t.column("vec").combine_chunks()
    lists, ok = vec.cast(pa.large_list(pa.float64())), ~np.asarray(vec.is_null())
    sizes = np.where(ok, pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy(zero_copy_only=False), 0)
    flat = lists.flatten()  # of the valid lists only
    bad = np.asarray(flat.is_null()) | ~np.isfinite(flat.fill_null(0).to_numpy(zero_copy_only=False))
    ends = np.concatenate(([0], np.cumsum(sizes)))
    ok &= np.diff(np.concatenate(([0], np.cumsum(bad)))[ends]) == 0
    at = np.flatnonzero(ok)
    values, dim = flat.fill_null(0).to_numpy(zero_copy_only=False), int(sizes[at].max(initial=1))
    m = np.zeros((len(at), max(dim, 1)))
    row = np.repeat(np.arange(len(at)), sizes[at])
    col = np.arange(len(row)) - np.repeat(np.cumsum(sizes[at]) - sizes[at], sizes[at])
    m[row, col] = values[np.repeat(ends[at], sizes[at]) + col]
    ids, labels = (t.column(c).to_numpy()[at] for c in ("id", "label"))
    return ids, labels, t.column("is_anchor").to_numpy()[at], m


def _pack(cells: int):
    def run(batches):
        ctx = TaskContext.get()
        seq, held, size, dim = 0, [], 0, 1

        def close():
            nonlocal seq
            ids, labels, anchor, m = _rows(pa.Table.from_batches(held))
            order = np.argsort(ids, kind="stable")
            m = whole_numbers(m[order])
            row = [ctx.partitionId() << 20 | seq, len(ids), int(anchor.sum()), m.dtype.str, ids[order].tobytes(),
                   labels[order].tobytes(), anchor[order].tobytes(), m.tobytes()]
            seq += 1
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, PACKED)], schema=PACKED)
        for b in batches:
            lengths = pa.compute.fill_null(pa.compute.list_value_length(b.column("vec")), 0).to_numpy(zero_copy_only=False)
            at = 0
            while at < b.num_rows:
                widest = np.maximum(np.maximum.accumulate(lengths[at:]), dim)
                full = np.flatnonzero(((np.arange(len(widest)) + 1 + size) * widest > cells) | (np.arange(len(widest)) + size >= 1 << 16))
                take = int(full[0]) if len(full) else len(widest)
                if not take and not held:
                    take = 1  # one row larger than a chunk
                if take:
                    held.append(b.slice(at, take))
                    size, dim, at = size + take, int(widest[take - 1]), at + take
                if at < b.num_rows:
                    yield close()
                    held, size, dim = [], 0, 1
        if held:
            yield close()
    return run


ANCHOR = pa.schema([("key", pa.int64()), ("id", pa.int64()), ("label", pa.int64()), ("kind", pa.string()), ("vec", pa.binary())])


def _anchor_rows(batches):
    """The anchors of the chunks, one row each; key = chunk and place in it."""
    for b in batches:
        for r in b.to_pylist():
            ids, labels = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["labels"], np.int64)
            at = np.flatnonzero(np.frombuffer(r["is_anchor"], bool))
            m = np.frombuffer(r["vectors"], r["kind"]).reshape(r["n"], -1)
            yield pa.RecordBatch.from_arrays([
                pa.array((r["chunk"] << 16) + at), pa.array(ids[at]), pa.array(labels[at]), pa.array([r["kind"]] * len(at), pa.string()),
                pa.array([m[i].tobytes() for i in at], pa.binary())], schema=ANCHOR)


BLOCK = "block long, anchor_keys binary, anchor_labels binary, low binary, high binary, anchor_kind string, anchor_vectors binary"
BLOCK_SCHEMA = pa.schema([("block", pa.int64()), ("anchor_keys", pa.binary()), ("anchor_labels", pa.binary()), ("low", pa.binary()),
                          ("high", pa.binary()), ("anchor_kind", pa.string()), ("anchor_vectors", pa.binary())])


def _block(wanted: int, low_pct: int, high_pct: int):
    """Pack anchor rows into blocks; ``scores`` (of the positives, null in the
    first pass) become the bounds of their windows."""
    def run(batches):
        ctx, seq = TaskContext.get(), 0
        for b in batches:
            for at in range(0, b.num_rows, BLOCK_ROWS):
                t = b.slice(at, BLOCK_ROWS)
                kinds = t.column("kind").to_pylist()
                vecs = [np.frombuffer(v, k) for v, k in zip(t.column("vec").to_pylist(), kinds)]
                kind = max(kinds, key=("<i2", "<i4", "<i8", "<f8").index)
                m = np.zeros((len(vecs), max(map(len, vecs))), kind)
                for i, v in enumerate(vecs):
                    m[i, :len(v)] = v
                low, high = np.zeros((len(vecs), wanted), np.int64), np.full((len(vecs), wanted), NONE)
                for i, s in enumerate(t.column("scores").to_pylist()):
                    for j, x in enumerate(s or []):
                        low[i, j], high[i, j] = -(-low_pct * x // 100), high_pct * x // 100
                row = [ctx.partitionId() << 20 | seq, t.column("key").to_numpy().tobytes(), t.column("label").to_numpy().tobytes(),
                       low.tobytes(), high.tobytes(), kind, m.tobytes()]
                seq += 1
                yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, BLOCK_SCHEMA)], schema=BLOCK_SCHEMA)
    return run


# ---------------------------------------------------------------- heaps

def best_of(s: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row the k best scores and their ids; ``ids`` ascend, so the first of
    equal scores has the smallest id.  ``s`` is used up."""
    top, who, row = np.full((len(s), k), NONE), np.zeros((len(s), k), np.int64), np.arange(len(s))
    for j in range(min(k, s.shape[1])):
        at = s.argmax(axis=1)
        top[:, j], who[:, j] = s[row, at], ids[at]
        s[row, at] = NONE
    return top, who


def _in_windows(s: np.ndarray, ids: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row and window (low to high) the k best scores and their ids, which
    ascend.  ``low`` may leave out what a full heap no longer takes: then few
    entries of the tile are looked at again."""
    least, most = np.where(high == NONE, SCORE_LIMIT + 1, low).min(axis=1), high.max(axis=1)
    i, j = np.nonzero((s >= least[:, None]) & (s <= most[:, None]))
    if 8 * len(i) > s.size:
        found = [best_of(np.where((s >= low[:, w, None]) & (s <= high[:, w, None]), s, NONE), ids, k) for w in range(low.shape[1])]
        return tuple(np.stack(x, axis=1) for x in zip(*found))
    v, top = s[i, j], np.full((*low.shape, k), NONE)
    who = np.zeros_like(top)
    for w in range(low.shape[1]):
        ok = np.flatnonzero((v >= low[i, w]) & (v <= high[i, w]))
        ok = ok[np.lexsort((j[ok], -v[ok], i[ok]))]
        row = i[ok]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        row, at, place = row[place < k], ok[place < k], place[place < k]
        top[row, w, place], who[row, w, place] = v[at], ids[j[at]]
    return top, who


def merged(a, b):
    """Of two heaps (scores, ids) the k best entries of each row."""
    k = a[0].shape[-1]
    top, who = np.concatenate((a[0], b[0]), -1), np.concatenate((a[1], b[1]), -1)
    order = np.lexsort((who, -np.maximum(top, NONE + 1)), axis=-1)[..., :k]
    return np.take_along_axis(top, order, -1), np.take_along_axis(who, order, -1)


def _tile(r: dict, wanted: int, negatives: int, same: bool):
    """Heaps of one tile: of positives (anchors, 1, wanted), or for each
    positive of the rows in its window (anchors, wanted, negatives)."""
    keys, labels = np.frombuffer(r["anchor_keys"], np.int64), np.frombuffer(r["anchor_labels"], np.int64)
    low, high = (np.frombuffer(r[c], np.int64).reshape(len(keys), wanted) for c in ("low", "high"))
    a, b = matrix(r["anchor_kind"], r["anchor_vectors"], len(keys)), matrix(r["kind"], r["vectors"], r["n"])
    ids, row_labels = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["labels"], np.int64)
    row_keys = (r["chunk"] << 16) + np.arange(r["n"])
    heap = np.full((len(keys), 1 if same else wanted, wanted if same else negatives), NONE)
    heap = heap, np.zeros_like(heap)
    for label in np.unique(labels):
        every, cand = np.flatnonzero(labels == label), np.flatnonzero((row_labels == label) == same)
        for i in range(0, len(every), TILE_ROWS):
            rows = every[i:i + TILE_ROWS]
            for j in range(0, len(cand), TILE_COLS):
                cols = cand[j:j + TILE_COLS]
                s = scores(a[rows], b[cols])
                if same:
                    s[keys[rows][:, None] == row_keys[cols][None, :]] = NONE
                    top = best_of(s, ids[cols], wanted)
                    found = top[0][:, None], top[1][:, None]
                else:
                    found = _in_windows(s, ids[cols], np.maximum(low[rows], heap[0][rows, :, -1]), high[rows], negatives)
                for x, y in zip(heap, merged((heap[0][rows], heap[1][rows]), found)):
                    x[rows] = y
    return keys, heap


HEAP = "key long, slot int, id long, score long"


def _heaps(wanted: int, negatives: int, same: bool):
    def run(batches):
        held = {}

        def flush():
            for keys, (top, who) in held.values():
                i, slot, j = np.nonzero(top != NONE)
                yield pa.RecordBatch.from_arrays([pa.array(keys[i]), pa.array(slot.astype(np.int32)), pa.array(who[i, slot, j]),
                                                  pa.array(top[i, slot, j])], names=["key", "slot", "id", "score"])
            held.clear()
        for b in batches:
            for i in range(b.num_rows):
                r = b.slice(i, 1).to_pylist()[0]
                keys, heap = _tile(r, wanted, negatives, same)
                held[r["block"]] = keys, merged(held[r["block"]][1], heap) if r["block"] in held else heap
                if len(held) > HELD:
                    yield from flush()
        yield from flush()
    return run


def _ranked(heaps: DataFrame, k: int) -> DataFrame:
    """The k best of the entries of all heaps of an anchor's slot, by rank."""
    w = Window.partitionBy("key", "slot").orderBy(F.desc("score"), "id")
    return heaps.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


# ---------------------------------------------------------------- operator

def mine(rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 3, low_pct: int = 50, high_pct: int = 95,
         id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Hard negatives of the rows for which ``anchors`` holds: anchor_id,
    positive_id, rank, negative_id, positive_score, negative_score.

    Components become floor(256 x).  An anchor's positives are its ``positives``
    best other rows of its label; for each one the best ``negatives`` rows of
    another label whose score lies between low_pct and high_pct hundredths of
    the positive's are returned, ties by the smaller id.

    Rows with a null id, label, vector or component, or a component that is
    not finite, take no part.  A vector shorter than another counts as padded
    by zeros (an empty one scores 0).  Rows that repeat an id stay rows of
    their own: each may be an anchor, and may be a positive of the other.
    Scores beyond 2^56 either way count as 2^56.  Other columns are not read.
    An empty table gives an empty result.
    """
    spark = rows.sparkSession
    taken = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"),
                        F.col(vec_col).alias("vec"), F.coalesce(anchors, F.lit(False)).alias("is_anchor"))
    chunks = C.stored(taken.dropna(subset=["id", "label", "vec"]).mapInArrow(_pack(CHUNK_CELLS), PACKED_DDL), "chunks")
    n_chunks, n_anchors = chunks.agg(F.count("*"), F.coalesce(F.sum("anchors"), F.lit(0))).first()
    anchor = C.stored(chunks.filter("anchors > 0").mapInArrow(
        _anchor_rows, "key long, id long, label long, kind string, vec binary"), "anchors")
    blocks = max(1, -(-n_anchors // BLOCK_ROWS))
    # a chunk is sent to ``parts`` tasks, so that few chunks keep all cores busy, and each block to one part of every chunk;
    # the number of tasks is given, since by their bytes a few tasks would get them all (below Spark's own it would deal them again)
    parts = max(1, min(blocks, -(-4 * spark.sparkContext.defaultParallelism // max(1, n_chunks))))
    tasks = max(C.partitions_of(spark), 2 * parts * n_chunks)
    places = F.broadcast(chunks.select("chunk"))  # a number per chunk
    dealt = chunks.drop("anchors", "is_anchor").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)).cast("array<long>")))

    def heaps(of: DataFrame, same: bool) -> DataFrame:
        packed = C.stored(of.repartition(blocks, "key").mapInArrow(_block(positives, low_pct, high_pct), BLOCK), "blocks")
        sent = packed.withColumn("part", F.pmod(F.xxhash64("block"), F.lit(parts).cast("long"))).crossJoin(places)
        # as files the vectors look small enough to broadcast; unpacked, and sent to every chunk, they are not
        return sent.repartition(tasks, "chunk", "part").hint("merge").join(
            dealt.repartition(tasks, "chunk", "part"), ["chunk", "part"]).mapInArrow(_heaps(positives, negatives, same), HEAP)

    found = _ranked(heaps(anchor.withColumn("scores", F.lit(None).cast("array<long>")), True), positives)
    found = C.stored(found.select("key", (F.col("rank") - 1).alias("slot"), F.col("id").alias("positive_id"),
                                  F.col("score").alias("positive_score")), "positives")
    best = found.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("slot", "positive_score"))).getField("positive_score").alias("scores"))
    hard = _ranked(heaps(anchor.hint("merge").join(best, "key"), False), negatives)
    return hard.join(found, ["key", "slot"]).join(anchor.select("key", F.col("id").alias("anchor_id")), "key").select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def digest(rows: DataFrame) -> DataFrame:
    """The rows of query op11: every 50th id is an anchor, every seventh has
    its label moved on by one."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.select("vec_id", "embedding", label.alias("label")), F.col("vec_id") % 50 == 0)
