"""Suffix-array dedup of byte strings by bucket-pointer refinement.

A byte is removed if a string of ``size`` bytes that covers it also starts
anywhere else.  Sorting every suffix of the corpus is not needed for that:

1. Every window of ``size`` bytes is assigned to its anchor, the leftmost
   smallest hash among the half-as-long grams inside it.  Equal windows have
   equal anchors, so only windows of the same anchor gram can be equal.
   Consecutive windows with one anchor form a segment.
2. Each chunk of documents sends, per distinct segment, the hash of its anchor
   gram and of its bytes, to the task of that hash range.  The task answers
   whether the same segment occurs twice (all its windows are repeated) and
   whether the gram has several different segments; of those, the lowest
   chunk that has one sends its bytes, once.  A chunk has a fixed number of
   ranges; beyond 2^8 chunks (1 GB) a task asks a level of tasks over groups.
3. The different segments of a gram meet in one task, which builds their
   suffix array: buckets by the first 8 bytes are refined by sorting on the
   bucket identifiers of later offsets (8, 16, ...), refined identifiers being
   used at once by the buckets that follow.  Neighbours in the array that
   share ``size`` bytes, compared exactly, are repeated.

A passage that a third of all documents share is one segment per chunk in step
2 and one segment in all in step 3.  A gram with more than ``MANY`` different
segments (a common line in ever other surroundings) would still gather them in
one task: the windows of its segments are counted instead by the hash of their
``size`` bytes, each chunk sending each hash once, which is as exact but for
hash collisions and needs no group.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqforge.llm import common as C

ADDED = ["n_bytes", "n_removed", "n_spans", "removed", "kept", "kept_sha256"]
POS_BITS = 24
#: Positions handled at once; below 2^POS_BITS.
PIECE = 1 << 19
Q = 8
BLOCK = 1 << 16
#: Text of segments that one suffix array is built over.
SORT_BYTES = 1 << 18
#: A chunk cuts its entries into 2^RANGE_BITS ranges, however large the input is.
RANGE_BITS = 8
#: Different segments of one gram that meet in a suffix array.
MANY = 64


def anchors(roll, n: int, size: int, gram: int) -> np.ndarray:
    """Anchor position of the window that starts at each of n - size + 1 bytes."""
    out = np.zeros(max(n - size + 1, 0), np.int64)
    width, mask = size - gram + 1, C.U64((1 << POS_BITS) - 1)
    for base in range(0, len(out), PIECE):
        to = min(base + PIECE, len(out))
        at = np.arange(base, to + width - 1)
        low = (C.range_hash(roll, at, at + gram) & ~mask) | (at - base).astype(C.U64)
        span = 1
        while 2 * span <= width:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        if span < width:
            low = np.minimum(low[:len(low) - (width - span)], low[width - span:])
        out[base:to] = base + (low & mask).astype(np.int64)
    return out


class Segments:
    """Segments of a chunk's documents: windows [first, last] of one anchor."""

    def __init__(self, data, offs, size, gram):
        self.data, self.size = data, size
        self.roll = roll = C.rolling(C.BYTE_CODES[data])
        anchor = anchors(roll, len(data), size, gram)
        docs = np.flatnonzero(np.diff(offs) >= size)
        first, last = [], []
        for d in docs.tolist():
            a = anchor[offs[d]:offs[d + 1] - size + 1]
            new = np.flatnonzero(a[1:] != a[:-1]) + 1
            first.append(np.append(0, new) + offs[d])
            last.append(np.append(new - 1, len(a) - 1) + offs[d])
        none = np.zeros(0, np.int64)
        self.first, self.last = (np.concatenate(x) if x else none for x in (first, last))
        at = anchor[self.first]
        # anchors have the smallest hashes: hashed once more they spread over all ranges
        key = C.mix(C.range_hash(roll, at, at + gram) + C.U64(0x9E3779B97F4A7C15))
        body = C.mix(C.range_hash(roll, self.first, self.last + size) + (at - self.first).astype(C.U64))
        both = np.empty(len(at), dtype=[("key", C.U64), ("body", C.U64)])
        both["key"], both["body"] = key, body
        order = np.lexsort((body, key))
        b = both[order]
        new = np.append(True, b[1:] != b[:-1])[:len(b)]
        self.entry = np.empty(len(b), np.int64)
        self.entry[order] = np.cumsum(new) - 1
        self.keys, self.bodies = b["key"][new], b["body"][new]
        self.sample = order[new]  # one segment of each entry
        self.twice = np.bincount(self.entry, minlength=len(self.keys)) > 1

    def windows(self, entries: np.ndarray):
        """(hash, segment, start) of each window of the segments of ``entries``."""
        at = np.flatnonzero(np.isin(self.entry, entries))
        n = self.last[at] - self.first[at] + 1
        seg = np.repeat(at, n)
        start = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + self.first[seg]
        return C.range_hash(self.roll, start, start + self.size), seg, start

    def text(self, entry: int) -> bytes:
        s = self.sample[entry]
        return self.data[self.first[s]:self.last[s] + self.size].tobytes()


OFFER = pa.schema([("_range", pa.int64()), ("_chunk", pa.int32()), ("keys", pa.binary()), ("bodies", pa.binary()), ("twice", pa.binary())])
OFFER_DDL = "_range long, _chunk int, keys binary, bodies binary, twice binary"
ANSWER = "_chunk int, _range long, codes binary, entry long, runs array<int>"


def _packets(keys, bodies, twice, bits: int, chunk: int) -> pa.Table:
    """Entries in ascending order of their keys, one row per range of the keys."""
    part, cut = C.cut_by_bits(keys, bits)
    spans = [slice(a, b) for a, b in zip(cut[:-1], cut[1:])]
    return pa.Table.from_arrays([
        pa.array(part, pa.int64()), pa.array(np.full(len(part), chunk), pa.int32()),
        pa.array([C.pack_sorted(keys[x]) for x in spans], pa.binary()),
        pa.array([bodies[x].tobytes() for x in spans], pa.binary()),
        pa.array([np.packbits(twice[x]).tobytes() for x in spans], pa.binary())], schema=OFFER)


def _offer(size, gram, bits, text_col):
    def run(key, t):
        C.release()
        s = Segments(*C.column_bytes(t.column(text_col)), size, gram)
        return _packets(s.keys, s.bodies, s.twice, bits, key[0].as_py())
    return run


class Gathered:
    """The entries of one range, of several chunks: which are equal, and which
    of these comes first."""

    def __init__(self, t):
        self.t = t = t.sort_by("_chunk")
        keys = [C.unpack_sorted(x) for x in t.column("keys").to_pylist()]
        self.cut = np.cumsum([0, *map(len, keys)])
        k = np.concatenate(keys)
        body = np.concatenate([np.frombuffer(x, C.U64) for x in t.column("bodies").to_pylist()])
        twice = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=len(y)) for x, y in zip(t.column("twice").to_pylist(), keys)]).astype(bool)
        self.order = order = np.lexsort((np.arange(len(k)), body, k))
        self.keys, self.bodies = k[order], body[order]
        self.new_key = np.append(True, self.keys[1:] != self.keys[:-1])
        self.new = self.new_key | np.append(True, self.bodies[1:] != self.bodies[:-1])
        self.group = np.cumsum(self.new) - 1
        self.repeated = np.bincount(self.group) > 1
        np.logical_or.at(self.repeated, self.group, twice[order])

    def answer(self, codes) -> pa.Table:
        """``codes``: of each entry, in this order."""
        code = np.empty(len(self.order), np.uint8)
        code[self.order] = codes
        t, n = self.t, self.t.num_rows
        return pa.table({"_chunk": t.column("_chunk").cast(pa.int32()), "_range": t.column("_range"),
                         "codes": pa.array([code[a:b].tobytes() for a, b in zip(self.cut[:-1], self.cut[1:])], pa.binary()),
                         "entry": pa.nulls(n, pa.int64()), "runs": pa.nulls(n, pa.list_(pa.int32()))})


def _answer(most: int):
    """Per entry of a chunk: 1 if its segment is repeated, plus 2 if it has to
    send it, plus 4 if its gram has too many segments for a suffix array."""
    def run(key, t):
        C.release()
        g = Gathered(t)
        kinds = np.bincount((np.cumsum(g.new_key) - 1)[g.new])  # different segments of each key
        kinds = kinds[np.cumsum(g.new_key) - 1]
        return g.answer(g.repeated[g.group] + 2 * ((kinds > 1) & g.new) + 4 * (kinds > most))
    return run


def _upward(bits: int):
    def run(key, t):
        C.release()
        g = Gathered(t)
        return _packets(g.keys[g.new], g.bodies[g.new], g.repeated, bits, key[1].as_py())
    return run


def _downward(bits: int):
    def run(key, t, answers):
        C.release()
        g = Gathered(t)
        code = _codes(g.keys[g.new], bits, answers)[g.group]
        return g.answer(np.where(g.new, code, code & 5))
    return run


def _answers(offers: DataFrame, chunks: int, most: int, bits: int, step: int) -> DataFrame:
    """The codes of all entries.  A task takes the packets of one range from up
    to 2^step chunks; if there are more, neighbouring ones form a group, whose
    task keeps each entry once, cuts the range further and asks the groups, so
    the rows of all levels are in proportion to the chunks."""
    if chunks <= 1 << step:
        return offers.groupBy("_range").applyInArrow(_answer(most), ANSWER)
    groups = -(-chunks >> step)
    finer = bits + min(step, max(1, (groups - 1).bit_length()))
    if finer > 48:
        raise ValueError("more levels than the hashes have bits")
    offers = offers.withColumn("_group", F.shiftright("_chunk", step))
    up = offers.groupBy("_range", "_group").applyInArrow(_upward(finer), OFFER_DDL)
    down = _answers(up, groups, most, finer, step).withColumn("_top", F.shiftright("_range", finer - bits))
    return offers.groupBy("_range", "_group").cogroup(down.groupBy("_top", "_chunk")).applyInArrow(_downward(finer), ANSWER)


def _codes(keys, bits: int, answers) -> np.ndarray:
    part, cut = C.cut_by_bits(keys, bits)
    code = np.zeros(len(keys), np.uint8)
    for r, x, e in zip(answers.column("_range").to_pylist(), answers.column("codes").to_pylist(), answers.column("entry").to_pylist()):
        if x is not None and e is None:
            i = np.searchsorted(part, r)
            code[cut[i]:cut[i + 1]] = np.frombuffer(x, np.uint8)
    return code


def _send(size, gram, bits, ranges, text_col):
    def run(key, t, answers):
        C.release()
        s = Segments(*C.column_bytes(t.column(text_col)), size, gram)
        cut = C.hash_ranges(s.keys, ranges)
        code = _codes(s.keys, bits, answers)
        e = np.flatnonzero(code & 6 == 2)
        h, twice, full, bound = _hot(s, code, ranges)
        hot = [C.pack_sorted(h[bound[i]:bound[i + 1]]) + np.packbits(twice[bound[i]:bound[i + 1]]).tobytes() for i in full]
        part = np.append(np.searchsorted(cut, e, side="right") - 1, full)
        return pa.table({
            "_range": pa.array(part, pa.int32()), "_chunk": pa.array([key[0].as_py()] * len(part), pa.int32()),
            "entry": pa.array(np.append(e, -1 - np.diff(bound)[full]), pa.int64()), "key": pa.array(np.append(s.keys[e].view(np.int64), np.zeros(len(full), np.int64))),
            "text": pa.array([*[s.text(i) for i in e.tolist()], *hot], pa.binary())})
    return run


def _hot(s: Segments, code: np.ndarray, ranges: int):
    """Distinct window hashes of the chunk's segments of crowded grams, which
    of them it has twice, the ranges that have any, and their bounds."""
    h = np.sort(s.windows(np.flatnonzero(code & 6 == 6))[0])
    new = np.append(True, h[1:] != h[:-1])[:len(h)]
    twice = np.bincount(np.cumsum(new) - 1) > 1 if len(h) else np.zeros(0, bool)
    bound = C.hash_ranges(h[new], ranges)
    return h[new], twice, np.flatnonzero(np.diff(bound)), bound


def suffix_array(data: np.ndarray, stop: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """``starts`` in the order of the first ``depth`` bytes (at least) of their
    suffixes, which end at ``stop``; by bucket-pointer refinement."""
    n = len(data)
    gram = np.zeros(n, C.U64)
    at = np.arange(n)
    for j in range(Q):
        p = np.minimum(at + j, n - 1)
        gram = (gram << C.U64(8)) | np.where(at + j < stop, data[p], 0).astype(C.U64)
    left = np.minimum(stop - at, Q)
    order = np.lexsort((left, gram))
    same = (gram[order[1:]] == gram[order[:-1]]) & (left[order[1:]] == left[order[:-1]])
    head = np.append(True, ~same)
    bucket = np.empty(n, np.int64)
    bucket[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0)) + 1
    offset = Q
    while offset < depth:
        open_ = np.flatnonzero(~head | np.append(~head[1:], False))
        if not len(open_):
            break
        heads = np.append(np.flatnonzero(head[open_]), len(open_))
        block = 0
        while block < len(open_):  # whole buckets, about BLOCK suffixes at a time
            to = heads[min(np.searchsorted(heads, block + BLOCK), len(heads) - 1)]
            sl = open_[block:to]
            pos = order[sl]
            own = bucket[pos]
            far = pos + offset
            inside = far < stop[pos]
            later = np.where(inside, bucket[np.where(inside, far, 0)], 0)
            by = np.lexsort((later, own))
            pos, own, later = pos[by], own[by], later[by]
            order[sl] = pos
            new = np.append(True, (own[1:] != own[:-1]) | (later[1:] != later[:-1]))
            head[sl] = new
            bucket[pos] = np.maximum.accumulate(np.where(new, sl, 0)) + 1
            block = to
        offset *= 2
    wanted = np.zeros(n, bool)
    wanted[starts] = True
    return order[wanted[order]]


def repeated_starts(data, stop, starts, size) -> np.ndarray:
    """Those of ``starts`` whose first ``size`` bytes begin another of them."""
    array = suffix_array(data, stop, starts, size)
    if len(array) < 2:
        return array[:0]
    a, b = array[:-1], array[1:]
    live = np.arange(len(a))
    for j in range(size):
        live = live[data[a[live] + j] == data[b[live] + j]]
        if not len(live):
            break
    return np.unique(np.concatenate([a[live], b[live]]))


def _sort(size):
    def run(key, t):
        C.release()
        out = [[], [], []]
        crowded = pa.compute.less(t.column("entry"), 0)
        bits = _count_hot(t.filter(crowded))
        for part in whole_keys(t.filter(pa.compute.invert(crowded))):
            texts = part.column("text").to_pylist()
            chunk, entry = part.column("_chunk").to_pylist(), part.column("entry").to_pylist()
            length = np.array([len(x) for x in texts])
            ends = np.cumsum(length)
            data, stop = np.frombuffer(b"".join(texts), np.uint8), np.repeat(ends, length)
            hit = repeated_starts(data, stop, np.flatnonzero(np.arange(len(data)) + size <= stop), size)
            owner = np.searchsorted(ends, hit, side="right")
            own, cut = np.unique(owner, return_index=True)
            for i, p in zip(own.tolist(), np.split(hit, cut[1:])):
                p = p - (ends[i] - length[i])
                gap = np.flatnonzero(np.diff(p) > 1) + 1
                out[0].append(chunk[i])
                out[1].append(entry[i])
                out[2].append(np.stack([p[np.append(0, gap)], p[np.append(gap - 1, len(p) - 1)]], 1).ravel().tolist())
        n, m = len(out[0]), len(bits)
        return pa.table({"_chunk": pa.array([*out[0], *[c for c, _ in bits]], pa.int32()), "_range": pa.array([*[None] * n, *[key[0].as_py()] * m], pa.int64()),
                         "codes": pa.array([*[None] * n, *[x for _, x in bits]], pa.binary()), "entry": pa.array([*out[1], *[-1] * m], pa.int64()),
                         "runs": pa.array([*out[2], *[None] * m], pa.list_(pa.int32()))})
    return run


def _count_hot(t) -> list[tuple[int, bytes]]:
    """(chunk, bits): which window hashes of a chunk occur twice in all."""
    size = [-1 - x for x in t.column("entry").to_pylist()]
    raw = t.column("text").to_pylist()
    if not raw:
        return []
    h = np.concatenate([C.unpack_sorted(x[:8 * n]) for x, n in zip(raw, size)])
    twice = np.concatenate([np.unpackbits(np.frombuffer(x[8 * n:], np.uint8), count=n) for x, n in zip(raw, size)]).astype(bool)
    _, at, many = np.unique(h, return_inverse=True, return_counts=True)
    hit = many[at] > 1
    own = np.zeros(len(many), bool)
    np.logical_or.at(own, at, twice)
    hit |= own[at]
    return [(c, np.packbits(x).tobytes()) for c, x in zip(t.column("_chunk").to_pylist(), np.split(hit, np.cumsum(size)[:-1]))]


def whole_keys(t: pa.Table):
    """Parts of the table that hold all rows of their keys, with about
    ``SORT_BYTES`` of text each (one key at least)."""
    t = t.sort_by("key").combine_chunks()
    keys = np.asarray(t.column("key"))
    ends = np.cumsum(np.asarray(pa.compute.binary_length(t.column("text"))))
    last = np.flatnonzero(np.append(keys[1:] != keys[:-1], True)) if len(keys) else []
    at = base = 0
    for i in last:
        if ends[i] - base >= SORT_BYTES or i == len(keys) - 1:
            yield t.slice(at, i + 1 - at)
            at, base = i + 1, ends[i]


def _apply(size, gram, bits, ranges, text_col, schema, with_bytes):
    def run(key, t, answers):
        C.release()
        data, offs = C.column_bytes(t.column(text_col))
        s = Segments(data, offs, size, gram)
        codes = _codes(s.keys, bits, answers)
        lo, hi = [], []  # first and last start of removed windows
        whole = (codes[s.entry] & 1).astype(bool)
        lo.append(s.first[whole])
        hi.append(s.last[whole])
        order = np.argsort(s.entry, kind="stable")
        by = np.searchsorted(s.entry[order], np.arange(len(s.keys) + 1))
        for e, runs in zip(answers.column("entry").to_pylist(), answers.column("runs").to_pylist()):
            if e is not None and e >= 0 and not codes[e] & 1:
                base = s.first[order[by[e]:by[e + 1]]]
                for a, z in zip(runs[::2], runs[1::2]):
                    lo.append(base + a)
                    hi.append(base + z)
        distinct, _, _, bound = _hot(s, codes, ranges)
        again = np.zeros(len(distinct), bool)
        for r, x, e in zip(answers.column("_range").to_pylist(), answers.column("codes").to_pylist(), answers.column("entry").to_pylist()):
            if e == -1:
                again[bound[r]:bound[r + 1]] = np.unpackbits(np.frombuffer(x, np.uint8), count=bound[r + 1] - bound[r])
        if len(distinct):
            h, _, start = s.windows(np.flatnonzero(codes & 6 == 6))
            lo.append(start[again[np.searchsorted(distinct, h)]])
            hi.append(lo[-1])
        lo, hi = np.concatenate(lo), np.concatenate(hi)
        gone = C.covered(lo, hi - lo + size, len(data))
        new = {k: [] for k in ADDED}
        for a, b in zip(offs[:-1], offs[1:]):
            m = gone[a:b]
            x, y = C.runs_of(m)
            kept = data[a:b][~m].tobytes()
            new["n_bytes"].append(int(b - a))
            new["n_removed"].append(int(m.sum()))
            new["n_spans"].append(len(x))
            new["removed"].append([{"start": int(p), "end": int(q)} for p, q in zip(x, y)])
            new["kept"].append(kept if with_bytes else None)
            new["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
        cols = [t.column(f.name) if f.name in t.column_names else pa.array(new[f.name], f.type) for f in schema]
        return pa.Table.from_arrays([c.cast(f.type) for c, f in zip(cols, schema)], schema=schema)
    return run


def suffix_dedup(docs: DataFrame, size: int = 400, with_bytes: bool = True, many: int = MANY, id_col: str = "doc_id", text_col: str = "text",
                 range_bits: int = RANGE_BITS, chunk_bytes: int = C.CHUNK_BYTES) -> DataFrame:
    """Remove every byte covered by a string of ``size`` bytes that also starts
    anywhere else, in this document or another (all copies go).

    Keeps the columns of ``docs`` but the text; adds n_bytes, n_removed,
    n_spans, removed (maximal byte intervals [start, end)), kept (the bytes
    left, null unless ``with_bytes``) and kept_sha256; input columns of these
    names are replaced.  A null text is empty, texts shorter than ``size`` are
    kept whole, ids may be null or repeated (every row is a document), an empty
    table gives an empty result.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    gram = max(1, size // 2)
    docs = C.without(docs, ADDED)
    dealt, ranges, _ = C.with_chunk(docs, id_col, text_col, chunk_bytes)
    span = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    out = T.StructType([*[f for f in docs.schema.fields if f.name != text_col], T.StructField("n_bytes", T.LongType()),
                        T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("removed", span),
                        T.StructField("kept", T.BinaryType()), T.StructField("kept_sha256", T.StringType())])
    offers = dealt.groupBy("_chunk").applyInArrow(_offer(size, gram, range_bits, text_col), OFFER_DDL)
    codes = _answers(offers, ranges, many, range_bits, range_bits)
    sent = dealt.groupBy("_chunk").cogroup(codes.groupBy("_chunk")).applyInArrow(
        _send(size, gram, range_bits, ranges, text_col), "_range int, _chunk int, entry long, key long, text binary")
    sorted_ = sent.groupBy("_range").applyInArrow(_sort(size), ANSWER)
    answers = codes.unionByName(sorted_)
    return dealt.groupBy("_chunk").cogroup(answers.groupBy("_chunk")).applyInArrow(
        _apply(size, gram, range_bits, ranges, text_col, to_arrow_schema(out), with_bytes), out)


def digest(docs: DataFrame) -> DataFrame:
    """The columns of query op9."""
    return suffix_dedup(docs.select("doc_id", "text"), with_bytes=False).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
