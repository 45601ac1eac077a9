"""Language-model scoring by context-tree weighting over bytes.

Every byte is eight binary decisions; each decision has a tree of contexts (the
last 0 to ``DEPTH`` bytes, newest first) whose nodes hold Krichevsky-Trofimov
estimates.  A node's weighted probability halves between its own estimate and
the product of its children's, which gives each context's posterior weight of
stopping there; a prediction mixes the estimates of all depths with these.

Training counts grams (context and next byte) of all training texts in Spark:
partial counts per task, summed in parts by the hash of the context's newest
``NEAR`` bytes, so a part has whole subtrees and weights them by itself; every
counted context takes part.  What lies above are the contexts of 0 to 2 bytes,
256^2 x 255 nodes at most, which are sent to all tasks.  The trained tree grows
with the input and stays in its parts: chunks of documents send their distinct
grams to the parts, which answer the code length of each.

The unigram base needs the count of every token: chunks of documents send
their distinct tokens to one task per hash range, which answers the counts.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqforge.llm import common as C

DEPTH = 6
#: A part of the tree has all contexts that share so many newest bytes.
NEAR = 3
END = 0xFF  # in no UTF-8 text: it ends a text and fills the context before it
#: Distinct grams that a task holds before it sends them.
HELD = 3 << 20
#: Bytes of text whose grams or words a task makes at once.
BLOCK = 1 << 20
BYTE = C.U64(8)
LGAMMA = np.frompyfunc(math.lgamma, 1, 1)
#: lgamma(n + 0.5) and lgamma(n + 1) of small counts.
SMALL = [LGAMMA(np.arange(1 << 12) + x).astype(float) for x in (0.5, 1.0)]
FOLDED = C.BYTE_CODES[C.LOWER]
END_TOKEN = C.mix(np.array([END], np.uint64))[0]
ADDED = ["n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"]


# ---------------------------------------------------------------- grams

def gram_keys(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, first): for every byte of the lower-cased texts and one end each,
    its context, newest byte highest, and the byte lowest."""
    n = len(offs) - 1
    size = np.diff(offs)
    shift = DEPTH * (np.arange(n) + 1) + np.arange(n)
    seq = np.full(len(data) + n * (DEPTH + 1), END, np.uint8)
    seq[np.arange(len(data)) + np.repeat(shift, size)] = C.LOWER[data]
    # runs of bytes with the newest highest: of 2, then 4, then DEPTH = 6
    two = (seq[1:].astype(C.U64) << BYTE) | seq[:-1]
    four = (two[2:] << C.U64(16)) | two[:-2]
    six = (four[2:] << C.U64(16)) | two[:-4]
    key = (six[:-1] << BYTE) | seq[DEPTH:] if len(six) else np.zeros(0, C.U64)
    # the windows whose last byte is a filler belong to no text
    begin = offs[:-1] + shift - DEPTH
    filler = (begin[1:, None] + np.arange(DEPTH) - DEPTH).ravel()
    return np.delete(key, filler), offs + np.append(np.arange(n), n)


def gram_blocks(batches, text_col: str):
    """(row, keys, first) of the texts, about ``BLOCK`` bytes at a time; a longer
    text comes in pieces of one row, each with the contexts of the piece before
    it, only the last with the end."""
    row = 0
    for b in C.batch_blocks(batches, text_col, BLOCK):
        data, offs = C.column_bytes(b.column(text_col))
        if b.num_rows > 1 or len(data) <= BLOCK:
            yield row, *gram_keys(data, offs)
        else:
            for at in range(0, len(data), BLOCK):
                back = min(at, DEPTH)
                part = data[at - back:at + BLOCK]
                keys, _ = gram_keys(part, np.array([0, len(part)]))
                keys = keys[back:len(keys) - (at + BLOCK < len(data))]
                yield row, keys, np.array([0, len(keys)])
        row += b.num_rows


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    head = np.flatnonzero(np.append(True, k[1:] != k[:-1])[:len(k)])
    return k[head], np.add.reduceat(counts[order], head) if len(head) else counts[:0]


def by_part(keys: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, cut): ascending grams in the order of their parts, and its bounds."""
    part = (C.mix(keys >> C.U64(8 * (DEPTH + 1 - NEAR))) % C.U64(parts)).astype(np.int64)
    return np.argsort(part, kind="stable"), np.append(0, np.cumsum(np.bincount(part, minlength=parts)))


def packed(keys: np.ndarray, counts: np.ndarray, parts: int) -> pa.RecordBatch:
    """Ascending grams, one row per part."""
    order, cut = by_part(keys, parts)
    full = np.flatnonzero(np.diff(cut))
    return pa.RecordBatch.from_pydict({
        "part": pa.array(full, pa.int32()),
        "keys": pa.array([C.pack_sorted(keys[order[cut[i]:cut[i + 1]]]) for i in full], pa.binary()),
        "counts": pa.array([counts[order[cut[i]:cut[i + 1]]].tobytes() for i in full], pa.binary())})


def _count(text_col: str, parts: int):
    def run(batches):
        held: list = []
        for _, keys, _ in gram_blocks(batches, text_col):
            held.append(np.unique(keys, return_counts=True))
            if sum(len(k) for k, _ in held) > HELD:
                held[:] = [summed(*map(np.concatenate, zip(*held)))]
                if len(held[0][0]) > HELD // 2:
                    yield packed(*held.pop(), parts)
        if held:
            yield packed(*summed(*map(np.concatenate, zip(*held))), parts)
        C.release()
    return run


def _total(few: int):
    """The grams of a part with their counts, and what its subtrees give to the
    contexts of two bytes, by the hash of these."""
    def run(key, t):
        C.release()
        k, c = summed(np.concatenate([C.unpack_sorted(x) for x in t.column("keys").to_pylist()]),
                      np.concatenate([np.frombuffer(x, np.int64) for x in t.column("counts").to_pylist()]))
        grams = chain(k, c)
        node, zeros, ones, below = (np.concatenate(x) for x in zip(*(subtree(grams, bit)[1] for bit in range(8))))
        _, at, n = np.unique(k >> BYTE, return_inverse=True, return_counts=True)
        sizes = np.bincount(np.log2(np.bincount(at, c)).astype(np.int64), n, minlength=64).astype(np.int64)
        slot = (C.mix(node >> BYTE) % C.U64(few)).astype(np.int64)
        up = [{"slot": int(i), **{n: x[slot == i].tobytes() for n, x in zip(SUMS, (node, zeros, ones, below))}} for i in np.unique(slot)]
        return pa.Table.from_pylist([{"part": key[0].as_py(), "keys": C.pack_sorted(k), "counts": c.tobytes(), "sizes": sizes.tolist(), "up": up}],
                                    schema=PART)
    return run


SUMS = ("node", "zeros", "ones", "below")
UP = pa.struct([("slot", pa.int32()), *[(n, pa.binary()) for n in SUMS]])
PART = pa.schema([("part", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()), ("sizes", pa.list_(pa.int64())), ("up", pa.list_(UP))])


def added_up(lists: dict) -> list:
    """Sums by node of the parts' lists."""
    node = np.concatenate([np.frombuffer(x, C.U64) for x in lists["node"]] or [np.zeros(0, C.U64)])
    node, at = np.unique(node, return_inverse=True)
    return [node, *(np.bincount(at, np.concatenate([np.frombuffer(x) for x in lists[n]] or [np.zeros(0)]), len(node)) for n in SUMS[1:])]


def _add_up(key, t):
    sums = added_up({n: t.column(n).to_pylist() for n in SUMS})
    return pa.table({n: pa.array([x.tobytes()], pa.binary()) for n, x in zip(SUMS, sums)})


# ---------------------------------------------------------------- tree

def log_gamma(counts: np.ndarray, half: bool) -> np.ndarray:
    """lgamma of whole counts + 0.5 (half) or + 1."""
    table = SMALL[not half]
    out = table[np.minimum(counts, len(table) - 1).astype(np.int64)]
    big = np.flatnonzero(counts >= len(table))
    out[big] = LGAMMA(counts[big] + (0.5 if half else 1.0)).astype(float)
    return out


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return log_gamma(zeros, True) + log_gamma(ones, True) - log_gamma(zeros + ones, False) - math.log(math.pi)


def parent_of(node: np.ndarray) -> np.ndarray:
    return ((node >> C.U64(16)) << BYTE) | (node & C.U64(255))


def weigh(zeros, ones, below):
    """(log weighted probability, weight of stopping) given the children's sum."""
    own = math.log(0.5) + log_kt(zeros, ones)
    all_ = np.logaddexp(own, math.log(0.5) + below)
    return all_, np.exp(own - all_)


def chain(keys: np.ndarray, counts: np.ndarray) -> list:
    """(grams, counts, place of each gram of one byte more) of DEPTH to 2 bytes of context."""
    out = [(keys, counts, None)]
    for _ in range(DEPTH, 2, -1):
        up = parent_of(keys)
        order = np.argsort(up, kind="stable")
        keys = up[order]
        new = np.append(True, keys[1:] != keys[:-1])
        at = np.empty(len(order), np.int64)
        at[order] = np.cumsum(new) - 1
        keys, counts = keys[new], np.add.reduceat(counts[order], np.flatnonzero(new))
        out.append((keys, counts, at))
    return out


def subtree(grams: list, k: int):
    """Nodes of the decision ``k`` of a byte: for depth DEPTH to 3, deepest
    first, (node, one's estimate, stop weight, place of the parent, first gram,
    node of each gram); and what depth 2 needs: (node, zeros, ones, children's
    sum).  A node is the context above the decision's place in the byte."""
    flat = []
    for keys, counts, _ in grams:
        byte = keys & C.U64(255)
        node = (keys ^ byte) | C.U64(1 << k) | (byte >> C.U64(8 - k))
        new = np.append(True, node[1:] != node[:-1])
        head = np.flatnonzero(new)
        ones = np.add.reduceat(np.where((byte >> C.U64(7 - k)) & C.U64(1), counts, 0), head)
        flat.append((node[head], np.add.reduceat(counts, head) - ones, ones, head, np.cumsum(new) - 1))
    out, below = [], None
    for i, (node, zeros, ones, head, at) in enumerate(flat[:-1]):
        weighted, stop = (log_kt(zeros, ones), np.ones(len(node))) if below is None else weigh(zeros, ones, below)
        parent = flat[i + 1][4][grams[i + 1][2][head]]
        below = np.bincount(parent, weighted, len(flat[i + 1][0]))
        out.append((node, (ones + 0.5) / (zeros + ones + 1), stop, parent, head, at))
    node, zeros, ones, *_ = flat[-1]
    return out, (node, zeros.astype(float), ones.astype(float), below)


def upper_of(sums: list) -> dict:
    """Depths 0 to 2 from the sums of depth 2: their levels, and for each node
    of depth 2 what the depths so far mix (the probability of a one) and the
    weight that they leave."""
    node, z, o, s = sums
    levels = {}
    for depth in (2, 1, 0):
        weighted, stop = weigh(z, o, s)
        place = np.log2(np.maximum(node & C.U64(255), C.U64(1)).astype(float)).astype(int)
        levels[depth] = [tuple(x[place == k] for x in (node, (o + 0.5) / (z + o + 1), stop)) for k in range(8)]
        node, at = np.unique(parent_of(node), return_inverse=True)
        z, o, s = (np.bincount(at, x, len(node)) for x in (z, o, weighted))
    state = []
    for k in range(8):
        two = levels[2][k][0]
        mixed, left = np.zeros(len(two)), np.ones(len(two))
        for depth in range(3):
            table, one, stop = levels[depth][k]
            want = two
            for _ in range(2 - depth):
                want = parent_of(want)
            at = np.searchsorted(table, want)
            mixed, left = mixed + left * stop[at] * one[at], left * (1 - stop[at])
        state.append((mixed, left))
    return {"levels": levels, "state": state}


def code_lengths(upper: dict, keys: np.ndarray, counts: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Code length in bits of the ``wanted`` ascending grams of a part, given
    its trained grams.  The nodes of a trained gram are known by their place;
    any other gram walks the tree."""
    at = np.searchsorted(keys, wanted)
    hit = np.zeros(len(wanted), bool)
    inside = at < len(keys)
    hit[inside] = keys[at[inside]] == wanted[inside]
    at, other = at[hit], wanted[~hit]
    bits, far = np.zeros(len(at)), np.zeros(len(other))
    grams = chain(keys, counts) if len(keys) else None
    for k in range(8):
        tables = {d: x[k] for d, x in upper["levels"].items()}
        if grams:
            levels, (node, *_) = subtree(grams, k)
            place = np.searchsorted(tables[2][0], node)
            mixed, left = (x[place] for x in upper["state"][k])
            for depth, (node, one, stop, parent, _, of_gram) in zip(range(3, DEPTH + 1), levels[::-1]):
                tables[depth] = node, one, stop
                mixed, left = mixed[parent] + left[parent] * stop * one, left[parent] * (1 - stop)
            p = mixed[of_gram[at]]
            bits -= np.log2(np.where((wanted[hit] >> C.U64(7 - k)) & C.U64(1), p, 1 - p))
        far += walk(tables, other, k)
    out = np.empty(len(wanted))
    out[hit], out[~hit] = bits, far
    return out


def walk(tables: dict, keys: np.ndarray, k: int) -> np.ndarray:
    """Code length in bits of the decision ``k`` of each gram's byte."""
    byte = keys & C.U64(255)
    node = C.U64(1 << k) | (byte >> C.U64(8 - k))
    one, left, mixed = np.full(len(keys), 0.5), np.ones(len(keys)), np.zeros(len(keys))
    live = np.arange(len(keys))
    for depth in range(DEPTH + 1):
        table, estimate, stop = tables.get(depth, (np.zeros(0, C.U64),) * 3)
        want = ((keys[live] >> C.U64(8 * (DEPTH - depth + 1))) << BYTE) | node[live]
        at = np.minimum(np.searchsorted(table, want), max(len(table) - 1, 0))
        here = table[at] == want if len(table) else np.zeros(len(live), bool)
        # a context that training did not see adds nothing: its parent's estimate stands for it
        gone = live[~here]
        mixed[gone] += left[gone] * one[gone]
        live, at = live[here], at[here]
        one[live] = estimate[at]
        w = stop[at] if depth < DEPTH else 1.0
        mixed[live] += left[live] * w * one[live]
        left[live] *= 1 - w
    return -np.log2(np.where((byte >> C.U64(7 - k)) & C.U64(1), mixed, 1 - mixed))


class Tree:
    """Levels 0 to DEPTH, each with the sorted nodes, estimates of a one and
    stop weights of the eight decisions."""

    def __init__(self, levels: dict):
        self.levels = levels

    def bits(self, keys: np.ndarray) -> np.ndarray:
        """Code length in bits of the last byte of each gram."""
        return sum((walk({d: x[k] for d, x in self.levels.items()}, keys, k) for k in range(8)), np.zeros(len(keys)))


class Scorer:
    """Code lengths of any grams, each different one walked once."""

    def __init__(self, model: dict):
        self.tree = Tree(model["levels"])

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        uniq, at = np.unique(keys, return_inverse=True)
        return self.tree.bits(uniq)[at]


def grow(docs: DataFrame, text_col: str, parts: int) -> tuple[DataFrame, dict]:
    """(trained grams by part, depths 0 to 2) of all texts of ``docs``."""
    counts = docs.select(text_col).mapInArrow(_count(text_col, parts), "part int, keys binary, counts binary")
    grams = C.stored(counts.groupBy("part").applyInArrow(_total(C.partitions_of(docs.sparkSession)),
        "part int, keys binary, counts binary, sizes array<long>, up array<struct<slot:int,node:binary,zeros:binary,ones:binary,below:binary>>"), "grams")
    up = grams.select(F.explode("up").alias("up")).select("up.*").groupBy("slot").applyInArrow(
        _add_up, "node binary, zeros binary, ones binary, below binary").collect()
    return grams, upper_of(added_up({n: [r[n] for r in up] for n in SUMS}))


def _levels(least: int):
    """The nodes of a part whose contexts have ``least`` occurrences and more."""
    def run(batches):
        for b in batches:
            for keys, counts in zip(b.column("keys").to_pylist(), b.column("counts").to_pylist()):
                grams = chain(C.unpack_sorted(keys), np.frombuffer(counts, np.int64))
                for k in range(8):
                    for depth, (node, one, stop, _, head, _), (g, c, _) in zip(range(DEPTH, 2, -1), subtree(grams, k)[0], grams):
                        _, at = np.unique(g >> BYTE, return_inverse=True)
                        many = (np.bincount(at, c)[at] >= least)[head]
                        yield pa.RecordBatch.from_pydict({"depth": pa.array([depth], pa.int32()), "k": pa.array([k], pa.int32()),
                            **{n: [x[many].tobytes()] for n, x in (("node", node), ("one", one), ("stop", stop))}})
    return run


def train(docs: DataFrame, text_col: str = "text", max_grams: int = 1 << 19) -> dict:
    """A tree of all texts of ``docs`` that fits one task, for a look at it:
    contexts of fewer than a power of two occurrences are left out until
    ``max_grams`` of DEPTH bytes are left.  All counted contexts weigh in
    first, so the weights do not depend on what is left out.  ``score`` leaves
    nothing out and does not use it."""
    grams, upper = grow(docs, text_col, C.n_chunks(docs, text_col)[0])
    sizes = grams.select(F.posexplode("sizes").alias("level", "n")).groupBy("level").agg(F.sum("n").alias("n")).collect()
    least, held = 1, 0
    for r in sorted(sizes, key=lambda r: -r["level"]):
        held += r["n"]
        if held > max_grams:
            least = 1 << (r["level"] + 1)
            break
    rows = grams.select("keys", "counts").mapInArrow(_levels(least), "depth int, k int, node binary, one binary, stop binary").collect()
    levels = dict(upper["levels"])
    for depth in range(3, DEPTH + 1):
        levels[depth] = []
        for k in range(8):
            own = [r for r in rows if (r["depth"], r["k"]) == (depth, k)]
            node, one, stop = (np.concatenate([np.frombuffer(r[n], t) for r in own] or [np.zeros(0, t)]) for n, t in (("node", C.U64), ("one", float), ("stop", float)))
            order = np.argsort(node)
            levels[depth].append((node[order], one[order], stop[order]))
    return {"levels": levels}


# ---------------------------------------------------------------- code lengths of a chunk's grams

def distinct(t, text_col: str) -> np.ndarray:
    """The different grams of the texts, ascending."""
    held: list = [np.zeros(0, C.U64)]
    for _, keys, _ in gram_blocks([t], text_col):
        held.append(C.ascending(keys))
        if sum(map(len, held[1:])) > HELD:
            held[:] = [C.ascending(np.concatenate(held))]
    return C.ascending(np.concatenate(held))


def _ask(parts: int, text_col: str):
    def run(key, t):
        C.release()
        keys = distinct(t, text_col)
        order, cut = by_part(keys, parts)
        full = np.flatnonzero(np.diff(cut))
        return pa.table({"part": pa.array(full, pa.int32()), "_chunk": pa.array([key[0].as_py()] * len(full), pa.int32()),
                         "keys": pa.array([C.pack_sorted(keys[order[cut[i]:cut[i + 1]]]) for i in full], pa.binary())})
    return run


def _tell(upper):
    def run(key, asked, own):
        C.release()
        if not asked.num_rows:
            return TOLD.empty_table()
        lists = [C.unpack_sorted(x) for x in asked.column("keys").to_pylist()]
        cut = np.cumsum([0, *map(len, lists)])
        uniq, at = np.unique(np.concatenate(lists), return_inverse=True)
        keys = np.concatenate([C.unpack_sorted(x) for x in own.column("keys").to_pylist()] or [np.zeros(0, C.U64)])
        counts = np.concatenate([np.frombuffer(x, np.int64) for x in own.column("counts").to_pylist()] or [np.zeros(0, np.int64)])
        bits = code_lengths(upper.value, keys, counts, uniq).astype(np.float32)[at]
        return pa.table({"_chunk": asked.column("_chunk").cast(pa.int32()), "part": asked.column("part").cast(pa.int32()), "bits": pa.array(
            [np.ascontiguousarray(bits[a:b].view(np.uint8).reshape(-1, 4).T).tobytes() for a, b in zip(cut[:-1], cut[1:])], pa.binary())}, schema=TOLD)
    return run


TOLD = pa.schema([("_chunk", pa.int32()), ("part", pa.int32()), ("bits", pa.binary())])


# ---------------------------------------------------------------- unigram base and scores

def _tokens(t, text_col: str):
    """(hash of each token, first): the words of each text and then one end."""
    codes, sizes = [np.zeros(0, C.U64)], [np.zeros(1, np.int64)]
    for b in C.batch_blocks([t], text_col, BLOCK):
        data, offs = C.column_bytes(b.column(text_col))
        starts, ends, first = C.spans_of_words(data, offs, C.SPACE)
        codes.append(np.insert(C.word_codes(data, starts, ends, FOLDED), first[1:], END_TOKEN))
        sizes.append(np.diff(first) + 1)
    return np.concatenate(codes), np.cumsum(np.concatenate(sizes))


def _offer(ranges: int, text_col: str):
    def run(key, t):
        C.release()
        codes, first = _tokens(t, text_col)
        learn = np.repeat(~np.asarray(t.column("_held")), np.diff(first))
        uniq, at = np.unique(codes, return_inverse=True)
        n = np.bincount(at, learn, minlength=len(uniq)).astype(np.uint32)
        cut = C.hash_ranges(uniq, ranges)
        full = np.flatnonzero(np.diff(cut))
        return pa.table({"_range": pa.array(full, pa.int32()), "_chunk": pa.array([key[0].as_py()] * len(full), pa.int32()),
                         "codes": pa.array([C.pack_sorted(uniq[cut[i]:cut[i + 1]]) for i in full], pa.binary()),
                         "counts": pa.array([n[cut[i]:cut[i + 1]].tobytes() for i in full], pa.binary())})
    return run


def _answer(key, t):
    lists = [C.unpack_sorted(x) for x in t.column("codes").to_pylist()]
    cut = np.cumsum([0, *map(len, lists)])
    uniq, at = np.unique(np.concatenate(lists), return_inverse=True)
    n = np.bincount(at, np.concatenate([np.frombuffer(x, np.uint32) for x in t.column("counts").to_pylist()]), len(uniq)).astype(np.int64)
    rows = len(lists)
    total = np.zeros((2, rows), np.int64)
    total[:, 0] = (n > 0).sum(), n.sum()
    return pa.table({"_chunk": t.column("_chunk").cast(pa.int32()), "_range": pa.array([key[0].as_py()] * rows, pa.int32()),
                     "counts": pa.array([np.ascontiguousarray(n[at[a:b]].view(np.uint8).reshape(-1, 8).T).tobytes() for a, b in zip(cut[:-1], cut[1:])], pa.binary()),
                     "distinct": total[0], "tokens": total[1]})


def _score(parts, ranges, distinct_tokens, tokens, text_col, schema):
    def run(key, t, answers):
        C.release()
        codes, first = _tokens(t, text_col)
        uniq, at = np.unique(codes, return_inverse=True)
        cut = C.hash_ranges(uniq, ranges)
        n = np.zeros(len(uniq), np.int64)
        tokens_of = answers.filter(answers.column("bits").is_null())
        for r, x in zip(tokens_of.column("_range").to_pylist(), tokens_of.column("counts").to_pylist()):
            n[cut[r]:cut[r + 1]] = np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(8, -1).T).view(np.int64).ravel()
        n_tokens = np.diff(first)
        new = {"n_tokens": n_tokens, "train_tokens": np.full(len(n_tokens), tokens)}
        new["n_known"] = np.add.reduceat((n[at] > 0).astype(np.int64), first[:-1]) if len(n_tokens) else n_tokens
        new["base_score"] = (np.add.reduceat(np.log10(n[at] + 1.0), first[:-1]) if len(n_tokens) else np.zeros(0)) - n_tokens * math.log10(tokens + distinct_tokens + 1)
        bits, size = np.zeros(len(n_tokens)), np.zeros(len(n_tokens), np.int64)
        grams = distinct(t, text_col)
        order, cut = by_part(grams, parts)
        lengths = np.zeros(len(grams), np.float32)
        told = answers.filter(answers.column("bits").is_valid())
        for r, x in zip(told.column("_range").to_pylist(), told.column("bits").to_pylist()):
            lengths[order[cut[r]:cut[r + 1]]] = np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(4, -1).T).view(np.float32).ravel()
        for row, keys, begin in gram_blocks([t], text_col):
            own = slice(row, row + len(begin) - 1)
            uniq, at = np.unique(keys, return_inverse=True)
            bits[own] += np.add.reduceat(lengths[np.searchsorted(grams, uniq)].astype(float)[at], begin[:-1])
            size[own] += np.diff(begin)
        new["score"] = -bits * math.log10(2)
        new["bits_per_byte"] = bits / size
        cols = [t.column(f.name) if f.name in t.column_names else pa.array(new[f.name], f.type) for f in schema]
        return pa.Table.from_arrays([c.cast(f.type) for c, f in zip(cols, schema)], schema=schema)
    return run


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 7 == 2, F.lit(False))


def score(docs: DataFrame, held, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Train on the rows where ``held`` (a boolean column, never null) is false
    and score all rows.

    The text is left out; added are n_tokens, n_known, train_tokens, base_score
    (log10 of the add-one unigram), score (log10 probability that the tree
    gives the lower-cased bytes and one end) and bits_per_byte; input columns
    of these names are replaced.  A null text is empty and has its end only; a
    null id is no reason to leave a row out; repeated rows count as often as
    they occur; an empty table gives an empty result, and without training
    rows every decision has probability one half.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    spark = docs.sparkSession
    docs = C.without(docs, [*ADDED, "_held"]).withColumn("_held", held)
    dealt, ranges, _ = C.with_chunk(docs, id_col, text_col)
    grams, upper = grow(docs.filter(~F.col("_held")), text_col, ranges)
    asked = dealt.groupBy("_chunk").applyInArrow(_ask(ranges, text_col), "part int, _chunk int, keys binary")
    told = asked.groupBy("part").cogroup(grams.select("part", "keys", "counts").groupBy("part")).applyInArrow(
        _tell(spark.sparkContext.broadcast(upper)), "_chunk int, part int, bits binary")
    offers = dealt.groupBy("_chunk").applyInArrow(_offer(ranges, text_col), "_range int, _chunk int, codes binary, counts binary")
    answers = C.stored(offers.groupBy("_range").applyInArrow(
        _answer, "_chunk int, _range int, counts binary, distinct long, tokens long"), "token-counts")
    distinct, tokens = answers.agg(F.coalesce(F.sum("distinct"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    out = T.StructType([*[f for f in docs.schema.fields if f.name not in (text_col, "_held")],
                        *[T.StructField(c, T.LongType()) for c in ADDED[:3]], *[T.StructField(c, T.DoubleType()) for c in ADDED[3:]]])
    answers = answers.select("_chunk", "_range", "counts", F.lit(None).cast("binary").alias("bits")).unionByName(
        told.select("_chunk", F.col("part").alias("_range"), F.lit(None).cast("binary").alias("counts"), "bits"))
    return dealt.groupBy("_chunk").cogroup(answers.groupBy("_chunk")).applyInArrow(
        _score(ranges, ranges, distinct, tokens, text_col, to_arrow_schema(out)), out)


def digest(docs: DataFrame) -> DataFrame:
    """The columns of query op4."""
    docs = docs.select("doc_id", held_out().alias("held_out"), "text")
    return score(docs, F.col("held_out"))
