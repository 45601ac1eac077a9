"""Cross-tokenizer alignment of a byte-level BPE (A) and a sentencepiece model
with byte fallback (B), and counts of aligned id pairs over all documents.

Token spans come from the libraries: character offsets of A, proto spans of B.
Both are coarse cuts: tokens that are part of one multibyte character share
its span, and byte-fallback pieces have no width of their own.  The decoded
bytes of the tokens refine them: inside a cut each token ends where its bytes end, and a
unit whose bytes are not those of the text is no alignment at all.

Neither tokenizer joins a blank to what stands before it, if letters or signs
stand on both sides.  So a text falls into units at such blanks, and each
distinct unit of a chunk of documents is tokenized and aligned once, whole
blocks of units at a time.  A block in which a unit does not end in a cut of both
tokenizers is done again, unit by unit.

A chunk sends each distinct id pair once with the number of its documents
that hold it; pairs are summed in Spark, the highest sum of each A id is
joined back, and every chunk gets the sums of its own pairs.  A pair that all
documents hold is one row per chunk.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqforge.llm import common as C

TOKENIZER_A = "/opt/tokenizers/byte_bpe_50k.json"
TOKENIZER_B = "/opt/tokenizers/piece_bpe_32k.model"
CHUNK, BLOCK = 8 << 20, 1 << 16
ADDED = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "groups"]
CUT = re.compile(r"(?<=\S) (?=\S)")
ODD_CUT = re.compile(r"^ | $|  |[^\S ] | [^\S ]")


# ---------------------------------------------------------------- tokenizers

def byte_letters() -> dict[str, int]:
    """The letters that byte-level BPE writes bytes as: printable bytes stand
    for themselves, the others follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Side:
    """A tokenizer: ids and coarse byte ends of a text, and the bytes of each id."""

    def __init__(self, table: list[bytes]):
        self.table, self.sizes = table, np.array([len(x) for x in table])

    def cuts(self, text: str, place: np.ndarray):
        raise NotImplementedError


class ByteLevel(Side):
    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True
        letters = byte_letters()
        tokens = (self.model.id_to_token(i) or "" for i in range(self.model.get_vocab_size()))
        super().__init__([bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode() for t in tokens])

    def cuts(self, text, place):
        """``place``: the byte at which each character of blank + text ends, 0 first."""
        e = self.model.encode(" " + text, add_special_tokens=False)
        return np.array(e.ids, np.int64), place[np.array([x[1] for x in e.offsets], np.int64)]


class Pieces(Side):
    def __init__(self, path: str):
        import sentencepiece
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        super().__init__([bytes([int(n[3:5], 16)]) if self.model.is_byte(i) else n.replace("▁", " ").encode()
                          for i, n in enumerate(names)])

    def cuts(self, text, place):
        pieces = self.model.encode(text, return_type="proto").pieces
        ends = np.array([p.end for p in pieces], np.int64)
        if len(ends) and ends[-1] != place[-1] - 1:  # spans of characters
            ends = place[ends + 1] - 1
        return np.array([p.id for p in pieces], np.int64), ends + 1  # B writes the blank itself


@lru_cache(maxsize=2)
def sides(path_a: str, path_b: str) -> tuple[Side, Side, list[str]]:
    a, b = ByteLevel(path_a), Pieces(path_b)
    return a, b, [str(i) for i in range(max(len(a.table), len(b.table)))]


# ---------------------------------------------------------------- alignment of units

def units(text: str) -> list[str]:
    """A text cut at the single blanks with other than white space on both sides."""
    return CUT.split(text) if ODD_CUT.search(text) else text.split(" ")


def ragged(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ... (count[i] numbers), one after another."""
    return np.arange(count.sum()) + np.repeat(first - np.cumsum(count) + count, count)


def refined(side: Side, text: str, full: bytes, place: np.ndarray, unit_end: np.ndarray):
    """(ids, byte ends, unit of each token, units that are right), or None if a
    unit does not end in a cut."""
    ids, cuts = side.cuts(text, place)
    cuts = np.maximum.accumulate(cuts)
    upto = np.searchsorted(cuts, unit_end, side="right")
    if len(unit_end) == 1:
        upto = np.array([len(ids)])
    elif not len(ids) or (upto == 0).any() or (cuts[upto - 1] != unit_end).any():
        return None
    sizes = side.sizes[ids]
    ends = np.cumsum(sizes)
    parts = [side.table[i] for i in ids]
    unit = np.repeat(np.arange(len(unit_end)), np.diff(upto, prepend=0))
    if b"".join(parts) == full:
        return ids, ends, unit, np.ones(len(unit_end), bool)
    start, low = np.append(0, unit_end[:-1]), np.append(0, upto[:-1])
    right = np.array([b"".join(parts[i:j]) == full[s:e] for i, j, s, e in zip(low, upto, start, unit_end)])
    shift = start - np.append(0, ends)[low]
    return ids, ends + shift[unit], unit, right


def align_block(block: list[str], a: Side, b: Side, names: list[str]):
    """For units joined by blanks: per unit (right, tokens of A, of B, groups,
    links, text of the groups), and the id pairs of all links in their order."""
    text = " ".join(block)
    full = b" " + text.encode()
    data = np.frombuffer(full, np.uint8)
    place = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
    unit_end = np.cumsum([len(u.encode()) + 1 for u in block])
    left, other = refined(a, text, full, place, unit_end), refined(b, text, full, place, unit_end)
    if left is None or other is None:
        each = [align_block([u], a, b, names) for u in block]
        return (*(np.concatenate(x) for x in list(zip(*each))[:5]), [s for x in each for s in x[5]], np.concatenate([x[6] for x in each]))
    n, right = len(block), left[3] & other[3]
    (ia, ea, ua), (ib, eb, ub) = ([x[right[side[2]]] for x in side[:3]] for side in (left, other))
    ends = np.intersect1d(ea, eb, assume_unique=True)
    cut_a, cut_b = np.searchsorted(ea, ends, side="right"), np.searchsorted(eb, ends, side="right")
    group_unit = ua[cut_a - 1] if len(ends) else np.zeros(0, np.int64)
    sa, sb = [names[i] for i in ia], [names[i] for i in ib]
    texts, i, k = [[] for _ in block], 0, 0
    for u, j, m in zip(group_unit.tolist(), cut_a.tolist(), cut_b.tolist()):
        texts[u].append(f"{','.join(sa[i:j])}|{','.join(sb[k:m])}")
        i, k = j, m
    sizes = a.sizes[ia], b.sizes[ib]
    low = np.searchsorted(eb, ea - sizes[0], side="right")
    many = np.searchsorted(eb - sizes[1], ea, side="left") - low
    pairs = np.repeat(ia, many) << 32 | ib[ragged(low, many)]
    return (right, np.bincount(ua, minlength=n), np.bincount(ub, minlength=n), np.bincount(group_unit, minlength=n),
            np.bincount(ua, weights=many, minlength=n).astype(np.int64), [";".join(x) for x in texts], pairs)


class Numbers(dict):
    """Numbers distinct units in the order they come."""

    def __missing__(self, unit):
        n = self[unit] = len(self)
        return n


def planes(x: np.ndarray) -> bytes:
    """uint32 as byte planes, which the shuffle's compression shortens."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def numbers(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def align_texts(texts: list[str | None], a: Side, b: Side, names: list[str], with_groups: bool):
    """Per document (n_a, n_b, n_groups, n_links, digest, groups, indices of its
    distinct pairs, how often each), and the chunk's pairs with their documents."""
    index = Numbers()
    docs = [np.fromiter(map(index.__getitem__, units(t)), np.int64) if t else np.zeros(0, np.int64) for t in texts]
    found, block, size = [], [], 0
    for u in index:
        block.append(u)
        size += len(u)
        if size >= BLOCK:
            found.append(align_block(block, a, b, names))
            block, size = [], 0
    if block or not found:
        found.append(align_block(block or [""], a, b, names))
    index.clear()
    right, na, nb, ng, nl = (np.concatenate([f[i] for f in found]) for i in range(5))
    words = [s for f in found for s in f[5]]
    pairs, each = np.unique(np.concatenate([f[6] for f in found]), return_inverse=True)
    del found
    first = np.cumsum(nl) - nl
    out, held = [], np.zeros(len(pairs), np.int64)
    for d in docs:
        if not len(d) or not right[d].all():
            out.append((0, 0, 0, 0, "", "", np.zeros(0, np.int64), np.zeros(0, np.int64)))
            continue
        rendered = ";".join([words[i] for i in d.tolist()])
        own, times = np.unique(each[ragged(first[d], nl[d])], return_counts=True)
        held[own] += 1
        out.append((*(int(x[d].sum()) for x in (na, nb, ng, nl)), hashlib.sha256(rendered.encode()).hexdigest(),
                    rendered if with_groups else None, own, times))
    used = np.cumsum(held > 0) - 1
    return [(*o[:6], used[o[6]], o[7]) for o in out], pairs[held > 0], held[held > 0]


# ---------------------------------------------------------------- Spark

def _align(path_a: str, path_b: str, text_col: str, out: pa.Schema, with_groups: bool):
    def run(batches):
        a, b, names = sides(path_a, path_b)
        ctx, seq, held, size = TaskContext.get(), 0, [], 0

        def close():
            nonlocal seq
            t = pa.Table.from_batches(held)
            rows, pairs, docs = align_texts(t.column(text_col).to_pylist(), a, b, names, with_groups)
            t = t.drop_columns([text_col])
            empty = [None] * (len(rows) - 1)
            new = {
                **{n: [r[i] for r in rows] for i, n in enumerate(("n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups"))},
                "_own": [planes(np.diff(r[6], prepend=0)) for r in rows], "_times": [planes(r[7]) for r in rows],
                "_chunk": [ctx.partitionId() << 20 | seq] * len(rows), "_pairs": [C.pack_sorted(pairs.astype(C.U64)), *empty],
                "_docs": [planes(docs), *empty]}
            seq += 1
            C.release()
            cols = [t.column(f.name) if f.name in t.column_names else pa.array(new[f.name], f.type) for f in out]
            yield from pa.Table.from_arrays([c.cast(f.type) for c, f in zip(cols, out)], schema=out).to_batches(2000)
        for batch in C.batch_blocks(batches, text_col, CHUNK):
            held.append(batch)
            size += pa.compute.sum(pa.compute.binary_length(batch.column(text_col))).as_py() or 0
            if size >= CHUNK:
                yield from close()
                held, size = [], 0
        if held and sum(x.num_rows for x in held):
            yield from close()
    return run


def _pairs(batches):
    """A chunk's pairs, one row each."""
    for b in batches:
        for chunk, pairs, docs in zip(*(b.column(i).to_pylist() for i in range(3))):
            p = C.unpack_sorted(pairs).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(p), chunk)), pa.array(p), pa.array(numbers(docs))],
                                             names=["chunk", "pair", "docs"])


def _score(out: pa.Schema):
    """Per document the links that are their A id's best, and the counts over all links."""
    def run(key, t, answers):
        if not t.num_rows:
            return out.empty_table()
        order = np.argsort(answers.column("pair").to_numpy())
        total, best = (answers.column(c).to_numpy()[order] for c in ("total", "best"))
        n_best, count_sum = [], []
        for own, times in zip(t.column("_own").to_pylist(), t.column("_times").to_pylist()):
            own, times = np.cumsum(numbers(own)), numbers(times)
            n_best.append(int(times[best[own]].sum()) if len(own) else 0)
            count_sum.append(int((times * total[own]).sum()) if len(own) else 0)
        new = {"n_best": n_best, "count_sum": count_sum}
        cols = [pa.array(new[f.name], f.type) if f.name in new else t.column(f.name) for f in out]
        return pa.Table.from_arrays([c.cast(f.type) for c, f in zip(cols, out)], schema=out)
    return run


def align(docs: DataFrame, path_a: str = TOKENIZER_A, path_b: str = TOKENIZER_B, text_col: str = "text",
          with_groups: bool = False) -> tuple[DataFrame, DataFrame]:
    """(documents, pairs).  Documents keep their columns but the text and get
    n_a and n_b (tokens), n_groups (cut where tokens of both end), n_links
    (overlapping token pairs), n_best (links whose pair is in as many
    documents as any pair of its A id), count_sum (documents of the link's
    pair, over all links), groups_sha256 and, on demand, groups (``a1,a2|b1;...``).
    Pairs: a_id, b_id, docs (documents that hold the pair linked), best.

    A null or empty text, and one whose decoded tokens are not blank + text in
    both tokenizers (a text with U+2581, for one), has no tokens: zeros and ''.
    Whole texts are read, however long.  Repeated rows count as documents of
    their own; ids are not looked at, so null and repeated ids are nothing
    special.  Input columns named as an added one are replaced.  An empty table
    gives empty results.  The two files must be on every machine.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    docs = C.without(docs, [*ADDED, "_own", "_times", "_chunk", "_pairs", "_docs"])
    longs = [T.StructField(n, T.LongType()) for n in ("n_a", "n_b", "n_groups", "n_links")]
    kept = [f for f in docs.schema.fields if f.name != text_col] + longs + [
        T.StructField("groups_sha256", T.StringType()), *([T.StructField("groups", T.StringType())] if with_groups else [])]
    packed = [T.StructField(n, T.BinaryType()) for n in ("_own", "_times")] + [T.StructField("_chunk", T.LongType())]
    lists = [T.StructField(n, T.BinaryType()) for n in ("_pairs", "_docs")]
    schema = T.StructType([*kept, *packed, *lists])
    done = C.stored(docs.mapInArrow(_align(path_a, path_b, text_col, to_arrow_schema(schema), with_groups), schema), "aligned")
    rows = done.filter("_pairs is not null").select("_chunk", "_pairs", "_docs").mapInArrow(_pairs, "chunk long, pair long, docs long")
    total = rows.groupBy("pair").agg(F.sum("docs").alias("total")).withColumn("a_id", F.shiftright("pair", 32))
    total = C.stored(total, "pairs")
    top = total.groupBy("a_id").agg(F.max("total").alias("top"))
    pairs = total.join(top, "a_id").select("pair", "total", (F.col("total") == F.col("top")).alias("best"))
    answers = rows.select("chunk", "pair").join(pairs, "pair").select(F.col("chunk").alias("_chunk"), "pair", "total", "best")
    out = T.StructType([*kept, T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())])
    scored = done.drop("_pairs", "_docs").groupBy("_chunk").cogroup(answers.groupBy("_chunk")).applyInArrow(
        _score(to_arrow_schema(out)), out)
    return scored, pairs.select(F.shiftright("pair", 32).cast("int").alias("a_id"),
                                F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("b_id"), F.col("total").alias("docs"), "best")


def digest(docs: DataFrame) -> DataFrame:
    """The columns of query op12."""
    return align(docs.select("doc_id", "text"))[0].select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
