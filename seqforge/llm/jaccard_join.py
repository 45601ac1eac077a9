"""Exact Jaccard join of documents on word n-grams in the metric space of the
Jaccard distance d = 1 - |x & y| / |x | y| (eps = the largest linking distance).

Pivots alone cannot split a corpus: unrelated documents are at distance 1 from
one another, so every pivot sees them all in one window.  The first regions
are therefore cells in which linked documents must meet:

* rings around the empty set, by set size.  Linked sizes differ by a bounded
  factor, so a set near the lower edge of the next ring is copied to it;
* inside a ring the n-grams fall into m classes by hash.  Linked sets differ in at
  most t < m n-grams, so some class has equal parts in both (and one that is not empty,
  if more than t classes are not); a cell holds the sets with one such part.

Inside the cells the join is pivot based and recursive.  The most central
member (in the most shared cells) becomes the pivot, the distances of
all members to it are computed, and members within eps form its region: they
are linked to it, so no pair among them needs a look.  The others, with
those of the region that the triangle inequality does not keep more than eps
from every one of them, are the cell of the next round, with another pivot.
Cells whose members are all connected by now are done.  Small cells and what
is left after some rounds are joined exactly: ordered by the distance to the
last pivot and cut into blocks of bounded size; blocks beyond eps apart are
skipped, pairs of the others are compared.

Distances are bounded first and counted only where the bound allows a link.
The parities of a set's sizes in many small hash classes (its sketch, a
32nd of the set) differ in at most as many places as two sets differ in
n-grams.  So a pair whose sketches are too far apart never needs its sets;
the whole sets are sent for the other pairs alone, each pair once.

Copies with equal sets are one member throughout.  Pairs of members that are
connected already are not compared, so a group of n near copies takes about n
comparisons a round, not n^2.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqforge.llm import common as C

ADDED = ["n_shingles", "component_id"]
#: Rounds of pivots, members up to which a cell is joined at once, n-grams in a block (of 1024 members at most).
ROUNDS, SMALL, BLOCK_GRAMS = 3, 4096, 1 << 20
#: Bits of an n-gram's hash that sets keep; slots of the bitmap of wanted sets.
BITS, SLOTS = 48, 1 << 23
#: Bytes of text whose n-grams are made at once; columns and rows of sketches that are compared at once.
BLOCK_TEXT = 1 << 20
COLUMNS, ROWS = 4096, 256
U64 = C.U64


# ---------------------------------------------------------------- sets

def grams(data: np.ndarray, offs: np.ndarray, n: int) -> list[np.ndarray]:
    """Per document the ascending distinct hashes of its word n-grams."""
    data = C.LOWER[data]
    starts, ends, first = C.spans_of_words(data, offs, C.SPACE)
    at, doc = C.window_starts(first, n)
    words = np.diff(first)
    short = np.flatnonzero((words > 0) & (words < n))
    roll = C.rolling(C.word_codes(data, starts, ends))
    h = C.range_hash(roll, np.concatenate((at, first[:-1][short])), np.concatenate((at + n, first[1:][short])))
    out = np.split(h[:len(at)], np.cumsum(np.bincount(doc, minlength=len(words)))[:-1]) if len(words) else []
    for i, x in zip(short, h[len(at):]):
        out[i] = np.array([x])
    return [C.ascending(x) for x in out]


def _sets(n: int, text_col: str, out: pa.Schema):
    def run(batches):
        for b in C.batch_blocks(batches, text_col, BLOCK_TEXT):
            sets = grams(*C.column_bytes(b.column(text_col)), n)
            new = {"n_shingles": [len(s) for s in sets],
                   "_sid": [int(np.int64(np.uint64(xxhash.xxh64_intdigest(s.tobytes())))) if len(s) else None for s in sets],
                   "_set": [C.pack_sorted(s >> U64(64 - BITS)) if len(s) else None for s in sets]}
            cols = [pa.array(new[f.name], f.type) if f.name in new else b.column(b.schema.get_field_index(f.name)) for f in out]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, out)], schema=out)
            C.release()
    return run


# ---------------------------------------------------------------- cells

def most_apart(n: int, pct: int) -> int:
    """The most n-grams in which a set of n may differ from a linked one."""
    return (100 - pct) * n // pct


def rings(largest: int, pct: int) -> list[int]:
    """Lower edges of the rings: a set that can link to one in ring r is in
    ring r - 1 at least.  Smaller sets than the first edge link to equal sets only.
    Two edges lie above the largest set, for the ring that it is copied to."""
    edges = [next(n for n in range(1, 102) if most_apart(n, pct))]
    while len(edges) < 3 or edges[-2] <= largest:
        edges.append(math.ceil(edges[-1] * 100 / pct * 100 / pct) + 1)
    return edges


def cell_keys(sets: list[np.ndarray], pct: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the set, key) of all cells that the sets are in."""
    size = np.array([len(s) for s in sets], np.int64)
    if not size.sum():
        return np.zeros(0, np.int64), np.zeros(0, U64)
    edges = np.array(rings(int(size.max()), pct))
    classes = np.array([math.ceil(1.05 * most_apart(int(e) - 1, pct)) + 2 for e in edges[1:]])
    ring = np.searchsorted(edges, size, side="right") - 1
    apart = (100 - pct) * size // pct
    found = []
    upper = edges[np.maximum(ring, 0) + 1]
    for shift, who in ((0, np.flatnonzero(ring >= 0)), (1, np.flatnonzero((ring >= 0) & (100 * size >= pct * upper)))):
        if not len(who):
            continue
        own = ring[who] + shift
        m = classes[own].astype(U64)
        h = np.concatenate([sets[i] for i in who])
        doc = np.repeat(np.arange(len(who)), size[who])
        part = ((h >> U64(BITS - 32)) * m[doc]) >> U64(32)
        start = np.flatnonzero(np.append(True, (part[1:] != part[:-1]) | (doc[1:] != doc[:-1])))
        total = np.add.reduceat(C.mix(h), start)
        d, p = doc[start], part[start]
        few = np.flatnonzero(np.bincount(d, minlength=len(who)) <= apart[who])
        if len(few):  # two sets like this may agree in empty classes only
            gone = [np.setdiff1d(np.arange(int(m[i])), p[d == i].astype(np.int64)) for i in few]
            d, p = np.append(d, np.repeat(few, [len(g) for g in gone])), np.append(p, np.concatenate(gone).astype(U64))
            total = np.append(total, np.zeros(len(d) - len(total), U64))
        found.append((who[d], C.mix(total + C.mix((own[d].astype(U64) << U64(32)) + p + U64(1)))))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, U64))


def _cells(pct: int):
    def run(batches):
        seen: set[int] = set()
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                sids, sets = [], []
                for s, x in zip(part.column("_sid").to_pylist(), part.column("_set").to_pylist()):
                    if s not in seen:  # copies in one task count once
                        seen.add(s)
                        sids.append(s)
                        sets.append(C.unpack_sorted(x))
                who, keys = cell_keys(sets, pct)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.array(sids, np.int64)[who])], names=["key", "sid"])
            C.release()
    return run


def only(rows: DataFrame, sid_col: str, wanted: DataFrame) -> DataFrame:
    """Most of the rows whose sid is not wanted dropped, before a join deals
    the rest: a bitmap of bounded size, and per task each sid once."""
    slot = F.pmod(F.col("sid"), F.lit(SLOTS))
    found = wanted.groupBy(F.bitmap_bucket_number(slot).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits")).collect()
    each = 8 * 4096
    mask = np.zeros((SLOTS // each + 2) * each, bool)
    for r in found:
        mask[r.bucket * each:(r.bucket + 1) * each] = np.unpackbits(np.frombuffer(r.bits, np.uint8), bitorder="little")
    packed = np.packbits(mask).tobytes()

    def run(batches):
        bits, seen = np.unpackbits(np.frombuffer(packed, np.uint8)).astype(bool), set()
        for b in batches:
            sid = b.column(sid_col).to_numpy()
            slots = sid % SLOTS  # bit position and bucket of a slot: see bitmap_bit_position
            place = np.where(slots > 0, (slots - 1) % each + (1 + (slots - 1) // each) * each, 0)
            at = [i for i in np.flatnonzero(bits[place]) if not (sid[i] in seen or seen.add(sid[i]))]
            yield b.take(pa.array(at, pa.int64()))
            C.release()
    return rows.mapInArrow(run, rows.schema)


def wanted_sets(marked: DataFrame, wanted: DataFrame) -> DataFrame:
    """(sid, n, set, sketch) of the wanted sids."""
    found = only(marked.filter("_sid is not null").select("_sid", "n_shingles", "_set"), "_sid", wanted)
    found = found.select(F.col("_sid").alias("sid"), F.col("n_shingles").alias("n"), F.col("_set").alias("set"))
    found = found.join(wanted, "sid", "left_semi").dropDuplicates(["sid"])
    return C.stored(found.mapInArrow(_sketches, "sid long, n long, set binary, sketch binary"), "sets")


# ---------------------------------------------------------------- bounds and distances

def sketch(s: np.ndarray) -> np.ndarray:
    """Parity of the set's size in each of 2 to 4 times as many classes as it has n-grams."""
    bits = max(6, int(2 * len(s) - 1).bit_length())
    return np.bincount((s >> U64(BITS - bits)).astype(np.int64), minlength=1 << bits).astype(np.uint8) & 1


def folded(bits: np.ndarray, size: int) -> np.ndarray:
    """The sketch over ``size`` larger classes."""
    return np.bitwise_xor.reduce(bits.reshape(size, -1), axis=1)


def _sketches(batches):
    for b in batches:
        for at in range(0, b.num_rows, 256):
            t = b.slice(at, 256)
            made = [np.packbits(sketch(C.unpack_sorted(x))).tobytes() for x in t.column("set").to_pylist()]
            yield pa.RecordBatch.from_arrays([*t.columns, pa.array(made, pa.binary())], names=["sid", "n", "set", "sketch"])
        C.release()


def bits_of(raw: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(raw, np.uint8))


def _bounds(batches):
    """The least number of n-grams in which a member and its pivot differ."""
    for b in batches:
        least = []
        for x, p in zip(b.column("sketch").to_pylist(), b.column("pivot_sketch").to_pylist()):
            if len(x) != len(p):
                size = 8 * min(len(x), len(p))
                x, p = (np.packbits(folded(bits_of(y), size)).tobytes() for y in (x, p))
            least.append((int.from_bytes(x) ^ int.from_bytes(p)).bit_count())
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("sid", "pivot", "n", "pivot_n")), pa.array(least, pa.int64())],
                                         names=["sid", "pivot", "n", "pivot_n", "apart"])
        C.release()


def _apart(batches):
    """The number of n-grams in which the sets differ."""
    for b in batches:
        apart = []
        for x, p in zip(b.column("set").to_pylist(), b.column("pivot_set").to_pylist()):
            x, p = C.unpack_sorted(x), C.unpack_sorted(p)
            both = np.sort(np.concatenate((x, p)))
            apart.append(len(x) + len(p) - 2 * int((both[1:] == both[:-1]).sum()))
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("sid", "pivot", "n", "pivot_n")), pa.array(apart, pa.int64())],
                                         names=["sid", "pivot", "n", "pivot_n", "apart"])
        C.release()


PAIRS = "sid long, pivot long, n long, pivot_n long, apart long"


def near(pct: int):
    """2 |x & p| = n + m - apart and 2 |x | p| = n + m + apart."""
    both = F.col("n") + F.col("pivot_n")
    return 100 * (both - F.col("apart")) >= pct * (both + F.col("apart"))


def distances(pairs: DataFrame, sets: DataFrame, pct: int) -> DataFrame:
    """(sid, pivot, d, near) of distinct pairs; d is exact for near pairs and a
    lower bound for others."""
    other = sets.select(F.col("sid").alias("pivot"), F.col("n").alias("pivot_n"), F.col("sketch").alias("pivot_sketch"))
    bounded = pairs.join(sets.select("sid", "n", "sketch"), "sid").join(other, "pivot").select(
        "sid", "pivot", "n", "pivot_n", "sketch", "pivot_sketch").mapInArrow(_bounds, PAIRS)
    bounded = C.stored(bounded, "bounds")
    close = bounded.filter(near(pct)).select("sid", "pivot")
    other = only(sets.select("sid", "n", "set"), "sid", close.select(F.col("pivot").alias("sid"))) \
        .select(F.col("sid").alias("pivot"), F.col("n").alias("pivot_n"), F.col("set").alias("pivot_set"))
    exact = close.join(only(sets.select("sid", "n", "set"), "sid", close), "sid").join(other, "pivot") \
        .select("sid", "pivot", "n", "pivot_n", "set", "pivot_set").mapInArrow(_apart, PAIRS)
    d = 2 * F.col("apart") / (F.col("n") + F.col("pivot_n") + F.col("apart"))
    return C.stored(exact.unionByName(bounded.filter(~near(pct))).select("sid", "pivot", d.alias("d"), near(pct).alias("near")), "distances")


# ---------------------------------------------------------------- pivots

def pivot_round(cells: DataFrame, sets: DataFrame, pct: int, first: bool) -> tuple[DataFrame, DataFrame]:
    """(links to pivots, cells of the next round with each member's distance to the pivot)."""
    if first:  # the most central member, in the most shared cells
        rank = cells.groupBy("sid").agg(F.count("*").alias("score"))
        ranked = cells.join(rank, "sid")
    else:  # cells of one group try different members
        ranked = cells.withColumn("score", F.xxhash64("key", "sid"))
    pivots = ranked.groupBy("key").agg(F.max(F.struct("score", "sid")).getField("sid").alias("pivot"))
    members = C.stored(cells.select("key", "sid").join(pivots, "key").filter("sid <> pivot"), "members")
    found = distances(members.select("sid", "pivot").distinct(), sets, pct)
    eps = (100 - pct) / 100 + 1e-9
    placed = members.join(found, ["sid", "pivot"]).select("key", "sid", "d", "near")
    far = placed.filter("not near").groupBy("key").agg(F.min("d").alias("least"))
    left = placed.join(far, "key").filter(~F.col("near") | (F.col("d") + eps >= F.col("least"))).select("key", "sid", "d")
    return found.filter("near").select(F.col("sid").alias("a"), F.col("pivot").alias("b")), left


def unsettled(cells: DataFrame, roots: DataFrame) -> DataFrame:
    """The cells whose members are not all connected yet, with their size and
    each member's component."""
    named = cells.join(roots.select(F.col("node").alias("sid"), "root"), "sid", "left") \
        .withColumn("root", F.coalesce("root", "sid"))
    open_cells = named.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("size")) \
        .filter("lo <> hi").select("key", "size")
    return C.stored(named.join(open_cells, "key").select("key", "sid", "d", "root", "size"), "cells")


# ---------------------------------------------------------------- exact join of regions

def candidates(sids: np.ndarray, roots: np.ndarray, sizes: np.ndarray, sketches: list[bytes], pct: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of different components whose sketches allow a link."""
    width = 8 * min(map(len, sketches))
    m = np.stack([folded(bits_of(x), width) for x in sketches])
    ones, found = m.sum(axis=1, dtype=np.int64), []
    for top in range(0, len(m), ROWS):  # a strip against all rows from its first on
        rest = slice(top, len(m))
        strip = slice(top, top + ROWS)
        shared = np.zeros((len(m[strip]), len(m) - top), np.float32)
        for at in range(0, width, COLUMNS):
            part = m[rest, at:at + COLUMNS].astype(np.float32)
            shared += part[:ROWS] @ part.T
        apart = ones[strip, None] + ones[None, rest] - 2 * shared.astype(np.int64)
        apart = np.maximum(apart, np.abs(sizes[strip, None] - sizes[None, rest]))
        both = sizes[strip, None] + sizes[None, rest]
        i, j = np.nonzero(np.triu((100 * (both - apart) >= pct * (both + apart)) & (roots[strip, None] != roots[None, rest]), 1))
        found.append((top + i, top + j))
    i, j = (np.concatenate(x) for x in zip(*found))
    return np.minimum(sids[i], sids[j]), np.maximum(sids[i], sids[j])


def _join(pct: int):
    def run(batches):
        held, tile = [], None

        def close():
            ids = {r["sid"]: r for r in held}
            rows = list(ids.values())
            if len(rows) < 2:
                return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 2, names=["sid", "pivot"])
            pairs = candidates(*(np.array([r[c] for r in rows], np.int64) for c in ("sid", "root", "n")), [r["sketch"] for r in rows], pct)
            C.release()
            return pa.RecordBatch.from_arrays([pa.array(x) for x in pairs], names=["sid", "pivot"])
        for b in batches:
            for at in range(0, b.num_rows, 64):
                for r in b.slice(at, 64).to_pylist():
                    if (r["key"], r["i"], r["j"]) != tile:
                        if held:
                            yield close()
                        held, tile = [], (r["key"], r["i"], r["j"])
                    held.append(r)
        if held:
            yield close()
    return run


def join_regions(cells: DataFrame, sets: DataFrame, pct: int) -> DataFrame:
    """All links between different components inside the cells: members in the
    order of their distance to the pivot, in blocks of bounded size; blocks
    further apart than eps need no look, by the triangle inequality."""
    eps = (100 - pct) / 100 + 1e-9
    before = F.sum(F.col("n") + BLOCK_GRAMS // 1024).over(Window.partitionBy("key").orderBy("d", "sid").rowsBetween(Window.unboundedPreceding, -1))
    dealt = cells.join(sets.select("sid", "n"), "sid").withColumn(
        "block", F.floor(F.coalesce(before, F.lit(0)) / BLOCK_GRAMS)).select("key", "sid", "d", "root", "block")
    dealt = C.stored(dealt, "blocks")
    blocks = dealt.groupBy("key", "block").agg(F.min("d").alias("lo"), F.max("d").alias("hi"))
    i = blocks.select("key", F.col("block").alias("i"), F.col("hi").alias("end"))
    j = blocks.select("key", F.col("block").alias("j"), F.col("lo").alias("start"))
    tiles = i.join(j, "key").filter((F.col("i") <= F.col("j")) & (F.col("start") - F.col("end") <= eps)).select("key", "i", "j")
    tiles = tiles.select("key", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
    rows = dealt.join(tiles, ["key", "block"]).join(sets, "sid").select("key", "i", "j", "sid", "root", "n", "sketch")
    rows = rows.repartition(C.partitions_of(cells.sparkSession), "key", "i", "j").sortWithinPartitions("key", "i", "j")
    pairs = C.stored(rows.mapInArrow(_join(pct), "sid long, pivot long").distinct(), "pairs")
    return distances(pairs, sets, pct).filter("near").select(F.col("sid").alias("a"), F.col("pivot").alias("b"))


def contracted(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """(node, root) of all linked nodes, after more links between them."""
    if roots is None:
        return C.components(links)
    for c in ("a", "b"):
        head = roots.select(F.col("node").alias(c), F.col("root").alias("head"))
        links = links.join(head, c, "left").withColumn(c, F.coalesce("head", c)).drop("head")
    more = C.components(links.filter("a <> b"))
    head = more.select(F.col("node").alias("root"), F.col("root").alias("head"))
    old = roots.join(head, "root", "left").select("node", F.coalesce("head", "root").alias("root"))
    return C.stored(old.unionByName(more.join(roots, "node", "left_anti")), "roots")


# ---------------------------------------------------------------- operator

def jaccard_join(docs: DataFrame, shingle: int = 4, pct: int = 85, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(documents, links).  Documents keep their columns but the text and get
    n_shingles (distinct word n-grams) and component_id, the smallest id
    reachable over links; two link if 100 |x & y| >= pct |x | y|.  Links are
    pairs of set ids that connect the components (those that were looked at).

    Texts are lower-cased (A-Z) and cut into words at blank and 0x09-0x0D; of
    fewer words than ``shingle`` the whole sequence is the one n-gram.  A null
    or blank text has an empty set and is linked to nothing, its id names its
    component.  A null id never names a component, unless there is no other.
    Repeated rows link to each other.  Input columns named as the added ones
    are replaced.  An empty table gives an empty result.  N-grams are compared
    by 64 bits of a hash within a text and by 48 between texts.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    docs = C.without(docs, [*ADDED, "_sid", "_set"])
    schema = T.StructType([*[f for f in docs.schema.fields if f.name != text_col], T.StructField("n_shingles", T.LongType()),
                           T.StructField("_sid", T.LongType()), T.StructField("_set", T.BinaryType())])
    marked = C.stored(docs.mapInArrow(_sets(shingle, text_col, to_arrow_schema(schema)), schema), "grams")
    keyed = marked.filter("_sid is not null").select("_sid", "_set").mapInArrow(_cells(pct), "key long, sid long")
    w = Window.partitionBy("key")
    cells = keyed.withColumn("lo", F.min("sid").over(w)).withColumn("hi", F.max("sid").over(w)).filter("lo <> hi") \
        .select("key", "sid").distinct()
    cells = C.stored(cells, "cells")
    sets = wanted_sets(marked, cells.select("sid").distinct())
    links, rest, roots = [], None, None
    for k in range(ROUNDS):
        found, left = pivot_round(cells, sets, pct, k == 0)
        links.append(found)
        roots = contracted(roots, found)
        left = unsettled(left, roots)
        small = left if k == ROUNDS - 1 else left.filter(F.col("size") <= SMALL)
        rest = small if rest is None else rest.unionByName(small)
        cells = left.filter(F.col("size") > SMALL)
        if k == ROUNDS - 1 or not cells.head(1):
            break
    if rest.head(1):
        links.append(join_regions(rest, sets, pct))
        roots = contracted(roots, links[-1])
    links = reduce(DataFrame.unionByName, links)
    least = marked.filter("_sid is not null").groupBy(F.col("_sid").alias("sid")).agg(F.min(id_col).alias("least"))
    owner = least.join(roots, F.col("sid") == F.col("node"), "left").withColumn("root", F.coalesce("root", "sid"))
    owner = owner.select("sid", "root").join(owner.groupBy("root").agg(F.min("least").alias("component_id")), "root") \
        .select(F.col("sid").alias("_owner"), "component_id")
    kept = [f.name for f in schema.fields if f.name not in ("_sid", "_set")]
    named = marked.filter("_sid is not null").join(owner, F.col("_sid") == F.col("_owner")).select(*kept, "component_id")
    return named.unionByName(marked.filter("_sid is null").select(*kept, F.col(id_col).alias("component_id"))), links


def digest(docs: DataFrame) -> DataFrame:
    """The columns of query op13."""
    return jaccard_join(docs.select("doc_id", "text"))[0]
