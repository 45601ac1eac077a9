"""Helpers shared by the training-data operators: chunked exchange of texts,
vectorised tokenising and hashing, connected components, shared tables."""

from __future__ import annotations

import ctypes
import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqforge.session import ensure_checkpoint_dir

#: The whitespace that separates words: blank and 0x09-0x0D.
SPACE_BYTES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
CHUNK_BYTES = 4 << 20
U64 = np.uint64


# ---------------------------------------------------------------- tables

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the cluster's shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/seqforge-llm/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage is cut, and
    a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """Drop columns that an operator is about to add (its own columns win)."""
    return df.drop(*[c for c in df.columns if c.lower() in {n.lower() for n in names}])


def added_schema(df: DataFrame, *fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([*df.schema.fields, *[T.StructField(n, t) for n, t in fields]])


# ---------------------------------------------------------------- chunks

def partitions_of(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def n_chunks(df: DataFrame, text_col: str, target: int = CHUNK_BYTES) -> tuple[int, int]:
    """(number of chunks of about ``target`` bytes of text, bytes in all)."""
    total = df.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    return max(1, math.ceil(total / target), partitions_of(df.sparkSession)), total


def with_chunk(df: DataFrame, id_col: str, text_col: str, target: int = CHUNK_BYTES) -> tuple[DataFrame, int, int]:
    """Add ``_chunk``: documents cut into ranges of ascending id, so a document
    of a lower chunk has a smaller id.  The cut points are a fixed list of
    quantiles (their precision changes only the balance), so every branch and
    every re-execution assigns the same chunk.  Null ids are dealt by a hash of
    the text.  Returns (frame, chunks, bytes of text)."""
    n, total = n_chunks(df, text_col, target)
    cuts = df.select(F.col(id_col).cast("double").alias("v")).approxQuantile(
        "v", [i / n for i in range(1, n)], 1 / (8 * n)) if n > 1 else []
    cuts = sorted(set(cuts))
    out = df.withColumn("_idd", F.col(id_col).cast("double"))
    if cuts:
        out = Bucketizer(splits=[-math.inf, *cuts, math.inf], inputCol="_idd", outputCol="_bucket",
                         handleInvalid="keep").transform(out)
    else:
        out = out.withColumn("_bucket", F.lit(0.0))
    chunk = F.when(F.col(id_col).isNull(), F.pmod(F.xxhash64(F.col(text_col)), F.lit(n))).otherwise(F.col("_bucket"))
    return out.withColumn("_chunk", chunk.cast("int")).drop("_idd", "_bucket"), n, total


# ---------------------------------------------------------------- bytes and words

def release() -> None:
    """Give freed memory back to the system: a worker goes through many chunks,
    and what it holds is not Spark's to use."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def column_bytes(col) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.cast(pa.large_string()).combine_chunks()
        if isinstance(col, pa.ChunkedArray):
            col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.large_string())
    else:
        col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    n = len(col)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(col.buffers()[1], np.int64)[col.offset:col.offset + n + 1]
    data = col.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offs[0]:offs[-1]], offs - offs[0]


def batch_blocks(batches, text_col: str, limit: int = CHUNK_BYTES):
    """Slices of the incoming record batches with about ``limit`` bytes of text
    (one document at least), so memory follows the limit and not the batch."""
    for batch in batches:
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(text_col)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def byte_class(members) -> np.ndarray:
    mask = np.zeros(256, bool)
    mask[list(members)] = True
    return mask


SPACE = byte_class(SPACE_BYTES)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def spans_of_words(data: np.ndarray, offs: np.ndarray, is_break: np.ndarray):
    """(starts, ends, first): byte spans of the words and, per document, the
    index of its first word (one entry more than documents)."""
    inside = np.empty(len(data) + 1, bool)
    inside[:-1] = ~is_break[data]
    inside[-1] = False
    edge = np.zeros(len(data) + 1, bool)
    edge[offs] = True
    before = np.empty(len(data) + 1, bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (edge | ~before))
    ends = np.flatnonzero(before & (edge | ~inside))
    return starts, ends, np.searchsorted(starts, offs)


def ascending(x: np.ndarray) -> np.ndarray:
    """The different values, ascending (a sort; ``np.unique`` hashes, which is
    many times slower on long arrays)."""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


BYTE_CODES = mix((np.arange(256, dtype=U64) + U64(1)) * U64(0x9E3779B97F4A7C15))
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INV = pow(BASE, -1, 1 << 64)


POWERS: dict = {}


def powers(base: int, n: int) -> np.ndarray:
    """base^0 ... base^(n-1); kept between calls."""
    p = POWERS.get(base)
    if p is None or len(p) < n:
        p = np.full(max(n, 2), base, U64)
        p[0] = 1
        p = POWERS[base] = np.cumprod(p, dtype=U64)
    return p[:n]


def rolling(codes: np.ndarray):
    """Prefix sums of a polynomial hash modulo 2^64 over ``codes`` with the
    inverse powers; see :func:`range_hash`."""
    n = len(codes)
    pre = np.zeros(n + 1, U64)
    np.cumsum(codes * powers(BASE, n), out=pre[1:], dtype=U64)
    return pre, powers(BASE_INV, n + 1)


def range_hash(roll, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Rabin-Karp hash of codes[start:end], independent of where it lies."""
    pre, inv = roll
    return mix((pre[end] - pre[start]) * inv[start] + (end - start).astype(U64))


def word_codes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, codes: np.ndarray = BYTE_CODES) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    return range_hash(rolling(codes[data]), starts, ends)


def window_starts(first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Start (word index) and document of every window of ``size`` words."""
    n = np.maximum(np.diff(first) - size + 1, 0)
    doc = np.repeat(np.arange(len(n)), n)
    begin = np.cumsum(n) - n
    return np.arange(n.sum()) - begin[doc] + first[:-1][doc], doc


def covered(starts: np.ndarray, size, n: int) -> np.ndarray:
    """Mask of the n positions that lie in a run [start, start + size)."""
    diff = np.zeros(n + 1, np.int64)
    np.add.at(diff, starts, 1)
    np.add.at(diff, np.minimum(starts + size, n), -1)
    return np.cumsum(diff[:-1]) > 0


def runs_of(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate(([0], mask.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


# ---------------------------------------------------------------- packed integers

def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending uint64 as byte planes of their differences (the high planes
    are almost all zero, so the shuffle's compression removes them)."""
    d = np.diff(values, prepend=U64(0))
    return np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8).T).tobytes()


def unpack_sorted(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(U64).ravel(), dtype=U64)


def hash_ranges(values: np.ndarray, buckets: int) -> np.ndarray:
    """Bounds in the ascending ``values`` of equal ranges of the hash space."""
    at = np.array([(i << 64) // buckets for i in range(buckets)], U64)
    return np.append(np.searchsorted(values, at), len(values))


def cut_by_bits(values: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Ascending hashes cut by their highest ``bits`` bits: the ranges that
    have any, and their bounds (one more)."""
    if not len(values):
        return np.zeros(0, np.int64), np.zeros(1, np.int64)
    part = (values >> U64(64 - bits)).astype(np.int64) if bits else np.zeros(len(values), np.int64)
    head = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
    return part[head], np.append(head, len(values))


# ---------------------------------------------------------------- lowest holders

PACKETS = pa.schema([("_range", pa.int64()), ("_chunk", pa.int32()), ("packed", pa.binary())])
PACKETS_DDL = "_range long, _chunk int, packed binary"
BITS = pa.schema([("_chunk", pa.int32()), ("_range", pa.int64()), ("bits", pa.binary())])
BITS_DDL = "_chunk int, _range long, bits binary"


def packets(h: np.ndarray, bits: int, chunk: int) -> pa.Table:
    """Ascending hashes of a chunk, one row per range of the hash space."""
    part, cut = cut_by_bits(h, bits)
    return pa.Table.from_arrays([
        pa.array(part, pa.int64()), pa.array(np.full(len(part), chunk), pa.int32()),
        pa.array([pack_sorted(h[a:b]) for a, b in zip(cut[:-1], cut[1:])], pa.binary())], schema=PACKETS)


def bits_of(h: np.ndarray, bits: int, answers) -> np.ndarray:
    """The answers to :func:`packets`, one for each of the same hashes."""
    part, cut = cut_by_bits(h, bits)
    found = np.zeros(len(h), bool)
    at = np.searchsorted(part, np.asarray(answers.column("_range")))
    for i, raw in zip(at.tolist(), answers.column("bits").to_pylist()):
        a, b = cut[i], cut[i + 1]
        found[a:b] = np.unpackbits(np.frombuffer(raw, np.uint8), count=b - a).astype(bool)
    return found


def _merged(t):
    """The packets of one range by ascending chunk: their table, their bounds,
    all hashes in order, that order, and which come first of their value."""
    t = t.sort_by("_chunk")
    lists = [unpack_sorted(x) for x in t.column("packed").to_pylist()]
    every = np.concatenate(lists)
    order = np.argsort(every, kind="stable")
    every = every[order]
    return t, np.cumsum([0, *map(len, lists)]), every, order, np.append(True, every[1:] != every[:-1])


def _answer_bits(t, cut, again) -> pa.Table:
    return pa.Table.from_arrays([
        t.column("_chunk").cast(pa.int32()), t.column("_range"),
        pa.array([np.packbits(again[a:b]).tobytes() for a, b in zip(cut[:-1], cut[1:])], pa.binary())], schema=BITS)


def _held_here(key, t):
    t, cut, _, order, new = _merged(t)
    again = np.empty(len(order), bool)
    again[order] = ~new
    return _answer_bits(t, cut, again)


def _upward(bits: int):
    def run(key, t):
        release()
        *_, every, _, new = _merged(t)
        return packets(every[new], bits, key[1].as_py())
    return run


def _downward(bits: int):
    def run(key, t, answers):
        release()
        t, cut, every, order, new = _merged(t)
        lower = bits_of(every[new], bits, answers)
        again = np.empty(len(order), bool)
        again[order] = ~new | lower[np.cumsum(new) - 1]
        return _answer_bits(t, cut, again)
    return run


def held_lower(sent: DataFrame, chunks: int, bits: int, step: int | None = None) -> DataFrame:
    """Which hashes does a lower chunk hold too?  ``sent`` has the different
    hashes of every chunk as :func:`packets` by ``bits`` bits; the answer has a
    row (_chunk, _range, bits) per packet.

    A task takes the packets of one range from up to 2^step chunks (``step``
    is ``bits`` unless given).  If there are more chunks, neighbouring ones
    form a group: its task keeps each hash once, cuts the range further by
    ``step`` bits and asks the same question among the groups.  So a chunk
    sends at most 2^bits rows at any size of the input, a task gets at most
    2^step packets, and the rows of all levels are in proportion to the chunks."""
    step = step or bits
    if chunks <= 1 << step:
        return sent.groupBy("_range").applyInArrow(_held_here, BITS_DDL)
    groups = -(-chunks >> step)
    finer = bits + min(step, max(1, (groups - 1).bit_length()))
    if finer > 48:
        raise ValueError("more levels than the hashes have bits")
    sent = sent.withColumn("_group", F.shiftright("_chunk", step))
    up = sent.groupBy("_range", "_group").applyInArrow(_upward(finer), PACKETS_DDL)
    down = held_lower(up, groups, finer, step).withColumn("_top", F.shiftright("_range", finer - bits))
    return sent.groupBy("_range", "_group").cogroup(down.groupBy("_top", "_chunk")).applyInArrow(_downward(finer), BITS_DDL)


# ---------------------------------------------------------------- components

def components(links: DataFrame, rounds: int = 100) -> DataFrame:
    """Connected components of ``links(a, b)`` by alternating large-star and
    small-star steps; returns (node, root) for every linked node, root being
    its component's smallest node.  Each round is written to the shared
    folder; only two aggregate numbers reach the driver."""
    def star(edges: DataFrame, large: bool) -> DataFrame:
        if large:
            both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        else:
            both = edges
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        joined = both.join(low, "a")
        if large:
            out = joined.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
                low.select("a", F.col("m").alias("b")))
        return out.filter(F.col("a") != F.col("b")).distinct()

    def sign(edges: DataFrame):
        r = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return r[0], r[1]

    edges = stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                   .filter(F.col("a") != F.col("b")).distinct(), "links")
    seen = sign(edges)
    for _ in range(rounds):
        if not seen[0]:
            break
        edges = stored(star(star(edges, True), False), "links")
        now = sign(edges)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
