"""SimHash near-dedup with multi-index hashing.

The 64-bit fingerprint is cut into two 32-bit segments.  Of two fingerprints
within r bits, either the high segments differ in at most r // 2 bits or the
low ones in at most (r - 1) // 2.  So a small Hamming ball is enumerated
within a segment (radius 0, 1, ...), the table is probed with every member of
the ball, and complete distances are verified.  A probe at radius a leaves
r - a bits for the other segment, so one of its r - a + 1 blocks agrees
exactly: that block is part of the table key, which keeps buckets narrow
(43 to 48 bits for r = 2) however many fingerprints share a segment.

Only distinct fingerprints enter the tables, so exact copies cost one row.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqforge.llm import common as C

SEED = 42
ADDED = ["fingerprint", "component_id"]
#: Shingles whose bits are counted at once.
BLOCK = 1 << 16


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """SimHash of a text: majority bits of the XXH64 of its word shingles."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    a, b = starts[:len(words) - k + 1].tolist(), ends[k - 1:].tolist()
    ones, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for i in range(0, len(a), BLOCK):
        h = np.fromiter((digest(joined[x:y], SEED) for x, y in zip(a[i:i + BLOCK], b[i:i + BLOCK])), ">u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(a))
    return int.from_bytes(bits.tobytes(), "big")


def _fingerprints(text_col: str, shingle: int):
    def run(batches):
        for b in C.batch_blocks(batches, text_col):
            fp = np.array([fingerprint(t, shingle) for t in b.column(text_col).to_pylist()], np.uint64).view(np.int64)
            cols = [c for n, c in zip(b.schema.names, b.columns) if n != text_col]
            names = [n for n in b.schema.names if n != text_col]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(fp)], names=[*names, "_fp"])
    return run


def _blocks(n: int) -> list[tuple[int, int]]:
    """(shift, width) of n blocks of a 32-bit segment."""
    edges = [i * 32 // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges[:-1], edges[1:])]


def _tables(max_bits: int) -> list[tuple[int, int, int, int, int]]:
    """(key kind, segment shift, radius, block shift in the other, width)."""
    out = []
    for seg, radii in ((32, max_bits // 2 + 1), (0, (max_bits + 1) // 2)):
        for radius in range(radii):
            for at, width in _blocks(max_bits - radius + 1):
                out.append((len(out), seg, radius, 32 - seg + at, width))
    return out


def _key(fp: Column, kind: int, seg: int, at: int, width: int) -> Column:
    part = F.shiftrightunsigned(fp, seg).bitwiseAND(F.lit(0xFFFFFFFF))
    block = F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << width) - 1))
    return F.xxhash64(F.lit(kind), part, block)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def links(fps: DataFrame, max_bits: int) -> DataFrame:
    """(a, b), a < b: all pairs of the distinct ``fp`` within ``max_bits``."""
    fp = F.col("fp")
    kinds = _tables(max_bits)
    table = fps.select(fp.alias("b"), F.explode(F.array(*[_key(fp, k, s, at, w) for k, s, _, at, w in kinds])).alias("key"))
    balls = []
    for k, s, radius, at, w in kinds:
        for flips in combinations(range(32), radius):
            mask = sum(1 << (s + i) for i in flips)
            balls.append(_key(fp.bitwiseXOR(F.lit(_signed(mask))), k, s, at, w))
    probes = fps.select(fp.alias("a"), F.explode(F.array(*balls)).alias("key"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits
    return probes.join(table, "key").filter((F.col("a") < F.col("b")) & near).select("a", "b").distinct()


def simhash_dedup(docs: DataFrame, shingle: int = 3, max_bits: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its columns but the text, ``fingerprint`` (16 hex
    digits) and ``component_id``, the smallest id reachable over fingerprints
    that differ in at most ``max_bits`` bits.

    Texts are lower-cased (A-Z) and cut into words at blank and 0x09-0x0D; a
    text of fewer words than a shingle is one shingle; a null or blank text has
    fingerprint zero, linked like any other.  A null id never names a component
    (a component of null ids only has a null name).  Repeated rows share a
    component.  Input columns named as the added ones are replaced.  An empty
    table gives an empty result.
    """
    docs = C.without(docs, ADDED)
    rest = T.StructType([f for f in docs.schema.fields if f.name != text_col])
    marked = docs.select(*rest.names, text_col).mapInArrow(
        _fingerprints(text_col, shingle), T.StructType([*rest.fields, T.StructField("_fp", T.LongType())]))
    marked = C.stored(marked, "fingerprints")
    least = marked.groupBy(F.col("_fp").alias("fp")).agg(F.min(id_col).alias("least"))
    roots = C.components(links(least.select("fp"), max_bits))
    owner = least.join(roots, F.col("fp") == F.col("node"), "left").withColumn("root", F.coalesce("root", "fp"))
    named = owner.groupBy("root").agg(F.min("least").alias("component_id"))
    owner = owner.select("fp", "root").join(named, "root").select("fp", "component_id")
    return marked.join(owner, F.col("_fp") == F.col("fp")).select(
        *rest.names, F.lpad(F.lower(F.hex("_fp")), 16, "0").alias("fingerprint"), "component_id")


def digest(docs: DataFrame) -> DataFrame:
    """The columns of query op2."""
    return simhash_dedup(docs.select("doc_id", "text"))


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """Pipeline stage: of each component the document whose id names it stays
    (rows that repeat that id stay together; rows without an id all stay)."""
    names = simhash_dedup(docs.select("doc_id", "text")).filter(F.col("doc_id") == F.col("component_id")) \
        .select(F.col("doc_id").alias("_kept")).distinct()
    return docs.join(names, F.col("doc_id") == F.col("_kept"), "left").filter(
        F.col("_kept").isNotNull() | F.col("doc_id").isNull()).select(*docs.columns)
