"""Masking for masked-token training data (M1-M4).

Every draw is a hash of ``(seed, row key, position, purpose)``: one md5
per row gives a 32-bit row seed, and a cheap integer mix of (row seed,
position, purpose) gives each draw, so results are reproducible and
independent of partitioning.  All draws of a row need that row only, so
M1-M3 are map-only Arrow batch functions.  Id lists have no null entries;
a row whose ids (or structure) are null has null results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from seqforge.functions import arrow as A
from seqforge.functions.alphabet import CLS, IGNORE_INDEX, MASK, PAD, RESIDUES, SEP, SPECIALS, STRUCTURE_RATES


def special_ids(hyphen: bool = False) -> dict[str, int]:
    off = (1 if hyphen else 0) + len(RESIDUES)
    return {t: off + i for i, t in enumerate(SPECIALS)}


def vocab_size(hyphen: bool = False) -> int:
    return (1 if hyphen else 0) + len(RESIDUES) + len(SPECIALS)


M32 = 1 << 32


def row_seed(seed, key: Column) -> Column:
    """32-bit row seed from ``md5('<seed>:<key>')`` (one md5 per row)."""
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), key))
    return F.conv(F.substr(h, F.lit(1), F.lit(8)), 16, 10).cast("long")


def mix(rs: np.ndarray, i: np.ndarray, purpose: int) -> np.ndarray:
    """32-bit integer hash of (row seed, position, purpose): add, then two
    xor-shift-multiply rounds.  Every product stays below 2^63, so plain
    long arithmetic is exact (no overflow) here and in SQL."""
    x = (rs + i * 40503 + purpose * 1000003) & (M32 - 1)
    for _ in range(2):
        x = ((x ^ (x >> 16)) * 73244475) & (M32 - 1)
    return x ^ (x >> 16)


def uniform(rs: np.ndarray, i: np.ndarray, purpose: int) -> np.ndarray:
    return mix(rs, i, purpose) / float(M32)


# purposes of the per-position draws
SEL, HOW, RND, ORDER, MASKDRAW, SWAP = 1, 2, 3, 4, 5, 6


def row_key(*cols: str) -> Column:
    return F.concat_ws("/", *[F.col(c).cast("string") for c in cols])


def _by_row(df: DataFrame, keys: list[str], seed, columns: dict[str, str], added: dict[str, ST.DataType], work) -> DataFrame:
    """``keys`` and the ``added`` columns that ``work`` makes of each block of
    rows; it gets the Arrow columns by name, the row seeds and is map-only."""
    src = df.select(*keys, row_seed(seed, row_key(*keys)).alias("_rs"), *[F.col(c).alias(n) for n, c in columns.items()])

    def run(batches):
        for b in A.blocks(batches, next(iter(columns))):
            got = dict(zip(b.schema.names[len(keys):], b.columns[len(keys):]))
            new = work(got, got["_rs"].to_numpy())
            yield pa.RecordBatch.from_arrays([*b.columns[:len(keys)], *new], names=[*keys, *added])
    return src.mapInArrow(run, ST.StructType([*src.schema.fields[:len(keys)], *[ST.StructField(n, t) for n, t in added.items()]]))


def _places(bounds: np.ndarray, rs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row seed, position in its row) of every list entry."""
    size = np.diff(bounds)
    return np.repeat(rs, size), np.arange(bounds[-1]) - np.repeat(bounds[:-1], size)


IDS = ST.ArrayType(ST.IntegerType())


def _masked(x, chosen, value, bounds, null) -> list[pa.Array]:
    ids = np.where(chosen, value, x).astype(np.int32)
    labels = np.where(chosen, x, IGNORE_INDEX).astype(np.int32)
    return [A.lists(ids, bounds, null), A.lists(labels, bounds, null)]


# M1 ------------------------------------------------------------------------
def mask_uniform(df: DataFrame, ids: str, keys: list[str], p: float = 0.15, seed: int = 0,
                 hyphen: bool = False) -> DataFrame:
    """Each non-special position is chosen with probability ``p``; chosen
    positions become ``[MASK]`` (80%), a random id (10%) or stay (10%).
    Returns ``(*keys, masked_ids, labels)``; labels hold the original id
    where chosen and -100 elsewhere."""
    sp = special_ids(hyphen)
    nv = vocab_size(hyphen)

    def work(cols, seeds):
        x, bounds = A.list_values(cols["_ids"])
        rs, i = _places(bounds, seeds)
        chosen = ~np.isin(x, [sp[CLS], sp[SEP], sp[PAD]]) & (uniform(rs, i, SEL) < p)
        r = uniform(rs, i, HOW)
        rnd = np.floor(uniform(rs, i, RND) * nv)
        value = np.where(r < 0.8, sp[MASK], np.where(r < 0.9, rnd, x))
        return _masked(x, chosen, value, bounds, np.asarray(cols["_ids"].is_null()))
    return _by_row(df, keys, seed, {"_ids": ids}, {"masked_ids": IDS, "labels": IDS}, work)


# M2 ------------------------------------------------------------------------
def mask_by_structure(df: DataFrame, ids: str, ss: str, keys: list[str], rates=None, seed: int = 0,
                      offset: int = 1, carry: bool = False) -> DataFrame:
    """``(*keys, mask, mask_pos)``: one boolean per id position and the
    chosen id positions (ascending), chosen by structure — for each tag
    exactly ``floor(n_tag * rate)`` of the tag's positions, without
    replacement, those with the smallest hash.  Tags without a rate are
    never chosen.  The structure is cut to the id length first;
    ``offset=1`` aligns structure position i with id position i+1 (after
    ``[CLS]``); ``offset=0`` reproduces the reference (it can mask
    ``[CLS]``).  ``carry`` adds the ids and the structure, so that M3 and M4
    need no join."""
    rates = rates or STRUCTURE_RATES

    def work(cols, seeds):
        no = np.asarray(cols["_ids"].is_null()) | np.asarray(cols["_ss"].is_null())
        x, bounds = A.list_values(cols["_ids"])
        n = np.diff(bounds)
        _, _, first, tag = A.letters(cols["_ss"])
        row = np.repeat(np.arange(len(n)), np.diff(first))
        i = np.arange(len(tag)) - first[row]
        number = np.full(max(int(tag.max(initial=0)) + 1, 1 + max(map(ord, rates), default=0)), -1)
        number[[ord(t) for t in rates]] = np.arange(len(rates))
        tag = number[tag]
        inside = (i < n[row]) & (tag >= 0)
        row, i, tag = row[inside], i[inside], tag[inside]
        group = row * max(len(rates), 1) + tag
        order = np.argsort(group << 32 | mix(seeds[row], i, ORDER), kind="stable")  # ties by position
        row, i, group = row[order], i[order], group[order]
        head = np.flatnonzero(np.append(True, group[1:] != group[:-1])[:len(row)])
        count = np.diff(np.append(head, len(row)))
        rate = np.array(list(rates.values()), float)[group[head] % max(len(rates), 1)]
        rank = np.arange(len(row)) - np.repeat(head, count)
        hit = (rank < np.repeat(np.floor(count * rate), count)) & (i + offset < n[row])
        mask = np.zeros(bounds[-1], bool)
        mask[bounds[row[hit]] + i[hit] + offset] = True
        at = np.flatnonzero(mask)
        own = np.searchsorted(at, bounds)
        pos = (at - np.repeat(bounds[:-1], np.diff(own))).astype(np.int32)
        return [*([cols["_ids"], cols["_ss"]] if carry else []), A.lists(mask, bounds, no), A.lists(pos, own, no)]
    kept = {ids: df.schema[ids].dataType, ss: df.schema[ss].dataType} if carry else {}
    return _by_row(df, keys, seed, {"_ids": ids, "_ss": ss},
                   {**kept, "mask": ST.ArrayType(ST.BooleanType()), "mask_pos": IDS}, work)


# M3 ------------------------------------------------------------------------
def corrupt(df: DataFrame, ids: str, mask: str, keys: list[str], seed: int = 0, mode: str = "80_10_10",
            hyphen: bool = False, sep: str | None = None) -> DataFrame:
    """Apply a mask: ``(*keys, masked_ids, labels)``; labels keep the
    original id at masked positions (-100 elsewhere).  With ``sep`` both
    are texts, the ids joined by it.

    * ``80_10_10``: 80% ``[MASK]``, 10% random id, 10% unchanged;
    * ``as_reference``: 80% ``[MASK]``, then an independent 50% draw
      overwrites with a random id — effectively 40/50/10."""
    sp = special_ids(hyphen)
    nv = vocab_size(hyphen)
    if mode not in ("80_10_10", "as_reference"):
        raise ValueError(mode)

    def work(cols, seeds):
        x, bounds = A.list_values(cols["_ids"])
        m, ends = A.list_values(cols["_mask"])
        no = np.asarray(cols["_ids"].is_null()) | np.asarray(cols["_mask"].is_null())
        if not no.any() and not np.array_equal(bounds, ends):
            raise ValueError("ids and mask must have the same length")
        chosen = np.zeros(len(x), bool)
        if len(m):
            live = ~np.repeat(no, np.diff(bounds))
            chosen[live] = m[~np.repeat(no, np.diff(ends))]
        rs, i = _places(bounds, seeds)
        r = uniform(rs, i, MASKDRAW)
        rnd = np.floor(uniform(rs, i, RND) * nv)
        if mode == "80_10_10":
            value = np.where(r < 0.8, sp[MASK], np.where(r < 0.9, rnd, x))
        else:
            value = np.where(uniform(rs, i, SWAP) < 0.5, rnd, np.where(r < 0.8, sp[MASK], x))
        out = _masked(x, chosen, value, bounds, no)
        return out if sep is None else [A.joined(c, sep) for c in out]
    kind = IDS if sep is None else ST.StringType()
    return _by_row(df, keys, seed, {"_ids": ids, "_mask": mask}, {"masked_ids": kind, "labels": kind}, work)


# M4 ------------------------------------------------------------------------
def mask_report(df: DataFrame, ss: str, mask: str, by: list[str] | None = None, offset: int = 1) -> DataFrame:
    """Per structure tag: positions, masked positions and the rate (per
    ``by`` group if given).  Structure position i is read against mask
    position i + offset (beyond the mask: not masked); a row has as many
    positions as its mask, or its structure if that is shorter.  Each row
    is counted in its batch and gives one row per tag that it has."""
    cols = by or []
    src = df.select(*cols, F.col(ss).alias("_ss"), F.col(mask).alias("_mask")).filter("_ss is not null and _mask is not null")
    schema = ST.StructType([*src.schema.fields[:-2], ST.StructField("tag", ST.StringType()),
                            ST.StructField("total", ST.LongType()), ST.StructField("masked", ST.LongType())])

    def run(batches):
        for b in A.blocks(batches, "_ss"):
            _, _, first, points = A.letters(b.column(b.num_columns - 2))
            flags, bounds = A.list_values(b.column(b.num_columns - 1))
            flags = np.append(np.equal(flags, True).astype(bool), False)  # a null flag is not masked
            size = np.minimum(np.diff(first), np.diff(bounds))
            row = np.repeat(np.arange(len(size)), size)
            i = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
            at = bounds[row] + i + offset
            hit = flags[np.where((at >= bounds[row]) & (at < bounds[row + 1]), at, len(flags) - 1)]
            pairs, to = np.unique(row.astype(np.int64) << 32 | points[first[row] + i], return_inverse=True)
            own = pa.array(pairs >> 32)
            yield pa.RecordBatch.from_arrays(
                [*(c.take(own) for c in b.columns[:-2]), pa.array([chr(x) for x in pairs & 0xFFFFFFFF], pa.string()),
                 pa.array(np.bincount(to, minlength=len(pairs))),
                 pa.array(np.bincount(to, hit, minlength=len(pairs)).astype(np.int64))], names=schema.names)
    d = src.mapInArrow(run, schema)
    return (d.groupBy(*cols, "tag").agg(F.sum("total").alias("total"), F.sum("masked").alias("masked"))
              .withColumn("rate", F.col("masked") / F.col("total")))
