"""Grouped n-grams, encoded rows and concordance without a row per letter or bit."""
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqforge.operators import corpus as C


@pytest.mark.parametrize("sizes", [(2, 3), (1, 4, 4)])
def test_grouped_ngrams(spark, monkeypatch, sizes):
    """Keys whose rows lie apart, null keys and texts, other letters, sizes that fit no bitmap."""
    monkeypatch.setattr(C, "SET_ROWS", 3)
    rng = np.random.default_rng(5)
    letters = list("ACDEFGHIKLMNPQRSTVWY") + ["x", "\u00e9", "\U0001f600"]
    rows = [(int(i % 7) if i % 7 else None, "u" if i % 2 else "v", "".join(rng.choice(letters, n)) if n >= 0 else None)
            for i, n in enumerate(rng.integers(-1, 90, 120))]
    rows += [(100, "short", "A"), (100, "null", None), (101, "plain", "ACACAC")]
    total, seen = Counter(), defaultdict(set)
    for k, g, s in rows:
        for n in sizes:
            grams = [s[i:i + n] for i in range(len(s) - n + 1)] if s else []
            total[k, g] += len(grams)
            seen[k, g] |= set(grams)
    df = spark.createDataFrame(rows, "k int, g string, s string").repartition(3)
    out = C.ngrams(df, "s", sizes, by=["k", "g"])
    got = {(r.k, r.g): (r.n_grams, r.n_distinct) for r in out.collect()}
    assert got == {k: (n, len(seen[k])) for k, n in total.items() if n}
    assert dict(out.dtypes) == {"k": "int", "g": "string", "n_grams": "bigint", "n_distinct": "bigint"}


def test_grouped_ngrams_make_no_row_per_gram(spark):
    df = spark.createDataFrame([(i, "ACDEFGHIKL" * 50) for i in range(4)], "k int, s string")
    plan = C.ngrams(df, "s", by=["k"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "MapInArrow" in plan


@pytest.mark.parametrize("hyphen", [False, True])
@pytest.mark.parametrize("max_len", [2, 3, 12])
def test_encoded_letters(spark, max_len, hyphen):
    texts = ["ACDEFGHIKLMNPQRSTVWY", "ACD", "", None, "A-x\u00e9\U0001f600C", "ACDEFGHIKL", "ACDEFGHIKLM", "\u007f\u0080"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, s string").coalesce(1)
    want = df.filter("s is not null").select("id", C.encode_fixed(C.tokenize_chars("s"), max_len, C.char_index_map(hyphen), hyphen)["input_ids"].alias("ids"))
    got = {r.id: r.ids for r in C.encode_letters(df, "s", max_len, ["id"], "ids", hyphen).collect()}
    assert got.pop(3) is None and got == {r.id: r.ids for r in want.collect()}


def test_encoding_of_masking_has_no_lambda(spark):
    from seqforge.plans import q_masking as Q
    plan = Q._encoded(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan


def test_structure_mask_takes_the_smallest_hashes(spark):
    """Rates of some tags only, tags that are not ASCII, a rate that takes all."""
    from seqforge.operators import masking as M
    rng = np.random.default_rng(2)
    rows = [(k, [1] * (n + 2), "".join(rng.choice(list("HEC\u00e9x"), n))) for k, n in enumerate(rng.integers(0, 60, 30).tolist())]
    rates = {"C": 0.4, "\u00e9": 1.0, "E": 0.15}
    df = spark.createDataFrame(rows, "k int, ids array<int>, ss string")
    got = {r.k: r.mask_pos for r in M.mask_by_structure(df, "ids", "ss", ["k"], rates, seed=3).collect()}
    seeds = {r.k: r.rs for r in df.select("k", M.row_seed(3, M.row_key("k")).alias("rs")).collect()}
    for k, _, ss in rows:
        want = []
        for t, rate in rates.items():
            at = [i for i, c in enumerate(ss) if c == t]
            h = M.mix(np.full(len(at), seeds[k]), np.array(at, np.int64), M.ORDER)
            want += [i + 1 for _, i in sorted(zip(h.tolist(), at))[:int(np.floor(len(at) * rate))]]
        assert got[k] == sorted(want)


def test_corrupt_as_text(spark):
    from seqforge.operators import masking as M
    rows = [(0, [1, 2, 3] * 40, [True, False, True] * 40), (1, [], []), (2, None, None), (3, [7], [False]), (4, [7], None)]
    df = spark.createDataFrame(rows, "k int, ids array<int>, mask array<boolean>").coalesce(1)
    for mode in ("80_10_10", "as_reference"):
        want = M.corrupt(df, "ids", "mask", ["k"], 5, mode).collect()
        got = {r.k: r for r in M.corrupt(df, "ids", "mask", ["k"], 5, mode, sep=",").collect()}
        for r in want:
            for c in ("masked_ids", "labels"):
                assert got[r.k][c] == (None if r[c] is None else ",".join(map(str, r[c])))


def test_concordance_in_ranges(spark, monkeypatch):
    """Ranges of a few rows; hot values of y and of p, copies, NaN, nulls, a null group."""
    from seqforge.operators import metrics as G
    monkeypatch.setattr(G, "RANGE_ROWS", 9)
    rng = np.random.default_rng(12)
    nan = float("nan")
    rows = [(g, float(y), float(p)) for g, my, mp in (("a", 3, 90), ("b", 90, 3), ("c", 50, 50), (None, 4, 4)) for y, p in
            zip(rng.integers(0, my, 140), rng.integers(0, mp, 140))]
    rows += [("c", nan, 1.0), ("c", nan, 60.0), ("c", 1.0, nan), ("c", 2.0, nan), ("c", None, 1.0), ("c", 1.0, None), ("one", 1.0, 1.0), ("gone", None, 1.0)]
    want = {}

    def less(a, b):
        return a < b or (np.isnan(b) and not np.isnan(a))
    live = [r for r in rows if r[1] is not None and r[2] is not None]
    for g, y, p in live:
        n = want.setdefault(g, [0, 0.0])
        for h, y2, p2 in live:
            if g == h and less(y2, y):
                n[0] += 1
                n[1] += 1.0 if less(p2, p) else 0.0 if less(p, p2) else 0.5
    out = G.c_index(spark.createDataFrame(rows, "g string, y double, p double"), ["g"])
    assert {r.g: (r.n_pairs, round(r.c_index, 9)) for r in out.collect()} == {g: (n, round(s / n, 9) if n else 0.0) for g, (n, s) in want.items()}
    assert "Generate explode" not in out._jdf.queryExecution().optimizedPlan().toString()  # no row per bit of a rank


def test_sketches_are_compared_in_strips(monkeypatch):
    """The pairs of all rows at once, and memory of a strip's rows times all, not of all times all."""
    import tracemalloc

    from seqforge.llm import jaccard_join as J
    rng = np.random.default_rng(9)
    base = [np.unique(rng.integers(0, 1 << J.BITS, 300, dtype=np.uint64)) for _ in range(4)]
    sets = [np.unique(np.concatenate((b[rng.random(len(b)) < 0.97], rng.integers(0, 1 << J.BITS, rng.integers(0, 20), dtype=np.uint64)))) for b in base for _ in range(400)]
    raw = [np.packbits(J.sketch(x)).tobytes() for x in sets]
    sids, roots, sizes = np.arange(len(sets))[::-1].copy(), np.arange(len(sets)) % 5, np.array([len(x) for x in sets])
    width = 8 * min(map(len, raw))
    m = np.stack([J.folded(J.bits_of(x), width) for x in raw]).astype(np.int64)
    want = set()
    for i in range(len(m)):
        apart = np.maximum((m[i] ^ m[i + 1:]).sum(axis=1), np.abs(sizes[i] - sizes[i + 1:]))
        both = sizes[i] + sizes[i + 1:]
        ok = (100 * (both - apart) >= 85 * (both + apart)) & (roots[i] != roots[i + 1:])
        want |= {(min(sids[i], sids[j]), max(sids[i], sids[j])) for j in i + 1 + np.flatnonzero(ok)}
    J.candidates(sids[:9], roots[:9], sizes[:9], raw[:9], 85)
    tracemalloc.start()
    got = J.candidates(sids, roots, sizes, raw, 85)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(want) and set(zip(*(x.tolist() for x in got))) == want
    assert peak < 48 << 20


def test_grams_of_a_block_of_text(monkeypatch):
    """Arrays of a word's or byte's length are made for a megabyte of text at a time."""
    import pyarrow as pa

    from seqforge.llm import jaccard_join as J
    seen, grams = [], J.grams
    monkeypatch.setattr(J, "grams", lambda data, offs, n: seen.append(len(data)) or grams(data, offs, n))
    texts = [f"w{i} " * 500 for i in range(3000)]
    b = pa.RecordBatch.from_pydict({"doc_id": list(range(3000)), "text": texts})
    out = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("_sid", pa.int64()), ("_set", pa.binary())])
    rows = sum(x.num_rows for x in J._sets(4, "text", out)([b]))
    assert rows == 3000 and sum(seen) == sum(map(len, texts)) and max(seen) <= 1 << 20
