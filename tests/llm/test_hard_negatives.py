"""Hard negatives against a plain computation with whole Python numbers."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqforge.llm import hard_negatives as hn

BIG = hn.SCORE_LIMIT


def brute(rows, positives=5, negatives=3):
    rows = [(i, y, [math.floor(256 * x) for x in v]) for i, v, y in rows
            if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]

    def score(a, b):
        return max(-BIG, min(BIG, sum(x * y for x, y in zip(a, b))))
    out = []
    for k, (i, y, v) in enumerate(rows):
        if i % 50:
            continue
        others = sorted((-score(v, w), j, z) for m, (j, z, w) in enumerate(rows) if m != k)
        for p, j, z in [o for o in others if o[2] == y][:positives]:
            found = [o for o in others if o[2] != y and 50 * -p <= 100 * -o[0] <= 95 * -p][:negatives]
            out += [(i, j, r + 1, m, -p, -s) for r, (s, m, _) in enumerate(found)]
    return sorted(out)


def mined(spark, rows, slices=3):
    df = spark.createDataFrame([(i, v, y, "x") for i, v, y in rows], "vec_id long, embedding array<double>, label int, rank string")
    got = hn.mine(df.repartition(slices).withColumn("extra", F.lit(0)), F.col("vec_id") % 50 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in got.collect())


@pytest.mark.parametrize("shape", [(1, 1, 1), (33, 17, 40), (65, 70, 129), (16, 64, 512), (100, 1, 7)])
def test_strassen(shape):
    r = np.random.default_rng(1)
    a, b = r.integers(-10**8, 10**8, shape[:2]), r.integers(-10**8, 10**8, shape[1:])
    assert (hn.strassen(a, b) == a @ b).all()
    assert (hn.strassen(a, b, 2) == a @ b).all()


@pytest.mark.parametrize("cells", [hn.CHUNK_CELLS, 64])
def test_against_brute_force(spark, monkeypatch, cells):
    monkeypatch.setattr(hn, "CHUNK_CELLS", cells)
    monkeypatch.setattr(hn, "BLOCK_ROWS", 2)
    r = random.Random(3)
    rows = [(i, [r.choice([-0.3, 0.1, 0.4, 0.8]) for _ in range(5)], r.randint(0, 2)) for i in range(-50, 260)]
    assert mined(spark, rows) == brute(rows)


def test_odd_rows(spark):
    r = random.Random(4)
    rows = [(i, [r.random(), r.random() - 0.5, 0.25], r.randint(0, 1)) for i in range(60)]
    rows += [(50, [0.5, 0.5, 0.5], 0), (50, [0.5, 0.5, 0.5], 0), (7, [0.9, 0.1, 0.2], 1), (7, [0.9, 0.1, 0.2], 1)]
    rows += [(None, [1.0, 1.0, 1.0], 0), (100, None, 0), (100, [1.0, None, 1.0], 0), (150, [1.0, 1.0, 1.0], None),
             (200, [math.nan, 1.0, 1.0], 1), (250, [math.inf, 1.0, 1.0], 1), (300, [], 0), (301, [], 1), (302, [0.0], 0),
             (350, [0.5] * 9, 0), (351, [0.4] * 9, 1), (352, [0.45] * 9, 0)]
    got = mined(spark, rows)
    assert got == brute(rows) and any(x[0] == 300 for x in got)


def test_huge_numbers(spark):
    r = random.Random(5)
    rows = [(i, [r.choice([1e3, 1e9, 1e13, 3e30, -1e12]) * r.random() for _ in range(3)], r.randint(0, 1)) for i in range(0, 500, 5)]
    assert mined(spark, rows, 2) == brute(rows)


def test_no_rows(spark):
    assert mined(spark, [(1, [0.5], 1)]) == [] and mined(spark, [(50, [0.5], 1)]) == []
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert hn.digest(df).count() == 0


def test_nothing_but_chunk_numbers_is_broadcast(spark):
    """The files of blocks are small, what is made of them is not: each is sent to every chunk."""
    r = random.Random(6)
    rows = [(i, [r.random() for _ in range(4)], r.randint(0, 2)) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    got = hn.mine(df, F.col("vec_id") % 50 == 0)
    plan = got._jdf.queryExecution().executedPlan().toString().split("AdaptiveSparkPlan", 1)[1]
    lines = plan.splitlines()
    for at, line in enumerate(lines):
        if "BroadcastExchange" in line:
            depth = len(line) - len(line.lstrip(" :+-"))
            below = [x for x in lines[at + 1:at + 2] if len(x) - len(x.lstrip(" :+-")) > depth]
            assert below and not any("vec" in x for x in below)
    assert "SortMergeJoin [chunk" in plan and plan.count("hashpartitioning(chunk") == 2
    assert sorted(tuple(x) for x in got.collect()) == brute(rows)


def test_exact_beyond_doubles():
    """Products go through doubles only while every sum of the recursion is a whole number that they hold."""
    r = np.random.default_rng(7)
    for top in (100, 10**5, 10**6, 10**7, 2**27):
        a, b = r.integers(-top, top + 1, (70, 64)), r.integers(-top, top + 1, (90, 64))
        a[0], b[0] = top, top
        want = np.clip(a @ b.T, -BIG, BIG)
        assert (hn.scores(a, b) == want).all()
        assert (hn.scores(a[:3], b[:5]) == want[:3, :5]).all()


def test_windows_sparse_and_dense(monkeypatch):
    r = np.random.default_rng(8)
    s, ids = r.integers(0, 400, (30, 200)), np.arange(200) * 3
    low, high = r.integers(0, 300, (30, 4)), r.integers(100, 400, (30, 4))
    high[5:9, 2:] = hn.NONE
    high[20:] = low[20:] + 2
    for part in (slice(0, 20), slice(20, 30)):  # many entries within the windows, and few
        top, who = hn._in_windows(s[part].copy(), ids, low[part], high[part], 3)
        for i, w in np.ndindex(low[part].shape):
            want = sorted((-x, y) for x, y in zip(s[part][i].tolist(), ids.tolist()) if low[part][i, w] <= x <= high[part][i, w])[:3]
            assert [(-x, y) for x, y in zip(top[i, w].tolist(), who[i, w].tolist()) if x != hn.NONE] == want
