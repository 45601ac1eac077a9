"""The Jaccard join against all pairs of a small table."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqforge.llm import common, jaccard_join as jj
from tests.conftest import SF
from tests.llm import brute


def grams(text, n=4):
    w = brute.words((text or "").translate({i: i + 32 for i in range(65, 91)}))
    return frozenset(tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def naive(rows, pct=85):
    """rows of (id, text) -> sorted (id, set size, component)."""
    sets = [grams(t) for _, t in rows]
    head = list(range(len(rows)))

    def top(i):
        while head[i] != i:
            i = head[i]
        return i
    hold = {}
    for i, s in enumerate(sets):
        for g in s:
            hold.setdefault(g, []).append(i)
    for i, s in enumerate(sets):
        near = {}
        for g in s:
            for j in hold[g]:
                if j < i:
                    near[j] = near.get(j, 0) + 1
        for j, n in near.items():
            if 100 * n >= pct * (len(s) + len(sets[j]) - n):
                head[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(d, least.get(top(i), d))
    return sorted(((d, len(s), least.get(top(i))) for i, (d, s) in enumerate(zip([r[0] for r in rows], sets))), key=repr)


def joined(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("N_Shingles", F.lit("x")).withColumn("sid", F.lit(0))
    got = jj.jaccard_join(df.repartition(3))[0]
    assert got.columns == ["doc_id", "sid", "n_shingles", "component_id"]
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()), key=repr)


def copies(r, base, n, edits):
    """Copies of a text with some words changed."""
    out = []
    for _ in range(n):
        w = list(base)
        for i in r.sample(range(len(w)), r.randint(0, edits)):
            w[i] = f"x{r.randint(0, 10**6)}"
        out.append(" ".join(w))
    return out


def corpus(seed):
    r = random.Random(seed)
    shared = [f"s{i}" for i in range(40)]
    out = []
    for size in (9, 10, 14, 22, 40, 80, 200, 700):
        for _ in range(3):
            base = [f"w{r.randint(0, 3000)}" for _ in range(size)]
            out += copies(r, base, 12, max(1, size // 30))
            out += copies(r, base + shared, 4, 2) + copies(r, shared[:size // 2] + base, 4, 1)
    out += [" ".join(shared[:k]) for k in range(1, 41)] + [" ".join(f"t{i}" for i in range(12)) + f" end{k}" for k in range(60)]
    r.shuffle(out)
    return [(i, t) for i, t in enumerate(out)]


@pytest.mark.parametrize("small,block,seed", [(jj.SMALL, jj.BLOCK_GRAMS, 1), (2, 200, 2), (10, 1000, 3)])
def test_against_all_pairs(spark, monkeypatch, small, block, seed):
    monkeypatch.setattr(jj, "SMALL", small)
    monkeypatch.setattr(jj, "BLOCK_GRAMS", block)
    rows = corpus(seed)
    assert joined(spark, rows) == naive(rows)


def test_odd_rows(spark):
    words = " ".join(f"w{i}" for i in range(60))
    rows = [(5, words), (3, words.upper()), (3, words), (None, words + " more"), (None, None), (None, "alone here"), (8, ""), (9, " \t\n"),
            (10, "one"), (11, "ONE"), (12, "one two"), (13, "Ä b c"), (14, "ä b c"), (-2, "the line \n" * 500), (4, "the line \n" * 501),
            (15, " ".join(str(i) for i in range(30000))), (16, " ".join(str(i) for i in range(29000))), (2**62, "z")]
    assert joined(spark, rows) == naive(rows)


def test_documents(spark):
    docs = common.table(spark, SF, "documents")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = jj.digest(docs)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == naive(rows)
    assert jj.digest(docs.filter("false")).count() == 0


def test_linked_sets_meet_in_a_cell():
    r = np.random.default_rng(7)
    for n in [*range(5, 60), 100, 333, 1000, 5000]:
        for _ in range(20):
            base = np.unique(r.integers(0, 1 << 48, n, dtype=np.uint64))
            t = jj.most_apart(len(base), 85)
            drop = int(r.integers(0, t + 1))
            new = r.integers(0, 1 << 48, t - drop, dtype=np.uint64)
            other = np.unique(np.append(r.permutation(base)[drop:], new))
            inter = len(np.intersect1d(base, other))
            longer = np.arange(int(r.integers(1, 9000)), dtype=np.uint64) << np.uint64(34)  # keys must not depend on the batch
            (_, own), (_, others) = jj.cell_keys([base], 85), jj.cell_keys([longer, other], 85)
            if 100 * inter >= 85 * (len(base) + len(other) - inter) and inter < max(len(base), len(other)):
                assert set(own.tolist()) & set(others.tolist())
