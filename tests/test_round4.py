"""Bounded memory and work of embeddings, the store, gram counts and the stream meter."""
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from seqforge.operators import corpus as C
from seqforge.operators import vectors as E
from seqforge.sources import files as S
from seqforge.sources import matrix as M

TABLE = "aa1 string, aa2 string, score int"


def test_embed_holds_a_few_matrices(spark, monkeypatch):
    class Told:
        dim = 2

        def __init__(self, table):
            pass

        def encode_batch(self, seqs, max_len):
            return [np.array([[len(seqs), sum(map(len, seqs))]] * min(len(s), max_len), np.float32).reshape(-1, 2) for s in seqs]

    monkeypatch.setitem(E.ENCODERS, "told", Told)
    df = spark.createDataFrame([(i, "A" * 1000) for i in range(300)] + [(300, ""), (301, None)], "id long, s string").coalesce(1)
    rows = {r.id: r for r in E.embed(df, "s", ["id"], "told", 3, states=True).collect()}
    assert max(r.matrix[0][1] for r in rows.values() if r.n_rows) <= E.LETTERS
    assert max(r.matrix[0][0] for r in rows.values() if r.n_rows) <= 64
    assert [len(rows[i].matrix) for i in (0, 299, 300, 301)] == [3, 3, 0, 0]
    assert all(r.sums == [sum(x[k] for x in r.matrix) for k in (0, 1)] for r in rows.values())
    assert rows[300].maxima is None and rows[0].maxima == rows[0].matrix[0]


def test_store_moves_no_matrix(spark, tmp_path):
    t = spark.createDataFrame([(a, b, (i * 7 + j * 3) % 19) for i, a in enumerate("ACDE") for j, b in enumerate("ACDE")], TABLE)
    df = spark.createDataFrame([(i, "ACDE" * 5000 + "A" * i) for i in range(40)], "id long, s string")
    path = f"{tmp_path}/store"
    out = S.embedding_store(df, path, "s", "substitution", lambda u: E.embed_windows(u, "s", ["key"], "substitution", 1000, t, states=True), 20, digits=1)
    assert out.count() == 40
    for p in (tmp_path / "store/matrices").rglob("*.parquet"):
        meta = pq.ParquetFile(p).metadata
        for k in range(meta.num_row_groups):  # what a reader decodes at once: floats, however well they are packed
            values = max(meta.row_group(k).column(c).num_values for c in range(meta.row_group(k).num_columns))
            assert values <= 8 * S.ROW_GROUP
    total = F.aggregate(F.flatten("matrix"), F.lit(0.0), lambda a, x: a + x)
    m = S.read_matrices(out, path, "substitution", 1, {"t": total})
    moved = [line for line in m._jdf.queryExecution().executedPlan().toString().split("\n") if "Join" in line or "Exchange" in line]
    assert moved and not any("matrix" in line for line in moved)
    got = {r.key: r.t for r in m.groupBy("key").agg(F.sum("t").alias("t")).collect()}
    assert got == {r.key: sum(r.sums) for r in out.collect()}


@pytest.mark.parametrize("letters", ["ACDEFG", "".join(chr(0x4E00 + i) for i in range(3000))])
def test_gram_counts(spark, letters):
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list(letters), n)) for n in (0, 1, 2, 3, 50, 4000)] + [None]
    want = Counter(s[i:i + n] for s in texts if s for n in (1, 3) for i in range(len(s) - n + 1))
    got = C.gram_counts(spark.createDataFrame([(s,) for s in texts], "s string"), "s", [1, 3]).collect()
    assert {r.token: r.frequency for r in got} == want and len(got) == len(want)


def test_matrix_reads_the_corpus_once(spark):
    texts = ["ACACCA", "AAxAA", "", None, "WYWYA"]
    df = spark.createDataFrame([(s,) for s in texts], "sequence string")
    m = M.derive_substitution_matrix(df)
    plan = m._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Generate regexp" not in plan
    pairs = Counter(tuple(sorted(s[i:i + 2])) for s in texts if s for i in range(len(s) - 1) if "x" not in s[i:i + 2])
    n, ca = sum(pairs.values()), Counter()
    for (a, b), c in pairs.items():
        ca[a] += c
        ca[b] += c
    want = {}
    for (a, b), c in pairs.items():
        e = ca[a] * ca[b] / (2 * n) ** 2 * (1 if a == b else 2)
        want[a, b] = want[b, a] = round(2 * np.log2(c / n / e))
    got = m.collect()
    assert {(r.aa1, r.aa2): r.score for r in got} == want and len(got) == len(want)


def test_metered_continues():
    from seqforge.streaming import reset_meter as R
    rng = np.random.default_rng(7)
    units, reset = rng.integers(-5, 1 << 60, 500), rng.random(500) < 0.05
    total, count, want = 17, 4, []
    for u, r in zip(units.tolist(), reset):
        total, count = (0, 0) if r else (total, count)
        total, count = ((total + u + 2**63) % 2**64) - 2**63, count + 1
        want.append((total, count))
    sums, counts = R.metered(units, reset, 17, 4)
    assert list(zip(sums.tolist(), counts.tolist())) == want


def test_meter_of_many_rows(spark, tmp_path):
    """Rows of one key in one batch: their state calls and timers once took minutes."""
    import time

    from seqforge.streaming import reset_meter as R
    df = spark.range(60000).select(F.lit("a").alias("k"), F.col("id").alias("step"), F.timestamp_micros(F.col("id") * 37000500 + 1_700_000_000_000_000).alias("ts"),
                                   (F.col("id") % 7 / 4).alias("v"), (F.col("id") % 50 == 0).alias("reset"))
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    cols = dict(key="k", step="step", ts="ts", value="v", reset="reset")
    began = time.time()
    out = R.run_reset_meter(spark, spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/ckpt", **cols)
    got = sorted(tuple(x) for x in out.collect())
    assert time.time() - began < 60
    want = sorted(tuple(x) for x in R.reset_meter(df, **cols).collect())
    assert 0 < len(want) - len(got) < 100 and got == want[:len(got)]


@pytest.mark.parametrize("most", [3, 400])
def test_dominated(most):
    from seqforge.operators.metrics import dominated
    rng = np.random.default_rng(most)
    for n in (1, 2, 63, 64, 65, 300):
        t, y, p = (rng.integers(0, most, n) for _ in range(3))
        w = rng.integers(1, 4, n)
        less = [x[None, :] < x[:, None] for x in (t, y, p)]
        pairs = w[:, None] * w[None, :]
        assert dominated(t, y, p, w) == (pairs * (less[0] & less[1] & less[2])).sum()
        assert dominated(t, y, None, w) == (pairs * (less[0] & less[1])).sum()


def test_ordered_concordance_in_blocks(spark, monkeypatch, tmp_path):
    """Blocks of a few rows, hot values of each column; and rows that are written do not grow with their logarithm."""
    from seqforge.operators import metrics as G
    monkeypatch.setattr(G, "BLOCK_ROWS", 5)
    monkeypatch.setattr(G, "BLOCKS", 7)
    rng = np.random.default_rng(11)
    rows = [(g, int(o), float(y), float(p)) for g, most in (("a", 4), ("b", 60)) for o, y, p in zip(*(rng.integers(0, most, 150) for _ in range(3)))]
    rows += [("hot", i, 1.0, float(i % 3)) for i in range(90)] + [("one", 1, 1.0, 1.0)]
    want = {}
    for g, o, y, p in rows:
        n = want.setdefault(g, [0, 0.0])
        for h, o2, y2, p2 in rows:
            if g == h and o2 < o and y2 < y:
                n[0] += 1
                n[1] += 1.0 if p2 < p else 0.5 if p2 == p else 0.0
    got = G.c_index_ordered(spark.createDataFrame(rows, "g string, o int, y double, p double"), ["g"], "o")
    assert {r.g: (r.n_pairs, round(r.c_index, 9)) for r in got.collect()} == {g: (n, round(s / n, 9) if n else 0.0) for g, (n, s) in want.items()}
    generated = [line for line in got._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Generate explode" in line]
    assert not generated  # no row per pair of bits
