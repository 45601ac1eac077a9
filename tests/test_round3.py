"""Ordered concordance, weighted draws, embeddings of any length, the embedding
store: each against a plain computation."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqforge.operators import metrics as G
from seqforge.operators import splits as X
from seqforge.operators import vectors as E
from seqforge.sources import files as S


def plain_c_index(y, p):
    total = pairs = 0
    for i in range(1, len(y)):
        for j in range(i):
            if y[i] > y[j]:
                pairs += 1
                total += 1 if p[i] > p[j] else 0.5 if p[i] == p[j] else 0
    return pairs, total / pairs if pairs else 0.0


def test_ordered_c_index(spark):
    r = random.Random(1)
    rows = [(g, i, r.choice([1.0, 2.0, 2.5, 4.0]) if g else r.random(), round(r.random(), 1)) for g in (0, 1) for i in range(500)]
    rows += [(2, i, 1.0, r.random()) for i in range(5)] + [(1, 1000, None, 1.0), (1, 1001, 1.0, None)]
    r.shuffle(rows)
    got = {x.g: (x.n_pairs, x.c_index) for x in G.c_index_ordered(spark.createDataFrame(rows, "g int, o int, y double, p double"), ["g"], "o").collect()}
    for g in (0, 1, 2):
        mine = sorted((o, y, p) for k, o, y, p in rows if k == g and y is not None and p is not None)
        n, c = plain_c_index([m[1] for m in mine], [m[2] for m in mine])
        assert got[g][0] == n and got[g][1] == pytest.approx(c, abs=1e-12)


def test_ordered_c_index_equal_order(spark):
    df = spark.createDataFrame([(0, 1, 1.0, 1.0), (0, 1, 2.0, 2.0), (0, 2, 3.0, 3.0)], "g int, o int, y double, p double")
    assert G.c_index_ordered(df, ["g"], "o").first()["n_pairs"] == 2


def test_sample_by_weight(spark):
    rows = [(i, float(w), "x") for i, w in enumerate([0, 1, 1, 0, 1000, 1e-30, 2] * 30)] + [(999, None, "y"), (0, 3.0, "again")]
    df = spark.createDataFrame(rows, "k long, w double, draw_name string")
    got = X.sample_by_weight(df, "w", ["k"], n=20000, seed=3).collect()
    assert sorted(r.draw for r in got) == list(range(20000))
    assert all(r.w for r in got)
    total = sum(w or 0 for _, w, _ in rows)
    for want in (1000.0, 2.0):
        share = sum(r.w == want for r in got) / len(got)
        assert share == pytest.approx(sum(w for _, w, _ in rows if w == want) / total, abs=0.004)
    again = X.sample_by_weight(df.repartition(7), "w", ["k"], n=20000, seed=3).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))


def test_sample_by_weight_edges(spark):
    df = spark.createDataFrame([(1, 0.0), (2, None)], "k int, w double")
    none = X.sample_by_weight(df, "w", ["k"])
    assert none.columns == ["draw", "k", "w"] and none.count() == 0
    assert X.sample_by_weight(df.filter("false"), "w", ["k"]).count() == 0
    one = spark.createDataFrame([(1, 0.0), (2, 5.0)], "k int, w double")
    assert {r.k for r in X.sample_by_weight(one, "w", ["k"], n=50).collect()} == {2}
    for bad in (-1.0, float("nan"), float("inf")):
        with pytest.raises(Exception):
            X.sample_by_weight(spark.createDataFrame([(1, bad)], "k int, w double"), "w", ["k"]).collect()


TABLE = [("A", "A", 1.0), ("A", "C", -2.0), ("C", "C", 3.0), ("W", "A", 0.5)]


def whole_matrix(s):
    at = {}
    for a, b, v in TABLE:
        at[a, b] = v
    from seqforge.functions.alphabet import RESIDUES
    return np.array([[at.get((c, d), 0.0) for d in RESIDUES] for c in s or ""], np.float32).reshape(-1, 20)


def embedded(spark):
    t = spark.createDataFrame(TABLE, "aa1 string, aa2 string, score double")
    rows = [(1, "ACW" * 7), (1, "ACW" * 7), (1, "C"), (2, ""), (None, None), (3, "Ünï-A*"), (4, "AC" * 5000)]
    return rows, spark.createDataFrame(rows, "doc_id long, sequence string").withColumn("maxima", F.lit("x")), t


def test_embed_pooled(spark):
    rows, df, t = embedded(spark)
    got = E.embed_pooled(df, "sequence", "substitution", 5, t)
    assert got.columns == ["doc_id", "n_rows", "sums", "maxima"]
    found = sorted(((r.doc_id, r.n_rows, list(r.sums), r.maxima) for r in got.collect()), key=repr)
    want = []
    for k, s in rows:
        m = whole_matrix(s)
        want.append((k, len(m), m.sum(axis=0, dtype=np.float64).tolist(), m.max(axis=0).tolist() if len(m) else None))
    assert found == sorted(want, key=repr)


def test_embed_windows(spark):
    rows, df, t = embedded(spark)
    got = E.embed_windows(df, "sequence", ["doc_id"], "substitution", 5, t).collect()
    assert max(len(r.matrix) for r in got) == 5
    assert sorted((r.doc_id, r.window) for r in got if r.doc_id == 1) == sorted([(1, w) for w in range(5)] * 2 + [(1, 0)])
    four = np.concatenate([r.matrix for r in sorted((r for r in got if r.doc_id == 4), key=lambda r: r.window)])
    assert (four == whole_matrix("AC" * 5000)).all()


def test_embedding_store(spark, tmp_path):
    rows, df, t = embedded(spark)
    path, calls = f"{tmp_path}/store", []

    def fn(u):
        calls.append(sorted(r.sequence for r in u.collect()))
        return E.embed_windows(u, "sequence", ["key"], "substitution", 5, t)

    def files():
        return sorted(str(p) for p in (tmp_path / "store").rglob("*.parquet"))
    first = S.embedding_store(df.filter("doc_id = 1"), path, "sequence", "substitution", fn, 20)
    assert first.count() == 3 and calls == [["ACW" * 7, "C"]]
    whole = S.embedding_store(df, path, "sequence", "substitution", fn, 20).collect()
    assert len(calls) == 2 and not set(calls[0]) & set(calls[1])
    for r in whole:
        if r.sequence is not None:
            m = whole_matrix(r.sequence)
            assert r.n_rows == len(m) and r.sums == m.sum(axis=0, dtype=np.float64).tolist()
        else:
            assert r.key is None and r.n_rows is None
    before = files()
    again = S.embedding_store(df, path, "sequence", "substitution", fn, 20)
    assert len(calls) == 2 and files() == before  # nothing missing: nothing embedded, nothing written
    scans = again._jdf.queryExecution().executedPlan().toString()
    assert "matrices" not in scans  # pooled states come from the index
    # a lost write (matrices without index rows) and a second writer of the same keys
    other = S.embedding_store(df.filter("doc_id = 4"), f"{tmp_path}/other", "sequence", "substitution", fn, 20)
    spark.read.parquet(f"{tmp_path}/other/matrices").write.mode("append").partitionBy("backend", "prefix").parquet(f"{path}/matrices")
    assert other.count() == 1
    m = S.read_matrices(again.filter("doc_id = 4"), path, "substitution")
    assert m.count() == 2000 and m.select("window").distinct().count() == 2000
    assert S.read_matrices(again, path, "other").count() == 0


def test_mask_report(spark):
    from seqforge.operators import masking as M
    rows = [("a", "HEC", [True, True, False, True]), ("a", "HHHHH", [False, True]), ("b", "", [True]), ("b", None, [True]),
            ("b", "CC", None), ("b", "Cx", [None, True, True])]
    df = spark.createDataFrame(rows, "g string, ss string, mask array<boolean>")
    for offset in (0, 1):
        want = {}
        for g, ss, mask in rows:
            for i, tag in enumerate((ss or "")[:len(mask or [])]):
                t = want.setdefault((g, tag), [0, 0])
                t[0] += 1
                t[1] += i + offset < len(mask) and mask[i + offset] is True
        got = {(r.g, r.tag): [r.total, r.masked] for r in M.mask_report(df, "ss", "mask", ["g"], offset).collect()}
        assert got == want


def test_letter_scores_are_bounded(spark):
    table = spark.createDataFrame([("A", "A", 1.0), ("A", "A", 4.0), ("?", "A", 9.0), ("A", "long", 9.0)], "aa1 string, aa2 string, score double")
    df = spark.createDataFrame([("A A", "AA")], "pred string, label string")
    row = G.string_identity(df, table).first()
    assert (row.matches, row.total, row.mean_substitution) == (2, 2, 4.0)
