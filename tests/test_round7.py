"""What the findings of round 4 asked for."""

from decimal import Decimal

import numpy as np
import pytest

from seqforge.operators import metrics as G


def plain_ordered(rows):
    """{group: (pairs, index)} of (group, o, y, p) by every pair."""
    out = {}
    for g in {r[0] for r in rows}:
        of = [r[1:] for r in rows if r[0] == g and None not in r[1:]]
        n = s = 0
        for o, y, p in of:
            for o2, y2, p2 in of:
                if o2 < o and y2 < y:
                    n += 1
                    s += 2 if p2 < p else p2 == p
        if of:
            out[g] = n, round(s / 2 / n, 9) if n else 0.0
    return out


def test_concordant():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 3, 8, 9, 100, 257):
        for most in (1, 3, n + 1, 10 * n + 1):
            v = rng.integers(0, most, n)
            assert G.concordant(v) == sum(int((v[:i] < v[i]).sum()) for i in range(n))
            assert G.concordant(v / 7) == G.concordant(v)


@pytest.mark.parametrize("blocks", [1, 5, 60])
def test_ordered_concordance_in_two_dimensions(spark, monkeypatch, blocks):
    """Ranges of a few rows, values of each column that fill several ranges, equal rows, nulls; no row becomes several."""
    monkeypatch.setattr(G, "BLOCK_ROWS", 3)
    monkeypatch.setattr(G, "BLOCKS", blocks)
    rng = np.random.default_rng(5)
    rows = [(g, *(int(x) for x in r)) for g, most in (("a", (3, 3, 3)), ("b", (70, 2, 40)), ("c", (70, 40, 2)), ("d", (2, 50, 50)))
            for r in rng.integers(0, most, (120, 3))]
    rows += [("hot", i, i % 5, 1) for i in range(60)] + [("same", 1, 1, 1)] * 9 + [("one", 1, 1, 1), (None, 1, 1, 1), (None, 2, 2, 2)]
    rows += [("a", None, 1, 1), ("a", 1, None, 1), ("a", 1, 1, None), ("none", 1, 1, None)]
    got = G.c_index_ordered(spark.createDataFrame(rows, "g string, o long, y double, p double"
                                                  .replace("double", "long")).selectExpr("g", "o", "cast(y as double) y", "cast(p as double) p"), ["g"], "o")
    assert {r.g: (r.n_pairs, round(r.c_index, 9)) for r in got.collect()} == plain_ordered(rows)
    assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_ordered_concordance_of_other_types(spark, monkeypatch):
    monkeypatch.setattr(G, "BLOCK_ROWS", 3)
    rng = np.random.default_rng(6)
    rows = [(1, int(o), int(y), int(p)) for o, y, p in rng.integers(0, 12, (80, 3))]
    df = spark.createDataFrame([(g, f"{o:03d}", Decimal(y) / 4, float("nan") if p == 11 else float(p)) for g, o, y, p in rows],
                               "g int, o string, y decimal(9,2), p double")
    r = G.c_index_ordered(df, ["g"], "o").first()
    assert (r.n_pairs, round(r.c_index, 9)) == plain_ordered(rows)[1]
    r = G.c_index_ordered(df.selectExpr("date_add(date'2020-01-01', cast(o as int)) o", "y", "p", "g"), [], "o").first()
    assert (r.n_pairs, round(r.c_index, 9)) == plain_ordered(rows)[1]


def test_matrices_are_packed_whole():
    import pyarrow as pa
    from seqforge.sources import files as S
    for rows in ([[[1.0, 2.0], [3.0, 4.0]], [], [[5.5, -0.0]]], [[]], [], [[[1.0], [2.0, 3.0], []], [[4.0]]]):
        col = pa.array(rows, pa.list_(pa.list_(pa.float32())))
        assert S._unpacked(S._packed(col)).to_pylist() == rows
        assert S._unpacked(S._packed(col.slice(1))).to_pylist() == rows[1:]
        assert S._unpacked(S._packed(col).slice(1)).to_pylist() == rows[1:]
        packed = S._packed(col)
        by_dictionary = pa.ListArray.from_arrays(packed.offsets, packed.values.dictionary_encode())
        assert S._unpacked(by_dictionary).to_pylist() == rows and S._unpacked(by_dictionary.slice(1)).to_pylist() == rows[1:]
    with pytest.raises(ValueError):
        S._packed(pa.array([[[None, 1.0]]], pa.list_(pa.list_(pa.float32()))))


def test_store_writes_matrices_where_they_are_made(spark, tmp_path):
    """Rows of floats are values of their own in the files, nothing but states leaves the tasks, and functions of
    matrices are computed where files are read."""
    import pyarrow.parquet as pq
    from pyspark.sql import functions as F
    from seqforge.operators import vectors as E
    from seqforge.sources import files as S
    t = spark.createDataFrame([(a, b, (i * 7 + j * 3) % 19) for i, a in enumerate("ACDE") for j, b in enumerate("ACDE")], "aa1 string, aa2 string, score int")
    df = spark.createDataFrame([(i, "ACDE" * (300 * (i % 7)) + "A" * i + "é") for i in range(60)] + [(60, None), (61, ""), (62, "ACDE")], "id long, s string")
    plans = []

    def fn(u, then=None):
        out = E.embed_windows(u, "s", ["key"], "substitution", 100, t, states=True, then=then)
        plans.append((out.columns, out._jdf.queryExecution().executedPlan().toString().count("MapInArrow")))
        return out

    def plain(u):
        return E.embed_windows(u, "s", ["key"], "substitution", 100, t)
    stores = []
    for name, f in (("one", fn), ("two", plain)):
        path = f"{tmp_path}/{name}"
        S.embedding_store(df.filter("id < 20"), path, "s", "substitution", f, 20, digits=1)
        out = S.embedding_store(df, path, "s", "substitution", f, 20, digits=1)
        files = [p for p in (tmp_path / name / "matrices").rglob("*") if p.is_file() and p.suffix != ".crc"]
        assert files and all(p.name.startswith("part-") for p in files)
        for p in files:
            assert str(pq.read_schema(p).field("matrix").type.value_type) == "binary"
        m = S.read_matrices(out, path, "substitution", 1)
        n = S.read_matrices(out, path, "substitution", 1, {"n": F.col("n_rows"), "t": lambda x: float(x.sum(dtype="float64")), "k": F.size("matrix")})
        whole = {(r.key, r.window): (r.n_rows, sum(map(sum, r.matrix)), len(r.matrix)) for r in m.collect()}
        assert {(r.key, r.window): (r.n, r.t, r.k) for r in n.collect()} == whole and m.count() == len(whole)
        stores.append((whole, sorted((r.id, r.key or "", r.n_rows, r.sums, r.maxima) for r in out.collect())))
        totals = {}
        for (key, _), (_, x, _) in whole.items():
            totals[key] = totals.get(key, 0.0) + x
        assert totals == {r.key: sum(r.sums) for r in out.collect() if r.key}
        assert sum(k for _, _, k in whole.values()) == sum({r.key: r.n_rows for r in out.collect() if r.key}.values())
    assert stores[0] == stores[1] and len(plans) == 2 and all(p == (["key", "n_rows", "sums", "maxima"], 1) for p in plans)
