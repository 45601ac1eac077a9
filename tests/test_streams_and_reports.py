"""Streams against the batch form (restart, replayed batch, rows out of order),
reports taken in the writing pass, fold overwrite, the hash tree, SQL names."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from seqforge.functions import register as U
from seqforge.functions import scalar
from seqforge.operators import clean as P
from seqforge.operators import corpus as C
from seqforge.operators import metrics as G
from seqforge.operators import relate as J
from seqforge.sources import files as S
from seqforge.streaming import ingest as I
from seqforge.streaming import reset_meter as R


def fasta(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join(f">{i} d\n{s}\n" for i, s in rows))


def batch_windows(spark, path):
    kept = P.clean_with_rejects(S.read_fasta(spark, path), ["sequence"], 40)[0]
    return sorted((r.seq_id, r.k, r.start, r.window) for r in C.sequence_windows(kept, 8).collect())


def test_ingest_restart_and_replay(spark, tmp_path):
    out, ckpt, src = f"{tmp_path}/out", f"{tmp_path}/ckpt", tmp_path / "in"
    for f in range(3):
        fasta(src / f"a{f}.fa", [(f"s{f}{i}", "ACDEFGHIK" * (i + 1)) for i in range(6)] + [(f"x{f}", "ACB"), (f"e{f}", "AC D")])

    def go():
        I.ingest(I.fasta_stream(spark, str(src), 1), out, ckpt, ["sequence"], 40, 8)

    def got():
        return sorted((r.seq_id, r.k, r.start, r.window) for r in I.read_windows(spark, out).collect())
    go()
    assert got() == batch_windows(spark, str(src)) and got()
    first = got()
    go()  # nothing new
    assert got() == first
    fasta(src / "b.fa", [("late", "ACDEF" * 5)])
    go()
    assert got() == batch_windows(spark, str(src)) != first
    # a batch that runs again replaces its folder
    again = S.read_fasta(spark, str(src / "b.fa"))
    last = max(r.batch_id for r in I.read_counts(spark, out).collect())
    I.sink(out, ["sequence"], 40, 8)(again, last)
    assert got() == batch_windows(spark, str(src))
    # rows of a batch without its commit row are not read
    I.cleaned_windows(again, ["sequence"], 40, 8).write.partitionBy("outcome").parquet(f"{out}/rows/batch_id={last + 1}")
    assert got() == batch_windows(spark, str(src))
    counts = I.read_counts(spark, out).agg(*[F.sum(c) for c in ("rows", "kept", "invalid", "too_long")]).first()
    want = {r.outcome: r.n for r in P.clean_with_rejects(S.read_fasta(spark, str(src)), ["sequence"], 40)[2].collect()}
    assert tuple(counts) == (sum(want.values()), want["kept"], want["invalid"], want["too_long"])
    rejected = {r.seq_id for r in I.read_windows(spark, out, "invalid").collect()}
    assert rejected == {"x0", "x1", "x2"}


def test_assay_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.csv").write_text("antigen,TCR\nACD,EFG\nNA,\nAXD,EFG\n")
    stream = I.assay_stream(spark, f"{tmp_path}/in", ["antigen", "TCR"])
    I.ingest(stream, f"{tmp_path}/out", f"{tmp_path}/ckpt", ["antigen", "TCR"], 34, 2)
    kept = [(r.antigen, r.TCR, r.window) for r in I.read_windows(spark, f"{tmp_path}/out").collect()]
    assert sorted(kept) == [("ACD", "EFG", "AC"), ("ACD", "EFG", "CD")]


def test_reset_meter_stream(spark, tmp_path):
    r, t0 = random.Random(5), dt.datetime(2024, 1, 1)
    rows = [(r.choice("ab"), i, t0 + dt.timedelta(minutes=i), float(r.randint(0, 9)) / 4, r.random() < 0.1) for i in range(300)]
    schema = "k string, step long, ts timestamp, v double, reset boolean"
    cols = dict(key="k", step="step", ts="ts", value="v", reset="reset")
    out = None
    for part in range(3):
        mine = rows[part * 100:part * 100 + 100]
        mine = [x for b in range(0, 100, 20) for x in r.sample(mine[b:b + 20], 20)]  # out of order within the delay
        spark.createDataFrame(mine, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        source = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        out = R.run_reset_meter(spark, source, f"{tmp_path}/out", f"{tmp_path}/ckpt", **cols)
    got = sorted(tuple(x) for x in out.collect())
    want = sorted(tuple(x) for x in R.reset_meter(spark.createDataFrame(rows, schema), **cols).collect())
    passed = [x for x in want if x[2] < rows[-1][2] - dt.timedelta(hours=1)]
    assert [x for x in got if x[2] < rows[-1][2] - dt.timedelta(hours=1)] == passed and len(passed) > 200
    total, n = {}, {}
    for k, step, _, v, reset in rows:  # the plain loop
        if reset:
            total[k], n[k] = 0, 0
        total[k], n[k] = total.get(k, 0) + v, n.get(k, 0) + 1
    last = {k: max((x for x in want if x[0] == k), key=lambda x: x[1]) for k in total}
    assert {k: (x[3], x[4]) for k, x in last.items()} == {k: (total[k], n[k]) for k in total}


def test_reports_in_the_writing_pass(spark, tmp_path):
    df = spark.createDataFrame([("ACD",), (" acd",), ("AC1",), ("A" * 50,), (None,)], "s string")
    tagged, seen = P.observe_rejects(P.tag_rejects(df, ["s"]))
    tagged.write.parquet(f"{tmp_path}/clean")
    assert seen.get == {"rows": 5, "kept": 1, "invalid": 3, "too_long": 1}
    pairs = spark.createDataFrame([("a", "x", 2), ("A ", "x", 1), ("b", " ", 3), ("b", "y", 4)], "antigen string, tcr string, n int")
    out, before, after = J.observed_dedupe(pairs, ["antigen", "tcr"], "n")
    out.write.parquet(f"{tmp_path}/pairs")
    assert before.get == {"rows": 4, "blank_keys": 1} and after.get == {"rows": 3}
    a = spark.createDataFrame([(1, "AC"), (2, "A"), (3, "A")], "id int, t string")
    z, flags = J.zip_report(J.zip_by_position(a, a.withColumn("id", F.when(F.col("id") != 2, F.col("id"))).withColumn(
        "t", F.when(F.col("id") == 3, "AAA").otherwise(F.col("t"))).withColumn("o", F.col("t")), "id", "o"), text_a="a_t", text_b="b_t")
    z.write.parquet(f"{tmp_path}/zip")
    assert flags.get["pairs"] == 3 and flags.get["id_mismatch"] == z.filter("id_mismatch").count() > 0


def test_one_fold_at_a_time(spark, tmp_path):
    df = spark.createDataFrame([(i, i % 3) for i in range(9)], "x int, fold int")
    for write, path, fmt in ((S.write_splits, f"{tmp_path}/s", "parquet"), (S.write_predictions, f"{tmp_path}/p", "csv")):
        write(df, path, fmt=fmt)
        before = {p.name for p in (tmp_path / path[-1] / "fold=0").iterdir()}
        write(df.filter("fold = 1").withColumn("x", F.col("x") + 100), path, fmt=fmt, replace="folds")
        got = spark.read.format(fmt).option("header", True).load(path).selectExpr("cast(x as int) x", "cast(fold as int) fold")
        assert sorted(tuple(r) for r in got.collect()) == sorted((i + 100 if i % 3 == 1 else i, i % 3) for i in range(9))
        assert {p.name for p in (tmp_path / path[-1] / "fold=0").iterdir()} == before
    S.write_splits(df.filter("fold = 2"), f"{tmp_path}/s")
    assert spark.read.parquet(f"{tmp_path}/s").select("fold").distinct().count() == 1


def test_fingerprints(spark):
    rows = [(i, f"t{i}") for i in range(300)]

    def tree(rows, parts=3):
        t = G.fingerprint_tree(spark.createDataFrame(rows, "i int, t string").repartition(parts), ["i"], ["i", "t"], fanout=8)
        return t

    def top(rows, parts=3):
        return tree(rows, parts).orderBy(F.desc("level")).first()["hash"]
    assert top(rows) == top(list(reversed(rows)), 7)
    swapped = [(i, "t11" if i == 10 else "t10" if i == 11 else t) for i, t in rows]
    assert top(swapped) != top(rows)
    changed = G.changed_ranges(tree(rows), tree(swapped)).collect()
    assert [tuple(r) for r in changed] == [(8, 8, 8)]
    assert top(rows[:2] + [(2, None)]) != top(rows[:2] + [(2, "")])
    assert tree([]).count() == 0 and tree(rows[:1]).count() == 1

    def flat(rows):
        return G.dataset_fingerprint(spark.createDataFrame(rows, "i int, t string"), ["i", "t"]).first()["fingerprint"]
    assert flat([(1, None)]) != flat([(1, "")]) and flat([(1, "a"), (2, "b")]) == flat([(2, "b"), (1, "a")])
    assert flat([(1, "-")]) != flat([(1, None)])


def test_sql_names(spark):
    U.register_functions(spark)
    vocab = spark.createDataFrame([("AC", 1.5), ("CDE", 0.7), ("EF", -0.2)], "token string, freq_z double")
    df = spark.createDataFrame([(1, "ACDEFACDEFGH"), (2, "A"), (3, ""), (4, None)], "id int, s string")
    df.createOrReplaceTempView("sql_seqs")
    for name, form in (("fmfm", C.tokenize_fmfm), ("fmfcm", C.tokenize_fmfcm)):
        fn = U.register_tokenizer(spark, name, vocab)
        got = spark.sql(f"SELECT id, w.k, w.start, {fn}(w.window) AS tokens FROM sql_seqs, LATERAL sf_windows(s, 4) AS w").collect()
        windows = C.sequence_windows(df, 4, "s")
        want = form(windows, "window", ["id", "k", "start"], vocab).collect()
        assert sorted((r.id, r.k, r.start, r.tokens) for r in got) == sorted((r.id, r.k, r.start, r.tokens) for r in want)
    U.register_tokenizer(spark, "common")
    assert spark.sql("SELECT sf_tokenize_common('AB') AS t").first().t == ["A", "B"]
    for bad in (("other", vocab), ("fmfm", None)):
        with pytest.raises(ValueError):
            U.register_tokenizer(spark, *bad)
    odd = spark.createDataFrame([(" \t a b\r\n\f\x0b",), (" x",), ("",), (None,)], "s string")
    assert [r[0] for r in odd.select(scalar.strip("s")).collect()] == ["a b", " x", "", None]
    odd.createOrReplaceTempView("sql_odd")
    by_name = [r[0] for r in spark.sql("SELECT sf_normalize_peptide(s) FROM sql_odd").collect()]
    assert by_name == [r[0] for r in odd.select(scalar.normalize_peptide("s")).collect()]
