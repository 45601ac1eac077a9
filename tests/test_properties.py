"""Property and quirk tests on small hand-written inputs."""

import math

import pytest
from pyspark.sql import functions as F

from seqforge.functions import scalar as S
from seqforge.operators import corpus as T
from seqforge.operators import masking as M
from seqforge.operators import metrics as G
from seqforge.operators import splits as X
from seqforge.sources import files as SRC


def _py_windows(seq, L):
    step = L // 2
    if len(seq) <= L:
        return [seq]
    out = [seq[i:i + L] for i in range(0, len(seq) - L + 1, step)]
    if (len(seq) - L) % step != 0:
        out.append(seq[-L:])
    return out


@pytest.mark.parametrize("n", [1, 7, 8, 9, 12, 13, 31])
def test_windows_cover_and_end_flush(spark, n):
    L = 8
    seq = ("ACDEFGHIKLMNPQRSTVWY" * 3)[:n]
    df = spark.createDataFrame([(1, seq)], "id long, sequence string")
    got = [r.window for r in T.sequence_windows(df, L).orderBy("k").collect()]
    assert got == _py_windows(seq, L)
    assert got[-1] == seq[-min(L, n):]


def test_pad_never_truncates(spark):
    df = spark.createDataFrame([("AC",), ("A" * 40,)], "s string")
    got = [r.p for r in df.select(S.pad_right("s", 34).alias("p")).collect()]
    assert got[0] == "AC" + "-" * 32 and got[1] == "A" * 40


def test_round_up_pow2_exact_at_large_powers(spark):
    df = spark.createDataFrame([(1,), (2,), (3,), (1 << 29,), ((1 << 29) + 1,)], "n long")
    got = [r.w for r in df.select(S.round_up_pow2("n").alias("w")).collect()]
    assert got == [1, 2, 4, 1 << 29, 1 << 30]


def test_allele_rules(spark):
    cases = {"A0201": "HLA-A*02:01", "A*02:01": "HLA-A*02:01", "HLA-B5801": "HLA-B*58:01",
             "HLA-A*02:01:01": "HLA-A*02:01", "DRB1*01:01": "DRB1*01:01", " ": "", "hla-b*58:01": "HLA-B*58:01"}
    df = spark.createDataFrame([(k,) for k in cases], "a string")
    got = {r.a: r.n for r in df.select("a", S.normalize_allele("a").alias("n")).collect()}
    assert got == cases


def test_labels(spark):
    df = spark.createDataFrame([("1",), ("1.0",), ("Unknown",), (" 0 ",), (None,), ("2",)], "l string")
    r = df.select(S.parse_label("l", "digits_else_zero").alias("d"), S.parse_label("l", "strict01").alias("s"),
                  S.parse_label("l", "is_labeled").alias("i"), S.parse_label("l", "gt1").alias("g")).collect()
    assert [x.d for x in r] == [1, 0, 0, 0, 0, 2]
    assert [x.s for x in r] == [1, None, None, 0, None, None]
    assert [x.i for x in r] == [True, True, False, True, False, True]
    assert [x.g for x in r] == [0, 0, 0, 0, 0, 1]


def test_fasta_edge_cases(spark, tmp_path):
    text = ">a1 first record\nACDE\nFGH\n\n>empty\n>a2|1 second\nKL MN\n>a1 again\nPQ\n"
    p = tmp_path / "x.fasta"
    p.write_text(text)
    got = [tuple(r) for r in SRC.read_fasta(spark, str(p)).collect()]
    assert got == [("a1", "a1 first record", "ACDEFGH"), ("a2|1", "a2|1 second", "KLMN"), ("a1", "a1 again", "PQ")]
    assert len(SRC.read_fasta(spark, str(p), keep_empty=True).collect()) == 4
    lab = SRC.read_fasta(spark, str(p)).select(S.label_from_id("seq_id").alias("l")).collect()
    assert [r.l for r in lab] == [-1, 1, -1]


def test_structure_text_chunk_rule(spark, tmp_path):
    b = SRC.BANNER
    text = (f"{b}\n\nPred: CCH\n  AA: ACD\n{b}\n\n  AA: KLM\n{b}\n\nPred: CC HH\n  AA: ACD EFGH\n"
            f"{b}\n\nPred: CCC\n  AA: AC DE\n")
    p = tmp_path / "x.horiz"
    p.write_text(text)
    got = [tuple(r) for r in SRC.read_structure_text(spark, str(p)).orderBy("seq_id").collect()]
    # block 2 has no Pred (dropped); block 3 has equal chunk counts but unequal lengths (kept)
    assert got == [("seq1", "ACD", "CCH"), ("seq2", "ACDEFGH", "CCHH")]


def test_kfold_partitions_exactly(spark):
    df = spark.range(103).select(F.col("id"), (F.col("id") % 3 == 0).cast("int").cast("string").alias("label"))
    f = X.stratified_kfold(df, "label", ["id"], k=5)
    rows = f.collect()
    assert len(rows) == 103 and len({r.id for r in rows}) == 103
    sizes = f.groupBy("label", "fold").count().collect()
    for lab in ("0", "1"):
        c = [r["count"] for r in sizes if r.label == lab]
        assert max(c) - min(c) <= 1


def test_split_fraction_sizes(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    c = {r.split: r["count"] for r in X.split_fraction(df, ["k"]).groupBy("split").count().collect()}
    assert c == {"train": 700, "valid": 150, "test": 150}


def test_structure_mask_exact_counts(spark):
    ss = "CCCCCCCCCCHHHHHHHHHHEEEEEEEEEE"
    ids = list(range(len(ss) + 2))
    df = spark.createDataFrame([(1, ids, ss)], "id long, ids array<int>, ss string")
    m = M.mask_by_structure(df, "ids", "ss", ["id"]).collect()[0]
    pos = m.mask_pos
    assert 0 not in pos and all(p <= len(ss) for p in pos)
    tags = [ss[p - 1] for p in pos]
    assert tags.count("C") == 4 and tags.count("H") == 1 and tags.count("E") == 1


def test_metrics_edge_cases(spark):
    one_class = spark.createDataFrame([(1, 1, 0.2), (1, 1, 0.9)], "fold int, y_true int, y_prob double")
    r = G.curve_metrics(one_class, ["fold"]).collect()[0]
    assert math.isnan(r.roc_auc)
    tied = spark.createDataFrame([(1, 1, 0.5), (1, 0, 0.5)], "fold int, y_true int, y_prob double")
    assert G.curve_metrics(tied, ["fold"]).collect()[0].roc_auc == 0.5
    nopos = spark.createDataFrame([(1, 0, 0), (1, 1, 0)], "fold int, y_true int, y_pred int")
    cm = G.class_metrics(G.confusion(nopos, ["fold"])).collect()[0]
    assert cm.precision == 0.0 and cm.mcc == 0.0


def test_fold_report_single_fold_sd_zero(spark):
    m = spark.createDataFrame([(1, 0.8)], "fold int, auc double")
    rows = {r.fold: r.auc for r in G.fold_report(m, "fold", ["auc"], ddof=1).collect()}
    assert rows == {"1": 0.8, "avg": 0.8, "sd": 0.0}


def test_c_index_matches_brute_force(spark):
    import random
    rnd = random.Random(7)
    rows = [(g, float(rnd.randint(0, 6)), float(rnd.randint(0, 9))) for g in (1, 2) for _ in range(60)]
    rows += [(3, 1.0, 1.0)]  # a group without any pair
    df = spark.createDataFrame(rows, "g int, y double, p double")
    got = {r.g: (r.n_pairs, r.c_index) for r in G.c_index(df, ["g"]).collect()}
    for grp in (1, 2, 3):
        pts = [(y, p) for g, y, p in rows if g == grp]
        num = pairs = 0
        for yi, pi in pts:
            for yj, pj in pts:
                if yi > yj:
                    pairs += 1
                    num += 1.0 if pi > pj else (0.5 if pi == pj else 0.0)
        assert got[grp][0] == pairs
        assert abs(got[grp][1] - (num / pairs if pairs else 0.0)) < 1e-12


VOCAB = {"AC": 1.5, "CD": -1.5, "ACD": 1.5, "CDE": 2.0, "DE": 0.25, "EEE": -0.5}


def _choose(s, i, sizes):
    if i == len(s) - 1:
        return s[i]
    best, total = None, 0.0
    for n in sizes:
        if i + n <= len(s):
            z = VOCAB.get(s[i:i + n], 0.0)
            total += z
            if best is None or z > best[0]:
                best = z, s[i:i + n]
    return best[1] if best and total != 0 else s[i]


def _walk(s, sizes):
    out, i = [], 0
    while i < len(s):
        out.append(_choose(s, i, sizes))
        i += len(out[-1])
    return out


@pytest.mark.parametrize("sizes", [(2, 3), (2,), (3,)])
def test_frequency_tokenizers_match_brute_force(spark, sizes):
    texts = ["ACDEACD", "A", "", "CDE", "ACXDE", "AÄCD", "DEEEEACDE", "AC" * 40]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "id int, s string")
    vocab = spark.createDataFrame(list(VOCAB.items()), "token string, freq_z double")
    got = {r.id: r.tokens for r in T.tokenize_fmfm(df, "s", ["id"], vocab, sizes).collect()}
    over = {r.id: r.tokens for r in T.tokenize_fmfcm(df, "s", ["id"], vocab, sizes).collect()}
    assert got == {**{i: _walk(t, sizes) for i, t in enumerate(texts)}, len(texts): None}
    assert over == {**{i: [_choose(t, j, sizes) for j in range(len(t))] for i, t in enumerate(texts)}, len(texts): None}
    pair = spark.createDataFrame([(1, "ACD-CDE"), (2, "-A")], "id int, s string")
    both = {r.id: r.tokens for r in T.tokenize_pair(pair, "s", ["id"], vocab, sizes=sizes).collect()}
    assert both == {1: _walk("ACD", sizes) + ["-"] + _walk("CDE", sizes), 2: ["-", "A"]}


def test_tokenizers_reject_bad_input(spark):
    vocab = spark.createDataFrame([("AÄ", 1.0)], "token string, freq_z double")
    with pytest.raises(ValueError):
        T.vocab_tables(vocab)
    bad = spark.createDataFrame([(1, "AC-D-E")], "id int, s string")
    good = spark.createDataFrame(list(VOCAB.items()), "token string, freq_z double")
    with pytest.raises(Exception, match="expected one hyphen"):
        T.tokenize_pair(bad, "s", ["id"], good).collect()


def test_build_vocab_counts_every_gram(spark):
    from collections import Counter
    texts = ["ACDAC", "", "A", "ÄCDA", "ACD" * 30, None]
    want = Counter(t[i:i + n] for t in texts if t for n in (1, 2, 4) for i in range(len(t) - n + 1))
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    got = {r.token: r.frequency for r in T.build_vocab(df, "s", (1, 2, 4)).collect()}
    assert got == dict(want)


def test_masking_of_null_empty_and_short_rows(spark):
    rows = [(1, [24, 3, 4, 5, 23], "CCH"), (2, None, "CC"), (3, [], ""), (4, [24, 1], "CCCCCCCCCC"), (5, [24, 1, 23], None)]
    df = spark.createDataFrame(rows, "id long, ids array<int>, ss string")
    m = M.mask_by_structure(df, "ids", "ss", ["id"], rates={"C": 1.0}, carry=True)
    got = {r.id: (r.mask, r.mask_pos) for r in m.collect()}
    assert got[1] == ([False, True, True, False, False], [1, 2])
    assert got[2] == got[5] == (None, None)
    assert got[3] == ([], []) and got[4] == ([False, True], [1])
    c = {r.id: (r.masked_ids, r.labels) for r in M.corrupt(m, "ids", "mask", ["id"]).collect()}
    assert c[2] == c[5] == (None, None) and c[3] == ([], [])
    assert c[1][1] == [-100, 3, 4, -100, -100] and c[4][1] == [-100, 1]
    u = {r.id: r.labels for r in M.mask_uniform(df, "ids", ["id"], p=1.0).collect()}
    assert u[1] == [-100, 3, 4, 5, -100] and u[2] is None and u[3] == []
