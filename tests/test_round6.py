"""Plans of queries at size."""
from seqforge.plans.catalog import REGISTRY

SF = "/root/testdata/sf0.001"


def test_masked_topn_reads_the_texts_once(spark):
    """no pass per side of the matrix and no row per pair of letters."""
    plan = REGISTRY["g11_masked_topn"].build(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert sum("FileScan" in line and "text#" in line for line in plan.split("\n")) == 1
    assert plan.count("MapInArrow") == 1 and plan.count("Generate ") == 1  # the two letters of a pair


def test_suffix_dedup_at_400_bytes(spark):
    """op9: passages of over 50 words stay below 400 bytes and go from there on, in all documents that have them."""
    import random

    from seqforge.llm import suffix_dedup
    rng = random.Random(4)

    def text(n):  # words of 5 letters, n bytes
        return "".join(" " if i % 6 == 5 else rng.choice("abcdefghijklmnopqrstuvwxyz") for i in range(n))

    less, just, own, more = text(399), text(400), text(400), text(700)
    docs = [(1, text(301) + "1" + less + "1" + text(99)), (2, "2" + less + "2"), (3, "3" + just + "3" + text(99)), (4, text(150) + "4" + just),
            (5, own + "5" + own + "é"), (6, text(2000)), (7, more), (8, more), (9, None)]
    assert len(less.split()) > 50
    want = {i: (len((t or "").encode()), n, k) for (i, t), (n, k) in zip(docs, [(0, 0), (0, 0), (400, 1), (400, 1), (800, 2), (0, 0), (700, 1), (700, 1), (0, 0)])}
    got = suffix_dedup.digest(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in got} == want and len(got) == len(want)
