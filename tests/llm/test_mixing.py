"""Raking, caps and the token budget against plain loops over the cells."""

import math
import random

import pytest
from pyspark.sql import functions as F

from seqforge.llm import common, mixing
from tests.conftest import SF

DIMS = ["source", "lang"]


def plain_rake(cells, dims, targets, rounds=4000):
    """{cell: weight}: each dimension's sums scaled to its targets in turn."""
    total = sum(cells.values())
    w = {c: t / total for c, t in cells.items()}
    for _ in range(rounds):
        for k, d in enumerate(dims):
            sums = {}
            for c, x in w.items():
                sums[c[k]] = sums.get(c[k], 0.0) + x
            w = {c: x * targets[d].get(c[k], 0.0) / sums[c[k]] if sums[c[k]] else 0.0 for c, x in w.items()}
    return w


def frame(spark, cells, targets):
    rows = [(*c, t, *[targets[d].get(c[k], 0.0) for k, d in enumerate(DIMS)]) for c, t in cells.items()]
    return spark.createDataFrame(rows, "source string, lang string, tokens long, target_source double, target_lang double")


def test_weights_are_those_of_plain_raking(spark):
    r, filled = random.Random(7), 0.5
    cells = {(f"s{i}", f"l{j}"): r.randint(1, 5000) for i in range(5) for j in range(5) if i == j or j == (i + 1) % 5 or r.random() < filled}
    # targets that some weighting of the cells meets
    meant = {c: t * r.uniform(0.2, 3) for c, t in cells.items()}
    all_ = sum(meant.values())
    targets = {d: {v: sum(x for c, x in meant.items() if c[k] == v) / all_ for v in {c[k] for c in cells}} for k, d in enumerate(DIMS)}
    got = mixing.rake(frame(spark, cells, targets), DIMS).collect()
    want = plain_rake(cells, DIMS, targets)
    assert {(x.source, x.lang): x.weight for x in got} == pytest.approx(want, abs=1e-5)
    assert all(x.deviation <= mixing.TOLERANCE for x in got)


def test_contradicting_targets_end_and_are_reported(spark, caplog):
    """Each source has one language, so both shares cannot be met."""
    cells = {("a", "x"): 10, ("b", "y"): 10, ("c", "y"): 0}
    targets = {"source": {"a": 0.9, "b": 0.05, "c": 0.05}, "lang": {"x": 0.2, "y": 0.8}}
    got = {x.source: x for x in mixing.rake(frame(spark, cells, targets), DIMS).collect()}
    assert got["c"].weight == 0 and got["a"].deviation > 0.1 and "misses a target" in caplog.text


def test_targets_are_made_reachable(spark):
    """A value gives at most the cap times its share; the others take its rest."""
    cells = {("a", "x"): 100, ("b", "x"): 600, ("c", "x"): 300}
    targets = {"source": {"a": 0.5, "b": 0.2, "c": 0.3}, "lang": {"x": 1.0}}
    got = {x.source: x for x in mixing.rake(frame(spark, cells, targets), DIMS, cap=2.0).collect()}
    assert {k: x.weight for k, x in got.items()} == pytest.approx({"a": 0.2, "b": 0.8 * 0.4, "c": 0.8 * 0.6})
    assert got["a"].ratio == pytest.approx(2) and got["a"].deviation < mixing.TOLERANCE


def test_scale_is_that_of_bisection(spark):
    r = random.Random(3)
    rows = [(r.random(), r.random() * 4) for _ in range(50)]
    total = sum(a for a, _ in rows)
    rows = [(a / total, b) for a, b in rows] + [(0.1, 0.0)]
    low, high = 0.0, 100.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(a * min(1.5, b * mid) for a, b in rows) < 1 else (low, mid)
    df = spark.createDataFrame(rows, "size double, ratio double")
    assert mixing.calibrate(df, "size", "ratio", 1.5) == pytest.approx(low)
    assert sum(a * min(1.5, b * low) for a, b in rows) == pytest.approx(1)
    assert mixing.calibrate(df.filter("false"), "size", "ratio", 1.5) == 0


@pytest.mark.parametrize("budget", [0.5])
def test_documents_meet_targets_and_budget(spark, budget):
    docs = common.table(spark, SF, "documents")
    cells = common.stored(mixing.cell_probabilities(docs, budget=budget), "test-cells")
    rows = cells.collect()
    total = sum(x.tokens for x in rows)
    assert sum(x.tokens * x.probability for x in rows) == pytest.approx(budget * total)
    assert all(0 <= x.probability <= 1 for x in rows)
    off = max(x.deviation for x in rows)
    for x in mixing.mix_report(cells).collect():
        most = x.share / budget
        if x.target < most * 0.8 and off < mixing.TOLERANCE:
            assert x.kept_share >= x.target - 1e-4, x
        assert x.kept_share <= most + 1e-9
    kept = mixing.mix(docs, budget=budget)
    chance = {(x.source, x.lang, x.topic): x.probability for x in rows}
    for x in kept.collect():
        assert x.probability == pytest.approx(chance[x.source, x.lang, x.topic], abs=1e-6)
    assert kept.agg(F.sum("n_tokens")).first()[0] == pytest.approx(budget * total, rel=0.15)


def test_odd_columns_and_tables(spark):
    rows = [(1, "a b c", "s", "en"), (1, "a b c", "s", "en"), (2, None, None, "en"), (None, "d e", "s", None), (3, "", "t", "de"), (4, "w " * 5000, "u", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").select(
        "*", F.lit("x").alias("Probability"), F.lit(1).alias("n_tokens"), F.lit(2).alias("MIX_WEIGHT"))
    out = mixing.mix(docs, budget=1.0)
    assert out.columns == ["doc_id", "text", "source", "lang", "topic", "n_tokens", "probability", "mix_weight"]
    got = out.collect()
    assert sorted(str(x.doc_id) for x in got) == ["1", "1", "4", "None"] and all(x.probability == pytest.approx(1) for x in got)
    assert mixing.mix(docs, budget=0.0).collect() == [] and mixing.mix(docs.filter("false")).collect() == []
    assert mixing.mix(docs.filter("doc_id in (2, 3)")).collect() == []
    own = docs.withColumn("topic", F.lit("mine"))
    assert {x.topic for x in mixing.mix(own, budget=1.0).collect()} == {"mine"}
    half = {"source": spark.createDataFrame([("s", 1.0), ("nowhere", 3.0)], "source string, target_source double")}
    assert {x.source for x in mixing.mix(docs, half, budget=0.9).collect()} <= {"s"}
    assert math.isfinite(mixing.cell_probabilities(docs, half).agg(F.max("deviation")).first()[0])
