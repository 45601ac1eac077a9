"""Hostile, odd and empty inputs of the operators that have no SQL."""

import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqforge.llm import classifier, html_text

HOSTILE = {
    "wide cell": "<table>" + "<tr><td>a<td>b" * 2000 + "<tr><td>" + "w" * 40000 + "<td>b</table>",
    "nested lists": "<ul><li>x" * 4000,
    "nested blocks": "<div>x" * 60000,
    "nested marks": "<i>x" * 60000,
    "open paragraphs": "<p>a<div>" * 30000 + "<li>x" * 30000,
    "nested tables": "<table><tr><td>x<td>y" * 5000,
    "nested selects": "<select><option>x" * 20000,
    "one high cell": "<table><tr>" + "<td>a" * 3000 + "<td>" + "x<br>" * 3000 + "</table>",
    "wide spans": "<table><tr>" + f"<td>{'v' * 70}" * 900 + "<tr><td colspan=1000>z<td>y" * 3000,
    "quotes with ends": '<a ">"x' * 60000,
    "ends of nothing": "<b>" * 30000 + "</i>" * 30000,
}


@pytest.mark.parametrize("name", HOSTILE)
def test_op8_time_and_text_grow_with_the_page(name):
    html = HOSTILE[name]
    begin = time.process_time()
    text, _ = html_text.extract(html)
    assert time.process_time() - begin < 5
    assert len(text) < 25 * len(html)


def test_op8_bounds_drop_no_text():
    wide = html_text.extract("<table><tr><td>a<td>b<tr><td>" + "w" * 500 + "<td>c</table>")[0]
    assert wide == "a | b\n" + "w" * 500 + " | c"
    lists = html_text.extract("".join(f"<ul><li>w{k}" for k in range(200)))[0].split("\n")
    assert [x.strip(" -") for x in lists] == [f"w{k}" for k in range(200)]
    assert max(len(x) - len(x.lstrip()) for x in lists) == 2 * html_text.INDENT
    tables, cells = html_text.extract("".join(f"<table><tr><td>l{k}<td>r{k}" for k in range(60)))
    assert sorted(w for w in tables.split() if w != "|") == sorted(f"{s}{k}" for s in "lr" for k in range(60)) and cells == 120
    high = html_text.extract("<table><tr>" + "<td>a" * 300 + "<td>" + "".join(f"x{k}<br>" for k in range(300)) + "</table>")[0]
    assert sorted(high.replace("|", " ").split()) == sorted(["a"] * 300 + [f"x{k}" for k in range(300)])
    assert html_text.extract("<select><option>a<option selected>b<select>c")[0] == "b c"


def test_op8_rows(spark):
    rows = [(1, "<p>a</p>"), (1, "<p>a</p>"), (None, "<p>b"), (2, None), (3, ""), (4, "<div>" * 3000 + "deep"), (5, "a " * 200000)]
    pages = spark.createDataFrame(rows, "page_id long, html string").select("*", F.lit(7).alias("Text"), F.lit(8).alias("n_cells"), F.lit("k").alias("kept"))
    out = html_text.extract_html(pages)
    assert out.columns == ["page_id", "kept", "text", "n_cells"]
    got = sorted(((r.page_id, r.text) for r in out.collect()), key=repr)
    assert got == sorted([(1, "a"), (1, "a"), (None, "b"), (2, ""), (3, ""), (4, "deep"), (5, ("a " * 200000).strip())], key=repr)
    assert html_text.extract_html(pages.filter("false")).collect() == []


def test_op10_updates_are_those_of_plain_ftrl():
    """One pass over 50 texts against the update rule written out slot by slot."""
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "buy", "now!", "Zeta9"], rng.integers(0, 30))) for _ in range(50)]
    labels = [int(k % 3 == 0) for k in range(50)]
    import pyarrow as pa
    slot, value, first = features = classifier.sparse(pa.array(texts))
    z, n = np.zeros(classifier.SIZE), np.zeros(classifier.SIZE)
    classifier.learn(z, n, features, labels)
    zz, nn = {}, {}

    def weight(i):
        s, q = zz.get(i, 0.0), nn.get(i, 0.0)
        if abs(s) <= classifier.L1:
            return 0.0
        return -(s - math.copysign(classifier.L1, s)) / ((classifier.BETA + math.sqrt(q)) / classifier.ALPHA + classifier.L2)

    for d, y in enumerate(labels):
        own = [(int(slot[k]), float(value[k])) for k in range(first[d], first[d + 1])]
        assert len({i for i, _ in own}) == len(own)
        w = {i: weight(i) for i, _ in own}
        p = 1 / (1 + math.exp(-sum(w[i] * x for i, x in own)))
        for i, x in own:
            g = (p - y) * x
            zz[i] = zz.get(i, 0.0) + g - (math.sqrt(nn.get(i, 0.0) + g * g) - math.sqrt(nn.get(i, 0.0))) / classifier.ALPHA * w[i]
            nn[i] = nn.get(i, 0.0) + g * g
    assert {i: z[i] for i in np.flatnonzero(n)} == pytest.approx({i: zz[i] for i in np.flatnonzero(n)})
    assert {int(i): n[i] for i in np.flatnonzero(n)} == pytest.approx({i: q for i, q in nn.items() if q})
    got = classifier.weights(z, n)
    assert [got[i] for i in zz] == pytest.approx([weight(i) for i in zz])


def test_pipeline_on_odd_and_no_rows(spark, tmp_path):
    """Null ids and texts, repeated rows and an empty table pass through all stages."""
    import corpus_pipeline
    from seqforge.llm import common
    from tests.conftest import SF
    docs = common.table(spark, SF, "documents")
    odd = docs.limit(60).unionByName(docs.limit(20)).unionByName(docs.limit(3).withColumn("doc_id", F.lit(None).cast("long"))) \
        .unionByName(docs.limit(2).withColumn("text", F.lit(None).cast("string"))).unionByName(docs.limit(2).withColumn("lang", F.lit(None).cast("string")))
    for name, rows in (("odd", odd), ("none", docs.filter("false"))):
        sf = str(tmp_path / name)
        rows.write.parquet(f"{sf}/documents.parquet")
        common.table(spark, SF, "benchmark").write.parquet(f"{sf}/benchmark.parquet")
        out = corpus_pipeline.run(spark, sf)
        assert set(docs.columns) <= set(out.columns)
        got = out.collect()
        assert (not got) if name == "none" else 0 < len(got) < rows.count()
