"""Cases where an operator once did less than its whole job."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqforge.llm import common, ctw, html_text, quality

TEXTS = ["the cat sat on the mat", "the rat sat on the cat", "a hat", "", "that cat", "on and on and on the mat"] * 3 + ["the hat and the mat", "xyz"]


def brute_tree(texts):
    """{(context, newest byte last, bits so far): [zeros, ones]} and log weighted probabilities."""
    counts = defaultdict(lambda: [0, 0])
    for t in texts:
        s = b"\xff" * ctw.DEPTH + t.lower().encode() + b"\xff"
        for i in range(ctw.DEPTH, len(s)):
            bits = format(s[i], "08b")
            for d in range(ctw.DEPTH + 1):
                for k in range(8):
                    counts[s[i - d:i], bits[:k]][int(bits[k])] += 1
    below = defaultdict(float)
    weighted, stop = {}, {}
    for c, bits in sorted(counts, key=lambda x: -len(x[0])):
        z, o = counts[c, bits]
        own = math.lgamma(z + .5) + math.lgamma(o + .5) - math.lgamma(z + o + 1) - math.log(math.pi)
        a, b = math.log(.5) + own, math.log(.5) + below[c, bits]
        top = max(a, b)
        weighted[c, bits] = own if len(c) == ctw.DEPTH else top + math.log(math.exp(a - top) + math.exp(b - top))
        stop[c, bits] = 1.0 if len(c) == ctw.DEPTH else math.exp(a - weighted[c, bits])
        if c:
            below[c[1:], bits] += weighted[c, bits]
    return counts, stop


def brute_bits(tree, text):
    counts, stop = tree
    s = b"\xff" * ctw.DEPTH + text.lower().encode() + b"\xff"
    total = 0.0
    for i in range(ctw.DEPTH, len(s)):
        bits = format(s[i], "08b")
        for k in range(8):
            one, left, mixed = 0.5, 1.0, 0.0
            for d in range(ctw.DEPTH + 1):
                key = s[i - d:i], bits[:k]
                if key not in counts:
                    break
                z, o = counts[key]
                one = (o + .5) / (z + o + 1)
                mixed += left * stop[key] * one
                left *= 1 - stop[key]
            mixed += left * one
            total -= math.log2(mixed if bits[k] == "1" else 1 - mixed)
    return total


def test_op4_scores_are_those_of_brute_force_context_tree_weighting(spark):
    new = ["the cat in the hat", "zzz", "on the cat sat", None]
    rows = [(i, t, False) for i, t in enumerate(TEXTS)] + [(100 + i, t, True) for i, t in enumerate(new)]
    tree = brute_tree(TEXTS)
    for r in ctw.score(spark.createDataFrame(rows, "doc_id long, text string, h boolean"), F.col("h")).collect():
        text = dict((i, t) for i, t, _ in rows)[r.doc_id] or ""
        assert r.score == pytest.approx(-brute_bits(tree, text) * math.log10(2), rel=1e-4)


def test_op4_weights_do_not_depend_on_what_is_left_out(spark):
    counts, stop = brute_tree(TEXTS)
    model = ctw.train(spark.createDataFrame([(t,) for t in TEXTS], "text string"), max_grams=20)
    whole = sum(len({c for c, _ in counts if len(c) == d}) for d in range(3, ctw.DEPTH + 1))
    context = b"at"
    nodes, _, weights = (np.concatenate(x) for x in zip(*model["levels"][2])) if isinstance(model["levels"][2], list) else model["levels"][2]
    assert sum(len(np.unique((x[0][0] if isinstance(x, list) else x[0]) >> np.uint64(8))) for d, x in model["levels"].items() if d > 2) < whole
    for (c, bits), w in stop.items():
        if c == context:
            node = (c[1] << 16) | (c[0] << 8) | int("1" + bits, 2)
            at = np.flatnonzero(nodes == np.uint64(node))
            assert weights[at[0]] == pytest.approx(w, abs=1e-5)


def test_op4_keeps_every_context_of_a_larger_corpus(spark):
    """A text that training has seen keeps its code length when the corpus has
    over 2^19 other contexts, which share none of its letters."""
    r = random.Random(5)
    seen = "".join(r.choice("0123456789") for _ in range(3000))
    other = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=20000)) for _ in range(60)]
    bits = []
    for rest in (other[:1], other):
        rows = [(0, seen)] + list(enumerate(rest, 1))
        scored = ctw.score(spark.createDataFrame(rows, "doc_id long, text string"), F.lit(False))
        bits.append(scored.filter("doc_id = 0").first().bits_per_byte)
    assert bits[1] == pytest.approx(bits[0], rel=0.02)


@pytest.mark.parametrize("html, text", [
    ("<html><head><title>t</title><body><p>text</p>", "text"), ("<head><meta charset=utf-8><title>t</title><p>a<p>b", "a\n\nb"),
    ("<head><script>x</script>\n bare <b>words</b>", "bare words"), ("<head><style>p{}</style><link href=x></head><body>a", "a"),
    ("<head><template><p>no</p></template><noscript><link></noscript><title>t</title><div>yes</div>", "yes")])
def test_op8_ends_a_head_that_the_page_leaves_open(html, text):
    assert html_text.extract(html)[0] == text


@pytest.mark.parametrize("html, text", [
    ('<body><svg class="i"/><p>rest</p>', "rest"), ("a <math/> b", "a b"), ('<svg><path d="x"/><g/></svg>after', "after"),
    ("<svg><title>no</title><defs><text>no</text></defs> no <g><text>one</text><text x=1>two</text></g></svg>", "one two"),
    ("<svg><foreignObject><p>in</p></foreignObject></svg><p>out", "in\n\nout"), ("<svg><path d=x><p>kept</p>", "kept"),
    ("<p>so <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>no</annotation></math> holds", "so x=2 holds"),
    ("pick <select><option>a<option selected>b<option>c</select> now", "pick b now"), ("<select><option disabled>a<option>b</select>", "b"),
    ("x<select multiple><option>a<option>b</select>y", "x\na\nb\ny"), ("<table><tr><td><select><option>a</select><td>b</table>", "a | b"),
    ("<div style='visibility:hidden'>no <b style='visibility: visible'>yes</b></div>", "yes"),
    ("a<div style='display:none'>no<b style='visibility:visible'>no</b></div>", "a"), ("<svg><style/><script/></svg>z", "z")])
def test_op8_emits_all_visible_text(html, text):
    assert html_text.extract(html)[0] == text


def test_op3_rejects_a_long_text_of_long_junk_words(spark):
    docs = common.table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "lang", "text")
    lang = docs.groupBy("lang").count().orderBy("count").collect()[-1]["lang"]
    r = random.Random(3)
    junk = " ".join("".join(r.choices("etaoinsrhldcum", k=8)) for _ in range(2000)).replace(" ", " \n", 3)
    more = spark.createDataFrame([(-1, lang, junk)], docs.schema)
    got = quality.quality_rules(docs.unionByName(more)).filter("doc_id = -1").first()
    assert not got.base_failed and got.word_distance > quality.MAX_WORD_DISTANCE and not got.kept
