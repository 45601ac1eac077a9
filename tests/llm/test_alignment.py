"""Alignment of two tokenizers, against a plain computation on whole texts."""

import hashlib
from collections import Counter, defaultdict

import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from seqforge.llm import common, token_alignment as ta
from tests.conftest import SF

ODD = [None, "", " ", "  ", "a", " a", "a ", " lead and  double ", "tab\t x \n y", "naïve 日本語 𝔘𝔫𝔦 text's", "a ▁b", "x▁",
       "  nb  sp", "<s> <|endoftext|> </s><unk>", "<0x0A> 😀x😀 y", "no blank at all" * 400, "ab " * 3000 + "end", "don't 's 123 4 5,6 .",
       "a　b 　 c  d", "\x00 a\x00b \x1c c\x1d d", "\r\n a\r\nb", "a", "the same the same"]


def brute(texts):
    a, b = Tokenizer.from_file(ta.TOKENIZER_A), sentencepiece.SentencePieceProcessor(model_file=ta.TOKENIZER_B)
    a.encode_special_tokens = True
    letters = ta.byte_letters()

    def spans(tokens):
        at, out = 0, []
        for i, raw in tokens:
            out.append((i, at, at + len(raw)))
            at += len(raw)
        return out
    docs, held = [], Counter()
    for t in texts:
        ta_ = [(i, bytes(letters[c] for c in a.id_to_token(i))) for i in a.encode(" " + t, add_special_tokens=False).ids] if t else []
        tb = []
        for i in b.encode(t) if t else []:
            p = b.id_to_piece(i)
            tb.append((i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()))
        want = (" " + t).encode() if t else b""
        if b"".join(x for _, x in ta_) != want or b"".join(x for _, x in tb) != want:
            ta_ = tb = []
        sa, sb = spans(ta_), spans(tb)
        links = []
        for i, s, e in sa:
            links += [(i, j) for j, u, v in sb if s < v and u < e] if len(sb) < 400 else []
        if len(sb) >= 400:
            at = defaultdict(list)
            for j, u, v in sb:
                for x in range(u, v):
                    at[x] = j, u
            links = [(i, j) for i, s, e in sa for j, _ in dict.fromkeys(at[x] for x in range(s, e))]
        ends = sorted({e for *_, e in sa} & {e for *_, e in sb})
        groups, low = [], 0
        for e in ends:
            groups.append(",".join(str(i) for i, _, v in sa if low < v <= e) + "|" + ",".join(str(j) for j, _, v in sb if low < v <= e))
            low = e
        held.update(set(links))
        docs.append((len(sa), len(sb), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""))
    top = defaultdict(int)
    for (i, _), n in held.items():
        top[i] = max(top[i], n)
    return [(*d[:3], len(d[3]), sum(held[x] == top[x[0]] for x in d[3]), sum(held[x] for x in d[3]), d[4]) for d in docs]


COLS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("chunk,block", [(ta.CHUNK, ta.BLOCK), (300, 40)])
def test_odd_texts(spark, monkeypatch, chunk, block):
    monkeypatch.setattr(ta, "CHUNK", chunk)
    monkeypatch.setattr(ta, "BLOCK", block)
    rows = [(None if i == 3 else i // 2, t, "x") for i, t in enumerate(ODD)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_links string").withColumn("place", F.lit(1)).coalesce(2)
    got, pairs = ta.align(df.withColumn("order", F.monotonically_increasing_id()))
    assert got.columns == ["doc_id", "place", "order", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]
    found = [tuple(r[c] for c in COLS) for r in sorted(got.collect(), key=lambda r: r["order"])]
    assert found == brute(ODD)
    best = pairs.collect()
    assert len({(r.a_id, r.b_id) for r in best}) == len(best) and any(r.best for r in best)


def test_documents(spark):
    docs = common.table(spark, SF, "documents")
    rows = docs.orderBy("doc_id").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r[c] for c in COLS) for r in ta.digest(docs).collect()}
    assert [got[r.doc_id] for r in rows] == brute([r.text for r in rows])


def test_groups_and_empty_table(spark):
    df = spark.createDataFrame([(1, "Hello naïve world")], "doc_id long, text string")
    row = ta.align(df, with_groups=True)[0].first()
    assert hashlib.sha256(row.groups.encode()).hexdigest() == row.groups_sha256 and row.groups.count(";") + 1 == row.n_groups
    none = ta.digest(df.filter("false"))
    assert none.columns == ["doc_id", *COLS] and none.count() == 0
