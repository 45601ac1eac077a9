"""Quality classifier: hashed word n-gram logistic regression, trained with
follow-the-regularised-leader updates and scored as sparse dot products.

Tokens are runs of letters, digits and non-ASCII bytes, and single marks.
Unigrams and bigrams are hashed into 2^18 slots with values 1 + ln(count),
scaled to unit length; the share of repeated bigrams (in tenths) and a bias
have slots of their own.  Only the text is an input.

Training reads a bounded sample of the labelled rows (``MAX_ROWS``, chosen by a
hash of the id), dealt to ``SHARDS`` tasks.  In each epoch every shard goes on
from the mean of all shards' states; states have a fixed size (2 MB a shard).
Scoring is one pass of tasks over all documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqforge.llm import common as C

SLOT_BITS = 18
SLOTS = 1 << SLOT_BITS
LEVELS = 11
BIAS = SLOTS + LEVELS
SIZE = BIAS + 1
MAX_ROWS, SHARDS, EPOCHS = 20_000, 8, 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.05, 0.1
#: Weight of a repeated-bigram slot and of the bias beside the unit-length rest.
SIDE = 0.5

WORDS = C.byte_class([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])
MARKS = ~WORDS & ~C.SPACE


def tokens(data: np.ndarray, offs: np.ndarray):
    """Hashes of the tokens, and the first token of each document."""
    word, mark = WORDS[data], MARKS[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offs] = True
    before = np.append(False, word)
    starts = np.flatnonzero(mark | (word & (edge[:-1] | ~before[:-1])))
    after = np.append(word, False)
    last = mark | (word & (edge[1:] | ~after[1:]))
    ends = np.flatnonzero(last) + 1
    return C.word_codes(data, starts, ends), np.searchsorted(starts, offs)


def sparse(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(slots, values, first): features of each text, by document."""
    data, offs = C.column_bytes(texts)
    codes, first = tokens(data, offs)
    n = len(offs) - 1
    doc = np.repeat(np.arange(n), np.diff(first))
    at, at_doc = C.window_starts(first, 2)
    pairs = C.mix(codes[at] * C.U64(3) + C.mix(codes[at + 1])) if len(at) else np.zeros(0, C.U64)
    slot = np.concatenate([codes, pairs]) >> C.U64(64 - SLOT_BITS)
    slot = slot.astype(np.int64)
    owner = np.concatenate([doc, at_doc])
    key, count = np.unique(owner * SLOTS + slot, return_counts=True)
    owner, slot = key // SLOTS, key % SLOTS
    value = 1 + np.log(count)
    norm = np.sqrt(np.bincount(owner, value * value, minlength=n))
    value = value / norm[owner]
    # a document's distinct bigrams: its number above 44 bits of their hashes
    whole = np.sort((at_doc.astype(C.U64) << C.U64(44)) | (pairs >> C.U64(20)))
    new = whole[np.append(True, whole[1:] != whole[:-1])[:len(whole)]] >> C.U64(44)
    n_pairs = np.bincount(at_doc, minlength=n)
    again = 1 - np.bincount(new.astype(np.int64), minlength=n) / np.maximum(n_pairs, 1)
    again = np.where(n_pairs > 0, again, 0.0)
    side = np.arange(n)
    owner = np.concatenate([owner, side, side])
    slot = np.concatenate([slot, SLOTS + np.floor(again * 10).astype(np.int64), np.full(n, BIAS)])
    value = np.concatenate([value, np.full(2 * n, SIDE)])
    order = np.argsort(owner, kind="stable")
    return slot[order], value[order], np.searchsorted(owner[order], np.arange(n + 1))


def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def learn(z: np.ndarray, n: np.ndarray, features, labels) -> None:
    """One pass of FTRL-proximal updates, in place."""
    slot, value, first = features
    for a, b, y in zip(first[:-1], first[1:], labels):
        i, x = slot[a:b], value[a:b]
        w = weights(z[i], n[i])
        g = (sigmoid(w @ x) - y) * x
        z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA * w
        n[i] += g * g


def _epoch(state):
    def run(key, t):
        t = t.sort_by([("order", "ascending")])
        z, n = state.value
        z, n = z.astype(np.float64), n.astype(np.float64)
        for a in range(0, t.num_rows, 512):
            part = t.slice(a, 512)
            learn(z, n, sparse(part.column("text")), part.column("label").to_pylist())
        return pa.table({"rows": pa.array([t.num_rows], pa.int64()), "z": [z.astype(np.float32).tobytes()], "n": [n.astype(np.float32).tobytes()]})
    return run


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text",
          max_rows: int = MAX_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """FTRL state (z, n) from the labelled documents.  Rows without id or label
    are not used; several labels of an id count by their mean, several rows of
    an id are all used.  Without labelled rows the state is zero."""
    spark = docs.sparkSession
    own = labels.select(F.col(id_col).alias("_id"), F.col(label).alias("_y")).dropna().groupBy("_id").agg((F.avg("_y") >= 0.5).cast("int").alias("label"))
    known = own.count()
    z, n = np.zeros(SIZE), np.zeros(SIZE)
    if not known:
        return z, n
    pick = F.shiftrightunsigned(F.xxhash64("_id"), 11) / F.lit(float(1 << 53)) < min(1.0, max_rows / known)
    # at most about max_rows ids: small enough to send to every task
    own = F.broadcast(own.filter(pick))
    rows = docs.join(own, F.col(id_col) == F.col("_id")).select(
        F.xxhash64("_id", text_col).alias("order"), F.col(text_col).alias("text"), "label")
    rows = C.stored(rows.withColumn("shard", F.pmod("order", F.lit(SHARDS)).cast("int")), "labelled")
    for _ in range(EPOCHS):
        state = spark.sparkContext.broadcast((z.astype(np.float32), n.astype(np.float32)))
        done = rows.groupBy("shard").applyInArrow(_epoch(state), "rows long, z binary, n binary").collect()
        state.destroy()
        share = np.array([r["rows"] for r in done], float)
        if not share.sum():
            break
        z, n = (np.average([np.frombuffer(r[k], np.float32) for r in done], axis=0, weights=share) for k in ("z", "n"))
    return z, n


def _score(model, text_col: str):
    def run(batches):
        w = model.value
        for b in C.batch_blocks(batches, text_col):
            slot, value, first = sparse(b.column(text_col))
            s = sigmoid(np.add.reduceat(w[slot] * value, first[:-1])) if b.num_rows else np.zeros(0)
            cols = [c for f, c in zip(b.schema.names, b.columns) if f != text_col]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))],
                                             names=[*[f for f in b.schema.names if f != text_col], "score", "predicted"])
    return run


def classify(docs: DataFrame, state: tuple[np.ndarray, np.ndarray], text_col: str = "text") -> DataFrame:
    """``docs`` without the text, with score (0 to 1) and predicted (1 from 0.5
    on).  Null and empty texts have the bias only; input columns named as the
    added ones are replaced; an empty table gives an empty result."""
    docs = C.without(docs, ["score", "predicted"])
    model = docs.sparkSession.sparkContext.broadcast(weights(*state).astype(np.float32))
    out = T.StructType([*[f for f in docs.schema.fields if f.name != text_col], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return docs.mapInArrow(_score(model, text_col), out)


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The columns of query op10."""
    docs = docs.select("doc_id", "text")
    state = train(docs, labels.filter(~held_out()))
    return classify(docs.select("doc_id", held_out().alias("held_out"), "text"), state)
