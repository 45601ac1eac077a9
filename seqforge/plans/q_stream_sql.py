"""Registered streaming (W1) and SQL-function (U1) queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from seqforge.functions.register import register_functions, register_tokenizer
from seqforge.plans import views as V
from seqforge.plans import q_clean  # noqa: F401  (its queries are registered first)
from seqforge.plans.registry import REGISTRY, register
from seqforge.plans.q_corpus import _CHOICE_SQL, _TOK_VIEWS, _vocab_z
from seqforge.sources.files import scratch_path, write_fasta
from seqforge.streaming import ingest as I
from seqforge.streaming import reset_meter as R
from seqforge.streaming.running import run_meter


@register("w1_running_average_stream", sql="""
SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type,
       CAST(sum(CAST(value AS DECIMAL(38, 6))) AS DOUBLE) AS total, count(*) AS count,
       round(CAST(sum(CAST(value AS DECIMAL(38, 6))) AS DOUBLE) / count(*), 6) AS average
FROM events GROUP BY 1, 2""")
def q_w1(spark, d):
    """Hourly meter per event type from a Structured Streaming run over events."""
    base = scratch_path(spark, "stream")
    r = run_meter(spark, d, "events.parquet", f"{base}/out", f"{base}/ckpt")
    return r.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type",
                    "total", "count", F.round("average", 6).alias("average"))


@register("u1_sql_functions", sql=V.with_views("pairs") + """
SELECT row_key, CASE WHEN lower(trim(label)) IN ('0', '1') THEN CAST(lower(trim(label)) AS INTEGER) END AS strict01,
       (label IS NOT NULL AND lower(label) <> 'unknown') AS labeled,
       CASE WHEN regexp_full_match(label, '[0-9]+') THEN coalesce(TRY_CAST(label AS BIGINT), 0) ELSE 0 END AS digits,
       upper(replace(trim(coalesce(antigen, '')), ' ', '')) AS antigen_norm,
       CASE WHEN length(tcr) < 8 THEN rpad(tcr, 8, '-') ELSE tcr END AS tcr_padded,
       regexp_full_match(antigen, '[ACDEFGHIKLMNPQRSTVWY]+') AS valid,
       coalesce(TRY_CAST(split_part(antigen || '|' || label, '|', 2) AS INTEGER), -1) AS id_label,
       CASE WHEN TRY_CAST(tcr AS DOUBLE) > 1 THEN 1 ELSE 0 END AS above_one
FROM pairs""")
def q_u1(spark, d):
    """The scalar rules called as SQL functions from spark.sql."""
    register_functions(spark)
    view = f"pairs_{uuid.uuid4().hex[:8]}"
    V.pairs(spark, d).createOrReplaceTempView(view)
    return spark.sql(f"""SELECT row_key, sf_parse_label_strict(label) AS strict01, sf_is_labeled(label) AS labeled,
        sf_label_digits(label) AS digits, sf_normalize_peptide(antigen) AS antigen_norm,
        sf_pad_right(tcr, 8) AS tcr_padded, sf_is_valid_sequence(antigen) AS valid,
        sf_label_from_id(antigen || '|' || label) AS id_label, sf_label_gt1(tcr) AS above_one FROM {view}""")


def _cut(total: str, count: str):
    """An average cut to 6 decimals in whole numbers (rounding a double at a
    half differs between engines)."""
    return F.floor(F.round(F.col(total) * 1000000).cast("long") / F.col(count)).cast("double") / 1000000.0


LONGEST, WINDOW = 3000, 512
_INGESTED = [("arrived", f"SELECT CAST(doc_id AS VARCHAR) AS seq_id, sequence, CASE WHEN NOT regexp_full_match(sequence, '[ACDEFGHIKLMNPQRSTVWY]+') "
              f"THEN 'invalid' WHEN length(sequence) > {LONGEST} THEN 'too_long' ELSE 'kept' END AS outcome FROM ("
              "SELECT doc_id, CASE WHEN doc_id % 10 = 3 THEN sequence || 'X' ELSE sequence END AS sequence FROM seqs) WHERE length(sequence) > 0")]


def _ingested(spark, d) -> str:
    """Sequences (every tenth spoilt) written as FASTA files, which arrive in
    two halves and are taken in by two runs of one stream."""
    base = scratch_path(spark, "ingest")
    s = V.seqs(spark, d).select("doc_id", F.when(F.col("doc_id") % 10 == 3, F.concat("sequence", F.lit("X"))).otherwise(
        F.col("sequence")).alias("sequence")).filter(F.length("sequence") > 0)
    for half in (0, 1):
        write_fasta(s.filter(F.col("doc_id") % 2 == half).repartition(3, "doc_id"), f"{base}/in/half={half}", "doc_id", "sequence")
        I.ingest(I.fasta_stream(spark, f"{base}/in/*", 2), f"{base}/out", f"{base}/ckpt", ["sequence"], LONGEST, WINDOW)
    return f"{base}/out"


@register("w2_stream_ingest", sql=V.with_views("seqs", extra=_INGESTED) + f"""
SELECT seq_id, CAST(k AS INTEGER) AS k, CAST(start AS INTEGER) AS start, substr(sequence, CAST(start AS INTEGER) + 1, {WINDOW}) AS "window" FROM (
  SELECT seq_id, sequence, start, row_number() OVER (PARTITION BY seq_id ORDER BY start) - 1 AS k FROM (
    SELECT seq_id, sequence, unnest(CASE WHEN length(sequence) <= {WINDOW} THEN [0] ELSE
      list_distinct(list_concat(range(0, length(sequence) - {WINDOW} + 1, {WINDOW // 2}), [length(sequence) - {WINDOW}])) END) AS start
    FROM arrived WHERE outcome = 'kept'))""")
def q_w2(spark, d):
    """S1, P8 and T1 on a stream of files, in two runs; the windows of the committed batches."""
    return I.read_windows(spark, _ingested(spark, d)).select("seq_id", "k", "start", "window")


@register("w2_ingest_counts", sql=V.with_views("seqs", extra=_INGESTED) + """
SELECT count(*) AS rows, count(*) FILTER (WHERE outcome = 'kept') AS kept, count(*) FILTER (WHERE outcome = 'invalid') AS invalid,
       count(*) FILTER (WHERE outcome = 'too_long') AS too_long FROM arrived""")
def q_w2c(spark, d):
    """Outcome counts, observed in the pass that writes each batch."""
    counts = I.read_counts(spark, _ingested(spark, d))
    return counts.agg(*[F.sum(c).alias(c) for c in ("rows", "kept", "invalid", "too_long")])


@register("w3_reset_meter", sql="""
WITH e AS (SELECT event_type AS key, event_id AS step, CAST(ts AS TIMESTAMP) AS ts, CAST(value AS DECIMAL(38, 6)) AS v, event_id % 50 = 0 AS reset FROM events),
p AS (SELECT *, sum(CASE WHEN reset THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY ts, step ROWS UNBOUNDED PRECEDING) AS part FROM e)
SELECT key, step, round(CAST(sum(v) OVER w AS DOUBLE), 6) AS total, count(*) OVER w AS count, floor(CAST(sum(v) OVER w * 1000000 AS BIGINT)::DOUBLE / count(*) OVER w) / 1000000 AS average
FROM p WINDOW w AS (PARTITION BY key, part ORDER BY ts, step ROWS UNBOUNDED PRECEDING)
QUALIFY ts < (SELECT max(ts) FROM e) - INTERVAL 61 MINUTE""")
def q_w3(spark, d):
    """The meter with resets (every fiftieth event) as arbitrary state of a stream; rows that the watermark has passed."""
    base = scratch_path(spark, "resets")
    reset = F.col("event_id") % 50 == 0
    events = V.table(spark, d, "events")
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(d).withColumn("reset", reset)
    out = R.run_reset_meter(spark, stream, f"{base}/out", f"{base}/ckpt", key="event_type", step="event_id", ts="ts", value="value", reset="reset")
    last = events.agg(F.max(F.col("ts").cast("timestamp"))).scalar()
    return out.filter(F.col("ts") < last - F.expr("INTERVAL 61 MINUTE")).select(
        "key", "step", F.round("total", 6).alias("total"), "count", _cut("total", "count").alias("average"))


@register("g20_reset_average", sql="""
WITH e AS (SELECT event_type AS key, event_id AS step, CAST(ts AS TIMESTAMP) AS ts, CAST(value AS DECIMAL(38, 6)) AS v, event_id % 50 = 0 AS reset FROM events),
p AS (SELECT *, sum(CASE WHEN reset THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY ts, step ROWS UNBOUNDED PRECEDING) AS part FROM e)
SELECT key, step, round(CAST(sum(v) OVER w AS DOUBLE), 6) AS total, count(*) OVER w AS count, floor(CAST(sum(v) OVER w * 1000000 AS BIGINT)::DOUBLE / count(*) OVER w) / 1000000 AS average
FROM p WINDOW w AS (PARTITION BY key, part ORDER BY ts, step ROWS UNBOUNDED PRECEDING)""")
def q_g20r(spark, d):
    """G20 with reset, batch form."""
    e = V.table(spark, d, "events").withColumn("reset", F.col("event_id") % 50 == 0)
    m = R.reset_meter(e, "event_type", "event_id", "ts", "value", "reset")
    return m.select("key", "step", F.round("total", 6).alias("total"), "count", _cut("total", "count").alias("average"))


@register("u2_sql_tokenize", sql=V.with_views("seqs", extra=_TOK_VIEWS + [("ch", _CHOICE_SQL)]) +
          "SELECT doc_id, k, string_agg(tok, ' ' ORDER BY i) AS tokens FROM ch GROUP BY doc_id, k")
def q_u2(spark, d):
    """One SELECT cuts windows and tokenizes them, both called by name."""
    register_functions(spark)
    tokenize = register_tokenizer(spark, "fmfcm", _vocab_z(spark, d))
    view = f"seqs_{uuid.uuid4().hex[:8]}"
    V.seqs(spark, d).filter(F.length("sequence") > 0).createOrReplaceTempView(view)
    return spark.sql(f"""SELECT doc_id, w.k, array_join({tokenize}(w.window), ' ') AS tokens
        FROM {view}, LATERAL sf_windows(sequence, 512) AS w""")


@register("u1_normalize_allele", sql=REGISTRY["p11_normalize_allele"].sql)
def q_u1a(spark, d):
    """P11 by its SQL name."""
    register_functions(spark)
    view = f"part_{uuid.uuid4().hex[:8]}"
    REGISTRY["p11_normalize_allele"].build(spark, d).select("p_partkey", "raw").createOrReplaceTempView(view)
    return spark.sql(f"SELECT p_partkey, raw, sf_normalize_allele(raw) AS allele FROM {view}")
