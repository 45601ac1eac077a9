"""Row-wise operators on streams: files that arrive (FASTA, S1, or assay
tables, S3) are cleaned (P8) and cut into windows (T1) by the same functions
as in a batch job, into a sink that is idempotent by batch id.

Each micro-batch is written in one pass to its own folder, rows partitioned by
their outcome (``kept`` windows, ``invalid`` and ``too_long`` records), with
the counts observed on the way.  A commit row with these counts follows.  A
batch that runs again after a failure or restart replaces its folder, and
readers only take folders that have a commit row; so the result is that of
one batch job over all files, whatever was repeated.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqforge.operators.clean import observe_rejects, tag_rejects
from seqforge.operators.corpus import sequence_windows
from seqforge.sources.files import parse_fasta

COUNTS = "batch_id long, rows long, kept long, invalid long, too_long long"


def fasta_stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """S1 on a folder that grows: ``(seq_id, description, sequence)``."""
    raw = spark.readStream.option("lineSep", "\n>").option("maxFilesPerTrigger", files_per_batch).text(path)
    return parse_fasta(raw)


def assay_stream(spark: SparkSession, path: str, columns: list[str], files_per_batch: int = 1000) -> DataFrame:
    """S3 on a folder that grows: all columns as text, empty cells ``''``."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    rows = spark.readStream.schema(schema).option("header", True).option("mode", "FAILFAST") \
        .option("maxFilesPerTrigger", files_per_batch).csv(path)
    return rows.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in columns])


def cleaned_windows(rows: DataFrame, seq_cols: list[str], max_len: int, window: int) -> DataFrame:
    """Tagged rows (P8), the kept ones as the windows of their first sequence
    column (T1), the rejected ones as one row without window; ``outcome``."""
    tagged = rows if "reject_reason" in rows.columns else tag_rejects(rows, seq_cols, max_len)
    text = F.when(F.col("reject_reason").isNull(), F.col(seq_cols[0])).otherwise(F.lit(""))
    d = tagged.withColumn("_text", text).withColumn("outcome", F.coalesce("reject_reason", F.lit("kept"))).drop("reject_reason")
    return sequence_windows(d, window, "_text")


def sink(out: str, seq_cols: list[str], max_len: int, window: int) -> Callable[[DataFrame, int], None]:
    """The ``foreachBatch`` function: one pass, then the commit row."""
    def run(batch: DataFrame, batch_id: int) -> None:
        tagged, seen = observe_rejects(tag_rejects(batch, seq_cols, max_len), f"batch{batch_id}")
        cleaned_windows(tagged, seq_cols, max_len, window).write.mode("overwrite") \
            .partitionBy("outcome").parquet(f"{out}/rows/batch_id={batch_id}")
        c = seen.get
        commit = [(batch_id, c["rows"], c["kept"], c["invalid"], c["too_long"])]
        batch.sparkSession.createDataFrame(commit, COUNTS).coalesce(1).drop("batch_id") \
            .write.mode("overwrite").parquet(f"{out}/commits/batch_id={batch_id}")
    return run


def ingest(stream: DataFrame, out: str, checkpoint: str, seq_cols: list[str], max_len: int, window: int) -> None:
    """Take in all files that are there now; a later call goes on from there."""
    q = (stream.writeStream.foreachBatch(sink(out, seq_cols, max_len, window))
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


def read_counts(spark: SparkSession, out: str) -> DataFrame:
    """Outcome counts of the committed batches."""
    return spark.read.schema(COUNTS).parquet(f"{out}/commits")


def read_windows(spark: SparkSession, out: str, outcome: str = "kept") -> DataFrame:
    """Rows of one outcome from committed batches (other folders are pruned)."""
    rows = spark.read.option("basePath", f"{out}/rows").parquet(f"{out}/rows").filter(F.col("outcome") == outcome)
    return rows.join(read_counts(spark, out).select("batch_id"), "batch_id", "left_semi").drop("batch_id", "outcome")
