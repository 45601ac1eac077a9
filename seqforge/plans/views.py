"""Test views built from the driver tables, once as Spark DataFrames and once
as DuckDB SQL (common table expressions) for the oracle.

Both sides are built from the same parquet tables with the same rules, so
a registered query and its oracle SQL see identical inputs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqforge.functions.alphabet import RESIDUES

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --------------------------------------------------------------------------
# Spark side
# --------------------------------------------------------------------------

def seqs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, species, sequence, label.  Strip non-residues *before* upper:
    upper-casing first would turn some letters into several residues."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    keep = RESIDUES + RESIDUES.lower()
    return (docs.join(labels, "doc_id", "left")
            .select("doc_id", F.col("lang").alias("species"),
                    F.upper(F.regexp_replace("text", f"[^{keep}]+", "")).alias("sequence"),
                    F.col("quality").cast("int").alias("label")))


def seqs_ss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seqs(spark, sf_dir).withColumn(
        "ss", F.translate("sequence", RESIDUES, "HECHECHECHECHECHECHE"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("row_key"),
        F.concat(F.lit("A"), F.col("o_custkey").cast("string")).alias("antigen"),
        F.col("o_orderkey").cast("string").alias("tcr"),
        F.when(F.col("o_orderstatus") == "F", "1")
         .when(F.col("o_orderstatus") == "O", "0")
         .otherwise("Unknown").alias("label"))


def preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab = table(spark, sf_dir, "labels")
    return (lab.select(F.col("doc_id").alias("example_id"),
                       F.col("quality").cast("int").alias("y_true"),
                       F.explode(F.sequence(F.lit(1), F.lit(5))).alias("fold"))
            .withColumn("y_prob", ((F.col("example_id") * 7919 + F.col("fold") * 104729) % 1000)
                        .cast("double") / 1000.0)
            .select("example_id", "fold", "y_true", "y_prob"))


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("pos_id"), F.col("embedding").alias("scores"),
                    F.when(F.col("vec_id") % 7 == 0, F.lit(-100)).otherwise(F.col("label"))
                    .cast("int").alias("truth"))


def reg(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("y"),
                     F.col("l_extendedprice").alias("p"))


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return ev.select(F.col("event_type").alias("key"), F.col("event_id").alias("step"),
                     F.col("ts").cast("timestamp").alias("ts"), "value")


# --------------------------------------------------------------------------
# DuckDB side: CTE bodies; ``with_views`` resolves dependencies.
# --------------------------------------------------------------------------

_KEEP = RESIDUES + RESIDUES.lower()

VIEW_SQL = {
    "seqs": (
        "SELECT d.doc_id, d.lang AS species, "
        f"upper(regexp_replace(d.text, '[^{_KEEP}]', '', 'g')) AS sequence, "
        "CAST(l.quality AS INTEGER) AS label "
        "FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"),
    "seqs_ss": ("SELECT *, translate(sequence, '" + RESIDUES + "', 'HECHECHECHECHECHECHE') AS ss "
                "FROM seqs"),
    "pairs": (
        "SELECT o_orderkey AS row_key, 'A' || CAST(o_custkey AS VARCHAR) AS antigen, "
        "CAST(o_orderkey AS VARCHAR) AS tcr, "
        "CASE WHEN o_orderstatus = 'F' THEN '1' WHEN o_orderstatus = 'O' THEN '0' "
        "ELSE 'Unknown' END AS label FROM orders"),
    "preds": (
        "SELECT l.doc_id AS example_id, f.fold, CAST(l.quality AS INTEGER) AS y_true, "
        "CAST((l.doc_id * 7919 + f.fold * 104729) % 1000 AS DOUBLE) / 1000.0 AS y_prob "
        "FROM labels l, (SELECT CAST(range AS INTEGER) AS fold FROM range(1, 6)) f"),
    "logits": (
        "SELECT vec_id AS pos_id, embedding AS scores, "
        "CAST(CASE WHEN vec_id % 7 = 0 THEN -100 ELSE label END AS INTEGER) AS truth "
        "FROM embeddings"),
    "reg": ("SELECT l_orderkey, l_linenumber, l_quantity AS y, l_extendedprice AS p "
            "FROM lineitem"),
    "steps": ("SELECT event_type AS key, event_id AS step, CAST(ts AS TIMESTAMP) AS ts, value "
              "FROM events"),
}

_DEPS = {"seqs_ss": ["seqs"]}


def with_views(*names: str, extra: list[tuple[str, str]] | None = None) -> str:
    """``WITH`` clause defining the named views (and their dependencies) plus
    any extra ``(name, body)`` CTEs, in order."""
    order: list[str] = []

    def add(n):
        for d in _DEPS.get(n, []):
            add(d)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    parts = [f"{n} AS ({VIEW_SQL[n]})" for n in order]
    parts += [f"{n} AS ({body})" for n, body in (extra or [])]
    return "WITH " + ",\n".join(parts) + "\n" if parts else ""


SPARK_VIEWS = {"seqs": seqs, "seqs_ss": seqs_ss, "pairs": pairs, "preds": preds,
               "logits": logits, "reg": reg, "steps": steps}
