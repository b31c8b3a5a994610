"""Stand-ins for the entities on the test tables: documents as uploads, labels as outcomes, events as polls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrun.operators.history import previous
from quillrun.schemas import ADMINS, EDITORS

MEMBERS = [(1, ADMINS), (2, EDITORS)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def members(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MEMBERS, "user_id long, role string")


def signed_up(events: DataFrame) -> DataFrame:
    """(user_id, role): users with sign-ups as model editors, with over two as administrators."""
    counts = events.where("event_type = 'signup' AND user_id IS NOT NULL").groupBy("user_id").count()
    return counts.select("user_id", F.when(F.col("count") > 2, ADMINS).otherwise(EDITORS).alias("role"))


def extraction_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, user_id, model_id, filename, status, original_log_id): exact copies act as retries."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    keyed = docs.select("doc_id", "source", F.sha2(F.coalesce("text", F.lit("")), 256).alias("k"))
    rows = previous(keyed, "k", "doc_id").join(labels, "doc_id", "left")
    open_status = F.element_at(F.array(*map(F.lit, ("P100", "P200", "P300"))), (F.col("doc_id") % 3 + 1).cast("int"))
    status = F.when(F.col("quality").isNull(), open_status).when(F.col("quality") == 0, "E100").when(F.col("toxic") == 0, "S200").otherwise("S100")
    return rows.select(F.col("doc_id").alias("id"), (F.col("doc_id") % 150).alias("user_id"), F.col("source").alias("model_id"), F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("filename"), status.alias("status"), F.col("before").alias("original_log_id"))


#: The same for DuckDB.
LOG_SQL = """log AS (SELECT d.doc_id id, d.doc_id % 150 user_id, source model_id, 'doc-' || d.doc_id || '.pdf' filename,
  CASE WHEN quality IS NULL THEN ['P100', 'P200', 'P300'][d.doc_id % 3 + 1] WHEN quality = 0 THEN 'E100' WHEN toxic = 0 THEN 'S200' ELSE 'S100' END status,
  lag(d.doc_id) OVER (PARTITION BY coalesce(text, '') ORDER BY d.doc_id) original_log_id FROM documents d LEFT JOIN labels USING (doc_id))"""


def polls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(job, ts, seq, kind): each user's events as polls of a job; errors act as HTTP 500, sign-ups as new uploads."""
    return as_polls(table(spark, sf_dir, "events"))


def as_polls(events: DataFrame) -> DataFrame:
    kind = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "signup", "upload").otherwise("poll")
    return events.select(F.col("user_id").alias("job"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), kind.alias("kind"))


def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(job, ts, seq, status): events as status changes."""
    return as_changes(table(spark, sf_dir, "events"))


def as_changes(events: DataFrame) -> DataFrame:
    names = F.create_map(*(F.lit(x) for kv in {"signup": "P100", "view": "P200", "click": "P300", "purchase": "S100", "error": "E100"}.items() for x in kv))
    return events.select(F.col("user_id").alias("job"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), F.element_at(names, F.col("event_type")).alias("status"))
