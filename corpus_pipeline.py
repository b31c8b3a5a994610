"""A corpus pipeline: quality, near-duplicates, decontamination, secrets, mixing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. The quality
classifier can't be stated in SQL, so there is no ORACLE_SQL. Tests hold its votes against exact
cosines one by one, the mixing stage against SQL, and the others against the operators' own results,
which other tests hold against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrun.llm import decontaminate, mixing, quality, secrets, simhash
from quillrun.llm.common import stored, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.scored(docs, model, "__quality").where(F.col("__quality") >= quality.THRESHOLD).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group."""
    return simhash.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by the benchmark."""
    return decontaminate.remove_documents(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked and n_chars counted anew."""
    out = secrets.masked(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns) if "n_chars" in docs.columns else out


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample of the documents that meets the target token shares, with
    the probability and residual weight of each."""
    return mixing.mixed(docs, mixing.TARGETS).where("sampled").select(*docs.columns, "probability", "residual")


STAGES = [
    ("quality classifier", keep_quality),
    ("SimHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("secret scans", mask_secrets),
    ("mixing sources", mix),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written as Parquet to the shared checkpoint folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs)
    return docs
