"""Bounded labelled samples to fit classifiers on."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrun.llm.common import checkpointed, held_out


def labels_of(labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, label) of the labels 0 and 1 that may be learnt from; an id labelled twice takes the larger."""
    return labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> DataFrame:
    """(doc_id, label, weight, text), checkpointed: for each of 0 and 1 at most ``per_class`` labelled
    ids that are not held out, those of the smallest hashes. The weight, labelled ids of the class over
    those taken, gives the classes the mix that they have in all labels.

    Null labels, ids and texts don't count; an id labelled twice takes the larger label; of rows that
    repeat an id, the one of the smallest text hash counts.
    """
    known = labels_of(labels, label)
    picked = [known.where(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for c in (0, 1)]
    ids = checkpointed(reduce(DataFrame.unionByName, picked))
    n = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    weight = F.when(F.col("label") == 1, max(1.0, n.get(1, 0) / per_class)).otherwise(max(1.0, n.get(0, 0) / per_class))
    rows = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(ids), "doc_id")
    return checkpointed(rows.groupBy("doc_id", "label").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")).select("doc_id", "label", weight.alias("weight"), "text"))
