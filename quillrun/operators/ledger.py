"""A ledger of a provider's answers: every text is asked once, in small tasks, few at a time.

A text's key is a hash of the question and the text, so equal texts share an answer. What has no good
answer yet is dealt to waves of ``max_in_flight`` tasks, each of which asks for some texts, one call at a
time: the number of calls at once doesn't depend on how many tasks the work has. As a call returns, a
file with its answers goes to the ledger's folder. A task that is started again, and a job that is run
again, find these files and ask for the rest only. After each wave the files become rows of the
ledger's table, and the folder is emptied, so no more files lie there than a wave has calls.

The ledger's folder must be one that all executors share, and that pyarrow's file systems can open
(local paths, file, s3, gs, hdfs).

Defined results: null texts are asked as empty ones; an answer with an error is kept, but asked for again by
the next run; of several answers to a key the one without an error counts, else the latest; chunks with
equal texts have a row each; an empty table asks nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrun.operators.extract import MAX_IN_FLIGHT, Provider, asked
from quillrun.sources.shared import opened

ANSWER = "asked string, run string, at double, pairs array<struct<key:string,value:string>>, error string"
#: Texts that a task asks for, about.
PER_TASK = 256


def key_of(question: str):
    """The key of the text in column ``text``, for what is asked about it."""
    return F.sha2(F.concat(F.lit(question + "\0"), F.coalesce("text", F.lit(""))).cast("binary"), 256)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Columns ANSWER: the answer that counts for each key asked so far."""
    try:
        rows = spark.read.schema(ANSWER).parquet(f"{path}/table")
    except AnalysisException:  # nothing has been asked
        rows = spark.createDataFrame([], ANSWER)
    best = F.max_by(F.struct(*rows.columns), F.struct(F.col("error").isNull(), "at")).alias("best")
    return rows.groupBy(F.col("asked").alias("k")).agg(best).select("best.*")


def _settle(spark: SparkSession, path: str, parts: int = MAX_IN_FLIGHT) -> None:
    """Files of answers become rows of the table, in ``parts`` files of its own at most. If this ends before they
    are deleted, rows double, which read() bears."""
    system, folder = opened(f"{path}/files")
    if not any(f.is_file and f.base_name.endswith(".json") for f in system.get_file_info(fs.FileSelector(folder, allow_not_found=True))):
        return
    spark.read.schema(ANSWER).option("pathGlobFilter", "*.json").json(f"{path}/files").coalesce(parts).write.mode("append").parquet(f"{path}/table")
    system.delete_dir_contents(folder)


def _answered(system: fs.FileSystem, folder: str, mine: str) -> set[str]:
    """The keys in the files that tasks of the same texts have left."""
    done: set[str] = set()
    for f in system.get_file_info(fs.FileSelector(folder)):
        if f.base_name.startswith(mine) and f.base_name.endswith(".json"):
            with system.open_input_stream(f.path) as lines:
                done.update(json.loads(line)["asked"] for line in lines.read().splitlines())
    return done


def _asking(provider: Provider, path: str, run: str, wave: int, batch: int):
    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import time

        from pyspark import TaskContext

        system, folder = opened(f"{path}/files")
        mine = f"{run}-{wave}-{TaskContext.get().partitionId()}-"
        there = _answered(system, folder, mine)
        for pdf in batches:
            keys, texts, done = pdf["asked"].tolist(), pdf["text"].tolist(), 0
            todo = [i for i, k in enumerate(keys) if k not in there]
            for at in range(0, len(todo), batch):
                part, lines = todo[at : at + batch], []
                for i, (pairs, error) in zip(part, asked(provider, [texts[i] for i in part])):
                    lines.append(json.dumps({"asked": keys[i], "run": run, "at": time.time(), "pairs": [{"key": k, "value": v} for k, v in pairs], "error": error}))
                    done += 1
                name = f"{folder}/{mine}{uuid.uuid4().hex}"
                with system.open_output_stream(f"{name}.part") as out:
                    out.write("\n".join(lines).encode())
                system.move(f"{name}.part", f"{name}.json")  # appears whole or not at all
            yield pd.DataFrame({"n": [done]})

    return ask


def ask(chunks: DataFrame, provider: Provider, path: str, question: str = "", max_in_flight: int = MAX_IN_FLIGHT, per_task: int = PER_TASK, batch: int = 16) -> int:
    """Asks the provider about the texts of chunks that have no good answer in the ledger at ``path``, and
    returns how many were asked. ``question`` names what is asked: the model, the prompt, the provider."""
    spark, run = chunks.sparkSession, uuid.uuid4().hex
    system, folder = opened(f"{path}/files")
    system.create_dir(folder, recursive=True)
    _settle(spark, path)  # what a run before left behind
    texts = chunks.select(key_of(question).alias("asked"), F.coalesce("text", F.lit("")).alias("text")).dropDuplicates(["asked"])
    todo = texts.join(read(spark, path).where("error is null").select("asked"), "asked", "left_anti")
    n = todo.count()
    waves = -(-n // (max_in_flight * per_task))
    if not waves:
        return 0
    work = f"{path}/work-{run}"
    todo.withColumn("wave", F.pmod(F.xxhash64("asked"), F.lit(waves))).repartition("wave").write.partitionBy("wave").parquet(work)
    rows = spark.read.schema("asked string, text string, wave long").parquet(work)
    done = 0
    for wave in range(waves):
        dealt = rows.where(F.col("wave") == wave).select("asked", "text").repartition(max_in_flight, "asked").sortWithinPartitions("asked")
        done += dealt.mapInPandas(_asking(provider, path, run, wave, batch), "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        _settle(spark, path, max_in_flight)
    system, folder = opened(work)
    system.delete_dir(folder)
    return done


def answers(chunks: DataFrame, path: str, question: str = "") -> DataFrame:
    """(doc_id, chunk_id, page, key, value, error) of the chunks from the ledger, as extract() gives them; a
    chunk that hasn't been asked for has an error that says so."""
    rows = chunks.select("doc_id", "chunk_id", F.col("page_from").alias("page"), key_of(question).alias("asked"))
    found = rows.join(read(chunks.sparkSession, path).select("asked", "pairs", "error", F.lit(True).alias("_there")), "asked", "left")
    found = found.withColumn("error", F.when(F.col("_there"), F.col("error")).otherwise("not asked"))
    pairs = F.coalesce("pairs", F.array().cast("array<struct<key:string,value:string>>"))
    none = F.array(F.struct(F.lit(None).cast("string").alias("key"), F.lit(None).cast("string").alias("value"), F.lit(True).alias("bare")))
    listed = F.transform(pairs, lambda p: F.struct(p["key"].alias("key"), p["value"].alias("value"), F.lit(False).alias("bare")))
    both = F.when((F.size(pairs) == 0) | F.col("error").isNotNull(), F.concat(listed, none)).otherwise(listed)
    rows = found.select("doc_id", "chunk_id", "page", F.inline(both), "error")
    return rows.select("doc_id", "chunk_id", "page", "key", "value", F.when(F.col("bare"), F.col("error")).alias("error"))
