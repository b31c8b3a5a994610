"""Extraction history: who sees which logs, filters, retries, edits, groups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillrun.functions.scalars import is_status, is_terminal, to_time
from quillrun.schemas import ADMINS, EDITORS, NEXT
from quillrun.sources.shared import written

#: Rows of a range of times that one task works on at once, about.
PIECE_ROWS = 1_000_000


def in_pieces(events: DataFrame, each: int = PIECE_ROWS, order: tuple[str, ...] = ("ts", "seq")) -> DataFrame:
    """events with ``_piece``: which range of an order holds the row, ascending, nulls first. There are as
    many ranges, alike in rows, as rows make with ``each`` of them; rows share one where all of the order is
    equal. Where there are several, events are written to the shared folder, as ranges differ by run."""
    n = events.count() // each
    if n < 2:
        return events.withColumn("_piece", F.lit(0))
    return written(events.repartitionByRange(n, *order).withColumn("_piece", F.spark_partition_id()))


def visible(logs: DataFrame, members: DataFrame, user_id: int) -> DataFrame:
    """The logs that a user may see: an administrator all, others their own."""
    admin = members.where((F.col("user_id") == user_id) & (F.col("role") == ADMINS)).limit(1).count()
    return logs if admin else logs.where(F.col("user_id") == user_id)


def seen_by(logs: DataFrame, members: DataFrame, users: DataFrame) -> DataFrame:
    """(viewer, role, id): each viewer's own logs, and all logs once for the administrators among the
    viewers, who see all: there viewer is null and role theirs."""
    admins = users.join(members.where(F.col("role") == ADMINS).select(F.col("user_id").alias("viewer")).distinct(), "viewer", "left_semi").distinct()
    own = users.distinct().join(admins, "viewer", "left_anti").join(logs, F.col("viewer") == F.col("user_id")).select("viewer", F.lit(None).cast("string").alias("role"), "id")
    every = logs if admins.limit(1).count() else logs.limit(0)
    return own.unionByName(every.select(F.lit(None).cast("long").alias("viewer"), F.lit(ADMINS).alias("role"), "id"))


def may_edit_models(members: DataFrame, user_id: int) -> bool:
    return bool(editors(members).where(F.col("user_id") == user_id).limit(1).count())


def history(logs: DataFrame, status: list[str] | None = None, model_id: str | None = None, user_id: int | None = None) -> DataFrame:
    """Logs by any of status, model and user."""
    tests = [F.col("status").isin(status)] if status else []
    tests += [F.col("model_id") == model_id] if model_id is not None else []
    tests += [F.col("user_id") == user_id] if user_id is not None else []
    return logs.where(reduce(Column.__and__, tests)) if tests else logs


def page_of(logs: DataFrame, order: list, size: int, after: Column | None = None) -> DataFrame:
    """The next ``size`` logs in an order; ``after`` is a test that keeps what lies beyond the page before."""
    return (logs.where(after) if after is not None else logs).orderBy(*order).limit(size)


def by_time(logs: DataFrame, since: str | None = None) -> DataFrame:
    """logs with the time that created_at tells, newest first, of equal times the larger id first; those
    without one stand last. ``since`` keeps what is not older."""
    rows = logs.withColumn("created", to_time(F.col("created_at")))
    rows = rows.where(F.col("created") >= to_time(F.lit(since))) if since else rows
    return rows.orderBy(F.col("created").desc_nulls_last(), F.col("id").desc())


def editors(members: DataFrame) -> DataFrame:
    """(user_id): who may edit models."""
    return members.where(F.col("role").isin(ADMINS, EDITORS)).select("user_id").distinct()


def newest(logs: DataFrame, n: int) -> DataFrame:
    """The n logs of the largest ids of each user. A user's logs are cut down in parts first, so that
    a user with very many logs never gathers in one task."""
    part = Window.partitionBy("user_id", F.pmod(F.xxhash64("id"), F.lit(64))).orderBy(F.col("id").desc())
    few = logs.withColumn("_n", F.row_number().over(part)).where(F.col("_n") <= n).drop("_n")
    return few.withColumn("rn", F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("id").desc()))).where(F.col("rn") <= n)


def invalid_status(logs: DataFrame) -> DataFrame:
    return logs.where(~is_status(F.col("status")))


def with_status(logs: DataFrame, dim: DataFrame) -> DataFrame:
    """Every status, with its logs where it has any."""
    return F.broadcast(dim).join(logs, F.col("code") == F.col("status"), "left")


def counts(logs: DataFrame) -> DataFrame:
    """(status, model_id, n) with sums over models and over all."""
    return logs.rollup("status", "model_id").agg(F.count(F.lit(1)).alias("n"))


def previous(rows: DataFrame, group: str, order: str, each: int = 100_000) -> DataFrame:
    """rows with ``before``: the ``order``, a whole number, of the row before in its group; null for
    the first and where the order is null. Rows of a null group are one group.

    A row's predecessor is looked for within ranges of the order (in_pieces), and only the last of each
    range is compared across ranges; so one group may hold most rows.
    """
    empty = F.lit(None).cast(rows.schema[order].dataType)
    cut = in_pieces(rows.where(F.col(order).isNotNull()), each, (order,)).withColumnRenamed("_piece", "_r")
    inner = cut.withColumn("_b", F.lag(order).over(Window.partitionBy(group, "_r").orderBy(order)))
    lasts = cut.groupBy(group, "_r").agg(F.max(order).alias("_last"))
    over = lasts.select(F.col(group).alias("_g"), F.col("_r").alias("_k"), F.lag("_last").over(Window.partitionBy(group).orderBy("_r")).alias("_prior"))
    found = inner.join(over, inner[group].eqNullSafe(over["_g"]) & (inner["_r"] == over["_k"])).withColumn("before", F.coalesce("_b", "_prior")).select(*rows.columns, "before")
    return found.unionByName(rows.where(F.col(order).isNull()).withColumn("before", empty))


def retryable(logs: DataFrame) -> DataFrame:
    """Failed logs that no other log retries."""
    tried = logs.where(F.col("original_log_id").isNotNull()).select(F.col("original_log_id").alias("id")).distinct()
    return logs.where(F.col("status") == "E100").join(tried, "id", "left_anti")


def retry(logs: DataFrame) -> DataFrame:
    """A new pending job for each retryable log: (id, original_log_id, status, filename)."""
    return retryable(logs).select(F.concat_ws("-", F.lit("retry"), F.col("id").cast("string")).alias("id"), F.col("id").alias("original_log_id"), F.lit("P100").alias("status"), "filename")


def with_original(logs: DataFrame) -> DataFrame:
    """Retries with the status of the log that they retry."""
    first = logs.select(F.col("id").alias("original_log_id"), F.col("status").alias("original_status"))
    return logs.where(F.col("original_log_id").isNotNull()).join(first, "original_log_id", "left")


def chains(logs: DataFrame, checkpoint=None, most_rounds: int = 40) -> DataFrame:
    """(id, root, attempt): the first log of each chain of retries, and the place in it from 1.

    Pointers are doubled: after k rounds a log knows its ancestor 2^k steps up, so a chain of n
    retries takes log2(n) rounds of one join. ``checkpoint`` is applied after each round.
    """
    steps = logs.select("id", F.coalesce("original_log_id", "id").alias("root"), F.col("original_log_id").isNotNull().cast("int").alias("up"))
    for _ in range(most_rounds):
        above = steps.select(F.col("id").alias("root"), F.col("root").alias("top"), F.col("up").alias("more"))
        steps = steps.join(above, "root", "left").select("id", F.coalesce("top", "root").alias("root"), (F.col("up") + F.coalesce("more", F.lit(0))).alias("up"), (F.coalesce("more", F.lit(0)) > 0).alias("moved"))
        steps = checkpoint(steps) if checkpoint else steps
        if not steps.where("moved").limit(1).count():
            return steps.select("id", "root", (F.col("up") + 1).alias("attempt"))
        steps = steps.drop("moved")
    raise RuntimeError(f"a chain of retries is longer than 2^{most_rounds}, or circular")


def apply_edits(values: DataFrame, edits: DataFrame) -> DataFrame:
    """(doc_id, key, value, edited): a user's value over the machine's; new keys are added."""
    e = edits.select("doc_id", "key", F.col("value").alias("new"), F.lit(True).alias("edited"))
    rows = values.select("doc_id", "key", "value").join(e, ["doc_id", "key"], "full")
    return rows.select("doc_id", "key", F.when(F.col("edited"), F.col("new")).otherwise(F.col("value")).alias("value"), F.coalesce("edited", F.lit(False)).alias("edited"))


def confirm(logs: DataFrame, edited: DataFrame) -> DataFrame:
    """Logs; those of edited documents that had succeeded become confirmed."""
    done = edited.select(F.col("doc_id").alias("id"), F.lit(True).alias("_e")).distinct()
    return logs.join(done, "id", "left").withColumn("status", F.when(F.col("_e") & (F.col("status") == "S100"), "S200").otherwise(F.col("status"))).drop("_e")


def add_members(members: DataFrame, new: DataFrame) -> DataFrame:
    return members.unionByName(new).distinct()


def remove_members(members: DataFrame, gone: DataFrame) -> DataFrame:
    return members.join(gone, ["user_id", "role"], "left_anti")


def jobs_with_logs(jobs: DataFrame, logs: DataFrame) -> DataFrame:
    """Jobs with the log they led to; a job without a log_id can't be retried."""
    got = logs.select(F.col("id").alias("log_id"), F.col("status").alias("log_status"))
    return jobs.join(got, "log_id", "left").withColumn("can_retry", F.col("log_id").isNotNull() & (F.col("log_status") == "E100"))


def transitions(events: DataFrame, each: int = PIECE_ROWS) -> DataFrame:
    """events with prior, the status before in the job, and legal, whether the status may follow it. The
    one before is looked for by pieces, and beyond them among their last rows only, so one job may have
    most events."""
    rows = in_pieces(events, each)
    own = Window.partitionBy("job", "_piece").orderBy("ts", "seq")
    lasts = rows.groupBy(F.col("job").alias("_job"), F.col("_piece").alias("_p")).agg(F.max(F.struct("ts", "seq", "status")).alias("_last"))
    lasts = lasts.select("_job", "_p", F.lag("_last.status").over(Window.partitionBy("_job").orderBy("_p")).alias("_carried"))
    rows = rows.withColumn("_k", F.row_number().over(own)).withColumn("_lag", F.lag("status").over(own))
    rows = rows.join(lasts, rows["job"].eqNullSafe(lasts["_job"]) & (rows["_piece"] == lasts["_p"]))
    rows = rows.withColumn("prior", F.when(F.col("_k") == 1, F.col("_carried")).otherwise(F.col("_lag"))).select(*events.columns, "prior")
    legal = [(F.col("prior").isNull() if a is None else F.col("prior") == a) & F.col("status").isin(b) for a, b in NEXT.items() if b]
    return rows.withColumn("legal", F.coalesce(reduce(Column.__or__, legal), F.lit(False)))


def latest(events: DataFrame) -> DataFrame:
    """(job, status, terminal): the last status of each job."""
    return events.groupBy("job").agg(F.max_by("status", F.struct("ts", "seq")).alias("status")).withColumn("terminal", is_terminal(F.col("status")))
