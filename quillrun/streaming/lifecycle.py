"""Polling and job life cycle, as batch windows and as stateful streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quillrun.operators.history import PIECE_ROWS, in_pieces
from quillrun.schemas import NEXT

MAX_POLLS, MAX_ERRORS, POLL_SECONDS = 60, 3, 5
#: Width of the ranges of time in which a stream's rows are folded.
PIECE_SECONDS = 86_400
#: Groups in which a batch's ranges are put in order.
GROUPS = 1024
NO_JOB = -(1 << 63)
OUTCOMES = "job long, attempts long, errors long, outcome string"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def poll_attempts(polls: DataFrame, each: int = PIECE_ROWS) -> DataFrame:
    """polls with attempt (from 1, per job), prior_errors, and whether the poll was still made. Polls are
    numbered by pieces, whose sums are then added up, so one job may have most polls."""
    bad = (F.col("kind") == "error").cast("long")
    rows = in_pieces(polls, each)
    own = Window.partitionBy("job", "_piece").orderBy("ts", "seq")
    earlier = Window.partitionBy("job").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("job", "_piece").agg(F.count(F.lit(1)).alias("n"), F.sum(bad).alias("e"))
    sums = sums.select(
        F.col("job").alias("_job"),
        F.col("_piece").alias("_p"),
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_n"),
        F.coalesce(F.sum("e").over(earlier), F.lit(0)).alias("_e"),
    )
    rows = rows.withColumn("attempt", F.row_number().over(own).cast("long")).withColumn(
        "prior_errors", F.coalesce(F.sum(bad).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    rows = rows.join(sums, rows["job"].eqNullSafe(sums["_job"]) & (rows["_piece"] == sums["_p"]))
    rows = rows.withColumns({"attempt": F.col("attempt") + F.col("_n"), "prior_errors": F.col("prior_errors") + F.col("_e")})
    rows = rows.select(*polls.columns, "attempt", "prior_errors")
    return rows.withColumn("made", (F.col("attempt") <= MAX_POLLS) & (F.col("prior_errors") < MAX_ERRORS))


def timed_polls(polls: DataFrame, seconds: int = MAX_POLLS * POLL_SECONDS) -> DataFrame:
    """(job, attempts, errors, outcome) where polling ends ``seconds`` after a job's first poll, besides
    the other limits. Starts come by partial aggregation, so a job's late polls never gather."""
    starts = polls.groupBy("job").agg(F.min("ts").alias("_start"))
    rows = polls.join(starts, "job")
    late = rows.where(F.col("ts").cast("long") - F.col("_start").cast("long") >= seconds).select("job").distinct().withColumn("_late", F.lit(True))
    own = poll_outcomes(rows.where(F.col("ts").cast("long") - F.col("_start").cast("long") < seconds).drop("_start"))
    return own.join(late, "job", "left").withColumn("outcome", F.when((F.col("outcome") == "open") & F.col("_late"), "timeout").otherwise(F.col("outcome"))).drop("_late")


def retry_stream(failed: DataFrame, tried: DataFrame) -> DataFrame:
    """(id, original_log_id, status, filename): a new pending job for each failed log (id, status,
    filename) of a stream that none of ``tried`` (original_log_id) retries. Stateless: a stream of logs
    has each log once."""
    done = tried.where(F.col("original_log_id").isNotNull()).select(F.col("original_log_id").alias("id")).distinct()
    rows = failed.where(F.col("status") == "E100").join(done, "id", "left_anti")
    return rows.select(F.concat_ws("-", F.lit("retry"), F.col("id").cast("string")).alias("id"), F.col("id").alias("original_log_id"), F.lit("P100").alias("status"), "filename")


def poll_outcomes(polls: DataFrame) -> DataFrame:
    """(job, attempts, errors, outcome) after all polls that were made."""
    made = poll_attempts(polls).where("made").groupBy("job").agg(F.count(F.lit(1)).alias("attempts"), F.sum((F.col("kind") == "error").cast("long")).alias("errors"))
    return made.withColumn("outcome", F.when(F.col("errors") >= MAX_ERRORS, "stopped").when(F.col("attempts") >= MAX_POLLS, "timeout").otherwise("open"))


def advance(state: tuple[int, int], kind: str) -> tuple[int, int]:
    """(attempts, errors) after one more poll; a job that has stopped stays as it is."""
    attempts, errors = state
    if attempts >= MAX_POLLS or errors >= MAX_ERRORS:
        return state
    return attempts + 1, errors + (kind == "error")


def earliest(parts: Iterator[pd.DataFrame], most: int = MAX_POLLS) -> pd.DataFrame:
    """The first rows by time, then number; no more than these and one part are held."""
    held = None
    for part in parts:
        held = (part if held is None else pd.concat([held, part])).sort_values(["ts", "seq"])[:most].copy()
    return held


def outcome_of(attempts: int, errors: int) -> str:
    return "stopped" if errors >= MAX_ERRORS else "timeout" if attempts >= MAX_POLLS else "open"


def poll_stream(polls: DataFrame) -> DataFrame:
    """(job, attempts, errors, outcome) after each batch, from a stream of polls.

    Within a batch the polls of a job are taken by time, then number. No more than MAX_POLLS count, so
    only the earliest are held of a batch. See poll_states() for uploads that start anew.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now = tuple(state.get) if state.exists else (0, 0)
        for kind in earliest(parts)["kind"]:
            now = advance(now, kind)
        state.update(now)
        yield pd.DataFrame({"job": [key[0]], "attempts": [now[0]], "errors": [now[1]], "outcome": [outcome_of(*now)]})

    return polls.groupBy("job").applyInPandasWithState(step, "job long, attempts long, errors long, outcome string", "attempts long, errors long", "update", "NoTimeout")


def follow(prior: str | None, status: str) -> tuple[str | None, bool]:
    """The status after a change is asked for, and whether it was legal; illegal changes are refused."""
    legal = status in NEXT.get(prior, [])
    return (status if legal else prior), legal


def by_pieces(stream: DataFrame, effect: Callable[[pd.DataFrame, np.ndarray], dict], ddl: str, seconds: int, groups: int = GROUPS) -> DataFrame:
    """(job, piece, effect): what the rows of a job in a range of so many seconds, in the order of time and
    number, do to any state. So a job's rows are folded in many tasks, and its state meets a row for each
    range; null times come first. Ranges are dealt by hash to ``groups``, each of which is sorted and told at
    once: effect gets its rows in order and where ranges begin. Most ranges have a few rows, too few for a call each."""

    def told(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values(["job", "piece", "ts", "seq"], na_position="first", ignore_index=True)
        job, piece = rows["job"].to_numpy(), rows["piece"].to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], (job[1:] != job[:-1]) | (piece[1:] != piece[:-1])]))
        return pd.DataFrame({"job": job[starts], "piece": piece[starts], **effect(rows, starts)})

    piece = F.coalesce(F.floor(F.col("ts").cast("double") / seconds).cast("long"), F.lit(-(1 << 62)))
    rows = _keyed(stream).withColumn("piece", piece)
    return rows.groupBy(F.pmod(F.xxhash64("job", "piece"), F.lit(groups)).alias("group")).applyInPandas(told, f"job long, piece long, {ddl}")


def _in_order(parts: Iterator[pd.DataFrame], columns: list[str]) -> Iterator[tuple]:
    rows = pd.concat(list(parts)).sort_values("piece")
    return zip(*(rows[c].tolist() for c in columns))


def _words(codes: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> list[str]:
    """Letters for codes from 0, of each range."""
    text = (codes + ord("a")).astype(np.uint8).tobytes().decode()
    return [text[a:b] for a, b in zip(begins.tolist(), ends.tolist())]


def _keyed(rows: DataFrame) -> DataFrame:
    """rows whose job is never null, as keys of states can't be: NO_JOB stands for null."""
    return rows.withColumn("job", F.coalesce("job", F.lit(NO_JOB)))


def _unkeyed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("job", F.nullif("job", F.lit(NO_JOB)))


#: The states that a change may meet, and the statuses that may be asked for; any other is the last.
BEFORE, ASKED = list(NEXT), [s for s in NEXT if s] + ["other"]
#: For each of both, the place of the state that follows, and whether the change is legal.
STEPS = [[(BEFORE.index(after), legal) for after, legal in (follow(now, asked) for asked in ASKED)] for now in BEFORE]


#: Changes of a range that are handed on one by one; of more only the effect is.
LONG = 64


class StatusMachine(StatefulProcessor):
    """Each job's status, and how often each status was refused, in Spark's state store."""

    def __init__(self, ttl_ms: int | None = None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.status = handle.getValueState("status", "status string", self.ttl_ms)
        self.refused = handle.getMapState("refused", "asked string", "n long", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known = self.status.exists()  # what was refused is never kept longer
        now = self.status.get()[0] if known else None
        before = {k[0]: v[0] for k, v in self.refused.iterator()} if known else {}
        k, more = BEFORE.index(now), [0] * len(ASKED)
        for word, after, refused in _in_order(rows, ["asked", "after", "refused"]):
            if word is None:
                more = [a + int(n) for a, n in zip(more, refused[k])]
                k = int(after[k])
            else:
                for c in word:
                    c = ord(c) - ord("a")
                    k, legal = STEPS[k][c]
                    more[c] += not legal
        refused = before | {a: before.get(a, 0) + n for a, n in zip(ASKED, more) if n}
        for asked, n in refused.items():
            if n != before.get(asked):  # once for all rows, as each costs a call to the store
                self.refused.updateValue((asked,), (n,))
        self.status.update((BEFORE[k],))
        yield pd.DataFrame({"job": [key[0]], "status": [BEFORE[k]], "refused": [sum(refused.values())]})

    def close(self) -> None:
        pass


def status_effect(rows: pd.DataFrame, starts: np.ndarray) -> dict:
    """Of each range the changes that are asked for, a letter each; of a long one, from each status that a job may
    have, none too, the status after it, and how often each was refused."""
    codes = pd.Categorical(rows["status"], categories=ASKED[:-1]).codes.astype(np.int64)
    words = _words(np.where(codes < 0, len(ASKED) - 1, codes), starts, np.append(starts[1:], len(rows)))
    out: dict[str, list] = {"asked": [], "after": [], "refused": []}
    for word in words:
        after, refused = None, None
        if len(word) > LONG:
            after, refused = list(range(len(BEFORE))), [[0] * len(ASKED) for _ in BEFORE]
            for c in word.encode():
                for j, k in enumerate(after):
                    after[j], legal = STEPS[k][c - ord("a")]
                    refused[j][c - ord("a")] += not legal
        for name, v in zip(out, (word if after is None else None, after, refused)):
            out[name].append(v)
    return out


def status_stream(events: DataFrame, seconds: int = PIECE_SECONDS, ttl_ms: int | None = None) -> DataFrame:
    """(job, status, refused) of the jobs that a batch changes, from a stream of (job, ts, seq, status).
    Within a batch changes are taken by time, then number. A state that hasn't changed for ``ttl_ms``
    milliseconds is dropped."""
    effects = by_pieces(events, status_effect, "asked string, after array<int>, refused array<array<long>>", seconds)
    mode = "None" if ttl_ms is None else "ProcessingTime"
    return _unkeyed(effects.groupBy("job").transformWithStateInPandas(StatusMachine(ttl_ms), "job long, status string, refused long", "Update", mode))


class PollCounter(StatefulProcessor):
    """Each job's polls since its last upload; a new upload clears its state."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counted = handle.getValueState("counted", "attempts long, errors long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = tuple(self.counted.get()) if self.counted.exists() else (0, 0)
        for anew, kinds in _in_order(rows, ["anew", "kinds"]):
            now = (0, 0) if anew else now
            for kind in kinds:
                now = advance(now, "error" if kind == "b" else "poll")
        self.counted.update(now)
        yield pd.DataFrame({"job": [key[0]], "attempts": [now[0]], "errors": [now[1]], "outcome": [outcome_of(*now)]})

    def close(self) -> None:
        pass


def poll_effect(rows: pd.DataFrame, starts: np.ndarray) -> dict:
    """Whether a range has an upload, and its first polls after the last one, a letter each: b for errors, else a."""
    kinds = rows["kind"].to_numpy()
    last = np.maximum.reduceat(np.where(kinds == "upload", np.arange(len(rows)), -1), starts)
    begins = np.where(last < 0, starts, last + 1)
    ends = np.minimum(np.append(starts[1:], len(rows)), begins + MAX_POLLS)
    return {"anew": last >= 0, "kinds": _words((kinds == "error").astype(np.int64), begins, ends)}


def upload_stream(polls: DataFrame, seconds: int = PIECE_SECONDS) -> DataFrame:
    """(job, attempts, errors, outcome) of the jobs that a batch changes, where a new upload starts a job anew."""
    effects = by_pieces(polls, poll_effect, "anew boolean, kinds string", seconds)
    return _unkeyed(effects.groupBy("job").transformWithStateInPandas(PollCounter(), OUTCOMES, "Update", "None"))


class TimedPolls(StatefulProcessor):
    """Polls of each job until a time after its first one. A timer then ends the job; a second one, after
    ``linger_ms``, in which further polls of the job are let fall, drops its state."""

    def __init__(self, limit_ms: int, linger_ms: int):
        self.limit_ms, self.linger_ms = limit_ms, linger_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "start_ms long, attempts long, errors long, ended boolean")

    def _row(self, key, attempts: int, errors: int, over: bool) -> pd.DataFrame:
        outcome = outcome_of(attempts, errors)
        return pd.DataFrame({"job": [key[0]], "attempts": [attempts], "errors": [errors], "outcome": ["timeout" if over and outcome == "open" else outcome]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = earliest(rows)
        first = int(held["ms"].iloc[0])
        start, attempts, errors, ended = tuple(self.job.get()) if self.job.exists() else (first, 0, 0, False)
        if ended:
            return
        if first < start or not self.job.exists():  # a poll from before the first one known moves the end
            if self.job.exists():
                self.handle.deleteTimer(start + self.limit_ms)
            start = first
            self.handle.registerTimer(start + self.limit_ms)
        for kind in held["kind"][held["ms"] < start + self.limit_ms]:
            attempts, errors = advance((attempts, errors), kind)
        self.job.update((start, attempts, errors, False))
        yield self._row(key, attempts, errors, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        start, attempts, errors, ended = tuple(self.job.get())
        last = start + self.limit_ms + self.linger_ms
        if ended or timerValues.getCurrentWatermarkInMs() > last:
            self.job.clear()
        else:
            self.job.update((start, attempts, errors, True))
            self.handle.registerTimer(last)
        if not ended:
            yield self._row(key, attempts, errors, True)

    def close(self) -> None:
        pass


def timed_poll_stream(polls: DataFrame, seconds: int = MAX_POLLS * POLL_SECONDS, linger: int = 86_400, delay: str = "1 hour") -> DataFrame:
    """(job, attempts, errors, outcome) of the jobs that a batch changes or ends. A job ends ``seconds``
    after its first poll, when the watermark, ``delay`` behind the latest poll of all jobs, has passed that
    time. Polls without a time are let fall, and no more than MAX_POLLS of a job and batch are held."""
    rows = _keyed(polls.where(F.col("ts").isNotNull())).withWatermark("ts", delay).withColumn("ms", F.unix_millis("ts"))
    return _unkeyed(rows.groupBy("job").transformWithStateInPandas(TimedPolls(1000 * seconds, 1000 * linger), OUTCOMES, "Update", "EventTime"))


def append_to_end(stream: DataFrame, path: str) -> DataFrame:
    """All rows of a stateless stream over what is there; ``path`` is a folder that the cluster shares."""
    query = stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows")


def run_to_end(stream: DataFrame, path: str, one_batch: bool = False) -> DataFrame:
    """Runs a stateful stream over all that is there and gives the last row of each job. ``path`` is a folder
    that the whole cluster shares: states stay in the state store there, and a batch adds the rows of
    the jobs that it changes. Run again, it goes on where it ended. States with a time to live ask for
    batches for ever, as time passes by itself: for them take ``one_batch``, or start the stream yourself."""
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)  # the only one that has timers and maps

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")

    trigger = {"once": True} if one_batch else {"availableNow": True}
    query = stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{path}/state").trigger(**trigger).start()
    query.awaitTermination()
    names = [c for c in stream.columns if c != "job"]
    try:
        rows = spark.read.schema(stream.schema.add("batch", "long")).option("basePath", f"{path}/rows").parquet(f"{path}/rows")
    except AnalysisException:  # there has been no batch
        return spark.createDataFrame([], stream.schema)
    return rows.groupBy("job").agg(*(F.max_by(c, "batch").alias(c) for c in names))
