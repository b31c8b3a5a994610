"""States, timers and time to live in Spark's state store, over several batches and restarts."""

import datetime
import random
import time

from pyspark.sql import functions as F

from quillrun.streaming import lifecycle

EVENT = "job long, ts long, seq long, status string"
POLL = "job long, ts timestamp, seq long, kind string"
START = datetime.datetime(2024, 1, 1)


def feed(spark, path, rows, ddl):
    spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").parquet(str(path))
    return spark.readStream.schema(ddl).parquet(str(path))


def told(rows):
    return {r["job"]: tuple(r[c] for c in rows.columns if c != "job") for r in rows.collect()}


def left(spark, path, name):
    return spark.read.format("statestore").option("stateVarName", name).load(f"{path}/state").count()


def followed(rows):
    """Plain folding: {job: (status, refused)}."""
    out = {}
    for job, _, _, asked in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2])):
        status, refused = out.get(job, (None, 0))
        status, legal = lifecycle.follow(status, asked)
        out[job] = (status, refused + (not legal))
    return out


def test_status_states_over_batches(spark, tmp_path):
    rng = random.Random(2)
    statuses = ["P100", "P200", "P300", "S100", "S200", "E100", "nonsense", None]
    rows = [(rng.choice([1, 1, 1, 2, 3, None]), k, k, rng.choice(statuses[: 4 if k % 3 else 8])) for k in range(300)]
    for at in (0, 100, 200):
        stream = feed(spark, tmp_path / "in", rows[at : at + 100], EVENT)
        got = told(lifecycle.run_to_end(lifecycle.status_stream(stream, 7), str(tmp_path / "out")))
        assert got == followed(rows[: at + 100])
    again = lifecycle.run_to_end(lifecycle.status_stream(spark.readStream.schema(EVENT).parquet(str(tmp_path / "in")), 7), str(tmp_path / "out"))
    assert told(again) == got  # nothing is new
    written = spark.read.parquet(str(tmp_path / "out/rows"))
    assert written.groupBy("batch").agg(F.count("*").alias("n")).where("n > 4").count() == 0  # a row for each changed job, no more
    assert left(spark, tmp_path / "out", "status") == 4
    (tmp_path / "none").mkdir()
    nothing = spark.readStream.schema(EVENT).parquet(str(tmp_path / "none"))
    assert lifecycle.run_to_end(lifecycle.status_stream(nothing), str(tmp_path / "out0")).collect() == []


def test_only_changed_jobs_are_written(spark, tmp_path):
    feed(spark, tmp_path / "in", [(j, 1, j, "P100") for j in range(50)], EVENT)
    lifecycle.run_to_end(lifecycle.status_stream(spark.readStream.schema(EVENT).parquet(str(tmp_path / "in"))), str(tmp_path / "out"))
    stream = feed(spark, tmp_path / "in", [(7, 2, 1, "P200")], EVENT)
    got = told(lifecycle.run_to_end(lifecycle.status_stream(stream), str(tmp_path / "out")))
    assert got[7] == ("P200", 0) and got[8] == ("P100", 0) and len(got) == 50
    last = spark.read.parquet(str(tmp_path / "out/rows")).where("batch = 1")
    assert [r["job"] for r in last.collect()] == [7]


def test_states_expire(spark, tmp_path):
    stream = feed(spark, tmp_path / "in", [(1, 1, 1, "P100")], EVENT)
    assert told(lifecycle.run_to_end(lifecycle.status_stream(stream, ttl_ms=1), str(tmp_path / "out"), one_batch=True)) == {1: ("P100", 0)}
    time.sleep(0.1)
    stream = feed(spark, tmp_path / "in", [(1, 2, 2, "P200")], EVENT)  # the state is gone, so this is refused
    assert told(lifecycle.run_to_end(lifecycle.status_stream(stream, ttl_ms=1), str(tmp_path / "out"), one_batch=True)) == {1: (None, 1)}


def polls(job, *seconds, kind="poll"):
    return [(job, START + datetime.timedelta(seconds=s), s, kind) for s in seconds]


def test_uploads_clear_the_state(spark, tmp_path):
    stream = feed(spark, tmp_path / "in", polls(1, 1, 2) + polls(1, 3, 4, 5, kind="error") + polls(2, 1), POLL)
    run = lambda s: told(lifecycle.run_to_end(lifecycle.upload_stream(s, 3), str(tmp_path / "out")))
    assert run(stream) == {1: (5, 3, "stopped"), 2: (1, 0, "open")}
    assert run(feed(spark, tmp_path / "in", polls(1, 6), POLL)) == {1: (5, 3, "stopped"), 2: (1, 0, "open")}
    assert run(feed(spark, tmp_path / "in", polls(1, 7, kind="upload") + polls(1, 8) + polls(2, *range(10, 100)), POLL)) == {1: (1, 0, "open"), 2: (60, 0, "timeout")}


def test_timers_end_jobs_and_drop_their_states(spark, tmp_path):
    def run(rows):
        stream = feed(spark, tmp_path / "in", rows, POLL)
        return told(lifecycle.run_to_end(lifecycle.timed_poll_stream(stream, 300, 600, "10 seconds"), str(tmp_path / "out")))

    assert run(polls(1, 0, 5, 10) + polls(2, 100, kind="error")) == {1: (3, 0, "open"), 2: (1, 1, "open")}
    # time passes by the polls of another job: the first has ended, the second not yet
    got = run(polls(3, 320) + polls(2, 200, 250, kind="error") + polls(1, 299, 300, 301))
    assert got == {1: (4, 0, "timeout"), 2: (3, 3, "stopped"), 3: (1, 0, "open")}
    assert left(spark, tmp_path / "out", "job") == 3
    # a job that has ended takes no more polls while its state lingers
    assert run(polls(1, 400))[1] == (4, 0, "timeout")
    got = run(polls(4, 100_000))
    assert got == {1: (4, 0, "timeout"), 2: (3, 3, "stopped"), 3: (1, 0, "timeout"), 4: (1, 0, "open")}
    assert left(spark, tmp_path / "out", "job") == 1  # only the last job has a state
    assert run([(5, None, 1, "poll")] + polls(4, 200_000))[4] == (1, 0, "timeout")
    assert left(spark, tmp_path / "out", "job") == 0


def test_an_earlier_first_poll_moves_the_end(spark, tmp_path):
    run = lambda rows: told(lifecycle.run_to_end(lifecycle.timed_poll_stream(feed(spark, tmp_path / "in", rows, POLL), 300, 600, "1 hour"), str(tmp_path / "out")))
    assert run(polls(1, 250)) == {1: (1, 0, "open")}
    assert run(polls(1, 10, 320)) == {1: (2, 0, "open")}  # 320 is beyond the end at 310
    assert run(polls(2, 3911)) == {1: (2, 0, "timeout"), 2: (1, 0, "open")}


def test_many_ranges_are_told_in_few_calls(spark):
    rows = spark.range(3000).select((F.col("id") % 1000).alias("job"), F.col("id").alias("ts"), F.col("id").alias("seq"), F.lit("P100").alias("status"))
    effect = lambda rows, starts: {"call": [int(rows["seq"].iloc[0])] * len(starts), "n": len(rows)}
    got = lifecycle.by_pieces(rows, effect, "call long, n long", 10, groups=8)
    assert got.count() == 3000 and got.select("call").distinct().count() <= 8


def test_long_ranges_and_short_ones_fold_alike(spark, tmp_path):
    rng = random.Random(5)
    statuses = ["P100", "P100", "P200", "P300", "S100", "S200", "E100", "nonsense", None]
    rows = [(rng.choice([1, 1, 2, 3, None]), rng.choice([None, k // 3]), k, rng.choice(statuses)) for k in range(900)]
    for seconds in (1, 40, 10_000):
        stream = feed(spark, tmp_path / f"in{seconds}", rows, EVENT)
        assert told(lifecycle.run_to_end(lifecycle.status_stream(stream, seconds), str(tmp_path / f"out{seconds}"))) == followed(rows)
