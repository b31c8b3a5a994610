import gc
import io
import random
import weakref
import zipfile
from xml.etree import ElementTree

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillrun.functions import scalars
from quillrun.operators import extract, history
from quillrun.schemas import ADMINS, EDITORS, ExtractionModel, Field
from quillrun.sources import files
from quillrun.streaming import lifecycle

LOG = "id long, user_id long, status string, original_log_id long, filename string"


@pytest.fixture(scope="module")
def logs(spark):
    return spark.createDataFrame([(1, 1, "E100", None, "a"), (2, 1, "E100", 1, "a"), (3, 2, "S100", 2, "a"), (4, 3, "E100", None, "b")], LOG)


def test_who_sees_what(spark, logs):
    members = spark.createDataFrame([(9, ADMINS), (8, EDITORS)], "user_id long, role string")
    ids = lambda u: sorted(r.id for r in history.visible(logs, members, u).collect())
    assert ids(9) == [1, 2, 3, 4] and ids(1) == [1, 2] and ids(8) == []
    assert history.may_edit_models(members, 8) and history.may_edit_models(members, 9) and not history.may_edit_models(members, 1)


def test_retries(logs):
    assert [r.id for r in history.retryable(logs).collect()] == [4]
    assert {(r.id, r.root, r.attempt) for r in history.chains(logs).collect()} == {(1, 1, 1), (2, 1, 2), (3, 1, 3), (4, 4, 1)}
    assert [tuple(r) for r in history.retry(logs).collect()] == [("retry-4", 4, "P100", "b")]


def test_a_long_chain(spark):
    rows = spark.range(1, 101).selectExpr("id", "CASE WHEN id > 1 THEN id - 1 END original_log_id")
    got = history.chains(rows, lambda d: d.localCheckpoint()).collect()
    assert {(r.id, r.root, r.attempt) for r in got} == {(i, 1, i) for i in range(1, 101)}


def test_a_job_without_a_log_cant_be_retried(spark, logs):
    jobs = spark.createDataFrame([("j1", 1), ("j3", 3), ("j0", None)], "job_id string, log_id long")
    assert {r.job_id: bool(r.can_retry) for r in history.jobs_with_logs(jobs, logs).collect()} == {"j1": True, "j3": False, "j0": False}


def test_previous_across_ranges(spark):
    rows = spark.createDataFrame([("g", i) for i in (1, 5, 12, 31)] + [("h", 7)], "k string, n long")
    assert {r.n: r.before for r in history.previous(rows, "k", "n", each=1).collect()} == {1: None, 5: 1, 12: 5, 31: 12, 7: None}


def test_edits(spark, logs):
    values = spark.createDataFrame([(1, "a", "x"), (1, "b", "y")], "doc_id long, key string, value string")
    none = spark.createDataFrame([], values.schema)
    assert {tuple(r) for r in history.apply_edits(values, none).collect()} == {(1, "a", "x", False), (1, "b", "y", False)}
    edits = spark.createDataFrame([(1, "b", None), (3, "c", "new")], values.schema)
    assert {tuple(r) for r in history.apply_edits(values, edits).collect()} == {(1, "a", "x", False), (1, "b", None, True), (3, "c", "new", True)}
    assert {r.id: r.status for r in history.confirm(logs, edits).collect()} == {1: "E100", 2: "E100", 3: "S200", 4: "E100"}


def test_legal_transitions():
    path, seen = None, []
    for s in ["P200", "P100", "P300", "P200", "P300", "S100", "P100", "S200", "E100"]:
        path, legal = lifecycle.follow(path, s)
        seen.append(legal)
    assert seen == [False, True, False, True, True, True, False, True, False] and path == "S200"


@pytest.mark.parametrize("polls,errors,outcome", [(59, 0, "open"), (60, 0, "timeout"), (61, 0, "timeout"), (10, 2, "open"), (10, 3, "stopped")])
def test_poll_limits(spark, polls, errors, outcome):
    rows = spark.createDataFrame([(1, i, i, "error" if i < errors else "poll") for i in range(polls)], "job long, ts long, seq long, kind string")
    assert lifecycle.poll_outcomes(rows).first().outcome == outcome
    state = (0, 0)
    for i in range(polls):
        state = lifecycle.advance(state, "error" if i < errors else "poll")
    assert state == tuple(lifecycle.poll_outcomes(rows).first()[1:3])


def test_a_new_upload_clears_the_poll(spark, tmp_path):
    rows = [(1, i, "error") for i in range(3)] + [(1, 3, "upload"), (1, 4, "poll")]
    spark.createDataFrame([(j, s, s, k) for j, s, k in rows], "job long, ts long, seq long, kind string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("job long, ts long, seq long, kind string").parquet(str(tmp_path / "in"))
    assert lifecycle.run_to_end(lifecycle.upload_stream(stream, 2), str(tmp_path / "out")).collect()[0][1:] == (1, 0, "open")
    stream = spark.readStream.schema("job long, ts long, seq long, kind string").parquet(str(tmp_path / "in"))
    assert lifecycle.run_to_end(lifecycle.poll_stream(stream), str(tmp_path / "out2")).collect()[0][1:] == (3, 3, "stopped")


def test_poll_stream_holds_the_earliest_polls_only(spark, tmp_path):
    alive, most = weakref.WeakSet(), []

    class Part(pd.DataFrame):
        pass

    def parts():
        for k in reversed(range(50)):
            part = Part({"ts": range(100 * k, 100 * k + 100), "seq": 0, "kind": "poll"})
            alive.add(part._mgr)
            yield part
            del part
            gc.collect()
            most.append(len(alive))

    assert lifecycle.earliest(parts())["ts"].tolist() == list(range(lifecycle.MAX_POLLS)) and max(most) <= 2
    rows = [(1, i, i, "error" if i in (70, 71, 72) or i == 5 else "poll") for i in range(3000)] + [(2, i, i, "error" if i % 2 else "poll") for i in range(3000)]
    spark.createDataFrame(rows, "job long, ts long, seq long, kind string").repartition(3).write.parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    try:
        stream = spark.readStream.schema("job long, ts long, seq long, kind string").parquet(str(tmp_path / "in"))
        got = {r.job: tuple(r)[1:] for r in lifecycle.run_to_end(lifecycle.poll_stream(stream), str(tmp_path / "out")).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {1: (60, 1, "timeout"), 2: (6, 3, "stopped")}


def test_hot_jobs_are_cut_into_pieces(spark):
    rng = random.Random(7)
    rows = [(rng.choice([1, 1, 1, 2, None]), rng.choice([None, *range(40)]), i, rng.choice(["poll", "poll", "error", "upload"])) for i in range(400)]
    polls = spark.createDataFrame(rows, "job long, ts long, seq long, kind string")
    pieces = {r[0]: r[1] for r in history.in_pieces(polls, 50).groupBy("_piece").count().collect()}
    assert len(pieces) > 4 and max(pieces.values()) < 150 and sum(pieces.values()) == 400
    whole, cut = (sorted(map(repr, lifecycle.poll_attempts(polls, n).select("job", "ts", "seq", "attempt", "prior_errors", "made").collect())) for n in (10**6, 50))
    assert whole == cut and len(cut) == 400
    counts = {}
    for job, ts, seq, kind in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2])):
        counts[seq] = 1 + sum(j == job and (t is not None, t or 0, s) < (ts is not None, ts or 0, seq) for j, t, s, _ in rows)
    assert {r.seq: r.attempt for r in lifecycle.poll_attempts(polls, 50).collect()} == counts
    events = polls.withColumn("status", F.when(F.col("kind") == "poll", "P100").when(F.col("kind") == "error", "P200"))
    whole, cut = (sorted(map(repr, history.transitions(events, n).select("job", "seq", "prior", "legal").collect())) for n in (10**6, 50))
    assert whole == cut and len(cut) == 400
    assert history.in_pieces(polls.limit(0), 50).count() == 0


def test_types(spark):
    values = {"number": [("1,234.50", 1234.5), ("$7", 7.0), ("x", None)], "date": [("2024년 3월 5일", "2024-03-05"), ("2024-03-05", "2024-03-05"), ("soon", None)], "boolean": [("yes", True), ("0", False), ("on", None)], "array": [('["a","b"]', ["a", "b"]), ("a, b", ["a", "b"]), ("", None)]}
    for kind, cases in values.items():
        got = spark.createDataFrame([(i, v) for i, (v, _) in enumerate(cases)], "i int, v string").select("i", scalars.typed(F.col("v"), kind).alias("x")).orderBy("i").collect()
        assert [str(r.x) if kind == "date" and r.x else r.x for r in got] == [w for _, w in cases]


def test_models(spark, tmp_path):
    model = ExtractionModel("m", (Field("k", "Label", "number"), Field("d", "Day", "date", "when")))
    (tmp_path / "m.json").write_text(model.to_json())
    assert files.load_model(spark, str(tmp_path)) == model
    assert [r.key for r in files.read_models(spark, str(tmp_path)).orderBy("pos").collect()] == ["k", "d"]
    assert model.frame(spark).count() == 2
    for bad in (lambda: Field("a", "A", "money"), lambda: ExtractionModel("m", (Field("a", "A"), Field("a", "B")))):
        with pytest.raises(ValueError):
            bad()
    wide = extract.project(spark.createDataFrame([(1, "k", "12"), (1, "z", "0")], "doc_id long, key string, value string"), model)
    assert extract.relabel(extract.cast_fields(wide, model), model).collect()[0].asDict() == {"doc_id": 1, "Label": 12.0, "Day": None}


def test_files_in_and_out(spark, tmp_path, logs):
    for name in ("a.pdf", "b.PNG", "c.txt"):
        (tmp_path / name).write_bytes(b"x")
    found = files.ingest(spark, str(tmp_path))
    assert sorted(r.path[-5:] for r in found.collect()) == ["a.pdf", "b.PNG"]
    assert files.store(found, str(tmp_path / "kept")).count() == 2
    stream = files.ingest_stream(spark, str(tmp_path)).select("path").writeStream.format("memory").queryName("arrived").trigger(availableNow=True).start()
    stream.awaitTermination()
    assert spark.table("arrived").count() == 2
    saved = files.save(logs, spark.createDataFrame([(4, 3, "S100", None, "b"), (5, 3, "P100", 4, "b")], LOG), str(tmp_path / "v2"))
    assert {r.id: r.status for r in saved.collect()} == {1: "E100", 2: "E100", 3: "S100", 4: "S100", 5: "P100"}
    assert files.preview(saved, 5)["original_log_id"] == 4 and files.preview(saved, 6) is None
    files.export_csv(logs, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 4
    books = files.workbooks(logs.coalesce(1), rows_each=3).collect()
    assert len(books) == 2
    with zipfile.ZipFile(io.BytesIO(bytes(books[0].content))) as z:
        assert z.testzip() is None and z.read("xl/worksheets/sheet1.xml").count(b"<row>") == 4


def test_previous_keeps_rows_without_an_order(spark):
    rows = spark.createDataFrame([("k", 3), ("k", None), (None, 1), (None, 2**62), ("k", -(2**62))], "k string, n long")
    got = sorted(((r.k, r.n, r.before) for r in history.previous(rows, "k", "n", each=1).collect()), key=repr)
    assert got == sorted([("k", 3, -(2**62)), ("k", None, None), (None, 1, None), (None, 2**62, 1), ("k", -(2**62), None)], key=repr)
    assert history.previous(rows.limit(0), "k", "n").columns == ["k", "n", "before"]


def test_only_editors_save_models(spark, tmp_path):
    from quillrun.sources import derived, files
    from quillrun.schemas import ExtractionModel, Field

    path, model = str(tmp_path / "models"), ExtractionModel("m", (Field("a", "A"),))
    with pytest.raises(PermissionError):
        files.save_model(derived.members(spark), 5, model, path)
    files.save_model(derived.members(spark), 2, model, path)
    files.save_model(derived.members(spark), 1, ExtractionModel("n", ()), path)
    assert [(r.model_name, r.key) for r in files.read_models(spark, path).collect()] == [("m", "a")]


def test_workbooks_go_there_and_back(spark, tmp_path):
    from quillrun.sources import workbook

    rows = spark.createDataFrame([(i, f"<a & {i}>" if i % 3 else None, i / 4) for i in range(50)], "n long, t string, x double").repartition(3)
    workbook.export_workbooks(rows, str(tmp_path / "books"), rows_each=10)
    got = workbook.read_workbooks(spark, f"file://{tmp_path}/books")
    assert sorted((int(r.n), r.t, float(r.x)) for r in got.collect()) == sorted((r.n, r.t, r.x) for r in rows.collect())
    names = [p.name for p in (tmp_path / "books").iterdir()]
    assert len(names) >= 5 and all(n.endswith(".xlsx") for n in names)


def test_workbooks_keep_whole_values(spark, tmp_path):
    from quillrun.sources import workbook

    texts = ["\x01 a\x0bb \uffff", "_x0041_", "_x0041\x01", "__x005F_x0001_x0002_", "a\r\nb\rc\n", "", None, " <&>\"' ", "x" * 32_767, "\U0001f600" * 40_000, "_x000D_\r" * 9_000, "y" * 100_000]
    rows = spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate(zip(texts, [0.5, float("nan"), float("inf"), -1e300] * 3))], "n long, `t\x02` string, x double")
    rows = rows.withColumn("big", F.lit(2**60 + 1)).repartition(2)
    workbook.export_workbooks(rows, str(tmp_path / "books"))
    got = workbook.read_workbooks(spark, str(tmp_path / "books"))
    assert got.columns == rows.columns
    assert {int(r[0]): r[1] for r in got.collect()} == dict(enumerate(texts))
    assert {r.big for r in got.collect()} == {str(2**60 + 1)} and {r.x for r in got.collect()} == {"0.5", "nan", "inf", "-1e+300"}
    for book in (tmp_path / "books").iterdir():
        with zipfile.ZipFile(book) as z:
            for n in (n for n in z.namelist() if "sheets/sheet" in n):
                cells = ("".join(c.itertext()) for c in ElementTree.fromstring(z.read(n)).iter(f"{workbook.MAIN}c"))
                assert all(len(c.encode("utf-16-le")) <= 2 * workbook.CELL for c in cells)


def test_workbooks_refuse_what_a_sheet_cannot_hold(spark, tmp_path):
    from quillrun.sources import workbook

    for each in (0, workbook.MOST_ROWS):
        with pytest.raises(Exception, match="rows_each"):
            workbook.export_workbooks(spark.range(3), str(tmp_path / "books"), rows_each=each)
    with pytest.raises(ValueError, match="columns at most"):
        workbook.sheet([f"c{i}" for i in range(workbook.MOST_COLUMNS + 1)], [])


def test_a_commit_sweeps_what_lost_tasks_left(tmp_path):
    from quillrun.sources import workbook

    writer = workbook.Writer(str(tmp_path), ["a"], 2)
    lost = writer.write(iter([(1,), (2,), (3,)]))
    kept = writer.write(iter([(1,), (2,), (3,)]))
    (tmp_path / ".other-1.part").write_bytes(b"")
    assert len(lost.files) == len(kept.files) == 2
    writer.commit([kept])
    names = sorted(p.name for p in tmp_path.iterdir())
    assert names[0] == ".other-1.part" and len(names) == 3 and all(n.endswith(".xlsx") for n in names[1:])


def test_models_are_drafted_and_read_again(spark, tmp_path):
    from quillrun.operators import extract
    from quillrun.sources import files

    rows = [("m/1", "b", "1"), ("m/1", "b", "-2.5"), ("m/1", "a", "x"), ("m/1", "a", "3"), ("n", "a", None), (None, "a", "1"), ("n", None, None)]
    models = extract.drafted(spark.createDataFrame(rows, "model_name string, key string, value string"))
    for _ in range(2):  # saved again, a model replaces its file
        assert files.save_models(models, str(tmp_path / "models")) == 2
    got = files.read_models(spark, str(tmp_path / "models"))
    assert sorted((r.model_name, r.pos, r.key, r.label, r.type) for r in got.collect()) == [("m/1", 0, "a", "A", "string"), ("m/1", 1, "b", "B", "number"), ("n", 0, "a", "A", "string")]


def test_members_are_read_once_each(spark, tmp_path):
    from quillrun.sources import files

    spark.createDataFrame([(1, "x"), (1, "x"), (None, "x"), (2, None)], "user_id long, role string").write.json(str(tmp_path / "m"))
    assert [tuple(r) for r in files.read_members(spark, str(tmp_path / "m")).collect()] == [(1, "x")]


def test_polls_end_by_time(spark):
    rows = [("a", s, s, "poll") for s in (0, 100, 299, 300)] + [("b", 0, 0, "poll"), ("c", 0, 0, "error"), ("c", 1, 1, "error"), ("c", 2, 2, "error"), ("c", 900, 3, "poll")]
    polls = spark.createDataFrame(rows, "job string, ts long, seq long, kind string").withColumn("ts", F.col("ts").cast("timestamp"))
    got = {r.job: (r.attempts, r.outcome) for r in lifecycle.timed_polls(polls).collect()}
    assert got == {"a": (3, "timeout"), "b": (1, "open"), "c": (3, "stopped")}


def test_job_keeps_failed_files(spark):
    from quillrun.operators import jobs
    from quillrun.schemas import ExtractionModel, Field

    files = spark.createDataFrame([(1, "a.pdf", bytearray(b"ab 12|cd 34")), (2, "b.pdf", bytearray(b"\xff")), (3, "c.txt", bytearray(b"x"))], "doc_id long, path string, content binary")
    own, failures = jobs.recognised(files, lambda c: c.decode("ascii").split("|"))
    provider = lambda texts: [([("n", t.split()[1]), ("w", t.split()[0])], None) for t in texts]
    logs = jobs.run(own, ExtractionModel("m", (Field("n", "N"),)), provider, F.lit(0), "2024-01-01T00:00:00Z", failures).collect()
    got = {r.doc_id: r for r in logs}
    assert {d: (r.status, (r.error or "").split(":")[0]) for d, r in got.items()} == {1: ("S100", ""), 2: ("E100", "UnicodeDecodeError"), 3: ("E100", "unsupported file")}
    sub = got[1].preview_data.sub_documents[0]
    assert sub.page_ranges == [1, 2] and sub.data.guide_extracted["n"].asDict() == {"value": "12", "page": 1, "offset": 4} and sub.data.other_data[0].toPython() == {"page": 1, "key": "w", "value": "ab"}
