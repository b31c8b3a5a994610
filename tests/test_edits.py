"""Users' edits in nested previews."""

import pytest
from pyspark.sql import functions as F

from quillrun.operators import edits, jobs
from quillrun.schemas import ExtractionModel, Field

NOW = "2024-02-01T00:00:00Z"
MODEL = ExtractionModel("m", (Field("n", "N"),))
EDITS_DDL = "doc_id long, index int, key string, value string, edited_at long, seq long"


@pytest.fixture(scope="module")
def logs(spark):
    """Document 1 has two sub-documents, 2 failed, 3 found nothing."""
    own = spark.createDataFrame([(1, 0, "ab 12"), (1, 1, "#cd 34"), (2, 0, "bad 1"), (3, 0, "")], "doc_id long, page int, text string")
    provider = lambda texts: [([("w", t.split()[0]), ("n", t.split()[1])] if t.split() else [], "bad" if "bad" in t else None) for t in texts]
    return jobs.run(own, MODEL, provider, F.when(F.col("text").startswith("#"), 1).otherwise(0), "2024-01-01T00:00:00Z", max_tokens=2).cache()


def _edited(spark, logs, rows):
    return {r.doc_id: r for r in edits.apply(logs, spark.createDataFrame(rows, EDITS_DDL), MODEL, NOW).collect()}


def test_edits_are_written_back(spark, logs):
    rows = [
        (1, 0, "n", "old", 1, 1), (1, 0, "n", "13", 2, 1), (1, 1, "w", None, 1, 1), (1, 1, "z", "new", 1, 1),
        (2, 0, "n", "9", 1, 1), (3, 7, "n", "9", 1, 1), (9, 0, "n", "9", 1, 1), (None, 0, "n", "9", 1, 1), (1, None, "n", "9", 1, 1), (1, 0, None, "9", 1, 1),
    ]
    got = _edited(spark, logs, rows)
    assert {d: (r.status, r.updated_at) for d, r in got.items()} == {1: ("S200", NOW), 2: ("E100", "2024-01-01T00:00:00Z"), 3: ("S100", "2024-01-01T00:00:00Z")}
    first, second = got[1].preview_data.sub_documents
    assert first.data.guide_extracted["n"].asDict() == {"value": "13", "page": 1, "offset": 4}
    assert [o.toPython() for o in first.data.other_data] == [{"page": 1, "key": "w", "value": "ab"}]
    assert second.data.guide_extracted["n"].value == "34"
    assert [o.toPython() for o in second.data.other_data] == [{"page": 2, "key": "w"}, {"key": "z", "value": "new"}]
    assert got[1].extracted_data.toPython() == {"n": "13", "w": "ab", "z": "new"}


def test_a_cleared_key_falls_to_the_next_sub_document(spark, logs):
    got = _edited(spark, logs, [(1, 0, "n", None, 1, 1), (1, 0, "w", None, 1, 1), (1, 1, "w", None, 1, 1)])
    assert got[1].extracted_data.toPython() == {"n": "34"}


def test_new_fields_have_no_place(spark, logs):
    got = _edited(spark, logs, [(3, 0, "n", "1", 1, 1)])[3]
    assert got.preview_data.sub_documents[0].data.guide_extracted["n"].asDict() == {"value": "1", "page": None, "offset": None}
    assert got.extracted_data.toPython() == {"n": "1"} and got.status == "S200"


def test_edits_that_tie_and_repeat(spark, logs):
    rows = [(1, 0, "n", "a", 1, 1), (1, 0, "n", "b", 1, 1), (1, 0, "n", "b", 1, 1)]
    assert _edited(spark, logs, rows)[1].preview_data.sub_documents[0].data.guide_extracted["n"].value == "b"


def test_no_edits_change_nothing(spark, logs):
    got = {d: (r.status, repr(r.preview_data), r.updated_at) for d, r in _edited(spark, logs, []).items()}
    assert got == {r.doc_id: (r.status, repr(r.preview_data), r.updated_at) for r in logs.collect()}
    assert edits.apply(logs.limit(0), spark.createDataFrame([(1, 0, "n", "a", 1, 1)], EDITS_DDL), MODEL, NOW).count() == 0


def test_rejected_edits_say_why(spark, logs):
    rows = [(1, 0, "n", "a", 1, 1), (1, 0, None, "a", 1, 2), (9, 0, "n", "a", 1, 3), (2, 0, "n", "a", 1, 4), (1, 5, "n", "a", 1, 5)]
    got = edits.rejected(logs, spark.createDataFrame(rows, EDITS_DDL))
    assert {r.seq: r.reason for r in got.collect()} == {2: "no field", 3: "no log", 4: "not finished", 5: "no sub-document"}


@pytest.mark.parametrize("each", [1_000_000, 3])
def test_trail_of_a_field_with_most_edits(spark, logs, each):
    rows = [(1, 0, "n", None if i == 5 else str(i), i // 2, i) for i in range(20)] + [(1, 1, "w", "x", 3, 50), (1, 1, "z", "y", 3, 51)]
    got = {r.seq: r.before for r in edits.trail(logs, spark.createDataFrame(rows, EDITS_DDL), each).collect()}
    assert got == {0: "12", **{i: None if i == 6 else str(i - 1) for i in range(1, 20)}, 50: "#cd", 51: None}


def test_trail_computes_the_logs_once(spark, logs):
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(status):
        read.add(1)
        return status

    rows = spark.createDataFrame([(1, 0, "n", str(i), i, i) for i in range(20)], EDITS_DDL)
    assert len(edits.trail(logs.withColumn("status", counted("status")), rows, 3).collect()) == 20
    assert read.value <= logs.count()


def test_fields_carry_columns_of_their_logs(logs):
    got = {(r.doc_id, r["index"], r.key, r.status) for r in jobs.fields_of(logs, "status").collect()}
    assert got == {(1, 0, "n", "S100"), (1, 1, "n", "S100"), (2, 0, "n", "E100")}
    assert {(r.doc_id, r.key, r.status) for r in jobs.others_of(logs, "status").collect()} == {(1, "w", "S100"), (2, "w", "E100")}


def test_values_are_not_read_back_from_written_open_data(spark, logs):
    rows = spark.createDataFrame([(1, 0, "z", "new", 1, 1)], EDITS_DDL)
    plan = edits.apply(logs, rows, MODEL, NOW).select("doc_id", "extracted_data")._jdf.queryExecution().optimizedPlan().toString().split("InMemoryRelation")[0]
    assert plan.count("parseJson") == 1  # of extracted_data alone


def test_null_entries_of_open_data_stay(spark, logs):
    data = "transform(preview_data.sub_documents, s -> struct(s.index AS index, s.page_ranges AS page_ranges, struct(s.data.guide_extracted AS guide_extracted, array(null, parse_json('{\"key\":\"w\",\"value\":\"q\",\"more\":1}')) AS other_data) AS data))"
    own = logs.withColumn("preview_data", F.struct(F.expr(data).alias("sub_documents")))
    for key, want in (("z", [None, {"key": "w", "value": "q", "more": 1}, {"key": "z", "value": "e"}]), ("w", [None, {"key": "w", "value": "e"}])):
        got = _edited(spark, own, [(1, 0, key, "e", 1, 1)])[1].preview_data.sub_documents[0].data.other_data
        assert [o if o is None else o.toPython() for o in got] == want


def test_rejecting_edits_moves_no_values(spark, logs, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    joined, join = [], DataFrame.join
    monkeypatch.setattr(DataFrame, "join", lambda self, other, *a, **k: (joined.append(other.schema.simpleString()), join(self, other, *a, **k))[1])
    got = edits.rejected(logs, spark.createDataFrame([(2, 0, "n", "a", 1, 1), (1, 9, "n", "a", 1, 1), (1, 0, "n", "a", 1, 1)], EDITS_DDL))
    assert {(r.doc_id, r.reason) for r in got.collect()} == {(2, "not finished"), (1, "no sub-document")} and got.columns == [*EDITS_DDL.replace(" long", "").replace(" int", "").replace(" string", "").split(", "), "reason"]
    assert joined and not [s for s in joined if "guide_extracted" in s]
