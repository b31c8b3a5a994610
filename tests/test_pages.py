import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillrun.operators import extract, pages

texts = st.lists(st.text(alphabet="ab\n é", max_size=60), min_size=1, max_size=8)


def docs_of(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "doc_id long, text string")


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(texts)
def test_pages_rejoin(spark, values):
    got = {r.doc_id: r.text for r in pages.rejoin(pages.paginate(docs_of(spark, values), lines=2)).collect()}
    assert got == dict(enumerate(values))


def test_null_and_overlap(spark):
    got = pages.paginate(docs_of(spark, [None, "a\nb\nc"]), lines=2, overlap=1).orderBy("doc_id", "page").collect()
    assert [(r.doc_id, r.page, r.text) for r in got] == [(0, 0, ""), (1, 0, "a\nb"), (1, 1, "b\nc")]


@pytest.mark.parametrize("length,mode", [(1999, "single"), (2000, "single"), (2001, "chunked")])
def test_switch_at_the_limit(spark, length, mode):
    assert pages.plan(docs_of(spark, ["x" * length])).first().mode == mode


def test_packing_is_greedy_and_flags_large_pages(spark):
    sizes = [10, 10, 30, 5, 5, 5]
    rows = spark.createDataFrame([(0, i, "x" * 4 * n) for i, n in enumerate(sizes)], "doc_id long, page int, text string")
    got = pages.pack(rows, max_tokens=20).orderBy("page").collect()
    assert [(r.chunk_id, r.oversized) for r in got] == [(0, False), (0, False), (1, True), (2, False), (2, False), (2, False)]
    whole = pages.chunks(rows, pages.pack(rows, max_tokens=20)).orderBy("chunk_id").collect()
    assert [(r.page_from, r.page_to, r.est_tokens) for r in whole] == [(0, 1, 20), (2, 2, 30), (3, 5, 15)]


@pytest.mark.parametrize("each", [1, 3, 10_000])
def test_chunks_in_one_pass_are_those_of_the_packing(spark, each):
    rows = [(d, p, "é" * ((7 * d + 13 * p) % 90), p % 2) for d in range(9) for p in range(d % 5 * 4 + 1)]
    rows += [(20, 0, None, 0), (20, 1, "a", 1), (20, 2, None, 0), (21, 0, None, 1), (22, 5, "x" * 400, 0), (None, 0, "no document", 0)]
    own = spark.createDataFrame(rows[::-1], "doc_id long, page int, text string, class int")
    want = pages.chunks(own, pages.pack(own, 20)).orderBy("doc_id", "chunk_id").select("doc_id", "chunk_id", "page_from", "text").collect()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", each)
    try:
        got = pages.chunked(own, 20).orderBy("doc_id", "chunk_id").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [(r.doc_id, r.chunk_id, r.page_from, r.text) for r in got] == [tuple(r) for r in want]
    laid = [(r.doc_id, p, n, k) for r in got for p, n, k in zip(r.pages, r.lengths, r.classes)]
    assert laid == sorted((d, p, None if t is None else len(t), k) for d, p, t, k in rows if d is not None)
    assert pages.chunked(own.limit(0), 20).count() == 0


def test_a_value_lies_on_the_first_page_that_has_it_whole():
    text, own, lengths = "ab\ncab\n\néab", [4, 5, 6, 7, 8], [2, -1, 3, 0, 3]
    found = [pages.place(text, own, lengths, v) for v in ("ab", "cab", "b\nc", "éab", "", "none")]
    assert found == [(4, 1), (6, 1), (4, 0), (8, 1), (4, 1), (4, 0)]


def test_every_page_in_one_sub_document(spark):
    rows = spark.createDataFrame([(0, i, t) for i, t in enumerate("a###|a|a|###|###".split("|"))], "doc_id long, page int, text string")
    got = pages.segment(rows, F.col("text").contains("###").cast("int")).orderBy("index").collect()
    assert [(r["index"], r["class"], r.page_ranges) for r in got] == [(0, 1, [1]), (1, 0, [2, 3]), (2, 1, [4, 5])]


def test_chunked_equals_whole(spark):
    own = docs_of(spark, ["one\ntwo abcdefghijklmnop\nthree\nqrstuvwxyzabcdef\n" * 4, "nothing", None])
    rule = {"long_word": extract.RULES["long_word"]}
    by_page = extract.merge(extract.extract_by_rules(pages.paginate(own, lines=1), rule)).select("doc_id", "value")
    whole = own.select("doc_id", F.regexp_extract("text", rule["long_word"], 0).alias("value")).where("value <> ''")
    assert by_page.exceptAll(whole).count() == 0 == whole.exceptAll(by_page).count()


def test_merge_takes_the_first_value_in_any_order(spark):
    rows = [(1, 2, "k", "late"), (1, 0, "k", None), (1, 1, "k", "first"), (1, 0, "other", "x")]
    for order in (rows, rows[::-1]):
        got = extract.merge(spark.createDataFrame(order, "doc_id long, page int, key string, value string")).collect()
        assert {(r.key, r.value, r.page) for r in got} == {("k", "first", 2), ("other", "x", 1)}


def test_a_failing_provider_gives_errors_not_a_failed_job(spark):
    def provider(texts):
        raise TimeoutError("no answer")

    chunks = spark.createDataFrame([(1, 0, 0, "x"), (2, 0, 0, "y")], "doc_id long, chunk_id int, page_from int, text string")
    got = extract.outcome(extract.extract(chunks, provider)).collect()
    assert {(r.doc_id, r.status, r.error) for r in got} == {(1, "E100", "TimeoutError: no answer"), (2, "E100", "TimeoutError: no answer")}


def test_the_provider_stage_has_as_many_tasks_as_calls_in_flight(spark):
    chunks = spark.range(40).selectExpr("id doc_id", "0 chunk_id", "0 page_from", "'x' text")
    assert extract.extract(chunks, lambda ts: [([], None)] * len(ts), max_in_flight=3).rdd.getNumPartitions() == 3


def test_recognise(spark):
    files = spark.createDataFrame([("a.pdf", bytearray(b"one|two")), ("b.pdf", bytearray(b"\xff")), ("c.pdf", bytearray(b"=x"))], "path string, content binary")

    def provider(content):
        text = content.decode("ascii")
        return [{"text": text, "tables": [[["1", "2"], ["3"]]], "layout": [("title", "x")]}] if text[0] == "=" else text.split("|")

    got = {(r.path, r.page): r for r in extract.recognise(files, provider).collect()}
    assert got["a.pdf", 1].text == "two" and got["a.pdf", 0].tables == [] and got["b.pdf", 0].error.startswith("UnicodeDecodeError")
    assert got["c.pdf", 0].tables == [[["1", "2"], ["3"]]] and got["c.pdf", 0].layout[0].kind == "title"


def test_no_text_is_lost_by_its_provider(spark):
    chunks = spark.createDataFrame([(i, 0, 0, t) for i, t in enumerate(["a", "bad", "", "b", "few"])], "doc_id long, chunk_id int, page_from int, text string")

    def provider(texts):
        if "bad" in texts:
            raise ValueError("bad")
        return [([("k", t)], None) if t else ([], None) for t in texts if t != "few"]

    got = {r.doc_id: (r.status, r.error) for r in extract.outcome(extract.extract(chunks, provider, 1)).collect()}
    assert got == {0: ("S100", None), 1: ("E100", "ValueError: bad"), 2: ("S100", None), 3: ("S100", None), 4: ("E100", "0 answers to 1 texts")}


def test_mentions_of_any_length(spark):
    texts = ["the quick brown fox jumps over the lazy dog", "quick brown", "aquick brownie", "", None, "a b  c d", "x"]
    items = ["quick brown fox jumps over the lazy d", "uick brow", "brown", "ick brown fo", "b  c", "", None, "a b  c d", " ", "nowhere at all here"]
    docs = spark.createDataFrame([*enumerate(texts), (None, "quick brown")], "doc_id long, text string")
    got = {(r.item_id, r.doc_id, r.offset) for r in extract.mentions(spark.createDataFrame(list(enumerate(items)), "item_id long, text string"), docs).collect()}
    assert got == {(i, d, t.index(x) + 1) for i, x in enumerate(items) if x for d, t in enumerate(texts) if t and x in t}


def test_html_tables(spark):
    html = "<table><tr><th>a</th><td> b <b>c</b></td></tr><tr><td>d</td></tr></table><p>no</p><TABLE class=x><tr ><td>e</td></tr></TABLE>"
    rows = extract.html_tables(spark.createDataFrame([(1, html), (2, None)], "page_id long, html string")).collect()
    assert [(r.page_id, r.table, r.row, r.cells) for r in rows] == [(1, 0, 0, ["a", "b c"]), (1, 0, 1, ["d"]), (1, 1, 0, ["e"])]


def test_tasks_of_a_provider_read_no_more_where_there_is_more_text(spark):
    chunks = spark.range(300).selectExpr("if(id = 7, null, id + (1L << 60)) doc_id", "0 chunk_id", "0 page_from", "if(id = 9, null, repeat('x', 10)) text")

    def provider(texts):
        from pyspark import TaskContext

        return [([("task", str(TaskContext.get().taskAttemptId())), ("text", t or "none")], None) for t in texts]

    got = extract.extract(chunks, provider, max_in_flight=2, per_task=250, per_file=25).collect()
    tasks = [r.value for r in got if r.key == "task"]
    assert max(map(tasks.count, tasks)) < 50 and len(set(tasks)) >= 12
    assert {r.doc_id for r in got} == {None if i == 7 else i + (1 << 60) for i in range(300)} and len(got) == 600
    assert extract.extract(chunks.limit(0), provider).count() == 0


def test_packing_takes_time_by_the_pages(spark):
    import time

    import numpy as np

    sizes, start = np.arange(200_000) % 3 * 250, time.process_time()
    ids = [pages.packed_greedily(sizes[i : i + 2], 500) for i in range(0, len(sizes), 2)]
    assert time.process_time() - start < 1 and ids[1].tolist() == [0, 0] and ids[2].tolist() == [0, 1]


def test_hints_leave_no_match_out():
    from quillrun.plans import catalog

    texts = ["", "é٣٤ a@b.co", "1.2.3.4", "x 1.22.333.4444 y@", "1..2", "12", "1 2 3", "abcdefghijklmnop", "@.1.", "### 7", "a@b"]
    slow = [[(k, m.group()) for k, p in extract.RULES.items() if (m := re.search(p, t))] for t in texts]
    assert [values for values, _ in catalog._by_pattern(texts)] == slow


@pytest.fixture(scope="module")
def job(spark):
    from quillrun.operators import jobs
    from quillrun.schemas import ExtractionModel, Field

    own = spark.createDataFrame([(1, 0, "ab 12"), (1, 1, "#cd 34"), (1, 2, "x\ncd 12"), (2, 0, "bad 1"), (3, 0, ""), (4, 0, None), (4, 1, "é 7")], "doc_id long, page int, text string")
    provider = lambda texts: [([(k, v) for k, v in zip("wn", t.split())] + [("end", t[-4:])] if t else [], "bad" if "bad" in t else None) for t in texts]
    kind = F.when(F.col("text").startswith("#"), 1).otherwise(0)
    return lambda **more: jobs.run(own, ExtractionModel("m", (Field("n", "N"), Field("end", "E"))), provider, kind, "2024-01-01T00:00:00Z", max_tokens=4, **more)


def test_texts_of_a_job_move_once(job, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    joined, join = [], DataFrame.join
    monkeypatch.setattr(DataFrame, "join", lambda self, other, *a, **k: (joined.append({*self.columns, *other.columns}), join(self, other, *a, **k))[1])
    assert job().count() == 4
    assert joined and not [c for c in joined if "text" in c]


def test_a_job_with_a_ledger_gives_the_same_logs(job, tmp_path):
    def told(logs):
        return sorted(repr((r.doc_id, r.status, r.error, r.preview_data and r.preview_data.asDict(True), r.x)) for r in logs.withColumn("x", F.to_json("extracted_data")).drop("extracted_data").withColumn("preview_data", F.col("preview_data").cast(plain)).collect())

    plain = "struct<sub_documents:array<struct<index:int,page_ranges:array<int>,data:struct<guide_extracted:map<string,struct<value:string,page:int,offset:int>>,other_data:array<string>>>>>"
    want = told(job())
    assert told(job(answers_at=str(tmp_path))) == want and len(want) == 4 and sum("'offset': 4" in w for w in want) == 1


def test_many_files_of_texts_are_read_without_a_shuffle(spark):
    texts = extract.listed(spark.range(90).repartition(3).selectExpr("id doc_id", "0 chunk_id", "0 page_from", "repeat('x', 10) text"), per_file=5)
    (files,) = extract._waves(texts, 10_000)
    for tasks, shuffled in ((2, False), (4, False), (5, True)):
        dealt = extract._dealt(texts, files, tasks)
        sizes = dealt.rdd.glom().map(len).collect()
        assert sum(sizes) == 90 and len(sizes) == tasks and max(sizes) <= 1.5 * 90 / tasks and ("Exchange" in dealt._jdf.queryExecution().executedPlan().toString()) == shuffled
