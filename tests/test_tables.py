"""Table grids, detected sub-documents, upserts of touched buckets, files stored once."""

import glob
import itertools
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillrun.operators import grids, pages
from quillrun.plans import catalog
from quillrun.sources import files, workbook
from quillrun.sources.shared import folder


def test_grids():
    read = lambda html: [(t, p, ["|".join(r) for r in g]) for t, p, g in grids.read_grids(html)]
    assert read("<table><tr><td>a<td>b<tr><td colspan=2>c</table>") == [(0, None, ["a|b", "c|c"])]
    assert read("<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td>d<td>e</table>") == [(0, None, ["a|b", "a|c", "d|e"])]
    assert read("<table><tr><td rowspan=0>a<td>b<tr><td>c<tr><td>d</table>") == [(0, None, ["a|b", "a|c", "a|d"])]
    assert read("<table><tr><td>a<td rowspan=2>b<tr><td>c</table>") == [(0, None, ["a|b", "c|b"])]
    nested = "<table><tr><td>x <table><tr><td>in</td></tr></table> y</td><td>z</td></tr></table><table><tr><th>2</table>"
    assert read(nested) == [(0, None, ["x y|z"]), (1, 0, ["in"]), (2, None, ["2"])]
    assert read("<TABLE><TR><TD COLSPAN='x'>A &lt; B<script>no</script></TD>") == [(0, None, ["A < B"])]
    assert read("<table></table><td>lost") == [(0, None, [])] and read("no table") == [] and read("") == []
    assert len(read("<table><tr><td colspan=99999999>w</table>")[0][2][0].split("|")) == grids.MOST_COLUMNS


def test_grids_of_awkward_pages(spark):
    df = spark.createDataFrame([(1, None), (None, "<table><tr><td>a"), (2, ""), (3, "<table><tr><td>a<td>b")], "page_id long, html string").withColumn("table", F.lit("clash"))
    assert [tuple(r) for r in grids.html_grids(df).collect()] == [(3, 0, None, 0, ["a", "b"])]


def test_cuts_are_the_best():
    rng = random.Random(4)
    for _ in range(150):
        unlike, least = [rng.randint(900, 1000) for _ in range(rng.randint(0, 9))], rng.randint(1, 3)
        n = len(unlike) + 1

        def gain(cuts):
            edges = [0, *(i + 1 for i in cuts), n]
            return sum(unlike[i] - 950 for i in cuts) if all(b - a >= least for a, b in zip(edges, edges[1:])) or not cuts else -1

        most = max(gain(c) for k in range(n) for c in itertools.combinations(range(len(unlike)), k))
        assert gain(np.flatnonzero(pages.best_cuts(np.array(unlike), 950, least)).tolist()) == most


def test_detected_sub_documents(spark):
    a, b = "red green blue\n" * 10, "one two three\n" * 15
    docs = spark.createDataFrame([(1, a + b + a), (2, a), (3, ""), (4, None)], "doc_id long, text string")
    got = sorted((r.doc_id, r["index"], r.page_ranges) for r in pages.detect(pages.paginate(docs)).collect())
    assert got == [(1, 0, [1, 2]), (1, 1, [3, 4, 5]), (1, 2, [6, 7, 8]), (2, 0, [1, 2, 3]), (3, 0, [1]), (4, 0, [1])]


def test_only_touched_buckets_are_written(spark, tmp_path):
    path, ddl = str(tmp_path / "t"), "id long, v string"
    files.save_in_buckets(spark.range(2000).select("id", F.lit("old").alias("v")), path, buckets=200)
    before = {f: os.path.getmtime(f) for f in glob.glob(f"{path}/bucket=*/*.parquet")}
    assert len(before) == 200
    new = spark.createDataFrame([(7, "new"), (5000, "new")], ddl)
    assert files.upsert_buckets(new, path, ddl, buckets=200) <= 2
    after = {f: os.path.getmtime(f) for f in glob.glob(f"{path}/bucket=*/*.parquet")}
    assert sum(after.get(f) == t for f, t in before.items()) >= 198  # one part in a hundred is written
    rows = {r.id: r.v for r in spark.read.schema(ddl).parquet(path).collect()}
    assert len(rows) == 2001 and sorted(i for i, v in rows.items() if v == "new") == [7, 5000]
    assert files.upsert_buckets(new.limit(0), path, ddl, buckets=200) == 0 and spark.read.parquet(path).count() == 2001


def test_contents_are_stored_once(spark, tmp_path):
    lot = lambda *rows: files.write_files(spark.createDataFrame([(n, bytearray(c)) for n, c in rows], "name string, content binary"), str(tmp_path / "in"))
    run = lambda: sorted((r.length, bytes(r.content), os.path.basename(r.file_url)) for r in files.ingest_once(files.ingest_stream(spark, str(tmp_path / "in"), 2), str(tmp_path / "out")).collect())
    (tmp_path / "in").mkdir()
    assert run() == []
    assert lot(("a.pdf", b"one"), ("b.pdf", b"one"), ("c.png", b"two"), ("d.txt", b"no")) == 4
    first = run()
    assert [(n, c) for n, c, _ in first] == [(3, b"one"), (3, b"two")]
    assert run() == first  # a restart with nothing new
    lot(("e.pdf", b"two"), ("f.pdf", b"three"), ("g.pdf", b""))
    assert [(n, c) for n, c, _ in run()] == [(3, b"one"), (3, b"two"), (5, b"three")]  # Spark reads no empty files


def test_many_small_files_make_one_batch(spark, tmp_path):
    rows = spark.range(1200).select(F.concat(F.lit("f"), F.col("id").cast("string"), F.lit(".pdf")).alias("name"), (F.col("id") % 1100).cast("string").cast("binary").alias("content"))
    files.write_files(rows, str(tmp_path / "in"))
    got = files.ingest_once(files.ingest_stream(spark, str(tmp_path / "in")), str(tmp_path))
    assert got.count() == got.select("hash").distinct().count() == 1100
    assert [p.name for p in (tmp_path / "store").iterdir() if p.name.startswith("batch=")] == ["batch=0"]


def test_the_driver_of_an_ingest_keeps_no_names_of_files(spark):
    root = folder(spark).removeprefix("file:")
    before = set(glob.glob(f"{root}/ingest-*"))
    n = catalog.QUERIES["t06_ingest_once"](spark, "/root/testdata/sf0.001").agg({"n_files": "sum"}).first()[0]
    (path,) = set(glob.glob(f"{root}/ingest-*")) - before
    noted = [line for log in glob.glob(f"{path}/state/sources/0/[0-9]*") for line in open(log) if line.startswith("{")]
    assert len(glob.glob(f"{path}/in/*/*.pdf")) == 2 * n >= 300 and len(noted) == 2  # a part of the list for each lot


def test_listed_files_are_read_once_each(spark, tmp_path):
    into, listed = tmp_path / "in", str(tmp_path / "listed")
    lot = lambda **rows: [(into / n).parent.mkdir(parents=True, exist_ok=True) or (into / n).write_bytes(c) for n, c in rows.items()]
    seen = lambda: sorted((r.path.removeprefix(f"{into}/"), r.length) for r in spark.read.parquet(listed).collect())

    def run():
        stream = files.listed_stream(spark, str(into), listed)
        return sorted((r.length, bytes(r.content)) for r in files.ingest_once(stream, str(tmp_path / "out")).collect())

    into.mkdir()
    assert files.list_new(spark, f"{into}/", listed) == 0 and run() == []
    lot(**{"a.pdf": b"one", "x/b %41#é?.PDF": b"one", "x/y/z/c.webp": b"two", "d.txt": b"no", "x/.e.pdf": b"no", "_f/g.pdf": b"no", "h.pdf": b"", "i.pdf/j.tiff": b"six"})
    assert files.list_new(spark, str(into), listed) == 4
    assert seen() == [("a.pdf", 3), ("i.pdf/j.tiff", 3), ("x/b %41#é?.PDF", 3), ("x/y/z/c.webp", 3)]
    first = run()
    assert first == [(3, b"one"), (3, b"six"), (3, b"two")]
    assert files.list_new(spark, str(into), listed) == 0 and run() == first  # nothing new
    lot(**{"a.pdf": b"other", "x/k.pdf": b"two", "w/l.png": b"three", "h.pdf": b"four!"})  # a path counts once, an empty file once it has content
    assert files.list_new(spark, str(into), listed) == 3
    assert run() == sorted([*first, (5, b"three"), (5, b"four!")])
    found = files.listed_stream(spark, str(into), listed).writeStream.format("memory").queryName("listed").trigger(availableNow=True).start()
    found.awaitTermination()
    rows = spark.table("listed").collect()
    assert len(rows) == 7 and all(r.modificationTime.timestamp() == pytest.approx(os.path.getmtime(r.path), abs=1e-3) for r in rows if not r.path.endswith("a.pdf"))


def test_parts_of_a_list_cut_a_stream_into_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "PART_FILES", 10)
    rows = spark.range(60).select(F.concat(F.col("id") % 7, F.lit("/f"), F.col("id"), F.lit(".pdf")).alias("name"), (F.col("id") % 25).cast("string").cast("binary").alias("content"))
    files.write_files(rows, str(tmp_path / "in"))
    assert files.list_new(spark, str(tmp_path / "in"), str(tmp_path / "listed")) == 60
    got = files.ingest_once(files.listed_stream(spark, str(tmp_path / "in"), str(tmp_path / "listed"), 2 * files.PART_BYTES), str(tmp_path))
    assert got.count() == got.select("hash").distinct().count() == 25
    assert sorted(p.name for p in (tmp_path / "store").iterdir() if p.name.startswith("batch=")) == ["batch=0", "batch=1", "batch=2"]


def test_a_task_holds_a_few_million_characters_of_a_workbook(spark, tmp_path):
    rows = spark.range(40).select("id", F.repeat(F.lit("wordé "), F.lit(50_000)).alias("text")).coalesce(1)  # 12 million characters
    workbook.export_workbooks(rows, str(tmp_path / "books"))
    assert len(glob.glob(str(tmp_path / "books/*.xlsx"))) == 3
    assert sorted(map(tuple, workbook.read_workbooks(spark, str(tmp_path / "books")).collect())) == sorted(map(tuple, rows.select(F.col("id").cast("string"), "text").collect()))
