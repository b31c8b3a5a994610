"""The ledger of answers, occurrences of many items, packing and ranges."""

import glob
import os
import random
import sys
import time

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from quillrun.operators import extract, history, ledger, pages

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers don't see this module
CHUNK = "doc_id long, chunk_id int, page_from int, text string"


def chunks(spark, texts):
    return spark.createDataFrame([(i, 0, 0, t) for i, t in enumerate(texts)], CHUNK)


class Counting:
    """Notes each text it is asked for and how many calls run at once; fails, or kills its worker, as told."""

    def __init__(self, folder, bad=(), kills_at=None):
        self.folder, self.bad, self.kills_at = str(folder), bad, kills_at
        os.makedirs(self.folder, exist_ok=True)

    def __call__(self, texts):
        own = f"{self.folder}/running-{os.getpid()}-{time.time_ns()}"
        open(own, "w").close()
        with open(f"{self.folder}/most", "a") as f:
            f.write(f"{len(glob.glob(f'{self.folder}/running-*'))}\n")
        with open(f"{self.folder}/asked", "a") as f:
            if self.kills_at and len(self.asked()) >= self.kills_at:
                os._exit(1)
            f.writelines(f"{t}\n" for t in texts)
        time.sleep(0.003)
        os.unlink(own)
        return [([], "unreadable") if t in self.bad else ([("first", t)] if t else [], None) for t in texts]

    def asked(self):
        return open(f"{self.folder}/asked").read().split("\n")[:-1] if os.path.exists(f"{self.folder}/asked") else []

    def most(self):
        return max(map(int, open(f"{self.folder}/most").read().split()))


def test_texts_are_asked_once_and_few_at_a_time(spark, tmp_path):
    texts = [f"t{i}" for i in range(200)] + ["t5", "t5", "", None]
    provider, path = Counting(tmp_path / "calls"), str(tmp_path / "ledger")
    n = ledger.ask(chunks(spark, texts), provider, path, max_in_flight=2, per_task=30, batch=3)
    assert n == 201 and sorted(provider.asked()) == sorted({t or "" for t in texts})
    assert provider.most() <= 2
    got = {r.doc_id: r.value for r in ledger.answers(chunks(spark, texts), path).collect()}
    assert got == {i: t or None for i, t in enumerate(texts)}
    assert ledger.ask(chunks(spark, texts), provider, path) == 0 and len(provider.asked()) == 201
    assert ledger.ask(chunks(spark, texts[:3]), provider, path, question="other") == 3  # another question has other answers
    assert not glob.glob(f"{path}/files/*.json") and not glob.glob(f"{path}/work-*")


def test_only_failed_texts_are_asked_again(spark, tmp_path):
    texts, path = [f"t{i}" for i in range(40)], str(tmp_path / "ledger")
    first, second = Counting(tmp_path / "one", bad=("t3", "t7")), Counting(tmp_path / "two")
    ledger.ask(chunks(spark, texts), first, path)
    got = {r.doc_id: (r.value, r.error) for r in ledger.answers(chunks(spark, texts + ["new"]), path).collect()}
    assert got[3] == (None, "unreadable") and got[4] == ("t4", None) and got[40] == (None, "not asked")
    assert ledger.ask(chunks(spark, texts), second, path) == 2 and sorted(second.asked()) == ["t3", "t7"]
    assert {r.error for r in ledger.answers(chunks(spark, texts), path).collect()} == {None}
    assert ledger.ask(chunks(spark, []), second, path) == 0 and ledger.answers(chunks(spark, []), path).count() == 0


def test_a_killed_task_repeats_no_answered_text(spark, tmp_path):
    texts, path = [f"t{i}" for i in range(60)], str(tmp_path / "ledger")
    dying = Counting(tmp_path / "calls", kills_at=25)
    with pytest.raises(Exception):
        ledger.ask(chunks(spark, texts), dying, path, max_in_flight=1, per_task=100, batch=1)
    answered = len(glob.glob(f"{path}/files/*.json"))
    assert 20 <= answered <= 25
    going = Counting(tmp_path / "calls")
    assert ledger.ask(chunks(spark, texts), going, path, max_in_flight=1, per_task=100, batch=1) == 60 - answered
    asked = going.asked()
    assert len(asked) == len(set(asked)) == 60
    assert ledger.answers(chunks(spark, texts), path).where("value is null").count() == 0


def test_occurrences_equal_brute_force(spark):
    rng = random.Random(9)
    make = lambda n: "".join(rng.choice("abé 漢") for _ in range(n))
    items = [(i, make(rng.randint(1, 4))) for i in range(40)] + [(5, ""), (None, "a"), (41, None)]
    docs = [(i, make(rng.randint(0, 60))) for i in range(50)] + [(None, "aaaa"), (51, None)]
    want = sorted({(i, d, at + 1) for i, t in items if t and i is not None for d, x in docs if x and d is not None for at in range(len(x)) if x.startswith(t, at)})
    its, dcs = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")
    for most in (1 << 24, 10):
        assert sorted(map(tuple, extract.occurrences(its, dcs, most).collect())) == want
    firsts = {}
    for i, d, o in want:
        firsts[i, d] = min(o, firsts.get((i, d), o))
    assert sorted(map(tuple, extract.mentions(its, dcs).collect())) == sorted((i, d, o) for (i, d), o in firsts.items())
    assert extract.occurrences(its.limit(0), dcs).count() == 0


def test_packing_is_greedy_and_linear():
    rng = random.Random(1)
    for _ in range(50):
        sizes = [rng.choice([0, 1, 5, 40, 99, 100, 101, 300]) for _ in range(rng.randint(1, 60))]
        want, total, chunk = [], None, 0
        for t in sizes:
            if total is not None and total + t > 100:
                chunk, total = chunk + 1, 0
            total = (total or 0) + t
            want.append(chunk)
        assert pages.packed_greedily(np.array(sizes), 100).tolist() == want
    began = time.time()
    assert pages.packed_greedily(np.full(1_000_000, 300), 500)[-1] == 999_999
    assert time.time() - began < 20


def test_packing_a_document_of_very_many_pages(spark):
    rows = spark.range(200_000).select(F.lit(1).cast("long").alias("doc_id"), F.col("id").cast("int").alias("page"), F.repeat(F.lit("x"), F.lit(400)).alias("text"))
    began = time.time()
    assert pages.pack(rows).agg(F.max("chunk_id")).first()[0] == 39_999  # five pages of 100 tokens each
    assert time.time() - began < 30


def test_ranges_split_equal_times_and_sparse_ids(spark):
    rows = spark.range(3000).select(F.lit(1).cast("long").alias("job"), F.lit(7).cast("long").alias("ts"), F.col("id").alias("seq"))
    pieces = [r["count"] for r in history.in_pieces(rows, 300).groupBy("_piece").count().collect()]
    assert sum(pieces) == 3000 and max(pieces) < 900
    sparse = spark.range(2000).select(F.lit("k").alias("k"), F.when(F.col("id") == 0, 2**62).otherwise(F.col("id")).alias("n"))
    pieces = [r["count"] for r in history.in_pieces(sparse, 200, ("n",)).groupBy("_piece").count().collect()]
    assert sum(pieces) == 2000 and max(pieces) < 600
    got = {r.n: r.before for r in history.previous(sparse, "k", "n", 200).collect()}
    assert got[2**62] == 1999 and got[1] is None and got[1500] == 1499 and len(got) == 2000


def test_a_call_leaves_one_file_and_a_task_again_asks_for_the_rest(spark, tmp_path, monkeypatch):
    texts, path = [f"t{i}" for i in range(64)], str(tmp_path / "ledger")
    left = []
    settle = ledger._settle
    monkeypatch.setattr(ledger, "_settle", lambda *a: (left.append(len(glob.glob(f"{path}/files/*.json"))), settle(*a)))
    assert ledger.ask(chunks(spark, texts), Counting(tmp_path / "one"), path, max_in_flight=1, per_task=100, batch=16) == 64
    assert left == [0, 4] and ledger.answers(chunks(spark, texts), path).where("value is null").count() == 0
    rows = spark.createDataFrame([(f"k{i}", f"t{i}") for i in range(20)], "asked string, text string").coalesce(1)
    again = Counting(tmp_path / "two")
    for part, n in ((rows.where("asked < 'k15'"), 7), (rows, 13)):  # k0, k1, k10 to k14 first
        assert part.mapInPandas(ledger._asking(again, path, "r", 0, 3), "n long").first()[0] == n
    assert len(again.asked()) == len(set(again.asked())) == 20
