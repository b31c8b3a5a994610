"""Whitening, seed-and-extend dedup and the manifest against brute force, and on awkward rows."""

import hashlib
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillrun.llm import common, merkle, mixing, seedextend, suffixes, urlfilter, whitening

DOC = "doc_id long, text string, lang string, source string, n_chars long"
VEC = "vec_id long, embedding array<float>, label int"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# --- whitening


def brute_white(vectors, k=16):
    x = np.floor(np.array(vectors, float) * 64).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(0)
    centred = (n * fit - sums) / n
    values, directions = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:k]
    white = ((n * x - sums) / n) @ directions[:, order] / np.sqrt(values[order])
    return n, ((n * x - sums) ** 2).sum(1), white, values[order] / values.sum()


def test_whitening_equals_numpy(spark):
    rng = np.random.default_rng(5)
    made = (rng.normal(size=(60, 24)) * np.linspace(1, 3, 24)).astype(np.float32)
    made = np.vstack([made, made[:20]])
    rows = [(i, [float(v) for v in r], 0) for i, r in enumerate(made)]
    bad = [(900, None, 0), (901, [1.0] * 23 + [None], 0), (902, [float("nan")] * 24, 0), (903, [float("inf")] * 24, 0), (904, [], 0), (905, [3e38] * 24, 0)]
    got = whitening.whiten(spark.createDataFrame(rows + bad, VEC).withColumns({"n": F.lit("x"), "x": F.lit(1), "component": F.lit("y")}))
    got = got.toPandas()
    n, deviation, white, explained = brute_white(made)
    assert len(got) == 80 * 16 and set(got["n"]) == {n} and n == 60
    wide = got.pivot(index="vec_id", columns="component", values="whitened").loc[range(80)].to_numpy()
    assert np.abs(wide * np.sign(wide[0]) - white * np.sign(white[0])).max() < 1e-9
    first = got[got["component"] == 1].set_index("vec_id").loc[range(80)]
    assert [int(v) for v in first["deviation"]] == deviation.tolist()
    assert np.abs(got.groupby("component")["explained"].first().to_numpy() - explained).max() < 1e-12
    assert got["identity_error"].nunique() == 1 and got["identity_error"].iloc[0] < 1e-9


def test_whitening_of_awkward_rows(spark):
    assert whitening.whiten(spark.createDataFrame([], VEC)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0], 0)] * 3, VEC)).collect() == []  # one vector has no variance
    rows = [(None, [1.0, 2.0], 0), (1, [2.0, 4.0], 0), (1, [2.0, 4.0], 0), (2, [3.0, 6.5], None), (3, [1.0], 0), (4, [5.0], 0)]
    got = whitening.whiten(spark.createDataFrame(rows, VEC)).toPandas()
    assert sorted(got["n"]) == [2, 2] + [3] * 8  # lengths apart
    assert got["vec_id"].isna().sum() == 2
    # numbers beyond 64 bits stay exact
    big = [(i, [float(v), 1.0 + i % 3], 0) for i, v in enumerate([2.0**45, -(2.0**44), 3.0, 7.0])]
    got = whitening.whiten(spark.createDataFrame(big, "vec_id long, embedding array<double>, label int")).where("component = 1")
    x = [[int(v * 64) + 1_000_000, int((1.0 + i % 3) * 64) + 1_000_000] for i, v in enumerate([2.0**45, -(2.0**44), 3.0, 7.0])]
    sums = [sum(r[d] for r in x) for d in (0, 1)]
    assert {r["vec_id"]: int(r["deviation"]) for r in got.collect()} == {i: sum((4 * r[d] - sums[d]) ** 2 for d in (0, 1)) for i, r in enumerate(x)}


# --- seed and extend


def brute_repeats(docs, window):
    """docs: [(doc_id, text)] of different ids; (doc_id, n_words, n_removed, sha256)."""
    seen, out = set(), []
    for doc, text in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0)):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = set()
        for i in range(len(words) - window + 1):
            w = tuple(words[i : i + window])
            if w in seen:
                gone.update(range(i, i + window))
            seen.add(w)
        kept = [w for i, w in enumerate(words) if i not in gone]
        out.append((doc, len(words), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def made_docs(seed, n=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)] + ["é", "漢字", "x y"]
    shared = [[rng.choice(vocabulary) for _ in range(rng.randint(15, 90))] for _ in range(6)]
    docs = []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            part = rng.choice(shared)
            a = rng.randint(0, len(part) - 1)
            at = rng.randint(0, len(words))
            words[at:at] = part[a : a + rng.randint(1, 60)]
        docs.append((i, rng.choice([" ", "\n", "\t "]).join(words)))
    return docs + [(n, None), (n + 1, ""), (n + 2, " \n"), (None, docs[3][1]), (n + 3, "same words " * 300), (n + 4, docs[5][1])]


@pytest.mark.parametrize("hot", [4096, 1])
def test_seed_and_extend_equals_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(seedextend, "HOT_CONTEXTS", hot)
    docs = made_docs(3)
    df = spark.createDataFrame([(d, t, "en", "a", 1) for d, t in docs], DOC).withColumns({c: F.lit("clash") for c in ("id", "key", "spans", "h", "c", "p", "n")})
    assert rows_of(seedextend.dedup_report(df)) == brute_repeats(docs, 20)
    assert rows_of(seedextend.dedup_report(df, 12, 5)) == brute_repeats(docs, 12)


def test_seed_and_extend_in_small_parts(spark, monkeypatch):
    monkeypatch.setattr(seedextend, "SEGMENT", 128)
    monkeypatch.setattr(seedextend, "PIECE", 64)
    monkeypatch.setattr(seedextend, "TOGETHER", 3)
    monkeypatch.setattr(seedextend, "REMEMBERED", 4)
    monkeypatch.setattr(common, "REMEMBERED", 4)
    docs = made_docs(4, 40)
    df = spark.createDataFrame([(d, t, "en", "a", 1) for d, t in docs], DOC)
    assert rows_of(seedextend.dedup_report(df)) == brute_repeats(docs, 20)


def test_seed_and_extend_defined_results(spark):
    text = " ".join(f"word{i}" for i in range(50))
    df = spark.createDataFrame([(5, text, "en", "a", 1)] * 3 + [(None, text, "en", "a", 1), (None, None, None, None, None)], DOC)
    got = rows_of(seedextend.dedup_report(df).select("doc_id", "n_words", "n_removed"))
    assert got == [(5, 50, 50)] * 3 + [(None, 0, 0), (None, 50, 0)]  # rows equal in id and text are one document
    kept = {r["doc_id"]: r["text"] for r in seedextend.without_repeats(df).where("text is not null").collect()}
    assert kept == {5: "", None: text}
    assert rows_of(seedextend.repeats(df)) == [(5, 0, 50)] * 3
    assert seedextend.dedup_report(spark.createDataFrame([], DOC)).collect() == []


def test_many_rows_equal_in_id_and_text(spark):
    text = " ".join(f"word{i}" for i in range(400))
    rows = spark.range(5000).select(F.lit(7).cast("long").alias("doc_id"), F.lit(text).alias("text")).unionByName(spark.createDataFrame([(1, text[:1500]), (9, text[300:])], "doc_id long, text string"))
    for report in (seedextend.dedup_report, suffixes.dedup_report):
        began = time.time()
        assert report(rows).where("n_removed > 0").count() >= 5000
        assert time.time() - began < 40


# --- manifest


def brute_manifest(rows, arity):
    """rows: [(doc_id, lang, leaf)]; (doc_id, leaf, subroot, root, proof's digests)."""

    def sha(parts):
        return hashlib.sha256("".join(parts).encode()).hexdigest()

    def tree(leaves):
        paths, at = [[] for _ in leaves], list(range(len(leaves)))
        while len(leaves) > 1:
            for i in range(len(paths)):
                run = at[i] // arity * arity
                paths[i] += [leaves[j] for j in range(run, min(run + arity, len(leaves))) if j != at[i]]
                at[i] //= arity
            leaves = [sha(leaves[j : j + arity]) for j in range(0, len(leaves), arity)]
        return leaves[0], paths

    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    names = sorted(by, key=lambda g: (g is not None, (g or "").encode()))
    inner = {}
    for g in names:
        by[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[2]))
        inner[g] = tree([r[2] for r in by[g]])
    root, outer = tree([inner[g][0] for g in names])
    return sorted(((r[0], r[2], inner[g][0], root, "".join(p + q)) for g, q in zip(names, outer) for r, p in zip(by[g], inner[g][1])), key=str)


@pytest.mark.parametrize("arity,block", [(2, 4096), (2, 4), (3, 9), (5, 6)])
def test_manifest_equals_brute_force(spark, monkeypatch, arity, block):
    monkeypatch.setattr(merkle, "BLOCK", block)
    rng = random.Random(arity)
    rows = [(rng.choice([None, *range(30)]), f"text {rng.randint(0, 20)}", rng.choice([None, "", "en", "en", "en", "é", "~", "one"] + ["en"] * 8), "s", None) for _ in range(150)]
    rows += [(1000, "alone", "single", "s", 3)]
    df = spark.createDataFrame(rows, DOC).withColumns({c: F.lit("clash") for c in ("group", "id", "leaf", "other", "known", "at", "uid", "steps")})
    got = merkle.manifest(df, arity=arity).select("doc_id", "leaf", "subroot", "root", merkle.beside(F.col("steps")).alias("p"))

    def leaf(r):
        values = [r[0], r[3], r[2], r[4], r[1]]
        return hashlib.sha256("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values).encode()).hexdigest()

    assert rows_of(got) == brute_manifest([(r[0], r[2], leaf(r)) for r in rows], arity)
    assert merkle.verified(merkle.manifest(df, arity=arity)).where("verified").count() == len(rows)
    wrong = merkle.verified(merkle.manifest(df, arity=arity, other=F.when(F.col("doc_id") == 1000, F.sha2(F.lit(b"x"), 256))))
    assert [r["doc_id"] for r in wrong.where("not verified").collect()] == [1000]


def test_manifest_of_nothing_and_of_one(spark):
    assert merkle.manifest(spark.createDataFrame([], DOC)).collect() == []
    (row,) = merkle.verified(merkle.manifest(spark.createDataFrame([(None, None, None, None, None)], DOC))).collect()
    assert row["leaf"] == row["subroot"] == row["root"] == hashlib.sha256(b"-----").hexdigest() and row["steps"] == [] and row["verified"]


# --- URL filter and raking


def test_rules_for_parts_of_hosts_say_nothing_of_other_hosts(spark):
    rows = [(i, f"http://example.org/es/{i}", "<p>plain words</p>") for i in range(60)] + [(100 + i, f"http://site{i}.example.net/{'es' if i % 2 else 'en'}/{i}", "<p>plain words</p>") for i in range(60)]
    rows += [(200 + i, f"http://casino-win.example.net/en/{i}", "<p>plain words</p>") for i in range(9)]
    got = {r["page_id"]: r["verdict"] for r in urlfilter.judged(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == "block" for i in range(60)) and all(got[100 + i] == "allow" for i in range(60)) and all(got[200 + i] == "block" for i in range(9))


def test_raking_says_where_it_has_not_settled(spark, recwarn):
    rows = [("a", "en", "0", 90), ("a", "de", "1", 1), ("b", "en", "1", 5), ("b", "de", "0", 300)]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens long")
    targets = {"source": {"a": 0.5, "b": 0.5}, "lang": {"en": 0.5, "de": 0.5}, "topic": {"0": 0.5, "1": 0.5}}
    few = mixing.rake(cells, targets, rounds=2).collect()
    assert len(few) == 4 and any("has not settled" in str(w.message) for w in recwarn)
    recwarn.clear()
    done = {tuple(r)[:3]: r["factor"] * r["tokens"] for r in mixing.rake(cells, targets, rounds=4000).collect()}
    assert not any("has not settled" in str(w.message) for w in recwarn)
    for k, name in enumerate(("source", "lang", "topic")):
        for value, share in targets[name].items():
            assert abs(sum(v for c, v in done.items() if c[k] == value) - share) < 1e-6
