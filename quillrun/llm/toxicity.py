"""Toxicity by weak supervision.

Lexicon and pattern voters say toxic (1), clean (-1) or nothing (0) of every whole text. A generative
label model, two classes with a mean vote for each voter and class (accuracies) and one covariance
between voters (correlations), is fitted by EM on the counts of vote patterns of all rows, labelled or
not; a known label is one more voter, whose reliability is estimated like theirs, so the others can
overrule it. A linear classifier is then trained on the posteriors of a bounded labelled sample and
scores every text.

The lexicons come from the sample: words and word beginnings that are far commoner in toxic rows,
beside a fixed list of insults. Of near copies in the sample one counts, that of the least id.
Labels of held-out rows are never read; language, source and id are never inputs.

Defined results: a null or empty text gets the classifier's score of no features; repeated rows
score alike; an empty table gives an empty result; without labelled rows of both classes the fixed
list and the patterns decide; other columns of the input are carried along by scored().
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrun.llm.common import checkpointed, drop_stored, held_out, stored, table
from quillrun.llm.labels import labelled_sample, labels_of

#: Labelled rows of each class that the fit reads at most.
PER_CLASS = 4000
#: Lexicon entries at most, the most telling first.
LEXICON = 4096
LEAST_DOCS, LEAST_ODDS = 4, 8.0
#: What an entry's odds are at least when 1.64 standard errors are taken off.
SURE_ODDS = 4.0
STEMS = (3, 4, 5, 6, 7, 8)
#: A stem also has entries for how often its words occur: "*" at least twice and once in 200 words,
#: "**" once in 60 words.
TIERS = ("", "*", "**")
#: Rows, right and wrong, that a label's reliability is estimated with besides the known ones.
TRUST = (9.0, 1.0)
#: Where between the class means, 0 and 1, log-odds are counted, and the steps that this distance has.
BETWEEN, STEPS_BETWEEN = (0.25, 1.2), 8
#: Steps of the classifier's training.
STEPS = 1500
INSULTS = ["idiot", "moron", "stupid", "loser", "scum", "trash", "worthless", "pathetic", "disgusting", "clown", "dumb", "fool", "jerk", "freak", "pig", "vermin", "filth", "hate", "kill", "die", "ugly", "liar", "coward", "creep"]
WORD = re.compile(r"[^\W\d_]+")
YOU = re.compile(r"\b(?:you|your|he|she|they|this)\b(?:\W+\w+){0,2}\W+(?:are|is|was)\b", re.I)
VOTERS = ["insults", "strong words", "words", "stems", "many stems", "many hits", "dense hits", "shouting", "marks", "address"]


def tiers_of(count: int, n: int) -> list[str]:
    return ["", *["*"] * (count >= 2 and 200 * count >= n), *["**"] * (60 * count >= n)]


def features_of(text: str) -> set[str]:
    """Words ('=word') and word beginnings ('stem', 'stem*', 'stem**') of a text."""
    words = WORD.findall(text.lower())
    own = Counter(words)
    stems: Counter = Counter()
    for w, c in own.items():
        for k in STEMS:
            if len(w) > k:
                stems[w[:k]] += c
    return {f"={w}" for w in own} | {f + t for f, c in stems.items() for t in tiers_of(c, len(words))}


def votes_of(text: str, hits: list[float], stems: int, words: int, n: int, insults: int) -> list[int]:
    """hits: log-odds of the lexicon entries found, of which so many are stems and words."""
    strong = sum(1 for h in hits if h >= math.log(20))
    letters = sum(map(str.isupper, text)) / max(1, len(text))
    return [
        1 if insults else 0,
        1 if strong else 0,
        1 if words else -1,
        1 if stems else -1,
        1 if stems >= 3 else 0,
        1 if len(hits) >= 3 else (-1 if not hits else 0),
        1 if n and len(hits) / n >= 0.01 else (-1 if not hits else 0),
        1 if letters > 0.5 else 0,
        1 if text.count("!") > 3 and n and text.count("!") / n > 0.05 else 0,
        1 if insults and YOU.search(text) else 0,
    ]


class Model:
    """lexicon: log-odds by entry; weights of the voters, the entries and the bias."""

    def __init__(self, lexicon: dict[str, float]):
        self.odds, self.at = list(lexicon.values()), {f: i for i, f in enumerate(lexicon)}
        stems = {f.rstrip("*") for f in lexicon if f[0] != "="}
        self.stems, self.heads, self.sizes = stems, {f[:3] for f in stems}, sorted({len(f) for f in stems})
        self.words, self.insults = {f[1:] for f in lexicon if f[0] == "="}, set(INSULTS)
        self.votes_w, self.entry_w, self.bias = np.full(len(VOTERS), 0.4), np.zeros(len(lexicon)), -1.0
        self.estimates: dict[str, float] = {}

    def read(self, text: str) -> tuple[list[int], list[int]]:
        """The votes, and the numbers of the lexicon entries that occur."""
        words = WORD.findall(text.lower())
        own, heads, known, n = Counter(words), self.heads, self.stems, len(words)
        stems: Counter = Counter()
        for w in [w for w in own if w[:3] in heads]:
            for k in self.sizes:
                if len(w) > k and w[:k] in known:
                    stems[w[:k]] += own[w]
        by_word = [self.at["=" + w] for w in self.words & own.keys()]
        by_stem = [i for f, c in stems.items() for t in tiers_of(c, n) if (i := self.at.get(f + t)) is not None]
        found = by_word + by_stem
        return votes_of(text, [self.odds[i] for i in found], len(by_stem), len(by_word), n, len(self.insults & own.keys())), found

    def score(self, text: str | None) -> float:
        return self.of(*self.read(text or ""))

    def of(self, votes, found) -> float:
        """The score of what read() gave."""
        found = np.asarray(found, int)
        z = self.bias + float(np.dot(self.votes_w, votes)) + float(self.entry_w[found].sum())
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _signature(text: str) -> int:
    """Near copies mostly share it: the least hash of three words in a row."""
    w = text.split()
    return min((xxhash.xxh64_intdigest(" ".join(w[i : i + 3])) for i in range(max(1, len(w) - 2))), default=0) >> 1


def _signed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame({"doc_id": pdf["doc_id"], "sig": [_signature(t) for t in pdf["text"]]})


def _told(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame({"label": pdf["label"], "f": [sorted(features_of(t)) for t in pdf["text"]]})


def induce(sample: DataFrame, most: int = LEXICON) -> dict[str, float]:
    """Entries and their log-odds: those in at least LEAST_DOCS toxic rows, LEAST_ODDS times as common
    there as in clean ones, and surely (SURE_ODDS) no chance finds."""
    # ids alone are compared, so that a large group of copies is summed before it is shuffled
    one = sample.mapInPandas(_signed, "doc_id long, sig long").groupBy("sig").agg(F.min("doc_id").alias("doc_id")).select("doc_id").distinct()
    told = checkpointed(sample.join(F.broadcast(one), "doc_id").mapInPandas(_told, "label int, f array<string>"))
    n = {r["label"]: r["n"] for r in told.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not n.get(0) or not n.get(1):
        return {f"={w}": math.log(20) for w in INSULTS}
    counts = told.select("label", F.explode("f").alias("f")).groupBy("f").agg(F.sum("label").alias("a"), F.count(F.lit(1)).alias("b"))
    odds = F.log(((F.col("a") + 0.5) / (n[1] + 1)) / ((F.col("b") - F.col("a") + 0.5) / (n[0] + 1)))
    error = F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("b") - F.col("a") + 0.5))
    top = counts.where(F.col("a") >= LEAST_DOCS).withColumn("odds", odds).where((F.col("odds") >= math.log(LEAST_ODDS)) & (F.col("odds") - 1.64 * error >= math.log(SURE_ODDS))).orderBy((F.col("odds") * F.sqrt("a")).desc(), "f").limit(most)
    return {r["f"]: r["odds"] for r in top.collect()}


def label_model(votes: np.ndarray, labels: np.ndarray, n: np.ndarray, rounds: int = 40) -> tuple[np.ndarray, dict[str, float]]:
    """Posteriors of toxicity of vote patterns that so many rows have, and what was estimated.

    Class means and a common covariance of the votes (accuracies and correlations), the share of toxic
    rows, and how often the label names each class are re-estimated with the posteriors, all rows
    counting. ``labels`` is NaN where none is known: there the votes alone decide. A label is one more
    voter, and the others overrule it where they are surer. It starts the estimates; without any
    label, the majority of voters does. Beyond the class means the log-odds are the model's own; between them,
    where few voters speak and normal tails mislead, they are those counted at like places.
    """
    known = ~np.isnan(labels)
    say = np.where(known, labels, 0.5)
    p = np.where(known, 0.1 + 0.8 * say, np.where(votes.sum(axis=1) > 0, 0.9, 0.1))
    first = known if len(set(labels[known])) == 2 else np.ones(len(n), bool)
    told = {}
    for k in range(rounds):
        use = n * first if k == 0 else n
        toxic, clean = use * p, use * (1 - p)
        a, b = toxic.sum() + 1e-9, clean.sum() + 1e-9
        high, low = toxic @ votes / a, clean @ votes / b
        x, y = votes - high, votes - low
        cov = ((toxic[:, None] * x).T @ x + (clean[:, None] * y).T @ y) / (a + b) + 0.05 * np.eye(votes.shape[1])
        w = np.linalg.solve(cov, high - low)
        # where a row stands between the class means, 0 clean and 1 toxic
        at = (votes - low) @ w / max((high - low) @ w, 1e-9)
        step = np.clip(at * STEPS_BETWEEN + STEPS_BETWEEN / 2, 0, 2 * STEPS_BETWEEN - 1).astype(int)
        in_toxic, in_clean = (np.bincount(step, c, 2 * STEPS_BETWEEN) for c in (toxic, clean))
        counted = np.log((in_toxic + 0.5 * a / (a + b)) / a / ((in_clean + 0.5 * b / (a + b)) / b))[step]
        odds = np.where((at >= BETWEEN[0]) & (at <= BETWEEN[1]), counted, votes @ w - (high + low) @ w / 2)
        right = [(TRUST[0] + (use * q * known * (say == c)).sum()) / (sum(TRUST) + (use * q * known).sum()) for c, q in ((0, 1 - p), (1, p))]
        label = np.where(~known, 0.0, np.where(say == 1, math.log(right[1] / (1 - right[0])), math.log((1 - right[1]) / right[0])))
        p = 1 / (1 + np.exp(-np.clip(odds + math.log(a / b) + label, -30, 30)))
        told = {"toxic share": a / (a + b), "label right when clean": right[0], "label right when toxic": right[1]} | dict(zip(VOTERS, w))
    return p, {k: float(v) for k, v in told.items()}


def features(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, votes, found) of every row: its votes and the numbers of its lexicon entries."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = sent.value
        for pdf in batches:
            rows = [own.read(t or "") for t in pdf["text"]]
            yield pd.DataFrame({"known": pdf["known"], "id": pdf["id"], "votes": [v for v, _ in rows], "found": [f for _, f in rows]})

    rows = docs.select(F.col("doc_id").isNotNull().alias("known"), F.coalesce("doc_id", F.lit(0)).cast("long").alias("id"), "text")
    rows = rows.mapInPandas(read, "known boolean, id long, votes array<int>, found array<int>")
    return rows.select(F.when(F.col("known"), F.col("id")).alias("doc_id"), "votes", "found")


def fit_features(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> tuple[Model, DataFrame]:
    """The fitted model, and the stored features() of docs that it was fitted on."""
    sample = labelled_sample(docs, labels, "toxic", per_class)
    model = Model(induce(sample))
    told = stored(features(docs, model))
    known = labels_of(labels, "toxic")
    # distinct votes and labels: a few hundred rows, 3^10 x 3 at most
    counts = told.select("doc_id", "votes").join(known, "doc_id", "left").groupBy("votes", "label").agg(F.count(F.lit(1)).alias("n")).orderBy("votes", "label").collect()
    if not counts:
        return model, told
    p, model.estimates = label_model(np.array([r["votes"] for r in counts], float), np.array([np.nan if r["label"] is None else r["label"] for r in counts], float), np.array([r["n"] for r in counts], float))
    posterior = {(tuple(r["votes"]), r["label"]): float(x) for r, x in zip(counts, p)}
    ids = sample.select("doc_id", "label", "weight")
    # one row for each sampled id: 2 x per_class at most
    rows = told.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "label", "weight").agg(F.min(F.struct("votes", "found")).alias("f")).select("doc_id", "label", "weight", "f.*").collect()
    rows = sorted(rows, key=lambda r: r["doc_id"])
    if {r["label"] for r in rows} == {0, 1}:
        train(model, rows, np.array([posterior[tuple(r["votes"]), r["label"]] for r in rows]))
    return model, told


def train(model: Model, rows: list, p: np.ndarray) -> None:
    """The linear classifier, on posteriors of rows with votes, found and weight."""
    votes, n = np.array([r["votes"] for r in rows], float), np.array([r["weight"] for r in rows], float)
    doc = np.repeat(np.arange(len(rows)), [len(r["found"]) for r in rows])
    entry = np.array([i for r in rows for i in r["found"]], int)
    vw, ew, bias = np.zeros(votes.shape[1]), np.zeros(len(model.at)), 0.0
    gv, ge, gb = np.full(len(vw), 1e-8), np.full(len(ew), 1e-8), 1e-8
    for _ in range(STEPS):  # full-batch AdaGrad on the cross-entropy with the posteriors
        z = votes @ vw + np.bincount(doc, ew[entry], len(rows)) + bias
        off = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - p) * n / n.sum()
        dv, de, db = off @ votes + 1e-4 * vw, np.bincount(entry, off[doc], len(ew)) + 1e-4 * ew, off.sum()
        gv, ge, gb = gv + dv**2, ge + de**2, gb + db**2
        vw, ew, bias = vw - 0.3 * dv / np.sqrt(gv), ew - 0.3 * de / np.sqrt(ge), bias - 0.3 * db / math.sqrt(gb)
    model.votes_w, model.entry_w, model.bias = vw, ew, bias


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    model, told = fit_features(docs, labels, per_class)
    drop_stored(told)
    return model


def scored(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """docs with a column of that name, 0 to 1; one that is there already is replaced."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        own = sent.value
        return pd.Series([round(own.score(t), 9) for t in texts], dtype="float64")

    return docs.withColumn(name, score("text"))


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    model, told = fit_features(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(votes: pd.Series, found: pd.Series) -> pd.Series:
        own = sent.value
        return pd.Series([round(own.of(v, f), 9) for v, f in zip(votes, found)], dtype="float64")

    return told.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score("votes", "found").alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
