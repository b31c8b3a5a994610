"""Quality by nearest-neighbour voting in a latent-semantic space.

A text becomes a vector of terms that tell of its make-up: shapes of words (letters folded to one,
marks kept), pairs of shapes, repeats of the word before, line make-up and word lengths. Latent
directions are found by singular value decomposition of a bounded labelled sample; its latent
vectors and labels are broadcast. Every document's vector is multiplied with all of them in blocks,
exact cosines, and the nearest neighbours vote with weights that grow with similarity. Votes of a
class of which the sample has a part count for the whole class, so that the mix of classes doesn't
depend on the input's size.

Labels of held-out rows are never read; language, source and id are never inputs.

Defined results: a null or empty text has no terms, a zero vector, and gets the share of label 1 among
all labels that may be read; repeated rows score alike; neighbours that tie with the last one all vote; an empty
table gives an empty result; with no labelled rows every score is 0.5; other columns of the input
are carried along.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrun.llm.common import held_out, table
from quillrun.llm.labels import labelled_sample

#: Labelled rows of each class at most; they bound what is broadcast.
PER_CLASS = 1500
TERMS, LATENT = 1024, 48
NEIGHBOURS, SHARPNESS = 25, 6
BLOCK = 512
THRESHOLD = 0.3


class _Folds(dict):
    """Character to shape, filled in as characters come."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        self[code] = got = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
        return got


_FOLDS = _Folds()
_RUNS = re.compile(r"(a)a+|(A)A+|(0)0+")
_OTHER = re.compile(r"[^\w\s]|_")


def terms_of(text: str) -> Counter:
    """Terms and how much of the text they make up, in parts of the words."""
    words = text.split()
    n = len(words)
    if not n:
        return Counter()
    shapes = _RUNS.sub(lambda m: m[0][0], text.translate(_FOLDS)).split()
    out: Counter = Counter(s[:12] for s in shapes)
    out.update(map("{0[0]:.6} {0[1]:.6}".format, zip(shapes, shapes[1:])))
    same = sum(map(str.__eq__, words, words[1:]))
    distinct = len(set(words)) / n
    lines = text.count("\n") + 1
    return Counter({t: c / n for t, c in out.items()}) + Counter({
        "<same>": 4 * same / n, "<few words>": 2 * max(0.0, 0.6 - distinct), "<lines>": lines / n,
        f"<distinct {int(10 * distinct)}>": 0.2, f"<size {min(n, 65536).bit_length()}>": 0.1, f"<word length {min(12, len(text) // n)}>": 0.2,
        "<other>": len(_OTHER.findall(text)) / len(text),
    })


class Model:
    """terms: their columns; idf; the latent directions; the labelled vectors and labels."""

    def __init__(self, rows: list[tuple[int, Counter]], weights: list[float] | None = None):
        seen = Counter(t for _, c in rows for t in c)
        self.at = {t: i for i, (t, _) in enumerate(sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:TERMS])}
        self.idf = np.array([np.log((1 + len(rows)) / (1 + seen[t])) + 0.1 for t in self.at], np.float32)
        self.labels = np.array([y for y, _ in rows], np.float32)
        self.weights = np.ones(len(rows)) if weights is None else np.array(weights, np.float64)
        self.prior = float(np.average(self.labels, weights=self.weights)) if rows else 0.5
        self.axes = np.zeros((len(self.at), 0), np.float32)
        if rows:
            x = self._matrix([c for _, c in rows])
            values, vectors = np.linalg.eigh((x.T @ x).astype(np.float64))  # right singular vectors of x
            self.axes = vectors[:, ::-1][:, : min(LATENT, len(self.at))].astype(np.float32)
            self.points = self._latent(x)

    def _matrix(self, counts: list[Counter]) -> np.ndarray:
        x = np.zeros((len(counts), len(self.at)), np.float32)
        for i, c in enumerate(counts):
            for t, v in c.items():
                if (j := self.at.get(t)) is not None:
                    x[i, j] = v
        x = np.sqrt(np.maximum(x, 0)) * self.idf
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def _latent(self, x: np.ndarray) -> np.ndarray:
        z = x @ self.axes
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)

    def score(self, counts: list[Counter]) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(counts), self.prior)
        cosines = self._latent(self._matrix(counts)) @ self.points.T
        k = min(NEIGHBOURS, cosines.shape[1])
        last = np.partition(cosines, -k, axis=1)[:, -k, None]
        weight = np.where(cosines >= last, np.maximum(cosines, 0), 0).astype(np.float64) ** SHARPNESS * self.weights
        total = weight.sum(axis=1)
        return np.where(total > 1e-9, weight @ self.labels.astype(np.float64) / np.maximum(total, 1e-9), self.prior)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            own = [terms_of(t) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "label": pdf["label"], "weight": pdf["weight"], "t": [list(c) for c in own], "v": [[float(x) for x in c.values()] for c in own]})

    sample = labelled_sample(docs, labels, "quality", per_class)
    rows = sorted(sample.mapInPandas(read, "doc_id long, label int, weight double, t array<string>, v array<double>").collect(), key=lambda r: (r["doc_id"], r["t"]))  # at most 2 x per_class rows
    return Model([(r["label"], Counter(dict(zip(r["t"], r["v"])))) for r in rows], [r["weight"] for r in rows])


def scored(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """docs with a column of that name, 0 to 1; one that is there already is replaced."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        model, blocks = sent.value, (texts.iloc[at : at + BLOCK] for at in range(0, len(texts), BLOCK))
        return pd.Series(np.concatenate([np.zeros(0), *(np.round(model.score([terms_of(t or "") for t in b]), 9) for b in blocks)]), dtype="float64")

    return docs.withColumn(name, score("text"))


def op9_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return scored(docs.select("doc_id", "text"), model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
