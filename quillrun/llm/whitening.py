"""Embedding whitening: principal components of integer vectors, each scaled to variance one.

1. Every entry c of a vector becomes the whole number x = floor(SCALE * c) + OFFSET. Each different x
   vector once makes the fit list, of n vectors with sums S; copies fall together before the shuffle.
2. Rows are centred exactly: n * x - S is a whole number, which is divided by n once. RowMatrix sums
   their outer products (computeGramianMatrix) by tree aggregation; divided by n that is the covariance.
3. Its eigenvectors are found on the driver (d x d numbers for d dimensions, whatever the rows), and
   broadcast with S to the tasks that project and scale every row.
4. The covariance of the whitened fit list is measured in the same way, as a check.

What comes to the driver and is broadcast grows with the dimensions alone.

Defined results: a row whose vector is null or empty, or holds an entry that is null, not finite or too
large for a whole number of 64 bits, has no result; a null id stays null; repeated rows have a result
each; vectors of another length are fitted apart, on their own list; components without variance (one
vector, or fewer than dimensions) are left out; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrun.llm.common import stored, table

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 16
#: Largest |SCALE * c| that is made a whole number.
LARGEST = 2.0**62
WHITE = "known boolean, id long, component int, n long, deviation string, whitened double, explained double, identity_error double"


@dataclass(frozen=True)
class Whitening:
    """What is fitted: n and the sums of the fit list, directions (d x k, of unit length), their
    eigenvalues, the trace of the covariance and the largest error of the whitened covariance."""

    n: int
    sums: list[int]
    directions: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float = 0.0

    def numerators(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exactly; as Python's integers where 64 bits might not do."""
        most = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))
        if self.n * most + max(map(abs, self.sums)) < 1 << 62:
            return self.n * x - np.array(self.sums, np.int64)
        return self.n * x.astype(object) - np.array(self.sums, object)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (self.numerators(x) / self.n).astype(np.float64)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.directions / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sums of squares of n * x - S by row, exactly."""
        d = self.numerators(x)
        most = max(abs(int(d.max(initial=0))), abs(int(d.min(initial=0))))
        wide = d if most * most * d.shape[1] < 1 << 63 else d.astype(object)
        return (wide * wide).sum(axis=1).tolist()


def whole_numbers(rows: DataFrame) -> DataFrame:
    """(known, id, x) of the rows whose vector can be used; id is 0 where it isn't known."""
    fits = ~F.exists("embedding", lambda c: F.coalesce(F.isnan(c) | (F.abs(c.cast("double") * SCALE) > LARGEST), F.lit(True)))
    x = F.transform("embedding", lambda c: F.floor(c.cast("double") * SCALE) + OFFSET)
    used = rows.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0)).where(fits)
    return used.select(F.col("vec_id").isNotNull().alias("known"), F.coalesce(F.col("vec_id").cast("long"), F.lit(0)).alias("id"), x.alias("x"))


def _stacked(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    for pdf in batches:
        if len(pdf):
            yield pdf, np.stack(pdf["x"].to_numpy())


def _mapped(rows: DataFrame, model: Whitening, name: str, means: np.ndarray | None = None) -> DataFrame:
    """(z): what the model's method of that name makes of the rows' x, less ``means``."""
    known = rows.sparkSession.sparkContext.broadcast((model, means))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, less = known.value
        for _, x in _stacked(batches):
            z = getattr(own, name)(x)
            yield pd.DataFrame({"z": list(z if less is None else z - less)})

    return rows.select("x").mapInPandas(run, "z array<double>")


def _covariance(centred: DataFrame, n: int, width: int) -> np.ndarray:
    vectors = MLUtils.convertVectorColumnsFromML(centred.select(array_to_vector("z").alias("z")), "z")
    return RowMatrix(vectors, n, width).computeGramianMatrix().toArray() / n


def fit(vectors: DataFrame, width: int, components: int = COMPONENTS) -> Whitening | None:
    """The model of different vectors x of one length; None where they don't vary."""
    sums = vectors.select(F.posexplode("x").alias("at", "v")).groupBy("at").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("s"), F.count(F.lit(1)).alias("n")).collect()
    n, sums = sums[0]["n"], [int(r["s"]) for r in sorted(sums, key=lambda r: r["at"])]
    model = Whitening(n, sums, np.eye(width), np.ones(width), 0.0)
    covariance = _covariance(_mapped(vectors, model, "centred"), n, width)
    values, directions = np.linalg.eigh((covariance + covariance.T) / 2)
    order = np.argsort(-values, kind="stable")[:components]
    order = order[values[order] > values.max() * width * np.finfo(float).eps]
    if not len(order) or values.max() <= 0:
        return None
    model = Whitening(n, sums, directions[:, order], values[order], float(np.trace(covariance)))
    means = _mapped(vectors, model, "whitened").select(F.posexplode("z").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("s")).orderBy("at").collect()
    white = _covariance(_mapped(vectors, model, "whitened", np.array([r["s"] / n for r in means])), n, len(order))
    return Whitening(n, sums, model.directions, model.values, model.trace, float(np.abs(white - np.eye(len(order))).max()))


def applied(rows: DataFrame, model: Whitening) -> DataFrame:
    """Columns WHITE, a row for each row of whole_numbers() and component; deviation is decimal digits,
    as it may need more than 64 bits."""
    known = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = known.value
        k = len(own.values)
        for pdf, x in _stacked(batches):
            yield pd.DataFrame({
                "known": np.repeat(pdf["known"].to_numpy(), k), "id": np.repeat(pdf["id"].to_numpy(), k), "component": np.tile(np.arange(1, k + 1, dtype=np.int32), len(pdf)), "n": own.n,
                "deviation": np.repeat(np.array([str(v) for v in own.deviations(x)], object), k), "whitened": own.whitened(x).ravel(),
                "explained": np.tile(own.values / own.trace, len(pdf)), "identity_error": own.identity_error,
            })

    return rows.mapInPandas(run, WHITE)


def whiten(rows: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation decimal(38,0), whitened, explained, identity_error) of rows with
    vec_id and embedding, for each component up to ``components``."""
    numbers = whole_numbers(rows)
    vectors = stored(numbers.select("x").distinct())
    widths = [r[0] for r in vectors.select(F.size("x")).distinct().collect()]  # one for each length of vector
    found = []
    for width in sorted(widths):
        model = fit(vectors.where(F.size("x") == width), width, components)
        if model:
            found.append(applied(numbers.where(F.size("x") == width) if len(widths) > 1 else numbers, model))
    white = reduce(DataFrame.unionByName, found) if found else rows.sparkSession.createDataFrame([], WHITE)
    return white.select(F.when(F.col("known"), F.col("id")).alias("vec_id"), "component", "n", F.col("deviation").cast("decimal(38,0)").alias("deviation"), "whitened", "explained", "identity_error")


def op11_embedding_whitening(spark, sf_dir: str) -> DataFrame:
    """whiten() of all embeddings; a deviation beyond 64 bits is null, and whole in deviation_exact."""
    rows = whiten(table(spark, sf_dir, "embeddings"))
    return rows.select("vec_id", "component", "n", F.col("deviation").try_cast("long").alias("deviation"), "whitened", "explained", "identity_error", F.col("deviation").alias("deviation_exact"))
