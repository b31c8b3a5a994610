"""Verified links within buckets, without gathering a bucket or emitting its pairs.

Rows have part and val, which name a bucket, id, a long, probe, and more columns. Within a bucket every
probe row is compared with every other row. Buckets over a block's rows are cut into blocks on both
sides, and every pair of blocks is one unit of work. Of a unit's links only a spanning forest is kept.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrun.llm.common import checkpointed

#: Rows of a bucket on either side that one task compares.
BLOCK = 2048
#: Hot bucket lists up to this length are broadcast, longer ones joined.
BROADCAST_BUCKETS = 20_000
#: Comparisons of a unit of work up to which it can be done together with others, and those done at once.
FEW, AT_ONCE = 1024, 1 << 20
_KEY = ["part", "val", "bi", "bp"]


def forest(near: np.ndarray, x: np.ndarray, q: np.ndarray) -> list[tuple[int, int]]:
    """Edges that join what the links of x (rows) to q (columns) join: each node of a component to its
    smallest node."""
    other = near & (x[:, None] != q[None, :])
    rows, cols = np.flatnonzero(other.any(axis=1)), np.flatnonzero(other.any(axis=0))
    if not len(rows):
        return []
    near, x, q = near[np.ix_(rows, cols)], x[rows], q[cols]
    fresh_x, fresh_q, out = np.ones(len(x), bool), np.ones(len(q), bool), []
    while fresh_x.any():
        edge, nodes = np.flatnonzero(fresh_x)[:1], []
        fresh_x[edge] = False
        while len(edge):
            nodes.append(x[edge])
            to = np.flatnonzero(near[edge].any(axis=0) & fresh_q)
            fresh_q[to] = False
            nodes.append(q[to])
            edge = np.flatnonzero(near[:, to].any(axis=1) & fresh_x)
            fresh_x[edge] = False
        group = np.unique(np.concatenate(nodes))
        out += [(int(v), int(group[0])) for v in group[1:]]
    return out


def _small(pdf: pd.DataFrame, a: np.ndarray, b: np.ndarray, pairs: Callable[[pd.DataFrame, pd.DataFrame], np.ndarray]) -> list[tuple[int, int]]:
    """Links within the units of rows a to b, all compared as pairs of rows; other rows stand before
    probe rows."""
    probe, ids, out = np.concatenate([[0], np.cumsum(pdf["probe"].to_numpy(bool))]), pdf["id"].to_numpy(np.int64), []
    probes = probe[b] - probe[a]
    own = b - a - probes
    last, rest = np.cumsum(own * probes), pdf.drop(columns=[*_KEY, "probe"])
    while len(a):
        n = max(1, int(np.searchsorted(last, AT_ONCE, side="right")))
        size = (own * probes)[:n]
        unit = np.repeat(np.arange(n), size)
        k = np.arange(len(unit)) - np.repeat(np.cumsum(size) - size, size)
        x, q = a[unit] + k // probes[unit], a[unit] + own[unit] + k % probes[unit]
        other = ids[x] != ids[q]
        x, q = x[other], q[other]
        near = pairs(rest.iloc[x], rest.iloc[q])
        u, v = np.maximum(ids[x], ids[q])[near], np.minimum(ids[x], ids[q])[near]
        out += zip(u.tolist(), v.tolist())
        done, a, b, own, probes = last[n - 1], a[n:], b[n:], own[n:], probes[n:]
        last = last[n:] - done
    return out


def _verified(links: Callable[[pd.DataFrame, pd.DataFrame], list[tuple[int, int]]], pairs: Callable[[pd.DataFrame, pd.DataFrame], np.ndarray] | None = None):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: list[pd.DataFrame] = []

        def edges(pdf: pd.DataFrame) -> pd.DataFrame:
            if pairs:
                pdf = pdf.iloc[np.lexsort((pdf["probe"], *(pdf[c] for c in reversed(_KEY))))]
            ids, probe, out = pdf["id"].to_numpy(np.int64), pdf["probe"].to_numpy(bool), []
            keys = pdf[_KEY].to_numpy(np.int64)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            starts, ends = np.array([0, *cuts], np.int64), np.array([*cuts, len(pdf)], np.int64)
            if pairs:
                probes = np.concatenate([[0], np.cumsum(probe)])
                probes = probes[ends] - probes[starts]
                size = probes * (ends - starts - probes)
                few = (size > 0) & (size <= FEW)
                out += set(_small(pdf, starts[few], ends[few], pairs))
                starts, ends = starts[size > FEW], ends[size > FEW]
            for a, b in zip(starts.tolist(), ends.tolist()):
                if b - a > 1 and (ids[a:b] != ids[a]).any():
                    out += links(pdf.iloc[a:b][~probe[a:b]], pdf.iloc[a:b][probe[a:b]])
            return pd.DataFrame(out, columns=["u", "v"], dtype="int64")

        for pdf in batches:
            if not len(pdf):
                continue
            keys = pdf[_KEY].to_numpy(np.int64)
            last = (keys == keys[-1]).all(axis=1)
            if kept and last.all() and (kept[-1][_KEY].to_numpy(np.int64)[-1] == keys[-1]).all():
                kept.append(pdf)
                continue
            cut = int(len(pdf) - last[::-1].argmin()) if not last.all() else 0
            yield edges(pd.concat([*kept, pdf.iloc[:cut]]))
            kept = [pdf.iloc[cut:]]
        if kept:
            yield edges(pd.concat(kept))

    return run


def bucket_links(rows: DataFrame, links: Callable[[pd.DataFrame, pd.DataFrame], list[tuple[int, int]]], block: int = BLOCK, pairs: Callable[[pd.DataFrame, pd.DataFrame], np.ndarray] | None = None) -> DataFrame:
    """Edges (u, v) between ids. ``links`` gets the other rows and the probe rows of a unit of work;
    ``pairs``, if given, as many rows of each from small units, and says which of them are linked.
    ``rows`` is read twice."""
    hot = checkpointed(
        rows.groupBy("part", "val")
        .agg(F.count(F.when(~F.col("probe"), 1)).alias("ni"), F.count(F.when(F.col("probe"), 1)).alias("np"))
        .where((F.greatest("ni", "np") > block) & (F.col("ni") > 0))
        .select("part", "val", F.ceil(F.col("ni") / block).cast("int").alias("ki"), F.ceil(F.greatest("np", F.lit(1)) / block).cast("int").alias("kp"))
    )
    n_hot, columns = hot.count(), rows.columns
    if n_hot:
        rows = rows.join(F.broadcast(hot) if n_hot <= BROADCAST_BUCKETS else hot, ["part", "val"], "left").fillna(1, ["ki", "kp"])
    else:
        rows = rows.withColumns({"ki": F.lit(1), "kp": F.lit(1)})
    at = F.pmod(F.xxhash64("id"), F.when(F.col("probe"), F.col("kp")).otherwise(F.col("ki"))).cast("int")
    rows = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.when(F.col("probe"), F.col("ki")).otherwise(F.col("kp")) - 1))).select(
        *columns, F.when(F.col("probe"), F.col("o")).otherwise(at).alias("bi"), F.when(F.col("probe"), at).otherwise(F.col("o")).alias("bp")
    )
    # a given number, as merging small partitions would leave few tasks for work that isn't small
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, *_KEY).sortWithinPartitions(*_KEY).mapInPandas(_verified(links, pairs), "u long, v long")
