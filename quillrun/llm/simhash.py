"""SimHash near-duplicates by the generalised pigeonhole principle.

A fingerprint has 64 bits over word shingles. Two fingerprints within ``radius`` differing bits
must, for any thresholds t_1..t_m with sum radius - m + 1, differ in at most t_i bits within some
partition i. Correlated bits are grouped into partitions; each fingerprint gets its own thresholds
by dynamic programming over candidate counts estimated from histograms of the partitions' values;
it then probes the values in those balls, and every candidate is verified on all 64 bits.

Defined results: a null or blank text has fingerprint zero and links like any other; repeated rows
and ties share a fingerprint and so a component; an empty table gives an empty result; other
columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillrun.llm.blocks import BLOCK, bucket_links, forest
from quillrun.llm.common import checkpointed, table
from quillrun.llm.components import connected_components

SEED = 42
#: Histograms have at most this many bits of a partition's value, whatever the corpus.
HISTOGRAM_BITS = 16


def fingerprint_of(text: str | None, shingle: int = 3) -> int:
    """The fingerprint as a signed 64-bit number."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(g, SEED) for g in grams), np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536].astype("<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


@F.pandas_udf(T.LongType())
def _fingerprint(texts: pd.Series) -> pd.Series:
    return pd.Series([fingerprint_of(t) for t in texts], dtype="int64")


def hex16(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _co_occurrence(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total, n = np.zeros((64, 64)), 0
    for pdf in batches:
        bits = np.unpackbits(pdf["fp"].to_numpy("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
        for at in range(0, len(bits), 65536):
            total += bits[at : at + 65536].T @ bits[at : at + 65536]
        n += len(bits)
    i, j = np.meshgrid(range(64), range(64), indexing="ij")
    yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "s": total.ravel(), "n": float(n)})


def group_bits(together: np.ndarray, n: float, m: int) -> list[list[int]]:
    """m groups of bit numbers, near equal in size: each grows by the bit most correlated with it."""
    p = np.diag(together) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(together / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd)
    np.fill_diagonal(corr, 0)
    left, groups = set(range(64)), []
    for width in [64 // m + (k < 64 % m) for k in range(m)]:
        rest = sorted(left)
        group = [max(rest, key=lambda b: (corr[b, rest].sum(), -b))]
        while len(group) < width:
            group.append(max((b for b in rest if b not in group), key=lambda b: (corr[b, group].sum(), -b)))
        left -= set(group)
        groups.append(group)
    return groups


def project(fps: np.ndarray, bits: list[int]) -> np.ndarray:
    """The value of a partition: its bits in order, first bit lowest."""
    fps, out = fps.view(np.uint64), np.zeros(len(fps), np.int64)
    for k, b in enumerate(bits):
        out |= ((fps >> np.uint64(b)) & np.uint64(1)).astype(np.int64) << k
    return out


def spheres(histogram: np.ndarray, radius: int) -> list[np.ndarray]:
    """For each e up to radius, the number of rows within e bits of each value of a full histogram."""
    width = len(histogram).bit_length() - 1
    values = np.arange(len(histogram))

    def around(h: np.ndarray) -> np.ndarray:
        return sum((h[values ^ (1 << b)] for b in range(width)), np.zeros(len(h)))

    shells = [np.zeros(len(histogram)), histogram.astype(float)]
    for e in range(1, radius + 1):  # around() counts each value of the next shell e times
        shells.append(np.maximum(0, (around(shells[-1]) - (width - e + 2) * shells[-2]) / e))
    return list(np.cumsum(shells[1:], axis=0))


def allocate(costs: np.ndarray, radius: int) -> np.ndarray:
    """Thresholds of each row: (rows, m), each -1..radius, with sum radius - m + 1 and the least sum
    of costs[row, partition, threshold + 1], by dynamic programming over the partitions."""
    rows, m, _ = costs.shape
    best, picks = np.full((rows, radius + m + 1), np.inf), []  # by the sum of (threshold + 1) so far
    best[:, 0] = 0
    for i in range(m):
        options = np.full((radius + 2, *best.shape), np.inf)
        for e in range(radius + 2):
            options[e, :, e:] = best[:, : best.shape[1] - e] + costs[:, i, e, None]
        picks.append(options.argmin(axis=0))
        best = options.min(axis=0)
    out, state = np.zeros((rows, m), np.int64), np.full(rows, radius + 1)
    for i in reversed(range(m)):
        out[:, i] = picks[i][np.arange(rows), state]
        state = state - out[:, i]
    return out - 1


def _prober(parts, counts, radius: int):
    """Rows (part, val, id, probe): each fingerprint once in every partition, and its probes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        near = [spheres(np.array(h), radius) for h in counts.value]
        masks = [[np.array([sum(1 << b for b in c) for c in combinations(range(len(bits)), e)], np.int64) for e in range(radius + 1)] for bits in parts]
        for pdf in batches:
            for at in range(0, len(pdf), 4096):
                fps = pdf["fp"].to_numpy(np.int64)[at : at + 4096]
                values = [project(fps, bits) for bits in parts]
                costs = np.zeros((len(fps), len(parts), radius + 2))
                for i, bits in enumerate(parts):
                    size = 0
                    for e in range(radius + 1):
                        size += len(masks[i][e])
                        scale = 2.0 ** (min(len(bits), HISTOGRAM_BITS) - len(bits))
                        costs[:, i, e + 1] = size + scale * near[i][e][values[i] & ((1 << HISTOGRAM_BITS) - 1)]
                limits = allocate(costs, radius)
                for i in range(len(parts)):
                    yield pd.DataFrame({"part": i, "val": values[i], "id": fps, "probe": False})
                    for e in range(radius + 1):
                        own = limits[:, i] >= e
                        if own.any():
                            n = len(masks[i][e])
                            yield pd.DataFrame({"part": i, "val": (values[i][own][:, None] ^ masks[i][e][None, :]).ravel(), "id": np.repeat(fps[own], n), "probe": True})

    return run


def partitions_for(n: int) -> int:
    """More partitions need fewer probes, fewer partitions give rarer values: set by the number of
    fingerprints alone; any choice finds the same links."""
    return 4 if n < 1 << 22 else 3 if n < 1 << 32 else 2


def near_links(fps: DataFrame, radius: int = 3, block: int = BLOCK) -> DataFrame:
    """Edges (u, v) that connect exactly the fingerprints that links of ``radius`` bits connect.

    ``fps`` has distinct longs in column fp. Within a bucket only a spanning forest is returned, so
    a bucket of n rows gives fewer than 2n edges. Buckets over ``block`` rows are cut into blocks on
    both sides, and every pair of blocks is one unit of work.
    """
    spark, sc = fps.sparkSession, fps.sparkSession.sparkContext
    n = fps.count()
    m = partitions_for(n)
    together, sums = np.zeros((64, 64)), fps.mapInPandas(_co_occurrence, "i int, j int, s double, n double").groupBy("i", "j").agg(F.sum("s").alias("s"))
    for r in sums.collect():  # 4096 rows
        together[r["i"], r["j"]] = r["s"]
    parts = group_bits(together, n, m)

    def histogram(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i, bits in enumerate(parts):
                v, c = np.unique(project(pdf["fp"].to_numpy(np.int64), bits[:HISTOGRAM_BITS]), return_counts=True)
                yield pd.DataFrame({"part": i, "val": v, "c": c})

    counts = [np.zeros(1 << min(len(bits), HISTOGRAM_BITS)) for bits in parts]
    for r in fps.mapInPandas(histogram, "part int, val long, c long").groupBy("part", "val").agg(F.sum("c").alias("c")).toLocalIterator():  # at most 2^16 a partition
        counts[r["part"]][r["val"]] = r["c"]
    rows = fps.mapInPandas(_prober(parts, sc.broadcast(counts), radius), "part int, val long, id long, probe boolean")

    def links(own: pd.DataFrame, probes: pd.DataFrame) -> list[tuple[int, int]]:
        x, q = np.unique(own["id"].to_numpy(np.int64)), np.unique(probes["id"].to_numpy(np.int64))
        return forest(np.bitwise_count(x.view(np.uint64)[:, None] ^ q.view(np.uint64)[None, :]) <= radius, x, q)

    return bucket_links(rows, links, block)


def row_keys() -> list:
    """Two hashes of a row's id and text, which together tell rows apart."""
    return [F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64("text", F.lit("row"), "doc_id").alias("k2")]


def simhash_groups(docs: DataFrame, radius: int = 3, block: int = BLOCK) -> DataFrame:
    """(doc_id, k1, k2, fp, root, component_id) for each row of docs: the fingerprint, the smallest
    fingerprint of its group and the smallest doc_id reachable."""
    rows = checkpointed(docs.select("doc_id", *row_keys(), _fingerprint("text").alias("fp")))
    fps = checkpointed(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = connected_components(near_links(fps.select("fp"), radius, block))
    of = fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = of.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(of.join(least, "root").select("fp", "root", "component_id"), "fp")


def one_of_each(docs: DataFrame, radius: int = 3, block: int = BLOCK) -> DataFrame:
    """docs with one row of each group: that of the smallest id, of equal ids that of the smallest
    text hash."""
    groups = simhash_groups(docs, radius, block)
    first = groups.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "k1", "k2")).alias("s"))
    kept = first.select(F.col("s.k1").alias("__k1"), F.col("s.k2").alias("__k2"))
    k1, k2 = row_keys()
    rows = docs.withColumns({"__k1": k1, "__k2": k2}).join(kept, ["__k1", "__k2"], "left_semi")
    return rows.dropDuplicates(["__k1", "__k2"]).select(docs.columns)


def op2_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents")).select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id")
