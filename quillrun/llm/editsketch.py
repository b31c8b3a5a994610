"""Document fingerprints by randomised edit embedding.

Every text is walked by the same random walk over its characters: at step j the character under the
pointer is written out, and a shared random coin of j and the character says whether the pointer
moves on. Texts a few edits apart soon walk in step again, so their walks differ in few places: edit
distance becomes Hamming distance. Bits are sampled from the walk - a shared random bit of each
sampled character - at places spread over a power of two that holds most of it.

A text of n code points has the scale s = bit length of n. Texts of any length are walked whole.

A fingerprint is "<s>:<block>:<block>" in hex, the blocks for the scales s and s + 1, so that texts
whose lengths straddle a power of two still share a scale. A block is the number of places that the
walk reaches and the bits, 0 beyond it. likeness() is 1 - 2 x differing bits / places reached by
either walk, at least 0; 1 for equal fingerprints; 0 where no scale is shared.

with_near() joins texts alike by banding: neighbouring places of a block form parts, so narrow that
fingerprints as like as wanted must share one of them whole (_parts()); those that share one are
candidates, and every candidate is verified by likeness. No link is missed, wherever the edits stand.

Defined results: null counts as empty; empty texts share a fingerprint; repeated rows and ids each
get a row, equal ids in the order of their texts' hashes, null ids first; a single row is its own
next; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillrun.llm.blocks import BLOCK, bucket_links, forest
from quillrun.llm.common import checkpointed, drop_stored, stored, table
from quillrun.llm.components import connected_components

SEED = 20_240_229
#: Bits sampled at each of the two scales of a fingerprint.
SAMPLES = 128
LEAST_SCALE = 5
#: Texts of so many code points are walked one by one, as few are left to walk beside; the walk is the same.
ALONE = 8192
#: Code points that are walked side by side; bounds the memory of a task.
TOGETHER = 3_000_000
#: The walk knows of a character a number below ALPHABET; coins repeat after PERIOD steps.
ALPHABET, PERIOD = 256, 4096
#: Rows of a run of neighbouring ids, which one task streams: so many, or the root of all if that is more.
RUN_ROWS = 1000

#: The likeness from which texts are near, and the widest parts of a block that are compared whole.
NEAR, MOST_PART_BITS = 0.8, 32

_RNG = np.random.Generator(np.random.PCG64(SEED))
COINS = _RNG.integers(0, 2, (PERIOD, ALPHABET), dtype=np.int64)
BITS = _RNG.integers(0, 2, (SAMPLES, ALPHABET), dtype=np.uint8)
_SPREAD = np.sort(_RNG.random(SAMPLES))


def places(scale: int) -> np.ndarray:
    """The steps sampled at a scale, ascending; a walk over 2^k characters takes 2^(k+1) on average."""
    return (_SPREAD * (2 << scale)).astype(np.int64)


def _characters(text: str) -> np.ndarray:
    """Code points as numbers below ALPHABET: ASCII as it is, others by hash."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return np.where(points < 128, points, 128 + ((points * np.uint32(2_654_435_761)) >> np.uint32(25))).astype(np.uint8)


def _stays() -> bytes:
    """For each step of a period and each character, how many steps the walk stays on it from there."""
    out, stay = np.zeros((PERIOD, ALPHABET), np.int64), np.zeros(ALPHABET, np.int64)
    for j in reversed(range(2 * PERIOD)):
        stay = np.where(COINS[j % PERIOD] == 1, 1, stay + 1)
        out[j % PERIOD] = stay
    if out.max() > 255:
        raise ValueError("a coin stays too long")
    return out.astype(np.uint8).tobytes()


_STAYS = _stays()


def _alone(chars: bytes, due: list[int]) -> bytes:
    """The characters under the walk at the steps due, ascending, as far as it reaches them."""
    seen, steps, j = bytearray(), iter(due), 0
    q = next(steps)
    for c in chars:
        j += _STAYS[(j & PERIOD - 1) << 8 | c]
        while q < j:
            seen.append(c)
            if (q := next(steps, -1)) < 0:
                return bytes(seen)
    return bytes(seen)


def _beside(parts: list[np.ndarray], scales: np.ndarray, due: dict[int, list[int]], seen: np.ndarray, reached: np.ndarray) -> None:
    """As _alone(), of many sequences step by step: into the rows of seen, and how many into reached."""
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    codes, start = np.concatenate([*parts, np.zeros(1, np.uint8)]), np.cumsum(sizes) - sizes
    at_step: dict[int, list[tuple[int, int]]] = {}
    for s in set(scales.tolist()):
        for i, q in enumerate(due[s]):
            at_step.setdefault(q, []).append((s, i))
    ids = np.flatnonzero(sizes > 0)
    p, end, own = start[ids], (start + sizes)[ids], scales[ids]
    stop = np.array([due[s][-1] + 1 for s in own.tolist()], np.int64)
    j = 0
    while len(ids):
        c = codes[p]
        for s, i in at_step.get(j, ()):
            at = own == s
            seen[ids[at], i] = c[at]
            reached[ids[at]] = i + 1
        p = p + COINS[j % PERIOD][c]
        j += 1
        live = (p < end) & (stop > j)
        if not live.all():
            ids, p, end, stop, own = ids[live], p[live], end[live], stop[live], own[live]


def fingerprints(texts: list[str]) -> list[str]:
    """Every text is walked once, whole, for both of its scales."""
    chars = [_characters(t) for t in texts]
    scales = np.array([max(LEAST_SCALE, len(c).bit_length()) for c in chars], np.int64)
    due = {s: sorted({*places(s).tolist(), *places(s + 1).tolist()}) for s in set(scales.tolist())}
    seen, reached = np.zeros((len(texts), 2 * SAMPLES), np.uint8), np.zeros(len(texts), np.int64)
    beside = np.array([len(c) < ALONE for c in chars], bool)
    if beside.any():
        ids = np.flatnonzero(beside)
        own, n = np.zeros((len(ids), 2 * SAMPLES), np.uint8), np.zeros(len(ids), np.int64)
        _beside([chars[i] for i in ids], scales[ids], due, own, n)
        seen[ids], reached[ids] = own, n
    for i in np.flatnonzero(~beside):
        found = _alone(chars[i].tobytes(), due[int(scales[i])])
        seen[i, : len(found)], reached[i] = np.frombuffer(found, np.uint8), len(found)
    blocks, every = [], np.arange(SAMPLES)
    for up in (0, 1):
        at = {s: np.searchsorted(q, places(s + up)) for s, q in due.items()}
        at = np.array([at[s] for s in scales.tolist()], np.int64).reshape(-1, SAMPLES)
        known = at < reached[:, None]
        bits = np.packbits(BITS[every, np.take_along_axis(seen, at, axis=1)] * known, axis=1)
        blocks.append([f"{int(k):02x}{b.tobytes().hex()}" for k, b in zip(known.sum(axis=1), bits)])
    return [f"{int(s):02x}:{a}:{b}" for s, a, b in zip(scales, *blocks)]


def likeness(a: list[str], b: list[str]) -> np.ndarray:
    """Of pairs of fingerprints, 0 to 1."""
    out = np.array([float(x == y) for x, y in zip(a, b)])
    for i, (x, y) in enumerate(zip(a, b)):
        (s, *own), (t, *other) = x.split(":"), y.split(":")
        apart = int(t, 16) - int(s, 16)
        if x == y or abs(apart) > 1:
            continue
        p, q = own[max(0, apart)], other[max(0, -apart)]
        most = max(int(p[:2], 16), int(q[:2], 16))
        out[i] = max(0.0, 1 - 2 * (int(p[2:], 16) ^ int(q[2:], 16)).bit_count() / most) if most else 0.0
    return out.round(6)


def _edited(text: str, following: str) -> str:
    m = len(text) // 4
    return text[: len(text) - m] + following[:m]


def _report(docs: list[tuple], following: str) -> pd.DataFrame:
    """Of consecutive (doc_id, text); ``following`` stands after the last."""
    texts = [t for _, t in docs]
    edits = [_edited(t, f) for t, f in zip(texts, [*texts[1:], following])]
    found = fingerprints([*texts, following, *edits])
    n = len(texts)
    own, after, edited = found[:n], found[1 : n + 1], found[n + 1 :]
    return pd.DataFrame({
        "doc_id": pd.array([i for i, _ in docs], "Int64"), "n_chars": [len(t) for t in texts], "edited_sha256": [hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest() for e in edits],
        "fingerprint": own, "edited_fingerprint": edited, "near_edited": likeness(own, edited), "near_next": likeness(own, after),
    })


def _streamed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by run, carry, id. The last row of a run waits for its carry, the next run's first."""
    docs, run, size = [], None, 0
    for pdf in batches:
        for b, carry, known, i, text in zip(pdf["run"], pdf["carry"], pdf["known"], pdf["id"], pdf["text"]):
            if b != run:
                docs, run, size = [], b, 0
            if size >= TOGETHER or carry and docs:
                yield _report(docs, text)
                docs, size = [], 0
            if not carry:
                docs.append((int(i) if known else None, text))
                size += len(text)


def runs_of(docs: DataFrame) -> DataFrame:
    """(run, carry, known, id, hash, text): every row in its run of neighbouring ids and, with carry, the
    first row of the run that follows (after the last run, of the first).

    Only run limits and the first key of each run reach the driver: as many as the root of the rows at
    most. Null ids, and an id that many rows have, are split by the hashes of their texts.
    """
    rows = docs.select(F.col("doc_id").isNotNull().alias("known"), F.coalesce("doc_id", F.lit(0)).cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("hash", F.xxhash64("text"))
    n, with_id = rows.agg(F.count(F.lit(1)), F.count(F.when(F.col("known"), 1))).first()
    each = max(RUN_ROWS, math.isqrt(n))
    parts, unknown = max(1, with_id // each), max(1, (n - with_id) // each)
    limits = np.array(sorted(map(int, rows.where("known").approxQuantile("id", [k / parts for k in range(1, parts)], 0.2 / parts))) if parts > 1 else [], np.int64)

    @F.pandas_udf("int")
    def run_of(known: pd.Series, ids: pd.Series, hashes: pd.Series) -> pd.Series:
        ids, share = ids.to_numpy(np.int64), hashes.to_numpy(np.float64) / 2.0**64 + 0.5
        first, last = np.searchsorted(limits, ids, side="left"), np.searchsorted(limits, ids, side="right")
        # an id that is several limits has as many runs of its own
        run = np.where(last - first > 1, first + 1 + np.minimum(share * (last - first), last - first - 1), last)
        return pd.Series(np.where(known, run, np.minimum(share * unknown, unknown - 1) - unknown).astype("int32"))

    rows = rows.withColumn("run", run_of("known", "id", "hash"))
    key = F.struct("known", "id", "hash")
    firsts = rows.groupBy("run").agg(F.min(key).alias("k")).orderBy("run").collect()
    at = {r["run"]: (firsts[k - 1]["run"], (r["k"]["known"], r["k"]["id"], r["k"]["hash"])) for k, r in enumerate(firsts)}

    @F.pandas_udf("int")
    def carried_to(run: pd.Series, known: pd.Series, ids: pd.Series, hashes: pd.Series) -> pd.Series:
        return pd.Series([at[b][0] if b in at and at[b][1] == k else None for b, k in zip(run, zip(known, ids, hashes))], dtype="Int32")

    sent = F.struct(F.col("run").alias("run"), F.lit(False).alias("carry"))
    also = F.struct(F.col("to").alias("run"), F.lit(True).alias("carry"))
    rows = rows.withColumn("to", carried_to("run", "known", "id", "hash"))
    return rows.select(F.inline(F.when(F.col("to").isNull(), F.array(sent)).otherwise(F.array(sent, also))), "known", "id", "hash", "text")


def edit_report(docs: DataFrame) -> DataFrame:
    """One row per row of docs: its fingerprint, its edited text's, and both likenesses."""
    rows = runs_of(docs).repartition("run").sortWithinPartitions("run", "carry", "known", "id", "hash")
    return rows.select("run", "carry", "known", "id", "text").mapInPandas(
        _streamed, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )


@F.pandas_udf(T.StringType())
def fingerprint(texts: pd.Series) -> pd.Series:
    out: list[str] = []
    at = 0
    sizes = [len(t or "") for t in texts]
    while at < len(sizes):
        to, size = at, 0
        while to < len(sizes) and (to == at or size + sizes[to] <= TOGETHER):
            size += sizes[to]
            to += 1
        out += fingerprints([t or "" for t in texts.iloc[at:to]])
        at = to
    return pd.Series(out, dtype="object")


def _limits(least: float) -> tuple[np.ndarray, int]:
    """For each number of places the most differing bits at a likeness of ``least``, and the widest
    parts of which any number of places has more than such bits."""
    most = [max((d for d in range(k + 1) if round(1 - 2 * d / k, 6) >= least), default=-1) for k in range(1, SAMPLES + 1)]
    fits = [w for w in range(1, MOST_PART_BITS + 1) if all(d < -(-k // w) for k, d in enumerate(most, 1))]
    if not fits:
        raise ValueError("least must be above -1")
    return np.array([-1, *most], np.int64), fits[-1]


def _parts(least: float):
    """Fingerprints (id, fp) to rows (part, val, id, probe, k, b0, b1), by the pigeonhole principle.

    Of two blocks let K be the places of the longer, d the most bits that may differ, and U the parts
    that the shorter reaches. Beyond those it has zeros, so each one of the longer there differs. With o
    such ones, d - o bits at most differ within the U parts, and of any d - o + 1 parts one is equal. So
    a block is to be found by its U and the values of its parts, and probes for each U up to its own
    with d - o + 1 values; where there are no more parts than d - o, with all blocks of that U.
    """
    limits, width = _limits(least)
    total = -(-SAMPLES // width)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fps = [f.split(":") for f in pdf["fp"]]
            ids, scales = pdf["id"].to_numpy(np.int64), np.array([int(f[0], 16) for f in fps], np.int64)
            for up in (0, 1):
                k = np.array([int(f[1 + up][:2], 16) for f in fps], np.int64)
                raw = np.frombuffer(b"".join(bytes.fromhex(f[1 + up][2:]) for f in fps), np.uint8).reshape(-1, SAMPLES // 8)
                words, bits = np.ascontiguousarray(raw).view("<i8"), np.unpackbits(raw, axis=1).astype(np.int64)
                bits = np.concatenate([bits, np.zeros((len(fps), total * width - SAMPLES), np.int64)], axis=1).reshape(-1, total, width)
                values, ones = bits @ (1 << np.arange(width)), bits.sum(axis=2)
                beyond = np.concatenate([ones[:, ::-1].cumsum(axis=1)[:, ::-1], np.zeros((len(fps), 1), np.int64)], axis=1)  # ones from each part on
                own, scale = -(-k // width), scales + up

                def rows(at: np.ndarray, to: int, u, part, val, probe: bool) -> pd.DataFrame:
                    # the scale, which of its blocks is looked for, its parts, and the part, total for all
                    key = ((scale[at] * 2 + to) * (total + 1) + u) * (total + 1) + part
                    return pd.DataFrame({"part": key.astype(np.int32), "val": val, "id": ids[at], "probe": probe, "k": k[at].astype(np.int32), "b0": words[at, 0], "b1": words[at, 1]})

                at, part = np.nonzero(np.arange(total)[None, :] < own[:, None])
                yield rows(at, up, own[at], part, values[at, part], False)
                at = np.flatnonzero(own)
                yield rows(at, up, own[at], total, np.zeros(len(at), np.int64), False)
                for u in range(1, total + 1):
                    wanted = np.where(own >= u, limits[k] - beyond[:, u] + 1, 0)
                    at, part = np.nonzero(np.arange(u)[None, :] < np.where(wanted > u, 0, wanted)[:, None])
                    every = np.flatnonzero(wanted > u)
                    for to in (0, 1) if up == 0 else (0,):
                        yield rows(at, to, u, part, values[at, part], True)
                        yield rows(every, to, u, total, np.zeros(len(every), np.int64), True)

    return run


def near_classes(fps: DataFrame, least: float = NEAR, block: int = BLOCK) -> DataFrame:
    """(id, root): of the fingerprints fp with their ids, longs, those of which some other has a
    likeness of ``least`` or more, and the smallest id that such links join. Exact."""
    limits = _limits(least)[0]
    rows = fps.mapInPandas(_parts(least), "part int, val long, id long, probe boolean, k int, b0 long, b1 long")
    held = stored(rows)
    # the scales, blocks and numbers of parts that some probe for and others have: some hundreds
    kinds = held.groupBy("part").agg(F.countDistinct("probe").alias("n")).where("n = 2").select("part").collect()
    rows = held.where(F.col("part").isin(sorted(r["part"] for r in kinds)))

    def near(x: pd.DataFrame, q: pd.DataFrame, outer: bool) -> np.ndarray:
        own, other = ([t[c].to_numpy(np.int64) for c in ("b0", "b1", "k")] for t in (x, q))
        if outer:
            own, other = [c[:, None] for c in own], [c[None, :] for c in other]
        diff = sum(np.bitwise_count((own[b] ^ other[b]).view(np.uint64)).astype(np.int64) for b in (0, 1))
        return diff <= limits[np.maximum(own[2], other[2])]

    def links(own: pd.DataFrame, probes: pd.DataFrame) -> list[tuple[int, int]]:
        x, q = own.drop_duplicates(["id", "k", "b0", "b1"]), probes.drop_duplicates(["id", "k", "b0", "b1"])
        return forest(near(x, q, True), x["id"].to_numpy(np.int64), q["id"].to_numpy(np.int64))

    found = checkpointed(bucket_links(rows, links, block, lambda x, q: near(x, q, False)))
    drop_stored(held)
    return connected_components(found).select(F.col("node").alias("id"), "root")


def with_near(rows: DataFrame, least: float = NEAR, block: int = BLOCK) -> DataFrame:
    """rows, read twice, with component_id: the smallest doc_id of the rows whose fingerprints links of
    likeness ``least`` or more join."""
    reps = checkpointed(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("least")).select(F.xxhash64("fingerprint").alias("id"), F.col("fingerprint").alias("fp"), "least"))
    of = reps.join(near_classes(reps.select("id", "fp"), least, block), "id", "left").select("fp", "least", F.coalesce("root", "id").alias("root"))
    small = of.groupBy("root").agg(F.min("least").alias("component_id"))
    of = of.join(small, "root").select(F.col("fp").alias("fingerprint"), "component_id")
    return rows.join(of, "fingerprint").select(*rows.columns, "component_id")


def near_groups(docs: DataFrame, least: float = NEAR, block: int = BLOCK) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of docs: see with_near()."""
    return with_near(checkpointed(docs.select("doc_id", fingerprint("text").alias("fingerprint"))), least, block)


def op8_edit_fingerprints(spark, sf_dir: str) -> DataFrame:
    return with_near(stored(edit_report(table(spark, sf_dir, "documents"))))
