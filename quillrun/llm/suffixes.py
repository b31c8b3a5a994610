"""Suffix-array dedup: removes every byte covered by a string of ``length`` bytes that also starts
anywhere else in the corpus, the same document included.

1. Each start of a full-length string has a minimiser: the least hash of the GRAM-byte strings within
   it, of equals the last. Equal strings have equal minimisers at equal offsets. Neighbouring starts
   with one minimiser form a run; a run's context is the bytes that its strings cover.
2. Runs whose minimiser's hash occurs once in the corpus can't hold repeated strings. Of the rest,
   equal contexts are counted, and become one representative each.
3. The representatives that share a hash with others are dealt to tasks by that hash, their contexts
   cut from the texts, and their suffixes sorted in two stages: those smaller than their successors
   are sorted directly, the rest induced by scans over the buckets of first bytes. Neighbours in
   suffix order with a common prefix of the full length are repeats.
4. Repeated starts go back to all runs of an equal context, and documents are cut.

Of hashes with over HOT_CONTEXTS different contexts, single strings are counted by a 128-bit hash
instead. Such counts are summed before they are shuffled, and a join gives them back to their starts,
so a task sorts HOT_CONTEXTS contexts of a hash at most, whatever the surroundings of a common passage.
Rows equal in id and text share one set of spans, and a task cuts the contexts of such rows once.

Defined results: null counts as empty; texts shorter than the length are kept whole; repeated rows
are each other's repeats; several rows may share a doc_id; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillrun.llm.common import Seen, checkpointed, drop_stored, stored, table

LENGTH = 400
GRAM = 160
#: Bytes that are hashed together; a power of two up to 2^20.
SEGMENT = 1 << 19
#: Bytes of contexts whose suffixes are sorted together.
SORTED_TOGETHER = 1 << 20
#: Different contexts of a hash that are sorted together at most.
HOT_CONTEXTS = 512
_BASE = np.uint64(0x9E3779B97F4A7C15)
_POSITION = np.uint64((1 << 20) - 1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base), np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(out, dtype=np.uint64)


class _Scanner:
    def __init__(self, length: int, gram: int):
        self.length, self.gram, self.width = length, gram, length - gram + 1
        n = SEGMENT + 2 * length
        self.up, self.down = _powers(int(_BASE), n), _powers(pow(int(_BASE), -1, 1 << 64), n)

    def gram_hashes(self, data: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[: len(data)], dtype=np.uint64)])
            h = (sums[self.gram :] - sums[: -self.gram]) * self.down[: len(sums) - self.gram]
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            return h ^ h >> np.uint64(32)

    def runs(self, data: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of texts laid end to end (from starts to ends): for each run its text's number, first start,
        number of starts, minimiser's place and hash."""
        h = self.gram_hashes(np.frombuffer(data, np.uint8))
        order = (h & ~_POSITION) | (_POSITION - np.arange(len(h), dtype=np.uint64))
        n = len(order) - self.width + 1
        blocks = np.concatenate([order, np.full(-len(order) % self.width, ~np.uint64(0))]).reshape(-1, self.width)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(behind[:n], ahead[self.width - 1 : self.width - 1 + n])
        new = np.concatenate([[True], least[1:] != least[:-1]])
        new[starts[starts < n]] = True
        text = np.repeat(np.arange(len(starts)), ends - starts)[:n]
        valid = np.arange(n) + self.length <= ends[text]
        first = np.flatnonzero(new & valid)
        stop = np.minimum(np.append(np.flatnonzero(new), n)[np.searchsorted(np.flatnonzero(new), first, side="right")], ends[text[first]] - self.length + 1)
        place = (_POSITION - (least[first] & _POSITION)).astype(np.int64)
        return text[first], first, stop - first, place, h[place].view(np.int64)


def _scan(length: int, gram: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = _Scanner(length, gram)

        def emit(parts: list[tuple]) -> pd.DataFrame:
            """parts: (id, key, offset in the document, bytes)."""
            data = b"".join(p[3] for p in parts)
            ends = np.cumsum([len(p[3]) for p in parts])
            starts = ends - [len(p[3]) for p in parts]
            text, first, n, place, h = scanner.runs(data, starts, ends)
            whole = xxhash.xxh3_64_intdigest
            c = np.fromiter((whole(data[a : a + m]) for a, m in zip(first.tolist(), (n + length - 1).tolist())), np.uint64, len(first))
            shift = np.array([p[2] for p in parts], np.int64) - starts
            return pd.DataFrame({
                "h": h, "c": c.view(np.int64), "n": n.astype(np.int32), "d": (place - first).astype(np.int32),
                "id": np.array([p[0] for p in parts], np.int64)[text], "key": np.array([p[1] for p in parts], np.int64)[text], "p": first + shift[text],
            })

        parts: list[tuple] = []
        size = 0
        for pdf in batches:
            for i, k, t in zip(pdf["id"], pdf["key"], pdf["text"]):
                data = t.encode("utf-8", "surrogatepass")
                for at in range(0, len(data) - length + 1, SEGMENT // 2):
                    piece = data[at : at + SEGMENT // 2 + length - 1]
                    if parts and size + len(piece) > SEGMENT:
                        yield emit(parts)
                        parts, size = [], 0
                    parts.append((i, k, at, piece))
                    size += len(piece)
        if parts:
            yield emit(parts)

    return run


def suffix_order(contexts: list[bytes], counts: list[int], length: int) -> tuple[bytes, np.ndarray]:
    """The contexts joined (one byte between), and the places of their first ``counts`` suffixes each,
    in an order where those with equal first ``length`` bytes are neighbours.

    A suffix is small if it is smaller than its successor. Small ones are sorted directly. Each other
    one begins a bucket's first part: a scan over the buckets in order puts the predecessors of what
    it meets behind what their buckets already hold. Where the last suffix wanted is not small, the
    chain goes on to the next small one, or to the end of the context, which is smaller than all.
    """
    text = b"\0".join(contexts) + b"\0"
    data = np.frombuffer(text, np.uint8).astype(np.int16)
    sizes = np.array([len(c) for c in contexts])
    starts = np.cumsum(sizes + 1) - (sizes + 1)
    data[starts + sizes] = -1  # the end of a context
    n = len(data)
    # small: the next place where the bytes change has a rise
    change = np.flatnonzero(data[1:] != data[:-1])
    nxt = change[np.minimum(np.searchsorted(change, np.arange(n)), len(change) - 1)]
    small = np.zeros(n, bool)
    small[: n - 1] = (data[nxt] < data[np.minimum(nxt + 1, n - 1)])[: n - 1]
    small[starts + sizes] = True
    smalls = np.flatnonzero(small)
    last = smalls[np.searchsorted(smalls, starts + np.array(counts) - 1)]  # ends every chain
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, last + 1, -1)
    wanted = np.cumsum(edge)[:n] > 0
    ends = np.repeat(starts + sizes, sizes + 1)
    direct = np.flatnonzero(wanted & small & (data >= 0))
    keys = [text[a:b] for a, b in zip(direct.tolist(), np.minimum(direct + length, ends[direct]).tolist())]
    direct = direct[sorted(range(len(direct)), key=keys.__getitem__)] if len(direct) else direct
    bounds = np.searchsorted(data[direct], np.arange(257))
    queue: list[list[np.ndarray]] = [[] for _ in range(256)]

    def induce(met: np.ndarray, above: int) -> None:
        before = met[met > 0] - 1
        before = before[wanted[before] & ~small[before] & (data[before] > above)]
        by = np.argsort(data[before], kind="stable")
        before = before[by]
        cut = np.flatnonzero(np.diff(data[before])) + 1
        for part in np.split(before, cut) if len(before) else []:
            queue[data[part[0]]].append(part)

    induce(np.flatnonzero(wanted & (data < 0)), -1)
    out = []
    for b in range(256):
        layer = np.concatenate(queue[b]) if queue[b] else np.zeros(0, np.int64)
        met = [layer]
        while len(layer):  # runs of one byte
            layer = layer[layer > 0] - 1
            layer = layer[wanted[layer] & ~small[layer] & (data[layer] == b)]
            met.append(layer)
        met.append(direct[bounds[b] : bounds[b + 1]])
        bucket = np.concatenate(met)
        if len(bucket):
            induce(bucket, b)
            out.append(bucket)
    order = np.concatenate(out) if out else np.zeros(0, np.int64)
    inside = np.zeros(n + 1, np.int32)
    np.add.at(inside, starts, 1)
    np.add.at(inside, starts + np.array(counts), -1)
    return text, order[np.cumsum(inside)[:n][order] > 0]


def repeated(contexts: list[bytes], counts: list[int], length: int) -> list[np.ndarray]:
    """For each context, which of its first ``counts`` starts hold a string of another start."""
    text, order = suffix_order(contexts, counts, length)
    places = order.tolist()
    same = np.fromiter((text[a : a + length] == text[b : b + length] for a, b in zip(places, places[1:])), bool, max(0, len(places) - 1))
    twice = np.zeros(len(text), bool)
    twice[order[:-1][same]] = True
    twice[order[1:][same]] = True
    at, out = 0, []
    for c, n in zip(contexts, counts):
        out.append(twice[at : at + n])
        at += len(c) + 1
    return out


def _spans(marks: np.ndarray) -> list[tuple[int, int]]:
    edge = np.diff(np.concatenate([[0], marks.astype(np.int8), [0]]))
    return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()))


def _cut(length: int, gram: int):
    """Rows (doc's text, its representatives) to pieces: (k0, k1, h, c, from, n, context), dealt by hash.
    Of hot hashes each start is a piece without a context, dealt by 128 bits of its string."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = Seen()
        for pdf in batches:
            out: list[tuple] = []
            size = 0
            own = zip(pdf["id"], pdf["key"]) if "id" in pdf else repeat(None)  # rows without an identity are all cut
            for identity, t, reps in zip(own, pdf["text"], pdf["reps"]):
                if identity is not None and seen.again(identity):
                    continue
                data = t.encode("utf-8", "surrogatepass")
                for r in reps:
                    h, c, p, n, d = (int(r[x]) for x in ("h", "c", "p", "n", "d"))
                    if r["hot"]:
                        keys = np.frombuffer(b"".join(xxhash.xxh3_128_digest(data[j : j + length]) for j in range(p, p + n)), "<i8").reshape(-1, 2)
                        out += [(k0, k1, h, c, j, 1, None) for j, (k0, k1) in enumerate(keys.tolist())]
                        size += 100 * n
                    else:
                        out.append((h, 0, h, c, 0, n, data[p : p + n + length - 1]))
                        size += n + length
                    if size > 1 << 23:
                        yield pd.DataFrame(out, columns=["k0", "k1", "h", "c", "a", "n", "context"])
                        out, size = [], 0
            yield pd.DataFrame(out, columns=["k0", "k1", "h", "c", "a", "n", "context"])

    return run


def _sort(length: int):
    """Pieces sorted by key to spans of repeated starts: (h, c, a, b), relative to the run."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        size, key, last = 0, None, None

        def marked() -> pd.DataFrame:
            found = repeated([x[3] for x in held], [x[2] for x in held], length)
            rows = [(h, c, a + s, a + e) for (h, c, _, _, a), marks in zip(held, found) for s, e in _spans(marks)]
            return pd.DataFrame(rows, columns=["h", "c", "a", "b"], dtype="int64")

        for pdf in batches:
            for k0, k1, h, c, a, n, context in zip(*(pdf[x] for x in ("k0", "k1", "h", "c", "a", "n", "context"))):
                if size >= SORTED_TOGETHER and (k0, k1) != key:  # a key's pieces stay together
                    yield marked()
                    held, size = [], 0
                if (h, c, a) == last:  # of another row with the same id and text
                    continue
                key, last = (k0, k1), (h, c, a)
                held.append((h, c, n, context, a))
                size += len(context)
        if held:
            yield marked()

    return run


def _identity(docs: DataFrame | None = None) -> list[Column]:
    """A row's id, -1 without one, and a hash of id and text: both never null."""
    doc_id, text = (docs["doc_id"], docs["text"]) if docs is not None else (F.col("doc_id"), F.col("text"))
    return [F.coalesce(doc_id, F.lit(-1)).cast("long").alias("id"), F.xxhash64(doc_id, text).alias("key")]


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(id, key, spans): the starts of repeated strings of each text that has any, as array<struct<a, b>>
    in any order, b exclusive, in bytes of UTF-8. id and key are those of _identity()."""
    texts = docs.select(*_identity(), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    runs = stored(texts.where(F.octet_length("text") >= length).mapInPandas(_scan(length, gram), "h long, c long, n int, d int, id long, key long, p long"))
    twice = checkpointed(runs.groupBy("h").agg(F.count(F.lit(1)).alias("t")).where("t > 1").select("h"))
    likely = stored(runs.join(twice, "h"))
    drop_stored(runs)
    contexts = likely.groupBy("h", "c").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("id", "key", "p", "n", "d")).alias("r"))
    contexts = checkpointed(contexts.select("h", "c", "copies", "r.*"))
    several = checkpointed(contexts.groupBy("h").agg(F.count(F.lit(1)).alias("k")).where("k > 1"))
    reps = contexts.join(several, "h").select("id", "key", F.struct("h", "c", "p", "n", "d", (F.col("k") > HOT_CONTEXTS).alias("hot")).alias("rep"))
    reps = reps.groupBy("id", "key").agg(F.collect_list("rep").alias("reps"))
    pieces = texts.join(reps, ["id", "key"]).select("id", "key", "text", "reps")
    pieces = pieces.mapInPandas(_cut(length, gram), "k0 long, k1 long, h long, c long, a int, n int, context binary")
    pieces = stored(pieces)
    told = pieces.where("context is not null").repartition("k0", "k1").sortWithinPartitions("k0", "k1", "h", "c", "a").mapInPandas(_sort(length), "h long, c long, a int, b int")
    singles = pieces.where("context is null").select("k0", "k1", "h", "c", "a").distinct()
    again = singles.join(singles.groupBy("k0", "k1").agg(F.count(F.lit(1)).alias("t")).where("t > 1").select("k0", "k1"), ["k0", "k1"])
    # starts in a row become one span; a context has no more starts than a minimiser's strings have offsets
    island = (F.col("a") - F.row_number().over(Window.partitionBy("h", "c").orderBy("a"))).alias("i")
    told = told.unionByName(again.select("h", "c", "a", island).groupBy("h", "c", "i").agg(F.min("a").alias("a"), (F.max("a") + 1).alias("b")).drop("i"))
    whole = contexts.where("copies > 1").select("h", "c", F.lit(0).alias("a"), F.col("n").alias("b"))
    marks = checkpointed(told.unionByName(whole).groupBy("h", "c").agg(F.collect_set(F.struct("a", "b")).alias("m")))
    drop_stored(pieces)
    starts = likely.join(marks, ["h", "c"]).select("id", "key", F.transform("m", lambda m: F.struct((F.col("p") + m["a"]).alias("a"), (F.col("p") + m["b"]).alias("b"))).alias("s"))
    found = checkpointed(starts.groupBy("id", "key").agg(F.flatten(F.collect_set("s")).alias("spans")))
    drop_stored(likely)
    return found


def _removed(spans, length: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes that strings of the given starts cover."""
    out: list[list[int]] = []
    for a, b in sorted((int(s["a"]), int(s["b"]) + length - 1) for s in spans) if spans is not None else ():
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _kept(data: bytes, removed: list[tuple[int, int]]) -> bytes:
    return b"".join(data[a:b] for a, b in zip([0, *(b for _, b in removed)], [*(a for a, _ in removed), len(data)]))


def _reported(length: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for t, spans in zip(pdf["text"], pdf["spans"]):
                data, removed = t.encode("utf-8", "surrogatepass"), _removed(spans, length)
                rows.append((len(data), sum(b - a for a, b in removed), len(removed), hashlib.sha256(_kept(data, removed)).hexdigest()))
            out = pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256"])
            yield pd.concat([pdf[["known", "id"]].reset_index(drop=True), out], axis=1)

    return run


def _with_spans(docs: DataFrame, length: int, gram: int) -> tuple[DataFrame, Column]:
    found = repeated_spans(docs, length, gram)
    own_id, own_key = _identity(docs)
    return docs.join(found, (own_id == found["id"]) & (own_key == found["key"]), "left"), found["spans"]


def dedup_report(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    rows, spans = _with_spans(docs.select("doc_id", "text"), length, gram)
    rows = rows.select(F.col("doc_id").isNotNull().alias("known"), F.coalesce("doc_id", F.lit(0)).cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text"), spans.alias("spans"))
    rows = rows.mapInPandas(_reported(length), "known boolean, id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return rows.select(F.when(F.col("known"), F.col("id")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """docs with repeated bytes cut from text; characters that lose a byte lose all of them."""

    @F.pandas_udf("string")
    def kept(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([t if s is None or t is None else _kept(t.encode("utf-8", "surrogatepass"), _removed(s, length)).decode("utf-8", "ignore") for t, s in zip(texts, spans)], dtype="object")

    rows, spans = _with_spans(docs, length, gram)
    return rows.select(*(kept(docs["text"], spans).alias(c) if c == "text" else docs[c] for c in docs.columns))


def op4_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """dedup_report() of all documents, and has_repeats: 1 where anything was removed, else 0."""
    return dedup_report(table(spark, sf_dir, "documents")).withColumn("has_repeats", (F.col("n_removed") > 0).cast("int"))


#: The rows of op4 by counting every 400-byte window, cut from blocks of 512 starts; bytes are hex digits,
#: and windows are told apart by MD5.
OP4_SQL = r"""
WITH d AS (SELECT row_number() OVER () r, doc_id, hex(encode(coalesce(text, ''))) h FROM documents),
blocks AS (SELECT r, b, substr(h, 2 * b + 1, 1822) t FROM (SELECT r, h, unnest(range(0, length(h) // 2 - 399, 512)) b FROM d)),
starts AS (SELECT r, b, t, unnest(range(0, least(512, length(t) // 2 - 399))) i FROM blocks),
windows AS (SELECT r, b + i i, md5(substr(t, 2 * i + 1, 800)) k FROM starts),
repeats AS (SELECT k FROM windows GROUP BY k HAVING count(*) > 1),
hits AS (SELECT r, i FROM windows SEMI JOIN repeats USING (k)),
marked AS (SELECT r, i, (i > coalesce(lag(i) OVER (PARTITION BY r ORDER BY i) + 400, -1))::INT apart FROM hits),
numbered AS (SELECT r, i, sum(apart) OVER (PARTITION BY r ORDER BY i) run FROM marked),
runs AS (SELECT r, min(i) a, max(i) + 400 b FROM numbered GROUP BY r, run),
pieces AS (SELECT r, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) a, a b FROM runs UNION ALL SELECT r, max(b), NULL FROM runs GROUP BY r),
kept AS (SELECT r, string_agg(substr(h, 2 * a + 1, 2 * (coalesce(b, length(h) // 2) - a)), '' ORDER BY a) k FROM pieces JOIN d USING (r) GROUP BY r),
removed AS (SELECT r, sum(b - a) n, count(*) spans FROM runs GROUP BY r)
SELECT doc_id, (length(h) // 2)::BIGINT n_bytes, coalesce(n, 0)::BIGINT n_removed, coalesce(spans, 0)::BIGINT n_spans,
  sha256(unhex(coalesce(k, h))) kept_sha256, (coalesce(n, 0) > 0)::INT has_repeats
FROM d LEFT JOIN removed USING (r) LEFT JOIN kept USING (r)
"""
