"""Substring dedup by seed and extend: removes every word covered by a passage of WINDOW words that also
starts earlier: in a document of a smaller id, or before it in the same one.

1. Seeds. Of the GRAM-word strings in each window of WINDOW words the one of the least hash is its
   anchor (winnowing), so equal windows have equal anchors at equal offsets. Neighbouring windows with one
   anchor form a run; its context is the words they cover. Anchors that occur once can't be repeats.
2. Join. Documents meet on the anchors that are left. Occurrences of an equal context match all along:
   all but the earliest repeat it. The earliest stands for its context in what follows.
3. Extend. The contexts of an anchor are compared word by word, outwards to the left and to the right,
   all of them at once: those that agree so far share a class, and each step divides the classes by
   the next word. A window with o words left of its anchor has a match where another context is in its
   class of o words to the left and in its class of the rest to the right; the earliest one stays.
4. Windows that have an earlier match and follow each other make maximal repeats, of WINDOW words or more.

No pairs of occurrences are made. Anchors with over HOT_CONTEXTS different contexts aren't gathered:
their windows are counted one by one under 128-bit hashes of their words, in partial sums. Contexts are
equal where two 64-bit hashes of their words are.

Defined results: null has no words; documents of fewer words are kept whole; a null id is smaller than any
other; rows of one id are different documents, in the order of a hash of their texts, but rows equal in id
and text are one document, with one result each; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillrun.llm.common import Seen, checkpointed, drop_stored, stored, table

WINDOW, GRAM = 20, 8
#: Words that are hashed together, up to 2^19.
SEGMENT = 1 << 18
#: Bytes of a text that are split into words at once.
PIECE = 1 << 20
#: Different contexts of an anchor that are compared in one task at most.
HOT_CONTEXTS = 4096
#: Contexts that are compared together.
TOGETHER = 16_384
#: Words whose hashes a task remembers.
REMEMBERED = 1 << 18
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_POSITION = np.uint64((1 << 20) - 1)
NULL_ID = -(1 << 63)


class _Hashes(dict):
    """Hash of a word; forgets all when it has become too large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def pieces(data: bytes) -> Iterator[bytes]:
    """A text in parts that end between words."""
    at = 0
    while at < len(data):
        cut = _SPACE.search(data, at + PIECE)
        end = cut.start() if cut else len(data)
        yield data[at:end]
        at = end


def word_hashes(data: bytes, known: _Hashes) -> np.ndarray:
    parts = [np.fromiter(map(known.__getitem__, words), np.uint64, len(words)) for words in (p.split() for p in pieces(data))]
    return parts[0] if len(parts) == 1 else np.concatenate([np.zeros(0, np.uint64), *parts])


def anchors(h: np.ndarray, starts: np.ndarray, ends: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Of documents laid end to end (from starts to ends in the word hashes h): for each run its
    document's number, first window, number of windows, its anchor's place and hash."""
    with np.errstate(over="ignore"):
        g = np.zeros(len(h) - gram + 1, np.uint64)
        for j in range(gram):
            g = g * _BASE + h[j : j + len(g)]
        g ^= g >> np.uint64(29)
        g *= _MIX
        g ^= g >> np.uint64(32)
    order = (g & ~_POSITION) | np.arange(len(g), dtype=np.uint64)
    width, n = window - gram + 1, len(h) - window + 1
    span, least = 1, order
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    least = np.minimum(least[:n], least[width - span : width - span + n])
    new = np.concatenate([[True], least[1:] != least[:-1]])
    new[starts[starts < n]] = True
    document = np.repeat(np.arange(len(starts)), ends - starts)[:n]
    heads = np.flatnonzero(new)
    first = heads[heads + window <= ends[document[heads]]]
    stop = np.minimum(np.append(heads, n)[np.searchsorted(heads, first, side="right")], ends[document[first]] - window + 1)
    place = (least[first] & _POSITION).astype(np.int64)
    return document[first], first, stop - first, place, g[place].view(np.int64)


RUNS = "h long, c long, n int, d int, id long, key long, p long"


def _scan(window: int, gram: int):
    """Documents to runs: anchor's hash, context's hash, number of windows, anchor's place in the
    context, document, first window's place in it."""

    def emit(parts: list[tuple]) -> pd.DataFrame:
        h = np.concatenate([p[3] for p in parts])
        ends = np.cumsum([len(p[3]) for p in parts])
        starts = ends - [len(p[3]) for p in parts]
        document, first, n, place, anchor = anchors(h, starts, ends, window, gram)
        data, whole = h.tobytes(), xxhash.xxh3_64_intdigest
        c = np.fromiter((whole(data[8 * a : 8 * b]) for a, b in zip(first.tolist(), (first + n + window - 1).tolist())), np.uint64, len(first))
        shift = np.array([p[2] for p in parts], np.int64) - starts
        return pd.DataFrame({
            "h": anchor, "c": c.view(np.int64), "n": n.astype(np.int32), "d": (place - first).astype(np.int32),
            "id": np.array([p[0] for p in parts], np.int64)[document], "key": np.array([p[1] for p in parts], np.int64)[document], "p": first + shift[document],
        })

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, seen = _Hashes(), Seen()
        parts: list[tuple] = []
        size = 0
        for pdf in batches:
            for i, k, t in zip(pdf["id"], pdf["key"], pdf["text"]):
                if seen.again((i, k)):
                    continue
                h = word_hashes(t.encode("utf-8", "surrogatepass"), known)
                for at in range(0, len(h) - window + 1, SEGMENT // 2):
                    part = h[at : at + SEGMENT // 2 + window - 1]
                    if parts and size + len(part) > SEGMENT:
                        yield emit(parts)
                        parts, size = [], 0
                    parts.append((i, k, at, part))
                    size += len(part)
        if parts:
            yield emit(parts)

    return run


CONTEXTS = "h long, id long, key long, p long, n int, d int, words binary, k0 long, k1 long"


def _cut(window: int):
    """Rows (a document's text, its contexts) to contexts with their words; of hot anchors each window
    is a row without words, but with their 128-bit hash."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = Seen()
        for pdf in batches:
            for i, k, t, contexts in zip(pdf["id"], pdf["key"], pdf["text"], pdf["contexts"]):
                if seen.again((i, k)):
                    continue
                words = t.encode("utf-8", "surrogatepass").split()
                rows: list[tuple] = []
                for r in contexts:
                    h, p, n, d = (int(r[x]) for x in ("h", "p", "n", "d"))
                    if not r["hot"]:
                        rows.append((h, i, k, p, n, d, b" ".join(words[p : p + n + window - 1]), 0, 0))
                        continue
                    for at in range(p, p + n):
                        k0, k1 = np.frombuffer(xxhash.xxh3_128_digest(b" ".join(words[at : at + window])), "<i8").tolist()
                        rows.append((h, i, k, at, 1, 0, None, k0, k1))
                for at in range(0, len(rows), TOGETHER):
                    yield pd.DataFrame(rows[at : at + TOGETHER], columns=["h", "id", "key", "p", "n", "d", "words", "k0", "k1"])

    return run


def extended(h: np.ndarray, words: list[list[int]], n: np.ndarray, d: np.ndarray, window: int, gram: int) -> list[tuple[int, int]]:
    """(context, window) of all windows that an earlier context has too. Contexts are in order, each
    with its anchor's hash h, its words as numbers, its number of windows and its anchor's place."""
    size = np.array([len(w) for w in words])
    flat, at = np.fromiter((x for w in words for x in w), np.int64, int(size.sum())), np.cumsum(size) - size
    most = int(flat.max(initial=0)) + 2

    def step(classes: np.ndarray, place: np.ndarray, within: np.ndarray) -> np.ndarray:
        """Classes divided by the word at a place of each context; -1 where there is none."""
        out = np.full(len(classes), -1)
        if within.any():
            out[within] = np.unique(classes[within] * most + flat[(at + place)[within]], return_inverse=True)[1]
        return out

    classes = np.unique(h, return_inverse=True)[1]
    for j in range(gram):
        classes = step(classes, d + j, np.ones(len(h), bool))
    left, right = [classes], [classes]
    for j in range(1, window - gram + 1):
        left.append(step(left[-1], d - j, (d >= j) & (left[-1] >= 0)))
        right.append(step(right[-1], d + gram + j - 1, (d + gram + j - 1 < size) & (right[-1] >= 0)))
    found = []
    for o in range(window - gram + 1):
        own = np.flatnonzero((d - o >= 0) & (d - o < n))
        if len(own):
            key = left[o][own] * (len(h) + 1) + right[window - gram - o][own]
            first, inverse = np.unique(key, return_index=True, return_inverse=True)[1:]
            again = own[first[inverse] != np.arange(len(own))]
            found += zip(again.tolist(), (d[again] - o).tolist())
    return found


def _spans(starts: list[int]) -> list[tuple[int, int]]:
    """Ascending numbers as runs of consecutive ones, ends exclusive."""
    out: list[list[int]] = []
    for s in starts:
        if out and out[-1][1] == s:
            out[-1][1] = s + 1
        else:
            out.append([s, s + 1])
    return [(a, b) for a, b in out]


def _extend(window: int, gram: int):
    """Contexts, sorted by anchor and order, to spans of windows with earlier matches."""

    def matched(pdf: pd.DataFrame) -> pd.DataFrame:
        numbers: dict[bytes, int] = {}
        words = [[numbers.setdefault(w, len(numbers)) for w in text.split(b" ")] for text in pdf["words"]]
        found = extended(pdf["h"].to_numpy(), words, pdf["n"].to_numpy(np.int64), pdf["d"].to_numpy(np.int64), window, gram)
        by: dict[int, list[int]] = {}
        for context, at in sorted(found):
            by.setdefault(context, []).append(at)
        ids, keys, places = (pdf[c].tolist() for c in ("id", "key", "p"))
        rows = [(ids[i], keys[i], places[i] + a, places[i] + b) for i, starts in by.items() for a, b in _spans(starts)]
        return pd.DataFrame(rows, columns=["id", "key", "a", "b"], dtype="int64")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        size = 0
        for pdf in batches:
            held.append(pdf)
            size += len(pdf)
            if size >= TOGETHER:  # all but the last anchor's contexts, which may go on
                rows = pd.concat(held, ignore_index=True).drop_duplicates(["h", "id", "key", "p"], ignore_index=True)
                own = rows["h"] == rows["h"].iloc[-1]
                if not own.all():
                    yield matched(rows[~own].reset_index(drop=True))
                held = [rows[own]]
                size = int(own.sum())
        if size:
            yield matched(pd.concat(held, ignore_index=True).drop_duplicates(["h", "id", "key", "p"], ignore_index=True))

    return run


def _identity(docs: DataFrame) -> list[Column]:
    """A row's id and a hash of id and text: both never null."""
    return [F.coalesce(docs["doc_id"], F.lit(NULL_ID)).cast("long").alias("id"), F.xxhash64(docs["doc_id"], docs["text"]).alias("key")]


def repeated_windows(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(id, key, spans): the starts of windows that have an earlier match, of each document that has any,
    as array<struct<a, b>> in any order, b exclusive, in words. id and key are those of _identity()."""
    texts = docs.select(*_identity(docs), F.coalesce(docs["text"], F.lit("")).alias("text"))
    long_enough = texts.where(F.octet_length("text") >= 2 * window - 1)
    runs = stored(long_enough.mapInPandas(_scan(window, gram), RUNS))
    shared = checkpointed(runs.groupBy("h").agg(F.count(F.lit(1)).alias("t")).where("t > 1").select("h"))
    likely = stored(runs.join(shared, "h"))
    drop_stored(runs)
    contexts = likely.groupBy("h", "c").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("id", "key", "p", "n", "d")).alias("r"))
    contexts = checkpointed(contexts.select("h", "c", "copies", "r.*"))
    several = checkpointed(contexts.groupBy("h").agg(F.count(F.lit(1)).alias("k")).where("k > 1"))
    own = contexts.join(several, "h").select("id", "key", F.struct("h", "p", "n", "d", (F.col("k") > HOT_CONTEXTS).alias("hot")).alias("r"))
    own = own.groupBy("id", "key").agg(F.collect_list("r").alias("contexts"))
    cut = stored(long_enough.join(own, ["id", "key"]).select("id", "key", "text", "contexts").mapInPandas(_cut(window), CONTEXTS))
    told = cut.where("words is not null").repartition("h").sortWithinPartitions("h", "id", "key", "p").mapInPandas(_extend(window, gram), "id long, key long, a long, b long")
    singles = cut.where("words is null").select("k0", "k1", "id", "key", F.col("p").alias("a")).distinct()
    first = singles.groupBy("k0", "k1").agg(F.count(F.lit(1)).alias("t"), F.min(F.struct("id", "key", "a")).alias("m")).where("t > 1").drop("t")
    later = singles.join(first, ["k0", "k1"]).where(F.struct("id", "key", "a") != F.col("m")).select("id", "key", "a", (F.col("a") + 1).alias("b"))
    copies = contexts.where("copies > 1").select("h", "c", F.struct("id", "key", "p").alias("m"))
    copies = likely.join(copies, ["h", "c"]).where(F.struct("id", "key", "p") != F.col("m")).select("id", "key", F.col("p").alias("a"), (F.col("p") + F.col("n")).alias("b"))
    spans = told.unionByName(later).unionByName(copies).groupBy("id", "key").agg(F.collect_set(F.struct("a", "b")).alias("spans"))
    found = checkpointed(spans)
    for t in (likely, cut):
        drop_stored(t)
    return found


def maximal(spans: list, window: int) -> list[tuple[int, int]]:
    """Maximal runs of words that the windows of the given starts cover."""
    out: list[list[int]] = []
    for a, b in sorted((int(s["a"]), int(s["b"]) + window - 1) for s in spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _kept(text: str, spans, window: int) -> tuple[int, int, list[bytes]]:
    """Words, removed words, and the kept words of each piece of a text."""
    gone = maximal(spans, window) if spans is not None else []
    n = removed = 0
    kept = []
    for piece in pieces(text.encode("utf-8", "surrogatepass")):
        words = piece.split()
        m = n + len(words)
        for a, b in reversed([(max(a, n), min(b, m)) for a, b in gone if a < m and b > n]):
            removed += b - a
            del words[a - n : b - n]
        n = m
        kept += [b" ".join(words)] if words else []
    return n, removed, kept


def _with_spans(docs: DataFrame, window: int, gram: int) -> tuple[DataFrame, Column]:
    found = repeated_windows(docs, window, gram)
    own_id, own_key = _identity(docs)
    return docs.join(found, (own_id == found["id"]) & (own_key == found["key"]), "left"), found["spans"]


def dedup_report(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, kept_sha256 of the kept words joined by spaces."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for t, spans in zip(pdf["text"], pdf["spans"]):
                n, removed, kept = _kept(t, spans, window)
                rows.append((n, removed, hashlib.sha256(b" ".join(kept)).hexdigest()))
            yield pd.concat([pdf[["known", "doc"]].reset_index(drop=True), pd.DataFrame(rows, columns=["n_words", "n_removed", "kept_sha256"])], axis=1)

    rows, spans = _with_spans(docs.select("doc_id", "text"), window, gram)
    rows = rows.select(F.col("doc_id").isNotNull().alias("known"), F.coalesce("doc_id", F.lit(0)).cast("long").alias("doc"), F.coalesce("text", F.lit("")).alias("text"), spans.alias("spans"))
    rows = rows.mapInPandas(run, "known boolean, doc long, n_words long, n_removed long, kept_sha256 string")
    return rows.select(F.when(F.col("known"), F.col("doc")).alias("doc_id"), "n_words", "n_removed", "kept_sha256")


def repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, start, end): the maximal repeats of each document in words, end exclusive."""
    rows, spans = _with_spans(docs.select("doc_id", "text"), window, gram)
    order = Window.partitionBy("doc_id", "row").orderBy("a", "b")
    starts = rows.select("doc_id", F.monotonically_increasing_id().alias("row"), spans.alias("s")).select("doc_id", "row", F.inline("s")).withColumn("b", F.col("b") + window - 1)
    reach = F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = starts.withColumn("apart", F.coalesce(F.col("a") > reach, F.lit(True)).cast("long"))
    numbered = marked.withColumn("run", F.sum("apart").over(order))
    return numbered.groupBy("doc_id", "row", "run").agg(F.min("a").alias("start"), F.max("b").alias("end")).select("doc_id", "start", "end")


def without_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """docs with repeated words cut from text; what is kept of a text that loses any is joined by spaces."""

    @F.pandas_udf("string")
    def kept(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([t if s is None or t is None else b" ".join(_kept(t, s, window)[2]).decode("utf-8", "surrogatepass") for t, s in zip(texts, spans)], dtype="object")

    rows, spans = _with_spans(docs, window, gram)
    return rows.select(*(kept(docs["text"], spans).alias(c) if c == "text" else docs[c] for c in docs.columns))


def op12_seed_extend_dedup(spark, sf_dir: str) -> DataFrame:
    """dedup_report() of all documents."""
    return dedup_report(table(spark, sf_dir, "documents"))


#: The rows of op12 by numbering every window of 20 words, cut from blocks of 256 starts.
OP12_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w FROM documents),
blocks AS (SELECT doc_id, b, w[b + 1:b + 275] t FROM (SELECT doc_id, w, unnest(range(0, len(w) - 19, 256)) b FROM d)),
starts AS (SELECT doc_id, b, t, unnest(range(0, least(256, len(t) - 19))) i FROM blocks),
windows AS (SELECT doc_id, b + i i, md5(array_to_string(t[i + 1:i + 20], ' ')) k FROM starts),
firsts AS (SELECT k, min((doc_id, i)) m FROM windows GROUP BY k HAVING count(*) > 1),
hits AS (SELECT doc_id, i FROM windows JOIN firsts USING (k) WHERE (doc_id, i) > m),
words AS (SELECT doc_id, unnest(range(len(w))) i, unnest(w) word FROM d),
told AS (SELECT doc_id, i, word, i - max(CASE WHEN h.i IS NOT NULL THEN w.i END) OVER (PARTITION BY w.doc_id ORDER BY w.i) AS back
  FROM words w LEFT JOIN hits h USING (doc_id, i)),
kept AS (SELECT doc_id, count(*) n_words, count(*) FILTER (back < 20) n_removed, string_agg(word, ' ' ORDER BY i) FILTER (back IS NULL OR back >= 20) t FROM told GROUP BY doc_id)
SELECT doc_id, coalesce(n_words, 0) n_words, coalesce(n_removed, 0) n_removed, sha256(coalesce(t, '')) kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""
