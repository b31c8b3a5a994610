"""Benchmark decontamination: test n-grams as a broadcast hash set, training windows scanned against it.

Words are runs of digits, ASCII letters and non-ASCII characters of the text with A-Z lower-cased.
A window is 13 consecutive words of a benchmark item, or the whole of a shorter item that has words.
Every place of a document is looked up by its two next words; where a window of the set begins so, the
document's window is hashed, looked up in the set, and a hit is verified word for word. Only built-in functions run.

A set that is too large to broadcast is sent as bits instead: one bit for each hash, in a field of fixed
size. Windows whose bit isn't set are dropped where they stand; the others, with the words of each, meet
the set by a shuffle that verifies them, so bits that hashes share cost work but change no result.

Defined results: null and empty texts have no words and no hits; repeated rows are judged one by one
and ties don't arise; an empty benchmark hits nothing; an empty table gives an empty result; other
columns of either table are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillrun.llm.common import ascii_lower, checkpointed, sha256_hex, table

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same for text that is not lower-cased.
ANY_SEPARATORS, ANY_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW = 13
#: Sets of up to this many windows, words and item ids of so many bytes, are broadcast; larger ones are joined by shuffle.
BROADCAST_WINDOWS, BROADCAST_BYTES = 500_000, 100_000_000
#: Bits of the field that stands for a larger set: a row for each 64 of them at most is broadcast.
FIELD_BITS = 1 << 27


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS, -1), "")


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(h, size, win, items): each distinct window with the sorted ids of its items."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words_of(F.col("text")).alias("w")).where(F.size("w") > 0)
    items = items.withColumn("size", F.least(F.size("w"), F.lit(window)))
    at = items.withColumn("i", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("size") + 1))).withColumn("win", F.slice("w", F.col("i"), F.col("size")))
    return at.groupBy("size", "win").agg(F.array_sort(F.collect_set("item")).alias("items")).select(F.xxhash64("win").alias("h"), "size", "win", "items")


def _hashes(words: Column, size: int) -> Column:
    starts = F.when(F.size(words) >= size, F.sequence(F.lit(1), F.size(words) - size + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.struct(i.alias("i"), F.lit(size).alias("size"), F.xxhash64(F.slice(words, i, size)).alias("h")))


def _fits(windows: DataFrame) -> bool:
    """Whether the set may be broadcast whole. A window may belong to very many items, so bytes count too."""
    length = lambda texts: F.aggregate(texts, F.lit(0).cast("long"), lambda n, t: n + F.octet_length(t))
    n, size = windows.agg(F.count(F.lit(1)), F.sum(length(F.col("win")) + length(F.col("items")))).first()
    return n <= BROADCAST_WINDOWS and (size or 0) <= BROADCAST_BYTES


def _may_be_in(rows: DataFrame, windows: DataFrame, bits: int) -> DataFrame:
    """rows whose h is one of windows' or shares a bit with one, and those without h."""
    at, of = F.pmod("h", F.lit(bits)), F.pmod("h", F.lit(64)).cast("int")
    field = windows.select(F.shiftright(at, 6).alias("part"), of.alias("bit")).groupBy("part").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("field"))
    known = rows.withColumn("part", F.shiftright(at, 6)).join(F.broadcast(field), "part", "left")
    return known.where(F.col("h").isNull() | (F.getbit("field", of) == 1)).drop("part", "field")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per row of docs: doc_id, text_key (hash of the text), n_words, runs (hit words as
    array<struct<start, end>>, merged, from 0, end exclusive), n_hit, items (ids as sorted strings)."""
    windows = checkpointed(benchmark_windows(benchmark, window))
    sizes = sorted(r["size"] for r in windows.select("size").distinct().collect())  # at most `window` values
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.xxhash64("text").alias("text_key"), words_of(F.col("text")).alias("words")).withColumn("n_words", F.size("words").cast("long"))
    own = F.slice("words", F.greatest("i", F.lit(1)), F.greatest("size", F.lit(1)))
    if _fits(windows):
        # hashed whole are only windows that begin with the two words of one in the set, or its single one
        at = rows.select("*", F.posexplode_outer("words").alias("at", "w")).withColumn("i", F.coalesce(F.col("at") + 1, F.lit(0)))
        head = windows.groupBy(F.xxhash64(F.col("win")[0], F.get("win", F.lit(1))).alias("head"), (F.col("size") == 1).alias("single")).agg(F.collect_set("size").alias("sizes"))
        pairs = head.where("not single").select("head", "sizes")
        at = at.withColumn("head", F.xxhash64("w", F.get("words", F.col("i")))).join(F.broadcast(pairs), "head", "left").drop("head")
        if 1 in sizes:
            singles = head.where("single").select("head", F.col("sizes").alias("one"))
            at = at.withColumn("head", F.xxhash64("w", F.lit(None).cast("string"))).join(F.broadcast(singles), "head", "left").drop("head")
        none = F.array().cast("array<int>")
        mark = F.when(F.col("i") <= 1, F.array(F.lit(0))).otherwise(none)  # a row for every document
        found = F.concat(mark, F.coalesce("sizes", none), *([F.coalesce("one", none)] if 1 in sizes else []))
        at = at.where((F.col("i") <= 1) | F.col("sizes").isNotNull() | (F.col("one").isNotNull() if 1 in sizes else F.lit(False)))
        at = at.select("rid", "doc_id", "text_key", "n_words", "words", "i", F.explode(found).alias("size")).where(F.col("i") + F.col("size") - 1 <= F.col("n_words"))
        joined, hit = at.withColumn("h", F.when(F.col("size") > 0, F.xxhash64(own))).join(F.broadcast(windows), ["h", "size"], "left"), own == F.col("win")
    else:  # a window is sent with its own words alone, and the marks are spread by their rows
        mark = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("size"), F.lit(None).cast("long").alias("h")))
        rows = rows.withColumn("at", F.concat(mark, *(_hashes(F.col("words"), s) for s in sizes)))
        rows = _may_be_in(rows.select("rid", "doc_id", "text_key", "words", "n_words", F.inline_outer("at")), windows, FIELD_BITS)
        sent = rows.select("rid", "doc_id", "text_key", "n_words", "i", "size", F.coalesce("h", F.xxhash64("rid")).alias("h"), F.when(F.col("size") > 0, own).alias("own"))
        joined, hit = sent.join(windows, ["h", "size"], "left"), F.col("own") == F.col("win")
    found = joined.where((F.col("size") == 0) | hit).select(
        "rid", "doc_id", "text_key", "n_words", "items", F.when(F.col("size") > 0, F.struct((F.col("i") - 1).alias("start"), (F.col("i") + F.col("size") - 1).alias("end"))).alias("run")
    )
    by_row = found.groupBy("rid").agg(
        F.first("doc_id").alias("doc_id"), F.first("text_key").alias("text_key"), F.first("n_words").alias("n_words"),
        F.array_sort(F.collect_set("run")).alias("runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    hit = by_row.select("doc_id", "text_key", "n_words", _places(F.col("runs")).alias("places"), "items")
    return hit.select("doc_id", "text_key", "n_words", _merged(F.col("places")).alias("runs"), F.size("places").cast("long").alias("n_hit"), "items")


def _places(runs: Column) -> Column:
    """The words of sorted runs, each once. They ascend: of a run's words those are new that lie beyond all before."""
    return F.array_distinct(F.flatten(F.transform(runs, lambda r: F.sequence(r["start"], r["end"] - 1))))


def _merged(places: Column) -> Column:
    """Ascending places as runs of neighbours; places must be a column of its own, as each is looked up by number."""
    first = F.filter(places, lambda p, i: (i == 0) | (F.get(places, i - 1) < p - 1))
    last = F.filter(places, lambda p, i: (i == F.size(places) - 1) | (F.get(places, i + 1) > p + 1))
    return F.zip_with(first, last, lambda s, e: F.struct(s.alias("start"), (e + 1).alias("end")))


def is_contaminated() -> Column:
    """The contract's rule: some word hit, and at least one in twenty."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def _touched(docs: DataFrame, found: DataFrame) -> tuple[DataFrame, list]:
    """docs with their text key, and the join condition with the rows of ``found``, which are
    broadcast while they are few."""
    found = checkpointed(found.dropDuplicates(["doc_id", "text_key"]).select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "runs"))
    found = F.broadcast(found) if found.count() <= BROADCAST_WINDOWS else found
    return found, [docs["doc_id"].eqNullSafe(found["_id"]), F.xxhash64(docs["text"]).eqNullSafe(found["_key"])]


def remove_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs without the contaminated ones, all columns kept."""
    found, on = _touched(docs, contamination(docs, benchmark, window).where(is_contaminated()))
    return docs.join(found, on, "left_anti")


def remove_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with every hit word cut out of text; what stands between words stays."""
    found, on = _touched(docs, contamination(docs, benchmark, window).where("n_hit > 0"))
    own = "_" * (1 + max(map(len, docs.columns)))  # a name that docs doesn't have
    text, runs = docs["text"], found["runs"]
    gaps, words = F.split(text, ANY_WORD, -1), F.array_remove(F.split(text, ANY_SEPARATORS, -1), "")
    rows = docs.join(found, on, "left").select(*(docs[c] for c in docs.columns), runs.alias(f"{own}runs"), *(F.when(runs.isNotNull(), x).alias(f"{own}{n}") for n, x in (("gaps", gaps), ("words", words))))
    text, runs, gaps, words = rows["text"], rows[f"{own}runs"], rows[f"{own}gaps"], rows[f"{own}words"]
    before = lambda i: F.when(i > 0, F.get(runs, i - 1)["end"]).otherwise(0)
    kept = F.transform(runs, lambda r, i: F.concat(F.slice(words, before(i) + 1, r["start"] - before(i)), F.array_repeat(F.lit(""), r["end"] - r["start"])))
    tail = F.slice(words, F.element_at(runs, -1)["end"] + 1, F.size(words))
    left = F.zip_with(gaps, F.concat(F.flatten(kept), tail), lambda g, w: F.concat(g, F.coalesce(w, F.lit(""))))
    return rows.select(*(F.when(runs.isNull(), text).otherwise(F.array_join(left, "")).alias(c) if c == "text" else rows[c] for c in docs.columns))


def op7_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), sha256_hex(F.array_join("items", ",")).alias("items_sha256"), is_contaminated().alias("contaminated")
    )


_WORDS = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

OP7_SQL = f"""
WITH items AS (SELECT coalesce(item_id::VARCHAR, '') item, {_WORDS} w FROM benchmark),
sized AS (SELECT item, w, least(len(w), 13) size FROM items WHERE len(w) > 0),
starts AS (SELECT item, w, size, unnest(range(1, len(w) - size + 2)) i FROM sized),
wins AS (SELECT DISTINCT item, size, list_slice(w, i, i + size - 1) win FROM starts),
docs AS (SELECT row_number() OVER () rid, doc_id, {_WORDS} w FROM documents),
sizes AS (SELECT DISTINCT size FROM wins),
places AS (SELECT rid, w, size, unnest(range(1, len(w) - size + 2)) i FROM docs, sizes WHERE len(w) >= size),
spots AS (SELECT rid, size, i, list_slice(w, i, i + size - 1) win FROM places),
hits AS (SELECT rid, i, spots.size size, item FROM spots JOIN wins ON spots.size = wins.size AND spots.win = wins.win),
hit_words AS (SELECT rid, count(DISTINCT p) n_hit FROM (SELECT rid, unnest(range(i, i + size)) p FROM hits) GROUP BY rid),
hit_items AS (SELECT rid, count(*) n_items, string_agg(item, ',' ORDER BY item) ids FROM (SELECT DISTINCT rid, item FROM hits) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT n_words, coalesce(n_hit, 0)::BIGINT n_hit, coalesce(n_items, 0)::BIGINT n_items, sha256(coalesce(ids, '')) items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) contaminated
FROM docs LEFT JOIN hit_words USING (rid) LEFT JOIN hit_items USING (rid)
"""
