"""Documents to pages, pages to chunks, pages to sub-documents."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillrun.functions.scalars import est_tokens

LINES_PER_PAGE = 5
MAX_TOKENS = 500


def paginate(docs: DataFrame, lines: int = LINES_PER_PAGE, overlap: int = 0) -> DataFrame:
    """(doc_id, page, text): pages of so many lines, numbered from 0; ``overlap`` lines of the page
    before go ahead of each. A null text is one empty page."""
    split = docs.select("doc_id", F.split(F.coalesce("text", F.lit("")), "\n", -1).alias("l"))
    pages = split.select("doc_id", "l", F.explode(F.sequence(F.lit(0), F.floor((F.size("l") - 1) / lines).cast("int"))).alias("page"))
    first = F.greatest(F.lit(0), F.col("page") * lines - overlap)
    return pages.select("doc_id", "page", F.array_join(F.slice("l", first + 1, (F.col("page") + 1) * lines - first), "\n").alias("text"))


def rejoin(pages: DataFrame) -> DataFrame:
    """(doc_id, text) from pages without overlap."""
    parts = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", "text"))).alias("p"))
    return parts.select("doc_id", F.array_join(F.col("p.text"), "\n").alias("text"))


def plan(docs: DataFrame, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """(doc_id, est_tokens, mode): whole documents that exceed the limit go in chunks."""
    rows = docs.select("doc_id", est_tokens(F.col("text")).alias("est_tokens"))
    return rows.withColumn("mode", F.when(F.col("est_tokens") > max_tokens, "chunked").otherwise("single"))


def pack(pages: DataFrame, max_tokens: int = MAX_TOKENS, tokens: Column | None = None) -> DataFrame:
    """(doc_id, page, est_tokens, chunk_id, oversized): pages in order fill a chunk until the next one
    would exceed the limit. A page over the limit stays alone and is flagged. ``tokens`` has the pages' sizes,
    where they are at hand.

    A document's page sizes become one array, folded in one pass, so the time grows with the pages. Texts don't move.
    """
    rows = pages.select("doc_id", "page", (est_tokens(F.col("text")) if tokens is None else tokens).alias("t"))
    docs = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", "t"))).alias("p"))

    @F.arrow_udf("array<int>")
    def chunk_ids(sizes: pa.Array) -> pa.Array:
        flat, ends = sizes.flatten().to_numpy(zero_copy_only=False), np.cumsum([0, *sizes.value_lengths().to_pylist()], dtype=np.int32)
        ids = [packed_greedily(flat[a:b], max_tokens) for a, b in zip(ends[:-1], ends[1:])]
        return pa.ListArray.from_arrays(ends, np.concatenate([np.zeros(0, np.int32), *ids]))

    packed = docs.select("doc_id", F.arrays_zip("p", chunk_ids("p.t").alias("ids")).alias("z")).select("doc_id", F.explode("z").alias("z"))
    return packed.select("doc_id", F.col("z.p.page").alias("page"), F.col("z.p.t").alias("est_tokens"), F.col("z.ids").alias("chunk_id"), (F.col("z.p.t") > max_tokens).alias("oversized"))


def packed_greedily(sizes: np.ndarray, most: int) -> np.ndarray:
    """The chunk of each page: as many pages as ``most`` holds, one at least."""
    ids, chunk, total = [], 0, 0
    for size in sizes.tolist():
        if ids and total + size > most:
            chunk, total = chunk + 1, 0
        total += size
        ids.append(chunk)
    return np.array(ids, np.int32)


def pack_by_running_sum(pages: DataFrame, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """(doc_id, page, chunk_id) by the running sum alone: a chunk may exceed the limit by a page."""
    order = Window.partitionBy("doc_id").orderBy("page").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = est_tokens(F.col("text"))
    return pages.select("doc_id", "page", t.alias("t")).withColumn("before", F.sum("t").over(order) - F.col("t")).select("doc_id", "page", F.floor(F.col("before") / max_tokens).cast("int").alias("chunk_id"))


def chunks(pages: DataFrame, packed: DataFrame) -> DataFrame:
    """(doc_id, chunk_id, page_from, page_to, text, est_tokens) from pages and their packing."""
    rows = pages.join(packed, ["doc_id", "page"]).groupBy("doc_id", "chunk_id")
    got = rows.agg(F.array_sort(F.collect_list(F.struct("page", "text"))).alias("p"), F.sum("est_tokens").alias("est_tokens"))
    return got.select("doc_id", "chunk_id", F.col("p")[0]["page"].alias("page_from"), F.element_at("p", -1)["page"].alias("page_to"), F.array_join(F.col("p.text"), "\n").alias("text"), "est_tokens")


def chunked(pages: DataFrame, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """(doc_id, chunk_id, page_from, text, pages, lengths, classes) from pages (doc_id, page, text, class): the chunks of pack()
    and chunks(), with the number, the characters (null of a null text) and the class of each page.

    Texts move once, to the other pages of their document, and pass in order: a task holds a batch and the chunk that it ends in.
    Pages without a doc_id or a number are left out.
    """
    kind = pages.schema["class"].dataType
    rows = pages.where("doc_id IS NOT NULL AND page IS NOT NULL").select(F.col("doc_id").cast("long"), F.col("page").cast("int"), "text", "class", est_tokens(F.col("text")).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the rows of the chunk that isn't closed yet
        doc, chunk, total = None, 0, 0
        ids: list[int] = []  # of the chunks that held and the batch begin
        for rows in batches:
            starts = []
            for i, (d, t) in enumerate(zip(rows["doc_id"].to_numpy().tolist(), rows["t"].to_numpy().tolist())):
                if d != doc or total + t > max_tokens:
                    chunk = chunk + 1 if d == doc else 0
                    doc, total = d, 0
                    starts.append(i)
                    ids.append(chunk)
                total += t
            if not starts:
                held.append(rows)
                continue
            before = sum(map(len, held))
            closed, ends = [*held, rows.slice(0, starts[-1])], [*([0] if held else []), *(before + s for s in starts)]
            if len(ends) > 1:
                yield _joined(closed, ends, ids[:-1])
            held, ids = [rows.slice(starts[-1])], ids[-1:]
        if held:
            yield _joined(held, [0, sum(map(len, held))], ids)

    columns = f"doc_id long, chunk_id int, page_from int, text string, pages array<int>, lengths array<int>, classes array<{kind.simpleString()}>"
    return rows.repartition("doc_id").sortWithinPartitions("doc_id", "page").mapInArrow(run, columns)


def _joined(rows: list[pa.RecordBatch], ends: list[int], ids: list[int]) -> pa.RecordBatch:
    """One row for each chunk, of the rows from one of ``ends`` to the next."""
    doc, page, text, kind = (pa.chunked_array([b[c] for b in rows]).combine_chunks() for c in ("doc_id", "page", "text", "class"))
    first, ends = np.array(ends[:-1]), pa.array(ends, pa.int32())
    some = np.concatenate([[0], np.cumsum(text.is_valid().to_numpy(zero_copy_only=False))])[ends]  # null texts are no part of a chunk's
    texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(some, pa.int32()), text.drop_null()), "\n")
    lists = [pa.ListArray.from_arrays(ends, c) for c in (page, pc.utf8_length(text), kind)]
    columns = [doc.take(first), pa.array(ids, pa.int32()), page.take(first), texts, *lists]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "chunk_id", "page_from", "text", "pages", "lengths", "classes"])


def classed(chunks: DataFrame) -> DataFrame:
    """(doc_id, page, class) of the pages in chunks of chunked()."""
    return chunks.select("doc_id", F.inline(F.arrays_zip(F.col("pages").alias("page"), F.col("classes").alias("class"))))


def paged(pages: pa.ListArray, lengths: pa.ListArray) -> Callable[[int], tuple[list[int], list[int]]]:
    """The pages of a row and their lengths, -1 for null; made once for a batch, as lists of Arrow are slow to take apart."""
    ends = [0, *np.cumsum(pages.value_lengths().to_numpy()).tolist()]
    numbers, sizes = pages.flatten().to_numpy().tolist(), pc.fill_null(lengths.flatten(), -1).to_numpy().tolist()
    return lambda i: (numbers[ends[i] : ends[i + 1]], sizes[ends[i] : ends[i + 1]])


def place(text: str, pages: list[int], lengths: list[int], value: str) -> tuple[int, int]:
    """The first of a chunk's pages that has value, and its offset there, from 1; the first page and 0 where none has.
    A null page has length -1."""
    at = 0
    for page, n in zip(pages, lengths):
        if n >= 0:
            found = text.find(value, at, at + n)
            if found >= 0:
                return page, found - at + 1
            at += n + 1
    return pages[0], 0


def segment(pages: DataFrame, kind: Column) -> DataFrame:
    """(doc_id, index, class, page_ranges): neighbouring pages of one class make a sub-document, with
    its 1-based page numbers."""
    rows = pages.select("doc_id", "page", kind.alias("class"))
    island = F.col("page") - F.row_number().over(Window.partitionBy("doc_id", "class").orderBy("page"))
    found = rows.withColumn("island", island).groupBy("doc_id", "class", "island").agg(F.array_sort(F.collect_list(F.col("page") + 1)).alias("page_ranges"))
    return found.select("doc_id", (F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("page_ranges")[0])) - 1).alias("index"), "class", "page_ranges")


def unlikeness(pages: DataFrame) -> DataFrame:
    """(doc_id, page, unlike): how much a page differs from the one before, in thousandths: 1000 less the share
    of their different words that both have. First pages have none; two pages without words are alike."""
    words = pages.select("doc_id", "page", F.array_distinct(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).alias("w"))
    before = words.select("doc_id", (F.col("page") + 1).alias("page"), F.col("w").alias("v"))
    sizes = words.join(before, ["doc_id", "page"]).select("doc_id", "page", F.size(F.array_intersect("w", "v")).alias("both"), F.size(F.array_union("w", "v")).alias("every"))
    return sizes.select("doc_id", "page", F.expr("1000 - case when every = 0 then 1000 else 1000 * both div every end").cast("int").alias("unlike"))


def best_cuts(unlike: np.ndarray, threshold: int, least: int) -> np.ndarray:
    """Where to cut n + 1 pages, given how much each but the first differs from the one before: the
    cuts of the largest sum of (unlike - threshold) of which no part has under ``least`` pages."""
    n = len(unlike)
    gain = [int(x) - threshold for x in unlike]
    best = [0] * (n + 1)  # best[i]: of cuts before pages 1 to i
    for i in range(1, n + 1):
        fits = least <= i <= n + 1 - least
        best[i] = max(best[i - 1], best[max(i - least, 0)] + gain[i - 1]) if fits else best[i - 1]
    cuts, i = np.zeros(n, bool), n
    while i > 0:
        if best[i] > best[i - 1]:
            cuts[i - 1] = True
            i -= least
        else:
            i -= 1
    return cuts


def detect(pages: DataFrame, threshold: int = 950, least: int = 2) -> DataFrame:
    """(doc_id, index, page_ranges): sub-documents told by where neighbouring pages differ. Of all ways to
    cut a document into parts of ``least`` pages or more, the one whose cuts differ most beyond
    ``threshold``, by dynamic programming; page numbers count from 1. Only numbers of a document meet."""

    @F.pandas_udf("array<boolean>")
    def cut(unlike: pd.Series) -> pd.Series:
        return pd.Series([best_cuts(np.asarray(u, np.int64), threshold, least) for u in unlike])

    gathered = unlikeness(pages).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", "unlike"))).alias("u"))
    cuts = gathered.select("doc_id", F.explode(F.arrays_zip(F.col("u.page").alias("page"), cut("u.unlike").alias("cut"))).alias("z")).select("doc_id", "z.page", "z.cut")
    rows = pages.select("doc_id", "page").join(cuts, ["doc_id", "page"], "left")
    order = Window.partitionBy("doc_id").orderBy("page")
    numbered = rows.select("doc_id", "page", F.sum(F.coalesce(F.col("cut"), F.lit(False)).cast("int")).over(order).cast("int").alias("index"))
    return numbered.groupBy("doc_id", "index").agg(F.array_sort(F.collect_list(F.col("page") + 1)).alias("page_ranges"))
