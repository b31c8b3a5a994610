"""Providers, extraction, merging, routing, casting, highlighting."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from typing import Protocol

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillrun.functions.scalars import typed
from quillrun.operators.pages import paged, place
from quillrun.schemas import ExtractionModel
from quillrun.sources.shared import tabled, written

MAX_IN_FLIGHT = 4
#: Characters of text that a task of a provider reads, about.
PER_TASK = 1 << 26
#: Texts in one of the files that waves are made of.
PER_FILE = 4096
#: Patterns of the rule provider: a field's first match on a page is its value.
RULES = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "ipv4": r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}", "digits": r"\d{2,}", "long_word": r"[a-z]{14,}"}
#: What any match of a rule holds and is quicker to look for: a text without it isn't searched for the rule.
HINTS = {"email": "@", "ipv4": r"\.\d{1,3}\.", "digits": r"\d"}


class Provider(Protocol):
    """An outside service: texts in, for each a list of (key, value) and an error or None."""

    def __call__(self, texts: list[str]) -> list[tuple[list[tuple[str, str]], str | None]]: ...


def extract_by_rules(pages: DataFrame, rules: dict[str, str] = RULES) -> DataFrame:
    """(doc_id, page, key, value): the first match of each field on each page, by built-in functions."""
    found = F.array(*(F.struct(F.lit(k).alias("key"), F.nullif(F.regexp_extract("text", p, 0), F.lit("")).alias("value")) for k, p in rules.items()))
    return pages.select("doc_id", "page", F.inline(F.filter(found, lambda x: x["value"].isNotNull())))


def asked(provider: Provider, texts: list[str]) -> list[tuple[list[tuple[str, str]], str | None]]:
    """A provider's answers, one for each text; a call that fails is repeated text by text."""
    try:
        answers = list(provider(texts))
        if len(answers) == len(texts):
            return answers
        failed = f"{len(answers)} answers to {len(texts)} texts"
    except Exception as error:  # a provider's failure is a result, not the job's end
        failed = f"{type(error).__name__}: {error}"
    # one bad text doesn't fail the others of its call
    return [([], failed)] if len(texts) == 1 else [asked(provider, [t])[0] for t in texts]


def _waves(texts: DataFrame, most: int) -> list[list[str]]:
    """The files that hold texts, in lists of about ``most`` characters, one file at least, each from its largest file to its smallest."""
    lists, room = [], 0
    sizes = texts.groupBy(F.col("_metadata.file_path").alias("path")).agg(F.sum("n").alias("n"))
    for r in sorted(sizes.collect()):
        if not lists or room < r["n"]:
            lists.append([])
            room = most
        lists[-1].append((r["n"], r["path"]))
        room -= r["n"]
    return [[path for _, path in sorted(files, reverse=True)] for files in lists]


def _dealt(texts: DataFrame, files: list[str], tasks: int) -> DataFrame:
    """The rows of files in so many tasks: many files are read by them as they lie, in even shares; few ones are shuffled."""
    if len(files) < 4 * tasks:
        return texts.where(F.col("_metadata.file_path").isin(files)).repartition(tasks)
    return reduce(DataFrame.union, [texts.where(F.col("_metadata.file_path").isin(files[i::tasks])) for i in range(tasks)]).coalesce(tasks)


def listed(chunks: DataFrame, per_file: int = PER_FILE) -> DataFrame:
    """Chunks in files of up to ``per_file`` rows, as in_waves() takes them; places stay, where chunks have pages and lengths."""
    size = F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n")
    more = [c for c in ("pages", "lengths", "classes") if c in chunks.columns]
    return tabled(chunks.select(F.col("doc_id").cast("long"), F.col("chunk_id").cast("int"), F.col("page_from").cast("int"), "text", *more, size), per_file)


def extract(chunks: DataFrame, provider: Provider, max_in_flight: int = MAX_IN_FLIGHT, batch: int = 16, per_task: int = PER_TASK, per_file: int = PER_FILE) -> DataFrame:
    """in_waves() of any chunks."""
    return in_waves(listed(chunks, per_file), provider, max_in_flight, batch, per_task)


def in_waves(texts: DataFrame, provider: Provider, max_in_flight: int = MAX_IN_FLIGHT, batch: int = 16, per_task: int = PER_TASK) -> DataFrame:
    """(doc_id, chunk_id, page, key, value, error) from a provider, at most ``max_in_flight`` calls at
    once: listed() texts are dealt to waves, one after the other, of so many tasks, each with one call at a time. An error is
    a row with a message; a text without values and error is a row without key. A call that fails is repeated text by text.
    Where texts have pages and lengths, also (at_page, offset), the place() of each value: the task has the text at hand,
    so it need not move to its values.

    A task reads about ``per_task`` characters, or where texts are very long a share of a file's rows, however many
    there are. A call may cost money and differ when repeated, so the answers of each wave are checkpointed.
    """
    types = {"doc_id": pa.int64(), "chunk_id": pa.int32(), "page": pa.int32(), "key": pa.string(), "value": pa.string(), "error": pa.string()}
    asks, schema = ["doc_id", "chunk_id", "page_from", "text"], "doc_id long, chunk_id int, page int, key string, value string, error string"
    if placed := {"pages", "lengths"} <= set(texts.columns):
        types |= {"at_page": pa.int32(), "offset": pa.int32()}
        asks, schema = [*asks, "pages", "lengths"], schema + ", at_page int, offset int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for listed in batches:
            doc, chunk, page, texts = (c.to_pylist() for c in listed.columns[:4])
            places, rows = list(zip(doc, chunk, page)), []
            nowhere, pages_of = ((None, None), paged(*listed.columns[4:])) if placed else ((), None)
            for at in range(0, len(texts), batch):
                for i, (values, error) in enumerate(asked(provider, texts[at : at + batch]), at):
                    for k, v in values:
                        found = nowhere if not placed or v is None else place(texts[i] or "", *pages_of(i), v)
                        rows.append((*places[i], k, v, None, *found))
                    if error is not None or not values:
                        rows.append((*places[i], None, None, error, *nowhere))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types.values())], list(types))

    found = []
    for files in _waves(texts, max_in_flight * per_task) or [[]]:
        found.append(written(_dealt(texts, files, max_in_flight).select(*asks).mapInArrow(run, schema)))
    return reduce(DataFrame.union, found)


PAGE = "text string, tables array<array<array<string>>>, layout array<struct<kind:string,text:string>>"


def recognise(files: DataFrame, provider: Callable[[bytes], list]) -> DataFrame:
    """(path, page, text, tables, layout, error): the pages of files with a binary ``content``.

    A page is its text, or a dictionary with text, tables (rows of cells) and layout (kind and text
    of each block in reading order). A file that can't be read is one page with an error.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    for i, page in enumerate(provider(bytes(content))):
                        page = page if isinstance(page, dict) else {"text": page}
                        layout = [{"kind": k, "text": t} for k, t in page.get("layout", [])]
                        rows.append((path, i, page.get("text"), page.get("tables", []), layout, None))
                except Exception as failed:
                    rows.append((path, 0, None, [], [], f"{type(failed).__name__}: {failed}"))
            yield pd.DataFrame(rows, columns=["path", "page", "text", "tables", "layout", "error"])

    return files.select("path", "content").mapInPandas(run, f"path string, page int, {PAGE}, error string")


def html_tables(pages: DataFrame) -> DataFrame:
    """(page_id, table, row, cells): the cells of every table row of raw web pages, numbered from 0."""
    bare = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, r"(?s)<[^>]+>", " "), r"[\x20\x09-\x0D]+", " "))
    tables = pages.select("page_id", F.posexplode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r"(?is)<table[ >].*?</table>"), F.lit(0))).alias("table", "t"))
    rows = tables.select("page_id", "table", F.posexplode(F.regexp_extract_all("t", F.lit(r"(?is)<tr[ >].*?</tr>"), F.lit(0))).alias("row", "r"))
    cells = F.transform(F.regexp_extract_all("r", F.lit(r"(?is)<t[dh][ >].*?</t[dh]>"), F.lit(0)), bare)
    return rows.select("page_id", "table", "row", cells.alias("cells"))


def html_layout(pages: DataFrame) -> DataFrame:
    """(page_id, text, n_tables, headings): text and layout of raw web pages, in place of a recogniser."""
    html = F.coalesce("html", F.lit(""))
    bare = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " "), r"(?s)<[^>]+>", " ")
    return pages.select("page_id", F.trim(F.regexp_replace(bare, r"[\x20\x09-\x0D]+", " ")).alias("text"), F.size(F.regexp_extract_all(html, F.lit(r"(?i)<table[ >]"), F.lit(0))).cast("long").alias("n_tables"), F.size(F.regexp_extract_all(html, F.lit(r"(?i)<h[1-6][ >]"), F.lit(0))).cast("long").alias("n_headings"))


def merge(values: DataFrame) -> DataFrame:
    """(doc_id, key, value, page): of each field the first value that isn't null, in page order, with
    its 1-based page; the same for any order of the rows."""
    rows = values.where(F.col("value").isNotNull()).groupBy("doc_id", "key").agg(F.min(F.struct("page", "value")).alias("m"))
    return rows.select("doc_id", "key", F.col("m.value").alias("value"), (F.col("m.page") + 1).alias("page"))


def outcome(answers: DataFrame) -> DataFrame:
    """(doc_id, status, error): E100 with the first message where any chunk failed, else S100."""
    rows = answers.groupBy("doc_id").agg(F.min(F.when(F.col("error").isNotNull(), F.struct("page", "error")))["error"].alias("error"))
    return rows.select("doc_id", F.when(F.col("error").isNull(), "S100").otherwise("E100").alias("status"), "error")


def route(values: DataFrame, model: ExtractionModel) -> DataFrame:
    """Values with ``guided``: whether the model declares the field."""
    return values.withColumn("guided", F.coalesce(F.col("key").isin([f.key for f in model.fields]), F.lit(False)))


#: Values of a field drafted as a number.
NUMBER = r"^-?[0-9]+(\.[0-9]+)?$"


def drafted(values: DataFrame) -> DataFrame:
    """(model_name, fields) of values with the model_name they were found for: each key a field, by name, of type
    number where all its values are numbers, string otherwise, labelled by the key in capitals. Values without a
    model's name are left out."""
    keys = values.where("model_name IS NOT NULL AND key IS NOT NULL").groupBy("model_name", "key").agg(F.every(F.coalesce(F.col("value").rlike(NUMBER), F.lit(False))).alias("numeric"))
    one = F.struct("key", F.upper("key").alias("label"), F.when(F.col("numeric"), "number").otherwise("string").alias("type"), F.lit(None).cast("string").alias("description"))
    return keys.groupBy("model_name").agg(F.array_sort(F.collect_list(one)).alias("fields"))


def records(merged: DataFrame, model: ExtractionModel) -> DataFrame:
    """(doc_id, guide_extracted map, other_data array) from merged values."""
    rows = route(merged, model).groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("guided"), F.struct("key", F.struct("value", "page").alias("v"))))).alias("g"),
        F.array_sort(F.collect_list(F.when(~F.col("guided"), F.struct("page", "key", "value")))).alias("other_data"),
    )
    return rows.select("doc_id", F.map_from_entries("g").alias("guide_extracted"), "other_data")


def project(merged: DataFrame, model: ExtractionModel) -> DataFrame:
    """One row per document, one raw column per declared field."""
    keys = [f.key for f in model.fields]
    return merged.groupBy("doc_id").pivot("key", keys).agg(F.first("value")) if keys else merged.select("doc_id").distinct()


def relabel(wide: DataFrame, model: ExtractionModel) -> DataFrame:
    return wide.withColumnsRenamed({f.key: f.label for f in model.fields})


def cast_fields(wide: DataFrame, model: ExtractionModel) -> DataFrame:
    """Raw columns as their fields' types."""
    return wide.withColumns({f.key: typed(F.col(f.key), f.type) for f in model.fields})


def locate(merged: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, key, value, page, offset): where each value stands on its page, from 1, 0 if absent."""
    at = pages.select("doc_id", (F.col("page") + 1).alias("page"), "text")
    return merged.join(at, ["doc_id", "page"]).select("doc_id", "key", "value", "page", F.expr("instr(text, value)").cast("long").alias("offset"))


def mentions(items: DataFrame, docs: DataFrame, words: int = 6) -> DataFrame:
    """(item_id, doc_id, offset): where items' texts stand in documents, whole words or not.

    The words within an item, but for its first and last, are whole words wherever it stands. Up to
    ``words`` of them in a row are its key; documents are joined on the windows of the sizes that keys
    have, by hashes alone, and texts are looked at for the candidates only. Items of one or two words
    have no such key: occurrences() searches every document for all of them at once. Empty items and rows without ids have no mentions.
    """
    split = lambda c: F.array_remove(F.split(c, r"[\x20\x09-\x0D]+", -1), "")
    own = items.where((F.length("text") > 0) & F.col("item_id").isNotNull()).select("item_id", F.col("text").alias("item"), split(F.col("text")).alias("w")).distinct()
    size = F.least(F.size("w") - 2, F.lit(words))
    keyed = own.where(F.size("w") > 2).select("item_id", "item", size.alias("n"), F.xxhash64(size, F.slice("w", F.lit(2), size)).alias("k"))
    sizes = sorted(r["n"] for r in keyed.select("n").distinct().collect())  # ``words`` values at most

    def windows(w: Column, n: int) -> Column:
        starts = F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.xxhash64(F.lit(n), F.slice(w, i, n)))

    found = docs.sparkSession.createDataFrame([], items.select("item_id").schema.add("doc_id", docs.schema["doc_id"].dataType).add("offset", "long"))
    if sizes:
        w = docs.select("doc_id", split(F.col("text")).alias("w"))
        places = w.select("doc_id", F.explode(F.array_distinct(F.flatten(F.array(*(windows(F.col("w"), n) for n in sizes))))).alias("k"))
        likely = places.join(keyed, "k").select("item_id", "item", "doc_id").distinct()
        found = likely.join(docs.select("doc_id", "text"), "doc_id").select("item_id", "doc_id", F.expr("instr(text, item)").cast("long").alias("offset")).where("offset > 0").distinct()
    short = occurrences(own.where(F.size("w") <= 2).select("item_id", F.col("item").alias("text")), docs)
    return found.unionByName(short.groupBy("item_id", "doc_id").agg(F.min("offset").alias("offset")))


def _blocks(items: DataFrame, most: int) -> Iterator[list[tuple]]:
    """Items in lists of about so many characters."""
    block, size = [], 0
    for r in items.toLocalIterator():
        block.append((r["item_id"], r["text"]))
        size += len(r["text"])
        if size >= most:
            yield block
            block, size = [], 0
    if block:
        yield block


def occurrences(items: DataFrame, docs: DataFrame, most: int = 1 << 24) -> DataFrame:
    """(item_id, doc_id, offset): every place, from 1, where an item's text stands in a document's, those
    that overlap too. One pass over a text finds all items by an automaton of their characters; items
    of over ``most`` characters together are a query set of several automata, a scan of the documents each.
    Equal items are found alike, rows that repeat count once; empty items and rows without ids have none.
    """
    import ahocorasick

    own = items.where((F.length("text") > 0) & F.col("item_id").isNotNull()).select("item_id", "text").distinct()
    texts = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text")
    ddl = f"item_id {items.schema['item_id'].dataType.simpleString()}, doc_id {docs.schema['doc_id'].dataType.simpleString()}, offset long"
    found = docs.sparkSession.createDataFrame([], ddl)
    for block in _blocks(own, most):
        listed = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pd.DataFrame], listed=listed) -> Iterator[pd.DataFrame]:
            by: dict[str, list] = {}
            for item, text in listed.value:
                by.setdefault(text, []).append(item)
            automaton = ahocorasick.Automaton()
            for text, ids in by.items():
                automaton.add_word(text, (len(text), ids))
            automaton.make_automaton()
            for pdf in batches:
                for doc, text in zip(pdf["doc_id"], pdf["text"]):
                    rows = [(i, doc, end - n + 2) for end, (n, ids) in automaton.iter(text) for i in ids]
                    if rows:
                        yield pd.DataFrame(rows, columns=["item_id", "doc_id", "offset"])

        found = found.unionByName(texts.mapInPandas(run, ddl))
    return found.distinct()
