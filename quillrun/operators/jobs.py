"""One extraction job from files to logs: recognise, pack, extract, place, merge, save."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillrun.functions.scalars import is_supported
from quillrun.operators import extract, ledger, pages
from quillrun.schemas import ExtractionModel
from quillrun.sources.shared import written


def recognised(files: DataFrame, provider: Callable[[bytes], list]) -> tuple[DataFrame, DataFrame]:
    """Pages (doc_id, page, text) and failures (doc_id, error) of supported files with a doc_id; others
    fail unread. The provider is called once a file: its pages are checkpointed."""
    ok = files.where(is_supported(F.col("path")))
    found = written(extract.recognise(ok.select(F.col("doc_id").cast("string").alias("path"), "content"), provider).withColumnRenamed("path", "doc"))
    read = found.select(F.col("doc").cast("long").alias("doc_id"), "page", "text", "error")
    other = files.where(~is_supported(F.col("path"))).select("doc_id", F.lit("unsupported file").alias("error"))
    return read.where("error is null").select("doc_id", "page", "text"), read.where("error is not null").select("doc_id", "error").unionByName(other)


def placed(answers: DataFrame, texts: DataFrame) -> DataFrame:
    """answers with at_page and offset, the places of their values in the chunks ``texts`` (with pages and lengths)."""

    @F.arrow_udf("struct<at_page:int,offset:int>")
    def places(text: pa.Array, own: pa.Array, lengths: pa.Array, value: pa.Array) -> pa.Array:
        pages_of = pages.paged(own, lengths)
        found = [None if v is None else pages.place(t or "", *pages_of(i), v) for i, (t, v) in enumerate(zip(text.to_pylist(), value.to_pylist()))]
        rows = [None if f is None else {"at_page": f[0], "offset": f[1]} for f in found]
        return pa.array(rows, pa.struct({"at_page": pa.int32(), "offset": pa.int32()}))

    rows = answers.join(texts.select("doc_id", "chunk_id", "text", "pages", "lengths"), ["doc_id", "chunk_id"])
    return rows.withColumn("_at", places("text", "pages", "lengths", "value")).select(*(answers[c] for c in answers.columns), "_at.*")


def previews(found: DataFrame, subs: DataFrame, model: ExtractionModel) -> DataFrame:
    """(doc_id, preview_data): of every sub-document its pages, the first value of each declared field
    with its place, and all other first values as open data."""
    listed = subs.select("doc_id", "index", "page_ranges", F.explode("page_ranges").alias("n"))
    rows = found.join(listed.select("doc_id", "index", (F.col("n") - 1).alias("page")), ["doc_id", "page"])
    first = rows.groupBy("doc_id", "index", "key").agg(F.min(F.struct("page", "offset", "value")).alias("m"))
    guided = F.col("key").isin([f.key for f in model.fields])
    field = F.struct(F.col("m.value").alias("value"), (F.col("m.page") + 1).alias("page"), F.col("m.offset").alias("offset"))
    data = first.groupBy("doc_id", "index").agg(
        F.array_sort(F.collect_list(F.when(guided, F.struct("key", field.alias("v"))))).alias("g"),
        F.array_sort(F.collect_list(F.when(~guided, F.struct((F.col("m.page") + 1).alias("page"), "key", F.col("m.value").alias("value"))))).alias("o"),
    )
    none = F.array().cast("array<struct<key:string,v:struct<value:string,page:int,offset:int>>>")
    both = subs.join(data, ["doc_id", "index"], "left").select(
        "doc_id", "index", "page_ranges",
        F.struct(F.map_from_entries(F.coalesce("g", none)).alias("guide_extracted"), F.coalesce(F.transform("o", lambda x: F.parse_json(F.to_json(x))), F.array().cast("array<variant>")).alias("other_data")).alias("data"),
    )
    # variants can't be compared, so the order is put on the index alone, by a map of its own
    nested = both.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("index", F.struct("index", "page_ranges", "data").alias("s")))).alias("m"))
    ordered = F.transform(F.array_sort(F.map_keys("m")), lambda i: F.element_at("m", i))
    return nested.select("doc_id", F.struct(ordered.alias("sub_documents")).alias("preview_data"))


def run(own: DataFrame, model: ExtractionModel, provider: extract.Provider, kind: Column, now: str, failures: DataFrame | None = None, max_tokens: int = pages.MAX_TOKENS, max_in_flight: int = extract.MAX_IN_FLIGHT, answers_at: str | None = None, question: str = "") -> DataFrame:
    """The log of each document with pages (doc_id, page, text): status, error, nested preview_data,
    extracted_data as open data, created_at and updated_at. ``failures`` (doc_id, error) become logs too.

    The provider's answers are checkpointed before anything reads them twice. A document of which any
    chunk failed is E100 and keeps what the others gave. With a ledger of answers at ``answers_at`` only
    chunks are asked for that have no good answer there, so a job that is run again retries what failed.
    """
    texts = extract.listed(pages.chunked(own.select("doc_id", "page", "text", kind.alias("class")), max_tokens))
    if answers_at is None:
        answers = extract.in_waves(texts, provider, max_in_flight)
    else:
        ledger.ask(texts, provider, answers_at, question, max_in_flight)
        answers = written(placed(ledger.answers(texts, answers_at, question), texts))
    found = answers.where(F.col("value").isNotNull()).select("doc_id", "key", "value", F.col("at_page").alias("page"), "offset")
    nested = previews(found, pages.segment(pages.classed(texts), F.col("class")), model)
    flat = extract.merge(found).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("m"))
    logs = extract.outcome(answers).join(nested, "doc_id", "left").join(flat, "doc_id", "left")
    logs = logs.select("doc_id", "status", "error", F.parse_json(F.coalesce(F.to_json("m"), F.lit("{}"))).alias("extracted_data"), "preview_data")
    if failures is not None:
        logs = logs.unionByName(failures.select("doc_id", F.lit("E100").alias("status"), "error"), allowMissingColumns=True)
    return logs.withColumns({"created_at": F.lit(now), "updated_at": F.lit(now)})


def fields_of(logs: DataFrame, *also: str) -> DataFrame:
    """(doc_id, index, key, value, page, offset) of the declared fields in preview_data, and the logs' columns ``also``."""
    subs = logs.select("doc_id", *also, F.inline("preview_data.sub_documents"))
    return subs.select("doc_id", *also, "index", F.explode("data.guide_extracted").alias("key", "v")).select("doc_id", "index", "key", "v.*", *also)


def others_of(logs: DataFrame, *also: str) -> DataFrame:
    """(doc_id, index, key, value, page) of the open data in preview_data, and the logs' columns ``also``."""
    subs = logs.select("doc_id", *also, F.inline("preview_data.sub_documents"))
    open_data = subs.select("doc_id", *also, "index", F.explode("data.other_data").alias("o"))
    return open_data.select("doc_id", "index", *(F.try_variant_get("o", f"$.{k}", t).alias(k) for k, t in (("key", "string"), ("value", "string"), ("page", "int"))), *also)
