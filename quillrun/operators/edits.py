"""Users' edits written back into the logs of jobs.

Edits are (doc_id, index, key, value, edited_at, seq): a field of one sub-document and its new value, null
to clear it. Of a field's edits the last by edited_at and seq counts; equal ones are decided by the value.
Only finished jobs (S100, S200) take edits, and only in sub-documents that they have; rejected() tells the
others and why. A null document, sub-document or key names no field.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillrun.operators.history import PIECE_ROWS, in_pieces
from quillrun.schemas import ExtractionModel
from quillrun.sources.shared import written

DONE = ("S100", "S200")
_OPEN = (("page", "int"), ("key", "string"), ("value", "string"))


def _judged(logs: DataFrame, edits: DataFrame, *also: Column) -> DataFrame:
    """edits with reason, why they can't be applied, null where they can, and the columns ``also`` of their log."""
    own = logs.select("doc_id", F.col("status").alias("_status"), F.col("preview_data.sub_documents.index").alias("_indexes"), *also)
    rows = edits.join(own, "doc_id", "left")
    reason = (
        F.when(F.col("doc_id").isNull() | F.col("index").isNull() | F.col("key").isNull(), "no field")
        .when(F.col("_status").isNull(), "no log")
        .when(~F.col("_status").isin(*DONE), "not finished")
        .when(~F.coalesce(F.array_contains("_indexes", F.col("index")), F.lit(False)), "no sub-document")
    )
    return rows.withColumn("reason", reason).drop("_status", "_indexes")


def rejected(logs: DataFrame, edits: DataFrame) -> DataFrame:
    """edits that can't be applied, with the reason."""
    return _judged(logs, edits).where(F.col("reason").isNotNull())


def trail(logs: DataFrame, edits: DataFrame, each: int = PIECE_ROWS) -> DataFrame:
    """Applicable edits with before, the value that each one replaced: the last edit's, or for the first
    the machine's. logs are as they were before any of the edits. The edit before is looked for within
    ranges of the order, and beyond them among each field's last ones, so one field may have most edits."""
    rows = _judged(logs, edits, F.col("preview_data.sub_documents").alias("_subs")).where(F.col("reason").isNull())
    rows = rows.withColumn("_sub", F.get(F.filter("_subs", lambda s: s["index"] == F.col("index")), F.lit(0)))
    other = F.filter("_sub.data.other_data", lambda o: F.try_variant_get(o, "$.key", "string") == F.col("key"))
    found = F.coalesce(F.try_element_at("_sub.data.guide_extracted", F.col("key"))["value"], F.try_variant_get(F.get(other, F.lit(0)), "$.value", "string"))
    field, order = ["doc_id", "index", "key"], ("edited_at", "seq", "value")
    # written, as ranges are made from counts and samples of the rows
    rows = in_pieces(written(rows.withColumn("_found", found).drop("_sub", "_subs", "reason")), each, order)
    w = Window.partitionBy(*field, "_piece").orderBy(*order)
    lasts = rows.groupBy(*field, "_piece").agg(F.max(F.struct(*order)).alias("_last"))
    lasts = lasts.withColumn("_carried", F.lag("_last").over(Window.partitionBy(*field).orderBy("_piece"))).drop("_last")
    rows = rows.withColumns({"_k": F.row_number().over(w), "_lag": F.lag("value").over(w)}).join(lasts, [*field, "_piece"])
    first = F.when(F.col("_carried").isNull(), F.col("_found")).otherwise(F.col("_carried.value"))
    return rows.withColumn("before", F.when(F.col("_k") == 1, first).otherwise(F.col("_lag"))).select(*edits.columns, "before")


def _named(o: Column) -> list[Column]:
    """page, key and value of an entry of open data."""
    return [F.try_variant_get(o, f"$.{k}", t).alias(k) for k, t in _OPEN]


def apply(logs: DataFrame, edits: DataFrame, model: ExtractionModel, now: str) -> DataFrame:
    """logs with the edits in preview_data and extracted_data.

    Declared fields are edited in guide_extracted, others in other_data; both keep the place where the
    machine found them, and new ones have none. extracted_data gets, for edited keys, the first value in
    the order of sub-documents, and loses keys that have none left. Edited logs are S200, updated now; all
    others stay as they are. A document's edits, the last of each field, meet in its log's row.
    """
    last = edits.dropna(subset=["doc_id", "index", "key"]).groupBy("doc_id", "index", "key")
    mine = last.agg(F.max_by("value", F.struct("edited_at", "seq", "value")).alias("value"))
    mine = mine.groupBy("doc_id").agg(F.collect_list(F.struct("index", "key", "value")).alias("_edits"))
    declared = [f.key for f in model.fields]

    def listed(index: Column, guided: bool) -> Column:
        """key -> value of a sub-document's edits, of declared keys or others."""
        ours = F.filter("_edits", lambda e: (e["index"] == index) & (e["key"].isin(declared) if guided else ~e["key"].isin(declared)))
        return F.map_from_entries(F.transform(ours, lambda e: F.struct(e["key"], e["value"])))

    both = lambda i: F.struct(listed(i, True).alias("guided"), listed(i, False).alias("others"))
    # made once a document, ahead of the join: lambdas would make it anew for each of its values
    mine = mine.withColumn("_of", F.map_from_entries(F.transform(F.array_distinct("_edits.index"), lambda i: F.struct(i, both(i)))))
    subs = F.col("preview_data.sub_documents")
    rows = logs.join(mine, "doc_id", "left").withColumn(
        "_edits",
        F.when(F.col("status").isin(*DONE), F.filter("_edits", lambda e: F.exists(subs, lambda s: s["index"] == e["index"]))),
    )
    of = lambda sub, kind: F.coalesce(F.try_element_at("_of", sub["index"])[kind], F.create_map().cast("map<string,string>"))

    def guide(sub: Column) -> Column:
        old, new = sub["data"]["guide_extracted"], of(sub, "guided")
        field = lambda k, v: F.struct(v.alias("value"), F.try_element_at(old, k)["page"].alias("page"), F.try_element_at(old, k)["offset"].alias("offset"))
        return F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k)), F.transform_values(new, field))

    def others(sub: Column) -> Column:
        """Open data as (page, key, value, kept, put): kept is the machine's own entry, put whether an edit replaces it."""
        old, new = F.transform(sub["data"]["other_data"], lambda o: F.struct(*_named(o), o.alias("kept"), F.lit(False).alias("put"))), of(sub, "others")
        put = lambda k, page: F.struct(page.alias("page"), k.alias("key"), F.element_at(new, k).alias("value"), F.lit(None).cast("variant").alias("kept"), F.lit(True).alias("put"))
        edited = F.transform(old, lambda o: F.when(F.coalesce(F.map_contains_key(new, o["key"]), F.lit(False)), put(o["key"], o["page"])).otherwise(o))
        fresh = F.array_sort(F.filter(F.map_keys(new), lambda k: ~F.exists(old, lambda o: F.coalesce(o["key"] == k, F.lit(False)))))
        return F.concat(edited, F.transform(fresh, lambda k: put(k, F.lit(None).cast("int"))))

    # typed, so that values needn't be read back from the open data that is written; only logs with edits are made anew
    touched = F.size("_edits") > 0
    made = F.transform(subs, lambda s: F.struct(s["index"].alias("index"), s["page_ranges"].alias("page_ranges"), guide(s).alias("guided"), others(s).alias("others")))
    rows = rows.withColumn("_new", F.when(touched, made))
    entry = lambda o: F.when(o["put"], F.parse_json(F.to_json(F.struct(o["page"].alias("page"), o["key"].alias("key"), o["value"].alias("value"))))).otherwise(o["kept"])
    data = lambda s: F.struct(s["guided"].alias("guide_extracted"), F.transform(s["others"], entry).alias("other_data"))
    new_subs = F.transform("_new", lambda s: F.struct(s["index"].alias("index"), s["page_ranges"].alias("page_ranges"), data(s).alias("data")))
    rows = rows.withColumn("preview_data", F.when(touched, F.struct(new_subs.alias("sub_documents"))).otherwise(F.col("preview_data")))

    known = lambda s: F.concat(
        F.transform(F.map_entries(s["guided"]), lambda e: F.struct(e["key"].alias("key"), e["value"]["value"].alias("value"))),
        F.transform(s["others"], lambda o: F.struct(o["key"].alias("key"), o["value"].alias("value"))),
    )
    values = F.filter(F.flatten(F.transform("_new", known)), lambda v: v["value"].isNotNull())
    keys = F.array_distinct(F.transform("_edits", lambda e: e["key"]))
    old = F.coalesce(F.col("extracted_data").cast("map<string,string>"), F.create_map().cast("map<string,string>"))
    kept = F.map_filter(old, lambda k, _: ~F.array_contains("_keys", k))
    firsts = F.transform("_keys", lambda k: F.struct(k.alias("key"), F.get(F.filter("_values", lambda v: v["key"] == k), F.lit(0))["value"].alias("value")))
    flat = F.map_concat(kept, F.map_from_entries(F.filter(firsts, lambda v: v["value"].isNotNull())))
    rows = rows.withColumns({"_keys": keys, "_values": values})
    return rows.withColumns({
        "extracted_data": F.when(touched, F.parse_json(F.to_json(flat))).otherwise(F.col("extracted_data")),
        "status": F.when(touched, "S200").otherwise(F.col("status")),
        "updated_at": F.when(touched, now).otherwise(F.col("updated_at")),
    }).select(*logs.columns)
