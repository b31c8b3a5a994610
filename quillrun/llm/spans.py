"""Spans of regular expressions as rows, with built-in functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Code points of text kept from before and after each match.
CONTEXT = 40


class Kind:
    """A named pattern. ``guard``: a cheap condition that every text with a match meets. ``keep``:
    which matches count, on the matched value; others are let fall without another try."""

    def __init__(self, name: str, pattern: str, guard: Callable[[Column], Column] | None = None, keep: Callable[[Column], Column] | None = None):
        self.name, self.pattern, self.guard, self.keep = name, pattern, guard, keep


def _found(text: Column, kind: Kind) -> Column:
    """array<struct<kind, gap, len, value, before, after>>: gap is the distance from the match before."""
    pieces, values = F.split(text, kind.pattern, -1), F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    named = lambda p: F.struct(F.length(p).alias("gap"), F.right(p, F.lit(CONTEXT)).alias("before"))
    both = F.zip_with(F.transform(pieces, named), values, lambda p, v: F.struct(p["gap"].alias("gap"), p["before"].alias("before"), v.alias("value")))
    after = F.transform(F.slice(pieces, 2, 1 << 30), lambda p: F.left(p, F.lit(CONTEXT)))
    rows = F.zip_with(both, after, lambda x, a: F.struct(F.lit(kind.name).alias("kind"), x["gap"].alias("gap"), F.length(x["value"]).alias("len"), x["value"].alias("value"), x["before"].alias("before"), a.alias("after")))
    rows = F.filter(rows, lambda x: x["value"].isNotNull())
    none = F.array().cast("array<struct<kind:string,gap:int,len:int,value:string,before:string,after:string>>")
    return F.when(kind.guard(text), rows).otherwise(none) if kind.guard else rows


def spans_of(docs: DataFrame, text: Column, kinds: list[Kind]) -> DataFrame:
    """Rows (rid, doc_id, text_key, kind, start, end, value, before, after), dealt by rid: one for each
    kept match, in code points, end exclusive, and one with kind '' for each row of docs.

    Matches of a pattern are numbered, and a running sum of gaps and lengths gives their places.
    """
    base = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.xxhash64("text").alias("text_key"), text.alias("t"))
    mark = F.array(F.struct(F.lit("").alias("kind"), F.lit(0).alias("gap"), F.lit(0).alias("len"), F.lit("").alias("value"), F.lit("").alias("before"), F.lit("").alias("after")))
    found = base.select("rid", "doc_id", "text_key", F.concat(mark, *(_found(F.col("t"), k) for k in kinds)).alias("f"))
    rows = found.select("rid", "doc_id", "text_key", F.posexplode_outer("f").alias("n", "x")).select("rid", "doc_id", "text_key", "n", "x.*").repartition("rid")
    order = Window.partitionBy("rid", "kind").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(order)).withColumn("start", F.col("end") - F.col("len"))
    keep = F.lit(True)
    for k in kinds:
        if k.keep:
            keep = keep & ((F.col("kind") != k.name) | k.keep(F.col("value")))
    return rows.where(keep).select("rid", "doc_id", "text_key", "kind", "start", "end", "value", "before", "after")


def joined(spans: Column) -> Column:
    """kind:start:end of array<struct<..., kind, start, end>>, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def sql_spans(kind: str, pattern: str, text: str) -> str:
    """DuckDB SELECT of (rid, kind, s, e, value) for every match in a column of ``docs``."""
    return f"""SELECT * FROM (SELECT rid, '{kind}' kind, gaps + taken - length(value) s, gaps + taken e, value FROM (
  SELECT rid, vals[i] value, list_sum(list_transform(pieces[1:i], lambda x: length(x)))::BIGINT gaps, list_sum(list_transform(vals[1:i], lambda x: length(x)))::BIGINT taken FROM (
  SELECT *, unnest(range(1, len(vals) + 1)) i FROM (SELECT rid, string_split_regex({text}, '{pattern}') pieces, regexp_extract_all({text}, '{pattern}') vals FROM docs))))"""
