"""Secret scans with multipart credential linking.

Base kinds are reported always. Weaker parts - short or oddly named secrets, account identifiers,
endpoints - are reported only where complementary parts of a credential stand within the same scope,
a distance of ``scope`` code points: an identifier needs a secret and a secret an identifier or an
endpoint; an endpoint needs both. The interval join takes, for each weak part, the nearest part of
each sort before and after it by window functions, so parts are never paired with all others. Only
built-in functions run.

Defined results: a null text counts as empty and has no spans; repeated rows are scanned one by one;
spans of one start are ordered by kind, then end; an empty table gives an empty result; other
columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillrun.llm.common import checkpointed, sha256_hex, table
from quillrun.llm.spans import Kind, joined, spans_of, sql_spans

VALUE = r"[A-Za-z0-9+/_.=-]"
ASSIGN = rf"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?({VALUE}+)"""
ACCESS, HEX = "AKIA[A-Z0-9]{14,}", "[0-9a-f]{16,}"
WEAK_SECRET = rf"""(?i)(?:password|passwd|pwd|pass|secret|token|api_?key|private_?key|credential|auth)["']?\x20*[:=]\x20*["']?{VALUE}{{6,}}"""
WEAK_ID = r"""(?i)(?:user_?name|user_?id|user|login|account|client_?id|access_?id|access_?key)["']?\x20*[:=]\x20*["']?[a-z0-9@+/_.-]{3,}"""
ENDPOINT = r"(?:https?|ftp|ssh|amqp|redis|mongodb|mysql|postgres|postgresql|jdbc)://[^\x00-\x20\"'<>]+"
#: The kinds, in the order of ties.
BASE = ["assign", "access", "hex"]
WEAK = ["weak_secret", "weak_id", "endpoint"]
SCOPE = 200
#: Runs of a text up to which masked() cuts substrings; with more it takes the text apart once.
FEW = 64


def _has_sign(t: Column) -> Column:
    return t.contains(":") | t.contains("=")


KINDS = [
    Kind("assign", ASSIGN, _has_sign, lambda v: F.length(F.regexp_extract(v, ASSIGN, 2)) >= 12),
    Kind("access", ACCESS, lambda t: t.contains("AKIA")),
    Kind("hex", HEX, lambda t: t.rlike("[0-9a-f]{16}")),
    Kind("weak_secret", WEAK_SECRET, _has_sign),
    Kind("weak_id", WEAK_ID, _has_sign),
    Kind("endpoint", ENDPOINT, lambda t: t.contains("://")),
]


def secret_spans(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """One row per row of docs: doc_id, text_key, base and spans, arrays of
    struct<start, rank, kind, end> in order."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = spans_of(docs, text, KINDS)
    whole = Window.partitionBy("rid").orderBy("start", "end", "kind")
    # what follows is what precedes in the order turned round: a frame without end would be summed anew for each row
    back = Window.partitionBy("rid").orderBy(F.desc("start"), F.desc("end"), F.desc("kind"))
    past, ahead = (w.rowsBetween(Window.unboundedPreceding, -1) for w in (whole, back))
    base, ident, secret, place = F.col("kind").isin(BASE), F.col("kind").isin("access", "weak_id"), F.col("kind").isin("assign", "hex", "weak_secret"), F.col("kind") == "endpoint"

    def within(part: Column) -> Column:
        before, after = F.max(F.when(part, F.col("end"))).over(past), F.min(F.when(part, F.col("start"))).over(ahead)
        return F.coalesce(F.col("start") - before <= scope, F.lit(False)) | F.coalesce(after - F.col("end") <= scope, F.lit(False))

    rows = rows.withColumns({
        "near_id": within(ident), "near_secret": within(secret), "near_place": within(place),
        "over_base": F.coalesce(F.max(F.when(base, F.col("end"))).over(past) > F.col("start"), F.lit(False)) | F.coalesce(F.min(F.when(base, F.col("start"))).over(ahead) < F.col("end"), F.lit(False)),
    })
    linked = (
        F.when(F.col("kind") == "weak_secret", F.col("near_id") | F.col("near_place"))
        .when(F.col("kind") == "weak_id", F.col("near_secret"))
        .when(F.col("kind") == "endpoint", F.col("near_id") & F.col("near_secret"))
        .otherwise(False)
    )
    rank = F.array_position(F.array(*map(F.lit, BASE + WEAK)), F.col("kind"))
    span = F.struct("start", rank.alias("rank"), "kind", "end")
    return rows.groupBy("rid").agg(
        F.first("doc_id").alias("doc_id"), F.first("text_key").alias("text_key"),
        F.array_sort(F.collect_list(F.when(base, span))).alias("base"),
        F.array_sort(F.collect_list(F.when(base | (linked & ~F.col("over_base")), span))).alias("spans"),
    )


def masked(docs: DataFrame, scope: int = SCOPE, mask: str = "[SECRET]") -> DataFrame:
    """docs with every reported span of text replaced; spans that overlap are replaced as one. Takes time
    in proportion to a text and its spans, but for texts of up to ``FEW`` runs, where each run is sought from the start."""
    found = secret_spans(docs, scope).where(F.size("spans") > 0).dropDuplicates(["doc_id", "text_key"])
    found = checkpointed(_islands(checkpointed(found.select(F.monotonically_increasing_id().alias("n"), "doc_id", "text_key", "spans"))))
    found = F.broadcast(found) if found.count() <= 100_000 else found
    own = "_" * (1 + max(map(len, docs.columns)))  # a name that docs doesn't have
    on = [docs["doc_id"].eqNullSafe(found["doc_id"]), F.xxhash64(docs["text"]).eqNullSafe(found["text_key"])]
    runs = found["runs"]
    rows = docs.join(found, on, "left").select(*(docs[c] for c in docs.columns), runs.alias(f"{own}runs"), F.when(F.size(runs) > FEW, F.split(docs["text"], "", -1)).alias(f"{own}chars"))
    text, runs, chars = rows["text"], rows[f"{own}runs"], rows[f"{own}chars"]
    before = lambda i: F.when(i > 0, F.get(runs, i - 1)["end"]).otherwise(0)
    last = F.element_at(runs, -1)["end"]
    short = F.concat(F.array_join(F.transform(runs, lambda r, i: F.concat(F.substring(text, before(i) + 1, r["start"] - before(i)), F.lit(mask))), ""), F.substring(text, last + 1, F.length(text)))
    many = F.concat(F.array_join(F.transform(runs, lambda r, i: F.concat(F.array_join(F.slice(chars, before(i) + 1, r["start"] - before(i)), ""), F.lit(mask))), ""), F.array_join(F.slice(chars, last + 1, F.size(chars)), ""))
    new = F.when(runs.isNull(), text).when(chars.isNull(), short).otherwise(many)
    return rows.select(*(new.alias(c) if c == "text" else rows[c] for c in docs.columns))


def _islands(found: DataFrame) -> DataFrame:
    """(doc_id, text_key, runs) of rows with a number ``n`` each: spans that overlap made one, by windows over a text's spans."""
    rows = found.select("n", "doc_id", "text_key", F.explode("spans").alias("s")).select("n", "doc_id", "text_key", F.col("s.start").cast("int").alias("start"), F.col("s.end").cast("int").alias("end"))
    order = Window.partitionBy("n").orderBy("start", "end")
    rows = rows.withColumn("reached", F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("island", F.sum(F.when(F.col("start") < F.col("reached"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = rows.groupBy("n", "island").agg(F.first("doc_id").alias("doc_id"), F.first("text_key").alias("text_key"), F.min("start").alias("start"), F.max("end").alias("end"))
    return runs.groupBy("n").agg(F.first("doc_id").alias("doc_id"), F.first("text_key").alias("text_key"), F.array_sort(F.collect_list(F.struct("start", "end"))).alias("runs")).drop("n")


def op5_secret_scan(spark, sf_dir: str) -> DataFrame:
    found = secret_spans(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(count, BASE), sha256_hex(joined(F.col("base"))).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def _sql(pattern: str) -> str:
    """The pattern for text with A-Z lower-cased."""
    return pattern.removeprefix("(?i)").replace("A-Za-z", "a-z").replace("'", "''")


OP5_SQL = f"""
WITH docs AS (SELECT row_number() OVER () rid, doc_id, coalesce(text, '') t, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') l FROM documents),
parts AS (
{sql_spans("assign", _sql(ASSIGN), "l")} WHERE length(regexp_extract(value, '{_sql(ASSIGN)}', 2)) >= 12 UNION ALL
{sql_spans("access", ACCESS, "t")} UNION ALL
{sql_spans("hex", HEX, "t")} UNION ALL
{sql_spans("weak_secret", _sql(WEAK_SECRET), "l")} UNION ALL
{sql_spans("weak_id", _sql(WEAK_ID), "l")} UNION ALL
{sql_spans("endpoint", ENDPOINT.replace("'", "''"), "t")}),
near AS (SELECT *, kind IN ('assign', 'access', 'hex') base,
  coalesce(s - max(CASE WHEN kind IN ('access', 'weak_id') THEN e END) OVER past <= {SCOPE}, false) OR coalesce(min(CASE WHEN kind IN ('access', 'weak_id') THEN s END) OVER ahead - e <= {SCOPE}, false) near_id,
  coalesce(s - max(CASE WHEN kind IN ('assign', 'hex', 'weak_secret') THEN e END) OVER past <= {SCOPE}, false) OR coalesce(min(CASE WHEN kind IN ('assign', 'hex', 'weak_secret') THEN s END) OVER ahead - e <= {SCOPE}, false) near_secret,
  coalesce(s - max(CASE WHEN kind = 'endpoint' THEN e END) OVER past <= {SCOPE}, false) OR coalesce(min(CASE WHEN kind = 'endpoint' THEN s END) OVER ahead - e <= {SCOPE}, false) near_place,
  coalesce(max(CASE WHEN kind IN ('assign', 'access', 'hex') THEN e END) OVER past > s, false) OR coalesce(min(CASE WHEN kind IN ('assign', 'access', 'hex') THEN s END) OVER ahead < e, false) over_base
  FROM parts WINDOW past AS (PARTITION BY rid ORDER BY s, e, kind ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), ahead AS (PARTITION BY rid ORDER BY s, e, kind ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
told AS (SELECT rid, base, kind, s, concat_ws(':', kind, s, e) span, list_position(['assign', 'access', 'hex', 'weak_secret', 'weak_id', 'endpoint'], kind) rank, e FROM near
  WHERE base OR NOT over_base AND (kind = 'weak_secret' AND (near_id OR near_place) OR kind = 'weak_id' AND near_secret OR kind = 'endpoint' AND near_id AND near_secret)),
by_doc AS (SELECT rid, count(*) FILTER (kind = 'assign') a, count(*) FILTER (kind = 'access') k, count(*) FILTER (kind = 'hex') h,
  string_agg(span, ',' ORDER BY s, rank, e) FILTER (base) base_spans, string_agg(span, ',' ORDER BY s, rank, e) all_spans FROM told GROUP BY rid)
SELECT doc_id, coalesce(a, 0)::BIGINT n_assign, coalesce(k, 0)::BIGINT n_access, coalesce(h, 0)::BIGINT n_hex, sha256(coalesce(base_spans, '')) base_sha256, coalesce(all_spans, '') spans
FROM docs LEFT JOIN by_doc USING (rid)
"""
