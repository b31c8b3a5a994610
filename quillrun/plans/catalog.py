"""Registered queries and the SQL that gives the same rows.

Names begin with the id of the operator. Entities are stand-ins on the test tables (sources.derived).
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import functions as F

from quillrun.functions import scalars
from quillrun.operators import edits, extract, grids, history, jobs, ledger, pages
from quillrun.schemas import ADMINS, EDITORS, NEXT, STATUSES, ExtractionModel, Field, status_dim
from quillrun.sources import derived, files, workbook
from quillrun.sources.derived import LOG_SQL, extraction_log, table
from quillrun.sources.shared import folder, written
from quillrun.streaming import lifecycle

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def registered(sql: str | None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


MODEL = ExtractionModel("contacts", (Field("email", "E-mail"), Field("ipv4", "Address"), Field("long_word", "Term")))
PAGES_SQL = """lines AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) l FROM documents),
numbered AS (SELECT doc_id, l, unnest(range(0, (len(l) - 1) // 5 + 1)) p FROM lines),
pages AS (SELECT doc_id, p::INT page, array_to_string(l[p * 5 + 1:p * 5 + 5], chr(10)) text FROM numbered)"""
SIZED_SQL = PAGES_SQL + ", sized AS (SELECT doc_id, page, text, ceil(length(text) / 4.0)::BIGINT t FROM pages)"
VALUES_SQL = PAGES_SQL + ", found AS (" + " UNION ALL ".join(f"SELECT doc_id, page, '{k}' key, nullif(regexp_extract(text, '{p}', 0), '') value FROM pages" for k, p in extract.RULES.items()) + "), vals AS (SELECT * FROM found WHERE value IS NOT NULL)"
MERGED_SQL = VALUES_SQL + ", merged AS (SELECT doc_id, key, arg_min(value, page) value, (min(page) + 1)::INT page FROM vals GROUP BY doc_id, key)"
POLLS_SQL = """polls AS (SELECT user_id job, ts, event_id seq, CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'upload' ELSE 'poll' END kind FROM events),
numbered AS (SELECT *, row_number() OVER w attempt, coalesce(sum((kind = 'error')::INT) OVER (PARTITION BY job ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT prior_errors FROM polls WINDOW w AS (PARTITION BY job ORDER BY ts, seq)),
made AS (SELECT job, seq, attempt, prior_errors, attempt <= 60 AND prior_errors < 3 made FROM numbered)"""
OUTCOME_SQL = f"""WITH {POLLS_SQL}, sums AS (SELECT job, count(*) attempts, sum((kind = 'error')::INT)::BIGINT errors FROM made JOIN numbered USING (job, seq) WHERE made GROUP BY job)
SELECT *, CASE WHEN errors >= 3 THEN 'stopped' WHEN attempts >= 60 THEN 'timeout' ELSE 'open' END outcome FROM sums"""
CHANGES_SQL = """changes AS (SELECT user_id job, ts, event_id seq, CASE event_type WHEN 'signup' THEN 'P100' WHEN 'view' THEN 'P200' WHEN 'click' THEN 'P300' WHEN 'purchase' THEN 'S100' WHEN 'error' THEN 'E100' END status FROM events)"""
DIM_SQL = "dim AS (SELECT * FROM (VALUES " + ", ".join(map(repr, STATUSES)) + ") t(code, label, terminal))"


def _pages(spark, sf_dir):
    return pages.paginate(table(spark, sf_dir, "documents"))


def _merged(spark, sf_dir, rules=extract.RULES):
    return extract.merge(extract.extract_by_rules(_pages(spark, sf_dir), rules))


@registered(f"WITH {PAGES_SQL} SELECT * FROM pages")
def x01_paginate(spark, sf_dir):
    return _pages(spark, sf_dir)


@registered(f"WITH {SIZED_SQL} SELECT doc_id, count(*) n_pages, sum(t)::BIGINT est_tokens FROM sized GROUP BY doc_id")
def a05_token_counts(spark, sf_dir):
    sized = _pages(spark, sf_dir).withColumn("t", scalars.est_tokens(F.col("text")))
    return sized.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_pages"), F.sum("t").alias("est_tokens"))


@registered("SELECT doc_id, ceil(length(coalesce(text, '')) / 4.0)::BIGINT est_tokens, CASE WHEN ceil(length(coalesce(text, '')) / 4.0) > 500 THEN 'chunked' ELSE 'single' END AS mode FROM documents")
def x02_chunk_mode(spark, sf_dir):
    return pages.plan(table(spark, sf_dir, "documents"))


@registered("SELECT doc_id FROM documents WHERE ceil(length(text) / 4.0) > 500")
def p10_over_limit(spark, sf_dir):
    return pages.plan(table(spark, sf_dir, "documents")).where("mode = 'chunked'").select("doc_id")


GREEDY_SQL = f"""WITH RECURSIVE {SIZED_SQL},
packed AS (SELECT doc_id, page, t, 0 chunk, t total FROM sized WHERE page = 0 UNION ALL
  SELECT s.doc_id, s.page, s.t, CASE WHEN p.total + s.t > 500 THEN p.chunk + 1 ELSE p.chunk END, CASE WHEN p.total + s.t > 500 THEN s.t ELSE p.total + s.t END
  FROM packed p JOIN sized s ON s.doc_id = p.doc_id AND s.page = p.page + 1)"""


@registered(GREEDY_SQL + " SELECT doc_id, page, t est_tokens, chunk::INT chunk_id, t > 500 oversized FROM packed")
def x03_pack(spark, sf_dir):
    return pages.pack(_pages(spark, sf_dir))


@registered(GREEDY_SQL + " SELECT p.doc_id, chunk::INT chunk_id, min(p.page) page_from, max(p.page) page_to, string_agg(text, chr(10) ORDER BY p.page) text, sum(p.t)::BIGINT est_tokens FROM packed p JOIN sized s ON p.doc_id = s.doc_id AND p.page = s.page GROUP BY p.doc_id, chunk")
def x03_chunks(spark, sf_dir):
    own = _pages(spark, sf_dir)
    return pages.chunks(own, pages.pack(own))


@registered(f"WITH {SIZED_SQL} SELECT doc_id, page, ((sum(t) OVER (PARTITION BY doc_id ORDER BY page) - t) // 500)::INT chunk_id FROM sized")
def w03_pack_by_sum(spark, sf_dir):
    return pages.pack_by_running_sum(_pages(spark, sf_dir))


@registered(f"WITH {PAGES_SQL} SELECT doc_id, arg_min(v, page) long_word, (min(page) + 1)::INT page_no FROM (SELECT doc_id, page, nullif(regexp_extract(text, '[a-z]{{14,}}', 0), '') v FROM pages) WHERE v IS NOT NULL GROUP BY doc_id")
def x04_extract_merge(spark, sf_dir):
    return _merged(spark, sf_dir, {"long_word": extract.RULES["long_word"]}).select("doc_id", F.col("value").alias("long_word"), F.col("page").alias("page_no"))


@registered(f"WITH {VALUES_SQL} SELECT * FROM vals")
def x04_extract_fields(spark, sf_dir):
    return extract.extract_by_rules(_pages(spark, sf_dir))


def _shouting(texts):
    """A provider that gives the first word and fails on texts with '###'."""
    return [([], "unreadable") if "###" in t else ([("first", t.split()[0])] if t.split() else [], None) for t in texts]


@registered(GREEDY_SQL + """, chunked AS (SELECT p.doc_id, chunk, string_agg(text, chr(10) ORDER BY p.page) text FROM packed p JOIN sized s ON p.doc_id = s.doc_id AND p.page = s.page GROUP BY p.doc_id, chunk)
SELECT doc_id, CASE WHEN bool_or(text LIKE '%###%') THEN 'E100' ELSE 'S100' END status, CASE WHEN bool_or(text LIKE '%###%') THEN 'unreadable' END error FROM chunked GROUP BY doc_id""")
def x13_error_capture(spark, sf_dir):
    own = _pages(spark, sf_dir)
    return extract.outcome(extract.extract(pages.chunks(own, pages.pack(own)), _shouting))


def _reading(texts):
    """A provider that gives the first word of any text."""
    return [([("first", t.split()[0])] if t.split() else [], None) for t in texts]


@registered(
    GREEDY_SQL
    + r""", chunked AS (SELECT p.doc_id, chunk, string_agg(text, chr(10) ORDER BY p.page) text FROM packed p JOIN sized s ON p.doc_id = s.doc_id AND p.page = s.page GROUP BY p.doc_id, chunk)
SELECT doc_id, chunk::INT chunk_id, nullif(regexp_extract(text, '\S+', 0), '') value, CASE WHEN contains(text, '###') THEN 2 ELSE 1 END run FROM chunked"""
)
def x12_retry_chunks(spark, sf_dir):
    """All chunks are asked for; a second run asks again for those that failed, and only for them."""
    own = _pages(spark, sf_dir)
    chunked, path = written(pages.chunks(own, pages.pack(own))), f"{folder(spark)}/ledger-{uuid.uuid4().hex}"
    ledger.ask(chunked, _shouting, path, per_task=4096)
    failed = written(ledger.answers(chunked, path).where("error is not null").select("doc_id", "chunk_id").distinct())
    ledger.ask(chunked, _reading, path, per_task=4096)
    rows = ledger.answers(chunked, path).join(failed.withColumn("again", F.lit(True)), ["doc_id", "chunk_id"], "left")
    return rows.select("doc_id", "chunk_id", "value", F.when(F.col("again"), 2).otherwise(1).alias("run"))


@registered(f"WITH {MERGED_SQL} SELECT * FROM merged")
def a01_merge(spark, sf_dir):
    return _merged(spark, sf_dir)


@registered(f"WITH {VALUES_SQL}, low AS (SELECT * FROM vals WHERE page = 0), high AS (SELECT * FROM vals WHERE page > 0) SELECT doc_id, key, count(*) n FROM (SELECT * FROM low UNION ALL SELECT * FROM high) GROUP BY doc_id, key")
def u03_combine_chunks(spark, sf_dir):
    values = extract.extract_by_rules(_pages(spark, sf_dir))
    both = values.where("page = 0").withColumn("first", F.lit(True)).unionByName(values.where("page > 0"), allowMissingColumns=True)
    return both.groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("n"))


@registered(f"WITH {MERGED_SQL} SELECT doc_id, max(value) FILTER (key = 'email') email, max(value) FILTER (key = 'ipv4') ipv4, max(value) FILTER (key = 'long_word') long_word FROM merged GROUP BY doc_id")
def p01_project(spark, sf_dir):
    return extract.project(_merged(spark, sf_dir), MODEL)


@registered(f"""WITH {MERGED_SQL} SELECT doc_id, max(value) FILTER (key = 'email') "E-mail", max(value) FILTER (key = 'ipv4') "Address", max(value) FILTER (key = 'long_word') "Term" FROM merged GROUP BY doc_id""")
def p02_relabel(spark, sf_dir):
    return extract.relabel(extract.project(_merged(spark, sf_dir), MODEL), MODEL)


@registered("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d')::DATE \"day\", (printf('%.2f', o_totalprice))::DECIMAL(18,2) money, printf('%.2f', o_totalprice)::DOUBLE number, o_orderkey % 2 = 0 flag, o_orderpriority label FROM orders")
def p03_typed(spark, sf_dir):
    raw = table(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy'년' M'월' d'일'").alias("day"), F.format_number("o_totalprice", 2).alias("money"), F.format_number("o_totalprice", 2).alias("number"), F.when(F.col("o_orderkey") % 2 == 0, "yes").otherwise("no").alias("flag"), F.col("o_orderpriority").alias("label"))
    cast = extract.cast_fields(raw, ExtractionModel("orders", (Field("day", "Day", "date"), Field("number", "Number", "number"), Field("flag", "Flag", "boolean"), Field("label", "Label"))))
    return cast.withColumn("money", scalars.to_money(F.col("money")))


@registered(f"WITH {MERGED_SQL} SELECT doc_id, key, value, page, key IN ('email', 'ipv4', 'long_word') guided FROM merged")
def x09_route(spark, sf_dir):
    return extract.route(_merged(spark, sf_dir), MODEL)


@registered(f"WITH {MERGED_SQL} SELECT doc_id, key, value, page FROM merged WHERE key IN ('email', 'ipv4', 'long_word')")
def a04_guide_extracted(spark, sf_dir):
    rows = extract.records(_merged(spark, sf_dir), MODEL)
    return rows.select("doc_id", F.explode("guide_extracted").alias("key", "v")).select("doc_id", "key", "v.value", "v.page")


@registered(f"WITH {MERGED_SQL} SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY page, key, value) - 1)::INT pos, page, key, value FROM merged WHERE key NOT IN ('email', 'ipv4', 'long_word')")
def a02_other_data(spark, sf_dir):
    rows = extract.records(_merged(spark, sf_dir), MODEL)
    return rows.select("doc_id", F.posexplode("other_data").alias("pos", "o")).select("doc_id", "pos", "o.page", "o.key", "o.value")


@registered(f"WITH {MERGED_SQL} SELECT m.doc_id, key, value, m.page, instr(text, value)::BIGINT AS \"offset\" FROM merged m JOIN pages p ON m.doc_id = p.doc_id AND m.page = p.page + 1")
def x10_highlight(spark, sf_dir):
    own = _pages(spark, sf_dir)
    return extract.locate(extract.merge(extract.extract_by_rules(own)), own)


@registered("SELECT item_id, doc_id, instr(d.text, b.text)::BIGINT AS \"offset\" FROM benchmark b JOIN documents d ON contains(d.text, b.text) WHERE length(b.text) > 0")
def j06_mentions(spark, sf_dir):
    return extract.mentions(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))


ITEMS_SQL = "items AS (SELECT item_id, array_to_string(string_split(text, ' ')[1:2], ' ') t FROM benchmark WHERE text <> '')"


@registered(
    f"""WITH {ITEMS_SQL}, found AS (SELECT item_id, doc_id, t, text FROM items JOIN documents ON contains(text, t) WHERE t <> ''),
places AS (SELECT item_id, doc_id, t, text, unnest(range(1, length(text) - length(t) + 2)) o FROM found)
SELECT item_id, doc_id, o "offset" FROM places WHERE substr(text, o, length(t)) = t"""
)
def j06_occurrences(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark").where("text <> ''").select("item_id", F.array_join(F.slice(F.split("text", " "), 1, 2), " ").alias("text"))
    return extract.occurrences(items, table(spark, sf_dir, "documents"))


ISLANDS_SQL = f"""WITH {PAGES_SQL}, kinds AS (SELECT doc_id, page, CASE WHEN contains(text, '###') THEN 1 ELSE 0 END AS "class" FROM pages),
islands AS (SELECT *, page - row_number() OVER (PARTITION BY doc_id, "class" ORDER BY page) island FROM kinds),
subs AS (SELECT doc_id, "class", min(page) + 1 page_from, max(page) + 1 page_to, count(*) n FROM islands GROUP BY doc_id, "class", island),
indexed AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page_from) - 1 idx FROM subs)"""


@registered(ISLANDS_SQL + ' SELECT doc_id, idx::INT AS "index", "class", page_from::INT page_from, page_to::INT page_to, n::INT n_pages FROM indexed')
def x08_segments(spark, sf_dir):
    rows = pages.segment(_pages(spark, sf_dir), F.when(F.col("text").contains("###"), 1).otherwise(0))
    return rows.select("doc_id", "index", "class", F.col("page_ranges")[0].alias("page_from"), F.element_at("page_ranges", -1).alias("page_to"), F.size("page_ranges").alias("n_pages"))


DETECTED_SQL = f"""WITH RECURSIVE {PAGES_SQL}, words AS (SELECT doc_id, page, list_distinct(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) w FROM pages),
unlike AS (SELECT a.doc_id, a.page i, 1000 - CASE WHEN len(list_distinct(list_concat(a.w, b.w))) = 0 THEN 1000 ELSE 1000 * len(list_intersect(a.w, b.w)) // len(list_distinct(list_concat(a.w, b.w))) END - 950 gain
  FROM words a JOIN words b ON a.doc_id = b.doc_id AND a.page = b.page + 1),
sizes AS (SELECT doc_id, (max(page) + 1)::INT n FROM pages GROUP BY doc_id),
best AS (SELECT doc_id, 0 i, 0::BIGINT f, 0::BIGINT back, n FROM sizes UNION ALL
  SELECT b.doc_id, b.i + 1, CASE WHEN b.i >= 1 AND b.i + 1 <= n - 2 THEN greatest(b.f, b.back + gain) ELSE b.f END, b.f, n FROM best b JOIN unlike u ON u.doc_id = b.doc_id AND u.i = b.i + 1),
walk AS (SELECT doc_id, n - 1 i, false cut FROM sizes UNION ALL
  SELECT w.doc_id, CASE WHEN b.f > b.back THEN w.i - 2 ELSE w.i - 1 END, b.f > b.back FROM walk w JOIN best b ON b.doc_id = w.doc_id AND b.i = w.i WHERE w.i > 0),
cuts AS (SELECT doc_id, i + 2 i FROM walk WHERE cut),
starts AS (SELECT p.doc_id, page, count(c.i) k FROM pages p LEFT JOIN cuts c ON c.doc_id = p.doc_id AND c.i <= page GROUP BY p.doc_id, page)"""


@registered(DETECTED_SQL + ' SELECT doc_id, k::INT AS "index", (min(page) + 1)::INT page_from, (max(page) + 1)::INT page_to FROM starts GROUP BY doc_id, k')
def x08_detected(spark, sf_dir):
    rows = pages.detect(_pages(spark, sf_dir))
    return rows.select("doc_id", "index", F.col("page_ranges")[0].alias("page_from"), F.element_at("page_ranges", -1).alias("page_to"))


@registered(ISLANDS_SQL + ' SELECT doc_id, idx::INT AS "index", unnest(range(page_from, page_to + 1))::INT page_no FROM indexed')
def a03_sub_documents(spark, sf_dir):
    rows = pages.segment(_pages(spark, sf_dir), F.when(F.col("text").contains("###"), 1).otherwise(0))
    nested = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("index", "page_ranges"))).alias("sub_documents"))
    return nested.select("doc_id", F.inline("sub_documents")).select("doc_id", "index", F.explode("page_ranges").alias("page_no"))


@registered(f"WITH {LOG_SQL} SELECT * FROM log")
def s05_extraction_log(spark, sf_dir):
    return extraction_log(spark, sf_dir)


@registered(f"WITH {LOG_SQL} SELECT id, status FROM log WHERE status IN ('E100', 'S100')")
def p04_by_status(spark, sf_dir):
    return history.history(extraction_log(spark, sf_dir), status=["E100", "S100"]).select("id", "status")


@registered(f"WITH {LOG_SQL} SELECT id, model_id FROM log WHERE model_id = 'src3'")
def p05_by_model(spark, sf_dir):
    return history.history(extraction_log(spark, sf_dir), model_id="src3").select("id", "model_id")


@registered(f"WITH {LOG_SQL} SELECT id, user_id, status FROM log WHERE user_id = 7 AND status = 'S200'")
def p06_by_user(spark, sf_dir):
    return history.history(extraction_log(spark, sf_dir), status=["S200"], user_id=7).select("id", "user_id", "status")


@registered(f"WITH {LOG_SQL} SELECT id, user_id FROM log WHERE user_id = 5")
def p07_personal(spark, sf_dir):
    return history.visible(extraction_log(spark, sf_dir), derived.members(spark), 5).select("id", "user_id")


@registered(f"WITH {LOG_SQL} SELECT id, user_id FROM log")
def p08_all_for_admin(spark, sf_dir):
    return history.visible(extraction_log(spark, sf_dir), derived.members(spark), 1).select("id", "user_id")


@registered(f"WITH {LOG_SQL} SELECT l.id, l.status, l.model_id FROM log l WHERE status = 'E100' AND NOT EXISTS (SELECT 1 FROM log r WHERE r.original_log_id = l.id)")
def p09_retryable(spark, sf_dir):
    return history.retryable(extraction_log(spark, sf_dir)).select("id", "status", "model_id")


@registered("SELECT event_id, event_type FROM events WHERE event_type NOT IN ('P100', 'P200', 'P300', 'S100', 'S200', 'E100') OR event_type IS NULL")
def p12_invalid_status(spark, sf_dir):
    return history.invalid_status(table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("status"))).select("event_id", F.col("status").alias("event_type"))


@registered(f"WITH {LOG_SQL} SELECT id, status, status IN ('S100', 'S200', 'E100') terminal FROM log")
def p13_terminal(spark, sf_dir):
    return extraction_log(spark, sf_dir).select("id", "status", scalars.is_terminal(F.col("status")).alias("terminal"))


@registered(f"WITH {LOG_SQL} SELECT r.id, r.original_log_id, o.status original_status FROM log r LEFT JOIN log o ON r.original_log_id = o.id WHERE r.original_log_id IS NOT NULL")
def j01_original(spark, sf_dir):
    return history.with_original(extraction_log(spark, sf_dir)).select("id", "original_log_id", "original_status")


@registered(f"WITH {LOG_SQL}, models AS (SELECT DISTINCT source model_id, 'Model ' || source model_name FROM documents) SELECT id, model_id, model_name FROM log LEFT JOIN models USING (model_id)")
def j02_model(spark, sf_dir):
    models = table(spark, sf_dir, "documents").select(F.col("source").alias("model_id")).distinct().withColumn("model_name", F.concat(F.lit("Model "), F.col("model_id")))
    return extraction_log(spark, sf_dir).join(models, "model_id", "left").select("id", "model_id", "model_name")


@registered(f"WITH {LOG_SQL}, viewers AS (SELECT unnest([1, 2, 5, 149])::BIGINT viewer) SELECT viewer, NULL::VARCHAR AS role, id FROM viewers JOIN log ON viewer = user_id WHERE viewer <> 1 UNION ALL SELECT NULL, 'System Admins', id FROM log")
def j03_visible(spark, sf_dir):
    users = spark.createDataFrame([(1,), (2,), (5,), (149,)], "viewer long")
    return history.seen_by(extraction_log(spark, sf_dir), derived.members(spark), users)


@registered(f"WITH {LOG_SQL} SELECT l.id FROM log l ANTI JOIN log r ON r.original_log_id = l.id WHERE l.status = 'E100'")
def j04_never_retried(spark, sf_dir):
    return history.retryable(extraction_log(spark, sf_dir)).select("id")


EDITS = [(d, "long_word", f"fixed{d}") for d in range(0, 200, 3)]
EDITS_SQL = "edits AS (SELECT r doc_id, 'long_word' key, 'fixed' || r new FROM range(0, 200, 3) t(r))"


@registered(f"WITH {MERGED_SQL}, {EDITS_SQL} SELECT doc_id, key, coalesce(new, value) value, new IS NOT NULL edited FROM merged FULL JOIN edits USING (doc_id, key)")
def j05_edits(spark, sf_dir):
    return history.apply_edits(_merged(spark, sf_dir), spark.createDataFrame(EDITS, "doc_id long, key string, value string"))


@registered(f"WITH {LOG_SQL}, {EDITS_SQL} SELECT id, CASE WHEN status = 'S100' AND id IN (SELECT doc_id FROM edits) THEN 'S200' ELSE status END status FROM log")
def x11_confirm(spark, sf_dir):
    return history.confirm(extraction_log(spark, sf_dir), spark.createDataFrame(EDITS, "doc_id long, key string, value string")).select("id", "status")


@registered(f"WITH {LOG_SQL}, jobs AS (SELECT 'job-' || id job_id, CASE WHEN id % 4 > 0 THEN id END log_id FROM log) SELECT job_id, log_id, status log_status, log_id IS NOT NULL AND coalesce(status = 'E100', false) can_retry FROM jobs LEFT JOIN log ON log_id = log.id")
def j07_jobs(spark, sf_dir):
    logs = extraction_log(spark, sf_dir)
    jobs = logs.select(F.concat(F.lit("job-"), F.col("id").cast("string")).alias("job_id"), F.when(F.col("id") % 4 > 0, F.col("id")).alias("log_id"))
    return history.jobs_with_logs(jobs, logs).select("job_id", "log_id", "log_status", F.coalesce("can_retry", F.lit(False)).alias("can_retry"))


@registered(f"WITH {LOG_SQL}, {DIM_SQL} SELECT code, label, terminal, id FROM dim LEFT JOIN log ON code = status")
def j08_status_label(spark, sf_dir):
    return history.with_status(extraction_log(spark, sf_dir), status_dim(spark)).select("code", "label", "terminal", "id")


@registered(f"WITH RECURSIVE {LOG_SQL}, up AS (SELECT id, id root, 1 attempt FROM log WHERE original_log_id IS NULL UNION ALL SELECT l.id, up.root, up.attempt + 1 FROM log l JOIN up ON l.original_log_id = up.id) SELECT * FROM up")
def j09_chains(spark, sf_dir):
    return history.chains(written(extraction_log(spark, sf_dir).select("id", "original_log_id")), written)


@registered(f"WITH {LOG_SQL} SELECT id, row_number() OVER (PARTITION BY text ORDER BY id)::INT attempt, lag(id) OVER (PARTITION BY text ORDER BY id) previous FROM log JOIN documents ON id = doc_id")
def w06_attempts(spark, sf_dir):
    logs = written(extraction_log(spark, sf_dir).select("id", "original_log_id"))
    return history.chains(logs, written).join(logs, "id").select("id", "attempt", F.col("original_log_id").alias("previous"))


@registered(f"WITH {LOG_SQL} SELECT 'retry-' || id id, id original_log_id, 'P100' status, filename FROM log l WHERE status = 'E100' AND NOT EXISTS (SELECT 1 FROM log r WHERE r.original_log_id = l.id)")
def x12_retry(spark, sf_dir):
    return history.retry(extraction_log(spark, sf_dir))


@registered(f"WITH {LOG_SQL} SELECT status, model_id, count(*) n FROM log GROUP BY ROLLUP (status, model_id)")
def a07_counts(spark, sf_dir):
    return history.counts(extraction_log(spark, sf_dir))


@registered(f"WITH {LOG_SQL} SELECT user_id, id, row_number() OVER (PARTITION BY user_id ORDER BY id DESC)::INT rn FROM log QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY id DESC) <= 3")
def w07_newest(spark, sf_dir):
    return history.newest(extraction_log(spark, sf_dir), 3).select("user_id", "id", "rn")


@registered(f"WITH {LOG_SQL} SELECT id, status FROM log WHERE status = 'S200' AND id < 900 ORDER BY id DESC LIMIT 20")
def o02_page(spark, sf_dir):
    logs = history.history(extraction_log(spark, sf_dir), status=["S200"])
    return history.page_of(logs, [F.col("id").desc()], 20, F.col("id") < 900).select("id", "status")


@registered(f"WITH {CHANGES_SQL} SELECT job, arg_max(status, (ts, seq)) status, arg_max(status, (ts, seq)) IN ('S100', 'S200', 'E100') terminal FROM changes GROUP BY job")
def a06_latest(spark, sf_dir):
    return history.latest(derived.job_events(spark, sf_dir))


LEGAL_SQL = " OR ".join((f"prior IS NULL AND status IN ({', '.join(map(repr, b))})" if a is None else f"prior = '{a}' AND status IN ({', '.join(map(repr, b))})") for a, b in NEXT.items() if b)


@registered(f"WITH {CHANGES_SQL}, pairs AS (SELECT job, seq, status, lag(status) OVER (PARTITION BY job ORDER BY ts, seq) prior FROM changes) SELECT job, seq, status, prior, coalesce({LEGAL_SQL}, false) legal FROM pairs")
def w05_transitions(spark, sf_dir):
    return history.transitions(derived.job_events(spark, sf_dir)).select("job", "seq", "status", "prior", "legal")


@registered(f"WITH {POLLS_SQL} SELECT * FROM made")
def w01_poll_attempts(spark, sf_dir):
    return lifecycle.poll_attempts(derived.polls(spark, sf_dir)).select("job", "seq", "attempt", "prior_errors", "made")


@registered(OUTCOME_SQL)
def w02_poll_outcomes(spark, sf_dir):
    return lifecycle.poll_outcomes(derived.polls(spark, sf_dir))


def _stream(spark, sf_dir):
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")  # a pattern, as a stream's plain path must be a folder


RESTARTS_SQL = f"""WITH {POLLS_SQL.split("numbered AS")[0].rstrip().rstrip(",")}, fresh AS (SELECT *, max(CASE WHEN kind = 'upload' THEN (ts, seq) END) OVER (PARTITION BY job) up FROM polls),
counted AS (SELECT *, row_number() OVER w attempt, coalesce(sum((kind = 'error')::INT) OVER (PARTITION BY job ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) prior FROM fresh WHERE up IS NULL OR (ts, seq) > up WINDOW w AS (PARTITION BY job ORDER BY ts, seq)),
sums AS (SELECT job, count(*) attempts, sum((kind = 'error')::INT)::BIGINT errors FROM counted WHERE attempt <= 60 AND prior < 3 GROUP BY job),
every AS (SELECT job, coalesce(attempts, 0) attempts, coalesce(errors, 0) errors FROM (SELECT DISTINCT job FROM polls) LEFT JOIN sums USING (job))
SELECT *, CASE WHEN errors >= 3 THEN 'stopped' WHEN attempts >= 60 THEN 'timeout' ELSE 'open' END outcome FROM every"""


@registered(RESTARTS_SQL)
def t04_new_uploads(spark, sf_dir):
    return lifecycle.run_to_end(lifecycle.upload_stream(derived.as_polls(_stream(spark, sf_dir))), f"{folder(spark)}/{uuid.uuid4().hex}")


@registered(OUTCOME_SQL)
def t02_poll_stream(spark, sf_dir):
    return lifecycle.run_to_end(lifecycle.poll_stream(derived.as_polls(_stream(spark, sf_dir))), f"{folder(spark)}/{uuid.uuid4().hex}")


MEMBERS_SQL = f"held AS (SELECT * FROM (VALUES (1, '{ADMINS}'), (2, '{EDITORS}')) t(user_id, role))"


@registered(f"WITH {MEMBERS_SQL} SELECT user_id::BIGINT user_id, role FROM held UNION SELECT DISTINCT user_id, '{EDITORS}' FROM events WHERE user_id < 10")
def u01_add_members(spark, sf_dir):
    new = table(spark, sf_dir, "events").where("user_id < 10").select("user_id", F.lit(EDITORS).alias("role"))
    return history.add_members(derived.members(spark), new)


@registered(f"SELECT DISTINCT user_id, '{EDITORS}' role FROM events WHERE user_id < 10 AND user_id <> 2")
def u02_remove_members(spark, sf_dir):
    some = table(spark, sf_dir, "events").where("user_id < 10").select("user_id", F.lit(EDITORS).alias("role")).distinct()
    return history.remove_members(some, derived.members(spark))


@registered(r"SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g'), '[\x20\x09-\x0D]+', ' ', 'g')) text, len(regexp_extract_all(coalesce(html, ''), '(?i)<table[ >]'))::BIGINT n_tables, len(regexp_extract_all(coalesce(html, ''), '(?i)<h[1-6][ >]'))::BIGINT n_headings FROM pages")
def s03_layout(spark, sf_dir):
    return extract.html_layout(table(spark, sf_dir, "pages"))


@registered(f"""WITH {VALUES_SQL}, keys AS (SELECT source, key, bool_and(regexp_matches(value, '{extract.NUMBER}')) numeric FROM vals JOIN documents USING (doc_id) WHERE source IS NOT NULL GROUP BY ALL)
SELECT source model_name, (row_number() OVER (PARTITION BY source ORDER BY key) - 1)::INT pos, key, upper(key) label, CASE WHEN numeric THEN 'number' ELSE 'string' END type FROM keys""")
def s04_model_fields(spark, sf_dir):
    """A model for each source, drafted from the values found in its documents, saved and read again."""
    path = f"{folder(spark)}/models-{uuid.uuid4().hex}"
    sources = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("model_name"))
    files.save_models(extract.drafted(extract.extract_by_rules(_pages(spark, sf_dir)).join(sources, "doc_id")), path)
    return files.read_models(spark, path).select("model_name", "pos", "key", "label", "type")


@registered(f"SELECT user_id, CASE WHEN count(*) > 2 THEN '{ADMINS}' ELSE '{EDITORS}' END role FROM events WHERE event_type = 'signup' AND user_id IS NOT NULL GROUP BY user_id")
def s06_members(spark, sf_dir):
    """Users who signed up as members, those who did so over twice as administrators, saved and read again."""
    path = f"{folder(spark)}/members-{uuid.uuid4().hex}"
    derived.signed_up(table(spark, sf_dir, "events")).write.json(path)
    return files.read_members(spark, path)


@registered(f"WITH {LOG_SQL} SELECT id, CASE WHEN id % 10 = 0 THEN 'S200' ELSE status END status FROM log UNION ALL SELECT -1, 'P100'")
def k02_upsert(spark, sf_dir):
    old = extraction_log(spark, sf_dir).select("id", "status")
    new = old.where("id % 10 = 0").withColumn("status", F.lit("S200")).unionByName(spark.createDataFrame([(-1, "P100")], "id long, status string"))
    return files.save(old, new, f"{folder(spark)}/log-{uuid.uuid4().hex}")


@registered(f"WITH {LOG_SQL} SELECT id, CASE WHEN id % 10 = 0 THEN 'S200' ELSE status END status FROM log UNION ALL SELECT -1, 'P100'")
def k02_upsert_buckets(spark, sf_dir):
    old, path = extraction_log(spark, sf_dir).select("id", "status"), f"{folder(spark)}/log-{uuid.uuid4().hex}"
    files.save_in_buckets(old, path)
    new = old.where("id % 10 = 0").withColumn("status", F.lit("S200")).unionByName(spark.createDataFrame([(-1, "P100")], "id long, status string"))
    files.upsert_buckets(new, path, "id long, status string")
    return spark.read.schema("id long, status string").parquet(path).select("id", "status")


@registered("SELECT sha256(coalesce(text, '')) hash, strlen(coalesce(text, '')) length, count(*) n_files FROM documents WHERE text <> '' GROUP BY ALL")
def t06_ingest_once(spark, sf_dir):
    """All documents as files that arrive in two lots, the first of which the second repeats."""
    path = f"{folder(spark)}/ingest-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents").where("text <> ''")
    name = F.concat(F.pmod(F.xxhash64("doc_id"), F.lit(max(64, docs.count() // files.PART_FILES))).cast("string"), F.lit("/doc-"), F.col("doc_id").cast("string"), F.lit(".pdf"))  # many folders are listed by many tasks
    rows = written(docs.select(name.alias("name"), F.coalesce("text", F.lit("")).cast("binary").alias("content")))

    def arrived():
        files.list_new(spark, f"{path}/in", f"{path}/listed")
        return files.ingest_once(files.listed_stream(spark, f"{path}/in", f"{path}/listed"), path)

    files.write_files(rows.where("crc32(content) % 2 = 0"), f"{path}/in")
    arrived()
    files.write_files(rows, f"{path}/in")
    files.write_files(rows.withColumn("name", F.regexp_replace("name", "/", "/again-")), f"{path}/in")
    found = arrived()
    counts = rows.groupBy(F.sha2("content", 256).alias("hash")).agg(F.count(F.lit(1)).alias("n_files"))
    return found.select("hash", "length").join(counts, "hash")


@registered(f"WITH {LOG_SQL} SELECT id::VARCHAR id, user_id::VARCHAR user_id, model_id, filename, status, original_log_id::VARCHAR original_log_id FROM log")
def k03_workbooks(spark, sf_dir):
    path = f"{folder(spark)}/books-{uuid.uuid4().hex}"
    workbook.export_workbooks(extraction_log(spark, sf_dir), path)
    return workbook.read_workbooks(spark, path)


@registered("SELECT doc_id::VARCHAR doc_id, lang, text FROM documents")
def k03_workbook_texts(spark, sf_dir):
    """Whole texts as cells, those that don't fit on second sheets."""
    path = f"{folder(spark)}/books-{uuid.uuid4().hex}"
    workbook.export_workbooks(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), path)
    return workbook.read_workbooks(spark, path)


@registered(f"WITH {LOG_SQL} SELECT id, status, model_id FROM log ORDER BY id DESC")
def o01_history_order(spark, sf_dir):
    return extraction_log(spark, sf_dir).select("id", "status", "model_id").orderBy(F.col("id").desc())


STATE_SQL = LEGAL_SQL.replace("prior", "s.status").replace("AND status", "AND n.status")


@registered(f"""WITH RECURSIVE {CHANGES_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY job ORDER BY ts, seq) k FROM changes), jobs AS (SELECT job, max(k) most FROM n GROUP BY job),
states AS (SELECT job, 0::BIGINT k, NULL::VARCHAR status, 0::BIGINT refused FROM jobs UNION ALL
  SELECT s.job, n.k, CASE WHEN coalesce({STATE_SQL}, false) THEN n.status ELSE s.status END, refused + (NOT coalesce({STATE_SQL}, false))::BIGINT FROM states s JOIN n ON s.job = n.job AND n.k = s.k + 1)
SELECT job, status, refused FROM states JOIN jobs USING (job) WHERE k = most""")
def t01_status_stream(spark, sf_dir):
    events = derived.as_changes(_stream(spark, sf_dir))
    return lifecycle.run_to_end(lifecycle.status_stream(events), f"{folder(spark)}/{uuid.uuid4().hex}")


@registered(r"SELECT page_id, name, regexp_matches(name, '(?i)\.(pdf|png|jpe?g|tiff?|bmp|webp)$') supported FROM (SELECT page_id, 'page-' || page_id || ['.pdf', '.txt', '.PNG', '.jpg.html'][page_id % 4 + 1] AS name FROM pages)")
def p11_supported(spark, sf_dir):
    endings = F.array(*map(F.lit, (".pdf", ".txt", ".PNG", ".jpg.html")))
    names = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("page-"), F.col("page_id").cast("string"), F.element_at(endings, (F.col("page_id") % 4 + 1).cast("int"))).alias("name"))
    return names.withColumn("supported", scalars.is_supported(F.col("name")))


@registered(f"WITH {LOG_SQL} SELECT id, user_id, model_id, filename, status FROM log WHERE id = 100")
def k04_preview(spark, sf_dir):
    row = files.preview(extraction_log(spark, sf_dir).select("id", "user_id", "model_id", "filename", "status"), 100)
    return spark.createDataFrame([tuple(row.values())] if row else [], "id long, user_id long, model_id string, filename string, status string")


_COMPILED = [(k, re.compile(extract.HINTS.get(k, "")).search, re.compile(p).search) for k, p in extract.RULES.items()]


def _by_pattern(texts):
    """A provider that gives the first match of each rule, and fails on texts with '###'."""
    return [([(k, m.group()) for k, hint, find in _COMPILED if hint(t) and (m := find(t))], "unreadable" if "###" in t else None) for t in texts]


JOB_SQL = GREEDY_SQL + """, chunked AS (SELECT p.doc_id, chunk, string_agg(text, chr(10) ORDER BY p.page) text FROM packed p JOIN sized s ON p.doc_id = s.doc_id AND p.page = s.page GROUP BY p.doc_id, chunk),
told AS (""" + " UNION ALL ".join(f"SELECT doc_id, chunk, '{k}' key, nullif(regexp_extract(text, '{p}', 0), '') value FROM chunked" for k, p in extract.RULES.items()) + """),
places AS (SELECT t.doc_id, key, value, p.page, instr(s.text, value) AS "offset", row_number() OVER (PARTITION BY t.doc_id, t.chunk, key ORDER BY p.page) n
  FROM told t JOIN packed p ON t.doc_id = p.doc_id AND t.chunk = p.chunk JOIN sized s ON s.doc_id = p.doc_id AND s.page = p.page WHERE value IS NOT NULL AND contains(s.text, value)),
kinds AS (SELECT doc_id, page, CASE WHEN contains(text, '###') THEN 1 ELSE 0 END k FROM sized),
marked AS (SELECT *, page - row_number() OVER (PARTITION BY doc_id, k ORDER BY page) island FROM kinds),
subs AS (SELECT doc_id, page, dense_rank() OVER (PARTITION BY doc_id ORDER BY least_page) - 1 idx FROM (SELECT *, min(page) OVER (PARTITION BY doc_id, k, island) least_page FROM marked)),
firsts AS (SELECT p.doc_id, idx, key, arg_min(struct_pack(value, page := p.page, o := "offset"), (p.page, "offset", value)) m FROM places p JOIN subs s ON p.doc_id = s.doc_id AND p.page = s.page WHERE n = 1 GROUP BY p.doc_id, idx, key),
states AS (SELECT doc_id, CASE WHEN bool_or(contains(text, '###')) THEN 'E100' ELSE 'S100' END status FROM chunked GROUP BY doc_id)"""


def _job(spark, sf_dir):
    own = _pages(spark, sf_dir)
    return jobs.run(own, MODEL, _by_pattern, F.when(F.col("text").contains("###"), 1).otherwise(0), "2024-01-31T12:00:00Z")


@registered(JOB_SQL + """ SELECT doc_id, status, idx::INT AS "index", key, m.value AS "value", (m.page + 1)::INT page, m.o::INT AS "offset" FROM firsts JOIN states USING (doc_id) WHERE key IN ('email', 'ipv4', 'long_word')""")
def x14_extraction_job(spark, sf_dir):
    return jobs.fields_of(_job(spark, sf_dir), "status").select("doc_id", "status", "index", "key", "value", "page", "offset")


@registered(JOB_SQL + """ SELECT doc_id, idx::INT AS "index", key, m.value AS "value", (m.page + 1)::INT page FROM firsts WHERE key NOT IN ('email', 'ipv4', 'long_word')""")
def x15_open_data(spark, sf_dir):
    return jobs.others_of(_job(spark, sf_dir))


@registered(JOB_SQL + " SELECT doc_id, status, CASE status WHEN 'E100' THEN 'unreadable' END error, json_extract_string(d, '$.digits') digits, TIMESTAMP '2024-01-31 12:00:00' created FROM states LEFT JOIN (SELECT doc_id, json_object('digits', arg_min(value, page)) d FROM places WHERE n = 1 AND key = 'digits' GROUP BY doc_id) USING (doc_id)")
def x16_job_logs(spark, sf_dir):
    logs = _job(spark, sf_dir)
    return logs.select("doc_id", "status", "error", F.try_variant_get("extracted_data", "$.digits", "string").alias("digits"), scalars.to_time(F.col("created_at")).cast("timestamp_ntz").alias("created"))


USER_EDITS_SQL = JOB_SQL + """, edits AS (SELECT user_id * 7 + event_id % 7 doc_id, (event_id % 2)::INT idx, CASE event_id % 5 WHEN 0 THEN 'email' WHEN 1 THEN 'long_word' WHEN 2 THEN 'digits' WHEN 3 THEN 'note' END key,
  CASE WHEN event_type <> 'error' THEN 'fixed-' || (event_id % 50) END val, ts edited_at, event_id seq FROM events),
judged AS (SELECT e.*, CASE WHEN key IS NULL THEN 'no field' WHEN status IS NULL THEN 'no log' WHEN status <> 'S100' THEN 'not finished' WHEN s.doc_id IS NULL THEN 'no sub-document' END reason
  FROM edits e LEFT JOIN states USING (doc_id) LEFT JOIN (SELECT DISTINCT doc_id, idx FROM subs) s ON e.doc_id = s.doc_id AND e.idx = s.idx),
lasts AS (SELECT doc_id, idx, key, arg_max(struct_pack(v := val), struct_pack(edited_at, seq)) l FROM judged WHERE reason IS NULL GROUP BY doc_id, idx, key),
fields AS (SELECT coalesce(f.doc_id, l.doc_id) doc_id, coalesce(f.idx, l.idx) idx, coalesce(f.key, l.key) key, CASE WHEN l.doc_id IS NULL THEN m.value ELSE l.l.v END val, (m.page + 1)::INT page, m.o::INT o
  FROM firsts f FULL JOIN lasts l ON f.doc_id = l.doc_id AND f.idx = l.idx AND f.key = l.key)"""


def _user_edits(spark, sf_dir):
    """A stand-in for what users edit: events as edits of fields, some of which aren't there."""
    n = F.col("event_id")
    key = F.when(n % 5 == 0, "email").when(n % 5 == 1, "long_word").when(n % 5 == 2, "digits").when(n % 5 == 3, "note")
    value = F.when(F.col("event_type") != "error", F.concat(F.lit("fixed-"), (n % 50).cast("string")))
    return table(spark, sf_dir, "events").select(
        (F.col("user_id") * 7 + n % 7).alias("doc_id"), (n % 2).cast("int").alias("index"), key.alias("key"), value.alias("value"), F.col("ts").alias("edited_at"), n.alias("seq")
    )


@registered(USER_EDITS_SQL + """ SELECT doc_id, CASE WHEN status = 'S100' AND doc_id IN (SELECT doc_id FROM lasts) THEN 'S200' ELSE status END status, idx::INT AS "index", key, val AS "value", page,
  CASE WHEN key IN ('email', 'ipv4', 'long_word') THEN o END "offset" FROM fields JOIN states USING (doc_id)""")
def j05_edited_fields(spark, sf_dir):
    """Every value in preview_data after users' edits; open data has no offsets."""
    logs = written(edits.apply(_job(spark, sf_dir), _user_edits(spark, sf_dir), MODEL, "2024-02-01T12:00:00Z"))
    values = jobs.fields_of(logs, "status").unionByName(jobs.others_of(logs, "status"), allowMissingColumns=True)
    return values.select("doc_id", "status", "index", "key", "value", "page", "offset")


@registered(USER_EDITS_SQL + """ SELECT doc_id, key, arg_min(val, idx) AS "value", doc_id IN (SELECT doc_id FROM lasts) edited FROM fields WHERE val IS NOT NULL GROUP BY doc_id, key""")
def j05_edited_values(spark, sf_dir):
    """Every value in extracted_data after users' edits."""
    logs = edits.apply(_job(spark, sf_dir), _user_edits(spark, sf_dir), MODEL, "2024-02-01T12:00:00Z")
    return logs.select("doc_id", F.explode(F.col("extracted_data").cast("map<string,string>")).alias("key", "value"), (F.col("updated_at") > F.col("created_at")).alias("edited"))


@registered(USER_EDITS_SQL + """ SELECT doc_id, idx AS "index", key, seq, reason FROM judged WHERE reason IS NOT NULL""")
def j05_rejected_edits(spark, sf_dir):
    return edits.rejected(_job(spark, sf_dir), _user_edits(spark, sf_dir)).select("doc_id", "index", "key", "seq", "reason")


@registered(USER_EDITS_SQL + """ SELECT j.doc_id, j.idx AS "index", j.key, seq, val AS "value", CASE WHEN row_number() OVER w = 1 THEN m.value ELSE lag(val) OVER w END "before"
FROM judged j LEFT JOIN firsts f ON j.doc_id = f.doc_id AND j.idx = f.idx AND j.key = f.key WHERE reason IS NULL WINDOW w AS (PARTITION BY j.doc_id, j.idx, j.key ORDER BY edited_at, seq)""")
def j05_edit_trail(spark, sf_dir):
    return edits.trail(_job(spark, sf_dir), _user_edits(spark, sf_dir)).select("doc_id", "index", "key", "seq", "value", "before")


@registered("SELECT o_orderkey id, o_orderdate::TIMESTAMP created, date_trunc('month', o_orderdate)::TIMESTAMP AS \"month\" FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01'")
def o03_by_time(spark, sf_dir):
    logs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"))
    rows = history.by_time(logs, "1995-01-01T00:00:00Z")
    return rows.select("id", F.col("created").cast("timestamp_ntz").alias("created"), F.date_trunc("month", "created").cast("timestamp_ntz").alias("month"))


@registered(f"WITH {MEMBERS_SQL} SELECT DISTINCT e.user_id, e.user_id IN (SELECT user_id FROM held) may_edit FROM events e WHERE e.user_id < 5")
def r02_model_editors(spark, sf_dir):
    users = table(spark, sf_dir, "events").where("user_id < 5").select("user_id").distinct()
    return users.join(history.editors(derived.members(spark)).withColumn("may_edit", F.lit(True)), "user_id", "left").select("user_id", F.coalesce("may_edit", F.lit(False)).alias("may_edit"))


@registered("""WITH polls AS (SELECT user_id job, ts, event_id seq, event_type = 'error' bad, date_diff('second', date_trunc('second', min(ts) OVER (PARTITION BY user_id)), date_trunc('second', ts)) age FROM events),
numbered AS (SELECT *, row_number() OVER w attempt, coalesce(sum(bad::INT) OVER (PARTITION BY job ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) prior FROM polls WHERE age < 259200 WINDOW w AS (PARTITION BY job ORDER BY ts, seq)),
sums AS (SELECT job, count(*) attempts, sum(bad::INT)::BIGINT errors FROM numbered WHERE attempt <= 60 AND prior < 3 GROUP BY job)
SELECT *, CASE WHEN errors >= 3 THEN 'stopped' WHEN attempts >= 60 OR job IN (SELECT job FROM polls WHERE age >= 259200) THEN 'timeout' ELSE 'open' END outcome FROM sums""")
def t03_timed_polls(spark, sf_dir):
    return lifecycle.timed_polls(derived.polls(spark, sf_dir), 3 * 86_400)


@registered("""WITH polls AS (SELECT user_id job, epoch_ms(ts) ms, event_id seq, event_type = 'error' bad, min(epoch_ms(ts)) OVER (PARTITION BY user_id) start FROM events),
numbered AS (SELECT *, row_number() OVER w attempt, coalesce(sum(bad::INT) OVER (PARTITION BY job ORDER BY ms, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) prior
  FROM polls WHERE ms < start + 259200000 WINDOW w AS (PARTITION BY job ORDER BY ms, seq)),
sums AS (SELECT job, start, count(*) attempts, sum(bad::INT)::BIGINT errors FROM numbered WHERE attempt <= 60 AND prior < 3 GROUP BY job, start)
SELECT job, attempts, errors, CASE WHEN errors >= 3 THEN 'stopped' WHEN attempts >= 60 OR start + 259200000 <= (SELECT max(ms) - 3600000 FROM polls) THEN 'timeout' ELSE 'open' END outcome FROM sums""")
def t02_timed_stream(spark, sf_dir):
    stream = lifecycle.timed_poll_stream(derived.as_polls(_stream(spark, sf_dir)), 3 * 86_400)
    return lifecycle.run_to_end(stream, f"{folder(spark)}/{uuid.uuid4().hex}")


@registered("SELECT 'retry-' || event_id id, event_id original_log_id, 'P100' status, 'event-' || event_id filename FROM events WHERE event_type = 'error' AND event_id % 3 <> 0")
def t05_retry_stream(spark, sf_dir):
    failed = _stream(spark, sf_dir).select(F.col("event_id").alias("id"), F.when(F.col("event_type") == "error", "E100").otherwise("S100").alias("status"), F.concat(F.lit("event-"), F.col("event_id").cast("string")).alias("filename"))
    tried = table(spark, sf_dir, "events").where("event_id % 3 = 0").select(F.col("event_id").alias("original_log_id"))
    return lifecycle.append_to_end(lifecycle.retry_stream(failed, tried), f"{folder(spark)}/{uuid.uuid4().hex}")


@registered(r"""WITH t AS (SELECT page_id, regexp_extract_all(coalesce(html, ''), '(?is)<table[ >].*?</table>') ts FROM pages), u AS (SELECT page_id, unnest(range(len(ts))) k, ts FROM t),
r AS (SELECT page_id, k, regexp_extract_all(ts[k + 1], '(?is)<tr[ >].*?</tr>') rs FROM u), v AS (SELECT page_id, k, unnest(range(len(rs))) n, rs FROM r)
SELECT page_id, k::INT AS "table", n::INT AS "row", array_to_string(list_transform(regexp_extract_all(rs[n + 1], '(?is)<t[dh][ >].*?</t[dh]>'), lambda c: trim(regexp_replace(regexp_replace(c, '(?s)<[^>]+>', ' ', 'g'), '[\x20\x09-\x0D]+', ' ', 'g'))), '|') cells FROM v""")
def s03_tables(spark, sf_dir):
    rows = extract.html_tables(table(spark, sf_dir, "pages"))
    return rows.withColumn("cells", F.array_join("cells", "|"))


@registered("""SELECT o_orderkey page_id, 0 "table", NULL::INT parent, 0 "row", 'No. ' || o_orderkey || '|' || o_orderpriority || '|' || o_orderpriority cells FROM orders UNION ALL
SELECT o_orderkey, 0, NULL, 1, 'No. ' || o_orderkey || '|' || o_orderstatus || '|' FROM orders UNION ALL
SELECT o_orderkey, 1, 0, 0, o_custkey || '|' || o_custkey FROM orders UNION ALL SELECT o_orderkey, 1, 0, 1, 'a & b|' || o_orderstatus FROM orders""")
def s03_grid(spark, sf_dir):
    """Orders as web pages, each a table with spans and a table in it."""
    html = F.format_string(
        "<p>1</p><table class='t'><tr><th rowspan=2>No.<br>%d</th><td colspan=\"2\">%s<tr><td>%s</td><td><table><tr><td colspan=2>%d</td></tr><tr><td>a &amp; b<td><b>%s</b></table></td></tr></table>",
        "o_orderkey", "o_orderpriority", "o_orderstatus", "o_custkey", "o_orderstatus",
    )
    rows = grids.html_grids(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page_id"), html.alias("html")))
    return rows.withColumn("cells", F.array_join("cells", "|"))
