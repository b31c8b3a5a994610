"""Personal data by weak-supervision aggregation.

Candidate spans come from strict and loose patterns. Regex, gazetteer and context labelers vote
(1 personal, 0 not, null abstains) on each; expectation-maximisation over the counts of vote
patterns estimates every labeler's reliability; a logistic span classifier is then fitted to the
posteriors and scores all candidates. Spans of the base kinds are always reported, a loose
candidate when its score is at least 0.5 and it overlaps no base span. All candidates of the corpus
are counted; the driver sees only the counts of distinct vote patterns, of which there are at most
(kinds x 2^2 x 3^4). Only built-in functions run.

Defined results: a null text counts as empty and has no spans; repeated rows are scanned one by one;
spans of one kind are ordered by start; an empty table gives an empty result; other columns of the
input are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillrun.llm.common import checkpointed, sha256_hex, table
from quillrun.llm.spans import Kind, joined, spans_of, sql_spans

#: The base patterns. Look-behinds keep long runs linear: a match can only begin where a run begins
#: or where the match before has ended, which is where the plain pattern begins too. Repeated groups
#: are possessive: others recurse once for each repeat, and long texts exhaust a task's stack.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+"
CARD = r"[0-9]+(?:[\x20-][0-9]+)*+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: The same as the contract words them, for SQL.
EMAIL_SQL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP_SQL = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD_SQL = r"[0-9]([\x20-]?[0-9])+"

BASE = ["email", "ip", "card", "phone"]
LOOSE = ["email_masked", "phone_local", "ssn", "iban", "birth_date", "person"]
#: Gazetteers and context words of the labelers.
MAIL_ENDS = ["com", "org", "net", "edu", "gov", "io", "de", "fr", "es", "uk", "eu", "info"]
TITLES = ["Mr", "Mrs", "Ms", "Dr", "Prof", "Herr", "Frau", "Mme", "Sr", "Sra"]
IBAN_LANDS = ["DE", "FR", "ES", "GB", "IT", "NL", "BE", "AT", "CH", "PT", "IE", "LU", "PL"]
FOR = r"(?i)(?:call|phone|tel|mobile|fax|mail|contact|reach|write|ssn|social|security|born|birth|dob|name|address|iban|account|card|patient|client|user)\b[^\n]{0,30}$"
AGAINST = r"(?i)(?:version|release|build|isbn|issn|order|invoice|serial|model|part|page|section|figure|sku|ref|id|no)\.?\x20*[:#]?\x20*$"
VOTERS = ["shape", "list", "context", "edge"]
#: What the span classifier sees besides the votes.
FEATURES = ["labelled", "alone"]


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check: from the right, every second digit counts
    double, less 9 where that exceeds 9."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((2 * c.cast("int")) % 10 + F.floor(c.cast("int") / 5).cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def remainder_97(account: Column) -> Column:
    """Of an account number, its first four characters put last and letters read as numbers from 10: the
    remainder by 97, 1 where the check digits are right."""
    moved = F.concat(F.substring(account, 5, 40), F.substring(account, 1, 4))
    number = lambda c: F.when(c.rlike("[0-9]"), c.try_cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.filter(F.split(moved, ""), lambda c: c != ""), F.lit(0), lambda r, c: F.when(c.rlike("[0-9]"), (r * 10 + number(c)) % 97).otherwise((r * 100 + number(c)) % 97))


def _is_card(v: Column) -> Column:
    return F.length(_digits(v)).between(16, 19) & luhn(F.when(F.length(_digits(v)).between(16, 19), _digits(v)).otherwise("0"))


def _is_ip(v: Column) -> Column:
    part = lambda p: F.regexp_replace(p, "^0+", "")
    return F.forall(F.split(v, r"\."), lambda p: (F.length(part(p)) < 3) | ((F.length(part(p)) == 3) & (part(p) <= "255")))


KINDS = [
    Kind("email", EMAIL, lambda t: t.contains("@")),
    Kind("ip", IP, lambda t: t.rlike(r"[0-9]\.[0-9]"), _is_ip),
    Kind("card", CARD, lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){15}"), _is_card),
    Kind("phone", PHONE, lambda t: t.contains("+"), lambda v: F.length(_digits(v)).between(8, 15)),
    Kind("email_masked", r"(?i)\b[a-z0-9._%+-]{1,64}\x20?[\[({]\x20?at\x20?[\])}]\x20?[a-z0-9-]{1,63}(?:\x20?(?:\.|[\[({]\x20?dot\x20?[\])}])\x20?[a-z0-9-]{1,63})++", lambda t: t.rlike(r"(?i)[\[({]\x20?at\x20?[\])}]")),
    Kind("phone_local", r"(?<![0-9+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])", lambda t: t.rlike(r"[0-9]{3}[\x20.-][0-9]{4}")),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", lambda t: t.rlike(r"[0-9]-[0-9]{2}-[0-9]")),
    Kind("iban", r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?\b", lambda t: t.rlike(r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}")),
    Kind("birth_date", r"(?<![0-9-])(?:19|20)[0-9]{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])(?![0-9-])", lambda t: t.rlike(r"[0-9]{4}-[0-9]{2}-")),
    Kind("person", r"\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sr|Sra)\.?\x20[A-Z][a-z]+(?:\x20[A-Z][a-z]+)?", lambda t: t.rlike(r"\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sr|Sra)\b")),
]


def candidates(docs: DataFrame) -> DataFrame:
    """The spans of every kind with their votes, and a row with kind '' for each row of docs."""
    rows = spans_of(docs, F.coalesce(F.col("text"), F.lit("")), KINDS)
    value, kind = F.col("value"), F.col("kind")
    ending = F.lower(F.element_at(F.split(value, r"\."), -1))
    shape = (
        F.when(kind == "email", value.rlike(r"^[A-Za-z0-9][A-Za-z0-9._%+-]*@")).when(kind.isin("ip"), ~value.rlike(r"^0|\.0[0-9]"))
        .when(kind.isin("card", "phone", "email_masked"), True)
        .when(kind == "ssn", ~value.rlike(r"^(?:000|666|9)|-00-|-0000$")).when(kind == "iban", F.length(F.regexp_replace(value, " ", "")).between(15, 34) & remainder_97(F.regexp_replace(value, " ", "")).eqNullSafe(1))
        .when(kind == "phone_local", value.startswith("("))
    )
    listed = (
        F.when(kind.isin("email", "email_masked"), ending.isin(MAIL_ENDS)).when(kind == "iban", F.substring(value, 1, 2).isin(IBAN_LANDS))
        .when(kind == "person", F.regexp_extract(value, "^[A-Za-z]+", 0).isin(TITLES)).when(kind == "card", F.substring(value, 1, 1).isin("3", "4", "5", "6"))
        .when(kind == "ip", ~value.rlike(r"^(?:0|10|127|255)\.|^192\.168\.")).when(kind.isin("phone_local"), ~_digits(value).rlike("^[01]"))
    )
    context = F.when(F.col("before").rlike(AGAINST), False).when(F.col("before").rlike(FOR), True).when(kind == "birth_date", False)  # a date alone is no birth date
    edge = F.when(F.col("before").rlike(r"[A-Za-z0-9]$") | F.col("after").rlike(r"^[A-Za-z0-9]"), False)
    # what the classifier sees besides the votes
    labelled, alone = F.col("before").rlike(r"[:=]\x20*$"), F.col("before").rlike(r"(?:^|\n)\x20*$") & (F.col("after").rlike(r"^\x20*(?:\n|$)"))
    base = kind.isin(BASE)
    whole = Window.partitionBy("rid").orderBy("start", "end", "kind")
    back = Window.partitionBy("rid").orderBy(F.desc("start"), F.desc("end"), F.desc("kind"))  # what follows precedes here
    over = F.coalesce(F.max(F.when(base, F.col("end"))).over(whole.rowsBetween(Window.unboundedPreceding, -1)) > F.col("start"), F.lit(False)) | F.coalesce(
        F.min(F.when(base, F.col("start"))).over(back.rowsBetween(Window.unboundedPreceding, -1)) < F.col("end"), F.lit(False)
    )
    return rows.withColumn("over", over & kind.isin(LOOSE)).select("rid", "doc_id", "text_key", "kind", "start", "end", "over", *(f.cast("int").alias(n) for n, f in zip(FEATURES, (labelled, alone))), *(v.cast("int").alias(n) for n, v in zip(VOTERS, (shape, listed, context, edge))))


def fit(counts: list[dict], rounds: int = 30) -> dict:
    """Weights of the span classifier from counts of vote patterns ({kind, voters..., n}).

    First a two-class model with independent voters given the class, fitted by EM with prior counts
    that hold voters better than chance; then logistic regression on its posteriors.
    """
    prior, right = {k: 0.8 if k in BASE else 0.5 for k in BASE + LOOSE}, {v: 0.8 for v in VOTERS}
    posterior = [0.5] * len(counts)
    for _ in range(rounds):
        for i, c in enumerate(counts):
            odds = math.log(prior[c["kind"]] / (1 - prior[c["kind"]]))
            odds += sum((1 if c[v] else -1) * math.log(right[v] / (1 - right[v])) for v in VOTERS if c[v] is not None)
            posterior[i] = 1 / (1 + math.exp(-odds))
        for v in VOTERS:
            seen = [(p if c[v] else 1 - p, c["n"]) for p, c in zip(posterior, counts) if c[v] is not None]
            right[v] = min(0.98, max(0.55, (80 + sum(p * n for p, n in seen)) / (100 + sum(n for _, n in seen))))
        for k in prior:
            seen = [(p, c["n"]) for p, c in zip(posterior, counts) if c["kind"] == k]
            prior[k] = min(0.99, max(0.01, (5 * (0.8 if k in BASE else 0.5) + sum(p * n for p, n in seen)) / (5 + sum(n for _, n in seen))))
    weights: dict = {}
    for _ in range(300):
        slope, curve = {}, {}
        for c, p in zip(counts, posterior):
            own = [("bias", 1.0), (c["kind"], 1.0), *((v, 1.0 if c[v] else -1.0) for v in VOTERS if c[v] is not None), *((f, 1.0) for f in FEATURES if c.get(f))]
            off = p - 1 / (1 + math.exp(-sum(weights.get(f, 0.0) * x for f, x in own)))
            for f, x in own:
                slope[f] = slope.get(f, 0.0) + math.log1p(c["n"]) * off * x
                curve[f] = curve.get(f, 0.0) + math.log1p(c["n"])
        for f in slope:
            weights[f] = weights.get(f, 0.0) + (slope[f] - 0.01 * weights.get(f, 0.0)) / (curve[f] + 1)
    return {f: round(w, 9) for f, w in weights.items()} | {f"reliability of {v}": r for v, r in right.items()}


def _score(weights: dict) -> Column:
    total = F.lit(weights.get("bias", 0.0))
    for k in BASE + LOOSE:
        total = total + F.when(F.col("kind") == k, weights.get(k, 0.0)).otherwise(0.0)
    for v in VOTERS:
        total = total + F.when(F.col(v) == 1, weights.get(v, 0.0)).when(F.col(v) == 0, -weights.get(v, 0.0)).otherwise(0.0)
    for f in FEATURES:
        total = total + F.when(F.col(f) == 1, weights.get(f, 0.0)).otherwise(0.0)
    return 1 / (1 + F.exp(-total))


def personal_spans(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, text_key, base and spans, arrays of struct<rank, start, kind,
    end, score> in order."""
    rows = checkpointed(candidates(docs))
    # loose candidates within base spans tell nothing: they are tails of those
    counts = [r.asDict() for r in rows.where("kind <> '' and not over").groupBy("kind", *FEATURES, *VOTERS).agg(F.count(F.lit(1)).alias("n")).orderBy("kind", *FEATURES, *VOTERS).collect()]
    base = F.col("kind").isin(BASE)
    rows = rows.withColumn("score", F.round(_score(fit(counts)), 6))
    rank = F.array_position(F.array(*map(F.lit, BASE + LOOSE)), F.col("kind"))
    span = F.struct(rank.alias("rank"), "start", "kind", "end", "score")
    loose = F.col("kind").isin(LOOSE) & (F.col("score") >= 0.5) & ~F.col("over")
    return rows.groupBy("rid").agg(
        F.first("doc_id").alias("doc_id"), F.first("text_key").alias("text_key"),
        F.array_sort(F.collect_list(F.when(base, span))).alias("base"), F.array_sort(F.collect_list(F.when(base | loose, span))).alias("spans"),
    )


def op10_personal_data(spark, sf_dir: str) -> DataFrame:
    found = personal_spans(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(count, BASE), sha256_hex(joined(F.col("base"))).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


#: The base columns alone, which SQL can express; tests compare them.
BASE_SQL = f"""
WITH docs AS (SELECT row_number() OVER () rid, doc_id, coalesce(text, '') t FROM documents),
all_parts AS (
{sql_spans("email", EMAIL_SQL, "t")} UNION ALL
{sql_spans("ip", IP_SQL, "t")} WHERE len(list_filter(string_split(value, '.'), lambda p: length(ltrim(p, '0')) > 3 OR length(ltrim(p, '0')) = 3 AND ltrim(p, '0') > '255')) = 0 UNION ALL
{sql_spans("card", CARD_SQL, "t")} UNION ALL
{sql_spans("phone", PHONE, "t")} WHERE length(regexp_replace(value, '[^0-9]', '', 'g')) BETWEEN 8 AND 15),
numbered AS (SELECT *, reverse(regexp_replace(value, '[^0-9]', '', 'g')) d FROM all_parts),
parts AS (SELECT * FROM numbered WHERE kind <> 'card' OR length(d) BETWEEN 16 AND 19 AND list_sum(list_transform(range(1, length(d) + 1), lambda i: CASE WHEN i % 2 = 1 THEN d[i]::INT ELSE (2 * d[i]::INT) % 10 + d[i]::INT // 5 END)) % 10 = 0),
by_doc AS (SELECT rid, count(*) FILTER (kind = 'email') n_email, count(*) FILTER (kind = 'ip') n_ip, count(*) FILTER (kind = 'card') n_card, count(*) FILTER (kind = 'phone') n_phone,
  string_agg(concat_ws(':', kind, s, e), ',' ORDER BY list_position(['email', 'ip', 'card', 'phone'], kind), s) told FROM parts GROUP BY rid)
SELECT doc_id, coalesce(n_email, 0)::BIGINT n_email, coalesce(n_ip, 0)::BIGINT n_ip, coalesce(n_card, 0)::BIGINT n_card, coalesce(n_phone, 0)::BIGINT n_phone, sha256(coalesce(told, '')) base_sha256
FROM docs LEFT JOIN by_doc USING (rid)
"""
