"""Mixing sources to target weights by iterative proportional fitting.

Token counts are summed by cell (source, language, topic). Raking scales the cells in turn so that
their sums meet the target share of each source, then language, then topic, and repeats until no cell
changes, ROUNDS times at most. A document carries its cell's weight, 1 on average over the tokens, and
is sampled with the probability rate x weight, 1 at most. Its residual, weight / probability, makes up
for what that cap takes: the tokens of the sample, times their residuals, are expected to meet the
targets. Without a rate the largest weight gets probability one, no cap holds and all residuals are
equal. Draws are hashes of seed and id, alike on every run and every partitioning.

A topic is what the caller gives as such. Without one it is a group of words by form, the commonest
among the TOPICS groups of a text's long words: it stands in for a topic, and tells nothing of meaning.
Only built-in functions run; cells and factors stay tables, of which the driver sees sums alone.

Defined results: null sources, languages and texts form categories of their own ('' for the name);
so do texts without long words; documents without tokens count as none but are sampled like their cell;
repeated rows and ties are drawn together, as the draw depends on the id alone; an empty table gives an
empty result; other columns are carried along, but for those named like added ones. A target is a share
for each value, or an exponent: then shares follow the token counts to that power (0: even, 1: as they
are, also without a target). Values that a target doesn't name keep their own share of the tokens, and
those it names share the rest; names that are absent are let fall. Targets that contradict each other (a
topic found in one language alone) can't all be met; the last raked, topics, then is.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillrun.llm.common import checkpointed, table

#: Rounds of raking at most, those between two looks at the change, and the relative change of a cell below
#: which raking ends.
ROUNDS, LOOK, SETTLED = 24, 4, 1e-12
#: Cells up to which one partition holds them while they are raked.
FEW_CELLS = 100_000
#: The part of all tokens that a sample keeps where no cap holds.
RATE = 0.5
MARGINALS = ("source", "lang", "topic")
TOPICS = 6
#: Length from which a word tells of a topic, in code points.
LONG_WORD = 8
SEED = "mix"


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", -1), "")


def _letters(words: Column, topics: int) -> Column:
    """The groups of long words, by their lengths and their first and last characters."""
    return F.transform(F.filter(words, lambda w: F.length(w) >= LONG_WORD), lambda w: F.pmod(F.ascii(w) + F.ascii(F.substring(w, -1, 1)) + F.length(w), F.lit(topics)))


def topic_of(letters: Column, topics: int = TOPICS) -> Column:
    """The commonest group, of equals the first; -1 without any."""

    def counted(k: int) -> Column:
        return F.struct(F.size(F.filter(letters, lambda g: g == k)).alias("n"), F.lit(-k).alias("k"))

    none = F.struct(F.lit(0).alias("n"), F.lit(1).alias("k"))
    most = F.array_max(F.array(none, *map(counted, range(topics))))["k"]
    # never null, and said so: joins on it would else test it for null first, word by word, group by group
    return F.coalesce((-most).cast("string"), F.lit("-1"))


def described(docs: DataFrame, topic: Column | None = None) -> DataFrame:
    """docs with their categories and token counts: _source, _lang, _topic, _tokens."""
    docs = docs.drop("_source", "_lang", "_topic", "_tokens", "_w", "_g")
    rows = docs.withColumn("_w", _words(F.col("text"))).withColumn("_g", _letters(F.col("_w"), TOPICS))
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in docs.columns else F.lit("")
    own = topic_of(F.col("_g")) if topic is None else F.coalesce(topic.cast("string"), F.lit(""))
    return rows.select(*docs.columns, name("source").alias("_source"), name("lang").alias("_lang"), own.alias("_topic"), F.size("_w").cast("long").alias("_tokens"))


Target = dict[str, float] | float


def shares(positive: DataFrame, m: str, wanted: Target) -> DataFrame:
    """(m, share) of each value of a marginal that has tokens; shares sum to one."""
    n = positive.groupBy(m).agg(F.sum("tokens").cast("double").alias("n"))
    total = positive.agg(F.sum("tokens")).first()[0] or 0
    if not isinstance(wanted, dict):
        n = n.withColumn("x", F.pow("n", F.lit(float(wanted))))
        return n.select(m, (F.col("x") / F.lit(float(n.agg(F.sum("x")).first()[0] or 1.0))).alias("share"))
    listed = n.sparkSession.createDataFrame([(k, float(v)) for k, v in wanted.items()], f"{m} string, v double")
    n = n.join(F.broadcast(listed), m, "left")  # a target is an argument, and as long as its caller wrote it
    given, known = n.agg(F.sum("v"), F.sum(F.when(F.col("v").isNotNull(), F.col("n")))).first()
    if given is not None and given <= 0:
        raise ValueError(f"no target of {m} is above zero for a value that is present")
    return n.select(m, F.when(F.col("v").isNull(), F.col("n") / float(total or 1)).otherwise(F.col("v") / float(given or 1) * (float(known or 0) / float(total or 1))).alias("share"))


def rake(cells: DataFrame, targets: dict[str, Target], rounds: int = ROUNDS) -> DataFrame:
    """cells (source, lang, topic, tokens) with factor, each sum of tokens x factor over a marginal
    near its target share. A half step sums the cells by a marginal and scales each by its sum; every LOOK
    rounds are checkpointed. Where the last round still changes a cell, a warning says by how much. FEW_CELLS are held in one partition, where sums need no shuffle; of more, sums are
    taken by partial aggregation and joined back, so no value's cells gather. ``cells`` should be
    checkpointed.
    """
    wanted = {m: checkpointed(shares(cells.where("tokens > 0"), m, targets.get(m, 1.0))) for m in MARGINALS}
    now, few = cells.where("tokens > 0").withColumn("factor", F.lit(1.0)), cells.count() <= FEW_CELLS
    for m in MARGINALS if few else ():  # a value of a marginal has a cell at least, so shares are as few
        now = now.join(F.broadcast(wanted[m].withColumnRenamed("share", f"share_{m}")), m)
    now = checkpointed(now.coalesce(1)) if few else now
    change = None
    for r in range(1, rounds + 1):
        now = now.withColumn("before", F.col("factor"))
        for m in MARGINALS:
            own = F.col("tokens") * F.col("factor")
            if few:
                now = now.withColumn("s", F.sum(own).over(Window.partitionBy(m)))
            else:
                now = now.join(now.groupBy(m).agg(F.sum(own).alias("s")).join(wanted[m].withColumnRenamed("share", f"share_{m}"), m), m)
            now = now.withColumn("factor", F.when(F.col("s") > 0, F.col("factor") * F.col(f"share_{m}") / F.col("s")).otherwise(0.0)).drop("s")
            now = now if few else now.drop(f"share_{m}")
        if r % LOOK and r < rounds:
            now = now if few else checkpointed(now)
            now = now.drop("before")
            continue
        now = checkpointed(now)
        change = now.agg(F.max(F.abs(F.col("factor") - F.col("before")) / F.greatest("factor", "before"))).first()[0]
        now = now.drop("before")
        if change is None or change <= SETTLED:
            break
    if change is not None and change > SETTLED:
        warnings.warn(f"raking has not settled in {rounds} rounds: a cell still changes by {change:.1e} of itself", stacklevel=2)
    return cells.join(now.select(*MARGINALS, "factor"), list(MARGINALS), "left").withColumn("factor", F.coalesce("factor", F.lit(0.0)))


def mixed(docs: DataFrame, targets: dict[str, Target], rate: float | None = RATE, rounds: int = ROUNDS, seed: str = SEED, topic: Column | None = None) -> DataFrame:
    """docs with _source, _lang, _topic, _tokens, weight, probability, residual and sampled."""
    return weighed(described(docs.drop("weight", "probability", "residual", "sampled"), topic), targets, rate, rounds, seed)


def weighed(rows: DataFrame, targets: dict[str, Target], rate: float | None = RATE, rounds: int = ROUNDS, seed: str = SEED) -> DataFrame:
    """As mixed(), of rows that are described; they are read twice."""
    cells = checkpointed(rows.groupBy(F.col("_source").alias("source"), F.col("_lang").alias("lang"), F.col("_topic").alias("topic")).agg(F.sum("_tokens").alias("tokens")))
    total, cells = cells.agg(F.sum("tokens")).first()[0] or 0, checkpointed(rake(cells, targets, rounds))
    top = cells.agg(F.max("factor")).first()[0] or 0.0
    scale = (1.0 / top if rate is None else rate * total) if top > 0 else 0.0
    known = cells.select(F.col("source").alias("_source"), F.col("lang").alias("_lang"), F.col("topic").alias("_topic"), F.round(F.col("factor") * F.lit(float(total)), 6).alias("weight"), F.round(F.least(F.lit(1.0), F.col("factor") * F.lit(scale)), 6).alias("probability"))
    known = known.withColumn("residual", F.when(F.col("probability") > 0, F.round(F.col("weight") / F.col("probability"), 6)).otherwise(0.0))
    known = F.broadcast(known) if known.count() <= 100_000 else known
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return rows.join(known, ["_source", "_lang", "_topic"]).withColumn("sampled", draw < F.col("probability"))


#: The production targets: sources tempered, more than half English, topics as they are.
TARGETS: dict[str, Target] = {"source": 0.5, "lang": {"en": 0.55, "de": 0.15, "fr": 0.15, "es": 0.15}, "topic": 1.0}


def op3_mixing(spark, sf_dir: str) -> DataFrame:
    rows = checkpointed(described(table(spark, sf_dir, "documents")).select("doc_id", "_source", "_lang", "_topic", "_tokens"))
    rows = weighed(rows, TARGETS)
    return rows.select("doc_id", F.col("_topic").alias("topic"), F.col("_tokens").alias("n_tokens"), "weight", "probability", "residual", "sampled")


def _sql(rounds: int = ROUNDS) -> str:
    first = f"((ascii(w) + ascii(w[-1]) + length(w)) % {TOPICS})"
    counts = ", ".join(f"len(list_filter(g, lambda x: x = {k}))" for k in range(TOPICS))
    steps, name = [], "f0"
    for r in range(rounds):
        for m in MARGINALS:
            new = f"f{r + 1}{m}"
            steps.append(f"{new} AS MATERIALIZED (SELECT source, lang, topic, tokens, CASE WHEN s > 0 THEN factor * share / s ELSE 0 END factor FROM (SELECT *, sum(tokens * factor) OVER (PARTITION BY {m}) s FROM {name}) JOIN t_{m} USING ({m}))")
            name = new
    given = " ".join(f"WHEN '{k}' THEN {v}" for k, v in TARGETS["lang"].items())
    share = {"source": f"pow(n, {TARGETS['source']})", "topic": "n"}
    marginals = ",\n".join(f"t_{m} AS (SELECT {m}, x / sum(x) OVER () share FROM (SELECT {m}, {x} x FROM (SELECT {m}, sum(tokens) n FROM f0 GROUP BY {m})))" for m, x in share.items())
    return f"""
WITH w AS (SELECT doc_id, coalesce(source, '') source, coalesce(lang, '') lang, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') ws FROM documents),
g AS (SELECT doc_id, source, lang, len(ws)::BIGINT tokens, list_transform(list_filter(ws, lambda x: length(x) >= {LONG_WORD}), lambda w: {first}) g FROM w),
d AS (SELECT doc_id, source, lang, tokens, CASE WHEN len(g) = 0 THEN '-1' ELSE (list_position([{counts}], list_max([{counts}])) - 1)::VARCHAR END topic FROM g),
f0 AS MATERIALIZED (SELECT source, lang, topic, sum(tokens)::DOUBLE tokens, 1.0::DOUBLE factor FROM d GROUP BY ALL HAVING sum(tokens) > 0),
{marginals},
t_lang AS (SELECT lang, CASE WHEN v IS NULL THEN n / sum(n) OVER () ELSE v / sum(v) OVER () * (sum(CASE WHEN v IS NOT NULL THEN n END) OVER () / sum(n) OVER ()) END share FROM (SELECT lang, n, (CASE lang {given} END)::DOUBLE v FROM (SELECT lang, sum(tokens) n FROM f0 GROUP BY lang))),
{", ".join(steps)},
known AS (SELECT source, lang, topic, round(factor * (SELECT sum(tokens) FROM f0), 6) weight, round(least(1.0, factor * (SELECT {RATE} * sum(tokens) FROM f0)), 6) probability FROM {name})
SELECT doc_id, topic, tokens n_tokens, coalesce(weight, 0) weight, coalesce(probability, 0) probability, CASE WHEN probability > 0 THEN round(weight / probability, 6) ELSE 0 END residual,
  ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT / 4294967296.0 < coalesce(probability, 0) sampled
FROM d LEFT JOIN known USING (source, lang, topic)
"""


OP3_SQL = _sql()
