"""Merkle manifest of a dataset: a tree of digests for each group of rows, a tree over their roots, and
for every row the digests that prove it.

A leaf is the SHA-256, in lowercase hex digits, of a row's fields; a parent is that of its children's
digests, joined. In a tree every ``arity`` neighbours on a level have a parent, the last one fewer, even
one; a level of one node is the root. So the number of rows alone tells how many children a node has.

1. Leaves are sorted by group, order, digest and a number of their own, in ranges, and numbered in their
   group: by place in their range and the sums of the ranges before.
2. Events, a node's digest each, go by combineByKey to blocks of BLOCK neighbouring places or fewer. A
   block's combiner holds partial parents: a parent gathers children under their places until it has as
   many as its level's size gives it, and becomes an event for its own parent. Combiners of tasks meet
   as what they have of the block. What a block can't resolve, its topmost node, is the frontier: it goes
   to the next round as a leaf of larger blocks, until one is left. The roots, by group, make the tree above.
3. Links run back: from the root, each block hands the digests beside its path down to the blocks
   below, which add those within, and so to the rows.

Rounds are as many as the levels divided by those of a block; a round deals out a node for each block.
A block holds BLOCK leaves at most, whatever the size of its group. Only sums and the largest size of a
group come to the driver.

Defined results: null fields count as ``-``; null groups and null order are values that come first; rows of
one order are placed by their leaves, and repeated rows have a place each; an empty table gives an empty
result; columns that aren't named as fields are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark import RDD
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillrun.llm.common import drop_stored, stored, table

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
ARITY = 2
#: Leaves of a block at most.
BLOCK = 4096
#: Leaves that a partition of blocks has, about, where the session's number would give it more.
PART_ROWS = 200_000
STEPS = "array<struct<before:string,after:string>>"
PROOFS = f"group string, known boolean, id long, leaf string, other string, subroot string, root string, steps {STEPS}"
RANKED = "group string, id long, known boolean, leaf string, other string, at long, size long"


def field(value: Column) -> Column:
    """``-`` for null, else the value's bytes in UTF-8 by number, a colon, and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: list[Column]) -> Column:
    return F.sha2(F.concat(*map(field, values)).cast("binary"), 256)


def digest(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def widths(size: int, arity: int, levels: int) -> list[int]:
    """Nodes of a tree of so many leaves, on each level from the lowest."""
    found = [size]
    for _ in range(levels):
        found.append(-(-found[-1] // arity))
    return found


class Partial:
    """What is known of a block: digests by level and place, and parents that wait for children.

    ``size`` is how many nodes the tree has on the block's lowest level, ``rows`` what the leaves carry.
    """

    __slots__ = ("arity", "levels", "size", "widths", "known", "open", "rows")

    def __init__(self, arity: int, levels: int, size: int):
        self.arity, self.levels, self.size = arity, levels, size
        self.widths = widths(size, arity, levels)
        self.known: dict[tuple[int, int], str] = {}
        self.open: dict[tuple[int, int], dict[int, str]] = {}
        self.rows: dict[int, tuple] = {}

    def __reduce__(self):
        return _partial, (self.arity, self.levels, self.size, self.known, self.open, self.rows)

    def tell(self, level: int, place: int, value: str) -> None:
        """A node is known; so may be its parent, and what stands above."""
        while True:
            self.known[level, place] = value
            nodes = self.widths[level]
            if level == self.levels or nodes == 1:
                return
            parent = (level + 1, place // self.arity)
            children = self.open.setdefault(parent, {})
            children[place] = value
            if len(children) < min(self.arity, nodes - parent[1] * self.arity):
                return
            del self.open[parent]
            level, place = parent
            value = digest([children[p] for p in sorted(children)])

    def meet(self, other: Partial) -> Partial:
        self.rows.update(other.rows)
        waiting = other.open
        self.known.update(other.known)
        for (level, _), children in waiting.items():
            for place, value in children.items():
                self.tell(level - 1, place, value)
        return self

    def top(self) -> tuple[int, int]:
        return max(self.known)

    def paths(self) -> Iterator[tuple[int, list[tuple[str, str]]]]:
        """For each leaf the digests before and after it and its ancestors, level by level."""
        highest = self.top()
        above: dict[int, list[tuple[str, str]]] = {highest[1]: []}
        for level in range(highest[0] - 1, -1, -1):
            nodes, below = self.widths[level], {}
            for parent, steps in above.items():
                places = range(parent * self.arity, min((parent + 1) * self.arity, nodes))
                for p in places:
                    before = "".join(self.known[level, q] for q in places if q < p)
                    below[p] = [(before, "".join(self.known[level, q] for q in places if q > p)), *steps]
            above = below
        yield from above.items()


def _partial(arity: int, levels: int, size: int, known: dict, waiting: dict, rows: dict) -> Partial:
    out = Partial(arity, levels, size)
    out.known, out.open, out.rows = known, waiting, rows
    return out


def block_levels(arity: int) -> int:
    levels = 1
    while arity ** (levels + 1) <= BLOCK:
        levels += 1
    return levels


def gathered(events: RDD, arity: int, levels: int, parts: int) -> RDD:
    """Blocks from events ((group, block), (size, place, digest, what the leaf carries))."""

    def more(block: Partial, event: tuple) -> Partial:
        _, place, value, carried = event
        block.rows[place] = carried
        block.tell(0, place, value)
        return block

    return events.combineByKey(lambda event: more(Partial(arity, levels, event[0]), event), more, Partial.meet, parts)


def numbered(leaves: DataFrame) -> DataFrame:
    """Columns RANKED, from rows (group, id, known, leaf, other): their places in their group by id."""
    own = stored(leaves.withColumn("uid", F.monotonically_increasing_id()))
    order = ["group", F.col("known").asc(), "id", "leaf", "uid"]
    # within a range the numbers rise with the order, and their upper bits tell the range
    rows = stored(own.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("uid", F.monotonically_increasing_id()))
    drop_stored(own)
    part = F.shiftright("uid", 33).alias("part")
    sums = rows.groupBy("group", part).agg(F.min("uid").alias("least"), F.count(F.lit(1)).alias("n"))
    by = Window.partitionBy("group")
    before = F.coalesce(F.sum("n").over(by.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(F.col("group").alias("_g"), F.col("part").alias("_p"), (before - F.col("least")).alias("shift"), F.sum("n").over(by).alias("size"))
    joined = rows.join(sums, rows["group"].eqNullSafe(sums["_g"]) & (F.shiftright("uid", 33) == sums["_p"]))
    ranked = stored(joined.select("group", "id", "known", "leaf", "other", (F.col("uid") + F.col("shift")).alias("at"), "size"))
    drop_stored(rows)
    return ranked


def rounds_of(size: int, span: int) -> int:
    """The round in which a tree of so many leaves has one block left."""
    found = 0
    while size > span:
        size, found = -(-size // span), found + 1
    return found


def _rounds(ranked: DataFrame, arity: int) -> list[RDD]:
    """The blocks of each round from below."""
    levels = block_levels(arity)
    span = arity**levels
    n, largest = ranked.agg(F.count(F.lit(1)), F.coalesce(F.max("size"), F.lit(0))).first()
    parts = max(int(ranked.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // PART_ROWS)
    events = ranked.rdd.map(lambda r: ((r["group"], r["at"] // span), (r["size"], r["at"], r["leaf"], (r["known"], r["id"], r["other"]))))
    blocks = []
    for k in range(rounds_of(largest, span) + 1):
        blocks.append(gathered(events, arity, levels, parts if k == 0 else max(1, parts // 8)))

        def frontier(item: tuple) -> list[tuple]:
            (group, _), block = item
            level, place = block.top()
            nodes = block.widths[level]
            return [((group, place // span), (nodes, place, block.known[level, place], None))] if nodes > 1 else []

        events = blocks[-1].flatMap(frontier)
    return blocks


def _roots(blocks: list[RDD], arity: int) -> RDD:
    """(group, root, number of leaves above which the last block stands) of each tree."""

    def last(k: int):
        def run(item: tuple) -> list[tuple]:
            (group, _), block = item
            level, place = block.top()
            return [(group, block.known[level, place], k)] if block.widths[level] == 1 else []

        return run

    found = [b.flatMap(last(k)) for k, b in enumerate(blocks)]
    return found[0].context.union(found) if len(found) > 1 else found[0]


def _handed_down(blocks: list[RDD], crowns: RDD) -> RDD:
    """(leaf's place and what it carries, its block's group, crown, steps) from crowns
    (group, (round of the last block, crown, steps above it))."""

    def steps(item: tuple) -> Iterator[tuple]:
        (group, _), (block, (crown, above)) = item
        for place, own in block.paths():
            yield group, place, block, crown, [*own, *above]

    links = None
    for k in reversed(range(len(blocks))):
        here = crowns.filter(lambda c, k=k: c[1][0] == k).map(lambda c: ((c[0], 0), (c[1][1], c[1][2])))
        links = here if links is None else links.union(here)
        parts = blocks[k].getNumPartitions()
        paths = blocks[k].join(links, parts).flatMap(steps)
        links = paths.map(lambda x: ((x[0], x[1]), (x[3], x[4])))
    return paths


def prove(leaves: DataFrame, arity: int = ARITY) -> DataFrame:
    """Columns PROOFS of rows (group string, known boolean, id long, leaf string, other string): steps are
    the digests before and after the row's node on each level, up to the root over all groups. ``other`` is
    carried along."""
    spark = leaves.sparkSession
    blocks = _rounds(numbered(leaves), arity)
    roots = _roots(blocks, arity).map(lambda r: (r[0], r[2], True, r[1], None))
    tops = stored(spark.createDataFrame(roots, "group string, id long, known boolean, leaf string, other string", verifySchema=False))
    # the groups' roots are the leaves of one tree, in the order of the groups
    above = tops.select(F.lit("").alias("group"), "id", (F.col("group").isNotNull()).alias("known"), "leaf", F.col("group").alias("other"))
    above = _by_name(above)
    upper = _rounds(above, arity)
    root = above.sparkSession.createDataFrame(_roots(upper, arity).map(lambda r: (r[1],)), "root string").first()
    if root is None:
        return spark.createDataFrame([], PROOFS)
    root = root["root"]
    crowns = _handed_down(upper, _roots(upper, arity).map(lambda r: (r[0], (r[2], None, []))))
    crowns = crowns.map(lambda x: (x[2].rows[x[1]], x[2].known[0, x[1]], x[4])).map(lambda x: (x[0][2] if x[0][0] else None, (x[0][1], x[1], x[2])))
    paths = _handed_down(blocks, crowns)

    def row(x: tuple) -> tuple:
        group, place, block, subroot, steps = x
        known, doc, other = block.rows[place]
        return group, known, doc, block.known[0, place], other, subroot, root, steps

    return spark.createDataFrame(paths.map(row), PROOFS, verifySchema=False)


def _by_name(tops: DataFrame) -> DataFrame:
    """Columns RANKED of the groups' roots in the order of their names, null first."""
    own = tops.withColumn("uid", F.lit(0))
    order = [F.col("known").asc(), F.col("other").asc_nulls_first()]
    rows = stored(own.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("uid", F.monotonically_increasing_id()))
    part = F.shiftright("uid", 33).alias("part")
    sums = rows.groupBy(part).agg(F.min("uid").alias("least"), F.count(F.lit(1)).alias("n"))
    every = Window.partitionBy(F.lit(0))
    before = F.coalesce(F.sum("n").over(every.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(F.col("part").alias("_p"), (before - F.col("least")).alias("shift"), F.sum("n").over(every).alias("size"))
    return rows.join(sums, F.shiftright("uid", 33) == sums["_p"]).select("group", "id", "known", "leaf", "other", (F.col("uid") + F.col("shift")).alias("at"), "size")


def beside(steps: Column) -> Column:
    """All digests of a proof, from the leaf to the root, each level's from left to right."""
    return F.array_join(F.transform(steps, lambda s: F.concat(s["before"], s["after"])), "")


def folded(own: Column, steps: Column) -> Column:
    """The root that a leaf and the digests beside its path give."""
    return F.aggregate(steps, own, lambda acc, s: F.sha2(F.concat(s["before"], acc, s["after"]).cast("binary"), 256))


def manifest(docs: DataFrame, fields: list[str] = FIELDS, order: str = "doc_id", group: str = "lang", arity: int = ARITY, other: Column | None = None) -> DataFrame:
    """(group, <order>, leaf, other, subroot, root, steps) of each row, for trees of the ``fields`` by
    ``group``, in the order of a whole-numbered column."""
    own = docs.select(
        docs[group].cast("string").alias("group"), docs[order].isNotNull().alias("known"), F.coalesce(docs[order].cast("long"), F.lit(0)).alias("id"),
        leaf([docs[f] for f in fields]).alias("leaf"), (F.lit(None) if other is None else other).cast("string").alias("other"),
    )
    return prove(own, arity).select("group", F.when(F.col("known"), F.col("id")).alias(order), "leaf", "other", "subroot", "root", "steps")


def verified(proofs: DataFrame) -> DataFrame:
    """proofs with folded_root, from ``other`` in place of the leaf where there is one, and verified."""
    rows = proofs.withColumn("folded_root", folded(F.coalesce("other", "leaf"), F.col("steps")))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    """The manifest of all documents, and what it makes of rows whose n_chars were raised by one."""
    docs = table(spark, sf_dir, "documents")
    raised = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("string")
    meddled = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0) & F.col("n_chars").isNotNull()
    other = F.when(meddled, leaf([raised if f == "n_chars" else F.col(f) for f in FIELDS]))
    rows = verified(manifest(docs, other=other))
    return rows.select("doc_id", "leaf", "subroot", "root", F.sha2(beside(F.col("steps")).cast("binary"), 256).alias("proof_sha256"), "folded_root", "verified")


_FIELD = "coalesce(strlen({0}::VARCHAR) || ':' || {0}::VARCHAR, '-')"
_LEAF = "sha256({} || {} || {} || {} || {})"
#: The rows of op13, by recursion over levels; rows of equal ids have no order there.
OP13_SQL = f"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda s, z: xor(s >> 1, 3988292384 * (s & 1)))) t),
own AS (SELECT *, list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda s, c: xor(s >> 8, t[(xor(s, c) & 255) + 1])) k FROM documents, crc),
leaves AS (SELECT doc_id, lang, {_LEAF.format(*(_FIELD.format(f) for f in FIELDS))} leaf,
  {_LEAF.format(*(_FIELD.format(f if f != "n_chars" else "(n_chars + CASE WHEN xor(k, 4294967295) % 7 = 0 THEN 1 ELSE 0 END)") for f in FIELDS))} claimed,
  row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST) - 1 i, count(*) OVER (PARTITION BY lang) n FROM own),
nodes AS (SELECT lang, 0 lv, i, leaf h, n FROM leaves UNION ALL
  SELECT lang, lv + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), any_value((n + 1) // 2) FROM nodes WHERE n > 1 GROUP BY lang, lv, i // 2),
tops AS (SELECT lang, lv high, h subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 i, count(*) OVER () n FROM nodes WHERE n = 1),
crown AS (SELECT 0 lv, i, subroot h, n FROM tops UNION ALL SELECT lv + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), any_value((n + 1) // 2) FROM crown WHERE n > 1 GROUP BY lv, i // 2),
top AS (SELECT h root, lv higher FROM crown WHERE n = 1),
beside AS (SELECT l.doc_id, l.lang, l.i leaf_i, s.lv, s.h, s.i place FROM leaves l JOIN nodes s ON s.lang IS NOT DISTINCT FROM l.lang AND s.i = xor(l.i >> s.lv, 1) UNION ALL
  SELECT l.doc_id, l.lang, l.i, t.high + c.lv, c.h, c.i FROM leaves l JOIN tops t ON t.lang IS NOT DISTINCT FROM l.lang JOIN crown c ON c.i = xor(t.i >> c.lv, 1)),
proofs AS (SELECT lang, leaf_i, string_agg(h, '' ORDER BY lv) p FROM beside GROUP BY lang, leaf_i),
steps AS (SELECT lang, leaf_i, lv, h, place % 2 = 0 AS before FROM beside),
folds AS (SELECT l.lang, l.i leaf_i, 0 lv, claimed acc, high + higher last FROM leaves l JOIN tops t ON t.lang IS NOT DISTINCT FROM l.lang, top UNION ALL
  SELECT f.lang, f.leaf_i, f.lv + 1, sha256(CASE WHEN before THEN h ELSE '' END || acc || CASE WHEN NOT before THEN h ELSE '' END), last
  FROM folds f LEFT JOIN steps s ON s.lang IS NOT DISTINCT FROM f.lang AND s.leaf_i = f.leaf_i AND s.lv = f.lv WHERE f.lv < last)
SELECT l.doc_id, leaf, subroot, root, sha256(coalesce(p, '')) proof_sha256, acc folded_root, acc = root verified
FROM leaves l JOIN tops t ON t.lang IS NOT DISTINCT FROM l.lang LEFT JOIN proofs p ON p.lang IS NOT DISTINCT FROM l.lang AND p.leaf_i = l.i
  JOIN folds f ON f.lang IS NOT DISTINCT FROM l.lang AND f.leaf_i = l.i AND f.lv = last, top
"""
