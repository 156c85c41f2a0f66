"""How filters interact: who is removed by which filter, in every order of them.

Each document has a mask of the five filters it fails. For each part and label, the
32 sums of signs ``(-1) ** bits(mask & u)`` are aggregated, a Walsh-Hadamard
transform that adds up over tasks; its inverse, applied to the sums, gives exactly
how many documents have each mask. All 120 orders are evaluated on these cells, and
a filter's removals summed over all orders are 120 / failures for each document
that fails it, as each of its failing filters is the first in as many orders.

A null text is empty: it fails the first filter, and is a copy of other empty ones.
Of equal texts, all but those of the smallest id are copies; rows that share that
id, and rows without an id, are none. Documents without labels count in the totals
only; several labels of an id count if any is 1. A null source is the part "".
An empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch

FILTERS = "ABCDE"
CELLS = 1 << len(FILTERS)
ORDERS = tuple("".join(p) for p in permutations(FILTERS))
LEAST_WORDS, DISTINCT_PERCENT, UPPER_PERCENT = 50, 65, 5
#: Texts that more than this share of all rows have; so at most as many texts as its inverse are broadcast.
HEAVY_SHARE = 1 / 10_000


def failures(text: Column) -> Column:
    """The mask of the filters that look at one text."""
    text = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    n = F.size(words)
    fails = (
        n < LEAST_WORDS, 100 * F.size(F.array_distinct(words)).cast("long") < DISTINCT_PERCENT * n.cast("long"),
        100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long") > UPPER_PERCENT * F.length(text).cast("long"), text.rlike("[#$%&*|]"),
    )
    return reduce(lambda a, b: a + b, [F.when(x, 1 << k).otherwise(0) for k, x in enumerate(fails)])


def masks(docs: DataFrame, id_col: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(id, part, mask) for each row. Only digests of texts are moved; those of very many rows are broadcast, so that no copies meet in one task."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(part, F.lit("")).alias("part"), failures(F.col(text)).alias("mask"), F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)).alias("digest"))
    rows = scratch.keep(rows, "audit-rows")
    copies = scratch.keep(rows.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL"), "audit-copies")
    heavy = F.col("n") > rows.count() * HEAVY_SHARE
    hot = F.broadcast(copies.where(heavy).select("digest", "first"))
    rest = rows.join(hot.select("digest"), "digest", "left_anti").join(copies.where(~heavy).select("digest", "first"), "digest", "left")
    again = F.when(F.col("id") > F.col("first"), 1 << 4).otherwise(0)
    return rows.join(hot, "digest").unionByName(rest).select("id", "part", (F.col("mask") + again).alias("mask"))


def sign(mask: Column, u: Column | int) -> Column:
    return F.lit(1) - 2 * (F.bit_count(mask.bitwiseAND(u)) % 2)


def parity_sums(rows: DataFrame) -> DataFrame:
    """(part, label, sums) of rows (part, label, mask)."""
    own = rows.groupBy("part", "label").agg(*[F.sum(sign(F.col("mask"), u)).alias(f"w{u}") for u in range(CELLS)])
    return own.select("part", "label", F.array(*[f"w{u}" for u in range(CELLS)]).alias("sums"))


def cells(sums: Column) -> Column:
    """Documents with each mask, from the sums of signs; the division has no rest."""
    at = F.sequence(F.lit(0), F.lit(CELLS - 1))
    return F.transform(at, lambda m: F.shiftright(F.aggregate(at, F.lit(0).cast("long"), lambda a, u: a + sums[u] * sign(m, u)), len(FILTERS)))


def total(counts: Column, holds) -> Column:
    """Documents whose mask meets a condition."""
    return F.aggregate(F.sequence(F.lit(0), F.lit(CELLS - 1)), F.lit(0).cast("long"), lambda a, m: a + F.when(holds(m), counts[m]).otherwise(0))


def interactions(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", part: str = "source", good: str = "quality", toxic: str = "toxic") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley): a row for each part, order and step."""
    rows = scratch.keep(masks(docs, id_col, text, part), "audit-masks")
    marks = F.explode(F.array_compact(F.array(F.when(F.col(good) == 1, "good"), F.when(F.col(toxic) == 1, "toxic"))))
    marked = labels.select(F.col(id_col).alias("id"), marks.alias("label")).distinct()
    both = rows.select("part", F.lit("all").alias("label"), "mask").union(rows.join(marked, "id").select("part", "label", "mask"))
    counted = parity_sums(both).withColumn("cells", cells(F.col("sums")))
    of = lambda label: F.coalesce(F.first(F.when(F.col("label") == label, F.col("cells")), ignorenulls=True), F.array_repeat(F.lit(0).cast("long"), CELLS)).alias(label)
    parts = counted.groupBy("part").agg(of("all"), of("good"), of("toxic"))
    steps = parts.withColumn("filter_order", F.explode(F.array(*map(F.lit, ORDERS)))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    bits = F.create_map(*[F.lit(x) for k, f in enumerate(FILTERS) for x in (f, 1 << k)])
    letters = F.transform(F.sequence(F.lit(1), F.col("step")), lambda k: bits[F.substr("filter_order", k, F.lit(1))])
    own = steps.withColumn("bit", F.element_at(letters, -1)).withColumn("before", F.aggregate(letters, F.lit(0), lambda a, b: a + b) - F.col("bit"))
    bit, before = F.col("bit"), F.col("before")
    fails, earlier = (lambda m: m.bitwiseAND(bit) != 0), (lambda m: m.bitwiseAND(before) != 0)
    removed = lambda m: fails(m) & ~earlier(m)
    shares = F.array(*[F.lit(len(ORDERS) // k) for k in range(1, len(FILTERS) + 1)])
    share = F.aggregate(F.sequence(F.lit(1), F.lit(CELLS - 1)), F.lit(0).cast("long"), lambda a, m: a + F.when(fails(m), F.col("all")[m] * F.element_at(shares, F.bit_count(m))).otherwise(0))
    return own.select(
        "part", "filter_order", "step", total(F.col("all"), lambda m: ~fails(m) & ~earlier(m)).alias("kept"), total(F.col("all"), removed).alias("removed"),
        total(F.col("all"), lambda m: fails(m) & earlier(m)).alias("redundant"), F.col("all")[bit].alias("unique_fails"),
        total(F.col("good"), removed).alias("good_lost"), total(F.col("toxic"), removed).alias("toxic_lost"), share.alias("shapley"),
    )
