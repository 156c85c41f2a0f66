"""Answers to a table of questions: one pass tells what each asks, and each kind has its own plan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import questions, text
from ..sources import scratch
from . import pattern

#: Names that a list gives at most.
LISTED = 12
#: Score of an answer that an ancestor hands down.
INHERITED = 0.7


def classified(asked: DataFrame) -> DataFrame:
    """Adds what each question (id, text) is: arithmetic, two-step, compare, boolean, enumerate or factual, tried in this order, with what it names."""
    q = F.col("text")
    value, nested = text.arithmetic(q), questions.nested(q)
    kind = F.when(value.isNotNull(), "arithmetic").when(nested.isNotNull(), "two-step").otherwise(questions.kind(q))
    names = {"nested": nested, "fact": questions.factual(q), "yes_no": questions.yes_no(q), "listed": questions.listed(q), "compared": questions.compared(q)}
    return asked.select("id", kind.alias("kind"), value.alias("value"), *[v.alias(k) for k, v in names.items()])


def _factual(facts: DataFrame, rows: DataFrame) -> DataFrame:
    """Of the relations to try the first that has an answer; else what an ancestor hands down."""
    probes = rows.select(F.col("id").alias("probe"), F.col("fact.entity").alias("s"), F.col("fact.relation").alias("r")).where("s IS NOT NULL")
    ways = probes.select("probe", "s", F.col("r").alias("asked"), F.posexplode(questions.tried(F.col("r"))).alias("k", "r"))
    own = pattern.answers(facts).select("s", "r", "answer")
    hit = ways.join(own, ["s", "r"]).groupBy("probe").agg(F.min_by(F.struct("answer", "r", "asked"), "k").alias("x")).select("probe", "x.*")
    hit = scratch.keep(hit, "answered")
    direct = hit.select(F.col("probe").alias("id"), "answer", F.lit(1.0).alias("score"), F.when(F.col("r") == F.col("asked"), "direct").otherwise(F.concat(F.lit("via "), "r")).alias("how"))
    left = probes.join(hit.select("probe"), "probe", "left_anti")
    far = pattern.infer(facts, left, discount=INHERITED).where("how = 'inherited'")
    return direct.union(far.select("probe", "answer", "score", "how"))


def routed(facts: DataFrame, asked: DataFrame) -> DataFrame:
    """(id, kind, answer, score, how) of questions (id, text); answer and how are null, and the score 0, where nothing is known."""
    rows = scratch.keep(classified(asked), "questions")
    of = lambda kind: rows.where(F.col("kind") == kind)
    one = F.lit(1.0)
    sums = of("arithmetic").select("id", F.when(F.col("value") == F.floor("value"), F.floor("value").cast("string")).otherwise(F.col("value").cast("string")).alias("answer"), one.alias("score"), F.lit("direct").alias("how"))
    steps = of("two-step").select("id", F.col("nested.entity").alias("s"), F.col("nested.inner").alias("r"), F.col("nested.outer").alias("outer"))
    own = pattern.answers(facts).select("s", "r", "answer")
    middle = steps.join(own, ["s", "r"]).select("id", F.col("answer").alias("s"), F.col("outer").alias("r"))
    two = middle.join(own, ["s", "r"]).select("id", "answer", one, F.lit("two-step"))
    said = pattern.boolean(facts, of("boolean").where("yes_no IS NOT NULL").select(F.col("id").alias("probe"), "yes_no.*"))
    yes = said.where("verdict IS NOT NULL").select("probe", F.col("verdict").cast("string"), one, "how")
    both = of("compare").where("compared IS NOT NULL").select("id", "compared.*")
    sizes = pattern.compare_sizes(facts, both.select("a", "b").distinct()).where("winner != 'unknown'")
    larger = both.join(sizes, ["a", "b"]).select("id", "winner", one, F.lit("size"))
    kinds = of("enumerate").where("listed IS NOT NULL").select("id", F.col("listed").alias("o"))
    groups = facts.where(F.col("r").isin("isa", "category")).join(kinds.select("o").distinct(), "o", "left_semi").groupBy("o", "r", "s").agg(F.min("seq").alias("seq"))
    first = groups.withColumn("n", F.row_number().over(W.partitionBy("o", "r").orderBy("seq", "s"))).where(F.col("n") <= LISTED)
    names = first.groupBy("o", "r").agg(F.array_sort(F.collect_list(F.struct("n", "s"))).alias("x"))
    best = names.groupBy("o").agg(F.max_by(F.struct("x", "r"), "r").alias("y"))  # isa before category
    lists = kinds.join(best, "o").select("id", F.array_join(F.transform("y.x", lambda e: e["s"]), ", "), one, F.col("y.r"))
    known = reduce(DataFrame.union, (sums, two, yes, larger, lists, _factual(facts, of("factual"))))
    return rows.select("id", "kind").join(known, "id", "left").select("id", "kind", "answer", F.coalesce("score", F.lit(0.0)).alias("score"), "how")
