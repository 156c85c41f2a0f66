"""What candidate facts would unlock, for all candidates in one fixpoint.

Alone: a row of the fixpoint is a fact and the one candidate it needs, none for what
the base gives by itself; facts that need different candidates don't join. In order:
a fact's value is the place of the last candidate it needs, at best: a derivation
needs the larger of its premises' values, and a fact the least of its derivations'.
So both are what adding candidates one by one would give, without a run for each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import traits
from ..sources import scratch
from . import derive

TRIPLE = ["s", "r", "o"]


def _ways(left: DataFrame, right: DataFrame, same: bool) -> DataFrame:
    """(s, r, o, v): two facts in a row give one that needs the larger v; with ``same``, only if no two different candidates are needed."""
    a = left.where(F.col("r").isin(*derive.BEGINS)).select("s", F.col("r").alias("r1"), F.col("o").alias("mid"), F.col("v").alias("va"))
    b = right.where(F.col("r").isin(*derive.ENDS)).select(F.col("s").alias("mid"), F.col("r").alias("r2"), "o", F.col("v").alias("vb"))
    rows = a.join(b, "mid").where("s != o AND mid != o AND s != mid").where(F.coalesce(traits.inverse(F.col("r1")) != F.col("r2"), F.lit(True)))
    if same:
        rows = rows.where("va = 0 OR vb = 0 OR va = vb")
    rows = rows.withColumn("r", derive.head(F.col("r1"), F.col("r2"), F.col("r1") == F.col("r2"))).where("r IS NOT NULL")
    return rows.select(*TRIPLE, F.greatest("va", "vb").alias("v"))


def _base(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    negative = traits.is_negative(F.col("r"))
    denied = facts.where(negative).select("s", traits.denegate(F.col("r")).alias("r"), "o").distinct()
    useful = F.col("r").isin(*(derive.BEGINS | derive.ENDS))
    return facts.where(~negative & useful).select(*TRIPLE).distinct(), scratch.keep(denied, "denied")


def alone(facts: DataFrame, candidates: DataFrame, rounds: int = 3) -> DataFrame:
    """(candidate, s, r, o) of candidates (candidate, s, r, o), numbered from 1: what each unlocks by itself, beyond the base and what that gives."""
    base, denied = _base(facts)
    grown = scratch.keep(base.union(derive.cascade(facts.select(*TRIPLE), rounds).select(*TRIPLE)).distinct().withColumn("v", F.lit(0).cast("long")), "base")
    told = candidates.select(*TRIPLE, F.col("candidate").cast("long").alias("v")).distinct()
    new = seen = scratch.keep(told.join(grown.select(*TRIPLE), TRIPLE, "left_anti"), "told")
    out = None
    for _ in range(rounds):
        ways = _ways(new, grown, True).union(_ways(grown, new, True)).union(_ways(new, seen, True)).union(_ways(seen, new, True))
        fresh = ways.distinct().join(grown.select(*TRIPLE), TRIPLE, "left_anti").join(denied, TRIPLE, "left_anti").join(seen, [*TRIPLE, "v"], "left_anti")
        new = scratch.keep(fresh, "unlocked")
        out = new if out is None else out.union(new)
        if new.isEmpty():
            break
        seen = seen.union(new)
    return out.select(F.col("v").alias("candidate"), *TRIPLE)


def in_order(facts: DataFrame, candidates: DataFrame, rounds: int = 3) -> DataFrame:
    """(candidate, s, r, o) of candidates (candidate, s, r, o), numbered from 1: what each unlocks when those before it are told."""
    base, denied = _base(facts)
    told = base.withColumn("v", F.lit(0).cast("long")).union(candidates.select(*TRIPLE, F.col("candidate").cast("long")))
    known = new = scratch.keep(told.groupBy(*TRIPLE).agg(F.min("v").alias("v")).withColumn("told", F.lit(True)), "told")
    for k in range(rounds):
        ways = _ways(new, known, False)
        if k:  # at first both are all facts
            ways = ways.union(_ways(known, new, False))
        ways = ways.groupBy(*TRIPLE).agg(F.min("v").alias("v"))
        both = ways.join(known.withColumnRenamed("v", "was"), TRIPLE, "left").join(denied, TRIPLE, "left_anti")
        new = scratch.keep(both.where("was IS NULL OR v < was").select(*TRIPLE, "v", F.coalesce("told", F.lit(False)).alias("told")), "better")
        if new.isEmpty():
            break
        known = scratch.keep(known.join(new.select(*TRIPLE), TRIPLE, "left_anti").unionByName(new), "known")
    return known.where("v > 0 AND NOT told").select(F.col("v").alias("candidate"), *TRIPLE)


def summed(unlocked: DataFrame, candidates: DataFrame, sample: int = 5) -> DataFrame:
    """(candidate, n, sample) of every candidate: how many facts it unlocks, and the first by name."""
    n = unlocked.groupBy("candidate").agg(F.count("*").alias("n"))
    first = unlocked.withColumn("k", F.row_number().over(W.partitionBy("candidate").orderBy(*TRIPLE))).where(F.col("k") <= sample)
    text = F.array_sort(F.collect_list(F.struct("k", F.concat_ws("|", *TRIPLE).alias("x"))))
    shown = first.groupBy("candidate").agg(F.array_join(F.transform(text, lambda e: e["x"]), "; ").alias("sample"))
    ids = candidates.select(F.col("candidate").cast("long").alias("candidate")).distinct()
    return ids.join(n, "candidate", "left").join(shown, "candidate", "left").select("candidate", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("sample", F.lit("")).alias("sample"))
