"""Conflicts between facts, their resolution, and votes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import traits


def functional_conflicts(facts: DataFrame, functional: tuple[str, ...] = traits.FUNCTIONAL) -> DataFrame:
    """(s, r, n_values, values): subjects with several objects of a relation that has one."""
    own = facts.where(F.col("r").isin(*functional)).select("s", "r", "o").distinct()
    return own.groupBy("s", "r").agg(F.count("*").alias("n_values"), F.array_join(F.array_sort(F.collect_set("o")), ",").alias("values")).where("n_values >= 2")


def denial_conflicts(facts: DataFrame) -> DataFrame:
    """(s, r, o) that are both stored and denied."""
    neg = facts.where(traits.is_negative(F.col("r"))).select("s", traits.denegate(F.col("r")).alias("r"), "o").distinct()
    return facts.where(~traits.is_negative(F.col("r"))).select("s", "r", "o").distinct().join(neg, ["s", "r", "o"], "left_semi")


def resolve(facts: DataFrame, provenance: DataFrame, functional: tuple[str, ...] = traits.FUNCTIONAL) -> DataFrame:
    """(s, r, o, keep, reason): of conflicting objects the one with the best source, then the latest, most repeated, surest stays."""
    conflicts = functional_conflicts(facts, functional).select("s", "r")
    own = facts.groupBy("s", "r", "o").agg(F.min("seq").alias("seq")).join(conflicts, ["s", "r"], "left_semi").join(provenance, ["s", "r", "o"], "left")
    prio = F.coalesce(traits.lookup(traits.SOURCE_PRIORITY, F.coalesce("source", F.lit("unknown"))), F.lit(traits.SOURCE_PRIORITY["unknown"]))
    keys = {"source": prio, "recency": F.coalesce("last_seen", F.lit(0.0)), "count": F.coalesce("count", F.lit(0)), "confidence": F.coalesce("confidence", F.lit(0.0))}
    rated = own.select("s", "r", "o", "seq", *[v.alias(f"_{k}") for k, v in keys.items()])
    w = W.partitionBy("s", "r").orderBy(*[F.desc(f"_{k}") for k in keys], "seq")
    ranked = rated.withColumn("_n", F.row_number().over(w))
    reason = F.lit("order")
    for k in reversed(list(keys)):
        reason = F.when(F.col(f"_{k}") != F.lead(f"_{k}").over(w), k).otherwise(reason)
    ranked = ranked.withColumn("_why", reason)
    first = F.first("_why").over(w)
    return ranked.select("s", "r", "o", (F.col("_n") == 1).alias("keep"), first.alias("reason"))


def majority(votes: DataFrame) -> DataFrame:
    """(probe, winner, n_votes, abstained) of votes (probe, voter, value, score); a null value abstains."""
    n = votes.groupBy("probe", "value").agg(F.count("*").alias("n"), F.sum("score").alias("weight"))
    best = n.where("value IS NOT NULL").groupBy("probe").agg(F.min_by(F.struct("value", "n"), F.struct(-F.col("n"), -F.col("weight"), F.col("value"))).alias("x"))
    out = n.where("value IS NULL").select("probe", F.col("n").alias("abstained"))
    return votes.select("probe").distinct().join(best, "probe", "left").join(out, "probe", "left").select("probe", F.col("x.value").alias("winner"), F.coalesce("x.n", F.lit(0)).alias("n_votes"), F.coalesce("abstained", F.lit(0)).alias("abstained"))
