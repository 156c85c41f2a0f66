"""Where facts come from: reinforcement, decay, pruning, explanation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import scratch

#: Fixed value: share of the doubt that each sight of a fact takes away.
REINFORCE = 0.1


def reinforced(sights: DataFrame) -> DataFrame:
    """(s, r, o, source, confidence, count, last_seen) of sights (s, r, o, source, confidence, ts): the first sight's confidence, grown by each later one."""
    first = F.min_by("confidence", "ts")
    return sights.groupBy("s", "r", "o").agg(
        F.when(F.min("source") != F.max("source"), "multi").otherwise(F.min("source")).alias("source"),
        (1 - (1 - first) * F.pow(F.lit(1 - REINFORCE), F.count("*") - 1)).alias("confidence"), F.count("*").alias("count"), F.max("ts").alias("last_seen"),
    )


def decayed(provenance: DataFrame, factor: float, ticks: int = 1) -> DataFrame:
    return provenance.withColumn("confidence", F.col("confidence") * F.pow(F.lit(factor), F.lit(ticks)))


def pruned(facts: DataFrame, provenance: DataFrame, least: float = 0.1, few: int = 1, users_too: bool = False, negatives_too: bool = False) -> DataFrame:
    """Facts without those that are doubtful, rarely seen, and neither a user's nor denials."""
    gone = provenance.where((F.col("confidence") < least) & (F.col("count") <= few))
    if not users_too:
        gone = gone.where("source != 'user'")
    if not negatives_too:
        gone = gone.where("NOT startswith(r, 'not_')")
    return facts.join(gone.select("s", "r", "o"), ["s", "r", "o"], "left_anti")


def explain(derivations: DataFrame, roots: DataFrame, depth: int = 5) -> DataFrame:
    """(root, fact, depth, leaf) of derivations (fact, premise): the tree below each root, each fact at its least depth.

    Leaves are told apart once, on the derivations, and nothing is looked for below
    them. Further columns of derivations tell of the premise and are kept; roots have them too.
    """
    more = [c for c in derivations.columns if c not in ("fact", "premise")]
    edges = derivations.select("fact", "premise", *more)
    inner = edges.select("fact").distinct()
    is_leaf = F.coalesce("leaf", F.lit(True)).alias("leaf")
    step = scratch.keep(edges.join(inner.select(F.col("fact").alias("premise"), F.lit(False).alias("leaf")), "premise", "left").select("fact", "premise", *more, is_leaf), "edges")
    top = roots.select(F.col("root").alias("fact"), *more).distinct().join(inner.withColumn("leaf", F.lit(False)), "fact", "left")
    rows = scratch.keep(top.select(F.col("fact").alias("root"), "fact", *more, is_leaf), "front")
    seen, above = rows.withColumn("depth", F.lit(0)), rows.where("NOT leaf").select("root", "fact")
    for d in range(1, depth + 1):
        new = rows.where("NOT leaf").select("root", "fact").join(step, "fact").select("root", F.col("premise").alias("fact"), *more, "leaf")
        inside = new.where("NOT leaf").distinct().join(above, ["root", "fact"], "left_anti")
        rows = scratch.keep(new.where("leaf").union(inside), "front")
        if rows.isEmpty():
            break
        seen, above = seen.unionByName(rows.withColumn("depth", F.lit(d))), above.union(rows.where("NOT leaf").select("root", "fact"))
    return seen.groupBy("root", "fact").agg(F.min("depth").alias("depth"), F.first("leaf").alias("leaf"), *[F.first(c).alias(c) for c in more])
