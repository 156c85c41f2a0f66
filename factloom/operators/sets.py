"""Set operations over the answers to constraints, and over whole fact bases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def satisfied(facts: DataFrame, constraints: DataFrame) -> DataFrame:
    """(group, value, constraint, score) of subjects for constraints (group, constraint, r, o)."""
    return facts.join(constraints, ["r", "o"]).select("group", F.col("s").alias("value"), "constraint").distinct().withColumn("score", F.lit(1.0))


def intersect(facts: DataFrame, constraints: DataFrame) -> DataFrame:
    """(group, value, score): subjects that satisfy all constraints of a group; the geometric mean of scores."""
    n = constraints.groupBy("group").agg(F.count_distinct("constraint").alias("n"))
    hits = satisfied(facts, constraints).groupBy("group", "value").agg(F.count("*").alias("got"), F.exp(F.avg(F.ln(F.greatest("score", F.lit(1e-9))))).alias("score"))
    return hits.join(n, "group").where("got = n").select("group", "value", "score")


def union(facts: DataFrame, constraints: DataFrame) -> DataFrame:
    """(group, value, n_satisfied, score): subjects that satisfy any; the largest score."""
    return satisfied(facts, constraints).groupBy("group", "value").agg(F.count("*").alias("n_satisfied"), F.max("score").alias("score"))


def difference(facts: DataFrame, positive: DataFrame, negative: DataFrame) -> DataFrame:
    """(group, value) that satisfy a positive constraint of the group and no negative one."""
    return satisfied(facts, positive).select("group", "value").distinct().join(satisfied(facts, negative), ["group", "value"], "left_anti")


def duplicates(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Facts without repeats, the first of each staying, and the removed ones."""
    ranked = facts.withColumn("_n", F.row_number().over(W.partitionBy("s", "r", "o").orderBy("seq")))
    return ranked.where("_n = 1").drop("_n"), ranked.where("_n > 1").drop("_n")


def forget(facts: DataFrame, gone: DataFrame) -> DataFrame:
    """Facts without the first match of each row of gone (s, r, o); the n-th repeat of a row takes the n-th match."""
    n = gone.groupBy("s", "r", "o").agg(F.count("*").alias("_gone"))
    ranked = facts.withColumn("_n", F.row_number().over(W.partitionBy("s", "r", "o").orderBy("seq")))
    return ranked.join(n, ["s", "r", "o"], "left").where(F.col("_gone").isNull() | (F.col("_n") > F.col("_gone"))).select(*facts.columns)


def diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """(s, r, o, side): facts of one base only ("left", "right") or of both."""
    x, y = a.select("s", "r", "o").distinct().withColumn("x", F.lit(1)), b.select("s", "r", "o").distinct().withColumn("y", F.lit(1))
    side = F.when(F.col("y").isNull(), "left").when(F.col("x").isNull(), "right").otherwise("both")
    return x.join(y, ["s", "r", "o"], "full_outer").select("s", "r", "o", side.alias("side"))


def merge(a: DataFrame, b: DataFrame) -> DataFrame:
    """Facts of both bases, each once; those of a come first."""
    both = a.withColumn("_side", F.lit(0)).unionByName(b.withColumn("_side", F.lit(1)))
    return both.groupBy("s", "r", "o").agg(F.min(F.struct("_side", "seq"))["seq"].alias("seq")).select("seq", "s", "r", "o")


def merge_provenance(a: DataFrame, b: DataFrame) -> DataFrame:
    """Counts add, the last sight is the later, sources that differ become multi, and confidence is reinforced once."""
    key = ["s", "r", "o"]
    y = b.select(*key, *[F.col(c).alias(f"_{c}") for c in ("source", "confidence", "count", "last_seen")])
    both = a.join(y, key, "full_outer")
    two = F.col("source").isNotNull() & F.col("_source").isNotNull()
    return both.select(
        *key,
        F.when(two & (F.col("source") != F.col("_source")), "multi").otherwise(F.coalesce("source", "_source")).alias("source"),
        F.when(two, F.col("confidence") + 0.1 * (1 - F.col("confidence"))).otherwise(F.coalesce("confidence", "_confidence")).alias("confidence"),
        (F.coalesce("count", F.lit(0)) + F.coalesce("_count", F.lit(0))).alias("count"),
        F.greatest("last_seen", "_last_seen").alias("last_seen"),
    )
