"""Facts from the relational tables. seq keeps the order of tables and keys; it needs no global numbering."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources import scratch

#: seq is the table's rank times this, plus the key.
STEP = 10**17
#: Upper bounds of p_size for each size.
SIZE_BOUNDS = ((10, "tiny"), (20, "small"), (30, "medium"), (40, "large"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _facts(df: DataFrame, rank: int, key: Column, s: Column, r: str, o: Column) -> DataFrame:
    return df.select((F.lit(rank * STEP) + key.cast("long")).alias("seq"), F.lower(s).alias("s"), F.lit(r).alias("r"), F.lower(o).alias("o"))


def _tag(kind: str, key: str) -> Column:
    return F.concat(F.lit(f"{kind}#"), F.col(key).cast("string"))


def _size() -> Column:
    out = F.when(F.col("p_size") <= SIZE_BOUNDS[0][0], SIZE_BOUNDS[0][1])
    for most, name in SIZE_BOUNDS[1:]:
        out = out.when(F.col("p_size") <= most, name)
    return out.otherwise("huge")


def facts(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    """(seq, s, r, o) of the named views; see VIEWS."""
    t = lambda name: table(spark, sf_dir, name)
    c = F.col

    def one(name: str) -> DataFrame:
        if name == "N":
            return _facts(t("nation").join(F.broadcast(t("region")), c("n_regionkey") == c("r_regionkey")), 1, c("n_nationkey"), c("n_name"), "locatedin", c("r_name"))
        if name == "C":
            return _facts(t("customer").join(F.broadcast(t("nation")), c("c_nationkey") == c("n_nationkey")), 2, c("c_custkey"), c("c_name"), "locatedin", c("n_name"))
        if name == "C2":
            return _facts(t("customer"), 3, c("c_custkey"), c("c_name"), "category", c("c_mktsegment"))
        if name == "S":
            return _facts(t("supplier").join(F.broadcast(t("nation")), c("s_nationkey") == c("n_nationkey")), 4, c("s_suppkey"), c("s_name"), "locatedin", c("n_name"))
        if name == "P":
            return _facts(t("part"), 5, c("p_partkey"), _tag("part", "p_partkey"), "isa", c("p_type"))
        if name == "P2":
            return _facts(t("part"), 6, c("p_partkey"), _tag("part", "p_partkey"), "madeof", c("p_brand"))
        if name == "P3":
            return _facts(t("part"), 7, c("p_partkey"), _tag("part", "p_partkey"), "size", _size())
        if name == "O":
            return _facts(t("orders").join(t("customer"), c("o_custkey") == c("c_custkey")), 8, c("o_orderkey"), _tag("order", "o_orderkey"), "partof", c("c_name"))
        if name == "O2":
            return _facts(t("orders"), 9, c("o_orderkey"), _tag("order", "o_orderkey"), "kind", c("o_orderpriority"))
        if name == "L":
            pairs = t("lineitem").select("l_orderkey", "l_partkey").distinct()
            return _facts(pairs, 10, c("l_orderkey") * 10**8 + c("l_partkey"), _tag("order", "l_orderkey"), "has", _tag("part", "l_partkey"))
        if name == "E":
            after = F.lead("event_id").over(W.partitionBy("user_id").orderBy("ts", "event_id"))
            return _facts(t("events").select("event_id", after.alias("next")).where("next IS NOT NULL"), 11, c("event_id"), _tag("e", "event_id"), "causes", _tag("e", "next"))
        if name == "NEG":
            some = t("part").where("p_partkey % 23 = 0").groupBy("p_type", "p_brand").agg(F.min("p_partkey").alias("k"))
            return _facts(some, 12, c("k"), c("p_type"), "not_madeof", c("p_brand"))
        if name == "C50":
            moved = t("customer").where("c_custkey % 50 = 0").withColumn("n", (c("c_nationkey") + 1) % 25)
            return _facts(moved.join(F.broadcast(t("nation")), c("n") == c("n_nationkey")), 13, c("c_custkey"), c("c_name"), "locatedin", c("n_name"))
        if name == "D40":
            return _facts(t("part").where("p_partkey % 40 = 0"), 14, c("p_partkey"), _tag("part", "p_partkey"), "not_madeof", c("p_brand"))
        raise ValueError(f"no such view: {name}")

    return reduce(DataFrame.unionByName, map(one, names))


def provenance(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    """(s, r, o, source, confidence, count, last_seen) of facts; all follow from the key."""
    k = F.pmod("seq", F.lit(STEP))
    source = F.element_at(F.array(F.lit("user"), F.lit("external"), F.lit("induced")), (k % 3 + 1).cast("int"))
    return facts(spark, sf_dir, *names).select("s", "r", "o", source.alias("source"), F.least(F.lit(1.0), F.lit(0.05) + (k % 20) / 20).alias("confidence"), (1 + k % 4).cast("long").alias("count"), (k % 1000).cast("double").alias("last_seen"))


def beliefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(b, s, r, o): what suppliers hold of parts; rows are dealt once, by subject, to tasks of so many rows."""
    lines, supplier = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    rows = lines.join(scratch.near(supplier), F.col("l_suppkey") == F.col("s_suppkey"))
    held = rows.select(F.lower("s_name").alias("b"), _tag("part", "l_partkey").alias("s"), F.lit("madeof").alias("r"), F.concat(F.lit("brand#"), ((F.col("l_partkey") + F.col("l_suppkey")) % 25 + 1).cast("string")).alias("o"))
    return held.repartition(scratch.shares(spark, lines.count()), "s").distinct()


def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, ts, subject, relation, state, symbol, score) of queries, from events."""
    v = F.col("value")
    state = F.when(v > 150, "known").when(v > 60, "ambiguous").otherwise("idk")
    symbol = F.get_json_object("props", "$.k").cast("int") % 3
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "ts", _tag("user", "user_id").alias("subject"), F.col("event_type").alias("relation"), state.alias("state"), symbol.cast("string").alias("symbol"), (v / 500).alias("score"))
