"""Tells and denials applied to a base and its records, many at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import traits
from ..plans.ranks import numbered
from ..sources import scratch
from . import derivations

TRIPLE = ["s", "r", "o"]


def applied(facts: DataFrame, records: DataFrame, tells: DataFrame) -> dict[str, DataFrame]:
    """``facts`` (seq, s, r, o) and ``records`` after tells (op, s, r, o, source, confidence, ts); op is tell or deny.

    A tell stores its fact and the inverse one, a denial the denied relation, each
    once: what is stored already is only reinforced, in its record. New facts follow
    all others in the order in which they were first told. A denial of a denial is
    one denial. Records of inverses aren't written; nothing told them.
    """
    rows = tells.select("op", *[F.lower(c).alias(c) for c in TRIPLE], "source", "confidence", "ts")
    rows = rows.withColumn("r", F.when(F.col("op") == "deny", traits.negate(F.col("r"))).otherwise(F.col("r"))).where("s IS NOT NULL AND r IS NOT NULL AND o IS NOT NULL")
    rows = scratch.keep(rows, "tells")
    back = traits.inverse(F.col("r"))
    turned = rows.where((F.col("op") == "tell") & back.isNotNull()).select(F.col("o").alias("s"), back.alias("r"), F.col("s").alias("o"), "ts", F.lit(1).alias("side"))
    first = rows.select(*TRIPLE, "ts", F.lit(0).alias("side")).union(turned).groupBy(*TRIPLE).agg(F.min(F.struct("ts", "side")).alias("at"))
    new = first.join(facts.select(*TRIPLE), TRIPLE, "left_anti").select(*TRIPLE, "at.ts", "at.side")
    last = facts.agg(F.coalesce(F.max("seq"), F.lit(-1)).alias("n")).first()["n"]
    placed = numbered(new, "ts", "side", *TRIPLE).select((F.col("place") + F.lit(last) + 1).alias("seq"), *TRIPLE)
    how = F.lit(None).cast("array<struct<s:string,r:string,o:string>>")
    old = records if "derivation" in records.columns else records.withColumn("derivation", how)
    return {"facts": facts.select("seq", *TRIPLE).union(placed), "records": derivations.recorded(old, rows.withColumn("derivation", how))}
