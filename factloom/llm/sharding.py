"""Sharding by rendezvous hashing.

Each shard draws a number from a record's key; the record goes to the shard with
the highest draw. With weights, a draw u in (0, 1) counts as -weight / ln(u), so
that shards get rows in proportion to weight. One more shard takes only the
records whose draw it wins; no record moves between the others.

A null key is a key like any other. Rows with equal keys get the same shard and
their own slots; equal rows are interchangeable. Shards may stay empty; an empty
table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Parts into which a shard's rows are dealt to number them; a fixed bound on what is broadcast: shards x parts rows.
SLOT_PARTS = 256
#: Equal rows that one array stands for at most.
RUN = 4096


def rendezvous(key: Column, weights: Sequence[float], seed: int = 0) -> Column:
    """The shard of a key: 0 to len(weights) - 1. Ties go to the later shard."""
    if not weights or any(not w > 0 for w in weights):
        raise ValueError("each shard needs a weight above 0")
    key = F.coalesce(key.cast("string"), F.lit("\0null"))
    draws = []
    for k, w in enumerate(weights):
        u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(seed), F.lit(k)), 11).cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))
        draws.append(F.struct((F.lit(-float(w)) / F.ln(u)).alias("draw"), F.lit(k).alias("shard")))
    return F.array_max(F.array(*draws))["shard"]


def with_slots(rows: DataFrame, shard: str, order: Sequence[str], slot: str = "slot") -> DataFrame:
    """Numbers the rows of each shard from 0 without gaps; rows are known by the columns of ``order`` alone.

    Equal rows are counted before they are moved. A shard's rows are dealt to parts
    by a hash of all their values; parts are numbered on their own, in the order
    of the values, and begin where those before end, so no shard and no group of
    copies meets in one task. Numbers depend on the values only.
    """
    part = F.pmod(F.xxhash64(*[F.col(c) for c in order], F.lit("slot")), F.lit(SLOT_PARTS))
    counted = rows.groupBy(shard, *[c for c in order if c != shard]).agg(F.count("*").alias("_n")).withColumn("_part", part)
    before = W.partitionBy(shard).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    begins = counted.groupBy(shard, "_part").agg(F.sum("_n").alias("_m")).select(shard, "_part", F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_begin"))
    own = W.partitionBy(shard, "_part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    placed = counted.withColumn("_at", F.coalesce(F.sum("_n").over(own), F.lit(0))).join(F.broadcast(begins), [shard, "_part"])
    runs = F.explode(F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / RUN)))
    each = placed.withColumn("_run", runs).withColumn("_copy", F.explode(F.sequence(F.col("_run") * RUN, F.least(F.col("_run") * RUN + RUN, "_n") - 1)))
    return each.withColumn(slot, (F.col("_begin") + F.col("_at") + F.col("_copy")).cast("long")).drop("_part", "_at", "_begin", "_n", "_run", "_copy")


def shard_documents(docs: DataFrame, weights: Sequence[float], grown: Sequence[float] | None = None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, size, text_crc32, shard, slot, grown_shard): only sizes and checksums of texts are moved."""
    rows = docs.select(
        F.col(id_col),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
        rendezvous(F.col(id_col), weights).alias("shard"),
        (rendezvous(F.col(id_col), grown) if grown else F.lit(None).cast("int")).alias("grown_shard"),
    )
    return with_slots(rows, "shard", [id_col, "text_crc32", "size", "grown_shard"])
