"""Calibration of scores against outcomes: samples (score, correct)."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import ranks
from ..plans.ranks import numbered
from ..sources import scratch


def category(score: Column, know: float = 0.20, think: float = 0.10, guess: float = 0.05) -> Column:
    return F.when(score >= know, "know").when(score >= think, "think").when(score >= guess, "guess").otherwise("none")


def tally(samples: DataFrame, *by: str) -> DataFrame:
    """(category, n_right, n_wrong), for each value of the columns ``by`` if there are any; over a stream these are running counts."""
    return samples.groupBy(*by, category(F.col("score")).alias("category")).agg(F.count_if("correct").alias("n_right"), F.count_if(~F.col("correct")).alias("n_wrong"))


def reliability(samples: DataFrame, key: str, bins: int = 10) -> DataFrame:
    """(bin, n, mean_score, accuracy, calibrated) over bins of equal counts, in the order of scores and then of key.

    The first bins take one sample more if counts can't be equal; calibrated is the
    probability that the isotonic steps of the same samples give the mean score.
    """
    places = ranks.numbered(samples.select("score", "correct", F.col(key).alias("_key")), "score", "_key")
    each, more = divmod(samples.count(), bins)
    at, head = F.col("place"), more * (each + 1)
    b = F.when(at < head, F.floor(at / (each + 1))).otherwise(more + F.floor((at - head) / max(each, 1))).cast("int")
    rows = places.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg("score").alias("mean_score"), F.avg(F.col("correct").cast("double")).alias("accuracy"))
    steps = isotonic(samples).join(F.broadcast(rows.select("bin", "mean_score")))  # a row for each bin
    above = F.when(F.col("upto") >= F.col("mean_score"), F.col("upto"))
    of = F.coalesce(F.min_by("probability", above), F.max_by("probability", "upto"))
    return rows.join(F.broadcast(steps.groupBy("bin").agg(of.alias("calibrated"))), "bin", "left")


def brier(samples: DataFrame) -> DataFrame:
    """(n, brier) of the step-rescaled scores."""
    s = F.col("score")
    p = F.when(s >= 0.30, 0.95).when(s >= 0.20, 0.90).when(s >= 0.10, 0.70).otherwise(3 * s)
    return samples.agg(F.count("*").alias("n"), F.avg(F.pow(p - F.col("correct").cast("double"), 2)).alias("brier"))


def _pooled(blocks: Iterable[tuple[float, float, float]]) -> list[tuple[float, float, float]]:
    """Blocks (upto, sum, weight) in order, each pooled with those before it while their mean is not below its own."""
    out: list[tuple[float, float, float]] = []
    for upto, total, n in blocks:
        while out and out[-1][1] * n >= total * out[-1][2]:
            _, t, m = out.pop()
            total, n = total + t, n + m
        out.append((upto, total, n))
    return out


def isotonic(samples: DataFrame, smoothing: float = 1.0) -> DataFrame:
    """(upto, probability, n): steps that rise with the score, by pooling adjacent violators.

    Equal scores are one block from the start. Blocks are smoothed by so many samples
    of either outcome, and pooled again where that breaks their order.
    """
    table = samples.groupBy("score").agg(F.sum(F.col("correct").cast("double")).alias("right"), F.count("*").cast("double").alias("n"))

    blocks = _flat(table.select(F.col("score").alias("upto"), F.col("right").alias("total"), "n"))
    smooth = blocks.select("upto", ((F.col("total") + smoothing) / (F.col("n") + 2 * smoothing) * F.col("n")).alias("total"), "n")
    return _flat(smooth).select("upto", (F.col("total") / F.col("n")).alias("probability"), "n")


#: Blocks that one task pools at once.
POOL = 10_000


def _flat(blocks: DataFrame) -> DataFrame:
    """Blocks (upto, total, n) pooled until their means rise.

    Blocks are numbered by ranges and pooled in groups of ``POOL``, whose borders move
    by half a group each round. When two rounds in a row have pooled nothing, no
    neighbours are left that should be pooled, so no task ever holds all blocks.
    """

    def pool(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(_pooled(rows.sort_values("upto")[["upto", "total", "n"]].itertuples(index=False)), columns=["upto", "total", "n"])

    blocks, still, k = scratch.keep(blocks, "blocks"), 0, 0
    n = blocks.count()
    while still < 2 and n > 1:
        group = F.floor((F.col("place") + k % 2 * (POOL // 2)) / POOL).alias("group")
        placed = numbered(blocks, "upto").select("upto", "total", "n", group)
        blocks = scratch.keep(placed.groupBy("group").applyInPandas(pool, "upto double, total double, n double"), "blocks")
        was, n = n, blocks.count()
        if k % 2 == 0 and was <= POOL:
            break  # all were in one group
        still, k = (still + 1 if was == n else 0), k + 1
    return blocks


def accuracy(samples: DataFrame, sure: float = 0.20) -> DataFrame:
    """(n, accuracy, confident_wrong)."""
    return samples.agg(F.count("*").alias("n"), F.avg(F.col("correct").cast("double")).alias("accuracy"), F.avg(((F.col("score") >= sure) & ~F.col("correct")).cast("double")).alias("confident_wrong"))


def hits(answers: DataFrame, expected: DataFrame, sure: float = 0.20) -> DataFrame:
    """(n, top1, top3, none, wrong_sure) of answers (probe, value, score, rank) to expected (probe, value), of which any may be right."""
    right = answers.join(expected.select("probe", "value").distinct(), ["probe", "value"], "left_semi").groupBy("probe").agg(F.min("rank").alias("at"))
    first = answers.where("rank = 1").select("probe", "score")
    rows = expected.select("probe").distinct().join(right, "probe", "left").join(first, "probe", "left")
    good = F.coalesce(F.col("at") == 1, F.lit(False))
    return rows.agg(F.count("*").alias("n"), F.count_if(good).alias("top1"), F.count_if(F.col("at") <= 3).alias("top3"), F.count_if(F.col("score").isNull()).alias("none"), F.count_if(~good & (F.col("score") >= sure)).alias("wrong_sure"))


def percentiles(rows: DataFrame, value: str, key: str, shares: tuple[float, ...] = (0.5, 0.95, 0.99, 1.0)) -> DataFrame:
    """(share, value): the value at place min(n - 1, floor(share * n)) of the sorted values; places come from ranges, not from one sorted task."""
    placed = scratch.keep(numbered(rows.select(value, key).where(F.col(value).isNotNull()), value, key), "values")
    n = placed.count()
    wanted = [(p, min(n - 1, int(p * n))) for p in shares] if n else []
    spark = rows.sparkSession
    return placed.join(F.broadcast(spark.createDataFrame(wanted, "share double, place long")), "place").select("share", F.col(value).alias("value"))
