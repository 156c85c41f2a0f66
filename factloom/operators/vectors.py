"""Vector algebra on arrays, in the JVM."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def bind(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x * y)


def binarize(a: Column) -> Column:
    return F.transform(a, lambda x: F.when(x >= 0, 1).otherwise(-1))


def permute(a: Column, n: int) -> Column:
    """Cyclic shift to the right."""
    k = F.pmod(F.lit(n), F.size(a))
    return F.when(k == 0, a).otherwise(F.concat(F.slice(a, F.size(a) - k + 1, k), F.slice(a, 1, F.size(a) - k)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 if either has no length."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n == 0, 0.0).otherwise(dot(a, b) / n)


def bundle(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, pos, total): sums by place, pre-aggregated before they move."""
    return rows.select(key, F.posexplode(vector).alias("pos", "x")).groupBy(key, "pos").agg(F.sum(F.col("x").cast("double")).alias("total"))


def bundles(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, bundle): summed vectors; a key has as many places as its vectors."""
    return bundle(rows, key, vector).groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "total"))), lambda p: p["total"]).alias("bundle"))


#: Queries and symbols that meet in one task.
QUERY_BLOCK, SYMBOL_BLOCK = 8192, 8192


def unbind(bound: Column, a: Column) -> Column:
    """The other factor of a binding of vectors of 1 and -1, which are their own inverses."""
    return bind(bound, a)


def seeded(symbol: Column, places: int, seed: int = 0) -> Column:
    """A vector of 1 and -1 that only symbol and seed decide."""
    return F.transform(F.sequence(F.lit(0), F.lit(places - 1)), lambda i: F.when(F.xxhash64(symbol, i, F.lit(seed)) % 2 == 0, 1).otherwise(-1))


def clean_up(queries: DataFrame, candidates: DataFrame, k: int = 3) -> DataFrame:
    """(query, symbol, score, rank) of queries (query, v) among candidates (symbol, w), by cosine; of equal scores the first symbol.

    Both sides are dealt to blocks of bounded size, so a codebook of any size will
    do; a pair of blocks gives k symbols at most for each query.
    """
    parts = [max(1, -(-df.count() // size)) for df, size in ((queries, QUERY_BLOCK), (candidates, SYMBOL_BLOCK))]
    own, other = (lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")), (lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    left = queries.select("query", F.col("v").cast("array<double>").alias("v"), own("query", parts[0]).alias("p"), other(parts[1]).alias("q"))
    right = candidates.select("symbol", F.col("w").cast("array<double>").alias("w"), other(parts[0]).alias("p"), own("symbol", parts[1]).alias("q"))

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"query": a["query"][:0], "symbol": b["symbol"][:0], "score": np.zeros(0)})
        x, y = (np.stack(c.to_numpy()).astype(np.float64) for c in (a["v"], b.sort_values("symbol")["w"]))
        n = np.sqrt((x**2).sum(1))[:, None] * np.sqrt((y**2).sum(1))
        score = np.divide(x @ y.T, n, out=np.zeros(n.shape), where=n > 0)
        at = np.argsort(-score.round(9), axis=1, kind="stable")[:, :k]  # symbols are in order
        symbols = b["symbol"].sort_values().to_numpy()
        return pd.DataFrame({"query": np.repeat(a["query"].to_numpy(), at.shape[1]), "symbol": symbols[at].ravel(), "score": np.take_along_axis(score, at, 1).ravel()})

    kinds = [f"{c} {df.schema[c].dataType.simpleString()}" for c, df in (("query", queries), ("symbol", candidates))]
    scored = left.groupBy("p", "q").cogroup(right.groupBy("p", "q")).applyInPandas(best, ", ".join([*kinds, "score double"]))
    return scored.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(F.desc(F.round("score", 9)), "symbol"))).where(F.col("rank") <= k)
