"""Approximate nearest neighbours by balanced posting lists.

A bounded sample is cut in halves again and again along the line between two
means, which gives lists of equal size; the means of the parts are the
centroids. A vector goes to the list of its nearest centroid, and near a border
also to the next ones, up to a ratio of the nearest distance. Centroids are found by best-first search in a graph of near centroids that is kept in
memory. A query visits the lists of its nearest centroids, and those farther than
a ratio of the nearest distance are pruned. How many it visits, and the ratio, are
raised until CHECKED queries, held against exact search over all vectors, find
RECALL of their neighbours. Within lists, inner products are exact.

Equal vectors are indexed once, as a class with its smallest ids: with k wanted,
only k + 1 of them can ever be among anyone's nearest. Lists and their queries
are dealt to blocks of bounded size, so no group of copies meets in one task.

Largest inner product is turned into least distance by one more coordinate that
brings all vectors to the same length.

Defined results: vectors that are null, empty, zero, of another than the most
frequent length, or that hold null or non-finite components take no part, as
queries or otherwise. Ties go to the smaller id. Of rows with the same id and
vector one takes part. Fewer rows than k give as many as there are. Other columns
are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import scratch

#: The bound of the sample that the centroids are fitted on.
SAMPLE_ROWS = 65_536
#: Vectors of a list, without copies at borders; at least SAMPLE_PER_LIST sampled rows make a centroid.
LIST_ROWS = 200
SAMPLE_PER_LIST = 8
#: A vector's lists: so many at most, and no farther than this ratio of the nearest.
COPIES, COPY_RATIO = 4, 1.25
#: A query's lists at first: so many at most, and no farther than this ratio of the nearest.
PROBES, PROBE_RATIO = 64, 1.3
#: Queries that are searched exactly too, and the share of their neighbours that the lists visited hold at least.
CHECKED, RECALL = 256, 0.93
#: Rows and queries of a block of a list.
BLOCK_ROWS, BLOCK_QUERIES = 4096, 2048
NEIGHBOURS, ENTRIES, BEAM_MORE = 24, 32, 32
SEARCH_ROWS = 512


def balanced_centroids(x: np.ndarray, lists: int, seed: int = 5) -> np.ndarray:
    """Means of parts that are halved until there are so many, the largest first."""
    rng = np.random.default_rng(seed)
    parts = [np.arange(len(x))]
    while len(parts) < min(lists, len(x)):
        parts.sort(key=len)
        own = parts.pop()
        y = x[own]
        a, b = y[rng.integers(len(y))], y[rng.integers(len(y))]
        for _ in range(6):
            side = y @ (b - a) > np.median(y @ (b - a))
            if side.all() or not side.any():
                break
            a, b = y[~side].mean(0), y[side].mean(0)
        order = np.argsort(y @ (b - a), kind="stable")
        parts += [own[order[: len(own) // 2]], own[order[len(own) // 2 :]]]
    return np.stack([x[p].mean(0) for p in parts]).astype(np.float32)


@dataclass
class Graph:
    """Centroids with links to near ones, and entries from which a search begins."""

    centroids: np.ndarray
    links: np.ndarray
    entries: np.ndarray

    @classmethod
    def build(cls, centroids: np.ndarray) -> Graph:
        n, sq = len(centroids), (centroids**2).sum(1)
        r = min(NEIGHBOURS, n - 1)
        links = np.zeros((n, r), np.int32)
        for i in range(0, n, 1024):
            d = sq - 2 * centroids[i : i + 1024] @ centroids.T
            d[np.arange(len(d)), np.arange(i, i + len(d))] = np.inf
            links[i : i + 1024] = np.argpartition(d, r - 1, axis=1)[:, :r] if r else 0
        return cls(centroids, links, np.linspace(0, n - 1, min(ENTRIES, n)).astype(np.int32))

    def search(self, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and squared distances of about the k nearest centroids, nearest first, for all rows at once."""
        n, rows = len(self.centroids), np.arange(len(q))[:, None]
        base = (q**2).sum(1)[:, None]
        if k >= n:
            d = np.maximum(base + (self.centroids**2).sum(1) - 2 * q @ self.centroids.T, 0)
            ids = np.argsort(d, axis=1, kind="stable")
            return ids, d[rows, ids]
        beam = min(n, k + BEAM_MORE)
        opened = max(2, k // 32)
        seen = np.zeros((len(q), n), bool)

        def far(ids: np.ndarray) -> np.ndarray:
            c = self.centroids[ids]
            return np.maximum(base + (c**2).sum(-1) - 2 * np.einsum("bd,bnd->bn", q, c), 0)

        ids = np.tile(self.entries, (len(q), 1))
        d = far(ids)
        seen[:, self.entries] = True
        done = np.zeros(ids.shape, bool)
        while True:
            order = np.argsort(d, axis=1)[:, :beam]
            ids, d, done = ids[rows, order], d[rows, order], done[rows, order]
            todo = np.where(done, np.inf, d)
            if self.links.shape[1] == 0 or not np.isfinite(todo).any():
                return ids[:, :k], d[:, :k]
            take = np.argsort(todo, axis=1)[:, :opened]
            open_ = np.isfinite(todo[rows, take])
            done[rows, take] = True
            new = np.where(open_[:, :, None], self.links[ids[rows, take]], -1).reshape(len(q), -1)
            new.sort(axis=1)
            fresh = (new >= 0) & ~seen[rows, new]
            fresh[:, 1:] &= new[:, 1:] != new[:, :-1]
            new[~fresh] = 0
            seen[np.nonzero(fresh)[0], new[fresh]] = True
            ids = np.concatenate([ids, new], 1)
            d = np.concatenate([d, np.where(fresh, far(new), np.inf)], 1)
            done = np.concatenate([done, ~fresh], 1)


def lists_of(graph: Graph, x: np.ndarray) -> list[np.ndarray]:
    """The lists that hold each vector."""
    return _close(graph, x, COPIES, COPY_RATIO)


def probes_of(graph: Graph, q: np.ndarray, probes: int = PROBES, ratio: float = PROBE_RATIO) -> list[np.ndarray]:
    """The lists that each query visits."""
    return _close(graph, q, probes, ratio)


def fitting_probes(graph: Graph, q: np.ndarray, held: list[list[list[int]]]) -> tuple[int, float, float]:
    """Probes and ratio with which the queries reach RECALL, and what they reach; held has the lists of each query's nearest."""
    n, probes = len(graph.centroids), PROBES
    total = sum(map(len, held))
    while True:
        for ratio in (PROBE_RATIO, PROBE_RATIO**2, float("inf")):
            visited = [set(p.tolist()) for p in probes_of(graph, q, probes, ratio)]
            hits = sum(not own.isdisjoint(lists) for own, near in zip(visited, held, strict=True) for lists in near)
            if hits >= RECALL * total:
                return probes, ratio, hits / max(1, total)
        if probes >= n:  # all lists are visited
            return probes, float("inf"), 1.0
        probes *= 2


def _close(graph: Graph, x: np.ndarray, k: int, ratio: float) -> list[np.ndarray]:
    out, rows = [], max(16, SEARCH_ROWS * PROBES // max(k, PROBES))
    for i in range(0, len(x), rows):
        ids, d = graph.search(x[i : i + rows], k)
        far = np.inf if ratio == np.inf else ratio**2 * d[:, :1] + 1e-12
        out += [a[ok] for a, ok in zip(ids, d <= far, strict=True)]
    return out


def _matrix(vectors: pa.Array, dim: int, lift: float = 0.0, query: bool = False) -> np.ndarray:
    """Rows with one more coordinate: 0 for queries, else what brings them to length ``lift``."""
    x = np.asarray(vectors.flatten()).reshape(-1, dim).astype(np.float32)
    last = np.zeros(len(x), np.float32) if query else np.sqrt(np.maximum(lift**2 - (x.astype(np.float64) ** 2).sum(1), 0)).astype(np.float32)
    return np.hstack([x, last[:, None]])


def _usable(vectors: DataFrame, id_col: str, vector: str) -> DataFrame:
    v = F.col(vector).cast("array<double>")
    ok = F.col(id_col).isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(v, lambda c: c != 0)
    return vectors.where(ok).select(F.col(id_col).alias("id"), F.col(vector).alias("v"))


def _exact(classes: DataFrame, asking: DataFrame, dim: int, k: int) -> tuple[pa.Table, DataFrame]:
    """CHECKED queries (cls, v) chosen by hash, and (query, cls) of the k nearest other classes of each, found among all."""
    some = asking.orderBy(F.xxhash64("cls", F.lit("checked"))).limit(CHECKED).select("cls", "v").toArrow()
    own = np.asarray(some["cls"]).astype(np.int64)
    q = classes.sparkSession.sparkContext.broadcast((own, np.asarray(some["v"].combine_chunks().flatten()).reshape(-1, dim).astype(np.float64)))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x = q.value
        cls, score = np.zeros((len(x), 0), np.int64), np.zeros((len(x), 0))
        for b in batches:
            y = np.asarray(b.column(1).flatten()).reshape(-1, dim).astype(np.float64)
            new = np.asarray(b.column(0))
            dots = np.where(new == ids[:, None], -np.inf, x @ y.T)
            cls, score = np.hstack([cls, np.tile(new, (len(x), 1))]), np.hstack([score, dots])
            m = min(k, score.shape[1])
            at = np.argpartition(-score, m - 1, axis=1)[:, :m] if m else np.zeros((len(x), 0), np.int64)
            cls, score = np.take_along_axis(cls, at, 1), np.take_along_axis(score, at, 1)
        ok = np.isfinite(score)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, cls.shape[1])[ok.ravel()]), pa.array(cls[ok]), pa.array(score[ok])], ["query", "cls", "score"])

    found = classes.select("cls", "v").mapInArrow(best, "query long, cls long, score double")
    rank = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "cls"))
    return some, found.withColumn("_r", rank).where(F.col("_r") <= k).select("query", "cls")


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score) of each query's k nearest others; is_query is a condition on column ``id``."""
    spark = vectors.sparkSession
    rows = _usable(vectors, id_col, vector)
    lengths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    if not lengths:
        empty = spark.createDataFrame([], "query_id long, rank int, id long, score double")
        return empty
    dim = lengths[0]["n"]
    rows = rows.where(F.size("v") == dim)
    first = F.dense_rank().over(W.partitionBy("v").orderBy("id"))
    some = rows.withColumn("_r", first).where(F.col("_r") <= k + 1)
    classes = scratch.keep(some.groupBy("v").agg(F.array_sort(F.collect_set("id")).alias("ids")).select(F.col("ids")[0].alias("cls"), "v", "ids"), "classes")
    members = rows.where(is_query).distinct().join(classes.select("cls", "v"), "v").select("id", "cls")
    members = scratch.keep(members, "members")
    stats = classes.agg(F.count("*").alias("n"), F.max(F.aggregate(F.col("v").cast("array<double>"), F.lit(0.0), lambda a, c: a + c * c)).alias("sq")).first()
    lift, n = float(np.sqrt(stats["sq"] or 0.0)), stats["n"]
    few = classes.orderBy(F.xxhash64("cls", F.lit("sample"))).limit(SAMPLE_ROWS).select("v").toArrow()["v"].combine_chunks()
    x = _matrix(few, dim, lift)
    graph = spark.sparkContext.broadcast(Graph.build(balanced_centroids(x, max(1, min(n // LIST_ROWS, len(x) // SAMPLE_PER_LIST)))))

    def dealt(find, query: bool):
        @F.arrow_udf("array<int>")
        def udf(v: pa.Array) -> pa.Array:
            got = find(graph.value, _matrix(v, dim, lift, query))
            return pa.array([g.tolist() for g in got], pa.list_(pa.int32()))

        return udf

    rows_in = scratch.keep(classes.select("cls", "v", F.explode(dealt(lists_of, False)("v")).alias("list")), "lists")
    asking = classes.join(members.select("cls").distinct(), "cls", "left_semi")
    some, exact = _exact(classes, asking, dim, k)
    held: dict[int, list[list[int]]] = {i: [] for i in some["cls"].to_pylist()}
    for r in rows_in.join(F.broadcast(exact), "cls").groupBy("query", "cls").agg(F.collect_list("list").alias("lists")).collect():  # k rows for each query checked
        held[r["query"]].append(r["lists"])
    probes, ratio, _ = fitting_probes(graph.value, _matrix(some["v"].combine_chunks(), dim, lift, True), list(held.values())) if held else (PROBES, PROBE_RATIO, 1.0)
    visit = partial(probes_of, probes=probes, ratio=ratio)
    asked = scratch.keep(asking.select(F.col("cls").alias("query"), F.col("v").alias("q"), F.explode(dealt(visit, True)("v")).alias("list")), "probes")
    parts = rows_in.groupBy("list").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("np"))
    qparts = asked.groupBy("list").agg(F.ceil(F.count("*") / BLOCK_QUERIES).cast("int").alias("nq"))
    sizes = F.broadcast(parts.join(qparts, "list"))  # a row for each centroid
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    left = asked.join(sizes, "list").withColumn("qpart", F.pmod(F.xxhash64("query"), F.col("nq")).cast("int")).withColumn("part", upto("np")).drop("np", "nq")
    right = rows_in.join(sizes, "list").withColumn("part", F.pmod(F.xxhash64("cls"), F.col("np")).cast("int")).withColumn("qpart", upto("nq")).drop("np", "nq")

    def block(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"query": [], "cls": [], "score": []})
        q, y = np.stack(a["q"].to_numpy()).astype(np.float64), np.stack(b["v"].to_numpy()).astype(np.float64)
        dots = q @ y.T
        m = min(k + 1, len(y))
        last = np.partition(dots, len(y) - m, axis=1)[:, len(y) - m]
        last -= 1e-12 * np.sqrt((q**2).sum(1) * (y**2).sum(1).max())  # the sums below may round otherwise
        own, at = np.nonzero(dots >= last[:, None])  # all that may tie with the last one
        score, cls = (q[own] * y[at]).sum(1), b["cls"].to_numpy()[at]
        order = np.lexsort((cls, -score, own))
        own, score, cls = own[order], score[order], cls[order]
        first = np.searchsorted(own, np.arange(len(q)))
        ok = np.arange(len(own)) - first[own] < m
        return pd.DataFrame({"query": a["query"].to_numpy()[own[ok]], "cls": cls[ok], "score": score[ok]})

    keys = ["list", "part", "qpart"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(block, "query long, cls long, score double")
    best = found.groupBy("query", "cls").agg(F.max("score").alias("score"))
    best = best.withColumn("_r", F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "cls"))).where(F.col("_r") <= k + 1)
    near = best.join(classes.select("cls", "ids"), "cls").groupBy("query").agg(F.collect_list(F.struct("score", "ids")).alias("near"))
    flat = F.flatten(F.transform("near", lambda c: F.transform(c["ids"], lambda i: F.struct((-c["score"]).alias("minus"), i.alias("id")))))
    near = near.select(F.col("query").alias("cls"), F.slice(F.array_sort(flat), 1, k + 1).alias("near"))
    out = members.join(near, "cls").select(F.col("id").alias("query_id"), F.posexplode(F.slice(F.filter("near", lambda c: c["id"] != F.col("id")), 1, k)).alias("pos", "hit"))
    return out.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("hit.id").alias("id"), (-F.col("hit.minus")).alias("score"))
