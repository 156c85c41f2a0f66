"""Scored search for chains: edges ranked once, a beam for each probe and round, bounds from what is found.

A path's cost is the sum of its links' negative log scores in millionths; its
confidence the geometric mean of the scores, less for each link after the first.
After each round a probe has at most ``width`` paths, so a search moves probes x
width x (edges of a node) rows a round, however many paths a hub has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources import scratch
from .derivations import LEAST_SCORE, UNIT, certainty

#: Digits to which confidences are compared.
DIGITS = 9


def priorities(skills: DataFrame) -> DataFrame:
    """(r, priority): relations by the successes and the rate of the skills (pattern, success, failure) that use them, in thousandths."""
    tried = F.greatest(F.col("success") + F.col("failure"), F.lit(1))
    weight = F.col("success") * F.greatest(F.col("success") / tried, F.lit(0.01))
    return skills.select(F.explode("pattern").alias("r"), F.round(1000 * weight).cast("long").alias("w")).groupBy("r").agg(F.sum("w").alias("priority"))


def edges(facts: DataFrame, records: DataFrame | None = None, beam: int = 4, least: float = 0.10, reverse: bool = False, skills: DataFrame | None = None) -> DataFrame:
    """(at, r, o, cost, priority): of each node and relation the ``beam`` surest links of at least a score; reverse ones as "~r".

    The rank doesn't depend on a search, so it is made once; the limit by rank is
    applied before rows are moved, so a hub's links don't meet in one task.
    """
    rows = facts.select("s", "r", "o").distinct()
    if records is None:
        rows = rows.withColumn("score", F.lit(1.0))
    else:
        own = records.groupBy("s", "r", "o").agg(F.max("confidence").alias("score"))
        rows = rows.join(own, ["s", "r", "o"], "left").withColumn("score", F.coalesce("score", F.lit(1.0)))
    rows = rows.where(F.col("score") >= least).select("s", "r", "o", F.round(-F.ln(F.greatest("score", F.lit(LEAST_SCORE))) * UNIT).cast("long").alias("cost"))
    ways = rows.select(F.col("s").alias("at"), "r", "o", "cost")
    if reverse:
        ways = scratch.keep(ways.union(rows.select("o", F.concat(F.lit("~"), "r"), "s", "cost")), "ways")
    ranked = ways.withColumn("n", F.row_number().over(W.partitionBy("at", "r").orderBy("cost", "o"))).where(F.col("n") <= beam).drop("n")
    if skills is not None:
        first = scratch.near(scratch.keep(priorities(skills), "priorities"))
        ranked = ranked.withColumn("plain", F.ltrim(F.col("r"), F.lit("~"))).join(first.withColumnRenamed("r", "plain"), "plain", "left").drop("plain")
    else:
        ranked = ranked.withColumn("priority", F.lit(None).cast("long"))
    return scratch.keep(ranked.select("at", "r", "o", "cost", F.coalesce("priority", F.lit(0)).cast("long").alias("priority")), "edges")


def _sure(hops: Column | int, cost: Column) -> Column:
    return F.round(certainty(F.lit(hops) if isinstance(hops, int) else hops, cost), DIGITS)


def beam_search(ways: DataFrame, probes: DataFrame, depth: int = 4, width: int = 16, top: int = 3) -> DataFrame:
    """(probe, relations, nodes, hops, confidence, rank) of probes (probe, start, goal) over ``edges``.

    Paths are simple and end at their goal. Of paths of a probe that reach a node
    after as many links, the best goes on; of those, the best ``width``. Links of
    useful relations come first among equals. A path goes on only if it can still
    beat the last of the ``top`` chains its probe has. Of chains with the same
    relations the best counts.
    """
    order = ["cost", F.desc("priority"), "relations", "nodes"]
    first = F.struct("cost", (-F.col("priority")).alias("p"), "relations", "nodes")
    rest = F.struct("cost", "priority", "relations", "nodes")
    none = F.array().cast("array<string>")
    zero = F.lit(0).cast("long")
    front = scratch.keep(probes.select("probe", F.lower("start").alias("at"), F.lower("goal").alias("goal"), zero.alias("cost"), zero.alias("priority"), none.alias("relations"), F.array(F.lower("start")).alias("nodes")), "front")
    found = None
    for k in range(1, depth + 1):
        grown = front.withColumnRenamed("cost", "c0").withColumnRenamed("priority", "p0").join(ways, "at").where(~F.array_contains("nodes", F.col("o")))
        grown = grown.select("probe", "goal", F.col("o").alias("at"), (F.col("c0") + F.col("cost")).alias("cost"), (F.col("p0") + F.col("priority")).alias("priority"), F.array_append("relations", F.col("r")).alias("relations"), F.array_append("nodes", F.col("o")).alias("nodes"))
        grown = scratch.keep(grown if k < depth else grown.where("at = goal"), "grown")  # what isn't there after the last link is nobody's
        hits = grown.where("at = goal").groupBy("probe", "relations").agg(F.min_by(F.struct("cost", "nodes"), F.struct("cost", "nodes")).alias("x"))
        hits = hits.select("probe", "relations", "x.nodes", F.lit(k).alias("hops"), "x.cost", _sure(k, F.col("x.cost")).alias("confidence"))
        found = scratch.keep((hits if found is None else found.unionByName(hits)).withColumn("rank", F.row_number().over(W.partitionBy("probe").orderBy(F.desc("confidence"), "hops", "relations"))).where(F.col("rank") <= top).drop("rank"), "found")
        if k == depth:
            break
        best = grown.where("at != goal").groupBy("probe", "goal", "at").agg(F.min_by(rest, first).alias("x")).select("probe", "goal", "at", "x.*")
        full = found.groupBy("probe").agg(F.min("confidence").alias("bar"), F.count("*").alias("n")).where(F.col("n") >= top).select("probe", "bar")
        reach = F.greatest(*[_sure(k + j, F.col("cost")) for j in range(1, depth - k + 1)], F.lit(0.0))
        alive = best.join(full, "probe", "left").where(F.col("bar").isNull() | (reach > F.col("bar"))).drop("bar")
        front = scratch.keep(alive.withColumn("n", F.row_number().over(W.partitionBy("probe").orderBy(*order))).where(F.col("n") <= width).drop("n"), "front")
        if front.isEmpty():
            break
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("probe").orderBy(F.desc("confidence"), "hops", "relations")))
    return ranked.select("probe", F.array_join("relations", ",").alias("relations"), F.array_join("nodes", ">").alias("nodes"), "hops", "confidence", "rank")


def follow(facts: DataFrame, starts: DataFrame, longest: int) -> DataFrame:
    """(id, answer) of starts (id, start, relations): the first answer of each link in turn; "~r" goes from object to subject."""
    ends = lambda a, b, r: facts.groupBy(F.col(a).alias("node"), r.alias("r")).agg(F.min_by(b, "seq").alias("next"))
    step = scratch.keep(ends("s", "o", F.col("r")).union(ends("o", "s", F.concat(F.lit("~"), F.col("r")))), "steps")
    at = starts.select("id", F.lower("start").alias("node"), "relations")
    done = None
    for k in range(1, longest + 1):
        due = at.where(F.size("relations") >= k).withColumn("r", F.element_at("relations", F.lit(k)))
        at = scratch.keep(due.join(step, ["node", "r"]).select("id", F.col("next").alias("node"), "relations"), "walk")
        over = at.where(F.size("relations") == k).select("id", F.col("node").alias("answer"))
        done = over if done is None else done.union(over)
    return done


def analogies(facts: DataFrame, probes: DataFrame, records: DataFrame, top: int = 3, sharpness: float = 4.0, depth: int = 3, least: float = 0.10) -> DataFrame:
    """(probe, relation, answer, probability, via) of probes (probe, a, b, c): "a is to b as c is to what".

    Relations from a to b are tried on c, surest first, and the probabilities of
    their answers are a softmax of both scores' product. If none links a and b, the
    best chain that does is followed from c; its probability is its confidence.
    """
    score = records.groupBy("s", "r", "o").agg(F.max("confidence").alias("score"))
    own = facts.groupBy("s", "r", "o").agg(F.min("seq").alias("seq")).join(score, ["s", "r", "o"], "left").withColumn("score", F.coalesce("score", F.lit(1.0)))
    own = scratch.keep(own, "scored")
    asked = probes.select("probe", *[F.lower(x).alias(x) for x in ("a", "b", "c")])
    ranked = own.withColumn("n", F.row_number().over(W.partitionBy("s", "r").orderBy("seq"))).where("n <= 3")
    links = asked.join(ranked, (F.col("a") == F.col("s")) & (F.col("b") == F.col("o"))).where(F.col("score") >= least).select("probe", "c", "r", F.col("score").alias("link"))
    links = scratch.keep(links.withColumn("n", F.row_number().over(W.partitionBy("probe").orderBy(F.desc("link"), "r"))).where(F.col("n") <= top), "links")
    first = own.groupBy(F.col("s").alias("c"), "r").agg(F.min_by(F.struct("o", "score"), "seq").alias("x")).select("c", "r", F.col("x.o").alias("answer"), F.col("x.score").alias("score"))
    tried = links.join(first, ["c", "r"]).withColumn("e", F.exp(sharpness * F.col("link") * F.col("score")))
    share = F.col("e") / F.sum("e").over(W.partitionBy("probe"))
    best = tried.withColumn("p", share).groupBy("probe").agg(F.min_by(F.struct(F.col("r").alias("relation"), "answer", F.col("p").alias("probability")), F.struct(-F.col("p"), F.col("n"))).alias("x")).select("probe", "x.*", F.lit("relation").alias("via"))
    rest = asked.join(links.select("probe").distinct(), "probe", "left_anti")
    chains = scratch.keep(beam_search(edges(facts, records, 3, least), rest.select("probe", F.col("a").alias("start"), F.col("b").alias("goal")), depth, top=1), "chains")
    shape = F.split("relations", ",")
    ends = follow(facts, chains.join(rest, "probe").select(F.col("probe").alias("id"), F.col("c").alias("start"), shape.alias("relations")), depth)
    far = chains.join(ends.withColumnRenamed("id", "probe"), "probe").select("probe", F.array_join(shape, " -> ").alias("relation"), "answer", F.col("confidence").alias("probability"), F.lit("chain").alias("via"))
    return best.unionByName(far)
