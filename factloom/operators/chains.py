"""Multi-hop chains: walks, discovery, closures, causes, analogy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import confidence as conf
from ..sources import scratch
from .pattern import answers


def walk(facts: DataFrame, starts: DataFrame, relations: list[str], directions: list[str] | None = None) -> DataFrame:
    """(start, answer, hops, confidence, hedge): follows the first answer of each hop, and stops where there is none.

    A direction is forward (s to o) or reverse (o to s).
    """
    directions = directions or ["forward"] * len(relations)
    if set(directions) - {"forward", "reverse"} or len(directions) != len(relations):
        raise ValueError("a direction is forward or reverse, one for each relation")
    at = starts.select("start").distinct().withColumn("node", F.lower("start")).withColumn("trace", F.array(F.col("node"))).withColumn("alive", F.lit(True))
    for r, way in zip(relations, directions, strict=True):
        own = facts.where(F.col("r") == r)
        step = own.groupBy(F.col("s" if way == "forward" else "o").alias("node")).agg(F.min_by("o" if way == "forward" else "s", "seq").alias("next"))
        at = at.join(step, "node", "left").select("start", F.coalesce(F.when(F.col("alive"), F.col("next")), "node").alias("node"), F.when(F.col("alive") & F.col("next").isNotNull(), F.concat("trace", F.array("next"))).otherwise(F.col("trace")).alias("trace"), (F.col("alive") & F.col("next").isNotNull()).alias("alive"))
    hops = F.size("trace") - 1
    c = F.when(F.col("alive"), conf.combine(F.array_repeat(F.lit(1.0), hops))).otherwise(0.0)
    return at.select("start", F.when(F.col("alive"), F.col("node")).alias("answer"), hops.cast("int").alias("hops"), c.alias("confidence"), F.when(F.col("alive"), conf.hedge(c)).otherwise("unknown").alias("hedge"), F.array_join("trace", ">").alias("trace"))


def discover(facts: DataFrame, probes: DataFrame, depth: int = 4, reverse: bool = False, top: int = 3) -> DataFrame:
    """(probe, relations, nodes, hops, confidence, rank) of probes (probe, start, goal): simple paths, shortest first.

    Paths grow once for each start, whatever its goals; a simple path ends at its
    goal, so paths that go on beyond a goal are other probes' only. Each depth is
    stored. Of paths with the same relations the first by nodes is kept.
    """
    edges = facts.select("s", "r", "o").distinct()
    if reverse:
        edges = edges.union(facts.select("o", F.concat(F.lit("~"), "r"), "s").distinct())
    edges = scratch.keep(edges.withColumnRenamed("s", "at"), "edges")
    asked = probes.select("probe", F.lower("start").alias("start"), F.col("goal").alias("at"))
    front = asked.select("start").distinct().select("start", F.col("start").alias("at"), F.array().cast("array<string>").alias("relations"), F.array("start").alias("nodes"))
    found = None
    for _ in range(depth):
        grown = front.join(edges, "at").where(~F.array_contains("nodes", F.col("o")))
        front = scratch.keep(grown.select("start", F.col("o").alias("at"), F.concat("relations", F.array("r")).alias("relations"), F.concat("nodes", F.array("o")).alias("nodes")), "paths")
        found = front if found is None else found.unionByName(front)
        if front.isEmpty():
            break
    one = asked.join(found, ["start", "at"]).groupBy("probe", "relations").agg(F.min("nodes").alias("nodes")).withColumn("hops", F.size("relations"))
    ranked = one.withColumn("rank", F.row_number().over(W.partitionBy("probe").orderBy("hops", F.array_join("relations", ","))))
    return ranked.where(F.col("rank") <= top).select("probe", F.array_join("relations", ",").alias("relations"), F.array_join("nodes", ">").alias("nodes"), "hops", conf.combine(F.array_repeat(F.lit(1.0), F.col("hops"))).alias("confidence"), "rank")


def nearest_goal(facts: DataFrame, starts: DataFrame, goal: Column, depth: int = 4) -> DataFrame:
    """(start, node, hops): the nodes of least distance from each start that meet a condition on column ``node``; any expression or UDF will do."""
    step = scratch.keep(facts.select(F.col("s").alias("node"), F.col("o").alias("next")).distinct(), "edges")
    front = scratch.keep(starts.select("start").distinct().select("start", F.lower("start").alias("node"), F.lit(0).alias("hops")), "front")
    seen, found = front, None
    for d in range(1, depth + 1):
        new = front.join(step, "node").select("start", F.col("next").alias("node")).distinct().join(seen.select("start", "node"), ["start", "node"], "left_anti")
        reached = scratch.keep(new.select("start", "node", F.lit(d).alias("hops"), goal.alias("goal")), "front")
        hits = reached.where("goal").drop("goal")
        found = hits if found is None else found.union(hits)
        front = reached.where("NOT goal OR goal IS NULL").drop("goal").join(hits.select("start").distinct(), "start", "left_anti")
        if front.isEmpty():
            break
        seen = seen.union(reached.drop("goal"))
    return found


def effects(facts: DataFrame, starts: DataFrame, depth: int = 3, relation: str = "causes", backward: bool = False) -> DataFrame:
    """(start, node, depth, score): what follows from each start, or what it follows from; the first visit counts."""
    a, b = ("o", "s") if backward else ("s", "o")
    step = scratch.keep(facts.where(F.col("r") == relation).select(F.col(a).alias("at"), F.col(b).alias("next")).distinct(), "edges")
    front = scratch.keep(starts.select("start").distinct().withColumn("at", F.col("start")), "front")
    seen = front.select("start", F.col("at").alias("node"), F.lit(0).alias("depth"))
    for d in range(1, depth + 1):
        new = front.join(step, "at").select("start", F.col("next").alias("at")).distinct()
        front = scratch.keep(new.join(seen.select("start", F.col("node").alias("at")), ["start", "at"], "left_anti"), "front")
        if front.isEmpty():
            break
        seen = seen.union(front.select("start", "at", F.lit(d)))
    return seen.where("depth > 0").withColumn("score", F.lit(1.0))


def siblings(facts: DataFrame, relation: str = "isa", most_children: int | None = None) -> DataFrame:
    """(s, sibling, n_shared) of subjects with a shared parent; parents of more children than most_children are left out, if it is given.

    Subjects with the same parents are one class, and shared parents are counted for
    pairs of classes, so that pairs of subjects, which are the result, are made last
    and never moved.
    """
    kids = facts.where(F.col("r") == relation).select("s", "o").distinct()
    if most_children is not None:
        kids = kids.join(kids.groupBy("o").count().where(F.col("count") <= most_children).select("o"), "o", "left_semi")
    own = scratch.keep(kids.groupBy("s").agg(F.array_sort(F.collect_list("o")).alias("set")), "parents")
    classes = scratch.keep(own.groupBy("set").agg(F.min("s").alias("c")), "classes")
    parts = classes.select("c", F.explode("set").alias("o"))
    shared = parts.join(parts.withColumnRenamed("c", "d"), "o").groupBy("c", "d").agg(F.count("*").alias("n_shared"))
    members = scratch.keep(own.join(scratch.near(classes), "set").select("s", "c"), "members")
    spread = members.repartition("s").join(scratch.near(scratch.keep(shared, "shared")), "c")  # a subject makes many pairs, so tasks share them
    return spread.join(scratch.near(members.select(F.col("s").alias("sibling"), F.col("c").alias("d"))), "d").where("s != sibling").select("s", "sibling", "n_shared")


def property_causes(facts: DataFrame, properties: DataFrame, top: int = 8) -> DataFrame:
    """(r, o, cause, score, rank) of properties (r, o): those that have it, and their isa-children at 0.8."""
    direct = facts.join(properties, ["r", "o"]).select("r", "o", F.col("s").alias("cause"), F.lit(1.0).alias("score"))
    kids = facts.where("r = 'isa'").select(F.col("s").alias("child"), F.col("o").alias("cause"))
    lifted = direct.join(kids, "cause").select("r", "o", F.col("child").alias("cause"), (F.col("score") * 0.8).alias("score"))
    best = direct.union(lifted).groupBy("r", "o", "cause").agg(F.max("score").alias("score"))
    return best.withColumn("rank", F.row_number().over(W.partitionBy("r", "o").orderBy(F.desc("score"), "cause"))).where(F.col("rank") <= top)


def analogy(facts: DataFrame, probes: DataFrame, k: int = 3) -> DataFrame:
    """(probe, relation, answer, probability) of probes (probe, a, b, c): "a is to b as c is to what"."""
    ranked = facts.groupBy("s", "r", "o").agg(F.min("seq").alias("seq")).withColumn("n", F.row_number().over(W.partitionBy("s", "r").orderBy("seq"))).where("n <= 3")
    links = probes.join(ranked, (F.col("a") == F.col("s")) & (F.col("b") == F.col("o"))).select("probe", "c", "r", "seq")
    links = links.withColumn("n", F.row_number().over(W.partitionBy("probe").orderBy("seq", "r"))).where(F.col("n") <= k)
    own = answers(facts).select(F.col("s").alias("c"), "r", "answer")
    joint = links.join(own, ["c", "r"]).withColumn("joint", F.lit(1.0))
    share = F.exp(4 * F.col("joint")) / F.sum(F.exp(4 * F.col("joint"))).over(W.partitionBy("probe"))
    return joint.withColumn("probability", share).groupBy("probe").agg(F.min_by(F.struct("r", "answer", "probability"), F.struct(-F.col("probability"), F.col("n"))).alias("x")).select("probe", F.col("x.r").alias("relation"), F.col("x.answer").alias("answer"), F.col("x.probability").alias("probability"))


def by_slots(lessons: DataFrame, asked: DataFrame) -> DataFrame:
    """(id, output, n_slots, n_known) of asked (id, place, slot, value): the outputs that lessons (seq, slot, value, output) give single slots, joined in order.

    The first lesson of a slot and value counts; slots without a lesson add nothing.
    """
    one = lessons.groupBy("slot", "value").agg(F.min_by("output", "seq").alias("output"))
    got = asked.join(one, ["slot", "value"], "left")
    parts = F.array_sort(F.collect_list(F.when(F.col("output").isNotNull(), F.struct("place", "output"))))
    return got.groupBy("id").agg(F.array_join(F.transform(parts, lambda x: x["output"]), "").alias("output"), F.count("*").alias("n_slots"), F.count("output").alias("n_known"))


def round_trip(facts: DataFrame, asked: DataFrame, k: int = 5) -> DataFrame:
    """(s, r, o, forward, reverse): 1 / rank of o among the first k objects, and of s among the first k subjects; 0 if beyond."""
    once = facts.groupBy("s", "r", "o").agg(F.min("seq").alias("seq"))
    f = once.withColumn("n", F.row_number().over(W.partitionBy("s", "r").orderBy("seq"))).where(F.col("n") <= k).select("s", "r", "o", (1 / F.col("n")).alias("forward"))
    b = once.withColumn("n", F.row_number().over(W.partitionBy("r", "o").orderBy("seq"))).where(F.col("n") <= k).select("s", "r", "o", (1 / F.col("n")).alias("reverse"))
    return asked.join(f, ["s", "r", "o"], "left").join(b, ["s", "r", "o"], "left").select("s", "r", "o", F.coalesce("forward", F.lit(0.0)).alias("forward"), F.coalesce("reverse", F.lit(0.0)).alias("reverse"))


def beliefs_and_truth(beliefs: DataFrame, facts: DataFrame) -> DataFrame:
    """(b, s, r, o, truth, agrees): what each believer holds beside the stored answer."""
    beliefs = scratch.keep(beliefs, "beliefs")
    beliefs = beliefs.repartition(scratch.shares(beliefs.sparkSession, beliefs.count()), "s", "r")
    return beliefs.join(answers(facts).select("s", "r", F.col("answer").alias("truth")), ["s", "r"], "left").select("b", "s", "r", "o", "truth", F.col("o").eqNullSafe(F.col("truth")).alias("agrees"))


def best_walk(facts: DataFrame, starts: DataFrame, candidates: list[list[str]]) -> DataFrame:
    """(start, answer, pattern, confidence): of several chains the surest that arrives; of equals the first given."""
    all_ = None
    for k, relations in enumerate(candidates):
        one = walk(facts, starts, relations).where("answer IS NOT NULL").select("start", "answer", "confidence", F.lit(k).alias("k"), F.lit(",".join(relations)).alias("pattern"))
        all_ = one if all_ is None else all_.union(one)
    best = F.min_by(F.struct("answer", "pattern", "confidence"), F.struct(-F.col("confidence"), F.col("k")))
    return all_.groupBy("start").agg(best.alias("x")).select("start", "x.answer", "x.pattern", "x.confidence")


def reached(facts: DataFrame, nodes: DataFrame, relation: str, value: str | None = None) -> DataFrame:
    """Nodes (column ``node``) that have the relation, or whose first answer to it is the value."""
    own = answers(facts.where(F.col("r") == relation))
    if value is not None:
        own = own.where(F.col("answer") == value)
    return nodes.join(own.select(F.col("s").alias("node")), "node", "left_semi")


def kinship(edges: DataFrame, labels: dict[str, tuple[int, int]]) -> DataFrame:
    """(path, up, down) of paths (path, step, relation): steps up and down in all; a step down after steps up turns them back no more.

    Steps up that follow steps down cancel them, as the child of a child's parent is a child.
    """
    table = F.create_map(*[F.lit(x) for k, (u, d) in labels.items() for x in (k, u * 1000 + d)])
    steps = edges.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("step", table[F.col("relation")].alias("c")))), lambda x: x["c"]).alias("cs"))
    start = F.struct(F.lit(0).alias("up"), F.lit(0).alias("down"))

    def fold(a, c):
        up, down = F.floor(c / 1000).cast("int"), (c % 1000).cast("int")
        back = F.least(a["down"], up)
        return F.struct((a["up"] + up - back).cast("int").alias("up"), (a["down"] - back + down).cast("int").alias("down"))

    return steps.select("path", F.aggregate("cs", start, fold).alias("x")).select("path", "x.up", "x.down")
