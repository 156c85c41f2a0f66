"""Pattern queries over facts (seq, s, r, o): many probes at once, ties broken by seq."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text, traits
from ..sources import scratch

ROLES = ("s", "r", "o")


def query(facts: DataFrame, probes: DataFrame, unknown: str, k: int | None = 3) -> DataFrame:
    """(probe, value, score, rank): the first k distinct values of a role for each probe.

    probes have a column ``probe`` and one for each known role; k None takes all.
    Without a known role each probe gets the first k values of all facts; all of them
    for all probes would be a cross product, so k must be given there.
    """
    known = [c for c in ROLES if c in probes.columns]
    if unknown in known:
        raise ValueError("the unknown role can't be known")
    if not known:
        if k is None:
            raise ValueError("probes without a known role need k")
        first = facts.groupBy(F.col(unknown).alias("value")).agg(F.min("seq").alias("seq")).orderBy("seq", "value").limit(k)
        ranked = first.select("value", F.row_number().over(W.orderBy("seq", "value")).alias("rank"))  # k rows
        return probes.select("probe").distinct().join(F.broadcast(ranked)).select("probe", "value", F.lit(1.0).alias("score"), "rank")
    hits = facts.join(probes, known)
    values = hits.groupBy("probe", F.col(unknown).alias("value")).agg(F.min("seq").alias("seq"))
    ranked = values.withColumn("rank", F.row_number().over(W.partitionBy("probe").orderBy("seq", "value")))
    if k is not None:
        ranked = ranked.where(F.col("rank") <= k)
    return ranked.select("probe", "value", F.lit(1.0).alias("score"), "rank")


def answers(facts: DataFrame) -> DataFrame:
    """(s, r, answer, n_values): the first object of each subject and relation."""
    return facts.groupBy("s", "r").agg(F.min_by("o", "seq").alias("answer"), F.count_distinct("o").alias("n_values"))


def subjects_of(facts: DataFrame, relation: str, value: str) -> DataFrame:
    return facts.where((F.col("r") == relation) & (F.col("o") == value)).select("s").distinct()


def epistemic(facts: DataFrame, probes: DataFrame, k: int = 5, least: float = 0.08, sure: float = 0.15, ratio: float = 0.85) -> DataFrame:
    """(probe, state, top, score, n_values) of probes (probe, s, r): known, ambiguous, or idk if there is nothing to say."""
    found = query(facts, probes, "o", k)
    best = found.groupBy("probe").agg(F.min_by("value", "rank").alias("top"), F.max("score").alias("score"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("second"), F.count("*").alias("n_values"))
    all_ = probes.select("probe").join(best, "probe", "left")
    score = F.coalesce("score", F.lit(0.0))
    state = F.when(score < least, "idk").when(F.col("second") >= ratio * score, "ambiguous").when(score < sure, "idk").otherwise("known")
    return all_.select("probe", state.alias("state"), F.when(state != "idk", F.col("top")).alias("top"), score.alias("score"), F.coalesce("n_values", F.lit(0)).alias("n_values"))


def calibrated(facts: DataFrame, provenance: DataFrame, probes: DataFrame, k: int = 3) -> DataFrame:
    """(probe, value, score, rank): scores weighted by the source of the fact, and by hops if it is induced."""
    near = query(facts, probes, "o", 2 * k).join(probes, "probe").withColumnRenamed("value", "o")
    known = near.join(provenance.select("s", "r", "o", "source", *([c for c in ("hops",) if c in provenance.columns])), ["s", "r", "o"], "left")
    hops = F.coalesce("hops", F.lit(1)) if "hops" in provenance.columns else F.lit(1)
    weight = F.when(F.col("source") == "induced", F.greatest(F.lit(0.5), F.pow(F.lit(0.9), hops))).otherwise(F.coalesce(traits.lookup(traits.SOURCE_WEIGHT, F.coalesce("source", F.lit(""))), F.lit(1.0)))
    scored = known.withColumn("score", F.col("score") * weight)
    out = scored.withColumn("place", F.row_number().over(W.partitionBy("probe").orderBy(F.desc("score"), "rank")))
    return out.where(F.col("place") <= k).select("probe", F.col("o").alias("value"), "score", F.col("place").alias("rank"))


def without_denied(facts: DataFrame) -> DataFrame:
    """Positive facts of which no denial is stored."""
    neg = facts.where(traits.is_negative(F.col("r"))).select("s", traits.denegate(F.col("r")).alias("r"), "o").distinct()
    return facts.where(~traits.is_negative(F.col("r"))).join(neg, ["s", "r", "o"], "left_anti")


def ancestors(facts: DataFrame, starts: DataFrame, depth: int, edges: tuple[str, ...] = traits.ANCESTOR_EDGES) -> DataFrame:
    """(s, ancestor, depth, seq): nearest first; each round looks only at what the one before has found anew, which is stored."""
    up = facts.where(F.col("r").isin(*edges)).groupBy(F.col("s").alias("node"), F.col("o").alias("next")).agg(F.min("seq").alias("step"))
    up = scratch.keep(up, "edges")
    seen = starts.select("s").distinct().select("s", F.col("s").alias("ancestor"), F.lit(0).alias("depth"), F.lit(0).cast("long").alias("seq"))
    front = seen = scratch.keep(seen, "front")
    for d in range(1, depth + 1):
        new = front.join(up, front["ancestor"] == up["node"]).select("s", F.col("next").alias("ancestor"), F.lit(d).alias("depth"), F.col("step").alias("seq"))
        front = scratch.keep(new.groupBy("s", "ancestor", "depth").agg(F.min("seq").alias("seq")).join(seen.select("s", "ancestor"), ["s", "ancestor"], "left_anti"), "front")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen.where("depth > 0")


def infer(facts: DataFrame, probes: DataFrame, depth: int = 3, inherit: tuple[str, ...] = traits.INHERITED, discount: float = 0.7) -> DataFrame:
    """(probe, answer, score, how): the subject's own answer, or else that of its nearest ancestor."""
    own = answers(facts).select("s", "r", "answer")
    direct = probes.join(own, ["s", "r"], "left")
    up = ancestors(facts, probes, depth).join(own.withColumnRenamed("s", "ancestor"), "ancestor").where(F.col("r").isin(*inherit))
    best = probes.join(up, ["s", "r"]).groupBy("probe").agg(F.min_by("answer", F.struct("depth", "seq", "ancestor")).alias("inherited"))
    out = direct.join(best, "probe", "left")
    how = F.when(F.col("answer").isNotNull(), "direct").when(F.col("inherited").isNotNull(), "inherited").otherwise("none")
    score = F.when(how == "direct", 1.0).when(how == "inherited", discount).otherwise(0.0)
    return out.select("probe", F.coalesce("answer", "inherited").alias("answer"), score.alias("score"), how.alias("how"))


def boolean(facts: DataFrame, probes: DataFrame, depth: int = 5) -> DataFrame:
    """(probe, verdict, how) of probes (probe, s, r, o): true, false or null.

    Steps are stored, each in tasks of so many rows, and what holds of a probe is
    gathered by one aggregate, so that no task sorts for several joins at once.
    """
    spark = probes.sparkSession
    with scratch.dealt(spark, facts.count()):
        probes = scratch.keep(probes, "probes")
    with scratch.dealt(spark, facts.count() + probes.count()):
        return scratch.keep(_boolean(facts, probes, depth), "verdicts")


def _boolean(facts: DataFrame, probes: DataFrame, depth: int) -> DataFrame:
    isa = probes.where(F.col("r").isin("isa", "kind", "category"))
    up = ancestors(facts, isa, depth, ("isa", "kind", "category")).select("s", F.col("ancestor").alias("o"))
    member = isa.join(up, ["s", "o"], "left_semi").select("probe", F.lit(0).alias("mark"))
    direct = probes.join(facts.select("s", "r", "o").distinct(), ["s", "r", "o"], "left_semi").select("probe", F.lit(1).alias("mark"))
    other = probes.where(F.col("r").isin(*traits.SINGLE_VALUED)).join(answers(facts).select("s", "r"), ["s", "r"], "left_semi").select("probe", F.lit(2).alias("mark"))
    first = scratch.keep(member.union(direct).union(other).groupBy("probe").agg(F.min("mark").alias("mark")), "marks")
    inferred = scratch.keep(infer(facts, probes.select("probe", "s", "r")).select("probe", F.col("answer").alias("inferred")), "inferred")
    out = probes.select("probe", "o").join(first, "probe", "left").join(inferred, "probe", "left")
    mark = F.col("mark")
    how = F.when(mark == 0, "isa-transitive").when(mark == 1, "direct").when(mark == 2, "contradicted").when(F.col("inferred") == F.col("o"), "inferred")
    return out.select("probe", F.when(how == "contradicted", False).when(how.isNotNull(), True).alias("verdict"), how.alias("how"))


def compare_sizes(facts: DataFrame, pairs: DataFrame, dimension: str = "size") -> DataFrame:
    """(a, b, winner) of pairs (a, b): the larger by the order of sizes, tie, or unknown."""
    size = answers(facts.where(F.col("r") == dimension)).select("s", traits.rank_in(traits.SIZES, F.col("answer")).alias("n"))
    both = pairs.join(size.select(F.col("s").alias("a"), F.col("n").alias("na")), "a", "left").join(size.select(F.col("s").alias("b"), F.col("n").alias("nb")), "b", "left")
    winner = F.when(F.col("na").isNull() | F.col("nb").isNull(), "unknown").when(F.col("na") > F.col("nb"), F.col("a")).when(F.col("na") < F.col("nb"), F.col("b")).otherwise("tie")
    return both.select("a", "b", winner.alias("winner"))


def numeric(facts: DataFrame, relation: str) -> DataFrame:
    """(s, value): objects that parse as numbers, the first of each subject."""
    return answers(facts.where(F.col("r") == relation)).select("s", text.number(F.col("answer")).alias("value")).where("value IS NOT NULL")


def threshold(facts: DataFrame, relation: str, op: str, bound: float) -> DataFrame:
    v = F.col("value")
    test = {">": v > bound, "<": v < bound, ">=": v >= bound, "<=": v <= bound, "==": v == bound}[op]
    return numeric(facts, relation).where(test)


def compare_numeric(facts: DataFrame, pairs: DataFrame, relation: str) -> DataFrame:
    """(a, b, value_a, value_b, winner) of pairs (a, b): the one with the larger number, tie, or unknown if either has none."""
    own = numeric(facts, relation)
    both = pairs.join(own.select(F.col("s").alias("a"), F.col("value").alias("value_a")), "a", "left").join(own.select(F.col("s").alias("b"), F.col("value").alias("value_b")), "b", "left")
    x, y = F.col("value_a"), F.col("value_b")
    winner = F.when(x.isNull() | y.isNull(), "unknown").when(x > y, F.col("a")).when(x < y, F.col("b")).otherwise("tie")
    return both.select("a", "b", "value_a", "value_b", winner.alias("winner"))


def compare_subjects(facts: DataFrame, pairs: DataFrame, most: int = 15) -> DataFrame:
    """(a, b, r, value_a, value_b, n) of pairs (a, b): the relations both have, by name and at most so many, with the last object of each."""
    last = facts.groupBy("s", "r").agg(F.max_by("o", "seq").alias("value"))
    both = pairs.join(last.select(F.col("s").alias("a"), "r", F.col("value").alias("value_a")), "a").join(last.select(F.col("s").alias("b"), "r", F.col("value").alias("value_b")), ["b", "r"])
    n = F.row_number().over(W.partitionBy("a", "b").orderBy("r"))
    return both.withColumn("n", n).where(F.col("n") <= most).select("a", "b", "r", "value_a", "value_b", "n")


def inside(facts: DataFrame, pairs: DataFrame, depth: int = 6, relation: str = "locatedin") -> DataFrame:
    """(contained, container, depth) of the pairs that hold."""
    up = ancestors(facts, pairs.select(F.col("contained").alias("s")), depth, (relation,))
    return pairs.join(up, (F.col("contained") == F.col("s")) & (F.col("container") == F.col("ancestor"))).select("contained", "container", "depth")


def direction(facts: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, direction): the first direction relation stored from a to b."""
    rank = traits.rank_in(traits.DIRECTIONS, F.col("r"))
    hits = pairs.join(facts.where(F.col("r").isin(*traits.DIRECTIONS)), (F.col("a") == F.col("s")) & (F.col("b") == F.col("o")))
    return hits.groupBy("a", "b").agg(F.min_by("r", rank).alias("direction"))


def canonical(name: Column, aliases: dict[str, str]) -> Column:
    """Lower case with _ for spaces, and the alias's entry if there is one."""
    plain = F.regexp_replace(F.lower(F.trim(name)), " ", "_")
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv]), plain), plain) if aliases else plain


def ambiguous_entities(facts: DataFrame, relation: str = "isa") -> DataFrame:
    """(s, n_parents) of subjects with two or more parents."""
    return facts.where(F.col("r") == relation).groupBy("s").agg(F.count_distinct("o").alias("n_parents")).where("n_parents >= 2")


def describe(facts: DataFrame, order: tuple[str, ...], most: int = 6) -> DataFrame:
    """(s, description): a sentence for each relation in the given order, at most so many."""
    rank = traits.rank_in(order, F.col("r"))
    said = answers(facts).withColumn("at", rank).where("at IS NOT NULL")
    said = said.withColumn("n", F.row_number().over(W.partitionBy("s").orderBy("at"))).where(F.col("n") <= most)
    line = F.concat(F.col("s"), F.lit(" "), F.col("r"), F.lit(" "), F.col("answer"), F.lit("."))
    return said.groupBy("s").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", line.alias("line")))), lambda x: x["line"]), " ").alias("description"))


def two_step(facts: DataFrame, first: str, second: str) -> DataFrame:
    """(s, middle, answer): "what is the second of the first of s"."""
    a = answers(facts)
    one = a.where(F.col("r") == first).select("s", F.col("answer").alias("middle"))
    two = a.where(F.col("r") == second).select(F.col("s").alias("middle"), "answer")
    return one.join(two, "middle").select("s", "middle", "answer")
