"""Text pairs of several tasks from facts, in an order from easy to hard."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.ranks import numbered
from ..sources import scratch

#: How hard tasks are, and relations of the forms of questions.
DIFFICULTY = {"fill_blank": 0.1, "boolean": 0.2, "qa": 0.3, "honest_no": 0.4, "paraphrase": 0.5, "summarize": 0.8, "contrast": 0.9}
BACKWARD = ("capital", "wrote", "founder", "author", "composed", "painted", "invented", "founded")
KINDS, OWNED = ("isa", "kind", "category"), ("has", "capital", "located_in", "locatedin")
#: Ways to say a fact (s, r, o), of which paraphrases are made, and how many of a fact.
PHRASES = ("the {r} of {s} is {o}.", "{s} {r} {o}.", "{s} has {r} {o}.", "{o} is the {r} of {s}.")
PARAPHRASES = 3
#: One fact of so many has a pair that admits ignorance; facts that a summary has; pairs are scored by so many words.
HONEST, SUMMED, LONGEST, TIERS = 16, 3, 256, 4


def _say(shape: str, **parts: Column) -> Column:
    """A text with columns in the places of names in braces."""
    out = []
    for piece in shape.split("{"):
        name, closed, rest = piece.partition("}")
        out += [parts[name], F.lit(rest)] if closed else [F.lit(piece)]
    return F.concat(*out)


def _plain(c: str) -> Column:
    return F.replace(F.col(c), F.lit("_"), F.lit(" "))


def _each(facts: DataFrame) -> DataFrame:
    """(part, seq, k, task, draft, target): the pairs of single facts."""
    own = {"s": _plain("s"), "r": _plain("r"), "o": _plain("o")}
    say = lambda shape: _say(shape, **own)
    start = F.pmod(F.length("s") + F.length("o"), F.lit(len(PHRASES)))
    said = F.array(*map(say, PHRASES))
    at = lambda k: F.get(said, F.pmod(start + k, F.lit(len(PHRASES))))
    pair = lambda task, draft, target, when=None: F.when(F.lit(True) if when is None else when, F.struct(F.lit(task).alias("task"), draft.alias("draft"), target.alias("target")))
    r = F.col("r")
    pairs = [pair("paraphrase", at(2 * k), at(2 * k + 1 + k // 2)) for k in range(PARAPHRASES)] + [
        pair("qa", say("what is the {r} of {s}?"), say("the {r} of {s} is {o}.")), pair("qa", say("who or what is the {r} associated with {o}?"), say("{o} is associated with {s} via {r}."), r.isin(*BACKWARD)),
        pair("fill_blank", say("the {r} of {s} is ___."), own["o"]), pair("boolean", say("is {s} a {o}?"), say("yes, {s} is a {o}."), r.isin(*KINDS)), pair("boolean", say("is {s} {o}?"), say("yes, {s} is {o}."), r == "color"),
        pair("boolean", say("does {s} have {r} of {o}?"), say("yes, {s} {r} {o}."), r.isin(*OWNED)),
        pair("honest_no", say("what is the favourite colour of {s}?"), say("I don't have any record of the favourite colour of {s}."), F.pmod("seq", F.lit(HONEST)) == 0),
    ]
    return facts.select(F.lit(0).alias("part"), "seq", F.posexplode(F.array(*pairs)).alias("k", "x")).where("x IS NOT NULL").select("part", "seq", "k", "x.*")


def _summaries(facts: DataFrame) -> DataFrame:
    """A pair for each subject of two facts or more, of its first ones; at most ``SUMMED`` rows of a subject are moved."""
    first = facts.withColumn("n", F.row_number().over(W.partitionBy("s").orderBy("seq"))).where(F.col("n") <= SUMMED)
    own = {"s": _plain("s"), "r": _plain("r"), "o": _plain("o")}
    rows = first.groupBy("s").agg(F.min("seq").alias("seq"), F.array_sort(F.collect_list(F.struct("n", _say("{s} {r} {o}.", **own).alias("said"), _say("{r} {o}", **own).alias("part")))).alias("x")).where(F.size("x") > 1)
    draft = F.array_join(F.transform("x", lambda e: e["said"]), " ")
    target = F.concat(_plain("s"), F.lit(" has "), F.array_join(F.transform("x", lambda e: e["part"]), ", "), F.lit("."))
    return rows.select(F.lit(1).alias("part"), "seq", F.lit(0).alias("k"), F.lit("summarize").alias("task"), draft.alias("draft"), target.alias("target"))


def _contrasts(facts: DataFrame) -> DataFrame:
    """A pair for each two facts in a row of a relation whose objects differ; places within relations come from ranges, so none is one task's."""
    placed = scratch.keep(numbered(facts.select("r", "seq", "s", "o"), "r", "seq", "s", "o"), "places")
    begins = scratch.near(scratch.keep(placed.groupBy("r").agg(F.min("place").alias("begin")), "begins"))
    rank = F.col("place") - F.col("begin")
    sides = placed.join(begins, "r").select("r", F.floor(rank / 2).alias("pair"), F.struct((rank % 2).alias("n"), "seq", "s", "o").alias("x"))
    two = sides.groupBy("r", "pair").agg(F.array_sort(F.collect_list("x")).alias("x")).where(F.size("x") == 2)
    a, b = F.col("x")[0], F.col("x")[1]
    clean = lambda c: F.replace(c, F.lit("_"), F.lit(" "))
    own = {"a": clean(a["s"]), "v": clean(a["o"]), "b": clean(b["s"]), "w": clean(b["o"]), "r": _plain("r")}
    return two.where(a["o"] != b["o"]).select(F.lit(2).alias("part"), a["seq"].alias("seq"), F.lit(0).alias("k"), F.lit("contrast").alias("task"), _say("{a} {r} {v}. {b} {r} {w}.", **own).alias("draft"), _say("unlike {a} which has {r} = {v}, {b} has {r} = {w}.", **own).alias("target"))


def pairs(facts: DataFrame) -> DataFrame:
    """(part, seq, k, task, draft, target) of facts (seq, s, r, o) with a seq each; denials give none."""
    own = scratch.keep(facts.where("NOT startswith(r, 'not_')").select("seq", "s", "r", "o"), "facts")
    return reduce(DataFrame.union, (_each(own), _summaries(own), _contrasts(own)))


def scored(rows: DataFrame) -> DataFrame:
    """Adds score and tier: half by words, half by the task."""
    hard = F.create_map(*[F.lit(x) for kv in DIFFICULTY.items() for x in kv])[F.col("task")]
    n = lambda c: F.size(F.filter(F.split(c, r"\s+"), lambda w: w != ""))
    score = F.least(F.lit(1.0), 0.5 * ((n("draft") + n("target")) / (2 * LONGEST)) + 0.5 * F.coalesce(hard, F.lit(0.5)))
    return rows.withColumn("score", score).withColumn("tier", F.least(F.lit(TIERS - 1), F.greatest(F.lit(0), F.floor(score * TIERS))).cast("int"))


def in_order(rows: DataFrame, *order: str) -> DataFrame:
    """(place, tier, review, task, draft, target): tiers one after the other, each in the given order, followed by a tenth of the tier before.

    Review rows are drawn at a stride, so a row knows by its rank in its tier whether
    and where it comes again; there is no sort of all rows in one task.
    """
    placed = scratch.keep(numbered(scored(rows), "tier", *order), "tiers")
    own = placed.groupBy("tier").agg(F.count("*").alias("n"), F.min("place").alias("begin"))
    all_ = placed.sparkSession.range(TIERS).select(F.col("id").cast("int").alias("tier")).join(own, "tier", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    w = W.orderBy("tier")  # a row for each tier
    after = F.when(F.col("tier") > 0, F.when(F.lag("n").over(w) > 0, F.least(F.greatest(F.lit(1), F.floor(F.col("n") / 10)), F.lag("n").over(w))))
    sizes = all_.withColumn("review", F.coalesce(after, F.lit(0))).withColumn("want", F.greatest(F.lit(1), F.floor(F.col("n") / 10)))
    sizes = sizes.withColumn("from", F.sum(F.col("n") + F.col("review")).over(w) - F.col("n") - F.col("review"))
    sizes = sizes.withColumn("again_from", F.lead("from").over(w) + F.lead("n").over(w)).withColumn("again", F.lead("want").over(w))
    sizes = scratch.keep(sizes.withColumn("stride", F.greatest(F.lit(1), F.floor(F.col("n") / F.col("again")))).drop("n"), "tier-sizes")
    at = placed.join(F.broadcast(sizes.drop("review")), "tier").withColumn("i", F.col("place") - F.col("begin"))
    comes = F.array(F.struct((F.col("from") + F.col("i")).alias("place"), F.lit(False).alias("review")), F.when((F.col("i") % F.col("stride") == 0) & (F.floor(F.col("i") / F.col("stride")) < F.col("again")), F.struct((F.col("again_from") + F.floor(F.col("i") / F.col("stride"))).alias("place"), F.lit(True).alias("review"))))
    return at.withColumn("x", F.explode(comes)).where("x IS NOT NULL").select(F.col("x.place").cast("long").alias("place"), "tier", "x.review", "task", "draft", "target")
