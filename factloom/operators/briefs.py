"""What is known of subjects, in tables and in paragraphs with sources.

Lists are cut by rank where they are made, so that a subject with very many facts,
children or mentions moves only what is shown.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import phrases, traits
from ..plans import ranks
from ..sources import scratch

#: Sections of an overview in order, and the relations of each; a relation that two have is the later one's.
SECTIONS = {
    "Identity": ("isa", "kind", "category", "role"),
    "Location": ("locatedin", "lives_in", "continent", "capital", "capital_of", "country", "near", "habitat", "origin"),
    "Properties": ("color", "size", "height_m", "length_km", "atomic_number", "symbol", "category", "kind", "state_at_room_temperature", "group", "period", "diet", "lifespan"),
    "Composition": ("madeof", "haspart", "partof", "has", "contains"),
    "Origin and history": ("founder", "founded", "founded_year", "wrote", "author", "composed", "painted", "invented", "directed", "century", "origin_country", "country"),
    "Activity": ("usedfor", "causes", "field", "works_at", "spoken_in", "language", "currency", "population_tier"),
    "Beliefs and culture": ("sacred_text", "religion", "cuisine"),
}
OTHER = len(SECTIONS)
#: How many of each are shown.
SENTENCES, SHOWN, SIBLINGS, PEERS, CHILDREN, MENTIONS, NAMED, CITED = 3, 5, 10, 20, 5, 12, 5, 12


def section(relation: Column) -> Column:
    """The place of a relation's section, from 0; other relations come last."""
    table = {r: k for k, rs in enumerate(SECTIONS.values()) for r in rs}
    return F.coalesce(traits.lookup(table, relation), F.lit(OTHER))


def _first(rows: DataFrame, n: int, by: list[str], *order) -> DataFrame:
    return rows.withColumn("n", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("n") <= n)


def _joined(rows: DataFrame, by: list[str], what: Column, sep: str, out: str, order: str = "n") -> DataFrame:
    return rows.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("k"), what.alias("x")))), lambda e: e["x"]), sep).alias(out))


def subjects(facts: DataFrame, records: DataFrame, episodes: DataFrame) -> DataFrame:
    """(s, n_facts, facts, denials, parents, siblings, sources, n_derived, n_asked) of every subject: counts of all, the first of each list.

    Siblings are the first children of a subject's parents, by name; each parent
    names at most ``PEERS``, so no pairs of children are made.
    """
    own = facts.groupBy("s", "r", "o").agg(F.min("seq").alias("seq"))
    negative = traits.is_negative(F.col("r"))
    n = own.groupBy("s").agg(F.count_if(~negative).alias("n_facts"))
    told = _joined(_first(own.where(~negative), SHOWN, ["s"], "seq"), ["s"], F.concat_ws("=", "r", "o"), ", ", "facts")
    denied = _joined(_first(own.where(negative), 3, ["s"], "seq"), ["s"], F.concat_ws("=", traits.denegate(F.col("r")), "o"), ", ", "denials")
    up = own.where("r = 'isa'").select("s", F.col("o").alias("parent"), "seq")
    parents = _joined(_first(up, SHOWN, ["s"], "seq"), ["s"], F.col("parent"), ", ", "parents")
    peers = _first(up.withColumnRenamed("s", "peer"), PEERS, ["parent"], "seq", "peer").select("parent", "peer")
    near = up.join(peers, "parent").where("s != peer").select("s", "peer").distinct()
    siblings = _joined(_first(near, SIBLINGS, ["s"], "peer"), ["s"], F.col("peer"), ", ", "siblings")
    kinds = records.groupBy("s", "source").agg(F.count("*").alias("m"))
    sources = _joined(kinds, ["s"], F.concat_ws(":", "source", F.col("m").cast("string")), ",", "sources", "source")
    derived = records.where(F.col("source").isin("induced", "rule")).groupBy("s").agg(F.count("*").alias("n_derived"))
    asked = episodes.groupBy(F.col("subject").alias("s")).agg(F.count("*").alias("n_asked"))
    out = reduce(lambda a, b: a.join(b, "s", "left"), (told, denied, parents, siblings, sources, derived, asked), n)
    return out.select("s", "n_facts", *[F.coalesce(c, F.lit("")).alias(c) for c in ("facts", "denials", "parents", "siblings", "sources")], *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_derived", "n_asked")])


def overviews(facts: DataFrame) -> DataFrame:
    """(s, overview): paragraphs by section, at most ``SENTENCES`` sentences each; denials are facts as others are."""
    own = facts.groupBy("s", "r", "o").agg(F.min("seq").alias("seq")).withColumn("section", section(F.col("r")))
    first = _first(own, SENTENCES, ["s", "section"], "seq")
    text = _joined(first, ["s", "section"], phrases.sentence(F.col("s"), F.col("r"), F.col("o")), " ", "text")
    return _joined(text, ["s"], phrases.plain(F.col("text")), "\n\n", "overview", "section")


def briefs(facts: DataFrame, records: DataFrame) -> DataFrame:
    """(topic, brief) of all subjects and objects: overview, classification, instances, what it is to others, and the sources of what is cited."""
    own = scratch.keep(facts.groupBy("s", "r", "o").agg(F.min("seq").alias("seq")), "facts")
    plain = phrases.plain
    outgoing = _first(own, SHOWN, ["s"], "seq").select(F.col("s").alias("topic"), F.lit(0).alias("part"), "s", "r", "o", "seq")
    parents = _first(own.where("r = 'isa'"), CHILDREN, ["s"], "seq").select(F.col("s").alias("topic"), F.lit(1).alias("part"), "s", "r", "o", "seq")
    children = _first(own.where("r = 'isa'"), CHILDREN, ["o"], "seq", "s").select(F.col("o").alias("topic"), F.lit(2).alias("part"), "s", "r", "o", "seq")
    mentions = _first(own, MENTIONS, ["o"], "seq", "s", "r").select(F.col("o").alias("topic"), F.lit(3).alias("part"), "s", "r", "o", "seq")
    t = plain(F.col("topic"))
    parts = [overviews(own).select(F.col("s").alias("topic"), F.lit(0).alias("part"), F.col("overview").alias("text"))]
    parts.append(_joined(parents, ["topic"], plain(F.col("o")), ", ", "x", "seq").select("topic", F.lit(1), F.concat(t, F.lit(" is classified as: "), "x")))
    parts.append(_joined(children.withColumn("k", F.struct("seq", "s")), ["topic"], plain(F.col("s")), ", ", "x", "k").select("topic", F.lit(2), F.concat(F.lit("Known instances or subtypes of "), t, F.lit(" include: "), "x", F.lit("."))))
    ranked = _first(mentions, NAMED, ["topic", "r"], "seq", "s").withColumn("k", F.struct("seq", "s"))
    named = ranked.groupBy("topic", "r").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", plain(F.col("s")).alias("x")))), lambda e: e["x"]), ", ").alias("x"), F.min("k").alias("k"))
    parts.append(_joined(named, ["topic"], F.concat(t, F.lit(" is the "), plain(F.col("r")), F.lit(" of "), "x", F.lit(".")), " ", "y", "k").select("topic", F.lit(3), "y"))
    best = records.groupBy("s", "r", "o").agg(F.max_by("source", F.struct("confidence", "source")).alias("source"))
    cited = reduce(DataFrame.union, (outgoing, parents, children, mentions)).join(best, ["s", "r", "o"])
    lines = _first(cited, CITED, ["topic"], "part", "seq", "s", "r", "o").withColumn("line", F.concat(F.lit("- ("), F.concat_ws(", ", "s", "r", "o"), F.lit(") source: "), "source"))
    parts.append(_joined(lines, ["topic"], F.col("line"), "\n", "x").select("topic", F.lit(4), F.concat(F.lit("Source provenance for facts cited above:\n"), "x")))
    heads = F.array(*map(F.lit, ("Overview", "Classification", "Instances", "Relations", "Citations")))
    all_ = reduce(DataFrame.union, parts).toDF("topic", "part", "text")
    body = _joined(all_, ["topic"], F.concat(F.lit("## "), F.get(heads, F.col("part")), F.lit("\n\n"), plain(F.col("text"))), "\n\n", "body", "part")
    return body.select("topic", F.concat(F.lit("# Research brief: "), F.initcap(t), F.lit("\n\n"), "body").alias("brief"))


#: An answer is a runner-up from this share of the best score on; candidates that are shown.
RATIO, CANDIDATES = 0.85, 4


def clarifications(answers: DataFrame, facts: DataFrame, turns: DataFrame) -> DataFrame:
    """(about, reason, candidates): what to ask back.

    Of answers (probe, value, score, rank) those with runners-up nearly as good; of
    facts the names of several kinds; of turns (conv, turn, entity, pronoun) those
    whose pronoun stands after two different things were named, the last two of them.
    """
    best = answers.where("rank = 1").select("probe", F.col("score").alias("top"))
    close = answers.where("rank <= 5").join(best, "probe").where((F.col("rank") == 1) | (F.col("score") >= RATIO * F.col("top")))
    many = close.groupBy("probe").agg(F.array_sort(F.collect_list(F.struct("rank", "value"))).alias("x")).where(F.size("x") > 1)
    one = many.select(F.col("probe").alias("about"), F.lit("similar_confidence").alias("reason"), F.array_join(F.transform(F.slice("x", 1, CANDIDATES), lambda e: e["value"]), ", ").alias("candidates"))
    kinds = _first(facts.where("r = 'isa'").groupBy("s", "o").agg(F.min("seq").alias("seq")), CANDIDATES, ["s"], "seq", "o")
    several = kinds.groupBy("s").agg(F.array_sort(F.collect_list(F.struct("n", F.concat("s", F.lit(" the "), "o").alias("x")))).alias("x")).where(F.size("x") > 1)
    two = several.select("s", F.lit("entity_polysemy"), F.array_join(F.transform("x", lambda e: e["x"]), ", "))
    spoken = ranks.carried(turns.select("conv", "turn", "entity", "pronoun"), "conv", "turn", {"last": "entity"})
    spoken = spoken.withColumn("was", F.when(F.col("entity") != F.col("last"), F.col("last")))
    open_ = ranks.carried(spoken, "conv", "turn", {"second": "was"}).where("pronoun AND second IS NOT NULL")
    three = open_.select(F.concat_ws(":", F.col("conv").cast("string"), F.col("turn").cast("string")), F.lit("pronoun_ambiguity"), F.concat_ws(", ", "last", "second"))
    return one.union(two).union(three)
