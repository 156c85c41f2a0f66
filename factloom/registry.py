"""All queries over the base tables, by name; their SQL is in oracle.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracle
from .functions import confidence, text, traits
from .operators import analytics, beliefs, calibrate, chains, derivations, derive, episodes, pattern, provenance, sets, upkeep, vectors
from .plans import star
from .sources import scratch, triples
from .streaming import twins

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    _QUERIES[f.__name__] = f
    return f


def queries() -> dict[str, Query]:
    return _QUERIES | {name: f for module in catalog() for name, f in module.QUERIES.items()}


def catalog() -> tuple:
    from .catalog import derivations as derived
    from .catalog import briefs, corpus, dialogue, intake, replay, search, streams, writing

    return (derived, replay, search, dialogue, streams, corpus, briefs, intake, writing)


def oracle_sql() -> dict[str, str]:
    return oracle.oracle_sql() | {name: sql for module in catalog() for name, sql in module.sql().items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chain_order_region(spark, sf_dir)


def _geo(spark: SparkSession, d: str) -> DataFrame:
    return star.facts(spark, d, "O", "C", "N")


def _r6(c):
    return F.round(c, 6)


# facts and sources


@query
def facts_all(spark, d):
    return analytics.relation_stats(star.facts(spark, d, "N", "C", "C2", "S", "P", "P2", "P3", "O", "O2", "L", "E", "NEG"))


@query
def symmetrise(spark, d):
    return derive.symmetrised(star.facts(spark, d, "N", "C", "P", "P2"))


@query
def forget_first(spark, d):
    f = star.facts(spark, d, "C", "C50")
    return sets.forget(f, star.facts(spark, d, "C").where("seq % 7 = 0").select("s", "r", "o")).select("s", "r", "o")


@query
def html_pages(spark, d):
    return star.table(spark, d, "pages").select("page_id", triples.html_text(F.col("html")).alias("text"))


@query
def open_extraction(spark, d):
    f = star.facts(spark, d, "N", "C", "S", "P", "P2", "P3").withColumn("s", text.symbol(F.col("s"))).withColumn("o", text.symbol(F.col("o")))
    r, k = F.col("r"), F.pmod("seq", F.lit(3))
    say = lambda *xs: F.concat(*[F.lit(x) if i % 2 == 0 else F.col(x) for i, x in enumerate(xs)])
    place = F.when(k == 0, say("The ", "s", " is located in ", "o", ".")).when(k == 1, say("", "s", " is in the ", "o")).otherwise(say("", "o", " is the ", "r", " of ", "s", "."))
    other = F.when(k == 0, say("The ", "r", " of ", "s", " is ", "o", ".")).otherwise(say("", "o", " is the ", "r", " of ", "s"))
    said = F.when(r == "locatedin", place).when(r == "isa", say("", "s", " is a ", "o", ".")).when(r == "madeof", say("", "s", " is made of ", "o", " .")).otherwise(other)
    rows = f.select("seq", said.alias("text"))
    return triples.extract_facts(rows, "text", "seq").withColumnRenamed("seq", "id")


@query
def corrections(spark, d):
    name = F.concat(F.lit("Part"), F.col("p_partkey").cast("string"))
    shapes = (("Actually, the ", " is good, not bad."), ("The price of ", " is high not low"), ("No ", " is good."), ("", " is actually a gear."), ("", " is good."))
    said = F.element_at(F.array(*[F.concat(F.lit(a), name, F.lit(b)) for a, b in shapes]), (F.col("p_partkey") % 5 + 1).cast("int"))
    return triples.corrections(star.table(spark, d, "part").select(said.alias("text")), "text")


@query
def log_fold(spark, d):
    log = star.facts(spark, d, "O")
    key = F.pmod("seq", F.lit(star.STEP))
    more = log.where(key % 7 == 0).select((F.col("seq") + 10 * star.STEP).alias("seq"), F.lit("forget").alias("op"), "s", "r", "o")
    return episodes.folded(log.select("seq", F.lit("store").alias("op"), "s", "r", "o").union(more))


@query
def training_corpus(spark, d):
    return triples.training_pairs(star.facts(spark, d, "P", "P2", "NEG"))


def _folder(spark, name: str) -> str:
    return scratch.place(spark, name)


@query
def jsonl_source(spark, d):
    path = _folder(spark, "jsonl")
    star.facts(spark, d, "C", "O").select(F.upper("s").alias("s"), "r", F.concat("o", F.lit(" ")).alias("o"), F.lit(1).alias("n")).write.json(path)
    return triples.read_jsonl(spark, path)


@query
def csv_source(spark, d):
    path = _folder(spark, "csv")
    star.facts(spark, d, "C", "O").select(F.upper("s").alias("s"), "r", F.when(F.pmod("seq", F.lit(5)) != 0, F.col("o")).alias("o")).write.option("header", True).csv(path)
    return triples.read_csv(spark, path)


@query
def graph_source(spark, d):
    path = _folder(spark, "graph")
    f = star.facts(spark, d, "P", "P2", "C", "C2").withColumn("s", text.symbol(F.col("s"))).withColumn("o", text.symbol(F.col("o")))
    rel = F.element_at(F.create_map(*[F.lit(x) for x in ("isa", "IsA", "madeof", "MadeOf", "locatedin", "AtLocation", "category", "ExternalURL")]), F.col("r"))
    lang = F.when(F.pmod("seq", F.lit(4)) == 0, "fr").otherwise("en")
    meta = F.concat(F.lit('{"weight": '), (F.pmod("seq", F.lit(6)) / 2).cast("string"), F.lit("}"))
    node = lambda l, c: F.concat(F.lit("/c/"), l, F.lit("/"), c, F.lit("/n"))
    line = F.concat_ws("\t", F.concat(F.lit("/a/"), F.col("seq").cast("string")), F.concat(F.lit("/r/"), rel), node(lang, F.col("s")), node(F.lit("en"), F.col("o")), meta)
    f.select(line).write.text(path)
    return triples.read_weighted_graph(spark, path)


@query
def text_source(spark, d):
    path = _folder(spark, "texts")
    p = star.table(spark, d, "nation")
    p.select(F.concat(F.lit("The home of "), text.symbol(F.lower("n_name")), F.lit(" is earth.\nno facts here")).alias("value"), "n_nationkey").repartition(5, "n_nationkey").select("value").write.text(path)
    found = triples.extract_facts(triples.read_texts(spark, f"{path}/*.txt").select("file", F.explode(F.split("text", "\n")).alias("line")), "line", "file")
    return found.select("s", "r", "o")


@query
def log_recovery(spark, d):
    """A snapshot of half the facts, and a log from before and after it."""
    path = _folder(spark, "log")
    f = star.facts(spark, d, "O")
    key = F.pmod("seq", F.lit(star.STEP))
    upto = 8 * star.STEP + 30_000
    more = f.where(key % 7 == 0).select((F.col("seq") + 10 * star.STEP).alias("seq"), F.lit("forget").alias("op"), "s", "r", "o")
    triples.write_log(f.select("seq", F.lit("store").alias("op"), "s", "r", "o").union(more), path)
    return triples.recover(f.where(F.col("seq") <= upto).select("s", "r", "o"), upto, triples.read_log(spark, path))


# patterns


@query
def pattern_unknown(spark, d):
    probes = star.facts(spark, d, "N").select(F.col("s").alias("probe"))
    return pattern.query(star.facts(spark, d, "C", "S"), probes, "o", 3)


@query
def compare_numbers(spark, d):
    p = star.table(spark, d, "part")
    key = lambda k: F.concat(F.lit("part#"), k.cast("string"))
    f = p.select(F.col("p_partkey").alias("seq"), key(F.col("p_partkey")).alias("s"), F.lit("length").alias("r"), F.format_number(F.col("p_size") * 1000, 0).alias("o"))
    return pattern.compare_numeric(f, p.select(key(F.col("p_partkey")).alias("a"), key(F.col("p_partkey") + 1).alias("b")), "length")


@query
def compare_pairs(spark, d):
    p = star.table(spark, d, "part")
    key = lambda k: F.concat(F.lit("part#"), k.cast("string"))
    return pattern.compare_subjects(star.facts(spark, d, "P", "P2", "P3"), p.select(key(F.col("p_partkey")).alias("a"), key(F.col("p_partkey") + 1).alias("b")))


@query
def pattern_point(spark, d):
    f = star.facts(spark, d, "O", "O2", "L")
    probes = star.facts(spark, d, "O").select(F.col("s").alias("probe"), "s", F.lit("has").alias("r"))
    return pattern.query(f, probes, "o", 3)


@query
def pattern_subjects(spark, d):
    f = star.facts(spark, d, "C", "S")
    probes = star.facts(spark, d, "N").select(F.col("s").alias("probe"), F.lit("locatedin").alias("r"), F.col("s").alias("o"))
    return pattern.query(f, probes, "s", 3)


@query
def answer_first(spark, d):
    return pattern.answers(star.facts(spark, d, "C", "C50", "L"))


@query
def epistemic_ask(spark, d):
    f = star.facts(spark, d, "C", "C50")
    probes = star.facts(spark, d, "C").select(F.col("s").alias("probe"), "s", "r").union(star.facts(spark, d, "S").select("s", "s", "r"))
    return pattern.epistemic(f, probes)


@query
def calibrated_ask(spark, d):
    names = ("C", "C50")
    probes = star.facts(spark, d, "C").select(F.col("s").alias("probe"), "s", "r")
    return pattern.calibrated(star.facts(spark, d, *names), star.provenance(spark, d, *names), probes).select("probe", "value", _r6("score").alias("score"), "rank")


@query
def denied_filter(spark, d):
    return pattern.without_denied(star.facts(spark, d, "P2", "D40")).select("s", "r", "o")


@query
def infer_inherited(spark, d):
    f = star.facts(spark, d, "O", "C", "N")
    probes = star.facts(spark, d, "O").select(F.concat("s", F.lit("/l")).alias("probe"), "s", F.lit("locatedin").alias("r"))
    return pattern.infer(f, probes)


@query
def boolean_verdict(spark, d):
    f = star.facts(spark, d, "P", "P2", "P3")
    own = star.facts(spark, d, "P", "P3")
    wrong = star.facts(spark, d, "P3").select("s", "r", F.lit("tiny").alias("o"))
    probes = own.select("s", "r", "o").union(wrong).distinct().select(F.concat_ws("|", "s", "r", "o").alias("probe"), "s", "r", "o")
    return pattern.boolean(f, probes)


@query
def compare_sizes(spark, d):
    p = star.table(spark, d, "part")
    pairs = p.select(F.concat(F.lit("part#"), F.col("p_partkey").cast("string")).alias("a"), F.concat(F.lit("part#"), (F.col("p_partkey") + 1).cast("string")).alias("b"))
    return pattern.compare_sizes(star.facts(spark, d, "P3"), pairs)


@query
def numeric_threshold(spark, d):
    p = star.table(spark, d, "part").select(F.col("p_partkey").alias("seq"), F.concat(F.lit("part#"), F.col("p_partkey").cast("string")).alias("s"), F.lit("length").alias("r"), F.format_number(F.col("p_size") * 1000, 0).alias("o"))
    return pattern.threshold(p, "length", ">=", 25000.0)


def _regions():
    """The keys of the five regions, each on a row of its own."""
    return F.explode(F.sequence(F.lit(0), F.lit(4))).alias("k")


def _region_names(spark, d):
    return star.table(spark, d, "region").select(F.col("r_regionkey").cast("int").alias("k"), F.lower("r_name").alias("container"))


@query
def containment(spark, d):
    f = star.facts(spark, d, "C", "N")
    pairs = star.facts(spark, d, "C").select(F.col("s").alias("contained"), _regions()).join(_region_names(spark, d), "k").select("contained", "container")
    return pattern.inside(f, pairs)


@query
def ambiguous_entities(spark, d):
    return pattern.ambiguous_entities(star.facts(spark, d, "C", "C50"), "locatedin")


@query
def describe_parts(spark, d):
    return pattern.describe(star.facts(spark, d, "P", "P2", "P3"), ("isa", "madeof", "size"))


@query
def two_step_question(spark, d):
    return pattern.two_step(star.facts(spark, d, "O", "C"), "partof", "locatedin")


@query
def canonical_names(spark, d):
    return star.table(spark, d, "nation").select("n_nationkey", pattern.canonical(F.concat(F.lit(" "), F.col("n_name"), F.lit(" Land ")), {"france_land": "fr"}).alias("name"))


# sets


def _constraints(spark, d):
    brand = star.table(spark, d, "part").select(F.lower("p_brand").alias("o")).distinct()
    a = brand.select(F.col("o").alias("group"), F.lit(1).alias("constraint"), F.lit("madeof").alias("r"), "o")
    return a, a.union(brand.select("o", F.lit(2), F.lit("size"), F.lit("large")))


@query
def set_intersect(spark, d):
    return sets.intersect(star.facts(spark, d, "P2", "P3"), _constraints(spark, d)[1]).select("group", "value", _r6("score").alias("score"))


@query
def set_union(spark, d):
    return sets.union(star.facts(spark, d, "P2", "P3"), _constraints(spark, d)[1])


@query
def set_difference(spark, d):
    a, both = _constraints(spark, d)
    return sets.difference(star.facts(spark, d, "P2", "P3"), a, both.where("constraint = 2"))


@query
def deduplicate(spark, d):
    f = star.facts(spark, d, "C").union(star.facts(spark, d, "C").where("seq % 3 = 0").withColumn("seq", F.col("seq") + star.STEP * 50))
    return sets.duplicates(f)[1].select("s", "r", "o")


@query
def base_diff(spark, d):
    return sets.diff(star.facts(spark, d, "C"), star.facts(spark, d, "C", "C50").where("seq % 5 != 0"))


@query
def base_merge(spark, d):
    return sets.merge(star.facts(spark, d, "C"), star.facts(spark, d, "C50", "C")).select("s", "r", "o")


@query
def provenance_merge(spark, d):
    a = star.provenance(spark, d, "C")
    b = star.provenance(spark, d, "C").where("count > 2").withColumn("source", F.lit("user"))
    return sets.merge_provenance(a, b).select("s", "r", "o", "source", _r6("confidence").alias("confidence"), "count", "last_seen")


# chains


@query
def chain_order_region(spark, d):
    f = _geo(spark, d)
    out = chains.walk(f, star.facts(spark, d, "O").select(F.col("s").alias("start")), ["partof", "locatedin", "locatedin"])
    return out.select("start", "answer", "hops", _r6("confidence").alias("confidence"), "hedge")


@query
def chain_reverse(spark, d):
    out = chains.walk(star.facts(spark, d, "C", "N"), star.facts(spark, d, "N").select(F.col("o").alias("start")), ["locatedin", "locatedin"], ["reverse", "reverse"])
    return out.select("start", "answer", "hops", "hedge")


@query
def discover_paths(spark, d):
    f = _geo(spark, d)
    o = star.facts(spark, d, "O").select(F.col("s").alias("start"), _regions()).join(_region_names(spark, d), "k").select("start", F.col("container").alias("goal"))
    probes = o.select(F.concat_ws(">", "start", "goal").alias("probe"), "start", "goal")
    return chains.discover(f, probes, depth=3).select("probe", "relations", "nodes", "hops", _r6("confidence").alias("confidence"), "rank")


@query
def discover_reverse(spark, d):
    f = star.facts(spark, d, "N", "S")
    n = star.facts(spark, d, "N").select("s", "o")
    pairs = n.join(n.select(F.col("s").alias("t"), "o"), "o").where("s != t")
    probes = pairs.select(F.concat_ws(">", "s", "t").alias("probe"), F.col("s").alias("start"), F.col("t").alias("goal"))
    return chains.discover(f, probes, depth=2, reverse=True).select("probe", "relations", "nodes", "hops", "rank")


@query
def custom_goal(spark, d):
    return chains.nearest_goal(_geo(spark, d), star.facts(spark, d, "O").select(F.col("s").alias("start")), F.col("node").startswith("a"))


@query
def slot_outputs(spark, d):
    p = star.table(spark, d, "part")
    values = F.array(F.struct(F.lit(1).alias("place"), F.lit("brand").alias("slot"), F.lower("p_brand").alias("value")), F.struct(F.lit(2).alias("place"), F.lit("size").alias("slot"), F.col("p_size").cast("string").alias("value")))
    asked = p.select(F.col("p_partkey").alias("id"), F.explode(values).alias("x")).select("id", "x.*")
    lessons = asked.where("slot = 'brand' OR CAST(value AS INT) % 2 = 0").select(F.col("id").alias("seq"), "slot", "value", F.concat(F.substring("slot", 1, 1), F.regexp_extract("value", r"(\d+)", 1)).alias("output"))
    return chains.by_slots(lessons, asked)


@query
def causal_effects(spark, d):
    e = star.facts(spark, d, "E")
    return chains.effects(e, e.select(F.col("s").alias("start")))


@query
def root_causes(spark, d):
    e = star.facts(spark, d, "E")
    return chains.effects(e, e.select(F.col("o").alias("start")), backward=True)


@query
def ancestor_closure(spark, d):
    f = _geo(spark, d)
    return pattern.ancestors(f, star.facts(spark, d, "O"), 3, ("partof", "locatedin")).select("s", "ancestor", "depth")


@query
def sibling_pairs(spark, d):
    return chains.siblings(star.facts(spark, d, "N", "S"), "locatedin")


@query
def property_search(spark, d):
    f = star.facts(spark, d, "P", "P2", "P3")
    return chains.property_causes(f, f.where("r != 'isa'").select("r", "o").distinct())


@query
def analogy_solve(spark, d):
    f = star.facts(spark, d, "P", "P2", "P3")
    p = star.table(spark, d, "part")
    key = lambda k: F.concat(F.lit("part#"), k.cast("string"))
    probes = p.select(F.col("p_partkey").alias("probe"), key(F.col("p_partkey")).alias("a"), F.lower("p_brand").alias("b"), key(F.col("p_partkey") + 1).alias("c"))
    return chains.analogy(f, probes).select("probe", "relation", "answer", _r6("probability").alias("probability"))


@query
def round_trip_check(spark, d):
    f = star.facts(spark, d, "L")
    return chains.round_trip(f, f.select("s", "r", "o")).select("s", "r", "o", _r6("forward").alias("forward"), _r6("reverse").alias("reverse"))


@query
def belief_truth(spark, d):
    return chains.beliefs_and_truth(star.beliefs(spark, d), star.facts(spark, d, "P2"))


# analytics


@query
def concept_density(spark, d):
    return analytics.density(star.facts(spark, d, "O", "O2", "L", "P", "NEG"))


@query
def relation_cooccurrence(spark, d):
    return analytics.cooccurrence(star.facts(spark, d, "O", "O2", "P2", "P3", "C", "C2")).withColumn("jaccard", _r6("jaccard"))


@query
def similar_entities(spark, d):
    return analytics.similar(star.facts(spark, d, "P2", "P3"), star.facts(spark, d, "P")).withColumn("jaccard", _r6("jaccard"))


@query
def subject_importance(spark, d):
    return analytics.importance(star.facts(spark, d, "O", "C", "N"), star.episodes(spark, d))


@query
def knowledge_gaps(spark, d):
    f = star.facts(spark, d, "P", "P2").union(star.facts(spark, d, "P3").where("seq % 3 != 0"))
    return analytics.gaps(f).withColumn("share", _r6("share"))


@query
def expected_relations(spark, d):
    f = star.facts(spark, d, "P", "P2").union(star.facts(spark, d, "P3").where("seq % 3 != 0"))
    return analytics.expectations(f).withColumn("agreement", _r6("agreement"))


@query
def abstraction(spark, d):
    return analytics.abstractions(star.facts(spark, d, "P", "P2", "P3"))


@query
def source_report(spark, d):
    return analytics.sources(star.provenance(spark, d, "C", "P")).select("source", "n", _r6("confidence").alias("confidence"), _r6("reinforcement").alias("reinforcement"))


@query
def subject_summaries(spark, d):
    return analytics.summaries(star.facts(spark, d, "P", "P2", "P3", "D40"))


@query
def shard_balance(spark, d):
    return analytics.shard_balance(star.facts(spark, d, "O", "C"), 16)


@query
def hot_keys(spark, d):
    return analytics.hot_keys(star.facts(spark, d, "L"))


@query
def shard_sizing(spark, d):
    return analytics.relation_stats(star.facts(spark, d, "O", "L", "C")).select("r", "n", analytics.recommend_shards(F.col("n")).alias("shards"))


@query
def active_learning(spark, d):
    f = star.facts(spark, d, "C", "P")
    return analytics.active_learning(f, star.provenance(spark, d, "C"), analytics.gaps(star.facts(spark, d, "P", "P2").where("seq % 3 != 0"))).withColumn("score", _r6("score"))


# beliefs and derivation


@query
def functional_conflicts(spark, d):
    return beliefs.functional_conflicts(star.facts(spark, d, "C", "C50"))


@query
def denial_conflicts(spark, d):
    return beliefs.denial_conflicts(star.facts(spark, d, "P2", "D40"))


@query
def conflict_resolution(spark, d):
    return beliefs.resolve(star.facts(spark, d, "C", "C50"), star.provenance(spark, d, "C", "C50"))


@query
def consensus(spark, d):
    b = star.beliefs(spark, d)
    return beliefs.majority(b.select(F.col("s").alias("probe"), F.col("b").alias("voter"), F.when(~F.col("o").endswith("5"), F.col("o")).alias("value"), F.lit(1.0).alias("score")))


@query
def induction_gates(spark, d):
    f = star.facts(spark, d, "O", "C", "N", "L", "P2")
    a = f.select(F.col("s").alias("n0"), F.col("r").alias("r1"), F.col("o").alias("n1"))
    b = f.select(F.col("s").alias("n1"), F.col("r").alias("r2"), F.col("o").alias("n2"))
    rows = a.join(b, "n1").select(F.array("r1", "r2").alias("relations"), F.array("n0", "n1", "n2").alias("nodes"), F.lit(0.95).alias("confidence"))
    return derive.gates(rows, f).groupBy(F.array_join("relations", ",").alias("relations"), "head", "verdict").agg(F.count("*").alias("n"))


@query
def cascade_induction(spark, d):
    return derive.cascade(star.facts(spark, d, "O", "C", "N")).select("s", "r", "o")


@query
def rule_instances(spark, d):
    return derive.instantiate(star.facts(spark, d, "O", "C", "N"), ["partof", "locatedin"], "locatedin")


@query
def negation_propagation(spark, d):
    return derive.propagate_negations(star.facts(spark, d, "P", "P2", "NEG"))


def _skills(spark, d):
    f = star.facts(spark, d, "O", "C", "N", "O2", "L", "P")
    a = f.select("s", F.col("r").alias("r1"), F.col("o").alias("m"), F.col("seq").alias("q"))
    both = a.join(f.select(F.col("s").alias("m"), F.col("r").alias("r2")), "m")
    return both.groupBy("r1", "r2").agg(F.count_if(F.col("q") % 4 != 0).alias("success"), F.count_if(F.col("q") % 4 == 0).alias("failure")).select(F.array("r1", "r2").alias("pattern"), "success", "failure")


def _flat(rules):
    return rules.select(F.array_join("body", ",").alias("body"), "head", "support", _r6("confidence").alias("confidence"))


@query
def rule_extraction(spark, d):
    return _flat(derive.extract_rules(_skills(spark, d)))


@query
def rule_composition(spark, d):
    return _flat(derive.compose_rules(derive.extract_rules(_skills(spark, d))))


def _long_skills(spark, d):
    """Skills of two and of three relations.

    Paths are counted, not made: links that end at a node times those that go on
    from it. Links that go on from no other's end are left out before.
    """
    f = star.facts(spark, d, "O", "C", "C2", "N", "L", "P", "P2")
    failed = F.pmod("seq", F.lit(9)) == 0
    ends = scratch.keep(f.groupBy(F.col("o").alias("n1"), F.col("r").alias("r1")).agg(F.count_if(~failed).alias("success"), F.count_if(failed).alias("failure")), "ends")
    inner = scratch.keep(f.select("s", "r", "o").join(ends.select(F.col("n1").alias("s")).distinct(), "s", "left_semi"), "inner")
    begins = inner.groupBy("s", "r").agg(F.count("*").alias("n"))
    one = begins.select(F.col("s").alias("n1"), F.col("r").alias("r2"), "n")
    links = inner.select(F.col("s").alias("n1"), F.col("r").alias("r2"), F.col("o").alias("s")).join(begins.withColumnRenamed("r", "r3"), "s")
    two = links.groupBy("n1", "r2", "r3").agg(F.sum("n").alias("n"))
    n = lambda rows, *rs: ends.join(rows, "n1").groupBy(F.array("r1", *rs).alias("pattern")).agg(*[F.sum(F.col(c) * F.col("n")).alias(c) for c in ("success", "failure")])
    return scratch.keep(n(one, "r2").union(n(two, "r2", "r3")), "skills")


@query
def skill_families(spark, d):
    return derive.skill_families(_long_skills(spark, d), 1)


@query
def skill_promotion(spark, d):
    return _flat(derive.promoted_families(_long_skills(spark, d)))


@query
def rules_merged(spark, d):
    return _flat(derive.merged_rules(derive.extract_rules(_skills(spark, d)).union(derive.promoted_families(_long_skills(spark, d)))))


@query
def rules_pruned(spark, d):
    tried = _skills(spark, d).withColumn("success", F.when(F.col("pattern")[0] == "has", F.lit(0)).otherwise(F.col("success")))
    return derive.pruned_rules(tried).select(F.array_join("pattern", ",").alias("pattern"), "success", "failure", _r6("running").alias("running"))


@query
def rule_rounds(spark, d):
    rules = [(["partof", "locatedin"], "locatedin"), (["locatedin", "locatedin"], "locatedin")]
    return derivations.rule_rounds(star.facts(spark, d, "O", "C", "N"), rules)


@query
def what_if(spark, d):
    extra = star.table(spark, d, "region").select(F.lower("r_name").alias("s"), F.lit("locatedin").alias("r"), F.lit("earth").alias("o"))
    return derive.what_changes(star.facts(spark, d, "C", "N"), extra)


@query
def branch_view(spark, d):
    c = star.facts(spark, d, "C")
    key = F.pmod("seq", F.lit(star.STEP))
    step = key.cast("long").alias("step")
    a = c.where(key % 4 == 0).select(F.lit("main").alias("branch"), step, F.lit("forget").alias("op"), "s", "r", "o")
    b = c.where(key % 8 == 0).select(F.lit("trial").alias("branch"), step, F.lit("store").alias("op"), "s", "r", "o")
    x = c.where(key % 5 == 0).select(F.lit("other").alias("branch"), step, F.lit("store").alias("op"), "s", "r", F.lit("nowhere").alias("o"))
    return derive.visible(c, a.union(b).union(x), ["main", "trial"])


# provenance


@query
def provenance_reinforced(spark, d):
    o = star.table(spark, d, "events")
    sights = o.select(F.concat(F.lit("user#"), F.col("user_id").cast("string")).alias("s"), F.lit("did").alias("r"), F.col("event_type").alias("o"), F.when(F.col("event_id") % 2 == 0, "user").otherwise("external").alias("source"), (F.col("value") / 1000).alias("confidence"), F.col("event_id").alias("ts"))
    return provenance.reinforced(sights).withColumn("confidence", _r6("confidence"))


@query
def pruned_facts(spark, d):
    return provenance.pruned(star.facts(spark, d, "C", "P", "P2"), star.provenance(spark, d, "C", "P", "P2"), least=0.5, few=2).select("s", "r", "o")


@query
def explain_tree(spark, d):
    e = star.facts(spark, d, "E")
    return provenance.explain(e.select(F.col("o").alias("fact"), F.col("s").alias("premise")), e.select(F.col("o").alias("root")))


# episodes


@query
def drift_events(spark, d):
    return episodes.drift(star.episodes(spark, d))


@query
def drift_flags(spark, d):
    return episodes.drifted(star.episodes(spark, d))


@query
def state_breakdown(spark, d):
    return episodes.states(star.episodes(spark, d))


@query
def hot_signatures(spark, d):
    return episodes.hot_signatures(star.episodes(spark, d))


@query
def episode_consolidation(spark, d):
    return episodes.consolidated(star.episodes(spark, d), stable=0.5).withColumn("share", _r6("share"))


@query
def last_episodes(spark, d):
    return episodes.last_of_each(star.episodes(spark, d), 2).select("id", "subject", "relation", "n")


@query
def episodes_between(spark, d):
    return episodes.in_window(star.episodes(spark, d), "2024-01-05", "2024-01-10").select("id", "state")


@query
def carried_context(spark, d):
    turns = star.table(spark, d, "conversations").withColumn("said", F.when(F.col("role") == "user", F.col("turn")))
    return episodes.carried(turns.select("conv_id", "turn", "role", "said").distinct(), "conv_id", "turn", "said")


@query
def ring_neighbours(spark, d):
    month = F.lower(F.date_format("o_orderdate", "MMMM"))
    o = star.table(spark, d, "orders").select("o_orderkey", month.alias("month"))
    return o.select("o_orderkey", "month", episodes.ring(F.col("month"), traits.MONTHS, -1).alias("before"), episodes.ring(F.col("month"), traits.MONTHS, 1).alias("after"))


@query
def ngram_successors(spark, d):
    return episodes.successors(star.table(spark, d, "documents"), "doc_id", F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9]+)"), F.lit(1)), 2, 2)


@query
def user_topics(spark, d):
    return episodes.user_topics(star.episodes(spark, d))


# calibration


def _samples(spark, d):
    docs = star.table(spark, d, "documents").select("doc_id", F.least(F.lit(1.0), F.col("n_chars") / 20000).alias("score"))
    return docs.join(star.table(spark, d, "labels"), "doc_id").select("doc_id", "score", (F.col("quality") == 1).alias("correct"))


@query
def calibration_tally(spark, d):
    return calibrate.tally(_samples(spark, d))


@query
def reliability(spark, d):
    out = calibrate.reliability(_samples(spark, d), "doc_id")
    return out.select("bin", "n", *[_r6(c).alias(c) for c in ("mean_score", "accuracy", "calibrated")])


@query
def brier_score(spark, d):
    return calibrate.brier(_samples(spark, d)).withColumn("brier", _r6("brier"))


@query
def answer_accuracy(spark, d):
    return calibrate.accuracy(_samples(spark, d)).select("n", _r6("accuracy").alias("accuracy"), _r6("confident_wrong").alias("confident_wrong"))


@query
def isotonic_steps(spark, d):
    return calibrate.isotonic(_samples(spark, d)).select(*[_r6(c).alias(c) for c in ("upto", "probability", "n")])


# text


@query
def tokenise(spark, d):
    return star.table(spark, d, "benchmark").select("item_id", F.array_join(text.tokens(F.col("text")), " ").alias("tokens"), F.size(text.sentences(F.col("text"))).alias("n_sentences"))


@query
def word_forms(spark, d):
    p = star.table(spark, d, "part").select("p_partkey", F.explode(F.split(F.lower("p_name"), " ")).alias("w"))
    return p.select("w").distinct().select("w", text.singular(F.concat("w", F.lit("s"))).alias("one"), text.singular(F.concat("w", F.lit("ies"))).alias("other"))


@query
def number_words(spark, d):
    rows = star.table(spark, d, "part").select("p_partkey", F.element_at(F.array(F.lit("1,234"), F.lit("twenty_five"), F.lit("two hundred"), F.lit("three thousand"), F.lit("12.5"), F.lit("blue")), (F.col("p_partkey") % 6 + 1).cast("int")).alias("said"))
    return rows.select("p_partkey", text.number(F.col("said")).alias("value"))


@query
def arithmetic(spark, d):
    op = F.element_at(F.array(*map(F.lit, "+-*/")), (F.col("p_partkey") % 4 + 1).cast("int"))
    rows = star.table(spark, d, "part").select("p_partkey", F.concat(F.lit("what is "), F.col("p_partkey").cast("string"), F.lit(" "), op, F.lit(" "), (F.col("p_size") % 3).cast("string"), F.lit("?")).alias("q"))
    return rows.select("p_partkey", _r6(text.arithmetic(F.col("q"))).alias("value"))


@query
def integer_math(spark, d):
    return star.table(spark, d, "part").select("p_partkey", text.is_prime(F.col("p_partkey")).alias("prime"), text.gcd(F.col("p_partkey"), F.lit(360)).alias("gcd"), text.lcm(F.col("p_partkey"), F.lit(360)).alias("lcm"))


@query
def negated_questions(spark, d):
    rows = star.facts(spark, d, "P").select("s", F.concat(F.lit("is "), "s", F.when(F.pmod("seq", F.lit(2)) == 0, F.lit(" not")).otherwise(""), F.lit(" a "), "o").alias("q"))
    return rows.select("s", text.has_negation(F.col("q")).alias("negated"), text.cache_key(text.strip_negation(F.col("q"))).alias("plain"))


@query
def relation_names(spark, d):
    r = star.facts(spark, d, "N", "C2", "P", "P2", "NEG").select("r").distinct()
    return r.select("r", traits.inverse(F.col("r")).alias("inverse"), traits.negate(F.col("r")).alias("negated"), traits.denegate(F.col("r")).alias("plain"))


@query
def chain_confidence(spark, d):
    rows = star.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list((F.col("l_discount") * 10 + 0.001))).alias("x"))
    c = {k: confidence.combine(F.col("x"), k) for k in ("product", "min", "geometric_mean")}
    return rows.select("l_orderkey", *[_r6(v).alias(k) for k, v in c.items()], confidence.hedge(c["product"]).alias("hedge"), confidence.weakest(F.col("x")).alias("weakest"))


# vectors


@query
def vector_bundles(spark, d):
    return vectors.bundle(star.table(spark, d, "embeddings"), "label", "embedding").select("label", "pos", F.round("total", 4).alias("total"))


@query
def vector_algebra(spark, d):
    e = star.table(spark, d, "embeddings")
    a = vectors.binarize(F.col("embedding"))
    b = vectors.permute(a, 3)
    agree = F.aggregate(vectors.bind(a, b), F.lit(0), lambda s, x: s + x)
    return e.select("vec_id", agree.alias("agreement"), _r6(vectors.cosine(F.col("embedding"), vectors.permute(F.col("embedding"), 1))).alias("turned"))


@query
def vector_clean_up(spark, d):
    e = star.table(spark, d, "embeddings")
    book = vectors.bundles(e, "label", "embedding").select(F.col("label").alias("symbol"), F.col("bundle").alias("w"))
    return vectors.clean_up(e.select(F.col("vec_id").alias("query"), F.col("embedding").alias("v")), book).withColumn("score", F.round("score", 5)).select("query", "symbol", "score", "rank")


# more of the same families


@query
def direction_lookup(spark, d):
    n = star.table(spark, d, "nation")
    east = n.select(F.col("n_nationkey").cast("long").alias("seq"), F.lower("n_name").alias("s"), F.when(F.col("n_nationkey") % 2 == 0, "east_of").otherwise("north_of").alias("r"), ((F.col("n_nationkey") + 1) % 25).alias("k"))
    f = east.join(F.broadcast(n.select(F.col("n_nationkey").alias("k"), F.lower("n_name").alias("o"))), "k").select("seq", "s", "r", "o")
    f = f.union(f.where("r = 'east_of'").select(F.col("seq") + 100, "s", F.lit("south_of"), "o"))
    return pattern.direction(f, f.select(F.col("s").alias("a"), F.col("o").alias("b")).distinct())


@query
def best_of_chains(spark, d):
    f = star.facts(spark, d, "O", "C", "N", "S")
    starts = star.facts(spark, d, "O", "S").select(F.col("s").alias("start"))
    return chains.best_walk(f, starts, [["partof", "locatedin", "locatedin"], ["locatedin"], ["partof", "locatedin"]]).withColumn("confidence", _r6("confidence"))


@query
def goal_reached(spark, d):
    f = star.facts(spark, d, "C", "C2")
    return chains.reached(f, f.select(F.col("s").alias("node")).distinct(), "category", "building")


@query
def kinship_paths(spark, d):
    o = star.table(spark, d, "orders").select(F.col("o_orderkey").alias("path"))
    names = F.array(F.lit("parent"), F.lit("child"), F.lit("sibling"))
    steps = o.select("path", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("step"))
    e = steps.select("path", "step", F.element_at(names, (F.floor(F.col("path") / F.pow(F.lit(3), F.col("step"))) % 3 + 1).cast("int")).alias("relation"))
    return chains.kinship(e, {"parent": (1, 0), "child": (0, 1), "sibling": (1, 1)})


@query
def skill_statistics(spark, d):
    return derive.skill_stats(_skills(spark, d)).withColumn("rate", _r6("rate"))


@query
def relation_priority(spark, d):
    return derive.relation_priority(_skills(spark, d))


@query
def rule_feedback(spark, d):
    return derive.laplace(_skills(spark, d)).select(F.array_join("pattern", ",").alias("pattern"), _r6("running").alias("running"))


@query
def state_histories(spark, d):
    return episodes.history(star.episodes(spark, d))


@query
def promoted_memories(spark, d):
    e = star.table(spark, d, "events")
    return episodes.promoted(e.select(F.when(F.col("event_id") % 2 == 0, "user").otherwise("agent").alias("actor"), F.when(F.col("event_id") % 3 == 0, "told").otherwise("seen").alias("kind"), F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("content")))


@query
def status_report(spark, d):
    return episodes.status(star.episodes(spark, d))


@query
def base_state(spark, d):
    return analytics.state_hash(star.facts(spark, d, "O", "C", "N"))


@query
def curriculum_tiers(spark, d):
    return analytics.curriculum(triples.training_pairs(star.facts(spark, d, "P", "P2")), {"declare": 0.1, "fill": 0.4, "ask": 0.6, "confirm": 0.9})


#: Words that a vocabulary holds at most, beside the specials.
VOCABULARY = 50_000


def _words():
    return F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9]+)"), F.lit(1))


@query
def word_vocabulary(spark, d):
    return analytics.vocabulary(star.table(spark, d, "documents"), _words(), VOCABULARY)


@query
def word_encoding(spark, d):
    docs = star.table(spark, d, "documents")
    return analytics.encode_words(docs, "doc_id", _words(), scratch.keep(analytics.vocabulary(docs, _words(), VOCABULARY), "vocabulary"))


@query
def word_decoding(spark, d):
    """Texts of the known words, from ids of a vocabulary of the more frequent half of them."""
    docs = star.table(spark, d, "documents")
    vocab = scratch.keep(analytics.vocabulary(docs, _words(), VOCABULARY, least=3), "vocabulary")
    return analytics.decode_words(analytics.encode_words(docs, "doc_id", _words(), vocab), "doc_id", vocab)


@query
def source_summaries(spark, d):
    names = star.provenance(spark, d, "C", "P").select(F.substring("source", 1, 4).alias("name")).distinct()
    return analytics.told_by(star.facts(spark, d, "C", "P"), star.provenance(spark, d, "C", "P"), names)


@query
def rule_effectiveness(spark, d):
    return derive.effectiveness(_long_skills(spark, d)).withColumn("running", _r6("running"))


@query
def negated_verdicts(spark, d):
    f = star.facts(spark, d, "P", "P2", "P3")
    asked = star.facts(spark, d, "P3").select(F.concat("s", F.when(F.pmod("seq", F.lit(3)) == 0, F.lit(" isnt")).otherwise(" is"), F.lit(" tiny")).alias("q"), "s", "r", F.lit("tiny").alias("o"))
    asked = asked.withColumn("x", text.negated_question(F.col("q"))).withColumn("probe", F.col("s"))
    verdicts = pattern.boolean(f, asked.select("probe", "s", "r", "o"))
    return asked.join(verdicts, "probe").select("q", F.col("x.question").alias("question"), F.col("x.negated").alias("negated"), text.turned(F.col("verdict"), F.col("x.negated")).alias("verdict"))


@query
def stream_calibration(spark, d):
    """Outcomes by relation and category of score, as a stream counts them."""
    base = _folder(spark, "stream")
    e = star.table(spark, d, "events").select(F.col("event_type").alias("relation"), (F.col("value") / 500).alias("score"), (F.col("event_id") % 3 == 0).alias("correct"))
    e.write.parquet(f"{base}/in")
    rows = spark.readStream.schema(e.schema).parquet(f"{base}/in")
    twins.run_once(calibrate.tally(rows, "relation"), lambda df, k: df.write.mode("overwrite").parquet(f"{base}/out"), f"{base}/checkpoint", "complete")
    return spark.read.parquet(f"{base}/out")


@query
def decayed_provenance(spark, d):
    return provenance.decayed(star.provenance(spark, d, "C"), 0.9, 3).select("s", "r", "o", _r6("confidence").alias("confidence"))


# passes and streams


@query
def maintenance(spark, d):
    f = star.facts(spark, d, "O", "C", "N", "C50", "P", "P2", "NEG")
    return upkeep.maintained(f, star.provenance(spark, d, "C", "C50"))["report"]


@query
def maintenance_pass(spark, d):
    """What each step of a whole pass does; the session that it leaves is saved."""
    f = star.facts(spark, d, "O", "C", "N", "C50", "P", "P2", "NEG")
    rules = [(["partof", "locatedin"], "locatedin"), (["locatedin", "locatedin"], "locatedin"), (["partof", "category"], "category")]
    return upkeep.passed(f.union(star.facts(spark, d, "C2")), star.provenance(spark, d, "C", "C50"), _long_skills(spark, d), star.episodes(spark, d), rules, 1, path=_folder(spark, "session"))["report"]


@query
def maintained_base(spark, d):
    """The base that a pass leaves, written and read again."""
    f = star.facts(spark, d, "O", "C", "N", "C50", "P", "P2", "NEG")
    return scratch.keep(upkeep.maintained(f, star.provenance(spark, d, "C", "C50"))["facts"], "base")


def _consolidated(spark, d):
    f = star.facts(spark, d, "C", "C50", "P", "P2", "P3").union(star.facts(spark, d, "C").where("seq % 3 = 0").withColumn("seq", F.col("seq") + 50 * star.STEP))
    return upkeep.consolidated(f, star.provenance(spark, d, "C", "P"), star.episodes(spark, d), factor=0.9, forget=0.2)


@query
def consolidation_report(spark, d):
    return _consolidated(spark, d)["report"]


@query
def consolidated_base(spark, d):
    return scratch.keep(_consolidated(spark, d)["facts"], "base")


@query
def decision_replay(spark, d):
    """Decisions over one base, held against the same base and against another."""
    f = star.facts(spark, d, "C", "C50")
    probes = star.facts(spark, d, "C", "S").select(F.col("s").alias("probe"), "s", "r")
    records = upkeep.decisions(f, probes)
    same = upkeep.replayed(records, f).withColumn("against", F.lit("same"))
    return same.union(upkeep.replayed(records, star.facts(spark, d, "C")).withColumn("against", F.lit("other")))


@query
def hard_questions(spark, d):
    f = star.facts(spark, d, "C", "N", "P", "P3")
    kinds = star.facts(spark, d, "P").select((F.col("seq") + 20 * star.STEP).alias("seq"), "s", F.lit("kind").alias("r"), F.element_at(F.split("o", " "), -1).alias("o"))
    stems = star.table(spark, d, "nation").select((F.col("n_nationkey") + 30 * star.STEP).alias("seq"), F.element_at(F.split(F.lower("n_name"), "[ _]"), 1).alias("s"), F.lit("has").alias("r"), F.lit("name").alias("o"))
    return upkeep.hard_questions(f.union(kinds).union(stems))


@query
def stream_tally(spark, d):
    """Counts of states by day, as a stream keeps them."""
    base = _folder(spark, "stream")
    star.episodes(spark, d).write.parquet(f"{base}/in")
    rows = spark.readStream.schema(spark.read.parquet(f"{base}/in").schema).parquet(f"{base}/in")
    at = rows.withColumn("ts", F.col("ts").cast("timestamp"))  # event time is told by instants
    twins.run_once(twins.tally_stream(at), lambda df, k: df.write.mode("overwrite").parquet(f"{base}/out"), f"{base}/checkpoint", "complete")
    return spark.read.parquet(f"{base}/out").withColumn("begin", F.col("begin").cast("timestamp_ntz"))


@query
def stream_drift(spark, d):
    """The drift operator's streaming twin over the stored log; it gives the batch operator's rows."""
    base = scratch.place(spark, "stream")
    star.episodes(spark, d).write.parquet(f"{base}/in")
    rows = spark.readStream.schema(spark.read.parquet(f"{base}/in").schema).parquet(f"{base}/in")
    twins.run_once(twins.drift_stream(rows), lambda df, k: df.write.mode("append").parquet(f"{base}/out"), f"{base}/checkpoint")
    return spark.read.parquet(f"{base}/out")
