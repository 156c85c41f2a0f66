"""Counts, rankings and reports over facts and their records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import traits
from ..sources import scratch

#: Rows of a vocabulary that are broadcast at most.
VOCABULARY_ROWS = 200_000


def positive(facts: DataFrame) -> DataFrame:
    return facts.where(~traits.is_negative(F.col("r")))


def density(facts: DataFrame) -> DataFrame:
    """(n_facts, n_subjects): how many subjects have how many positive facts."""
    return positive(facts).groupBy("s").agg(F.count("*").alias("n_facts")).groupBy("n_facts").agg(F.count("*").alias("n_subjects"))


def cooccurrence(facts: DataFrame, least: int = 2) -> DataFrame:
    """(r1, r2, both, only1, only2, jaccard) of relations that subjects share."""
    own = positive(facts).where("r != 'isa'").select("s", "r").distinct()
    n = own.groupBy("r").agg(F.count("*").alias("n"))
    pairs = own.select("s", F.col("r").alias("r1")).join(own.select("s", F.col("r").alias("r2")), "s").where("r1 < r2").groupBy("r1", "r2").agg(F.count("*").alias("both")).where(F.col("both") >= least)
    out = pairs.join(n.select(F.col("r").alias("r1"), F.col("n").alias("n1")), "r1").join(n.select(F.col("r").alias("r2"), F.col("n").alias("n2")), "r2")
    return out.select("r1", "r2", "both", (F.col("n1") - F.col("both")).alias("only1"), (F.col("n2") - F.col("both")).alias("only2"), (F.col("both") / (F.col("n1") + F.col("n2") - F.col("both"))).alias("jaccard"))


def similar(facts: DataFrame, subjects: DataFrame | None = None, least: int = 1, top: int = 10) -> DataFrame:
    """(s, other, overlap, jaccard, rank): subjects by shared (r, o). Only subjects asked for are on the left side.

    Subjects with the same set of (r, o) are one class, so that pairs are made of
    classes; a class needs to know only top + 1 of its members to name anyone's others.
    """
    attrs = positive(facts).where("r != 'isa'").select("s", "r", "o").distinct()
    own = attrs.groupBy("s").agg(F.array_sort(F.collect_list(F.struct("r", "o"))).alias("set"))
    own = scratch.keep(own.select("s", "set", F.sha2(F.to_json("set").cast("binary"), 256).alias("c")), "sets")
    first = own.select("c", "s").withColumn("n", F.row_number().over(W.partitionBy("c").orderBy("s"))).where(F.col("n") <= top + 1).select("c", F.col("s").alias("other"))
    classes = scratch.keep(own.groupBy("c").agg(F.first("set").alias("set")), "classes")
    size = classes.select("c", F.size("set").alias("n"))
    parts = classes.select("c", F.explode("set").alias("x")).select("c", "x.r", "x.o")
    left = parts if subjects is None else parts.join(own.join(subjects.select("s").distinct(), "s", "left_semi").select("c").distinct(), "c", "left_semi")
    both = left.join(parts.withColumnRenamed("c", "d"), ["r", "o"]).groupBy("c", "d").agg(F.count("*").alias("overlap")).where(F.col("overlap") >= least)
    both = both.join(size, "c").join(size.select(F.col("c").alias("d"), F.col("n").alias("m")), "d").withColumn("jaccard", F.col("overlap") / (F.col("n") + F.col("m") - F.col("overlap")))
    order = W.partitionBy("c").orderBy(F.desc("overlap"), F.desc("jaccard"), "other")
    named = both.join(first.withColumnRenamed("c", "d"), "d").withColumn("k", F.row_number().over(order)).where(F.col("k") <= top + 1)
    lists = scratch.keep(named.groupBy("c").agg(F.array_sort(F.collect_list(F.struct("k", "other", "overlap", "jaccard"))).alias("x")), "named")
    asking = own.select("s", "c") if subjects is None else own.select("s", "c").join(subjects.select("s").distinct(), "s", "left_semi")
    others = F.slice(F.filter("x", lambda e: e["other"] != F.col("s")), 1, top)  # in order, so that no subject's rows are sorted again
    out = asking.join(scratch.near(lists), "c").select("s", F.posexplode(others).alias("at", "e"))
    return out.select("s", "e.other", "e.overlap", "e.jaccard", (F.col("at") + 1).alias("rank"))


def importance(facts: DataFrame, episodes: DataFrame, top: int = 20) -> DataFrame:
    """(subject, as_s, as_o, asked, score): 1 for each fact of it, a half as object, 2 for each query."""
    s = facts.groupBy(F.col("s").alias("subject")).agg(F.count("*").alias("as_s"))
    o = facts.groupBy(F.col("o").alias("subject")).agg(F.count("*").alias("as_o"))
    q = episodes.groupBy("subject").agg(F.count("*").alias("asked"))
    all_ = s.join(o, "subject", "full_outer").join(q, "subject", "full_outer").fillna(0, ["as_s", "as_o", "asked"])
    return all_.withColumn("score", F.col("as_s") + 0.5 * F.col("as_o") + 2.0 * F.col("asked")).orderBy(F.desc("score"), "subject").limit(top)


def gaps(facts: DataFrame, least_share: float = 0.4, least_siblings: int = 3, relation: str = "isa") -> DataFrame:
    """(s, r, support, siblings, share): relations that enough siblings have and the subject lacks.

    Siblings are counted by parent, so no pairs of siblings are made.
    """
    kids = facts.where(F.col("r") == relation).groupBy("s").agg(F.min_by("o", "seq").alias("parent"))
    own = positive(facts).where(F.col("r") != relation).select("s", "r").distinct()
    n = kids.groupBy("parent").agg((F.count("*") - 1).alias("siblings"))
    have = own.join(kids, "s").groupBy("parent", "r").agg(F.count("*").alias("support"))
    want = kids.join(n, "parent").where(F.col("siblings") >= least_siblings).join(have, "parent").where(F.col("support") >= least_share * F.col("siblings"))
    return want.join(own, ["s", "r"], "left_anti").select("s", "r", "support", "siblings", (F.col("support") / F.col("siblings")).alias("share"))


#: Relations whose objects make siblings.
PARENTS = ("isa", "kind", "category")


def expectations(facts: DataFrame, least_agreement: float = 0.4, least_siblings: int = 3, parents: int = 3, most: int = 50) -> DataFrame:
    """(s, r, hits, siblings, agreement): relations that enough siblings have and the subject lacks.

    Siblings share one of a subject's first parents of each relation; a parent names
    its first children only, as many as ``most``, by relation. The numbers are the
    feature's, so no parent gives more than ``most`` siblings to a subject.
    """
    kids = facts.where(F.col("r").isin(*PARENTS)).groupBy("s", "r", "o").agg(F.min("seq").alias("seq"))
    up = kids.withColumn("n", F.row_number().over(W.partitionBy("s", "r").orderBy("seq", "o"))).where(F.col("n") <= parents).select("s", F.col("o").alias("parent")).distinct()
    down = kids.withColumn("n", F.row_number().over(W.partitionBy("r", "o").orderBy("seq", "s"))).where(F.col("n") <= most).select(F.col("o").alias("parent"), F.col("s").alias("sibling")).distinct()
    pairs = scratch.keep(up.join(down, "parent").where("s != sibling").select("s", "sibling").distinct(), "siblings")
    enough = pairs.groupBy("s").agg(F.count("*").alias("siblings")).where(F.col("siblings") >= least_siblings)
    own = facts.where(~F.col("r").isin(*PARENTS)).select("s", "r").distinct()
    hits = pairs.join(own.withColumnRenamed("s", "sibling"), "sibling").groupBy("s", "r").agg(F.count("*").alias("hits"))
    out = hits.join(enough, "s").withColumn("agreement", F.col("hits") / F.col("siblings")).where(F.col("agreement") >= least_agreement)
    return out.join(own, ["s", "r"], "left_anti").select("s", "r", "hits", "siblings", "agreement")


def abstractions(facts: DataFrame, least: int = 3, relation: str = "isa") -> DataFrame:
    """(parent, r, o, support, known): what enough children of a parent share, and whether the parent has it already."""
    kids = facts.where(F.col("r") == relation).select("s", F.col("o").alias("parent")).distinct()
    own = positive(facts).where(F.col("r") != relation).select("s", "r", "o").distinct()
    shared = kids.join(own, "s").groupBy("parent", "r", "o").agg(F.count("*").alias("support")).where(F.col("support") >= least)
    return shared.join(own.select(F.col("s").alias("parent"), "r", "o", F.lit(True).alias("known")), ["parent", "r", "o"], "left").withColumn("known", F.coalesce("known", F.lit(False)))


def sources(provenance: DataFrame) -> DataFrame:
    return provenance.groupBy("source").agg(F.count("*").alias("n"), F.avg("confidence").alias("confidence"), F.avg("count").alias("reinforcement"))


def summaries(facts: DataFrame) -> DataFrame:
    """(s, n_facts, n_denials, n_relations, parents) of each subject."""
    neg = traits.is_negative(F.col("r"))
    parents = F.array_join(F.array_sort(F.collect_set(F.when(F.col("r") == "isa", F.col("o")))), ",")
    return facts.groupBy("s").agg(F.count_if(~neg).alias("n_facts"), F.count_if(neg).alias("n_denials"), F.count_distinct(F.when(~neg, F.col("r"))).alias("n_relations"), parents.alias("parents"))


def told_by(facts: DataFrame, provenance: DataFrame, names: DataFrame, most: int = 12) -> DataFrame:
    """(name, summary, n) of names (name): the first facts whose source is the name or holds it, as sentences, at most so many."""
    own = facts.groupBy("s", "r", "o").agg(F.min("seq").alias("seq")).join(provenance.select("s", "r", "o", "source"), ["s", "r", "o"])
    n = F.length("source")
    parts = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(F.lit(1), n - i + 1), lambda k: F.substr("source", i, k))))
    kinds = own.select("source").distinct().where(n > 0).select("source", F.explode(F.array_distinct(parts)).alias("name")).join(names.select("name").distinct(), "name")
    first = own.join(kinds, "source").withColumn("n", F.row_number().over(W.partitionBy("name").orderBy("seq", "s", "r", "o"))).where(F.col("n") <= most)
    line = F.struct("n", F.concat_ws(" ", "s", "r", "o").alias("line"))
    return first.groupBy("name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: F.concat(x["line"], F.lit("."))), " ").alias("summary"), F.count("*").alias("n"))


def relation_stats(facts: DataFrame) -> DataFrame:
    """(r, n, subjects, objects) of each relation; distinct ends are grouped one kind at a time, so that no fact is doubled for both."""
    subjects = facts.groupBy("r", "s").agg(F.count("*").alias("n")).groupBy("r").agg(F.sum("n").alias("n"), F.count("s").alias("subjects"))
    objects = facts.groupBy("r", "o").agg(F.count("*")).groupBy("r").agg(F.count("o").alias("objects"))
    return subjects.join(objects, subjects["r"].eqNullSafe(objects["r"])).select(subjects["r"], "n", "subjects", "objects")


def shard_balance(facts: DataFrame, shards: int) -> DataFrame:
    """(shard, n) by a hash of subject and relation; empty shards are listed."""
    n = facts.groupBy(F.pmod(F.crc32(F.concat_ws("\0", "s", "r").cast("binary")), F.lit(shards)).cast("int").alias("shard")).agg(F.count("*").alias("n"))
    return facts.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard")).join(n, "shard", "left").fillna(0, ["n"])


def hot_keys(facts: DataFrame, top: int = 10) -> DataFrame:
    return facts.groupBy("s", "r").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "s", "r").limit(top)


#: Facts that a shard holds well, by the dimension of vectors.
SHARD_TARGETS = {512: 30, 1024: 45, 2048: 60, 4096: 80, 8192: 160, 16384: 320}


def recommend_shards(n_facts, dim: int = 4096, factor: float = 1.25, least: int = 8, most: int = 4096):
    """The next power of 2 of the shards that the facts need, as a column."""
    need = F.greatest(F.lit(1), F.floor(n_facts * factor / SHARD_TARGETS[dim]))
    return F.least(F.lit(most), F.greatest(F.lit(least), F.pow(F.lit(2), F.ceil(F.log2(need))))).cast("int")


def active_learning(facts: DataFrame, provenance: DataFrame, gap_rows: DataFrame, top: int = 15) -> DataFrame:
    """(s, r, why, score): what to ask next: doubtful facts, facts without record, and gaps; each (s, r) once."""
    low = provenance.where("confidence <= 0.4").select("s", "r", F.lit("doubtful").alias("why"), F.greatest(F.lit(0.0), 1 - 4 * F.abs(F.col("confidence") - 0.15)).alias("score"))
    bare = facts.join(provenance, ["s", "r", "o"], "left_anti").select("s", "r", F.lit("unrecorded").alias("why"), F.lit(0.5).alias("score"))
    gap = gap_rows.select("s", "r", F.lit("gap").alias("why"), F.col("share").alias("score"))
    best = low.union(bare).union(gap).groupBy("s", "r").agg(F.min(F.struct((-F.col("score")).alias("minus"), "why")).alias("x"))
    return best.select("s", "r", F.col("x.why").alias("why"), (-F.col("x.minus")).alias("score")).orderBy(F.desc("score"), "s", "r").limit(top)


def state_hash(facts: DataFrame) -> DataFrame:
    """(parts, n, hash): a digest of a base that doesn't depend on order; sums of hashes are aggregated before they move."""
    h = F.conv(F.substring(F.sha2(F.concat_ws("\0", "s", "r", "o").cast("binary"), 256), 1, 12), 16, 10).cast("decimal(38,0)")
    return facts.agg(F.count("*").alias("n"), F.sum(h).cast("string").alias("hash"))


def curriculum(pairs: DataFrame, difficulty: dict[str, float], tiers: int = 4, longest: int = 256) -> DataFrame:
    """(task, tier, n) of text pairs (task, draft, target): half by length, half by the task."""
    hard = F.create_map(*[F.lit(x) for kv in difficulty.items() for x in kv])[F.col("task")]
    score = 0.5 * (F.length("draft") + F.length("target")) / (2 * longest) + 0.5 * hard
    tier = F.least(F.lit(tiers - 1), F.greatest(F.lit(0), F.floor(score * tiers))).cast("int")
    return pairs.groupBy("task", tier.alias("tier")).agg(F.count("*").alias("n"))


def vocabulary(texts: DataFrame, words, size: int, least: int = 1) -> DataFrame:
    """(word, n, id): the most frequent words; ids follow four specials. The rows are as many as ``size`` at most."""
    n = texts.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    top = n.orderBy(F.desc("n"), "word").limit(size)
    return top.withColumn("id", F.row_number().over(W.orderBy(F.desc("n"), "word")) + 3)


def encode_words(texts: DataFrame, key: str, words, vocab: DataFrame, unknown: int = 3) -> DataFrame:
    """(key, ids): each word's id, unknown ones the same. The stored vocabulary is broadcast up to a counted size, so that words aren't moved to be looked up."""
    at = texts.select(key, F.posexplode_outer(words).alias("pos", "word")).join(scratch.near(vocab.select("word", "id"), VOCABULARY_ROWS), "word", "left")
    ids = F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("id", F.lit(unknown)).alias("id")))), lambda x: x["id"].cast("string"))
    return at.where("pos IS NOT NULL").groupBy(key).agg(F.array_join(ids, " ").alias("ids"))


def decode_words(encoded: DataFrame, key: str, vocab: DataFrame, unknown: str = "<unk>") -> DataFrame:
    """(key, text): the words of ids (column ``ids``), joined by blanks; ids that the vocabulary lacks give the unknown word."""
    at = encoded.select(key, F.posexplode(F.split("ids", " ")).alias("pos", "id")).withColumn("id", F.col("id").cast("int"))
    got = at.join(vocab.select("id", "word"), "id", "left")
    words = F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("word", F.lit(unknown)).alias("word")))), lambda x: x["word"])
    return got.groupBy(key).agg(F.array_join(words, " ").alias("text"))
