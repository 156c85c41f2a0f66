"""Texts taken in as facts, what peers have and a subject lacks, and the state of a session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text, traits
from ..sources import scratch, triples
from . import telling

TRIPLE = ["s", "r", "o"]
#: Parents of a subject, peers of a parent, objects and gaps that count or are shown, and the least facts that peers have.
PARENTS, PEERS, OBJECTS, GAPS, SUPPORT = 3, 25, 3, 10, 2
#: Relations whose question names what peers have.
NAMED = ("has", "haspart", "partof", "madeof", "contains", "color", "size", "kind", "category", "locatedin")


def ingested(texts: DataFrame, facts: DataFrame, records: DataFrame, source: str = "external", confidence: float = 0.7) -> dict[str, DataFrame]:
    """``files`` (file, n_tokens, n_sentences, n_facts, n_new) of texts (file, ts, text), and ``facts`` and ``records`` after their sentences were told.

    A fact is new to the first file, by ts and name, that tells it and if the base
    lacks it. Texts without facts and null texts have their counts, too.
    """
    plain = F.coalesce("text", F.lit(""))
    counts = texts.select("file", F.size(text.tokens(plain)).alias("n_tokens"), F.size(text.sentences(plain)).alias("n_sentences"))
    told = scratch.keep(triples.extract_facts(texts.select(F.struct("file", "ts").alias("of"), "text"), "text", "of").select("of.file", "of.ts", *TRIPLE), "told")
    first = told.groupBy(*TRIPLE).agg(F.min(F.struct("ts", "file")).alias("at")).join(facts.select(*TRIPLE), TRIPLE, "left_anti")
    new = first.groupBy(F.col("at.file").alias("file")).agg(F.count("*").alias("n_new"))
    n = told.groupBy("file").agg(F.count("*").alias("n_facts"))
    files = counts.join(n, "file", "left").join(new, "file", "left").select("file", "n_tokens", "n_sentences", F.coalesce("n_facts", F.lit(0)).alias("n_facts"), F.coalesce("n_new", F.lit(0)).alias("n_new"))
    out = telling.applied(facts, records, told.select(F.lit("tell").alias("op"), *TRIPLE, F.lit(source).alias("source"), F.lit(confidence).alias("confidence"), F.col("ts").cast("double").alias("ts")))
    return {"files": files} | out


def _question(s: Column, r: Column, objects: Column) -> Column:
    plain = F.concat(F.lit("What is the "), r, F.lit(" of "), s, F.lit("?"))
    peers = F.concat(plain, F.lit(" (its peers include "), F.array_join(F.slice(objects, 1, 2), ", "), F.lit(")"))
    return F.when(r.isin(*NAMED) & (F.size(objects) > 0), peers).otherwise(plain)


def peer_gaps(facts: DataFrame) -> DataFrame:
    """(s, r, support, objects, question, n): relations that a subject's peers have facts of and the subject lacks, most facts first.

    Peers are the first children of the subject's first parents. Subjects with the
    same parents have the same peers, so facts of peers are counted once for each
    set of parents; and what a subject lacks it doesn't add to, itself a peer or not.
    """
    own = facts.groupBy(*TRIPLE).agg(F.min("seq").alias("seq"))
    isa = own.where("r = 'isa'").select("s", F.col("o").alias("parent"), "seq")
    up = isa.withColumn("n", F.row_number().over(W.partitionBy("s").orderBy("seq", "parent"))).where(F.col("n") <= PARENTS)
    kin = scratch.keep(up.groupBy("s").agg(F.array_sort(F.collect_list("parent")).alias("parents")), "kin")
    peers = isa.withColumn("n", F.row_number().over(W.partitionBy("parent").orderBy("seq", "s"))).where(F.col("n") <= PEERS).select("parent", F.col("s").alias("peer"))
    sets = kin.select("parents").distinct()
    pairs = sets.select("parents", F.explode("parents").alias("parent")).join(peers, "parent").select("parents", "peer").distinct()
    told = own.where(~traits.is_negative(F.col("r")) & (F.col("r") != "isa")).select("s", "r", "o")
    each = pairs.join(told.withColumnRenamed("s", "peer"), "peer").groupBy("parents", "r", "o").agg(F.count("*").alias("m"))
    each = scratch.keep(each, "peers")
    shown = each.withColumn("n", F.row_number().over(W.partitionBy("parents", "r").orderBy(F.desc("m"), "o")))
    best = shown.where(F.col("n") <= OBJECTS).groupBy("parents", "r").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "o"))), lambda x: x["o"]).alias("objects"))
    support = each.groupBy("parents", "r").agg(F.sum("m").alias("support")).where(F.col("support") >= SUPPORT).join(best, ["parents", "r"])
    alone = pairs.groupBy("parents").agg(F.count("*").alias("k"), F.min("peer").alias("one"))
    want = kin.join(alone, "parents").where((F.col("k") > 1) | (F.col("one") != F.col("s"))).join(support, "parents").join(told.select("s", "r").distinct(), ["s", "r"], "left_anti")
    ranked = want.withColumn("n", F.row_number().over(W.partitionBy("s").orderBy(F.desc("support"), "r"))).where(F.col("n") <= GAPS)
    return ranked.select("s", "r", "support", F.array_join("objects", ", ").alias("objects"), _question(F.col("s"), F.col("r"), F.col("objects")).alias("question"), "n")


def status(facts: DataFrame, records: DataFrame, skills: DataFrame, episodes: DataFrame) -> DataFrame:
    """(name, n) of what a session holds; each number is aggregated where its rows are."""
    one = lambda df, name, n: df.agg(F.lit(name).alias("name"), F.coalesce(n.cast("long"), F.lit(0)).alias("n"))
    negative = traits.is_negative(F.col("r"))
    uses = F.col("success") + F.col("failure")
    rows = [
        one(facts, "facts", F.count_if(~negative)), one(facts, "denials", F.count_if(negative)), one(facts.select("r").distinct(), "relations", F.count("*")), one(facts.select("s").union(facts.select("o")).distinct(), "entities", F.count("*")),
        one(records, "records", F.count("*")), one(records, "unsure_records", F.count_if(F.col("confidence") < 0.3)), one(records, "derived_records", F.count_if(F.col("source").isin("induced", "rule"))),
        one(skills, "skills", F.count("*")), one(skills, "sure_skills", F.count_if((uses >= 3) & (F.col("success") >= 0.8 * uses))), one(episodes, "episodes", F.count("*")), one(episodes, "open_episodes", F.count_if(F.col("state") == "idk")),
        one(episodes.select("subject", "relation").distinct(), "signatures", F.count("*")),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.union(r)
    return out
