"""Query logs (id, ts, subject, relation, state, symbol, score) and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import traits
from ..plans import ranks

KEY = ("subject", "relation")


def drift(episodes: DataFrame) -> DataFrame:
    """Episodes whose state or symbol differs from the one before of the same subject and relation, with what was before.

    What was before is carried by ranges of the order, so a signature with very many
    episodes is worked on by many tasks.
    """
    here = F.struct("state", "symbol")
    rows = episodes.select("id", *KEY, "state", "symbol", F.struct(*KEY).alias("key"), F.struct("ts", "id").alias("at"), here.alias("here"))
    was = ranks.carried(rows, "key", "at", {"was": "here"})
    changed = F.col("was").isNotNull() & ~F.col("here").eqNullSafe(F.col("was"))
    return was.where(changed).select("id", *KEY, F.col("was.state").alias("was_state"), "state", F.col("was.symbol").alias("was_symbol"), "symbol")


def drifted(episodes: DataFrame) -> DataFrame:
    """(subject, relation, drifted): whether any episode differs from the first, that is whether there are two kinds of them."""
    return episodes.groupBy(*KEY, "state", "symbol").agg(F.count("*").alias("n")).groupBy(*KEY).agg((F.count("*") > 1).alias("drifted"))


def states(episodes: DataFrame) -> DataFrame:
    return episodes.groupBy("state").agg(F.count("*").alias("n"))


def hot_signatures(episodes: DataFrame, top: int = 10) -> DataFrame:
    return episodes.groupBy(*KEY).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *KEY).limit(top)


def consolidated(episodes: DataFrame, least: int = 3, stable: float = 0.9, ambiguous: float = 0.5) -> DataFrame:
    """(subject, relation, n, mode, share, verdict, often_ambiguous): what a signature's answers settle on."""
    n = episodes.groupBy(*KEY).agg(F.count("*").alias("n"), F.count_if(F.col("state") != "idk").alias("told"), F.count_if(F.col("state") == "ambiguous").alias("unsure")).where(F.col("n") >= least)
    said = episodes.where("state != 'idk'").groupBy(*KEY, "symbol").agg(F.count("*").alias("m"))
    mode = said.groupBy(*KEY).agg(F.min_by(F.struct("symbol", "m"), F.struct(-F.col("m"), F.col("symbol"))).alias("x"))
    share = F.coalesce(F.col("x.m") / F.col("told"), F.lit(0.0))
    return n.join(mode, list(KEY), "left").select(*KEY, "n", F.col("x.symbol").alias("mode"), share.alias("share"), F.when(share >= stable, "stable").otherwise("unstable").alias("verdict"), (F.col("unsure") / F.col("n") >= ambiguous).alias("often_ambiguous"))


def last_of_each(episodes: DataFrame, k: int) -> DataFrame:
    """The last k episodes of each signature."""
    return episodes.withColumn("n", F.row_number().over(W.partitionBy(*KEY).orderBy(F.desc("ts"), F.desc("id")))).where(F.col("n") <= k)


def in_window(episodes: DataFrame, begin: str, end: str) -> DataFrame:
    return episodes.where(F.col("ts").between(F.lit(begin).cast("timestamp"), F.lit(end).cast("timestamp")))


def carried(turns: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Adds ``carried``: the last value before the row that isn't null."""
    w = W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return turns.withColumn("carried", F.last(value, ignorenulls=True).over(w))


def ring(item, values: tuple[str, ...], step: int):
    """The member of a ring so many steps on; null for other items."""
    at = traits.rank_in(values, item)
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(at - 1 + step, F.lit(len(values))) + 1).cast("int"))


def successors(texts: DataFrame, key: str, words, order: int = 2, top: int = 3) -> DataFrame:
    """(context, next, n, rank): what follows so many words, most frequent first.

    Rows are dealt by context once, for the counts and for the ranks: most are seen
    once, so that adding them up before they move would hardly make them fewer.
    """
    at = texts.select(key, words.alias("w")).where(F.size("w") > order)
    grams = F.transform(F.sequence(F.lit(1), F.size("w") - order), lambda i: F.struct(F.array_join(F.slice("w", i, order), " ").alias("context"), F.element_at("w", i + order).alias("next")))
    n = at.select(F.explode(grams).alias("g")).select("g.context", "g.next").repartition("context").groupBy("context", "next").agg(F.count("*").alias("n"))
    return n.withColumn("rank", F.row_number().over(W.partitionBy("context").orderBy(F.desc("n"), "next"))).where(F.col("rank") <= top)


def user_topics(episodes: DataFrame, top: int = 3) -> DataFrame:
    """(subject, topic, n, rank): most frequent relations of each subject."""
    n = episodes.groupBy("subject", F.col("relation").alias("topic")).agg(F.count("*").alias("n"))
    return n.withColumn("rank", F.row_number().over(W.partitionBy("subject").orderBy(F.desc("n"), "topic"))).where(F.col("rank") <= top)


def folded(log: DataFrame) -> DataFrame:
    """(s, r, o, n): copies left after a log (seq, op, s, r, o) of store and forget; a forget without a copy does nothing.

    The count that is left is the running sum less its least value, if that is below 0.
    """
    w = W.partitionBy("s", "r", "o").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    step = F.when(F.col("op") == "store", 1).otherwise(-1)
    run = log.withColumn("sum", F.sum(step).over(w))
    out = run.groupBy("s", "r", "o").agg(F.max_by("sum", "seq").alias("end"), F.min("sum").alias("low"))
    return out.select("s", "r", "o", (F.col("end") - F.least(F.col("low"), F.lit(0))).alias("n")).where("n > 0")


def history(episodes: DataFrame) -> DataFrame:
    """(subject, relation, states): the states of each signature in order, as text; one row for each signature and day, so that rows stay small."""
    at = F.struct("ts", "id", "state")
    by_day = episodes.groupBy(*KEY, F.to_date("ts").alias("day")).agg(F.array_sort(F.collect_list(at)).alias("x"))
    return by_day.select(*KEY, F.col("day").cast("string").alias("day"), F.array_join(F.transform("x", lambda e: e["state"]), ",").alias("states"))


def promoted(memories: DataFrame, least: int = 3, actor: str = "user", kind: str = "told") -> DataFrame:
    """(content, n): what an actor has told often enough to be a fact."""
    return memories.where((F.col("actor") == actor) & (F.col("kind") == kind)).groupBy("content").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def status(episodes: DataFrame) -> DataFrame:
    return episodes.agg(F.count("*").alias("n"), F.count_if(F.col("state") == "known").alias("known"), F.count_if(F.col("state") == "ambiguous").alias("ambiguous"), F.count_if(F.col("state") == "idk").alias("idk"), F.count_distinct(*KEY).alias("signatures"))
