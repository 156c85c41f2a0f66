"""Benchmark decontamination by a positional inverted index.

One pass over the documents stores the postings (row, place, term) of all words
that occur in the test items, as a table. Everything else reads that table: how
often each term occurs; for each test window its two rarest terms; the postings
of those, shifted by the terms' offsets and intersected; and, along the
alignments that remain, the postings of all other terms of the item. Runs of
matching places that are as long as a window are exact phrase matches.

Only DataFrame functions are used. Test-side tables are broadcast if they have
at most BROADCAST_ROWS rows, which is counted, and joined by shuffle beyond.

Defined results: null and empty texts have no words and no matches. An item
without words matches nothing. Rows with equal or null ids are matched each on
its own; items with equal ids count once. Empty tables on either side give no
matches. Other columns of the inputs are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import scratch

#: Fixed by the contract: A-Z are lower-cased, and words are runs of anything but these.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WINDOW = 13
BROADCAST_ROWS = 1_000_000
#: Stands after the last word of each row, so that its place is the number of words.
END, END_ID = "\0", -1


@dataclass
class Index:
    """postings: row, pos, term, and in the entry that ends a row its id; terms: word, term."""

    postings: DataFrame
    terms: DataFrame


def _split(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), SEPARATORS)


def _lowered(word: Column) -> Column:
    return F.when(F.lower(word) == word, word).otherwise(F.translate(word, UPPER, LOWER))


def word_places(rows: DataFrame, id_col: str, text: str, *more: str) -> DataFrame:
    """(row, id, n_words, pos, word) and a last entry with END for each row."""
    at = rows.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), *more, _split(F.col(text)).alias("_w"))
    lead, tail = (F.element_at("_w", k) == "" for k in (1, -1))
    at = at.withColumn("_lead", lead.cast("int")).withColumn("_n", F.size("_w") - F.col("_lead") - (tail & (F.size("_w") > 1)).cast("int"))
    at = at.select("row", "id", *more, "_n", "_lead", F.posexplode(F.concat("_w", F.array(F.lit(END)))).alias("pos", "word"))
    pos = F.when(F.col("word") == END, F.col("_n")).otherwise(F.col("pos") - F.col("_lead"))
    return at.where(F.col("word") != "").select("row", "id", *more, F.col("_n").alias("n_words"), pos.alias("pos"), _lowered(F.col("word")).alias("word"))


def _near(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if scratch.small(df, BROADCAST_ROWS) else df


def build_index(docs: DataFrame, words: DataFrame, id_col: str = "doc_id", text: str = "text") -> Index:
    """Stores the postings of the given words (column ``word``) in all documents."""
    spark = docs.sparkSession
    distinct = words.select("word").where(F.col("word") != END).distinct()
    terms = scratch.keep(distinct.withColumn("term", F.monotonically_increasing_id()).union(spark.sql(f"SELECT '\\0' AS word, {END_ID}L AS term")), "terms")
    places = word_places(docs, id_col, text).drop("n_words")
    ends = F.col("term") == END_ID
    found = places.join(_near(terms), "word").select("row", F.when(ends, F.col("id")).alias("id"), "pos", "term")
    return Index(scratch.keep(found, "postings"), terms)


def _item_table(index: Index, items: DataFrame, id_col: str, text: str) -> DataFrame:
    """(item, item_id, n_words, pos, term, freq) of the items' words; freq 0 if no document has the term."""
    freq = index.postings.groupBy("term").agg(F.count("*").alias("freq"))
    places = word_places(items, id_col, text).where(F.col("word") != END).withColumnRenamed("row", "item").withColumnRenamed("id", "item_id")
    return scratch.keep(places.join(_near(index.terms), "word").join(freq, "term", "left").select("item", "item_id", "n_words", "pos", "term", F.coalesce("freq", F.lit(0)).alias("freq")), "items")


def phrase_matches(index: Index, items: DataFrame, window: int = WINDOW, id_col: str = "item_id", text: str = "text") -> DataFrame:
    """(row, item_id, start, end): places of documents, end exclusive, that windows of the item cover.

    A window is ``window`` consecutive words of an item; an item of fewer is one window.
    """
    words = _item_table(index, items, id_col, text)
    size = F.least(F.lit(window), F.col("n_words"))
    ahead = W.partitionBy("item").orderBy("pos").rowsBetween(0, window - 1)
    seen = F.collect_list(F.struct("freq", "pos", "term")).over(ahead)
    wins = words.select("item", "pos", "n_words", F.array_sort(seen).alias("seen")).where(F.size("seen") >= size)
    first, second = F.col("seen")[0], F.coalesce(F.get("seen", F.lit(1)), F.col("seen")[0])
    pairs = wins.where(first["freq"] > 0).select("item", first["pos"].alias("pos1"), first["term"].alias("term1"), second["pos"].alias("pos2"), second["term"].alias("term2")).distinct()
    pairs = scratch.keep(pairs, "pairs")
    rare = pairs.select(F.col("term1").alias("term")).union(pairs.select("term2")).distinct()
    lists = scratch.keep(index.postings.select("row", "pos", "term").join(_near(rare), "term", "left_semi"), "rare")
    began = lists.join(_near(pairs), F.col("term") == F.col("term1")).select("item", "row", (F.col("pos") - F.col("pos1")).alias("shift"), (F.col("pos") - F.col("pos1") + F.col("pos2")).alias("pos"), F.col("term2").alias("term"))
    shifts = scratch.keep(began.join(lists, ["row", "pos", "term"], "left_semi").select("item", "row", "shift").distinct(), "shifts")
    places = shifts.join(_near(words.select("item", "n_words", F.col("pos").alias("at"), "term")), "item").select("item", "row", "shift", "n_words", "at", "term", (F.col("at") + F.col("shift")).alias("pos"))
    rest = index.postings.select("row", "pos", "term").where(F.col("term") != END_ID)
    rows = scratch.keep(shifts.select("row").distinct(), "rows")
    rest = rest.join(_near(rows), "row", "left_semi")
    hits = rest.join(places, ["row", "pos", "term"])
    line = W.partitionBy("row", "item", "shift").orderBy("at")
    runs = hits.withColumn("run", F.col("at") - F.row_number().over(line)).groupBy("row", "item", "shift", "run", "n_words").agg(F.min("pos").alias("start"), (F.max("pos") + 1).alias("end"))
    names = words.select("item", "item_id").distinct()
    return runs.where(F.col("end") - F.col("start") >= size).join(_near(names), "item").select("row", "item_id", "start", "end")


def proximity_matches(index: Index, queries: DataFrame, within: int, id_col: str = "query_id", word: str = "word") -> DataFrame:
    """(row, query_id, start, end): spans of at most ``within`` words, from the rarest term, that hold all words of a query.

    queries has a row for each word. For each place of the rarest word, the nearest place of each other word counts.
    """
    freq = index.postings.groupBy("term").agg(F.count("*").alias("freq"))
    asked = queries.select(F.col(id_col).alias("query_id"), _lowered(F.col(word)).alias("word")).where("word IS NOT NULL").distinct()
    asked = scratch.keep(asked.join(index.terms, "word", "left").join(freq, "term", "left").select("query_id", F.coalesce("term", F.lit(-2)).alias("term"), F.coalesce("freq", F.lit(0)).alias("freq")), "asked")
    heads = asked.groupBy("query_id").agg(F.min(F.struct("freq", "term"))["term"].alias("head"), F.count("*").alias("n"), F.min("freq").alias("least")).where("least > 0")
    at = index.postings.select("row", "pos", "term")
    began = at.join(_near(heads), F.col("term") == F.col("head")).select("row", "query_id", "n", F.col("pos").alias("at"), "head")
    others = asked.join(heads.select("query_id", "head"), "query_id").where("term != head").select("query_id", "term")
    wanted = began.join(_near(others), "query_id").withColumn("cell", F.explode(F.sequence(F.floor((F.col("at") - within) / within), F.floor((F.col("at") + within) / within))))
    got = at.withColumn("cell", F.floor(F.col("pos") / within)).join(wanted, ["row", "term", "cell"]).where(F.abs(F.col("pos") - F.col("at")) < within)
    near = got.groupBy("row", "query_id", "at", "n", "term").agg(F.min_by("pos", F.struct(F.abs(F.col("pos") - F.col("at")), F.col("pos"))).alias("pos"))
    near = near.unionByName(began.select("row", "query_id", "at", "n", F.col("head").alias("term"), F.col("at").alias("pos")))
    spans = near.groupBy("row", "query_id", "at", "n").agg(F.count("*").alias("found"), F.min("pos").alias("start"), (F.max("pos") + 1).alias("end"))
    return spans.where((F.col("found") == F.col("n")) & (F.col("end") - F.col("start") <= within)).select("row", "query_id", "start", "end")


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """For each document: n_words, n_hit, n_items, item_ids, and contaminated (a twentieth of its words or more are hit)."""
    words = word_places(items, item_id, item_text)
    index = build_index(docs, words, id_col, text)
    spans = scratch.keep(phrase_matches(index, items, window, item_id, item_text), "spans")
    hit = spans.select("row", F.explode(F.sequence("start", F.col("end") - 1)).alias("pos")).distinct().groupBy("row").agg(F.count("*").alias("n_hit"))
    which = spans.select("row", F.col("item_id").cast("string").alias("i")).distinct().groupBy("row").agg(F.count("*").alias("n_items"), F.array_sort(F.collect_list("i")).alias("item_ids"))
    found = hit.join(which, "row")
    all_rows = index.postings.where(F.col("term") == END_ID).select("row", "id", F.col("pos").cast("long").alias("n_words"))
    out = all_rows.join(found, "row", "left").select(
        F.col("id").alias(id_col), "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("n_items", F.lit(0)).alias("n_items"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
    )
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
