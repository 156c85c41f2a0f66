"""Tells, summaries and sentences on small fixtures."""

import math

from pyspark.sql import functions as F

from factloom.functions import phrases
from factloom.operators import briefs, telling, upkeep
from factloom.sources import sessions

from .test_reasoning import TRIPLE, facts, got, records

HOW = "s string, r string, o string, source string, confidence double, count long, last_seen double"


def test_tells_and_denials(spark):
    f = facts(spark, ("a", "partof", "b"), ("c", "color", "red"))
    known = spark.createDataFrame([("a", "partof", "b", "user", 0.5, 1, 1.0)], HOW)
    said = [
        ("tell", "A", "partof", "B", "external", 0.9, 5.0), ("tell", "x", "capital", "y", "user", 0.7, 6.0), ("tell", "x", "capital", "y", "user", 0.1, 7.0), ("deny", "c", "color", "blue", "user", 0.8, 4.0),
        ("deny", "c", "not_color", "blue", "user", 0.8, 8.0), ("tell", None, "isa", "z", "user", 0.8, 8.0), ("tell", "y", "capitalof", "x", "user", 0.6, 9.0),
    ]
    out = telling.applied(f, known, spark.createDataFrame(said, "op string, s string, r string, o string, source string, confidence double, ts double"))
    rows = sorted(map(tuple, out["facts"].collect()))
    assert rows[:2] == sorted(map(tuple, f.collect())) and [r[1:] for r in rows[2:]] == [("c", "not_color", "blue"), ("b", "haspart", "a"), ("x", "capital", "y"), ("y", "capitalof", "x")]
    assert [r[0] for r in rows[2:]] == [2, 3, 4, 5]
    told = {(r["s"], r["r"], r["o"]): r for r in out["records"].collect()}
    assert set(told) == {("a", "partof", "b"), ("x", "capital", "y"), ("c", "not_color", "blue"), ("y", "capitalof", "x")}
    assert (told["a", "partof", "b"]["source"], told["a", "partof", "b"]["count"]) == ("multi", 2) and math.isclose(told["a", "partof", "b"]["confidence"], 0.55)
    assert math.isclose(told["x", "capital", "y"]["confidence"], 1 - 0.3 * 0.9) and told["c", "not_color", "blue"]["count"] == 2


def test_dossiers_and_briefs(spark):
    f = facts(spark, ("cat", "isa", "mammal"), ("dog", "isa", "mammal"), ("cow", "isa", "mammal"), ("cat", "has", "fur"), ("cat", "color", "black"), ("cat", "not_has", "wings"), ("mammal", "isa", "animal"), ("cat", "lives_in", "old_town"))
    known = records(spark, ("cat", "isa", "mammal", "user", 0.9), ("cat", "has", "fur", "induced", 0.5))
    asked = spark.createDataFrame([("cat",), ("cat",), ("bird",)], "subject string")
    rows = {r["s"]: r for r in briefs.subjects(f, known, asked).collect()}
    cat = rows["cat"]
    assert (cat["n_facts"], cat["facts"], cat["denials"], cat["parents"], cat["siblings"], cat["sources"], cat["n_derived"], cat["n_asked"]) == (4, "isa=mammal, has=fur, color=black, lives_in=old_town", "has=wings", "mammal", "cow, dog", "induced:1,user:1", 1, 2)
    assert rows["dog"]["siblings"] == "cat, cow" and rows["mammal"]["siblings"] == "" and "bird" not in rows
    over = {r["s"]: r["overview"] for r in briefs.overviews(f).collect()}
    assert over["cat"] == "A cat is a mammal.\n\ncat lives in old town.\n\nThe cat is black.\n\nThe cat has fur.\n\nThe not has of cat is wings."
    brief = {r["topic"]: r["brief"] for r in briefs.briefs(f, known).collect()}
    assert brief["mammal"] == (
        "# Research brief: Mammal\n\n## Overview\n\nA mammal is a animal.\n\n## Classification\n\nmammal is classified as: animal\n\n## Instances\n\nKnown instances or subtypes of mammal include: cat, dog, cow.\n\n"
        "## Relations\n\nmammal is the isa of cat, dog, cow.\n\n## Citations\n\nSource provenance for facts cited above:\n- (cat, isa, mammal) source: user\n- (cat, isa, mammal) source: user"
    )
    assert briefs.briefs(f.limit(0), known).count() == 0 and briefs.subjects(f.limit(0), known, asked).count() == 0


def test_clarifications(spark):
    answers = spark.createDataFrame([("p", "x", 1.0, 1), ("p", "y", 0.9, 2), ("p", "z", 0.2, 3), ("q", "x", 1.0, 1)], "probe string, value string, score double, rank int")
    f = facts(spark, ("paris", "isa", "city"), ("paris", "isa", "person"), ("rome", "isa", "city"))
    turns = spark.createDataFrame([(1, 0, "cat", False), (1, 1, None, True), (1, 2, "dog", False), (1, 3, "dog", False), (1, 4, None, True), (2, 0, None, True)], "conv long, turn long, entity string, pronoun boolean")
    assert got(briefs.clarifications(answers, f, turns), "about", "reason", "candidates") == {("p", "similar_confidence", "x, y"), ("paris", "entity_polysemy", "paris the city, paris the person"), ("1:4", "pronoun_ambiguity", "dog, cat")}


def test_sentences(spark):
    df = spark.createDataFrame([("big_cat", "isa", "cat", 0.3), ("x", "wrote", "y", 0.15), ("x", "likes", "y", 0.07), ("x", "is", "y", 0.0), ("x", "is", None, 0.9)], "s string, r string, o string, c double")
    out = [(r["a"], r["b"]) for r in df.select(phrases.sentence(F.col("s"), F.col("r"), F.col("o")).alias("a"), phrases.hedged(F.col("o"), F.col("c")).alias("b")).collect()]
    assert out == [("A big cat is a cat.", "I know it's cat."), ("x wrote y.", "I think y, but I'm not certain."), ("The likes of x is y.", "I'm not really sure, but maybe y."), ("The x is y.", "I don't know."), (None, "I don't know.")]
    names = spark.createDataFrame([("Made of",), ("kind",), (" likes ",)], "n string").select(phrases.relation_name(F.col("n")).alias("x")).collect()
    assert [r["x"] for r in names] == ["madeof", "isa", "likes"]


def test_whole_pass_is_kept_as_a_session(spark, tmp_path):
    f = facts(spark, ("o", "partof", "c"), ("c", "locatedin", "n"), ("n", "locatedin", "r"), ("c", "locatedin", "m"), ("x", "isa", "y"), ("y", "not_has", "z"))
    known = spark.createDataFrame([("c", "locatedin", "n", "user", 0.9, 1, 1.0), ("c", "locatedin", "m", "external", 0.9, 1, 1.0)], HOW)
    skills = spark.createDataFrame([(["isa", "has"], 9, 1), (["isa", "has", "has"], 8, 0)], "pattern array<string>, success long, failure long")
    seen = spark.createDataFrame([(k, "s", "r", "known", "a") for k in range(4)], "id long, subject string, relation string, state string, symbol string")
    out = upkeep.passed(f, known, skills, seen, [(["partof", "locatedin"], "locatedin")], 2, path=str(tmp_path / "s"))
    n = {r["step"]: r["n"] for r in out["report"].collect()}
    assert n["conflicts"] == 1 and n["negations"] == 1 and n["episodes_consolidated"] == n["answers_ready"] == 1 and n["skills_promoted"] == 0
    kept = sessions.load(spark, str(tmp_path / "s"))
    assert ("c", "locatedin", "m") not in got(kept["facts"], *TRIPLE) and ("x", "not_has", "z") in got(kept["facts"], *TRIPLE) and ("o", "locatedin", "r") in got(kept["facts"], *TRIPLE)
    assert got(kept["facts"].where("s = 'o' AND r = 'locatedin'"), "o", "how") == {("n", "induced"), ("m", "induced"), ("r", "induced")}


def test_texts_are_edited(spark):
    from factloom.functions import text
    from factloom.operators import calibrate, writing

    df = spark.createDataFrame([(1, "The cat is an animal. it has fur. It has fur! a apple is a fruit. Why? so."), (2, "One only"), (3, ""), (4, None)], "id long, text string")
    t = F.col("text")
    rows = {r["id"]: r for r in df.select("id", writing.shortened(t).alias("a"), writing.polished(t).alias("b"), writing.summarised(t).alias("c")).collect()}
    assert rows[1]["a"] == "The cat is an animal. it has fur. It has fur!" and rows[2]["a"] == "One only" and rows[3]["a"] == ""
    assert rows[1]["b"] == "The cat is an animal. Also, it has fur. Additionally, it has fur! Moreover, an apple is a fruit. And why? Plus, so." and rows[4]["b"] is None
    assert rows[1]["c"].startswith("Summary:\n- cat isa animal\n- it has fur") and rows[2]["c"] == "One only" and rows[4]["c"] == ""
    f = facts(spark, ("cat", "isa", "animal"), ("cat", "color", "black"), ("cat", "has", "claws"), ("cat", "size", "small"))
    out = {r["id"]: r["text"] for r in writing.expanded(df, f).collect()}
    assert out[1].startswith("The cat is an animal. Note also: the color of cat is black. Note also: the size of cat is small. it has fur.") and set(out) == {1, 2, 3, 4}
    probes = spark.createDataFrame([("p", "what color?", "cat", "color"), ("q", "what?", "kitten", "color"), ("z", "who?", "dog", "color")], "probe string, question string, s string, r string")
    told = {r["probe"]: (r["answer"], r["told"]) for r in writing.narrated(f.union(facts(spark, ("kitten", "isa", "cat"))), probes).collect()}
    assert told["p"] == ("black", 'Let me think about "what color?"... I know that The cat is black. So the answer is black.') and told["q"][0] == "black" and "So I can infer that The kitten is black." in told["q"][1] and told["z"][0] is None
    values = spark.createDataFrame([(i, float(i)) for i in range(100)] + [(200, None)], "k long, v double").repartition(4)
    assert got(calibrate.percentiles(values, "v", "k"), "share", "value") == {(0.5, 50.0), (0.95, 95.0), (0.99, 99.0), (1.0, 99.0)}
    assert calibrate.percentiles(values.limit(0), "v", "k").count() == 0
    assert [r["f"] for r in spark.createDataFrame([(0,), (5,), (20,), (21,), (-1,)], "n int").select(text.factorial(F.col("n")).alias("f")).collect()] == [1, 120, 2432902008176640000, None, None]
