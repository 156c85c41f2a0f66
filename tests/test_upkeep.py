"""Rules that the registered queries' data don't reach, on small fixtures."""

import math

import pytest

from factloom.functions import text
from factloom.operators import analytics, calibrate, chains, derivations, derive, pattern, upkeep, vectors
from factloom.plans import ranks
from factloom.sources import triples


def facts(spark, *rows):
    return spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "seq long, s string, r string, o string")


def test_probes_without_a_known_role_all_get_the_first_values(spark):
    f = facts(spark, ("a", "r", "x"), ("b", "r", "y"), ("c", "r", "x"), ("d", "r", "z"))
    probes = spark.createDataFrame([("p",), ("q",)], "probe string")
    got = sorted((r["probe"], r["rank"], r["value"]) for r in pattern.query(f, probes, "o", 2).collect())
    assert got == [("p", 1, "x"), ("p", 2, "y"), ("q", 1, "x"), ("q", 2, "y")]
    with pytest.raises(ValueError):
        pattern.query(f, probes, "o", None)
    assert pattern.query(f.limit(0), probes, "o", 2).count() == 0


def test_places_are_global_and_gapless(spark):
    rows = spark.range(5000).selectExpr("id % 7 AS a", "id").repartition(6)
    got = ranks.numbered(rows, "a", "id").collect()
    assert [(r["a"], r["id"]) for r in sorted(got, key=lambda r: r["place"])] == sorted((r["a"], r["id"]) for r in got)
    assert sorted(r["place"] for r in got) == list(range(5000))
    assert ranks.numbered(rows.limit(0), "a", "id").count() == 0


def steps_of(samples):
    """Pooling written as plainly as can be."""
    table = {}
    for score, ok in samples:
        table.setdefault(score, []).append(ok)
    def pool(blocks):
        blocks = list(blocks)
        k = 0
        while k + 1 < len(blocks):
            (_, t, n), (u, x, m) = blocks[k], blocks[k + 1]
            if t / n >= x / m - 1e-15:
                blocks[k : k + 2] = [(u, t + x, n + m)]
                k = max(0, k - 1)
            else:
                k += 1
        return blocks

    first = pool((s, float(sum(v)), float(len(v))) for s, v in sorted(table.items()))
    return [(u, t / n, n) for u, t, n in pool((u, (t + 1) / (n + 2) * n, n) for u, t, n in first)]


def test_isotonic_steps_and_equal_bins(spark):
    samples = [((k * 37 % 101) / 101, (k * 53 % 97) / 97 < (k * 37 % 101) / 101) for k in range(1003)]
    df = spark.createDataFrame([(k, s, ok) for k, (s, ok) in enumerate(samples)], "id long, score double, correct boolean").repartition(5)
    want = steps_of(samples)
    got = sorted((r["upto"], r["probability"], r["n"]) for r in calibrate.isotonic(df).collect())
    assert len(got) == len(want) > 3 and all(math.isclose(x, y, abs_tol=1e-9) for g, w in zip(got, want) for x, y in zip(g, w))
    bins = sorted(calibrate.reliability(df, "id").collect())
    assert [r["n"] for r in bins] == [101] * 3 + [100] * 7
    ordered = sorted((s, k, ok) for k, (s, ok) in enumerate(samples))
    at = 0
    for r in bins:
        own = ordered[at : at + r["n"]]
        at += r["n"]
        mean = sum(s for s, _, _ in own) / len(own)
        assert math.isclose(r["mean_score"], mean, abs_tol=1e-9) and math.isclose(r["accuracy"], sum(ok for _, _, ok in own) / len(own), abs_tol=1e-9)
        assert math.isclose(r["calibrated"], next((p for u, p, _ in want if u >= mean), want[-1][1]), abs_tol=1e-9)
    few = sorted(calibrate.reliability(df.where("id < 4"), "id").collect())
    assert [(r["bin"], r["n"]) for r in few] == [(0, 1), (1, 1), (2, 1), (3, 1)]


def test_negations_with_and_without_apostrophe(spark):
    rows = spark.createDataFrame([("It isnt  red",), ("aren't they",), ("nothing  ever",), ("knot",)], "q string")
    got = [(r[0], r[1]) for r in rows.select(text.has_negation(rows.q), text.strip_negation(rows.q)).collect()]
    assert got == [(True, "It red"), (True, "they"), (True, "ever"), (False, "knot")]


def test_sentences_and_corrections(spark):
    said = ["Paris is the capital of France.", "The sky is blue", "Ana lives in Rome.", "Bell invented the telephone.", "Wood is in the shed", "A b c d", "", None, "The color of the Sky is blue..", "\u00c9mile wrote Germinal"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(said)], "k long, t string")
    got = {r["k"]: (r["s"], r["r"], r["o"]) for r in rows.select("k", triples.extract(rows.t).alias("f")).where("f IS NOT NULL").select("k", "f.*").collect()}
    assert got == {0: ("france", "capital", "paris"), 1: ("sky", "is", "blue"), 2: ("ana", "lives_in", "rome"), 3: ("bell", "invented", "telephone"), 4: ("wood", "locatedin", "shed"), 8: ("sky", "color", "blue"), 9: ("\u00e9mile", "wrote", "germinal")}
    fixes = spark.createDataFrame([("Actually, the sky is blue, not red.",), ("The size of Mars is small, not big",), ("no the cat is black",), ("Grass is actually a plant.",), ("grass is green",), (None,)], "t string")
    got = sorted(tuple(r) for r in triples.corrections(fixes, "t").collect())
    assert got == [("forget", "mars", "size", "big"), ("forget", "sky", "is", "red"), ("store", "cat", "is", "black"), ("store", "grass", "is", "plant"), ("store", "mars", "size", "small"), ("store", "sky", "is", "blue")]


def test_rules_cascade_until_nothing_is_new(spark):
    f = facts(spark, ("a", "in", "b"), ("b", "in", "c"), ("c", "in", "d"), ("d", "in", "e"), ("a", "not_far", "e"))
    got = {(r["s"], r["r"], r["o"]): r["round"] for r in derivations.rule_rounds(f, [(["in", "in"], "in"), (["in", "in", "in"], "far")]).collect()}
    assert got[("a", "in", "c")] == 1 and got[("a", "in", "e")] == 2 and ("a", "far", "e") not in got and got[("a", "far", "d")] == 1
    assert derivations.rule_rounds(f.limit(0), [(["in", "in"], "in")]).count() == 0


def test_nearest_goal_stops_at_its_depth(spark):
    f = facts(spark, ("a", "r", "b"), ("b", "r", "x1"), ("b", "r", "c"), ("c", "r", "x2"), ("d", "r", "a"))
    from pyspark.sql import functions as F

    got = sorted((r["start"], r["node"], r["hops"]) for r in chains.nearest_goal(f, spark.createDataFrame([("a",), ("d",), ("x1",)], "start string"), F.col("node").startswith("x")).collect())
    assert got == [("a", "x1", 2), ("d", "x1", 3)]


def test_similar_subjects_equal_brute_force(spark):
    rows = [(f"s{k}", r, str((k * m) % 5)) for k in range(40) for r, m in (("a", 1), ("b", 3), ("c", 7))]
    sets = {}
    for s, r, o in rows:
        sets.setdefault(s, set()).add((r, o))
    want = []
    for s, own in sets.items():
        near = sorted((-len(own & x), -len(own & x) / len(own | x), t) for t, x in sets.items() if t != s and own & x)[:10]
        want += [(s, t, -n, k + 1) for k, (n, _, t) in enumerate(near)]
    got = analytics.similar(facts(spark, *rows)).collect()
    assert sorted((r["s"], r["other"], r["overlap"], r["rank"]) for r in got) == sorted(want)


def test_replay_tells_another_base(spark):
    f = facts(spark, ("a", "r", "x"), ("b", "r", "y"), ("b", "r", "z"))
    probes = spark.createDataFrame([("p", "a", "r"), ("q", "b", "r"), ("n", "c", "r")], "probe string, s string, r string")
    records = upkeep.decisions(f, probes)
    assert {r["probe"]: r["verdict"] for r in upkeep.replayed(records, f).collect()} == {"p": "verified", "q": "verified", "n": "verified"}
    assert {r["verdict"] for r in upkeep.replayed(records, f.limit(2)).collect()} == {"state mismatch"}
    from pyspark.sql import functions as F

    assert {r["verdict"] for r in upkeep.replayed(records.withColumn("top", F.lit("w")), f).collect()} == {"diverged"}


def test_consolidation_forgets_and_abstracts(spark):
    f = facts(spark, *[(f"k{i}", "isa", "dog") for i in range(5)], *[(f"k{i}", "has", "tail") for i in range(5)], ("k0", "has", "tail"))
    records = spark.createDataFrame([("k1", "has", "tail", "user", 0.01, 1, 0.0)], "s string, r string, o string, source string, confidence double, count long, last_seen double")
    seen = spark.createDataFrame([], "subject string, relation string")
    out = upkeep.consolidated(f, records, seen)
    left = {tuple(r) for r in out["facts"].collect()}
    assert ("dog", "has", "tail") in left and ("k1", "has", "tail") not in left and len(left) == 10
    assert {r["step"]: r["n"] for r in out["report"].collect()} == {"promotions": 0, "contradictions": 0, "duplicates": 1, "abstractions": 1, "forgotten": 1}
    assert out["provenance"].count() == 0


def test_clean_up_in_blocks(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(vectors, "QUERY_BLOCK", 7)
    monkeypatch.setattr(vectors, "SYMBOL_BLOCK", 5)
    rng = np.random.default_rng(5)
    q, w = rng.normal(size=(20, 6)), rng.normal(size=(30, 6))
    w[3] = 0
    book = spark.createDataFrame([(f"w{k:02}", v.tolist()) for k, v in enumerate(w)], "symbol string, w array<double>")
    got = vectors.clean_up(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(q)], "query long, v array<double>"), book).collect()
    n = np.linalg.norm(w, axis=1)
    n[3] = 1
    for k in range(20):
        s = w @ q[k] / n / np.linalg.norm(q[k])
        own = [(r["symbol"], r["score"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query"] == k]
        assert [x for x, _ in own] == [f"w{i:02}" for i in np.argsort(-s)[:3]] and np.allclose([x for _, x in own], np.sort(s)[::-1][:3])


def test_decisions_in_many_small_tasks(spark, monkeypatch):
    """Decisions are stored step by step, and replayed in tasks of so many records."""
    from factloom.sources import scratch

    f = spark.createDataFrame([(k, f"c{k}", "locatedin", f"n{k % 3}") for k in range(40)], "seq long, s string, r string, o string")
    monkeypatch.setattr(scratch, "ROWS", 4)
    records = upkeep.decisions(f, f.selectExpr("s AS probe", "s", "r"))
    assert "Join" not in records._jdf.queryExecution().toString()
    out = upkeep.replayed(records, f)
    assert [(r["verdict"], r["count"]) for r in out.groupBy("verdict").count().collect()] == [("verified", 40)]
    assert records.where("state = 'known'").count() == 40
