"""Hand-made scenes of a few facts."""

import pytest
from pyspark.sql import functions as F

from factloom.functions import confidence, text
from factloom.operators import analytics, beliefs, calibrate, chains, derive, episodes, pattern, provenance, sets, writing
from factloom.plans import star
from factloom.sources import scratch, triples
from factloom.streaming import twins

from .conftest import SF


def facts(spark, *rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "seq long, s string, r string, o string")


def got(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


STAIRS = (("a", "isa", "b"), ("b", "isa", "c"), ("c", "isa", "d"))


def test_cascade_climbs_the_stairs(spark):
    assert got(derive.cascade(facts(spark, *STAIRS)), "s", "o") == [("a", "c"), ("a", "d"), ("b", "d")]


def test_cascade_respects_denials(spark):
    f = facts(spark, *STAIRS, ("a", "not_isa", "c"))
    assert ("a", "c") not in got(derive.cascade(f), "s", "o")


def test_walk_and_partial_walk(spark):
    f = facts(spark, *STAIRS)
    starts = spark.createDataFrame([("a",), ("c",)], "start string")
    assert got(chains.walk(f, starts, ["isa", "isa"]), "start", "answer", "hops") == [("a", "c", 2), ("c", None, 1)]
    with pytest.raises(ValueError):
        chains.walk(f, starts, ["isa"], ["sideways"])


def test_walk_takes_the_first_object(spark):
    f = facts(spark, ("a", "isa", "b"), ("b", "isa", "c1"), ("b", "isa", "c2"))
    assert got(chains.walk(f, spark.createDataFrame([("a",)], "start string"), ["isa", "isa"]), "answer") == [("c1",)]


def test_discover_forward_and_reverse(spark):
    f = facts(spark, ("france", "capital", "paris"), ("france", "locatedin", "europe"), ("spain", "locatedin", "europe"))
    probes = spark.createDataFrame([("p", "paris", "spain")], "probe string, start string, goal string")
    assert chains.discover(f, probes).count() == 0
    assert got(chains.discover(f, probes, reverse=True), "relations") == [("~capital,locatedin,~locatedin",)]


def test_epistemic_states(spark):
    f = facts(spark, ("x", "r", "1"), ("y", "r", "1"), ("y", "r", "2"))
    probes = spark.createDataFrame([(k, k, "r") for k in "xyz"], "probe string, s string, r string")
    assert got(pattern.epistemic(f, probes), "probe", "state", "top") == [("x", "known", "1"), ("y", "ambiguous", "1"), ("z", "idk", None)]


def test_unknown_role_must_be_unknown(spark):
    with pytest.raises(ValueError):
        pattern.query(facts(spark, *STAIRS), spark.createDataFrame([("p", "a")], "probe string, s string"), "s")


def test_infer_and_boolean(spark):
    f = facts(spark, ("cat", "isa", "mammal"), ("mammal", "has", "fur"), ("cat", "color", "black"))
    probes = spark.createDataFrame([("1", "cat", "has"), ("2", "cat", "color"), ("3", "cat", "size")], "probe string, s string, r string")
    assert got(pattern.infer(f, probes), "probe", "answer", "how") == [("1", "fur", "inherited"), ("2", "black", "direct"), ("3", None, "none")]
    asked = [("1", "cat", "isa", "mammal"), ("2", "cat", "color", "white"), ("3", "cat", "has", "fur"), ("4", "cat", "has", "wings")]
    out = pattern.boolean(f, spark.createDataFrame(asked, "probe string, s string, r string, o string"))
    assert got(out, "probe", "verdict", "how") == [("1", True, "isa-transitive"), ("2", False, "contradicted"), ("3", True, "inferred"), ("4", None, None)]


def test_conflict_keeps_the_users_word(spark):
    f = facts(spark, ("fish", "isa", "vegetable"), ("fish", "isa", "animal"))
    p = spark.createDataFrame([("fish", "isa", "animal", "user", 0.5, 1, 1.0), ("fish", "isa", "vegetable", "induced", 0.9, 5, 2.0)], "s string, r string, o string, source string, confidence double, count long, last_seen double")
    assert got(beliefs.resolve(f, p), "o", "keep", "reason") == [("animal", True, "source"), ("vegetable", False, "source")]


def test_negation_goes_to_members(spark):
    f = facts(spark, ("mammal", "not_has", "feathers"), ("cat", "isa", "mammal"), ("duck", "isa", "mammal"), ("duck", "has", "feathers"))
    assert got(derive.propagate_negations(f), "s", "r", "o") == [("cat", "not_has", "feathers")]


def test_forget_takes_the_first_match(spark):
    f = facts(spark, ("a", "r", "x"), ("a", "r", "x"), ("a", "r", "y"))
    left = sets.forget(f, spark.createDataFrame([("a", "r", "x")], "s string, r string, o string"))
    assert got(left, "seq") == [(1,), (2,)]


def test_similarity_gaps_and_abstraction(spark):
    f = facts(spark, ("dog", "has", "fur"), ("dog", "has", "tail"), ("cat", "has", "fur"), ("cat", "has", "tail"), ("cat", "color", "black"))
    assert got(analytics.similar(f), "s", "other", "overlap")[0] == ("cat", "dog", 2)
    zoo = facts(spark, *[(k, "isa", "mammal") for k in "abcd"], *[(k, "has", "fur") for k in "abc"])
    assert got(analytics.gaps(zoo), "s", "r", "support") == [("d", "has", 3)]
    assert got(analytics.abstractions(zoo), "parent", "o", "support", "known") == [("mammal", "fur", 3, False)]


def test_votes(spark):
    v = spark.createDataFrame([("p", "1", "x", 1.0), ("p", "2", "x", 1.0), ("p", "3", "y", 1.0), ("p", "4", None, 0.0)], "probe string, voter string, value string, score double")
    assert got(beliefs.majority(v), "winner", "n_votes", "abstained") == [("x", 2, 1)]


def test_fold_ignores_forgets_before_stores(spark):
    log = spark.createDataFrame([(1, "forget", "a"), (2, "store", "a"), (3, "store", "b"), (4, "forget", "b"), (5, "forget", "b"), (6, "store", "b")], "seq long, op string, s string").withColumn("r", F.lit("r")).withColumn("o", F.lit("o"))
    assert got(episodes.folded(log), "s", "n") == [("a", 1), ("b", 1)]


def test_streams_equal_their_batch_twins(spark, tmp_path):
    log = spark.createDataFrame([(k, "forget" if k % 3 == 0 else "store", f"s{k % 4}", "r", "o") for k in range(1, 40)], "seq long, op string, s string, r string, o string")
    log.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(log.schema).parquet(str(tmp_path / "in"))
    twins.run_once(twins.fold_stream(stream), lambda df, k: df.write.mode("overwrite").parquet(str(tmp_path / "out")), str(tmp_path / "cp"), "update")
    assert got(spark.read.parquet(str(tmp_path / "out")).where("n > 0"), "s", "n") == got(episodes.folded(log), "s", "n")
    spark.sql("SELECT 1").collect()


def test_streams_over_many_batches_work_on_buckets(spark, tmp_path):
    """Several micro-batches with keys of all kinds give the batch operators' rows; Python is called for buckets, not for each key."""
    many = [(k, "forget" if k * 7 % 5 < 2 else "store", None if k % 11 == 0 else f"s{k * k % 37}", "r", f"o{k % 3}") for k in range(600)]
    log = spark.createDataFrame(many, "seq long, op string, s string, r string, o string")
    e = log.select(F.expr("seq + 9007199254740993 AS id"), F.expr("timestamp'2024-01-01' + make_interval(0,0,0,0,0,seq)").alias("ts"), F.col("s").alias("subject"), F.col("o").alias("relation"), F.when(F.col("seq") % 4 != 0, F.col("op")).alias("state"), F.when(F.col("seq") % 3 != 0, "x").alias("symbol"))
    for rows, through, mode in ((log, twins.fold_stream, "update"), (e, twins.drift_stream, "append")):
        at = tmp_path / through.__name__
        for k in range(3):
            rows.where(F.floor(F.col(rows.columns[0]) % 600 / 200) == k if rows is log else F.floor((F.col("id") - 9007199254740993) / 200) == k).coalesce(1).write.mode("append").parquet(str(at / "in"))
            stream = spark.readStream.schema(rows.schema).parquet(str(at / "in"))
            twins.run_once(through(stream), lambda df, b, at=at: df.withColumn("b", F.lit(b)).write.mode("append").parquet(str(at / "out")), str(at / "cp"), mode)
    fold = spark.read.parquet(str(tmp_path / "fold_stream" / "out")).groupBy("s", "r", "o").agg(F.max_by("n", "b").alias("n")).where("n > 0")
    key = lambda rows: sorted(map(str, rows))
    assert key(map(tuple, fold.collect())) == key(map(tuple, episodes.folded(log).collect()))
    drift = spark.read.parquet(str(tmp_path / "drift_stream" / "out")).drop("b")
    assert key(map(tuple, drift.collect())) == key(map(tuple, episodes.drift(e).collect()))
    plan = twins.fold_stream(spark.readStream.schema(log.schema).parquet(str(tmp_path / "fold_stream" / "in")))._jdf.queryExecution().analyzed().toString()
    assert "_bucket" in plan


def test_polished_keeps_digits(spark):
    """A sentence's place isn't trimmed from it, spaces are."""
    rows = spark.createDataFrame([("0997 is it. 1683 ndly. _b. b. 1683  ndly. 1683 ndly.",), ("",), (None,)], "t string")
    assert [r[0] for r in rows.select(writing.polished(F.col("t"))).collect()] == ["0997 is it. Also, 1683 ndly. Additionally, b. Moreover, 1683  ndly.", "", None]
    other = spark.createDataFrame([("a egg, ba egg, chlla\u00eda egg.",)], "t string")  # accented letters end a word, as in SQL
    assert other.select(writing.polished(F.col("t"))).first()[0] == "An egg, ba egg, chlla\u00edan egg."


def test_windowed_tally(spark, tmp_path):
    rows = spark.sql("SELECT timestamp'2024-01-01' + make_interval(0,0,0,0,id) AS ts, IF(id % 2 = 0, 'known', 'idk') AS state FROM range(48)")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    twins.run_once(twins.tally_stream(stream), lambda df, k: df.write.mode("overwrite").parquet(str(tmp_path / "out")), str(tmp_path / "cp"), "complete")
    assert {r["n"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {12}


def test_sources(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"s":"Cat ","r":"isa","o":"Mammal","x":1}\n\n{"s":"","r":"isa","o":"y"}\n')
    assert got(triples.read_jsonl(spark, str(tmp_path / "a.jsonl")), "s", "r", "o") == [("cat", "isa", "mammal")]
    (tmp_path / "a.csv").write_text("s;r;o\nA;isa;B\n;isa;C\n")
    assert got(triples.read_csv(spark, str(tmp_path / "a.csv"), ";"), "s", "o") == [("a", "b")]
    (tmp_path / "g.tsv").write_text('x\t/r/IsA\t/c/en/cat/n\t/c/en/animal\t{"weight": 2.0}\nx\t/r/IsA\t/c/fr/chat\t/c/en/animal\t3\nx\t/r/Odd\t/c/en/a\t/c/en/b\t3\nx\t/r/HasA\t/c/en/cat\t/c/en/tail\t0.5\n')
    assert got(triples.read_weighted_graph(spark, str(tmp_path / "g.tsv")), "s", "r", "o", "confidence") == [("cat", "isa", "animal", 0.5)]
    log = tmp_path / "log.jsonl"
    line = '{"seq":%d,"op":"store","fact":{"S":"a","R":"r","O":"o"}}\n'
    log.write_text(line % 1 + line % 2 + '{"seq":3,"op":"st')
    assert triples.read_log(spark, str(log)).count() == 2
    log.write_text(line % 1 + "{broken\n" + line % 2)
    with pytest.raises(Exception, match="broken line"):
        triples.read_log(spark, str(log)).collect()


def test_text_functions(spark):
    df = spark.createDataFrame([("Hello, world! It is 5.",)], "t string")
    r = df.select(text.tokens(F.col("t")).alias("a"), F.size(text.sentences(F.col("t"))).alias("n"), text.detokenize(text.tokens(F.col("t"))).alias("d")).first()
    assert r["a"][:3] == ["hello", ",", "world"] and r["n"] == 2 and r["d"].startswith("hello, world!")
    n = spark.createDataFrame([("twenty_five",), ("two hundred",), ("three thousand five hundred",), ("1,250",), ("blue",), (None,)], "t string").select(text.number(F.col("t")).alias("n"))
    assert [r["n"] for r in n.collect()] == [25.0, 200.0, 3500.0, 1250.0, None, None]


def test_confidence(spark):
    df = spark.createDataFrame([([1.0, 0.5],), ([],)], "x array<double>").select(confidence.combine(F.col("x"), "product").alias("p"), confidence.combine(F.col("x"), "min").alias("m"))
    assert [(round(r["p"], 6), round(r["m"], 6)) for r in df.collect()] == [(0.475, 0.475), (0.0, 0.0)]


def test_isotonic_rises(spark):
    s = spark.createDataFrame([(k / 100, (k * 7) % 100 < k) for k in range(100)], "score double, correct boolean")
    p = [r["probability"] for r in calibrate.isotonic(s).orderBy("upto").collect()]
    assert p == sorted(p) and len(p) > 2


def test_explain_tree(spark):
    d = spark.createDataFrame([("f", "g"), ("f", "h"), ("g", "f")], "fact string, premise string")
    assert got(provenance.explain(d, spark.createDataFrame([("f",)], "root string")), "fact", "depth", "leaf") == [("f", 0, False), ("g", 1, False), ("h", 1, True)]


def test_empty_facts(spark):
    f = facts(spark, ("a", "r", "b")).limit(0)
    assert derive.cascade(f).count() == 0 and analytics.cooccurrence(f).count() == 0 and beliefs.functional_conflicts(f).count() == 0


def test_similar_ranks_by_class(spark):
    """Others are ranked once for each class: no subject's rows are sorted again."""
    f = facts(spark, *[(f"s{k:02}", "has", f"x{k % 2}") for k in range(30)], *[(f"s{k:02}", "size", "big") for k in range(30)])
    out = analytics.similar(f, least=2, top=3)
    assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert {(r["s"], r["other"], r["rank"]) for r in out.where("s IN ('s02', 's29')").collect()} == {("s02", "s00", 1), ("s02", "s04", 2), ("s02", "s06", 3), ("s29", "s01", 1), ("s29", "s03", 2), ("s29", "s05", 3)}


def test_long_skills_are_counted_once(spark):
    """Skills are stored counts: what reads them twice joins no links again."""
    from factloom import registry

    skills = registry._long_skills(spark, "/root/testdata/sf0.001")
    assert "Join" not in skills._jdf.queryExecution().optimizedPlan().toString()
    assert skills.schema["success"].dataType.simpleString() == "bigint" and {tuple(r["pattern"]) for r in skills.collect()} >= {("partof", "category"), ("partof", "locatedin", "locatedin")}


def test_siblings_make_pairs_last(spark):
    rows = [(f"s{k}", "isa", p) for k in range(12) for p in ("a", "b", "c") if k % (ord(p) - 95)] + [("s1", "isa", "b"), ("z", "isa", "alone"), ("s1", "has", "x")]
    out = chains.siblings(facts(spark, *rows))
    kids = {(s, o) for s, r, o in rows if r == "isa"}
    shared = {}
    for s, o in kids:
        for t, p in kids:
            if o == p and s != t:
                shared[s, t] = shared.get((s, t), 0) + 1
    assert {(r["s"], r["sibling"]): r["n_shared"] for r in out.collect()} == shared and out.count() == len(shared)
    assert "Aggregate" not in out._jdf.queryExecution().executedPlan().toString()  # pairs of subjects aren't moved to be counted


def test_successors_are_dealt_once(spark):
    texts = spark.createDataFrame([(1, ["a", "b", "c", "a", "b", "d", "a", "b", "d"]), (2, ["a"])], "id long, w array<string>")
    out = episodes.successors(texts, "id", F.col("w"), 2, 2)
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert ("a b", "d", 2, 1) in got(out, "context", "next", "n", "rank") and ("a b", "c", 1, 2) in got(out, "context", "next", "n", "rank")


def test_beliefs_in_many_small_tasks(spark, monkeypatch):
    """What suppliers hold is dealt to tasks of so many rows, at first and when it is joined with what is stored."""
    held = star.beliefs(spark, SF)
    whole = sorted(map(tuple, chains.beliefs_and_truth(held, star.facts(spark, SF, "P2")).collect()))
    monkeypatch.setattr(scratch, "ROWS", 500)
    few = star.beliefs(spark, SF)
    assert few.rdd.getNumPartitions() == -(-star.table(spark, SF, "lineitem").count() // 500)
    out = chains.beliefs_and_truth(few, star.facts(spark, SF, "P2"))
    assert out.rdd.getNumPartitions() == -(-held.count() // 500) and sorted(map(tuple, out.collect())) == whole


def test_verdicts_in_many_small_tasks(spark, monkeypatch):
    """Verdicts are the same in tasks of few rows, and stored, so that no task sorts for all their joins at once."""
    f = spark.createDataFrame([(k, f"p{k}", "isa", "tool") for k in range(30)] + [(100 + k, f"p{k}", "size", "small") for k in range(30)], "seq long, s string, r string, o string")
    asked = f.select("s", "r", "o").union(f.where("r = 'size'").select("s", "r", F.lit("huge"))).select(F.concat_ws("|", "s", "r", "o").alias("probe"), "s", "r", "o")
    whole = pattern.boolean(f, asked)
    assert "Join" not in whole._jdf.queryExecution().toString()
    monkeypatch.setattr(scratch, "ROWS", 7)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    assert sorted(map(tuple, pattern.boolean(f, asked).collect())) == sorted(map(tuple, whole.collect()))
    assert whole.groupBy("verdict").count().collect() and whole.where("verdict").count() == 60 and whole.where("NOT verdict").count() == 30
    assert spark.conf.get("spark.sql.shuffle.partitions") == before


def test_similar_subjects_may_share_one_fact(spark):
    """Parts have two facts each; others that share only one of them are similar too."""
    from factloom import registry

    parts = {r["p_partkey"]: {("b", r["p_brand"]), ("s", min(-(-max(r["p_size"], 1) // 10), 5))} for r in star.table(spark, SF, "part").collect()}
    got = {}
    for r in registry.similar_entities(spark, SF).collect():
        got.setdefault(r["s"], []).append((r["rank"], r["overlap"], r["other"]))
    names = {f"part#{k}": x for k, x in parts.items()}
    for s, own in names.items():
        near = sorted((-len(own & x), t) for t, x in names.items() if t != s and own & x)[:10]
        assert sorted(got[s]) == [(k + 1, -n, t) for k, (n, t) in enumerate(near)]
    assert {n for x in got.values() for _, n, _ in x} == {1, 2}
