"""Derivations, search, replay, dialogues, questions, corpora and sessions on small fixtures, beside plain Python."""

import math
import random
import time

import pytest
from pyspark.sql import functions as F

from factloom.functions import expression, questions
from factloom.operators import corpus, derivations, derive, dialogue, kinship, provenance, replay, router, search
from factloom.plans import ranks
from factloom.sources import sessions
from factloom.streaming import twins

TRIPLE = ("s", "r", "o")


def facts(spark, *rows):
    return spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "seq long, s string, r string, o string").repartition(3)


def records(spark, *rows):
    return spark.createDataFrame(list(rows), "s string, r string, o string, source string, confidence double")


def got(df, *cols):
    return {tuple(r[c] for c in cols) for r in df.collect()}


def test_closure_keeps_the_best_derivation(spark):
    f = facts(spark, ("a", "isa", "b"), ("a", "isa", "c"), ("b", "isa", "d"), ("c", "isa", "d"), ("d", "isa", "e"), ("a", "not_isa", "x"), ("d", "isa", "x"), ("e", "has", "tail"))
    known = records(spark, ("a", "isa", "b", "user", 0.5), ("b", "isa", "d", "user", 0.5), ("a", "isa", "c", "user", 0.9), ("c", "isa", "d", "external", 0.9), ("d", "isa", "e", "user", 1.0))
    rows = {(r["s"], r["r"], r["o"]): r for r in derivations.closure(f, known).collect()}
    best = rows["a", "isa", "d"]
    assert (best["mid"], best["hops"], best["round"], best["n_user"], best["n_other"]) == ("c", 2, 1, 1, 1)
    assert math.isclose(best["confidence"], 0.9 * 0.95, rel_tol=1e-5)
    far = rows["a", "isa", "e"]
    assert (far["hops"], far["total"], far["depth"], far["n_induced"]) == (3, 5, 3, 2)
    assert math.isclose(far["confidence"], (0.9 * 0.9 * 1.0) ** (1 / 3) * 0.95**2, rel_tol=1e-5)
    assert ("a", "isa", "x") not in rows and ("b", "isa", "x") in rows
    assert rows["a", "has", "tail"]["n_unknown"] == 1
    assert {k for k in rows} == got(derive.cascade(f), *TRIPLE)
    derived = derivations.closure(f, known)
    tree = provenance.explain(derivations.premises(derived), derived.where("s = 'a' AND o = 'e'").select(derivations.key(*TRIPLE).alias("root")))
    assert {(r["fact"], r["leaf"]) for r in tree.collect() if r["leaf"]} == {("a|isa|c", True), ("c|isa|d", True), ("d|isa|e", True)}
    assert derivations.closure(f.limit(0), known).count() == 0


def test_records_take_tells(spark):
    how = "array<struct<s:string,r:string,o:string>>"
    old = spark.createDataFrame([("a", "isa", "b", "user", 0.5, 2, 10.0, None)], f"s string, r string, o string, source string, confidence double, count long, last_seen double, derivation {how}")
    tells = [("a", "isa", "b", "rule", 0.9, 20.0, [("x", "y", "z")]), ("a", "isa", "b", "rule", 0.9, 30.0, None), ("n", "isa", "m", "induced", 0.4, 5.0, None), ("n", "isa", "m", "induced", 0.8, 4.0, None)]
    rows = {r["s"]: r for r in derivations.recorded(old, spark.createDataFrame(tells, f"s string, r string, o string, source string, confidence double, ts double, derivation {how}")).collect()}
    a, n = rows["a"], rows["n"]
    assert (a["source"], a["count"], a["last_seen"], a["derivation"][0]["s"]) == ("multi", 4, 30.0, "x") and math.isclose(a["confidence"], 1 - 0.5 * 0.81)
    assert (n["source"], n["count"], n["derivation"]) == ("induced", 2, None) and math.isclose(n["confidence"], 1 - 0.2 * 0.9)


def test_rules_run_with_the_confidence_they_have(spark):
    rows = [(f"x{i}", "in", f"m{i % 7}") for i in range(40)] + [(f"m{i}", "of", f"e{i % 3}") for i in range(7)] + [(f"x{i}", "not_far", f"e{(i % 7) % 3}") for i in range(0, 40, 4)] + [("x1", "far", "e1")]
    out = derivations.instances(facts(spark, *rows), [(["in", "of"], "far", 0.7), (["in", "in"], "far", 0.5)])
    tries = sorted((r["attempt"], r["s"], r["denied"], r["confidence"]) for r in out.collect())
    passed = 0
    order = [f"x{i}" for i in range(40) if i != 1]
    assert [t[1] for t in tries] == order and [t[0] for t in tries] == list(range(39))
    for k, (_, s, denied, sure) in enumerate(tries):
        assert denied == (int(s[1:]) % 4 == 0) and math.isclose(sure, 0.7 if k == 0 else (passed + 1) / (k + 2))
        passed += not denied
    with pytest.raises(ValueError):
        derivations.instances(facts(spark, *rows), [(["in", "in"], "far", 0.5)])


def test_rules_are_tried_in_slices(spark, monkeypatch, tmp_path):
    """Slices of subjects give what all facts give at once; of what was stored for it only the tries are left, and what was shuffled goes."""
    from factloom.sources import scratch

    rows = [(f"x{i}", "in", f"m{i % 7}") for i in range(60)] + [(f"m{i}", "of", f"e{i % 3}") for i in range(7)] + [(f"x{i}", "not_far", f"e{(i % 7) % 3}") for i in range(0, 60, 4)] + [("x1", "far", "e1")]
    f, rules = facts(spark, *rows), [(["in", "of"], "far", 0.7), (["of", "in"], "near", 0.4)]
    whole = sorted(map(tuple, derivations.instances(f, rules).collect()))
    monkeypatch.setattr(scratch, "folder", lambda spark: str(tmp_path))
    monkeypatch.setattr(derivations, "SLICE", 20)
    out = derivations.instances(f, rules)
    assert {p.name.partition("-")[0] for p in tmp_path.iterdir()} == {"ranges"}
    assert len(whole) == 59 and sorted(map(tuple, out.collect())) == whole
    bare = derivations.instances(f, rules, nodes=False)
    assert "nodes" not in bare.columns and sorted(map(tuple, bare.collect())) == sorted(map(tuple, out.drop("nodes").collect()))


def test_running_sums_are_made_as_rows_are_stored(spark):
    """Rows are dealt to ranges once: places and sums need no second exchange of all rows."""
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"), F.when(F.col("id") % 3 > 0, F.col("id") % 5).alias("v"))
    out = ranks.numbered(df, "k", sums={"upto": "v"})
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window") == 1 and "_range" in plan and out.columns == ["k", "v", "place", "upto"]
    total = 0
    for i, r in enumerate(sorted(out.collect())):
        assert (r["k"], r["place"], r["upto"]) == (i, i, total)
        total += r["v"] or 0


def test_beam_is_linear_on_hubs(spark):
    spokes = [(f"n{i}", "isa", "hub") for i in range(400)] + [(f"n{i}", "madeof", f"m{i % 40}") for i in range(400)] + [("n7", "near", "n8"), ("n8", "size", "goal"), ("m3", "size", "goal")]
    f = facts(spark, *spokes)
    ways = search.edges(f, reverse=True, beam=4)
    assert ways.groupBy("at", "r").count().agg(F.max("count")).first()[0] == 4
    probes = spark.createDataFrame([(f"n{i}", f"n{i}", "goal") for i in range(50)], "probe string, start string, goal string")
    out = {(r["probe"], r["rank"]): r for r in search.beam_search(ways, probes, depth=4, width=4, top=2).collect()}
    assert out["n7", 1]["relations"] == "near,size" and math.isclose(out["n7", 1]["confidence"], 0.95)
    assert out["n3", 1]["nodes"] == "n3>m3>goal" and len(out) <= 100
    scores = records(spark, ("n7", "near", "n8", "user", 0.2), ("n7", "isa", "hub", "user", 0.05))
    weak = search.edges(f, scores)
    assert weak.where("at = 'n7' AND r = 'isa'").count() == 0
    found = search.beam_search(weak, probes.where("probe = 'n7'"), depth=2).first()
    assert math.isclose(found["confidence"], math.sqrt(0.2) * 0.95, rel_tol=1e-5)
    skills = spark.createDataFrame([(["isa", "size"], 9, 1), (["size"], 5, 5), (["near"], 0, 0)], "pattern array<string>, success long, failure long")
    assert got(search.priorities(skills), "r", "priority") == {("isa", 8100), ("size", 10600), ("near", 0)}


def test_analogy_falls_back_to_chains(spark):
    f = facts(spark, ("paris", "capital", "france"), ("rome", "capital", "italy"), ("ann", "lives", "paris"), ("bob", "lives", "rome"), ("paris", "in", "france"), ("rome", "in", "italy"))
    probes = spark.createDataFrame([("p", "Paris", "france", "rome"), ("q", "ann", "france", "bob"), ("z", "ann", "nowhere", "bob")], "probe string, a string, b string, c string")
    out = {r["probe"]: r for r in search.analogies(f, probes, records(spark, ("paris", "in", "france", "user", 0.5), ("rome", "in", "italy", "user", 0.5))).collect()}
    joint = [math.exp(4 * 1.0), math.exp(4 * 0.25)]
    assert (out["p"]["relation"], out["p"]["answer"]) == ("capital", "italy") and math.isclose(out["p"]["probability"], joint[0] / sum(joint))
    assert (out["q"]["relation"], out["q"]["answer"], out["q"]["via"]) == ("lives -> capital", "italy", "chain") and "z" not in out


def test_replay_equals_one_run_for_each_candidate(spark):
    rng = random.Random(3)
    nodes = [f"n{i}" for i in range(12)]
    base = [(a, "isa", b) for a, b in {tuple(rng.sample(nodes, 2)) for _ in range(10)}] + [("n0", "not_isa", "n5")]
    more = [(k + 1, *t) for k, t in enumerate((a, "isa", b) for a, b in sorted({tuple(rng.sample(nodes, 2)) for _ in range(6)}))]
    f, c = facts(spark, *base), spark.createDataFrame(more, "candidate long, s string, r string, o string")
    run = lambda extra: got(derive.cascade(facts(spark, *base, *extra).select(*TRIPLE), 9), *TRIPLE)
    plain = run([])
    alone = got(replay.alone(f, c, 9), "candidate", *TRIPLE)
    assert alone == {(k, *x) for k, *t in more for x in run([tuple(t)]) - plain}
    told = {tuple(t) for _, *t in more}
    want, before = set(), plain
    for n in range(1, len(more) + 1):
        after = run([tuple(t) for _, *t in more[:n]])
        want |= {(n, *x) for x in after - before if x not in told}
        before |= after
    assert got(replay.in_order(f, c, 9), "candidate", *TRIPLE) == want
    summed = {r["candidate"]: r for r in replay.summed(replay.alone(f, c, 9), c).collect()}
    assert set(summed) == {k for k, *_ in more} and all(summed[k]["n"] == sum(x[0] == k for x in alone) for k in summed)


def test_carried_over_ranges(spark):
    rng = random.Random(5)
    rows = [("hot" if i % 3 else f"c{i % 11}" if i % 2 else None, i, rng.choice((None, None, f"v{i}"))) for i in range(600)]
    out = {r["t"]: r["last"] for r in ranks.carried(spark.createDataFrame(rows, "k string, t long, v string").repartition(8), "k", "t", {"last": "v"}).collect()}
    last = {}
    for k, t, v in rows:
        assert out[t] == last.get(k)
        last[k] = v if v is not None else last.get(k)


SPOKEN = [
    (1, 0, "what color is the sky?", "what color is the sky?", "sky", "color"), (1, 1, "what about the grass?", "what color is the grass?", "grass", "color"), (1, 2, "is it green?", "is grass green ?", None, None),
    (1, 3, "where is it?", "where is grass ?", "grass", "lives_in"), (1, 4, "and the sun", "what lives_in is the sun?", "sun", "lives_in"), (1, 5, "what about it?", "what lives_in is the sun?", "sun", "lives_in"), (1, 6, "them", "what lives_in is the sun?", "sun", "lives_in"),
    (2, 0, "what about the moon?", "what about the moon?", "moon", None), (2, 1, "it", "moon", "moon", None), (2, 2, "hello there", "hello there", None, None), (3, 0, None, None, None, None), (3, 1, "", "", None, None),
]


def test_dialogue(spark):
    turns = spark.createDataFrame([x[:3] for x in SPOKEN], "conv long, turn long, text string").repartition(4)
    out = {(r["conv"], r["turn"]): (r["question"], r["entity"], r["relation"]) for r in dialogue.resolved(turns).collect()}
    assert out == {x[:2]: x[3:] for x in SPOKEN}
    answered = dialogue.answered(facts(spark, ("sky", "color", "blue"), ("sun", "lives_in", "space")), dialogue.resolved(turns))
    said = {(r["conv"], r["turn"]): (r["answer"], r["before"]) for r in answered.collect()}
    assert said[1, 0] == ("blue", None) and said[1, 4] == ("space", "blue") and said[1, 6] == ("space", "space") and said[2, 1] == (None, None)


def test_long_turns_take_time_in_proportion(spark):
    """Words of a turn aren't taken apart again for each of its words."""
    said = "so " + "word " * 600 + "it and them"
    turns = spark.createDataFrame([(1, 0, "what size is the cat?"), *[(1, k, said) for k in range(1, 13)]], "conv long, turn long, text string")
    began = time.time()
    assert (5, said.replace("it", "cat")) in got(dialogue.resolved(turns), "turn", "question") and time.time() - began < 20


def test_dialogue_stream_and_its_end(spark, tmp_path):
    schema = "conv long, turn long, text string, ts timestamp"
    rows = [(x[0], x[1], x[2]) for x in SPOKEN]

    def run(part, day):
        spark.createDataFrame(part, "conv long, turn long, text string").withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000 + 86_400 * day) + F.col("turn"))).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        twins.run_once(dialogue.written(twins.referred(dialogue.read(stream), keep_ms=86_400_000)), lambda df, k: df.write.mode("append").parquet(str(tmp_path / "out")), str(tmp_path / "cp"))

    run([x for x in rows if x[1] < 3], 0)
    run([x for x in rows if x[1] >= 3], 0)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert {(r["conv"], r["turn"]): (r["question"], r["entity"], r["relation"]) for r in out.collect()} == {x[:2]: x[3:] for x in SPOKEN}
    run([(9, 0, "what size is the moon?")], 10)  # moves the watermark past the others' end
    run([(1, 7, "it")], 10)
    assert out.sparkSession.read.parquet(str(tmp_path / "out")).where("conv = 1 AND turn = 7").first()["question"] == "it"


def test_streams_leave_late_rows_out_and_count_them(spark, tmp_path):
    def run(seconds):
        rows = spark.createDataFrame([(i, "u", s) for i, s in seconds], "id long, subject string, s long").select("id", "subject", F.timestamp_seconds("s").alias("ts"))
        rows.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = twins.session_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), "10 seconds", "60 seconds")
        return twins.run_once(stream, lambda df, k: df.write.mode("append").parquet(str(tmp_path / "out")), str(tmp_path / "cp"))

    t = 1_700_000_000
    assert run([(1, t), (2, t + 5), (3, t + 30)]) == 0
    assert run([(4, t + 500)]) == 0
    assert run([(5, t + 1), (6, t + 900)]) == 1
    assert sorted(r["n"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 1, 2]


def test_questions(spark):
    asked = {
        "What is the capital of France?": ("factual", ("france", "capital")), "who wrote Hamlet?": ("factual", ("hamlet", "wrote")), "what does the cat have": ("factual", ("cat", "has")), "what is the table made of?": ("factual", ("table", "madeof")),
        "what causes rain?": ("factual", ("rain", "causedby")), "where does alice live?": ("factual", ("alice", "lives_in")), "when is easter?": ("factual", ("easter", "when")), "hello": ("factual", None), "": ("factual", None),
        "is a cat bigger than the mouse?": ("compare", None), "list all mammals": ("enumerate", None), "what animals are mammals": ("enumerate", ("mammals", "is")), "is the cat an animal?": ("boolean", None),
    }
    df = spark.createDataFrame([(q,) for q in asked], "q string")
    q = F.col("q")
    out = {r["q"]: r for r in df.select("q", questions.kind(q).alias("kind"), questions.factual(q).alias("f"), questions.yes_no(q).alias("y"), questions.listed(q).alias("l"), questions.compared(q).alias("c")).collect()}
    for text, (kind, fact) in asked.items():
        assert out[text]["kind"] == kind and (tuple(out[text]["f"]) if out[text]["f"] else None) == fact
    assert tuple(out["is the cat an animal?"]["y"]) == ("cat", "isa", "animal") and out["list all mammals"]["l"] == "mammal" and tuple(out["is a cat bigger than the mouse?"]["c"]) == ("cat", "mouse")


def test_router(spark):
    f = facts(spark, ("cat", "isa", "mammal"), ("dog", "isa", "mammal"), ("mammal", "isa", "animal"), ("mammal", "has", "fur"), ("cat", "size", "small"), ("dog", "size", "medium"), ("hamlet", "author", "shakespeare"), ("france", "capital", "paris"), ("paris", "mayor", "anne"), ("apple", "category", "fruit"))
    asked = [
        ("what is 6 * 7?", "42"), ("is the cat an animal?", "true"), ("is dog bigger than cat?", "dog"), ("list all mammals", "cat, dog"), ("list fruits", "apple"), ("what is the mayor of the capital of france?", "anne"), ("what kind is the big cat?", "mammal"),
        ("who wrote hamlet?", "shakespeare"), ("what does the cat have?", "fur"), ("what color is the dog?", None), ("nonsense", None), (None, None),
    ]
    rows = spark.createDataFrame([(i, q) for i, (q, _) in enumerate(asked)], "id long, text string")
    out = {r["id"]: r for r in router.routed(f, rows).collect()}
    assert {i: out[i]["answer"] for i in out} == {i: a for i, (_, a) in enumerate(asked)}
    assert out[7]["how"] == "via author" and out[8]["score"] == 0.7 and out[9]["score"] == 0.0


def test_expressions(spark):
    rng = random.Random(1)

    def make(depth):
        if not depth or rng.random() < 0.2:
            return str(rng.randint(1, 9))
        kind = rng.randrange(4)
        if kind == 0:
            return f"({make(depth - 1)})"
        if kind == 1:
            return f"abs({make(depth - 1)} - {make(depth - 1)})"
        return f"{make(depth - 1)} {rng.choice('+-*/%')} {make(depth - 1)}"

    said = [make(4) for _ in range(60)] + ["2^3^2", "-3 + 4", "2 * -3", "2 - -3", "-(2 + 3) * 2", "sqrt(16) + 1.5", "1,000 + 1"]
    want = []
    for x in said:
        try:
            want.append(float(eval(x.replace(",", "").replace("^", "**"), {"abs": abs, "sqrt": math.sqrt})))
        except ZeroDivisionError:
            want.append(None)
    none = ["", "sqrt(0 - 4)", "1 +", "(2", "2 2", "hello", None]
    out = spark.createDataFrame([(i, x) for i, x in enumerate([*said, *none])], "i int, x string").select("i", expression.evaluate(F.col("x")).alias("v")).collect()
    values = {r["i"]: r["v"] for r in out}
    for i, w in enumerate(want):
        assert values[i] is None if w is None else math.isclose(values[i], w, rel_tol=1e-12, abs_tol=1e-12), said[i]
    assert [values[len(said) + i] for i, x in enumerate(none) if x != "(2"] == [None] * (len(none) - 1)


def test_kinship(spark):
    named = {
        "mother,mother": "grandmother", "father,father,father": "great-grandfather", "mother,brother": "uncle", "mother,father,sister": "great-aunt", "brother,daughter": "niece", "son,son,son": "great-grandson", "mother,son": "brother", "mother,brother,son": "cousin", "mother,mother,brother,son,son": "second cousin",
        "wife,mother": "mother-in-law", "husband,brother": "brother-in-law", "son,wife": "daughter-in-law", "daughter,husband": "son-in-law", "brother,wife": "sister-in-law", "son,mother": None, "wife,son": None, "mother,mother,brother,son": None, "friend,mother": None,
    }
    df = spark.createDataFrame([(k, k.split(",")) for k in named], "k string, r array<string>")
    assert {r["k"]: r["t"] for r in df.select("k", kinship.composed(F.col("r")).alias("t")).collect()} == named


def test_sessions(spark, tmp_path):
    path = str(tmp_path / "s")
    one, two = facts(spark, ("a", "isa", "b")), facts(spark, ("a", "isa", "b"), ("c", "isa", "d"))
    with pytest.raises(ValueError):
        sessions.load(spark, path)
    assert sessions.save({"facts": one, "more": one}, path) == 1
    two.write.parquet(f"{path}/2-cut/facts")  # the end before the manifest
    assert got(sessions.load(spark, path)["facts"], *TRIPLE) == got(one, *TRIPLE)
    assert sessions.save({"facts": two}, path, version=2) == 2
    assert got(sessions.load(spark, path, 2)["facts"], *TRIPLE) == got(two, *TRIPLE)
    assert set(sessions.load(spark, path, 1, number=1)) == {"facts", "more"}
    with pytest.raises(ValueError):
        sessions.load(spark, path, 1)
    grown = sessions.load(spark, path, 3, {1: None, 2: lambda t: {"facts": t["facts"].withColumn("new", F.lit(1))}})
    assert "new" in grown["facts"].columns
    folder = next(p for p in (tmp_path / "s").iterdir() if p.name.startswith("2-") and p.name != "2-cut")
    one.write.mode("overwrite").parquet(str(folder / "facts"))
    with pytest.raises(ValueError, match="isn't what was saved"):
        sessions.load(spark, path, 2)


def test_corpus_order(spark):
    rng = random.Random(2)
    tasks = list(corpus.DIFFICULTY)
    for n in (0, 1, 7, 300):
        rows = [(i, rng.choice(tasks), "w " * rng.choice((1, 30, 90, 250)), "t") for i in range(n)]
        out = [(r["place"], r["draft"], r["task"], r["review"]) for r in corpus.in_order(spark.createDataFrame(rows, "seq long, task string, draft string, target string").repartition(3), "seq").collect()]
        tiers = [[] for _ in range(4)]
        for _, task, draft, target in rows:
            score = min(1.0, 0.5 * ((len(draft.split()) + 1) / 512) + 0.5 * corpus.DIFFICULTY[task])
            tiers[min(3, int(score * 4))].append((draft, task))
        want = [(*x, False) for x in tiers[0]]
        for k in range(1, 4):
            want += [(*x, False) for x in tiers[k]]
            size = max(1, len(tiers[k]) // 10)
            want += [(*x, True) for x in tiers[k - 1][:: max(1, len(tiers[k - 1]) // size)][:size]] if tiers[k - 1] else []
        assert [x[0] for x in sorted(out)] == list(range(len(want))) and [x[1:] for x in sorted(out)] == want


def test_isotonic_in_groups_equals_one_pass(spark):
    from factloom.operators import calibrate

    rng = random.Random(8)
    rows = [(k / 400, rng.random() < k / 400) for k in range(400) for _ in range(3)] + [(k / 400, False) for k in range(350, 400)] * 5
    df = spark.createDataFrame(rows, "score double, correct boolean").repartition(4)
    whole = sorted(map(tuple, calibrate.isotonic(df).collect()))
    before, calibrate.POOL = calibrate.POOL, 16
    try:
        parts = sorted(map(tuple, calibrate.isotonic(df).collect()))
    finally:
        calibrate.POOL = before
    assert len(whole) == len(parts) and all(math.isclose(a, b, rel_tol=1e-9) for x, y in zip(whole, parts, strict=True) for a, b in zip(x, y, strict=True))


def test_hard_questions_of_confusion(spark):
    from factloom.operators import upkeep

    f = facts(spark, ("york", "isa", "town"), ("york minster", "isa", "church"), ("new_york", "isa", "town"), ("new", "isa", "word"))
    out = got(upkeep.hard_questions(f).where("category = 'confusion'"), "question")
    assert out == {("tell of york minster, not of york.",), ("tell of new_york, not of new.",)}


def test_summaries_of_parts_of_names(spark):
    from factloom.operators import analytics

    f = facts(spark, ("a", "isa", "b"), ("c", "isa", "d"))
    p = records(spark, ("a", "isa", "b", "web.site", 0.5), ("c", "isa", "d", "", 0.5))
    names = spark.createDataFrame([("site",), ("web.site",), ("x",), ("b.s",)], "name string")
    assert got(analytics.told_by(f, p, names), "name", "summary") == {("site", "a isa b."), ("web.site", "a isa b."), ("b.s", "a isa b.")}


def test_closure_leaves_out_what_cannot_join(spark):
    rows = [("o1", "partof", "c1"), ("c1", "locatedin", "n1"), ("n1", "locatedin", "w"), ("x", "memberof", "y"), ("y", "has", "z"), ("v", "isa", "x"), *[(f"o{k}", "kind", "low") for k in range(50)]]
    f = facts(spark, *rows)
    own, given = derive.marked(f.select(*TRIPLE))
    assert given == ["has", "locatedin"]  # neither partof nor kind, which meet nothing, are searched again
    assert got(own.where("starts OR goes_on"), "s") == {("o1",), ("c1",), ("n1",), ("x",), ("y",), ("v",)}
    known = records(spark, ("o1", "partof", "c1", "user", 0.5))
    assert got(derivations.closure(f, known), *TRIPLE) == got(derive.cascade(f), *TRIPLE) >= {("o1", "locatedin", "w"), ("x", "has", "z"), ("v", "has", "z")}


def test_explain_carries_what_is_told_of_premises(spark):
    how = spark.createDataFrame([("f", "a", "user"), ("f", "g", "induced"), ("g", "a", "user"), ("g", "f", "induced"), ("h", "g", "induced")], "fact string, premise string, source string")
    roots = spark.createDataFrame([("h", "induced"), ("told", "user")], "root string, source string")
    want = {("h", "h", 0, False, "induced"), ("h", "g", 1, False, "induced"), ("h", "a", 2, True, "user"), ("h", "f", 2, False, "induced"), ("told", "told", 0, True, "user")}
    assert got(provenance.explain(how, roots), "root", "fact", "depth", "leaf", "source") == want
