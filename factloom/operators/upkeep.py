"""Passes that read a base and give what it becomes; the caller stores it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import traits
from ..sources import scratch, sessions
from . import analytics, beliefs, derivations, derive, episodes, pattern, provenance

TRIPLE = ["s", "r", "o"]


def maintained(facts: DataFrame, records: DataFrame, rounds: int = 3) -> dict[str, DataFrame]:
    """``facts`` (s, r, o, how) after a pass, and its ``report`` (step, n).

    Induction adds facts and negation denials; then, of functional facts that
    disagree, those that lose are taken out.
    """
    facts = scratch.keep(facts, "base")
    new = derive.cascade(facts.select(*TRIPLE), rounds).select(*TRIPLE)
    denied = derive.propagate_negations(facts)
    lost = beliefs.resolve(facts, records).where("NOT keep").select(*TRIPLE)
    new, denied, lost = (scratch.keep(x, name) for x, name in ((new, "induced"), (denied, "denied"), (lost, "lost")))
    kept = facts.select(*TRIPLE).distinct().join(lost, TRIPLE, "left_anti")
    all_ = kept.withColumn("how", F.lit("told")).union(new.withColumn("how", F.lit("induced"))).union(denied.withColumn("how", F.lit("denied")))
    counts = [x.agg(F.lit(step).alias("step"), F.count("*").alias("n")) for step, x in (("induced", new), ("denied", denied), ("resolved", lost))]
    return {"facts": all_, "report": counts[0].union(counts[1]).union(counts[2])}


def passed(facts: DataFrame, records: DataFrame, skills: DataFrame, seen: DataFrame, rules: list[tuple[list[str], str]], rounds: int = 2, hot: int = 10, path: str | None = None) -> dict[str, DataFrame]:
    """A whole pass: ``facts`` (s, r, o, how), ``rules``, ``answers`` and its ``report`` (step, n), each step over what those before have left.

    Chains induce facts, rules add to them, denials go down to members, and of told
    facts that disagree those that lose are taken out. Then families of skills
    become rules, episodes settle on answers or are flagged, and the answers to the
    most asked signatures are made ready. With a path all of it is kept as a session.
    """
    told = scratch.keep(facts, "told")
    induced = scratch.keep(derive.cascade(told.select(*TRIPLE), rounds).select(*TRIPLE), "induced")
    known = told.select(*TRIPLE).union(induced)
    ruled = scratch.keep(derivations.rule_rounds(known, rules, rounds).select(*TRIPLE), "ruled")
    known = known.union(ruled)
    denied = scratch.keep(derive.propagate_negations(known), "denied")
    lost = scratch.keep(beliefs.resolve(told, records).where("NOT keep").select(*TRIPLE), "lost")
    kept = told.select(*TRIPLE).distinct().join(lost, TRIPLE, "left_anti").withColumn("how", F.lit("told"))
    for rows, how in ((induced, "induced"), (ruled, "rule"), (denied, "denied")):
        kept = kept.union(rows.withColumn("how", F.lit(how)))
    after = scratch.keep(kept, "after")
    own = derive.extract_rules(skills)
    fresh = scratch.keep(derive.promoted_families(skills).join(own.select("body", "head"), ["body", "head"], "left_anti"), "promoted")
    settled = scratch.keep(episodes.consolidated(seen), "settled")
    asked = episodes.hot_signatures(seen, hot)
    ready = scratch.keep(asked.join(settled.where("verdict = 'stable'").select("subject", "relation", F.col("mode").alias("answer")), ["subject", "relation"]), "ready")
    counts = {
        "chain_induction": induced, "rule_cascade": ruled, "negations": denied, "conflicts": lost, "skills_promoted": fresh, "episodes_consolidated": settled.where("verdict = 'stable'"),
        "episodes_ambiguous": settled.where("often_ambiguous"), "answers_ready": ready, "final_size": after.select(*TRIPLE).distinct(),
    }
    report = None
    for step, rows in counts.items():
        one = rows.agg(F.lit(step).alias("step"), F.count("*").alias("n"))
        report = one if report is None else report.union(one)
    out = {"facts": after, "rules": own.unionByName(fresh), "answers": ready, "report": report}
    if path is not None:
        sessions.save(out, path)
    return out


def consolidated(facts: DataFrame, records: DataFrame, seen: DataFrame, support: int = 5, factor: float = 0.999, forget: float = 0.02, often: int = 3) -> dict[str, DataFrame]:
    """``facts`` (s, r, o), ``provenance`` and ``report`` (step, n) after a pass over facts, their records and episodes.

    Copies of facts are merged; what enough children of a parent share is stored
    for the parent, unless it has it; confidence decays, and facts whose
    confidence falls below ``forget`` are taken out, with their records.
    Contradictions and often asked signatures are counted.
    """
    doubles = facts.groupBy(*TRIPLE).agg((F.count("*") - 1).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    kids = facts.withColumn("r", F.when(F.col("r").isin(*analytics.PARENTS), "isa").otherwise(F.col("r")))
    up = analytics.abstractions(kids, support).where("NOT known").select(F.col("parent").alias("s"), "r", "o")
    up = scratch.keep(up.join(pattern.answers(facts).select("s", "r", F.col("answer").alias("o")), TRIPLE, "left_anti"), "abstractions")
    aged = provenance.decayed(records, factor)
    gone = scratch.keep(aged.where(F.col("confidence") < forget).select(*TRIPLE).distinct(), "forgotten")
    left = facts.select(*TRIPLE).union(up).distinct().join(gone, TRIPLE, "left_anti")
    steps = {
        "promotions": seen.groupBy("subject", "relation").count().where(F.col("count") >= often).agg(F.count("*").alias("n")), "contradictions": beliefs.functional_conflicts(facts).agg(F.count("*").alias("n")),
        "duplicates": doubles, "abstractions": up.agg(F.count("*").alias("n")), "forgotten": gone.agg(F.count("*").alias("n")),
    }
    report = None
    for name, n in steps.items():
        row = n.select(F.lit(name).alias("step"), F.col("n").cast("long").alias("n"))
        report = row if report is None else report.union(row)
    return {"facts": left, "provenance": aged.join(gone, TRIPLE, "left_anti"), "report": report}


def decisions(facts: DataFrame, probes: DataFrame) -> DataFrame:
    """(probe, s, r, state, top, score, n_values, base) of probes (probe, s, r): the answers to them, and the hash of the base that gave them."""
    with scratch.dealt(probes.sparkSession, facts.count() + probes.count()):
        said = scratch.keep(pattern.epistemic(facts, probes), "said")
        base = analytics.state_hash(facts).select(F.col("hash").alias("base"))  # one row
        return scratch.keep(said.join(probes, "probe").crossJoin(F.broadcast(base)).select("probe", "s", "r", "state", "top", "score", "n_values", "base"), "decisions")


def replayed(records: DataFrame, facts: DataFrame) -> DataFrame:
    """(probe, verdict) of records of decisions: "verified" or "diverged" by the answers that facts give now, or "state mismatch" if the base is another."""
    now = decisions(facts, records.select("probe", "s", "r"))
    now = now.repartition(scratch.shares(now.sparkSession, now.count()), "probe")
    both = records.join(now.select("probe", F.col("state").alias("_state"), F.col("top").alias("_top"), F.col("base").alias("_base")), "probe")
    same = F.col("state").eqNullSafe(F.col("_state")) & F.col("top").eqNullSafe(F.col("_top"))
    return both.select("probe", F.when(F.col("base") != F.col("_base"), "state mismatch").when(same, "verified").otherwise("diverged").alias("verdict"))


def hard_questions(facts: DataFrame, per_category: int = 5) -> DataFrame:
    """(category, question, expected, answer): questions made from facts, so many of each category, by name.

    Negation asks beside a category, compounds chain two facts, polysemy asks for
    subjects of several parents, confusion for names of which another is a part,
    and contradiction for a value that a single-valued relation rules out.
    """
    one = pattern.answers(facts)
    up = facts.where(F.col("r").isin(*analytics.PARENTS)).select("s", "o").distinct()
    two = one.join(one.select(F.col("s").alias("answer"), F.col("r").alias("r2"), F.col("answer").alias("end")), "answer")
    single = one.where(F.col("r").isin(*traits.SINGLE_VALUED))
    wrong = single.join(single.groupBy("r").agg(F.min("answer").alias("least"), F.max("answer").alias("most")), "r").where("least != most")
    stem = F.regexp_extract("s", r"^(\w+)[ _]", 1)
    names = one.select("s").distinct()
    close = names.where(stem != "").join(names.select(F.col("s").alias("part")), F.col("part") == stem)
    say = lambda *xs: F.concat(*[F.lit(x) if i % 2 == 0 else F.col(x) for i, x in enumerate(xs)])
    rows = (
        up.select(F.lit("negation").alias("category"), say("what is not a ", "o", "?").alias("question"), F.lit("answer").alias("expected"), F.lit(None).cast("string").alias("answer")),
        two.select(F.lit("compound"), say("what is the ", "r2", " of the ", "r", " of ", "s", "?"), F.lit("answer"), "end"),
        up.groupBy("s").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("polysemy"), say("what is ", "s", "?"), F.lit("ask"), F.lit(None).cast("string")),
        close.select(F.lit("confusion"), say("tell of ", "s", ", not of ", "part", "."), F.lit("answer"), F.lit(None).cast("string")),
        wrong.select(F.lit("contradiction"), F.concat(F.lit("is the "), "r", F.lit(" of "), "s", F.lit(" "), F.when(F.col("answer") == F.col("least"), F.col("most")).otherwise(F.col("least")), F.lit("?")), F.lit("refuse"), F.lit(None).cast("string")),
    )
    picked = [r.toDF("category", "question", "expected", "answer").distinct().orderBy("question", "answer").limit(per_category) for r in rows]
    out = picked[0]
    for p in picked[1:]:
        out = out.union(p)
    return out
