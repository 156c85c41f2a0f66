"""New facts from old ones: gated induction, rules, negation, to a fixpoint.

Rounds are synchronous: each reads what the rounds before have stored, and joins
only with what the last one has added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import traits
from ..sources import scratch


def _in(c: Column, values) -> Column:
    return c.isin(*values)


def head(first: Column, last: Column, same: Column) -> Column:
    """The relation that a chain gives: its own if it is one transitive relation, the last if the first lifts it, else null."""
    out = F.when(same & _in(first, traits.TRANSITIVE), first)
    for firsts, lasts in traits.TRANSFERS:
        out = out.when(_in(first, firsts) & _in(first, traits.LIFTING) & _in(last, lasts), last)
    return out


def gates(chains: DataFrame, facts: DataFrame, least: float = 0.2) -> DataFrame:
    """chains (relations, nodes, confidence) with head and verdict: "accepted", or the first gate that rejects."""
    rel, nodes = F.col("relations"), F.col("nodes")
    first, last = F.element_at(rel, 1), F.element_at(rel, -1)
    steps = F.zip_with(F.slice(rel, 1, F.size(rel) - 1), F.slice(rel, 2, F.size(rel)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    inverse = F.exists(steps, lambda x: F.coalesce(traits.inverse(x["a"]) == x["b"], F.lit(False)))
    repeat = F.exists(steps, lambda x: (x["a"] == x["b"]) & ~_in(x["a"], traits.TRANSITIVE))
    same = F.size(F.array_distinct(rel)) == 1
    goal = F.element_at(nodes, -1)
    rows = chains.withColumn("head", head(first, last, same)).withColumn("s", nodes[0]).withColumn("o", goal)
    denied = facts.where(traits.is_negative(F.col("r"))).select("s", traits.denegate(F.col("r")).alias("head"), "o", F.lit(True).alias("denied")).distinct()
    rows = rows.join(denied, ["s", "head", "o"], "left")
    verdict = (
        F.when(F.size(rel) < 2, "too short").when(F.col("confidence") < least, "unsure").when(inverse, "inverse pair").when(repeat, "repeated relation")
        .when(F.array_contains(F.slice(nodes, 1, F.size(nodes) - 1), goal), "cycle").when(F.col("head").isNull(), "no head").when(F.col("denied"), "denied").otherwise("accepted")
    )
    return rows.withColumn("verdict", verdict).drop("denied")


#: Relations that a chain of two that has a head can begin and end with.
BEGINS = frozenset({*traits.TRANSITIVE, *(x for firsts, _ in traits.TRANSFERS for x in firsts if x in traits.LIFTING)})
ENDS = frozenset({*traits.TRANSITIVE, *(x for _, lasts in traits.TRANSFERS for x in lasts)})


def heads(firsts, lasts) -> set[str]:
    """The relations that ``head`` gives for chains of two of these relations."""
    same = {a for a in firsts if a in lasts and a in traits.TRANSITIVE}
    return same | {b for a in firsts for b in lasts if a in traits.LIFTING and any(a in xs and b in ys for xs, ys in traits.TRANSFERS)}


def marked(facts: DataFrame) -> tuple[DataFrame, list[str]]:
    """A kept table of facts (s, r, o) with ``starts`` and ``goes_on``: whether s and o are middles; and the relations of what chains over middles can give.

    A middle is both a subject and an object. Induction adds no nodes, so what it adds
    has its marks from its premises, and facts that aren't marked stay out of all joins.
    """
    node = facts.select(F.col("s").alias("node")).distinct()
    middles = scratch.near(scratch.keep(facts.select(F.col("o").alias("node")).distinct().join(node, "node", "left_semi"), "middles"))
    own = facts.join(middles.select(F.col("node").alias("s"), F.lit(True).alias("starts")), "s", "left").join(middles.select(F.col("node").alias("o"), F.lit(True).alias("goes_on")), "o", "left")
    own = scratch.keep(own.select(*facts.columns, F.coalesce("starts", F.lit(False)).alias("starts"), F.coalesce("goes_on", F.lit(False)).alias("goes_on")), "marked")
    kinds = own.where(_in(F.col("r"), BEGINS | ENDS)).select("r", "starts", "goes_on").distinct().collect()  # of fixed relations
    firsts, lasts, out = {k["r"] for k in kinds if k["goes_on"]}, {k["r"] for k in kinds if k["starts"]}, set()
    while more := heads((firsts | out) & BEGINS, (lasts | out) & ENDS) - out:
        out |= more
    return own, sorted(out)


def two_hops(left: DataFrame, right: DataFrame) -> DataFrame:
    """Chains of two facts (s, r, o) that the gates of relations and cycles let through, with their head.

    Facts that can't begin or end such a chain are left out before the join. A node
    in the middle of very many facts is a skewed key of a join, which Spark splits.
    """
    a = left.where(_in(F.col("r"), BEGINS)).select("s", F.col("r").alias("r1"), F.col("o").alias("mid"))
    b = right.where(_in(F.col("r"), ENDS)).select(F.col("s").alias("mid"), F.col("r").alias("r2"), "o")
    out = a.join(b, "mid").where("s != o AND mid != o AND s != mid")
    out = out.where(F.coalesce(traits.inverse(F.col("r1")) != F.col("r2"), F.lit(True)))
    return out.withColumn("r", head(F.col("r1"), F.col("r2"), F.col("r1") == F.col("r2"))).where("r IS NOT NULL")


def cascade(facts: DataFrame, rounds: int = 5) -> DataFrame:
    """(s, r, o, round): facts that induction adds, round by round, until none is new."""
    denied = facts.where(traits.is_negative(F.col("r"))).select("s", traits.denegate(F.col("r")).alias("r"), "o").distinct()
    known = facts.where(~traits.is_negative(F.col("r"))).select("s", "r", "o").distinct()
    useful = F.col("r").isin(*{*traits.TRANSITIVE, *traits.LIFTING, *(x for _, lasts in traits.TRANSFERS for x in lasts)})
    known = new = scratch.keep(known.where(useful), "known")
    added = None
    for k in range(1, rounds + 1):
        ways = two_hops(new, known)
        if k > 1:
            ways = ways.select("s", "r", "o").union(two_hops(known, new).select("s", "r", "o"))
        fresh = ways.select("s", "r", "o").distinct().join(known, ["s", "r", "o"], "left_anti").join(denied, ["s", "r", "o"], "left_anti")
        new = scratch.keep(fresh, "round")
        step = new.withColumn("round", F.lit(k))
        added = step if added is None else added.union(step)
        if new.isEmpty():
            break
        known = known.union(new)
    return added


def extract_rules(skills: DataFrame, least_support: int = 2, least_confidence: float = 0.5) -> DataFrame:
    """(body, head, support, confidence) of skills (pattern, success, failure); heads that no table gives are "implies"."""
    rel = F.col("pattern")
    first, last = F.element_at(rel, 1), F.element_at(rel, -1)
    same = F.size(F.array_distinct(rel)) == 1
    steps = F.zip_with(F.slice(rel, 1, F.size(rel) - 1), F.slice(rel, 2, F.size(rel)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    bad = F.exists(steps, lambda x: F.coalesce(traits.inverse(x["a"]) == x["b"], F.lit(False)) | ((x["a"] == x["b"]) & ~_in(x["a"], traits.TRANSITIVE)))
    out = F.when(same & _in(first, traits.TRANSITIVE), first).when(_in(first, traits.LIFTING), last).otherwise("implies")
    rate = F.col("success") / (F.col("success") + F.col("failure"))
    return skills.where((F.size(rel) >= 2) & ~bad & (F.col("success") >= least_support) & (rate >= least_confidence)).select(rel.alias("body"), out.alias("head"), F.col("success").alias("support"), rate.alias("confidence"))


def instantiate(facts: DataFrame, body: list[str], head_relation: str) -> DataFrame:
    """(s, r, o): what a rule's body gives and isn't stored or denied; nodes of a body differ."""
    out = None
    for k, r in enumerate(body):
        step = facts.where(F.col("r") == r).select(F.col("s").alias(f"n{k}"), F.col("o").alias(f"n{k + 1}")).distinct()
        out = step.where(F.col("n0") != F.col("n1")) if out is None else out.join(step, f"n{k}")
        for j in range(k + 1):
            if k:
                out = out.where(F.col(f"n{j}") != F.col(f"n{k + 1}"))
    found = out.select(F.col("n0").alias("s"), F.lit(head_relation).alias("r"), F.col(f"n{len(body)}").alias("o")).distinct()
    stored = facts.select("s", traits.denegate(F.col("r")).alias("r"), "o").distinct()
    return found.join(stored, ["s", "r", "o"], "left_anti")


def promoted_families(skills: DataFrame, prefix: int = 2, members: int = 2, least: float = 0.7) -> DataFrame:
    """(body, head, support, confidence): families of skills that are sure enough, as rules; families without a head give none."""
    body = F.slice("pattern", 1, prefix)
    own = skills.where(F.size("pattern") >= prefix).groupBy(body.alias("body")).agg(F.count("*").alias("members"), F.sum("success").alias("support"), F.sum("failure").alias("failure")).where(F.col("members") >= members)
    rate = F.col("support") / (F.col("support") + F.col("failure"))
    same = F.size(F.array_distinct("body")) == 1
    out = own.select("body", head(F.element_at("body", 1), F.element_at("body", -1), same).alias("head"), "support", rate.alias("confidence"))
    return out.where((F.col("confidence") >= least) & F.col("head").isNotNull())


def effectiveness(rules: DataFrame, top: int = 20) -> DataFrame:
    """(pattern, uses, running) of rules (pattern, success, failure): the most used ones, the surest of equals first."""
    out = laplace(rules).select(F.array_join("pattern", ",").alias("pattern"), (F.col("success") + F.col("failure")).alias("uses"), "running")
    return out.orderBy(F.desc("uses"), F.desc("running"), "pattern").limit(top)


def merged_rules(rules: DataFrame) -> DataFrame:
    """(body, head, support, confidence): rules of the same body and head are one, with the most of each."""
    return rules.groupBy("body", "head").agg(F.max("support").alias("support"), F.max("confidence").alias("confidence"))


def pruned_rules(rules: DataFrame, least: float = 0.30, attempts: int = 3) -> DataFrame:
    """rules (success, failure) without those that were tried often enough and have a running confidence below ``least``."""
    tried = F.col("success") + F.col("failure")
    return laplace(rules).where((tried < attempts) | (F.col("running") >= least))


def compose_rules(rules: DataFrame, most: int = 5) -> DataFrame:
    """(body, head, support, confidence): rules whose head begins another's body, put in its place."""
    a = rules.select(F.col("body").alias("b1"), F.col("head").alias("h1"), F.col("support").alias("s1"), F.col("confidence").alias("c1"))
    b = rules.select(F.col("body").alias("b2"), F.col("head").alias("h2"), F.col("support").alias("s2"), F.col("confidence").alias("c2"))
    both = a.join(b, (F.col("h1") == F.col("b2")[0]) & ~((F.col("b1") == F.col("b2")) & (F.col("h1") == F.col("h2"))))
    body = F.concat("b1", F.slice("b2", 2, F.size("b2")))
    return both.select(body.alias("body"), F.col("h2").alias("head"), F.least("s1", "s2").alias("support"), (F.col("c1") * F.col("c2")).alias("confidence")).where(F.size("body") <= most)


def propagate_negations(facts: DataFrame) -> DataFrame:
    """(s, r, o): denials of a class handed to its members, but where the member has the fact or the denial itself."""
    neg = facts.where(traits.is_negative(F.col("r"))).select(F.col("s").alias("class"), "r", "o").distinct()
    member = facts.where(F.col("r").isin(*traits.LIFTING)).select("s", F.col("o").alias("class")).distinct()
    new = member.join(neg, "class").select("s", "r", "o").distinct()
    stored = facts.select("s", traits.negate(F.col("r")).alias("r"), "o").distinct()
    return new.join(stored, ["s", "r", "o"], "left_anti")


def symmetrised(facts: DataFrame, skip_existing: bool = True) -> DataFrame:
    """(s, r, o): inverses of facts that are not stored yet."""
    back = facts.withColumn("inv", traits.inverse(F.col("r"))).where((F.col("inv").isNotNull()) & ((F.col("inv") != F.col("r")) | (F.col("s") != F.col("o"))))
    new = back.select(F.col("o").alias("s"), F.col("inv").alias("r"), F.col("s").alias("o")).distinct()
    return new.join(facts, ["s", "r", "o"], "left_anti") if skip_existing else new


def skill_families(skills: DataFrame, prefix: int = 2, least: int = 2) -> DataFrame:
    """(family, members, success, failure): skills by their first relations."""
    return skills.groupBy(F.array_join(F.slice("pattern", 1, prefix), ",").alias("family")).agg(F.count("*").alias("members"), F.sum("success").alias("success"), F.sum("failure").alias("failure")).where(F.col("members") >= least)


def what_changes(facts: DataFrame, extra: DataFrame, rounds: int = 2) -> DataFrame:
    """(s, r, o): what induction adds with the extra facts (s, r, o), beyond them and beyond what it adds without."""
    base = facts.select("s", "r", "o")
    more = cascade(base.union(extra.select("s", "r", "o")), rounds).select("s", "r", "o")
    return more.join(cascade(base, rounds), ["s", "r", "o"], "left_anti")


def visible(facts: DataFrame, deltas: DataFrame, branches: list[str]) -> DataFrame:
    """(s, r, o) of a branch: the base with the deltas (branch, step, op, s, r, o) of its line; the last word on a fact counts."""
    own = deltas.where(F.col("branch").isin(*branches))
    order = F.array_position(F.array(*map(F.lit, branches)), F.col("branch"))
    last = own.groupBy("s", "r", "o").agg(F.max_by("op", F.struct(order, F.col("step"))).alias("op"))
    base = facts.select("s", "r", "o").distinct().join(last.where("op = 'forget'"), ["s", "r", "o"], "left_anti")
    return base.union(last.where("op = 'store'").select("s", "r", "o")).distinct()


def ranked_rules(rules: DataFrame, top: int = 20) -> DataFrame:
    return rules.orderBy(F.desc("support"), F.desc("confidence"), F.array_join("body", ",")).limit(top)


def skill_stats(skills: DataFrame, least_uses: int = 3, sure: float = 0.8) -> DataFrame:
    """(pattern, uses, rate, sure) of skills (pattern, success, failure) that were used enough."""
    uses = F.col("success") + F.col("failure")
    rate = F.col("success") / uses
    return skills.where(uses >= least_uses).select(F.array_join("pattern", ",").alias("pattern"), uses.alias("uses"), rate.alias("rate"), (rate >= sure).alias("sure"))


def relation_priority(skills: DataFrame) -> DataFrame:
    """(relation, weight): relations by the successes of the skills that use them."""
    return skills.select(F.explode("pattern").alias("relation"), "success").groupBy("relation").agg(F.sum("success").alias("weight"))


def laplace(rules: DataFrame) -> DataFrame:
    """Adds the running confidence of rules (success, failure)."""
    return rules.withColumn("running", (F.col("success") + 1) / (F.col("success") + F.col("failure") + 2))
