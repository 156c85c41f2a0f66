"""Derived facts that keep how they were derived: fixpoints over a semiring, rules with running confidence, records.

A derivation has a length, the told facts it rests on counted with repeats, and a
cost, the sum of their scores' negative logarithms in millionths. Both add up along
a chain, so the best derivation of each part makes the best of the whole: fewest
facts, then least cost, then the first by name. The best one is picked by an
aggregate, which runs before rows are moved.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import confidence as conf
from ..functions import traits
from ..plans.ranks import numbered
from ..sources import scratch
from .derive import BEGINS, ENDS, head, marked
from .provenance import REINFORCE

TRIPLE = ["s", "r", "o"]
#: What a tree of premises holds of each kind of source.
KINDS = ("n_user", "n_other", "n_unknown", "n_induced")
#: Cost of a link is in such parts of a natural logarithm; scores below the least count as it.
UNIT, LEAST_SCORE = 1_000_000, 1e-9
TREE = ("hops", "cost", "total", "depth", *KINDS)
#: Marks of a fact's nodes, see ``derive.marked``.
MARKS = ("starts", "goes_on")


def certainty(hops: Column, cost: Column) -> Column:
    """Confidence of a chain of so many links: their geometric mean, less for each link after the first."""
    return F.greatest(F.exp(-cost / UNIT / hops) * F.pow(F.lit(conf.DECAY), hops - 1), F.lit(conf.FLOOR))


def told(facts: DataFrame, records: DataFrame) -> DataFrame:
    """(s, r, o, source, *TREE) of distinct facts: leaves of derivations. Facts without a record have the source "unknown" and score 1."""
    best = records.groupBy(*TRIPLE).agg(F.max_by(F.struct("source", "confidence"), F.struct("confidence", "source")).alias("x"))
    rows = facts.select(*TRIPLE).distinct().join(best, TRIPLE, "left")
    source = F.coalesce(F.col("x.source"), F.lit("unknown"))
    cost = F.round(-F.ln(F.greatest(F.coalesce(F.col("x.confidence"), F.lit(1.0)), F.lit(LEAST_SCORE))) * UNIT).cast("long")
    kinds = (source == "user", ~source.isin("user", "unknown", "induced"), source == "unknown", source == "induced")
    one = F.lit(1).cast("long")
    return rows.select(*TRIPLE, source.alias("source"), one.alias("hops"), cost.alias("cost"), one.alias("total"), one.alias("depth"), *[x.cast("long").alias(k) for x, k in zip(kinds, KINDS, strict=True)])


def _joined(left: DataFrame, right: DataFrame) -> DataFrame:
    """(s, r, o, mid, r1, r2, *TREE, *MARKS): what two facts in a row give, with the tree of both."""
    a = left.where(F.col("goes_on") & F.col("r").isin(*BEGINS)).select("s", "starts", F.col("r").alias("r1"), F.col("o").alias("mid"), *[F.col(c).alias(f"a_{c}") for c in TREE])
    b = right.where(F.col("starts") & F.col("r").isin(*ENDS)).select(F.col("s").alias("mid"), F.col("r").alias("r2"), "o", "goes_on", *[F.col(c).alias(f"b_{c}") for c in TREE])
    rows = a.join(b, "mid").where("s != o AND mid != o AND s != mid").where(F.coalesce(traits.inverse(F.col("r1")) != F.col("r2"), F.lit(True)))
    both = {c: F.col(f"a_{c}") + F.col(f"b_{c}") for c in TREE}
    both |= {"total": both["total"] + 1, "n_induced": both["n_induced"] + 1, "depth": F.greatest("a_depth", "b_depth") + 1}
    return rows.withColumn("r", head(F.col("r1"), F.col("r2"), F.col("r1") == F.col("r2"))).where("r IS NOT NULL").select(*TRIPLE, "mid", "r1", "r2", *[both[c].alias(c) for c in TREE], *MARKS)


def _best(rows: DataFrame) -> DataFrame:
    rest = ["mid", "r1", "r2", *TREE, *MARKS]
    return rows.groupBy(*TRIPLE).agg(F.min_by(F.struct(*rest), F.struct("hops", "cost", "mid", "r1", "r2")).alias("x")).select(*TRIPLE, *[f"x.{c}" for c in rest])


def closure(facts: DataFrame, records: DataFrame, rounds: int = 5) -> DataFrame:
    """(s, r, o, round, mid, r1, r2, confidence, *TREE) of the facts that induction adds: (s, r1, mid) and (mid, r2, o) are the premises.

    Rounds are synchronous and stored, and join only with what the last one added. A
    fact keeps the best derivation of the first round that gives it, so that
    premises are always of earlier rounds and explanations end. Denied and told
    facts aren't derived. Facts whose nodes aren't middles of chains aren't moved by
    joins, nor those that no chain can give by the search for known ones.
    """
    positive = facts.where(~traits.is_negative(F.col("r")))
    denied = facts.where(traits.is_negative(F.col("r"))).select("s", traits.denegate(F.col("r")).alias("r"), "o").distinct()
    useful = F.col("r").isin(*(BEGINS | ENDS))
    known, given = marked(scratch.keep(told(positive.where(useful), records).drop("source"), "told"))
    new = known
    old = added = None
    for k in range(1, rounds + 1):
        ways = _joined(new, known)
        if old is not None:
            ways = ways.unionByName(_joined(old, new))
        fresh = _best(ways).join(known.where(F.col("r").isin(*given)).select(*TRIPLE), TRIPLE, "left_anti").join(denied, TRIPLE, "left_anti")
        step = scratch.keep(fresh.withColumn("round", F.lit(k)), "derived")
        added = step.drop(*MARKS) if added is None else added.unionByName(step.drop(*MARKS))
        if k == rounds or step.isEmpty():
            break
        new, old = step.select(*TRIPLE, *TREE, *MARKS), known
        known = known.unionByName(new)
    return added.withColumn("confidence", certainty(F.col("hops"), F.col("cost")))


def key(s, r, o) -> Column:
    return F.concat_ws("|", s, r, o)


def premises(derived: DataFrame) -> DataFrame:
    """(fact, premise): a row for each premise, for ``provenance.explain``."""
    both = F.array(key("s", "r1", "mid"), key("mid", "r2", "o"))
    return derived.select(key("s", "r", "o").alias("fact"), F.explode(both).alias("premise"))


def as_records(derived: DataFrame) -> DataFrame:
    """(s, r, o, source, confidence, count, tags, derivation) of derived facts."""
    step = lambda s, r, o: F.struct(F.col(s).alias("s"), F.col(r).alias("r"), F.col(o).alias("o"))
    tags = F.array(F.lit("induced"), F.concat(F.lit("via_"), F.col("hops").cast("string"), F.lit("_hops")))
    return derived.select(*TRIPLE, F.lit("induced").alias("source"), "confidence", F.lit(1).cast("long").alias("count"), tags.alias("tags"), F.array(step("s", "r1", "mid"), step("mid", "r2", "o")).alias("derivation"))


def recorded(records: DataFrame, tells: DataFrame) -> DataFrame:
    """Records (s, r, o, source, confidence, count, last_seen, derivation) after tells (s, r, o, source, confidence, ts, derivation).

    A tell of a known fact takes a share of its doubt away, its own confidence
    counts only if it is the first; a source other than the record's makes it
    "multi"; the last derivation that is given stays. One aggregate, so that tells
    of a hot fact are added up where they are.
    """
    cols = [*TRIPLE, "source", "confidence", "n", "at", "derivation"]
    old = records.select(*TRIPLE, "source", "confidence", F.col("count").alias("n"), F.col("last_seen").alias("at"), "derivation").withColumn("old", F.lit(True))
    new = tells.select(*TRIPLE, "source", "confidence", F.lit(1).cast("long").alias("n"), F.col("ts").alias("at"), "derivation").withColumn("old", F.lit(False))
    rows = old.select(*cols, "old").unionByName(new.select(*cols, "old"))
    first = F.struct(~F.col("old"), F.col("at"), F.col("confidence"), F.col("source"))
    again = F.count("*") - 1
    return rows.groupBy(*TRIPLE).agg(
        F.when(F.min("source") != F.max("source"), "multi").otherwise(F.min("source")).alias("source"),
        (1 - (1 - F.min_by("confidence", first)) * F.pow(F.lit(1 - REINFORCE), again)).alias("confidence"), F.sum("n").alias("count"), F.max("at").alias("last_seen"),
        F.max_by("derivation", F.when(F.col("derivation").isNotNull(), F.struct(~F.col("old"), F.col("at")))).alias("derivation"),
    )


Rule = tuple[list[str], str, float]


def sound(body: list[str]) -> bool:
    """Whether no two relations in a row of a body undo each other, or repeat without being transitive."""
    back = {**dict(traits.INVERSES), **{b: a for a, b in traits.INVERSES}}
    return len(body) > 1 and all(back.get(a) != b and (a != b or a in traits.TRANSITIVE) for a, b in zip(body, body[1:], strict=False))


def bindings(steps: list[DataFrame]) -> DataFrame:
    """(n0, n1, ...) of facts (seq, s, o) in a row whose nodes all differ, with the seqs in order."""
    out = None
    for k, facts in enumerate(steps):
        step = facts.select(F.col("s").alias(f"n{k}"), F.col("o").alias(f"n{k + 1}"), F.col("seq").alias(f"q{k}"))
        out = step.where("n0 != n1") if out is None else out.join(step, f"n{k}")
        for j in range(k + 1 if k else 0):
            out = out.where(F.col(f"n{j}") != F.col(f"n{k + 1}"))
    n = len(steps)
    return out.select(*[f"n{k}" for k in range(n + 1)], F.array(*[f"q{k}" for k in range(n)]).alias("seqs"))


def _tried(own: DataFrame, first: DataFrame, rules: list[Rule], nodes: bool) -> DataFrame:
    """(s, r, o, rule, seqs, nodes, denied): what rules give from facts of ``first`` on, unless first has it."""
    found = None
    for k, (body, head_, _) in enumerate(rules):
        if not sound(body):
            continue
        rows = bindings([(own if j else first).where(F.col("r") == r).select("seq", "s", "o") for j, r in enumerate(body)])
        between = [F.array(*[f"n{j}" for j in range(len(body) + 1)]).alias("nodes")] * nodes
        one = rows.select(F.col("n0").alias("s"), F.lit(head_).alias("r"), F.col(f"n{len(body)}").alias("o"), F.lit(k).alias("rule"), "seqs", *between)
        found = one if found is None else found.unionByName(one)
    if found is None:
        raise ValueError("no rule has a sound body of two relations or more")
    dealt = found.repartition(*TRIPLE)  # few rows of a body give the same, so they are sorted once, after they have moved
    best = F.struct("rule", "seqs", *["nodes"] * nodes)
    tried = dealt.groupBy(*TRIPLE).agg(F.min(best).alias("x")).select(*TRIPLE, "x.*")
    stored = first.where(F.col("r").isin(*{h for _, h, _ in rules})).select(*TRIPLE)  # what a rule gives has its head
    denials = first.where(traits.is_negative(F.col("r"))).select("s", traits.denegate(F.col("r")).alias("r"), "o", F.lit(1).alias("denied"))
    return tried.join(stored, TRIPLE, "left_anti").join(denials, TRIPLE, "left").withColumn("denied", F.coalesce("denied", F.lit(0)))


#: Facts that are bound to rules at once, by their subjects, so that what is shuffled for them doesn't grow with the input.
SLICE = 20_000_000


def instances(facts: DataFrame, rules: list[Rule], nodes: bool = True) -> DataFrame:
    """(s, r, o, rule, nodes, denied, attempt, confidence): what rules (body, head, confidence) give, each with the confidence its rule has by then.

    A rule's tries are taken in the order of the facts they begin with. A denied one
    fails; the rule's confidence before a try is (successes + 1) / (tries + 2), and
    its own before the first. Stored facts aren't tried. What several rules give is
    the first rule's. Tries are numbered by ranges, so one rule may have most rows.
    Subjects are taken in slices of about SLICE facts, one after another; nodes can be left out.
    """
    used = {r for body, h, _ in rules for r in (*body, h, traits.NOT + h)}
    own = scratch.keep(facts.where(F.col("r").isin(*used)).groupBy(*TRIPLE).agg(F.min("seq").alias("seq")), "facts")
    n = -(-own.count() // SLICE)
    if n > 1:
        whole, own = own, scratch.keep(own.withColumn("slice", F.pmod(F.xxhash64("s"), F.lit(n))), "facts", by=("slice",))
        scratch.drop(whole)
        parts = kept = [scratch.keep(_tried(own.drop("slice"), own.where(F.col("slice") == i).drop("slice"), rules, nodes), "tried") for i in range(n)]
        scratch.drop(own)
    else:
        parts, kept = [_tried(own, own, rules, nodes)], [own]
    placed = numbered(reduce(DataFrame.unionByName, parts), "rule", "seqs", *TRIPLE, sums={"failed": "denied"})
    scratch.drop(*kept)
    begins = placed.groupBy("rule").agg(F.min("place").alias("p0"), F.min("failed").alias("f0"))
    begins = begins.withColumn("prior", F.element_at(F.array(*[F.lit(float(prior)) for *_, prior in rules]), F.col("rule") + 1))
    rows = placed.join(F.broadcast(begins), "rule").withColumn("attempt", F.col("place") - F.col("p0"))  # a row for each rule, which the driver gave
    passed = F.col("attempt") - (F.col("failed") - F.col("f0"))
    running = F.when(F.col("attempt") == 0, F.col("prior")).otherwise((passed + 1) / (F.col("attempt") + 2))
    return rows.select(*TRIPLE, "rule", *["nodes"] * nodes, (F.col("denied") > 0).alias("denied"), "attempt", running.alias("confidence"))


def rule_rounds(facts: DataFrame, rules: list[tuple[list[str], str]], rounds: int = 4) -> DataFrame:
    """(s, r, o, round): what rules (body, head) give, applied to what they have given before, until nothing is new.

    Each round joins the facts of the last one, at each place of a body in turn, with
    older facts at the places before and all facts at those after, so no
    combination is made twice. The base is stored once, without other relations.
    """
    used = {r for body, h in rules for r in (*body, h, traits.NOT + h)}
    base = scratch.keep(facts.where(F.col("r").isin(*used)).select(*TRIPLE).distinct(), "rule-base")
    denied = base.where(traits.is_negative(F.col("r"))).select("s", traits.denegate(F.col("r")).alias("r"), "o")
    old, new, all_, added = base.limit(0), base, base, None
    fresh = None
    for k in range(1, rounds + 1):
        found = []
        for body, head_ in rules:
            for at, r in enumerate(body):
                if k == 1 and at or fresh is not None and r not in fresh:
                    continue
                sides = [all_] * len(body) if k == 1 else [old] * at + [new] + [all_] * (len(body) - at - 1)
                rows = bindings([x.where(F.col("r") == y).select(F.lit(0).alias("seq"), "s", "o") for x, y in zip(sides, body, strict=True)])
                found.append(rows.select(F.col("n0").alias("s"), F.lit(head_).alias("r"), F.col(f"n{len(body)}").alias("o")))
        if not found:
            break
        rows = reduce(DataFrame.union, found).distinct().join(all_, TRIPLE, "left_anti").join(denied, TRIPLE, "left_anti")
        step = scratch.keep(rows, "rules")
        added = step.withColumn("round", F.lit(k)) if added is None else added.union(step.withColumn("round", F.lit(k)))
        if step.isEmpty():
            break
        fresh = {h for _, h in rules}
        old, new, all_ = all_, step, all_.union(step)
    return added
