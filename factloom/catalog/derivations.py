"""Queries on derived facts and how they were derived."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import derivations, provenance
from ..oracle import _INV, _head, f, prov
from ..plans import star

ROUNDS = 3
BASE = ("O", "C", "N", "O2")
RECORDED = ("O", "C")


def _closure(spark, d):
    return derivations.closure(star.facts(spark, d, *BASE), star.provenance(spark, d, *RECORDED), ROUNDS)


def cascade_derivations(spark, d):
    """Each induced fact with its best derivation, its confidence and what its tree of premises holds."""
    key = derivations.key
    return _closure(spark, d).select("s", "r", "o", "round", "hops", F.round("confidence", 6).alias("confidence"), key("s", "r1", "mid").alias("first"), key("mid", "r2", "o").alias("second"), "total", "depth", *derivations.KINDS)


def explained_facts(spark, d):
    """The tree of premises of each induced fact, with the source of each node."""
    derived = _closure(spark, d)
    key = derivations.key("s", "r", "o")
    leaves = derivations.told(star.facts(spark, d, *BASE), star.provenance(spark, d, *RECORDED)).select(key.alias("premise"), "source")
    sourced = derivations.premises(derived).join(leaves, "premise", "left").withColumn("source", F.coalesce("source", F.lit("induced")))
    tree = provenance.explain(sourced, derived.select(key.alias("root"), F.lit("induced").alias("source")), 2 * ROUNDS)
    return tree.select("root", "fact", "depth", "leaf", "source")


def derivation_records(spark, d):
    """Records after the facts that induction adds were stored, half of them twice, and told facts told again."""
    step = "array<struct<s:string,r:string,o:string>>"
    old = star.provenance(spark, d, *RECORDED).withColumn("derivation", F.lit(None).cast(step))
    made = derivations.as_records(_closure(spark, d))
    told = lambda rows, source, confidence, ts, how: rows.select("s", "r", "o", F.lit(source).alias("source"), confidence.alias("confidence"), F.lit(float(ts)).alias("ts"), how.alias("derivation"))
    tell = lambda source, confidence, ts, how: F.struct(F.lit(source).alias("source"), confidence.alias("confidence"), F.lit(float(ts)).alias("ts"), how.alias("derivation"))
    first, again = tell("induced", F.col("confidence"), 2000, F.col("derivation")), tell("rule", F.lit(0.5), 2001, F.lit(None).cast(step))
    both = made.select("s", "r", "o", F.explode(F.when(F.length("s") % 2 == 0, F.array(first, again)).otherwise(F.array(first))).alias("x"))  # both of a fact in one task, so they are added up before they move
    tells = both.select("s", "r", "o", "x.*").union(told(old.where("count > 2"), "user", F.lit(0.9), 1500, F.lit(None).cast(step)))
    how = F.array_join(F.transform("derivation", lambda x: F.concat_ws("|", x["s"], x["r"], x["o"])), " & ")
    return derivations.recorded(old, tells).select("s", "r", "o", "source", F.round("confidence", 6).alias("confidence"), "count", "last_seen", how.alias("derivation"))


def _ruled(spark, d):
    f_ = star.facts(spark, d, "L", "P2", "O", "C", "O2")
    denied = star.table(spark, d, "lineitem").where("l_partkey % 5 = 0").join(star.table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return f_.unionByName(denied.select((F.lit(20 * star.STEP) + F.col("l_orderkey") * 10**8 + F.col("l_partkey")).alias("seq"), F.concat(F.lit("order#"), F.col("l_orderkey").cast("string")).alias("s"), F.lit("not_madeof").alias("r"), F.lower("p_brand").alias("o")))


def rule_attempts(spark, d):
    """What two rules give, denied tries among them, each with the confidence that its rule has by then."""
    rules = [(["has", "madeof"], "madeof", 0.9), (["partof", "locatedin"], "locatedin", 0.6), (["partof", "haspart"], "kind", 0.5)]
    out = derivations.instances(_ruled(spark, d), rules, nodes=False)
    return out.select("s", "r", "o", "rule", "denied", "attempt", F.round("confidence", 6).alias("confidence"))


QUERIES = {x.__name__: x for x in (cascade_derivations, explained_facts, derivation_records, rule_attempts)}


def _tree(src: str, recorded: str, rounds: int) -> str:
    """Rounds unrolled: each joins all that is known and ranks the ways to each new fact."""
    kinds = ", ".join(f"CAST(coalesce(source, 'unknown') {x} AS BIGINT) AS {k}" for k, x in zip(derivations.KINDS, ("= 'user'", "NOT IN ('user', 'unknown', 'induced')", "= 'unknown'", "= 'induced'"), strict=True))
    tree = ", ".join(derivations.TREE)
    parts = [
        f"p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY s, r, o ORDER BY confidence DESC, source DESC) AS k FROM {recorded}) WHERE k = 1)",
        f"k0 AS (SELECT s, r, o, 0 AS round, CAST(NULL AS VARCHAR) AS mid, CAST(NULL AS VARCHAR) AS r1, CAST(NULL AS VARCHAR) AS r2, coalesce(source, 'unknown') AS source, CAST(1 AS BIGINT) AS hops, CAST(round(-ln(greatest(coalesce(confidence, 1.0), 1e-9)) * {derivations.UNIT}) AS BIGINT) AS cost, CAST(1 AS BIGINT) AS total, CAST(1 AS BIGINT) AS depth, {kinds} FROM (SELECT DISTINCT s, r, o FROM {src}) LEFT JOIN p USING (s, r, o))",
    ]
    both = {c: f"a.{c} + b.{c} AS {c}" for c in derivations.TREE} | {"total": "a.total + b.total + 1 AS total", "n_induced": "a.n_induced + b.n_induced + 1 AS n_induced", "depth": "greatest(a.depth, b.depth) + 1 AS depth"}
    for i in range(1, rounds + 1):
        way = f"SELECT a.s, {_head('a.r', 'b.r')} AS r, b.o, a.o AS mid, a.r AS r1, b.r AS r2, {', '.join(both[c] for c in derivations.TREE)} FROM k{i - 1} a JOIN k{i - 1} b ON a.o = b.s WHERE a.s <> b.o AND a.o <> b.o AND a.s <> a.o AND NOT EXISTS (SELECT 1 FROM {_INV} WHERE inv.a = a.r AND inv.b = b.r)"
        ranked = f"SELECT *, row_number() OVER (PARTITION BY s, r, o ORDER BY hops, cost, mid, r1, r2) AS k FROM ({way}) w WHERE r IS NOT NULL AND NOT EXISTS (SELECT 1 FROM k{i - 1} x WHERE x.s = w.s AND x.r = w.r AND x.o = w.o)"
        parts.append(f"k{i} AS (SELECT * FROM k{i - 1} UNION ALL SELECT s, r, o, {i}, mid, r1, r2, 'induced', {tree} FROM ({ranked}) WHERE k = 1)")
    certain = "greatest(exp(-cost / 1000000.0 / hops) * pow(0.95, hops - 1), 0.01)"
    parts.append(f"known AS (SELECT *, {certain} AS confidence FROM k{rounds})")
    return ", ".join(parts)


def sql() -> dict[str, str]:
    tree = _tree(f(*BASE), prov(*RECORDED), ROUNDS)
    out = {"cascade_derivations": f"WITH {tree} SELECT s, r, o, CAST(round AS INTEGER) AS round, hops, round(confidence, 6) AS confidence, s || '|' || r1 || '|' || mid AS first, mid || '|' || r2 || '|' || o AS second, total, depth, {', '.join(derivations.KINDS)} FROM known WHERE round > 0"}
    out["explained_facts"] = (
        f"WITH RECURSIVE {tree}, e AS (SELECT s || '|' || r || '|' || o AS fact, unnest([s || '|' || r1 || '|' || mid, mid || '|' || r2 || '|' || o]) AS premise FROM known WHERE round > 0), "
        f"w AS (SELECT DISTINCT fact AS root, fact, 0 AS depth FROM e UNION SELECT w.root, e.premise, w.depth + 1 FROM w JOIN e USING (fact) WHERE w.depth < {2 * ROUNDS}) "
        "SELECT root, fact, CAST(min(w.depth) AS INTEGER) AS depth, NOT EXISTS (SELECT 1 FROM e WHERE e.fact = w.fact) AS leaf, any_value(source) AS source FROM w JOIN known k ON w.fact = k.s || '|' || k.r || '|' || k.o GROUP BY root, fact"
    )
    how = "s || '|' || r1 || '|' || mid || ' & ' || mid || '|' || r2 || '|' || o"
    out["derivation_records"] = (
        f"WITH {tree}, old AS (SELECT * FROM {prov(*RECORDED)}), made AS (SELECT s, r, o, confidence, {how} AS derivation FROM known WHERE round > 0), "
        "rows AS (SELECT s, r, o, source, confidence, count AS n, last_seen AS t, CAST(NULL AS VARCHAR) AS derivation, 0 AS new FROM old UNION ALL SELECT s, r, o, 'induced', confidence, 1, 2000, derivation, 1 FROM made UNION ALL SELECT s, r, o, 'rule', 0.5, 1, 2001, NULL, 1 FROM made WHERE length(s) % 2 = 0 UNION ALL SELECT s, r, o, 'user', 0.9, 1, 1500, NULL, 1 FROM old WHERE count > 2) "
        "SELECT s, r, o, CASE WHEN count(DISTINCT source) > 1 THEN 'multi' ELSE min(source) END AS source, round(1 - (1 - arg_min(confidence, new * 10000 + t)) * pow(0.9, count(*) - 1), 6) AS confidence, CAST(sum(n) AS BIGINT) AS count, CAST(max(t) AS DOUBLE) AS last_seen, max(derivation) AS derivation FROM rows GROUP BY s, r, o"
    )
    denied = "SELECT DISTINCT 'order#' || l_orderkey AS s, 'madeof' AS r, lower(p_brand) AS o FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_partkey % 5 = 0"
    out["rule_attempts"] = (
        f"WITH t AS (SELECT 0 AS rule, 0.9 AS prior, x.s, 'madeof' AS r, y.o, [x.seq, y.seq] AS seqs FROM {f('L')} x JOIN {f('P2')} y ON x.o = y.s UNION ALL SELECT 1, 0.6, x.s, 'locatedin', y.o, [x.seq, y.seq] FROM {f('O')} x JOIN {f('C')} y ON x.o = y.s), "
        f"one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY s, r, o ORDER BY rule, seqs) AS k FROM t) WHERE k = 1), d AS ({denied}), "
        "m AS (SELECT one.*, d.s IS NOT NULL AS denied FROM one LEFT JOIN d USING (s, r, o)), n AS (SELECT *, row_number() OVER w - 1 AS attempt, coalesce(sum(CAST(denied AS INTEGER)) OVER (PARTITION BY rule ORDER BY seqs, s, r, o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS failed FROM m WINDOW w AS (PARTITION BY rule ORDER BY seqs, s, r, o)) "
        "SELECT s, r, o, rule, denied, CAST(attempt AS BIGINT) AS attempt, round(CASE WHEN attempt = 0 THEN prior ELSE (attempt - failed + 1) / (attempt + 2) END, 6) AS confidence FROM n"
    )
    return out
