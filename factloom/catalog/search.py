"""Queries that search for chains with scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import derivations, search
from ..oracle import f, prov
from ..plans import star

HUBS = ("P", "P2", "P3")
DEPTH, WIDTH, TOP, BEAM = 4, 8, 3, 4


def _skills(spark, d):
    """Chains of two relations over parts, told apart by the first fact's key."""
    own = star.facts(spark, d, *HUBS)
    n = own.groupBy("r").agg(F.count_if(F.col("seq") % 4 != 0).alias("success"), F.count_if(F.col("seq") % 4 == 0).alias("failure"))
    return n.select(F.array("r").alias("pattern"), F.when(F.col("r") == "size", F.col("success") - 1).otherwise(F.col("success")).alias("success"), "failure")


def beam_paths(spark, d):
    """Chains of up to four links from each part to the next one's brand, through types, brands and sizes that very many parts share."""
    key = lambda k: F.concat(F.lit("part#"), k.cast("string"))
    p = star.table(spark, d, "part")
    brand = F.lead(F.lower("p_brand")).over(search.W.partitionBy(F.floor(F.col("p_partkey") / 1000)).orderBy("p_partkey"))
    probes = p.select(key(F.col("p_partkey")).alias("probe"), key(F.col("p_partkey")).alias("start"), brand.alias("goal")).where("goal IS NOT NULL")
    ways = search.edges(star.facts(spark, d, *HUBS), star.provenance(spark, d, *HUBS), BEAM, reverse=True, skills=_skills(spark, d))
    return search.beam_search(ways, probes, DEPTH, WIDTH, TOP).withColumn("confidence", F.round("confidence", 6))


def analogy_chains(spark, d):
    """Analogies by a relation, and by the best chain where no relation links the pair."""
    key = lambda k: F.concat(F.lit("part#"), k.cast("string"))
    p = star.table(spark, d, "part")
    direct = p.select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("probe"), key(F.col("p_partkey")).alias("a"), F.lower("p_brand").alias("b"), key(F.col("p_partkey") + 1).alias("c"))
    o = star.facts(spark, d, "O").select("s", F.col("o").alias("m"), (F.pmod("seq", F.lit(star.STEP)) % 100 + 1).cast("string").alias("k"))
    home = star.facts(spark, d, "C").select(F.col("s").alias("m"), F.col("o").alias("b"))
    far = o.join(home, "m").select(F.col("s").alias("probe"), F.col("s").alias("a"), "b", F.concat(F.lit("order#"), "k").alias("c"))
    names = ("P2", "O", "C", "N")
    out = search.analogies(star.facts(spark, d, *names), direct.union(far), star.provenance(spark, d, "P2", "O"))
    return out.withColumn("probability", F.round("probability", 6))


QUERIES = {x.__name__: x for x in (beam_paths, analogy_chains)}


def _edges(src: str, recorded: str) -> str:
    cost = f"CAST(round(-ln(greatest(score, 1e-9)) * {derivations.UNIT}) AS BIGINT)"
    sk = f"(SELECT r, CASE WHEN r = 'size' THEN s - 1 ELSE s END AS s, t FROM (SELECT r, count(*) FILTER (seq % 4 <> 0) AS s, count(*) FILTER (seq % 4 = 0) AS t FROM {src} GROUP BY r))"
    return (
        f"sc AS (SELECT s, r, o, coalesce(max(confidence), 1.0) AS score FROM (SELECT DISTINCT s, r, o FROM {src}) LEFT JOIN {recorded} p USING (s, r, o) GROUP BY s, r, o), "
        f"pr AS (SELECT r, CAST(round(1000 * s * greatest(s / greatest(s + t, 1), 0.01)) AS BIGINT) AS priority FROM {sk}), "
        f"wy AS (SELECT s AS node, r, r AS plain, o, {cost} AS cost FROM sc WHERE score >= 0.1 UNION ALL SELECT o, '~' || r, r, s, {cost} FROM sc WHERE score >= 0.1), "
        f"ed AS (SELECT node, wy.r, o, cost, coalesce(priority, 0) AS priority FROM (SELECT *, row_number() OVER (PARTITION BY node, r ORDER BY cost, o) AS n FROM wy) wy LEFT JOIN pr ON plain = pr.r WHERE n <= {BEAM})"
    )


def _sure(hops: int, cost: str = "cost") -> str:
    return f"round(greatest(exp(-{cost} / {derivations.UNIT}.0 / {hops}) * pow(0.95, {hops} - 1), 0.01), {search.DIGITS})"


def sql() -> dict[str, str]:
    """Rounds unrolled, with the beam and the bounds of each."""
    probes = "SELECT 'part#' || p_partkey AS probe, lead(lower(p_brand)) OVER (PARTITION BY p_partkey // 1000 ORDER BY p_partkey) AS goal FROM part"
    parts = [_edges(f(*HUBS), prov(*HUBS)), f"f0 AS (SELECT probe, goal, probe AS node, CAST(0 AS BIGINT) AS cost, CAST(0 AS BIGINT) AS priority, CAST([] AS VARCHAR[]) AS rels, [probe] AS nodes FROM ({probes}) WHERE goal IS NOT NULL)"]
    found = []
    for k in range(1, DEPTH + 1):
        parts.append(f"g{k} AS (SELECT probe, goal, e.o AS node, x.cost + e.cost AS cost, x.priority + e.priority AS priority, list_append(rels, e.r) AS rels, list_append(nodes, e.o) AS nodes FROM f{k - 1} x JOIN ed e USING (node) WHERE NOT list_contains(nodes, e.o))")
        parts.append(f"h{k} AS (SELECT probe, rels, nodes, {k} AS hops, {_sure(k)} AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY probe, rels ORDER BY cost, nodes) AS n FROM g{k} WHERE node = goal) WHERE n = 1)")
        found.append(f"SELECT * FROM h{k}")
        if k < DEPTH:
            bar = f"(SELECT probe, min(confidence) AS bar FROM (SELECT probe, confidence, row_number() OVER (PARTITION BY probe ORDER BY confidence DESC) AS n FROM ({' UNION ALL '.join(found)})) WHERE n <= {TOP} GROUP BY probe HAVING count(*) >= {TOP})"
            reach = f"greatest({', '.join(_sure(k + j) for j in range(1, DEPTH - k + 1))}, 0)"
            parts.append(f"f{k} AS (SELECT probe, goal, node, cost, priority, rels, nodes FROM (SELECT *, row_number() OVER (PARTITION BY probe ORDER BY cost, priority DESC, rels, nodes) AS w FROM (SELECT *, row_number() OVER (PARTITION BY probe, node ORDER BY cost, priority DESC, rels, nodes) AS n FROM g{k} WHERE node <> goal) LEFT JOIN {bar} USING (probe) WHERE n = 1 AND (bar IS NULL OR {reach} > bar)) WHERE w <= {WIDTH})")
    out = {"beam_paths": f"WITH {', '.join(parts)} SELECT probe, array_to_string(rels, ',') AS relations, array_to_string(nodes, '>') AS nodes, hops, round(confidence, 6) AS confidence, CAST(n AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY probe ORDER BY confidence DESC, hops, rels) AS n FROM ({' UNION ALL '.join(found)})) WHERE n <= {TOP}"}
    out["analogy_chains"] = (
        f"WITH sc AS (SELECT x.s, x.r, x.o, coalesce(p.confidence, 1.0) AS score FROM {f('O', 'C')} x LEFT JOIN {prov('O')} p ON p.s = x.s AND p.o = x.o) "
        f"SELECT 'p' || a.p_partkey AS probe, 'madeof' AS relation, lower(b.p_brand) AS answer, CAST(1.0 AS DOUBLE) AS probability, 'relation' AS via FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1, {prov('P2')} q WHERE q.s = 'part#' || a.p_partkey AND q.confidence >= 0.1 "
        f"UNION ALL SELECT x.s, 'partof -> locatedin', w.o, round(0.95 * exp(-round(-ln(x.score) * 1000000) / 2000000), 6), 'chain' FROM sc x JOIN {f('O')} y ON y.s = 'order#' || (CAST(substr(x.s, 7) AS BIGINT) % 100 + 1) JOIN {f('C')} w ON w.s = y.o WHERE x.r = 'partof' AND x.score >= 0.1"
    )
    return out
