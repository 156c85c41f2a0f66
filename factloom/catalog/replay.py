"""Queries on what candidate facts would unlock."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import replay
from ..oracle import _INV, _head, f
from ..plans import star
from ..sources import scratch

ROUNDS = 3
#: Candidates: regions on earth are first, then nations of a bloc, then all orders.
REGIONS, NATIONS = 100, 1000


def _candidates(spark, d):
    t = star.table
    regions = t(spark, d, "region").select((F.col("r_regionkey") + 1).cast("long").alias("candidate"), F.lower("r_name").alias("s"), F.lit("locatedin").alias("r"), F.lit("earth").alias("o"))
    nations = t(spark, d, "nation").select((F.col("n_nationkey") + REGIONS).cast("long"), F.lower("n_name"), F.lit("partof"), F.concat(F.lit("bloc#"), (F.col("n_nationkey") % 4).cast("string")))
    blocs = t(spark, d, "region").where("r_regionkey < 4").select((F.col("r_regionkey") + 2 * REGIONS).cast("long"), F.concat(F.lit("bloc#"), F.col("r_regionkey").cast("string")), F.lit("locatedin"), F.lit("treaty"))
    orders = star.facts(spark, d, "O").select((F.pmod("seq", F.lit(star.STEP)) + NATIONS).cast("long"), "s", "r", "o")
    return scratch.keep(regions.union(nations).union(blocs).union(orders), "candidates")


def _facts(spark, d):
    return star.facts(spark, d, "C", "N", "P")


def unlocked_alone(spark, d):
    """How many facts each candidate unlocks by itself, and the first five."""
    c = _candidates(spark, d)
    return replay.summed(replay.alone(_facts(spark, d), c, ROUNDS), c)


def unlocked_in_order(spark, d):
    """How many facts each candidate unlocks after those before it, and the first five."""
    c = _candidates(spark, d)
    return replay.summed(replay.in_order(_facts(spark, d), c, ROUNDS), c)


QUERIES = {x.__name__: x for x in (unlocked_alone, unlocked_in_order)}


def _way(t: str, more: str = "") -> str:
    return f"SELECT a.s, {_head('a.r', 'b.r')} AS r, b.o, greatest(a.v, b.v) AS v FROM {t} a JOIN {t} b ON a.o = b.s WHERE a.s <> b.o AND a.o <> b.o AND a.s <> a.o {more} AND NOT EXISTS (SELECT 1 FROM {_INV} WHERE inv.a = a.r AND inv.b = b.r)"


def sql() -> dict[str, str]:
    cand = (
        f"c AS (SELECT CAST(r_regionkey + 1 AS BIGINT) AS v, lower(r_name) AS s, 'locatedin' AS r, 'earth' AS o FROM region UNION ALL SELECT n_nationkey + {REGIONS}, lower(n_name), 'partof', 'bloc#' || (n_nationkey % 4) FROM nation "
        f"UNION ALL SELECT r_regionkey + {2 * REGIONS}, 'bloc#' || r_regionkey, 'locatedin', 'treaty' FROM region WHERE r_regionkey < 4 UNION ALL SELECT seq % 100000000000000000 + {NATIONS}, s, r, o FROM {f('O')}), b AS (SELECT DISTINCT s, r, o FROM {f('C', 'N', 'P')})"
    )
    alone = [cand, "k0 AS (SELECT s, r, o, CAST(0 AS BIGINT) AS v FROM b UNION SELECT s, r, o, v FROM c)"]
    order = [cand, "k0 AS (SELECT s, r, o, min(v) AS v FROM (SELECT s, r, o, CAST(0 AS BIGINT) AS v FROM b UNION ALL SELECT s, r, o, v FROM c) GROUP BY s, r, o)"]
    for i in range(1, 2 * ROUNDS + 1):
        if i <= ROUNDS:
            order.append(f"k{i} AS (SELECT s, r, o, min(v) AS v FROM (SELECT * FROM k{i - 1} UNION ALL SELECT * FROM ({_way(f'k{i - 1}')}) WHERE r IS NOT NULL) GROUP BY s, r, o)")
        alone.append(f"k{i} AS (SELECT * FROM k{i - 1} UNION SELECT * FROM ({_way(f'k{i - 1}', 'AND (a.v = 0 OR b.v = 0 OR a.v = b.v)')}) WHERE r IS NOT NULL)")
    ends = lambda rows: f"u AS ({rows}), n AS (SELECT v, count(*) AS n, array_to_string(list(s || '|' || r || '|' || o ORDER BY s, r, o)[1:5], '; ') AS sample FROM u GROUP BY v) SELECT DISTINCT c.v AS candidate, coalesce(n, 0) AS n, coalesce(sample, '') AS sample FROM c LEFT JOIN n USING (v)"
    return {
        "unlocked_alone": f"WITH {', '.join(alone)}, " + ends(f"SELECT DISTINCT s, r, o, v FROM k{2 * ROUNDS} k WHERE v > 0 AND NOT EXISTS (SELECT 1 FROM k{2 * ROUNDS} x WHERE x.v = 0 AND x.s = k.s AND x.r = k.r AND x.o = k.o) AND NOT EXISTS (SELECT 1 FROM c WHERE c.v = k.v AND c.s = k.s AND c.r = k.r AND c.o = k.o)"),
        "unlocked_in_order": f"WITH {', '.join(order)}, " + ends(f"SELECT s, r, o, v FROM k{ROUNDS} k WHERE v > 0 AND NOT EXISTS (SELECT 1 FROM c WHERE c.s = k.s AND c.r = k.r AND c.o = k.o)"),
    }
