"""Queries that make training pairs, name relatives, evaluate expressions and keep sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expression
from ..operators import corpus, kinship
from ..oracle import _EPISODES, f, prov
from ..plans import star
from ..sources import scratch, sessions

TOLD = ("N", "P", "P2", "C2", "NEG")
SHAPES = ("({a} + {b}) * 3 - {a}", "what is -{a} ^ 2 / 4?", "2 ** 3 ** 2 - {b}", "sqrt({a} * {a}) + abs(0 - {b}) % 7", "{a} / (5 - 5)", "calculate {a} - {b} - (-4)", "({a} + ", "10,000 % {b}")


def corpus_pairs(spark, d):
    """Training pairs of seven tasks from facts."""
    return corpus.pairs(star.facts(spark, d, *TOLD)).select("task", "draft", "target", "seq")


def corpus_in_order(spark, d):
    """The pairs from easy to hard, a tenth of each tier again after the next."""
    return corpus.in_order(corpus.pairs(star.facts(spark, d, *TOLD)), "part", "seq", "k", "draft")


def _family(spark, d):
    """(s, r, o), "o is the r of s": each customer's parent is a third of their key; every fourth is married to the next."""
    k = F.col("c_custkey")
    c = star.table(spark, d, "customer").select(k.alias("k"))
    name = lambda x: F.concat(F.lit("person#"), x.cast("string"))
    said = lambda own, x, f_, m: own.select(name(F.col("k")).alias("s"), F.when(x % 2 == 0, f_).otherwise(m).alias("r"), name(x).alias("o"))
    kids = c.withColumn("p", F.floor(F.col("k") / 3)).where("p > 0")
    up = said(kids, F.col("p"), "mother", "father")
    down = kids.select(name(F.col("p")).alias("s"), F.when(F.col("k") % 2 == 0, "daughter").otherwise("son").alias("r"), name(F.col("k")).alias("o"))
    married = c.where("k % 4 = 0").join(c.select((F.col("k") - 1).alias("k")), "k")
    both = said(married, F.col("k") + 1, "wife", "husband").union(married.select(name(F.col("k") + 1).alias("s"), F.lit("wife").alias("r"), name(F.col("k")).alias("o")))
    pairs = kids.join(kids.select(F.col("k").alias("j"), "p"), "p").where("j != k")  # three to a parent
    return up.union(down).union(both).union(pairs.select(name(F.col("k")), F.when(F.col("j") % 2 == 0, "sister").otherwise("brother"), name(F.col("j"))))


def relatives(spark, d):
    """Names of people two or three steps away in families."""
    return kinship.relatives(scratch.keep(_family(spark, d), "family"))


def expressions(spark, d):
    """Values of arithmetic expressions about parts, some of which have none."""
    p = star.table(spark, d, "part").select("p_partkey", F.col("p_partkey").alias("a"), F.col("p_size").alias("b"))
    said = []
    for x in SHAPES:
        pieces = x.replace("{a}", "\0a\0").replace("{b}", "\0b\0").split("\0")
        said.append(F.concat(*[F.col(y).cast("string") if y in ("a", "b") else F.lit(y) for y in pieces]))
    text = F.get(F.array(*said), (F.col("p_partkey") % len(SHAPES)).cast("int"))
    return p.select("p_partkey", F.round(expression.evaluate(text), 6).alias("value"))


def _session(spark, d, *names):
    own = star.facts(spark, d, *names)
    skills = own.groupBy(F.array("r").alias("pattern")).agg(F.count_if(F.col("seq") % 3 != 0).alias("success"), F.count_if(F.col("seq") % 3 == 0).alias("failure"))
    return {"facts": own, "records": star.provenance(spark, d, *names), "skills": skills, "episodes": star.episodes(spark, d).select("id", "subject", "relation", "state")}


def session_snapshot(spark, d):
    """A session of an older schema saved, a newer one begun and left without its manifest, and the older one loaded and converted."""
    path = scratch.place(spark, "sessions")
    old = _session(spark, d, "C", "P2")
    sessions.save(old | {"records": old["records"].drop("last_seen")}, path, 1)
    old["facts"].limit(1).write.parquet(f"{path}/2-broken/facts")
    now = sessions.load(spark, path, 2, {1: lambda t: t | {"records": t["records"].withColumn("last_seen", F.lit(0.0))}})
    rows = [df.agg(F.lit(name).alias("name"), F.count("*").alias("n"), F.lit(",".join(sorted(df.columns))).alias("columns")) for name, df in sorted(now.items())]
    return rows[0].union(rows[1]).union(rows[2]).union(rows[3])


def session_merge(spark, d):
    """Skills of two sessions as one: counters add up."""
    out = sessions.merged(_session(spark, d, "C", "P2", "P3"), _session(spark, d, "C", "O"))
    return out["skills"].select(F.array_join("pattern", ",").alias("pattern"), "success", "failure")


QUERIES = {x.__name__: x for x in (corpus_pairs, corpus_in_order, relatives, expressions, session_snapshot, session_merge)}


def _pairs() -> str:
    clean = lambda c: f"replace({c}, '_', ' ')"
    say = lambda shape, **own: " || ".join(f"'{x}'" if k % 2 == 0 else clean(own.get(x, x)) for k, x in enumerate(shape.replace("'", "''").replace("{", "\0").replace("}", "\0").split("\0")))
    n = len(corpus.PHRASES)
    phrase = "[" + ", ".join(say(p) for p in corpus.PHRASES) + "]"
    at = lambda k: f"ph[(st + {k}) % {n} + 1]"
    lists = lambda xs: "(" + ", ".join(f"'{x}'" for x in xs) + ")"
    each = [("paraphrase", at(2 * k), at(2 * k + 1 + k // 2), "true") for k in range(corpus.PARAPHRASES)] + [
        ("qa", say("what is the {r} of {s}?"), say("the {r} of {s} is {o}."), "true"), ("qa", say("who or what is the {r} associated with {o}?"), say("{o} is associated with {s} via {r}."), f"r IN {lists(corpus.BACKWARD)}"),
        ("fill_blank", say("the {r} of {s} is ___."), clean("o"), "true"), ("boolean", say("is {s} a {o}?"), say("yes, {s} is a {o}."), f"r IN {lists(corpus.KINDS)}"), ("boolean", say("is {s} {o}?"), say("yes, {s} is {o}."), "r = 'color'"),
        ("boolean", say("does {s} have {r} of {o}?"), say("yes, {s} {r} {o}."), f"r IN {lists(corpus.OWNED)}"), ("honest_no", say("what is the favourite colour of {s}?"), say("I don't have any record of the favourite colour of {s}."), f"seq % {corpus.HONEST} = 0"),
    ]
    rows = " UNION ALL ".join(f"SELECT 0 AS part, seq, {k} AS k, '{task}' AS task, {a} AS draft, {b} AS target FROM y WHERE {when}" for k, (task, a, b, when) in enumerate(each))
    return (
        f"x AS (SELECT * FROM {f(*TOLD)} WHERE NOT starts_with(r, 'not_')), y AS (SELECT *, {phrase} AS ph, (length(s) + length(o)) % {n} AS st FROM x), e AS ({rows}), "
        f"su AS (SELECT 1 AS part, min(seq) AS seq, 0 AS k, 'summarize' AS task, string_agg({say('{s} {r} {o}.')}, ' ' ORDER BY seq) AS draft, any_value({clean('s')}) || ' has ' || string_agg({say('{r} {o}')}, ', ' ORDER BY seq) || '.' AS target FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY seq) AS n FROM x) WHERE n <= {corpus.SUMMED} GROUP BY s HAVING count(*) > 1), "
        f"rk AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY seq, s, o) - 1 AS n FROM x), co AS (SELECT 2 AS part, a.seq, 0 AS k, 'contrast' AS task, {say('{a.s} {a.r} {a.o}. {b.s} {a.r} {b.o}.')} AS draft, {say('unlike {a.s} which has {a.r} = {a.o}, {b.s} has {a.r} = {b.o}.')} AS target FROM rk a JOIN rk b ON a.r = b.r AND b.n = a.n + 1 AND a.n % 2 = 0 WHERE a.o <> b.o), "
        "pa AS (SELECT * FROM e UNION ALL SELECT * FROM su UNION ALL SELECT * FROM co)"
    )


def _term(sex: str = "g") -> str:
    by = lambda m, w: f"CASE WHEN {sex} = 'M' THEN '{m}' ELSE '{w}' END"
    great = lambda n: f"repeat('great-', greatest({n} - 2, 0))"
    return (
        f"CASE WHEN up = 0 AND down = 0 THEN NULL WHEN down = 0 AND up = 1 THEN {by('father', 'mother')} WHEN down = 0 THEN {great('up')} || {by('grandfather', 'grandmother')} WHEN up = 0 AND down = 1 THEN {by('son', 'daughter')} WHEN up = 0 THEN {great('down')} || {by('grandson', 'granddaughter')} "
        f"WHEN up = 1 AND down = 1 THEN {by('brother', 'sister')} WHEN down = 1 THEN {great('up')} || {by('uncle', 'aunt')} WHEN up = 1 THEN {great('down')} || {by('nephew', 'niece')} WHEN up = down THEN CASE up WHEN 2 THEN 'cousin' WHEN 3 THEN 'second cousin' END END"
    )


def sql() -> dict[str, str]:
    out = {"corpus_pairs": f"WITH {_pairs()} SELECT task, draft, target, seq FROM pa"}
    hard = "CASE task " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in corpus.DIFFICULTY.items()) + " END"
    words = lambda c: f"len(list_filter(regexp_split_to_array({c}, '\\s+'), lambda w: w <> ''))"
    out["corpus_in_order"] = (
        f"WITH {_pairs()}, sc AS (SELECT *, least({corpus.TIERS - 1}, CAST(floor(least(1.0::DOUBLE, 0.5::DOUBLE * (({words('draft')} + {words('target')}) / {2 * corpus.LONGEST}) + 0.5::DOUBLE * CAST({hard} AS DOUBLE)) * {corpus.TIERS}) AS INTEGER)) AS tier FROM pa), "
        f"r AS (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY part, seq, k, draft) - 1 AS i FROM sc), n AS (SELECT t AS tier, (SELECT count(*) FROM sc WHERE sc.tier = t) AS n FROM (SELECT unnest(range({corpus.TIERS})) AS t)), "
        "w AS (SELECT *, greatest(1, n // 10) AS want, lag(n) OVER (ORDER BY tier) AS was FROM n), "
        "again AS (SELECT w.tier AS after, r.*, r.i // greatest(1, w.was // w.want) AS j FROM w JOIN r ON r.tier = w.tier - 1 WHERE r.i % greatest(1, w.was // w.want) = 0 AND r.i // greatest(1, w.was // w.want) < w.want), "
        "both_ AS (SELECT tier AS bucket, 0 AS late, i AS at_, tier, false AS review, task, draft, target FROM r UNION ALL SELECT after, 1, j, tier, true, task, draft, target FROM again) "
        "SELECT row_number() OVER (ORDER BY bucket, late, at_) - 1 AS place, CAST(tier AS INTEGER) AS tier, review, task, draft, target FROM both_"
    )
    sex = lambda x, w, m: f"CASE WHEN {x} % 2 = 0 THEN '{w}' ELSE '{m}' END"
    inlaw = "CASE a.r || '|' || b.r " + " ".join(f"WHEN '{x if x != 'spouse' else s}|{y if y != 'spouse' else s}' THEN '{v}'" for (x, y), v in kinship.BY_MARRIAGE.items() for s in kinship.SPOUSE) + " END"
    ups = lambda *rs: " + ".join(f"CASE WHEN {r} IN ('mother', 'father', 'brother', 'sister') THEN 1 ELSE 0 END" for r in rs)
    downs = lambda *rs: " + ".join(f"CASE WHEN {r} IN ('son', 'daughter', 'brother', 'sister') THEN 1 ELSE 0 END" for r in rs)
    goes_up = lambda r: f"{r} IN ('mother', 'father', 'brother', 'sister')"
    goes_down = lambda r: f"{r} IN ('son', 'daughter', 'brother', 'sister')"
    blood = lambda *rs: " AND ".join(f"{r} NOT IN ('husband', 'wife')" for r in rs) + "".join(f" AND NOT ({goes_down(rs[i])} AND {goes_up(rs[j])})" for i in range(len(rs)) for j in range(i + 1, len(rs)))
    last = lambda r: f"CASE WHEN {r} IN ('father', 'son', 'brother', 'husband') THEN 'M' ELSE 'F' END"
    out["relatives"] = (
        f"WITH c AS (SELECT c_custkey AS k, c_custkey // 3 AS p FROM customer), kids AS (SELECT * FROM c WHERE p > 0), m AS (SELECT c.k FROM c JOIN c o ON o.k = c.k + 1 WHERE c.k % 4 = 0), "
        f"fa AS (SELECT DISTINCT * FROM (SELECT k AS s, {sex('p', 'mother', 'father')} AS r, p AS o FROM kids UNION ALL SELECT p, {sex('k', 'daughter', 'son')}, k FROM kids UNION ALL SELECT k, {sex('(k + 1)', 'wife', 'husband')}, k + 1 FROM m UNION ALL SELECT k + 1, 'wife', k FROM m UNION ALL SELECT x.k, {sex('y.k', 'sister', 'brother')}, y.k FROM kids x JOIN kids y ON x.p = y.p AND x.k <> y.k)), "
        f"two AS (SELECT a.s, b.o, a.r || ',' || b.r AS relations, {inlaw} AS law, {blood('a.r', 'b.r')} AS blood, {ups('a.r', 'b.r')} AS up, {downs('a.r', 'b.r')} AS down, {last('b.r')} AS g FROM fa a JOIN fa b ON a.o = b.s WHERE a.s <> b.o), "
        f"three AS (SELECT a.s, c.o, a.r || ',' || b.r || ',' || c.r AS relations, NULL AS law, {blood('a.r', 'b.r', 'c.r')} AS blood, {ups('a.r', 'b.r', 'c.r')} AS up, {downs('a.r', 'b.r', 'c.r')} AS down, {last('c.r')} AS g FROM fa a JOIN fa b ON a.o = b.s JOIN fa c ON b.o = c.s WHERE a.s <> b.o AND a.s <> c.o AND a.o <> c.o) "
        f"SELECT DISTINCT 'person#' || s AS start, 'person#' || o AS \"end\", relations, term FROM (SELECT s, o, relations, coalesce(law, CASE WHEN blood THEN {_term()} END) AS term FROM (SELECT * FROM two UNION ALL SELECT * FROM three)) WHERE term IS NOT NULL"
    )
    a, b = "CAST(p_partkey AS DOUBLE)", "CAST(p_size AS DOUBLE)"
    values = (f"({a} + {b}) * 3 - {a}", f"pow(-{a}, 2) / 4", f"512 - {b}", f"{a} + ({b} - 7 * floor({b} / 7))", "NULL", f"{a} - {b} + 4", "NULL", f"10000 - {b} * floor(10000 / {b})")
    out["expressions"] = "SELECT p_partkey, round(CASE p_partkey % 8 " + " ".join(f"WHEN {k} THEN {v}" for k, v in enumerate(values)) + " END, 6) AS value FROM part"
    both = f("C", "P2")
    out["session_snapshot"] = (
        f"SELECT 'facts' AS name, count(*) AS n, 'o,r,s,seq' AS columns FROM {both} UNION ALL SELECT 'records', count(*), 'confidence,count,last_seen,o,r,s,source' FROM {prov('C', 'P2')} "
        f"UNION ALL SELECT 'skills', count(DISTINCT r), 'failure,pattern,success' FROM {both} UNION ALL SELECT 'episodes', count(*), 'id,relation,state,subject' FROM ({_EPISODES})"
    )
    own = lambda *names: f"SELECT r, seq FROM {f(*names)}"
    out["session_merge"] = f"SELECT r AS pattern, count(*) FILTER (seq % 3 <> 0) AS success, count(*) FILTER (seq % 3 = 0) AS failure FROM ({own('C', 'P2', 'P3')} UNION ALL {own('C', 'O')}) GROUP BY r"
    return out
