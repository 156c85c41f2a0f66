"""Queries that tell, deny, sum up, ask back and write."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import phrases, questions, text
from ..operators import briefs, dialogue, pattern, telling
from ..oracle import _EPISODES, _INV, K, f, prov
from ..plans import star
from ..sources import scratch
from . import dialogue as talk

ABOUT = ("P", "P2", "P3", "D40")
WRITTEN = ("N", "P", "P2", "NEG")


def _tells(spark, d):
    """Customers that move, denials of what parts are made of, some twice, and a third of the customers told again."""
    key = F.pmod("seq", F.lit(star.STEP)).cast("double")
    rows = lambda df, op, source, sure, late: df.select(F.lit(op).alias("op"), "s", "r", "o", F.lit(source).alias("source"), F.lit(sure).alias("confidence"), (key + late).alias("ts"))
    c, moved, denied = star.facts(spark, d, "C"), star.facts(spark, d, "C50"), star.facts(spark, d, "D40")
    plain = denied.withColumn("r", F.lit("madeof"))
    return rows(moved, "tell", "user", 0.9, 0.25).union(rows(c.where("seq % 3 = 0"), "tell", "external", 0.6, 0.5)).union(rows(plain, "deny", "user", 0.8, 0.0)).union(rows(denied.where("seq % 80 = 0"), "deny", "rule", 0.5, 0.75))


def told_base(spark, d):
    """The base after tells and denials."""
    out = telling.applied(star.facts(spark, d, "C", "P2"), star.provenance(spark, d, "C"), _tells(spark, d))
    return scratch.keep(out["facts"], "told")


def told_records(spark, d):
    """The records after tells and denials."""
    out = telling.applied(star.facts(spark, d, "C", "P2"), star.provenance(spark, d, "C"), _tells(spark, d))
    return out["records"].select("s", "r", "o", "source", F.round("confidence", 6).alias("confidence"), "count", "last_seen")


def subject_dossiers(spark, d):
    """Everything that is known of each part."""
    e = star.episodes(spark, d).withColumn("subject", F.replace("subject", F.lit("user#"), F.lit("part#")))
    return briefs.subjects(star.facts(spark, d, *ABOUT), star.provenance(spark, d, "P", "P2"), e)


def subject_overviews(spark, d):
    return briefs.overviews(star.facts(spark, d, *WRITTEN, "C", "C2"))


def research_briefs(spark, d):
    """A brief with sources on every subject and every object."""
    return briefs.briefs(star.facts(spark, d, *WRITTEN), star.provenance(spark, d, "P"))


def clarification_requests(spark, d):
    """What to ask back about answers, kinds and pronouns."""
    names = ("C", "C50")
    probes = star.facts(spark, d, "C").select(F.col("s").alias("probe"), "s", "r")
    answers = pattern.calibrated(star.facts(spark, d, *names), star.provenance(spark, d, *names), probes)
    two = star.facts(spark, d, "P").union(star.facts(spark, d, "P3").where("seq % 4 = 0").withColumn("r", F.lit("isa")))
    turns = dialogue.read(talk._turns(spark, d))
    said = turns.select("conv", "turn", F.col("own_entity").alias("entity"), questions.has_pronoun(text.tokens(F.col("text"))).alias("pronoun"))
    return briefs.clarifications(answers, two, scratch.keep(said, "said"))


def rendered_facts(spark, d):
    """Facts under other names of their relations, as sentences, and answers hedged by how sure their records are."""
    other = F.when(F.col("r") == "madeof", "made of").when(F.col("r") == "locatedin", " Found in").when(F.col("r") == "size", "magnitude").otherwise(F.col("r"))
    rows = star.facts(spark, d, "N", "C", "C2", "P", "P2", "P3", "O").select("seq", "s", phrases.relation_name(other).alias("r"), phrases.entity_name(F.col("o")).alias("o"))
    sure = F.pmod("seq", F.lit(9)) / 30
    return rows.select("seq", phrases.sentence(F.col("s"), F.col("r"), F.col("o")).alias("sentence"), phrases.hedged(F.col("o"), sure).alias("hedged"))


QUERIES = {x.__name__: x for x in (told_base, told_records, subject_dossiers, subject_overviews, research_briefs, clarification_requests, rendered_facts)}


def _sentence(s: str = "s", r: str = "r", o: str = "o") -> str:
    fill = lambda shape: " || ".join(x for x in ("'" + shape.replace("'", "''").replace("{s}", f"' || replace({s}, '_', ' ') || '").replace("{o}", f"' || replace({o}, '_', ' ') || '").replace("{r}", f"' || {r} || '") + "'",))
    return f"CASE {r} " + " ".join(f"WHEN '{k}' THEN {fill(v)}" for k, v in phrases.SENTENCES.items()) + f" ELSE {fill(phrases.OTHERWISE)} END"


def _section(r: str = "r") -> str:
    table = {x: k for k, xs in enumerate(briefs.SECTIONS.values()) for x in xs}
    return f"CASE {r} " + " ".join(f"WHEN '{x}' THEN {k}" for x, k in table.items()) + f" ELSE {briefs.OTHER} END"


def sql() -> dict[str, str]:
    out = {}
    key = f"CAST(seq % {K} AS DOUBLE)"
    tells = (
        f"tl AS (SELECT 'tell' AS op, s, r, o, 'user' AS source, 0.9 AS confidence, {key} + 0.25 AS ts FROM {f('C50')} UNION ALL SELECT 'tell', s, r, o, 'external', 0.6, {key} + 0.5 FROM {f('C')} WHERE seq % 3 = 0 "
        f"UNION ALL SELECT 'deny', s, 'not_madeof', o, 'user', 0.8, {key} FROM {f('D40')} UNION ALL SELECT 'deny', s, r, o, 'rule', 0.5, {key} + 0.75 FROM {f('D40')} WHERE seq % 80 = 0), b AS (SELECT * FROM {f('C', 'P2')})"
    )
    out["told_base"] = (
        f"WITH {tells}, n AS (SELECT s, r, o, ts, 0 AS side FROM tl UNION ALL SELECT o, inv.b, s, ts, 1 FROM tl JOIN {_INV} ON inv.a = r WHERE op = 'tell'), m AS (SELECT s, r, o, ts, side, row_number() OVER (PARTITION BY s, r, o ORDER BY ts, side) AS k FROM n) "
        "SELECT seq, s, r, o FROM b UNION ALL SELECT (SELECT max(seq) FROM b) + row_number() OVER (ORDER BY ts, side, s, r, o), s, r, o FROM m WHERE k = 1 AND NOT EXISTS (SELECT 1 FROM b WHERE b.s = m.s AND b.r = m.r AND b.o = m.o)"
    )
    out["told_records"] = (
        f"WITH {tells}, x AS (SELECT s, r, o, source, confidence, count AS n, last_seen AS t, 0 AS new FROM {prov('C')} UNION ALL SELECT s, r, o, source, confidence, 1, ts, 1 FROM tl) "
        "SELECT s, r, o, CASE WHEN min(source) <> max(source) THEN 'multi' ELSE min(source) END AS source, round(1 - (1 - arg_min(confidence, new * 1e9 + t)) * pow(0.9, count(*) - 1), 6) AS confidence, CAST(sum(n) AS BIGINT) AS count, max(t) AS last_seen FROM x GROUP BY s, r, o"
    )
    first = lambda what, rows, by, order, n, sep=", ": f"(SELECT {by}, string_agg({what}, '{sep}' ORDER BY k) AS x FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {order}) AS k FROM {rows}) WHERE k <= {n} GROUP BY {by})"
    out["subject_dossiers"] = (
        f"WITH v AS (SELECT * FROM {f(*ABOUT)}), p AS (SELECT * FROM v WHERE NOT starts_with(r, 'not_')), q AS (SELECT * FROM v WHERE starts_with(r, 'not_')), up AS (SELECT s, o AS parent, seq FROM v WHERE r = 'isa'), "
        f"pe AS (SELECT parent, s AS peer FROM (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY seq, s) AS k FROM up) WHERE k <= {briefs.PEERS}), nb AS (SELECT DISTINCT up.s, peer FROM up JOIN pe USING (parent) WHERE up.s <> peer), rc AS (SELECT * FROM {prov('P', 'P2')}) "
        f"SELECT n.s, n_facts, coalesce(a.x, '') AS facts, coalesce(b.x, '') AS denials, coalesce(c.x, '') AS parents, coalesce(g.x, '') AS siblings, coalesce(h.x, '') AS sources, coalesce(n_derived, 0) AS n_derived, coalesce(n_asked, 0) AS n_asked "
        f"FROM (SELECT s, count(*) FILTER (NOT starts_with(r, 'not_')) AS n_facts FROM v GROUP BY s) n LEFT JOIN {first(chr(39).join(['r || ', '=', ' || o']), 'p', 's', 'seq', briefs.SHOWN)} a USING (s) LEFT JOIN {first(chr(39).join(['substr(r, 5) || ', '=', ' || o']), 'q', 's', 'seq', 3)} b USING (s) LEFT JOIN {first('parent', 'up', 's', 'seq', briefs.SHOWN)} c USING (s) "
        f"LEFT JOIN {first('peer', 'nb', 's', 'peer', briefs.SIBLINGS)} g USING (s) LEFT JOIN (SELECT s, string_agg(source || ':' || m, ',' ORDER BY source) AS x FROM (SELECT s, source, count(*) AS m FROM rc GROUP BY 1, 2) GROUP BY s) h USING (s) "
        f"LEFT JOIN (SELECT s, count(*) AS n_derived FROM rc WHERE source IN ('induced', 'rule') GROUP BY s) i USING (s) LEFT JOIN (SELECT replace(subject, 'user#', 'part#') AS s, count(*) AS n_asked FROM ({_EPISODES}) GROUP BY 1) j USING (s)"
    )
    over = lambda names: f"(SELECT s, string_agg(x, chr(10) || chr(10) ORDER BY sec) AS overview FROM (SELECT s, sec, string_agg({_sentence()}, ' ' ORDER BY k) AS x FROM (SELECT *, row_number() OVER (PARTITION BY s, sec ORDER BY seq) AS k FROM (SELECT *, {_section()} AS sec FROM {f(*names)})) WHERE k <= {briefs.SENTENCES} GROUP BY s, sec) GROUP BY s)"
    out["subject_overviews"] = f"SELECT s, replace(overview, '_', ' ') AS overview FROM {over((*WRITTEN, 'C', 'C2'))}"
    pl = lambda c: f"replace({c}, '_', ' ')"
    cut = lambda part, topic, rows, by, order, n: f"SELECT {topic} AS topic, {part} AS part, s, r, o, seq FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {order}) AS k FROM {rows}) WHERE k <= {n}"
    heads = "['Overview', 'Classification', 'Instances', 'Relations', 'Citations']"
    out["research_briefs"] = (
        f"WITH v AS (SELECT * FROM {f(*WRITTEN)}), isa AS (SELECT * FROM v WHERE r = 'isa'), ou AS ({cut(0, 's', 'v', 's', 'seq', briefs.SHOWN)}), pa AS ({cut(1, 's', 'isa', 's', 'seq', briefs.CHILDREN)}), ch AS ({cut(2, 'o', 'isa', 'o', 'seq, s', briefs.CHILDREN)}), me AS ({cut(3, 'o', 'v', 'o', 'seq, s, r', briefs.MENTIONS)}), "
        f"nm AS (SELECT topic, r, string_agg({pl('s')}, ', ' ORDER BY seq, s) AS x, min(seq) AS q FROM (SELECT *, row_number() OVER (PARTITION BY topic, r ORDER BY seq, s) AS k FROM me) WHERE k <= {briefs.NAMED} GROUP BY topic, r), "
        f"ci AS (SELECT a.*, p.source, row_number() OVER (PARTITION BY topic ORDER BY part, a.seq, a.s, a.r, a.o) AS k FROM (SELECT * FROM ou UNION ALL SELECT * FROM pa UNION ALL SELECT * FROM ch UNION ALL SELECT * FROM me) a JOIN {prov('P')} p USING (s, r, o)), "
        f"tx AS (SELECT s AS topic, 0 AS part, {pl('overview')} AS x FROM {over(WRITTEN)} UNION ALL SELECT topic, 1, {pl('topic')} || ' is classified as: ' || string_agg({pl('o')}, ', ' ORDER BY seq) FROM pa GROUP BY topic "
        f"UNION ALL SELECT topic, 2, 'Known instances or subtypes of ' || {pl('topic')} || ' include: ' || string_agg({pl('s')}, ', ' ORDER BY seq, s) || '.' FROM ch GROUP BY topic "
        f"UNION ALL SELECT topic, 3, string_agg({pl('topic')} || ' is the ' || {pl('r')} || ' of ' || x || '.', ' ' ORDER BY q) FROM nm GROUP BY topic "
        f"UNION ALL SELECT topic, 4, {pl(chr(39) + 'Source provenance for facts cited above:' + chr(39))} || chr(10) || string_agg({pl(chr(39).join(['', '- (', ' || s || ', ', ', ' || r || ', ', ', ' || o || ', ') source: ', ' || source']))}, chr(10) ORDER BY k) FROM ci WHERE k <= {briefs.CITED} GROUP BY topic) "
        f"SELECT topic, '# Research brief: ' || array_to_string(list_transform(string_split({pl('topic')}, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') || chr(10) || chr(10) || string_agg('## ' || {heads}[part + 1] || chr(10) || chr(10) || x, chr(10) || chr(10) ORDER BY part) AS brief FROM tx GROUP BY topic"
    )
    w = "OVER (PARTITION BY conv ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    pron = "[" + ", ".join(f"'{x}'" for x in questions.PRONOUNS) + "]"
    out["clarification_requests"] = (
        f"WITH {talk._resolved()}, an AS (@@ANSWERS@@), cl AS (SELECT a.*, t.score AS top FROM an a JOIN an t ON t.probe = a.probe AND t.rank = 1 WHERE a.rank = 1 OR (a.rank <= 5 AND a.score >= {briefs.RATIO} * t.score)), "
        f"ki AS (SELECT s, o, row_number() OVER (PARTITION BY s ORDER BY seq, o) AS k FROM (SELECT min(seq) AS seq, s, o FROM (SELECT seq, s, o FROM {f('P')} UNION ALL SELECT seq, s, o FROM {f('P3')} WHERE seq % 4 = 0) GROUP BY s, o)), "
        f"sp AS (SELECT conv, turn, e, last_value(e IGNORE NULLS) {w} AS last, k IN (1, 4, 5) OR (k = 6 AND list_has_any(t, {pron})) AS pronoun FROM own), sw AS (SELECT *, CASE WHEN e <> last THEN last END AS was FROM sp), se AS (SELECT *, last_value(was IGNORE NULLS) {w} AS second FROM sw) "
        "SELECT probe AS about, 'similar_confidence' AS reason, string_agg(value, ', ' ORDER BY rank) AS candidates FROM cl WHERE rank <= 4 GROUP BY probe HAVING count(*) > 1 "
        "UNION ALL SELECT s, 'entity_polysemy', string_agg(s || ' the ' || o, ', ' ORDER BY k) FROM ki WHERE k <= 4 GROUP BY s HAVING count(*) > 1 "
        "UNION ALL SELECT conv || ':' || turn, 'pronoun_ambiguity', last || ', ' || second FROM se WHERE pronoun AND second IS NOT NULL"
    )
    from ..oracle import oracle_sql

    out["clarification_requests"] = out["clarification_requests"].replace("@@ANSWERS@@", oracle_sql()["calibrated_ask"])
    said = [f"WHEN c >= {least} THEN '" + shape.replace("'", "''").replace("{a}", "' || o || '") + "'" for least, shape in phrases.SAID]
    unknown = phrases.UNKNOWN.replace("'", "''")
    alias = "CASE o " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in phrases.ENTITIES.items()) + " ELSE replace(lower(trim(o)), ' ', '_') END"
    own = "CASE r WHEN 'category' THEN 'category' WHEN 'isa' THEN 'isa' ELSE r END"
    out["rendered_facts"] = f"SELECT seq, {_sentence()} AS sentence, CASE {' '.join(said)} ELSE '{unknown}' END AS hedged FROM (SELECT seq, s, {own} AS r, {alias} AS o, (seq % 9) / 30 AS c FROM {f('N', 'C', 'C2', 'P', 'P2', 'P3', 'O')})"
    return out
