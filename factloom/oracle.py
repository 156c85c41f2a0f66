"""SQL of the registered queries, written against the base tables, for an engine that checks the results."""

from __future__ import annotations

from .functions import traits

K = 10**17

_VIEWS = {
    "N": f"SELECT {1 * K} + n_nationkey AS seq, lower(n_name) AS s, 'locatedin' AS r, lower(r_name) AS o FROM nation JOIN region ON n_regionkey = r_regionkey",
    "C": f"SELECT {2 * K} + c_custkey AS seq, lower(c_name) AS s, 'locatedin' AS r, lower(n_name) AS o FROM customer JOIN nation ON c_nationkey = n_nationkey",
    "C2": f"SELECT {3 * K} + c_custkey AS seq, lower(c_name) AS s, 'category' AS r, lower(c_mktsegment) AS o FROM customer",
    "S": f"SELECT {4 * K} + s_suppkey AS seq, lower(s_name) AS s, 'locatedin' AS r, lower(n_name) AS o FROM supplier JOIN nation ON s_nationkey = n_nationkey",
    "P": f"SELECT {5 * K} + p_partkey AS seq, 'part#' || p_partkey AS s, 'isa' AS r, lower(p_type) AS o FROM part",
    "P2": f"SELECT {6 * K} + p_partkey AS seq, 'part#' || p_partkey AS s, 'madeof' AS r, lower(p_brand) AS o FROM part",
    "P3": f"SELECT {7 * K} + p_partkey AS seq, 'part#' || p_partkey AS s, 'size' AS r, CASE WHEN p_size <= 10 THEN 'tiny' WHEN p_size <= 20 THEN 'small' WHEN p_size <= 30 THEN 'medium' WHEN p_size <= 40 THEN 'large' ELSE 'huge' END AS o FROM part",
    "O": f"SELECT {8 * K} + o_orderkey AS seq, 'order#' || o_orderkey AS s, 'partof' AS r, lower(c_name) AS o FROM orders JOIN customer ON o_custkey = c_custkey",
    "O2": f"SELECT {9 * K} + o_orderkey AS seq, 'order#' || o_orderkey AS s, 'kind' AS r, lower(o_orderpriority) AS o FROM orders",
    "L": f"SELECT DISTINCT {10 * K} + l_orderkey * 100000000 + l_partkey AS seq, 'order#' || l_orderkey AS s, 'has' AS r, 'part#' || l_partkey AS o FROM lineitem",
    "E": f"SELECT {11 * K} + event_id AS seq, 'e#' || event_id AS s, 'causes' AS r, 'e#' || nxt AS o FROM (SELECT event_id, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events) WHERE nxt IS NOT NULL",
    "NEG": f"SELECT {12 * K} + min(p_partkey) AS seq, lower(p_type) AS s, 'not_madeof' AS r, lower(p_brand) AS o FROM part WHERE p_partkey % 23 = 0 GROUP BY p_type, p_brand",
    "C50": f"SELECT {13 * K} + c_custkey AS seq, lower(c_name) AS s, 'locatedin' AS r, lower(n_name) AS o FROM customer JOIN nation ON (c_nationkey + 1) % 25 = n_nationkey WHERE c_custkey % 50 = 0",
    "D40": f"SELECT {14 * K} + p_partkey AS seq, 'part#' || p_partkey AS s, 'not_madeof' AS r, lower(p_brand) AS o FROM part WHERE p_partkey % 40 = 0",
}

_EPISODES = "SELECT event_id AS id, ts, 'user#' || user_id AS subject, event_type AS relation, CASE WHEN value > 150 THEN 'known' WHEN value > 60 THEN 'ambiguous' ELSE 'idk' END AS state, CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) % 3 AS VARCHAR) AS symbol, value / 500 AS score FROM events"


def f(*names: str) -> str:
    return "(" + " UNION ALL ".join(_VIEWS[n] for n in names) + ")"


def prov(*names: str) -> str:
    k = f"(seq % {K})"
    return f"(SELECT s, r, o, CASE {k} % 3 WHEN 0 THEN 'user' WHEN 1 THEN 'external' ELSE 'induced' END AS source, least(1.0, 0.05 + ({k} % 20) / 20.0) AS confidence, CAST(1 + {k} % 4 AS BIGINT) AS count, CAST({k} % 1000 AS DOUBLE) AS last_seen FROM {f(*names)})"


def names(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _head(a: str, b: str) -> str:
    out = f"CASE WHEN {a} = {b} AND {a} IN {names(traits.TRANSITIVE)} THEN {a}"
    for firsts, lasts in traits.TRANSFERS:
        out += f" WHEN {a} IN {names(firsts)} AND {a} IN {names(traits.LIFTING)} AND {b} IN {names(lasts)} THEN {b}"
    return out + " END"


_INV = "(VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in dict.fromkeys([*traits.INVERSES, *((b, a) for a, b in traits.INVERSES)])) + ") inv(a, b)"
_BELIEFS = "(SELECT DISTINCT lower(s_name) AS b, 'part#' || l_partkey AS s, 'madeof' AS r, 'brand#' || CAST((l_partkey + l_suppkey) % 25 + 1 AS VARCHAR) AS o FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)"
_SAMPLES = "(SELECT doc_id, least(1.0, n_chars / 20000.0) AS score, quality = 1 AS correct FROM documents JOIN labels USING (doc_id))"
_HEDGE = "CASE WHEN {c} >= 0.30 THEN 'strong' WHEN {c} >= 0.10 THEN 'moderate' WHEN {c} >= 0.03 THEN 'weak' ELSE 'uncertain' END"
_SUMMARY = "count(*) AS n, count(DISTINCT s) AS subjects, count(DISTINCT o) AS objects"


def _skills() -> str:
    v = f("O", "C", "N", "O2", "L", "P")
    return f"(SELECT a.r AS r1, b.r AS r2, count(*) FILTER (a.seq % 4 <> 0) AS success, count(*) FILTER (a.seq % 4 = 0) AS failure FROM {v} a JOIN {v} b ON a.o = b.s GROUP BY 1, 2)"


def _long_skills() -> str:
    v = f("O", "C", "C2", "N", "L", "P", "P2")
    good = "count(*) FILTER (a.seq % 9 <> 0) AS success, count(*) FILTER (a.seq % 9 = 0) AS failure"
    return f"(WITH v AS (SELECT * FROM {v}) SELECT a.r AS r1, b.r AS r2, NULL AS r3, {good} FROM v a JOIN v b ON a.o = b.s GROUP BY 1, 2 UNION ALL SELECT a.r, b.r, c.r, {good} FROM v a JOIN v b ON a.o = b.s JOIN v c ON b.o = c.s GROUP BY 1, 2, 3)"


def _pav(rows: str) -> str:
    """(upto, fit, n) of rows (upto, total, n): the rising fit of least squares by its min-max form, a row for each level."""
    return (
        f"(WITH g AS (SELECT * FROM {rows}), x AS (SELECT *, row_number() OVER (ORDER BY upto) AS i, sum(total) OVER (ORDER BY upto) AS st, sum(n) OVER (ORDER BY upto) AS sn FROM g), "
        "p AS (SELECT a.i AS j, b.i AS k, (b.st - a.st + a.total) / (b.sn - a.sn + a.n) AS m FROM x a JOIN x b ON a.i <= b.i), q AS (SELECT j, k, min(m) OVER (PARTITION BY j ORDER BY k DESC) AS lo FROM p), "
        "y AS (SELECT k AS i, round(max(lo), 12) AS fit FROM q GROUP BY k) SELECT max(upto) AS upto, fit, sum(total) AS total, sum(n) AS n FROM y JOIN x USING (i) GROUP BY fit)"
    )


def _steps() -> str:
    first = _pav(f"(SELECT score AS upto, CAST(sum(CAST(correct AS INTEGER)) AS DOUBLE) AS total, CAST(count(*) AS DOUBLE) AS n FROM {_SAMPLES} GROUP BY score)")
    return _pav(f"(SELECT upto, (total + 1) / (n + 2) * n AS total, n FROM {first})")


def _rules() -> str:
    lift, trans = names(traits.LIFTING), names(traits.TRANSITIVE)
    return (
        f"(SELECT r1, r2, CASE WHEN r1 = r2 AND r1 IN {trans} THEN r1 WHEN r1 IN {lift} THEN r2 ELSE 'implies' END AS head, success AS support, success / (success + failure) AS confidence FROM {_skills()} "
        f"WHERE success >= 2 AND success / (success + failure) >= 0.5 AND NOT (r1 = r2 AND r1 NOT IN {trans}) AND NOT EXISTS (SELECT 1 FROM {_INV} WHERE a = r1 AND b = r2))"
    )


def _gaps(src: str) -> str:
    return (
        f"(WITH x AS (SELECT * FROM {src}), kids AS (SELECT s, arg_min(o, seq) AS parent FROM x WHERE r = 'isa' GROUP BY s), own AS (SELECT DISTINCT s, r FROM x WHERE r <> 'isa' AND NOT starts_with(r, 'not_')), "
        "n AS (SELECT parent, count(*) - 1 AS siblings FROM kids GROUP BY parent), have AS (SELECT parent, r, count(*) AS support FROM own JOIN kids USING (s) GROUP BY 1, 2) "
        "SELECT kids.s, have.r, support, siblings, support / siblings AS share FROM kids JOIN n USING (parent) JOIN have USING (parent) WHERE siblings >= 3 AND support >= 0.4 * siblings AND NOT EXISTS (SELECT 1 FROM own WHERE own.s = kids.s AND own.r = have.r))"
    )


def _cascade(src: str, rounds: int, also: str = "") -> str:
    """Rounds unrolled: each joins all that is known."""
    useful = names(sorted({*traits.TRANSITIVE, *traits.LIFTING, *(x for _, lasts in traits.TRANSFERS for x in lasts)}))
    neg = f"neg AS (SELECT DISTINCT s, substr(r, 5) AS r, o FROM {src} WHERE starts_with(r, 'not_'))"
    parts = [neg, f"k0 AS (SELECT DISTINCT s, r, o FROM (SELECT s, r, o FROM {src} {also}) WHERE r IN {useful})"]
    for i in range(1, rounds + 1):
        parts.append(
            f"k{i} AS (SELECT s, r, o FROM k{i - 1} UNION SELECT s, r, o FROM (SELECT a.s, {_head('a.r', 'b.r')} AS r, b.o FROM k{i - 1} a JOIN k{i - 1} b ON a.o = b.s WHERE a.s <> b.o AND a.o <> b.o AND a.s <> a.o AND NOT EXISTS (SELECT 1 FROM {_INV} WHERE inv.a = a.r AND inv.b = b.r)) t "
            f"WHERE r IS NOT NULL AND NOT EXISTS (SELECT 1 FROM neg WHERE neg.s = t.s AND neg.r = t.r AND neg.o = t.o))"
        )
    return f"(WITH {', '.join(parts)} SELECT s, r, o FROM k{rounds} EXCEPT SELECT s, r, o FROM k0)"


def _ancestors(src: str, starts: str, edges, depth: int) -> str:
    return (
        f"(WITH RECURSIVE up AS (SELECT DISTINCT s AS node, o AS nxt FROM {src} WHERE r IN {names(edges)}), w AS (SELECT DISTINCT s, s AS ancestor, 0 AS depth FROM {starts} "
        f"UNION SELECT w.s, up.nxt, w.depth + 1 FROM w JOIN up ON w.ancestor = up.node WHERE w.depth < {depth}) SELECT s, ancestor, min(depth) AS depth FROM w WHERE depth > 0 AND ancestor <> s GROUP BY 1, 2)"
    )


def _effects(a: str, b: str) -> str:
    return (
        f"WITH RECURSIVE e AS (SELECT DISTINCT {a} AS x, {b} AS y FROM {f('E')}), w AS (SELECT x AS start, x AS node, 0 AS depth FROM e UNION SELECT w.start, e.y, w.depth + 1 FROM w JOIN e ON w.node = e.x WHERE w.depth < 3) "
        "SELECT start, node, CAST(min(depth) AS INTEGER) AS depth, CAST(1.0 AS DOUBLE) AS score FROM w WHERE depth > 0 GROUP BY 1, 2"
    )


def oracle_sql() -> dict[str, str]:
    geo = f("O", "C", "N")
    out = {}
    out["facts_all"] = f"SELECT r, {_SUMMARY} FROM {f('N', 'C', 'C2', 'S', 'P', 'P2', 'P3', 'O', 'O2', 'L', 'E', 'NEG')} GROUP BY r"
    src = f("N", "C", "P", "P2")
    out["symmetrise"] = f"SELECT DISTINCT x.o AS s, inv.b AS r, x.s AS o FROM {src} x JOIN {_INV} ON x.r = inv.a WHERE NOT EXISTS (SELECT 1 FROM {src} y WHERE y.s = x.o AND y.r = inv.b AND y.o = x.s)"
    out["forget_first"] = f"SELECT s, r, o FROM (SELECT *, row_number() OVER (PARTITION BY s, r, o ORDER BY seq) AS n FROM {f('C', 'C50')}) x WHERE NOT (n = 1 AND EXISTS (SELECT 1 FROM {f('C')} y WHERE y.seq % 7 = 0 AND y.s = x.s AND y.o = x.o))"
    out["html_pages"] = r"SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '&[a-zA-Z#0-9]+;', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM pages"
    sym = lambda c: f"regexp_replace({c}, '[^A-Za-z0-9]+', '_', 'g')"
    out["open_extraction"] = f"SELECT seq AS id, {sym('s')} AS s, r, {sym('o')} AS o FROM {f('N', 'C', 'S', 'P', 'P2', 'P3')}"
    out["corrections"] = (
        "SELECT op, 'part' || p_partkey AS s, r, o FROM part JOIN (VALUES (0, 'store', 'is', 'good'), (0, 'forget', 'is', 'bad'), (1, 'store', 'price', 'high'), (1, 'forget', 'price', 'low'), (2, 'store', 'is', 'good'), (3, 'store', 'is', 'gear')) v(k, op, r, o) ON p_partkey % 5 = k"
    )
    out["jsonl_source"] = f"SELECT s, r, o FROM {f('C', 'O')}"
    out["csv_source"] = f"SELECT s, r, o FROM {f('C', 'O')} WHERE seq % 5 <> 0"
    out["graph_source"] = f"SELECT {sym('s')} AS s, r, {sym('o')} AS o, (seq % 6) / 2.0 AS weight, least((seq % 6) / 2.0 / 4, 1.0) AS confidence FROM {f('P', 'P2', 'C')} WHERE seq % 4 <> 0 AND (seq % 6) / 2.0 >= 1"
    out["graph_source"] = f"SELECT s, r, o, CAST(weight AS DOUBLE) AS weight, CAST(confidence AS DOUBLE) AS confidence FROM ({out['graph_source']})"
    out["text_source"] = f"SELECT {sym('lower(n_name)')} AS s, 'home' AS r, 'earth' AS o FROM nation"
    out["log_recovery"] = f"SELECT s, r, o, CAST(1 AS BIGINT) AS n FROM {f('O')} WHERE (seq % {K}) % 7 <> 0"
    out["pattern_unknown"] = f"WITH v AS (SELECT o, min(seq) AS q FROM {f('C', 'S')} GROUP BY o), t AS (SELECT o, CAST(row_number() OVER (ORDER BY q, o) AS INTEGER) AS rank FROM v) SELECT s AS probe, t.o AS value, CAST(1.0 AS DOUBLE) AS score, rank FROM {f('N')}, t WHERE rank <= 3"
    out["compare_numbers"] = (
        "WITH q AS (SELECT 'part#' || p_partkey AS a, 'part#' || (p_partkey + 1) AS b, p_size * 1000.0 AS x, (SELECT z.p_size * 1000.0 FROM part z WHERE z.p_partkey = part.p_partkey + 1) AS y FROM part) "
        "SELECT a, b, CAST(x AS DOUBLE) AS value_a, CAST(y AS DOUBLE) AS value_b, CASE WHEN y IS NULL THEN 'unknown' WHEN x > y THEN a WHEN x < y THEN b ELSE 'tie' END AS winner FROM q"
    )
    out["compare_pairs"] = f"WITH t AS (SELECT * FROM {f('P', 'P2', 'P3')}) SELECT 'part#' || p_partkey AS a, 'part#' || (p_partkey + 1) AS b, x.r, x.o AS value_a, y.o AS value_b, CASE x.r WHEN 'isa' THEN 1 WHEN 'madeof' THEN 2 ELSE 3 END AS n FROM part JOIN t x ON x.s = 'part#' || p_partkey JOIN t y ON y.s = 'part#' || (p_partkey + 1) AND y.r = x.r"
    out["log_fold"] = f"SELECT s, r, o, count(*) AS n FROM {f('O')} WHERE (seq % {K}) % 7 <> 0 GROUP BY s, r, o"
    say = "s || ' ' || r || ' ' || o"
    out["training_corpus"] = " UNION ALL ".join(f"SELECT '{t}' AS task, {a} AS draft, {b} AS target FROM {f('P', 'P2')}" for t, a, b in (("declare", say, say + " || '.'"), ("ask", "'what is the ' || r || ' of ' || s || '?'", "o"), ("fill", "s || ' ' || r || ' ___'", "o"), ("confirm", "'is it true that ' || " + say + " || '?'", "'yes'")))

    out["pattern_point"] = f"SELECT * FROM (SELECT s AS probe, o AS value, CAST(1.0 AS DOUBLE) AS score, CAST(row_number() OVER (PARTITION BY s ORDER BY min(seq)) AS INTEGER) AS rank FROM {f('L')} WHERE s IN (SELECT s FROM {f('O')}) GROUP BY s, o) WHERE rank <= 3"
    out["pattern_subjects"] = f"SELECT * FROM (SELECT o AS probe, s AS value, CAST(1.0 AS DOUBLE) AS score, CAST(row_number() OVER (PARTITION BY o ORDER BY min(seq)) AS INTEGER) AS rank FROM {f('C', 'S')} GROUP BY s, o) WHERE rank <= 3"
    out["answer_first"] = f"SELECT s, r, arg_min(o, seq) AS answer, count(DISTINCT o) AS n_values FROM {f('C', 'C50', 'L')} GROUP BY s, r"
    out["epistemic_ask"] = f"WITH v AS (SELECT s, count(DISTINCT o) AS n, arg_min(o, seq) AS top FROM {f('C', 'C50')} GROUP BY s) SELECT p.s AS probe, CASE WHEN n IS NULL THEN 'idk' WHEN n > 1 THEN 'ambiguous' ELSE 'known' END AS state, top, CAST(CASE WHEN n IS NULL THEN 0 ELSE 1 END AS DOUBLE) AS score, coalesce(n, 0) AS n_values FROM {f('C', 'S')} p LEFT JOIN v ON p.s = v.s"
    out["calibrated_ask"] = (
        f"WITH v AS (SELECT s, r, o, row_number() OVER (PARTITION BY s, r ORDER BY min(seq)) AS n FROM {f('C', 'C50')} GROUP BY s, r, o), w AS (SELECT v.s, v.o, v.n, CASE source WHEN 'induced' THEN 0.9 WHEN 'multi' THEN 1.05 WHEN 'external' THEN 0.85 ELSE 1.0 END AS score FROM v LEFT JOIN {prov('C', 'C50')} p USING (s, r, o) WHERE v.n <= 6) "
        "SELECT s AS probe, o AS value, CAST(score AS DOUBLE) AS score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY s ORDER BY score DESC, n) AS INTEGER) AS rank FROM w) WHERE rank <= 3"
    )
    out["denied_filter"] = f"SELECT s, r, o FROM {f('P2')} x WHERE NOT EXISTS (SELECT 1 FROM {f('D40')} y WHERE y.s = x.s AND y.o = x.o)"
    out["infer_inherited"] = f"SELECT x.s || '/l' AS probe, y.o AS answer, CAST(0.7 AS DOUBLE) AS score, 'inherited' AS how FROM {f('O')} x JOIN {f('C')} y ON x.o = y.s"
    out["boolean_verdict"] = (
        f"WITH t AS (SELECT * FROM {f('P', 'P3')}), p AS (SELECT s, r, o FROM t UNION SELECT s, r, 'tiny' FROM t WHERE r = 'size') SELECT s || '|' || r || '|' || o AS probe, ok AS verdict, CASE WHEN NOT ok THEN 'contradicted' WHEN r = 'isa' THEN 'isa-transitive' ELSE 'direct' END AS how "
        "FROM (SELECT p.*, EXISTS (SELECT 1 FROM t WHERE t.s = p.s AND t.r = p.r AND t.o = p.o) AS ok FROM p)"
    )
    rank = "CASE o WHEN 'tiny' THEN 1 WHEN 'small' THEN 2 WHEN 'medium' THEN 3 WHEN 'large' THEN 4 WHEN 'huge' THEN 5 END"
    out["compare_sizes"] = f"WITH z AS (SELECT s, {rank} AS n FROM {f('P3')}), q AS (SELECT 'part#' || p_partkey AS a, 'part#' || (p_partkey + 1) AS b FROM part) SELECT a, b, CASE WHEN x.n IS NULL OR y.n IS NULL THEN 'unknown' WHEN x.n > y.n THEN a WHEN x.n < y.n THEN b ELSE 'tie' END AS winner FROM q LEFT JOIN z x ON a = x.s LEFT JOIN z y ON b = y.s"
    out["numeric_threshold"] = "SELECT 'part#' || p_partkey AS s, CAST(p_size * 1000 AS DOUBLE) AS value FROM part WHERE p_size >= 25"
    out["containment"] = f"SELECT c.s AS contained, n.o AS container, 2 AS depth FROM {f('C')} c JOIN {f('N')} n ON c.o = n.s"
    out["ambiguous_entities"] = f"SELECT s, count(DISTINCT o) AS n_parents FROM {f('C', 'C50')} GROUP BY s HAVING count(DISTINCT o) >= 2"
    out["describe_parts"] = f"SELECT a.s, a.s || ' isa ' || a.o || '. ' || a.s || ' madeof ' || b.o || '. ' || a.s || ' size ' || c.o || '.' AS description FROM {f('P')} a JOIN {f('P2')} b USING (s) JOIN {f('P3')} c USING (s)"
    out["two_step_question"] = f"SELECT x.s, x.o AS middle, y.o AS answer FROM {f('O')} x JOIN {f('C')} y ON x.o = y.s"
    out["canonical_names"] = "SELECT n_nationkey, CASE WHEN n = 'france_land' THEN 'fr' ELSE n END AS name FROM (SELECT n_nationkey, replace(lower(trim(' ' || n_name || ' Land ')), ' ', '_') AS n FROM nation)"

    brand = "lower(p_brand)"
    out["set_intersect"] = f"SELECT {brand} AS \"group\", 'part#' || p_partkey AS value, CAST(1.0 AS DOUBLE) AS score FROM part WHERE p_size > 30 AND p_size <= 40"
    out["set_union"] = f"WITH h AS (SELECT {brand} AS g, 'part#' || p_partkey AS v FROM part UNION ALL SELECT b.g, 'part#' || p_partkey FROM part, (SELECT DISTINCT {brand} AS g FROM part) b WHERE p_size > 30 AND p_size <= 40) SELECT g AS \"group\", v AS value, count(*) AS n_satisfied, CAST(1.0 AS DOUBLE) AS score FROM h GROUP BY 1, 2"
    out["set_difference"] = f"SELECT {brand} AS \"group\", 'part#' || p_partkey AS value FROM part WHERE NOT (p_size > 30 AND p_size <= 40)"
    out["deduplicate"] = f"SELECT s, r, o FROM {f('C')} WHERE seq % 3 = 0"
    out["base_diff"] = f"WITH a AS (SELECT DISTINCT s, r, o FROM {f('C')}), b AS (SELECT DISTINCT s, r, o FROM {f('C', 'C50')} WHERE seq % 5 <> 0) SELECT *, 'both' AS side FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT *, 'left' FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT *, 'right' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)"
    out["base_merge"] = f"SELECT DISTINCT s, r, o FROM {f('C', 'C50')}"
    out["provenance_merge"] = f"SELECT s, r, o, CASE WHEN count > 2 AND source <> 'user' THEN 'multi' ELSE source END AS source, round(CASE WHEN count > 2 THEN confidence + 0.1 * (1 - confidence) ELSE confidence END, 6) AS confidence, CASE WHEN count > 2 THEN 2 * count ELSE count END AS count, last_seen FROM {prov('C')}"

    out["chain_order_region"] = f"SELECT x.s AS start, z.o AS answer, 3 AS hops, round(0.95 * 0.95, 6) AS confidence, 'strong' AS hedge FROM {f('O')} x JOIN {f('C')} y ON x.o = y.s JOIN {f('N')} z ON y.o = z.s"
    out["chain_reverse"] = (
        f"WITH a AS (SELECT o AS start, arg_min(s, seq) AS m FROM {f('N')} GROUP BY o), b AS (SELECT o AS m, arg_min(s, seq) AS answer FROM {f('C')} GROUP BY o) "
        "SELECT start, answer, CAST(CASE WHEN answer IS NULL THEN 1 ELSE 2 END AS INTEGER) AS hops, CASE WHEN answer IS NULL THEN 'unknown' ELSE 'strong' END AS hedge FROM a LEFT JOIN b USING (m)"
    )
    out["discover_paths"] = f"SELECT x.s || '>' || z.o AS probe, 'partof,locatedin,locatedin' AS relations, x.s || '>' || y.s || '>' || z.s || '>' || z.o AS nodes, 3 AS hops, round(0.95 * 0.95, 6) AS confidence, 1 AS rank FROM {f('O')} x JOIN {f('C')} y ON x.o = y.s JOIN {f('N')} z ON y.o = z.s"
    out["discover_reverse"] = f"SELECT x.s || '>' || y.s AS probe, 'locatedin,~locatedin' AS relations, x.s || '>' || x.o || '>' || y.s AS nodes, 2 AS hops, 1 AS rank FROM {f('N')} x JOIN {f('N')} y ON x.o = y.o AND x.s <> y.s"
    out["custom_goal"] = (
        f"SELECT x.s AS start, CASE WHEN starts_with(y.o, 'a') THEN y.o ELSE z.o END AS node, CASE WHEN starts_with(y.o, 'a') THEN 2 ELSE 3 END AS hops FROM {f('O')} x JOIN {f('C')} y ON x.o = y.s JOIN {f('N')} z ON y.o = z.s WHERE starts_with(y.o, 'a') OR starts_with(z.o, 'a')"
    )
    out["slot_outputs"] = (
        "SELECT p_partkey AS id, 'b' || regexp_extract(p_brand, '(\\d+)', 1) || CASE WHEN p_size % 2 = 0 THEN 's' || p_size ELSE '' END AS output, CAST(2 AS BIGINT) AS n_slots, CAST(CASE WHEN p_size % 2 = 0 THEN 2 ELSE 1 END AS BIGINT) AS n_known FROM part"
    )
    out["causal_effects"] = _effects("s", "o")
    out["root_causes"] = _effects("o", "s")
    out["ancestor_closure"] = f"SELECT s, ancestor, CAST(depth AS INTEGER) AS depth FROM {_ancestors(geo, f('O'), ('partof', 'locatedin'), 3)}"
    out["sibling_pairs"] = f"WITH k AS (SELECT DISTINCT s, o FROM {f('N', 'S')}) SELECT a.s, b.s AS sibling, count(*) AS n_shared FROM k a JOIN k b ON a.o = b.o AND a.s <> b.s GROUP BY 1, 2"
    out["property_search"] = f"SELECT r, o, cause, score, CAST(rank AS INTEGER) AS rank FROM (SELECT r, o, s AS cause, CAST(1.0 AS DOUBLE) AS score, row_number() OVER (PARTITION BY r, o ORDER BY s) AS rank FROM (SELECT DISTINCT s, r, o FROM {f('P2', 'P3')})) WHERE rank <= 8"
    out["analogy_solve"] = "SELECT a.p_partkey AS probe, 'madeof' AS relation, lower(b.p_brand) AS answer, CAST(1.0 AS DOUBLE) AS probability FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1"
    out["round_trip_check"] = f"SELECT s, r, o, round(CASE WHEN x <= 5 THEN 1.0 / x ELSE 0 END, 6) AS forward, round(CASE WHEN y <= 5 THEN 1.0 / y ELSE 0 END, 6) AS reverse FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY seq) AS x, row_number() OVER (PARTITION BY o ORDER BY seq) AS y FROM {f('L')})"
    out["belief_truth"] = f"SELECT b, t.s, t.r, t.o, p.o AS truth, t.o = p.o AS agrees FROM {_BELIEFS} t LEFT JOIN {f('P2')} p ON t.s = p.s"
    out["belief_truth"] = out["belief_truth"].replace("t.o = p.o AS agrees", "coalesce(t.o = p.o, false) AS agrees")

    out["concept_density"] = f"SELECT n_facts, count(*) AS n_subjects FROM (SELECT s, count(*) AS n_facts FROM {f('O', 'O2', 'L', 'P')} GROUP BY s) GROUP BY n_facts"
    out["relation_cooccurrence"] = (
        f"WITH d AS (SELECT DISTINCT s, r FROM {f('O', 'O2', 'P2', 'P3', 'C', 'C2')}), n AS (SELECT r, count(*) AS n FROM d GROUP BY r), p AS (SELECT a.r AS r1, b.r AS r2, count(*) AS k FROM d a JOIN d b ON a.s = b.s AND a.r < b.r GROUP BY 1, 2) "
        "SELECT r1, r2, k AS \"both\", x.n - k AS only1, y.n - k AS only2, round(k / (x.n + y.n - k), 6) AS jaccard FROM p JOIN n x ON x.r = r1 JOIN n y ON y.r = r2 WHERE k >= 2"
    )
    out["similar_entities"] = (
        f"WITH d AS (SELECT DISTINCT s, r, o FROM {f('P2', 'P3')}), q AS (SELECT s FROM {f('P')}), p AS (SELECT a.s, b.s AS other, count(*) AS overlap FROM d a JOIN d b ON a.r = b.r AND a.o = b.o AND a.s <> b.s WHERE a.s IN (SELECT s FROM q) GROUP BY 1, 2) "
        "SELECT s, other, overlap, round(overlap / (4 - overlap), 6) AS jaccard, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY overlap DESC, other) AS rank FROM p) WHERE rank <= 10"
    )
    out["subject_importance"] = (
        f"WITH t AS (SELECT * FROM {geo}), a AS (SELECT s AS subject, count(*) AS as_s, 0 AS as_o, 0 AS asked FROM t GROUP BY s UNION ALL SELECT o, 0, count(*), 0 FROM t GROUP BY o UNION ALL SELECT subject, 0, 0, count(*) FROM ({_EPISODES}) GROUP BY subject) "
        "SELECT subject, CAST(sum(as_s) AS BIGINT) AS as_s, CAST(sum(as_o) AS BIGINT) AS as_o, CAST(sum(asked) AS BIGINT) AS asked, CAST(sum(as_s) + 0.5 * sum(as_o) + 2 * sum(asked) AS DOUBLE) AS score FROM a GROUP BY subject ORDER BY score DESC, subject LIMIT 20"
    )
    some = f"({_VIEWS['P']} UNION ALL {_VIEWS['P2']} UNION ALL SELECT * FROM ({_VIEWS['P3']}) WHERE seq % 3 <> 0)"
    out["knowledge_gaps"] = f"SELECT s, r, support, siblings, round(share, 6) AS share FROM {_gaps(some)}"
    out["expected_relations"] = (
        f"WITH x AS (SELECT * FROM {some}), k AS (SELECT s, r, o, min(seq) AS q FROM x WHERE r IN ('isa', 'kind', 'category') GROUP BY s, r, o), u AS (SELECT DISTINCT s, o FROM (SELECT *, row_number() OVER (PARTITION BY s, r ORDER BY q, o) AS n FROM k) WHERE n <= 3), "
        "w AS (SELECT DISTINCT o, s AS sib FROM (SELECT *, row_number() OVER (PARTITION BY r, o ORDER BY q, s) AS n FROM k) WHERE n <= 50), p AS (SELECT DISTINCT s, sib FROM u JOIN w USING (o) WHERE s <> sib), e AS (SELECT s, count(*) AS siblings FROM p GROUP BY s HAVING count(*) >= 3), "
        "own AS (SELECT DISTINCT s, r FROM x WHERE r NOT IN ('isa', 'kind', 'category')), h AS (SELECT p.s, own.r, count(*) AS hits FROM p JOIN own ON own.s = p.sib GROUP BY 1, 2) "
        "SELECT h.s, h.r, hits, siblings, round(hits / siblings, 6) AS agreement FROM h JOIN e USING (s) WHERE hits / siblings >= 0.4 AND NOT EXISTS (SELECT 1 FROM own WHERE own.s = h.s AND own.r = h.r)"
    )
    byte = "list_transform(range(1, strlen(s || chr(0) || r) + 1), lambda i: ascii(substr(s || chr(1) || r, CAST(i AS INTEGER), 1)))"
    table = "(SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END)) AS t)"
    fold = f"xor(4294967295, list_reduce(list_prepend(4294967295, {byte}), lambda c, b: xor(c // 256, t[CAST(xor(c % 256, CASE WHEN b = 1 THEN 0 ELSE b END) AS INTEGER) + 1])))"
    out["shard_balance"] = f"WITH h AS (SELECT {fold} % 16 AS shard FROM {f('O', 'C')}, {table}) SELECT CAST(g.shard AS INTEGER) AS shard, count(h.shard) AS n FROM (SELECT unnest(range(16)) AS shard) g LEFT JOIN h ON g.shard = h.shard GROUP BY 1"
    out["abstraction"] = "SELECT lower(p_type) AS parent, r, o, count(*) AS support, false AS known FROM (SELECT p_type, 'part#' || p_partkey AS s FROM part) JOIN " + f("P2", "P3") + " USING (s) GROUP BY 1, 2, 3 HAVING count(*) >= 3"
    out["source_report"] = f"SELECT source, count(*) AS n, round(avg(confidence), 6) AS confidence, round(avg(count), 6) AS reinforcement FROM {prov('C', 'P')} GROUP BY source"
    out["subject_summaries"] = f"SELECT s, count(*) FILTER (NOT starts_with(r, 'not_')) AS n_facts, count(*) FILTER (starts_with(r, 'not_')) AS n_denials, count(DISTINCT CASE WHEN NOT starts_with(r, 'not_') THEN r END) AS n_relations, coalesce(string_agg(DISTINCT CASE WHEN r = 'isa' THEN o END, ','), '') AS parents FROM {f('P', 'P2', 'P3', 'D40')} GROUP BY s"
    out["hot_keys"] = f"SELECT s, r, count(*) AS n FROM {f('L')} GROUP BY s, r ORDER BY n DESC, s, r LIMIT 10"
    out["shard_sizing"] = f"SELECT r, n, CAST(least(4096, greatest(8, pow(2, ceil(log2(greatest(1, floor(n * 1.25 / 80))))))) AS INTEGER) AS shards FROM (SELECT r, count(*) AS n FROM {f('O', 'L', 'C')} GROUP BY r)"
    few = f"(SELECT * FROM {f('P', 'P2')} WHERE seq % 3 <> 0)"
    out["active_learning"] = (
        f"WITH c AS (SELECT s, r, 'doubtful' AS why, greatest(0.0, 1 - 4 * abs(confidence - 0.15)) AS score FROM {prov('C')} WHERE confidence <= 0.4 UNION ALL SELECT s, r, 'unrecorded', 0.5 FROM {f('P')} UNION ALL SELECT s, r, 'gap', share FROM {_gaps(few)}) "
        "SELECT s, r, why, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY s, r ORDER BY score DESC, why) AS n FROM c) t WHERE n = 1 ORDER BY t.score DESC, s, r LIMIT 15"
    )

    out["functional_conflicts"] = f"SELECT s, r, count(DISTINCT o) AS n_values, string_agg(DISTINCT o, ',' ORDER BY o) AS values FROM {f('C', 'C50')} GROUP BY s, r HAVING count(DISTINCT o) >= 2"
    out["denial_conflicts"] = f"SELECT DISTINCT x.s, x.r, x.o FROM {f('P2')} x JOIN {f('D40')} y ON x.s = y.s AND x.o = y.o"
    out["conflict_resolution"] = f"WITH t AS (SELECT *, count(DISTINCT o) OVER (PARTITION BY s) AS n FROM {f('C', 'C50')}) SELECT s, r, o, seq < {13 * K} AS keep, 'order' AS reason FROM t WHERE n > 1"
    out["consensus"] = (
        f"WITH v AS (SELECT s AS probe, CASE WHEN NOT ends_with(o, '5') THEN o END AS value FROM {_BELIEFS}), n AS (SELECT probe, value, count(*) AS n FROM v GROUP BY 1, 2), w AS (SELECT *, row_number() OVER (PARTITION BY probe ORDER BY n DESC, value) AS k FROM n WHERE value IS NOT NULL) "
        "SELECT p.probe, w.value AS winner, coalesce(w.n, 0) AS n_votes, coalesce(z.n, 0) AS abstained FROM (SELECT DISTINCT probe FROM v) p LEFT JOIN w ON p.probe = w.probe AND k = 1 LEFT JOIN n z ON p.probe = z.probe AND z.value IS NULL"
    )
    gate = f("O", "C", "N", "L", "P2")
    out["induction_gates"] = (
        f"SELECT a.r || ',' || b.r AS relations, {_head('a.r', 'b.r')} AS head, CASE WHEN EXISTS (SELECT 1 FROM {_INV} WHERE inv.a = a.r AND inv.b = b.r) THEN 'inverse pair' WHEN a.r = b.r AND a.r NOT IN {names(traits.TRANSITIVE)} THEN 'repeated relation' WHEN a.o = b.o THEN 'cycle' WHEN {_head('a.r', 'b.r')} IS NULL THEN 'no head' ELSE 'accepted' END AS verdict, count(*) AS n "
        f"FROM {gate} a JOIN {gate} b ON a.o = b.s GROUP BY 1, 2, 3"
    )
    out["cascade_induction"] = f"SELECT * FROM {_cascade(geo, 4)}"
    out["rule_instances"] = f"SELECT DISTINCT x.s, 'locatedin' AS r, y.o FROM {f('O')} x JOIN {f('C')} y ON x.o = y.s"
    out["negation_propagation"] = f"SELECT DISTINCT p.s, n.r, n.o FROM {f('P')} p JOIN {f('NEG')} n ON p.o = n.s WHERE NOT EXISTS (SELECT 1 FROM {f('P2')} x WHERE x.s = p.s AND x.o = n.o)"
    out["rule_extraction"] = f"SELECT r1 || ',' || r2 AS body, head, support, round(confidence, 6) AS confidence FROM {_rules()}"
    out["rule_composition"] = f"SELECT a.r1 || ',' || a.r2 || ',' || b.r2 AS body, b.head, least(a.support, b.support) AS support, round(a.confidence * b.confidence, 6) AS confidence FROM {_rules()} a JOIN {_rules()} b ON a.head = b.r1 AND NOT (a.r1 = b.r1 AND a.r2 = b.r2 AND a.head = b.head)"
    out["skill_families"] = f"SELECT r1 AS family, count(*) AS members, CAST(sum(success) AS BIGINT) AS success, CAST(sum(failure) AS BIGINT) AS failure FROM {_long_skills()} GROUP BY r1 HAVING count(*) >= 2"
    promoted = (
        f"(SELECT r1 || ',' || r2 AS body, {_head('r1', 'r2')} AS head, CAST(sum(success) AS BIGINT) AS support, sum(success) / (sum(success) + sum(failure)) AS confidence FROM {_long_skills()} "
        f"GROUP BY r1, r2 HAVING count(*) >= 2 AND sum(success) / (sum(success) + sum(failure)) >= 0.7 AND {_head('r1', 'r2')} IS NOT NULL)"
    )
    out["skill_promotion"] = f"SELECT body, head, support, round(confidence, 6) AS confidence FROM {promoted}"
    out["rules_merged"] = f"SELECT body, head, max(support) AS support, round(max(confidence), 6) AS confidence FROM (SELECT r1 || ',' || r2 AS body, head, support, confidence FROM {_rules()} UNION ALL SELECT body, head, support, confidence FROM {promoted}) GROUP BY 1, 2"
    tried = f"(SELECT r1 || ',' || r2 AS pattern, CASE WHEN r1 = 'has' THEN 0 ELSE success END AS success, failure FROM {_skills()})"
    out["rules_pruned"] = f"SELECT pattern, success, failure, round((success + 1) / (success + failure + 2), 6) AS running FROM {tried} WHERE success + failure < 3 OR (success + 1) / (success + failure + 2) >= 0.3"
    out["rule_rounds"] = (
        f"SELECT x.s, 'locatedin' AS r, y.o, 1 AS round FROM {f('O')} x JOIN {f('C')} y ON x.o = y.s UNION SELECT y.s, 'locatedin', z.o, 1 FROM {f('C')} y JOIN {f('N')} z ON y.o = z.s "
        f"UNION SELECT x.s, 'locatedin', z.o, 2 FROM {f('O')} x JOIN {f('C')} y ON x.o = y.s JOIN {f('N')} z ON y.o = z.s"
    )
    cn = f("C", "N")
    earth = "UNION SELECT lower(r_name), 'locatedin', 'earth' FROM region"
    out["what_if"] = f"SELECT * FROM {_cascade(cn, 2, earth)} EXCEPT SELECT * FROM {_cascade(cn, 2)}"
    out["branch_view"] = f"SELECT DISTINCT s, r, o FROM {f('C')} WHERE (seq % {K}) % 4 <> 0 OR (seq % {K}) % 8 = 0"
    out["provenance_reinforced"] = "SELECT 'user#' || user_id AS s, 'did' AS r, event_type AS o, CASE WHEN count(DISTINCT event_id % 2) > 1 THEN 'multi' WHEN min(event_id % 2) = 0 THEN 'user' ELSE 'external' END AS source, round(1 - (1 - arg_min(value, event_id) / 1000) * pow(0.9, count(*) - 1), 6) AS confidence, count(*) AS count, max(event_id) AS last_seen FROM events GROUP BY user_id, event_type"
    out["pruned_facts"] = f"SELECT s, r, o FROM {f('C', 'P', 'P2')} x WHERE NOT EXISTS (SELECT 1 FROM {prov('C', 'P', 'P2')} p WHERE p.s = x.s AND p.r = x.r AND p.o = x.o AND confidence < 0.5 AND count <= 2 AND source <> 'user')"
    out["explain_tree"] = (
        f"WITH RECURSIVE e AS (SELECT * FROM {f('E')}), w AS (SELECT o AS root, o AS fact, 0 AS depth FROM e UNION SELECT w.root, e.s, w.depth + 1 FROM w JOIN e ON e.o = w.fact WHERE w.depth < 5) "
        "SELECT root, fact, CAST(min(depth) AS INTEGER) AS depth, NOT EXISTS (SELECT 1 FROM e WHERE e.o = fact) AS leaf FROM w GROUP BY root, fact"
    )

    w = "OVER (PARTITION BY subject, relation ORDER BY ts, id)"
    out["drift_events"] = f"SELECT id, subject, relation, was_state, state, was_symbol, symbol FROM (SELECT *, lag(state) {w} AS was_state, lag(symbol) {w} AS was_symbol, row_number() {w} AS n FROM ({_EPISODES})) WHERE n > 1 AND (state IS DISTINCT FROM was_state OR symbol IS DISTINCT FROM was_symbol)"
    out["stream_drift"] = out["drift_events"]
    out["drift_flags"] = f"SELECT subject, relation, bool_or(state <> s0 OR symbol <> y0) AS drifted FROM (SELECT *, first_value(state) {w} AS s0, first_value(symbol) {w} AS y0 FROM ({_EPISODES})) GROUP BY 1, 2"
    out["state_breakdown"] = f"SELECT state, count(*) AS n FROM ({_EPISODES}) GROUP BY state"
    out["hot_signatures"] = f"SELECT subject, relation, count(*) AS n FROM ({_EPISODES}) GROUP BY 1, 2 ORDER BY n DESC, subject, relation LIMIT 10"
    out["episode_consolidation"] = (
        f"WITH e AS ({_EPISODES}), n AS (SELECT subject, relation, count(*) AS n, count(*) FILTER (state <> 'idk') AS told, count(*) FILTER (state = 'ambiguous') AS unsure FROM e GROUP BY 1, 2 HAVING count(*) >= 3), "
        "m AS (SELECT *, row_number() OVER (PARTITION BY subject, relation ORDER BY m DESC, symbol) AS k FROM (SELECT subject, relation, symbol, count(*) AS m FROM e WHERE state <> 'idk' GROUP BY 1, 2, 3)) "
        "SELECT n.subject, n.relation, n, symbol AS mode, round(coalesce(m / told, 0.0), 6) AS share, CASE WHEN coalesce(m / told, 0.0) >= 0.5 THEN 'stable' ELSE 'unstable' END AS verdict, unsure / n >= 0.5 AS often_ambiguous FROM n LEFT JOIN m ON n.subject = m.subject AND n.relation = m.relation AND k = 1"
    )
    out["last_episodes"] = f"SELECT id, subject, relation, CAST(n AS INTEGER) AS n FROM (SELECT *, row_number() OVER (PARTITION BY subject, relation ORDER BY ts DESC, id DESC) AS n FROM ({_EPISODES})) WHERE n <= 2"
    out["episodes_between"] = f"SELECT id, state FROM ({_EPISODES}) WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-10'"
    out["carried_context"] = "WITH t AS (SELECT DISTINCT conv_id, turn, role, CASE WHEN role = 'user' THEN turn END AS said FROM conversations) SELECT *, last_value(said IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS carried FROM t"
    month = lambda step: f"lower(strftime(date_trunc('month', o_orderdate) + INTERVAL '{step} month', '%B'))"
    out["ring_neighbours"] = f"SELECT o_orderkey, {month(0)} AS month, {month(-1)} AS before, {month(1)} AS after FROM orders"
    out["ngram_successors"] = (
        "WITH t AS (SELECT regexp_extract_all(lower(text), '([a-z0-9]+)', 1) AS w FROM documents), g AS (SELECT w, unnest(range(1, len(w) - 1)) AS i FROM t WHERE len(w) > 2), n AS (SELECT w[i] || ' ' || w[i + 1] AS context, w[i + 2] AS next, count(*) AS n FROM g GROUP BY 1, 2) "
        "SELECT context, next, n, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY context ORDER BY n DESC, next) AS rank FROM n) WHERE rank <= 2"
    )
    out["user_topics"] = f"SELECT subject, topic, n, CAST(rank AS INTEGER) AS rank FROM (SELECT subject, relation AS topic, count(*) AS n, row_number() OVER (PARTITION BY subject ORDER BY count(*) DESC, relation) AS rank FROM ({_EPISODES}) GROUP BY 1, 2) WHERE rank <= 3"

    out["calibration_tally"] = f"SELECT CASE WHEN score >= 0.2 THEN 'know' WHEN score >= 0.1 THEN 'think' WHEN score >= 0.05 THEN 'guess' ELSE 'none' END AS category, count(*) FILTER (correct) AS n_right, count(*) FILTER (NOT correct) AS n_wrong FROM {_SAMPLES} GROUP BY 1"
    out["reliability"] = (
        f"WITH s AS MATERIALIZED (SELECT upto, fit FROM {_steps()}), b AS (SELECT CAST(k - 1 AS INTEGER) AS bin, count(*) AS n, avg(score) AS m, avg(CAST(correct AS DOUBLE)) AS a FROM (SELECT *, ntile(10) OVER (ORDER BY score, doc_id) AS k FROM {_SAMPLES}) GROUP BY 1) "
        "SELECT bin, n, round(m, 6) AS mean_score, round(a, 6) AS accuracy, round(coalesce((SELECT arg_min(fit, upto) FROM s WHERE upto >= m), (SELECT arg_max(fit, upto) FROM s)), 6) AS calibrated FROM b"
    )
    out["isotonic_steps"] = f"SELECT round(upto, 6) AS upto, round(fit, 6) AS probability, round(n, 6) AS n FROM {_steps()}"
    out["brier_score"] = f"SELECT count(*) AS n, round(avg(pow(CASE WHEN score >= 0.3 THEN 0.95 WHEN score >= 0.2 THEN 0.9 WHEN score >= 0.1 THEN 0.7 ELSE 3 * score END - CAST(correct AS DOUBLE), 2)), 6) AS brier FROM {_SAMPLES}"
    out["answer_accuracy"] = f"SELECT count(*) AS n, round(avg(CAST(correct AS DOUBLE)), 6) AS accuracy, round(avg(CAST(score >= 0.2 AND NOT correct AS DOUBLE)), 6) AS confident_wrong FROM {_SAMPLES}"

    out["tokenise"] = r"SELECT item_id, array_to_string(regexp_extract_all(lower(text), '[A-Za-z0-9_]+|[^\sA-Za-z0-9_]'), ' ') AS tokens, CAST(len(list_filter(string_split(regexp_replace(trim(text), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '')) AS INTEGER) AS n_sentences FROM benchmark"
    one = lambda x: f"CASE WHEN length({x}) <= 3 THEN {x} WHEN ends_with({x}, 'ies') THEN left({x}, -3) || 'y' WHEN regexp_matches({x}, '[sxz]es$') THEN left({x}, -2) WHEN ends_with({x}, 's') AND NOT ends_with({x}, 'ss') THEN left({x}, -1) ELSE {x} END"
    out["word_forms"] = f"SELECT w, {one('(w || chr(115))')} AS one, {one('(w || chr(105) || chr(101) || chr(115))')} AS other FROM (SELECT DISTINCT unnest(string_split(lower(p_name), ' ')) AS w FROM part)"
    out["number_words"] = "SELECT p_partkey, CAST(CASE p_partkey % 6 WHEN 0 THEN 1234 WHEN 1 THEN 25 WHEN 2 THEN 200 WHEN 3 THEN 3000 WHEN 4 THEN 12.5 END AS DOUBLE) AS value FROM part"
    out["arithmetic"] = "SELECT p_partkey, round(CAST(CASE p_partkey % 4 WHEN 0 THEN p_partkey + b WHEN 1 THEN p_partkey - b WHEN 2 THEN p_partkey * b ELSE CASE WHEN b = 0 THEN NULL ELSE p_partkey / b END END AS DOUBLE), 6) AS value FROM (SELECT p_partkey, p_size % 3 AS b FROM part)"
    out["integer_math"] = "SELECT p_partkey, p_partkey >= 2 AND NOT list_bool_or(list_transform(range(2, greatest(3, CAST(floor(sqrt(p_partkey)) AS BIGINT) + 1)), lambda d: d < p_partkey AND p_partkey % d = 0)) AS prime, CAST(gcd(p_partkey, 360) AS BIGINT) AS gcd, CAST(lcm(p_partkey, 360) AS BIGINT) AS lcm FROM part"
    out["negated_questions"] = f"SELECT s, seq % 2 = 0 AS negated, 'is ' || s || ' a ' || o AS plain FROM {f('P')}"
    out["relation_names"] = f"SELECT t.r, inv.b AS inverse, CASE WHEN starts_with(t.r, 'not_') THEN t.r ELSE 'not_' || t.r END AS negated, regexp_replace(t.r, '^not_', '') AS plain FROM (SELECT DISTINCT r FROM {f('N', 'C2', 'P', 'P2', 'NEG')}) t LEFT JOIN {_INV} ON t.r = inv.a"
    decay = "pow(0.95, len(x) - 1)"
    prod = f"greatest(0.01, list_reduce(list_transform(x, lambda v: CAST(v AS DOUBLE)), lambda a, v: a * v) * {decay})"
    out["chain_confidence"] = (
        "WITH t AS (SELECT l_orderkey, list(l_discount * 10 + 0.001 ORDER BY l_discount) AS x FROM lineitem GROUP BY l_orderkey) "
        f"SELECT l_orderkey, round({prod}, 6) AS product, round(greatest(0.01, list_min(x) * {decay}), 6) AS min, round(greatest(0.01, exp(list_sum(list_transform(x, lambda v: ln(greatest(v, 1e-9)))) / len(x)) * {decay}), 6) AS geometric_mean, {_HEDGE.format(c=prod)} AS hedge, 0 AS weakest FROM t"
    )
    out["vector_bundles"] = "SELECT label, CAST(i - 1 AS INTEGER) AS pos, round(sum(CAST(embedding[i] AS DOUBLE)), 4) AS total FROM (SELECT label, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) GROUP BY 1, 2"
    turn = lambda n: f"list_concat(embedding[-{n}:], embedding[:-{n + 1}])"
    out["vector_algebra"] = f"SELECT vec_id, CAST(list_sum(list_transform(list_zip(embedding, {turn(3)}), lambda p: CASE WHEN (p[1] >= 0) = (p[2] >= 0) THEN 1 ELSE -1 END)) AS INTEGER) AS agreement, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST({turn(1)} AS DOUBLE[])), 6) AS turned FROM embeddings"
    out["direction_lookup"] = "SELECT lower(x.n_name) AS a, lower(y.n_name) AS b, CASE WHEN x.n_nationkey % 2 = 0 THEN 'south_of' ELSE 'north_of' END AS direction FROM nation x JOIN nation y ON y.n_nationkey = (x.n_nationkey + 1) % 25"
    out["best_of_chains"] = f"SELECT s AS start, o AS answer, 'locatedin' AS pattern, CAST(1.0 AS DOUBLE) AS confidence FROM {f('S')} UNION ALL SELECT x.s, y.o, 'partof,locatedin', 0.95 FROM {f('O')} x JOIN {f('C')} y ON x.o = y.s"
    out["goal_reached"] = f"SELECT s AS node FROM {f('C2')} WHERE o = 'building'"
    step = lambda k: f"CAST(floor(o_orderkey / {3**k}) AS BIGINT) % 3"
    u, v = (lambda c: f"(CASE WHEN {c} = 1 THEN 0 ELSE 1 END)"), (lambda c: f"(CASE WHEN {c} = 0 THEN 0 ELSE 1 END)")
    out["kinship_paths"] = (
        f"WITH a AS (SELECT o_orderkey AS path, {step(0)} AS c0, {step(1)} AS c1, {step(2)} AS c2 FROM orders), b AS (SELECT *, {u('c0')} AS up, {v('c0')} AS down FROM a), "
        f"c AS (SELECT path, c2, up + {u('c1')} - least(down, {u('c1')}) AS up, down - least(down, {u('c1')}) + {v('c1')} AS down FROM b) SELECT path, CAST(up + {u('c2')} - least(down, {u('c2')}) AS INTEGER) AS up, CAST(down - least(down, {u('c2')}) + {v('c2')} AS INTEGER) AS down FROM c"
    )
    out["skill_statistics"] = f"SELECT r1 || ',' || r2 AS pattern, success + failure AS uses, round(success / (success + failure), 6) AS rate, success / (success + failure) >= 0.8 AS sure FROM {_skills()} WHERE success + failure >= 3"
    out["relation_priority"] = f"SELECT relation, CAST(sum(success) AS BIGINT) AS weight FROM (SELECT r1 AS relation, success FROM {_skills()} UNION ALL SELECT r2, success FROM {_skills()}) GROUP BY relation"
    out["rule_feedback"] = f"SELECT r1 || ',' || r2 AS pattern, round((success + 1) / (success + failure + 2), 6) AS running FROM {_skills()}"
    out["state_histories"] = f"SELECT subject, relation, strftime(ts, '%Y-%m-%d') AS day, string_agg(state, ',' ORDER BY ts, id) AS states FROM ({_EPISODES}) GROUP BY 1, 2, 3"
    out["promoted_memories"] = "SELECT user_id || ':' || event_type AS content, count(*) AS n FROM events WHERE event_id % 6 = 0 GROUP BY 1 HAVING count(*) >= 3"
    out["status_report"] = f"SELECT count(*) AS n, count(*) FILTER (state = 'known') AS known, count(*) FILTER (state = 'ambiguous') AS ambiguous, count(*) FILTER (state = 'idk') AS idk, count(DISTINCT (subject, relation)) AS signatures FROM ({_EPISODES})"
    out["base_state"] = f"SELECT count(*) AS n, CAST(sum(CAST('0x' || substr(sha256(s || chr(0) || r || chr(0) || o), 1, 12) AS BIGINT)) AS VARCHAR) AS hash FROM {geo}"
    hard = "CASE task WHEN 'declare' THEN 0.1 WHEN 'fill' THEN 0.4 WHEN 'ask' THEN 0.6 ELSE 0.9 END"
    out["curriculum_tiers"] = f"SELECT task, CAST(least(3, greatest(0, floor(4 * (0.5 * (length(draft) + length(target)) / 512 + 0.5 * {hard})))) AS INTEGER) AS tier, count(*) AS n FROM ({out['training_corpus']}) GROUP BY 1, 2"
    vocab = "(SELECT word, n, CAST(row_number() OVER (ORDER BY n DESC, word) + 3 AS INTEGER) AS id FROM (SELECT unnest(regexp_extract_all(lower(text), '([a-z0-9]+)', 1)) AS word, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, word LIMIT 50000))"
    out["word_vocabulary"] = f"SELECT * FROM {vocab}"
    out["word_encoding"] = f"WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '([a-z0-9]+)', 1)) AS word, generate_subscripts(regexp_extract_all(lower(text), '([a-z0-9]+)', 1), 1) AS i FROM documents) SELECT doc_id, string_agg(CAST(coalesce(id, 3) AS VARCHAR), ' ' ORDER BY i) AS ids FROM w LEFT JOIN {vocab} v USING (word) GROUP BY doc_id"
    some = vocab.replace("GROUP BY 1 ORDER BY", "GROUP BY 1 HAVING count(*) >= 3 ORDER BY")
    out["word_decoding"] = f"WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '([a-z0-9]+)', 1)) AS word, generate_subscripts(regexp_extract_all(lower(text), '([a-z0-9]+)', 1), 1) AS i FROM documents) SELECT doc_id, string_agg(CASE WHEN id IS NULL THEN '<unk>' ELSE word END, ' ' ORDER BY i) AS text FROM w LEFT JOIN {some} v USING (word) GROUP BY doc_id"
    out["source_summaries"] = (
        f"SELECT left(source, 4) AS name, string_agg(s || ' ' || r || ' ' || o || '.', ' ' ORDER BY k) AS summary, count(*) AS n FROM (SELECT p.*, row_number() OVER (PARTITION BY source ORDER BY seq) AS k FROM {f('C', 'P')} JOIN {prov('C', 'P')} p USING (s, r, o)) WHERE k <= 12 GROUP BY source"
    )
    out["rule_effectiveness"] = f"SELECT pattern, uses, running FROM (SELECT r1 || ',' || r2 || coalesce(',' || r3, '') AS pattern, success + failure AS uses, round((success + 1) / (success + failure + 2), 6) AS running FROM {_long_skills()}) ORDER BY uses DESC, running DESC, pattern LIMIT 20"
    out["negated_verdicts"] = (
        f"WITH p AS (SELECT s, o, seq % 3 = 0 AS n FROM {f('P3')}) SELECT s || CASE WHEN n THEN ' isnt' ELSE ' is' END || ' tiny' AS q, s || CASE WHEN n THEN ' tiny' ELSE ' is tiny' END AS question, n AS negated, (o = 'tiny') <> n AS verdict FROM p"
    )
    out["stream_calibration"] = "SELECT event_type AS relation, CASE WHEN value / 500 >= 0.2 THEN 'know' WHEN value / 500 >= 0.1 THEN 'think' WHEN value / 500 >= 0.05 THEN 'guess' ELSE 'none' END AS category, count(*) FILTER (event_id % 3 = 0) AS n_right, count(*) FILTER (event_id % 3 <> 0) AS n_wrong FROM events GROUP BY 1, 2"
    out["decayed_provenance"] = f"SELECT s, r, o, round(confidence * pow(0.9, 3), 6) AS confidence FROM {prov('C')}"
    out["maintenance"] = (
        f"SELECT 'induced' AS step, count(*) AS n FROM {_cascade(f('O', 'C', 'N', 'C50', 'P', 'P2', 'NEG'), 3)} UNION ALL SELECT 'denied', count(*) FROM ({out['negation_propagation']}) UNION ALL SELECT 'resolved', count(*) FROM ({out['conflict_resolution']}) WHERE NOT keep"
    )
    base = f("O", "C", "N", "C50", "P", "P2", "NEG")
    out["maintained_base"] = (
        f"WITH lost AS (SELECT s, r, o FROM ({out['conflict_resolution']}) WHERE NOT keep) SELECT s, r, o, 'told' AS how FROM (SELECT s, r, o FROM {base} EXCEPT SELECT s, r, o FROM lost) "
        f"UNION ALL SELECT s, r, o, 'induced' FROM {_cascade(base, 3)} UNION ALL SELECT s, r, o, 'denied' FROM ({out['negation_propagation']})"
    )
    more = f("O", "C", "N", "C50", "P", "P2", "NEG", "C2")
    settled = out["episode_consolidation"].replace(">= 0.5 THEN 'stable'", ">= 0.9 THEN 'stable'")
    step = lambda t: f"SELECT a.s, h AS r, b.o FROM {t} a JOIN {t} b ON a.o = b.s JOIN (VALUES ('partof', 'locatedin', 'locatedin'), ('locatedin', 'locatedin', 'locatedin'), ('partof', 'category', 'category')) v(x, y, h) ON a.r = x AND b.r = y WHERE a.s <> a.o AND a.o <> b.o AND a.s <> b.o"
    out["maintenance_pass"] = (
        f"WITH told AS (SELECT DISTINCT s, r, o FROM {more}), i AS (SELECT * FROM {_cascade(more, 1)}), k AS (SELECT * FROM told UNION SELECT * FROM i), ru AS (SELECT s, r, o FROM ({step('k')}) EXCEPT SELECT s, r, o FROM k), kk AS (SELECT * FROM k UNION SELECT * FROM ru), "
        "ng AS (SELECT DISTINCT m.s, n.r, n.o FROM kk m JOIN kk n ON m.o = n.s AND starts_with(n.r, 'not_') WHERE m.r IN " + names(traits.LIFTING) + " AND NOT EXISTS (SELECT 1 FROM kk x WHERE x.s = m.s AND x.o = n.o AND (x.r = n.r OR 'not_' || x.r = n.r))), "
        f"lo AS (SELECT s, r, o FROM ({out['conflict_resolution']}) WHERE NOT keep), ep AS ({settled}), ho AS ({out['hot_signatures']}), pr AS (SELECT body, head FROM {promoted} EXCEPT SELECT pattern, head FROM (SELECT r1 || ',' || r2 || coalesce(',' || r3, '') AS pattern, CASE WHEN r1 = r2 AND coalesce(r3, r1) = r1 AND r1 IN {names(traits.TRANSITIVE)} THEN r1 WHEN r1 IN {names(traits.LIFTING)} THEN coalesce(r3, r2) ELSE 'implies' END AS head FROM {_long_skills()} WHERE success >= 2 AND success / (success + failure) >= 0.5 AND r3 IS NULL)), "
        "fi AS (SELECT * FROM (SELECT * FROM told EXCEPT SELECT * FROM lo) UNION SELECT * FROM i UNION SELECT * FROM ru UNION SELECT * FROM ng) "
        "SELECT 'chain_induction' AS step, count(*) AS n FROM i UNION ALL SELECT 'rule_cascade', count(*) FROM ru UNION ALL SELECT 'negations', count(*) FROM ng UNION ALL SELECT 'conflicts', count(*) FROM lo UNION ALL SELECT 'skills_promoted', count(*) FROM pr "
        "UNION ALL SELECT 'episodes_consolidated', count(*) FROM ep WHERE verdict = 'stable' UNION ALL SELECT 'episodes_ambiguous', count(*) FROM ep WHERE often_ambiguous UNION ALL SELECT 'answers_ready', count(*) FROM ho JOIN ep USING (subject, relation) WHERE verdict = 'stable' UNION ALL SELECT 'final_size', count(*) FROM fi"
    )
    told = f"{f('C', 'C50', 'P', 'P2', 'P3')}"
    up = f"(SELECT parent AS s, r, o FROM (SELECT k.o AS parent, y.r, y.o FROM {f('P')} k JOIN {f('P2', 'P3')} y USING (s) GROUP BY 1, 2, 3 HAVING count(*) >= 5))"
    gone = f"(SELECT DISTINCT s, r, o FROM {prov('C', 'P')} WHERE confidence * 0.9 < 0.2)"
    out["consolidated_base"] = f"SELECT s, r, o FROM {told} UNION SELECT * FROM {up} EXCEPT SELECT * FROM {gone}"
    out["consolidation_report"] = (
        f"SELECT 'promotions' AS step, count(*) AS n FROM (SELECT subject, relation FROM ({_EPISODES}) GROUP BY 1, 2 HAVING count(*) >= 3) UNION ALL SELECT 'contradictions', count(*) FROM (SELECT s FROM {f('C', 'C50')} GROUP BY s HAVING count(DISTINCT o) >= 2) "
        f"UNION ALL SELECT 'duplicates', count(*) FROM {f('C')} WHERE seq % 3 = 0 UNION ALL SELECT 'abstractions', count(*) FROM {up} UNION ALL SELECT 'forgotten', count(*) FROM {gone}"
    )
    out["decision_replay"] = "SELECT s AS probe, v AS verdict, a AS against FROM " + f("C", "S") + ", (VALUES ('verified', 'same'), ('state mismatch', 'other')) t(v, a)"
    pick = lambda rows: f"SELECT * FROM (SELECT DISTINCT * FROM ({rows}) ORDER BY question, answer NULLS FIRST LIMIT 5)"
    kinds = f"(SELECT s, r, o FROM {f('C', 'N', 'P', 'P3')} UNION ALL SELECT s, 'kind', string_split(o, ' ')[-1] FROM {f('P')} UNION ALL SELECT regexp_split_to_array(lower(n_name), '[ _]')[1], 'has', 'name' FROM nation)"
    stem = "regexp_extract(a.s, '^([A-Za-z0-9_]+)[ _]', 1)"
    out["hard_questions"] = " UNION ALL ".join(
        (
            pick(f"SELECT 'negation' AS category, 'what is not a ' || o || '?' AS question, 'answer' AS expected, NULL AS answer FROM {kinds} WHERE r IN ('isa', 'kind')"),
            pick(f"SELECT 'compound' AS category, 'what is the ' || y.r || ' of the ' || x.r || ' of ' || x.s || '?' AS question, 'answer' AS expected, y.o AS answer FROM {kinds} x JOIN {kinds} y ON x.o = y.s"),
            pick(f"SELECT 'polysemy' AS category, 'what is ' || s || '?' AS question, 'ask' AS expected, NULL AS answer FROM {kinds} WHERE r IN ('isa', 'kind') GROUP BY s HAVING count(DISTINCT o) > 1"),
            pick(f"SELECT 'confusion' AS category, 'tell of ' || a.s || ', not of ' || b.s || '.' AS question, 'answer' AS expected, NULL AS answer FROM {kinds} a JOIN {kinds} b ON b.s = {stem} AND {stem} <> ''"),
            pick(
                f"WITH z AS (SELECT r, min(o) AS lo, max(o) AS hi FROM {kinds} WHERE r IN ('isa', 'kind', 'size') GROUP BY r) "
                f"SELECT 'contradiction' AS category, 'is the ' || r || ' of ' || s || ' ' || CASE WHEN o = lo THEN hi ELSE lo END || '?' AS question, 'refuse' AS expected, NULL AS answer FROM {kinds} JOIN z USING (r) WHERE lo <> hi"
            ),
        )
    )
    out["stream_tally"] = f"SELECT date_trunc('day', ts) AS begin, state, count(*) AS n FROM ({_EPISODES}) GROUP BY 1, 2"
    out["vector_clean_up"] = (
        "WITH p AS (SELECT vec_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), b AS (SELECT label, i, sum(CAST(x AS DOUBLE)) AS x FROM p GROUP BY 1, 2), w AS (SELECT label, list(x ORDER BY i) AS w FROM b GROUP BY label), "
        "z AS (SELECT vec_id, w.label AS symbol, list_cosine_similarity(CAST(embedding AS DOUBLE[]), w) AS score FROM embeddings, w) "
        "SELECT vec_id AS query, symbol, round(score, 5) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(score, 9) DESC, symbol) AS rank FROM z) WHERE rank <= 3"
    )
    return out
