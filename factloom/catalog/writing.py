"""Queries that edit texts, tell how answers were found, and measure answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import beliefs, calibrate, pattern, writing
from ..oracle import f
from ..plans import star
from . import intake
from .briefs import _sentence


def edited_texts(spark, d):
    """Each document's text at half its sentences, and smoothed."""
    return star.table(spark, d, "documents").select("doc_id", writing.shortened(F.col("text")).alias("short"), writing.polished(F.col("text")).alias("smooth"))


def summarised_letters(spark, d):
    return intake._letters(spark, d).select("file", writing.summarised(F.col("text")).alias("summary"))


def expanded_letters(spark, d):
    """Letters with what else is known of the parts that they name."""
    name = lambda c: text.symbol(F.col(c))
    known = star.facts(spark, d, "P", "P2", "P3").select("seq", name("s").alias("s"), "r", name("o").alias("o"))
    return writing.expanded(intake._letters(spark, d).select(F.col("file").alias("id"), "text"), known)


def narrated_answers(spark, d):
    """Where orders are, told step by step, and what isn't known of them."""
    o = star.facts(spark, d, "O").select("s", F.when(F.pmod("seq", F.lit(3)) == 0, "partof").when(F.pmod("seq", F.lit(3)) == 1, "locatedin").otherwise("color").alias("r"))
    probes = o.select(F.col("s").alias("probe"), F.concat(F.lit("what is the "), "r", F.lit(" of "), "s", F.lit("?")).alias("question"), "s", "r")
    return writing.narrated(star.facts(spark, d, "O", "C", "N"), probes)


def conflicts_told(spark, d):
    return writing.conflicts_told(beliefs.resolve(star.facts(spark, d, "C", "C50"), star.provenance(spark, d, "C", "C50")))


def answer_hits(spark, d):
    """How often the first, and one of the first three answers is the customer's own nation."""
    names = ("C", "C50")
    probes = star.facts(spark, d, "C").select(F.col("s").alias("probe"), "s", "r").union(star.facts(spark, d, "S").select("s", "s", "r"))
    answers = pattern.calibrated(star.facts(spark, d, *names), star.provenance(spark, d, *names), probes)
    return calibrate.hits(answers, star.facts(spark, d, "C", "S").select(F.col("s").alias("probe"), F.col("o").alias("value")))


def score_percentiles(spark, d):
    return calibrate.percentiles(star.table(spark, d, "events"), "value", "event_id").select("share", F.round("value", 6).alias("value"))


def factorials(spark, d):
    k = (F.col("p_partkey") % 23).cast("int")
    return star.table(spark, d, "part").select("p_partkey", text.factorial(k).alias("factorial"))


QUERIES = {x.__name__: x for x in (edited_texts, summarised_letters, expanded_letters, narrated_answers, conflicts_told, answer_hits, score_percentiles, factorials)}


def sql() -> dict[str, str]:
    from ..oracle import oracle_sql

    core = oracle_sql()
    cut = lambda t: rf"list_filter(string_split(regexp_replace(trim({t}, ' '), '([.!?])[ \t\n\x0B\f\r]+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '')"
    words = "[" + ", ".join(f"'{x}'" for x in writing.CONNECTIVES) + "]"
    out = {
        "edited_texts": (
            rf"WITH a AS (SELECT doc_id, {cut('text')} AS s, list_transform({cut(chr(39).join(['regexp_replace(replace(text, ', '_', ', ', ' ', '), ', chr(92) + 'ba[ ' + chr(92) + 't' + chr(92) + 'n' + chr(92) + 'x0B' + chr(92) + 'f' + chr(92) + 'r]+([aeiouAEIOU])', ', ', 'an ' + chr(92) + '1', ', ', 'g', ')']))}, lambda x: trim(x, ' ')) AS p FROM documents), "
            "b AS (SELECT *, list_transform(p, lambda x: lower(x)) AS low FROM a), c AS (SELECT *, list_filter(p, lambda x, i: list_position(low, lower(x)) = i AND x <> '') AS o FROM b), "
            "d AS (SELECT doc_id, s, list_transform(o, lambda x: CASE WHEN regexp_matches(x, '^[a-z]') THEN upper(x[1]) || x[2:] ELSE x END) AS o FROM c) "
            f"SELECT doc_id, array_to_string(s[1 : greatest(1, CAST(floor(len(s) * 0.5) AS INTEGER))], ' ') AS short, array_to_string(list_transform(o, lambda x, i: CASE WHEN i = 1 THEN x ELSE {words}[least(i - 1, {len(writing.CONNECTIVES)})] || ' ' || lower(x[1]) || x[2:] END), ' ') AS smooth FROM d"
        )
    }
    name = "regexp_replace(lower({}), '[^A-Za-z0-9]+', '_', 'g')"
    pl = lambda c: f"replace({c}, '_', ' ')"
    letters = f"SELECT 'letter' || lpad(CAST(p_partkey AS VARCHAR), 12, '0') AS file, 'part_' || p_partkey AS s, {name.format('p_type')} AS type, {name.format('p_brand')} AS brand, 'nation_' || (p_partkey % 25) AS nation, 'region_' || (p_partkey % 5) AS region, p_partkey % 9 <> 0 AS said, CASE WHEN p_size <= 10 THEN 'tiny' WHEN p_size <= 20 THEN 'small' WHEN p_size <= 30 THEN 'medium' WHEN p_size <= 40 THEN 'large' ELSE 'huge' END AS size FROM part"
    out["summarised_letters"] = f"SELECT file, CASE WHEN said THEN 'Summary:' || chr(10) || '- ' || {pl('s')} || ' isa ' || {pl('type')} || chr(10) || '- ' || {pl('s')} || ' madeof ' || {pl('brand')} || chr(10) || '- ' || {pl('nation')} || ' locatedin ' || {pl('region')} ELSE '' END AS summary FROM ({letters})"
    note = lambda r, v: f"' Note also: the {r} of ' || {pl('s')} || ' is ' || {pl(v)} || '.'"
    out["expanded_letters"] = (
        f"SELECT file AS id, CASE WHEN said THEN 'The ' || s || ' is a ' || type || '.' || CASE WHEN size <> type THEN {note('size', 'size')} ELSE '' END || ' It was seen! The ' || s || ' is made of ' || brand || '.' || CASE WHEN size <> brand THEN {note('size', 'size')} ELSE '' END || CASE WHEN type <> brand THEN {note('isa', 'type')} ELSE '' END || ' ' || nation || ' is in ' || region ELSE '' END AS text FROM ({letters})"
    )
    out["narrated_answers"] = (
        f"WITH q AS (SELECT x.s, CASE x.seq % 3 WHEN 0 THEN 'partof' WHEN 1 THEN 'locatedin' ELSE 'color' END AS r, x.o AS c, y.o AS n FROM {f('O')} x JOIN {f('C')} y ON y.s = x.o), z AS (SELECT *, 'Let me think about \"what is the ' || r || ' of ' || s || '?\"... ' AS b FROM q) "
        f"SELECT s AS probe, CASE r WHEN 'partof' THEN c WHEN 'locatedin' THEN n END AS answer, b || CASE r WHEN 'partof' THEN 'I know that ' || {_sentence('s', 'r', 'c')} || ' So the answer is ' || c || '.' "
        f"WHEN 'locatedin' THEN 'I know that A ' || {pl('s')} || ' is a ' || {pl('c')} || '. And I know that ' || {_sentence('c', 'r', 'n')} || ' So I can infer that ' || {_sentence('s', 'r', 'n')} ELSE 'I tried looking under: color. None of those gave me a confident answer, so I don''t know.' END AS told FROM z"
    )
    out["conflicts_told"] = f"SELECT s, r, 'For (' || s || ', ' || r || ', ?) keep ' || max(o) FILTER (keep) || '. Drop ' || array_to_string(list(o ORDER BY o) FILTER (NOT keep)[1:3], ', ') || '.' AS told FROM ({core['conflict_resolution']}) GROUP BY s, r"
    out["conflicts_told"] = f"SELECT s, r, 'For (' || s || ', ' || r || ', ?) keep ' || k || '. Drop ' || array_to_string(x[1:3], ', ') || '.' AS told FROM (SELECT s, r, max(o) FILTER (keep) AS k, list(o ORDER BY o) FILTER (NOT keep) AS x FROM ({core['conflict_resolution']}) GROUP BY s, r)"
    out["answer_hits"] = (
        f"WITH a AS ({core['calibrated_ask']}), e AS (SELECT s AS probe, o AS value FROM {f('C', 'S')}), r AS (SELECT probe, min(rank) AS at1 FROM a JOIN e USING (probe, value) GROUP BY probe), x AS (SELECT e.probe, at1, t.score FROM (SELECT DISTINCT probe FROM e) e LEFT JOIN r USING (probe) LEFT JOIN (SELECT probe, score FROM a WHERE rank = 1) t USING (probe)) "
        "SELECT count(*) AS n, count(*) FILTER (at1 = 1) AS top1, count(*) FILTER (at1 <= 3) AS top3, count(*) FILTER (score IS NULL) AS none, count(*) FILTER (coalesce(at1, 9) <> 1 AND score >= 0.2) AS wrong_sure FROM x"
    )
    out["score_percentiles"] = "WITH v AS (SELECT value, row_number() OVER (ORDER BY value, event_id) - 1 AS k, count(*) OVER () AS n FROM events WHERE value IS NOT NULL) SELECT share, round(value, 6) AS value FROM v JOIN (SELECT unnest([0.5, 0.95, 0.99, 1.0])::DOUBLE AS share) s ON k = least(n - 1, CAST(floor(share * n) AS BIGINT))"
    out["factorials"] = "SELECT p_partkey, CASE WHEN p_partkey % 23 <= 20 THEN CAST(factorial(CAST(p_partkey % 23 AS INTEGER)) AS BIGINT) END AS factorial FROM part"
    return out
