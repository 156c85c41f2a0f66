"""Queries on questions in words: conversations with references, and a table of questions of all kinds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import questions, text
from ..operators import dialogue, router
from ..oracle import f
from ..plans import star
from ..sources import scratch
from ..streaming import twins

#: What users say in turn; the last is what they say in the table.
SAID = ("what size is the {}?", "What is the isa of it?", "what about the {}?", "And the {}?", "it", "what about them?", "so {text}")
#: Parts are named by so many keys.
PARTS = 200


def _named(spark, d, *names):
    f_ = star.facts(spark, d, *names)
    return f_.select("seq", text.symbol(F.col("s")).alias("s"), "r", text.symbol(F.col("o")).alias("o"))


def _turns(spark, d):
    """(conv, turn, text): the users' turns as questions about parts."""
    c = star.table(spark, d, "conversations").where("role = 'user'")
    part = F.concat(F.lit("part_"), (F.pmod(F.col("conv_id") * 7 + F.col("turn") * 3, F.lit(PARTS)) + 1).cast("string"))
    shapes = F.array(*[F.concat(F.lit(x.split("{")[0]), F.col("text") if "{text}" in x else part if "{}" in x else F.lit(""), F.lit(x.rsplit("}", 1)[-1] if "{" in x else "")) for x in SAID])
    k = F.pmod(F.col("conv_id") + F.floor(F.col("turn") / 2), F.lit(len(SAID))).cast("int")
    return c.select(F.col("conv_id").alias("conv"), "turn", F.get(shapes, k).alias("text"))


def dialogue_answers(spark, d):
    """Users' turns with references resolved, answered from facts on parts."""
    turns = scratch.keep(dialogue.resolved(_turns(spark, d)), "turns")
    return dialogue.answered(_named(spark, d, "P", "P3"), turns)


def stream_dialogue(spark, d):
    """The same turns through a stream with a state for each conversation, which a second run goes on with."""
    base = scratch.place(spark, "stream")
    turns = _turns(spark, d).withColumn("ts", F.timestamp_seconds(1_700_000_000 + 60 * F.col("turn")))
    for part in (turns.where("turn < 3"), turns.where("turn >= 3")):
        part.write.mode("append").parquet(f"{base}/in")
        rows = spark.readStream.schema(turns.schema).parquet(f"{base}/in")
        twins.run_once(dialogue.written(twins.referred(dialogue.read(rows))), lambda df, k: df.write.mode("append").parquet(f"{base}/out"), f"{base}/checkpoint")
    return spark.read.schema("conv long, turn long, question string, entity string, relation string").parquet(f"{base}/out")


def routed_questions(spark, d):
    """Nine kinds of questions about parts, orders and customers, and what is known."""
    p = star.table(spark, d, "part")
    k = F.col("p_partkey")
    part = lambda n: F.concat(F.lit("part_"), n.cast("string"))
    order = F.concat(F.lit("order_"), k.cast("string"))
    segment = F.element_at(F.array(*map(F.lit, SEGMENTS)), (k % len(SEGMENTS) + 1).cast("int"))
    say = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y for y in x])
    asked = (
        say("what is ", k.cast("string"), " * 3?"), say("Is ", part(k), " a ", text.symbol(F.lower("p_type")), "?"), say("is ", part(k), " bigger than ", part(k + 1), "?"), say("list all ", segment, "s"), say("What is the locatedin of the partof of ", order, "?"),
        say("what size is the ", part(k), "?"), say("what kind is the ", part(k), "?"), say("what is the locatedin of ", order, "?"), say("who shipped ", part(k), "?"),
    )
    rows = p.select(k.alias("id"), F.get(F.array(*asked), (k % len(asked)).cast("int")).alias("text"))
    return router.routed(_named(spark, d, "P", "P3", "O", "C", "C2"), rows)


SEGMENTS = ("automobile", "building", "furniture", "household", "machinery")
QUERIES = {x.__name__: x for x in (dialogue_answers, stream_dialogue, routed_questions)}


def _resolved() -> str:
    """Templates told apart by their number; what is open is the last that a turn before has named."""
    pron = "[" + ", ".join(f"'{x}'" for x in questions.PRONOUNS) + "]"
    w = "OVER (PARTITION BY conv ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    first = f"list_min(list_filter(range(1, len(t) + 1), lambda i: list_contains({pron}, t[i])))"
    return (
        f"t AS (SELECT conv_id AS conv, turn, (conv_id + turn // 2) % {len(SAID)} AS k, 'part_' || ((conv_id * 7 + turn * 3) % {PARTS} + 1) AS part, 'so ' || text AS prose, regexp_extract_all(lower('so ' || text), '[A-Za-z0-9_]+|[^\\sA-Za-z0-9_]') AS t FROM conversations WHERE role = 'user'), "
        "own AS (SELECT *, CASE WHEN k IN (0, 2, 3) THEN part END AS e, CASE k WHEN 0 THEN 'size' WHEN 1 THEN 'isa' END AS r FROM t), "
        f"l AS (SELECT *, last_value(e IGNORE NULLS) {w} AS le, last_value(r IGNORE NULLS) {w} AS lr, {first} AS at1 FROM own), "
        "q AS (SELECT conv, turn, CASE k WHEN 0 THEN 'what size is the ' || part || '?' WHEN 1 THEN CASE WHEN le IS NULL THEN 'What is the isa of it?' ELSE 'what is the isa of ' || le || ' ?' END "
        "WHEN 2 THEN CASE WHEN lr IS NULL THEN 'what about the ' || part || '?' ELSE 'what ' || lr || ' is the ' || part || '?' END WHEN 3 THEN CASE WHEN lr IS NULL THEN 'And the ' || part || '?' ELSE 'what ' || lr || ' is the ' || part || '?' END "
        "WHEN 4 THEN CASE WHEN lr IS NOT NULL THEN 'what ' || lr || ' is the ' || coalesce(le, 'it') || '?' WHEN le IS NOT NULL THEN le ELSE 'it' END "
        "WHEN 5 THEN CASE WHEN lr IS NOT NULL THEN 'what ' || lr || ' is the ' || coalesce(le, 'them') || '?' WHEN le IS NOT NULL THEN 'what about ' || le || ' ?' ELSE 'what about them?' END "
        "ELSE CASE WHEN at1 IS NULL OR le IS NULL THEN prose ELSE array_to_string(t[1 : at1 - 1] || [le] || t[at1 + 1 :], ' ') END END AS question, "
        "CASE WHEN k <> 6 THEN coalesce(e, le) END AS entity, CASE WHEN k <> 6 THEN coalesce(r, lr) END AS relation FROM l)"
    )


def sql() -> dict[str, str]:
    name = "regexp_replace({}, '[^A-Za-z0-9]+', '_', 'g')"
    facts = f"g AS (SELECT {name.format('s')} AS s, r, {name.format('o')} AS o FROM {f('P', 'P3')})"
    out = {"stream_dialogue": f"WITH {_resolved()} SELECT conv, turn, question, entity, relation FROM q"}
    out["dialogue_answers"] = f"WITH {_resolved()}, {facts}, a AS (SELECT q.*, o AS answer FROM q LEFT JOIN g ON g.s = entity AND g.r = relation) SELECT *, last_value(answer IGNORE NULLS) OVER (PARTITION BY conv ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM a"
    size = lambda n: f"(SELECT list_position(['tiny', 'small', 'medium', 'large', 'huge'], o) AS n FROM {f('P3')} WHERE s = 'part#' || {n})"
    part = lambda c: f"(SELECT {c} FROM x WHERE x.k = p_partkey)"
    out["routed_questions"] = (
        f"WITH o AS (SELECT CAST(substr(x.s, 7) AS BIGINT) AS k, x.o AS c, y.o AS n FROM {f('O')} x JOIN {f('C')} y ON y.s = x.o), seg AS (SELECT o AS seg, array_to_string(list({name.format('s')} ORDER BY seq)[1:12], ', ') AS names FROM {f('C2')} GROUP BY o), "
        f"p AS (SELECT p_partkey AS id, p_partkey % 9 AS k, {name.format('lower(p_type)')} AS type, {size('p_partkey')} AS a, {size('p_partkey + 1')} AS b, ['automobile', 'building', 'furniture', 'household', 'machinery'][p_partkey % 5 + 1] AS seg FROM part) "
        "SELECT id, CASE k WHEN 0 THEN 'arithmetic' WHEN 1 THEN 'boolean' WHEN 2 THEN 'compare' WHEN 3 THEN 'enumerate' WHEN 4 THEN 'two-step' ELSE 'factual' END AS kind, answer, CASE WHEN answer IS NULL THEN 0.0 WHEN how = 'inherited' THEN 0.7 ELSE 1.0 END AS score, CASE WHEN answer IS NOT NULL THEN how END AS how FROM ("
        f"SELECT id, k, CASE k WHEN 0 THEN CAST(id * 3 AS VARCHAR) WHEN 1 THEN 'true' WHEN 2 THEN CASE WHEN a IS NULL OR b IS NULL THEN NULL WHEN a > b THEN 'part_' || id WHEN b > a THEN 'part_' || (id + 1) ELSE 'tie' END WHEN 3 THEN names WHEN 4 THEN {name.format('n')} "
        "WHEN 5 THEN ['tiny', 'small', 'medium', 'large', 'huge'][a] WHEN 6 THEN type WHEN 7 THEN " + name.format("n") + " END AS answer, CASE k WHEN 1 THEN 'isa-transitive' WHEN 2 THEN 'size' WHEN 3 THEN 'category' WHEN 4 THEN 'two-step' WHEN 6 THEN 'via isa' WHEN 7 THEN 'inherited' ELSE 'direct' END AS how FROM p LEFT JOIN o ON o.k = id LEFT JOIN seg USING (seg))"
    )
    out["routed_questions"] = out["routed_questions"].replace("FROM p LEFT JOIN o ON o.k = id", "FROM p LEFT JOIN (SELECT k AS ok, n FROM o) o ON ok = id")
    return out
