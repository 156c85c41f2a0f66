"""Queries that take texts in, ask for what peers have, and tell the state of a session."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import intake, vectors
from ..oracle import _EPISODES, f, prov
from ..plans import star
from . import corpus

KNOWN = ("N", "S")


def _letters(spark, d):
    """(file, ts, text): a letter for each part, on its kind, its maker and a nation."""
    p = star.table(spark, d, "part")
    k = F.col("p_partkey")
    name = F.concat(F.lit("part_"), k.cast("string"))
    nation = F.concat(F.lit("nation_"), F.pmod(k, F.lit(25)).cast("string"))
    said = F.concat(F.lit("The "), name, F.lit(" is a "), text.symbol(F.lower("p_type")), F.lit(". It was seen! "), F.lit("The "), name, F.lit(" is made of "), text.symbol(F.lower("p_brand")), F.lit(". "), nation, F.lit(" is in region_"), F.pmod(k, F.lit(5)).cast("string"))
    return p.select(F.concat(F.lit("letter"), F.lpad(k.cast("string"), 12, "0")).alias("file"), k.cast("double").alias("ts"), F.when(k % 9 != 0, said).alias("text"))


def _base(spark, d):
    return star.facts(spark, d, "N").select("seq", "s", F.lit("locatedin").alias("r"), F.concat(F.lit("region_"), F.pmod("seq", F.lit(5)).cast("string")).alias("o"))


def ingested_files(spark, d):
    """Tokens, sentences, facts and new facts of each letter."""
    return intake.ingested(_letters(spark, d), _base(spark, d), star.provenance(spark, d, "N"))["files"]


def ingested_facts(spark, d):
    """The facts that the letters add to the base, by how often their records were told."""
    out = intake.ingested(_letters(spark, d), _base(spark, d), star.provenance(spark, d, "N").limit(0))
    return out["facts"].select("s", "r", "o").join(out["records"].select("s", "r", "o", "count", F.round("confidence", 6).alias("confidence")), ["s", "r", "o"])


def peer_gaps(spark, d):
    """What most peers of a part have and it lacks; a third of the sizes and a fifth of the brands are left out, so that there are gaps."""
    f_ = star.facts(spark, d, "P").union(star.facts(spark, d, "P2").where("seq % 5 != 0")).union(star.facts(spark, d, "P3").where("seq % 3 != 0"))
    return intake.peer_gaps(f_)


def session_status(spark, d):
    own = corpus._session(spark, d, "C", "C50", "P2", "D40")
    return intake.status(*[own[x] for x in ("facts", "records", "skills", "episodes")])


def vector_unbinding(spark, d):
    """Bindings of each vector with its own shift, taken apart again: how far the parts agree with what went in."""
    e = star.table(spark, d, "embeddings")
    a = vectors.binarize(F.col("embedding"))
    b = vectors.permute(a, 5)
    agree = lambda x, y: F.aggregate(vectors.bind(x, y), F.lit(0), lambda s, v: s + v)
    bound = vectors.bind(a, b)
    return e.select("vec_id", agree(vectors.unbind(bound, a), b).alias("second"), agree(vectors.unbind(bound, b), a).alias("first"), agree(vectors.unbind(bound, a), a).alias("across"))


def joined_tokens(spark, d):
    """Texts taken apart and put together again."""
    return star.table(spark, d, "benchmark").select("item_id", text.detokenize(text.tokens(F.col("text"))).alias("text"))


QUERIES = {x.__name__: x for x in (ingested_files, ingested_facts, peer_gaps, session_status, vector_unbinding, joined_tokens)}


def sql() -> dict[str, str]:
    name = "regexp_replace(lower({}), '[^A-Za-z0-9]+', '_', 'g')"
    letters = f"l AS (SELECT 'letter' || lpad(CAST(p_partkey AS VARCHAR), 12, '0') AS file, p_partkey AS k, 'part_' || p_partkey AS s, {name.format('p_type')} AS type, {name.format('p_brand')} AS brand, 'nation_' || (p_partkey % 25) AS nation, 'region_' || (p_partkey % 5) AS region, p_partkey % 9 <> 0 AS said FROM part)"
    told = "t AS (SELECT file, k, s, 'isa' AS r, type AS o FROM l WHERE said UNION ALL SELECT file, k, s, 'madeof', brand FROM l WHERE said UNION ALL SELECT file, k, nation, 'locatedin', region FROM l WHERE said)"
    base = f"b AS (SELECT s, 'locatedin' AS r, 'region_' || (seq % 5) AS o FROM {f('N')})"
    new = "n AS (SELECT *, row_number() OVER (PARTITION BY s, r, o ORDER BY k) AS j FROM t)"
    tokens = "len(regexp_extract_all(lower('The ' || s || ' is a ' || type || '. It was seen! The ' || s || ' is made of ' || brand || '. ' || nation || ' is in ' || region), '[A-Za-z0-9_]+|[^\\sA-Za-z0-9_]'))"
    out = {
        "ingested_files": (
            f"WITH {letters}, {told}, {base}, {new} SELECT l.file, CAST(CASE WHEN said THEN {tokens} ELSE 0 END AS INTEGER) AS n_tokens, CAST(CASE WHEN said THEN 4 ELSE 0 END AS INTEGER) AS n_sentences, (SELECT count(*) FROM t WHERE t.file = l.file) AS n_facts, "
            "(SELECT count(*) FROM n WHERE n.file = l.file AND j = 1 AND NOT EXISTS (SELECT 1 FROM b WHERE b.s = n.s AND b.r = n.r AND b.o = n.o)) AS n_new FROM l"
        ),
        "ingested_facts": f"WITH {letters}, {told} SELECT s, r, o, count(*) AS count, round(1 - 0.3 * pow(0.9, count(*) - 1), 6) AS confidence FROM t GROUP BY s, r, o",
    }
    out["peer_gaps"] = (
        f"WITH v AS (SELECT * FROM {f('P')} UNION ALL SELECT * FROM {f('P2')} WHERE seq % 5 <> 0 UNION ALL SELECT * FROM {f('P3')} WHERE seq % 3 <> 0), i AS (SELECT s, o AS parent, row_number() OVER (PARTITION BY o ORDER BY seq, s) AS k FROM v WHERE r = 'isa'), pe AS (SELECT * FROM i WHERE k <= {intake.PEERS}), "
        "c AS (SELECT parent, v.r, v.o, count(*) AS m FROM pe JOIN v ON v.s = pe.s AND v.r <> 'isa' GROUP BY 1, 2, 3), sp AS (SELECT parent, r, CAST(sum(m) AS BIGINT) AS support, list(o ORDER BY m DESC, o)[1:3] AS objects FROM c GROUP BY 1, 2 HAVING sum(m) >= 2), "
        "w AS (SELECT i.s, sp.*, row_number() OVER (PARTITION BY i.s ORDER BY support DESC, r) AS n FROM i JOIN sp USING (parent) WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.s = i.s AND v.r = sp.r) AND EXISTS (SELECT 1 FROM pe WHERE pe.parent = i.parent AND pe.s <> i.s)) "
        "SELECT s, r, support, array_to_string(objects, ', ') AS objects, 'What is the ' || r || ' of ' || s || '? (its peers include ' || array_to_string(objects[1:2], ', ') || ')' AS question, CAST(n AS INTEGER) AS n FROM w WHERE n <= 10"
    )
    src, rec = f("C", "C50", "P2", "D40"), prov("C", "C50", "P2", "D40")
    sk = f"(SELECT r, count(*) FILTER (seq % 3 <> 0) AS a, count(*) FILTER (seq % 3 = 0) AS b FROM {src} GROUP BY r)"
    counts = {
        "facts": f"FROM {src} WHERE NOT starts_with(r, 'not_')", "denials": f"FROM {src} WHERE starts_with(r, 'not_')", "relations": f"FROM (SELECT DISTINCT r FROM {src})", "entities": f"FROM (SELECT s FROM {src} UNION SELECT o FROM {src})", "records": f"FROM {rec}", "unsure_records": f"FROM {rec} WHERE confidence < 0.3",
        "derived_records": f"FROM {rec} WHERE source IN ('induced', 'rule')", "skills": f"FROM {sk}", "sure_skills": f"FROM {sk} WHERE a + b >= 3 AND a >= 0.8 * (a + b)", "episodes": f"FROM ({_EPISODES})", "open_episodes": f"FROM ({_EPISODES}) WHERE state = 'idk'", "signatures": f"FROM (SELECT DISTINCT subject, relation FROM ({_EPISODES}))",
    }
    out["session_status"] = " UNION ALL ".join(f"SELECT '{k}' AS name, count(*) AS n {v}" for k, v in counts.items())
    signs = "list_transform(embedding, lambda x: CASE WHEN x >= 0 THEN 1 ELSE -1 END)"
    out["vector_unbinding"] = f"SELECT vec_id, CAST(len(v) AS INTEGER) AS second, CAST(len(v) AS INTEGER) AS first, CAST(list_sum(list_transform(range(1, len(v) + 1), lambda i: v[i] * v[CASE WHEN i > 5 THEN i - 5 ELSE len(v) + i - 5 END])) AS INTEGER) AS across FROM (SELECT vec_id, {signs} AS v FROM embeddings)"
    out["joined_tokens"] = r"SELECT item_id, regexp_replace(array_to_string(regexp_extract_all(lower(text), '[A-Za-z0-9_]+|[^\sA-Za-z0-9_]'), ' '), ' ([.,!?;:)])', '\1', 'g') AS text FROM benchmark"
    return out
