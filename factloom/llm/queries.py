"""The registered queries of this subpackage and, where SQL can say them, their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, audit, bpe, decontaminate, jaccard, langid, merkle, passages, perplexity, quality, secrets, sharding, warc

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
SHARDS = 24


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.round_trip_documents(docs, VOCABULARY, PATTERN)
    return coded.select("doc_id", F.size("coded.ids").cast("long").alias("n_tokens"), F.sha2(bpe.id_text(F.col("coded.ids")).cast("binary"), 256).alias("ids_sha256"), F.sha2("coded.decoded", 256).alias("decoded_sha256"))


def remainder(n: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(*langid.sample(docs, where=remainder(3) != 1))
    found = langid.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", F.coalesce(remainder(3) == 1, F.lit(False)).alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"), F.col("language.rejected").alias("rejected"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(remainder(5) != 0)
    model = quality.train(*quality.sample(docs, labels))
    scored = quality.score_documents(docs, model)
    return scored.select("doc_id", F.coalesce(remainder(5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= quality.CUT).cast("int").alias("predicted"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


def _lowered(text: str) -> str:
    return f"translate(coalesce({text}, ''), '{decontaminate.UPPER}', '{decontaminate.LOWER}')"


def _contamination_sql() -> str:
    """All windows of items beside all stretches of as many words of documents."""
    words = rf"regexp_extract_all({_lowered('text')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    stretch = lambda k: f"array_to_string(w[i : i + {k} - 1], ' ')"
    return f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS row, {words} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {words} AS w FROM benchmark),
wins AS (SELECT DISTINCT item, k, {stretch('k')} AS win FROM (SELECT item, w, least({decontaminate.WINDOW}, len(w)) AS k, unnest(range(1, len(w) - least({decontaminate.WINDOW}, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT k FROM wins),
spots AS (SELECT row, k, i, {stretch('k')} AS win FROM (SELECT row, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, lens WHERE len(w) >= k)),
hits AS (SELECT row, k, i, item FROM spots JOIN wins USING (k, win)),
places AS (SELECT row, count(*) AS n_hit FROM (SELECT DISTINCT row, unnest(range(i, i + k)) AS place FROM hits) GROUP BY row),
found AS (SELECT row, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT row, item FROM hits) GROUP BY row)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN places USING (row) LEFT JOIN found USING (row)"""


def _jaccard_sql() -> str:
    """All pairs that share a shingle, and what links reach."""
    n = jaccard.SHINGLE
    return rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_lowered('text')}, '[^\x20\x09-\x0D]+') AS w FROM documents),
t AS (SELECT doc_id, array_to_string(w[i : i + {n} - 1], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {n} + 2, 2))) AS i FROM d WHERE len(w) > 0)),
sets AS (SELECT DISTINCT doc_id, s FROM t), sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id WHERE 100 * k >= {jaccard.PERCENT} * (x.n + y.n - k)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT d.doc_id, coalesce(max(n), 0) AS n_shingles, min(b) AS component_id FROM d LEFT JOIN sizes USING (doc_id) JOIN reach ON reach.a = d.doc_id GROUP BY d.doc_id"""


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.page_derivatives(table(spark, sf_dir, "pages"))
    return out.select(F.col("source").alias("page_id"), "record_type", "record_id", "refers_to", "concurrent_to", "target_uri", "payload_digest", "content_type", "block_digest", "content_length", "block")


def _warc_sql() -> str:
    """The same records in SQL, from the same fixed patterns."""
    lit = lambda x: "'" + x.replace("'", "''") + "'"
    urn = lambda what: f"'<urn:uuid:' || substr(sha256({what}),1,8) || '-' || substr(sha256({what}),9,4) || '-' || substr(sha256({what}),13,4) || '-' || substr(sha256({what}),17,4) || '-' || substr(sha256({what}),21,12) || '>'"
    text = "body"
    for pattern, to in warc.HTML_STEPS:
        text = f"regexp_replace({text}, {lit(pattern)}, {lit(to)}, 'g')"
    nl = "chr(13) || chr(10)"
    head = f"'http-header: HTTP/1.1 200 OK' || {nl} || 'http-header: Content-Type: text/html; charset=utf-8' || {nl} || 'http-header: Content-Length: ' || strlen(body) || {nl}"
    links = f"coalesce(array_to_string(list_transform(regexp_extract_all(body, {lit(warc.LINK)}, 1), lambda x: 'outlink: ' || regexp_replace(x, '[\\r\\n]+', ' ', 'g') || {nl}), ''), '')"
    meta = f"'title: ' || regexp_replace(regexp_extract(body, {lit(warc.TITLE)}, 1), '\\s+', ' ', 'g') || {nl} || {head} || {links}"
    return f"""
WITH r AS (SELECT page_id, url, coalesce(html, '') AS body, {urn("'response|' || page_id || '|' || coalesce(url, '')")} AS rid FROM pages),
ids AS (SELECT *, {urn("'metadata|' || rid")} AS mid, {urn("'conversion|' || rid")} AS cid FROM r),
both_ AS (SELECT page_id, 'metadata' AS record_type, mid AS record_id, rid AS refers_to, cid AS concurrent_to, url, body, 'application/warc-fields' AS content_type, {meta} AS block FROM ids
UNION ALL SELECT page_id, 'conversion', cid, rid, mid, url, body, 'text/plain; charset=utf-8', {text} FROM ids)
SELECT page_id, record_type, record_id, refers_to, concurrent_to, regexp_replace(url, '[\\r\\n]+', ' ', 'g') AS target_uri, 'sha256:' || sha256(body) AS payload_digest, content_type, 'sha256:' || sha256(block) AS block_digest, CAST(strlen(block) AS BIGINT) AS content_length, block FROM both_"""


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ann.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20)
    return out.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = sharding.shard_documents(docs, [1.0] * SHARDS, [1.0] * (SHARDS + 1))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    of = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("secrets", lambda s: s["kind"].isin(*secrets.BASE))
    return found.select("doc_id", of("assign").alias("n_assign"), of("access").alias("n_access"), of("hex").alias("n_hex"), F.sha2(secrets.span_text(base).cast("binary"), 256).alias("base_sha256"), secrets.span_text(F.col("secrets")).alias("spans"))


def op11_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = perplexity.judged(table(spark, sf_dir, "documents"))
    return out.select("doc_id", *perplexity.COUNTS, "base_failed", "kept", "log_perplexity")


def op12_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.interactions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _audit_sql() -> str:
    """Every document taken through every order, by the definition."""
    bits = lambda cols: " + ".join(f"CASE WHEN {c} THEN {1 << k} ELSE 0 END" for k, c in enumerate(cols))
    return rf"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
f AS (SELECT doc_id, part, len(w) < {audit.LEAST_WORDS} AS a, 100 * len(list_distinct(w)) < {audit.DISTINCT_PERCENT} * len(w) AS b, 100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > {audit.UPPER_PERCENT} * length(text) AS c, regexp_matches(text, '[#$%&*|]') AS d, coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS e FROM t),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, {bits("abcde")} AS mask, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM f LEFT JOIN l USING (doc_id)),
one AS (SELECT unnest(range(5)) AS k), letters AS (SELECT substr('{audit.FILTERS}', CAST(k AS INT) + 1, 1) AS x, CAST(1 << k AS INT) AS bit FROM one),
orders AS (SELECT p.x || q.x || r.x || s.x || u.x AS filter_order, [p.bit, q.bit, r.bit, s.bit, u.bit] AS bits FROM letters p, letters q, letters r, letters s, letters u WHERE p.bit + q.bit + r.bit + s.bit + u.bit = 31 AND len(list_distinct([p.bit, q.bit, r.bit, s.bit, u.bit])) = 5),
steps AS (SELECT filter_order, CAST(step AS INT) AS step, bits[step] AS bit, coalesce(list_sum(bits[1 : step - 1]), 0)::INT AS earlier FROM (SELECT filter_order, bits, unnest(range(1, 6)) AS step FROM orders)),
shares AS (SELECT part, bit, CAST(sum(n) AS BIGINT) AS shapley FROM (SELECT part, bit, count(*) AS n FROM m, steps WHERE mask & bit <> 0 AND mask & earlier = 0 GROUP BY part, bit) GROUP BY part, bit)
SELECT part, filter_order, step, count_if(mask & (bit | earlier) = 0)::BIGINT AS kept, count_if(mask & bit <> 0 AND mask & earlier = 0)::BIGINT AS removed, count_if(mask & bit <> 0 AND mask & earlier <> 0)::BIGINT AS redundant, count_if(mask = bit)::BIGINT AS unique_fails,
coalesce(sum(good) FILTER (mask & bit <> 0 AND mask & earlier = 0), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (mask & bit <> 0 AND mask & earlier = 0), 0)::BIGINT AS toxic_lost, coalesce(max(shapley), 0)::BIGINT AS shapley
FROM (SELECT * FROM m, steps) LEFT JOIN shares USING (part, bit) GROUP BY part, filter_order, step"""


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.when(remainder(2) == 0, F.replace(F.col("text"), F.lit("\n"), F.lit("")))
    out = merkle.manifest(table(spark, sf_dir, "documents"), tampered)
    hexed = [merkle.hex_text(F.col(c)).alias(name) for c, name in (("leaf", "leaf"), ("subroot", "subroot"), ("root", "root"), ("proof", "proof_sha256"), ("folded", "folded_root"))]
    return out.select("doc_id", *hexed, (F.col("folded") == F.col("root")).alias("verified"))


def _merkle_sql() -> str:
    """Both trees level by level in one recursion each, and proofs folded row by row. DuckDB has no crc32; it is worked out bit by bit."""
    n = merkle.FANOUT
    one = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')"
    of = lambda t: "sha256(" + " || ".join(one(t if c == "text" else c) for c in ("doc_id", "source", "lang", "n_chars", "text")) + ")"
    bit = "list_reduce([CAST(4294967295 AS BIGINT)] || list_transform(range(strlen(CAST(doc_id AS VARCHAR))), lambda i: CAST(ascii(substr(CAST(doc_id AS VARCHAR), CAST(i AS INT) + 1, 1)) AS BIGINT)), lambda c, x: list_reduce([xor(c, x)] || list_transform(range(8), lambda j: CAST(j AS BIGINT)), lambda v, j: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END))"
    up = lambda name, base: f"{name} AS (SELECT 0 AS k, grp, size AS m, i, h FROM {base} UNION ALL SELECT k + 1, grp, (m + {n - 1}) // {n}, i // {n}, sha256(string_agg(h, '' ORDER BY i)) FROM {name} WHERE m > 1 GROUP BY k, grp, m, i // {n})"
    runs = lambda name, of: f"{name} AS (SELECT k, grp, i // {n} AS p, list(h ORDER BY i) AS hs FROM {of} WHERE m > 1 GROUP BY k, grp, i // {n})"
    fold = lambda name, base, of: f"{name} AS (SELECT row, 0 AS k, grp, i, x, '' AS proof, keep FROM {base} UNION ALL SELECT row, f.k + 1, f.grp, f.i // {n}, sha256(array_to_string(hs[1 : f.i % {n}], '') || x || array_to_string(hs[f.i % {n} + 2 :], '')), proof || array_to_string(hs[1 : f.i % {n}], '') || array_to_string(hs[f.i % {n} + 2 :], ''), keep FROM {name} f JOIN {of} r ON f.k = r.k AND f.grp = r.grp AND f.i // {n} = r.p)"
    ends = lambda name: f"(SELECT row, max_by(x, k) AS x, max_by(proof, k) AS proof, any_value(keep) AS keep FROM {name} GROUP BY row)"
    return f"""
WITH RECURSIVE lines AS (SELECT doc_id, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS grp, {of("text")} AS h, CASE WHEN (1 - {bit} & 1) = 0 THEN {of("replace(text, chr(10), '')")} END AS other FROM documents),
leaves AS (SELECT doc_id, grp, h, coalesce(other, h) AS x, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, h) - 1 AS i, count(*) OVER (PARTITION BY grp) AS size, row_number() OVER () AS row FROM lines),
{up("low", "leaves")}, subs AS (SELECT -1 AS grp, (SELECT count(DISTINCT grp) FROM leaves) AS size, grp AS i, h, h AS x FROM low WHERE m = 1), {up("high", "subs")},
{runs("low_runs", "low")}, {runs("high_runs", "high")},
{fold("a", "(SELECT row, grp, i, x, grp AS keep FROM leaves)", "low_runs")},
{fold("b", "(SELECT e.row, -1 AS grp, e.keep AS i, e.x, e.proof AS keep FROM " + ends("a") + " e)", "high_runs")}
SELECT doc_id, l.h AS leaf, s.h AS subroot, t.h AS root, sha256(e.keep || e.proof) AS proof_sha256, e.x AS folded_root, e.x = t.h AS verified
FROM {ends("b")} e JOIN leaves l USING (row) JOIN subs s ON s.i = l.grp JOIN (SELECT h FROM high WHERE m = 1) t ON true"""


def queries() -> dict:
    return {f.__name__: f for f in (op1_bpe, op2_language_id, op3_quality, op4_decontamination, op5_warc, op6_jaccard, op7_passages, op8_nearest, op9_sharding, op10_secrets, op11_perplexity, op12_audit, op13_merkle)}


def oracle_sql() -> dict[str, str]:
    return {"op4_decontamination": _contamination_sql(), "op5_warc": _warc_sql(), "op6_jaccard": _jaccard_sql(), "op12_audit": _audit_sql(), "op13_merkle": _merkle_sql()}
