"""The registered queries over the smallest tables, beside SQL or brute force."""

import hashlib
import math
import re
import zlib

import duckdb
import numpy as np
import pytest
import xxhash

from factloom.llm import langid, quality, queries, secrets

from ..conftest import SF
from ..test_queries import rows
from .test_operators import base_spans, own_encoding

TABLES = ("documents", "pages", "benchmark", "embeddings", "labels")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.fixture(scope="module")
def texts(db):
    return dict(db.execute("SELECT doc_id, text FROM documents").fetchall())


def hashed(value):
    return hashlib.sha256(value if isinstance(value, bytes) else value.encode()).hexdigest()


def crc(i):
    return zlib.crc32(str(i).encode())


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_beside_sql(spark, db, name):
    got, want = queries.queries()[name](spark, SF).toPandas(), db.execute(queries.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_op1(spark, texts):
    enc = own_encoding()
    out = queries.op1_bpe(spark, SF).collect()
    assert len(out) == len(texts)
    for r in out:
        ids = enc.encode_ordinary(texts[r["doc_id"]] or "")
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashed(",".join(map(str, ids))), hashed(texts[r["doc_id"]] or ""))


def test_op2_and_op3(spark, db, texts):
    lang = dict(db.execute("SELECT doc_id, lang FROM documents").fetchall())
    out = queries.op2_language_id(spark, SF).collect()
    assert len(out) == len(texts)
    assert all(r["held_out"] == (crc(r["doc_id"]) % 3 == 1) and 0 <= r["score"] <= 1 and r["lang_pred"] in {*lang.values(), "und"} for r in out)
    held = [r for r in out if r["held_out"] and lang[r["doc_id"]]]
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held]) > 0.9
    out = queries.op3_quality(spark, SF).collect()
    assert len(out) == len(texts)
    assert all(r["held_out"] == (crc(r["doc_id"]) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in out)


def test_op8(spark, db):
    v = {i: np.array(e, np.float64) for i, e in db.execute("SELECT vec_id, embedding FROM embeddings").fetchall() if e is not None and None not in e}
    v = {i: e for i, e in v.items() if np.isfinite(e).all() and e.any()}
    got = {}
    for r in queries.op8_nearest(spark, SF).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == {i for i in v if i % 20 == 0}
    for q, own in got.items():
        best = sorted((-float((v[q] * e).sum()), i) for i, e in v.items() if i != q)[:20]
        assert [(k + 1, i) for k, (_, i) in enumerate(best)] == [(r, i) for r, i, _ in sorted(own)]
        assert all(math.isclose(-s, x, rel_tol=1e-12) for (s, _), (_, _, x) in zip(best, sorted(own), strict=True))


def drawn(key, shards):
    """Weighted draws of equal weights, by the hash that Spark documents as xxhash64."""
    h = xxhash.xxh64(key.encode(), 42).intdigest()
    h = xxhash.xxh64((0).to_bytes(4, "little"), h).intdigest()
    u = [((xxhash.xxh64(k.to_bytes(4, "little"), h).intdigest() >> 11) + 0.5) / 2**53 for k in range(shards)]
    return max(range(shards), key=lambda k: -1 / math.log(u[k]))


def test_op9(spark, texts):
    out = queries.op9_sharding(spark, SF).collect()
    slots = {}
    for r in out:
        raw = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(raw) + 8, zlib.crc32(raw), "key")
        assert (r["shard"], r["grown_shard"]) == (drawn(str(r["doc_id"]), 24), drawn(str(r["doc_id"]), 25))
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert len(out) == len(texts) and all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_op10(spark, texts):
    out = queries.op10_secrets(spark, SF).collect()
    assert len(out) == len(texts)
    for r in out:
        text = texts[r["doc_id"]] or ""
        want = base_spans(text)
        n = [sum(x.startswith(k + ":") for x in want.split(",")) for k in secrets.BASE]
        assert ([r["n_assign"], r["n_access"], r["n_hex"]], r["base_sha256"]) == (n, hashed(want))
        spans = r["spans"].split(",") if r["spans"] else []
        assert [x for x in spans if x.split(":")[0] in secrets.BASE] == (want.split(",") if want else [])


def plain_language(model, text):
    """The scores of a text, worked out n-gram by n-gram from a model's table."""
    m32 = (1 << 32) - 1
    s = re.sub(rb"[^a-z\x80-\xff]+", b" ", b" " + (text or "").lower().encode() + b" ")
    total, count = np.zeros(len(model.labels)), 0
    for n in langid.SIZES:
        for i in range(len(s) - n + 1):
            g = s[i : i + n]
            if b" " in g[1:-1] or g == b"  ":
                continue
            h = g[0]
            for c in g[1:]:
                h = (h * 0x01000193 + c) & m32
            k = ((h ^ (n * 0x9E3779B1 & m32)) * 0x85EBCA6B) & m32
            k ^= k >> 15
            total += model.table[(k * 0xC2B2AE35 & m32) >> (32 - langid.BUCKET_BITS)]
            count += 1
    z = (total / max(count, 1) + model.bias) / model.temperature
    p = np.exp(z - z.max())
    return p / p.sum()


def test_op2_by_plain_python(spark, texts):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.train(*langid.sample(docs, where=queries.remainder(3) != 1))
    assert model.threshold > 0.3
    for r in queries.op2_language_id(spark, SF).collect()[:60]:
        text = texts[r["doc_id"]]
        if not re.search(r"[^\W\d_]", text or ""):
            assert (r["lang_pred"], r["score"], r["rejected"]) == ("und", 0.0, True)
            continue
        p = plain_language(model, text)
        assert r["lang_pred"] == model.labels[p.argmax()] and math.isclose(r["score"], p.max(), rel_tol=1e-4) and r["rejected"] == (r["score"] < model.threshold)


def test_language_rejects_what_it_has_not_learned(spark, texts, db):
    lang = dict(db.execute("SELECT doc_id, lang FROM documents").fetchall())
    own = [(t, lang[i]) for i, t in texts.items() if t and lang[i] and len(t) < 5000]
    model = langid.train([t for t, _ in own], [x for _, x in own])
    rng = np.random.default_rng(2)
    make = lambda letters: " ".join("".join(rng.choice(list(letters), rng.integers(2, 9))) for _ in range(80))
    odd = [make("абвгдежзиклмнопрстуфхцчшы") for _ in range(40)] + [make("abcdefghijklmnopqrstuvwxyz") for _ in range(40)]
    rows = spark.createDataFrame(list(enumerate(odd + [t for t, _ in own])), "doc_id long, text string")
    got = {r["doc_id"]: r["language"]["rejected"] for r in langid.identify(rows, model).collect()}
    assert sum(got[i] for i in range(80)) >= 72 and sum(got[80 + i] for i in range(len(own))) <= 0.03 * len(own)


def plain_quality(model, text):
    """The score of a text, worked out word by word from a model's weights."""
    m64 = (1 << 64) - 1

    def mix(h):
        h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 & m64
        h = (h ^ h >> 27) * 0x94D049BB133111EB & m64
        return h ^ h >> 31

    def word(w):
        power, total, b = 1, len(w), 0x9E3779B97F4A7C15 | 1
        for c in w:
            power = power * b & m64
            total += (c + 1) * power
        return mix(total & m64)

    h = [word(w) for w in re.findall(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff \t\n\x0b\x0c\r]+", (text or "").encode())]
    steps = [(2 * k * 0xD1342543DE82EF95 + 1) & m64 for k in (1, 2)]
    pairs = [1 << 63 if a == b else mix((mix(a * steps[0] & m64) + mix(b * steps[1] & m64)) & m64) for a, b in zip(h, h[1:], strict=False)]
    keys = sorted({x >> (64 - quality.BITS) for x in h + pairs})
    length = math.sqrt(sum(float(model.squares[k]) for k in keys))
    margin = sum(float(model.weights[k]) for k in keys) / max(length, 1e-12) + model.bias
    return 1 / (1 + math.exp(-max(-35, min(35, model.slope * margin + model.shift))))


def test_op3_by_plain_python(spark, texts):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet").where(queries.remainder(5) != 0)
    model = quality.train(*quality.sample(docs, labels))
    for r in queries.op3_quality(spark, SF).collect():
        assert math.isclose(r["score"], plain_quality(model, texts[r["doc_id"]]), rel_tol=1e-4, abs_tol=1e-7)


def test_op7(spark, texts):
    """Exact repeats of 51 words are all found, and what is found is nearly a repeat."""
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) for i, t in texts.items()}
    where, grams = {}, {}
    for i, w in words.items():
        for k in range(len(w) - 50):
            where.setdefault(tuple(w[k : k + 51]), set()).add(i)
        grams[i] = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
    exact = {i for docs in where.values() if len(docs) > 1 for i in docs}
    rows = queries.op7_passages(spark, SF).collect()
    found = {r["doc_id"] for r in rows}
    assert exact and exact <= found
    for r in rows:
        own = set(grams[r["doc_id"]][r["start_word"] : r["end_word"] - 4])
        assert r["end_word"] - r["start_word"] >= 45 and max(len(own & set(grams[x["doc_id"]])) for x in rows if x["class_id"] == r["class_id"] and x["doc_id"] != r["doc_id"]) >= 0.5 * min(len(own), 60)
