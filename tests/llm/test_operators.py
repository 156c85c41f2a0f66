"""Operators against brute force on small fixtures: nulls, empty and long texts, ties, repeats, empty tables, clashing names."""

import base64
import gzip
import hashlib
import json
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from factloom.llm import ann, bpe, decontaminate, jaccard, langid, passages, quality, queries, secrets, sharding, warc
from factloom.llm.components import components

from ..conftest import SF

RNG = random.Random(4)
WORDS = ["".join(RNG.choice("abcdeéñ") for _ in range(RNG.randint(1, 7))) for _ in range(4000)]
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def prose(n, rng=RNG):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def table(spark, texts, extra=True):
    """Documents with columns whose names operators use themselves."""
    rows = [(i, t, "x", 1, "y") if extra else (i, t) for i, t in enumerate(texts)]
    schema = "doc_id long, text string" + (", row string, n int, node string" if extra else "")
    return spark.createDataFrame(rows, schema).repartition(3)


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


ODD = [None, "", " ", "\n\t", "a", "É", "1234", "日本語 テキスト", "ab " * 5000, "x" * 30000, "same text here", "same text here"]


# 1


def own_encoding():
    lines = open(queries.VOCABULARY, "rb").read()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines.splitlines())}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_merges_and_decodes(spark):
    texts = [*ODD, *("".join(RNG.choice("abcde  \n's12é漢😀!A") for _ in range(60)) for _ in range(80)), "<|endoftext|>"]
    out = bpe.decode_documents(bpe.encode_documents(table(spark, texts), queries.VOCABULARY, queries.PATTERN), queries.VOCABULARY)
    enc, got = own_encoding(), by_id(out)
    assert "row" in out.columns
    for i, t in enumerate(texts):
        assert got[i]["ids"] == enc.encode_ordinary(t or "")
        assert bytes(got[i]["decoded"]) == (t or "").encode()
    both = by_id(bpe.round_trip_documents(table(spark, texts), queries.VOCABULARY, queries.PATTERN))
    assert all((list(both[i]["coded"]["ids"]), bytes(both[i]["coded"]["decoded"])) == (got[i]["ids"], bytes(got[i]["decoded"])) for i in range(len(texts)))
    assert bpe.encode_documents(table(spark, []), queries.VOCABULARY, queries.PATTERN).count() == 0
    assert bpe.round_trip_documents(table(spark, []), queries.VOCABULARY, queries.PATTERN).count() == 0


# 2, 3


def test_language_is_learned_and_rejected(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.train(*langid.sample(docs, where=queries.remainder(3) != 1))
    got = by_id(langid.identify(docs, model))
    held = [r for r in got.values() if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert np.mean([r["language"]["lang"] == r["lang"] for r in held]) > 0.95
    assert sum(r["language"]["rejected"] for r in held) <= 1
    odd = by_id(langid.identify(table(spark, ODD), model))
    for i in (0, 1, 2, 3, 6):
        assert (odd[i]["language"]["lang"], odd[i]["language"]["score"], odd[i]["language"]["rejected"]) == ("und", 0.0, True)
    assert odd[5]["language"]["lang"] != "und" and all(0 <= r["language"]["score"] <= 1 for r in odd.values())
    assert odd[10]["language"] == odd[11]["language"]
    nothing = langid.train(*langid.sample(docs.limit(0)))
    blank = by_id(langid.identify(table(spark, ["abc", None]), nothing))
    assert (blank[0]["language"]["lang"], blank[0]["language"]["rejected"], blank[1]["language"]["rejected"]) == ("und", False, True)


def test_quality_ranks_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality.train(*quality.sample(docs, labels.where(queries.remainder(5) != 0)))
    score = {r["doc_id"]: r["score"] for r in quality.score_documents(docs, model).collect()}
    held = [(score[r["doc_id"]], r["quality"]) for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    good, bad = [s for s, q in held if q == 1], [s for s, q in held if q == 0]
    assert np.mean([[g > b for b in bad] for g in good]) > 0.95
    odd = by_id(quality.score_documents(table(spark, ODD), model))
    assert len(odd) == len(ODD) and all(0 <= r["score"] <= 1 for r in odd.values()) and odd[0]["score"] == odd[1]["score"]
    flat = quality.train(*quality.sample(docs, labels.limit(0)))
    assert {r["score"] for r in quality.score_documents(table(spark, ODD), flat).collect()} == {0.5}


def test_dual_descent_finds_the_margin():
    rows = [np.array([0, k % 5 + 2]) for k in range(40)] + [np.array([1, k % 5 + 2]) for k in range(40)]
    y = np.array([1] * 40 + [-1] * 40)
    w, b = quality.descend(rows, y, np.ones(8))
    assert all(y[i] * (w[rows[i]].sum() / np.sqrt(2) + b) > 0.5 for i in range(80))


# 4


def words_of(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))


def contamination(docs, items, n=13):
    wins = {}
    for i, t in items:
        w = words_of(t)
        k = min(n, len(w))
        for a in range(len(w) - k + 1 if k else 0):
            wins.setdefault(tuple(w[a : a + k]), set()).add(str(i))
    out = {}
    for i, t in docs:
        w, hit, found = words_of(t), set(), set()
        for k in {len(x) for x in wins}:
            for a in range(len(w) - k + 1):
                if (g := wins.get(tuple(w[a : a + k]))) :
                    hit |= set(range(a, a + k))
                    found |= g
        out[i] = (len(w), len(hit), sorted(found), len(hit) > 0 and 20 * len(hit) >= len(w))
    return out


def test_contamination_equals_brute_force(spark):
    items = [prose(40), prose(13), prose(3), "Éa éa", None, "", "the the the the the the the the the the the the the the", prose(5), "z"]
    texts = [*ODD, *(prose(RNG.randint(5, 200)) for _ in range(20)), items[0], items[0].upper(), "x " + items[0][:100] + " y " * 300, prose(50) + "--" + items[1] + ", " + items[2], "éa éa", "Éa éa", "the " * 40, items[0] + " " + items[0], "z, z"]
    docs = table(spark, texts)
    bench = spark.createDataFrame([*enumerate(items), (1, items[1])], "item_id long, text string").withColumn("row", F.lit("clash"))
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], list(r["item_ids"]), r["contaminated"]) for r in decontaminate.contamination(docs, bench).collect()}
    assert got == contamination(enumerate(texts), list(enumerate(items)))
    assert all(r["n_hit"] == 0 for r in decontaminate.contamination(docs, bench.limit(0)).collect())
    assert decontaminate.contamination(docs.limit(0), bench).count() == 0


def test_proximity(spark):
    docs = table(spark, ["a b c d e f g", "a x x x x x x b", "b a", None])
    index = decontaminate.build_index(docs, spark.createDataFrame([(w,) for w in "abg"], "word string"))
    asked = spark.createDataFrame([("q", "A"), ("q", "b"), ("far", "a"), ("far", "g"), ("none", "nowhere")], "query_id string, word string")
    got = sorted((r["query_id"], r["start"], r["end"]) for r in decontaminate.proximity_matches(index, asked, 3).collect())
    assert got == [("q", 0, 2), ("q", 0, 2)]


# 5


def test_warc_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/\r\nx", "<title>T &amp; t</title><p>one<br>two<script>x</script>"), (2, None, None), (3, "u", ""), (3, "u", "")], "page_id long, url string, html string").withColumn("record", F.lit(1))
    out = warc.page_derivatives(pages)
    rows = out.collect()
    assert len(rows) == 8
    first = {r["record_type"]: r for r in rows if r["source"] == 1}
    assert first["conversion"]["block"] == "T & t\none\ntwo" and first["conversion"]["concurrent_to"] == first["metadata"]["record_id"]
    assert "http-header: Content-Type: text/html" in first["metadata"]["block"] and "\n" not in first["metadata"]["target_uri"]
    warc.write_derivatives(out.coalesce(1), str(tmp_path / "w"))
    back = {r["record_id"]: r for r in warc.read_warc(spark, str(tmp_path / "w" / "*.gz")).collect()}
    for r in rows:
        b = back[r["record_id"]]
        assert (b["refers_to"], b["payload"], b["block_digest"]) == (r["refers_to"], r["block"], r["block_digest"])
        assert b["block_digest"] == "sha256:" + hashlib.sha256(b["payload"].encode()).hexdigest()
    assert warc.page_derivatives(pages.limit(0)).count() == 0


def test_warc_files_of_all_kinds(spark, tmp_path):

    def record(kind, block, more=b""):
        return b"WARC/1.0\r\nWARC-Type: " + kind + b"\r\nWARC-Record-ID: <urn:x>\r\n" + more + b"Content-Length: " + str(len(block)).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"

    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n<p>\xff\xfea\r\n\r\nb</p>"
    parts = [record(b"warcinfo", b"software: x\r\n"), record(b"response", http, b"WARC-Target-URI: http://a/\r\ncontent-type: application/http; msgtype=response\r\n"), record(b"resource", b""), record(b"metadata", "é\r\n\r\n".encode())]
    (tmp_path / "a.warc").write_bytes(b"".join(parts))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(p) for p in parts))
    (tmp_path / "c.warc").write_bytes(parts[1][:-20])
    (tmp_path / "d.warc").write_bytes(b"")
    got = {}
    for r in warc.read_warc(spark, str(tmp_path / "*.warc*")).collect():
        got.setdefault(r["source"].rsplit("/", 1)[-1], []).append(r)
    for name in ("a.warc", "b.warc.gz"):
        kinds = {r["type"]: r for r in got[name]}
        assert len(got[name]) == 4 and bytes(kinds["response"]["payload_bytes"]) == b"<p>\xff\xfea\r\n\r\nb</p>" and "\ufffd" in kinds["response"]["payload"]
        assert kinds["response"]["target_uri"] == "http://a/" and kinds["response"]["http_headers"].endswith("text/html") and kinds["resource"]["payload"] == "" and kinds["metadata"]["payload"] == "é\r\n\r\n"
        assert not any(r["truncated"] for r in got[name])
    assert [r["truncated"] for r in got["c.warc"]] == [True] and "d.warc" not in got


def test_html_text_equals_the_steps(spark):
    rng = random.Random(3)
    bits = ["<p>", "</P >", "<!-- x -- <b> -->", "<!--", "<script>a<b</script>", "<STYLE x>p{}</style >", "<span>", "<header id=1>", "<head>", "<hr/>", "<h7>", "<pre\n>", "<prefix>", "<a href=\"x\">", "<", ">", "&amp;", "&#38;", "amp;", "lt;", "#38;", "&lt;", "&#60;", "&nbsp;", "&#x27;", "&middot;", "&copy;", "&", "\u2028", "\u0085", " ", "  ", "\t", "\r\n", "\n", " \n ", "word", "é", "日本", "$1", "\\"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for _ in range(1500)]
    want = []
    for t in texts:
        for pattern, to in warc.HTML_STEPS:
            t = re.sub(pattern.replace("$", r"\Z"), lambda m, to=to: to, t)
        want.append(t)
    got = spark.createDataFrame(list(enumerate(texts)), "i int, html string").select("i", warc.html_text(F.col("html")).alias("t")).collect()
    assert [r["t"] for r in sorted(got)] == want


# 6


def shingle_sets(texts, n=5):
    out = []
    for t in texts:
        w = re.findall("[^\x20\x09-\x0d]+", (t or "").translate(LOWER))
        out.append({tuple(w)} if 0 < len(w) < n else {tuple(w[i : i + n]) for i in range(len(w) - n + 1)})
    return out


def classes(sets):
    up = list(range(len(sets)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return [find(x) for x in range(len(sets))]


def edited(text, k, rng=RNG):
    w = text.split()
    for _ in range(k):
        w[rng.randrange(len(w))] = rng.choice(WORDS)
    return " ".join(w)


@pytest.mark.parametrize("block_rows", [20_000, 4])
def test_jaccard_equals_brute_force(spark, block_rows):
    base, common = [prose(n) for n in (30, 80, 200, 200)], prose(60)
    texts = [*ODD, *(edited(b, RNG.randint(0, 6)) for b in base for _ in range(14)), *(prose(20) + " " + common + " " + prose(30) for _ in range(25)), *(prose(4) for _ in range(4)), "A b", "a  B", base[0].upper()]
    sets = shingle_sets(texts)
    got = by_id(jaccard.jaccard_components(table(spark, texts), block_rows=block_rows))
    assert [got[i]["n_shingles"] for i in range(len(texts))] == [len(s) for s in sets]
    assert [got[i]["component_id"] for i in range(len(texts))] == classes(sets)


def test_jaccard_of_nothing(spark):
    assert jaccard.jaccard_components(table(spark, [])).count() == 0
    assert [r["component_id"] for r in jaccard.jaccard_components(table(spark, [None, "", None])).orderBy("doc_id").collect()] == [0, 1, 2]


def test_jaccard_without_ids_and_with_one_id(spark):
    rng = random.Random(17)
    base = [prose(60, rng) for _ in range(40)]
    texts = [*base, *(edited(b, 1, rng) for b in base), *base]
    want = classes(shingle_sets(texts))
    for ids in ([None] * len(texts), [7] * len(texts), [None if k % 3 else k for k in range(len(texts))]):
        docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").repartition(5)
        got = jaccard.jaccard_components(docs).collect()
        assert len(got) == len(texts)
        named = [min((ids[j] for j in range(len(texts)) if want[j] == want[i] and ids[j] is not None), default=None) for i in range(len(texts))]
        assert sorted((r["n_shingles"], str(r["component_id"])) for r in got) == sorted((56, str(x)) for x in named)


def test_tree_finds_all_pairs_of_the_bound():
    rng = np.random.default_rng(1)
    points = np.concatenate([rng.poisson(3, (60, jaccard.GROUPS)), np.repeat(rng.poisson(3, (5, jaccard.GROUPS)), 8, 0)])
    points[60:, :4] += rng.integers(0, 3, (40, 4))
    sizes, rows = points.sum(1), np.arange(len(points))
    t = jaccard.Tree(rows, sizes, rows, points)
    got = {tuple(sorted(p)) for f in jaccard.tree_join(t, t) for p in zip(t.rows[f[:, 0]].tolist(), t.rows[f[:, 1]].tolist())}
    want = {(a, b) for b in range(len(points)) for a in range(b) if np.minimum(points[a], points[b]).sum() >= jaccard.least_overlap(sizes[a], sizes[b]) and 100 * min(sizes[a], sizes[b]) >= 80 * max(sizes[a], sizes[b])}
    assert got == want and len(got) > 20


def test_components_of_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(100, 400)] + [(7, k) for k in range(8, 60)] + [(5, 5)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[k] == 100 for k in range(100, 401)) and all(got[k] == 7 for k in range(7, 60)) and 5 not in got
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# 7


def test_passages_that_repeat_are_found(spark):
    rng = random.Random(9)
    shared = [prose(60, rng), prose(55, rng), prose(120, rng)]
    texts = [*ODD, *(prose(rng.randint(60, 200), rng) for _ in range(15))]
    clean = {i for i in range(len(ODD), len(texts))}
    spans = {}
    for s in shared:
        for _ in range(4):
            head = prose(rng.randint(10, 90), rng)
            spans[len(texts)] = (len(head.split()), len(head.split()) + len(s.split()))
            texts.append(head + " " + s + " " + prose(rng.randint(10, 90), rng))
    near = len(texts)
    texts += [edited(shared[2], 2, rng), prose(45, rng) + " " + prose(3, rng)]
    whole = len(texts)
    texts += [prose(70, rng)] * 3
    rows = passages.repeated_passages(table(spark, texts)).collect()
    found = {}
    for r in rows:
        found.setdefault(r["doc_id"], []).append((r["start_word"], r["end_word"], r["class_id"]))
    for i, (a, b) in spans.items():
        assert any(x <= a and b <= y for x, y, _ in found[i])
    assert near in found and not clean & set(found)
    assert {found[k][0] for k in range(whole, whole + 3)} == {(0, 70, whole)}
    ids = {i: {c for _, _, c in found[i]} for i in spans}
    assert all(ids[i] == ids[min(spans) + 4 * ((i - min(spans)) // 4)] for i in spans)
    assert passages.repeated_passages(table(spark, [None, "a b"])).count() == 0


def test_passages_with_a_replaced_word_are_verified():
    rng = np.random.default_rng(4)

    def tokens(words):
        return np.array([hash(tuple(words[i : i + 5])) & 0xFFFFFFFF for i in range(len(words) - 4)], np.uint32)

    def similarity(a, b):
        return len(np.intersect1d(a, b)) / len(np.union1d(a, b))

    for n in (50, 52, 55, 60, 65, 70, 75):
        for at in range(n):
            a = rng.integers(0, 10**9, n).tolist()
            b = [*a[:at], -1, *a[at + 1 :]]
            assert similarity(tokens(a), tokens(b)) >= 0.8
            for around in (0, 30):
                sides = rng.integers(0, 10**9, (4, around)).tolist()
                x, y = tokens(sides[0] + a + sides[1]), tokens(sides[2] + b + sides[3])
                got = passages.passages(x, y)
                assert got, (n, at, around)
                for i, j, k, m in got:
                    assert min(j - i, m - k) >= 50 and similarity(x[i : j - 4], y[k : m - 4]) >= 0.8
                assert around or max(j - i for i, j, _, _ in got) >= n - 5
    a, (b, c, d, e) = rng.integers(0, 10**9, 44).tolist(), rng.integers(0, 10**9, (4, 40)).tolist()
    assert passages.passages(tokens(b + a + c), tokens(d + a + e)) == []  # too little for 50 words


def test_near_passages_are_found_as_brute_force_finds_them(spark):
    """Groups of passages with words replaced: 0.95 of the words and pairs at least that a comparison of all pairs gives."""
    rng = random.Random(31)
    sets = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    texts, groups = [], []
    for _ in range(25):
        base, own = prose(rng.randint(52, 110), rng).split(), []
        for _ in range(rng.choice([2, 3, 6, 25])):
            w = edited(" ".join(base), rng.randint(0, 3), rng).split()
            head = prose(rng.randint(1, 90), rng).split()
            own.append((len(texts), len(head), len(head) + len(w), sets(w)))
            texts.append(" ".join([*head, *w, *prose(rng.randint(1, 90), rng).split()]))
        groups.append(own)
    clean = len(texts)
    texts += [prose(rng.randint(60, 200), rng) for _ in range(60)]
    found = {}
    for r in passages.repeated_passages(table(spark, texts)).collect():
        found.setdefault(r["doc_id"], []).append((r["start_word"], r["end_word"], r["class_id"]))
    words = covered = pairs = joined = 0
    for own in groups:
        alike = [(x, y) for x in own for y in own if x[0] < y[0] and 100 * len(x[3] & y[3]) >= 80 * len(x[3] | y[3])]
        for i, a, b, _ in {x[0]: x for p in alike for x in p}.values():
            words += b - a
            covered += len({k for s, e, _ in found.get(i, []) for k in range(max(s, a), min(e, b))})
        for x, y in alike:
            pairs += 1
            joined += bool({c for *_, c in found.get(x[0], [])} & {c for *_, c in found.get(y[0], [])})
    assert pairs > 500 and covered >= 0.95 * words and joined >= 0.95 * pairs
    assert not [i for i in found if i >= clean]


def test_passages_around_a_line_of_all_texts(spark):
    """Passages that differ only beside a line that all texts have are no neighbours in its runs, and yet all are found."""
    rng = random.Random(2)
    words = lambda n: [f"w{rng.randrange(20000)}" for _ in range(n)]
    line, texts = words(44), []
    for _ in range(100):
        own = words(4) + line + words(4)
        texts += [" ".join(words(60) + own + words(60)) for _ in range(2)]
    found = {}
    for r in passages.repeated_passages(table(spark, texts)).collect():
        found.setdefault(r["doc_id"], set()).add(r["class_id"])
    assert all(found.get(i, set()) & found.get(i + 1, set()) for i in range(0, 200, 2))


def test_passages_a_short_line_of_all_texts_makes_no_links(spark, monkeypatch):
    """Windows meet around a line of 30 words, but what is beside it is of one text, so that no pair of texts is joined for it."""
    rng = random.Random(3)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    line, rest, given = words(30), passages.rest_links, []
    pair = words(60)
    texts = [" ".join(words(60) + line + words(60) + (pair if i < 2 else [])) for i in range(120)]
    monkeypatch.setattr(passages, "rest_links", lambda *args: given.append(rest(*args)) or given[0])
    found = passages.repeated_passages(table(spark, texts)).collect()
    assert sorted(r["doc_id"] for r in found) == [0, 1]
    assert len(given) == 1 and (given[0] is None or given[0].count() < 120)


def test_passages_leave_two_tables(spark, monkeypatch, tmp_path):
    """What is stored on the way goes when nothing reads it any more; the result reads the texts' fingerprints and the passages."""
    from factloom.sources import scratch

    rng = random.Random(2)
    words = lambda n: [f"w{rng.randrange(20000)}" for _ in range(n)]
    line, texts = words(44), []
    for _ in range(12):
        own = words(4) + line + words(4)
        texts += [" ".join(words(60) + own + words(60)) for _ in range(2)]
    monkeypatch.setattr(scratch, "folder", lambda spark: str(tmp_path))
    found = passages.repeated_passages(table(spark, texts))
    assert {p.name.partition("-")[0] for p in tmp_path.iterdir()} == {"texts", "final"}
    classes = {}
    for r in found.collect():
        classes.setdefault(r["doc_id"], set()).add(r["class_id"])
    assert all(classes.get(i, set()) & classes.get(i + 1, set()) for i in range(0, 24, 2))


def test_compact_windows_stand_for_all_stretches():
    rng = np.random.default_rng(2)
    tokens = np.append(rng.integers(0, 40, 150).astype(np.uint64), np.uint64(0))
    c, left, right = passages.compact_windows(tokens, np.array([150]), 0, least=10)
    h = passages.textbuf.mix64(tokens ^ passages._SEEDS[0]) | np.uint64(1 << 63)  # as the keys are ordered
    for i in range(150):
        for j in range(i + 9, 150):
            inside = [k for k in range(len(c)) if left[k] <= i <= c[k] <= j <= right[k]]
            assert len(inside) == 1 and h[c[inside[0]]] >> np.uint64(20) == h[i : j + 1].min() >> np.uint64(20)


# 8


def test_nearest_recall_and_odd_vectors(spark):
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding").where("vec_id < 1200")
    v = {r["vec_id"]: r["embedding"] for r in e.collect()}
    odd = spark.createDataFrame([(5000, None), (5001, [0.0] * 64), (5020, [float("nan")] * 64), (5040, [1.0, None] * 32), (5060, [1.0, 2.0]), (5080, [])], "vec_id long, embedding array<float>")
    same = spark.createDataFrame([(6000 + k, v[0]) for k in range(50)], "vec_id long, embedding array<float>")
    rows = e.union(odd).union(same).withColumn("query", F.lit(1)).repartition(3)
    got = {}
    for r in ann.nearest(rows, F.col("id") % 20 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["id"], r["score"]))
    v |= {6000 + k: v[0] for k in range(50)}
    ids, x = np.array(sorted(v)), np.array([v[k] for k in sorted(v)], np.float64)
    queries_ = [k for k in v if k % 20 == 0]
    assert sorted(got) == sorted(queries_)
    hit = 0
    for k in queries_:
        s = x @ np.array(v[k], np.float64)
        best = [i for i in ids[np.lexsort((ids, -np.round(s, 12)))] if i != k][:20]
        own = sorted(got[k])
        assert [r for r, _, _ in own] == list(range(1, 21)) and [i for _, i, _ in own] == [i for _, i, _ in sorted(own, key=lambda t: (-t[2], t[1]))]
        hit += len({i for _, i, _ in own} & set(best))
    assert hit / 20 / len(queries_) >= 0.9
    assert sorted(i for _, i, _ in got[6000]) == [0, *range(6001, 6020)]
    assert ann.nearest(odd, F.col("id") % 20 == 0).count() == 0


def test_nearest_ties_go_to_smaller_ids(spark):
    rows = [(0, [1.0, 0.0]), *((k, [0.5, k / 1000]) for k in range(1, 101)), *((k, [0.5, 0.05]) for k in range(200, 230)), (300, [0.4, 0.0])]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    got = sorted((r["rank"], r["id"], r["score"]) for r in ann.nearest(docs, F.col("id") == 0).collect())
    assert got == [(k, k, 0.5) for k in range(1, 21)]


def test_nearest_recall_where_lists_outnumber_probes(spark, monkeypatch):
    monkeypatch.setattr(ann, "LIST_ROWS", 8)
    monkeypatch.setattr(ann, "CHECKED", 64)
    x = np.random.default_rng(11).normal(size=(6000, 48))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    got = {}
    for r in ann.nearest(rows, F.col("id") % 20 == 0).collect():
        got.setdefault(r["query_id"], set()).add(r["id"])
    hit = 0
    for k in range(0, 6000, 20):
        s = x @ x[k]
        s[k] = -2
        hit += len(got[k] & set(np.argsort(-s)[:20].tolist()))
    assert hit / 20 / 300 >= 0.9


# 9


def test_shards(spark):
    docs = table(spark, ODD * 30)
    w = [1.0] * 24
    out = by_id(sharding.shard_documents(docs, w, [*w, 1.0]))
    slots = {}
    for i, t in enumerate(ODD * 30):
        r = out[i]
        raw = (t or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 8, zlib.crc32(raw))
        assert r["grown_shard"] in (r["shard"], 24)
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    big = spark.range(20_000).select(sharding.rendezvous(F.col("id"), [1.0, 3.0]).alias("s")).groupBy("s").count().collect()
    share = {r["s"]: r["count"] for r in big}
    assert abs(share[1] / 20_000 - 0.75) < 0.02
    with pytest.raises(ValueError):
        sharding.rendezvous(F.lit(1), [0.0])
    assert sharding.shard_documents(docs.limit(0), w).count() == 0


def test_shards_of_rows_without_ids(spark):
    rows = [(None, f"t{k % 7}") for k in range(9000)] + [(5, f"u{k}") for k in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    one, two = (sharding.shard_documents(d, [1.0] * 24, [1.0] * 25).collect() for d in (docs, docs.repartition(3)))
    assert sorted(map(str, one)) == sorted(map(str, two)) and len(one) == 10_000
    slots = {}
    for r in one:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert len(slots) <= 2 and all(sorted(s) == list(range(len(s))) for s in slots.values())


# 10

ASSIGN = re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base_spans(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(out))


def der(tag, body):
    n = len(body)
    size = bytes([n]) if n < 128 else bytes([0x81, n]) if n < 256 else bytes([0x82]) + n.to_bytes(2, "big")
    return bytes([tag]) + size + body


def sized(x):
    return len(x).to_bytes(4, "big") + x


def test_keys_in_all_their_forms():
    oid = lambda x: der(6, bytes.fromhex(x))
    pkcs8 = der(0x30, der(2, b"\x00") + der(0x30, oid("2b6570")) + der(4, der(4, bytes(range(32)))))
    sealed = der(0x30, der(0x30, oid("2a864886f70d01050d") + der(0x30, der(4, bytes(16)))) + der(4, bytes(range(160))))
    public = der(0x30, der(0x30, oid("2a8648ce3d0201") + oid("2a8648ce3d030107")) + der(3, b"\x00\x04" + bytes(range(64))))
    many = der(0x30, der(2, b"\x00") + b"".join(der(2, b"\x01" + bytes(9)) for _ in range(90)))
    ssh = b"openssh-key-v1\0" + sized(b"none") * 2 + sized(b"") + (1).to_bytes(4, "big") + sized(bytes(range(51))) + sized(bytes(range(144)))
    for raw, kind in ((pkcs8, "private_key"), (sealed, "private_key"), (public, "public_key"), (many, "private_key"), (ssh, "private_key")):
        full = base64.b64encode(raw).decode()
        url = base64.urlsafe_b64encode(raw).decode()
        lines = [full[k : k + 64] for k in range(0, len(full), 64)]
        forms = [full, full.rstrip("="), url.rstrip("="), "\n".join(lines), "\r\n".join(lines), "\n    ".join(lines), "\\n".join(lines)]
        for form in forms:
            for before, after in (("", ""), ("key ", " end"), ("-----BEGIN PRIVATE KEY-----\n", "\n-----END PRIVATE KEY-----"), ("x: ", "\nNext line"), ('"-----\\n', '\\n-----"'), ("MNOPQRSTUVWXYZabcdef\n", ",")):
                got = [x for x in secrets.scan(before + form + after) if x[0] not in secrets.BASE]
                assert got == [(kind, len(before), len(before + form))], (kind, form, before)
        broken = full[:-8]
        assert not [x for x in secrets.scan(broken) if x[0] not in secrets.BASE]
        assert not [x for x in secrets.scan(full.rstrip("=") + "AAAAAAAA") if x[0] not in secrets.BASE]


def test_secrets(spark):
    number = lambda n: der(2, b"\x01" + bytes(range(n)))
    rsa = der(0x30, der(2, b"\x00") + b"".join(number(n) for n in (120, 2, 120, 60, 60, 60, 60, 60)))
    pkcs8 = der(0x30, der(2, b"\x00") + der(0x30, der(6, bytes.fromhex("2b6570"))) + der(4, der(4, bytes(32))))
    url = lambda x: base64.urlsafe_b64encode(json.dumps(x).encode()).decode().rstrip("=")
    jwt = f"{url({'alg': 'HS256', 'typ': 'JWT'})}.{url({'sub': '1'})}.c2ln"
    wrapped = "\n".join(base64.b64encode(rsa).decode()[k : k + 64] for k in range(0, 800, 64))
    texts = [*ODD, "é password = hunter22, token: abc secret=", "TOKEN:'abcdefg", "ſecret: abcdefgh", "secret: token: abcdefgh", "api_key=" + "a" * 30 + " AKIA" + "Q7" * 8 + " AKIASHORT", "deadbeef" * 4, f"key {wrapped} end", "k " + base64.b64encode(pkcs8).decode(), pkcs8.hex(), jwt, jwt.replace("eyJ", "eyK", 1), "M" * 60]
    out = by_id(secrets.find_secrets(table(spark, texts)))
    kinds = {}
    for i, t in enumerate(texts):
        spans = [(s["kind"], s["start"], s["end"]) for s in out[i]["secrets"]]
        assert ",".join(f"{k}:{a}:{b}" for k, a, b in spans if k in secrets.BASE) == base_spans(t or "")
        kinds[i] = {k for k, _, _ in spans} - set(secrets.BASE)
    n = len(ODD)
    assert kinds[n + 6] == {"private_key"} and kinds[n + 7] == {"private_key"} and kinds[n + 8] == {"private_key"} and kinds[n + 9] == {"signed_token"}
    assert not any(kinds[i] for i in range(len(texts)) if i not in (n + 6, n + 7, n + 8, n + 9))
    masked = by_id(secrets.mask_secrets(table(spark, texts)))
    assert masked[0]["text"] is None and "hunter22" not in masked[n]["text"] and masked[n + 9]["text"] == "[SECRET]" and masked[10]["text"] == texts[10]


def test_warc_records_go_on_as_long_as_they_say(spark, tmp_path):
    def record(content, n=None, more=b""):
        return b"WARC/1.1\r\nWARC-Type: response\r\nContent-Type: application/http\r\n" + more + b"Content-Length: " + str(len(content) if n is None else n).encode() + b"\r\n\r\n" + content + b"\r\n\r\n"

    inner = b"WARC/1.0\r\nWARC-Type: fake\r\nContent-Length: 99999\r\n\r\n"
    http = lambda body, kind=b"text/plain": b"HTTP/1.1 200 OK\r\nContent-Type: " + kind + b"\r\n\r\n" + body
    bodies = [b"first", b"holds \r\n\r\n" + inner + b" and \r\n\r\n" + inner + b"end", "café ’".encode(), b""]
    latin = http("café".encode("latin-1"), b"text/html; charset=ISO-8859-1")
    parts = [record(http(b)) for b in bodies] + [record(latin, more=b"WARC-Payload-Digest: sha1:ABC\r\n")]
    (tmp_path / "a.warc").write_bytes(b"".join(parts))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(p) for p in parts))
    (tmp_path / "c.warc").write_bytes(parts[0] + record(http(b"cut"), 5000))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200b")
    try:
        rows = warc.read_warc(spark, str(tmp_path / "*.warc*")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    for name in ("a.warc", "b.warc.gz"):
        own = [r for r in rows if r["source"].endswith(name)]
        assert sorted(bytes(r["payload_bytes"]) for r in own) == sorted([*bodies, "café".encode("latin-1")]) and not any(r["truncated"] for r in own)
        assert {r["payload"] for r in own} >= {"café", "café ’", ""}
        assert {r["payload_digest"] for r in own} == {"sha1:ABC", *("sha256:" + hashlib.sha256(b).hexdigest() for b in bodies)}
    assert sorted(r["truncated"] for r in rows if r["source"].endswith("c.warc")) == [False, True]


def test_passages_of_rows_without_ids(spark):
    rng = random.Random(12)
    base = prose(120, rng).split()
    texts = []
    for _ in range(400):  # near copies of one text, each with a word of its own
        w = list(base)
        w[rng.randrange(20, 100)] = "own" + str(rng.random())
        texts.append(" ".join(w))
    rows = spark.createDataFrame([(None if i % 2 else 7, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    begin = time.perf_counter()
    out = passages.repeated_passages(rows).collect()
    assert len(out) == 400 and time.perf_counter() - begin < 90
