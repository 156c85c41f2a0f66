"""Ops 11 to 13 against brute force on small fixtures: nulls, empty and long texts, ties, repeats, empty tables, clashing names."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from factloom.llm import audit, merkle, perplexity, queries

from ..conftest import SF

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, size int, part string, model string, id string"
RNG = random.Random(9)


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([(*r, "clash", 1, "clash", "clash", "clash") for r in rows], schema).repartition(3)


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


# 13


def leaf(row):
    i, text, lang, source, n = row
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, text)))


def up(level):
    return [sha("".join(level[i : i + 3])) for i in range(0, len(level), 3)]


def whole(level):
    while len(level) > 1:
        level = up(level)
    return level[0]


def siblings(level, i):
    """(digests before, digests after) of each level."""
    out = []
    while len(level) > 1:
        a = i - i % 3
        out.append((level[a:i], level[i + 1 : a + 3]))
        level, i = up(level), i // 3
    return out


def brute_manifest(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[3]].append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    own = {s: sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for s in order}
    subs = {s: whole([leaf(r) for r in own[s]]) for s in order}
    out = []
    for k, s in enumerate(order):
        for i, r in enumerate(own[s]):
            path = siblings([leaf(x) for x in own[s]], i) + siblings([subs[x] for x in order], k)
            node = leaf((r[0], r[1].replace("\n", ""), *r[2:]) if r[1] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 else r)
            for a, b in path:
                node = sha("".join([*a, node, *b]))
            out.append((str(r[0]), leaf(r), subs[s], whole([subs[x] for x in order]), sha("".join("".join(a + b) for a, b in path)), node))
    return sorted(out)


def manifest(spark, rows):
    tampered = F.when(queries.remainder(2) == 0, F.replace(F.col("text"), F.lit("\n"), F.lit("")))
    out = merkle.manifest(frame(spark, rows), tampered).collect()
    return sorted((str(r["doc_id"]), *(bytes(r[c]).hex() for c in ("leaf", "subroot", "root", "proof", "folded"))) for r in out)


def test_merkle_manifest(spark):
    rows = [(i, f"line {i}\nline", "en", "big", i) for i in range(40)] + [(100 + i, "x\ny", None, f"s{i}", 3) for i in range(5)]
    rows += [(7, None, None, None, None), (8, "", "é", None, 0), (9, "-", "en", "é", 1), (None, "no id\n", "en", "big", 1), (None, "no id\n", "en", "big", 1), (3, "line 3\nline", "en", "big", 3), (50, "long\n" * 100_000, "en", "", 1)]
    got = manifest(spark, rows)
    assert got == brute_manifest(rows)
    assert any(a[5] != a[3] for a in got) and any(a[5] == a[3] for a in got)
    assert manifest(spark, rows[:1]) == brute_manifest(rows[:1])
    assert manifest(spark, []) == []


# 12


def brute_audit(rows, labels):
    texts = defaultdict(list)
    for i, text, *_ in rows:
        texts[text or ""].append(i)
    good, toxic = ({i for i, q, t in labels if i is not None and (q, t)[k] == 1} for k in (0, 1))
    docs = []
    for i, text, _, source, _ in rows:
        text = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        ids = [x for x in texts[text] if x is not None]
        fails = (len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), bool(re.search("[#$%&*|]", text)), i is not None and bool(ids) and i > min(ids))
        docs.append((source or "", {f for f, x in zip("ABCDE", fails, strict=True) if x}, i in good, i in toxic))
    out = {}
    for part in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == part]
        removed = Counter()
        for order in itertools.permutations("ABCDE"):
            for k, f in enumerate(order):
                here = [d for d in own if f in d[1] and not d[1] & set(order[:k])]
                removed[f] += len(here)
                out[part, "".join(order), k + 1] = [sum(not d[1] & set(order[: k + 1]) for d in own), len(here), sum(f in d[1] and bool(d[1] & set(order[:k])) for d in own), sum(d[1] == {f} for d in own), sum(d[2] for d in here), sum(d[3] for d in here)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(removed[order[step - 1]])
    return out


def audited(spark, rows, labels):
    out = audit.interactions(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    return {(r["part"], r["filter_order"], r["step"]): [r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")] for r in out}


def test_audit(spark):
    word = lambda: "".join(RNG.choice("abcdefgh") for _ in range(5))
    rows = [(None, "same", "en", "a", 1), (None, None, "en", None, None), (4, "", "en", "", 0), (5, "\x0b\n", "en", "a", 2), (6, "W" * 200_000, "en", "a", 1), (6, "W" * 200_000, "en", "a", 1)]
    for i in range(10, 60):
        text = " ".join(word() for _ in range(RNG.choice((20, 80)))) + RNG.choice(("", " #", " ABCDEFGHIJKLMNOPQRSTUVWXYZ")) + RNG.choice(("", " again" * 60))
        rows.append((i, text, "en", RNG.choice("ab"), 1))
        if i % 5 == 0:
            rows.append((i + 100, text, "en", "a", 1))
    labels = [(i, i % 2, i % 3 == 0 and 1 or 0) for i in range(0, 60, 2)] + [(10, 1, None), (None, 1, 1), (999, 1, 1)]
    assert audited(spark, rows, labels) == brute_audit(rows, labels)
    hot = [(i, "copy", "en", "a", 1) for i in range(40)]
    before, audit.HEAVY_SHARE = audit.HEAVY_SHARE, 0.2
    try:
        assert audited(spark, rows + hot, labels) == brute_audit(rows + hot, labels)
    finally:
        audit.HEAVY_SHARE = before
    assert audited(spark, [], labels) == {}
    assert all(x[4] == x[5] == 0 for x in audited(spark, rows, []).values())


# 11

ODD = [None, "", " ", "\n\t", "a", "É\n\nÉ", "日本語 テキスト", "ab " * 3000, "x" * 30000, "one\ntwo\none\n \n \none ", "\nq w e q w e\r\n\nq w e", "#*$%&|<> 5.,;:!?'\"()-/_~"]


def spelt(text):
    out = []
    for w in re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode()):
        out += [int(perplexity.ALPHABET[b]) for b in w] + [0]
    return out


def plain(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines, seen, dup = text.split("\n"), set(), 0
    for x in lines:
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    n = Counter(zip(w, w[1:], w[2:], strict=False))
    inside = {i + k for i in range(len(w) - 2) if n[w[i], w[i + 1], w[i + 2]] > 1 for k in range(3)}
    return [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside)]


class KneserNey:
    """Modified Kneser-Ney from dictionaries, by its published definition."""

    def __init__(self, texts, order):
        self.order, self.n = order, {}
        top = Counter()
        for t in texts:
            s = [0] * (order - 1) + spelt(t)
            top.update(tuple(s[i - order + 1 : i + 1]) for i in range(order - 1, len(s)))
        self.n[order] = top
        for k in range(order - 1, 0, -1):
            self.n[k] = Counter(g[1:] for g in self.n[k + 1])
        self.d, self.rest = {}, {}
        for k, n in self.n.items():
            c = [sum(v == i for v in n.values()) for i in range(5)]
            y = c[1] / (c[1] + 2 * c[2]) if c[1] else None
            self.d[k] = [0] + [min(i - 0.05, max(0.05, i - (i + 1) * y * c[i + 1] / c[i])) if y is not None and c[i] else (0.5, 1.0, 1.5)[i - 1] for i in (1, 2, 3)]
            total, taken = Counter(), defaultdict(float)
            for g, v in n.items():
                total[g[:-1]] += v
                taken[g[:-1]] += self.d[k][min(v, 3)]
            self.rest[k] = (total, taken)

    def p(self, gram):
        k = len(gram)
        if not k:
            return 1 / 64
        total, taken = self.rest[k]
        ctx = gram[:-1]
        if ctx not in total:
            return self.p(gram[1:])
        v = self.n[k].get(gram, 0)
        return max(0, v - self.d[k][min(v, 3)]) / total[ctx] + taken[ctx] / total[ctx] * self.p(gram[1:])

    def log_perplexity(self, text):
        s = [0] * (self.order - 1) + spelt(text)
        logs = [math.log(self.p(tuple(s[i - self.order + 1 : i + 1]))) for i in range(self.order - 1, len(s))]
        return -sum(logs) / len(logs) if logs else None


def prose(n, letters):
    return " ".join("".join(RNG.choice(letters) for _ in range(RNG.randint(1, 5))) for _ in range(n))


def test_perplexity_equals_the_definition(spark):
    texts = [(prose(60, "abcde"), "en") for _ in range(30)] + [(prose(60, "xyzé"), "fr") for _ in range(20)] + [(t, "en") for t in ODD] + [("qqq ww", "rare"), ("zz yy", None), ("pp", "*")]
    rows = [(i % 40, t, lang, "s", 1) for i, (t, lang) in enumerate(texts)]
    docs = frame(spark, rows)
    model = perplexity.train(docs)
    assert set(model.arrays) == {"en", "fr", perplexity.POOLED}
    own = {m: KneserNey([t for t, lang in texts if m in (lang, perplexity.POOLED)], perplexity.ORDER) for m in model.arrays}
    unseen = [(prose(30, "abcdefg12.é漢"), lang) for lang in ("en", "fr", "de", None)]
    for many in (texts, unseen):
        got = perplexity.measured(frame(spark, [(i, t, lang, "s", 1) for i, (t, lang) in enumerate(many)]), model).collect()
        assert len(got) == len(many)
        for r in got:
            t, lang = many[r["doc_id"]]
            assert [r[c] for c in perplexity.COUNTS] == plain(t)
            want = own[lang if lang in ("en", "fr") else perplexity.POOLED].log_perplexity(t)
            assert r["log_perplexity"] is None if want is None else math.isclose(r["log_perplexity"], want, rel_tol=1e-5)
    assert perplexity.judged(docs.limit(0)).count() == 0


def test_task_hands_on_counts_in_parts(spark):
    rows = [(i, prose(200, "abcdefghij"), "en", "s", 1) for i in range(20)]
    docs = frame(spark, rows)
    want = sorted(map(tuple, perplexity.counts(docs).collect()))
    batch = docs.select("lang", "text").toArrow().to_batches()[0]
    before, perplexity.HELD = perplexity.HELD, 50
    try:
        total = Counter()
        for out in perplexity._counter(perplexity.ORDER)(iter([batch] * 3)):
            for lang, code, n in zip(*(c.to_pylist() for c in out.columns), strict=True):
                total[lang, code] += n
    finally:
        perplexity.HELD = before
    keys, n = zip(*((w[1], w[2]) for w in want), strict=True)
    own = Counter()
    for text in batch.column(1).to_pylist():
        raw = [0] * (perplexity.ORDER - 1) + spelt(text)
        own.update(sum(x << 6 * k for k, x in enumerate(reversed(raw[i - 3 : i + 1]))) for i in range(3, len(raw)))
    assert {k: v // 3 for (_, k), v in total.items()} == own and set(own) <= set(keys) and sum(n) >= sum(own.values())


def test_bands_reject_both_sides(spark):
    word = ["".join(RNG.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    rows = [(i, " ".join(RNG.choice(word) for _ in range(150)), "en", "s", 1) for i in range(300)]
    rows += [(1000, " ".join("".join(RNG.choice("qjxzvk0") for _ in range(8)) for _ in range(300)), "en", "s", 1), (1001, " ".join(["a", "b", "aa", "bb", "ab"][RNG.randrange(5)] for _ in range(40)), "en", "s", 1), (1002, None, "en", "s", 1)]
    got = {r["doc_id"]: r for r in perplexity.judged(frame(spark, rows)).collect()}
    assert all(got[i]["kept"] for i in range(300))
    assert not got[1000]["base_failed"] and not got[1000]["kept"] and got[1001]["base_failed"] and not got[1001]["kept"] and not got[1002]["kept"]
    narrow = perplexity.judged(frame(spark, rows), widths=(0.5, 9.0)).where("NOT kept AND NOT base_failed AND log_perplexity < low").count()
    assert narrow > 0


def test_op11(spark):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    out = queries.op11_perplexity(spark, SF).collect()
    own = {x: KneserNey([r["text"] for r in docs.values() if r["lang"] == x], perplexity.ORDER) for x in {r["lang"] for r in docs.values()}}
    assert len(out) == len(docs)
    logs = defaultdict(list)
    for r in out:
        text = docs[r["doc_id"]]["text"]
        n = plain(text)
        failed = n[0] < 50 or 100 * n[4] > 50 * n[0]
        assert [r[c] for c in perplexity.COUNTS] == n and r["base_failed"] == failed
        x = own[docs[r["doc_id"]]["lang"]].log_perplexity(text)
        assert (x is None and r["log_perplexity"] is None) or math.isclose(r["log_perplexity"], x, rel_tol=1e-5)
        if not failed:
            logs[docs[r["doc_id"]]["lang"]].append(round(r["log_perplexity"], 3))
    band = {}
    for lang, xs in logs.items():
        half = lambda v: sorted(v)[math.ceil(len(v) / 2) - 1]
        band[lang] = half(xs), max(perplexity.LEAST_DEVIATION, 1.4826 * half([round(abs(x - half(xs)), 3) for x in xs]))
    for r in out:
        if r["base_failed"]:
            assert not r["kept"]
        else:
            d = docs[r["doc_id"]]
            middle, apart = band[d["lang"]]
            reach = apart * np.sqrt(1 + perplexity.SHORT / len(spelt(d["text"])))
            assert r["kept"] == (middle - perplexity.WIDTHS[0] * reach <= r["log_perplexity"] <= middle + perplexity.WIDTHS[1] * reach)


# linear time of ops 1 and 10, and ids that are null


def seconds(run):
    import time

    begin = time.perf_counter()
    run()
    return time.perf_counter() - begin


def test_long_pieces_and_key_like_lines_take_time_in_proportion():
    from factloom.llm import bpe, secrets

    ranks = bpe.Ranks(open(queries.VOCABULARY, "rb").read(), queries.PATTERN)
    piece = "".join(RNG.choice("abcdefgh") for _ in range(4_000_000))
    short = min(seconds(lambda: ranks.encode_piece(piece[:500_000])) for _ in range(2))
    assert seconds(lambda: ranks.encode_piece(piece)) < 16 * short + 1
    for line in ("MIT/AAAAAAAAAAAAAAAA\n", "b3BlbnNzaC1rZXktdjEAAAAABG5vbmU\n"):
        short = min(seconds(lambda x=line: secrets.scan(x * 12_500)) for _ in range(2))
        assert seconds(lambda x=line: secrets.scan(x * 100_000)) < 16 * short + 1


def test_held_out_is_never_null(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = docs.limit(1).withColumn("doc_id", F.lit(None).cast("long"))
    docs.unionByName(odd).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    for q in (queries.op2_language_id, queries.op3_quality):
        out = q(spark, str(tmp_path))
        assert out.where("held_out IS NULL").count() == 0 and out.where("doc_id IS NULL").count() == 1
