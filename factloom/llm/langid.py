"""Language identification by averaged hashed subword embeddings.

A text is lower-cased; every run of bytes that are no letters becomes one word
border. The byte n-grams of 2 to 5 bytes within words, borders included, are
hashed to rows of an embedding table. A text's vector is the mean of the rows
of its n-grams, and a linear softmax over it gives the languages. The table and
the softmax are trained together by stochastic gradient descent in numpy, on a
bounded sample of labelled rows. Scores are calibrated by a temperature, fitted
on rows kept out of the descent, and a prediction is rejected below a score
that nearly all right predictions among those rows reach.

Defined results: null texts and texts without a letter get ``und``, score 0 and
are rejected. Repeated rows are predicted each. An empty table gives no rows. With
no labelled row to learn from, every text gets ``und`` with score 0, and only those
without a letter are rejected. Other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textbuf

BUCKET_BITS = 15
DIM = 16
SIZES = (2, 3, 4, 5)
UNKNOWN = "und"
#: The bound of the training sample: rows of each label, fewer where labels are many, rows in all, least rows of a label, characters of a row.
ROWS_PER_LABEL = 500
MAX_ROWS, LEAST_ROWS = 32_000, 20
MAX_SAMPLE_CHARS = 20_000
#: Share of right predictions on the calibration rows, passages of two words among them, that may be rejected.
MAX_REJECTED = 0.001

#: Bytes that belong to words: a-z and all of non-ASCII letters (UTF-8).
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_LETTER[128:] = True


@dataclass
class Model:
    labels: list[str]
    table: np.ndarray  # buckets x labels: embeddings times softmax weights
    bias: np.ndarray
    temperature: float
    threshold: float


def _stream(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes with each run of non-letters as one border, and each text's start; texts have borders at both ends."""
    n = len(off) - 1
    pos = off[:-1] + 2 * np.arange(n)
    out = np.full(len(data) + 2 * n, 32, np.uint8)
    inner = np.ones(len(out), bool)
    inner[pos] = False
    inner[off[1:] + 2 * np.arange(n) + 1] = False
    out[inner] = data
    out[~_LETTER[out]] = 32
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != 32) | (out[:-1] != 32)
    keep[pos] = True
    count = np.concatenate([[0], np.cumsum(keep)])
    return out[keep], count[np.append(pos, len(out))]


def _grams(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams, with the text each belongs to."""
    s, starts = _stream(data, off)
    which = np.repeat(np.arange(len(off) - 1, dtype=np.int32), np.diff(starts))
    border, codes = s == 32, s.astype(np.uint32)
    buckets, owners = [], []
    h, clear = codes, np.ones(len(s), bool)
    for n in range(2, max(SIZES) + 1):
        if len(s) < n:
            break
        h = h[: len(s) - n + 1] * np.uint32(0x01000193) + codes[n - 1 :]
        clear = clear[: len(s) - n + 1]
        if n > 2:
            clear = clear & ~border[n - 2 : len(s) - 1]
        if n in SIZES:
            own = which[: len(h)]
            ok = clear & (own == which[n - 1 :])
            if n == 2:
                ok &= ~(border[:-1] & border[1:])
            k = (h[ok] ^ np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
            k ^= k >> np.uint32(15)
            buckets.append((k * np.uint32(0xC2B2AE35)) >> np.uint32(32 - BUCKET_BITS))
            owners.append(own[ok])
    if not buckets:
        return np.zeros(0, np.uint32), np.zeros(0, np.int32)
    return np.concatenate(buckets), np.concatenate(owners)


def _lower(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return textbuf.buffers(pc.utf8_lower(pc.fill_null(texts, "").cast(pa.large_string())))


def _features(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct buckets and their shares, for each text."""
    out = []
    for text in texts:
        b, _ = _grams(*_lower(pa.array([text])))
        k, c = np.unique(b, return_counts=True)
        out.append((k, (c / max(1, c.sum())).astype(np.float32)))
    return out


def train(texts: list[str], langs: list[str], seed: int = 7, epochs: int = 4, rate: float = 0.5) -> Model:
    """Fits on texts and on short passages of them; every fourth row calibrates."""
    if not texts:
        return Model([], np.zeros((1 << BUCKET_BITS, 0), np.float32), np.zeros(0, np.float32), 1.0, 0.0)
    rng = np.random.default_rng(seed)
    labels = sorted(set(langs))
    y_of = {x: i for i, x in enumerate(labels)}
    held = [i % 4 == 3 for i in range(len(texts))] if len(texts) >= 8 * len(labels) else [False] * len(texts)
    sets: dict[bool, list] = {False: [], True: []}
    for text, lang, h in zip(texts, langs, held, strict=True):
        tokens = text.split()
        some = [text] + [" ".join(tokens[a : a + n]) for n in (2, 6, 20) if len(tokens) > n for a in [int(rng.integers(len(tokens) - n))]]
        sets[h] += [(f, y_of[lang]) for f in _features(some) if len(f[0])]
    emb = rng.normal(0, 1 / DIM, (1 << BUCKET_BITS, DIM)).astype(np.float32)
    out, bias = np.zeros((DIM, len(labels)), np.float32), np.zeros(len(labels), np.float32)
    rows = sets[False]
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in rng.permutation(len(rows)):
            (k, share), y = rows[i]
            hidden = share @ emb[k]
            z = hidden @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            back = out @ p
            out -= step * np.outer(hidden, p)
            bias -= 0.1 * step * p
            emb[k] -= (step * min(len(k), 8.0) * share)[:, None] * back
    table = emb @ out
    check = sets[True] or rows
    z = np.array([share @ table[k] + bias for (k, share), _ in check])
    y = np.array([y for _, y in check])

    def scores(t: float) -> np.ndarray:
        e = np.exp((z - z.max(1, keepdims=True)) / t)
        return e / e.sum(1, keepdims=True)

    grid = np.geomspace(0.25, 8, 41)
    t = min(grid, key=lambda t: -np.log(scores(t)[np.arange(len(y)), y] + 1e-12).mean())
    s = scores(t)
    right = np.sort(s.max(1)[s.argmax(1) == y])
    at = float(right[int(MAX_REJECTED * len(right))]) if len(right) else 0.0
    return Model(labels, table.astype(np.float32), bias, float(t), at)


def sample(docs: DataFrame, lang: str = "lang", text: str = "text", id_col: str = "doc_id", where: Column | None = None) -> tuple[list[str], list[str]]:
    """Texts and labels of a sample with the module's bounds, chosen by a hash of the id."""
    rows = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull() & (F.length(text) <= MAX_SAMPLE_CHARS))
    if where is not None:
        rows = rows.where(where)
    rows = rows.select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit("sample")), F.lit(1 << 40)).alias("h"))
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_ROWS // LEAST_ROWS).collect()
    if not counts:
        return [], []
    most = min(ROWS_PER_LABEL, MAX_ROWS // len(counts))
    share = F.create_map(*[x for r in counts for x in (F.lit(r["lang"]), F.lit(int(min(1.0, 1.3 * most / r["count"]) * (1 << 40))))])
    got = rows.where(F.col("h") < share[F.col("lang")]).orderBy("h", "text").limit(2 * most * len(counts)).collect()
    seen: dict[str, int] = {}
    texts, langs = [], []
    for r in sorted(got, key=lambda r: (r["h"], r["text"])):
        seen[r["lang"]] = seen.get(r["lang"], 0) + 1
        if seen[r["lang"]] <= most:
            texts.append(r["text"])
            langs.append(r["lang"])
    return texts, langs


def _has_letter(lowered: bytes) -> bool:
    return any(c.isalpha() for c in lowered.decode("utf-8"))


def predictor(spark, model: Model):
    """A column function from text to struct(lang, score, rejected)."""
    shared = spark.sparkContext.broadcast(model)
    names = pa.array([*model.labels, UNKNOWN])

    @F.arrow_udf("struct<lang:string,score:double,rejected:boolean>")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        for texts in batches:
            data, off = _lower(texts)
            best, score, silent = [], [], []
            for i, j in textbuf.chunks(off):
                part, o = data[off[i] : off[j]], off[i : j + 1] - off[i]
                b, own = _grams(part, o)
                n = j - i
                counts = np.bincount(own, minlength=n)
                z = np.stack([np.bincount(own, m.table[b, k], n) for k in range(len(m.labels))] or [np.zeros(n)], 1)
                z = z / np.maximum(counts, 1)[:, None] + (m.bias if m.labels else 0)
                e = np.exp((z - z.max(1, keepdims=True)) / m.temperature)
                p = e / e.sum(1, keepdims=True)
                y, s = p.argmax(1), p.max(1) * bool(m.labels)
                ascii_letter = np.add.reduceat(np.append((part >= 97) & (part < 123), False), o[:-1]) if n else np.zeros(0)
                ascii_letter[np.diff(o) == 0] = 0
                mute = np.zeros(n, bool)
                for k in np.flatnonzero(ascii_letter == 0):
                    mute[k] = not _has_letter(part[o[k] : o[k + 1]].tobytes())
                y[mute], s[mute] = len(m.labels), 0.0
                best.append(y)
                score.append(s)
                silent.append(mute | (s < m.threshold))
            y, s, r = (np.concatenate([np.zeros(0, t), *x]) for x, t in ((best, np.int64), (score, float), (silent, bool)))
            yield pa.StructArray.from_arrays([names.take(pa.array(y)), pa.array(s), pa.array(r)], ["lang", "score", "rejected"])

    return predict


def identify(docs: DataFrame, model: Model, text: str = "text", out: str = "language") -> DataFrame:
    """Adds a struct of predicted language, calibrated score and rejection."""
    return docs.withColumn(out, predictor(docs.sparkSession, model)(F.col(text)))
