"""Quality classification by naive Bayes support vectors.

The features of a text are indicators of word unigrams and bigrams, hashed; runs
of letters and digits and runs of other printing bytes are words, case kept, and
a word followed by itself is one bigram whatever the word. An indicator is scaled by its class log-count ratio, texts are scaled to unit
length, and a linear hinge-loss model is fitted by dual coordinate descent. A
logistic curve on rows kept out of the descent turns margins into scores.

Defined results: null and empty texts have no features and get the score of a
zero vector. Repeated rows are scored each; of repeated labels any one row
counts as often as it is there. An empty table gives no rows. Without labelled
rows of both classes every text gets one score, the smoothed share of class 1.
Other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbuf

BITS = 18
#: The bound of the training sample: labelled rows, characters of a row.
ROWS = 6_000
MAX_SAMPLE_CHARS = 20_000
SMOOTHING = 1.0
COST = 1.0
CUT = 0.3

#: All bigrams of a word and the same word are one feature.
REPEATED = np.uint64(1 << 63)

_KIND = np.ones(256, np.uint8) * 2
_KIND[np.frombuffer(b" \t\n\x0b\x0c\r", np.uint8)] = 0
_KIND[48:58] = _KIND[65:91] = _KIND[97:123] = _KIND[128:] = 1


@dataclass
class Model:
    weights: np.ndarray  # margin of a present n-gram, ratio included
    squares: np.ndarray  # its share of the squared length
    bias: float
    slope: float
    shift: float


def features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram buckets of each text, as (text, bucket) in order."""
    h, _, firsts = textbuf.run_hashes(data, off, _KIND[data])
    own = np.repeat(np.arange(len(off) - 1, dtype=np.int64), np.diff(firsts))
    pairs = textbuf.ngram_hashes(h, 2)
    pairs[h[1:] == h[: len(pairs)]] = REPEATED
    same = own[: len(pairs)] == own[1:]
    keys = np.concatenate([own << BITS | (h >> np.uint64(64 - BITS)).astype(np.int64), (own[: len(pairs)] << BITS | (pairs >> np.uint64(64 - BITS)).astype(np.int64))[same]])
    keys = np.unique(keys)
    return keys >> BITS, keys & ((1 << BITS) - 1)


def descend(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, cost: float = COST, epochs: int = 12, seed: int = 3) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the L2-regularised squared hinge loss; the bias is a constant feature."""
    rng = np.random.default_rng(seed)
    w, bias = np.zeros(len(ratio)), 0.0
    xs = [(k, ratio[k] / max(1e-12, np.sqrt((ratio[k] ** 2).sum()))) for k in rows]
    alpha, diag = np.zeros(len(rows)), 1 / (2 * cost)
    q = 1.0 + 1.0 + diag  # unit length, the constant, the loss
    for _ in range(epochs):
        most = 0.0
        for i in rng.permutation(len(rows)):
            k, x = xs[i]
            g = y[i] * (x @ w[k] + bias) - 1 + diag * alpha[i]
            new = max(alpha[i] - g / q, 0.0)
            if (d := (new - alpha[i]) * y[i]) != 0:
                w[k] += d * x
                bias += d
                most = max(most, abs(d))
                alpha[i] = new
        if most < 1e-3:
            break
    return w, bias


def _logistic(m: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the curve with the least log loss, by Newton's steps."""
    a, b, t = 1.0, 0.0, np.where(y > 0, (np.sum(y > 0) + 1) / (np.sum(y > 0) + 2), 1 / (np.sum(y < 0) + 2))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -35, 35)))
        g = np.array([((p - t) * m).sum(), (p - t).sum()])
        v = p * (1 - p) + 1e-9
        hess = np.array([[(v * m * m).sum() + 1e-6, (v * m).sum()], [(v * m).sum(), v.sum() + 1e-6]])
        d = np.linalg.solve(hess, g)
        a, b = a - d[0], b - d[1]
        if abs(d).max() < 1e-9:
            break
    return float(a), float(b)


def train(rows: list[np.ndarray], y: np.ndarray) -> Model:
    """rows: distinct buckets of each text; y: 1 or -1. Every fourth row calibrates."""
    held = np.arange(len(rows)) % 4 == 3
    if len({*y[~held]}) < 2 or len({*y[held]}) < 2:
        held[:] = False
    if len({*y[~held]}) < 2:
        share = (np.sum(y > 0) + 1) / (len(y) + 2)
        return Model(np.zeros(1 << BITS, np.float32), np.ones(1 << BITS, np.float32), 0.0, 1.0, float(np.log(share / (1 - share))))
    pos, neg = (np.bincount(np.concatenate([rows[i] for i in np.flatnonzero(~held & (y == c))]), minlength=1 << BITS) + SMOOTHING for c in (1, -1))
    ratio = np.log(pos / pos.sum()) - np.log(neg / neg.sum())
    fit = np.flatnonzero(~held)
    w, bias = descend([rows[i] for i in fit], y[fit], ratio)
    check = np.flatnonzero(held) if held.any() else fit
    margin = np.array([w[rows[i]] @ ratio[rows[i]] / max(1e-12, np.sqrt((ratio[rows[i]] ** 2).sum())) + bias for i in check])
    slope, shift = _logistic(margin, y[check])
    return Model((w * ratio).astype(np.float32), (ratio**2).astype(np.float32), bias, slope, shift)


def sample(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text: str = "text") -> tuple[list[np.ndarray], np.ndarray]:
    """Features and classes of a sample of labelled rows with the module's bounds, chosen by a hash of the id.

    The chosen labels, at most ROWS, are broadcast; texts don't move.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(label).alias("_y"))
    few = F.broadcast(known.orderBy(F.xxhash64(F.col("_id").cast("string"), F.lit("sample")), "_id", "_y").limit(ROWS))

    @F.arrow_udf("array<int>")
    def buckets(texts: pa.Array) -> pa.Array:
        out = []
        data, off = textbuf.buffers(texts)
        for i in range(len(off) - 1):
            out.append(features(data[off[i] : off[i + 1]], np.array([0, off[i + 1] - off[i]]))[1].astype(np.int32))
        return pa.array(out, pa.list_(pa.int32()))

    at = docs.where(F.length(text) <= MAX_SAMPLE_CHARS).join(few, F.col(id_col) == F.col("_id")).select("_id", "_y", F.xxhash64(F.col("_id").cast("string"), F.lit("order")).alias("_h"), buckets(F.col(text)).alias("_k"))
    got = at.limit(2 * ROWS).toArrow().sort_by([("_h", "ascending"), ("_id", "ascending")])
    ks = got["_k"].combine_chunks()
    return [np.asarray(x.values) for x in ks], np.where(np.asarray(got["_y"].combine_chunks()) == 1, 1, -1)


def scorer(spark, model: Model):
    """A column function from text to the score, 0 to 1."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        for texts in batches:
            data, off = textbuf.buffers(texts)
            out = [np.zeros(0)]
            for i, j in textbuf.chunks(off):
                own, k = features(data[off[i] : off[j]], off[i : j + 1] - off[i])
                length = np.sqrt(np.bincount(own, m.squares[k], j - i))
                margin = np.bincount(own, m.weights[k], j - i) / np.maximum(length, 1e-12) + m.bias
                out.append(1 / (1 + np.exp(-np.clip(m.slope * margin + m.shift, -35, 35))))
            yield pa.array(np.concatenate(out))

    return score


def score_documents(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """Adds the score of each whole text; a column named ``out`` is replaced."""
    return docs.withColumn(out, scorer(docs.sparkSession, model)(F.col(text)))
