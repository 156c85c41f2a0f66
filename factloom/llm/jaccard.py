"""N-gram Jaccard self-join by R-trees over count vectors.

A document's set is its distinct word shingles. The tokens of a set are hashed to
groups, and the counts of the groups are a point. Two sets can't overlap by more
than the sum of the smaller counts, so an R-tree over points, whose nodes hold the
largest count of each group and the range of sizes, yields all pairs that may be
similar. The pairs that remain are bounded again by count vectors of about as many
groups as tokens, and the rest is verified on the sets.

To spread the work, trees are built for blocks: a block has the documents that
share a token among the first fifth of their sets, in an order that puts tokens of
many documents last. Similar sets always share such a token. Equal sets are one
node. Of the blocks of one token that would have over BLOCK_ROWS documents, each
pair is joined, so no block grows with the data and no pair is lost.

A first round names for each document one partner of each block: the block's
first document if the bound allows it, or else the one that the tree finds with
the most room. Its most frequent partner is verified, then those of the others
that are in another component by then. A second round joins all blocks again for
pairs of different components only, without a cap. So groups
of copies cost a few links for each copy rather than all pairs.

Defined results: null texts and texts without words have empty sets, link with
nothing and are their own component. Equal texts are in one component. Rows with
equal or null ids are documents of their own; the smallest id that is not null
names a component. Empty tables give no rows. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import scratch, textbuf
from .components import components, near

SHINGLE = 5
#: Similarity of at least PERCENT / 100.
PERCENT = 80
GROUPS = 256
#: Buckets of tokens that are counted: about so many tokens in one, of so many bytes each, and bounds of their number.
BUCKET_TOKENS, WORD_BYTES, LEAST_BITS, MOST_BITS = 16, 7, 18, 24
BLOCK_ROWS = 20_000
LEAF = 16
#: Tokens that are dealt to one task, about.
PART_TOKENS = 500_000
#: A map task sends its tokens when it has so many.
FLUSH_TOKENS = 1_000_000
_CHUNK = 1 << 14
#: Pairs that are verified together.
CHUNK_PAIRS = 256
#: Texts to be verified, and blocks, that Python gets at once.
VERIFY_BATCH, BLOCK_BATCH = 500, 50
#: First tokens of a node that its blocks know.
HEADS = 3
#: Pairs with the most room that a block names for two components, and pairs that are tried of those.
NAMED, TRIED = 3, 4
_NONE = np.iinfo(np.int64).max


def token_sets(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    data, off = textbuf.buffers(texts)
    for i, j in textbuf.chunks(off):
        h, firsts = textbuf.words(data[off[i] : off[j]], off[i : j + 1] - off[i])
        for s in textbuf.shingles(h, firsts, n):
            yield np.unique(s)


def bucket_bits(docs: DataFrame, text: str) -> int:
    """Bits of so many buckets that about BUCKET_TOKENS tokens meet in one, within bounds."""
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return int(np.clip(np.ceil(np.log2(max(1, size / WORD_BYTES / BUCKET_TOKENS))), LEAST_BITS, MOST_BITS))


def bucket(tokens: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each token, by its highest bits."""
    return (tokens.view(np.uint64) >> np.uint64(65 - buckets.bit_length())).astype(np.int64)


def token_counts(docs: DataFrame, text: str, n: int, bits: int) -> np.ndarray:
    """In how many sets, in all, the tokens of each bucket are; at most 2 ** MOST_BITS numbers, whatever the input."""

    def rows(total: np.ndarray, salt: int) -> pa.RecordBatch:
        parts = range(0, len(total), _CHUNK)
        return pa.RecordBatch.from_arrays([pa.array([p // _CHUNK for p in parts], pa.int32()), pa.array([salt] * len(parts), pa.int32()), pa.array([pack(total[p : p + _CHUNK]) for p in parts], pa.binary())], ["chunk", "salt", "counts"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.uint32)
        for b in batches:
            for tokens in token_sets(b.column(0), n):
                np.add.at(total, bucket(tokens, len(total)), 1)
        if total.any():
            yield rows(total, TaskContext.get().partitionId() // 256)

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(unpack(x).astype(np.int64) for x in pdf["counts"])
        return pd.DataFrame({"chunk": [pdf["chunk"].iloc[0]], "salt": [pdf["salt"].iloc[0]], "counts": [pack(total)]})

    schema = "chunk int, salt int, counts binary"
    some = docs.select(text).mapInArrow(count, schema).groupBy("chunk", "salt").applyInPandas(add, schema)
    with scratch.batches(docs.sparkSession, 1000):
        got = some.groupBy("chunk").applyInPandas(add, schema).collect()
    out = np.zeros(1 << bits, np.uint32)
    for r in got:
        out[r["chunk"] * _CHUNK : (r["chunk"] + 1) * _CHUNK] = unpack(r["counts"])
    return out


def levels_of(counts: np.ndarray) -> np.ndarray:
    """0 for buckets of rare tokens, and the more, the more documents a bucket's tokens have."""
    mean = float(counts.mean())
    usual = mean + 4 * np.sqrt(mean) + 6
    out = np.zeros(len(counts), np.uint8)
    many = np.flatnonzero(counts > usual)
    out[many] = np.clip(1 + np.log2(counts[many] / usual), 1, 60)
    return out


def prefix_size(n: int) -> int:
    """Of two sets with enough similarity, each shares a token among so many of its first with the other's first."""
    return n - -(-n * PERCENT // 100) + 1


def least_overlap(a, b):
    """Tokens that sets of these sizes must share: 100 i >= PERCENT (a + b - i)."""
    return -(-PERCENT * (a + b) // (100 + PERCENT))


def fine_groups(n: int) -> int:
    """Groups of the finer count vector: a power of 2, n or more, so that few tokens meet in a group."""
    return max(GROUPS, 1 << max(0, n - 1).bit_length())


def fold(counts: np.ndarray, groups: int) -> np.ndarray:
    """The count vector over fewer groups; tokens go by their lowest bits."""
    return counts.reshape(-1, groups).sum(0)


def pack(counts: np.ndarray) -> bytes:
    """The width of a count in bytes, and the counts."""
    kind = np.uint8 if counts.max(initial=0) < 256 else np.uint16 if counts.max() < 65536 else np.uint32
    return bytes([np.dtype(kind).itemsize]) + counts.astype(kind).tobytes()


def unpack(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"u{raw[0]}", offset=1).astype(np.int32)


def sketches(docs: DataFrame, id_col: str, text: str, n: int, levels: np.ndarray) -> DataFrame:
    """(row, id, hash, n, fp1, fp2, first, heads, counts, fine): a text's hash, its set's size, fingerprint, first tokens, the HEADS of them, and count vectors of GROUPS and of about n groups."""
    shared = docs.sparkSession.sparkContext.broadcast(levels)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = shared.value
        for b in batches:
            ns, f1, f2, first, ends, heads, vec, fine = [], [], [], [], [0], [], [], []
            for s in token_sets(b.column(1), n):
                ns.append(len(s))
                m = textbuf.mix64(s)
                f1.append(int(m.sum().astype(np.int64)))
                f2.append(int(textbuf.mix64(m ^ np.uint64(0x5851F42D4C957F2D)).sum().astype(np.int64)))
                lv = level[bucket(s, len(level))]
                order = s[np.argsort(lv, kind="stable")] if lv.any() else s
                first.append(order[: prefix_size(len(s))] if len(s) else s)
                ends.append(ends[-1] + len(first[-1]))
                heads.append(np.sort(first[-1].view(np.int64))[:HEADS].tobytes())
                many = np.bincount((s & np.uint64(fine_groups(len(s)) - 1)).astype(np.int64), minlength=fine_groups(len(s)))
                fine.append(pack(many))
                vec.append(pack(fold(many, GROUPS)))
            flat = np.concatenate(first).view(np.int64) if first else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(ns, pa.int32()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), lists, pa.array(heads, pa.binary()), pa.array(vec, pa.binary()), pa.array(fine, pa.binary())], ["id", "hash", "n", "fp1", "fp2", "first", "heads", "counts", "fine"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), text, F.xxhash64(text)).mapInArrow(sketch, f"id {kind}, hash long, n int, fp1 long, fp2 long, first array<long>, heads binary, counts binary, fine binary")
    return scratch.keep(out.select(F.monotonically_increasing_id().alias("row"), "*"), "sketches")


def blocks_of(nodes: DataFrame, counts: np.ndarray, block_rows: int) -> DataFrame:
    """(block, token, salt, rows): nodes that share one of their first tokens; salt 0 if the token has one block.

    Blocks with the same rows are kept once.
    """
    spark = nodes.sparkSession
    total = nodes.agg(F.sum(F.size("first"))).first()[0] or 0
    parts = max(1, -(-total // PART_TOKENS))
    large, buckets = np.flatnonzero(counts > block_rows), len(counts)
    shared = spark.sparkContext.broadcast((large, np.minimum(-(-counts[large].astype(np.int64) // block_rows), 65_535)))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        large, blocks = shared.value
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def send() -> pa.RecordBatch:
            token, row, n = (np.concatenate(x) for x in zip(*held, strict=True))
            of = np.ones(len(token), np.int64)
            if len(large):
                own = bucket(token, buckets)
                at = np.minimum(np.searchsorted(large, own), len(large) - 1)
                of[large[at] == own] = blocks[at[large[at] == own]]
            salt = np.where(of > 1, 1 + (textbuf.mix64(row.view(np.uint64)) % np.maximum(of, 1).astype(np.uint64)).astype(np.int64), 0).astype(np.uint16)
            part = (textbuf.mix64(token.view(np.uint64) + salt.astype(np.uint64)) % np.uint64(parts)).astype(np.int64)
            order = np.lexsort((row, part))
            token, row, n, salt, part = token[order], row[order], n[order], salt[order], part[order]
            cuts = np.flatnonzero(np.diff(part, prepend=-1))
            ends = np.append(cuts[1:], len(part))
            return pa.RecordBatch.from_arrays([pa.array(part[cuts], pa.int64()), *(pa.array([x[a:b].tobytes() for a, b in zip(cuts, ends, strict=True)], pa.binary()) for x in (token, row, n.astype(np.int32), salt))], ["part", "token", "row", "n", "salt"])

        for b in batches:
            lists = b.column(2)
            lens = np.diff(np.asarray(lists.offsets))
            held.append((np.asarray(lists.flatten()), np.repeat(np.asarray(b.column(0)), lens), np.repeat(np.asarray(b.column(1)), lens)))
            size += int(lens.sum())
            if size >= FLUSH_TOKENS:
                yield send()
                held, size = [], 0
        if size:
            yield send()

    def meet(table: pa.Table) -> pa.Table:
        token, row, n, salt = (np.concatenate([np.frombuffer(x.as_py(), kind) for x in table[c]]) for c, kind in (("token", np.int64), ("row", np.int64), ("n", np.int32), ("salt", np.uint16)))
        order = np.lexsort((row, n, salt, token))
        token, row, salt = token[order], row[order], salt[order].astype(np.int32)
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (salt[1:] != salt[:-1])
        starts = np.flatnonzero(new)
        lens = np.diff(np.append(starts, len(token)))
        ok = (lens > 1) | (salt[starts] > 0)
        keep = np.repeat(ok, lens)
        starts, lens, rows = starts[ok], lens[ok], row[keep]
        begin = np.concatenate([[0], np.cumsum(lens)]).astype(np.int32)
        m = textbuf.mix64(rows.view(np.uint64) + np.uint64(1))
        sums = [np.add.reduceat(x, begin[:-1]) if len(starts) else x[:0] for x in (m, textbuf.mix64(m ^ np.uint64(0x5851F42D4C957F2D)))]
        apart = textbuf.mix64(token[starts].view(np.uint64)) * (salt[starts] > 0)  # blocks of a split token all stay
        s1, s2 = (sums[0] + apart).view(np.int64), (sums[1] + apart * np.uint64(3)).view(np.int64)
        arrays = [pa.array(s1), pa.array(s2), pa.array(token[starts]), pa.array(salt[starts]), pa.ListArray.from_arrays(pa.array(begin), pa.array(rows))]
        out = pa.Table.from_arrays(arrays, ["s1", "s2", "token", "salt", "rows"])
        once = np.unique(np.stack([s1, s2], 1), axis=0, return_index=True)[1]
        return out.take(pa.array(np.sort(once)))

    dealt = nodes.select("row", "n", "first").mapInArrow(deal, "part long, token binary, row binary, n binary, salt binary")
    met = dealt.groupBy("part").applyInArrow(meet, "s1 long, s2 long, token long, salt int, rows array<long>")
    once = met.groupBy("s1", "s2").agg(F.min(F.struct("token", "salt", "rows")).alias("b")).select("b.*")
    return scratch.keep(once.select(F.monotonically_increasing_id().alias("block"), "*"), "blocks")


class Tree:
    """An R-tree over count vectors: halved by the widest group until LEAF points are left, all leaves at one depth."""

    def __init__(self, rows: np.ndarray, sizes: np.ndarray, comps: np.ndarray, points: np.ndarray, heads: np.ndarray | None = None):
        m = len(rows)
        self.depth = max(0, int(np.ceil(np.log2(max(1, m) / LEAF))))
        order = np.lexsort((rows, sizes))
        cuts = np.array([0, m])
        for d in range(self.depth):
            mids = (cuts[:-1] + cuts[1:]) // 2
            for a, b, c in zip(cuts[:-1], cuts[1:], mids, strict=True):
                if d and b - a > 1:  # the first cut is by size
                    own = order[a:b]
                    wide = int(np.argmax(np.ptp(points[own], axis=0)))
                    order[a:b] = own[np.argpartition(points[own, wide], c - a)]
            cuts = np.sort(np.concatenate([cuts, mids]))
        self.rows, self.sizes, self.comps, self.points = rows[order], sizes[order], comps[order], points[order]
        self.heads = heads[order] if heads is not None else None
        level, self.levels = cuts, []
        while True:
            a = level[:-1]
            self.levels.append((level, np.maximum.reduceat(self.points, a), np.minimum.reduceat(self.sizes, a), np.maximum.reduceat(self.sizes, a), np.minimum.reduceat(self.comps, a), np.maximum.reduceat(self.comps, a)))
            if len(level) == 2:
                break
            level = level[::2]
        self.levels.reverse()


def _possible(p, ps, pl, q, qs, ql) -> np.ndarray:
    """Whether nodes (largest counts, least and largest sizes) may hold similar sets."""
    sized = (100 * pl >= PERCENT * qs) & (100 * ql >= PERCENT * ps)
    sized[sized] = np.minimum(p[sized], q[sized]).sum(1) >= least_overlap(ps[sized], qs[sized])
    return sized


def tree_join(s: Tree, t: Tree, step: int = 1 << 15) -> Iterator[np.ndarray]:
    """Pairs of places in both trees whose sets may be similar and whose components differ; of a tree with itself each pair once."""
    same = s is t
    work = [(0, np.array([[0, 0]]))]
    while work:
        d, pairs = work.pop()
        if len(pairs) > step:
            work += [(d, pairs[:step]), (d, pairs[step:])]
            continue
        di, dj = min(d, s.depth), min(d, t.depth)
        (cs, ps, ss, sl, sa, sb), (ct, pt, ts, tl, ta, tb) = s.levels[di], t.levels[dj]
        i, j = pairs[:, 0], pairs[:, 1]
        ok = _possible(ps[i], ss[i], sl[i], pt[j], ts[j], tl[j]) & ~((sa[i] == sb[i]) & (ta[j] == tb[j]) & (sa[i] == ta[j]))
        i, j = i[ok], j[ok]
        if not len(i):
            continue
        if d < max(s.depth, t.depth):
            ki = np.stack([2 * i, 2 * i + 1], 1) if d < s.depth else i[:, None]
            kj = np.stack([2 * j, 2 * j + 1], 1) if d < t.depth else j[:, None]
            a, b = np.repeat(ki, kj.shape[1], 1).ravel(), np.tile(kj, (1, ki.shape[1])).ravel()
            new = np.stack([a, b], 1)
            work.append((d + 1, new[a <= b] if same else new))
            continue
        for x, y in zip(i, j, strict=True):
            a, b = np.meshgrid(np.arange(cs[x], cs[x + 1]), np.arange(ct[y], ct[y + 1]), indexing="ij")
            a, b = a.ravel(), b.ravel()
            if same and x == y:
                a, b = a[a < b], b[a < b]
            ok = s.comps[a] != t.comps[b]
            a, b = a[ok], b[ok]
            n, m = s.sizes[a], t.sizes[b]
            ok = _possible(s.points[a], n, n, t.points[b], m, m)
            if ok.any():
                yield np.stack([a[ok], b[ok]], 1)


def block_members(members: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows, sizes, points and heads of each block of a column of arrays of (row, n, counts, heads)."""
    flat, ends = members.flatten(), np.asarray(members.offsets) - members.offsets[0].as_py()
    rows, sizes = np.asarray(flat.field("row")), np.asarray(flat.field("n")).astype(np.int64)
    raw = flat.field("counts").to_pylist()
    if {len(x) for x in raw} == {GROUPS + 1}:
        points = np.frombuffer(b"".join(raw), np.uint8).reshape(-1, GROUPS + 1)[:, 1:]
    else:
        points = np.stack([unpack(x) for x in raw]) if raw else np.zeros((0, GROUPS), np.int32)
    pad = np.full(HEADS, _NONE).tobytes()
    heads = np.frombuffer(b"".join((x + pad)[: len(pad)] for x in flat.field("heads").to_pylist()), np.int64).reshape(-1, HEADS)
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        yield rows[a:b], sizes[a:b], points[a:b], heads[a:b]


def named_before(s: Tree, t: Tree, i: np.ndarray, j: np.ndarray, token: int) -> np.ndarray:
    """Whether pairs of places in both trees have a common token among their heads that comes before the block's."""
    x, y = s.heads[i], t.heads[j]
    x = np.where(x < token, x, _NONE)
    return ((x[:, :, None] == y[:, None, :]) & (x[:, :, None] != _NONE)).any((1, 2))


def most_room(s: Tree, t: Tree, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The NAMED pairs with the most room of each two components, as places among the pairs."""
    both = np.concatenate([np.minimum(s.points[i[k : k + _CHUNK]], t.points[j[k : k + _CHUNK]]).sum(1) for k in range(0, len(i), _CHUNK)])
    room = both / least_overlap(s.sizes[i], t.sizes[j])
    a, b = np.minimum(s.comps[i], t.comps[j]), np.maximum(s.comps[i], t.comps[j])
    order = np.lexsort((t.rows[j], s.rows[i], -room, b, a))
    new = np.append(True, (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1]))
    first = np.flatnonzero(new)[np.cumsum(new) - 1]
    return order[np.arange(len(order)) - first < NAMED]


def partners(rows: np.ndarray, sizes: np.ndarray, points: np.ndarray) -> list[tuple[int, int]]:
    """One link to try for each document of a block but the first."""
    head = int(np.lexsort((rows, sizes))[0])
    good = _possible(np.broadcast_to(points[head], points.shape), np.full(len(rows), sizes[head]), np.full(len(rows), sizes[head]), points, sizes, sizes)
    good[head] = False
    out = [(x, int(rows[head])) for x in rows[good].tolist()]
    rest = ~good
    rest[head] = False
    if rest.sum() > 1:
        t = Tree(rows[rest], sizes[rest], rows[rest], points[rest])
        best: dict[int, tuple[float, int]] = {}
        for found in tree_join(t, t):
            a, b = found[:, 0], found[:, 1]
            room = np.minimum(t.points[a], t.points[b]).sum(1) / least_overlap(t.sizes[a], t.sizes[b])
            for x, y, r in zip(t.rows[a].tolist(), t.rows[b].tolist(), room.tolist(), strict=True):
                x, y = max(x, y), min(x, y)
                if (r, -y) > best.get(x, (0.0, 0)):
                    best[x] = (r, -y)
        out += [(x, -y) for x, (_, y) in best.items()]
    return out


def may_link(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) that the finer count vectors allow."""
    rows = scratch.keep(pairs.select(F.col("a").alias("row")).union(pairs.select("b")).distinct(), "rows")
    fine = nodes.select("row", "n", "fine").join(near(rows), "row", "left_semi")

    def allowed(n: pa.Array, x: pa.Array, m: pa.Array, y: pa.Array) -> pa.Array:
        out = []
        for a, p, b, q in zip(n.to_pylist(), x.to_pylist(), m.to_pylist(), y.to_pylist(), strict=True):
            p, q = unpack(p), unpack(q)
            g = min(len(p), len(q))
            out.append(bool(np.minimum(fold(p, g), fold(q, g)).sum() >= least_overlap(a, b)))
        return pa.array(out, pa.bool_())

    left = pairs.join(fine.select(F.col("row").alias("a"), F.col("n").alias("na"), F.col("fine").alias("fa")), "a")
    both = left.join(fine.select(F.col("row").alias("b"), F.col("n").alias("nb"), F.col("fine").alias("fb")), "b")
    return scratch.keep(both.where(F.arrow_udf(allowed, "boolean")("na", "fa", "nb", "fb")).select("a", "b"), "allowed")


def verify(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, id_col: str, text: str, n: int) -> DataFrame:
    """The pairs (a, b) of nodes whose sets have the similarity.

    Sets are made again from the texts of these nodes, and each is sent where its
    pairs are: a pair goes by its node of more pairs, whose pairs are dealt to
    chunks of about CHUNK_PAIRS.
    """
    ends = pairs.select(F.col("a").alias("row")).union(pairs.select("b"))
    degree = scratch.keep(ends.groupBy("row").agg(F.count("*").alias("d")), "degree")
    wanted = scratch.keep(nodes.select("row", F.col("id").alias("_id"), F.col("hash").alias("_hash"), "fp1").join(near(degree), "row", "left_semi"), "wanted")
    d = near(degree)
    both = pairs.join(d.select(F.col("row").alias("a"), F.col("d").alias("da")), "a").join(d.select(F.col("row").alias("b"), F.col("d").alias("db")), "b")
    first = F.col("da") >= F.col("db")
    both = both.select("a", "b", F.when(first, F.col("a")).otherwise(F.col("b")).alias("hub"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("other"), F.greatest("da", "db").alias("d"))
    chunk = F.pmod(F.xxhash64("other"), F.ceil(F.col("d") / CHUNK_PAIRS))
    parts = max(1, -(-pairs.count() // CHUNK_PAIRS))
    both = scratch.keep(both.select("a", "b", F.pmod(F.xxhash64("hub", chunk), F.lit(parts)).alias("part")), "dealt")
    needs = scratch.keep(both.select("part", F.col("a").alias("row")).union(both.select("part", "b")).distinct(), "needs")

    def set_of(texts: pa.Array, prints: pa.Array) -> pa.Array:
        """The set, or null if it isn't the node's; both sides are arguments, so that it is made after the join.

        It is declared as not deterministic, or the filter on it would make it a second time.
        """
        rows = zip(token_sets(texts, n), prints.to_pylist(), strict=True)
        return pa.array([s.tobytes() if int(textbuf.mix64(s).sum().astype(np.int64)) == f else None for s, f in rows], pa.binary())

    texts = docs.select(F.col(id_col).alias("_t_id"), F.col(text).alias("_t")).where(F.col("_t").isNotNull())
    texts = texts.join(near(wanted), F.col("_t_id").eqNullSafe(F.col("_id")) & (F.xxhash64("_t") == F.col("_hash")))  # ids may be null or repeat
    sets = texts.select("row", F.arrow_udf(set_of, "binary").asNondeterministic()("_t", "fp1").alias("tokens")).where("tokens IS NOT NULL")
    sent = sets.join(near(needs), "row").select("part", F.col("row").alias("a"), F.lit(None).cast("long").alias("b"), "tokens")
    sent = sent.union(both.select("part", "a", "b", F.lit(None).cast("binary")))

    def similar(table: pa.Table) -> pa.Table:
        held: dict[int, np.ndarray] = {}
        asked = []
        for a, b, tokens in zip(table["a"].to_pylist(), table["b"].to_pylist(), table["tokens"], strict=True):
            if b is None:
                held[a] = np.frombuffer(tokens.as_buffer(), np.uint64)
            else:
                asked.append((a, b))
        out = []
        for a, b in asked:
            both = len(np.intersect1d(held[a], held[b], assume_unique=True))
            if 100 * both >= PERCENT * (len(held[a]) + len(held[b]) - both):
                out.append((a, b))
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    return sent.groupBy("part").applyInArrow(similar, "a long, b long")


_PAIRS = "array<struct<a:long,b:long>>"


def _pair_array(rows: list[list[tuple[int, int]]]) -> pa.Array:
    return pa.array([[{"a": a, "b": b} for a, b in r] for r in rows], pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))


def node_links(docs: DataFrame, nodes: DataFrame, counts: np.ndarray, id_col: str, text: str, n: int, block_rows: int) -> DataFrame:
    """(node, root): components of the nodes that have links."""
    blocks = blocks_of(nodes, counts, block_rows)
    member = blocks.select("block", F.explode("rows").alias("row")).join(nodes.select("row", "n", "counts", "heads"), "row")
    filled = member.groupBy("block").agg(F.collect_list(F.struct("row", "n", "counts", "heads")).alias("members"))  # at most about BLOCK_ROWS each
    filled = scratch.keep(filled.join(blocks.drop("rows"), "block"), "filled")

    def first_links(members: pa.Array) -> pa.Array:
        return _pair_array([partners(*m[:3]) for m in block_members(members)])

    both = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    tried = filled.select(F.explode(F.arrow_udf(first_links, _PAIRS)("members")).alias("p")).select("p.*")
    heads = filled.where("salt > 0").select("token", F.array_min(F.transform("members", lambda m: F.struct(m["n"], m["row"].alias("row"))))["row"].alias("head"))
    lead = heads.groupBy("token").agg(F.min("head").alias("lead"))
    tried = tried.union(heads.join(lead, "token").where("head != lead").select("head", "lead"))
    tried = scratch.keep(tried.groupBy(F.col("a").alias("own"), F.col("b").alias("partner")).agg(F.count("*").alias("times")), "tried", BLOCK_BATCH)
    most = F.row_number().over(W.partitionBy("own").orderBy(F.desc("times"), "partner"))
    best = scratch.keep(tried.withColumn("n", most).where("n = 1").select(*both("own", "partner")).distinct(), "best")
    links = scratch.keep(verify(may_link(best, nodes), docs, nodes, id_col, text, n), "links", VERIFY_BATCH)
    comps = components(links)
    tried = tried.select(*both("own", "partner")).distinct()
    root = near(comps)
    ends = tried.join(root.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a", "left").join(root.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b", "left")
    apart = ends.where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b").join(best, ["a", "b"], "left_anti")
    apart = may_link(scratch.keep(apart, "apart"), nodes)
    if not apart.isEmpty():
        links = links.union(scratch.keep(verify(apart, docs, nodes, id_col, text, n), "links", VERIFY_BATCH))
        comps = components(links)

    tried = scratch.keep(tried, "tried")
    for few in (True, False):
        more = apart_pairs(blocks, filled, comps, few)
        if more is None:
            break
        more = more.join(near(tried), ["a", "b"], "left_anti")
        if few:
            of = F.pmod(F.xxhash64("a", "b"), F.lit(TRIED))
            more = more.groupBy("ra", "rb", of).agg(F.max(F.struct("times", "a", "b")).alias("p")).select("p.a", "p.b")
        more = scratch.keep(more.select("a", "b"), "more", 10)
        tried = tried.union(more)
        allowed = may_link(more, nodes)
        if not allowed.isEmpty():
            links = links.union(scratch.keep(verify(allowed, docs, nodes, id_col, text, n), "links", VERIFY_BATCH))
            comps = components(links)
    return comps


def apart_pairs(blocks: DataFrame, filled: DataFrame, comps: DataFrame, few: bool) -> DataFrame | None:
    """(a, b, ra, rb, times): pairs of nodes of different components that blocks propose, their components, and by how many blocks.

    With few, each block names for two components the pairs with the most room only;
    otherwise all that the bound allows. None if no block has several components.
    """
    ranges = blocks.where("salt > 0 OR size(rows) > 2").select("block", F.explode("rows").alias("row")).join(near(comps), F.col("row") == F.col("node"), "left").select("block", "row", F.coalesce("root", "row").alias("root"))
    mixed = ranges.groupBy("block").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
    mixed = scratch.keep(mixed.join(blocks.select("block", "token", "salt"), "block"), "mixed")
    one = mixed.where("lo != hi").select(F.col("block").alias("x"), F.col("block").alias("y"))
    x, y = mixed.where("salt > 0").alias("x"), mixed.where("salt > 0").alias("y")
    differ = (F.col("x.lo") != F.col("x.hi")) | (F.col("y.lo") != F.col("y.hi")) | (F.col("x.lo") != F.col("y.lo"))
    two = x.join(y, F.col("x.token") == F.col("y.token")).where((F.col("x.salt") < F.col("y.salt")) & differ).select(F.col("x.block").alias("x"), F.col("y.block").alias("y"))
    todo = scratch.keep(one.union(two), "todo")
    if todo.isEmpty():
        return None
    roots = ranges.where("root != row").groupBy("block").agg(F.collect_list(F.struct("row", "root")).alias("roots"))
    side = filled.select("block", "token", "members").join(roots, "block", "left").withColumn("roots", F.coalesce("roots", F.array().cast("array<struct<row:bigint,root:bigint>>")))
    side = side.select("block", "token", F.struct("members", "roots").alias("side"))
    sides = todo.join(side.select(F.col("block").alias("x"), "token", F.col("side").alias("sx")), "x").join(side.select(F.col("block").alias("y"), F.col("side").alias("sy")), "y")

    def trees(side: pa.Array) -> Iterator[Tree]:
        roots = side.field("roots").to_pylist()
        for (rows, sizes, points, heads), known in zip(block_members(side.field("members")), roots, strict=True):
            own = {r["row"]: r["root"] for r in known}
            yield Tree(rows, sizes, np.array([own.get(r, r) for r in rows.tolist()], np.int64), points, heads)

    def propose(tokens: pa.Array, xs: pa.Array, ys: pa.Array) -> pa.Array:
        cols, ends = [[np.zeros(0, np.int64)] for _ in range(4)], [0]
        for token, s, t in zip(tokens.to_pylist(), trees(xs), trees(ys), strict=True):
            if len(s.rows) == len(t.rows) and (s.rows == t.rows).all():
                t = s
            found = [f if few else f[~named_before(s, t, f[:, 0], f[:, 1], token)] for f in tree_join(s, t)]
            i, j = np.concatenate(found).T if found else (np.zeros(0, np.int64),) * 2
            if few and len(i):
                best = most_room(s, t, i, j)
                i, j = i[best], j[best]
            a, b, ra, rb = s.rows[i], t.rows[j], s.comps[i], t.comps[j]
            for col, u, v, way in zip(cols, (a, a, ra, ra), (b, b, rb, rb), (np.minimum, np.maximum) * 2, strict=True):
                col.append(way(u, v))
            ends.append(ends[-1] + len(i))
        flat = pa.StructArray.from_arrays([pa.array(np.concatenate(c)) for c in cols], ["a", "b", "ra", "rb"])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)

    pairs = sides.select(F.explode(F.arrow_udf(propose, "array<struct<a:long,b:long,ra:long,rb:long>>")("token", "sx", "sy")).alias("p"))
    return pairs.select("p.*").groupBy("a", "b", "ra", "rb").agg(F.count("*").alias("times"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = SHINGLE, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(id, n_shingles, component_id) of all documents."""
    counts = token_counts(docs, text, shingle, bucket_bits(docs, text))
    all_rows = sketches(docs, id_col, text, shingle, levels_of(counts))
    full = all_rows.where("n > 0")
    sets = full.groupBy("fp1", "fp2", "n").agg(F.min("row").alias("node"), F.min("id").alias("least"), F.count("*").alias("copies"))
    sets = scratch.keep(sets, "nodes")
    again = scratch.keep(full.join(near(sets.where("copies > 1").drop("least")), ["fp1", "fp2", "n"]).where("row != node").select("row"), "again")
    nodes = full.join(near(again), "row", "left_anti")
    comps = node_links(docs, nodes, counts, id_col, text, shingle, block_rows)
    named = sets.join(near(comps), "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.where(F.col("copies") > 1).select("root").union(comps.select("root")).distinct()
    names = named.join(near(scratch.keep(least, "roots")), "root", "left_semi")
    by_root = names.groupBy("root").agg(F.min("least").alias("component_id"))
    final = scratch.keep(names.join(by_root, "root").select("fp1", "fp2", "n", "component_id"), "named")
    out = all_rows.select("id", "n", "fp1", "fp2").join(near(final), ["fp1", "fp2", "n"], "left")
    return out.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))
