"""Byte-level BPE encoding and decoding.

A text is cut by the tokenizer's pattern; each piece is encoded on its own.
The bytes of a piece are mapped to Latin-1 characters, an Aho-Corasick
automaton finds the longest vocabulary entry at each place, and the encoder
backtracks from longest matches: a token is kept if it is compatible with the
token before it (their merges would not have joined across the border) and
otherwise replaced by its next shorter prefix. Compatibility of adjacent tokens
is memoised. A set of dead places keeps the work linear in the piece, and the
result is exactly that of applying the merges by rank.

Nulls count as empty texts and give an empty array; repeated rows are encoded
each; other columns, whatever their names, pass through.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textbuf

#: Pieces whose tokens a task remembers: so many new ones, and those of the generation before.
MEMO_PIECES = 200_000
#: Longer pieces are encoded anew each time.
MEMO_CHARS = 48
#: Remembered pairs of adjacent tokens.
MEMO_PAIRS = 400_000
#: Bytes of text whose ids are made before they are sent on.
SLICE_BYTES = 1 << 20


def _entries(lines: bytes) -> list[tuple[int, bytes]]:
    return [(int(b), base64.b64decode(a)) for a, b in map(bytes.split, lines.splitlines())]


class Ranks:
    """A vocabulary of byte strings by rank, with its automaton and splits."""

    def __init__(self, lines: bytes, pattern: str):
        import ahocorasick
        import regex

        entries = sorted(_entries(lines))
        self.tokens = [t for _, t in entries]
        self.ids = [i for i, _ in entries]
        self.coded = [np.int32(i).tobytes() for i in self.ids]
        self.index = {t.decode("latin-1"): k for k, t in enumerate(self.tokens)}
        self.size = [len(t) for t in self.tokens]
        self.longest = max(self.size, default=0)
        self.findall = regex.compile(pattern).findall
        self.automaton = ahocorasick.Automaton()
        for t, k in self.index.items():
            self.automaton.add_word(t, k)
        self.automaton.make_automaton()
        self.pairs: dict[tuple[int, int], int] = {}
        self.left, self.right = list(range(len(self.tokens))), list(range(len(self.tokens)))
        self.shorter = [self._prefix(t) for t in self.index]
        self.memo: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.known: dict[int, bool] = {}
        for t, k in self.index.items():
            head = self.shorter[k]
            while head >= 0:
                tail = self.index.get(t[self.size[head] :], k)
                if tail < k and head < k and self._compatible(head, tail):
                    self.pairs[head, tail] = k
                    self.left[k], self.right[k] = head, tail
                    break
                head = self.shorter[head]

    def _prefix(self, token: str) -> int:
        for n in range(len(token) - 1, 0, -1):
            if (k := self.index.get(token[:n])) is not None:
                return k
        return -1

    def compatible(self, a: int, b: int) -> bool:
        """The remembered answer of _compatible, under one number for both tokens."""
        key = a * len(self.tokens) + b
        if (ok := self.known.get(key)) is None:
            if len(self.known) >= MEMO_PAIRS:
                self.known.clear()
            ok = self.known[key] = self._compatible(a, b)
        return ok

    def _compatible(self, a: int, b: int) -> bool:
        """Whether a and b stay apart when their joined bytes are merged by rank.

        The merges that made either token are undone from the last to the
        first; no pair at the border may have been joined before them.
        """
        limit = len(self.tokens)
        while True:
            if self.pairs.get((a, b), limit) < limit:
                return False
            undo_a = a > b if self.left[a] != a and self.left[b] != b else self.left[a] != a
            if undo_a:
                limit, a = a, self.right[a]
            elif self.left[b] != b:
                limit, b = b + 1, self.left[b]
            else:
                return True

    def encode_piece(self, piece: str) -> bytes:
        """The ids of a piece, four bytes each."""
        raw = piece if piece.isascii() else piece.encode("utf-8").decode("latin-1")
        if (k := self.index.get(raw)) is not None:
            return self.coded[k]
        find, prefix, size, shorter, compatible = self.index.get, self.automaton.longest_prefix, self.size, self.shorter, self.compatible
        n, out, before, at, token, longest = len(raw), [], -1, 0, -1, self.longest
        dead: set[int] = set()
        fresh = True
        while at < n:
            if fresh:  # the longest match here: the longest way into the automaton, cut to an entry
                end = at + prefix(raw[at : at + longest])
                while end > at and (token := find(raw[at:end], -1)) < 0:
                    end -= 1
            while token >= 0 and (dead and at + size[token] in dead or before >= 0 and not compatible(before, token)):
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at += size[token]
                before, fresh = token, True
            else:
                if not out:
                    raise ValueError("the vocabulary lacks a byte of the text")
                dead.add(at)
                last = out.pop()
                at -= size[last]
                token, before, fresh = shorter[last], out[-1] if out else -1, False
        return b"".join([self.coded[k] for k in out])

    def _fresh(self, piece: str) -> bytes:
        if (got := self.memo.get(piece)) is not None:  # twice in one text
            return got
        got = self.old.get(piece) or self.encode_piece(piece)
        if len(piece) <= MEMO_CHARS:
            if len(self.memo) >= MEMO_PIECES:
                self.old, self.memo = self.memo, {}
            self.memo[piece] = got
        return got

    def encode(self, text: str) -> bytes:
        """The ids of a text, four bytes each."""
        pieces = self.findall(text)
        rows = list(map(self.memo.get, pieces))
        if None in rows:
            rows = [self._fresh(p) if r is None else r for p, r in zip(pieces, rows, strict=True)]
        return b"".join(rows)


def _read(spark: SparkSession, path: str) -> bytes:
    """The vocabulary file, read by Spark, so that any store will do."""
    import os

    if "://" not in path and os.path.exists(path):
        with open(path, "rb") as f:
            return f.read()
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])


def _slices(texts: pa.Array) -> Iterator[pa.Array]:
    """The batch in parts of about SLICE_BYTES, so that the ids of one part at a time are held."""
    at = 0
    for i, j in textbuf.chunks(textbuf.buffers(texts)[1], SLICE_BYTES):
        at = j
        yield texts.slice(i, j - i)
    if not at:
        yield texts


def _encoded(ranks: Ranks, texts: pa.Array) -> pa.ListArray:
    rows = [ranks.encode(text.as_py() or "") for text in texts]
    ends = np.cumsum([0, *map(len, rows)]) // 4
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(rows), np.int32)))


class _Words:
    """What ids stand for, taken and joined by Arrow."""

    def __init__(self, entries: list[tuple[int, bytes]]):
        self.ids = np.array([i for i, _ in entries])
        self.tokens = pa.array([t for _, t in entries], pa.large_binary())

    def decode(self, ids: pa.ListArray) -> pa.Array:
        flat = np.asarray(ids.flatten())
        at = np.minimum(np.searchsorted(self.ids, flat), len(self.ids) - 1)
        if (self.ids[at] != flat).any():
            raise KeyError("an id that the vocabulary lacks")
        lens = np.asarray(pc.fill_null(pc.list_value_length(ids), 0))
        rows = pa.LargeListArray.from_arrays(pa.array(np.cumsum([0, *lens]), pa.int64()), self.tokens.take(pa.array(at)))
        return pc.if_else(ids.is_valid(), pc.binary_join(rows, pa.scalar(b"", pa.large_binary())), None).cast(pa.binary())


def encoder(spark: SparkSession, path: str, pattern: str):
    """A column function from text to ids (array<int>), without special tokens.

    A task makes the vocabulary's tables and frees them when it ends, so that they
    don't stay in Python workers beside the tasks of other operators.
    """
    shared = spark.sparkContext.broadcast(_read(spark, path))

    @F.arrow_udf("array<int>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        ranks = Ranks(shared.value, pattern)
        for texts in batches:
            for part in _slices(texts):
                yield _encoded(ranks, part)

    return encode


def decoder(spark: SparkSession, path: str):
    """A column function from ids (array<int>) to the bytes they stand for.

    Null arrays give null; ids that the vocabulary lacks raise an error.
    """
    shared = spark.sparkContext.broadcast(_read(spark, path))

    @F.arrow_udf("binary")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        words = _Words(sorted(_entries(shared.value)))
        for ids in batches:
            yield words.decode(ids)

    return decode


def round_trip(spark: SparkSession, path: str, pattern: str):
    """A column function from text to struct(ids, decoded): both directions in one Python worker and with one vocabulary."""
    shared = spark.sparkContext.broadcast(_read(spark, path))

    @F.arrow_udf("struct<ids:array<int>,decoded:binary>")
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        ranks = Ranks(shared.value, pattern)
        words = _Words(list(zip(ranks.ids, ranks.tokens, strict=True)))
        for texts in batches:
            for part in _slices(texts):
                ids = _encoded(ranks, part)
                yield pa.StructArray.from_arrays([ids, words.decode(ids)], ["ids", "decoded"])

    return both


def encode_documents(docs: DataFrame, path: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """Adds the ids of each whole text; a column named ``out`` is replaced."""
    return docs.withColumn(out, encoder(docs.sparkSession, path, pattern)(F.col(text)))


def decode_documents(docs: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds the bytes of each array of ids; a column named ``out`` is replaced."""
    return docs.withColumn(out, decoder(docs.sparkSession, path)(F.col(ids)))


def round_trip_documents(docs: DataFrame, path: str, pattern: str, text: str = "text", out: str = "coded") -> DataFrame:
    """Adds a struct of the ids of each whole text and the bytes decoded from them; a column named ``out`` is replaced."""
    return docs.withColumn(out, round_trip(docs.sparkSession, path, pattern)(F.col(text)))


def id_text(ids: Column) -> Column:
    """Decimal ids joined by commas."""
    return F.array_join(ids.cast("array<string>"), ",")
