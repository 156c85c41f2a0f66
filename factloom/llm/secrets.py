"""Secret scans with structural confirmation.

Three base kinds are found by pattern in the whole text: ``assign`` (a value
given to a password-like name), ``access`` (access key ids) and ``hex`` (long
runs of hex digits). Further spans are reported only if their decoded structure
confirms them: base64 or hex candidates are decoded and must parse as a private
or public key's DER encoding or as an OpenSSH private key, nested lengths
included, and dotted tokens must have a header and claims that decode to JSON
objects, with an algorithm named. Keys in base64 (of either alphabet) may go on
over line ends, indented or escaped; a key's span ends where its stated length
does, padding included, and only if no further digit follows there.

Spans are (kind, start, end) in code points, end exclusive, ordered by start and
then by kind as KINDS lists them. Nulls count as empty texts; repeated rows are
scanned each; other columns pass through.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Order of kinds at the same start; the first three are the base.
KINDS = ("assign", "access", "hex", "private_key", "public_key", "signed_token")
BASE = KINDS[:3]
#: Fixed patterns of the base kinds, and least lengths of what they find.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a maximal run; shorter ones fail
LEAST_VALUE, LEAST_ACCESS = 6, 20
#: Names that ASSIGN begins with, for a quick look.
_NAMES = (b"passw", b"secret", b"token", b"apikey", b"api_key")
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_HEXED = bytes(1 if chr(b) in "0123456789abcdef" else 0 for b in range(256))
_B64ED = bytes(1 if chr(b) in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=-_.\r\n" else 0 for b in range(256))

TOKEN = re.compile(r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]*)")
#: Where keys may begin: base64 of a first byte 0x30 ("M") or of OpenSSH's magic, or hex from "30".
_DIGIT = r"A-Za-z0-9+/_-"
KEY_B64 = re.compile(rf"(?:(?<![{_DIGIT}])|(?<=\\[nr]))(?:M[{_DIGIT}]{{15}}|b3BlbnNzaC1rZXktdjEA)")
KEY_HEX = re.compile(r"(?<![0-9A-Fa-f])30[0-9A-Fa-f]{30,}")
_RUN = re.compile(rf"[{_DIGIT}]+")
#: What may stand between the lines of a key.
_BREAK = re.compile(r"[ \t]*(?:\r?\n|(?:\\r)?\\n)[ \t]*")
_PADS = re.compile("={0,2}")
_PLAIN = str.maketrans("-_", "+/")
#: Object identifiers that name key algorithms (RSA, EC, Ed25519, X25519, DSA), and the begins of those that name encryption by password (PKCS #5, PKCS #12).
_OIDS = tuple(bytes.fromhex(x) for x in ("2a864886f70d010101", "2a8648ce3d0201", "2b6570", "2b656e", "2a8648ce380401"))
_SEALED = tuple(bytes.fromhex(x) for x in ("2a864886f70d0105", "2a864886f70d010c01"))
_OPENSSH = b"openssh-key-v1\0"


def _element(b: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """Tag, start and end of the content of the DER element at a place, if it fits."""
    if at + 2 > end:
        return None
    tag, n, at = b[at], b[at + 1], at + 2
    if n >= 128:
        k = n & 127
        if not 1 <= k <= 4 or at + k > end:
            return None
        n = int.from_bytes(b[at : at + k], "big")
        if n < 128 or b[at] == 0:  # DER takes the shortest form
            return None
        at += k
    return (tag, at, at + n) if at + n <= end else None


def _children(b: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    out = []
    while at < end:
        if (e := _element(b, at, end)) is None:
            return None
        out.append(e)
        at = e[2]
    return out


def key_kind(b: bytes) -> tuple[str, int] | None:
    """``private_key`` or ``public_key`` and the bytes it takes, if b begins with such an encoding."""
    top = _element(b, 0, len(b))
    if top is None or top[0] != 0x30 or top[2] - top[1] < 16:
        return None
    parts = _children(b, top[1], top[2])
    if not parts:
        return None
    tags = [t for t, _, _ in parts]
    small = lambda e: e[0] == 2 and e[2] - e[1] == 1 and b[e[1]] <= 2

    def named(e: tuple[int, int, int]) -> bytes:
        """The object identifier that a sequence begins with."""
        inner = _children(b, e[1], e[2]) if e[0] == 0x30 else None
        return b[inner[0][1] : inner[0][2]] if inner and inner[0][0] == 6 else b""

    def names_algorithm(e: tuple[int, int, int]) -> bool:
        return named(e) in _OIDS

    if len(parts) >= 3 and small(parts[0]) and names_algorithm(parts[1]) and tags[2] == 4:
        return "private_key", top[2]  # PKCS #8
    if tags == [0x30, 4] and named(parts[0]).startswith(_SEALED):
        return "private_key", top[2]  # encrypted PKCS #8
    if len(parts) >= 9 and small(parts[0]) and set(tags[:9]) == {2}:
        return "private_key", top[2]  # PKCS #1
    if len(parts) >= 2 and small(parts[0]) and b[parts[0][1]] == 1 and tags[1] == 4 and parts[1][2] - parts[1][1] >= 16:
        return "private_key", top[2]  # SEC 1
    if len(parts) == 2 and names_algorithm(parts[0]) and tags[1] == 3:
        return "public_key", top[2]  # SubjectPublicKeyInfo
    if tags == [2, 2] and parts[0][2] - parts[0][1] >= 64 and parts[1][2] - parts[1][1] <= 8:
        return "public_key", top[2]  # PKCS #1
    return None


def _unpadded(x: str) -> bytes | None:
    try:
        return base64.urlsafe_b64decode(x + "=" * (-len(x) % 4))
    except (binascii.Error, ValueError):
        return None


def is_signed_token(header: str, claims: str) -> bool:
    """Whether both decode to JSON objects and the header names an algorithm."""
    try:
        h, c = json.loads(_unpadded(header) or b""), json.loads(_unpadded(claims) or b"")
    except (ValueError, RecursionError):
        return False
    return isinstance(h, dict) and isinstance(c, dict) and isinstance(h.get("alg"), str)


class _Run:
    """Base64 digits that begin at a place of a text and go on over line ends, read once for all candidates among them."""

    def __init__(self, text: str, at: int):
        self.begins, self.before, parts, have = [], [], [], 0
        while m := _RUN.match(text, at):
            self.begins.append(at)
            self.before.append(have)
            parts.append(m[0])
            have, self.end = have + len(m[0]), m.end()
            if not (gap := _BREAK.match(text, m.end())):
                break
            at = gap.end()
        self.digits = "".join(parts).translate(_PLAIN)

    def has(self, at: int) -> bool:
        """Whether a place of the text is one of the digits."""
        k = bisect.bisect_right(self.begins, at) - 1
        return k >= 0 and self.before[k] + at - self.begins[k] < (self.before[k + 1] if k + 1 < len(self.before) else len(self.digits))

    def count(self, at: int) -> int:
        """How many digits come before a place."""
        k = bisect.bisect_right(self.begins, at) - 1
        return self.before[k] + at - self.begins[k]

    def place(self, n: int) -> int:
        """Where the first n digits end in the text."""
        k = bisect.bisect_left(self.before, n) - 1
        return self.begins[k] + n - self.before[k]

    def size(self, first: int) -> int:
        """Bytes that can be decoded from a digit on."""
        n = len(self.digits) - first
        return (n - (n % 4 == 1)) * 3 // 4

    def bytes(self, first: int, at: int, n: int) -> bytes:
        """Up to n bytes from a place on, counted from a digit."""
        begin = first + at // 3 * 4
        part = self.digits[begin : begin + -(-4 * (at % 3 + n) // 3)]
        part = part[: len(part) - (len(part) % 4 == 1)]
        return base64.b64decode(part + "=" * (-len(part) % 4))[at % 3 : at % 3 + n]


def _stated(head: bytes) -> int:
    """Bytes that the DER element takes of which these are the first, by the length it states; 0 if it states none."""
    if len(head) < 6 or head[1] < 128:
        return 2 + head[1] if len(head) > 1 else 0
    k = head[1] & 127
    return 2 + k + int.from_bytes(head[2 : 2 + k], "big") if 1 <= k <= 4 else 0


def _openssh_size(read, size: int) -> int:
    """Bytes of the OpenSSH private key that begins there: magic, three names, keys and the private part, each after its length; 0 if there is none."""
    at, left, keys = len(_OPENSSH), 3, False
    if read(0, at) != _OPENSSH:
        return 0
    while at + 4 <= size:
        n = int.from_bytes(read(at, 4), "big")
        at += 4
        if left == 0 and not keys:  # how many public keys there are; the private part comes after them
            keys, left = True, n + 1
            continue
        at, left = at + n, left - 1
        if left == 0 and keys:
            return at if at <= size else 0
    return 0


def _key_at(text: str, at: int, run: _Run) -> tuple[str, int] | None:
    """The kind of the base64 key that begins at a place of a run, and where it ends; only what may be a key is decoded whole."""
    first = run.count(at)
    size, kind = run.size(first), None
    if text[at] == "M":
        head = run.bytes(first, 0, 8)
        stated = _stated(head)
        inner = 2 + (head[1] & 127 if head[1] >= 128 else 0) if len(head) > 1 else 0
        if not 0 < stated <= size or inner >= len(head) or head[inner] not in (0x02, 0x30):
            return None
        found = key_kind(run.bytes(first, 0, stated))
        kind = found[0] if found and found[1] == stated else None
        size = stated
    else:
        size = _openssh_size(lambda k, n: run.bytes(first, k, n), size)
        kind = "private_key" if size else None
    if kind is None:
        return None
    end = _PADS.match(text, run.place(min(first + -(-4 * size // 3), len(run.digits)))).end()
    return None if _RUN.match(text, end) else (kind, end)


def _structures(text: str) -> Iterator[tuple[str, int, int]]:
    for m in TOKEN.finditer(text):
        if is_signed_token(m[1], m[2]):
            yield "signed_token", *m.span()
    at, run = 0, None
    while m := KEY_B64.search(text, at):
        at = m.end()
        if run is None or not run.has(m.start()):
            run = _Run(text, m.start())
        if found := _key_at(text, m.start(), run):
            kind, at = found
            yield kind, m.start(), at
    for m in KEY_HEX.finditer(text):
        if found := key_kind(bytes.fromhex(m[0][: len(m[0]) // 2 * 2])):
            yield found[0], m.start(), m.start() + 2 * found[1]


def scan(text: str) -> list[tuple[str, int, int]]:
    """All spans of a text, in order."""
    raw = text.encode("utf-8", "surrogatepass")
    out: list[tuple[str, int, int]] = []
    low = raw.translate(_LOWER)
    if any(x in low for x in _NAMES):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    if b"AKIA" in raw:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    if b"\x01" * 24 in raw.translate(_HEXED):
        out += [("hex", *m.span()) for m in HEX.finditer(text)]
    if b"\x01" * 16 in raw.translate(_B64ED):
        out += set(_structures(text))
    order = {k: i for i, k in enumerate(KINDS)}
    return sorted(out, key=lambda s: (s[1], order[s[0]], s[2]))


def _spans(texts: pa.Array) -> pa.Array:
    rows = [[{"kind": k, "start": a, "end": b} for k, a, b in scan(t.as_py() or "")] for t in texts]
    return pa.array(rows, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])))


def mask(text: str) -> str:
    """The text with each stretch that spans cover put as one ``[SECRET]``."""
    parts, at, until = [], 0, -1
    for _, a, b in scan(text):
        if a >= until:
            parts += [text[at:a], "[SECRET]"]
        at = until = max(b, until)
    return "".join([*parts, text[at:]]) if parts else text


def _masked(texts: pa.Array) -> pa.Array:
    return pa.array([mask(t.as_py()) if t.is_valid else None for t in texts], pa.string())


def secret_spans(text: Column) -> Column:
    """The spans of a text, as array<struct<kind, start, end>>."""
    return F.arrow_udf(_spans, "array<struct<kind:string,start:int,end:int>>")(text)


def masked(text: Column) -> Column:
    """The text without its secrets; spans and text pass one Python function, so a task needs one worker."""
    return F.arrow_udf(_masked, "string")(text)


def find_secrets(docs: DataFrame, text: str = "text", out: str = "secrets") -> DataFrame:
    """Adds the spans of each whole text; a column named ``out`` is replaced."""
    return docs.withColumn(out, secret_spans(F.col(text)))


def mask_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """Replaces secrets in the texts; nulls stay."""
    return docs.withColumn(text, masked(F.col(text)))


def span_text(spans: Column) -> Column:
    """kind:start:end of each, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
