"""Secret scan with structural confirmation.

Base spans come from three patterns.  The method then looks for the beginnings of key
encodings in base64 (either alphabet, over line ends too) and hex, wherever they stand in a run of
characters, decodes as much as the encoding's own length says, and adds a span only
for what parses: private keys in DER whose nested lengths close exactly and whose fields are
those of PKCS#1, SEC1, DSA or PKCS#8; OpenSSH private-key files, field by field; PEM
bodies of these, or encrypted ones with their headers; and token headers that are
JSON with an algorithm.  Lengths are followed by decoding single headers, so a beginning that
leads nowhere costs the same in a text of any size, and all of a key is decoded only where they close.  Certificates, public keys and signatures are no secrets and
are left out.  A base span is never taken away.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from bisect import bisect_right
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame

from veraline.llm.common import small_batches, tidy

# The base patterns and their least lengths, in the order that the digest lists them.
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # at least 20 characters with the prefix
HEX = re.compile(r"[0-9a-f]{24,}")
BASE = ("assign", "access", "hex")
LEAST_VALUE = 6
#: Kinds that the method adds, in the order in which ties of start are listed.
ADDED = ("jwt", "pem_key", "ssh_key", "der_base64", "der_hex", "pem_base64", "ssh_hex")

_TOKEN = re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{6,}\.[A-Za-z0-9_-]{2,}\.[A-Za-z0-9_-]*")
_PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]{0,40}PRIVATE KEY)-----((?:\s*[A-Za-z-]{4,20}: [^\r\n]{0,200}\r?\n)*)([A-Za-z0-9+/=\s]+)-----END \1-----")
_ENCRYPTED = re.compile(r"DEK-Info: [A-Z0-9-]{3,40},([0-9A-Fa-f]{16}|[0-9A-Fa-f]{32})\b")
# Where an encoding may begin: a DER sequence of a possible length, the magic words of a key file.
_BASE64_START = re.compile(r"(?=M[A-I][A-Za-z0-9+/_-]{14}|b3BlbnNzaC1rZXktdjE|LS0tLS1CRUdJTi)")
_HEX_START = re.compile(r"(?=30(?:8[123]|[0-7][0-9A-Fa-f])[0-9A-Fa-f]{28}|(?i:6f70656e7373682d6b65792d7631)00)")
_PEM_HEAD = re.compile(r"-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY-----")
_BLOCK = re.compile(r"[A-Za-z0-9+/_-]+(?:\r?\n[ \t]*[A-Za-z0-9+/_-]+)*")
_PLAIN_ALPHABET = str.maketrans("-_", "+/")
_RUN, _LINE_END = re.compile(r"[A-Za-z0-9+/_-]+"), re.compile(r"\r?\n[ \t]*")
_HEX_RUN = re.compile(r"[0-9A-Fa-f]+")
_SSH_MAGIC = b"openssh-key-v1\0"
_INTEGER, _OCTETS, _OID, _SEQUENCE = 0x02, 0x04, 0x06, 0x30
#: Bytes of a private key in DER or of a key file, at least and at most.
LEAST_KEY, MOST_KEY = 24, 1 << 16
_PBE = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))


def _header(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """(tag, start, end) of the contents of the DER value at `at`; None if its length isn't well formed or passes the end."""
    if end - at < 2 or data[at] & 0x1F == 0x1F:
        return None
    tag, size, at = data[at], data[at + 1], at + 2
    if size & 0x80:
        n = size & 0x7F
        if not 1 <= n <= 4 or end - at < n:
            return None
        size, at = int.from_bytes(data[at : at + n], "big"), at + n
        if size < 0x80 or n > 1 and not size >> (8 * (n - 1)):
            return None
    return (tag, at, at + size) if size <= end - at else None


def _fields(data: bytes, start: int, end: int) -> list[tuple[int, int, int]] | None:
    """The values in data[start:end], if they fill it exactly and so do those inside them."""
    out, todo = [], [(start, end, 0)]
    while todo:
        at, stop, depth = todo.pop()
        while at < stop:
            found = _header(data, at, stop)
            if not found or depth > 12:
                return None
            if not depth:
                out.append(found)
            if found[0] & 0x20:
                todo.append((found[1], found[2], depth + 1))
            at = found[2]
    return out


def is_der_key(data: bytes) -> bool:
    """A DER sequence that fills the bytes and has the fields of a private key."""
    top = _header(data, 0, len(data))
    if len(data) < LEAST_KEY or not top or top[0] != _SEQUENCE or top[2] != len(data):
        return False
    fields = _fields(data, top[1], top[2])
    if not fields:
        return False
    tags = [t for t, _, _ in fields]
    first = data[fields[0][1] : fields[0][2]]
    if tags[0] == _INTEGER:
        if first not in (b"\0", b"\1"):
            return False
        rsa = tags[:9] == [_INTEGER] * 9 and tags[9:] in ([], [_SEQUENCE])
        dsa = tags == [_INTEGER] * 6
        sec1 = first == b"\1" and tags[:2] == [_INTEGER, _OCTETS] and set(tags[2:]) <= {0xA0, 0xA1}
        pkcs8 = tags[:3] == [_INTEGER, _SEQUENCE, _OCTETS] and set(tags[3:]) <= {0xA0, 0xA1, 0x81} and data[fields[1][1]] == _OID
        return rsa or dsa or sec1 or pkcs8
    # an encrypted one names a password-based scheme
    return tags == [_SEQUENCE, _OCTETS] and data[fields[0][1]] == _OID and any(data[fields[0][1] + 2 :].startswith(x) for x in _PBE)


Peek = Callable[[int, int], bytes]


def _ssh_size(peek: Peek) -> int:
    """Bytes of the OpenSSH private-key file at the beginning; 0 if its length-led fields aren't all there.  Only lengths and short fields are looked at."""
    if peek(0, len(_SSH_MAGIC)) != _SSH_MAGIC:
        return 0
    at = len(_SSH_MAGIC)

    def field(most: int) -> tuple[int, int] | None:
        """(start, size) of the next field, if it's no longer than `most` and all there."""
        nonlocal at
        head = peek(at, 4)
        size, start = int.from_bytes(head, "big"), at + 4
        if len(head) < 4 or size > most or size and not peek(start + size - 1, 1):
            return None
        at = start + size
        return start, size

    cipher, kdf, options = field(64), field(64), field(1024)
    if not cipher or not kdf or not options or not cipher[1] or not kdf[1] or (peek(*cipher) == b"none") != (peek(*kdf) == b"none"):
        return 0
    n, at = int.from_bytes(peek(at, 4), "big"), at + 4
    if not 1 <= n <= 16:
        return 0
    for _ in range(n):
        blob = field(MOST_KEY)
        if not blob or not peek(blob[0] + 4, 6).startswith((b"ssh-", b"ecdsa-", b"sk-")):
            return 0
    private = field(MOST_KEY)
    if not private or not private[1] or private[1] % 8 or peek(*cipher) == b"none" and peek(private[0], 4) != peek(private[0] + 4, 4):
        return 0
    return at if at <= MOST_KEY else 0


def ssh_key_size(data: bytes) -> int:
    """_ssh_size() of whole bytes."""
    return _ssh_size(lambda k, n: data[k : k + n])


def _der_size(peek: Peek) -> int:
    """Bytes of the DER sequence at the beginning if its outer values, whose headers alone are looked at, begin as a private key's do and fill it; else 0."""

    def header(at: int, end: int) -> tuple[int, int, int] | None:
        data = peek(at, 6)
        if len(data) < 2 or data[0] & 0x1F == 0x1F:
            return None
        size, n = data[1], 0
        if size & 0x80:
            n = size & 0x7F
            size = int.from_bytes(data[2 : 2 + n], "big")
            if not 1 <= n <= 4 or len(data) < 2 + n or size < 0x80 or n > 1 and not size >> (8 * (n - 1)):
                return None
        start = at + 2 + n
        return (data[0], start, start + size) if start + size <= end else None

    top = header(0, MOST_KEY)
    if not top or top[0] != _SEQUENCE or top[2] < LEAST_KEY:
        return 0
    at, count = top[1], 0
    while at < top[2]:
        found = header(at, top[2])
        count += 1
        if not found or count > 12 or count == 1 and not (found[0] == _SEQUENCE or found[0] == _INTEGER and found[2] - found[1] == 1 and peek(found[1], 1) in (b"\0", b"\1")):
            return 0
        at = found[2]
    return top[2]


def _may_be_der(head: bytes) -> bool:
    """Whether the first nine bytes are a sequence's header and a version's, or another sequence's."""
    at = 2 + (head[1] & 0x7F if head[1] & 0x80 else 0)
    return at < len(head) and (head[at] == _SEQUENCE or head[at : at + 2] == b"\2\1")


def _decoded(text: str) -> bytes | None:
    body = re.sub(r"\s", "", text).rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (ValueError, binascii.Error):
        return None


class _Block:
    """Base64 characters over line ends, from a place in the text on; taken apart once for all candidates in them."""

    def __init__(self, text: str, at: int):
        self.at, self.end = at, _BLOCK.match(text, at).end()
        parts, self.places, self.before, n = [], [], [], 0
        while at < self.end:
            run = _RUN.match(text, at)
            self.places.append(at)
            self.before.append(n)
            parts.append(run[0])
            n += len(run[0])
            gap = _LINE_END.match(text, run.end())
            at = gap.end() if gap else self.end
        self.body = "".join(parts).translate(_PLAIN_ALPHABET)

    def index(self, at: int) -> int:
        k = bisect_right(self.places, at) - 1
        return self.before[k] + at - self.places[k]

    def place(self, index: int) -> int:
        """Where, in the text, the characters before index end."""
        k = bisect_right(self.before, index - 1) - 1
        return self.places[k] + index - self.before[k]

    def peek(self, index: int) -> Peek:
        body = self.body

        def peek(k: int, n: int) -> bytes:
            a = index + k // 3 * 4
            part = body[a : a + (k % 3 + n + 2) // 3 * 4]
            part = part[:-1] if len(part) % 4 == 1 else part
            return binascii.a2b_base64(part + "=" * (-len(part) % 4))[k % 3 : k % 3 + n]

        return peek


def _padded(text: str, end: int, chars: int) -> int:
    """The end with the padding that belongs to so many characters."""
    while end < len(text) and text[end] == "=" and (chars + 1) % 4 != 1:
        end, chars = end + 1, chars + 1
    return end


def _confirmed_pem(m: re.Match) -> bool:
    data, iv = _decoded(m[3]), _ENCRYPTED.search(m[2])
    return bool(data and (is_der_key(data) or ssh_key_size(data) or iv and len(data) % (len(iv[1]) // 2) == 0))


def _wrapped_pem(peek: Peek) -> int:
    """Bytes of the PEM private key at the beginning, confirmed; 0 if there's none.  As much is decoded as it takes to see its end or that it has none."""
    n = 1024
    while True:
        data = peek(0, n)
        text = data.decode("latin-1")
        head = _PEM_HEAD.match(text)
        if not head:
            return 0
        stop = text.find("-----", head.end())
        if stop >= 0 and len(text) >= stop + 80 or len(data) < n:
            m = _PEM.match(text)
            return m.end() if m and _confirmed_pem(m) else 0
        if n > 2 * MOST_KEY:
            return 0
        n *= 2


def _base64_key(text: str, block: _Block, at: int) -> tuple[str, int] | None:
    """(kind, end) of the key whose base64 begins at `at`."""
    index = block.index(at)
    if text[at] == "M" and not _may_be_der(binascii.a2b_base64(block.body[index : index + 12])):
        return None
    peek = block.peek(index)
    kind, size = {"b": ("ssh_key", _ssh_size), "L": ("pem_base64", _wrapped_pem), "M": ("der_base64", _der_size)}[text[at]]
    size = size(peek)
    if size < LEAST_KEY:
        return None
    chars = -(-size * 4 // 3)
    if len(block.body) < index + chars or kind == "der_base64" and not is_der_key(peek(0, size)):
        return None
    return kind, _padded(text, block.place(index + chars), chars)


def _hex_key(text: str, at: int) -> tuple[str, int] | None:
    """(kind, end) of the key whose hex begins at `at`."""

    def peek(k: int, n: int) -> bytes:
        run = _HEX_RUN.match(text, at + 2 * k, at + 2 * k + 2 * n)
        return bytes.fromhex(run[0][: len(run[0]) // 2 * 2]) if run else b""

    if text[at] == "3":
        size = _der_size(peek)
        data = peek(0, size)
        return ("der_hex", at + 2 * size) if size and len(data) == size and is_der_key(data) else None
    size = _ssh_size(peek)
    return ("ssh_hex", at + 2 * size) if size and len(peek(0, size)) == size else None


def is_signed_token(token: str) -> bool:
    """Whether the first two parts are base64url JSON objects and the header names an algorithm."""
    try:
        header, body = (json.loads(base64.urlsafe_b64decode(x + "=" * (-len(x) % 4))) for x in token.split(".")[:2])
    except (ValueError, binascii.Error, RecursionError):
        return False
    return isinstance(header, dict) and isinstance(header.get("alg"), str) and isinstance(body, dict)


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the three patterns, failing matches dropped."""
    out = []
    if "=" in text or ":" in text:
        out += [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    if "AKIA" in text:
        out += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]
    return out


def added_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of candidates whose structure is confirmed by decoding; of keys inside one another the outermost."""
    out, done = [], 0
    if "eyJ" in text:
        out += [(m.start(), "jwt", m.end()) for m in _TOKEN.finditer(text) if is_signed_token(m[0])]
    if "-----BEGIN " in text:
        out += [(m.start(), "pem_key", m.end()) for m in _PEM.finditer(text) if _confirmed_pem(m)]
    block = None
    for m in _BASE64_START.finditer(text):
        if m.start() >= done:
            if not block or m.start() >= block.end:
                block = _Block(text, m.start())
            if found := _base64_key(text, block, m.start()):
                done = found[1]
                out.append((m.start(), *found))
    done = 0
    for m in _HEX_START.finditer(text):
        if m.start() >= done and (found := _hex_key(text, m.start())):
            done = found[1]
            out.append((m.start(), *found))
    return out


_RANK = {k: i for i, k in enumerate((*BASE, *ADDED))}


def joined(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, k, b in sorted(spans, key=lambda x: (x[0], _RANK[x[1]], x[2])))


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, n_confirmed long, base_sha256 string, spans string"


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: counts and spans in code points, ends exclusive.

    A null text counts as empty: no spans and the digest of an empty string.
    Repeated rows and null doc_ids give a row each.  Texts are read whole; no
    shuffle, one pass.
    """
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            rows = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                base = base_spans(text) if text else []
                more = added_spans(text) if text else []
                n = [sum(k == x for _, k, _ in base) for x in BASE]
                rows.append((i, *n, len(more), hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + more)))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (*[pa.int64()] * 5, pa.string(), pa.string()), strict=True)], names=["doc_id", "n_assign", "n_access", "n_hex", "n_confirmed", "base_sha256", "spans"])

    return docs.select(docs["doc_id"].cast("long"), "text").mapInArrow(tidy(run), SCHEMA)
