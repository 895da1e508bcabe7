"""Secret scans with structural confirmation.

Candidates are stretches of 12 bytes or more of the base64 alphabets, ``=`` and
``.``, that could hold a secret (a digit, 40 bytes, AKIA or ASIA, ``=``, two
full stops, or only hex letters; a base64 value needs a digit to count), and
armoured key blocks. A candidate is reported only if it decodes to the structure of its
kind:

- ``private_key`` / ``public_key``: base64 or hex that decodes to DER whose
  nested lengths fill the data exactly and whose fields are those of an RSA,
  EC, PKCS#8 or SubjectPublicKeyInfo key; or to the OpenSSH format with its
  nested lengths. Armoured blocks must hold such data.
- ``signed_token``: three base64url parts, the first a JSON object that names
  its algorithm, the second a JSON object, the third a signature.
- ``access_key_id``: AKIA or ASIA and 16 characters of base32. Its first 40
  bits after a leading one are an account number; the id is confirmed if that
  is a number of 12 digits.
- ``checked_token``: gh?_ tokens whose CRC-32 in base 62 agrees.
- ``hex_secret`` / ``base64_secret``: a value assigned to a name such as token
  or password, that decodes and whose digits vary as random ones do.

``confirmed`` is true where the content has the structure of its kind; the
last two kinds, and ids whose account number is none, have no structure that
could be checked, and are reported as the lower class.

Defined cases: null and empty texts hold none; rows without an id are reported
with a null id; repeated rows are reported each; several kinds in one stretch
are each reported, and what lies inside an armoured block or a confirmed token
isn't reported again; of two readings of a value's end that of a key counts;
texts are read whole; an empty table gives an empty result; other columns are
never read, so their names can't clash.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import json
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import words as W
from .common import id_text, lean, text_of

SHORTEST = 12  #: as in _ASSIGN
LONG = 40
_RUN = np.zeros(256, bool)
_RUN[[*range(48, 58), *range(65, 91), *range(97, 123), *b"+/_-=."]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_HEX = np.zeros(256, bool)
_HEX[[*range(65, 71), *range(97, 103), *b".-"]] = True
_NAMES = r"[A-Za-z0-9_-]*(?:token|secret|passw(?:or)?d|passphrase|pwd|api[_-]?key|access[_-]?key|private[_-]?key|auth|credential)[A-Za-z0-9_-]*"
_ASSIGN = re.compile(rf"(?i)(?<![A-Za-z0-9])({_NAMES})[\"']?\s{{0,4}}(?:[:=]|=>)\s{{0,4}}[\"']?([A-Za-z0-9+/_.-]{{12,}}={{0,2}})$")
_ARMOUR = re.compile(r"-----BEGIN ([A-Z0-9 ]{0,40}KEY)-----([A-Za-z0-9+/=\s:,-]{16,}?)-----END \1-----")
_TOKEN = re.compile(r"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
_JWT = re.compile(r"(?<![A-Za-z0-9_-])([A-Za-z0-9_-]{8,})\.([A-Za-z0-9_-]{2,})\.([A-Za-z0-9_-]*)")
_ID = re.compile(r"(?<![A-Za-z0-9])(?:AKIA|ASIA)([A-Z2-7]{16})(?![A-Za-z0-9])")
_B62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def der(data: bytes, depth: int = 0) -> list[tuple[int, bytes | list]] | None:
    """Nested (tag, content) if lengths fill ``data`` exactly, else None. Containers are parsed, other content is kept."""
    out: list[tuple[int, bytes | list]] = []
    at = 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, n = data[at], data[at + 1]
        at += 2
        if n & 0x80:
            k = n & 0x7F
            if not 1 <= k <= 4 or at + k > len(data):
                return None
            n = int.from_bytes(data[at : at + k], "big")
            at += k
            if n < 0x80:
                return None  # not the shortest form
        if at + n > len(data):
            return None
        body = data[at : at + n]
        at += n
        if tag & 0x20:
            inner = der(body, depth + 1) if depth < 16 else None
            if inner is None:
                return None
            out.append((tag, inner))
        else:
            out.append((tag, body))
    return out


def key_kind(data: bytes) -> tuple[str, str] | None:
    """("private_key" or "public_key", format) of decoded bytes, if they are a key."""
    if data[:15] == b"openssh-key-v1\0":
        at, fields = 15, []
        for _ in range(3):  # cipher, kdf, options
            if at + 4 > len(data):
                return None
            n = int.from_bytes(data[at : at + 4], "big")
            fields.append(data[at + 4 : at + 4 + n])
            at += 4 + n
        keys = int.from_bytes(data[at : at + 4], "big") if at + 4 <= len(data) else 0
        at += 4
        for _ in range(keys + 1 if 1 <= keys <= 16 else 0):
            if at + 4 > len(data):
                return None
            at += 4 + int.from_bytes(data[at : at + 4], "big")
        return ("private_key", "openssh") if 1 <= keys <= 16 and at == len(data) and fields[0].isascii() else None
    tree = der(data)
    if not tree or len(tree) != 1 or tree[0][0] != 0x30 or not isinstance(tree[0][1], list):
        return None
    body = tree[0][1]
    tags = [t for t, _ in body]
    if tags[:1] == [2] and len(tags) == 9 and set(tags) == {2} and len(body[1][1]) >= 32:
        return "private_key", "rsa"
    if tags[:3] == [2, 0x30, 4] and body[1][1] and body[1][1][0][0] == 6:
        return "private_key", "pkcs8"
    if tags[:2] == [2, 4] and body[0][1] == b"\1" and len(body[1][1]) in (24, 28, 32, 48, 66):
        return "private_key", "ec"
    if tags == [2, 2] and len(body[0][1]) >= 32:
        return "public_key", "rsa"
    if tags == [0x30, 3] and body[0][1] and body[0][1][0][0] == 6:
        return "public_key", "spki"
    return None


def _unbase64(text: str) -> bytes | None:
    t = text.translate(str.maketrans("-_", "+/")).rstrip("=")
    if len(t) % 4 == 1:
        return None
    try:
        return base64.b64decode(t + "=" * (-len(t) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _json_object(part: str) -> dict | None:
    data = _unbase64(part)
    try:
        got = json.loads(data) if data else None
    except (ValueError, RecursionError):
        return None
    return got if isinstance(got, dict) else None


def _varied(value: str, hexa: bool) -> bool:
    """Do the digits vary as random ones do? No digit takes over 30 %, and enough different ones occur."""
    count = Counter(value.lower() if hexa else value)
    return max(count.values()) <= max(3, 0.3 * len(value)) and len(count) >= (6 if hexa else 10)


def account(key_id: str) -> int:
    """The account number in the 16 characters after AKIA or ASIA."""
    return (int.from_bytes(base64.b32decode(key_id)[:6], "big") & 0x7FFFFFFFFF80) >> 7


def confirm(text: str, at: int, to: int) -> list[tuple[str, str, bool, int, int]]:
    """(kind, format, confirmed, from, to) of what the candidate at text[at:to] holds."""
    run = text[at:to]
    out = []
    for m in _JWT.finditer(run):
        head = _json_object(m[1])
        alg = head.get("alg") if head else None
        if isinstance(alg, str) and _json_object(m[2]) is not None and (_unbase64(m[3]) or alg.lower() == "none"):
            out.append(("signed_token", alg[:16], True, at + m.start(), at + m.end()))
    for m in _ID.finditer(run):
        out.append(("access_key_id", run[m.start() : m.start() + 4], account(m[1]) < 10**12, at + m.start(), at + m.end()))
    for m in _TOKEN.finditer(run):
        crc, want = zlib.crc32(m[1].encode()), ""
        for _ in range(6):
            crc, digit = divmod(crc, 62)
            want = _B62[digit] + want
        if want == m[2]:
            out.append(("checked_token", m[0][:4], True, at + m.start(), at + m.end()))
    # the stretches between these may hold more
    edges = [at, *(x for f in sorted(out, key=lambda f: f[3]) for x in f[3:]), to]
    for a, z in zip(edges[::2], edges[1::2], strict=True):
        if z - a >= SHORTEST:
            # '.' and '-' may end the sentence; '-' may also be the last character of a base64url value, so that counts first unless the rest is a key
            rest = text[a:z]
            found = [_value(text, a, a + end) for end in dict.fromkeys((len(rest.rstrip(".")), len(rest.rstrip(".-"))))]
            out += max(found, key=lambda x: (bool(x) and x[0][0].endswith("_key"), bool(x)))
    return out


def _name_start(text: str, at: int) -> int:
    """Where a name starts whose assignment may end at ``at``: back over quotes, blanks and signs, then over the name."""
    least = max(0, at - 12)  # two quotes, two times four blanks, two signs
    while at > least and text[at - 1] in "\"' \t\r\n\f\v:=>":
        at -= 1
    while at > 0 and (text[at - 1] in "_-" or text[at - 1].isascii() and text[at - 1].isalnum()):
        at -= 1
    return max(0, at - 1)  # and the character before, which must not be of a name


def _value(text: str, at: int, to: int) -> list[tuple[str, str, bool, int, int]]:
    """As ``confirm``, of a key or an assigned value that ends at ``to``."""
    run = text[at:to]
    m = _ASSIGN.search(text[_name_start(text, at) : to])
    value = m[2] if m else run.lstrip(".=-")
    first = to - len(value)
    if re.fullmatch(r"(?:[0-9a-fA-F]{2})+", value):
        kind = key_kind(bytes.fromhex(value))
        if kind:
            return [(*kind, True, first, first + len(value))]
        return [("hex_secret", f"{len(value) * 4} bit", False, first, to)] if m and _varied(value, True) else []
    data = _unbase64(value) if len(value) >= 16 else None
    if data:
        kind = key_kind(data)
        if kind:
            return [(*kind, True, first, first + len(value))]
        mixed = len({"u" if c.isupper() else "l" if c.islower() else "d" if c.isdigit() else "" for c in value} - {""}) == 3
        if m and mixed and "." not in value and _varied(value, False):
            return [("base64_secret", f"{len(data) * 8} bit", False, first, to)]
    return []


def _armoured(text: str) -> list[tuple[str, str, bool, int, int]]:
    out = []
    for m in _ARMOUR.finditer(text):
        body = "".join(x for x in re.sub(r"(?m)^[A-Za-z-]+: .*$", "", m[2]).split())
        data = _unbase64(body)
        kind = key_kind(data) if data else None
        if kind:
            out.append((*kind, True, m.start(), m.end()))
        elif data and "ENCRYPTED" in m[0]:
            out.append(("private_key", "encrypted", True, m.start(), m.end()))
    return out


def _key_starts(raw: np.ndarray) -> np.ndarray:
    """Where AKIA or ASIA starts."""
    out = np.zeros(len(raw), bool)
    out[:-3] = (raw[:-3] == 65) & ((raw[1:-2] == 75) | (raw[1:-2] == 83)) & (raw[2:-1] == 73) & (raw[3:] == 65)
    return out


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, kind, format, confirmed, char_at, char_to), a row for each secret; the secret itself isn't in the result."""

    def run(batches):
        for batch in batches:
            for first, part in W.passes(text_of(batch)):
                raw, off = W.raw_bytes(part)
                inside = _RUN[raw]
                prev = np.zeros(len(raw), bool)
                prev[1:] = inside[:-1]
                at = off[:-1]
                prev[at[at < len(raw)]] = False
                begin = np.flatnonzero(inside & ~prev)
                nxt = np.zeros(len(raw), bool)
                nxt[:-1] = inside[1:]
                last = off[1:] - 1
                nxt[last[last >= 0]] = False
                end = np.flatnonzero(inside & ~nxt) + 1
                long = end - begin >= SHORTEST
                begin, end = begin[long], end[long]
                digits = np.zeros(len(raw) + 1, np.int64)
                np.cumsum(_DIGIT[raw], out=digits[1:])
                good = (digits[end] > digits[begin]) | (end - begin >= LONG)
                for mark, least in ((_key_starts(raw), 1), (raw == 61, 1), (raw == 46, 2)):
                    sums = np.zeros(len(raw) + 1, np.int64)
                    np.cumsum(mark, out=sums[1:])
                    good |= sums[end] - sums[begin] >= least
                np.cumsum(_HEX[raw], out=digits[1:])
                good |= digits[end] - digits[begin] == end - begin
                begin, end = begin[good], end[good]
                owner = np.searchsorted(off, begin, side="right") - 1
                chars = np.zeros(len(raw) + 1, np.int64)
                np.cumsum((raw & 0xC0) != 0x80, out=chars[1:])
                found: list[tuple[int, str, str, bool, int, int]] = []
                for i in np.unique(owner).tolist():
                    text = part[i].as_py()
                    blocks = _armoured(text) if "-----BEGIN " in text else []  # in order, none overlaps another
                    found += [(i, *x) for x in blocks]
                    starts = [x[3] for x in blocks]
                    mine = slice(*np.searchsorted(owner, (i, i + 1)))
                    for a, z in zip((chars[begin[mine]] - chars[off[i]]).tolist(), (chars[end[mine]] - chars[off[i]]).tolist(), strict=True):
                        k = bisect.bisect_right(starts, a) - 1
                        if k < 0 or blocks[k][4] < z:
                            found += [(i, *x) for x in confirm(text, a, z)]
                cols = list(zip(*found, strict=True)) or [[]] * 6
                types = (pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(np.array(cols[0], np.int64) + first)), *(pa.array(c, t) for c, t in zip(cols[1:], types, strict=True))],
                    ["doc_id", "kind", "format", "confirmed", "char_at", "char_to"],
                )

    return id_text(docs).mapInArrow(lean(run), "doc_id long, kind string, format string, confirmed boolean, char_at long, char_to long")
