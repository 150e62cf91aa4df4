"""Secret scans: base patterns, and candidates that are decoded and parsed before they are reported."""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, null_ids, set_ids, texts

#: All kinds, in the order of their numbers from 1: three base patterns, then what is confirmed by structure.
KINDS = ("assign", "access", "hex", "key", "token")

_ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ASSIGN_WORDS = ("passw", "secret", "token", "api")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")

# Registered names of signature and key management algorithms in token headers.
SIGNED = frozenset("HS256 HS384 HS512 RS256 RS384 RS512 ES256 ES256K ES384 ES512 PS256 PS384 PS512 EdDSA Ed25519 Ed448 none".split())
SEALED = frozenset(
    "RSA1_5 RSA-OAEP RSA-OAEP-256 RSA-OAEP-384 RSA-OAEP-512 A128KW A192KW A256KW dir ECDH-ES ECDH-ES+A128KW ECDH-ES+A192KW ECDH-ES+A256KW "
    "A128GCMKW A192GCMKW A256GCMKW PBES2-HS256+A128KW PBES2-HS384+A192KW PBES2-HS512+A256KW".split())
CIPHERS = {"DES-CBC": 8, "DES-EDE3-CBC": 8, "AES-128-CBC": 16, "AES-192-CBC": 16, "AES-256-CBC": 16}

#: A key encoding takes two length bytes at most, which any key in use fits; levels of encodings within encodings.
MOST_BYTES, DEPTH = (1 << 16) + 3, 2

#: Dot-joined runs whose first opens a JSON object; every run is read once.
_TOKEN = re.compile(r"(?<![A-Za-z0-9_-])(e[wy][A-Za-z0-9_-]{6,}+)\.([A-Za-z0-9_-]*+)\.([A-Za-z0-9_-]*+)(?:\.([A-Za-z0-9_-]*+)\.([A-Za-z0-9_-]*+))?+")
#: Starts of base64 text that can be a sequence with nested lengths, the magic of an OpenSSH key, or armour or a token encoded once more.
_START = re.compile(r"(?<![A-Za-z0-9+/])(?:M[A-P][A-Za-z0-9+/_-]{10}|b3BlbnNzaC1rZXktdjE|LS0tLS1CRUdJTi|ZX[lcd][A-Za-z0-9+/_-]{20})")
_RUN = re.compile(r"[A-Za-z0-9+/_-]++")
#: Between lines of one encoding: line ends, also written as escapes, and blanks where lines were joined.
_BREAK = re.compile(r"(?:\\r)?(?:\\n)?[\r\n]{0,2}[ \t]{0,8}")
_HEX_ANY = re.compile(r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{32,}+")
_ARMOUR_BEFORE = re.compile(r"-----BEGIN [A-Z0-9 ]{0,40}-----(?:\\r|\\n|\s){0,8}\Z")
_ARMOUR_AFTER = re.compile(r"={0,2}(?:\\r|\\n|\s){0,8}-----END [A-Z0-9 ]{0,40}-----")
_LOCKED = re.compile(
    r"-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY-----(?:\\r|\\n|\s){0,8}Proc-Type: 4,ENCRYPTED(?:\\r|\\n|\s){1,8}DEK-Info: ([A-Z0-9-]{1,20}),[0-9A-Fa-f]{16,32}(?:\\r|\\n|\s){1,8}")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base patterns, leftmost without overlap per kind; matches that fail their length go."""
    out = []
    low = text.lower()
    if any(w in low for w in _ASSIGN_WORDS):
        out += [(1, m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end() - m.start(1) >= 8]
    if "AKIA" in text:
        out += [(2, *m.span()) for m in _ACCESS.finditer(text)]
    return out + [(3, *m.span()) for m in _HEX.finditer(text)]


def elements(buf: bytes, lo: int, hi: int) -> list[tuple[int, int, int]] | None:
    """(tag, start, end) of the elements that fill [lo, hi) exactly by their definite lengths in shortest form; None if none do."""
    out = []
    while lo < hi:
        if hi - lo < 2:
            return None
        tag, n, at = buf[lo], buf[lo + 1], lo + 2
        if n > 0x82 or n == 0x80:
            return None
        if n > 0x80:
            size = n - 0x80
            if at + size > hi or buf[at] == 0:
                return None
            n, at = int.from_bytes(buf[at : at + size], "big"), at + size
            if n < 0x80:
                return None
        if at + n > hi:
            return None
        out.append((tag, at, at + n))
        lo = at + n
    return out


def wrapped(buf: bytes, lo: int, hi: int) -> bool:
    """The octets are themselves whole elements: a key within its algorithm's envelope."""
    inner = elements(buf, lo, hi)
    return bool(inner) and len(inner) == 1 and inner[0][0] in (0x30, 0x04, 0x02) and (inner[0][0] != 0x30 or bool(elements(buf, *inner[0][1:])))


def named(buf: bytes, part: tuple[int, int, int]) -> bool:
    """A sequence that begins with an object identifier: an algorithm or a content type."""
    inner = elements(buf, part[1], part[2])
    return bool(inner) and inner[0][0] == 0x06 and inner[0][2] > inner[0][1]


def der_key(buf: bytes) -> str | None:
    """The form of a private key whose encoding fills ``buf``; public keys and certificates have none."""
    outer = elements(buf, 0, len(buf))
    if not outer or len(outer) != 1 or outer[0][0] != 0x30:
        return None
    parts = elements(buf, outer[0][1], outer[0][2])
    if not parts or any(start == end for tag, start, end in parts if tag == 0x02):
        return None
    tags = [p[0] for p in parts]
    version = int.from_bytes(buf[parts[0][1] : parts[0][2]], "big") if tags[0] == 0x02 and parts[0][2] - parts[0][1] == 1 else None
    if version in (0, 1) and tags[:9] == [0x02] * 9 and tags[9:] in ([], [0x30]):
        return "rsa"
    if version == 0 and tags == [0x02] * 6:
        return "dsa"
    if version == 1 and tags[1] == 0x04 and len(tags) <= 4 and set(tags[2:]) <= {0xA0, 0xA1} and all(elements(buf, *p[1:]) for p in parts[2:]):
        return "ec"
    if version in (0, 1) and tags[1:3] == [0x30, 0x04] and set(tags[3:]) <= {0xA0, 0x81, 0xA1} and named(buf, parts[1]) and wrapped(buf, *parts[2][1:]):
        return "pkcs8"
    if tags == [0x30, 0x04] and named(buf, parts[0]) and parts[1][2] - parts[1][1] >= 16:
        return "pkcs8-encrypted"
    if version == 3 and tags[1:] in ([0x30], [0x30, 0x30]) and named(buf, parts[1]):
        return "pkcs12"
    return None


def der_size(head: bytes) -> int | None:
    """Bytes of a sequence by its header, if a key can begin so: a version or an algorithm comes first."""
    if len(head) < 6 or head[0] != 0x30 or head[1] == 0x80 or head[1] > 0x82:
        return None
    at = 2 + max(0, head[1] - 0x80)
    size = at + (head[1] if head[1] < 0x80 else int.from_bytes(head[2:at], "big"))
    return size if size >= 24 and (head[at : at + 2] == b"\x02\x01" or head[at] == 0x30) else None


def openssh_size(buf: bytes) -> int | None:
    """Bytes of an OpenSSH private key: magic, three strings, a number of keys, so many strings, the private part."""
    at = 15
    if buf[:at] != b"openssh-key-v1\0":
        return None

    def number(at: int) -> int | None:
        return int.from_bytes(buf[at : at + 4], "big") if at + 4 <= len(buf) else None

    def skip(at: int | None) -> int | None:
        n = number(at) if at is not None else None
        return at + 4 + n if n is not None and at + 4 + n <= len(buf) else None

    for _ in range(3):
        at = skip(at)
    keys = number(at) if at is not None else None
    if not keys or keys > 16:
        return None
    at += 4
    for _ in range(keys + 1):
        before, at = at, skip(at)
    return at if at is not None and at - before - 4 >= 16 and (at - before - 4) % 8 == 0 else None


def unsealed(part: str) -> bytes | None:
    try:
        return base64.b64decode(part.translate(_URL) + "=" * (-len(part) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


_URL = str.maketrans("-_", "+/")


def token_end(m: re.Match) -> tuple[str, int] | None:
    """Form and end of a signed or sealed token: its header is a JSON object with a known algorithm, all its parts decode."""
    head = unsealed(m[1])
    try:
        header = json.loads(head) if head else None
    except (ValueError, RecursionError):
        return None
    if not isinstance(header, dict) or not isinstance(header.get("alg"), str):
        return None
    parts = [unsealed(m[i]) if m[i] is not None else None for i in range(2, 6)]
    if header["alg"] in SEALED and isinstance(header.get("enc"), str):
        return ("jwe", m.end(5)) if all(p is not None for p in parts) and parts[2] else None
    if header["alg"] in SIGNED and parts[0] is not None and parts[1] is not None and (parts[1] or (header["alg"] == "none" and parts[0])):
        return "jws", m.end(3)
    return None


def gathered(text: str, at: int, need: int) -> tuple[str, int]:
    """Up to ``need`` base64 characters from ``at`` on, over line ends, and the place behind the last."""
    out, have, end = [], 0, at
    while have < need and (m := _RUN.match(text, at)):
        run = m[0].split("-----", 1)[0][: need - have]  # five dashes are armour
        if not run:
            break
        out.append(run)
        have, end = have + len(run), m.start() + len(run)
        if len(run) < len(m[0]):
            break
        at = _BREAK.match(text, end).end()
    return "".join(out), end


def armoured(text: str, start: int, end: int) -> tuple[int, int]:
    """The span with its padding, and with the armour lines right around it."""
    while end < len(text) and text[end] == "=":
        end += 1
    if m := _ARMOUR_AFTER.match(text, end):
        end = m.end()
    lo = max(0, start - 80)
    if m := _ARMOUR_BEFORE.search(text[lo:start]):
        start = lo + m.start()
    return start, end


def encoded_key(text: str, at: int, depth: int) -> tuple[str, str, int, int] | None:
    """(kind, form, start, end) if the base64 text that starts at ``at`` decodes to a key, or to text that holds one."""
    if text.startswith("M", at):
        size = der_size(unsealed(text[at : at + 12]) or b"")
        if size is None:
            return None
        need = (size * 8 + 5) // 6
        run, end = gathered(text, at, need)
        if len(run) < need or (end < len(text) and _RUN.match(text, end) and text[end] not in "-_" and text[end - 1] != "="):
            return None
        form = der_key((unsealed(run) or b"")[:size])
        return ("key", form, at, end) if form else None
    run = gathered(text, at, MOST_BYTES * 4 // 3)[0]
    raw = unsealed(run[: len(run) - (len(run) % 4 == 1)])
    if raw is None:
        return None
    if size := openssh_size(raw):
        return "key", "openssh", at, gathered(text, at, (size * 8 + 5) // 6)[1]
    if depth and text.startswith(("LS0", "ZX"), at):
        found = structural(raw.decode("latin-1"), depth - 1)
        if found:  # what follows on the next line need not belong to it
            end = gathered(text, at, (max(s[3] for s in found) * 8 + 5) // 6)[1]
            rest = _RUN.match(text, end)
            return found[0][0], found[0][1], at, rest.end() if rest else end
    return None


def structural(text: str, depth: int = DEPTH) -> list[tuple[str, str, int, int]]:
    """(kind, form, start, end) of the candidates that decode and parse, by start; none inside another of its kind."""
    out: list[tuple[str, str, int, int]] = []
    for m in _TOKEN.finditer(text):
        if found := token_end(m):
            out.append(("token", found[0], m.start(), found[1]))
    after = 0
    for m in _START.finditer(text):
        if m.start() >= after and (found := encoded_key(text, m.start(), depth)):
            start, end = armoured(text, found[2], found[3]) if found[0] == "key" else found[2:]
            out.append((*found[:2], start, end))
            after = end
    if "DEK-Info: " in text:
        for m in _LOCKED.finditer(text):
            run, end = gathered(text, m.end(), MOST_BYTES * 4 // 3)
            raw, block = unsealed(run), CIPHERS.get(m[1])
            if raw and block and len(raw) >= 24 and len(raw) % block == 0:
                out.append(("key", "pem-encrypted", m.start(), armoured(text, m.end(), end)[1]))
    for m in _HEX_ANY.finditer(text):
        run = m[0]
        if len(run) % 2 == 0:
            raw = bytes.fromhex(run)
            if raw[0] == 0x30 and (form := der_key(raw)):
                out.append(("key", form, *m.span()))
            elif openssh_size(raw) == len(raw):
                out.append(("key", "openssh", *m.span()))
            elif depth and raw[:1] in b"-e" and raw.isascii() and (found := structural(raw.decode(), depth - 1)):
                out.append((found[0][0], found[0][1], *m.span()))
    return sorted(out, key=lambda s: (s[2], s[0], s[3]))


_SPAN = pa.struct([("start", pa.int64()), ("no", pa.int32()), ("end", pa.int64()), ("base", pa.bool_()), ("form", pa.string())])


def spans_of(text: str) -> list[tuple]:
    """(start, kind number, end, base, form) of all spans, by start, then kind."""
    spans = [(a, k, b, True, KINDS[k - 1]) for k, a, b in base_spans(text)]
    return sorted(spans + [(a, KINDS.index(kind) + 1, b, False, form) for kind, form, a, b in structural(text)])


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: (doc_id, spans array of (start, no, end, base, form)), ``no`` the place in KINDS.

    Base spans are those of three fixed patterns: assignments to secret names, access key ids, long
    hexadecimal runs. Candidates with a structure are decoded, from base64 or hexadecimal, over line
    ends, also as escapes, and up to DEPTH encodings deep. They are reported only if they parse: private keys whose nested lengths
    fit to the last byte, OpenSSH keys, encrypted PEM keys of whole blocks, signed or sealed tokens whose header is a
    JSON object with a known algorithm. Public keys and certificates are no secrets. Offsets count code points, ends are exclusive.

    A null or empty text has no spans; a null id stays null; repeated rows are scanned each; very long texts are
    scanned whole, by their own task; an empty table gives no rows; other columns are not looked at;
    bytes that are no UTF-8 count as one sign each and belong to no span.
    """
    rows = set_ids(texts(docs, id_col, text_col)).withColumn("text", F.col("text").cast("binary"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[dict(zip(("start", "no", "end", "base", "form"), s)) for s in spans_of(t.as_py().decode("utf-8", "replace"))] for t in batch["text"]]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(spans, pa.list_(_SPAN))], ["doc_id", "spans"])

    return null_ids(rows.mapInArrow(run, "doc_id long, spans array<struct<start:long,no:int,end:long,base:boolean,form:string>>"))


def listed(spans: Column) -> Column:
    kind = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["no"])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kind(s), s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_digests(found: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_added, forms) of the rows of ``secrets``."""
    base, added = F.filter("spans", lambda s: s["base"]), F.filter("spans", lambda s: ~s["base"])
    numbers = F.transform(base, lambda s: s["no"])
    counts = [(F.size(numbers) - F.size(F.array_remove(numbers, n))).cast("bigint").alias(f"n_{k}") for n, k in enumerate(KINDS[:3], 1)]
    return found.select(
        "doc_id", *counts, F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"),
        F.size(added).cast("bigint").alias("n_added"), F.array_join(F.transform(added, lambda s: s["form"]), ",").alias("forms"))
