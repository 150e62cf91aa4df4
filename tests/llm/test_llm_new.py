"""Filter audit, secret scans and phrase collocations against plain forms."""

import base64
import hashlib
import itertools
import json
import random
import re
from collections import Counter

import numpy as np
import pytest
from llm_cases import SCHEMA, no_docs, odd_docs, odd_rows, prose

from contestlab.llm import audit, collocations, credentials, private
from contestlab.llm.common import row_key, texts


# ---- filter audit


def failed_plain(text: str) -> str:
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    out = "A" if len(words) < 50 else ""
    out += "B" if 100 * len(set(words)) < 65 * len(words) else ""
    out += "C" if 100 * len(re.findall("[A-Z]", text)) > 5 * len(text) else ""
    return out + ("D" if re.search(r"[#$%&*|]", text) else "")


def audit_plain(rows, labels):
    smallest = {}
    for i, t, _ in rows:
        smallest[t or ""] = min(smallest.get(t or "", 2**70), -(2**63) if i is None else i)
    docs = []
    for i, t, part in rows:
        failed = failed_plain(t or "") + ("E" if smallest[t or ""] < (-(2**63) if i is None else i) else "")
        docs.append((part or "", failed, (i, "q") in labels, (i, "t") in labels))
    orders = ["".join(p) for p in itertools.permutations("ABCDE")]
    out, sums = {}, Counter()
    for part, order in itertools.product({d[0] for d in docs}, orders):
        left = [d for d in docs if d[0] == part]
        for step, f in enumerate(order, 1):
            gone = [d for d in left if f in d[1]]
            left = [d for d in left if f not in d[1]]
            all_failing = [d for d in docs if d[0] == part and f in d[1]]
            out[part, order, step] = (len(left), len(gone), len(all_failing) - len(gone), sum(d[1] == f for d in all_failing), sum(d[2] for d in gone), sum(d[3] for d in gone))
            sums[part, f] += len(gone)
    return {(p, o, s): (*v, sums[p, o[s - 1]]) for (p, o, s), v in out.items()}


def test_path_counts_are_factorials():
    reaching, leaving = audit.path_counts(5)
    fact = [1, 1, 2, 6, 24, 120]
    assert all(reaching[s] == fact[s.bit_count()] and leaving[s] == fact[5 - s.bit_count()] for s in range(32))


def test_filter_audit_walks_every_order(spark):
    rng = random.Random(11)
    texts = [prose(rng, rng.choice([3, 49, 50, 60, 200]), rng.choice([20, 400])) for _ in range(60)]
    texts = [t.upper() if i % 7 == 0 else t + " $" if i % 5 == 0 else t for i, t in enumerate(texts)]
    rows = [(i, rng.choice(texts), rng.choice(["s", "t", None])) for i in range(200)]
    rows += [(i, t, lang) for i, t, lang, *_ in odd_rows()]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 200, 2)] + [(3, 1, 0), (3, 0, 1), (None, 1, 1)]
    marks = {(i, "q") for i, q, _ in labels if q == 1 and i is not None} | {(i, "t") for i, _, t in labels if t == 1 and i is not None}
    docs = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], "doc_id long, text string, source string, part string, same string, mask string")
    got = audit.filter_audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    want = audit_plain(rows, marks)
    assert len(got) == len(want) == 600 * 4
    assert {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in got} == want
    for r in got:
        assert r.kept >= 0 and r.removed + r.redundant >= r.unique_fails


def test_filter_audit_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.filter_audit(no_docs(spark), none).count() == 0
    got = audit.filter_audit(odd_docs(spark), none).collect()
    assert len(got) == 600 and not any(r.good_lost or r.toxic_lost for r in got)


# ---- secret scans


def tlv(tag: int, body: bytes) -> bytes:
    n = len(body)
    size = bytes([n]) if n < 0x80 else bytes([0x80 + (n.bit_length() + 7) // 8]) + n.to_bytes((n.bit_length() + 7) // 8, "big")
    return bytes([tag]) + size + body


def integer(rng: random.Random, bits: int) -> bytes:
    n = rng.getrandbits(bits) | 1 << (bits - 2)
    return tlv(2, n.to_bytes(bits // 8 + 1, "big").lstrip(b"\0") if n.to_bytes(bits // 8, "big")[0] < 0x80 else n.to_bytes(bits // 8 + 1, "big"))


def keys(rng: random.Random) -> dict[str, bytes]:
    version, rsa_id, ec_id = tlv(2, b"\0"), bytes.fromhex("06092a864886f70d010101"), bytes.fromhex("06072a8648ce3d0201")
    rsa = tlv(0x30, version + integer(rng, 1024) + tlv(2, b"\1\0\1") + integer(rng, 1024) + b"".join(integer(rng, 512) for _ in range(5)))
    ec = tlv(0x30, tlv(2, b"\1") + tlv(4, rng.randbytes(32)) + tlv(0xA0, bytes.fromhex("06082a8648ce3d030107")) + tlv(0xA1, tlv(3, b"\0" + rng.randbytes(65))))
    small = tlv(0x30, version + tlv(0x30, bytes.fromhex("06032b6570")) + tlv(4, tlv(4, rng.randbytes(32))))
    text = lambda b: len(b).to_bytes(4, "big") + b
    ssh = b"openssh-key-v1\0" + text(b"none") + text(b"none") + text(b"") + (1).to_bytes(4, "big") + text(rng.randbytes(51)) + text(rng.randbytes(136))
    return {
        "rsa": rsa, "ec": ec, "openssh": ssh, "dsa": tlv(0x30, version + b"".join(integer(rng, 512) for _ in range(5))), "pkcs8": small,
        "pkcs8 rsa": tlv(0x30, version + tlv(0x30, rsa_id + tlv(5, b"")) + tlv(4, rsa)), "pkcs8 ec": tlv(0x30, version + tlv(0x30, ec_id) + tlv(4, ec)),
        "pkcs8-encrypted": tlv(0x30, tlv(0x30, bytes.fromhex("06092a864886f70d01050d") + tlv(0x30, rng.randbytes(8))) + tlv(4, rng.randbytes(128))),
    }


def token(header: dict, payload: dict, signature: bytes) -> str:
    enc = lambda b: base64.urlsafe_b64encode(b).decode().rstrip("=")
    return ".".join([enc(json.dumps(header).encode()), enc(json.dumps(payload).encode()), enc(signature)])


def folded(text: str, width: int, by: str) -> str:
    return by.join(text[i : i + width] for i in range(0, len(text), width))


def test_keys_are_found_in_every_spelling():
    rng = random.Random(5)
    for name, raw in keys(rng).items():
        b64, form = base64.b64encode(raw).decode(), name.split()[0]
        spellings = {
            "run": b64, "lines": folded(b64, 64, "\n"), "dos": folded(b64, 76, "\r\n"), "escaped": folded(b64, 64, "\\n"), "joined": folded(b64, 64, " "), "url": base64.urlsafe_b64encode(raw).decode(),
            "hex": raw.hex(), "HEX": raw.hex().upper(), "armour": f"-----BEGIN X PRIVATE KEY-----\n{folded(b64, 64, chr(10))}\n-----END X PRIVATE KEY-----",
        }
        spellings["twice"] = base64.b64encode(spellings["armour"].encode()).decode()
        for how, spelled in spellings.items():
            for before, after in (("", ""), ("el niño 😀 key: ", " und so weiter"), ('{"k":"', '"}')):
                spans = credentials.structural(before + spelled + after)
                assert [(k, f) for k, f, *_ in spans] == [("key", form)], (name, how, before)
                assert spans[0][2:] == (len(before), len(before + spelled)), (name, how, before)


def test_what_does_not_parse_is_not_reported():
    rng = random.Random(6)
    raw = keys(rng)["rsa"]
    public = tlv(0x30, tlv(0x30, bytes.fromhex("06092a864886f70d010101") + tlv(5, b"")) + tlv(3, b"\0" + rng.randbytes(140)))
    cut = bytearray(raw)
    cut[len(raw) // 2 - 40 : len(raw) // 2 - 40] = b"\0"
    sealed = json.dumps({"alg": "HS256"}).encode()
    for bad in (public, raw[:-3], bytes(cut), rng.randbytes(600), tlv(0x30, rng.randbytes(300)), b"openssh-key-v1\0" + rng.randbytes(200), tlv(0x30, integer(rng, 1024) + tlv(2, b"\1\0\1"))):
        for spelled in (base64.b64encode(bad).decode(), bad.hex(), f"-----BEGIN RSA PRIVATE KEY-----\n{base64.b64encode(bad).decode()}\n-----END RSA PRIVATE KEY-----"):
            assert credentials.structural(f"a {spelled} b") == []
    for head in (b"{}", b'{"alg":"XX1"}', b'{"alg":7}', b"[1]", b'{"alg":"HS256"', sealed[:-1] + b"\xff"):
        assert credentials.structural(base64.urlsafe_b64encode(head).decode().rstrip("=") + ".e30.AAAA") == []
    assert credentials.structural("www.example.org eyes.open.now ewer.a.b MIIEJA MIIE " + "MA" * 500) == []


def test_tokens_are_found():
    jwt = token({"alg": "RS256", "typ": "JWT"}, {"sub": "a"}, bytes(range(64)))
    assert credentials.structural(f"Bearer {jwt}. Next") == [("token", "jws", 7, 7 + len(jwt))]
    spaced = base64.urlsafe_b64encode(b'{\n "alg": "HS256"}').decode().rstrip("=") + ".e30.c2lnbmF0dXJl"
    assert [s[:2] for s in credentials.structural(spaced)] == [("token", "jws")]
    sealed = ".".join([base64.urlsafe_b64encode(b'{"alg":"dir","enc":"A128GCM"}').decode().rstrip("="), "", "aXZpdml2", "Y2lwaGVy", "dGFn"])
    assert credentials.structural("x=" + sealed) == [("token", "jwe", 2, 2 + len(sealed))]
    locked = "-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0123456789ABCDEF0123456789ABCDEF\n\n" + base64.b64encode(bytes(96)).decode() + "\n-----END RSA PRIVATE KEY-----"
    assert credentials.structural("k\n" + locked + "\n") == [("key", "pem-encrypted", 2, 2 + len(locked))]


def base_plain(text: str) -> list[tuple[int, int, int]]:
    out = []
    for m in re.finditer(r"""(?a:([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", text):
        if len(m[2]) >= 8:
            out.append((m.start(), 1, m.end()))
    out += [(m.start(), 2, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 3, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out)


def test_secret_digests(spark):
    rng = random.Random(8)
    parts = ["password=", "PassWd : ", "toKen=abcdefghijk", "ſecret=abcdefghijk", "token: token: abcdefgh", "api_key='A.b-c_d/e+f='", "apikey=\"short\"", "AKIA" * 3, "AKIAABCDEFGHIJKL", "0123456789abcdef" * 2, "deadbeef" * 3, " ", "é", "😀", "\n",
             token({"alg": "HS256"}, {"a": 1}, bytes(32)), "secret" + " " * 50 + "=" + "x" * 20]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(300)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(i, t) for i, t, *_ in odd_rows()]
    docs = spark.createDataFrame([(i, t, "a", "b") for i, t in rows], "doc_id long, text string, spans string, no string")
    got = sorted(credentials.secret_digests(credentials.secrets(docs)).collect(), key=repr)
    assert len(got) == len(rows)
    want = Counter()
    for i, t in rows:
        base = base_plain(t or "")
        n = Counter(k for _, k, _ in base)
        want[i, n[1], n[2], n[3], hashlib.sha256(",".join(f"{credentials.KINDS[k - 1]}:{a}:{b}" for a, k, b in base).encode()).hexdigest()] += 1
    assert Counter(tuple(r)[:5] for r in got) == want
    assert any(r.n_added for r in got) and all(r.spans.count(":") // 2 == r.n_assign + r.n_access + r.n_hex + r.n_added for r in got)
    assert credentials.secrets(no_docs(spark)).count() == 0 and credentials.secrets(odd_docs(spark)).count() == len(odd_rows())


@pytest.mark.parametrize("text", ["M" * 300_000, "MIIE" * 50_000, "ey" * 100_000 + ".a.b", "password" * 30_000, "token" + " " * 200_000, "0" * 300_001, "-----BEGIN " * 20_000, "LS0tLS1CRUdJTi" * 10_000])
def test_long_texts_take_little_time(text):
    assert credentials.structural(text) == [] and len(credentials.spans_of(text)) <= 1


# ---- collocations


def collocations_plain(rows, min_count, top, longest=5, share=100):
    n, f = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    common = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= min_count}
    inside = set()
    for (lang, p), a in common.items():
        for i, j in itertools.combinations(range(len(p) + 1), 2):
            if 2 <= j - i < len(p) and 100 * a >= share * f[lang, p[i:j]]:
                inside.add((lang, p[i:j]))
    per = {}
    for (lang, p), a in common.items():
        if (lang, p) not in inside:
            cuts = [(1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            per.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return {(lang, r): (p.decode(), -a, l, rr, n[lang], -s) for lang, xs in per.items() for r, (s, a, p, l, rr) in enumerate(sorted(xs)[:top], 1)}


def test_tiles_count_pairs():
    rng = np.random.default_rng(4)
    for bits, dense in ((2, 1), (2, 50), (3, 10**9)):
        a, b = np.minimum(rng.geometric(0.1, 5000), 60) - 1, np.minimum(rng.geometric(0.2, 5000), 60) - 1
        first, second, n, number = collocations.tiled_pairs(a, b, bits, dense)
        assert dict(zip(zip(first.tolist(), second.tolist()), n.tolist())) == Counter(zip(a.tolist(), b.tolist()))
        assert (first[number] == a).all() and (second[number] == b).all()


def test_collocations_equal_plain_counts(spark):
    rng = random.Random(13)
    vocabulary = ["of", "the", "Of", "a", "new", "york", "city", "ÉTÉ", "été", "x y", "\x1c", "w" * 300]
    rows = []
    for i in range(400):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(40))]
        text = " ".join(w + rng.choice(["", "", "", ".", ",\n", "\t", "!"]) for w in words) + rng.choice(["", " In the long run it was so.", " new york city"])
        rows.append((rng.choice(["en", "de", None, "und"]), text))
    rows += [("en", None), (None, ""), ("fr", " . "), ("en", "a b " * 20_000)] + [(r[2], r[1]) for r in odd_rows()] + [("en", "same same same same same same")] * 30
    docs = spark.createDataFrame([(i, *r, "p", "q") for i, r in enumerate(rows)], "doc_id long, lang string, text string, slice string, word string").repartition(5)
    for options in (dict(min_count=8, top=50, slice_bytes=2000), dict(min_count=9, top=1000, longest=3, share=60)):
        got = collocations.collocations(docs, **options).collect()
        options.pop("slice_bytes", None)
        want = collocations_plain(rows, **options)
        assert {(r.lang, r.rank): tuple(r)[2:] for r in got} == want and len(got) == len(want)


def test_collocations_of_nothing(spark):
    assert collocations.collocations(no_docs(spark)).count() == 0
    rare = spark.createDataFrame([("en", "no phrase comes often enough")], "lang string, text string")
    assert collocations.collocations(rare).count() == 0


# ---- cards side by side


def test_cards_side_by_side_are_proposed_one_by_one(spark):
    rows = [
        (1, "pay 7536784127813050 4845168114407329 now"), (2, "ref 4111 1111 1111 1111-5500 0055 5555 5559 x"), (3, "1234 5678 9012 3456 7890 1234 5678 9012"), (4, None), (5, "4111111111111111 4111111111111112"),
        (6, "4111111111111111"), (7, "1" * 500), (8, "4465758382889437 4465758382889437-4465758382889437")]
    docs = texts(spark.createDataFrame(rows, "doc_id long, text string"))
    got = sorted((r["rid"], r["start"], r["end"], r["value"]) for r in private.candidates(docs.select(*row_key(), "doc_id", "text")).filter("kind = 'cards'").collect())
    text = dict(rows)
    assert [(i, text[i][a:b] == v) for i, a, b, v in got] == [(1, True)] * 2 + [(2, True)] * 2 + [(8, True)] * 3
    assert [v for *_, v in got[:4]] == ["7536784127813050", "4845168114407329", "4111 1111 1111 1111", "5500 0055 5555 5559"]


def test_cards_side_by_side_are_redacted(spark):
    rng = random.Random(21)

    def card() -> str:
        digits = [rng.randrange(10) for _ in range(15)]
        total = sum(d if i % 2 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits))
        return "".join(map(str, digits)) + str(-total % 10)

    rows = [(i, f"{prose(rng, 8)} {rng.choice(["card ", ""])}{card()} mail a{i}@b.example.org call +49 30 {rng.randrange(10**6, 10**7)} order {rng.randrange(10**9, 10**10)} {prose(rng, 8)}") for i in range(150)]
    rows += [(1000, f"{prose(rng, 8)} {card()} {card()} {prose(rng, 8)}"), (1001, f"{prose(rng, 8)} order 1234567890 {prose(rng, 8)}")]
    out = {r["doc_id"]: r["text"] for r in private.redacted(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[1000].count("<CARD>") == 2 and "1234567890" in out[1001]
