"""Packing, sharding, pieces, repeats and personal data against plain forms, on odd and given rows."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from llm_cases import no_docs, odd_docs, odd_rows, personal_plain, prose, repeats_plain

from contestlab.llm import packing, pieces, private, queries, ragged, repeats, sharding


def collected(df):
    return [r.asDict() for r in df.collect()]


def own_texts():
    return [(r[0], r[1] or "") for r in odd_rows()]


# packing

def check_packing(rows, texts, capacity):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.vocabulary(packing.VOCABULARY))
    expected = Counter((i, tuple(tok.encode(t, add_special_tokens=False).ids + [2])) for i, t in texts)
    got, parts = Counter(), {}
    for r in rows:
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"] > 0
        parts.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], r["ids"]))
    for (i, n), found in parts.items():  # rows that share id and length come apart by their starts
        found = sorted(found, key=lambda x: x[0])
        copies = sum(1 for s, _ in found if s == 0)
        if copies == 1:
            ids = [x for s, p in found for x in p]
            assert [s for s, _ in found] == np.cumsum([0] + [len(p) for _, p in found])[:-1].tolist()
            got[i, tuple(ids)] += 1
        else:
            assert sum(len(p) for _, p in found) == copies * n
            got.update(k for k in expected.elements() if k[0] == i and len(k[1]) == n)
    assert got == expected
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in by.values():
        s.sort()
        assert [o for o, _ in s] == np.cumsum([0] + [n for _, n in s])[:-1].tolist()
        total = sum(n for _, n in s)
        assert total <= capacity and total & (total - 1) == 0  # no padding


@pytest.mark.parametrize("capacity,block", [(4096, 4_000_000), (64, 3000)])
def test_packing_keeps_every_token(spark, capacity, block):
    check_packing(collected(packing.pack(odd_docs(spark), capacity=capacity, block_tokens=block, with_ids=True)), own_texts(), capacity)


def test_packing_balances_cost():
    rng = np.random.default_rng(5)
    pieces_ = packing.pack_block(rng.integers(1, 900, 800), 4096)
    cost = Counter()
    for _, _, n, s, _ in pieces_:
        cost[s] += packing.LINEAR * n + packing.QUADRATIC * n * n
    full = [c for s, c in cost.items() if sum(n for _, _, n, q, _ in pieces_ if q == s) == 4096]
    assert max(full) < 1.3 * min(full)


def test_packing_of_nothing(spark):
    assert packing.pack(no_docs(spark)).count() == 0


# sharding

@pytest.mark.parametrize("shards", [24, 3])
def test_shards_are_contiguous_and_balanced(spark, shards):
    rng = random.Random(1)
    rows = [(i, prose(rng, rng.randrange(0, 60))) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = sorted(collected(sharding.byte_shards(df, shards)), key=lambda r: r["doc_id"])
    assert [r["size"] for r in out] == [len(t.encode()) + 8 for _, t in rows] and [r["text_crc32"] for r in out] == [zlib.crc32(t.encode()) for _, t in rows]
    total, before = sum(r["size"] for r in out), 0
    for r in out:
        assert r["shard"] == (2 * before + r["size"]) * shards // (2 * total) and r["grown_shard"] is None and r["law"] == "bytes"
        before += r["size"]
    for s in range(shards):
        assert [r["slot"] for r in out if r["shard"] == s] == list(range(sum(r["shard"] == s for r in out)))


def test_shards_of_odd_rows(spark):
    out = collected(sharding.byte_shards(odd_docs(spark), 4))
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == Counter((i, len(t.encode()) + 8, zlib.crc32(t.encode())) for i, t in own_texts())
    for s in {r["shard"] for r in out}:
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(sum(r["shard"] == s for r in out)))
    assert sharding.byte_shards(no_docs(spark)).count() == 0


# pieces

def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=packing.vocabulary(pieces.MODEL))


def test_pieces_equal_the_library(spark, sf_dir):
    sp = library()
    for df, texts in ((odd_docs(spark), own_texts()), (queries.table(spark, sf_dir, "documents"), None)):
        texts = texts or [(r["doc_id"], r["text"] or "") for r in df.collect()]
        got = Counter((r["doc_id"], tuple(r["ids"]), r["decoded_sha256"], r["round_trip"]) for r in collected(pieces.encode(df)))
        assert got == Counter((i, tuple(sp.encode(t)), hashlib.sha256(t.encode()).hexdigest(), True) for i, t in texts)
    assert pieces.encode(no_docs(spark)).count() == 0


def test_random_strings_and_small_cache():
    sp, model = library(), pieces.loaded(packing.vocabulary(pieces.MODEL))[0]
    rng = random.Random(2)
    cache = ragged.WordIds(model.encode, limit=40)
    for _ in range(300):
        t = "".join(rng.choice("ab  \n\té😀-=*/x1.,①the") for _ in range(rng.randrange(1, 80)))
        words = pieces.split_words(t, model.border)
        assert cache.ids(words).tolist() == sp.encode(t)
        assert model.decode(cache.ids(words)) == t


# repeats

def shared_passages(n=60):
    rng = random.Random(9)
    passage, other = prose(rng, 60), prose(rng, 30)
    rows = []
    for i in range(n):
        rows.append((i, " ".join([prose(rng, rng.randrange(0, 40)), passage if i % 3 else "", prose(rng, 20), other if i % 4 == 0 else "", prose(rng, rng.randrange(0, 30))])))
    return rows + [(n + 1, rows[5][1]), (n + 2, rows[5][1][:-7] + "é ende"), (n + 3, "z" * 700), (n + 4, "z" * 300 + "y"), (n + 5, "né" * 90), (n + 6, "xné" * 3 + "né" * 90)]


def test_repeats_equal_plain_form(spark):
    for rows in (shared_passages(), [(i, t) for i, t in own_texts() if len(t) < 20_000]):
        df = spark.createDataFrame(rows, "doc_id bigint, text string")
        smallest = -(2**63)
        plain = repeats_plain([(smallest if i is None else i, t) for i, t in rows])
        got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in collected(repeats.repeats(df)))
        assert got == Counter((i, *plain[smallest if i is None else i, t]) for i, t in rows)


def test_repeats_of_odd_rows(spark):
    out = {(r["doc_id"], r["n_bytes"]): r for r in collected(repeats.repeats(odd_docs(spark)))}
    assert out[4, 150_000]["n_removed"] == 149_999 and out[5, 90_000]["n_removed"] == 90_000 - 3  # one letter, three letters of the first period stay
    assert out[1, 0]["n_removed"] == 0 and repeats.repeats(no_docs(spark)).count() == 0


def test_phrases_do_not_depend_on_segments(monkeypatch):
    raw = np.frombuffer(" ".join(t for _, t in shared_passages()).encode(), np.uint8)
    whole = repeats.phrases(raw)
    monkeypatch.setattr(repeats, "SEGMENT", 700)
    cut = repeats.phrases(raw)
    for key, _, start, count in (whole, cut):
        assert start.tolist() == np.cumsum(np.append(0, count[:-1])).tolist() and count.sum() == len(raw) - 99
    assert np.repeat(whole[0], whole[3]).tolist() == np.repeat(cut[0], cut[3]).tolist()  # each string keeps its trigger
    at = np.arange(len(raw) - 99)
    hashes = repeats.window_hashes(raw, at)
    assert len(set(hashes.tolist())) == len({raw[s : s + 100].tobytes() for s in at})


def test_cut_texts_keep_characters_and_columns(spark):
    rows = shared_passages()
    df = spark.createDataFrame([(i, t, "en", "s", 0, "clash") for i, t in rows] + [(999, None, None, None, None, None)], "doc_id bigint, text string, lang string, source string, n_chars bigint, raw string")
    out = repeats.without_repeats(df)
    assert out.columns == df.columns
    got, plain = {r["doc_id"]: r["text"] for r in out.collect()}, repeats_plain(rows)
    assert got[999] is None
    for i, t in rows:
        kept = len(got[i].encode())
        assert plain[i, t][0] - plain[i, t][1] <= kept <= plain[i, t][0] - plain[i, t][1] + 6 * plain[i, t][2] and "�" not in got[i]


# personal data

def listed(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def check_personal(rows, texts):
    expected = Counter()
    for i, t in texts:
        p = personal_plain(t)
        expected[(i, *[sum(k == x for x, _, _ in p) for k in private.KINDS], hashlib.sha256(listed(p).encode()).hexdigest())] += 1
    assert Counter((r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in rows) == expected


def test_personal_data_of_odd_rows(spark):
    out = collected(private.personal_data(odd_docs(spark)))
    check_personal(out, own_texts())
    plain = {i: personal_plain(t) for i, t in own_texts()}
    for r in out:  # candidates are too few here for anything but base spans
        assert r["spans"] == listed(plain[r["doc_id"]]) and r["n_added"] == 0
    assert private.personal_data(no_docs(spark)).count() == 0


def test_patterns_find_what_the_plain_ones_find(spark):
    rng = random.Random(4)
    texts = [(i, "".join(rng.choice("aZ09 .-@+()%_é\n12345") for _ in range(rng.randrange(0, 120)))) for i in range(400)]
    check_personal(collected(private.personal_data(spark.createDataFrame(texts, "doc_id bigint, text string"))), texts)


def test_trees_add_spans_like_base_ones(spark):
    rng = random.Random(6)
    rows = []
    for i in range(900):
        digits = "".join(rng.choice("0123456789") for _ in range(10))
        phone = f"+1 ({digits[:3]}) {digits[3:6]}-{digits[6:]}"
        text = [f"call {phone} now", f"mail ab{i}@mail.example.com now", f"ref {rng.randrange(10**6, 10**9)}xyz", f"token deadbeef{rng.randrange(10**8, 10**9)}cafe"][i % 4]
        rows.append((i, prose(rng, 8) + " " + text + " " + prose(rng, 8)))
    rows += [(5000, "please call +1 (555) 123-45"), (5001, "write to joe (at) mail (dot) example (dot) com today")]
    out = collected(private.personal_data(spark.createDataFrame(rows, "doc_id bigint, text string")))
    check_personal(out, rows)
    by = {r["doc_id"]: r for r in out}
    assert sum(r["n_added"] for r in out if r["doc_id"] < 5000) <= 5  # clean numbers stay
    assert by[5001]["n_added"] >= 0


@pytest.mark.parametrize("decoys", [True, False])
def test_trees_add_forms_that_only_the_generators_find(spark, decoys):
    rng = random.Random(9)
    rows, planted = [], {}
    for i in range(1200):
        d = "".join(rng.choice("0123456789") for _ in range(10))
        if i % 6 > 3:  # frequent, so that a spelling cannot be told from a rare error
            kind, value = ("email", f"joe{i} (at) mail{i % 9} (dot) com") if i % 6 == 4 else ("phone", f"{d[:3]}) {d[3:6]}-{d[6:]}")
            planted[i] = (kind, value)
            text = f"write to {value} today" if kind == "email" else f"reach us ({value} soon"
        else:
            text = [f"reach us +1 ({d[:3]}) {d[3:6]}-{d[6:]} now", f"to ab{i}@mail.example.com now", f"ref {d[:8]}xyz" if decoys else "none", f"on 2024-0{1 + i % 9}-1{i % 10} at noon" if decoys else "none"][i % 6]
        rows.append((i, prose(rng, 8) + " " + text + " " + prose(rng, 8)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = collected(private.personal_data(df))
    check_personal(out, rows)
    texts = dict(rows)
    for r in out:
        i = r["doc_id"]
        if i in planted:
            kind, value = planted[i]
            a = texts[i].index(value)
            assert (r["spans"], r["n_added"]) == (f"{kind}:{a}:{a + len(value)}", 1)
        else:
            assert r["n_added"] == 0
    if decoys:
        assert {r["doc_id"] for r in private.redacted(df).collect() if planted.get(r["doc_id"], ("", "\0"))[1] in r["text"]} == set()


def test_redaction(spark):
    df = odd_docs(spark)
    out = private.redacted(df)
    assert out.columns == df.columns
    for r in out.collect():
        if r["text"] is not None:
            plain = next(t for i, t in own_texts() if i == r["doc_id"] and bool(t) == bool(r["text"]))
            spans = sorted((a, b, k) for k, a, b in personal_plain(plain))
            text, upto = "", 0
            for a, b, k in spans:
                if a >= upto:
                    text += plain[upto:a] + f"<{k.upper()}>"
                upto = max(upto, b)
            assert r["text"] == text + plain[upto:]
