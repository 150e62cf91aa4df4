"""Near duplicates, language, quality, rules, search and the pipeline."""

import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest
from llm_cases import measures_plain, no_docs, odd_docs, odd_rows, personal_plain, prose

import corpus_pipeline
from contestlab.llm import language, minhash, packing, quality, queries, rules, search
from contestlab.llm.common import table
from contestlab.llm.components import components


def collected(df):
    return [r.asDict() for r in df.collect()]


# near duplicates

def roots_plain(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {x: find(x) for x in root}


def test_components(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2001 + i) for i in range(100)]
    got = {r["node"]: r["root"] for r in collected(components(spark.createDataFrame(edges, "a bigint, b bigint")))}
    assert got == {k: v for k, v in roots_plain([e for e in edges if e[0] != e[1]]).items()}


def corpus():
    rng = random.Random(12)
    rows, base = [], prose(rng, 200, 3000).split()
    for i in range(120):  # copies of one text with few changes: each near the text, not all near each other
        t = list(base)
        for _ in range(rng.randrange(0, 6)):
            t[rng.randrange(200)] = f"c{rng.randrange(10**6)}"
        rows.append((i, " ".join(t)))
    passage = prose(rng, 50, 3000)
    rows += [(200 + i, passage + " " + prose(rng, 60, 3000)) for i in range(60)]
    rows += [(300 + i, prose(rng, rng.randrange(1, 150), 3000)) for i in range(150)]
    rows += [(500 + i, rows[i % 3][1].upper() + "  ") for i in range(40)]
    return rows


def classes_plain(rows, weight):
    sampler = minhash.Sampler(weight, 1)
    parsed = {}
    for i, t in rows:
        parsed.setdefault(" ".join(t.lower().split()), []).append(i)
    keys = [k for k in parsed if k]
    counted = [minhash.counted(k) for k in keys]
    edges = [(a, b) for a, b in itertools.combinations(range(len(keys)), 2) if minhash.weighted_jaccard(sampler, counted[a], counted[b]) >= 0.8]
    root = roots_plain(edges)
    groups = {}
    for n, k in enumerate(keys):
        groups.setdefault(root.get(n, n), []).extend(parsed[k])
    return {i: min(g) for g in groups.values() for i in g}


@pytest.mark.parametrize("last", [64, 2])
def test_near_duplicates_equal_all_pairs(spark, last, monkeypatch):
    monkeypatch.setattr(minhash.links, "__defaults__", (minhash.SIMILARITY, 2, last))
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    keyed = df.selectExpr("text")
    plain = classes_plain(rows, minhash.idf(minhash.document_frequencies(keyed), len(rows)))
    got = {r["doc_id"]: r["class_id"] for r in collected(minhash.near_duplicates(df))}
    assert got == plain
    sizes = Counter(plain.values())
    assert max(sizes.values()) >= 100 and sum(n == 1 for n in sizes.values()) >= 150


def test_pairs_are_made_with_hubs_only(spark, monkeypatch):
    rng, base = random.Random(31), prose(random.Random(30), 200, 3000).split()
    rows = []
    for i in range(120):  # variants that share buckets, most of them not similar to each other
        t = list(base)
        for at in rng.sample(range(200), rng.randrange(0, 10)):
            t[at] = f"v{rng.randrange(10**6)}"
        rows.append((i, " ".join(t)))
    asked, verified = [], minhash.verified
    monkeypatch.setattr(minhash, "verified", lambda pairs, *more: asked.append(pairs.select("a", "b").distinct().count()) or verified(pairs, *more))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: r["class_id"] for r in collected(minhash.near_duplicates(df))}
    assert len(asked) == 1 and asked[0] <= len(rows) * minhash.BANDS
    assert got == classes_plain(rows, minhash.idf(minhash.document_frequencies(df.select("text")), len(rows)))
    assert 1 < len(set(got.values())) < 100


def test_samples_agree_as_often_as_texts_are_similar():
    rng = random.Random(3)
    base = prose(rng, 300, 3000).split()
    other = base[:270] + prose(rng, 30, 3000).split()
    weight = np.random.default_rng(1).uniform(1, 2, 1 << 10)
    sampler = minhash.Sampler(weight, 2000)
    parts = [minhash.counted(" ".join(x)) for x in (base, other)]
    sims = [sampler.signatures(s, np.log(sampler.weights(s, tf)), np.array([0]))[:, 0] for s, tf in parts]
    assert abs((sims[0] == sims[1]).mean() - minhash.weighted_jaccard(sampler, *parts)) < 0.04


def test_near_duplicates_of_odd_rows(spark):
    got = Counter((r["doc_id"], r["class_id"], r["class_size"]) for r in collected(minhash.near_duplicates(odd_docs(spark))))
    assert got[6, -5, 5] == 1 and got[7, -5, 5] == 2 and got[8, -5, 5] == got[-5, -5, 5] == 1  # copies, a repeated row, near copies
    assert got[1, 1, 1] == got[2, 2, 1] == got[3, 3, 1] == 1 and got[None, None, 1] == 2
    assert sum(got.values()) == len(odd_rows()) and minhash.near_duplicates(no_docs(spark)).count() == 0
    kept = minhash.distinct_documents(odd_docs(spark))
    assert kept.columns == odd_docs(spark).columns and kept.count() == len(odd_rows()) - 4


# language

def test_marginals_equal_enumeration():
    rng = np.random.default_rng(0)
    k, step = 3, np.exp(rng.normal(size=(3, 3)))
    lens = np.array([1, 5, 9, 2])
    pot = np.exp(rng.normal(size=(lens.sum(), k)))
    got = language.marginals(pot, lens, step, block=2)
    at = 0
    for n in lens:
        p, total = pot[at : at + n], np.zeros((n, k))
        for path in itertools.product(range(k), repeat=int(n)):
            # the first word is reached from a uniform state by one step
            w = step[:, path[0]].sum() * np.prod([p[i, c] for i, c in enumerate(path)]) * np.prod([step[a, b] for a, b in zip(path, path[1:])])
            for i, c in enumerate(path):
                total[i, c] += w
        assert np.allclose(got[at : at + n], total / total.sum(1, keepdims=True))
        at += n


def test_languages_on_held_out_documents(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    lang = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    out = collected(language.identify(docs))
    held = [r for r in out if r["held_out"] and lang[r["doc_id"]]]
    assert len(held) > 100 and np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in out) and len(out) == docs.count()


def test_code_switches_are_labelled():
    rng = random.Random(1)
    words = {"aa": ["the", "thing", "other", "those"], "bb": ["ñado", "ción", "para", "queja"]}
    sample = [(" ".join(rng.choice(words[y]) for _ in range(30)), y) for y in ("aa", "bb") for _ in range(60)]
    model = language.fit(sample, ["aa", "bb"])
    text = "the thing other those the thing ción para ñado queja ción para the other".split()
    scorer = language.Words(model)
    post = language.marginals(scorer(text), np.array([len(text)]), model.step)
    assert post.argmax(1).tolist() == [0] * 6 + [1] * 6 + [0] * 2


def test_languages_of_odd_rows(spark):
    out = collected(language.identify(odd_docs(spark)))
    assert len(out) == len(odd_rows())
    for r in out:
        if r["doc_id"] in (1, 2, 3, 14):
            assert (r["lang_pred"], r["score"]) == ("und", 0)
        if r["doc_id"] is None:
            assert r["held_out"] is False
    assert language.identify(no_docs(spark)).count() == 0


# quality

def test_quality_on_held_out_documents(spark):
    docs, labels = (table(spark, "/root/testdata/sf0.01", t) for t in ("documents", "labels"))
    known = {r["doc_id"]: r["quality"] for r in labels.collect()}
    out = collected(quality.classify(docs, labels))
    held = [r for r in out if r["held_out"] and r["doc_id"] in known]
    assert np.mean([r["predicted"] == known[r["doc_id"]] for r in held]) > 0.95
    assert len(out) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in out)


def test_isotonic_rises():
    rng = np.random.default_rng(2)
    x, n = np.sort(rng.normal(size=50)), rng.integers(1, 9, 50).astype(float)
    knots, values = quality.isotonic(x, rng.binomial(n.astype(int), 0.5).astype(float), n)
    assert (np.diff(knots) > 0).all() and len(knots) < 50


def test_quality_of_odd_rows(spark):
    labels = spark.createDataFrame([(6, 1, 0), (6, 0, 0), (None, 1, 0), (7, None, None)], "doc_id bigint, quality int, toxic int")
    for some in (labels, labels.limit(0)):
        assert quality.classify(odd_docs(spark), some).count() == len(odd_rows())
    assert quality.classify(no_docs(spark), labels).count() == 0


# rules

def test_measures_equal_plain_form(spark):
    rng = random.Random(5)
    rows = [(i, "".join(rng.choice(["a", "b", "c", " ", " ", "\n", "#", "|", "\t"]) for _ in range(rng.randrange(0, 400)))) for i in range(200)]
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    df = spark.createDataFrame([(i, t, None) for i, t in rows], "doc_id bigint, text string, lang string")
    got = {r["doc_id"]: r for r in collected(rules.quality_rules(df, labels))}
    for i, t in rows:
        r, plain = got[i], measures_plain(t)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == plain
        assert r["kept"] == (not plain[-1])  # nothing is shown without labels


def test_rules_of_odd_rows(spark):
    labels = spark.createDataFrame([(6, 1, 0), (None, 1, 0), (7, None, None)], "doc_id bigint, quality int, toxic int")
    out = collected(rules.quality_rules(odd_docs(spark), labels))
    assert Counter((r["doc_id"], r["n_words"], r["n_repeat_words"], r["base_failed"]) for r in out) == Counter((i, *(lambda m: (m[0], m[4], m[5]))(measures_plain(t or ""))) for i, t, *_ in odd_rows())
    assert rules.quality_rules(no_docs(spark), labels).count() == 0
    kept = rules.kept_documents(odd_docs(spark).drop("n_words"), labels)
    assert kept.count() == sum(r["kept"] for r in out)


def test_binomial_tail(spark):
    cases = [(0, 50, 0.05), (3, 400, 0.02), (20, 1000, 0.025), (150, 20_000, 0.0075), (5, 10, 0.1)]
    for k, n, p in cases:
        df = spark.createDataFrame([(k, n)], "k bigint, n bigint")
        got = df.select(rules.binomial_tail(df["k"], df["n"], p).alias("t")).first()["t"]
        want = sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log(1 - p)) for i in range(k + 1)) if k <= n * p else 1.0
        assert got == pytest.approx(want, rel=1e-6)


def test_cutoffs_keep_the_risk(spark):
    rng = random.Random(7)
    rows, labels = [], []
    for i in range(6000):
        good = i % 3 > 0
        share = rng.random() * (0.12 if good else 1.5)
        words = [f"{prose(rng, 1, 9000)}{'#' if rng.random() < share else ''}" for _ in range(60)]
        rows.append((i, " ".join(words), "en" if i % 2 else "fr"))
        labels.append((i, int(good), 0))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    out = {r["doc_id"]: r for r in collected(rules.quality_rules(docs, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"), risk=0.2))}
    for s in ("en", "fr"):
        good = [out[i] for i, q, _ in labels if q and out[i]["stratum"] == s and not out[i]["base_failed"]]
        bad = [out[i] for i, q, _ in labels if not q and out[i]["stratum"] == s and not out[i]["base_failed"]]
        assert np.mean([not r["kept"] for r in good]) <= 0.2 and np.mean([not r["kept"] for r in bad]) > 0.5


# search

def vectors(spark, n=400, d=12, extra=()):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(n, d)) * rng.gamma(0.7, 1.0, n)[:, None]
    x[n // 2 :] = x[0]  # a third of all rows and more may be one vector
    rows = [(i, [float(c) for c in np.float32(v)], i % 3, "clash") for i, v in enumerate(x)]
    return rows + list(extra), "vec_id bigint, embedding array<float>, label int, norm string"


@pytest.mark.parametrize("block,query_block,strip", [(2048, 2048, 16), (32, 4, 2)])
def test_top_k_equals_all_pairs(spark, block, query_block, strip):
    extra = [(900, None, 0, ""), (950, [1.0, None] + [0.0] * 10, 0, ""), (1000, [float("nan")] * 12, 0, ""), (None, [9.0] * 12, 0, ""), (1050, [0.5, 0.25], 0, ""), (1100, [], 0, ""), (50, [3.0] * 12, 0, "")]
    rows, schema = vectors(spark, extra=extra)
    whole = [(-(2**63) if i is None else i, [math.floor(256 * float(np.float32(c))) for c in v] + [0] * (12 - len(v))) for i, v, *_ in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    want = Counter()
    found = [(i, [(sum(a * b for a, b in zip(v, w)), j) for j, w in whole if j != i]) for i, v in whole if i % 50 == 0 and i != -(2**63)]
    got = collected(search.top_k(spark.createDataFrame(rows, schema), block=block, query_block=query_block, strip=strip))
    for i, scores in found:  # one query a row, ids may repeat
        best = sorted(scores, key=lambda x: (-x[0], x[1]))[:5]
        want.update((i, n, None if j == -(2**63) else j, s) for n, (s, j) in enumerate(best, 1))
    assert Counter((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == want
    assert search.top_k(spark.createDataFrame([], schema)).count() == 0


def test_top_k_scores_that_pass_64_bits_are_an_error(spark):
    far = spark.createDataFrame([(0, [1e17, -1e17]), (1, [1e17, 1.0])], "vec_id bigint, embedding array<double>")
    with pytest.raises(ValueError, match="too large"):
        search.top_k(far)


def test_bounds_prune():
    rng = np.random.default_rng(1)
    x = np.floor(256 * rng.normal(size=(3000, 16)) * (0.5 ** np.arange(16))).astype(np.int64)
    rotation = np.linalg.eigh((x.T @ x).astype(float))[1][:, ::-1].copy()
    side = lambda r, i: search.Side(np.arange(i, i + len(r)).tobytes(), r.tobytes(), rotation)
    q, c = side(x[:40], 0), side(x, 0)
    scores = x[:40] @ x.T
    least = np.sort(scores, 1)[:, -6].astype(float)
    i, j = search.survivors(q, c, least)
    assert len(i) < 0.2 * scores.size and {(a, b) for a, b in zip(*np.nonzero(scores >= least[:, None]))} <= set(zip(i.tolist(), j.tolist()))


# pipeline

def test_stages_take_effect(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = table(spark, sf_dir, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "near_dedup", "suffix_dedup", "personal_data", "packing"]
    kept = corpus_pipeline.quality_rules(spark, docs, sf_dir).cache()
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in collected(queries.op9_quality_rules(spark, sf_dir)) if r["kept"]}
    single = corpus_pipeline.near_dedup(spark, kept, sf_dir).cache()
    classes = collected(minhash.near_duplicates(kept))
    assert sorted(r["doc_id"] for r in single.collect()) == sorted({r["class_id"] for r in classes})
    cut = corpus_pipeline.suffix_dedup(spark, single, sf_dir).cache()
    assert cut.count() == single.count() and all(r["n_chars"] == len(r["text"]) for r in cut.collect())
    clean = corpus_pipeline.personal_data(spark, cut, sf_dir).cache()
    assert clean.columns == cut.columns == kept.columns == corpus_pipeline.COLUMNS and not [s for r in clean.collect() for s in personal_plain(r["text"])]
    last = collected(corpus_pipeline.pack_sequences(spark, clean, sf_dir))
    whole = collected(packing.pack(clean))
    assert {r["doc_id"] for r in last} == {r["doc_id"] for r in clean.collect()} and sum(r["length"] for r in last) == sum(r["length"] for r in whole)


def test_run_returns_packed_rows(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def test_known_words_are_few(monkeypatch):
    text = prose(random.Random(5), 4000, 900)
    want = minhash.shingles(text)
    monkeypatch.setattr(minhash, "_WORDS", {})
    monkeypatch.setattr(minhash, "_WORD_LIMIT", 50)
    for at in range(0, 4000, 100):
        minhash.shingles(" ".join(text.split()[at : at + 100]))
        assert len(minhash._WORDS) <= 151
    assert (minhash.shingles(text) == want).all()
    monkeypatch.undo()
    assert minhash._WORD_LIMIT <= 1 << 18
