"""The whole pipeline over a small corpus with planted junk, copies, passages and personal data, against a plain chain."""

import random
import zlib

import corpus_pipeline
import numpy as np
from llm_cases import measures_plain, personal_plain, prose
from tokenizers import Tokenizer

from contestlab.llm import packing

LENGTH = 100


def without_repeats_plain(texts: dict[int, str]) -> dict[int, str]:
    """Bytes of strings that start in a smaller id, or earlier in the same text, are cut out (ASCII texts)."""
    first: dict[str, int] = {}
    for i in sorted(texts):
        for s in range(len(texts[i]) - LENGTH + 1):
            first.setdefault(texts[i][s : s + LENGTH], i)
    out = {}
    for i, t in texts.items():
        gone, seen = np.zeros(len(t), bool), set()
        for s in range(len(t) - LENGTH + 1):
            w = t[s : s + LENGTH]
            if w in seen or first[w] < i:
                gone[s : s + LENGTH] = True
            seen.add(w)
        out[i] = "".join(c for c, g in zip(t, gone) if not g)
    return out


def redacted_plain(text: str) -> str:
    """Spans that overlap are one, under the kind of the first."""
    out, at = [], 0
    for kind, a, b in sorted(personal_plain(text), key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
            at = b
        else:
            at = max(at, b)
    return "".join(out) + text[at:]


def corpus(rng: random.Random) -> list[tuple]:
    texts = {i: prose(rng, rng.randrange(70, 140)) for i in range(1, 41)}
    texts[5] = texts[4]
    near = texts[6].split()
    near[50] = "changed"
    texts[7] = " ".join(near)
    passage = prose(rng, 60)
    for i in (10, 11, 12):
        texts[i] = f"{prose(rng, 50)} {passage} {prose(rng, 50)}"
    long = prose(rng, 150)
    texts[13] = f"{long}\n{long[:200]}"
    texts[20] += " write to ann.b+c@mail.example.org or 10.20.30.40, 999.1.2.3 is none"
    texts[21] += " card 4111 1111 1111 1111 or 4111 1111 1111 1112 call +49 (30) 123-4567"
    texts[30] = "too short to keep"
    texts[31] = "the same line again and again\n" * 30
    texts[32] = ""
    rows = [(i, t, "en" if i % 2 else "de", "s", len(t)) for i, t in texts.items()]
    return rows + [(50, None, "en", "s", None), (9, texts[9], "en", "s", 3)]  # no text; a row that comes twice


def test_run_equals_a_plain_chain(spark, tmp_path):
    rows = corpus(random.Random(17))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    texts = {i: t for i, t, *_ in rows if t is not None and not measures_plain(t)[-1]}
    assert set(range(1, 41)) - set(texts) == {30, 31, 32}
    for copy in (5, 7):
        del texts[copy]
    texts = {i: redacted_plain(t) for i, t in without_repeats_plain(texts).items()}
    assert all(texts[i].count(" ") < 110 for i in (11, 12)) and "<EMAIL>" in texts[20] and "<CARD>" in texts[21]
    tok = Tokenizer.from_file(packing.vocabulary(packing.VOCABULARY))
    want = {i: np.array(tok.encode(t, add_special_tokens=False).ids + [2], "<u4") for i, t in texts.items()}
    got: dict[int, list] = {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert set(got) == set(want)
    for i, pieces in got.items():
        pieces.sort(key=lambda r: r["start"])
        assert [r["start"] for r in pieces] == np.cumsum([0] + [r["length"] for r in pieces])[:-1].tolist()
        assert sum(r["length"] for r in pieces) == len(want[i]) and {r["doc_tokens"] for r in pieces} == {len(want[i])}
        assert all(zlib.crc32(want[i][r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for r in pieces)


def test_stages_of_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
