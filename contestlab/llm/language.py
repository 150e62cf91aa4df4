"""Language identification by a linear-chain conditional random field over words."""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import null_ids, set_ids, texts
from .ragged import CACHE_WORDS, spread_ranges

#: Documents of the learning folds that are read to fit the model, in all and a language at most
#: about so many, and the words that are taken of each, from a place of its own.
SAMPLE_DOCS, SAMPLE_PER_LANGUAGE, SAMPLE_WORDS = 2400, 600, 60
FOLDS, HELD_OUT = 5, 0
MIN_COUNT, LEXICON_SHARE = 3, 0.8
STEPS, RATE, DECAY, SEED = 60, 0.15, 1e-6, 11
#: Words of a document that are relaxed side by side with other blocks; longer words are cut.
BLOCK, WORD_CHARS = 64, 64
UNDETERMINED = "und"

LETTER = re.compile(r"[^\W\d_]")
EDGES = ".,;:!?\"'()[]{}«»„“”‘’…|*#$%&<>"


def words_of(text: str) -> list[str]:
    words = text.lower().split()
    if words and max(map(len, words)) > WORD_CHARS:
        words = [w[i : i + WORD_CHARS] for w in words for i in range(0, len(w), WORD_CHARS)]
    return words


def parts(word: str) -> list[str]:
    """Names of a word's affix and n-gram features; none for a word without letters."""
    w = word.strip(EDGES)
    if not LETTER.search(w):
        return []
    full = f"^{w}$"
    grams = [full[i : i + 3] for i in range(len(full) - 2)] + [w[i : i + 2] for i in range(len(w) - 1)] + list(set(w))
    return grams + ["<" + w[:n] for n in (2, 3)] + [w[-n:] + ">" for n in (1, 2, 3)]


def transfer(a: np.ndarray, step: np.ndarray, pot: np.ndarray) -> np.ndarray:
    """One word further: (.., K) times the transitions, weighted by the word, scaled to sum 1."""
    out = (a @ step) * pot
    return out / out.sum(-1, keepdims=True)


def marginals(pot: np.ndarray, lens: np.ndarray, step: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """Posterior of every word's label by forward-backward, exact for sequences of any length.

    Sequences lie one after the other in ``pot`` (words x labels, positive). They are cut into
    blocks; all blocks find the matrix that takes a state through them side by side, a short run
    over the blocks of a sequence links them, and forward and backward sums run side by side again.
    """
    k = pot.shape[1]
    per = -(-lens // block)
    seq = np.repeat(np.arange(len(lens)), per)
    nth = spread_ranges(np.zeros(len(lens), np.int64), per)
    start = (np.cumsum(lens) - lens)[seq] + nth * block
    size = np.minimum(block, lens[seq] - nth * block)
    at = start[:, None] + np.arange(block)
    inside = np.arange(block) < size[:, None]
    p = pot[np.where(inside, at, 0)]  # blocks x block x labels
    through = np.broadcast_to(np.eye(k), (len(seq), k, k)).copy()
    for t in range(block):
        on = inside[:, t]
        if not on.any():
            break
        nxt = (through @ step) * p[:, t, None, :]
        through = np.where(on[:, None, None], nxt / nxt.sum((1, 2), keepdims=True), through)
    first = np.cumsum(per) - per
    fore, back = np.full((len(seq), k), 1.0 / k), np.full((len(seq), k), 1.0)
    for j in range(1, int(per.max(initial=0))):
        s = first[per > j] + j
        v = np.einsum("nk,nkl->nl", fore[s - 1], through[s - 1])
        fore[s] = v / v.sum(1, keepdims=True)
        s = (first + per - 1)[per > j] - j
        v = np.einsum("nkl,nl->nk", through[s + 1], back[s + 1])
        back[s] = v / v.sum(1, keepdims=True)
    alpha = np.zeros((block, len(seq), k))
    a = fore
    for t in range(block):
        a = np.where(inside[:, t, None], transfer(a, step, p[:, t]), a)
        alpha[t] = a
    out = np.zeros_like(pot)
    b = back
    for t in reversed(range(block)):
        on = inside[:, t]
        m = alpha[t][on] * b[on]
        out[at[on, t]] = m / m.sum(1, keepdims=True)
        v = (p[:, t] * b) @ step.T
        b = np.where(on[:, None], v / v.sum(1, keepdims=True), b)
    return out


@dataclass(frozen=True)
class Model:
    labels: list[str]
    index: dict[str, int]
    weights: np.ndarray  # features x labels
    lexicon: dict[str, int]  # word to label
    lexicon_weight: np.ndarray
    step: np.ndarray  # exp of the transition scores

    def scores(self, words: list[str]) -> np.ndarray:
        """words x labels."""
        get = self.index.get
        found = [[i for i in map(get, parts(w)) if i is not None] for w in words]
        owner, flat = np.repeat(np.arange(len(words)), list(map(len, found))), np.fromiter(chain.from_iterable(found), np.int64)
        out = np.zeros((len(words), len(self.labels)))
        for c in range(len(self.labels)):
            out[:, c] = np.bincount(owner, self.weights[flat, c], minlength=len(words))
        known = np.array([self.lexicon.get(w.strip(EDGES), -1) for w in words], np.int64)
        out[known >= 0] += self.lexicon_weight[known[known >= 0]]
        return out


def fit(sample: list[tuple[str, str]], labels: list[str], steps: int = STEPS, rate: float = RATE, decay: float = DECAY, seed: int = SEED) -> Model:
    """Weights and transitions by Adam on the conditional likelihood.

    Half of the sequences join two documents, mostly of different languages, so that switches are learned.
    """
    rng = np.random.default_rng(seed)
    k = len(labels)
    runs = [(words_of(t), labels.index(y)) for t, y in sample]
    runs = [(w, y) for w, y in runs if w]
    if not runs or k < 2:
        return Model(labels, {}, np.zeros((0, k)), {}, np.zeros((k, k)), np.ones((k, k)))
    seqs = [[(w, y) for w in words] for words, y in runs]
    mates = rng.permutation(len(runs))
    for (a, ya), m in zip(runs, mates):
        b, yb = runs[m]
        seqs.append([(w, ya) for w in a[: len(a) // 2]] + [(w, yb) for w in b[len(b) // 2 :]])
    counts = [Counter(w.strip(EDGES) for words, y in runs if y == label for w in words) for label in range(k)]
    total = sum(counts, Counter())
    lexicon = {w: label for label in range(k) for w, n in counts[label].items() if n >= MIN_COUNT and n >= LEXICON_SHARE * total[w] and LETTER.search(w)}
    vocab = list(dict.fromkeys(w for s in seqs for w, _ in s))
    number = {w: i for i, w in enumerate(vocab)}
    named = [parts(w) for w in vocab]
    seen = Counter(f for p in named for f in set(p))
    index = {f: i for i, f in enumerate(sorted(f for f, n in seen.items() if n >= MIN_COUNT))}
    feats = [[index[f] for f in p if f in index] for p in named]
    flat = np.array([i for f in feats for i in f], np.int64)
    owner = np.repeat(np.arange(len(vocab)), [len(f) for f in feats])
    lex = np.array([lexicon.get(w.strip(EDGES), -1) for w in vocab])
    size = max(map(len, seqs))
    at, y, on = np.zeros((len(seqs), size), np.int64), np.zeros((len(seqs), size), np.int64), np.zeros((len(seqs), size), bool)
    for i, s in enumerate(seqs):
        at[i, : len(s)], y[i, : len(s)], on[i, : len(s)] = [number[w] for w, _ in s], [c for _, c in s], True
    n_words = on.sum()
    params = [np.zeros((len(index), k)), np.zeros((k, k)), np.zeros((k, k))]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    eye, lens, place = np.eye(k), on.sum(1), np.cumsum(on.ravel()).reshape(on.shape) - 1
    gold, pair_gold = eye[y[on]], np.zeros((k, k))
    both = on[:, 1:]
    np.add.at(pair_gold, (y[:, :-1][both], y[:, 1:][both]), 1.0)
    for t in range(1, steps + 1):
        weights, lex_w, trans = params
        emit = np.zeros((len(vocab), k))
        for c in range(k):
            emit[:, c] = np.bincount(owner, weights[flat, c], minlength=len(vocab))
        emit[lex >= 0] += lex_w[lex[lex >= 0]]
        emit = np.exp(np.clip(emit - emit.max(1, keepdims=True), -30, 0))
        step = np.exp(trans)
        pot = emit[at[on]]
        post = marginals(pot, lens, step)
        # expected transitions: the pair's posterior from the marginals of its left word and the step
        left, right = post[place[:, :-1][both]], post[place[:, 1:][both]]
        joint = (left[:, :, None] * step) * (pot[place[:, 1:][both]])[:, None, :]
        joint = joint / joint.sum(2, keepdims=True)
        pair = (0.5 * left[:, :, None] * joint + 0.5 * joint * right[:, None, :] / np.maximum((left[:, :, None] * joint).sum(1, keepdims=True), 1e-12) * left[:, :, None]).sum(0)
        g = post - gold
        by_word = np.zeros((len(vocab), k))
        for c in range(k):
            by_word[:, c] = np.bincount(at[on], g[:, c], minlength=len(vocab))
        g_w = np.stack([np.bincount(flat, by_word[owner, c], minlength=len(index)) for c in range(k)], 1)
        g_l = np.zeros((k, k))
        np.add.at(g_l, lex[lex >= 0], by_word[lex >= 0])
        for i, (p, g_p) in enumerate(zip(params, (g_w, g_l, pair - pair_gold))):
            grad = g_p / n_words + decay * p
            first[i] = 0.9 * first[i] + 0.1 * grad
            second[i] = 0.99 * second[i] + 0.01 * grad**2
            params[i] = p - rate * (first[i] / (1 - 0.9**t)) / (np.sqrt(second[i] / (1 - 0.99**t)) + 1e-8)
    return Model(labels, index, params[0], lexicon, params[1], np.exp(params[2] - params[2].max()))


def sampled(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE, words: int = SAMPLE_WORDS, limit: int = SAMPLE_DOCS) -> list[tuple[str, str]]:
    """(words, label) of documents (doc_id, text, lang) that hashes of their ids choose, as many of each language."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS != HELD_OUT) & (F.length("text") > 0))
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}  # one row a label
    if not counts:
        return []
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, per_language / n)])
    draw = F.pmod(F.xxhash64("doc_id", F.lit("draw")), F.lit(1 << 30)) / float(1 << 30)
    chosen = known.filter(draw < F.element_at(share, F.col("lang")))
    parts_ = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    chosen = chosen.select("lang", "doc_id", parts_.alias("w")).filter(F.size("w") > 0)
    place = 1 + F.pmod(F.xxhash64("doc_id", F.lit("place")), F.greatest(F.size("w") - words, F.lit(0)) + 1).cast("int")
    rows = chosen.select("lang", "doc_id", F.array_join(F.slice("w", place, words), " ").alias("run")).orderBy(F.xxhash64("doc_id", F.lit("order")), "doc_id", "run").limit(limit).collect()
    return [(r["run"], r["lang"]) for r in rows]


class Words:
    """Potentials of words, each scored once a worker; bounded."""

    def __init__(self, model: Model, limit: int = CACHE_WORDS):
        self.model, self.limit = model, limit
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.pot, self.letter = np.ones((1 << 16, len(self.model.labels))), np.zeros(1 << 16)

    def at(self, words: list[str]) -> np.ndarray:
        """Numbers of the words; they hold until the next call."""
        try:
            return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        except KeyError:
            if len(self.known) > self.limit:
                self.clear()
            known, new = self.known, sorted(set(words).difference(self.known))
            lo, hi = len(known), len(known) + len(new)
            known.update(zip(new, range(lo, hi)))
            while hi > len(self.pot):
                self.pot, self.letter = np.concatenate([self.pot, np.ones_like(self.pot)]), np.concatenate([self.letter, np.zeros_like(self.letter)])
            score = self.model.scores(new)
            self.pot[lo:hi] = np.exp(np.clip(score - score.max(1, keepdims=True), -30, 0))
            self.letter[lo:hi] = [LETTER.search(w) is not None for w in new]
            return np.fromiter(map(known.__getitem__, words), np.int64, len(words))

    def __call__(self, words: list[str]) -> np.ndarray:
        return self.pot[self.at(words)]


_SCORED: dict[str, Words] = {}


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """One row per document: (doc_id, held_out, lang_pred, score, n_words, switches).

    The field is fitted to a bounded sample of the learning folds (see SAMPLE_DOCS); only texts
    enter a prediction. Every word of every whole text gets its posterior; the prediction is the
    label with the largest mean over the words that hold a letter, ``score`` that mean, ``switches``
    the number of neighbouring words whose likeliest labels differ.

    A text that is null or has no letter is ``und`` with score 0; a null id is not held out and
    never learned from; without any label every text with a letter is ``und`` too; ties go to the
    label that sorts first; repeated rows are judged each; other columns are not looked at.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    sample = sampled(rows)
    model = fit(sample, sorted({y for _, y in sample}), **options)
    shared = spark.sparkContext.broadcast(model)  # bounded by the sample
    token = uuid.uuid4().hex  # names this model's scores among those a worker keeps

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if token not in _SCORED:
            _SCORED.clear()
            _SCORED[token] = Words(shared.value)
        potentials = _SCORED[token]
        labels = potentials.model.labels
        for b in batches:
            for lo in range(0, len(b), 256):
                own = b.iloc[lo : lo + 256]
                split = [words_of(t) for t in own["text"]]
                judged = [bool(labels) and LETTER.search(t) is not None for t in own["text"]]
                pred, score, switches = [UNDETERMINED] * len(own), np.zeros(len(own)), np.zeros(len(own), np.int64)
                which = [i for i, ok in enumerate(judged) if ok]
                if which:
                    lens = np.array([len(split[i]) for i in which], np.int64)
                    at = potentials.at([w for i in which for w in split[i]])
                    post, lettered = marginals(potentials.pot[at], lens, potentials.model.step), potentials.letter[at]
                    first = np.cumsum(lens) - lens
                    mean = np.add.reduceat(post * lettered[:, None], first, axis=0) / np.add.reduceat(lettered, first)[:, None]
                    best, likely = mean.argmax(1), post.argmax(1)
                    changes = np.concatenate([[0], (likely[1:] != likely[:-1]).astype(np.int64)])
                    changes[first] = 0
                    moved = np.add.reduceat(changes, first)
                    for n, i in enumerate(which):
                        pred[i], score[i], switches[i] = labels[best[n]], min(1.0, mean[n, best[n]]), moved[n]
                yield pd.DataFrame({"doc_id": own["doc_id"], "lang_pred": pred, "score": score, "n_words": [len(s) for s in split], "switches": switches})

    out = set_ids(texts(rows)).mapInPandas(run, "doc_id bigint, lang_pred string, score double, n_words bigint, switches bigint")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))
    return null_ids(out).select("doc_id", held.alias("held_out"), "lang_pred", "score", "n_words", "switches")
