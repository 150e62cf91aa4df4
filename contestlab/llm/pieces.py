"""SentencePiece encoding by suffix-array matching, and decoding."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from string import ascii_letters

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .common import null_ids, set_ids, texts
from .packing import vocabulary
from .ragged import WordIds, slices, spread_ranges

MODEL = "piece_bpe_32k.model"
MARK = "▁"
#: Characters of new words that are indexed together.
INDEX_CHARS = 1 << 19
#: Longer words are relaxed one by one, not side by side.
LONG_WORD = 256
#: Pairs of pieces whose fit a worker remembers.
KNOWN_PAIRS = 600_000

SCHEMA = "doc_id bigint, n_ids bigint, ids_crc32 bigint, decoded_sha256 string, round_trip boolean, ids array<int>"


class Pieces:
    """A byte-fallback BPE model: pieces, their scores and which of them may follow which."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.text = [sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i))]
        self.bytes = {int(self.text[i][1:-1], 16): i for i in range(n) if sp.is_byte(i)}
        self.id, self.score = {self.text[i]: i for i in plain}, {self.text[i]: sp.get_score(i) for i in plain}
        self.plain, self.unknown, self.start = np.array(plain), n, n + 1
        self.width = max(len(self.text[i]) for i in plain)
        if any(MARK in self.text[i].lstrip(MARK) for i in plain):
            raise ValueError("a piece goes on after the next word's mark")
        inside = {self.text[i][k : k + 2] for i in plain for k in range(len(self.text[i]) - 1)}
        apart = [p for p in ".,;:!?" if not any(c + p in inside for c in ascii_letters)]
        #: between a letter and these marks no piece reaches over
        self.border = re.compile(f"(?<=[A-Za-z])([{''.join(map(re.escape, apart))}])") if apart else re.compile("(?!)()")
        raw = [b"" if i not in set(plain) else self.text[i].replace(MARK, " ").encode() for i in range(n)]
        for b, i in self.bytes.items():
            raw[i] = bytes([b])
        self.raw_len = np.array([len(x) for x in raw])
        self.raw_at, self.raw = np.cumsum(self.raw_len) - self.raw_len, np.frombuffer(b"".join(raw), np.uint8)
        self.follows: dict[int, bool] = {}

    def merged(self, text: str) -> list[str]:
        """Plain merging of a short text: the best pair first, of equal ones the left."""
        parts = list(text)
        while len(parts) > 1:
            best = max(((self.score[a + b], -i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.score), default=None)
            if best is None:
                break
            i = -best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def fits(self, pair: int) -> bool:
        """Whether the second piece stays apart after the first: merging both texts gives just these two."""
        if (known := self.follows.get(pair)) is None:
            if len(self.follows) >= KNOWN_PAIRS:
                self.follows.clear()
            a, b = pair >> 20, pair & 0xFFFFF
            own = [] if a >= self.unknown else [self.text[a]]
            known = self.follows[pair] = b == self.unknown or self.merged("".join(own) + self.text[b]) == own + [self.text[b]]
        return known

    def edges(self, codes: np.ndarray, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(end, start, piece) of all occurrences of pieces in the text, by end, longest first.

        ``codes`` index ``chars`` from 1; 0 stands between words. The suffixes are sorted by as many
        characters as the longest piece has; two binary searches find the range of each piece.
        """
        kind = np.dtype(">u1") if len(chars) < 255 else np.dtype(">u4")
        padded = np.concatenate([codes, np.zeros(self.width, codes.dtype)]).astype(kind)
        windows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, self.width)[: len(codes)])
        text = windows.view(f"S{self.width * kind.itemsize}").ravel()
        order = np.lexsort(windows.view(">u8").astype(np.uint64).T[::-1]) if windows.shape[1] * kind.itemsize % 8 == 0 else np.argsort(text, kind="stable")
        text = text[order]
        code = {c: i + 1 for i, c in enumerate(map(chr, chars.tolist()))}
        here = [i for i in self.plain.tolist() if all(c in code for c in self.text[i])]
        lens = np.array([len(self.text[i]) for i in here], np.int64)
        keys = np.zeros((len(here), self.width), kind)
        for row, i in enumerate(here):
            keys[row, : lens[row]] = [code[c] for c in self.text[i]]
        low = np.searchsorted(text, keys.view(text.dtype).ravel(), "left")
        keys[np.arange(self.width)[None, :] >= lens[:, None]] = np.iinfo(kind).max
        high = np.searchsorted(text, keys.view(text.dtype).ravel(), "right")
        count = high - low
        starts, piece = order[spread_ranges(low, count)], np.repeat(np.array(here, np.int64), count)
        length = np.repeat(lens, count)
        single = np.zeros(len(chars) + 1, bool)
        single[[code[c] for c in code if c in self.id]] = True
        lone = np.flatnonzero((codes > 0) & ~single[codes])  # characters that are no piece
        starts, piece = np.concatenate([starts, lone]), np.concatenate([piece, np.full(len(lone), self.unknown)])
        length = np.concatenate([length, np.ones(len(lone), np.int64)])
        by = np.lexsort((-length, starts + length))
        return (starts + length)[by], starts[by], piece[by]

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words that begin with marks."""
        parts, group, size = [], [], 0
        for w in words:
            group.append(w)
            size += len(w) + 1
            if size > INDEX_CHARS:
                parts.append(self._encode(group))
                group, size = [], 0
        if group:
            parts.append(self._encode(group))
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        text = "\0".join(words) + "\0"
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        size = np.array([len(w) for w in words], np.int64)
        first = np.cumsum(size + 1) - size - 1
        chars, codes = np.unique(points, return_inverse=True)
        codes = codes + 1
        codes[first + size] = 0
        end, start, piece = self.edges(codes, chars)
        last, back = np.full(len(codes) + 1, -1, np.int64), np.full(len(codes) + 1, -1, np.int64)
        last[first] = self.start
        word = np.searchsorted(first, start, "right") - 1
        depth = end - first[word]
        long = size[word] > LONG_WORD
        # side by side: all words' edges that end at the same depth; the starts lie before
        short = np.flatnonzero(~long)
        by = short[np.argsort(depth[short], kind="stable")]
        for lo, hi in zip(*(lambda c: (c[:-1], c[1:]))(np.searchsorted(depth[by], np.arange(1, LONG_WORD + 2)))):
            e = by[lo:hi]
            if not len(e):
                continue
            pairs, which = np.unique(last[start[e]] << 20 | piece[e], return_inverse=True)
            pairs = pairs.tolist()
            known = [self.follows.get(p) for p in pairs]
            ok = e[np.array([self.fits(p) if k is None else k for p, k in zip(pairs, known)])[which]]
            last[end[ok]], back[end[ok]] = piece[ok], start[ok]
        for e in np.flatnonzero(long).tolist():  # already by end
            s = start[e]
            if self.fits(int(last[s]) << 20 | int(piece[e])):
                last[end[e]], back[end[e]] = piece[e], s
        # the pieces on each word's way back from its end
        at, used = first + size, []
        at = at[size > 0]
        for w in np.flatnonzero(size > LONG_WORD).tolist():
            p = int(first[w] + size[w])
            while p > first[w]:
                used.append(p)
                p = int(back[p])
        ends = [np.array(used, np.int64)]
        at = (first + size)[(size > 0) & (size <= LONG_WORD)]
        floor = first[(size > 0) & (size <= LONG_WORD)]
        while len(at):
            ends.append(at)
            at = back[at]
            on = at > floor
            at, floor = at[on], floor[on]
        ends = np.sort(np.concatenate(ends))
        ids, whose = last[ends], np.searchsorted(first, ends, "left") - 1
        lone = np.flatnonzero(ids == self.unknown)  # characters that fall back to bytes
        raw = [text[e].encode("utf-8", "replace") for e in (ends[lone] - 1).tolist()]
        each = np.ones(len(ids), np.int64)
        each[lone] = list(map(len, raw))
        ids, whose = np.repeat(ids, each), np.repeat(whose, each)
        ids[spread_ranges((np.cumsum(each) - each)[lone], each[lone])] = [self.bytes[x] for r in raw for x in r]
        return ids.astype(np.uint32), np.bincount(whose, minlength=len(words))

    def decode(self, ids: np.ndarray) -> str:
        raw = self.raw[spread_ranges(self.raw_at[ids], self.raw_len[ids])].tobytes()
        return raw.removeprefix(b" ").decode("utf-8", "replace")


CUT = "\x01"


def split_words(text: str, border: re.Pattern) -> list[str]:
    """The marked text in runs; no piece reaches over their borders."""
    if not text:
        return []
    if "  " not in text and MARK not in text and CUT not in text and text[-1] != " " and text[0] != " ":
        return (MARK + border.sub(CUT + r"\1", text).replace(" ", CUT + MARK)).split(CUT)
    out, marks = [], 0
    for w in text.replace(MARK, " ").split(" "):
        marks += 1
        if w:
            out.append(MARK * marks + w)
            marks = 0
    return out + [MARK * marks] * (marks > 0)


_LOADED: dict[str, tuple[Pieces, WordIds]] = {}


def loaded(path: str) -> tuple[Pieces, WordIds]:
    """Model and cache of this worker, kept from task to task."""
    if path not in _LOADED:
        model = Pieces(path)
        _LOADED[path] = model, WordIds(model.encode)
    return _LOADED[path]


def encode(docs: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: (doc_id, n_ids, ids_crc32, decoded_sha256, round_trip, ids).

    The new words of a batch are laid end to end and indexed by a suffix array; every piece is
    searched in it, the occurrences are edges sorted by position, and relaxing them in that order
    keeps at each place the one piece that merging would end with: the piece that stays apart
    from the piece kept at its start. Characters that are no piece become bytes. Decoding the ids
    gives the text back; ``round_trip`` says so (false where the text itself holds the mark).

    A null or empty text has no ids; a text is encoded whole whatever its length; equal rows give
    equal rows; an empty table gives none; other columns are not looked at. ``model`` is a path
    that every executor can read.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces, cache = loaded(model or vocabulary(MODEL))
        for b in batches:
            for lo, hi in slices(b["text"]):
                own = b.iloc[lo:hi]
                split = [split_words(t, pieces.border) for t in own["text"]]
                cache.offer(set().union(*split))
                found = [cache.ids(words) if words else np.zeros(0, np.uint32) for words in split]
                back = [pieces.decode(x) for x in found]
                yield pd.DataFrame({
                    "doc_id": own["doc_id"], "n_ids": [len(x) for x in found], "ids_crc32": [zlib.crc32(x.astype("<u4").tobytes()) for x in found],
                    "decoded_sha256": [hashlib.sha256(t.encode("utf-8", "replace")).hexdigest() for t in back], "round_trip": [t == s for t, s in zip(back, own["text"])],
                    "ids": [x.astype(np.int32) for x in found]})

    return null_ids(set_ids(texts(docs, id_col, text_col)).mapInPandas(run, SCHEMA))
