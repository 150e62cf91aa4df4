"""Cost-balanced packing of token sequences."""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import null_ids, set_ids, texts
from .ragged import WordIds, slices

CAPACITY = 4096
END_ID = 2
#: Cost of a piece of n tokens: LINEAR * n + QUADRATIC * n * n (projections against attention).
LINEAR, QUADRATIC = 1.0, 1.0 / 1024
#: Tokens that are packed together at most; a block holds one document more than fits.
BLOCK_TOKENS = 4_000_000
CACHE_WORDS = 1_000_000
VOCABULARY = "word_bpe_49k.json"

SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


RARE = re.compile("[\u0250-\U0010ffff]")
MARKS = re.compile("[^A-Za-z0-9\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f][.,] ")


def runs_of(text: str) -> list[str]:
    """The text in runs whose ids follow each other. The tokenizer lower-cases and parts letters from
    marks by itself; doing so before, for common letters and single marks only, leaves fewer different runs."""
    text = text.replace("\n", " ")
    if text.isascii() or not RARE.search(text):
        text = text.lower()
    if not MARKS.search(text):
        text = text.replace(", ", " , ").replace(". ", " . ")
    return text.split(" ")


_ENCODERS: dict[str, WordIds] = {}


def word_encoder(path: str) -> WordIds:
    """For a lower-casing tokenizer that drops white space and never joins across it, kept by a worker
    from task to task. A text's ids are those of its runs between blanks or line ends, one after the other."""
    if path in _ENCODERS:
        return _ENCODERS[path]
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    merge = tok.model.tokenize
    # the byte alphabet of such vocabularies: bytes that aren't printable in Latin-1 stand for 256 and up, in order
    odd = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)]
    alphabet = {b: 256 + i for i, b in enumerate(odd)}

    def whole(words: list[str]) -> list[list[int]]:
        return [e.ids for e in tok.encode_batch_fast(words, add_special_tokens=False)]

    def letters(word: str) -> list[int]:
        return [t.id for t in merge(word if word.isascii() else word.encode().decode("latin-1").translate(alphabet))]

    def plain(word: str) -> bool:
        """Lower-case common letters alone: nothing to normalize or to part, only to merge."""
        return word.isalpha() and word.islower() and (word.isascii() or not RARE.search(word))

    probes = ["the", "straße", "éçñüðāž", "internationalization", "q"]
    quick = whole(probes) == [letters(w) for w in probes]

    def encode(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [letters(w) if quick and plain(w) else None for w in words]
        rest = iter(whole([w for w, x in zip(words, ids) if x is None]))
        ids = [next(rest) if x is None else x for x in ids]
        lens = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.uint32, int(lens.sum())), lens

    _ENCODERS[path] = WordIds(encode, CACHE_WORDS)
    return _ENCODERS[path]


def sequence_sizes(total: int, capacity: int) -> list[int]:
    """Full sequences, and the rest as powers of two, which need no padding."""
    out = [capacity] * (total // capacity)
    return out + [1 << b for b in reversed(range(capacity.bit_length())) if total % capacity >> b & 1]


def pack_block(lengths: np.ndarray, capacity: int = CAPACITY, linear: float = LINEAR, quadratic: float = QUADRATIC) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of every piece; all sequences are full.

    What a document has beyond whole sequences is cut off its front into sequences of its own.
    The rests go by descending length to the sequence with the lowest cost so far that has room;
    a rest for which no room is left whole is cut over the cheapest open sequences.
    """
    out, sizes = [], []
    rests = []
    for d, n in enumerate(lengths.tolist()):
        for k in range(n // capacity):
            out.append((d, k * capacity, capacity, len(sizes), 0))
            sizes.append(capacity)
        if n % capacity:
            rests.append((n % capacity, d, n - n % capacity))
    first = len(sizes)
    room = np.array(sequence_sizes(sum(r[0] for r in rests), capacity), np.int64)
    size, cost = room.copy(), np.zeros(len(room))
    for n, d, start in sorted(rests, key=lambda r: (-r[0], r[1])):
        while n:
            fits = np.where(room >= n, cost, np.inf)
            s = int(fits.argmin())
            if fits[s] == np.inf:
                s = int(np.where(room > 0, cost, np.inf).argmin())
            take = min(n, int(room[s]))
            out.append((d, start, take, first + s, int(size[s] - room[s])))
            room[s] -= take
            cost[s] += linear * take + quadratic * take * take
            start, n = start + take, n - take
    return out


def pack(docs: DataFrame, capacity: int = CAPACITY, linear: float = LINEAR, quadratic: float = QUADRATIC, block_tokens: int = BLOCK_TOKENS,
         tokenizer: str | None = None, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]).

    Each task packs its own documents in blocks of bounded size, so nothing is shuffled and the
    memory of a task does not grow with the input. A block's tokens fill whole sequences and a
    few shorter ones of a power of two, so no sequence needs padding. ``sequence_id`` is the
    task's number times 2**32 plus a count; a retried task reads the same rows and gives the same.

    A null or empty text has the end id alone; a document of any length is cut; rows with equal
    ids stay separate documents; an empty table gives no rows; other columns are not looked at.
    ``tokenizer`` is a path that every executor can read (default: the word vocabulary).
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = word_encoder(tokenizer or vocabulary(VOCABULARY))
        base, used = TaskContext.get().partitionId() << 32, 0
        names: list = []
        ids: list[np.ndarray] = []
        held = 0

        def flush() -> pd.DataFrame:
            nonlocal used, held
            lengths = np.array([len(x) for x in ids], np.int64)
            pieces = pack_block(lengths, capacity, linear, quadratic)
            d, start, length, seq, offset = (np.array(x, np.int64) for x in zip(*pieces))
            cut = [ids[i][a : a + n].astype("<u4").tobytes() for i, a, n in zip(d, start, length)]
            out = pd.DataFrame({"doc_id": np.array(names, np.int64)[d], "start": start, "length": length, "ids_crc32": [zlib.crc32(c) for c in cut], "doc_tokens": lengths[d], "sequence_id": base + used + seq, "offset": offset})
            if with_ids:
                out["ids"] = [np.frombuffer(c, "<u4").astype(np.int32) for c in cut]
            used += int(seq.max()) + 1
            names.clear()
            ids.clear()
            held = 0
            return out

        for b in batches:
            for lo, hi in slices(b["text"]):
                runs = [runs_of(t) for t in b["text"].iloc[lo:hi]]
                encoder.offer(set().union(*runs))
                for name, words in zip(b["doc_id"].iloc[lo:hi].tolist(), runs):
                    x = np.append(encoder.ids(words), np.uint32(end_id))
                    names.append(name)
                    ids.append(x)
                    held += len(x)
                    if held >= block_tokens:
                        yield flush()
        if names:
            yield flush()

    return null_ids(set_ids(texts(docs, id_col, text_col)).mapInPandas(run, SCHEMA + (", ids array<int>" if with_ids else "")))
