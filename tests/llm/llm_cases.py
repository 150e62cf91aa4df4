"""Small tables with everything that may go wrong, and plain forms of what the operators return."""

import hashlib
import random
import re

import numpy as np

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, rid string, rth string, raw string, key string, node string, n_words string, size string, stratum string, label string, rank string, bands string"


def prose(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}{'aeiou'[rng.randrange(5)]}" for _ in range(n))


def odd_rows() -> list[tuple]:
    rng = random.Random(3)
    base = prose(rng, 120)
    near = base.split()
    near[60] = "changed"
    texts = [
        (1, None), (2, ""), (3, " \n\t  "), (None, "a text without an id " + prose(rng, 70)), (None, None), (4, "x" * 150_000), (5, "ab " * 30_000),
        (6, base), (7, base), (7, base), (8, " ".join(near)), (9, "Ünï😀côdé " + prose(rng, 80) + " \x00 end"), (10, "máil at a.b@c-d.example.org, 1.2.3.4 999.1.1.1 +1 (555) 123-4567"),
        (11, "4111 1111 1111 1111 and 4111111111111112 +12 3 0.0.0.0.0.0.0.255 x@y x@y.z@q.r"), (12, "one"), (-5, "line\nline\n\nline\n" + base), (13, base + "\n" + base), (14, "1" * 5000 + "." * 50 + "@" * 50),
    ]
    extra = ("r", "t", "b", "k", "n", "w", "s", "st", "l", "ra", "ba")
    return [(i, t, "en" if (i or 0) % 2 else None, None, None) + extra for i, t in texts]


def odd_docs(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def repeats_plain(texts: list[tuple[int, str]], length: int = 100) -> dict:
    """Documents by (id, text); strings that also start in a smaller id or earlier in the same text go."""
    first: dict[bytes, int] = {}
    for i, t in texts:
        b = t.encode()
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            first[w] = min(first.get(w, i), i)
    out = {}
    for i, t in texts:
        b, seen = t.encode(), set()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            if w in seen or first[w] < i:
                gone[s : s + length] = True
            seen.add(w)
        edge = np.diff(np.concatenate([[0], gone.astype(int), [0]]))
        out[i, t] = (len(b), int(gone.sum()), int((edge == 1).sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())
    return out


PATTERNS = [
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")), ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+")), ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")),
]


def luhn_plain(digits: str) -> bool:
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(digits))) % 10 == 0


def personal_plain(text: str) -> list[tuple[str, int, int]]:
    out = []
    for kind, pattern in PATTERNS:
        for m in pattern.finditer(text):
            v = m.group()
            d = re.sub("[^0-9]", "", v)
            ok = {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in v.split(".")), "card": lambda: 13 <= len(d) <= 19 and luhn_plain(d), "phone": lambda: 9 <= len(d) <= 15}[kind]
            if ok():
                out.append((kind, m.start(), m.end()))
    return out


def measures_plain(text: str) -> tuple:
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    threes = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    twice = {x for x in threes if threes.count(x) > 1} if len(threes) < 500 else {x for x, n in __import__("collections").Counter(threes).items() if n > 1}
    covered = {i + j for i, x in enumerate(threes) if x in twice for j in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), n < 50 or 100 * len(covered) > 50 * n
