"""Plain Python versions of the operators, and hand-made rows with every awkward case."""

from __future__ import annotations

import collections
import hashlib
import random
import re

BLANK = re.compile(r"[^\x20\x09-\x0D]+")
LETTER = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def lower(text):
    return (text or "").translate(LOWER)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def awkward_texts() -> list[str | None]:
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(300)] + ["Über", "naïve", "漢字", "🙂", "ß"]
    base = [rng.choice(vocabulary) for _ in range(120)]
    passage = [rng.choice(vocabulary) for _ in range(30)]
    texts: list[str | None] = [None, "", " \n\t ", "one", "One  two\nthree", "one two three four", "a b c d e", "A b\tc d e", "\x0bx\x0c y\x00z"]
    for k in range(12):  # a chain of near copies
        words = list(base)
        for j in range(k // 2):
            words[(7 * j + k) % len(words)] = f"edit{k}_{j}"
        texts.append(" ".join(words))
    for k in range(6):  # a shared passage in otherwise different texts
        own = [rng.choice(vocabulary) + str(k) for _ in range(80)]
        texts.append(" ".join(own[:40]) + "\n" + " ".join(passage) + "\n" + " ".join(own[40:]))
    texts += [" ".join(base)] * 3 + ["same line\nother line\nsame line"] * 2
    texts.append(" ".join(rng.choice(vocabulary) for _ in range(30_000)))  # very long
    texts.append("x" * 200_000)  # one very long word
    texts.append(" ".join(["again and"] * 400))
    return texts


def awkward_rows() -> list[tuple]:
    """(doc_id, text, lang, source, n_chars) with null ids, repeated ids and rows, null metadata."""
    texts = awkward_texts()
    rows = [(i, t, ("en", "fr", None)[i % 3], ("s1", "s2", None, "s0")[i % 4], None if t is None else len(t)) for i, t in enumerate(texts)]
    return rows + [(None, "one two three four five six", None, None, 3), (None, texts[10], "en", "s1", 1), rows[12], rows[12], (3, "other text of the same id", "en", "s1", 9)]


SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
CLASHES = ("node", "key", "c0", "n_words", "items", "spans", "shard", "slot", "score", "kept", "gram", "size", "unit", "label", "order", "copies", "row", "known")


def classes(rows, length=5, numerator=80, denominator=100):
    sets = []
    for _, t in rows:
        w = BLANK.findall(lower(t))
        sets.append(frozenset(tuple(w[j : j + length]) for j in range(len(w) - length + 1)) if len(w) >= length else frozenset([tuple(w)] if w else []))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, x in enumerate(sets):
        for b in range(a):
            both = len(x & sets[b])
            if both and denominator * both >= numerator * (len(x) + len(sets[b]) - both):
                parent[find(a)] = find(b)
    groups = collections.defaultdict(list)
    for a in range(len(rows)):
        groups[find(a)].append(a)
    out = []
    for members in groups.values():
        ids = [rows[m][0] for m in members if rows[m][0] is not None]
        out += [(rows[m][0], len(sets[m]), min(ids, default=None)) for m in members]
    return out


def repeated(rows, length=20):
    seen, out = {}, []
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    for doc, t in order:  # rows of one doc_id do not see each other
        w, own = BLANK.findall(t or ""), set()
        covered = set()
        for j in range(len(w) - length + 1):
            g = tuple(w[j : j + length])
            if g in own or (g in seen and seen[g] != (doc,)):
                covered |= set(range(j, j + length))
            own.add(g)
        for g in own:
            seen.setdefault(g, (doc,))
        out.append((doc, len(w), len(covered), sha(" ".join(x for k, x in enumerate(w) if k not in covered))))
    return out


def contaminated(rows, items, length=10):
    grams = collections.defaultdict(set)
    sizes = set()
    for i, t in items:
        w = LETTER.findall(lower(t))
        n = min(length, len(w))
        for j in range(len(w) - n + 1 if n else 0):
            grams[tuple(w[j : j + n])].add(i)
            sizes.add(n)
    out = []
    for doc, t in rows:
        w, covered, ids = LETTER.findall(lower(t)), set(), set()
        for n in sizes:
            for j in range(len(w) - n + 1):
                if (g := tuple(w[j : j + n])) in grams:
                    covered |= set(range(j, j + n))
                    ids |= grams[g]
        out.append((doc, len(w), len(covered), tuple(sorted(i for i in ids if i is not None))))
    return out


def base_counts(text):
    t = text or ""
    w = BLANK.findall(t)
    seen, copies = set(), 0
    for line in t.split("\n"):
        if BLANK.search(line):
            copies += line in seen
            seen.add(line)
    grams = list(zip(w, w[1:], w[2:], strict=False))
    count, covered = collections.Counter(grams), set()
    for j, g in enumerate(grams):
        if count[g] > 1:
            covered |= {j, j + 1, j + 2}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), copies, len(covered)


def targets(sizes: dict, weights=(1, 2, 3), most=3) -> dict:
    """sizes by source -> target by source."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    budget, held = sum(sizes.values()), {}
    while True:
        free, rest = budget - sum(held.values()), sum(weight[s] for s in names if s not in held)
        over = [s for s in names if s not in held and rest and most * sizes[s] < weight[s] * free / rest]
        if not over:
            return held | {s: weight[s] * free / rest for s in names if s not in held}
        held |= {s: most * sizes[s] for s in over}


def key(row):
    return tuple((x is not None, x) for x in row)
