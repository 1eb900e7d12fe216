"""Secret scans: fixed shapes, and values in a credential context that are hard to guess.

A value's guess cost (log10 of the guesses an informed attacker needs) is the least cost of any segmentation into spans that the
attacker would try: words of ranked public vocabularies (with capitals, look-alike letters, or reversed), dates, repeats of a unit,
walks on the keyboard, and single characters by brute force. Dynamic programming over the end of the segmentation finds it: each place
that can be reached below the limit is extended by every span that begins there. Once no such place is left the value is
above the limit, however long it is, so whole values of any length take time in proportion to their length.
"""

from __future__ import annotations

import base64
import math
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuswatch.llm.arrow_rows import veiled, with_measures

TOKENIZERS = "/opt/tokenizers"
VOCABULARIES = ("byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken")
#: Kinds of spans, in the order of reports: three fixed shapes, then values that are hard to guess.
KINDS = ("assign", "access", "hex", "guess")
SPANS = "array<struct<kind: string, start: long, stop: long, cost: double>>"

# The shapes. The least lengths of access (18) and hex (16) are part of their patterns, since both take whole runs.
ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ASSIGN_LEAST = 12
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
# Where a credential's value stands.
CONTEXT = re.compile(
    r"""(?i:password|passwd|passphrase|passcode|pwd|secret|token|credential|api[_-]?key|access[_-]?key|private[_-]?key)s?["'`]?\x20*(?:[:=]|\x20is\x20)\x20*["'`]?([^\x00-\x20"'`<>]+)""",
    re.ASCII,
)
URL_CONTEXT = re.compile(r"""://[^\x00-\x20/:@"'`<>]*:([^\x00-\x20/@"'`<>]+)@""")
TRAILING = ".,;:!?)]}"

# What the attacker knows.
LOOK_ALIKE = str.maketrans("4@310!5$7+", "aaeioisstt")
KEYBOARD = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
SHIFTED = str.maketrans('~!@#$%^&*()_+{}|:"<>?', "`1234567890-=[]\\;',./")
DATE = re.compile(r"(?:(?P<y1>(?:19|20)\d\d)(?P<s1>[-/._]?)(?P<m1>1[0-2]|0?[1-9])(?P=s1)(?P<d1>3[01]|[12]\d|0?[1-9])|(?P<a>3[01]|[12]\d|0?[1-9])(?P<s2>[-/._]?)(?P<b>3[01]|[12]\d|0?[1-9])(?P=s2)(?P<y2>(?:19|20)\d\d|\d\d))", re.ASCII)
YEAR = re.compile(r"(?:19|20)\d\d", re.ASCII)
LONGEST_WORD, LONGEST_UNIT, NOW = 24, 8, 2000
#: log10 of two: the attacker's choice between two ways.
TWICE = math.log10(2)
_WORDS: dict[tuple, dict[str, float]] = {}


def ranked_words(paths: tuple[str, ...]) -> dict[str, float]:
    """log10 of the rank of each word of at least three letters in the vocabularies (the best of them)."""
    if paths not in _WORDS:
        found: dict[str, int] = {}
        for path in paths:
            with open(path, "rb") as f:
                for token, rank in map(bytes.split, f):
                    word = base64.b64decode(token).decode(errors="ignore").strip().lower()
                    if 3 <= len(word) <= LONGEST_WORD and word.isalpha():
                        found[word] = min(found.get(word, 1 << 30), int(rank) + 1)
        _WORDS[paths] = {w: math.log10(r + 1) for w, r in found.items()}
    return _WORDS[paths]


def _case_cost(word: str) -> float:
    """Ways to spell a word with this many capitals."""
    capitals = sum(c.isupper() for c in word)
    if not capitals:
        return 0.0
    if capitals == len(word) or (capitals == 1 and (word[0].isupper() or word[-1].isupper())):
        return TWICE
    few = min(capitals, len(word) - capitals)
    return math.log10(sum(math.comb(len(word), k) for k in range(1, few + 1)) + 1)


def _equal_ahead(codes: np.ndarray, shift: int) -> np.ndarray:
    """For each place, how many characters from it on equal those ``shift`` places later."""
    n = len(codes)
    differ = np.flatnonzero(codes[:-shift] != codes[shift:]) if n > shift else np.zeros(0, np.int64)
    ends = np.append(differ, max(n - shift, 0))
    place = np.arange(n)
    return np.maximum(ends[np.minimum(np.searchsorted(ends, place), len(ends) - 1)] - place, 0)


def _keys() -> dict[str, tuple[float, int]]:
    """Place of each key: the rows of a keyboard are set off by half a key each."""
    return {c: (x + y / 2, y) for y, row in enumerate(KEYBOARD) for x, c in enumerate(row)}


KEYS = _keys()
#: Average number of neighbours of a key.
NEIGHBOURS = sum(abs(a[0] - b[0]) <= 1 and abs(a[1] - b[1]) <= 1 and a != b for a in KEYS.values() for b in KEYS.values()) / len(KEYS)


def keyboard_walks(value: str) -> tuple[list[int], list[int]]:
    """For each place, where the walk of neighbouring keys from it ends, and the number of its straight parts."""
    plain = value.lower().translate(SHIFTED)
    n = len(plain)
    stop, parts = list(range(1, n + 1)), [0] * n
    ahead = None
    for i in range(n - 2, -1, -1):
        a, b = KEYS.get(plain[i]), KEYS.get(plain[i + 1])
        step = (b[0] - a[0], b[1] - a[1]) if a and b and a != b else None
        if step and abs(step[0]) <= 1 and abs(step[1]) <= 1:
            stop[i] = stop[i + 1]
            parts[i] = parts[i + 1] + (step != ahead)
            ahead = step
        else:
            ahead = None
    return stop, parts


def _choices(n: int, k: int) -> float:
    """log10 of the number of ways to pick k of n."""
    return (math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)) / math.log(10)


def spans_from(value: str, i: int, words: dict[str, float]) -> Iterator[tuple[int, float]]:
    """(end, cost) of each word and date that begins at a place."""
    for size in range(3, min(LONGEST_WORD, len(value) - i) + 1):
        piece = value[i : i + size]
        lower = piece.lower()
        plain = lower.translate(LOOK_ALIKE)
        swapped = sum(a != b for a, b in zip(lower, plain, strict=True)) if plain != lower else 0
        known = min(words.get(plain, math.inf), words.get(plain[::-1], math.inf) + TWICE)
        if known < math.inf:
            yield i + size, known + _case_cost(piece) + swapped * TWICE + TWICE
    if value[i].isdigit():
        if m := DATE.match(value, i):
            year = int(m["y1"] or m["y2"])
            year += 0 if year > 99 else 1900 if year > 50 else 2000
            separated = 2 * TWICE if m["s1"] or m["s2"] else 0.0
            yield m.end(), math.log10(365 * max(abs(year - NOW), 20)) + separated + TWICE
        if m := YEAR.match(value, i):
            yield m.end(), math.log10(max(abs(int(m[0]) - NOW), 20)) + TWICE


def guess_cost(value: str, words: dict[str, float], limit: float = math.inf, units: bool = True) -> float:
    """log10 of the guesses that the cheapest segmentation of ``value`` needs; ``limit`` if that is not below it.

    A brute-force character costs 1. Repeats and walks are taken as far as they go.
    """
    n = len(value)
    best = [0.0] + [math.inf] * n
    codes = np.frombuffer(value.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    same = [_equal_ahead(codes, p).tolist() for p in range(1, min(LONGEST_UNIT, n // 2) + 1)] if units else []
    stop, parts = keyboard_walks(value)
    i, reach = 0, 0
    while i <= reach and i < n:
        here = best[i]
        if here < limit:
            ways = [(i + 1, 1.0), *spans_from(value, i, words)]
            if stop[i] - i >= 3:
                size, turns = stop[i] - i, parts[i]
                ways.append((stop[i], math.log10(len(KEYS) * size) + turns * math.log10(NEIGHBOURS) + _choices(size - 1, turns - 1) + TWICE))
            for p, ahead in enumerate(same, 1):
                if ahead[i] >= p:
                    copies = 1 + ahead[i] // p
                    ways.append((i + p * copies, guess_cost(value[i : i + p], words, units=False) + math.log10(copies) + TWICE))
            for end, cost in ways:
                if here + cost < best[end]:
                    best[end] = here + cost
                    if here + cost < limit:
                        reach = max(reach, end)
        i += 1
    return min(best[n], limit)


def found_spans(text: str, words: dict[str, float], min_length: int, min_cost: float) -> list[tuple[int, int, str, float | None]]:
    """(start, kind's place, stop, cost) of all spans of a text in order; code points, the stop exclusive."""
    base = [(m.start(), 0, m.end(), None) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        base += [(m.start(), 1, m.end(), None) for m in ACCESS.finditer(text)]
    base += [(m.start(), 2, m.end(), None) for m in HEX.finditer(text)]
    base.sort(key=lambda s: s[:3])
    begins, farthest, reach = [s[0] for s in base], [], 0
    for s in base:
        reach = max(reach, s[2])
        farthest.append(reach)
    found = {}
    for pattern in (CONTEXT, URL_CONTEXT):
        if pattern is CONTEXT or "://" in text:
            for m in pattern.finditer(text):
                value = m[1].rstrip(TRAILING)
                a, b = m.start(1), m.start(1) + len(value)
                if len(value) >= min_length and (a, b) not in found and not ((k := bisect_right(begins, a)) and farthest[k - 1] >= b):
                    found[a, b] = guess_cost(value, words, max(min_cost, 30.0))
    return sorted(base + [(a, 3, b, cost) for (a, b), cost in found.items() if cost >= min_cost], key=lambda s: s[:3])


def scanned(documents: DataFrame, min_length: int = 8, min_cost: float = 10.0, tokenizers: str = TOKENIZERS) -> DataFrame:
    """``documents`` with all its columns plus ``secrets``: its spans, array<struct<kind, start, stop, cost>>, row by row.

    ``assign``, ``access`` and ``hex`` are the fixed shapes (leftmost, without overlap within a kind). ``guess`` are values of at least
    ``min_length`` characters in a credential context, outside all others, that take 10^``min_cost`` guesses or more; ``cost`` is their
    guess cost (30 stands for more) and null for the shapes. Places are code points of the whole text, the stop exclusive. Null and empty
    texts have none; rows that repeat are scanned alike; a text or value of any length is read to its end. A
    column named like the new one is replaced. An empty table gives no rows.
    """
    paths = tuple(f"{tokenizers.rstrip('/')}/{v}" for v in VOCABULARIES)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("cost", pa.float64())]))

    def kernel():
        words = ranked_words(paths)

        def measure(part: pa.RecordBatch) -> list:
            rows = [found_spans(t or "", words, min_length, min_cost) for t in part.column("text").to_pylist()]
            return [pa.array([[{"kind": KINDS[k], "start": a, "stop": b, "cost": c} for a, k, b, c in row] for row in rows], kind)]

        return measure

    return with_measures(documents, {"secrets": SPANS}, kernel)


def span_list(spans: str, kinds: tuple[str, ...] = KINDS) -> Column:
    """``kind:start:stop`` of the spans of some kinds, comma-joined."""
    chosen = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def redacted(documents: DataFrame, mask: str = "<secret>", **parameters) -> DataFrame:
    """``documents`` with every secret in its text replaced by ``mask``; overlapping spans become one."""
    plain, restored = veiled(documents, ("text",))
    merged = F.aggregate(
        "secrets", F.expr("named_struct('out', cast('' as string), 'at', cast(0 as bigint))"),
        lambda done, s: F.struct(
            F.when(s["start"] >= done["at"], F.concat(done["out"], F.substring("text", (done["at"] + 1).cast("int"), (s["start"] - done["at"]).cast("int")), F.lit(mask)))
            .otherwise(done["out"]).alias("out"),
            F.greatest(done["at"], s["stop"]).alias("at"),
        ),
        lambda done: F.concat(done["out"], F.substring("text", (done["at"] + 1).cast("int"), F.length("text"))),
    )
    return restored(scanned(plain, **parameters).withColumn("text", F.when(F.size("secrets") > 0, merged).otherwise(F.col("text"))))
