"""Word kernels against regular expressions."""

import brute as B
import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from corpuswatch.llm import words as W

texts = st.lists(st.one_of(st.none(), st.text(alphabet="aB1 \t\n\x0b\x00é漢.\u00a0", max_size=30)), max_size=8)


@settings(max_examples=150, deadline=None)
@given(texts)
def test_words_equal_regular_expressions(rows):
    for table, pattern in ((W.NOT_BLANK, B.BLANK), (W.LETTERS, B.LETTER)):
        w = W.words_of(pa.array(rows, pa.string()), table)
        for d, t in enumerate(rows):
            want = pattern.findall(B.lower(t))
            assert w.counts[d] == len(want)
            assert w.text(w.first[d], w.first[d + 1]).decode() == " ".join(want)


@settings(max_examples=100, deadline=None)
@given(texts, st.integers(1, 6))
def test_equal_windows_have_equal_hashes(rows, length):
    w = W.words_of(pa.array(rows, pa.string()))
    hashes, inside = w.windows(length)
    by_hash = {}
    for d, t in enumerate(rows):
        words = B.BLANK.findall(B.lower(t))
        for j in range(len(words)):
            assert inside[w.first[d] + j] == (j + length <= len(words))
            if j + length <= len(words):
                by_hash.setdefault(int(hashes[w.first[d] + j]), set()).add(tuple(words[j : j + length]))
    assert all(len(v) == 1 for v in by_hash.values())
    values, first = W.shingle_sets(w, length)
    for d, t in enumerate(rows):
        words = B.BLANK.findall(B.lower(t))
        want = {tuple(words[j : j + length]) for j in range(len(words) - length + 1)} or ({tuple(words)} if words else set())
        assert first[d + 1] - first[d] == len(want)


def test_sliced_arrays_and_chunks():
    rows = pa.array(["zero", None, "one two", "", "three " * 50, "x"])
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), rows], ["doc_id", "text"])
    parts = list(W.chunks(batch.slice(1), "text", most=10))
    assert [i for p in parts for i in p.column("doc_id").to_pylist()] == [1, 2, 3, 4, 5]
    assert np.concatenate([W.words_of(p.column("text")).counts for p in parts]).tolist() == [0, 2, 0, 50, 1]
