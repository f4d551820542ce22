import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexfreq.llm.words import ALPHANUMERIC, SPACED, find_words, grams, slices

KINDS = [(SPACED, re.compile(rb"[^\x20\x09-\x0D]+")), (ALPHANUMERIC, re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"))]


@pytest.mark.parametrize("kind,pattern", KINDS)
@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.one_of(st.none(), st.text(alphabet="aBß\n\t .,9日\x00~Z|", max_size=30)), max_size=6))
def test_words_are_those_of_the_pattern(kind, pattern, texts):
    words = find_words(pa.array(texts, pa.string()), kind)
    found = [[] for _ in texts]
    for text, b, e in zip(words.text, words.begin, words.end):
        found[text].append(words.data[b:e].tobytes())
    assert found == [pattern.findall((t or "").encode().lower()) for t in texts]
    assert words.counts().tolist() == [len(f) for f in found]


def test_hashes_follow_the_words():
    words = find_words(pa.array(["the end of the", None, "", "END The"]), SPACED)
    h = words.hashes()
    assert h[0] == h[3] == h[5] and h[1] == h[4] and len({*h.tolist()}) == 3
    assert words.hashes(0, 2)[0] == find_words(pa.array(["th"]), SPACED).hashes()[0]
    assert words.hashes(1)[0] != h[0]
    two = grams(h, 2)
    assert len(two) == 5 and two[0] != two[4]


def test_slices_are_bounded_and_whole():
    texts = ["a" * n for n in (5, 300, 2, 2, 2, 0)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])
    parts = list(slices([batch], limit=6))
    assert [t for p in parts for t in p["text"].to_pylist()] == texts
    assert all(p.num_rows == 1 or sum(len(t or "") for t in p["text"].to_pylist()) <= 6 for p in parts)
    assert all(np.array_equal(find_words(p["text"], SPACED).counts(), [int(bool(t)) for t in p["text"].to_pylist()]) for p in parts)
