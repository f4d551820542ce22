import random

import numpy as np
import pyarrow as pa

from lexfreq.operators import trie as T


def test_every_listed_word_is_found_wherever_it_stands():
    rng = random.Random(5)
    for letters in ("ab", "abcdé你", "x\U0001F600y"):
        words = sorted({"".join(rng.choices(letters, k=rng.randint(1, 6))) for _ in range(40)})
        texts = ["".join(rng.choices(letters + "z", k=rng.randint(0, 30))) for _ in range(20)] + ["", None]
        own = T.Trie.of(pa.array(words))
        points, starts = T.letters_of(pa.array(texts))
        at, size, word = own.found(points, starts)
        got = [(int(np.searchsorted(starts, a, side="right") - 1), int(a), words[w]) for a, w in zip(at, word)]
        got = sorted((i, a - int(starts[i]), w) for i, a, w in got)
        assert got == sorted((i, p, w) for i, t in enumerate(texts) for w in words for p in range(len(t or "")) if (t or "").startswith(w, p))
        assert all(len(words[w]) == s for w, s in zip(word, size))


def test_empty_list_finds_nothing():
    own = T.Trie.of(pa.array([], pa.string()))
    assert [len(x) for x in own.found(*T.letters_of(pa.array(["abc"])))] == [0, 0, 0]


def test_pieces_hold_the_whole_list(spark):
    words = spark.createDataFrame([(f"w{i}", i) for i in range(50)] + [("", 99)], "word string, n long")
    pieces = [b.value for b in T.pieces_of(words, 12)]
    assert len(pieces) >= 4 and all(p.rows.num_rows <= 25 for p in pieces)
    assert sorted(x for p in pieces for x in p.rows["n"].to_pylist()) == list(range(50))


def test_slices_are_bounded():
    batch = pa.RecordBatch.from_pydict({"t": ["a" * n for n in (3, 4, 9, 1, 1, 1)] + [None]})
    assert [s["t"].to_pylist() for s in T.text_slices([batch], "t", 5)] == [["aaa"], ["aaaa"], ["a" * 9], ["a", "a", "a", None]]


def test_steps_beyond_the_table_are_searched(monkeypatch):
    rng = random.Random(6)
    words = sorted({"".join(rng.choices("abc", k=rng.randint(1, 7))) for _ in range(80)})
    points, starts = T.letters_of(pa.array(["".join(rng.choices("abcz", k=40)) for _ in range(30)]))
    found = {}
    for steps in (1, 40, 1 << 22):
        monkeypatch.setattr(T, "TABLE_STEPS", steps)
        own = T.Trie.of(pa.array(words))
        found[steps] = [x.tolist() for x in own.found(points, starts)]
        assert len(own._table) == 4 * min(len(own.word), max(1, steps // 4))
    assert found[1] == found[40] == found[1 << 22]
    text = "".join(map(chr, points))
    assert sorted(zip(*found[1])) == sorted((p, len(w), n) for n, w in enumerate(words) for p in range(len(text))
                                            if text.startswith(w, p) and p + len(w) <= starts[np.searchsorted(starts, p, side="right")])


def test_numbers_are_listed_once():
    numbers = np.array([5, -1, 5, 3, -1], np.int64)
    assert T.distinct(numbers).tolist() == [-1, 3, 5] and T.distinct(numbers[:0]).tolist() == [] and numbers.tolist() == [5, -1, 5, 3, -1]
