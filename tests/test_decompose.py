import random
from functools import lru_cache
from pathlib import Path

import pytest

from lexfreq.operators.decompose import HAN_RULES, PLAIN_RULES, RuleSet, resolve_words

LISTED = {
    "第": 2, "一": 1, "二": 1, "三": 1, "八": 1, "十": 1, "半": 2, "次": 2, "看": 1, "干净": 3, "点": 1, "分钟": 1,
    "很": 1, "多": 1, "电视": 1, "长": 2, "得": 2, "了": 1, "我": 1, "要": 2, "本": 1, "书": 1, "锻炼": 3, "身体": 2, "去": 1,
    "趟": 4, "小": 1, "王": 6, "老": 3, "张": 3, "时": 2, "哭": 3, "老师": 1, "妈妈": 1, "这": 1, "段": 3, "话": 2,
    "照片": 3, "狗": 1, "第二": 5}


def by_recursion(listed, rules):
    """The rules said once more, word by word."""

    def top(*levels):
        return None if None in levels else max(levels)

    def run_length(word, chars, start=0):
        n = start
        while n < len(word) and word[n] in chars:
            n += 1
        return n

    @lru_cache(maxsize=None)
    def level(word):
        return next((v for v in attempts(word) if v is not None), None)

    def attempts(word):
        yield listed.get(word)
        if len(word) == 1:
            yield listed.get(word + word)
        if len(word) < 2:
            return
        get = listed.get
        if rules.ordinal and word[0] == rules.ordinal:
            n = run_length(word, rules.numerals, 1)
            if n > 1:
                base = get(word[:n])
                base = base if base is not None else top(get(word[0]), *map(get, word[1:n]))
                yield base if n == len(word) else top(base, level(word[n:]))
        if word == word[0] * 2:
            yield get(word[0])
        if len(word) == 4 and word == word[0] * 2 + word[2] * 2:
            yield get(word[0] + word[2])
        if rules.silent_suffix and word.endswith(rules.silent_suffix):
            yield level(word[:-1])
        n = run_length(word, rules.numerals)
        if n == len(word):
            yield top(*map(get, word))
        elif n:
            yield top(*map(get, word[:n]), level(word[n:]))
        name = len(word) == 2 and word[0] in rules.name_risk and word[1] in rules.surnames
        if word[0] in rules.prefixes and not name:
            yield top(get(word[0]), level(word[1:]))
        if word[-1] in rules.suffixes:
            yield top(get(word[-1]), level(word[:-1]))
        for i in range(2, len(word) - 1):
            yield top(get(word[:i]), get(word[i:]))

    return level


def resolved(spark, words, listed, rules, partitions=2):
    frame = spark.createDataFrame([(w,) for w in words], "word string").repartition(partitions)
    wordlist = spark.createDataFrame(list(listed.items()), "word string, word_level int")
    return {r.word: (r.decomposed_level, r.match_pattern) for r in resolve_words(frame, wordlist, rules).collect()}


def test_documented_examples(spark):
    expected = {
        "第一次": (2, "ordinal"), "第一": (2, "ordinal"), "第二次": (5, "ordinal"), "看看": (1, "reduplication"),
        "干干净净": (3, "aabb_reduplication"), "点儿": (1, "erhua_suffix"), "二十八": (1, "pure_numeral"),
        "三分钟": (1, "numeral_plus_unit"), "很多": (1, "function_prefix"), "看电视": (1, "verb_prefix"),
        "长得": (2, "aspect_suffix"), "我要": (2, "pronoun_prefix"), "本书": (1, "measure_word"),
        "锻炼身体": (3, "two_word_compound"), "去一趟": (4, "verb_prefix"), "这段话": (3, "function_prefix"),
        "妈": (1, "single_char_via_doubled_form"), "老照片": (3, "function_prefix"), "小狗": (1, "function_prefix")}
    unresolved = ["小王", "老张", "时哭", "张老师", "第", "第电", "很", ""]
    got = resolved(spark, [*expected, *unresolved, "第二"], LISTED, HAN_RULES)
    assert got == expected


def test_random_words_equal_recursion(spark):
    rng = random.Random(7)
    alphabet = "第一二半很看我本小老王了得儿书要电视"
    listed = {w: rng.randint(1, 6) for w in
              {"".join(rng.choices(alphabet, k=rng.choice((1, 1, 2, 2, 3)))) for _ in range(140)}}
    words = {"".join(rng.choices(alphabet, k=rng.randint(1, 7))) for _ in range(4000)} - set(listed)
    level = by_recursion(listed, HAN_RULES)
    expected = {w: level(w) for w in words if level(w) is not None}
    assert len(expected) > 300
    for partitions in (1, 16):
        got = resolved(spark, words, listed, HAN_RULES, partitions)
        assert {w: v for w, (v, _) in got.items()} == expected


def test_long_chain(spark):
    listed = {"很": 1, "好": 2}
    word = "很" * 120 + "好"
    assert resolved(spark, [word], listed, HAN_RULES)[word] == (2, "function_prefix")


def test_whole_vocabulary_equals_recursion(spark):
    folder = Path("/root/testdata/sf0.001")
    if not folder.exists():
        pytest.skip("no supplied tables")
    from lexfreq.registry import inputs as I
    from lexfreq.registry.labels import LATIN_RULES
    words = {r.word for r in I.counts(spark, str(folder)).select("word").distinct().collect()}
    listed = {r.word: r.word_level for r in I.wordlist(spark, str(folder)).collect()}
    for rules in (LATIN_RULES, PLAIN_RULES):
        level = by_recursion(listed, rules)
        expected = {w: level(w) for w in words if w not in listed and level(w) is not None}
        got = resolved(spark, words, listed, rules, 8)
        assert {w: v for w, (v, _) in got.items()} == expected


def test_empty_classes_switch_rules_off(spark):
    got = resolved(spark, ["很多", "看看", "锻炼身体"], LISTED, RuleSet())
    assert set(got) == {"看看", "锻炼身体"}
