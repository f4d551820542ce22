import random
import re
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from lexfreq.functions import text as X
from lexfreq.operators import cleaning as CL


def collapsed(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").repartition(3)
    out = df.select("i", CL.collapse_repeats(F.col("text")).alias("t")).collect()
    return [r.t for r in sorted(out, key=lambda r: r.i)]


def by_regex(text):
    return None if text is None else re.sub(r"(?s)(.{4,200})\1+", r"\1", text)


def test_noise_before_the_first_copy(spark):
    text = "嘟嘟现在开始听写!请准备好。现在开始听写!请准备好。现在开始听写!请准备好。完"
    assert collapsed(spark, [text]) == ["嘟嘟现在开始听写!请准备好。完"]


def test_short_repeats_stay(spark):
    assert collapsed(spark, ["对对对", "好,好,", "", None]) == ["对对对", "好,好,", "", None]


def test_repeats_equal_the_regex(spark):
    rng = random.Random(3)
    texts = [None, "", "a", "a" * 5000, "ab" * 700, "\n" * 40, "😀😀🎉🎉" * 30]
    for _ in range(400):
        alphabet = "ab" if rng.random() < .3 else "abcdefgh \n汉字😀"
        pieces = []
        for _ in range(rng.randint(1, 12)):
            piece = "".join(rng.choices(alphabet, k=rng.choice((1, 3, 4, 5, 9, 30, 120, 199, 200, 201, 260))))
            pieces.append(piece * rng.choice((1, 1, 2, 3)))
        texts.append("".join(pieces))
    assert collapsed(spark, texts) == [by_regex(t) for t in texts]


def test_texts_do_not_reach_into_each_other(spark):
    df = spark.createDataFrame([(i, "gleicher Satz.") for i in range(50)], "i int, text string").coalesce(1)
    assert {r.t for r in df.select(CL.collapse_repeats(F.col("text")).alias("t")).collect()} == {"gleicher Satz."}


def blocks_by_definition(parts, at=0):
    """The longest block first, compared clause by clause with no short cuts."""
    def same(a, b):
        return SequenceMatcher(None, a, b).ratio() >= 0.82

    def twice(first, size):
        second = first + size
        return second + size <= len(parts) and all(same(parts[first + k], parts[second + k]) for k in range(size))

    kept = []
    while at < len(parts):
        sizes = [n for n in range(8, 0, -1) if twice(at, n) and (n > 1 or len(parts[at]) >= 4)]
        size = sizes[0] if sizes else 1
        kept += parts[at:at + size]
        at += size
        while sizes and twice(at - size, size):
            at += size
    return kept


def test_clause_blocks_equal_the_definition(spark):
    rng = random.Random(5)
    rows = []
    for i in range(150):
        vocabulary = ["".join(rng.choices("abcdefg你好", k=rng.randint(1, 14))) + "," for _ in range(5)]
        parts = []
        for _ in range(rng.randint(1, 10)):
            block = rng.choices(vocabulary, k=rng.randint(1, 9))
            parts += block
            if rng.random() < .6:
                parts += [p[:-2] + rng.choice("xy") + p[-1] if rng.random() < .2 else p for p in block]
        rows.append((i, parts))
    df = spark.createDataFrame(rows, "i int, parts array<string>")
    got = {r.i: r.kept for r in df.select("i", CL.collapse_clause_blocks(F.col("parts")).alias("kept")).collect()}
    assert got == {i: blocks_by_definition(parts) for i, parts in rows}


def test_only_listening_rows_change(spark):
    loop = "他们都来得很早,他们都来得很早,他们都来得很早。好"
    near = "今天天气真的很不错啊,今天天气真的很不错呀,再见。"
    rows = [(1, "reading", loop), (2, "listening", loop), (3, "listening", near), (4, "listening", ""),
            (5, "listening", None), (6, "listening", "好。好。")]
    df = spark.createDataFrame(rows, "i int, source_type string, text string")
    out = CL.dedupe_transcripts(df, F.col("source_type") == "listening")
    got = {r.i: r.text_clean for r in out.collect()}
    assert got[1] == loop and got[3] == "今天天气真的很不错啊,再见。"
    # The last copy ends in another mark, so the second pass takes it.
    assert got[2] == "他们都来得很早,好"
    assert got[4] == "" and got[5] is None and got[6] == "好。好。"
    assert out.columns == ["i", "source_type", "text", "text_clean"]


def test_clauses(spark):
    row = spark.range(1).select(X.clauses(F.lit("你好,再见。  ;好!")).alias("c")).first()
    assert row.c == ["你好,", "再见。", "  ;", "好!"]


def test_script_conversion(spark):
    dictionary = spark.createDataFrame(
        [("什麼", "什么"), ("題", "题"), ("沒", "没"), ("嗎", "吗"), ("我們", "我们"), ("乾淨", "干净"), ("乾", "干"), ("乾坤", "乾坤")],
        "traditional string, simplified string")
    pairs = CL.character_pairs(dictionary)
    texts = spark.createDataFrame([("我們沒題嗎?什麼",)], "t string")
    assert texts.select(CL.simplify_text(F.col("t"), pairs).alias("t")).first().t == "我们没题吗?什么"
    words = spark.createDataFrame([("乾坤", 6), ("乾淨", 3), ("干净", 5), ("嗎們", 2)], "word string, word_level int")
    converted = CL.lowest_level(CL.simplify_words(words, dictionary, pairs))
    assert {(r.word, r.word_level) for r in converted.collect()} == {("乾坤", 6), ("干净", 3), ("吗们", 2)}


def test_markers_and_scripts(spark):
    row = spark.range(1).select(
        X.marker_count(F.lit("這題說什麼,我們說")).alias("n"),
        X.keep_script(F.array(*[F.lit(w) for w in ("你好", "a1", "你a", "好", "")])).alias("whole"),
        X.keep_script(F.array(*[F.lit(w) for w in ("你好", "a1", "你a", "好", "")]), mode="any").alias("part")).first()
    assert row.n == 6 and row.whole == ["你好", "好"] and row.part == ["你好", "你a", "好"]


def longest_first(text, targets):
    out, at = "", 0
    while at < len(text):
        word = max((w for w in targets if text.startswith(w, at)), key=len, default=None)
        out += text[at] if word is None else targets[word]
        at += len(word or "x")
    return out


def test_phrases_in_running_text(spark):
    """The longest phrase from the left is converted as a whole; one that stays as it is keeps its characters."""
    dictionary = spark.createDataFrame([("乾淨", "干净"), ("乾", "干"), ("乾坤", "乾坤"), ("頭髮", "头发"), ("發", "发"), ("乾坤圈", "乾坤圈儿")],
                                       "traditional string, simplified string")
    listed = CL.phrase_pairs(dictionary, CL.character_pairs(dictionary))
    texts = spark.createDataFrame(list(enumerate(["乾坤乾淨乾頭髮發", "乾坤圈乾坤", "", None, "abc"])), "i int, text string")
    for most in (1000, 2):
        got = {r.i: r.text for r in CL.convert_phrases(texts, listed, most=most).collect()}
        assert got == dict(enumerate(["乾坤干净干头发发", "乾坤圈儿乾坤", "", None, "abc"]))


def test_phrases_against_the_definition(spark):
    rng = random.Random(8)
    targets = {"".join(rng.choices("abc你", k=rng.randint(1, 5))): "".join(rng.choices("xyz", k=rng.randint(0, 4))) for _ in range(25)}
    phrases = spark.createDataFrame(list(targets.items()), "word string, target string")
    texts = ["".join(rng.choices("abc你-", k=rng.randint(0, 60))) for _ in range(80)]
    frame = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "i int, text string, other string").repartition(3)
    for most in (1000, 6):
        out = CL.convert_phrases(frame, phrases, output="new", most=most)
        assert out.columns == ["i", "text", "other", "new"]
        assert {r.i: (r.text, r.new) for r in out.collect()} == {i: (t, longest_first(t, targets)) for i, t in enumerate(texts)}
    assert CL.convert_phrases(frame, phrases.limit(0), output="new").filter("new <> text").count() == 0


def test_repeats_do_not_depend_on_how_many_texts_are_taken_together(spark, monkeypatch):
    texts = ["abcdabcd" * i + "x" * (i % 9) for i in range(40)] + [None, "", "no repeat here"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    found = []
    for chars in (1, 100, 4_000_000):
        monkeypatch.setattr(CL, "BATCH_CHARS", chars)
        found.append([r.t for r in rows.select(CL.collapse_repeats(F.col("text")).alias("t")).collect()])
    assert found[0] == found[1] == found[2] and found[0][0] == "" and len(found[0]) == len(texts) and found[0][2] == "abcdabcdxx"
