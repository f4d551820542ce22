import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from lexfreq.plans.corpus import Corpus  # noqa: E402
from lexfreq.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(4, memory="8g", **{
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared"))})
    yield session
    session.stop()


@pytest.fixture(scope="session")
def seed(spark):
    """Two exams, four words; the rollup says 9 where the counts say 11, to tell the two apart."""
    wordlist = spark.createDataFrame(
        [("苹果", "píng guǒ", 1, "apple", "แอปเปิล"), ("老师", "lǎo shī", 1, "teacher", "ครู"), ("虽然", "suī rán", 4, "although", None)],
        "word string, pinyin string, word_level int, definition string, definition_th string")
    sources = spark.createDataFrame(
        [("k07", "listening", 2018, 4, "k07_tape.mp3"), ("k07", "reading", 2018, 4, "k07.pdf"), ("m11", "reading", 2022, 5, "m11.pdf")],
        "exam_id string, source_type string, year int, exam_level int, filename string")
    levels = "word string, word_level int, effective_level int, source_type string"
    frequencies = spark.createDataFrame(
        [("苹果", 1, 1, "reading", "k07", 6, True), ("苹果", 1, 1, "listening", "k07", 4, True), ("苹果", 1, 1, "reading", "m11", 3, True),
         ("老师", 1, 1, "reading", "k07", 2, True), ("虽然", 4, 4, "reading", "m11", 11, True), ("机器猫", None, None, "reading", "m11", 1, False)],
        f"{levels}, exam_id string, frequency long, in_official_wordlist boolean")
    aggregates = spark.createDataFrame(
        [("苹果", 1, 1, "reading", 9, 2, True), ("苹果", 1, 1, "listening", 4, 1, True), ("苹果", 1, 1, "all", 13, 2, True),
         ("老师", 1, 1, "reading", 2, 1, True), ("老师", 1, 1, "all", 2, 1, True), ("虽然", 4, 4, "reading", 9, 1, True),
         ("虽然", 4, 4, "all", 9, 1, True), ("机器猫", None, None, "reading", 1, 1, False), ("机器猫", None, None, "all", 1, 1, False)],
        f"{levels}, total_frequency long, exam_count long, in_official_wordlist boolean")
    sentences = spark.createDataFrame(
        [("k07", "reading", "老师每天早上吃一个苹果。"), ("k07", "listening", "这个苹果又大又甜。"), ("m11", "reading", "虽然外面很冷，他还是去跑步了。")],
        "exam_id string, source_type string, sentence string")
    return Corpus(wordlist, sources, frequencies, aggregates, sentences)
