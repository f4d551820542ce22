from pyspark.sql import functions as F

from lexfreq.functions import names, quality
from lexfreq.plans import analysis
from lexfreq.sources import files as FL


def test_names(spark):
    rows = ["H31001.pdf", "H31114 Audio.mp3", "H31327-exam-paper.pdf", "h31553b_copy.pdf", "H40000_copy.pdf", "readme.pdf", "H51001.pdf"]
    df = spark.createDataFrame([(n,) for n in rows], "n string")
    got = {r.n: (r.e, r.l, r.f) for r in df.select(
        "n", names.exam_id(F.col("n")).alias("e"), names.exam_level(F.col("n")).alias("l"),
        names.file_type(F.col("n")).alias("f")).collect()}
    assert got == {"H31001.pdf": ("H31001", 3, "full_exam"), "H31114 Audio.mp3": ("H31114", 3, "full_exam"),
                   "H31327-exam-paper.pdf": ("H31327", 3, "instruction_sheet"), "h31553b_copy.pdf": ("H31553B", 3, "full_exam"),
                   "H40000_copy.pdf": ("H40000", 4, "full_exam"), "readme.pdf": (None, None, "full_exam"), "H51001.pdf": (None, None, "full_exam")}


def test_year_level_and_prefixed_id(spark):
    df = spark.createDataFrame([("HSK4_2019_listening.mp3",), ("plain.pdf",)], "n string")
    rows = df.select(names.year(F.col("n")), names.level_tag(F.col("n")),
                     names.prefixed_exam_id(F.lit("listening"), F.col("n"))).collect()
    assert [tuple(r) for r in rows] == [(2019, 4, "listening_HSK4_2019_listening"), (None, None, "listening_plain")]


def touch(folder, *filenames):
    folder.mkdir(parents=True, exist_ok=True)
    for name in filenames:
        (folder / name).write_bytes(b"x" * 300_000)


def test_inventory(spark, tmp_path):
    touch(tmp_path, "H31001.pdf", "H31001_copy.pdf", "H31001 Audio.mp3", "H31001(1).PDF", "notes.txt", "other.pdf", "H40002试卷.pdf")
    touch(tmp_path / "deep", "H40003.pdf")
    flat = FL.list_files(spark, str(tmp_path))
    assert {r.filename for r in flat.collect()} == {"H31001.pdf", "H31001_copy.pdf", "H31001 Audio.mp3", "H31001(1).PDF", "other.pdf", "H40002试卷.pdf"}
    assert {r.size_mb for r in flat.collect()} == {0.29}
    assert FL.list_files(spark, str(tmp_path), recursive=True).filter("filename = 'H40003.pdf'").count() == 1
    assert "content" not in flat._jdf.queryExecution().executedPlan().toString()
    described = FL.describe_files(flat)
    assert {(r.exam_id, r.source_type, r.filename) for r in FL.best_copies(described).collect()} == {
        ("H31001", "reading", "H31001.pdf"), ("H31001", "listening", "H31001 Audio.mp3"), ("H40002", "reading", "H40002试卷.pdf")}
    assert [r.filename for r in FL.skipped_files(flat).collect()] == ["other.pdf"]
    dropped = FL.duplicate_files(described).filter("NOT is_kept").collect()
    assert {(r.filename, r.kept) for r in dropped} == {("H31001_copy.pdf", "H31001.pdf"), ("H31001(1).PDF", "H31001.pdf")}
    assert {(r.exam_id, r.source_type) for r in FL.only_in_one_source(described).collect()} == {("H40002", "reading")}
    ranked = FL.best_copies_ranked(described, 2).filter("exam_id = 'H31001' AND source_type = 'reading'").collect()
    assert {(r.copy_rank, r.filename) for r in ranked} == {(1, "H31001.pdf"), (2, "H31001(1).PDF")}


def test_resume_retries_failures(spark):
    files = spark.createDataFrame([(f"f{i}",) for i in range(6)], "filename string")
    progress = spark.createDataFrame(
        [("f0", "ok"), ("f1", "ocr_ok"), ("f2", "ocr_empty"), ("f3", "error:boom"), ("f4", None)], "filename string, notes string")
    left = FL.pending_files(files, progress, quality.is_done(F.col("notes")))
    assert {r.filename for r in left.collect()} == {"f2", "f3", "f4", "f5"}


def test_extraction_quality(spark):
    rows = [("", 1, "empty"), ("  \n　", 1, "empty"), ("x" * 149, 1, "sparse"), ("x" * 150, 0, None), ("x" * 299, 2, "sparse"),
            ("x" * 150 + "(cid:12)" * 10, 1, None), ("x" * 150 + "(cid:12)" * 11, 1, "cid")]
    df = spark.createDataFrame(rows, "text string, pages int, expected string")
    reason = quality.ocr_reason(F.col("text"), F.col("pages"))
    out = df.select("expected", reason.alias("reason"), quality.ocr_note(reason).alias("note")).collect()
    assert [r.reason for r in out] == [r.expected for r in out]
    assert {r.note for r in out} == {"ok", "ocr_ok", "sparse_then_ocr_ok", "cid_then_ocr_ok"}
    notes = spark.createDataFrame([("ok",), ("ocr_ok",), ("sparse_then_ocr_ok",), ("cid_then_ocr_ok",), ("error:x",)], "n string")
    assert [r.m for r in notes.select(quality.method_label(F.col("n")).alias("m")).collect()] == [
        "pdfplumber", "OCR (scanned)", "OCR (sparse fix)", "OCR (cid fix)", "other"]


def test_length_bins_are_right_closed(spark):
    values = [0, 1, 600, 601, 4000, 7000, 7001, 20000, 20001]
    df = spark.createDataFrame([(v,) for v in values], "n int").select(quality.length_bin(F.col("n")).alias("b"))
    assert [r.b for r in df.collect()] == [None, "<600", "<600", "600-4k", "600-4k", "4k-7k", ">7k", ">7k", None]


def test_full_exam(spark):
    good = "第一部分 第二部分 第三部分 " + "".join(f"{i}．他来了 " for i in range(1, 41))
    rows = [(good, 3), ("第一部分 第一部分 31. 好", 3), (good, 4), ("", 5)]
    df = spark.createDataFrame(rows, "text string, exam_level int")
    checks = quality.full_exam_checks(F.col("text"), F.col("exam_level"))
    out = [tuple(r) for r in df.select(*[c.alias(n) for n, c in checks.items()]).collect()]
    assert out == [(3, 40, 100.0, "OK"), (1, 31, 77.5, "sections=1/3; max_q=31/40"), (3, 40, 88.9, "OK"), (0, 0, 0.0, "sections=0/3")]


def test_instruction_sheet(spark):
    rows = [("注 意 一、听力 二，阅  读 三。书写",), ("听力 一、一、",)]
    checks = quality.instruction_checks(F.col("text"))
    out = [r.asDict() for r in spark.createDataFrame(rows, "text string").select(*[c.alias(n) for n, c in checks.items()]).collect()]
    assert out[0] == {"has_notice": True, "has_listening": True, "has_reading": True, "has_writing": True, "notice_items": 3, "issues": "OK"}
    assert out[1]["issues"] == "no 注意 header; missing: 阅读,书写; notice_items=1/3"


def test_file_summaries(spark):
    rows = [(3, "e1", "reading", "a", 100, 2.0, 2, "ok"), (3, "e2", "reading", "b", 0, 1.0, 0, "ocr_empty"), (4, "e3", "listening", "c", 5000, 4.0, 5, "ok")]
    df = spark.createDataFrame(rows, "exam_level int, exam_id string, source_type string, filename string, text_length int, size_mb double, pages int, notes string")
    assert {tuple(r) for r in analysis.extraction_summary(df).collect()} == {(3, "reading", 2, 50.0, 1), (4, "listening", 1, 5000.0, 0)}
    assert [tuple(r) for r in analysis.note_counts(df).collect()] == [("ok", 2), ("ocr_empty", 1)]
    assert {tuple(r) for r in analysis.length_groups(df).collect()} == {("<600", 1, 100.0, 2.0), ("4k-7k", 1, 5000.0, 4.0), ("other", 1, 0.0, 1.0)}
    assert {tuple(r) for r in analysis.method_summary(df).collect()} == {("pdfplumber", 2, 2550.0, 3.5, 525.0, 3.0), ("other", 1, 0.0, 0.0, 0.0, 1.0)}
    assert {tuple(r) for r in analysis.method_by_exam_level(df, (3, 4)).collect()} == {("pdfplumber", 1, 1, 0), ("other", 1, 0, 0)}
    both = analysis.combine_extractions(df.filter("source_type = 'reading'"), df.filter("source_type = 'listening'"))
    assert [r.filename for r in both.collect()] == ["a", "b", "c"]
