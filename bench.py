"""Time the headline queries; prints one JSON line.

Every query runs to the end over the whole tables of $BENCH_SF_DIR; results go to Spark's `noop`
sink. Before it is timed, a query runs once on the next smaller tables, where there are any, so
that class loading and code generation of a fresh JVM are not what is measured.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from lexfreq.registry import QUERIES  # noqa: E402
from lexfreq.session import local_session  # noqa: E402

# corpus_written is the load; the queries up to all_word_sentence_totals answer from a corpus that is loaded once.
HEADLINES = [
    "corpus_written", "counts_per_file", "rollup", "top_words", "top_words_exam_level", "compare_words", "word_detail",
    "example_sentences", "exam_sentences", "all_word_sentence_totals", "transcripts_deduped",
    "repeats_collapsed", "converted_counts", "segmented_counts", "compound_levels",
    "affixed_compound_levels", "labelled_counts", "coverage_by_match_type", "unmatched_review",
    "top_per_level", "rank_frequency", "best_copies", "frequency_upsert", "constraint_violations",
    "streamed_rollup",
]


def run(spark, name: str, folder: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    smaller = Path(folder).parent / "sf0.01"
    warm_up = str(smaller if smaller.exists() else folder)
    seconds = {}
    for name in HEADLINES:
        run(spark, name, warm_up)
        seconds[name] = round(run(spark, name, folder), 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": Path(folder).name.removeprefix("sf")}))


if __name__ == "__main__":
    main()
