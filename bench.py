"""Headline queries against ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

    python bench.py [query ...]
"""

from __future__ import annotations

import json
import os
import sys
import time

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 1))
HEADLINE = (
    "sentence_counts_by_language h1_search_blocks f5_search_bounded h7_normalize_speech h9_sentences"
    " c12_speech_sentences h16_text_digest a3_text_blocks a4_markdown_blocks a5_html_blocks b1_filter_library"
    " c2_assemble c5_missing_audio d7_document_text e1_elapsed e9_reading_order structure_pages d20_otsu"
    " h25_bpe_tokenize i1_upsert j5_fold_jobs"
).split()


def main() -> None:
    from lectern.plans.catalog import QUERIES
    from lectern.session import local_session

    spark = local_session("bench", CPUS)
    names = sys.argv[1:] or [n for n in HEADLINE if n in QUERIES]
    spark.read.parquet(f"{SF_DIR}/documents.parquet").count()  # start-up is not a query
    timings = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
