"""Time headline queries: one JSON line, seconds per query (results are written to the no-op sink, not collected)."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from docloom.session import build_session  # noqa: E402
from suite import REGISTRY  # noqa: E402

HEADLINE = (
    "top_k_similar", "recommend_by_document", "recommend_for_profiles", "recommend_by_text", "feedback_boosted", "grid_search",
    "mean_metrics", "average_list_overlap", "diversity_at_10", "length_profile_by_form", "z_threshold_sweep", "length_density",
    "duplicate_copies", "earliest_copies", "sampled_documents", "top_keyword_lists", "document_bundles", "author_pair_counts",
    "top_bigrams", "document_ratings", "user_ratings", "clean_legal_texts", "sentence_chunks", "structure_chunks", "summaries_by_tier",
    "extracted_keywords", "rouge_scores", "page_main_texts", "page_sections", "vector_rows", "upserted_keywords", "streamed_ratings",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(f"local[{cpus}]", "bench", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    for warm in ("document_ratings", "top_k_similar"):  # JVM and Python workers started, not counted
        REGISTRY[warm].run(spark, sf).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        t0 = time.perf_counter()
        REGISTRY[name].run(spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
