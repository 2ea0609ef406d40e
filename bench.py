"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from catalog.registry import QUERIES
from newslens.runtime import build_session

HEADLINE = (
    "p1_standardize",
    "q1_first_of_duplicates",
    "u1_combine",
    "u2_balance",
    "u3_statistics",
    "p6_clean_words",
    "d1_simhash",
    "d3_band_profile",
    "d4_near_pairs",
    "d5_groups",
    "d7_stratified_splits",
    "u4_split_profile",
    "e5_document_vectors",
    "f1_paraphrasing",
    "f2_subjectivity",
    "f4_lexicon_table_share",
    "f5_sentiment_polarity",
    "f7_selective_quoting",
    "f10_evidence_records",
    "f10_feature_means",
    "m1_minmax_fit",
    "m2_transition",
    "m4_linear_svm",
    "v2_roc_auc",
    "v5_fidelity",
    "v7_paired_t_test",
    "s10_run_tables",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", cores, max(8, int(cores) if cores.isdigit() else 8))
    spark.read.parquet(f"{sf}/labels.parquet").count()
    seconds = {}
    for name in HEADLINE:
        start = time.time()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": seconds, "sf": sf.rstrip("/").split("sf")[-1]}))


if __name__ == "__main__":
    main()
