"""Seconds per headline query; prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default all).
"""

from __future__ import annotations

import json
import os
import re
import time

from sievework.plans import catalog
from sievework.session import local_session

HEADLINES = [
    "fill_mean", "fill_median", "fill_mode", "z_score", "min_max", "quantile_filter", "dedup_keep_first",
    "movies_shape", "music_shape", "bins_freq_mean", "bins_freq_median", "bins_freq_named", "bins_width_mean",
    "merge_uncommon_topk", "merge_uncommon_count", "lang_split_semi_join", "csv_ingest", "term_counts",
    "stemmed_counts", "rare_term_prune", "bag_join_label", "mutual_information_topk", "sample_n", "split_80_20",
    "stratified_folds", "nb_predict", "accuracy_f1", "kde_curve", "box_stats", "word_counts", "summary_stats",
    "quantiles", "arff_header", "arff_body", "prepare_lineitem",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("bench", os.environ.get("BENCH_CPUS", "*"))
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.queries()

    def run(name: str) -> float:
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    for name in ("z_score", "bins_freq_mean", "term_counts"):  # start the session's code paths
        run(name)
    seconds = {name: round(run(name), 3) for name in HEADLINES}
    scale = re.search(r"sf([0-9.]+)", folder)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale.group(1)) if scale else None,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
