"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is run once to warm up and then BENCH_RUNS times; the median is reported. The
result is written to the no-op sink, so every row is computed and none is collected. Building
the query is part of the time, because multi-pass operators run jobs while building.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import functions as F

from auricle.operators import windows
from auricle.params import PRESETS, SAMPLE_RATE
from auricle.plans import load
from auricle.session import local_spark

HEADLINE = (
    "decision_stream quick_action_events virtual_clock policy_payload_parse level_comparison clip_topk_mean "
    "summary_metrics within_cross_errors group_stratified_split covariate_balanced_split best_seed_split "
    "quantile_rank_bin gate_distribution_ks gate_distribution_stats gate_verdict class_summary "
    "duplicate_content_groups clip_ledger dedupe_keep_first priority_assign leakage_guard_antijoin "
    "label_vocabulary_counts class_source_confounding centroid_margin linear_head_score embedding_pool "
    "mel_features window_index"
).split()


def mel_features_preset_a(spark, sf_dir):
    """Spectra at real window sizes: clips of one second made of the given arrays, preset A."""
    window, step, n_fft, hop, n_mels = PRESETS["A"]
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").repartition(spark.sparkContext.defaultParallelism)
    second = F.flatten(F.array_repeat("embedding", SAMPLE_RATE // 64)).alias("samples")
    kept = windows.frame_windows(vectors.select("vec_id", second), "samples", window, step)
    return windows.mel_features(kept, "frame", SAMPLE_RATE, n_fft, hop, n_mels)


#: Timed beside the headline queries, not part of the total.
EXTRA = {"mel_features_preset_a": mel_features_preset_a}


def main() -> int:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 4))
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    wanted = sys.argv[1:] or [*HEADLINE, *EXTRA, "logistic_head", "mlp_head", "binary_stack_head"]
    spark = local_spark(cpus)
    queries = {**load()[0], **EXTRA}
    times = {}
    for name in wanted:
        taken = []
        for i in range(runs + 1):
            start = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            if i:
                taken.append(time.perf_counter() - start)
        times[name] = round(statistics.median(taken), 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(t for n, t in times.items() if n in HEADLINE), 3),
                "unit": "sec",
                "queries": {n: t for n, t in times.items() if n in HEADLINE},
                "extra": {n: t for n, t in times.items() if n not in HEADLINE},
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cpus": cpus,
            }
        )
    )
    return 0


if __name__ == "__main__":
    sys.exit(main())
