"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import time

from vectorloom import local_session
from vectorloom.plans import catalog

HEADLINE = ["build_vocab", "tfidf", "similarity_query", "phrase_scores", "apply_phrases", "ngram_cooccurrence_2", "ppmi_shifted",
            "coherence_c_npmi", "pagerank_weighted", "bm25_scores", "dense_similarity", "most_similar", "eval_analogy_add",
            "outlier_positions", "lda_fit", "lsi_transform", "stream_vocab"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    seconds = {}
    for name in HEADLINE:
        start = time.time()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "headline queries, total wall time", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
