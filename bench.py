"""Headline-query benchmark.

Runs the headline queries at $BENCH_SF_DIR (default /root/testdata/sf0.1)
on local[$BENCH_CPUS] and prints ONE JSON line.  Each query is executed in
full through the no-op sink (no collect to the driver).
"""
from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "clean_text", "dedup_oldest_row", "set_union_agg", "label_transitions", "reply_proportion",
    "tfidf_by_label", "lexicon_scores", "tag_histogram", "components", "context_text", "n_hop",
    "clustering_coefficient", "group_split", "classification_report", "roc_auc", "corpus_bleu",
    "mann_whitney", "chi2_allpairs",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    from convgraph.session import local_session
    from convgraph.plans.registry import load_all
    spark = local_session(cores=cpus, shuffle_partitions=int(cpus) * 2, app="convgraph-bench")
    reg = load_all()
    times = {}
    # one run that is not timed: JVM, code generation and Python workers start
    reg[names[0]][0](spark, sf_dir).write.format("noop").mode("overwrite").save()
    for name in names:
        fn, _ = reg[name]
        t0 = time.time()
        fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
