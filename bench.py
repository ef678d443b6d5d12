"""Times headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS] and prints one line of JSON."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = (
    "s10_project_rollup", "s12_audit_archive", "lines_frame", "r13_r14_rewrite", "r16_line_diff", "x1_python_imports", "x6_calls", "j1_resolve_python_imports",
    "a1_module_complexity", "a7_degrees", "g1_transitive_dependents", "g3_dependency_cycles", "g4_cyclic_components", "g7_module_graph", "w4_top_priorities", "g9_change_impact", "w5_phase_files", "a9_readiness", "x11_test_plan", "a11_coverage_rollup", "k3_mermaid_report",
)


def whole(spark, sf_dir: str) -> tuple[float, int]:
    """Seconds and lines of an analysis from end to end: texts in files, then inventory, parsing, all warning rules, imports and
    edges, graph with cycles, impacts, readiness, test plans, rewrites behind the syntax gate, their diffs, explanations."""
    from pyspark.sql import functions as F

    from codecorpus.plans import analysis
    from codecorpus.queries.views import frame
    from codecorpus.queries.whole import texts

    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/files"
    texts(frame(spark, sf_dir, "v_code")).write.parquet(path)
    began = time.time()
    tables = analysis.analyze(spark.read.parquet(path))
    for table in tables.values():
        table.write.format("noop").mode("overwrite").save()
    took = time.time() - began
    return took, tables["modules"].agg(F.sum("line_count")).first()[0]


def main() -> None:
    from pyspark.sql import SparkSession

    from codecorpus import registry

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.local.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    registry.QUERIES["a2_parse_status_counts"](spark, sf_dir).collect()  # the session's start isn't counted
    took: dict[str, float] = {}
    for name in HEADLINE:
        began = time.time()
        registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    seconds, lines = whole(spark, sf_dir)
    rewritten = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()  # one line of code for each row
    headline = {n: took[n] for n in HEADLINE}
    print(json.dumps({"metric": "headline queries", "value": round(sum(headline.values()), 3), "unit": "sec", "queries": headline, "sf": Path(sf_dir).name, "whole_analysis_sec": round(seconds, 3), "whole_analysis_lines": lines, "lines_per_second_whole": round(lines / seconds), "lines_per_second_rewrite": round(rewritten / took["r13_r14_rewrite"])}))


if __name__ == "__main__":
    main()
