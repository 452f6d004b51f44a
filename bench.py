"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the data (default /root/testdata/sf0.1), BENCH_CPUS the local cores.
The tables are first copied into several files each, which is not timed: the given ones have
one row group, so that one task would read and mask a whole table, whatever the cores.  One
query is also timed on the given files (``given_files``).  Each query is planned, then run in
full to a sink that drops the rows; building and planning it is also stated apart (``planning``).
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from veilspark.plans.queries import registry  # noqa: E402
from veilspark.session import build_session  # noqa: E402

HEADLINES = (
    "flag_pii_documents",
    "only_pii_documents",
    "count_pii_documents",
    "detect_regex_documents",
    "detect_regex_messages",
    "detect_regex_page_text",
    "resolve_overlaps_documents",
    "mask_cascade_documents",
    "mask_changed_documents",
    "mask_spans_documents",
    "mask_spans_messages",
    "mask_columns_pages",
    "preview_documents",
    "preview_conversations",
    "apply_settings_messages",
    "resolve_decisions_messages",
    "chunk_text_documents",
    "tag_tokens_documents",
    "detect_ml_documents",
    "detect_hybrid_documents",
    "mask_hybrid_documents",
    "latest_mappings_spans_messages",
)


TABLES = ("documents", "pages", "conversations", "customer", "nation")
FILES_PER_CPU = 2


def copy_tables(spark, root: str, target: str, files: int) -> None:
    for name in TABLES:
        table = spark.read.parquet(f"{root}/{name}.parquet")
        table.repartition(files).write.parquet(f"{target}/{name}.parquet")


def run(query, spark, root: str) -> tuple[float, float]:
    """Seconds until the plan is there, and in all."""
    begin = time.perf_counter()
    df = query(spark, root)
    df._jdf.queryExecution().executedPlan()
    planned = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return round(planned - begin, 3), round(time.perf_counter() - begin, 3)


def main() -> None:
    root = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = build_session(
        "bench",
        **{
            "spark.master": f"local[{cpus}]",
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    # starts the JVM's and Python's workers, so that the first query does not pay for them
    spark.range(1000).groupBy().count().collect()
    spark.read.parquet(f"{root}/documents.parquet").count()

    queries = registry()
    seconds, planning = {}, {}
    with tempfile.TemporaryDirectory(prefix="bench-") as copies:
        copy_tables(spark, root, copies, FILES_PER_CPU * int(cpus))
        for name in HEADLINES:
            planning[name], seconds[name] = run(queries[name], spark, copies)
    given = run(queries["mask_spans_documents"], spark, root)[1]

    documents = spark.read.parquet(f"{root}/documents.parquet")
    n = documents.count()
    characters = documents.selectExpr("sum(length(text))").first()[0]
    print(
        json.dumps({
            "metric": "total_seconds",
            "value": round(sum(seconds.values()), 3),
            "unit": "sec",
            "queries": seconds,
            "sf": os.path.basename(root.rstrip("/")).removeprefix("sf"),
            "cpus": int(cpus),
            "documents": n,
            "characters": characters,
            "files_per_table": FILES_PER_CPU * int(cpus),
            "given_files": {"mask_spans_documents": given},
            "planning": planning,
            "characters_per_second_and_core": {
                name: round(characters / (seconds[name] - planning[name]) / int(cpus))
                for name in ("mask_spans_documents", "mask_hybrid_documents")
            },
            "ms_per_document": {
                name: round(1000 * seconds[name] / n, 4)
                for name in ("mask_spans_documents", "mask_hybrid_documents")
            },
        })
    )
    spark.stop()


if __name__ == "__main__":
    main()
