"""The registered streams over tables that are folders of files."""

import os

import pytest

from veilspark.plans import queries

TEXTS = [(1, "mail ann@b.org"), (2, "none"), (3, None), (4, "ip 10.0.0.1"), (5, "")]
MASKED = {(1, "mail [REDACTED_EMAIL]"), (2, "none"), (3, None), (4, "ip [REDACTED_IP]"), (5, "")}


def table(spark, root, name, rows, schema, folder):
    """A table as a folder of several files, or as one file."""
    df = spark.createDataFrame(rows, schema)
    if folder:
        return df.repartition(3).write.parquet(f"{root}/{name}.parquet")
    df.coalesce(1).write.parquet(f"{root}/_{name}")
    (part,) = [f for f in os.listdir(f"{root}/_{name}") if f.endswith(".parquet")]
    os.rename(f"{root}/_{name}/{part}", f"{root}/{name}.parquet")


@pytest.mark.parametrize("folder", [True, False])
def test_streams_read_whole_tables(spark, tmp_path, folder):
    root = str(tmp_path)
    table(spark, root, "documents", TEXTS, "doc_id long, text string", folder)
    table(spark, root, "customer", [(k, k % 2) for k in range(20)], "c_custkey long, c_nationkey int", folder)
    assert {tuple(r) for r in queries.mask_stream_documents(spark, root).collect()} == MASKED
    assert {r["doc_id"] for r in queries.alert_stream_documents(spark, root).collect()} == {1, 4}
    flushed = {tuple(r) for r in queries.flush_mappings_messages(spark, root).collect()}
    batch = {tuple(r) for r in queries.latest_mappings_spans_messages(spark, root).collect()}
    assert flushed == batch and batch


def test_stream_without_a_hit(spark, tmp_path):
    table(spark, str(tmp_path), "documents", [(1, "none"), (2, None)], "doc_id long, text string", True)
    assert queries.alert_stream_documents(spark, str(tmp_path)).collect() == []
