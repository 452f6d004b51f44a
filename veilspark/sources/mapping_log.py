"""A mapping store with a commit log: several writers at once, readers that probe nothing.

``FOLDER/_log/VERSION.json`` is the manifest of a version: the data folders that count, oldest
first, and of every run the batches that a rewrite has taken in.  A writer puts its data into a
folder of its own, then makes the next manifest from the latest one; a manifest is only made if
there is none of that version, and who comes second starts again from the winner's.  So a
version is whole or not there, data of a writer that died is never seen, and no writer loses
what another has committed.  Reading takes one manifest, whatever the number of batches, and an
earlier version as well, as long as its folders are there.

Writing a batch of a run again replaces it in its place; if a rewrite has taken it in, it is
there already and nothing happens.  The values are the very data that masking hides: keep the
folder as safe as the originals.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import MAPPING

EMPTY = {"version": 0, "folders": [], "taken": {}}


def _hadoop(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def _name(version: int) -> str:
    return f"{version:019d}.json"


def versions(spark: SparkSession, path: str) -> list[int]:
    """Committed versions, oldest first."""
    log, fs = _hadoop(spark, f"{path}/_log")
    names = [s.getPath().getName() for s in fs.listStatus(log)] if fs.exists(log) else []
    return sorted(int(n[: -len(".json")]) for n in names if n.endswith(".json") and not n.startswith("."))


def manifest(spark: SparkSession, path: str, version: int | None = None) -> dict:
    """The manifest of a version, the latest one by default; empty before the first."""
    if version is None:
        known = versions(spark, path)
        if not known:
            return dict(EMPTY)
        version = known[-1]
    file, fs = _hadoop(spark, f"{path}/_log/{_name(version)}")
    stream = fs.open(file)
    try:
        return json.loads(bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
    finally:
        stream.close()


def _create(spark: SparkSession, path: str, content: dict) -> bool:
    """Make the manifest unless there is one of its version; false if there is."""
    log = f"{path}/_log"
    draft, fs = _hadoop(spark, f"{log}/.{uuid.uuid4().hex}")
    target = _hadoop(spark, f"{log}/{_name(content['version'])}")[0]
    out = fs.create(draft)
    out.write(bytearray(json.dumps(content).encode()))
    out.close()
    java = spark._jvm
    options = spark.sparkContext._gateway.new_array(java.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = java.org.apache.hadoop.fs.Options.Rename.NONE
    context = java.org.apache.hadoop.fs.FileContext.getFileContext(
        fs.makeQualified(draft).toUri(), spark._jsc.hadoopConfiguration()
    )
    try:
        context.rename(fs.makeQualified(draft), fs.makeQualified(target), options)
        return True
    except Py4JJavaError as error:
        fs.delete(draft, False)
        if "FileAlreadyExistsException" in error.java_exception.getClass().getName():
            return False
        raise


def _commit(spark: SparkSession, path: str, change: Callable[[dict], dict | None]) -> int:
    """Apply ``change`` to the latest manifest until it is the next one; its version."""
    while True:
        latest = manifest(spark, path)
        after = change(latest)
        if after is None:
            return latest["version"]
        after = {**after, "version": latest["version"] + 1}
        if _create(spark, path, after):
            return after["version"]


def _write(mappings: DataFrame, path: str) -> str:
    folder = f"data-{uuid.uuid4().hex}"
    mappings.select("scope", "mask", "value").write.parquet(f"{path}/{folder}")
    return folder


def log_batch(mappings: DataFrame, path: str, batch: int, run: str = "batches") -> int:
    """Commit one batch of a run, later than all there is; the version it is in."""
    spark = mappings.sparkSession
    if batch <= manifest(spark, path)["taken"].get(run, -1):
        return manifest(spark, path)["version"]
    entry = {"folder": _write(mappings, path), "run": run, "batch": batch}

    def change(latest: dict) -> dict | None:
        if batch <= latest["taken"].get(run, -1):
            return None
        folders = list(latest["folders"])
        place = [i for i, f in enumerate(folders) if (f["run"], f["batch"]) == (run, batch)]
        if place:
            folders[place[0]] = entry
        else:
            folders.append(entry)
        return {**latest, "folders": folders}

    return _commit(spark, path, change)


def log_whole(mappings: DataFrame, path: str) -> int:
    """Commit ``mappings`` as the whole content; later batches count from there."""
    entry = {"folder": _write(mappings, path), "run": None, "batch": None}
    return _commit(mappings.sparkSession, path, lambda latest: {**latest, "folders": [entry], "taken": {}})


def load_logged(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """Content of the store at a version, the latest by default; empty if there is none."""
    return _content(spark, path, manifest(spark, path, version))


def _content(spark: SparkSession, path: str, known: dict) -> DataFrame:
    folders = [f["folder"] for f in known["folders"]]
    if not folders:
        return spark.createDataFrame([], MAPPING)
    rows = spark.read.schema(MAPPING).parquet(*[f"{path}/{f}" for f in folders])
    if len(folders) == 1:
        return rows.select("scope", "mask", "value")
    folder = F.regexp_extract("_metadata.file_path", "/(data-[0-9a-f]+)/[^/]*$", 1)
    place = F.array_position(F.lit(folders), folder)
    return rows.select(*rows.columns, place.alias("_place")).groupBy("scope", "mask").agg(
        F.max_by("value", "_place").alias("value")
    )


def compact_logged(spark: SparkSession, path: str) -> int:
    """Rewrite the batches there are as one; others may be committing meanwhile."""
    before = manifest(spark, path)
    if len(before["folders"]) < 2:
        return before["version"]
    old = {f["folder"] for f in before["folders"]}
    entry = {"folder": _write(_content(spark, path, before), path), "run": None, "batch": None}
    taken = dict(before["taken"])
    for f in before["folders"]:
        if f["run"] is not None:
            taken[f["run"]] = max(taken.get(f["run"], -1), f["batch"])

    def change(latest: dict) -> dict | None:
        here = {f["folder"] for f in latest["folders"]}
        if not old <= here:  # a batch was replaced or all content was: what was read is out of date
            return None
        added = [f for f in latest["folders"] if f["folder"] not in old]
        return {**latest, "folders": [entry, *added], "taken": taken}

    return _commit(spark, path, change)


def vacuum_logged(spark: SparkSession, path: str, keep: int = 1) -> list[str]:
    """Delete data folders that none of the last ``keep`` versions names, and older manifests.

    Not while a writer is at work: what it has written and not committed yet would go.
    """
    known = versions(spark, path)
    kept = known[-keep:]
    used = {f["folder"] for v in kept for f in manifest(spark, path, v)["folders"]}
    root, fs = _hadoop(spark, path)
    there = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
    gone = sorted(n for n in there if n.startswith("data-") and n not in used)
    for folder in gone:
        fs.delete(_hadoop(spark, f"{path}/{folder}")[0], True)
    for version in known[:-keep]:
        fs.delete(_hadoop(spark, f"{path}/_log/{_name(version)}")[0], False)
    return gone
