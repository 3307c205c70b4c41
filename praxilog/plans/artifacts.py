"""Artifacts: tables kept together under the digest of what they hold, on any file system that Spark writes to.

An artifact is written to a staging folder, its files are hashed in tasks, and one rename
publishes it; what an unfinished one leaves is in ``staging`` alone. Files are hashed whole,
so ``rows_a_file`` keeps them far below the 2 GB that a row may hold.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS_A_FILE = 2_000_000


def digest(value: Any) -> str:
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def _files(spark: SparkSession, folder: str) -> DataFrame:
    """``name`` (below the folder) and ``sha256`` of each file."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(folder)
    return rows.select(F.regexp_extract("path", r"([^/]+/[^/]+)$", 1).alias("name"), F.sha2("content", 256).alias("sha256"))


def _disk(spark: SparkSession, path: str) -> tuple[Any, Callable[[str], Any]]:
    of = spark._jvm.org.apache.hadoop.fs.Path
    return of(path).getFileSystem(spark._jsc.hadoopConfiguration()), of


def publish(spark: SparkSession, root: str, kind: str, tables: Mapping[str, DataFrame], metadata: Mapping[str, Any] | None = None, rows_a_file: int = ROWS_A_FILE) -> str:
    """Keeps ``tables`` by name and returns the artifact's id; the same content twice is one artifact.

    The manifest holds a row a file, so it grows with the number of files and not of rows.
    """
    disk, path = _disk(spark, root)
    stage = f"{root}/staging/{uuid.uuid4().hex}"
    try:
        for name, rows in tables.items():
            rows.write.option("maxRecordsPerFile", rows_a_file).parquet(f"{stage}/{name}")
        # names of files are drawn anew by each write, so contents alone, in order, tell artifacts apart
        found = sorted((r["name"].split("/")[0], r["sha256"], r["name"]) for r in _files(spark, stage).collect())
        own = digest({"kind": kind, "metadata": dict(metadata or {}), "tables": sorted(tables), "files": [f[:2] for f in found]})
        manifest = {"id": own, "kind": kind, "metadata": dict(metadata or {}), "tables": sorted(tables), "files": {f[2]: f[1] for f in found}}
        out = disk.create(path(f"{stage}/manifest.json"))
        out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        out.close()
        disk.mkdirs(path(f"{root}/artifacts"))
        if not disk.exists(path(f"{root}/artifacts/{own}")):
            disk.rename(path(stage), path(f"{root}/artifacts/{own}"))
    finally:
        disk.delete(path(stage), True)
    return own


def manifest(spark: SparkSession, root: str, artifact: str) -> dict:
    row = spark.read.text(f"{root}/artifacts/{artifact}/manifest.json", wholetext=True).first()
    return json.loads(row[0])


def load(spark: SparkSession, root: str, artifact: str, table: str) -> DataFrame:
    """A table of an artifact; names that its manifest lacks are refused, so that none leads out of its folder."""
    if table not in manifest(spark, root, artifact)["tables"]:
        raise KeyError(table)
    return spark.read.parquet(f"{root}/artifacts/{artifact}/{table}")


def verify(spark: SparkSession, root: str, artifact: str) -> list[str]:
    """What is wrong: ``manifest`` if it isn't that of the id, and files that are missing, changed or not in it."""
    own = manifest(spark, root, artifact)
    files = sorted((n.split("/")[0], h) for n, h in own["files"].items())
    sound = own["id"] == artifact == digest({"kind": own["kind"], "metadata": own["metadata"], "tables": own["tables"], "files": [list(f) for f in files]})
    now = {r["name"]: r["sha256"] for r in _files(spark, f"{root}/artifacts/{artifact}").collect()}
    wrong = sorted(n for n in now.keys() | own["files"].keys() if now.get(n) != own["files"].get(n))
    return [*([] if sound else ["manifest"]), *wrong]


def cached(spark: SparkSession, root: str, dataset: str, version: str, parameters: Mapping[str, Any], make: Callable[[], Mapping[str, DataFrame]]) -> str:
    """The artifact of a query over a dataset, made once for each dataset, version of the code and parameters; raises if it has changed since."""
    key = digest({"dataset": dataset, "version": version, "parameters": dict(parameters)})
    disk, path = _disk(spark, root)
    place = f"{root}/queries/{key}"
    if disk.exists(path(f"{place}/_SUCCESS")):
        own = spark.read.text(place).first()[0]
        if wrong := verify(spark, root, own):
            raise ValueError(f"a kept artifact has changed: {wrong[:5]}")
        return own
    own = publish(spark, root, "query", make(), {"key": key, "parameters": dict(parameters), "version": version, "dataset": dataset})
    spark.createDataFrame([(own,)], "id string").coalesce(1).write.mode("overwrite").text(place)
    return own
