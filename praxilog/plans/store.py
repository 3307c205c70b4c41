"""Immutable dataset versions: imports, manifests, lineage, exports.

Data are Parquet that Spark writes under a folder all executors share; the catalog is a
small SQLite file that the driver alone writes. A version is published by one transaction
that fails if another import of the workspace came first.
"""

from __future__ import annotations

import hashlib
import json
import shutil
import sqlite3
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import csv_guarded
from ..operators import ingest
from ..schema import ATTEMPTS, no_attempts, read_attempts
from ..sources.readers import CSV_ENCODING, read_records
from . import identities, lineage

TABLES = """
CREATE TABLE IF NOT EXISTS workspace (id TEXT PRIMARY KEY, name TEXT, kind TEXT, head TEXT);
CREATE TABLE IF NOT EXISTS dataset (id TEXT PRIMARY KEY, workspace TEXT, parent TEXT, manifest TEXT);
CREATE TABLE IF NOT EXISTS import (key TEXT PRIMARY KEY, workspace TEXT, dataset TEXT, report TEXT);
CREATE TABLE IF NOT EXISTS lineage (child TEXT, parent TEXT, PRIMARY KEY (child, parent));
"""
REACH = "WITH RECURSIVE r(id) AS (SELECT {to} FROM lineage WHERE {of} = ? UNION SELECT {to} FROM lineage JOIN r ON {of} = r.id) SELECT id FROM r ORDER BY id"


def digest(value: object) -> str:
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def file_hash(path: Path) -> str:
    with path.open("rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


class Store:
    def __init__(self, root: str | Path) -> None:
        self.root = Path(root)
        self.root.mkdir(parents=True, exist_ok=True)
        with self.transaction() as c:
            for statement in filter(str.strip, TABLES.split(";")):
                c.execute(statement)

    @contextmanager
    def transaction(self) -> Iterator[sqlite3.Connection]:
        c = sqlite3.connect(self.root / "catalog.sqlite", isolation_level=None, timeout=30)
        c.row_factory = sqlite3.Row
        try:
            c.execute("BEGIN IMMEDIATE")
            yield c
            c.execute("COMMIT")
        except BaseException:
            if c.in_transaction:
                c.execute("ROLLBACK")
            raise
        finally:
            c.close()

    def create_workspace(self, name: str, kind: str = "user") -> str:
        if kind not in ("user", "synthetic", "research"):
            raise ValueError("a workspace is user, synthetic or research")
        own = uuid.uuid4().hex
        with self.transaction() as c:
            c.execute("INSERT INTO workspace VALUES (?, ?, ?, NULL)", (own, name, kind))
        return own

    def _one(self, query: str, *values: str) -> sqlite3.Row:
        with self.transaction() as c:
            row = c.execute(query, values).fetchone()
        if row is None:
            raise KeyError(values)
        return row

    def manifest(self, dataset: str) -> dict:
        return json.loads(self._one("SELECT manifest FROM dataset WHERE id = ?", dataset)["manifest"])

    def datasets(self, workspace: str) -> list[str]:
        with self.transaction() as c:
            return [r["id"] for r in c.execute("SELECT id FROM dataset WHERE workspace = ? ORDER BY rowid", (workspace,))]

    def attempts(self, spark: SparkSession, dataset: str | None) -> DataFrame:
        """All attempts of a version: its own partition and those it inherits."""
        return read_attempts(spark, [str(self.root / p["path"]) for p in self.manifest(dataset)["partitions"]]) if dataset else no_attempts(spark)

    def known(self, spark: SparkSession, dataset: str, wanted: DataFrame) -> DataFrame:
        """Identities and content of a version's attempts that are among ``wanted``, by the indexes of its partitions."""
        folders = [str((self.root / p["path"]).parent / "index") for p in self.manifest(dataset)["partitions"]]
        return identities.lookup(spark, folders, wanted)

    def preview(self, spark: SparkSession, path: str, format: str, limit: int = 100, namespace: str = "local", learner: str = "local-learner") -> DataFrame:
        """The first records as they would be judged, without a store."""
        if not 1 <= limit <= 1000:
            raise ValueError("limit must be 1 to 1000")
        rows = read_records(spark, path, format).orderBy("row").limit(limit)
        return ingest.classified(ingest.validated(rows, namespace, learner)).orderBy("row")

    def validate_file(self, spark: SparkSession, path: str, format: str, namespace: str = "local", learner: str = "local-learner") -> dict:
        rows = ingest.classified(ingest.validated(read_records(spark, path, format), namespace, learner))
        counts = ingest.import_counts(rows).first().asDict()
        return counts | {"valid": counts["rejected"] == counts["conflicts"] == 0}

    def import_file(self, spark: SparkSession, workspace: str, path: str, format: str, namespace: str = "local", learner: str = "local-learner") -> dict:
        """Imports a file as a new version and returns its report; the same file and options again return the earlier one."""
        source = file_hash(Path(path))
        key = digest([workspace, source, format, namespace, learner])
        with self.transaction() as c:
            if row := c.execute("SELECT report FROM import WHERE key = ?", (key,)).fetchone():
                return json.loads(row["report"])
            parent = c.execute("SELECT head FROM workspace WHERE id = ?", (workspace,)).fetchone()["head"]
        stage = self.root / "staging" / uuid.uuid4().hex
        stage.mkdir(parents=True)
        try:
            provenance = F.to_json(F.struct(F.lit(source).alias("source_hash"), F.lit(format).alias("adapter"), "row", F.col("quality").alias("identity_quality")))
            ingest.validated(read_records(spark, path, format), namespace, learner).write.parquet(str(stage / "read"))  # parsed once
            rows = spark.read.parquet(str(stage / "read"))
            known = self.known(spark, parent, rows) if parent else None
            rows = ingest.classified(rows, known).withColumn("provenance", provenance)
            rows.write.parquet(str(stage / "judged"))  # judged once, read for every part of the result
            rows = spark.read.parquet(str(stage / "judged"))
            counts = ingest.import_counts(rows).first().asDict()
            if counts["accepted"]:
                rows.where("outcome = 'accepted'").select(*[f.name for f in ATTEMPTS]).sortWithinPartitions("learner_id").write.option("compression", "zstd").parquet(str(stage / "attempts"))
                identities.write(rows.where("outcome = 'accepted'"), str(stage / "index"))
            ingest.quarantine(rows).write.json(str(stage / "quarantine"))
            samples = [r.asDict() for r in ingest.quarantine(rows).orderBy("row").limit(ingest.SAMPLES).collect()]
            shutil.copyfile(path, stage / "original")
            shutil.rmtree(stage / "judged")
            shutil.rmtree(stage / "read")
            inherited = self.manifest(parent)["partitions"] if parent else []
            own = {"parent": parent, "key": key, "source": {"sha256": source, "format": format}, "counts": counts}
            dataset = digest(own) if counts["accepted"] or parent is None else parent
            place = self.root / "datasets" / (dataset if dataset != parent else f"empty-{key}")
            parts = [{"path": f"datasets/{dataset}/attempts", "files": {p.name: file_hash(p) for p in sorted((stage / "attempts").glob("*.parquet"))}}] if counts["accepted"] else []
            manifest = own | {"partitions": [*inherited, *parts]}
            (stage / "manifest.json").write_text(json.dumps(manifest, sort_keys=True))
            place.parent.mkdir(exist_ok=True)
            stage.rename(place)
            self._recheck(spark, [p for p in parts if p["path"] == f"datasets/{dataset}/attempts"], counts["accepted"])
            report = counts | {"dataset": dataset, "samples": samples}
            with self.transaction() as c:
                if c.execute("UPDATE workspace SET head = ? WHERE id = ? AND head IS ?", (dataset, workspace, parent)).rowcount != 1:
                    raise RuntimeError("another import came first")
                c.execute("INSERT OR IGNORE INTO dataset VALUES (?, ?, ?, ?)", (dataset, workspace, parent, json.dumps(manifest, sort_keys=True)))
                c.execute("INSERT INTO import VALUES (?, ?, ?, ?)", (key, workspace, dataset, json.dumps(report, default=str)))
                if parent and dataset != parent:
                    c.execute("INSERT OR IGNORE INTO lineage VALUES (?, ?)", (dataset, parent))
            return json.loads(json.dumps(report, default=str))
        except BaseException:
            shutil.rmtree(stage, ignore_errors=True)
            raise

    def _recheck(self, spark: SparkSession, parts: list[dict], accepted: int) -> None:
        """Raises unless the new partition's files are there as hashed and hold as many attempts as were accepted."""
        for part in parts:
            place = self.root / part["path"]
            rows = spark.createDataFrame([(n, str(place / n), h) for n, h in part["files"].items()], "id string, path string, checksum string")
            if lineage.file_checksums(rows).where("found is null or found <> checksum").limit(1).count():
                raise RuntimeError("files changed before the commit")
            if (held := read_attempts(spark, [str(place)]).count()) != accepted:
                raise RuntimeError(f"{held} attempts were written of {accepted}")

    def verify(self, dataset: str) -> list[str]:
        """Files of a version, its ancestors included, that are missing or changed."""
        return [f"{p['path']}/{n}" for p in self.manifest(dataset)["partitions"] for n, h in p["files"].items() if not (f := self.root / p["path"] / n).is_file() or file_hash(f) != h]

    def graph(self, spark: SparkSession, dataset: str) -> tuple[DataFrame, DataFrame]:
        """Nodes (``id``, ``path``, ``checksum``) and edges of all that a version rests on: its ancestors, and of each its
        original, its manifest and the files of its own partition. A row a file, from the manifests."""
        nodes, edges, seen, ahead = [], [], {dataset}, [dataset]
        while ahead:
            own = ahead.pop()
            try:
                manifest = self.manifest(own)
            except KeyError:  # a node of lineage that is no dataset has no files
                manifest = None
            with self.transaction() as c:
                above = {r["parent"] for r in c.execute("SELECT parent FROM lineage WHERE child = ?", (own,))}
            if manifest:
                above |= {manifest["parent"]} - {None}
                place = f"datasets/{own}"
                files = {f"{place}/original": manifest["source"]["sha256"], f"{place}/manifest.json": hashlib.sha256(json.dumps(manifest, sort_keys=True).encode()).hexdigest()}
                files |= {f"{p['path']}/{n}": h for p in manifest["partitions"] if p["path"] == f"{place}/attempts" for n, h in p["files"].items()}
                nodes += [(n, str(self.root / n), h) for n, h in files.items()]
                edges += [(own, n) for n in files]
            nodes.append((own, None, None))
            edges += [(own, p) for p in above]
            ahead += above - seen
            seen |= above
        return spark.createDataFrame(nodes, "id string, path string, checksum string"), spark.createDataFrame(edges, "child string, parent string")

    def audit(self, spark: SparkSession, dataset: str) -> DataFrame:
        """What of a version's ancestry is missing, changed, in a cycle, or rests on such (:func:`lineage.unsound`); files are hashed in tasks."""
        nodes, edges = self.graph(spark, dataset)
        return lineage.unsound(lineage.file_checksums(nodes), edges)

    def add_lineage(self, child: str, parents: list[str]) -> None:
        with self.transaction() as c:
            for p in parents:
                if p == child or any(r["id"] == child for r in c.execute(REACH.format(to="parent", of="child"), (p,))):
                    raise ValueError("lineage would form a cycle")
                c.execute("INSERT OR IGNORE INTO lineage VALUES (?, ?)", (child, p))

    def ancestors(self, node: str) -> list[str]:
        with self.transaction() as c:
            return [r["id"] for r in c.execute(REACH.format(to="parent", of="child"), (node,))]

    def descendants(self, node: str) -> list[str]:
        with self.transaction() as c:
            return [r["id"] for r in c.execute(REACH.format(to="child", of="parent"), (node,))]

    def reconcile(self) -> list[str]:
        """Removes what unfinished imports have left; returns the folders."""
        with self.transaction() as c:
            known = {r["id"] for r in c.execute("SELECT id FROM dataset")} | {f"empty-{r['key']}" for r in c.execute("SELECT key FROM import")}
            left = [*(self.root / "staging").glob("*"), *(p for p in (self.root / "datasets").glob("*") if p.name not in known)]
            for p in left:
                shutil.rmtree(p, ignore_errors=True)
        return [p.name for p in left]


def export(attempts: DataFrame, path: str, format: str, learner: str | None = None) -> None:
    """Writes attempts in order as json (lines), csv or parquet files. CSV cells that look like formulas are guarded and marked."""
    rows = attempts.where(F.col("learner_id") == learner) if learner else attempts
    rows = rows.drop("identity", "content_hash", "provenance").orderBy("source_namespace", "learner_id", "source_sequence", "event_id")
    stamp = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    if format == "parquet":
        rows.write.parquet(path)
    elif format in ("json", "ndjson"):
        rows.withColumn("timestamp", stamp).write.option("ignoreNullFields", "false").json(path)
    elif format == "csv":
        text = {n: csv_guarded(F.col(n)) for n, t in rows.dtypes if t == "string"}
        rows = rows.withColumns(text | {"skills": F.to_json("skills"), "timestamp": stamp, "csv_encoding": F.lit(CSV_ENCODING)})
        rows.write.option("header", True).option("escape", '"').csv(path)
    else:
        raise ValueError(f"unknown format {format}")
