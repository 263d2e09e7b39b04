"""Bundles in SQLite: single files with a driver-side writer, folders of shards that tasks write, and a data source for both.

A single file is one small artifact, so its writer streams rows through one connection.
Large tables go to a folder instead: ``df.write.format("sqlite_bundle")`` makes a file in
each task and names them all in one list when the job commits.  The source reads a file by
ranges of rows and a folder by shards, and pushes equality and upper-bound filters into
SQLite's WHERE.
"""

from __future__ import annotations

import hashlib
import json
import os
import sqlite3
import uuid
from collections.abc import Iterator
from contextlib import closing
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, InputPartition, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

from planewise.conventions import SQLITE_VERSION
from planewise.shipping import ship

# Tables of the format and their columns.
TABLES = {
    "manifest": "key TEXT PRIMARY KEY, value TEXT NOT NULL",
    "objects": "object_id TEXT PRIMARY KEY, pos INTEGER NOT NULL, true_label TEXT, pred_label TEXT, entropy REAL, color TEXT, json_meta TEXT, payload BLOB",
    "representation_blobs": "rep_id TEXT PRIMARY KEY, n_objects INTEGER NOT NULL, n_features INTEGER NOT NULL, dtype TEXT NOT NULL, data BLOB NOT NULL, sha256 TEXT NOT NULL",
    "knn_edges": "rep_id TEXT NOT NULL, metric_id TEXT NOT NULL, src_id TEXT NOT NULL, neighbor_id TEXT NOT NULL, rank INTEGER NOT NULL, distance REAL NOT NULL, PRIMARY KEY (rep_id, metric_id, src_id, rank)",
    "catalog_views": "view_id TEXT NOT NULL, rep_id TEXT NOT NULL, display_name TEXT, basis_data BLOB NOT NULL, p_dim INTEGER NOT NULL, semantically_valid INTEGER NOT NULL, is_misleading INTEGER NOT NULL, description TEXT, warning_note TEXT, PRIMARY KEY (view_id, rep_id)",
    "view_coords": "view_id TEXT NOT NULL, rep_id TEXT NOT NULL, object_id TEXT NOT NULL, x REAL NOT NULL, y REAL NOT NULL, PRIMARY KEY (view_id, rep_id, object_id)",
}
# Folders hold vectors by row, since a blob of a whole matrix can't be written in parts.
ROWS = {"representation_rows": "rep_id TEXT NOT NULL, object_id TEXT NOT NULL, pos INTEGER NOT NULL, data BLOB NOT NULL, PRIMARY KEY (rep_id, object_id)"}
RANGE_ROWS = 100_000
_SPARK = {"TEXT": "string", "INTEGER": "long", "REAL": "double", "BLOB": "binary"}


def _columns(table: str) -> list[tuple[str, str]]:
    return [(n, k) for n, k, *_ in (c.split() for c in (TABLES | ROWS)[table].split(", PRIMARY")[0].split(", "))]


class SQLiteBundleWriter:
    """Writes a bundle file, replacing one that is there."""

    def __init__(self, path: str, bundle_id: str, description: str = "") -> None:
        for end in ("", "-wal", "-shm", "-journal"):
            if os.path.exists(path + end):
                os.remove(path + end)
        self.db = sqlite3.connect(path)
        self.db.execute("PRAGMA journal_mode=WAL")
        self.db.execute("PRAGMA synchronous=NORMAL")
        for name, columns in TABLES.items():
            self.db.execute(f"CREATE TABLE {name} ({columns}) STRICT")
        self._manifest = {"bundle_id": bundle_id, "description": description, "schema_version": SQLITE_VERSION}

    def _rows(self, table: str, rows: Iterator[tuple]) -> None:
        marks = ", ".join("?" * len(_columns(table)))
        self.db.executemany(f"INSERT INTO {table} VALUES ({marks})", rows)

    def set_objects(self, objects: DataFrame) -> SQLiteBundleWriter:
        """Known columns by name; others as JSON; nulls stay null."""
        known = [n for n, _ in _columns("objects")]
        rest = [c for c in objects.columns if c not in known and not isinstance(objects.schema[c].dataType, type(StructType.fromDDL("b binary")["b"].dataType))]
        meta = F.to_json(F.struct(*rest)) if rest else F.lit(None).cast("string")
        columns = {n: F.col(n) if n in objects.columns else F.lit(None) for n in known} | {"json_meta": meta}
        rows = objects.select(*(columns[n].alias(n) for n in known)).orderBy("pos").toLocalIterator()
        self._rows("objects", (tuple(bytes(v) if isinstance(v, bytearray) else v for v in r) for r in rows))
        return self

    def add_representation(self, rep_id: str, points: DataFrame) -> SQLiteBundleWriter:
        """``points`` (object_id, pos, vec) as one float64 matrix in the order of ``pos``."""
        matrix = np.array([r["vec"] for r in points.orderBy("pos").select("vec").toLocalIterator()], np.float64)
        n, k = matrix.shape if matrix.ndim == 2 else (0, 0)
        data = matrix.tobytes()
        self._rows("representation_blobs", iter([(rep_id, n, k, "float64", data, hashlib.sha256(data).hexdigest())]))
        return self

    def add_knn_graph(self, rep_id: str, metric_id: str, edges: DataFrame) -> SQLiteBundleWriter:
        self._rows("knn_edges", ((rep_id, metric_id, r["src_id"], r["neighbor_id"], r["rank"], r["distance"]) for r in edges.toLocalIterator()))
        return self

    def add_catalog_view(self, view_id: str, rep_id: str, basis: np.ndarray, display_name: str = "", valid: bool = True, misleading: bool = False, description: str = "", warning: str | None = None) -> SQLiteBundleWriter:
        self._rows("catalog_views", iter([(view_id, rep_id, display_name, np.ascontiguousarray(basis, np.float64).tobytes(), basis.shape[0], int(valid), int(misleading), description, warning)]))
        return self

    def add_view_coords(self, view_id: str, rep_id: str, coords: DataFrame) -> SQLiteBundleWriter:
        self._rows("view_coords", ((view_id, rep_id, r["object_id"], r["x"], r["y"]) for r in coords.toLocalIterator()))
        return self

    def finalize(self) -> None:
        self._rows("manifest", ((k, json.dumps(v)) for k, v in self._manifest.items()))
        self.db.commit()
        self.db.execute("PRAGMA journal_mode=DELETE")
        self.db.close()


class _Reader(DataSourceReader):
    def __init__(self, path: str, table: str, range_rows: int = RANGE_ROWS) -> None:
        self.path, self.table, self.range_rows = path, table, range_rows
        self.where: list[tuple[str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802  (the API's name)
        known = {n for n, _ in _columns(self.table)}
        for f in filters:
            if isinstance(f, (EqualTo, LessThanOrEqual)) and len(f.attribute) == 1 and f.attribute[0] in known and isinstance(f.value, (str, int, float)):
                self.where.append((f"{f.attribute[0]} {'=' if isinstance(f, EqualTo) else '<='} ?", f.value))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        """Ranges of row numbers of each file; their ends are looked up in the files' indexes."""
        found = []
        for path in [os.path.join(self.path, f["file"]) for f in committed(self.path, self.table)] if os.path.isdir(self.path) else [self.path]:
            with closing(sqlite3.connect(f"file:{path}?mode=ro", uri=True)) as db:
                first, last = db.execute(f"SELECT min(rowid), max(rowid) FROM {self.table}").fetchone()
            if first is not None:
                found += [_Range(path, n, min(n + self.range_rows - 1, last)) for n in range(first, last + 1, self.range_rows)]
        return found or [_Range("", 0, 0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if not partition.path:
            return
        names = ", ".join(n for n, _ in _columns(self.table))
        test = " AND ".join(["rowid BETWEEN ? AND ?", *(w for w, _ in self.where)])
        with closing(sqlite3.connect(f"file:{partition.path}?mode=ro", uri=True)) as db:
            yield from db.execute(f"SELECT {names} FROM {self.table} WHERE {test}", [partition.first, partition.last, *(v for _, v in self.where)])


@dataclass
class _Range(InputPartition):
    path: str
    first: int
    last: int


@dataclass
class _Written(WriterCommitMessage):
    file: str
    n: int
    sha256: str


def _sha256(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def committed(path: str, table: str) -> list[dict]:
    """The shards (file, n, sha256) of a table in a folder; none where no job has committed."""
    try:
        with open(os.path.join(path, f"{table}.json")) as f:
            return json.load(f)
    except FileNotFoundError:
        return []


class _Writer(DataSourceWriter):
    """A shard for each task, under a name that no other attempt has; readers see those that the committed list names.

    Shards begin with a dot until the job commits; the list is replaced in one step, so a
    job that fails leaves the table as it was.  What lost executors or tasks that outlive
    their job leave behind is in no list; ``SQLiteBundleFolder.sweep`` takes it away.
    """

    def __init__(self, path: str, table: str, names: list[str], overwrite: bool) -> None:
        self.path, self.table, self.overwrite = path, table, overwrite
        wanted = [n for n, _ in _columns(table)]
        if sorted(names) != sorted(wanted):
            raise ValueError(f"{table} has the columns {wanted}, not {names}")
        self.places = [names.index(n) for n in wanted]

    def write(self, iterator: Iterator) -> _Written:
        os.makedirs(self.path, exist_ok=True)
        file = f"{self.table}-{uuid.uuid4().hex}.sqlite"
        made, n = os.path.join(self.path, "." + file), 0

        def rows() -> Iterator[tuple]:
            nonlocal n
            for row in iterator:
                n += 1
                yield tuple(bytes(v) if isinstance(v := row[p], bytearray) else v for p in self.places)

        try:
            with closing(sqlite3.connect(made)) as db:
                db.execute("PRAGMA synchronous=OFF")  # an attempt that is cut off is never listed
                db.execute(f"CREATE TABLE {self.table} ({(TABLES | ROWS)[self.table]}) STRICT")
                db.executemany(f"INSERT INTO {self.table} VALUES ({', '.join('?' * len(self.places))})", rows())
                db.commit()
            return _Written(file, n, _sha256(made))
        except BaseException:
            for end in ("", "-journal"):
                if os.path.exists(made + end):
                    os.remove(made + end)
            raise

    def _list(self, files: list[dict]) -> None:
        os.makedirs(self.path, exist_ok=True)
        new = os.path.join(self.path, f".{self.table}-{uuid.uuid4().hex}.json")
        with open(new, "w") as f:
            json.dump(files, f)
        os.replace(new, os.path.join(self.path, f"{self.table}.json"))

    def commit(self, messages: list[_Written | None]) -> None:
        before = committed(self.path, self.table)
        now = [{"file": m.file, "n": m.n, "sha256": m.sha256} for m in messages if m and m.n]
        for m in now:
            os.replace(os.path.join(self.path, "." + m["file"]), os.path.join(self.path, m["file"]))
        self._list([*([] if self.overwrite else before), *now])
        self._remove([m["file"] for m in before] if self.overwrite else [])
        self._remove(["." + m.file for m in messages if m and not m.n])

    def abort(self, messages: list[_Written | None]) -> None:
        self._remove(["." + m.file for m in messages if m])

    def _remove(self, files: list[str]) -> None:
        for f in files:
            if os.path.exists(os.path.join(self.path, f)):
                os.remove(os.path.join(self.path, f))


class SQLiteBundleSource(DataSource):
    """``spark.read.format("sqlite_bundle").option("table", ...).load(path)``, with ``range_rows`` rows a partition; ``df.write`` likewise into a folder."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_bundle"

    def _table(self) -> str:
        table = self.options.get("table", "objects")
        if table not in TABLES | ROWS:
            raise ValueError(f"no table {table!r} in a bundle")
        return table

    def schema(self) -> str:
        return ", ".join(f"{n} {_SPARK[k]}" for n, k in _columns(self._table()))

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"], self._table(), int(self.options.get("range_rows", RANGE_ROWS)))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], self._table(), schema.names, overwrite)


def register(spark: SparkSession) -> None:
    """Make the source known to a session, with filters pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    ship(spark)
    spark.dataSource.register(SQLiteBundleSource)


class SQLiteBundleFolder:
    """A bundle of any size: a folder, on storage that all executors mount, with shards of each table."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        register(spark)

    def write(self, table: str, rows: DataFrame, mode: str = "append") -> None:
        """``rows`` with the table's columns in any order; keys must be unique, which is checked within a shard only."""
        rows.write.format("sqlite_bundle").option("table", table).mode(mode).save(self.path)

    def add_representation(self, rep_id: str, points: DataFrame) -> None:
        """``points`` (object_id, pos, vec), each vector as its own float64 bytes."""
        self.write("representation_rows", points.select(F.lit(rep_id).alias("rep_id"), "object_id", "pos", _packed("vec").alias("data")))

    def table(self, name: str) -> DataFrame:
        return self.spark.read.format("sqlite_bundle").option("table", name).load(self.path)

    def points(self, rep_id: str) -> DataFrame:
        """(object_id, pos, vec) of a representation."""
        rows = self.table("representation_rows").where(F.col("rep_id") == rep_id)
        return rows.select("object_id", "pos", _unpacked("data").alias("vec"))

    def sweep(self) -> int:
        """Remove what failed jobs left; the number of files.  Only while no job writes to the folder."""
        held = {f["file"] for t in TABLES | ROWS for f in committed(self.path, t)} | {f"{t}.json" for t in TABLES | ROWS}
        left = [f for f in (os.listdir(self.path) if os.path.isdir(self.path) else []) if f not in held and f.lstrip(".").split("-")[0] in TABLES | ROWS]
        for f in left:
            os.remove(os.path.join(self.path, f))
        return len(left)

    def changed_shards(self) -> DataFrame:
        """(table, file) of shards whose bytes aren't those committed, or that are gone; each is hashed in a task."""
        listed = [(t, os.path.join(self.path, f["file"]), f["sha256"]) for t in TABLES | ROWS for f in committed(self.path, t)]
        shards = self.spark.createDataFrame(listed, "table string, file string, sha256 string").repartition(max(1, len(listed)), "file")

        def differing(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield b[[not os.path.exists(f) or _sha256(f) != h for f, h in zip(b["file"], b["sha256"], strict=True)]][["table", "file"]]

        return shards.mapInPandas(differing, "table string, file string")


def _packed(vec: str) -> Column:
    return F.pandas_udf(lambda s: s.map(lambda v: None if v is None else np.asarray(v, np.float64).tobytes()), "binary")(vec)


def _unpacked(data: str) -> Column:
    return F.pandas_udf(lambda s: s.map(lambda d: None if d is None else np.frombuffer(d, np.float64)), "array<double>")(data)


class SQLiteBundleReader:
    """A bundle file's tables as DataFrames and its small parts as Python values."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        if not os.path.exists(path):
            raise FileNotFoundError(path)
        self.spark, self.path = spark, path
        register(spark)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.format("sqlite_bundle").option("table", name).load(self.path)

    def get_manifest(self) -> dict:
        return {r["key"]: json.loads(r["value"]) for r in self.table("manifest").collect()}

    def objects(self) -> DataFrame:
        return self.table("objects")

    def object_ids(self) -> list[str]:
        return [r[0] for r in self.objects().orderBy("pos").select("object_id").collect()]

    def matrix(self, rep_id: str) -> np.ndarray:
        """The matrix of a representation; ValueError where its hash differs."""
        row = self.table("representation_blobs").where(F.col("rep_id") == rep_id).first()
        if row is None:
            raise KeyError(f"no representation {rep_id!r}")
        if hashlib.sha256(row["data"]).hexdigest() != row["sha256"]:
            raise ValueError(f"{rep_id}: the hash differs")
        return np.frombuffer(bytes(row["data"]), row["dtype"]).reshape(row["n_objects"], row["n_features"]).copy()

    def neighbors(self, rep_id: str, metric_id: str, k: int) -> DataFrame:
        """(src_id, neighbors): the ids of the first k neighbours in order."""
        near = self.table("knn_edges").where((F.col("rep_id") == rep_id) & (F.col("metric_id") == metric_id) & (F.col("rank") <= k))
        return near.groupBy("src_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "neighbor_id"))), lambda x: x["neighbor_id"]).alias("neighbors"))

    def view_basis(self, view_id: str, rep_id: str) -> np.ndarray:
        row = self.table("catalog_views").where((F.col("view_id") == view_id) & (F.col("rep_id") == rep_id)).first()
        if row is None:
            raise KeyError(f"no view {view_id!r} of {rep_id!r}")
        return np.frombuffer(bytes(row["basis_data"]), np.float64).reshape(row["p_dim"], -1).copy()

    def view_coords(self, view_id: str, rep_id: str) -> DataFrame:
        return self.table("view_coords").where((F.col("view_id") == view_id) & (F.col("rep_id") == rep_id)).select("object_id", "x", "y")
