"""Versioned tables. A write goes to a folder of its own; a commit is one file of pointer rows that
makes new versions of one or several tables current at once.

A job that dies leaves a folder nobody points to: readers see what they saw before, later writes
are not in its way, and `vacuum` removes it. A table can be rebuilt from itself, as its current
folders stay until then.

A table is one folder, or dealt by a hash of its key into buckets. An upsert of a bucketed table
reads and writes the buckets its rows fall into; the new version points to the other buckets where
they are, so cost follows the delta and not the table.

One writer per table at a time is assumed: of two commits of one version, both are read."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType
from pyspark.errors import AnalysisException


#: A row is a folder of a bucket of a version, or of all of it where the table has no buckets. No path: nothing there.
POINTERS = "name string, version bigint, path string, bucket int, buckets int, schema string"
BUCKETS = 64
#: Folders of a bucket, from which on appended rows are written together with those of the bucket.
FOLDERS = 16


def missing(error: AnalysisException) -> bool:
    """Did a read fail because nothing is at its path?"""
    return error.getCondition() == "PATH_NOT_FOUND"


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def all_nullable(schema: StructType) -> StructType:
    """Stored columns may be null at every level, as files do not tell."""

    def loose(part):
        if isinstance(part, dict):
            return {k: True if k in ("nullable", "containsNull", "valueContainsNull") else loose(v) for k, v in part.items()}
        return [loose(p) for p in part] if isinstance(part, list) else part

    return StructType.fromJson(loose(schema.jsonValue()))


@dataclass(frozen=True)
class Version:
    """A version of a table: its folders, by bucket where it has buckets."""

    number: int
    folders: dict[int | None, tuple[str, ...]]
    buckets: int | None
    schema: StructType

    def rows(self, name: str) -> list[tuple]:
        text = self.schema.json()
        return [(name, self.number, path, b, self.buckets, text) for b, paths in (self.folders or {None: (None,)}).items() for path in paths]

    def paths(self, buckets: set[int] | None = None) -> list[str]:
        """Folders of all, or of the given buckets."""
        return [p for b, paths in self.folders.items() if buckets is None or b in buckets for p in paths]


class Commit:
    """Tables that become current together, when the `with` block ends without an error."""

    def __init__(self, store: Snapshots):
        self.store, self.staged, self.now = store, {}, {}

    def __enter__(self) -> Commit:
        self.now = self.store.versions()
        return self

    def __exit__(self, kind, *_) -> None:
        if kind is None and self.staged:
            self.store._point([row for name, v in self.staged.items() for row in v.rows(name)])

    def _next(self, name: str) -> tuple[Version | None, int, str]:
        now = self.now.get(name)
        return now, (now.number if now else 0) + 1, f"{self.store.root}/{name}/{uuid.uuid4().hex}"

    def lookup(self, name: str, keys: DataFrame, key: str) -> DataFrame:
        """Rows of the given keys; of a bucketed table only the buckets they fall into are read."""
        v = self.now[name]
        wanted = keys.select(key).distinct()
        folders = v.paths()
        if v.buckets:
            folders = v.paths({r["b"] for r in wanted.select(bucket_of(key, v.buckets).alias("b")).distinct().collect()})
        return self.store._table(folders, v.schema).join(wanted, key, "left_semi").select(*v.schema.names)

    def write(self, name: str, df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
        """The whole table, in one folder."""
        _, number, path = self._next(name)
        (df.write.partitionBy(*partition_by) if partition_by else df.write).parquet(path)
        self.staged[name] = Version(number, {None: (path,)}, None, df.schema)
        return self.store.spark.read.schema(df.schema).parquet(path)

    def upsert(self, name: str, delta: DataFrame, key: str, merge: Callable[[DataFrame, DataFrame], DataFrame],
               schema: str | StructType, buckets: int = BUCKETS, reset: bool = False, keys: DataFrame | None = None,
               distinct: bool = False, dealt_out: bool = True) -> int:
        """`merge(old, delta)` gives the new rows of the buckets that the delta's keys fall into, from
        their old rows; it must not make rows of other keys. The delta is read for its keys first, unless
        they are given. Returns how many buckets were written.
        A table without buckets is dealt into buckets here; `reset` starts from no rows. With `distinct` the rows are
        a set: they are written where equal rows meet, not dealt out again; nor are they without `dealt_out`, so that
        every task writes a file to each of its buckets."""
        spark = self.store.spark
        now, number, path = self._next(name)
        now = None if reset else now
        dealt = now is not None and now.buckets is not None
        n = now.buckets if dealt else buckets
        kept, old = {}, now.paths() if now else []
        if dealt:
            touched = {r["b"] for r in (delta if keys is None else keys).select(bucket_of(key, n).alias("b")).distinct().collect()}  # at most n
            kept = {b: p for b, p in now.folders.items() if b not in touched}
            old = now.paths(touched)
        shape = now.schema if now else all_nullable(spark.createDataFrame([], schema).schema)
        rows = merge(self.store._table(old, shape), delta).select(*[F.col(f.name).cast(f.dataType) for f in shape])
        rows = (rows.distinct() if distinct else rows).withColumn("_bucket", bucket_of(key, n))
        # adaptive execution splits large buckets over several files and puts small ones into one task
        (rows.hint("rebalance", "_bucket") if dealt_out and not distinct else rows).write.partitionBy("_bucket").parquet(path)
        written = {b: (p,) for b, p in self.store._buckets_in(path)}
        self.staged[name] = Version(number, kept | written, n, shape)
        return len(written)

    def append(self, name: str, rows: DataFrame, key: str, schema: str | StructType, buckets: int = BUCKETS,
               reset: bool = False, dealt_out: bool = True) -> int:
        """Adds rows to a bucketed table. They become folders beside those of their buckets, so nothing stored is read
        or written again, until a bucket has FOLDERS of them. Without `dealt_out` the tasks write them where they are."""
        now, number, path = self._next(name)
        now = None if reset else now
        if now is not None and (now.buckets is None or max(map(len, now.folders.values()), default=0) >= FOLDERS):
            return self.upsert(name, rows, key, lambda old, d: old.unionByName(d), schema, buckets)
        n = now.buckets if now else buckets
        shape = now.schema if now else all_nullable(self.store.spark.createDataFrame([], schema).schema)
        placed = rows.select(*[F.col(f.name).cast(f.dataType) for f in shape]).withColumn("_bucket", bucket_of(key, n))
        (placed.hint("rebalance", "_bucket") if dealt_out else placed).write.partitionBy("_bucket").parquet(path)
        written = {b: (p,) for b, p in self.store._buckets_in(path)}
        before = now.folders if now else {}
        self.staged[name] = Version(number, {b: before.get(b, ()) + written.get(b, ()) for b in sorted({*before, *written})}, n, shape)
        return len(written)

    def replace(self, name: str, keys: DataFrame, rows: DataFrame, key: str, schema: str | StructType,
                buckets: int = BUCKETS, reset: bool = False, exact: bool = False) -> int:
        """The rows of the given keys, which may be none, take the place of those stored. `exact` promises that
        there are no rows of other keys, and that `keys` is cheap to read; they are written where stored rows meet the
        keys. Else such rows are left out."""
        if exact:
            def swapped(old: DataFrame, delta: DataFrame) -> DataFrame:
                return delta if reset else old.join(keys.select(key), key, "left_anti").select(*old.columns).unionByName(delta.select(*old.columns))

            return self.upsert(name, rows, key, swapped, schema, buckets, reset, keys, dealt_out=False)
        delta = keys.select(key).distinct().join(rows.withColumn("_row", F.lit(True)), key, "left")

        def swap(old: DataFrame, delta: DataFrame) -> DataFrame:
            new = delta.filter("_row").select(*old.columns)
            return old.join(delta.select(key).distinct(), key, "left_anti").select(*old.columns).unionByName(new)

        return self.upsert(name, delta, key, swap, schema, buckets, reset, keys)


class Snapshots:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # pointers
    def _pointers(self) -> DataFrame | None:
        try:
            return self.spark.read.schema(POINTERS).json(f"{self.root}/_pointers")
        except AnalysisException as e:
            if missing(e):  # nothing written yet
                return None
            raise

    def _point(self, rows: list[tuple]) -> None:
        """One partition is one file, which a rename brings into the folder: all rows or none."""
        self.spark.createDataFrame(rows, POINTERS).coalesce(1).write.mode("append").json(f"{self.root}/_pointers")

    def versions(self) -> dict[str, Version]:
        """The current version of every table, in one pass over the pointers."""
        pointers = self._pointers()
        if pointers is None:
            return {}
        rows = pointers.groupBy("name", "version").agg(
            F.first(F.struct("buckets", "schema")).alias("s"), F.collect_list(F.struct("bucket", "path")).alias("at")).groupBy("name").agg(
            F.max_by(F.struct("version", "s", "at"), "version").alias("v"))
        out = {}
        for r in rows.collect():  # one row per table
            v = r["v"]
            folders: dict = {}
            for bucket, path in sorted(((f["bucket"], f["path"]) for f in v["at"] if f["path"]), key=lambda at: (at[0] or 0, at[1])):
                folders[bucket] = (*folders.get(bucket, ()), path)
            out[r["name"]] = Version(v["version"], folders, v["s"]["buckets"], StructType.fromJson(json.loads(v["s"]["schema"])))
        return out

    def version(self, name: str) -> Version | None:
        return self.versions().get(name)

    def current(self, name: str) -> tuple[int, list[str]] | None:
        """Number and folders of the current version."""
        v = self.version(name)
        return v and (v.number, v.paths())

    def exists(self, name: str) -> bool:
        return self.version(name) is not None

    # tables
    def read(self, name: str, schema: str | None = None) -> DataFrame:
        """The current version; an empty table when none exists and a schema is given."""
        v = self.version(name)
        if v is None and schema is None:
            raise FileNotFoundError(f"{name} has no snapshot under {self.root}")
        return self._table(v.paths() if v else [], schema or v.schema)

    def _table(self, folders: list[str], schema: str | StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def lookup(self, name: str, keys: DataFrame, key: str) -> DataFrame:
        with self.commit() as c:
            return c.lookup(name, keys, key)

    def commit(self) -> Commit:
        return Commit(self)

    def write(self, name: str, df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
        with self.commit() as c:
            return c.write(name, df, partition_by)

    def upsert(self, name: str, delta: DataFrame, key: str, merge: Callable[[DataFrame, DataFrame], DataFrame],
               schema: str, buckets: int = BUCKETS) -> int:
        with self.commit() as c:
            return c.upsert(name, delta, key, merge, schema, buckets)

    # folders
    def _files(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return fs, list(fs.listStatus(at)) if fs.exists(at) else []

    def _buckets_in(self, path: str) -> list[tuple[int, str]]:
        names = (f.getPath().getName() for f in self._files(path)[1] if f.isDirectory())
        return [(int(n.split("=")[1]), f"{path}/{n}") for n in names if n.startswith("_bucket=")]

    def vacuum(self, hours: float = 24.0) -> list[str]:
        """Removes what no current version points to: folders of old versions and of failed writes,
        and their pointer rows. Only what was written more than `hours` ago goes, so that readers of
        an older version and a write under way are safe. Returns the folders."""
        pointers = self._pointers()
        if pointers is None:
            return []
        now = self.versions()
        fs, old_files = self._files(f"{self.root}/_pointers")
        limit = self.spark._jvm.java.lang.System.currentTimeMillis() - int(hours * 3_600_000)
        used = {p for v in now.values() for p in v.paths()}
        gone = []
        for name in now:
            for run in self._files(f"{self.root}/{name}")[1]:
                path = f"{self.root}/{name}/{run.getPath().getName()}"
                parts = [p for _, p in self._buckets_in(path)] or [path]
                dead = [p for p in parts if p not in used]
                if run.getModificationTime() < limit and dead:
                    dead = [path] if len(dead) == len(parts) else dead
                    for p in dead:
                        fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(p), True)
                    gone += dead
        stale = [f for f in old_files if f.getModificationTime() < limit]
        if len(stale) > 1:  # the current rows are in one new file before the old files go
            self._point([row for n, v in now.items() for row in v.rows(n)])
            for f in stale:
                fs.delete(f.getPath(), False)
        return gone


def append_new(df: DataFrame, path: str, key: str, force: bool = False,
               partition_by: list[str] | None = None) -> None:
    """Appends only rows whose key is not stored yet (all rows when forced)."""
    if not force:
        try:
            stored = df.sparkSession.read.parquet(path).select(key)
            df = df.join(stored, key, "left_anti")
        except AnalysisException as e:
            if not missing(e):  # else the first write
                raise
    writer = df.write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
