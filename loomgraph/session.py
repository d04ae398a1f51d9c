"""Session helpers for tests and the bench, and the checkpoint folder rule."""

from __future__ import annotations

import re
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "loomgraph", cores: int | str = 8, memory: str = "8g") -> SparkSession:
    """A single-JVM session for tests and the bench; clusters bring their own session and
    settings. Short queries are helped by a larger cache of generated code and by not
    recording a Python call site for every expression."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores) if str(cores).isdigit() else "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.driver.extraJavaOptions", "-XX:+UseParallelGC")
        .config("spark.sql.codegen.cache.maxEntries", "2000")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Makes this package importable in Python workers, once per application; for sessions
    that were not started with it (`--py-files`)."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    here = Path(__file__).resolve().parent
    if not here.is_dir():  # imported from an archive that was shipped already
        return
    base = Path(tempfile.mkdtemp(prefix="loomgraph-pkg-")) / here.name
    spark.sparkContext.addPyFile(shutil.make_archive(str(base), "zip", here.parent, here.name))
    _shipped.add(app)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints: the cluster's `spark.checkpoint.dir` when it names
    one, a folder of our own only where none is set (local tests)."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.match(r"local(\[|$)", sc.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="loomgraph-ckpt-"))
    return sc.getCheckpointDir()


class Scratch:
    """Written tables of one computation, in a folder of their own under the checkpoint folder.
    They outlive the loss of an executor, and superseded ones can be removed."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables-{uuid.uuid4().hex}"

    def write(self, name: str, df: DataFrame, *dealt: str) -> DataFrame:
        (df.write.partitionBy(*dealt) if dealt else df.write).parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def remove(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint, which outlives the loss of an executor."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, *dealt: str) -> DataFrame:
    """Cut lineage with a table of columns: for large intermediate tables. It is a fraction of a checkpoint's
    bytes, readers take the columns they need, and its size is known, so that small tables are broadcast.
    With `dealt`, files are kept apart by these columns."""
    return Scratch(df.sparkSession).write("table", df, *dealt)
