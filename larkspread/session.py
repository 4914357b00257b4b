"""Session helpers: a local session for tests and lineage cuts in the shared folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
_own_folders: dict[str, str] = {}
_marked: set[str] = set()


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, name: str = "larkspread") -> SparkSession:
    """A single-machine session, used by tests and the bench only."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("LARKSPREAD_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only where that setting is absent *and* the master is a single JVM (tests)
    is a temporary folder of this machine made up; on a cluster it is an error.
    """
    set_to = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY, None)
    if set_to:
        return set_to.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError(f"set {CHECKPOINT_KEY} to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_folders:
        _own_folders[app] = f"file://{tempfile.mkdtemp(prefix='larkspread-')}"
    return _own_folders[app]


def _own_tables(spark: SparkSession) -> str:
    """This application's part of the shared folder; it goes when the driver ends."""
    root = f"{shared_folder(spark)}/larkspread/{spark.sparkContext.applicationId}"
    if root not in _marked:
        fs, at = _hadoop(spark, root)
        fs.mkdirs(at)
        fs.deleteOnExit(at)
        _marked.add(root)
    return root


def materialize(df: DataFrame, label: str = "cut") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage like a reliable checkpoint but runs the plan a single time
    and stores compressed columns; a lost executor costs a re-read, no re-run.
    """
    spark = df.sparkSession
    path = f"{_own_tables(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_materialized(spark: SparkSession) -> None:
    """Delete the tables written by ``materialize`` now, not at the driver's end; frames
    read from them end with it."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/larkspread")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _hadoop(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def write_bytes(path: str, content: bytes) -> None:
    """A small file on any file system that Spark knows, or on this machine."""
    if "://" not in path:
        os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
        with open(path, "wb") as f:
            f.write(content)
        return
    fs, at = _hadoop(SparkSession.active(), path)
    out = fs.create(at, True)
    try:
        out.write(bytearray(content))
    finally:
        out.close()


def read_bytes(path: str) -> bytes:
    """The content of such a file; OSError where there is none."""
    if "://" not in path:
        with open(path, "rb") as f:
            return f.read()
    spark = SparkSession.active()
    fs, at = _hadoop(spark, path)
    if not fs.exists(at):
        raise FileNotFoundError(path)
    into = fs.open(at)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(into))
    finally:
        into.close()
