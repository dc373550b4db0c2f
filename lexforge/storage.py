"""Where the engine keeps what outlives a query: a folder that all executors share."""

from __future__ import annotations

import atexit
import hashlib
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

_kept: dict[str, SparkSession] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; only where that is unset and Spark runs on this
    machine alone is a temporary folder made and set."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="lexforge-")
        sc.setCheckpointDir(base)
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(base)
    return base


def place(spark: SparkSession, kind: str, *key: str) -> str:
    """A folder of its own for a kind of table and what it is made of; it goes when the driver ends."""
    name = hashlib.md5("\x00".join((spark.sparkContext.applicationId, *key)).encode()).hexdigest()
    path = f"{scratch_dir(spark)}/lexforge-{kind}-{name}"
    if not _kept:
        atexit.register(_sweep)
    _kept[path] = spark
    return path


def small_batches(spark: SparkSession, rows: int = 4000, size: int = 4 << 20) -> None:
    """Bounds the Arrow batches that go to Python by rows and, as texts can be long, by bytes. The
    settings are the session's, are only lowered, and stay lowered: a plan reads them when it runs."""
    for key, most, before in (("maxRecordsPerBatch", rows, "10000"), ("maxBytesPerBatch", size, str(64 << 20))):
        key = f"spark.sql.execution.arrow.{key}"
        now = spark.conf.get(key, before)
        if not now.isdigit() or int(now) > most:
            spark.conf.set(key, str(most))


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def complete(spark: SparkSession, path: str) -> bool:
    """Whether a table was written there to its end."""
    return exists(spark, f"{path}/_SUCCESS")


def kept(df: DataFrame, kind: str, *key: str) -> DataFrame:
    """The table as it was first written under its key, or written now."""
    spark = df.sparkSession
    path = place(spark, kind, *key)
    if not complete(spark, path):
        df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text by Hadoop's file system; None if there is none."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def swap_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small file aside, then puts it in the place of the old one."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    new, old = jvm.org.apache.hadoop.fs.Path(f"{path}.new"), jvm.org.apache.hadoop.fs.Path(path)
    fs = old.getFileSystem(conf)
    out = fs.create(new, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf)
    kinds = jvm.org.apache.hadoop.fs.Options.Rename
    rename = spark.sparkContext._gateway.new_array(kinds, 1)
    rename[0] = kinds.OVERWRITE
    context.rename(new, old, rename)


def _file(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def publish_text(spark: SparkSession, path: str, text: str) -> bool:
    """Writes a small file aside and renames it to a place that must be free; False if it is taken."""
    jvm = spark._jvm
    new, fs = _file(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    out = fs.create(new, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(new, _file(spark, path)[0], spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
    except Py4JJavaError as e:
        if "AlreadyExists" not in e.java_exception.getClass().getName():
            raise
        fs.delete(new, False)
        return False
    return True


def names(spark: SparkSession, path: str) -> list[str]:
    """Of the files and folders in a folder, but hidden and unfinished ones; none if it isn't there."""
    p, fs = _file(spark, path)
    found = [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []
    return [n for n in found if not n.startswith((".", "_")) and not n.endswith(".tmp")]


def size(spark: SparkSession, path: str) -> int:
    """Bytes under a path."""
    p, fs = _file(spark, path)
    return fs.getContentSummary(p).getLength()


def delete(spark: SparkSession, path: str) -> None:
    p, fs = _file(spark, path)
    fs.delete(p, True)


def _sweep() -> None:
    for path, spark in _kept.items():
        try:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the JVM may be gone already
            return
