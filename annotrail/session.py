"""What a session needs before the package's Python code runs on its executors."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()

#: Bytes of an Arrow batch on its way to a Python worker, unless the session names another number: rows are whole texts.
BATCH_BYTES = 4 << 20
_BATCH_CONF, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the session's executors, once for each application, and bound Arrow batches in bytes."""
    if spark.conf.get(_BATCH_CONF) == _BATCH_DEFAULT:
        spark.conf.set(_BATCH_CONF, str(BATCH_BYTES))
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = Path(__file__).resolve().parent
        if root.is_dir():  # else it came in an archive, as it does here
            archive = Path(tempfile.mkdtemp(prefix="annotrail-")) / "annotrail_package.zip"
            with zipfile.ZipFile(archive, "w") as out:
                for path in sorted(root.rglob("*.py")):
                    out.write(path, f"{root.name}/{path.relative_to(root)}")
            spark.sparkContext.addPyFile(str(archive))
        _shipped.add(app)
    return spark


def _path(spark: SparkSession, path: str):
    """(Hadoop file system, path)."""
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jpath


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with scheme and authority, as Spark's readers name it."""
    fs, jpath = _path(spark, path)
    return fs.makeQualified(jpath).toString()


def exists(spark: SparkSession, path: str) -> bool:
    fs, jpath = _path(spark, path)
    return fs.exists(jpath)


def remove(spark: SparkSession, path: str) -> None:
    fs, jpath = _path(spark, path)
    fs.delete(jpath, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, on any file system that Spark can write to."""
    fs, jpath = _path(spark, path)
    out = fs.create(jpath, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``; a temporary one where the master is this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="annotrail-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, which goes when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/annotrail-{name}-{uuid.uuid4().hex}"
    fs, jpath = _path(spark, path)
    fs.deleteOnExit(jpath)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends here and is evaluated once."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
