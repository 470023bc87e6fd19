"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from annotrail.session import ship

#: ``str.split``-like words of the digests: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where a session names none, a temporary one is set if the master is this machine; otherwise there is none to share.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if jvm_dir.isDefined():
            found = os.path.dirname(jvm_dir.get())
        else:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            found = "file://" + tempfile.mkdtemp(prefix="annotrail-")
            spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends here.

    The files outlive lost executors and go when the driver's JVM ends.
    """
    spark = ship(df.sparkSession)
    path = f"{shared_dir(spark)}/annotrail-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    jpath = jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return spark.read.schema(df.schema).parquet(path)


def by_row(
    df: DataFrame,
    columns: list[str],
    schema: str,
    make: Callable[[], Callable[..., Iterable[tuple]]],
    rows: int = 2048,
    out_bytes: int = 8 << 20,
) -> DataFrame:
    """Apply ``make()(*values)`` to each row of ``columns``; it yields tuples of ``schema``.

    ``make`` runs once a task, so it may build tables. Results leave in
    batches bounded in rows and in bytes, whatever the length of a text.
    """
    ship(df.sparkSession)
    src = df.select(*[F.col(f"`{c}`") for c in columns])
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        out: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True))
            return pa.RecordBatch.from_arrays(
                [pa.array(c, type=f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow
            )

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for values in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    for made in fn(*values):
                        out.append(made)
                        size += 64 + sum(len(v) * (8 if isinstance(v, list) else 1) for v in made if isinstance(v, (str, bytes, list)))
                        if len(out) >= rows or size >= out_bytes:
                            yield flush()
                            out, size = [], 0
        if out:
            yield flush()

    return src.mapInArrow(run, schema)


#: Bits of the largest filter that is sent out to find wanted rows: 32 MB.
MAX_BITS = 1 << 28


def perhaps(rows: DataFrame, wanted: DataFrame, key: list[str]) -> DataFrame:
    """``rows`` with __hit: false where the key surely isn't among those of ``wanted``.

    A bitmap of hashed keys, of ``MAX_BITS`` at most, goes to all executors; so rows that a join wouldn't touch need not move for it.
    """
    bits = 1 << 16
    while bits < min(MAX_BITS, 8 * wanted.count()):
        bits *= 2
    place = F.pmod(F.xxhash64(*key), F.lit(bits))
    part, bit = F.floor(place / 32768).cast("int"), (place % 32768).cast("int")
    maps = wanted.select(part.alias("__part"), bit.cast("long").alias("__bit")).groupBy("__part").agg(F.bitmap_construct_agg("__bit").alias("__map"))
    # The map as an array of bytes, which a row finds its own in without a conversion.
    byte = lambda k: F.conv(F.hex(F.substring(F.col("__map"), k + 1, F.lit(1))), 16, 10).cast("int")
    signed = lambda x: F.when(x > 127, x - 256).otherwise(x).cast("tinyint")
    maps = maps.select("__part", F.transform(F.sequence(F.lit(0), F.lit(4095)), lambda k: signed(byte(k))).alias("__map"))
    rows = rows.withColumn("__part", part).withColumn("__bit", bit).join(F.broadcast(maps), "__part", "left")
    byte = F.expr("__map[cast(shiftright(__bit, 3) as int)]").cast("int")
    hit = byte.bitwiseAND(F.expr("shiftleft(1, __bit & 7)")) != 0
    return rows.withColumn("__hit", F.coalesce(hit, F.lit(False))).drop("__part", "__bit", "__map")


def text_key(text: Column) -> Column:
    """A 128-bit name of a text, for grouping exact copies."""
    return F.md5(text.cast("binary"))


def like(out: DataFrame, docs: DataFrame) -> DataFrame:
    """``out`` with exactly the columns of ``docs``, in order."""
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
