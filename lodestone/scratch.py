"""Tables written to the folder that the whole cluster shares, for results that a plan reads several times."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; only a local session (tests) may leave it unset."""
    sc = spark.sparkContext
    top = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not top:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        top = tempfile.mkdtemp(prefix="lodestone-")
        sc.setCheckpointDir(top)
    return top.rstrip("/")


def fresh(spark: SparkSession, kind: str) -> str:
    """A path of its own in that folder, deleted at the end of the driver's JVM."""
    path = f"{folder(spark)}/lodestone-{kind}-{uuid.uuid4().hex}"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


def written(df: DataFrame, kind: str = "table") -> DataFrame:
    """``df``, computed once and read from then on."""
    path = fresh(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows and bytes that go to Python at once; either bound ends a batch, so that very long texts are batches of few.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def text_batches(spark: SparkSession, rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> None:
    """Bound what goes to Python at once by rows and by bytes, which bounds its memory and the JVM's.

    The settings are the session's; they are only ever lowered, and change no result.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        was = str(spark.conf.get(key)).strip().lower().removesuffix("b")
        if not was.lstrip("-").isdigit() or not 0 < int(was) <= most:
            spark.conf.set(key, most)


#: Rows of a few numbers, or of a path, up to which a side of a join is broadcast.
FEW_ROWS = 200_000


def few(df: DataFrame, most: int = FEW_ROWS) -> DataFrame:
    """``df``, a written table of narrow rows, to be broadcast if its row count allows it."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if df.count() <= most else df
