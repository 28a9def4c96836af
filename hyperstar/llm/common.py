"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words: space and the ASCII controls from tab to carriage return.
SPACES = r"[\x20\x09-\x0D]+"

_WRITTEN: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    Where that setting is missing, local mode uses a temporary folder of this
    machine (its only one), and a cluster a folder in its warehouse.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master.startswith("local") and not master.startswith("local-cluster"):
        return f"file://{tempfile.gettempdir()}/checkpoints"
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_stages"


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again: its lineage
    is cut, and lost executors cost no more than another read. The table is
    deleted when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _WRITTEN:
        atexit.register(_sweep)
    _WRITTEN.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def _sweep() -> None:
    while _WRITTEN:
        spark, path = _WRITTEN.pop()
        try:
            jvm, context = spark._jvm, spark._jsc
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(context.hadoopConfiguration()).delete(where, True)
        except Exception:  # the JVM may have ended before the interpreter
            return


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once a row, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """The words of a text, in order; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def text_key(text: Column) -> Column:
    """Tells apart rows that repeat a doc_id: 64 bits of the text, 0 for null."""
    return F.when(text.isNull(), F.lit(0)).otherwise(F.xxhash64(text))


def single_thread() -> None:
    """Keeps native libraries from starting threads of their own beside Spark's."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ["OMP_NUM_THREADS"] = "1"
