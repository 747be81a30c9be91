"""Shared pieces of the corpus operators: word rules, hold-out rule, shared-folder tables.

Words are maximal runs of characters other than space and U+0009..U+000D.  Lower-casing
touches A-Z only, so it never changes a text's length or its non-ASCII characters.
"""

from __future__ import annotations

import gc
import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def ship_by_value(module_name: str) -> None:
    """Pickle a module's functions by value, so executors need no copy of this package."""
    cloudpickle.register_pickle_by_value(sys.modules[module_name])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, UPPER, UPPER.lower())


def words_of(text: Column) -> Column:
    """The words of a text, in order; null text gives an empty array."""
    flat = F.translate(F.coalesce(text, F.lit("")), SPACES, " " * len(SPACES))
    return F.filter(F.split(flat, " "), lambda w: w != "")


def crc_mod(id_column: Column, divisor: int) -> Column:
    """crc32 of the id written as text, modulo `divisor`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % divisor


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor and the driver share: spark.checkpoint.dir, read from the session.

    Only where that is unset (tests, a laptop) a temporary folder takes its place, and only on a
    local master, where the driver and the executors are one process.
    """
    found = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if found:
        return found
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = getattr(shared_dir, "made", None)
    if made is None:
        made = shared_dir.made = tempfile.mkdtemp(prefix="brindle-shared-")
    return f"file://{made}"


def shared_table(df: DataFrame, label: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: lineage ends here, and a lost executor
    costs at most a reread.  The files go with `drop_table`, or when the application ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/brindle/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where, files = _located(spark, path)
    files.deleteOnExit(where)
    written = spark.read.schema(df.schema).parquet(path)
    written.shared_path = path
    return written


def drop_table(df: DataFrame) -> None:
    """Remove the files of a `shared_table` that nothing reads any more."""
    where, files = _located(df.sparkSession, df.shared_path)
    files.delete(where, True)


def drop_shuffles(spark: SparkSession) -> None:
    """Let Spark remove the files of shuffles that no plan reads any more.

    It does so when the driver's memory is collected, which may be long after a large shuffle's
    result has been written.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _located(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
