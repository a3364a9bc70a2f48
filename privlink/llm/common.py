"""Helpers shared by the training-data operators: tables, shared folders, lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import runtime

#: Bytes of a batch that goes to a Python worker.  The JVM and the worker hold a batch several times over, and neither gives all of
#: that memory back; a row that is larger goes alone.
BATCH_BYTES = 4 << 20
#: ASCII white space as the contracts count it (a fixed value): space, \t \n \v \f \r.
ASCII_SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Setting under which a plan's shuffle files go once it has run.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_local_dir: list[str] = []


def ship(spark: SparkSession) -> None:
    """Hand this package to the Python workers, and bound the batches that they get by BATCH_BYTES.

    The bound is a setting of the session and stays, as results are lazy; a smaller one of the session is left as it is.
    """
    runtime.ship(spark)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))
    if now > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: the session's spark.checkpoint.dir.

    Where it is unset, in local mode, a temporary folder of this process stands in; a cluster has to name one.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if found:
        return found
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError(f"spark.checkpoint.dir is unset, and {master} needs a folder that the driver and all executors see")
    if not _local_dir:
        _local_dir.append("file://" + tempfile.mkdtemp(prefix="privlink-"))
    return _local_dir[0]


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder of the shared store."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from the files; a lost executor costs no recomputation.

    The shuffle files of this one plan go as soon as it is written; nothing reads them again.

    Constraints stay behind: a checkpoint that remembers those of a union can't be joined with itself.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_dir(spark))
    keys = {"spark.sql.constraintPropagation.enabled": "false", CLEANUP: "true"}
    before = {k: spark.conf.get(k, "false") for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        return df.select("*").checkpoint()  # a plan of its own, made under these settings
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


class Store:
    """Intermediate tables of one operator as Parquet in the shared folder: smaller than checkpoints.

    A table's shuffle files go as soon as it is written; nothing reads them again.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.base, self.count = spark, f"{shared_dir(spark)}/tables-{uuid.uuid4().hex}", 0

    def put(self, df: DataFrame) -> DataFrame:
        before = self.spark.conf.get(CLEANUP, "false")
        self.count += 1
        path = f"{self.base}/{self.count}"
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.set(CLEANUP, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        return out


def bind(column: Column, use) -> Column:
    """``use(value)`` with the column computed once, however often ``use`` refers to it."""
    return F.get(F.transform(F.array(column), lambda v: use(v)), 0)


def fresh_names(df: DataFrame, *names: str) -> list[str]:
    """``names`` with as many underscores in front as keep them apart from the columns of df."""
    taken = {c.lower() for c in df.columns}
    lead = "_"
    while any((lead + n).lower() in taken for n in names):
        lead += "_"
    return [lead + n for n in names]


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, UPPER, LOWER)


def without_space(c: Column) -> Column:
    """Delete ASCII white space.  Byte-level replacements are cheaper than a regular expression here."""
    for ch in ASCII_SPACE:
        c = F.replace(c, F.lit(ch), F.lit(""))
    return c
