"""Session helpers: a local session for tests, and lineage cuts that survive executor loss."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


#: Spark's setting to remove the shuffle files of a query when it ends.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Spark's setting for the largest generated method, and its default.
METHOD_LIMIT = "spark.sql.codegen.hugeMethodLimit"


def local_session(cores: int | str = "*", partitions: int = 8, **extra: str) -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    settings = {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "256k",
        "spark.sql.session.timeZone": "UTC",
        "spark.driver.memory": "8g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **extra,
    }
    builder = SparkSession.builder.master(f"local[{cores}]").appName("contestry")
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for lineage cuts.

    The cluster names it in ``spark.checkpoint.dir``. A machine-local folder is chosen only
    where that is unset *and* the session is a single local JVM.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return named or current.get()
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        named = tempfile.mkdtemp(prefix="contestry-checkpoint-")
    context.setCheckpointDir(named)
    return named


# Scratch tables of this process that no scope has dropped yet.
_scratch: list[str] = []


def scratch_table(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder for a table written between two jobs."""
    path = os.path.join(checkpoint_root(spark), f"{label}-{uuid.uuid4().hex}")
    _scratch.append(path)
    return path


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Drop the scratch tables made inside when it ends.

    Frames that came out of the scope and still read them are to be written or collected
    before. Without a scope, tables stay for the cluster's own clean-up of the folder.
    """
    before = set(_scratch)
    try:
        yield
    finally:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path
        for path in [p for p in _scratch if p not in before]:
            place = hadoop(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
            _scratch.remove(path)


def compile_all(spark: SparkSession) -> None:
    """Have Spark split generated methods that HotSpot would leave to its interpreter.

    HotSpot compiles no method above 8,000 bytes, and Spark's own documentation names that value
    for it. A step over a wide row is easily above. A value that the session has is kept.
    """
    if spark.conf.get(METHOD_LIMIT, None) in (None, "65535"):
        spark.conf.set(METHOD_LIMIT, "8000")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Values one run has fixed then never change on a retry, nothing upstream is computed
    again, and readers still prune columns and rows, which a checkpointed row stream cannot.
    Once the table is there, the shuffle files behind it are of no use and go at once, instead
    of when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = scratch_table(spark, "cut")
    before = spark.conf.get(DROP_SHUFFLES, None)
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(DROP_SHUFFLES)
        else:
            spark.conf.set(DROP_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Give every core a share of a table that comes in fewer pieces than there are cores.

    For narrow tables in front of an expensive row-wise step. A table of many files is left
    as it is, so at scale this is no shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
