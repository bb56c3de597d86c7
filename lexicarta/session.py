"""Session helpers: local sessions for tests, and written intermediate tables."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, **conf) -> SparkSession:
    """A session for tests and benches; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("lexicarta")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared checkpoint folder the session names.

    All paths of an application are in one folder, to be deleted together.

    Only a session that is a single process gets a temporary folder without that
    setting; on a cluster such a folder would not be visible to every executor.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="lexicarta-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(base)
    base = "/".join([base.rstrip("/"), "lexicarta", context.applicationId, *_jobs])
    return f"{base}/{label}-{uuid.uuid4().hex}"


_jobs: list[str] = []


@contextlib.contextmanager
def job_scratch(spark: SparkSession, name: str) -> Iterator[None]:
    """Deletes what is written to scratch paths inside, also when the job fails."""
    folder = scratch_path(spark, name)
    _jobs.append(folder.rsplit("/", 1)[-1])
    try:
        yield
    finally:
        _jobs.pop()
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialize(
    df: DataFrame, label: str, schema: str | StructType | None = None, partition_by: str | None = None
) -> DataFrame:
    """Write ``df`` once and read it back.

    Cuts the lineage, survives lost executors, freezes anything that depends on
    the partitioning of one run, and gives the planner the exact size, so that
    it broadcasts the table only when the table really is small. ``schema`` reads
    the same data as another type of the same layout. With ``partition_by``, the last
    column, rows of other values are not read where it is filtered.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path, partitionBy=partition_by)
    return df.sparkSession.read.schema(schema or df.schema).parquet(path)
