"""Session helpers: the shared folder for intermediate tables, and tables written there to cut lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_WRITTEN: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the cluster names it in ``spark.checkpoint.dir``.

    Only where that setting is absent, as in local tests, a temporary folder of our own is made;
    on a cluster that would be local to one machine, so there it is an error.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if "dir" not in _OWN:
        _OWN["dir"] = tempfile.mkdtemp(prefix="ledgerloom-")
        atexit.register(shutil.rmtree, _OWN["dir"], True)
    return "file://" + _OWN["dir"]


def durable(df: DataFrame, label: str = "table", tidy: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and return it as read from there.

    The written table survives the loss of executors, cuts the lineage, and gives the next plan exact sizes. With ``tidy`` it is
    written in the denser codec, and the shuffle files of its making go at once and not when the driver next collects its garbage.
    """
    spark = df.sparkSession
    path = scratch(spark, label)
    before = spark.conf.get(_CLEAN, None)
    if tidy:
        spark.conf.set(_CLEAN, "true")
    try:
        (df.write.option("compression", "zstd") if tidy else df.write).parquet(path)
    finally:
        if tidy:
            spark.conf.unset(_CLEAN) if before is None else spark.conf.set(_CLEAN, before)
    written = spark.read.schema(df.schema).parquet(path)
    written._ledgerloom_path = path
    return written


_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def discard(df: DataFrame) -> None:
    """Delete a table of ``durable`` that no result reads any more."""
    path = df._ledgerloom_path
    p = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)
    _WRITTEN.remove((df.sparkSession, path))


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, deleted at exit like the tables of ``durable``."""
    path = f"{shared_dir(spark)}/ledgerloom-{label}-{uuid.uuid4().hex}"
    if not _WRITTEN:
        atexit.register(release)
    _WRITTEN.append((spark, path))
    return path


def release() -> None:
    """Delete the tables that this process wrote, once no result that reads them is needed; called at exit as well."""
    while _WRITTEN:
        spark, path = _WRITTEN.pop()
        try:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session is gone: only a local folder can still be reached
            shutil.rmtree(path.removeprefix("file://"), True)


#: Most partitions that a small input is spread over.
MOST_SPREAD = 32


def spread(df: DataFrame) -> DataFrame:
    """``df`` in as many partitions as there are cores, ``MOST_SPREAD`` at most, where it has fewer than half of that, for work that is bound by the CPU.

    Inputs of so few partitions are small (a partition is 128 MB at most), so only small inputs are ever moved, and never into many tasks.
    """
    cores = min(df.sparkSession.sparkContext.defaultParallelism, MOST_SPREAD)
    return df if 2 * df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the test tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
