"""Session construction and durable intermediate results."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from quarry.errors import PlanError

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(app: str = "quarry", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library expects; ``conf`` keys use ``__`` for dots and win over the defaults."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in ``spark.checkpoint.dir``.

    Only where the setting is absent and all executors are in this process (tests, one machine) a temporary
    folder takes its place; on a cluster its absence is an error, since its machines share no such folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise PlanError("spark.checkpoint.dir must name a folder that all executors share")
    held = getattr(shared_dir, "_own", None)
    if held is None:
        own = tempfile.mkdtemp(prefix="quarry-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        held = shared_dir._own = "file://" + own
    return held


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, unless they find it by themselves (working folder or PYTHONPATH)."""
    package = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(package)
    context = spark.sparkContext
    reachable = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    if root in (os.path.abspath(p) for p in reachable if p) or getattr(context, "_quarry_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="quarry-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    context.addPyFile(shutil.make_archive(os.path.join(folder, "quarry"), "zip", root, "quarry"))
    context._quarry_shipped = True


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores before a Python stage, if its input has fewer splits than there are cores.

    A large input has more splits and is left as it is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` by a table in the shared folder, so that a lost executor costs only a re-read.

    A checkpoint would do as well, but computes everything twice.
    """
    return written(df, "durable")


def written(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and return a scan of it (column pruning and pushdown apply).

    The files stay until ``drop_written``, since the returned frame is lazy, or else until the driver ends.
    """
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), f"{label}-{uuid.uuid4().hex}")
    _delete_on_exit(spark, path)
    df.write.parquet(path)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


_WRITTEN: list[str] = []


def _delete_on_exit(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)


def drop_written(spark: SparkSession) -> int:
    """Delete the intermediate tables written so far, once the results made from them are stored; how many there were."""
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    paths, _WRITTEN[:] = list(_WRITTEN), []
    for path in paths:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(hadoop).delete(target, True)
    return len(paths)
