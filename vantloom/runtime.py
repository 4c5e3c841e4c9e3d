"""Session plumbing shared by every operator: table loading and lineage cuts."""

from __future__ import annotations

import contextlib
import tempfile
import threading
import uuid
import zipfile
from pathlib import Path

from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; only Spark's reader touches the path, so any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local master may go without one; there it is a temporary folder, the same for the whole application.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if sc.master != "local" and not sc.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if sc.applicationId not in _temporary:
        _temporary[sc.applicationId] = tempfile.mkdtemp(prefix="vantloom-")
    return _temporary[sc.applicationId]


_temporary: dict[str, str] = {}
_written = threading.local()


def checkpoint(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and cut its lineage; files there survive the loss of any executor."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    out = df.checkpoint()
    for held in getattr(_written, "lists", ()):
        held.append(out._jdf.logicalPlan().rdd().getCheckpointFile().get())
    return out


def without_estimates(df: DataFrame) -> DataFrame:
    """A checkpointed ``df`` without the size that its plan was estimated at.

    Checkpoints keep that estimate, and a join's is the product of its sides', so in a loop of
    self-joins the digits of it double with every join, until planning never ends.
    """
    spark, jdf = df.sparkSession, df._jdf
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(jdf.queryExecution().toRdd(), jdf.schema(), False), spark)


@contextlib.contextmanager
def passing_checkpoints(spark: SparkSession):
    """Delete at the end what ``checkpoint`` wrote inside; nothing that reads it may be used after that."""
    held: list[str] = []
    _written.lists = [*getattr(_written, "lists", ()), held]
    try:
        yield
    finally:
        _written.lists = _written.lists[:-1]
        for path in held:
            discard(spark, path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder through the file system that its path names."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt out evenly where it is a plain scan of fewer splits than the cluster has cores.

    For work that is heavy by the row. What is moved is small by that rule: fewer splits than cores.
    A plan with exchanges of its own is left as it is.
    """
    made = df._jdf.queryExecution()
    if "AdaptiveSparkPlan" in made.executedPlan().nodeName() or "Exchange" in made.executedPlan().toString():
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 0 < made.toRdd().getNumPartitions() < cores else df


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once for each application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    here = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="vantloom-py-")) / "vantloom.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, p.relative_to(here.parent))
    sc.addPyFile(str(target))
    _shipped.add(sc.applicationId)


def ship_active() -> None:
    """``ship`` for the session in use, where only a Column is at hand."""
    ship(SparkSession.active())


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def ship_file(spark: SparkSession, path: str) -> str:
    """Send a file to every executor, once for each application, and give the name that ``shipped_file`` takes."""
    sc = spark.sparkContext
    if (sc.applicationId, path) not in _files:
        sc.addFile(path)
        _files.add((sc.applicationId, path))
    return path.rstrip("/").rsplit("/", 1)[-1]


_files: set[tuple[str, str]] = set()


def shipped_file(name: str) -> str:
    """Where a worker finds a file that ``ship_file`` sent."""
    return SparkFiles.get(name)
