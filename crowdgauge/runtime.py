"""Session set-up and reliable pinning of intermediate results."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


#: Whether an execution deletes its shuffle files when it ends.
CLEAR = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def session(app: str = "crowdgauge", master: str | None = None, partitions: int | None = None):
    """A session with the settings every job of this library relies on."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master is not None:
        builder = builder.master(master).config("spark.driver.memory", "8g")
    if partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    spark = builder.getOrCreate()
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the workers, whose own path may not hold it; once per application."""
    context = spark.sparkContext
    if getattr(context, "_crowdgauge_shipped", False):
        return
    package = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="crowdgauge-package-")
    archive = shutil.make_archive(
        f"{folder}/crowdgauge", "zip", root_dir=package.parent, base_dir=package.name
    )
    context.addPyFile(archive)
    context._crowdgauge_shipped = True


def is_local(spark: SparkSession) -> bool:
    """Driver and executors are one process and share its folders."""
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session.

    Only a local session gets a private folder where none is set. Executors of a cluster cannot see
    the driver's folders, so there a missing setting is an error.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current is None:
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if configured is None and not is_local(spark):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(configured or tempfile.mkdtemp(prefix="crowdgauge-checkpoint-"))
        current = context.getCheckpointDir()
    return current


@contextmanager
def clearing(spark: SparkSession) -> Iterator[None]:
    """What runs inside deletes its shuffle files as soon as it ends, not when the driver collects garbage."""
    held = spark.conf.get(CLEAR, None)
    spark.conf.set(CLEAR, "true")
    try:
        yield
    finally:
        if held is None:
            spark.conf.unset(CLEAR)
        else:
            spark.conf.set(CLEAR, held)


def pin(df: DataFrame, codec: str | None = None) -> DataFrame:
    """Write a result to the shared checkpoint folder and read it back.

    This cuts lineage, so a lost executor costs no recomputation and values such as partition ids
    never change between two reads. Being a written table it also brings its true size, so small
    intermediate results join by broadcast and large ones do not. Its shuffles leave no files.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/pinned-{uuid.uuid4().hex}"
    writer = df.write if codec is None else df.write.option("compression", codec)
    with clearing(df.sparkSession):
        writer.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._pinned_path = path
    return back


def unpin(*pinned: DataFrame | Iterable[DataFrame]) -> None:
    """Delete what ``pin`` wrote; only for results that no later plan reads."""
    for df in pinned:
        path = getattr(df, "_pinned_path", None)
        if path is not None:
            spark = df.sparkSession
            there = spark._jvm.org.apache.hadoop.fs.Path(path)
            there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)
            df._pinned_path = None


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
