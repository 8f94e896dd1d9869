"""Session settings and lineage cutting shared by the operators."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from tieout.errors import TieoutError


def build_session(master: str = "local[8]", app: str = "tieout", shuffle_partitions: int = 8,
                  driver_memory: str = "8g") -> SparkSession:
    """A session for local work. On a cluster pass your own session to the operators."""
    return (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", driver_memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder named by ``spark.checkpoint.dir``; make one only for a local master."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        context.setCheckpointDir(configured)
        return
    if not context.master.startswith("local"):
        raise TieoutError(
            "spark.checkpoint.dir is unset: name a folder every executor can reach"
        )
    context.setCheckpointDir(tempfile.mkdtemp(prefix="tieout-checkpoint-"))


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application, so that it need not lie on their path."""
    if spark.sparkContext.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="tieout-code-")) / "tieout.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for source in sorted((root / "tieout").rglob("*.py")):
            archive.write(source, source.relative_to(root))
    spark.sparkContext.addPyFile(str(target))
    _SHIPPED.add(spark.sparkContext.applicationId)


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint folder, removed when the session ends."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    _file_system(spark, folder).deleteOnExit(spark._jvm.org.apache.hadoop.fs.Path(folder))
    return folder


def write_scratch(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate frame to the shared folder and read it back, so that later steps
    reread it after a loss instead of computing it again."""
    folder = scratch_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def drop_scratch(df: DataFrame) -> None:
    """Delete the files of a frame from ``write_scratch`` that nothing reads any more."""
    spark = df.sparkSession
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        _file_system(spark, folder).delete(spark._jvm.org.apache.hadoop.fs.Path(folder), True)


def _file_system(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the frame to the shared checkpoint folder, so later steps reread it after a loss."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
