"""Session settings the jobs rely on."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: dict[str, str] = {}
_RUNS: list[str] = []


def build_session(app: str = "speechtables", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC time, adaptive execution and Arrow transfer switched on.

    Cluster settings (memory, shuffle partitions, checkpoint folder) stay with the submitter;
    ``conf`` adds or overrides single settings.
    """
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The shared checkpoint folder: the one the cluster names in ``spark.checkpoint.dir``.

    Only a session on one machine (``local[...]``) may lack that setting; it gets a folder of its own.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not named and not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="speechtables-checkpoint-"))
    return context.getCheckpointDir()


def ship_package(spark: SparkSession) -> None:
    """Give the package to the workers, once per application, wherever the driver was started."""
    context = spark.sparkContext
    if _SHIPPED.get("application") == context.applicationId:
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="speechtables-package-")) / "speechtables-package.zip"  # read by the driver only
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    context.addPyFile(str(archive))
    _SHIPPED["application"] = context.applicationId


def run_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared one, for the files of one run."""
    folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _RUNS.append(folder)
    return folder


def remove_run_folders(spark: SparkSession) -> int:
    """Delete the run folders this driver has made; call it when no result is read from them any more."""
    removed = 0
    while _RUNS:
        path = spark._jvm.org.apache.hadoop.fs.Path(_RUNS.pop())
        removed += bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
    return removed


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: worked out once, read by every later step."""
    path = run_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
