"""Session helpers: settings for this engine, and its code on the executors."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors, once for each Spark application."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        top = Path(__file__).resolve().parent
        folder = tempfile.mkdtemp(prefix="quaerix_")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        path = os.path.join(folder, "quaerix.zip")
        with zipfile.ZipFile(path, "w") as z:
            for p in sorted(top.rglob("*.py")):
                z.write(p, p.relative_to(top.parent).as_posix())
        spark.sparkContext.addPyFile(path)
        _SHIPPED.add(app)
    return spark


def scratch(spark: SparkSession) -> str:
    """The folder shared by the driver and all executors: ``spark.checkpoint.dir``.

    Where that is unset, a temporary folder is made and set if the master is this machine; a
    cluster without a shared folder is an error, since executors would not see each other's files.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        path = held.get() if held.isDefined() else None
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="quaerix_")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        path = "file://" + folder
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


_MADE: list[tuple[SparkSession, str]] = []


def made(spark: SparkSession, path: str) -> str:
    """Note a table below the scratch folder, which is removed at exit, or by `clear_scratch`."""
    if not _MADE:
        # Not before there is a session: what is registered last runs first, while the session's JVM still answers.
        atexit.register(clear_scratch)
    _MADE.append((spark, path))
    return path


def clear_scratch() -> None:
    """Remove the tables that were made in the scratch folder, once no result is read any more."""
    while _MADE:
        spark, path = _MADE.pop()
        try:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001  the session has ended; names are unique, so what lies there on this machine is ours
            shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)


def settled(df: DataFrame, name: str) -> DataFrame:
    """*df* written to the scratch folder and read back: what was long to plan, or is needed several times, is a table of plain columns after that."""
    path = made(df.sparkSession, f"{scratch(df.sparkSession)}/quaerix/{name}-{uuid.uuid4().hex}")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def local_session(cpus: str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session on this machine, for tests and the benchmark."""
    return (
        SparkSession.builder.master(f"local[{cpus}]").appName("quaerix")
        .config("spark.sql.shuffle.partitions", str(partitions)).config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory).config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
