"""Session helpers."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def share_package(spark: SparkSession) -> None:
    """Lets Python workers on this machine import the package wherever the driver was started.

    On a cluster the package is shipped with the job (``--py-files``); the path then names nothing and does no harm.
    """
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(":") if p]
    if ROOT not in paths:
        environment["PYTHONPATH"] = ":".join([*paths, ROOT])


_LOCAL_ROOTS: dict[str, str] = {}


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``; below a temporary one only where that is unset on a local master."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _LOCAL_ROOTS:
            _LOCAL_ROOTS[app] = "file://" + tempfile.mkdtemp(prefix="tideline-")
        root = _LOCAL_ROOTS[app]
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def local_session(cpus: int = 8, **conf: str) -> SparkSession:
    settings = {
        "spark.sql.shuffle.partitions": str(cpus),
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.sql.adaptive.enabled": "true",
    } | conf
    spark = SparkSession.builder.master(f"local[{cpus}]").appName("tideline").config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    share_package(spark)
    return spark
