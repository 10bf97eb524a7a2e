"""Sessions, and the shipping of this package to executors."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

_shipped: dict[str, bool] = {}


def session(name: str = "postmill", cores: str = "*", partitions: int = 8) -> SparkSession:
    """A local session with the settings the library expects."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Only a session in a single process, as in tests, may do without the setting; on a
    cluster that names no folder this raises."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.fullmatch(r"local(\[[^\[\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="postmill-")
        atexit.register(shutil.rmtree, where.removeprefix("file://"), True)
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder. All paths of an application are in one folder, which is deleted when its driver exits."""
    folder = f"{shared_dir(spark)}/postmill-{spark.sparkContext.applicationId}"
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package: once for each application, it is sent along as a zip file."""
    app = spark.sparkContext.applicationId
    if _shipped.get(app):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="postmill-"), "postmill_package.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, dirs, files in os.walk(here):
            dirs[:] = [d for d in dirs if d != "__pycache__"]
            for f in files:
                if f.endswith((".py", ".npz")):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(here)))
    spark.sparkContext.addPyFile(path)
    _shipped[app] = True
