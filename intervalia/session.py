"""Session defaults for local runs; on a cluster the caller's session is used as it is."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str | int = "*", memory: str = "8g", **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("intervalia")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.warehouse.dir", os.environ.get("INTERVALIA_WAREHOUSE", "/tmp/intervalia-warehouse"))
    )
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where none is named and all run on this machine."""
    if not (where := spark.conf.get("spark.checkpoint.dir", None)):
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="intervalia-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def stash(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends here, and sizes are known."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers once a context, for those that can't import it from a path."""
    sc = spark.sparkContext
    if getattr(sc, "_intervalia_shipped", False):
        return
    here = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="intervalia-src-")  # executors may fetch the file later
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with zipfile.ZipFile(z := f"{folder}/intervalia-src.zip", "w") as f:
        for p in sorted(here.rglob("*.py")):
            f.write(p, p.relative_to(here.parent))
    sc.addPyFile(z)
    sc._intervalia_shipped = True
