"""How tables are read, and where those go that queries write on their way."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def spread(df: DataFrame) -> DataFrame:
    """A table in fewer splits than there are cores is dealt out before costly work; larger ones stay."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under that of spark.checkpoint.dir, which driver and executors share.  In local mode without the setting it is one
    of this process, deleted at its end; a cluster without the setting gets an error."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="lodeseek-"))
            atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
        top = f"file://{_own[0]}"
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"
