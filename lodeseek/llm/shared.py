"""What the operators of this folder have in common: tables written to the shared folder, joins with hot keys."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key of more than one of so many rows is hot.
HOT_SHARE = 10_000
#: So many rows of a key are never hot.
LEAST_HOT = 100

_own_folders: dict[str, str] = {}
_written: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Where the setting is absent (tests in local mode) a folder of this process takes its place;
    a cluster without the setting gets an error, as executors would not see such a folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own_folders:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        _own_folders[app] = tempfile.mkdtemp(prefix="lodeseek-")
        atexit.register(shutil.rmtree, _own_folders[app], ignore_errors=True)
    return f"file://{_own_folders[app]}"


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back: later jobs neither recompute it nor
    depend on the executor that made it."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release_all_but_last(spark: SparkSession, since: int) -> None:
    """Deletes the tables that stash has written from number since (as written() gave it) on, but for the last one."""
    for path in _written[since:-1]:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    del _written[since:-1]


def written() -> int:
    """How many tables stash has written and nobody released."""
    return len(_written)


def join_counted(rows: DataFrame, keyed: DataFrame, key: str, count: str = "n", total: int | None = None) -> DataFrame:
    """The inner join of rows with keyed, without keyed's column count.  keyed has one row for each key, with the number
    of rows of it in count; both should be written tables, as they are read twice.

    Keys of more than LEAST_HOT rows and one in HOT_SHARE of all are HOT_SHARE at most, so these few rows of keyed go to
    all tasks, and the rows of a hot key stay where they are.  Only the others are dealt by key."""
    if total is None:
        total = keyed.agg(F.sum(count)).first()[0] or 0
    hot = F.col(count) > max(LEAST_HOT, total // HOT_SHARE)
    few = keyed.filter(hot).drop(count)
    here = rows.join(F.broadcast(few), key)
    there = rows.join(F.broadcast(few.select(key)), key, "left_anti").join(keyed.filter(~hot).drop(count), key)
    return here.unionByName(there)
