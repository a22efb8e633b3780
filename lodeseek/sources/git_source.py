"""Git as tables: what a commit holds, and what changed between two, read where the tasks run.

``git_files`` lists a commit's blobs.  Its partitions are ranges of the names in the commit's top folder, so the driver sees
these names only; each task lists what is below its own.  Filters on size and on the end of the path are left to the reader,
so that other files make no rows (files() sets spark.sql.python.filterPushdown.enabled, which Spark asks for).  ``git_changes`` has the paths that git
itself calls changed, also those of which only the mode did.  The folder must be one that all executors see."""

from __future__ import annotations

import os
import subprocess
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, StringEndsWith

from lodeseek.errors import InvalidCommitError
from lodeseek.functions.schemas import FILES

#: Names of the top folder are dealt to so many tasks at most.
MOST_TASKS = 64
CHANGES = {"A": "added", "D": "deleted"}


def _fields(folder: str, *question: str) -> Iterator[str]:
    """What git answers, cut at null bytes, without ever holding the whole."""
    with subprocess.Popen(["git", "-C", folder, *question], stdout=subprocess.PIPE, stderr=subprocess.PIPE, env=os.environ | {"GIT_LITERAL_PATHSPECS": "1"}) as git:
        rest = b""
        while block := git.stdout.read(1 << 16):
            *whole, rest = (rest + block).split(b"\0")
            for field in whole:
                yield field.decode("utf-8", "replace")
        said = git.stderr.read().decode("utf-8", "replace")
    if git.returncode:
        raise InvalidCommitError(said.strip())


@dataclass
class Names(InputPartition):
    names: list[str]


class FilesReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.folder, self.commit = options["path"], options["commit"]
        self.skipped = set(filter(None, options.get("skipped", "").split(",")))
        self.suffixes: list[str] = []
        self.bounds: list[tuple[str, int]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        kinds = {GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
        for f in filters:
            if isinstance(f, StringEndsWith) and f.attribute == ("path",):
                self.suffixes.append(f.value)
            elif type(f) in kinds and f.attribute == ("size",):
                self.bounds.append((kinds[type(f)], f.value))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        names = [n for n in _fields(self.folder, "ls-tree", "-z", "--name-only", self.commit) if n and n not in self.skipped]
        step = -(-len(names) // MOST_TASKS) or 1
        return [Names(names[i : i + step]) for i in range(0, len(names), step)] or [Names([])]

    def _fits(self, path: str, size: int) -> bool:
        compare = {">": int.__gt__, ">=": int.__ge__, "<": int.__lt__, "<=": int.__le__}
        return all(path.endswith(s) for s in self.suffixes) and all(compare[op](size, bound) for op, bound in self.bounds)

    def read(self, partition: Names) -> Iterator[tuple]:
        if not partition.names:
            return
        for entry in _fields(self.folder, "ls-tree", "-r", "-l", "-z", self.commit, "--", *partition.names):
            if entry:
                facts, path = entry.split("\t", 1)
                _, kind, blob, size = facts.split()
                if kind == "blob" and not self.skipped & set(path.split("/")) and self._fits(path, int(size)):
                    yield path, blob, int(size)


class ChangesReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.folder, self.base, self.commit = options["path"], options["base"], options["commit"]

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        fields = _fields(self.folder, "diff", "--name-status", "--no-renames", "-z", self.base, self.commit)
        for status in fields:
            if status:
                yield next(fields), CHANGES.get(status[0], "modified")


class GitFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "git_files"

    def schema(self) -> str:
        return FILES

    def reader(self, schema) -> FilesReader:
        return FilesReader(dict(self.options))


class GitChanges(DataSource):
    @classmethod
    def name(cls) -> str:
        return "git_changes"

    def schema(self) -> str:
        return "path string, change string"

    def reader(self, schema) -> ChangesReader:
        return ChangesReader(dict(self.options))


def files(spark: SparkSession, folder: str, commit: str, skipped: Iterable[str] = ()) -> DataFrame:
    """path, blob and size of a commit's files but for those in folders of the skipped names."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(GitFiles)
    return spark.read.format("git_files").options(path=folder, commit=commit, skipped=",".join(skipped)).load()


def changes(spark: SparkSession, folder: str, base: str, commit: str) -> DataFrame:
    """path and change between two commits; a rename is a deletion and an addition."""
    spark.dataSource.register(GitChanges)
    return spark.read.format("git_changes").options(path=folder, base=base, commit=commit).load()
