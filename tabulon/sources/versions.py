"""Small named states that are switched in one step, also by several writers.

The state of a name is the file with the highest number in the name's folder.  A
writer reads the state, prepares the next one and creates the file of the next
number only if there is none; if another writer was first, it starts again from
that writer's state.  A file appears whole or not at all, so a crash leaves the
old state or the new one.

Creating a file only if it is absent is one step on the file systems that such
a folder lives on: a hard link on a local disk, a rename that does not overwrite
on HDFS, a conditional write in an object store."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: older states that are kept for readers still at work
KEPT = 8
_RENAMING = ("hdfs", "viewfs", "webhdfs")


class Conflict(Exception):
    """Another writer was first each time."""


class Versions:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        sc = self.spark.sparkContext
        p = sc._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(sc._jsc.hadoopConfiguration())

    def _numbers(self, name: str) -> list[int]:
        folder, fs = self._fs(f"{self.root}/{name}")
        if not fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def _file(self, name: str, number: int) -> str:
        return f"{self.root}/{name}/{number:012d}.json"

    def latest(self, name: str) -> tuple[int, dict | None]:
        """Number and state, (0, None) if there is none."""
        numbers = self._numbers(name)
        if not numbers:
            return 0, None
        path, fs = self._fs(self._file(name, numbers[-1]))
        stream = fs.open(path)
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return numbers[-1], json.loads(text)

    def put(self, name: str, number: int, state: dict) -> bool:
        """Make ``state`` the one of that number; False if there is one already."""
        sc = self.spark.sparkContext
        path, fs = self._fs(self._file(name, number))
        fs.mkdirs(path.getParent())
        content = bytearray((json.dumps(state) + "\n").encode())
        scheme = fs.makeQualified(path).toUri().getScheme()
        if scheme not in ("file", *_RENAMING):
            return self._created(fs, path, content)
        draft, _ = self._fs(f"{self.root}/{name}/.{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(content)
        out.close()
        try:
            if scheme == "file":
                at = lambda p: sc._jvm.java.io.File(p.toUri().getPath()).toPath()
                sc._jvm.java.nio.file.Files.createLink(at(path), at(draft))
            else:
                context = sc._jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), sc._jsc.hadoopConfiguration())
                never = sc._gateway.new_array(getattr(sc._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
                context.rename(draft, path, never)
        except Exception as e:  # noqa: BLE001 - py4j wraps all Java errors alike
            if "FileAlreadyExists" not in str(e):
                raise
            return False
        finally:
            if fs.exists(draft):
                fs.delete(draft, False)
        return True

    @staticmethod
    def _created(fs, path, content: bytearray) -> bool:
        try:
            out = fs.create(path, False)
            out.write(content)
            out.close()
        except Exception as e:  # noqa: BLE001
            if "FileAlreadyExists" not in str(e):
                raise
            return False
        return True

    def change(self, name: str, next_state: Callable[[dict | None], dict], attempts: int = 100) -> dict:
        """Switch to ``next_state(state)``; called again with the newer state
        whenever another writer was first."""
        for _ in range(attempts):
            number, state = self.latest(name)
            new = next_state(state)
            if self.put(name, number + 1, new):
                self._forget(name, number + 1)
                return new
        raise Conflict(f"{name}: {attempts} writers were faster")

    def _forget(self, name: str, number: int) -> None:
        for old in self._numbers(name):
            if old < number - KEPT:
                path, fs = self._fs(self._file(name, old))
                fs.delete(path, False)

    def all(self, schema: str) -> DataFrame:
        """The states of all names as rows of ``schema``."""
        root, fs = self._fs(self.root)
        if not fs.exists(root):
            return self.spark.createDataFrame([], schema)
        if not fs.getFileStatus(root).isDirectory():
            raise ValueError(f"{self.root} is no folder of states")
        rows = (self.spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(self.root)
                .select("*", F.col("_metadata.file_path").alias("_file")))
        columns = [c for c in rows.columns if c != "_file"]
        folder, number = F.regexp_replace("_file", "/[^/]*$", ""), F.regexp_extract("_file", r"/(\d+)\.json$", 1).cast("long")
        newest = rows.groupBy(folder.alias("_folder")).agg(F.max_by(F.struct(*columns), number).alias("s"))
        return newest.select("s.*")
