"""Files and folders through Spark's file systems, so that a path may lie in any store that Spark reads."""

from __future__ import annotations

import json
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

_own: list[str] = []


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder below `spark.checkpoint.dir`; where that is unset, in a local folder, if all tasks run in this process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"spark.checkpoint.dir must name a folder that the executors of {master} share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="notewell-index-"))
        root = f"file://{_own[0]}"
    return f"{root.rstrip('/')}/indexes/{name}-{uuid.uuid4().hex[:12]}"


class Folder:
    """Small text files, names and deletions below one path."""

    def __init__(self, spark: SparkSession, path: str):
        self.root = path.rstrip("/")
        self.jvm = spark._jvm
        self.fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())
        self.conf = spark._jsc.hadoopConfiguration()

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str = "") -> list[str]:
        path = self._path(folder)
        return sorted(x.getPath().getName() for x in self.fs.listStatus(path)) if self.fs.exists(path) else []

    def exists(self, name: str = "") -> bool:
        return self.fs.exists(self._path(name))

    def read(self, name: str) -> dict | None:
        """A JSON object, or None where there is none or it is damaged. Other failures to read are raised."""
        if not self.exists(name):
            return None
        stream = self.fs.open(self._path(name))
        try:
            text = self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        except Py4JJavaError as failed:
            if not failed.java_exception.getClass().getName().endswith(".ChecksumException"):
                raise
            return None
        finally:
            stream.close()
        try:
            found = json.loads(text)
        except ValueError:
            return None
        return found if isinstance(found, dict) else None

    def create(self, name: str, content: dict) -> bool:
        """Writes a new JSON file beside its place and moves it there at once; False if the name is taken already."""
        if self.exists(name):
            return False
        draft = f"_draft-{uuid.uuid4().hex}"
        stream = self.fs.create(self._path(draft), True)
        stream.write(bytearray(json.dumps(content, sort_keys=True).encode()))
        stream.close()
        self.fs.mkdirs(self._path(name).getParent())
        done = not self.exists(name) and self.fs.rename(self._path(draft), self._path(name))
        if not done:
            self.fs.delete(self._path(draft), False)
        return done

    def copy(self, name: str, to: str) -> None:
        self.jvm.org.apache.hadoop.fs.FileUtil.copy(self.fs, self._path(name), self.fs, self._path(to), False, self.conf)

    def delete(self, name: str = "") -> None:
        self.fs.delete(self._path(name), True)

    def bytes(self, name: str = "") -> int:
        return self.fs.getContentSummary(self._path(name)).getLength() if self.exists(name) else 0
