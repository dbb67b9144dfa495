"""Small state in a folder on any of the cluster's file systems: numbered commits, each of which only one writer can make."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Folder:
    """A folder reached through Hadoop's file systems."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.conf = spark._jsc.hadoopConfiguration()
        root = self._at()
        self.fs = root.getFileSystem(self.conf)
        self.context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf)

    def _at(self, name: str = ""):  # noqa: ANN202
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, folder: str = "") -> list[str]:
        """The names in the folder, sorted; none if it doesn't exist."""
        at = self._at(folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self._at(name))
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """A file that isn't there yet; False if it is. It is written aside and renamed without overwriting, so it appears whole, and of two writers one fails."""
        target, aside = self.fs.makeQualified(self._at(name)), self.fs.makeQualified(self._at(f"_aside/{uuid.uuid4().hex}"))
        out = self.fs.create(aside, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        self.fs.mkdirs(target.getParent())
        gateway = self.spark.sparkContext._gateway
        plain = gateway.new_array(getattr(gateway.jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            self.context.rename(aside, target, plain)
        except Py4JJavaError as e:
            self.fs.delete(aside, False)
            if "FileAlreadyExistsException" in str(e.java_exception):
                return False
            raise
        return True

    def delete(self, name: str = "") -> None:
        self.fs.delete(self._at(name), True)


class Commits:
    """A state (JSON) with a history of numbered commits under `_commits`. Who read commit n may make commit n + 1, unless another has."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.folder = Folder(spark, path)

    def last(self) -> tuple[int, dict]:
        """The number and state of the last commit; (0, {}) before the first."""
        names = [n for n in self.folder.names("_commits") if n.endswith(".json") and not n.startswith(".")]
        return (int(names[-1].removesuffix(".json")), json.loads(self.folder.read(f"_commits/{names[-1]}"))) if names else (0, {})

    def make(self, number: int, state: dict) -> bool:
        """Commit `number`; False if it has been made."""
        return self.folder.create(f"_commits/{number:012d}.json", json.dumps(state))
