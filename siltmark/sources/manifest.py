"""A numbered list of the folders a table consists of.

Writers put rows into a folder of their own and publish a new version of the list; readers open only folders
of the newest version. A version is a small file that appears at once (write aside, rename without
overwriting), so a job that breaks off between any two steps changes nothing that readers see, and of two
writers that publish the same number one starts again from the other's list.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

Entry = dict[str, Any]
LISTS = "_list"


class Manifest:
    """The versions below ``path``; entries are dictionaries with a ``folder`` relative to ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._conf = spark._jsc.hadoopConfiguration()
        self._root = self._hadoop.Path(f"{path}/{LISTS}")
        self._files = self._root.getFileSystem(self._conf)

    def _versions(self) -> list[int]:
        if not self._files.exists(self._root):
            return []
        names = [f.getPath().getName() for f in self._files.listStatus(self._root)]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def _file(self, version: int):
        return self._hadoop.Path(f"{self.path}/{LISTS}/v{version:012d}.json")

    def latest(self) -> tuple[int, list[Entry]]:
        """Number and entries of the newest version; 0 and none before the first."""
        versions = self._versions()
        if not versions:
            return 0, []
        stream = self._files.open(self._file(versions[-1]))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return versions[-1], json.loads(text)

    def publish(self, change: Callable[[list[Entry]], list[Entry] | None]) -> bool:
        """Replace the newest list by ``change`` of it; False where ``change`` gives None (nothing to do)."""
        while True:
            version, entries = self.latest()
            after = change(entries)
            if after is None:
                return False
            if self._appear(version + 1, json.dumps(after)):
                return True

    def _appear(self, version: int, text: str) -> bool:
        aside = self._hadoop.Path(f"{self.path}/{LISTS}/.{uuid.uuid4().hex}")
        stream = self._files.create(aside, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        rename = getattr(self._hadoop, "Options$Rename")
        keep = self.spark.sparkContext._gateway.new_array(rename, 1)
        keep[0] = rename.NONE
        try:
            self._hadoop.FileContext.getFileContext(self._root.toUri(), self._conf).rename(aside, self._file(version), keep)
            return True
        except Exception as e:
            self._files.delete(aside, False)
            if "FileAlreadyExistsException" in str(e):
                return False
            raise

    def new_folder(self, label: str) -> str:
        return f"rows/{label}-{uuid.uuid4().hex}"

    def stage(self, df: DataFrame, label: str) -> str:
        """Write rows to a folder that no version lists yet; its relative name."""
        folder = self.new_folder(label)
        df.write.parquet(f"{self.path}/{folder}")
        return folder

    def read(self, folders: list[str], schema: str | StructType | None = None) -> DataFrame:
        """The rows of the given folders; ``schema`` serves where there are none."""
        if not folders:
            if schema is None:
                raise FileNotFoundError(f"nothing is listed in {self.path}")
            return self.spark.createDataFrame([], schema)
        reader = self.spark.read.schema(schema) if schema else self.spark.read.option("mergeSchema", True)
        return reader.parquet(*[f"{self.path}/{f}" for f in folders])

    def vacuum(self, hours: float = 24.0, keep: int = 20) -> list[str]:
        """Delete folders that the newest list does not name and old versions, all last changed ``hours`` ago or before.

        The margin protects jobs under way: staged folders not yet listed and readers of an older version.
        """
        versions, (_, entries) = self._versions(), self.latest()
        listed = {e[k] for e in entries for k in e if isinstance(e[k], str) and e[k].startswith("rows/")}
        limit = self.spark._jvm.java.lang.System.currentTimeMillis() - int(hours * 3_600_000)
        rows = self._hadoop.Path(f"{self.path}/rows")
        gone = []
        for f in self._files.listStatus(rows) if self._files.exists(rows) else []:
            name = f"rows/{f.getPath().getName()}"
            if name not in listed and f.getModificationTime() <= limit:
                self._files.delete(f.getPath(), True)
                gone.append(name)
        for v in versions[:-keep]:
            self._files.delete(self._file(v), False)
        return gone
