"""Groups and nodes of output in a folder: tables that are replaced as a whole, also while they are read.

A node is a folder of versions, each a Parquet table of its own, and a file that names the current one. A write makes
a new version beside the old ones and swaps that file last, in one rename, so a reader has the old table or the new
one, and a write that fails leaves the old one. What a plan has begun to read stays until ``clean``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

CURRENT = "current.version"


class Group:
    """A folder of nodes and of further groups, whose parents are made with it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        if CURRENT in self._names():  # a node of this name gives way to the group
            self._delete("")

    def _at(self, name: str = ""):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}".rstrip("/"))

    def _fs(self):
        return self._at().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, name: str = "") -> list[str]:
        fs, at = self._fs(), self._at(name)
        return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []

    def _delete(self, name: str) -> None:
        self._fs().delete(self._at(name), True)

    def _put(self, name: str, content: str) -> None:
        """A small file, complete from the moment it has its name."""
        fs, half = self._fs(), self._at(f"{name}.{uuid.uuid4().hex}")
        out = fs.create(half, True)
        try:
            out.write(bytearray(content.encode()))
        finally:
            out.close()
        jvm = self.spark._jvm
        over = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(half.toUri(), self.spark._jsc.hadoopConfiguration()).rename(half, self._at(name), over)

    def group(self, name: str) -> Group:
        return Group(self.spark, f"{self.path}/{name}")

    def write(self, node: str, df: DataFrame) -> DataFrame:
        """Makes or replaces a node and gives its table; ``df`` may read the node that it replaces."""
        if (own := self._names(node)) and CURRENT not in own:
            raise ValueError(f"{node} is a group")
        version = f"v-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{node}/{version}")
        self._put(f"{node}/{CURRENT}", version)
        return self.read(node)

    def current(self, node: str) -> str:
        if CURRENT not in self._names(node):
            raise KeyError(node)
        return self.spark.read.text(f"{self.path}/{node}/{CURRENT}").first()[0]

    def read(self, node: str) -> DataFrame:
        """The current version; later writes do not change what this plan reads."""
        return self.spark.read.parquet(f"{self.path}/{node}/{self.current(node)}")

    def empty(self, node: str, schema: str) -> DataFrame:
        """Makes or replaces a node without rows."""
        return self.write(node, self.spark.createDataFrame([], schema))

    def nodes(self) -> list[str]:
        return [n for n in self._names() if CURRENT in self._names(n)]

    def groups(self) -> list[str]:
        return [n for n in self._names() if n not in self.nodes() and self._fs().getFileStatus(self._at(n)).isDirectory()]

    def clean(self, node: str) -> None:
        """Deletes the versions that are not current, when nothing reads them any more."""
        keep = {CURRENT, self.current(node)}
        for name in self._names(node):
            if name not in keep:
                self._delete(f"{node}/{name}")
