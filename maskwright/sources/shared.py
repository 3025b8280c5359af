"""Files in the storage that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir.

    Only on one machine (a local master, as in tests) may the session name
    none; then a temporary one is made and kept for the application.
    """
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or _own.get(context.applicationId)
    if not root:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = _own[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="maskwright-")
    return root.rstrip("/")


def fresh(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """``df`` computed once, into the shared folder, for several readers; a streaming ``df`` as it is."""
    if df.isStreaming:
        return df
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_root(df.sparkSession))
    return df.checkpoint()


class Folder:
    """A folder of small files, through Hadoop's file systems."""

    def __init__(self, spark: SparkSession, path: str):
        self.context = spark.sparkContext
        self.jvm = self.context._jvm
        self.root = self.jvm.org.apache.hadoop.fs.Path(path)
        self.fs = self.root.getFileSystem(self.context._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(self.root, name)

    def names(self) -> list[str]:
        if not self.fs.exists(self.root):
            return []
        return sorted(f.getPath().getName() for f in self.fs.listStatus(self.root) if not f.getPath().getName().startswith("."))

    def read(self, name: str) -> str | None:
        if not self.fs.exists(self._at(name)):
            return None
        stream = self.fs.open(self._at(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Publish a new file with its whole text at once; False where another writer's stands already.

        On HDFS and its like by a rename that never replaces; on a mounted disk
        by a link, as Hadoop's own checks there leave a gap between two writers.
        """
        self.fs.mkdirs(self.root)
        made, final = self._at(f".{name}-{uuid.uuid4().hex}"), self._at(name)
        stream = self.fs.create(made, False)
        try:
            stream.write(bytearray(text, "utf-8"))
        finally:
            stream.close()
        try:
            if self.fs.getScheme() == "file":
                os.link(made.toUri().getPath(), final.toUri().getPath())
            else:
                rename = self.jvm.org.apache.hadoop.fs.Options.Rename
                options = self.context._gateway.new_array(rename, 1)
                options[0] = rename.NONE
                self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.root.toUri(), self.context._jsc.hadoopConfiguration()).rename(made, final, options)
        except Exception:
            if self.fs.exists(final):
                return False
            raise
        finally:
            self.fs.delete(made, False)
        return True
