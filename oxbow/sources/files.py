"""A folder of a Hadoop file system: small files read and created exclusively, digests, and tables staged in the cluster's shared folder."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


class Files:
    """The files of one folder, by name, whatever file system it is on.

    A name is taken once: publish() fails if it is there.  A rename without overwriting is atomic on HDFS, a hard link on a
    local disk; stores without an atomic rename need a committer of their own.  Small files on a local disk don't go through the JVM.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.Path = self.jvm.org.apache.hadoop.fs.Path
        self.fs = self.Path(folder).getFileSystem(conf)
        self.root = self.fs.makeQualified(self.Path(folder))
        self.context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.root.toUri(), conf)
        self.local, self.folder = self.root.toUri().getScheme() == "file", self.root.toUri().getPath()
        self.fs.mkdirs(self.root)

    def at(self, name: str):
        return self.Path(self.root, name)

    def _here(self, name: str) -> str:
        """The path on a local disk of a name, or of a whole path."""
        return self.at(name).toUri().getPath() if ":" in name else os.path.join(self.folder, name)

    def uri(self, name: str) -> str:
        return self.at(name).toString()

    def exists(self, name: str) -> bool:
        return os.path.exists(self._here(name)) if self.local else self.fs.exists(self.at(name))

    def names(self, pattern: str) -> list[str]:
        """The names that fit a glob, sorted; those that begin with a dot only if it does."""
        found = self.fs.globStatus(self.at(pattern))
        return sorted(f.getPath().getName() for f in found or [])

    def read(self, name: str) -> bytes:
        if self.local:
            with open(self._here(name), "rb") as f:
                return f.read()
        stream = self.fs.open(self.at(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def digest(self, name: str) -> str:
        """SHA-256 of a file, read as a stream."""
        stream = self.fs.open(self.at(name))
        try:
            return f"sha256:{self.jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(stream)}"
        finally:
            stream.close()

    def publish(self, made: str, name: str) -> None:
        """Gives a finished file its name; FileExistsError if that is taken."""
        if self.local:
            os.makedirs(os.path.dirname(self._here(name)), exist_ok=True)
            os.link(self._here(made), self._here(name))
            return
        self.fs.mkdirs(self.at(name).getParent())
        if self.exists(name):
            raise FileExistsError(name)
        try:
            self.context.rename(self.at(made), self.at(name), self.jvm.java.lang.reflect.Array.newInstance(self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0))
        except Exception as e:
            if self.exists(name):
                raise FileExistsError(name) from e
            raise

    def create(self, name: str, content: bytes) -> None:
        """A new file with content, seen whole or not at all; FileExistsError if the name is taken."""
        made = f".new-{uuid.uuid4().hex}"
        if self.local:
            with open(self._here(made), "xb") as f:
                try:
                    f.write(content)
                    f.flush()
                    self.publish(made, name)
                finally:
                    os.unlink(self._here(made))
            return
        stream = self.fs.create(self.at(made), False)
        try:
            stream.write(bytearray(content))
        finally:
            stream.close()
        try:
            self.publish(made, name)
        finally:
            self.delete(made)

    def delete(self, name: str) -> None:
        self.fs.delete(self.at(name), True)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; on a local master without it a temporary one."""
    sc = spark.sparkContext
    if at := sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir():
        return at
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="oxbow-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df computed once and cut from its lineage, in the shared folder, so that it survives lost executors."""
    spark = df.sparkSession
    at = shared_folder(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(at)
    return df.checkpoint()


_folders: list[tuple[SparkSession, str]] = []


def delete_at_end(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of intermediate tables when the driver ends."""
    _folders.append((spark, folder))


@atexit.register
def _delete() -> None:
    for spark, folder in _folders:
        sc = spark.sparkContext
        if sc._jsc is not None and not sc._jsc.sc().isStopped():
            at = sc._jvm.org.apache.hadoop.fs.Path(folder)
            at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)
