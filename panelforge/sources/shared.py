"""Files in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; in local mode, where it is unset, a temporary one."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        path = spark.conf.get("spark.checkpoint.dir", None)
        if path is None:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            path = tempfile.mkdtemp(prefix="spark-checkpoint-")
        sc.setCheckpointDir(path)
    return sc._jsc.sc().getCheckpointDir().get()


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own below the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: later plans read the rows back from shared storage.

    Spark removes the files of a checkpoint that nothing refers to any more where
    spark.cleaner.referenceTracking.cleanCheckpoints is set.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def _file_system(spark: SparkSession, path: str) -> tuple:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def remove_folder(spark: SparkSession, path: str) -> None:
    fs, where = _file_system(spark, path)
    fs.delete(where, True)


def list_folder(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none where it doesn't exist."""
    fs, where = _file_system(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []


def _address(uri: object) -> str:
    """An address that Spark and Arrow both read."""
    return f"file://{uri.getPath()}" if uri.getScheme() in (None, "file") else uri.toString()


def make_folder(spark: SparkSession, path: str) -> str:
    """Make a folder where there is none; its full address."""
    fs, where = _file_system(spark, path)
    fs.mkdirs(where)
    return _address(fs.makeQualified(where).toUri())


def list_files(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Full paths and sizes of the files below a path, in order, without hidden ones."""
    fs, where = _file_system(spark, path)
    found, out = fs.listFiles(where, True), []
    while found.hasNext():
        status = found.next()
        name = status.getPath().getName()
        if not name.startswith((".", "_")):
            out.append((_address(status.getPath().toUri()), status.getLen()))
    return sorted(out)


def read_text(spark: SparkSession, path: str) -> str:
    """A small file."""
    fs, where = _file_system(spark, path)
    stream = fs.open(where)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_once(spark: SparkSession, path: str, text: str) -> None:
    """A small file that appears as a whole, by one rename; an error where there is one of that name."""
    jvm, draft = spark._jvm, f"{path}.{uuid.uuid4().hex}.draft"
    fs, where = _file_system(spark, path)
    fs.mkdirs(where.getParent())
    stream = fs.create(jvm.org.apache.hadoop.fs.Path(draft))
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(jvm.org.apache.hadoop.fs.Path(fs.makeQualified(jvm.org.apache.hadoop.fs.Path(draft)).toString()), fs.makeQualified(where), none)


def rename_parts(spark: SparkSession, folder: str, name: str) -> None:
    """Give the part files of folder/<column>=<value> directories, one each, names of their own: name with {} for the value."""
    fs, where = _file_system(spark, folder)
    for directory in fs.listStatus(where):
        if directory.isDirectory():
            value = directory.getPath().getName().partition("=")[2]
            for part in fs.listStatus(directory.getPath()):
                if part.getPath().getName().startswith("part-"):
                    fs.rename(part.getPath(), spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name.format(value)}"))
            fs.delete(directory.getPath(), True)
