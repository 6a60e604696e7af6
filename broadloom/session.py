"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and the bench; on a cluster use the session the cluster gives."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("broadloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        # wide plans: do not record the Python call site of every column expression
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", memory)
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor sees, as the cluster names it in ``spark.checkpoint.dir``.

    Only a local session may do without the setting: there a folder below the warehouse is used, which is the
    same for all of its threads.
    """
    folder = spark.conf.get("spark.checkpoint.dir", "")
    if not folder:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_stages"
    return folder.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def releasing_shuffles(spark: SparkSession) -> Iterator[None]:
    """Within it, a write releases the shuffle files of its plan when it ends, for jobs of many stages."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back.

    Cuts the lineage like a checkpoint and survives the loss of any executor. The copy is parquet, so
    later readers still prune columns, push filters down and get ``count()`` from file footers.
    """
    return _written(df, shared_path(df.sparkSession, name))


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return _read(df, path)


def _read(df: DataFrame, path: str) -> DataFrame:
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def discard(*stages: DataFrame) -> None:
    """Remove stages that nothing reads any more; other tables are left alone."""
    for df in stages:
        if (path := getattr(df, "staged_at", None)) is not None:
            _remove(df.sparkSession, path)


def _file_system(spark: SparkSession, path: str):
    """The folder as its file system sees it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _remove(spark: SparkSession, path: str) -> None:
    fs, at = _file_system(spark, path)
    fs.delete(at, True)


class StageRegistry:
    """Stages of a named job that a later run of the job finds again.

    A stage lies under the job's folder by its name and the fingerprint of what it was made from, and counts once its
    write has ended. A run that asks for a finished stage reads it; a stage of the same name with another fingerprint is
    removed once the new one is written, so a name never holds more than one. :meth:`release` removes a stage when it
    is consumed, :meth:`close` all of them.
    """

    def __init__(self, spark: SparkSession, job: str):
        self.spark, self.folder = spark, f"{shared_folder(spark)}/jobs/{job}"

    def keep(self, name: str, df: DataFrame, version: str = "") -> DataFrame:
        """The table as a stage, written unless a finished one has the same fingerprint."""
        path = f"{self.folder}/{name}/{fingerprint(df, version)}"
        fs, at = _file_system(self.spark, f"{path}/_SUCCESS")
        if fs.exists(at):
            return _read(df, path)
        written = _written(df, path)
        for entry in self._entries(name):
            if not path.endswith("/" + entry):
                _remove(self.spark, f"{self.folder}/{name}/{entry}")
        return written

    def finished(self) -> dict[str, str]:
        """The fingerprint of each finished stage by name."""
        done = {}
        for name in self._entries(""):
            for entry in self._entries(name):
                fs, at = _file_system(self.spark, f"{self.folder}/{name}/{entry}/_SUCCESS")
                if fs.exists(at):
                    done[name] = entry
        return done

    def release(self, name: str) -> None:
        _remove(self.spark, f"{self.folder}/{name}")

    def close(self) -> None:
        _remove(self.spark, self.folder)

    def _entries(self, name: str) -> list[str]:
        fs, at = _file_system(self.spark, f"{self.folder}/{name}" if name else self.folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def fingerprint(df: DataFrame, version: str = "") -> str:
    """A digest of a table's plan, schema and input files (names, sizes, times).

    What Python functions do and rows that came from the driver are not seen: ``version`` stands for them.
    """
    spark = df.sparkSession
    plan = df._jdf.queryExecution().analyzed().canonicalized().toString()
    seen = [version, df.schema.json(), plan]
    for name in sorted(df.inputFiles()):
        fs, at = _file_system(spark, name)
        status = fs.getFileStatus(at)
        seen.append(f"{name}|{status.getLen()}|{status.getModificationTime()}")
    return hashlib.sha256("\n".join(seen).encode()).hexdigest()[:32]
