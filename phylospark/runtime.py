"""Session-level helpers: shared storage for cut lineages, and size-checked broadcasts."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side may be sent to every executor. A row here has a key and a few numbers.
BROADCAST_ROWS = 200_000

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or in local mode a new temporary folder."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if conf:
        return conf.rstrip("/")
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get().rstrip("/")
    if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="phylospark-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that is not yet used, deleted by `clean`."""
    path = f"{shared_dir(spark)}/phylospark/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df once as a table in the shared folder and read it back; lost executors cost nothing then."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def long_values(df: DataFrame) -> DataFrame:
    """The frame itself, of rows with megabytes each. From now on the session's Parquet writers look at the size of a page after each row; by default
    they hold 100 rows before they look first, and a packed copy of these."""
    df.sparkSession.conf.set("parquet.page.size.row.check.min", "1")
    return df


def filesystem(spark: SparkSession, path: str):
    """Hadoop's file system and path object of a path."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its file system, as Hadoop resolves it, so that all who use it mean the same file; without a scheme if that is the local one."""
    fs, p = filesystem(spark, path)
    return re.sub("^file:/+", "/", fs.makeQualified(p).toString())


def names_in(spark: SparkSession, folder: str) -> list[str]:
    """Names of what is in a folder, sorted; none if it does not exist."""
    fs, p = filesystem(spark, folder)
    return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []


def delete(spark: SparkSession, path: str) -> None:
    fs, p = filesystem(spark, path)
    fs.delete(p, True)


def read_text(spark: SparkSession, path: str) -> str | None:
    """The text of a small file, None if it does not exist."""
    fs, p = filesystem(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_new(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file that must not exist yet: under another name first, then renamed, so that it is there as a whole or not at all."""
    fs, p = filesystem(spark, path)
    _, part = filesystem(spark, f"{path}.{uuid.uuid4().hex}.part")
    stream = fs.create(part, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    if fs.exists(p) or not fs.rename(part, p):
        fs.delete(part, False)
        raise FileExistsError(path)


def clean() -> None:
    """Delete the tables that `materialize` wrote. Frames that read them end with it, so call it between jobs of a long session; it runs when Python ends."""
    for spark, path in _written:
        try:
            fs, p = filesystem(spark, path)
            fs.delete(p, True)
        except Exception:  # the session may have ended before
            pass
    _written.clear()


atexit.register(clean)


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether df has at most so many rows. Reads no more than one row beyond."""
    return df.select(F.lit(1)).limit(rows + 1).count() <= rows
