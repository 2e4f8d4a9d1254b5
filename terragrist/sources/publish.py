"""Writing datasets whole or not at all, and the folder for tables that queries write on their way."""

from __future__ import annotations

import json
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession


def file_system(spark: SparkSession, path: str):
    """(file system, path object) of the store that a path stands in."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def publish(
    df: DataFrame, path: str, *, mode: str = "errorifexists", compression: str = "zstd", partition_by: tuple[str, ...] = (), accept: Callable[[], None] | None = None, save: Callable[[DataFrameWriter, str], None] | None = None
) -> DataFrame:
    """Writes Parquet beside `path` and moves it there in one step, so that readers see all of it or nothing. Gives what was written.

    `mode`: errorifexists or overwrite. `accept` is called when all is written and before it is moved; if it raises, what was written goes. `save`: writes
    to a folder in another way than Parquet files by partition.
    """
    if mode not in ("errorifexists", "overwrite"):
        raise ValueError("mode must be errorifexists or overwrite")
    spark, path = df.sparkSession, path.rstrip("/")
    fs, at = file_system(spark, path)
    if mode == "errorifexists" and fs.exists(at):
        raise FileExistsError(path)
    beside = f"{path}.{uuid.uuid4().hex}.part"
    _, there = file_system(spark, beside)
    try:
        writer = df.write.option("compression", compression)
        if save is not None:
            save(writer, beside)
        else:
            (writer.partitionBy(*partition_by) if partition_by else writer).parquet(beside)
        if accept is not None:
            accept()
        if mode == "overwrite":
            fs.delete(at, True)
        if not fs.rename(there, at):
            raise OSError(f"{beside} could not be moved to {path}")
    finally:
        if fs.exists(there):
            fs.delete(there, True)
    return spark.read.schema(df.schema).parquet(path)


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder for one call, in spark.checkpoint.dir, which driver and executors share; deleted with the session.

    Where that is unset, a local session gets a temporary folder; on a cluster it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="terragrist-")
    folder = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    fs, at = file_system(spark, folder)
    fs.mkdirs(at)
    fs.deleteOnExit(at)
    return folder


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """One small file, through the file system of its store."""
    fs, at = file_system(spark, path)
    stream = fs.create(at, True)
    try:
        stream.write(bytearray(data))
    finally:
        stream.close()


def read_bytes(spark: SparkSession, path: str) -> bytes:
    """One small file, through the file system of its store."""
    fs, at = file_system(spark, path)
    stream = fs.open(at)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()


LAYOUT = "_layout.json"


def bucketed(spark: SparkSession, buckets: int, column: str) -> Callable[[DataFrameWriter, str], None]:
    """A way to save() a table in so many files by a hash of `column`, each sorted by it, with a note of the layout beside them."""

    def save(writer: DataFrameWriter, path: str) -> None:
        name = f"terragrist_{uuid.uuid4().hex}"
        writer.bucketBy(buckets, column).sortBy(column).format("parquet").option("path", path).saveAsTable(name)
        spark.sql(f"DROP TABLE {name}")  # the files stay
        write_bytes(spark, f"{path}/{LAYOUT}", json.dumps({"buckets": buckets, "column": column, "id": name}).encode())

    return save


def read_bucketed(spark: SparkSession, path: str, column: str) -> DataFrame:
    """A table saved by bucketed(), with its layout known to Spark, so that joins and groups by `column` read it where it is.

    The layout is checked before it is trusted: its note must name `column`, and every file must belong to one of the buckets, with one file a bucket at most.
    Raises ValueError otherwise.
    """
    path = path.rstrip("/")
    try:
        said = json.loads(read_bytes(spark, f"{path}/{LAYOUT}"))
    except Exception as e:
        raise ValueError(f"{path} has no note of its layout") from e
    if said["column"] != column:
        raise ValueError(f"{path} is laid out by {said['column']}, not by {column}")
    fs, at = file_system(spark, path)
    names = [f.getPath().getName() for f in fs.listStatus(at)]
    found = [re.search(r"_(\d{5})(?:\.c\d+)?\.[a-z0-9.]*parquet$", n) for n in names if n.startswith("part-")]
    numbers = [int(m[1]) for m in found if m]
    if len(numbers) < len(found) or len(set(numbers)) < len(numbers) or any(n >= said["buckets"] for n in numbers):
        raise ValueError(f"the files of {path} are not its {said['buckets']} buckets")
    ddl = spark.read.parquet(path).schema.toDDL()
    name, where = f"{said['id']}_read", path.replace("'", "\\'")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({ddl}) USING parquet CLUSTERED BY ({column}) SORTED BY ({column}) INTO {said['buckets']} BUCKETS LOCATION '{where}'")
    return spark.table(name)
