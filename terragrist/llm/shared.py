"""Tables written to the folder that driver and executors share, in place of cached or local state.

A written table survives the loss of any executor and cuts the lineage of what is read from it.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, a local session (as in tests) gets a temporary folder; on a cluster it is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = getattr(spark.sparkContext, "_terragrist_folder", None) or tempfile.mkdtemp(prefix="terragrist-")
        spark.sparkContext._terragrist_folder = folder
    return folder.rstrip("/")


def free() -> None:
    """Lets Spark clear the shuffle files of finished steps, which it does once their plans are gone."""
    gc.collect()
    session = SparkSession.getActiveSession()
    if session is not None:
        session._jvm.System.gc()


#: Bytes of text that Spark hands to Python at once.
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches of this session by bytes: whole texts in batches of 10,000 rows take several copies of 64 MB a task on either side."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def boxed(docs: DataFrame, *apart: str, **marks: Column) -> DataFrame:
    """The rows of `docs` as one column `doc`, beside columns of the operator's own, so that no name can clash, whatever characters it has. Columns `apart` stay beside it."""
    inside = [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns if c not in apart]
    return docs.select(F.struct(*inside).alias("doc"), *apart, *[c.alias(name) for name, c in marks.items()])


def unboxed(rows: DataFrame, columns: list[str], *apart: str) -> DataFrame:
    """The columns that boxed() was given, in their order."""
    return rows.select(*[F.col(c) if c in apart else F.col("doc").getField(c).alias(c) for c in columns])


class Scratch:
    """Intermediate tables of one operator call, under one folder of their own."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        path = spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        self._fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.deleteOnExit(path)
        self._written: set[str] = set()

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write and reread; the schema is given, so that an empty table reads as well."""
        path = f"{self.folder}/{name}"
        self._written.add(name)
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            self._written.discard(name)
            self._fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}"), True)

    def drop_all_but(self, *names: str) -> None:
        """Deletes every other table that this operator call has written."""
        self.drop(*[n for n in self._written if n not in names])
