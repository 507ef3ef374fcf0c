"""Tables and files in the folder that driver and executors share.

The folder is the one named in ``spark.checkpoint.dir``.  Only in a local
session (tests) without that setting a temporary folder is made; a cluster
without it is an error, since executors would write to their own disks.
"""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
#: Rows of an Arrow batch: with texts of a few thousand bytes the usual 10,000 fill a worker and the JVM's buffers.
ARROW_ROWS, ARROW_BYTES = 1000, "16m"


def bounded_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches to ``ARROW_ROWS`` rows; queries and stages over texts call it."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= ARROW_ROWS:
        spark.conf.set(name, ARROW_ROWS)
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)


def shared_dir(spark: SparkSession) -> str:
    """URI of the shared folder; set once per session where the cluster names none."""
    found = spark.conf.get(_SETTING, "") or spark.sparkContext.getConf().get(_SETTING, "")
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError(f"{_SETTING} must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set(_SETTING, found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/barlake-{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again.

    Later actions start from the written table, so a lost executor costs a
    reread and not the work above it.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    schema = df.schema
    df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._stored_at = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Removes tables made by ``stored`` that nothing reads any more."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table._stored_at)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


class SharedFile:
    """A file that a task writes under a name of its own and that gets its name when it is complete.

    A lost, repeated or doubled task therefore never leaves a part of a file
    under the name that readers use.
    """

    def __init__(self, uri: str):
        self.fs, self.path = pa.fs.FileSystem.from_uri(uri)
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.part = f"{self.path}.{uuid.uuid4().hex[:12]}"
        self.out = self.fs.open_output_stream(self.part)

    def write(self, data: bytes) -> None:
        self.out.write(data)

    def close(self) -> None:
        self.out.close()
        if not isinstance(self.fs, pa.fs.LocalFileSystem) and self.fs.get_file_info(self.path).type == pa.fs.FileType.File:
            self.fs.delete_file(self.path)  # of an earlier attempt; elsewhere the move replaces it
        self.fs.move(self.part, self.path)
