"""Working folders and Arrow batch helpers shared by the operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rule ``[^\x20\x09-\x0D]+``, as a Java pattern.
SPACES = r"[\x20\x09-\x0D]+"
NOT_SPACES = r"[^\x20\x09-\x0D]+"


def work_folder(spark: SparkSession, label: str) -> str:
    """A new folder name under the shared folder of ``spark.checkpoint.dir``.

    Where the setting is absent and the master local, as in tests, a temporary folder is made and
    set once; elsewhere executors would not see it, and that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset and the master is not local")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: lineage ends here."""
    spark = df.sparkSession
    path = work_folder(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_folder(spark: SparkSession, path: str) -> None:
    """Remove a working table that no later step reads."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


class Scratch:
    """Working tables that are removed together once what was made from them is stored."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, []

    def stored(self, df: DataFrame, label: str) -> DataFrame:
        path = work_folder(self.spark, label)
        self.paths.append(path)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        for path in self.paths:
            drop_folder(self.spark, path)


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, for tasks that write or read plain files."""
    if ":/" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def publish(files: fs.FileSystem, draft: str, final: str) -> None:
    """Name a finished file; an earlier attempt's file of that name has the same content."""
    if files.get_file_info(final).type != fs.FileType.NotFound:
        files.delete_file(final)
    files.move(draft, final)


def byte_texts(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """The texts as UTF-8 bytes, null as empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def pieces(batches: Iterable[pa.RecordBatch], column: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut where the bytes of ``column`` pass ``most``; every row comes once, whole."""
    for batch in batches:
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch[column]), 0).to_pylist()
        begin, held = 0, 0
        for i, size in enumerate(sizes):
            if held and held + size > most:
                yield batch.slice(begin, i - begin)
                begin, held = i, 0
            held += size
        if begin < batch.num_rows:
            yield batch.slice(begin)


def words(text: Column) -> Column:
    """Number of words of the word rule; null counts none."""
    return F.coalesce(F.regexp_count(text, F.lit(NOT_SPACES)), F.lit(0)).cast("long")
