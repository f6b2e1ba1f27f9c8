"""Documents of flat token files, found by their end-of-document ids.

A flat file is ids end to end, each document followed by the end id, with no header or index. Files
are cut into blocks of a fixed number of ids. A task looks for the end id in a block with one
vector comparison and returns the positions. A document that began in an earlier block starts
after the last end id of the blocks before: a running maximum over the blocks of a file, one row
a block. The same scan numbers the documents.

An end id at once after another is a document of no ids. Ids after the last end id are a document
with ``closed`` false. Empty files hold none. Files are independent and each block is one row, so
a large file is spread over as many tasks as it has blocks.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.llm import bpe
from tickloom.llm.common import opened, pieces, publish, stored

#: Ids in a block.
BLOCK = 1 << 20


def write_flat(
    docs: DataFrame, folder: str, vocabulary: bpe.Vocabulary, end_id: int, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Write one flat file a partition; returns the stored rows file, ordinal, doc_id of what went in.

    Null texts are empty documents, null ids stay null and repeated rows are all written.
    """
    source = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = bpe.encoder(vocabulary)
        end = np.array([end_id], use.dtype).tobytes()
        place, root = opened(folder)
        place.create_dir(root, recursive=True)
        name, out, done = f"part-{TaskContext.get().partitionId():06d}.bin", None, 0
        draft = f"{root}/.{name}.{uuid.uuid4().hex}"
        for batch in pieces(batches, "text"):
            out = out or place.open_output_stream(draft)
            for text in batch[1].to_pylist():
                out.write(use.encode(text or "") + end)
            n = batch.num_rows
            columns = [pa.array([name] * n), pa.array(range(done, done + n), pa.int64()), batch[0]]
            yield pa.RecordBatch.from_arrays(columns, names=["file", "ordinal", "doc_id"])
            done += n
        if out is not None:
            out.close()
            publish(place, draft, f"{root}/{name}")

    return stored(source.mapInArrow(run, "file string, ordinal long, doc_id long"), "flat-listing")


def scan(spark: SparkSession, folder: str, end_id: int, width: int = 2, block: int = BLOCK) -> DataFrame:
    """Documents of all flat files of a folder: file, ordinal, start, n_tokens, closed."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(folder)
    blocks = files.select(
        F.element_at(F.split("path", "/"), -1).alias("file"),
        F.col("path"),
        (F.col("length") / width).cast("long").alias("ids"),
    ).where("ids > 0")
    last = F.ceil(F.col("ids") / block) - 1
    blocks = blocks.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                place, path = opened(row["path"])
                begin = row["block"] * block
                stop = min(begin + block, row["ids"])
                with place.open_input_file(path) as source:
                    ids = np.frombuffer(source.read_at((stop - begin) * width, begin * width), f"<u{width}")
                ends = np.flatnonzero(ids == end_id) + begin
                columns = [[row["file"]], [row["block"]], [ends.tolist()], [stop]]
                kinds = (pa.string(), pa.int64(), pa.list_(pa.int64()), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["file", "block", "ends", "stop"]
                )

    found = blocks.repartition("file", "block").mapInArrow(run, "file string, block long, ends array<long>, stop long")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = found.select(
        "*",
        F.coalesce(F.max(F.try_element_at("ends", F.lit(-1))).over(before), F.lit(-1)).alias("end_before"),
        F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0)).alias("docs_before"),
        F.lead("block").over(Window.partitionBy("file").orderBy("block")).isNull().alias("is_last"),
    )
    tail = F.coalesce(F.try_element_at("ends", F.lit(-1)), F.col("end_before")) + 1
    closing = F.when(F.col("is_last") & (tail < F.col("stop")), F.array("stop")).otherwise(F.array().cast("array<long>"))
    each = carried.select(
        "file",
        "docs_before",
        F.posexplode(
            F.arrays_zip(
                F.concat("ends", closing).alias("end"),
                F.concat(F.array("end_before"), "ends").alias("before"),
                F.concat(F.transform("ends", lambda _: F.lit(True)), F.transform(closing, lambda _: F.lit(False))).alias("closed"),
            )
        ).alias("k", "x"),
    ).where("x.end IS NOT NULL")
    return each.select(
        "file",
        (F.col("docs_before") + F.col("k")).alias("ordinal"),
        (F.col("x.before") + 1).alias("start"),
        (F.col("x.end") - F.col("x.before") - 1).alias("n_tokens"),
        F.col("x.closed").alias("closed"),
    )
