"""Token-id files whose document boundaries are Elias-Fano coded.

One file holds the ids of its documents end to end, in ascending order of document id, then two
coded sequences, the end of each document in ids and the document ids, then a trailer of fixed
size. A monotone sequence of n values below u keeps ``floor(log2(u / n))`` low bits of each value
as they are and the rest in unary: about 2 + log2(u / n) bits a value. Every 256th one bit of the
unary part has its position in a table of 32-bit numbers, so any offset is found by looking at a
few bytes, without a table of 64-bit offsets. Reading selects the offsets of a stretch of documents
from the bytes between the samples around it; no sequence is decoded as a whole.

Null texts count as empty: such a document has its end id only. Rows with a null document id come
first. Ids are integers; others are cast to long as Spark casts them. Rows with the same id are ordered by a hash of the text; equal rows are all written. An
empty table gives no file. Columns other than the two named are not read.
"""

from __future__ import annotations

import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm import bpe
from tickloom.llm.common import opened, pieces, publish, stored, work_folder

MAGIC = b"TKEF0001"
SAMPLE = 256
#: magic's number, id width, documents, ids, null document ids, least document id, bytes of both codes
TRAILER = np.dtype([(n, "<i8") for n in ("magic", "width", "docs", "ids", "nulls", "least", "ends", "keys")])
MANIFEST = "shard int, file string, docs long, ids long"
#: Ids read at a time.
READ_IDS = 1 << 20
#: Bytes of the five numbers before a coded sequence.
HEADER = 40
#: Documents whose offsets are selected at a time, in one task of a read, and in a file at most.
LOOKED_UP, READ_DOCS, FILE_DOCS = 4096, 1 << 16, 1 << 18


@dataclass
class EliasFano:
    """A monotone sequence of non-negative integers."""

    n: int
    low_bits: int
    low: np.ndarray
    high: np.ndarray
    samples: np.ndarray

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        top = int(values[-1]) + 1 if n else 1
        low_bits = max(0, (top // max(n, 1)).bit_length() - 1)
        lows = (values[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)
        ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        marks = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        marks[ones] = 1
        return cls(
            n,
            low_bits,
            np.packbits(lows.astype(np.uint8).ravel(), bitorder="little"),
            np.packbits(marks, bitorder="little"),
            ones[::SAMPLE].astype("<u4"),
        )

    def to_bytes(self) -> bytes:
        sizes = np.array([self.n, self.low_bits, len(self.low), len(self.high), len(self.samples)], "<i8")
        return b"".join(x[:].tobytes() for x in (sizes, self.low, self.high, self.samples))

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        return cls.stored(lambda begin, end: data[begin:end])

    @classmethod
    def stored(cls, read: Callable[[int, int], bytes]) -> EliasFano:
        """The sequence behind ``read(begin, end)``; only looked-up bytes are read."""
        n, low_bits, low, high, samples = np.frombuffer(read(0, HEADER), "<i8").tolist()
        at = np.cumsum([HEADER, low, high, samples * 4]).tolist()
        low, high = (Stretch(read, b, e, np.dtype(np.uint8)) for b, e in zip(at, at[1:3], strict=False))
        return cls(n, low_bits, low, high, Stretch(read, at[2], at[3], np.dtype("<u4")))

    def lows(self, begin: int, end: int) -> np.ndarray:
        first = begin * self.low_bits
        bits = np.unpackbits(self.low[first // 8 : -(-end * self.low_bits // 8)], bitorder="little")
        bits = bits[first % 8 :][: (end - begin) * self.low_bits].reshape(end - begin, self.low_bits)
        return (bits.astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(1, dtype=np.uint64)

    def select(self, begin: int, end: int) -> np.ndarray:
        """The values at ``begin`` to ``end``: the samples around them bound the bits to look at."""
        if begin >= end:
            return np.empty(0, np.uint64)
        first = begin // SAMPLE
        around = self.samples[first : (end - 1) // SAMPLE + 2].astype(np.int64)
        bounded = len(around) > (end - 1) // SAMPLE + 1 - first
        at = int(around[0]) // 8
        bits = np.unpackbits(self.high[at : int(around[-1]) // 8 + 1 if bounded else None], bitorder="little")
        ones = np.flatnonzero(bits) + at * 8
        ones = ones[ones >= around[0]][begin - first * SAMPLE : end - first * SAMPLE]
        return (ones - np.arange(begin, end)).astype(np.uint64) << np.uint64(self.low_bits) | self.lows(begin, end)


class Stretch:
    """An array in a file, read where it is sliced."""

    def __init__(self, read: Callable[[int, int], bytes], begin: int, end: int, dtype: np.dtype) -> None:
        self.read, self.begin, self.dtype = read, begin, dtype
        self.n = (end - begin) // dtype.itemsize

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, part: slice) -> np.ndarray:
        begin, end, _ = part.indices(self.n)
        width = self.dtype.itemsize
        return np.frombuffer(self.read(self.begin + begin * width, self.begin + max(begin, end) * width), self.dtype)


class TokenFile:
    """One file, opened for reading."""

    def __init__(self, path: str) -> None:
        files, self.path = opened(path)
        self.source = files.open_input_file(self.path)
        size = self.source.size()
        (self.trailer,) = np.frombuffer(self.source.read_at(TRAILER.itemsize, size - TRAILER.itemsize), TRAILER)
        if int(self.trailer["magic"]).to_bytes(8, "little") != MAGIC:
            raise ValueError(f"not a token file: {path}")
        self.dtype = f"<u{self.trailer['width']}"
        self.docs, self.nulls, self.least = (int(self.trailer[n]) for n in ("docs", "nulls", "least"))
        keys = size - TRAILER.itemsize - int(self.trailer["keys"])
        self.keys, self.ends = EliasFano.stored(self.part(keys)), EliasFano.stored(self.part(keys - int(self.trailer["ends"])))

    def part(self, at: int) -> Callable[[int, int], bytes]:
        return lambda begin, end: self.source.read_at(end - begin, at + begin)

    def ids(self, begin: int, end: int) -> np.ndarray:
        width = int(self.trailer["width"])
        return np.frombuffer(self.source.read_at((end - begin) * width, begin * width), self.dtype)

    def offsets(self, first: int, last: int) -> np.ndarray:
        """Where documents ``first`` to ``last`` begin, and where the last of them ends."""
        ends = self.ends.select(max(first - 1, 0), last).astype(np.int64)
        return ends if first else np.concatenate([[0], ends])

    def doc_ids(self, first: int, last: int) -> list[int | None]:
        nulls = max(0, min(last, self.nulls) - first)
        keys = self.keys.select(max(first - self.nulls, 0), max(last - self.nulls, 0))
        return [None] * nulls + [self.least + k for k in keys.tolist()]

    def documents(self, first: int = 0, last: int | None = None) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """Document id, first id and ids of documents ``first`` to ``last``, a block of the file at a time."""
        last = self.docs if last is None else last
        for at in range(first, last, LOOKED_UP):
            stop = min(at + LOOKED_UP, last)
            places = self.offsets(at, stop).tolist()
            held, base = np.empty(0, self.dtype), places[0]
            for key, begin, end in zip(self.doc_ids(at, stop), places, places[1:], strict=False):
                if end > base + len(held):
                    base, held = begin, self.ids(begin, max(end, min(begin + READ_IDS, places[-1])))
                yield key, begin, held[begin - base : end - base]


def write(
    docs: DataFrame,
    folder: str,
    vocabulary: bpe.Vocabulary,
    end_id: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    files: int | None = None,
) -> DataFrame:
    """Write the files and return the stored list of them: shard, file, docs, ids.

    Documents are range-partitioned by id, one file a partition: ``files`` of them, or as many as
    the session's shuffle partitions, or one for each ``FILE_DOCS`` rows where that is more. A
    repeated attempt replaces its own file.
    """
    if files is None:
        needed = -(-docs.count() // FILE_DOCS)
        files = needed if needed > int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) else None
    source = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    by = [F.col("doc_id").asc_nulls_first()]
    ranged = source.repartitionByRange(*([files] if files else []), *by)
    ordered = ranged.sortWithinPartitions(*by, F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = bpe.encoder(vocabulary)
        end = np.array([end_id], use.dtype).tobytes()
        shard = TaskContext.get().partitionId()
        place, root = opened(folder)
        place.create_dir(root, recursive=True)
        name, ends, keys, nulls, total, out = f"part-{shard:06d}.ids", array("q"), array("q"), 0, 0, None
        draft = f"{root}/.{name}.{uuid.uuid4().hex}"
        for batch in pieces(batches, "text"):
            out = out or place.open_output_stream(draft)
            for key, text in zip(batch[0].to_pylist(), batch[1].to_pylist(), strict=True):
                ids = use.encode(text or "") + end
                out.write(ids)
                total += len(ids) // len(end)
                ends.append(total)
                if key is None:
                    nulls += 1
                else:
                    keys.append(key)
        if out is None:
            return
        least = keys[0] if keys else 0
        codes = [EliasFano.of(ends).to_bytes(), EliasFano.of(np.array(keys, object) - least).to_bytes()]
        magic = int.from_bytes(MAGIC, "little")
        trailer = np.array([(magic, len(end), len(ends), total, nulls, least, *map(len, codes))], TRAILER)
        for part in (*codes, trailer.tobytes()):
            out.write(part)
        out.close()
        publish(place, draft, f"{root}/{name}")
        row = {"shard": [shard], "file": [f"{folder}/{name}"], "docs": [len(ends)], "ids": [total]}
        yield pa.RecordBatch.from_pydict(row, pa.schema([("shard", pa.int32()), ("file", pa.string()), ("docs", pa.int64()), ("ids", pa.int64())]))

    return stored(ordered.mapInArrow(run, MANIFEST), "token-files")


def read(listing: DataFrame) -> DataFrame:
    """Per document of the listed files: doc_id, start (over all files), n_tokens, ids_crc32.

    A file is read in stretches of ``READ_DOCS`` documents by any number of tasks; offsets and ids of
    a stretch come from select. The only ordered step is over the list of files, one row each.
    """
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    based = listing.withColumn("base", F.coalesce(F.sum("ids").over(before), F.lit(0)))
    firsts = F.sequence(F.lit(0).cast("long"), F.col("docs") - 1, F.lit(READ_DOCS).cast("long"))
    stretches = based.select("file", "base", "docs", F.explode(firsts).alias("first"))
    stretches = stretches.withColumn("last", F.least(F.col("first") + READ_DOCS, "docs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base, first, last in zip(*(batch[n].to_pylist() for n in ("file", "base", "first", "last")), strict=True):
                rows: list[tuple] = []
                for key, begin, ids in TokenFile(path).documents(first, last):
                    rows.append((key, base + begin, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                names = ("doc_id", "start", "n_tokens", "ids_crc32")
                columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    count = listing.agg(F.sum(F.ceil(F.col("docs") / READ_DOCS))).first()[0]
    spread = stretches.drop("docs").repartition(max(1, int(count or 0)))
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def write_and_read(docs: DataFrame, vocabulary: bpe.Vocabulary, end_id: int) -> DataFrame:
    """Documents through files in the shared folder and back."""
    return read(write(docs, work_folder(docs.sparkSession, "ids"), vocabulary, end_id))
