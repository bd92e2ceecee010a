"""Token ids in files of separately compressed documents with a shared dictionary."""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import slices
from .encoders import encoder, vocabulary
from .store import input_partitions, shared_dir

#: Documents that the dictionary is trained on, and bytes of their texts: expected
#: numbers that are the same for tables of any size. Its own size in bytes.
TRAIN_DOCS, TRAIN_BYTES, DICTIONARY = 4096, 16_000_000, 65_536
#: Ids of a document come to the trainer in parts of so many bytes, all of them.
TRAIN_PART = 4096
#: Expected number of sampled places by which documents are dealt out in order.
SAMPLE = 16_384
#: A file is closed at this many bytes of compressed ids.
FILE_BYTES = 8_000_000

MAGIC = b"TIDZ\x01\x00\x00\x00"
HEAD = struct.Struct("<8sQII")  # magic, dictionary hash, documents, bytes of the dictionary's name field (0)

FILES = T.StructType(
    [
        T.StructField("part", T.IntegerType()),
        T.StructField("number", T.IntegerType()),
        T.StructField("first_id", T.LongType()),
        T.StructField("last_id", T.LongType()),
        T.StructField("ids_before", T.LongType()),
        T.StructField("n_ids", T.LongType()),
        T.StructField("file", T.BinaryType()),
    ]
)
FRAMES = T.StructType(
    [
        T.StructField("part", T.IntegerType()),
        T.StructField("doc_id", T.LongType()),
        T.StructField("serial", T.LongType()),
        T.StructField("n_ids", T.LongType()),
        T.StructField("frame", T.BinaryType()),
    ]
)


def dictionary_hash(dictionary: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(dictionary)


def pack_file(doc_ids: list[int | None], frames: list[bytes], dict_hash: int) -> bytes:
    """Header, offset index, document ids with a null mark, then the frames.

    The index holds n + 1 offsets from the first frame, so the k-th document is
    read and decompressed alone.
    """
    offsets = np.zeros(len(frames) + 1, dtype="<u8")
    np.cumsum([len(f) for f in frames], out=offsets[1:])
    known = np.array([d is not None for d in doc_ids], dtype="u1")
    ids = np.array([d or 0 for d in doc_ids], dtype="<i8")
    head = HEAD.pack(MAGIC, dict_hash, len(frames), 0)
    return b"".join([head, offsets.tobytes(), ids.tobytes(), known.tobytes(), *frames])


class IdFile:
    """One file opened for reading by position."""

    def __init__(self, data: bytes, dictionary: bytes):
        import zstandard

        magic, dict_hash, n, _ = HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token id file")
        if dict_hash != dictionary_hash(dictionary):
            raise ValueError("the file was written with another dictionary")
        self.data, self.n = data, n
        at = HEAD.size
        self.offsets = np.frombuffer(data, "<u8", n + 1, at)
        ids = np.frombuffer(data, "<i8", n, at + 8 * (n + 1))
        known = np.frombuffer(data, "u1", n, at + 8 * (2 * n + 1))
        self.doc_ids = [int(d) if k else None for d, k in zip(ids, known, strict=True)]
        self.frames = at + 8 * (2 * n + 1) + n
        zdict = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.unzip = zstandard.ZstdDecompressor(dict_data=zdict)

    def __getitem__(self, k: int) -> bytes:
        """Ids of the k-th document as little-endian unsigned 16-bit integers."""
        a, b = self.frames + int(self.offsets[k]), self.frames + int(self.offsets[k + 1])
        return self.unzip.decompress(self.data[a:b])


def train_dictionary(rows: DataFrame, count: int, size: int, path: str, end_id: int) -> bytes:
    """A dictionary trained on the ids of whole documents, drawn by a hash of their rows.

    About TRAIN_DOCS documents, or as many as have TRAIN_BYTES, whatever the
    table's size. With too few or too short ones for the trainer it is empty,
    and documents are compressed without one.
    """
    import zstandard

    share = min(1.0, TRAIN_DOCS / max(1, count), TRAIN_BYTES / max(1, size))
    drawn = rows.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < int(share * (1 << 30)))
    end = np.array([end_id], "<u2").tobytes()

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([x + end for x in encoder(path)(batch.column(0).to_pylist())], pa.binary())], names=["ids"])

    found = sorted(bytes(r["ids"]) for r in drawn.select("text").mapInArrow(ids, "ids binary").collect())
    parts = [x[k : k + TRAIN_PART] for x in found for k in range(0, len(x), TRAIN_PART)]
    try:
        return zstandard.train_dictionary(DICTIONARY, parts).as_bytes()
    except zstandard.ZstdError:
        return b""


def _place(doc: int | None, serial: int) -> tuple[bool, int, int]:
    """What documents are ordered by: null ids first, then ids, then the order of reading."""
    return doc is not None, doc or 0, serial


def _splitters(rows: DataFrame, size: int, parts: int) -> list[tuple]:
    """Places that cut the ordered documents into parts of about equal bytes; about SAMPLE rows are looked at."""
    chance = F.pmod(F.xxhash64("serial"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    times = F.floor((F.coalesce(F.octet_length("text"), F.lit(0)) + 1) * F.lit(SAMPLE / max(1, size)) + chance)
    drawn = rows.select("doc_id", "serial", times.cast("int").alias("times")).where("times > 0").collect()
    drawn = sorted((_place(r["doc_id"], r["serial"]), r["times"]) for r in drawn)
    sums = np.cumsum([t for _, t in drawn]) if drawn else np.array([])
    at = np.searchsorted(sums, [k * sums[-1] / parts for k in range(1, parts)]) if drawn else []
    return sorted({drawn[k][0] for k in at})


def write_id_files(
    df: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer_path: str | None = None,
    end_id: int = 1,
    level: int = 1,
) -> None:
    """Write all texts' ids under ``path``, in ascending id order, and the dictionary beside them.

    Texts are encoded and compressed where they are read; only the compressed
    documents are dealt out, by sampled places of about equal bytes, so many
    rows of one id are split like any others. Spark's own writer stores the
    files, one a row, so a task that is run again replaces its output and any
    shared file system will do. Parts, and files within them, follow the ids.

    Null or empty text: ``end_id`` alone. A very long text is one document like
    any other, in a file of its own size. Null ids come first. Rows with the
    same id are neighbours. An empty table writes no file.
    """
    import zstandard

    tokenizer_path = tokenizer_path or vocabulary("word_bpe_49k.json")
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.withColumn("serial", F.monotonically_increasing_id())
    size = F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1)
    count, size = rows.agg(F.count("*"), F.coalesce(size, F.lit(0))).first()
    dictionary = train_dictionary(rows, count, size, tokenizer_path, end_id)
    dict_hash = dictionary_hash(dictionary)
    splitters = _splitters(rows, size, input_partitions(rows))

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path)
        zdict = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        if zdict:
            zdict.precompute_compress(level=level)
        zip_ = zstandard.ZstdCompressor(level=level, dict_data=zdict).compress
        end = np.array([end_id], "<u2").tobytes()
        for batch in batches:
            docs, texts, serials = (batch.column(k).to_pylist() for k in range(3))
            for lo, hi in slices(texts):
                ids = [x + end for x in encode(texts[lo:hi])]
                parts = [bisect_right(splitters, _place(d, s)) for d, s in zip(docs[lo:hi], serials[lo:hi], strict=True)]
                columns = (parts, docs[lo:hi], serials[lo:hi], [len(x) // 2 for x in ids], [zip_(x) for x in ids])
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=FRAMES.names)

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, before = None, 0, 0
        doc_ids, frames, size, n_ids = [], [], 0, 0

        def closed() -> pa.RecordBatch:
            known = [d for d in doc_ids if d is not None] or [None]
            row = [[part], [number], [known[0]], [known[-1]], [before], [n_ids], [pack_file(doc_ids, frames, dict_hash)]]
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], names=FILES.names)

        for batch in batches:
            for now, doc, n, frame in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3, 4)), strict=True):
                if frames and (now != part or size >= FILE_BYTES):
                    yield closed()
                    number, before = number + 1, before + n_ids
                    doc_ids, frames, size, n_ids = [], [], 0, 0
                if now != part:
                    part, number, before = now, 0, 0
                doc_ids.append(doc)
                frames.append(frame)
                size += len(frame)
                n_ids += n
        if frames:
            yield closed()

    dealt = rows.mapInArrow(compress, FRAMES).repartitionById(len(splitters) + 1, F.col("part"))
    ordered = dealt.sortWithinPartitions("part", "doc_id", "serial")
    ordered.mapInArrow(files, FILES).write.option("compression", "uncompressed").parquet(f"{path}/files")
    kept = df.sparkSession.createDataFrame([(bytearray(dictionary),)], "dictionary binary")
    kept.coalesce(1).write.parquet(f"{path}/dictionary")


def read_dictionary(spark: SparkSession, path: str) -> bytes:
    """The dictionary of the files under ``path``; DICTIONARY bytes at most."""
    return bytes(spark.read.parquet(f"{path}/dictionary").first()["dictionary"])


def read_documents(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """doc_id and ids (an array) of the documents asked for, each decompressed alone from its file."""
    dictionary, wanted = read_dictionary(spark, path), set(doc_ids)
    near = F.lit(False)
    for doc in wanted:
        near = near | ((F.col("first_id") <= doc) & (F.col("last_id") >= doc))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                opened = IdFile(data, dictionary)
                at = [k for k, d in enumerate(opened.doc_ids) if d in wanted]
                ids = [np.frombuffer(opened[k], "<u2").tolist() for k in at]
                docs = pa.array([opened.doc_ids[k] for k in at], pa.int64())
                yield pa.RecordBatch.from_arrays([docs, pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    found = spark.read.schema(FILES).parquet(f"{path}/files").where(near)
    return found.select("file").mapInArrow(run, "doc_id long, ids array<int>")


def read_id_files(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """A row for each document in the files: its id, start, n_tokens and ids_crc32.

    ``start`` counts the ids of all documents before it. Each file knows the
    ids before it in its part; parts are summed in a table of one row for each
    part.
    """
    dictionary = read_dictionary(spark, path)
    files = spark.read.schema(FILES).parquet(f"{path}/files")
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    earlier = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("part_start"))
    fields = T.StructType(
        [
            T.StructField(id_col, T.LongType()),
            T.StructField("start", T.LongType()),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("ids_crc32", T.LongType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                opened = IdFile(data, dictionary)
                counts, crcs = [], []
                for k in range(opened.n):
                    ids = np.frombuffer(opened[k], "<u2").astype("<u4")
                    counts.append(len(ids))
                    crcs.append(zlib.crc32(ids.tobytes()))
                starts = start + np.concatenate([[0], np.cumsum(counts)[:-1]]).astype("i8")
                columns = [pa.array(opened.doc_ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(crcs, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=fields.names)

    # As many rows as parts, which the writer takes from the session's shuffle partitions.
    opened = files.join(F.broadcast(parts), "part")
    return opened.select((F.col("part_start") + F.col("ids_before")).alias("start"), "file").mapInArrow(run, fields)


def id_files_path(spark: SparkSession) -> str:
    """A new folder under the shared one."""
    import uuid

    return f"{shared_dir(spark)}/token-ids-{uuid.uuid4().hex}"
