"""Token files: frequency-ranked ids in byte-aligned variable-length code with separate control bytes.

An id is replaced by its rank by falling corpus frequency, so that common ids take one
byte. Four ranks share a control byte (two bits each: bytes of that rank less one); control
bytes stand before the data bytes, so a reader looks up the four lengths of each control
byte in a table, sums them to data positions and gathers every rank at once in numpy.

Layout of a file, little-endian: magic ``WLTF``, version u32, documents u64, ids u64, CRC-32
of the rest u32; then doc ids i64 and a bitmap of the null ones, ids of each document u64,
control bytes, data bytes. The rank table stands beside the files in ``ranks.bin``. Files hold
consecutive ranges of ascending ``doc_id`` (null first) and are numbered in that order.

A task writes to a name that no other attempt uses; a file counts once it is in the manifest
table, which holds a row for each task that ended well.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm import vocab
from weftline.plans.scratch import materialize, new_path

MAGIC, VERSION, HEADER = b"WLTF", 1, 28
#: Ids of one file, which a task holds in memory.
IDS_PER_FILE = 4_000_000
#: Bytes of each of the four ranks of a control byte.
LENGTHS = ((np.arange(256)[:, None] >> (2 * np.arange(4))[None, :]) & 3).astype(np.uint8) + 1


def encode_ranks(ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Control bytes and data bytes of unsigned 32-bit ranks."""
    ranks = ranks.astype(np.uint32, copy=False)
    lengths = np.ones(len(ranks), np.uint8)
    for bits in (8, 16, 24):
        lengths += ranks >= (1 << bits)
    padded = np.ones(-(-len(ranks) // 4) * 4, np.uint8)
    padded[: len(ranks)] = lengths
    quads = padded.reshape(-1, 4) - 1
    control = (quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6).astype(np.uint8)
    ends = np.cumsum(lengths, dtype=np.int64)
    starts = ends - lengths
    data = np.empty(int(ends[-1]) if len(ranks) else 0, np.uint8)
    data[starts] = ranks & 255
    for k in (1, 2, 3):
        long = np.flatnonzero(lengths > k)
        if len(long):
            data[starts[long] + k] = ranks[long] >> (8 * k) & 255
    return control, data


def decode_ranks(control: np.ndarray, data: np.ndarray, count: int) -> np.ndarray:
    """The ranks of ``encode_ranks``, by table lookup of control bytes."""
    lengths = LENGTHS[control].reshape(-1)[:count]
    starts = np.cumsum(lengths, dtype=np.int64) - lengths
    ranks = data[starts].astype(np.uint32)
    for k in (1, 2, 3):
        long = np.flatnonzero(lengths > k)
        if len(long):
            ranks[long] |= data[starts[long] + k].astype(np.uint32) << np.uint32(8 * k)
    return ranks


def pack_file(doc_ids: list[int | None], lengths: np.ndarray, ranks: np.ndarray) -> bytes:
    null = np.array([d is None for d in doc_ids], bool)
    control, data = encode_ranks(ranks)
    body = b"".join(
        [
            np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
            np.packbits(null).tobytes(),
            lengths.astype("<u8").tobytes(),
            control.tobytes(),
            data.tobytes(),
        ]
    )
    head = np.array([len(doc_ids), len(ranks)], "<u8").tobytes()
    return MAGIC + np.array([VERSION], "<u4").tobytes() + head + np.array([zlib.crc32(body)], "<u4").tobytes() + body


def unpack_file(content: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Doc ids, ids of each document, and ranks. Raises ValueError for content that isn't a whole token file."""
    if content[:4] != MAGIC or int.from_bytes(content[4:8], "little") != VERSION:
        raise ValueError("not a token file of this version")
    docs, count = (int(x) for x in np.frombuffer(content, "<u8", 2, 8))
    if zlib.crc32(memoryview(content)[HEADER:]) != int.from_bytes(content[24:28], "little"):
        raise ValueError("token file is damaged")
    at = HEADER
    ids = np.frombuffer(content, "<i8", docs, at)
    at += 8 * docs
    null = np.unpackbits(np.frombuffer(content, np.uint8, -(-docs // 8), at))[:docs]
    at += -(-docs // 8)
    lengths = np.frombuffer(content, "<u8", docs, at).astype(np.int64)
    at += 8 * docs
    control = np.frombuffer(content, np.uint8, -(-count // 4), at)
    data = np.frombuffer(content, np.uint8, -1, at + len(control))
    return [None if n else int(d) for d, n in zip(ids, null, strict=True)], lengths, decode_ranks(control, data, count)


def _joined(column: pa.BinaryArray) -> np.ndarray:
    """The bytes of all values of a binary column without nulls, one after the other, without copying."""
    _, offsets, values = column.buffers()
    ends = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(values or b"", np.uint8)[ends[0] : ends[-1]] if len(column) else np.zeros(0, np.uint8)


def ranked_ids(tokens: DataFrame, vocab_size: int, dtype: np.dtype) -> tuple[np.ndarray, int]:
    """All ids by falling frequency over all documents, then by id; and the number of ids counted. At most one row an id comes to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(vocab_size, np.int64)
        for batch in batches:
            seen += np.bincount(_joined(batch.column(0)).view(dtype), minlength=vocab_size)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(seen[at], pa.int64())], ["id", "n"])

    rows = tokens.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    total = np.zeros(vocab_size, np.int64)
    for row in rows:
        total[row["id"]] = row["n"]
    return np.argsort(-total, kind="stable").astype("<u4"), int(total.sum())


def _filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri)


def _write(uri: str, content: bytes) -> None:
    fs, path = _filesystem(uri)
    with fs.open_output_stream(path) as out:
        out.write(content)


@dataclass
class TokenFiles:
    """A folder of token files and the manifest (file_no, file, docs, ids, bytes) of those that count."""

    folder: str
    manifest: DataFrame


def write_token_files(df: DataFrame, vocab_path: str, folder: str | None = None, end_id: int = 0, ids_per_file: int = IDS_PER_FILE) -> TokenFiles:
    """Encode all documents and write them in ascending ``doc_id`` order to ``folder`` (default: the shared scratch folder)."""
    spark = df.sparkSession
    folder = folder or new_path(spark, "token-files")
    enc = vocab.encoder(vocab_path)
    dtype, size = enc.dtype, max(enc.vocab_size, end_id + 1)
    tokens = materialize(vocab.tokenize(df, vocab_path, end_id), "tokens", compression="zstd")
    order, total = ranked_ids(tokens, size, dtype)
    fs, path = _filesystem(folder)
    fs.create_dir(path, recursive=True)
    _write(f"{folder}/ranks.bin", order.tobytes())

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank_of = np.empty(size, np.uint32)
        rank_of[order] = np.arange(size, dtype=np.uint32)
        doc_ids, parts, held, number = [], [], 0, TaskContext.get().partitionId() << 32

        def put() -> pa.RecordBatch:
            nonlocal doc_ids, parts, held, number
            lengths = np.array([len(x) // dtype.itemsize for x in parts], np.int64)
            content = pack_file(doc_ids, lengths, rank_of[np.frombuffer(b"".join(parts), dtype)])
            name = f"tokens-{uuid.uuid4().hex}.wltf"
            _write(f"{folder}/{name}", content)
            row = {"file_no": number, "file": name, "docs": len(doc_ids), "ids": int(lengths.sum()), "bytes": len(content)}
            doc_ids, parts, held, number = [], [], 0, number + 1
            return pa.RecordBatch.from_pylist([row])

        for batch in batches:
            doc_ids += batch.column(0).to_pylist()
            parts += batch.column(1).to_pylist()
            held += batch.column(1).nbytes // dtype.itemsize
            if held >= 2 * ids_per_file:  # a range that turned out large goes on in another file
                yield put()
        if doc_ids:
            yield put()

    files = max(1, -(-total // ids_per_file))
    order_by = [F.col("doc_id"), F.crc32("ids"), F.xxhash64("row")]  # so that rows of one id, or equal ones, can be split over ranges
    numbered = tokens.select("doc_id", "ids", F.monotonically_increasing_id().alias("row"))
    by_id = numbered.repartitionByRange(files, *order_by).sortWithinPartitions(*order_by).select("doc_id", "ids")
    manifest = materialize(by_id.mapInArrow(write, "file_no long, file string, docs long, ids long, bytes long"), "token-manifest")
    return TokenFiles(folder, manifest)


def read_token_files(spark: SparkSession, files: TokenFiles) -> DataFrame:
    """``doc_id``, ``start`` (ids of all documents before it), ``n_tokens`` and ``ids_crc32`` of every document, from the files."""
    folder = files.folder

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = _filesystem(folder)
        with fs.open_input_stream(f"{path}/ranks.bin") as source:
            order = np.frombuffer(source.read(), "<u4")
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                doc_ids, lengths, ranks = unpack_file(memoryview(content.as_buffer()))
                raw, ends = memoryview(order[ranks].tobytes()), np.cumsum(lengths)
                begins = ends - lengths
                crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                columns = [pa.array([name] * len(doc_ids)), pa.array(doc_ids, pa.int64()), pa.array(begins), pa.array(lengths), pa.array(crcs, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["file", "doc_id", "at", "n_tokens", "ids_crc32"])

    before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    bases = files.manifest.select("file", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"))  # a row a file
    contents = spark.read.format("binaryFile").option("pathGlobFilter", "*.wltf").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    decoded = contents.mapInArrow(read, "file string, doc_id long, at long, n_tokens long, ids_crc32 long")
    return decoded.join(bases, "file").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
