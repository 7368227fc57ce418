"""Token ids in compressed files: canonical, length-limited Huffman codes in independent blocks.

Writing: texts become ids once, in a scratch table. Ids are counted over all documents (one number for each id of the
vocabulary reaches the driver) and get code lengths of at most ``LIMIT`` bits by package merging; codes are canonical,
so the lengths alone make up the code book. Documents are dealt by ranges of their id, sorted, and each range is
written as one shard of blocks. A block holds whole documents and can be decoded alone:

    4s  magic "HTB1"            u4  documents     u8  ids      u4  ids between checkpoints   u8  bits
    i8  id of each document     u1  1 where it is null         u8  ids of each document
    u8  bit offset of each checkpoint                          u1  bit stream, first bit highest
    u4  CRC-32 of all before                                   (all little-endian)

Blocks travel through Spark's Parquet writer as values of a binary column, so shards appear whole or not at all, also
when an executor is lost or a task runs twice, and on any store that Spark writes to.

Reading: a table with an entry for each possible ``LIMIT`` bits gives id and length of the code that they begin with.
All checkpoints of a block are decoded side by side, one id of each in a step.

Cases: a null text counts as empty and has the end id alone; null document ids come first; documents of one id keep
their rows; an empty table gives files without blocks; other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claritable.llm.common import documents, query, shared_dir
from claritable.llm.tokens import encoder, vocabulary_path

END_ID = 2
LIMIT = 18
#: Ids of a block and of a shard, about; ids between two checkpoints.
BLOCK_IDS = 1 << 19
SHARD_IDS = 1 << 24
STRIDE = 128
_HEAD = struct.Struct("<4sIQIQ")


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Lengths of an optimal prefix code of at most ``limit`` bits, by package merging; 0 for absent symbols."""
    lengths = np.zeros(len(counts), np.uint8)
    present = np.flatnonzero(counts)
    n = len(present)
    if n > 1 << limit:
        raise ValueError(f"{n} symbols do not fit codes of {limit} bits")
    if n < 2:
        lengths[present] = 1
        return lengths
    order = present[np.argsort(counts[present], kind="stable")]
    leaves = counts[order].astype(np.float64)
    packages, is_leaf = np.zeros(0), []
    for _ in range(limit):
        every = np.concatenate([leaves, packages])
        rank = np.argsort(every, kind="stable")
        is_leaf.append(rank < n)
        every = every[rank]
        packages = every[:len(every) // 2 * 2].reshape(-1, 2).sum(1)
    take, own = 2 * n - 2, np.zeros(n, np.uint8)
    for leaf in reversed(is_leaf):
        chosen = int(leaf[:take].sum())
        own[:chosen] += 1
        take = 2 * (take - chosen)
    lengths[order] = own
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of length, then symbol."""
    codes = np.zeros(len(lengths), np.uint32)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    long = lengths[order].astype(np.int64)
    if len(order):
        # The code after one of length l begins 2 ** (top - l) further on, counted in codes of the top length.
        top = int(long[-1])
        begins = np.concatenate([[0], np.cumsum(1 << (top - long))[:-1]])
        codes[order] = begins >> (top - long)
    return codes


def decoding_table(lengths: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """For each value of ``limit`` bits: the symbol that they begin with, times 32, plus the length of its code."""
    codes, table = canonical_codes(lengths), np.zeros(1 << limit, np.uint32)
    order = np.lexsort((codes, lengths))
    order = order[lengths[order] > 0]
    long = lengths[order].astype(np.int64)
    filled = np.repeat((order.astype(np.uint32) << 5) | long.astype(np.uint32), 1 << (limit - long))
    table[:len(filled)] = filled  # canonical codes fill the table from its start
    return table


def pack_bits(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Bit stream, bit offset of each id, number of bits."""
    long = lengths[ids].astype(np.int64)
    ends = np.cumsum(long)
    bits = int(ends[-1]) if len(ends) else 0
    begins = ends - long
    words = np.zeros(bits // 64 + 2, np.uint64)
    if len(ids):
        code, at, room = codes[ids].astype(np.uint64), begins >> 6, 64 - (begins & 63) - long
        high = np.where(room >= 0, code << np.maximum(room, 0).astype(np.uint64),
                        code >> np.maximum(-room, 0).astype(np.uint64))
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        words[at[first]] = np.bitwise_or.reduceat(high, first)
        over = np.flatnonzero(room < 0)  # at most one code runs over the end of a word
        words[at[over] + 1] |= code[over] << (64 + room[over]).astype(np.uint64)
    return words.astype(">u8").view(np.uint8)[:(bits + 7) // 8], begins, bits


def unpack_bits(stream: np.ndarray, checkpoints: np.ndarray, n: int, stride: int, table: np.ndarray,
                limit: int = LIMIT) -> np.ndarray:
    """The ``n`` ids of a stream; each step decodes the next id behind every checkpoint."""
    padded = np.concatenate([stream, np.zeros(stride * limit // 8 + 8, np.uint8)]).astype(np.uint64)
    windows = padded[:-3] << 24 | padded[1:-2] << 16 | padded[2:-1] << 8 | padded[3:]
    at, out = checkpoints.astype(np.int64), np.empty((stride, len(checkpoints)), np.uint32)
    for k in range(stride):
        found = table[(windows[at >> 3] << (at & 7).astype(np.uint64) & 0xFFFFFFFF) >> (32 - limit)]
        out[k] = found >> 5
        at = at + (found & 31)
    return out.T.ravel()[:n]


def write_block(doc_ids: list[int | None], ids: list[np.ndarray], codes: np.ndarray, lengths: np.ndarray,
                stride: int = STRIDE) -> bytes:
    every = np.concatenate(ids)
    stream, begins, bits = pack_bits(every, codes, lengths)
    body = b"".join([
        _HEAD.pack(b"HTB1", len(ids), len(every), stride, bits),
        np.array([x or 0 for x in doc_ids], "<i8").tobytes(), np.array([x is None for x in doc_ids], "u1").tobytes(),
        np.array([len(x) for x in ids], "<u8").tobytes(), begins[::stride].astype("<u8").tobytes(), stream.tobytes()])
    return body + struct.pack("<I", zlib.crc32(body))


def read_block(data: bytes, table: np.ndarray, limit: int = LIMIT) -> tuple[list[int | None], list[np.ndarray]]:
    """Ids of the documents and their token ids."""
    if zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
        raise ValueError("a block is damaged")
    magic, n_docs, n, stride, bits = _HEAD.unpack_from(data)
    if magic != b"HTB1":
        raise ValueError("not a block")
    at, parts = _HEAD.size, []
    for kind, size in (("<i8", n_docs), ("u1", n_docs), ("<u8", n_docs), ("<u8", -(-n // stride)), ("u1", -(-bits // 8))):
        parts.append(np.frombuffer(data, kind, size, at))
        at += parts[-1].nbytes
    doc_ids, null, sizes, checkpoints, stream = parts
    ids = unpack_bits(stream, checkpoints, n, stride, table, limit)
    names = [None if gone else int(x) for x, gone in zip(doc_ids, null, strict=True)]
    return names, np.split(ids, np.cumsum(sizes.astype(np.int64))[:-1]) if n_docs else []


_IDS = "doc_id long, ids binary, width int"


def _encoded(rows: DataFrame, path: str, end_id: int) -> DataFrame:
    """Ids of each text. Behind those of its last document, a task gives one row of width 0: its count of each id."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(path)
        counts = np.zeros(max(tokens.tokenizer.get_vocab_size(), end_id + 1), np.int64)
        kind = tokens.kind if end_id <= np.iinfo(tokens.kind).max else np.dtype("<u4")
        end = np.array(end_id, kind).tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                found = [x.astype(kind, copy=False) for x in tokens.encode(part.column(1).to_pylist())]
                counts += np.bincount(np.concatenate(found), minlength=len(counts))
                counts[end_id] += len(found)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([x.tobytes() + end for x in found], pa.binary()),
                     pa.array([kind.itemsize] * len(found), pa.int32())], ["doc_id", "ids", "width"])
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(1, pa.int64()), pa.array([counts.tobytes()], pa.binary()), pa.array([0], pa.int32())],
            ["doc_id", "ids", "width"])

    return rows.select("doc_id", "text").mapInArrow(scan, _IDS)


def _counted(spark: SparkSession, folder: str) -> np.ndarray:
    """How often each token id occurs: one number for each id of the vocabulary reaches the driver."""
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for x in batch.column(0):
                part = np.frombuffer(x.as_buffer(), np.int64)
                total = part + total if len(total) else part
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int64()), pa.array(total[there], pa.int64())], ["id", "n"])

    parts = spark.read.schema(_IDS).parquet(folder).where("width = 0").select("ids").mapInArrow(split, "id long, n long")
    counts = {row["id"]: row["n"] for row in parts.groupBy("id").agg(F.sum("n").alias("n")).toLocalIterator()}
    table = np.zeros(max(counts, default=0) + 1, np.int64)
    table[list(counts)] = list(counts.values())
    return table


def _remove(spark: SparkSession, path: str) -> None:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


def write_token_files(docs: DataFrame, folder: str, path: str | None = None, end_id: int = END_ID,
                      limit: int = LIMIT, block_ids: int = BLOCK_IDS, shard_ids: int = SHARD_IDS,
                      id_column: str = "doc_id", text_column: str = "text") -> None:
    """Write ``folder/blocks`` and ``folder/codes`` in ascending order of the documents' ids."""
    spark = docs.sparkSession

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    _encoded(rows, path or vocabulary_path(), end_id).write.option("compression", "zstd").parquet(f"{folder}/ids")
    table = _counted(spark, f"{folder}/ids")
    total = int(table.sum())
    ids = spark.read.schema(_IDS).parquet(f"{folder}/ids").where("width > 0")
    lengths = code_lengths(table, limit)
    codes = canonical_codes(lengths)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, held, size, block, start, shard = [], [], 0, 0, 0, 0

        def close() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([
                pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([start], pa.int64()),
                pa.array([size], pa.int64()), pa.array([write_block(names, held, codes, lengths)], pa.binary())],
                ["shard", "block", "start", "n", "data"])

        for batch in batches:
            for k in range(batch.num_rows):
                shard = batch.column(3)[k].as_py()
                names.append(batch.column(0)[k].as_py())
                held.append(np.frombuffer(batch.column(1)[k].as_buffer(), f"<u{batch.column(2)[k].as_py()}"))
                size += len(held[-1])
                if size >= block_ids:
                    yield close()
                    names, held, size, block, start = [], [], 0, block + 1, start + size
        if held:
            yield close()

    shards = max(1, -(-total // shard_ids))
    (ids.repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id")
     .select("doc_id", "ids", "width", F.spark_partition_id().alias("shard"))
     .mapInArrow(encode, "shard int, block int, start long, n long, data binary")
     .write.option("compression", "none").parquet(f"{folder}/blocks"))
    book = [(limit, zlib.compress(lengths.tobytes()))]
    spark.createDataFrame(book, "bits int, lengths binary").coalesce(1).write.parquet(f"{folder}/codes")
    _remove(spark, f"{folder}/ids")


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of each document, from the files alone."""
    book = spark.read.schema("bits int, lengths binary").parquet(f"{folder}/codes").first()
    limit, lengths = book["bits"], np.frombuffer(zlib.decompress(bytes(book["lengths"])), np.uint8)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = decoding_table(lengths, limit)
        for batch in batches:
            for k in range(batch.num_rows):
                names, ids = read_block(batch.column(2)[k].as_py(), table, limit)
                sizes = np.array([len(x) for x in ids], np.int64)
                begins = batch.column(1)[k].as_py() + np.cumsum(sizes) - sizes
                sums = [zlib.crc32(x.astype("<u4").tobytes()) for x in ids]
                yield pa.RecordBatch.from_arrays([
                    pa.array([batch.column(0)[k].as_py()] * len(ids), pa.int32()), pa.array(names, pa.int64()),
                    pa.array(begins), pa.array(sizes), pa.array(sums, pa.int64())],
                    ["shard", "doc_id", "start", "n_tokens", "ids_crc32"])

    blocks = spark.read.schema("shard int, block int, start long, n long, data binary").parquet(f"{folder}/blocks")
    # A row for each shard, of which there is one for every SHARD_IDS ids.
    before = blocks.groupBy("shard").agg(F.sum("n").alias("n"))
    order = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    before = before.select("shard", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before"))
    found = blocks.select("shard", "start", "data").mapInArrow(
        decode, "shard int, doc_id long, start long, n_tokens long, ids_crc32 long")
    return found.join(before, "shard").select(
        "doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


@query("op5_token_files")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    write_token_files(documents(spark, sf_dir), folder)
    return read_token_files(spark, folder)
