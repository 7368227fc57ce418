"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprints of 64 bits come from the word shingles of whole texts. Pairs within ``radius`` bits are found by bit masks
built so that none is missed: each bit position has a non-zero vector of ``radius + 1`` bits, and the mask of a
non-zero vector v holds the positions whose vector has an odd product with v. The positions in which two fingerprints
differ span at most ``radius`` dimensions, so some v is orthogonal to all of them, and under its mask the two are
equal. There are ``2 ** (radius + 1) - 1`` masks (15 for three bits), each of about half of the positions.

Only distinct fingerprints are compared, so exact copies cost nothing. Within a bucket (mask, masked bits) a search
from node to node gives the edges of a spanning forest, never all pairs. A bucket above ``most`` fingerprints is split
by masks over its free positions, by the same construction and with the same guarantee; as the free positions halve
with each split, buckets are bounded whatever the data. Groups are the connected components of the edges.

Cases: a null or blank text has fingerprint zero, linked like any other; a null id never names a group that has other
ids; repeated rows share a fingerprint and a group; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claritable.llm.common import documents, nested, query, settle, unnested
from claritable.llm.components import components

WORDS = 3
RADIUS = 3
SEED = 42
#: Fingerprints that a bucket may have before it is split.
MOST = 1 << 16
#: Buckets up to this size are compared pair by pair, with all others of a batch at once.
_SMALL = 16
_BLOCK = 1 << 16


def shingles(text: str | None, words: int = WORDS, seed: int = SEED) -> np.ndarray:
    """Hashes of the word shingles of a whole text in their order; none if it has no word."""
    from xxhash import xxh64_intdigest

    parts = (text or "").encode().lower().split()  # of bytes: A-Z only, and the six white space characters
    if not parts:
        return np.zeros(0, np.uint64)
    joined = b" ".join(parts)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    if len(parts) <= words:
        spans = [(0, len(joined))]
    else:
        spans = zip([0, *(gaps[:len(parts) - words] + 1).tolist()], [*gaps[words - 1:].tolist(), len(joined)],
                    strict=True)
    return np.array([xxh64_intdigest(joined[a:b], seed) for a, b in spans], np.uint64)


def fingerprint(text: str | None, words: int = WORDS, seed: int = SEED) -> int:
    """Unsigned fingerprint of a whole text."""
    hashes = shingles(text, words, seed).astype(">u8")
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _BLOCK):
        part = hashes[at:at + _BLOCK]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = WORDS, seed: int = SEED, id_column: str = "doc_id",
                 text_column: str = "text") -> DataFrame:
    """``doc_id, mark, fp`` for each row: the fingerprint as a signed long, and a hash of the text."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(x.as_py(), words, seed) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.array(prints, np.uint64).view(np.int64))],
                ["doc_id", "mark", "fp"])

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.xxhash64(text_column).alias("mark"),
                       F.col(text_column).alias("text"))
    return settle(rows.mapInArrow(scan, "doc_id long, mark long, fp long"))


def masks(positions: list[int], radius: int = RADIUS) -> list[list[int]]:
    """Position lists such that any ``radius`` of the given positions are missed by one of them."""
    size = 2 ** (radius + 1)
    vector = {p: k % (size - 1) + 1 for k, p in enumerate(positions)}
    return [[p for p in positions if (vector[p] & v).bit_count() % 2] for v in range(1, size)]


def _signed(positions: list[int]) -> int:
    value = sum(1 << p for p in positions)
    return value - (1 << 64) if value >> 63 else value


def _differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits in which fingerprints differ; numpy counts the bits of a signed number's absolute value."""
    return np.bitwise_count((a ^ b).view(np.uint64))


def _forest(fps: np.ndarray, radius: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Edges of a spanning forest of the links within one bucket."""
    left, right, rest = [], [], np.arange(len(fps))
    while len(rest):
        front, rest = rest[:1], rest[1:]
        while len(front) and len(rest):
            step, front = front[:64], front[64:]
            near = _differing(fps[step][:, None], fps[rest][None, :]) <= radius
            met = near.any(0)
            if met.any():
                left.append(fps[step[near[:, met].argmax(0)]])
                right.append(fps[rest[met]])
                front, rest = np.concatenate([front, rest[met]]), rest[~met]
    return left, right


def links(radius: int = RADIUS):
    """For rows ``path, key, fp`` sorted by bucket: edges ``u, v`` of links. Holds a batch and the open bucket."""
    def close(path: np.ndarray, key: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero(np.r_[True, (path[1:] != path[:-1]) | (key[1:] != key[:-1])])
        sizes = np.diff(np.r_[starts, len(path)])
        left, right = [], []
        small = np.repeat(np.where(sizes <= _SMALL, starts, -1), sizes)
        for shift in range(1, min(_SMALL, len(path))):
            hit = np.flatnonzero((small[shift:] == small[:-shift]) & (small[shift:] >= 0)
                                 & (_differing(fps[shift:], fps[:-shift]) <= radius))
            left.append(fps[hit])
            right.append(fps[hit + shift])
        for k in np.flatnonzero(sizes > _SMALL):
            a, b = _forest(fps[starts[k]:starts[k] + sizes[k]], radius)
            left, right = left + a, right + b
        none = [np.zeros(0, np.int64)]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(left or none)), pa.array(np.concatenate(right or none))], ["u", "v"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for batch in batches:
            part = [batch.column(k).to_numpy() for k in range(3)]
            held = part if held is None else [np.concatenate(x) for x in zip(held, part, strict=True)]
            path, key, _ = held
            if not len(path):
                continue
            # The last bucket may go on in the next batch.
            ended = int(np.flatnonzero((path == path[-1]) & (key == key[-1]))[0])
            if ended:
                yield close(*(x[:ended] for x in held))
                held = [x[ended:] for x in held]
        if held is not None and len(held[0]):
            yield close(*held)
    return scan


def near_edges(nodes: DataFrame, radius: int = RADIUS, most: int = MOST) -> DataFrame:
    """Edges ``u, v`` that connect all distinct fingerprints (``fp``) within ``radius`` bits of each other."""
    if most < 256:
        raise ValueError("a bucket of few free positions is not split further; most must be 256 or more")
    spark = nodes.sparkSession
    level = dict(enumerate(masks(list(range(64)), radius)))
    buckets = nodes.select("fp", F.explode(F.array(*[
        F.struct(F.lit(path).cast("long").alias("path"), F.col("fp").bitwiseAND(F.lit(_signed(at))).alias("key"))
        for path, at in level.items()])).alias("b")).select("b.path", "b.key", "fp")
    found = []
    while True:
        hot = settle(buckets.groupBy("path", "key").count().where(F.col("count") > most).select("path", "key"))
        split = not hot.isEmpty()
        plain = buckets.join(hot, ["path", "key"], "left_anti") if split else buckets
        found.append(plain.repartition("path", "key").sortWithinPartitions("path", "key")
                     .mapInArrow(links(radius), "u long, v long"))
        if not split:
            break
        # Split by masks over the positions that the bucket leaves free.
        finer, rows = {}, []
        for path, at in level.items():
            free = [p for p in range(64) if p not in set(at)]
            for k, more in enumerate(masks(free, radius)):
                finer[path * 100 + k] = sorted([*at, *more])
                rows.append((path, path * 100 + k, _signed([*at, *more])))
        table = spark.createDataFrame(rows, "path long, finer long, mask long")
        buckets = settle(buckets.join(hot, ["path", "key"]).join(F.broadcast(table), "path").select(
            F.col("finer").alias("path"), F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp"))
        level = finer
    edges = found[0]
    for more in found[1:]:
        edges = edges.unionAll(more)
    return edges


def near_duplicates(docs: DataFrame, words: int = WORDS, radius: int = RADIUS, seed: int = SEED, most: int = MOST,
                    id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, fingerprint, component_id`` for each row of ``docs`` (and ``mark``, a hash of its text, and ``root``,
    a fingerprint that names the group whether its rows have ids or not)."""
    rows = fingerprints(docs, words, seed, id_column, text_column)
    nodes = settle(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = components(near_edges(nodes.select("fp"), radius, most))
    rooted = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "root", "component_id")
    return rows.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "mark", "root")


def drop_near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                         **options) -> DataFrame:
    """The rows of ``docs`` of which one stays for each group, the one with the smallest id, with all columns."""
    found = near_duplicates(docs, id_column=id_column, text_column=text_column, **options)
    return keep_first(docs, found, id_column, text_column)


def keep_first(docs: DataFrame, found: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The row with the smallest id of each group; ``found`` has ``doc_id, mark, root`` for each row of ``docs``."""
    stay = found.groupBy("root").agg(F.min(F.struct(
        F.col("doc_id").isNull().alias("late"), "doc_id", "mark")).alias("best"))
    stay = stay.select(_key(F.col("best.doc_id"), F.col("best.mark")).alias("_key"))
    marked = nested(docs, _key=_key(F.col(id_column), F.xxhash64(text_column)))
    # Rows alike in id and text are one document.
    place = F.row_number().over(Window.partitionBy("_key").orderBy("_key"))
    first = marked.withColumn("place", place).where("place = 1")
    return unnested(first.join(stay, "_key", "left_semi"), docs)


def _key(doc_id: Column, mark: Column) -> Column:
    return F.concat_ws(":", doc_id.cast("string"), mark.cast("string"))


@query("op9_simhash_near_dedup")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir)).drop("mark", "root")
