"""Conversation prefix trie by range minima over sorted LCPs.

A conversation is the sequence of its turns' digests (128 bits each). Sequences are sorted over the whole table, equal
ones by id, and dealt in that order to blocks of about ``BLOCK`` conversations. ``lcp[i]`` is the number of turns that
conversation i shares with the one before it. Every prefix (i, d) of every conversation is a candidate: within its block,
two binary searches over a sparse table of range minima of lcp, one to the left and one to the right, give the interval
of the conversations that begin with it. Candidates with the same interval and depth are one node; the one at the left
end of its interval stands for it. All figures of a node come from its interval, in constant time each:

    members            the length of the interval; the smallest by a sparse table over the ids
    childless nodes    conversations in it that the next one neither repeats nor goes on from
    saved tokens       words of all members from depth d on, less those of each node below once (prefix sums)

An interval that touches an end of its block may go on in the next. Each block reports its part of such a node, at most
one for each turn of its first and last conversation, and the parts are added up by the digest of the prefix. So a system
prompt that a third of all conversations share costs each block one row. Only whole numbers, three for each block, reach
the driver.

Cases: rows without a conversation id belong to no conversation; null roles and texts count as empty; turns without a
number come first; turns of one number go by role, then by digest; a repeated row is a turn of its own; remainders of
negative ids are those of SQL; a conversation that is left without turns is a member of the root alone; an empty table
gives an empty result; other columns are ignored. A conversation travels as one value of 16 bytes a turn, a text only as
its digest and word count. The ids of members that end at a node are hashed as they stream by in order, within the
block, or in one task for a node that spans blocks, since a SHA-256 cannot be put together from parts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claritable.llm.common import WORD, query, settle

#: Conversations of a block, about.
BLOCK = 1 << 15
_DIGEST = 16
_NONE = hashlib.sha256(b"").hexdigest()
#: Rows of a block: whole nodes, nodes whose parent spans blocks, parts of such nodes, ids that end at one.
_WHOLE, _HANGING, _PART, _END = range(4)
_ROW = ("kind int, block int, at int, depth int, parent_at int, key binary, parent_key binary, conv_id long, "
        "parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")


def turn_digests(table: DataFrame, conv_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role",
                 text_column: str = "text") -> DataFrame:
    """``conv_id, turns`` of each conversation: digest and word count of its turns in their order."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in (role_column, text_column))
    digest = F.substring(F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)), 1, _DIGEST)
    words = F.regexp_count(text, F.lit(f"{WORD}+")).cast("long")
    turn = F.struct(F.col(turn_column).alias("turn"), role.alias("role"), digest.alias("digest"), words.alias("words"))
    rows = table.where(F.col(conv_column).isNotNull()).select(F.col(conv_column).cast("long").alias("conv_id"),
                                                              turn.alias("t"))
    ordered = F.sort_array(F.collect_list("t"))
    return rows.groupBy("conv_id").agg(F.transform(
        ordered, lambda t: F.struct(t["digest"].alias("digest"), t["words"].alias("words"))).alias("turns"))


def rebuilt(conversations: DataFrame, every: int = 20, heads: int = 4) -> DataFrame:
    """Each conversation with its first turns taken from the one that opens its group of ``every`` ids."""
    c, h = F.col("c.conv_id"), F.pmod(F.crc32(F.col("c.conv_id").cast("string")), F.lit(heads)).cast("int")
    base = conversations.where(F.col("conv_id") % every == 0).select(
        F.col("conv_id").alias("base"), F.slice("turns", 1, heads).alias("opening"))
    empty = F.array().cast("array<struct<digest:binary,words:bigint>>")
    rest = F.slice("c.turns", h + 1, F.greatest(F.size("c.turns"), F.lit(1)))
    return conversations.alias("c").join(base.alias("b"), c - c % every == F.col("b.base"), "left").select(
        c.alias("conv_id"), F.concat(F.coalesce(F.slice("b.opening", 1, h), empty), rest).alias("turns"))


def sorted_blocks(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """``conv_id, key, words`` in order of their sequences of digests, written once: its partitions are the blocks."""
    keyed = settle(conversations.select(
        "conv_id", F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["digest"])), "")).alias("key"),
        F.transform("turns", lambda t: t["words"]).alias("words")))
    blocks = max(1, -(-keyed.count() // block))
    return settle(keyed.repartitionByRange(blocks, "key", "conv_id").sortWithinPartitions("key", "conv_id"))


def _shared(a: bytes, b: bytes) -> int:
    """Turns that two sequences have in common at their start."""
    n = min(len(a), len(b)) // _DIGEST
    x, y = (np.frombuffer(k, f"S{_DIGEST}", n) for k in (a, b))
    apart = np.flatnonzero(x != y)
    return int(apart[0]) if len(apart) else n


def borders(blocks: DataFrame) -> dict[int, tuple[int, int | None]]:
    """For each block: turns its first conversation shares with the one before, and its last with the one after; None
    at the end of the table. Three numbers of each block reach the driver."""
    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = None
        for batch in batches:
            if batch.num_rows:
                first = first or batch.slice(0, 1)
                last = batch.slice(batch.num_rows - 1)
        if first is not None:
            yield pa.RecordBatch.from_arrays([first.column(0), first.column(1), last.column(1)], ["block", "first", "last"])

    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block, first, last, before, after = (column.to_pylist() for column in batch.columns)
            yield pa.RecordBatch.from_arrays([
                pa.array(block, pa.int32()),
                pa.array([0 if b is None else _shared(b, f) for b, f in zip(before, first, strict=True)], pa.int32()),
                pa.array([None if a is None else _shared(z, a) for z, a in zip(last, after, strict=True)], pa.int32())],
                ["block", "left", "right"])

    found = blocks.select(F.spark_partition_id().alias("block"), "key").mapInArrow(
        ends, "block int, first binary, last binary")
    order = Window.orderBy("block")  # one row of each block
    around = found.select("block", "first", "last", F.lag("last").over(order).alias("before"),
                          F.lead("first").over(order).alias("after"))
    return {row["block"]: (row["left"], row["right"])
            for row in around.mapInArrow(share, "block int, left int, right int").collect()}


def sparse_table(values: np.ndarray) -> list[np.ndarray]:
    """``table[k][i]`` is the least of the ``2 ** k`` values from i on."""
    table = [values]
    while 2 << (len(table) - 1) <= len(values):
        half = 1 << (len(table) - 1)
        table.append(np.minimum(table[-1][:-half], table[-1][half:]))
    return table


def least(table: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Range minima of closed intervals."""
    level = np.frexp((right - left + 1).astype(np.float64))[1] - 1
    out = np.empty(len(left), table[0].dtype)
    for k in np.unique(level):
        at = np.flatnonzero(level == k)
        out[at] = np.minimum(table[k][left[at]], table[k][right[at] - (1 << k) + 1])
    return out


def extents(table: list[np.ndarray], at: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last conversation that share ``depth`` turns with conversation ``at``: a binary search to each side.
    ``table`` is over lcp, of which the entry at 0 is below every depth."""
    n = len(table[0])
    left, right = at.copy(), at.copy()
    for k in range(len(table) - 1, -1, -1):
        step = 1 << k
        # lcp[left - step + 1 .. left] all reach the depth: the interval begins at left - step or before.
        can = left >= step
        can[can] = table[k][left[can] - step + 1] >= depth[can]
        left[can] -= step
        can = right + step < n
        can[can] = table[k][right[can] + 1] >= depth[can]
        right[can] += step
    return left, right


def _local_lcp(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Turns shared with the conversation before, within one block; 0 for the first."""
    lcp = np.zeros(len(sizes), np.int64)
    if len(sizes) > 1:
        both = np.minimum(sizes[1:], sizes[:-1])
        pair = np.repeat(np.arange(len(both)), both)
        step = np.arange(both.sum()) - np.repeat(np.cumsum(both) - both, both)
        same = flat[starts[:-1][pair] + step] == flat[starts[1:][pair] + step]
        lcp[1:] = both
        first = np.flatnonzero(~same)[::-1]
        lcp[1 + pair[first]] = step[first]  # the earliest difference is set last
    return lcp


def _block_nodes(block: int, ids: np.ndarray, keys: list[bytes], sizes: np.ndarray, flat_words: np.ndarray,
                 border: tuple[int, int | None]) -> Iterator[pa.RecordBatch]:
    before, after = border
    n = len(ids)
    flat = np.frombuffer(b"".join(keys), f"S{_DIGEST}")
    starts = np.cumsum(sizes) - sizes
    words = np.concatenate([[0], np.cumsum(flat_words)])

    def above_words(i: np.ndarray, d: np.ndarray) -> np.ndarray:
        """Words of the first d turns of conversations i."""
        return words[starts[i] + d] - words[starts[i]]

    local = _local_lcp(flat, starts, sizes)
    lcp = np.append(before, local[1:])
    table, ids_table = sparse_table(local), sparse_table(ids)
    # Candidate 0 is the root, candidate starts[i] + d the prefix (i, d).
    at = np.append(0, np.repeat(np.arange(n), sizes))
    depth = np.append(0, np.arange(len(flat)) - np.repeat(starts, sizes) + 1)
    left, right = extents(table, at, depth)
    node = np.flatnonzero(left == at)
    place = np.full(len(left), -1)
    place[node] = np.arange(len(node))
    at, depth, right = at[node], depth[node], right[node]
    # The parent stands at the left end of the interval of the same conversation's shorter prefix.
    shorter = np.where(depth > 1, starts[at] + depth - 1, 0)
    parent = place[np.where(depth > 1, starts[left[shorter]] + depth - 1, 0)]
    begins = (depth > 0) & (lcp[at] < depth)  # in this block
    spans = (at == 0) & (depth <= before)
    if after is not None:
        spans |= (right == n - 1) & (depth <= after)
    spans[0] = True

    every, who = sizes > 0, np.arange(n)
    follow = np.append(local[1:], after or 0)
    total = above_words(who, sizes)
    sums = {name: np.append(0, np.cumsum(x)) for name, x in (
        ("all", total), ("new", total - above_words(who, np.minimum(lcp, sizes))), ("leaf", every & (follow < sizes)))}

    def within(name: str) -> np.ndarray:
        return sums[name][right + 1] - sums[name][at]

    count = right - at + 1
    up = above_words(at, np.maximum(depth - 1, 0))
    # Of the turns that are new in the first conversation of a node, those above the node do not lie below it.
    saved = within("all") - count * up - within("new") + np.where(
        begins, up - above_words(at, np.minimum(lcp[at], sizes[at])), 0)
    children = np.bincount(parent[begins], minlength=len(node))
    smallest = least(ids_table, at, right)
    # Members that end at a node come first in its interval.
    ending = np.where(sizes[at] == depth, _runs(local, sizes)[at], 0)

    kind = np.where(spans, _PART, np.where(spans[parent], _HANGING, _WHOLE))
    part = np.flatnonzero(spans).tolist()
    names, parents, hashes = ([None] * len(node) for _ in range(3))
    for k in part:
        names[k] = hashlib.sha256(keys[at[k]][:depth[k] * _DIGEST]).digest()
        if depth[k]:
            parents[k] = hashlib.sha256(keys[at[k]][:(depth[k] - 1) * _DIGEST]).digest()
    for k in np.flatnonzero(~spans).tolist():
        hashes[k] = _NONE if not ending[k] else hashlib.sha256(
            ",".join(map(str, ids[at[k]:at[k] + ending[k]].tolist())).encode()).hexdigest()
    columns = [kind, np.full(len(node), block), at, depth, at[parent], names, parents, smallest, smallest[parent], count,
               children, within("leaf"), saved, hashes]
    kinds = [pa.int32()] * 5 + [pa.binary()] * 2 + [pa.int64()] * 6 + [pa.string()]
    labels = [x.split()[0] for x in _ROW.split(", ")]
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], labels)
    for k in part:
        for a in range(0, int(ending[k]), 1 << 16):
            some = ids[at[k] + a:at[k] + min(ending[k], a + (1 << 16))]
            row = [pa.nulls(len(some), t) for t in kinds]
            row[0], row[5] = pa.array([_END] * len(some), pa.int32()), pa.array([names[k]] * len(some), pa.binary())
            row[7] = pa.array(some)
            yield pa.RecordBatch.from_arrays(row, labels)


def _runs(lcp: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each conversation, how many from it on are equal to it."""
    breaks = np.flatnonzero(np.append((lcp[1:] < sizes[1:]) | (sizes[1:] != sizes[:-1]), True))
    return breaks[np.searchsorted(breaks, np.arange(len(sizes)))] - np.arange(len(sizes)) + 1


def _nodes(blocks: DataFrame, border: dict[int, tuple[int, int | None]]) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [batch for batch in batches if batch.num_rows]
        if held:
            rows = pa.Table.from_batches(held).combine_chunks()
            words = rows["words"].combine_chunks()
            yield from _block_nodes(rows["block"][0].as_py(), rows["conv_id"].to_numpy(), rows["key"].to_pylist(),
                                    words.value_lengths().to_numpy().astype(np.int64),
                                    words.flatten().to_numpy().astype(np.int64), border[rows["block"][0].as_py()])

    return blocks.select("conv_id", "key", "words", F.spark_partition_id().alias("block")).mapInArrow(scan, _ROW)


def _hashed(ends: DataFrame) -> DataFrame:
    """``key, ends_sha256`` of ``key, conv_id``: ids of a key in ascending order, hashed as they stream by."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, state = None, None

        def close() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([open_], pa.binary()), pa.array([state.hexdigest()])], ["key", "ends_sha256"])

        for batch in batches:
            keys, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for key, i in zip(keys, ids, strict=True):
                if key != open_:
                    if state is not None:
                        yield close()
                    open_, state = key, hashlib.sha256(str(i).encode())
                else:
                    state.update(f",{i}".encode())
        if state is not None:
            yield close()

    return ends.repartition("key").sortWithinPartitions("key", "conv_id").mapInArrow(
        scan, "key binary, ends_sha256 string")


def trie(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """A row for each node of the trie of ``conv_id, turns`` (each id once)."""
    blocks = sorted_blocks(conversations, block)
    rows = settle(_nodes(blocks, borders(blocks)))
    part = rows.where(F.col("kind") == _PART)
    total = part.groupBy("key", "depth").agg(
        F.max("parent_key").alias("parent_key"), F.min("conv_id").alias("conv_id"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")])
    # All conversations may be without turns: then the root is the one childless node.
    total = settle(total.withColumn("n_leaves", F.greatest("n_leaves", F.lit(1).cast("long"))))
    ends = _hashed(rows.where(F.col("kind") == _END).select("key", "conv_id"))
    parents = total.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    spanning = total.join(parents, "parent_key", "left").join(ends, "key", "left").withColumn(
        "ends_sha256", F.coalesce("ends_sha256", F.lit(_NONE)))
    # A block's nodes below a spanning one find it by its place in the block, so no key is shared by many of them.
    placed = part.select("block", F.col("at").alias("parent_at"), F.col("depth").alias("parent_depth"), "key").join(
        total.select("key", F.col("conv_id").alias("named")), "key").drop("key")
    hanging = rows.where(F.col("kind") == _HANGING).withColumn("parent_depth", F.col("depth") - 1).join(
        placed, ["block", "parent_at", "parent_depth"]).withColumn("parent_conv_id", F.col("named"))
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    whole = rows.where(F.col("kind") == _WHOLE)
    return whole.select(*names).unionAll(hanging.select(*names)).unionAll(spanning.select(*names)).withColumn(
        "depth", F.col("depth").cast("long"))


def prefix_trie(table: DataFrame, block: int = BLOCK, **columns: str) -> DataFrame:
    """The trie of the rebuilt conversations of a table of turns."""
    return trie(rebuilt(turn_digests(table, **columns)), block)


#: CRC-32 has no function in DuckDB; it is computed bit by bit over the decimal digits.
SQL = r"""
WITH RECURSIVE t AS (
  SELECT conv_id, list(struct_pack(role := coalesce(role, ''), text := coalesce(text, '')) ORDER BY turn NULLS FIRST,
    coalesce(role, '')) AS turns FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (
  SELECT conv_id, turns, xor(list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 1, 2, 3, 4, 5, 6, 7]::BIGINT[]),
      lambda y, z: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END)), 4294967295) % 4 AS h FROM t),
r AS MATERIALIZED (
  SELECT h.conv_id, list_concat(coalesce(list_slice(b.turns, 1, h.h), []), list_slice(h.turns, h.h + 1, len(h.turns))) AS turns
  FROM h LEFT JOIN t AS b ON b.conv_id = h.conv_id - h.conv_id % 20),
p AS MATERIALIZED (
  SELECT conv_id, len(turns) AS n, d, sha256(list_slice(turns, 1, d)::VARCHAR) AS k,
    CASE WHEN d > 0 THEN sha256(list_slice(turns, 1, d - 1)::VARCHAR) END AS pk,
    CASE WHEN d > 0 THEN len(regexp_extract_all(turns[d].text, '[^\x20\x09-\x0D]+')) ELSE 0 END AS w
  FROM (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS d FROM r)),
n AS MATERIALIZED (
  SELECT d, k, any_value(pk) AS pk, any_value(w) AS w, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE n = d), '')) AS ends_sha256
  FROM p GROUP BY d, k),
c AS MATERIALIZED (SELECT n.*, coalesce(x.n_children, 0) AS n_children
  FROM n LEFT JOIN (SELECT d - 1 AS d, pk AS k, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL) AS x USING (d, k)),
u AS (
  SELECT d, k, d AS top_d, k AS top_k, pk AS up, (n_convs - 1) * w AS saved, (n_children = 0)::BIGINT AS leaf FROM c
  UNION ALL
  SELECT u.d, u.k, c.d, c.k, c.pk, u.saved, u.leaf FROM u JOIN c ON c.d = u.top_d - 1 AND c.k = u.up),
s AS (SELECT top_d AS d, top_k AS k, sum(saved)::BIGINT AS saved_tokens, sum(leaf)::BIGINT AS n_leaves FROM u GROUP BY ALL)
SELECT c.conv_id, c.d AS depth, q.conv_id AS parent_conv_id, c.n_convs, c.n_children, s.n_leaves, s.saved_tokens, c.ends_sha256
FROM c JOIN s USING (d, k) LEFT JOIN c AS q ON q.d = c.d - 1 AND q.k = c.pk
"""


@query("op13_prefix_trie", SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
