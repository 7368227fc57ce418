"""Best-fit packing of token sequences by exact complements.

Pieces count only by their length, of which there are at most ``capacity``: the plan is made from the number of pieces
of each length, so what the driver holds does not grow with the data. The sums of one, two and three lengths in stock
are indexed. For each length, longest first, the combinations that fill its gap exactly are looked up by their sum and
consumed as often as the counts allow; those that the counts no longer allow leave the index. What is left is placed best-fit: each length, longest first, goes to the smallest gap that holds it,
many sequences at a time.

The plan says which sequence and place the k-th piece of a length gets. Pieces are numbered within their length by
salted groups: each (length, salt) is numbered on its own, after the counts of the salts before it. The salt comes from
a row number that is written with the pieces, so that pieces alike in all columns spread too. The number of salts
grows with the square root of the pieces, so a length that a third of all pieces share is numbered by many tasks.

Cases: a null text counts as empty and is one end id; documents above the capacity are cut, with the shorter piece
first; repeated rows are packed each; a null id packs like any other; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claritable.llm.common import documents, query, settle
from claritable.llm.tokens import map_texts

CAPACITY = 2048
END_ID = 0

#: Lengths in a sequence and how many sequences are made that way.
Plan = list[tuple[tuple[int, ...], int]]


class Complements:
    """What fills a gap exactly: the lengths in stock by the sums of one, two and three of them.

    A pair is kept under its sum by its larger part, a triple under its sum by one part, whose other two are the pairs
    of the rest. Counts only fall, so an entry that the counts no longer allow is taken off its list for good.
    """

    def __init__(self, counts: np.ndarray, capacity: int):
        self.counts = counts.tolist()
        stocked = counts > 0
        # Taken from the end: pairs of like parts first, triples with the longest part first.
        self.pairs: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.triples: list[list[int]] = [[] for _ in range(capacity + 1)]
        for total in range(2, capacity):
            small = np.arange(1, total // 2 + 1)
            self.pairs[total] = (total - small[stocked[small] & stocked[total - small]]).tolist()
        paired = np.array([bool(x) for x in self.pairs])
        for total in range(3, capacity):
            part = np.arange((total + 2) // 3, total - 1)
            self.triples[total] = part[stocked[part] & paired[total - part]].tolist()

    def use(self, lengths: tuple[int, ...], plan: Plan) -> None:
        n = min(self.counts[x] // k for x, k in Counter(lengths).items())
        if n:
            plan.append((lengths, n))
            for x in lengths:
                self.counts[x] -= n

    def fill(self, longest: int, gap: int, plan: Plan) -> None:
        """Fill sequences that begin with ``longest`` as often as the counts allow."""
        self.use((longest, gap), plan)
        self._with_pairs((longest,), gap, plan)
        waiting = []
        while self.triples[gap] and self.counts[longest]:
            part = self.triples[gap][-1]
            if self.counts[part]:
                self._with_pairs((longest, part), gap - part, plan)
            entry = self.triples[gap].pop() if self.counts[longest] else None
            # With pairs and the part left, it was only this length that they lacked.
            if entry is not None and self.counts[part] and self.pairs[gap - part]:
                waiting.append(entry)
        self.triples[gap] += reversed(waiting)

    def _with_pairs(self, given: tuple[int, ...], total: int, plan: Plan) -> None:
        counts, pairs, waiting = self.counts, self.pairs[total], []
        while pairs and all(counts[x] for x in given):
            a, b = pairs[-1], total - pairs[-1]
            if counts[a] and counts[b]:
                self.use((*given, a, b), plan)
                if not all(counts[x] for x in given):
                    break
            pairs.pop()
            if counts[a] and counts[b] and (a != b or counts[a] > 1):
                waiting.append(a)
        pairs += reversed(waiting)


def _exact(counts: np.ndarray, capacity: int, plan: Plan) -> None:
    """Consume what fills a sequence exactly with up to four pieces."""
    stock = Complements(counts, capacity)
    for longest in range(capacity, 0, -1):
        if stock.counts[longest] and longest == capacity:
            stock.use((longest,), plan)
        elif stock.counts[longest]:
            stock.fill(longest, capacity - longest, plan)
    counts[:] = stock.counts


def _best_fit(counts: np.ndarray, capacity: int, plan: Plan) -> None:
    """Place the rest, longest first, each in the smallest gap that holds it."""
    gaps: list[int] = []  # in order
    open_by_gap: dict[int, Counter] = defaultdict(Counter)

    def add(lengths: tuple[int, ...], n: int) -> None:
        gap = capacity - sum(lengths)
        if not n:
            return
        if not gap:
            plan.append((lengths, n))
            return
        if gap not in open_by_gap:
            insort(gaps, gap)
        open_by_gap[gap][lengths] += n

    for length in range(capacity, 0, -1):
        left = int(counts[length])
        while left:
            at = bisect_left(gaps, length)
            if at == len(gaps):
                each = capacity // length
                add((length,) * each, left // each)
                add((length,) * (left % each), 1 if left % each else 0)
                left = 0
                break
            gap = gaps[at]
            lengths, n = next(iter(open_by_gap[gap].items()))
            each = max(1, min(gap // length, left // n))
            filled = min(n, left // each)
            open_by_gap[gap][lengths] -= filled
            if not open_by_gap[gap][lengths]:
                del open_by_gap[gap][lengths]
                if not open_by_gap[gap]:
                    del open_by_gap[gap], gaps[at]
            add(lengths + (length,) * each, filled)
            left -= each * filled
        counts[length] = 0
    for of_gap in open_by_gap.values():
        plan.extend(of_gap.items())


def plan_sequences(pieces: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """How to fill sequences from a number of pieces for each length."""
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in pieces.items():
        counts[length] = n
    plan: Plan = []
    _exact(counts, capacity, plan)
    _best_fit(counts, capacity, plan)
    return plan


def _slots(plan: Plan, pieces: dict[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For runs of pieces of a length: key (length, first rank), first rank, first sequence, place."""
    used, rows, first = Counter(), [], 0
    for lengths, n in plan:
        offset = 0
        for x in lengths:
            rows.append((x, used[x], first, offset))
            used[x] += n
            offset += x
        first += n
    assert used == Counter({k: v for k, v in pieces.items() if v}), "the plan must place every piece once"
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return (table[:, 0] << 44) + table[:, 1], table[:, 1], table[:, 2], table[:, 3]


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """Start and length of the pieces of a document of ``n`` ids; only the first may be shorter."""
    first = n % capacity or min(n, capacity)
    bounds = [0, *range(first, n + 1, capacity)]
    return [(a, b - a) for a, b in zip(bounds, bounds[1:], strict=False)]


def token_pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID,
                 id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of the pieces of whole texts."""
    def write(keys: list[pa.Array], ids: list[np.ndarray]) -> pa.RecordBatch:
        rows = [(k, piece, start, n, zlib.crc32(x[start:start + n].astype("<u4").tobytes()))
                for k, x in enumerate(ids) for piece, (start, n) in enumerate(cut(len(x), capacity))]
        at, piece, start, n, crc = (np.array(x, np.int64) for x in zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays(
            [keys[0].take(pa.array(at)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(n), pa.array(crc)],
            ["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    return map_texts(rows, ["doc_id"], "doc_id long, piece int, start long, length long, ids_crc32 long", write, path,
                     end_id)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces (``doc_id, piece, start, length, ids_crc32``)."""
    pieces = settle(pieces.withColumn("row", F.monotonically_increasing_id()))
    counts = {row["length"]: row["count"] for row in pieces.groupBy("length").count().collect()}  # capacity at most
    keys, ranks, sequences, offsets = _slots(plan_sequences(counts, capacity), counts)
    salts = max(1, math.isqrt(sum(counts.values())) // 4)
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(salts)).cast("int"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    base = salted.groupBy("length", "salt").count().select(
        F.col("length"), "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    within = F.row_number().over(Window.partitionBy("length", "salt").orderBy("row"))
    ranked = salted.withColumn("within", within - 1).join(base, ["length", "salt"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            at = np.searchsorted(keys, (n << 44) + rank, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(sequences[at] + rank - ranks[at]), pa.array(offsets[at])],
                [*batch.schema.names[:5], "sequence_id", "offset"])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("within") + F.col("base")).alias(
        "rank")).mapInArrow(place, schema)


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID,
                   id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    return pack(token_pieces(docs, path, capacity, end_id, id_column, text_column), capacity)


@query("op4_best_fit_packing")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir))
