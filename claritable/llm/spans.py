"""Spans found in texts: how they are joined, digested and returned."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: (start, kind, end) in code points of the source, end exclusive; kind is its place in the list of kinds.
Span = tuple[int, int, int]


def joined(spans: list[Span], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in sorted(spans))


def scan_spans(docs: DataFrame, find: Callable[[str], tuple[list[Span], list[Span]]], kinds: tuple[str, ...],
               counted: tuple[str, ...], id_column: str, text_column: str) -> DataFrame:
    """Apply ``find``, which gives base and added spans of a whole text, to every row.

    Returns ``doc_id``, ``n_<kind>`` of base spans, ``base_sha256``, ``spans`` and ``n_added``.
    """
    names = ["doc_id", *(f"n_{kind}" for kind in counted), "base_sha256", "spans", "n_added"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [[] for _ in counted]
            digests, texts, added = [], [], []
            for value in batch.column(1):
                base, more = find(value.as_py() or "")
                for k, column in enumerate(counts):
                    column.append(sum(x[1] == k for x in base))
                digests.append(hashlib.sha256(joined(base, kinds).encode()).hexdigest())
                texts.append(joined(base + more, kinds))
                added.append(len(more))
            longs = [pa.array(x, pa.int64()) for x in counts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *longs, pa.array(digests, pa.string()), pa.array(texts, pa.string()),
                 pa.array(added, pa.int64())], names)

    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = [f"doc_id {kind}", *(f"n_{k} long" for k in counted), "base_sha256 string", "spans string", "n_added long"]
    return rows.mapInArrow(scan, ", ".join(schema))
