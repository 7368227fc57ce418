"""Exact deduplication by a tree-merge of sorted digest runs.

Every partition of digests becomes a run: sorted by digest, equal ones folded into one entry with the row that stays
and the number of rows. Runs are then merged in binomial rounds. In a round, the runs whose numbers differ in one
digit (base ``fan``) exchange parts: each takes the digests of that digit from all of them and merges what it got.
After all rounds every digest lies in one run, and no run ever held more than its share: a digest that fills a third
of all rows is one entry of each run it meets. Only digests travel, no text.

Entries merge only where the 256 bits of the digest and the length of the normalised text agree, at every level.
Of equal entries the row with the most code points stays, then the smallest id (a null id last), then the first row.

Cases: a null text counts as empty; empty texts equal each other and texts of white space alone; repeated rows are
equal documents of which one stays; an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claritable.llm.common import SPACE_RUN, documents, nested, query, same, settle, unnested

#: Runs that exchange parts in a round, and entries that a run should hold at most.
FAN = 4
RUN_ROWS = 1_000_000

_ENTRY = "bucket long, text_sha256 binary, n_norm long, n_points long, doc_id long, row long, n long, run int"


def digests(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """A row for each document: digest and length of its text without white space, code points, a row number."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.length(text).cast("long").alias("n_points"),
                       F.regexp_replace(text, SPACE_RUN, "").alias("bare"))
    return settle(rows.select(
        "doc_id", "n_points", F.unhex(F.sha2("bare", 256)).alias("text_sha256"),
        F.length("bare").cast("long").alias("n_norm"), F.monotonically_increasing_id().alias("row")))


def _fold(part: pa.Table) -> pa.Table:
    """One entry for each digest of a table that is sorted by digest."""
    at = {name: part[name].to_numpy() for name in ("n_norm", "n_points", "row", "n")}
    sha = np.array(part["text_sha256"].to_pylist(), "S32")
    starts = np.flatnonzero(np.r_[True, (sha[1:] != sha[:-1]) | (at["n_norm"][1:] != at["n_norm"][:-1])])
    group = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(sha)]))
    null = part["doc_id"].is_null().to_numpy()
    known = part["doc_id"].fill_null(0).to_numpy()
    order = np.lexsort((at["row"], known, null, -at["n_points"], group))
    kept = part.take(pa.array(order[starts]))
    at_n = kept.schema.get_field_index("n")
    # Under its own field: the schema must stay that of the next batch, nullable or not.
    return kept.set_column(at_n, kept.schema.field(at_n), pa.array(np.add.reduceat(at["n"], starts)))


def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge sorted entries; holds one batch and the entry that is still open."""
    last = None
    for batch in batches:
        part = pa.Table.from_batches([batch])
        if last is not None:
            part = pa.concat_tables([last, part])
        if not part.num_rows:
            continue
        part = _fold(part).combine_chunks()
        last = part.slice(part.num_rows - 1)
        yield from part.slice(0, part.num_rows - 1).to_batches()
    if last is not None:
        yield from last.to_batches()


def merge_runs(rows: DataFrame, fan: int = FAN, run_rows: int = RUN_ROWS) -> DataFrame:
    """Entries of all digests: ``text_sha256, n_norm, n_points, doc_id, row, n`` with the row that stays."""
    rounds = max(2, math.ceil(math.log(max(1, rows.count() / run_rows), fan)))
    runs = fan ** rounds
    bucket = F.pmod(F.conv(F.substring(F.hex("text_sha256"), 1, 12), 16, 10).cast("long"), F.lit(runs))
    entries = (rows.select(bucket.alias("bucket"), "text_sha256", "n_norm", "n_points", "doc_id", "row",
                           F.lit(1).cast("long").alias("n"),
                           F.pmod(F.spark_partition_id(), F.lit(runs)).alias("run"))
               .sortWithinPartitions("text_sha256", "n_norm").mapInArrow(merge, _ENTRY))
    for k in range(rounds):
        digit = fan ** k
        # The run's own digits, but for digit k, which is the digest's.
        own = F.floor(F.col("run") / digit) % fan
        wanted = F.floor(F.col("bucket") / digit) % fan
        entries = (entries.withColumn("run", (F.col("run") + (wanted - own) * digit).cast("int"))
                   .repartitionById(runs, F.col("run"))
                   .sortWithinPartitions("text_sha256", "n_norm").mapInArrow(merge, _ENTRY))
    return entries.drop("bucket", "run")


def exact_duplicates(docs: DataFrame, fan: int = FAN, run_rows: int = RUN_ROWS, id_column: str = "doc_id",
                     text_column: str = "text") -> DataFrame:
    """A row for each row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256`` (lowercase hex)."""
    rows = digests(docs, id_column, text_column)
    # Only digests of several rows are joined back; a hot one is split by the skew handling of the join.
    groups = settle(merge_runs(rows, fan, run_rows).where("n > 1").select(
        "text_sha256", "n_norm", F.col("doc_id").alias("keep_id"), F.col("row").alias("keep_row"), "n"))
    joined = rows.alias("a").join(groups.alias("b"), same("text_sha256", "n_norm")("a", "b"), "left")
    grouped = F.col("n").isNotNull()
    return joined.select(
        F.col("a.doc_id").alias("doc_id"),
        F.when(grouped, F.col("keep_id")).otherwise(F.col("a.doc_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1).cast("long")).alias("group_size"),
        (~grouped | (F.col("row") == F.col("keep_row"))).alias("kept"),
        F.lower(F.hex("a.text_sha256")).alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame, fan: int = FAN, run_rows: int = RUN_ROWS, id_column: str = "doc_id",
                          text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    verdicts = exact_duplicates(docs, fan, run_rows, id_column, text_column)
    stay = verdicts.where("kept").select(_key(F.col("doc_id"), F.col("text_sha256")).alias("_key"))
    text = F.coalesce(F.col(text_column), F.lit(""))
    marked = nested(docs, _key=_key(F.col(id_column), F.sha2(F.regexp_replace(text, SPACE_RUN, ""), 256)),
                    size=F.length(text))
    # Rows may share id and digest; the one with the most code points stays. The join needs no further shuffle.
    place = F.row_number().over(Window.partitionBy("_key").orderBy(F.desc("size")))
    first = marked.withColumn("place", place).where("place = 1")
    return unnested(first.join(stay, "_key", "left_semi"), docs)


def _key(doc_id: Column, sha: Column) -> Column:
    return F.concat_ws(":", doc_id.cast("string"), sha)


SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
d AS (SELECT doc_id, length(text) AS points, sha256(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
      FROM t),
g AS (SELECT text_sha256, first(doc_id ORDER BY points DESC, doc_id) AS keep_id, count(*) AS group_size
      FROM d GROUP BY text_sha256)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.text_sha256
FROM d JOIN g USING (text_sha256)
"""


@query("op7_exact_dedup", SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(documents(spark, sf_dir))
