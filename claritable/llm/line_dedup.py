r"""Line deduplication by winnowing. DataFrame functions only.

Each line with a word, trimmed, is hashed. A window starts at each line and ends at its ``run``-th line or at the line
that brings it to ``words`` words, whichever comes first, so a single long line is a window of its own. In every
window the smallest hash (the rightmost on ties) is selected as a fingerprint; where a window ends depends on its own
lines alone, so equal windows select the same fingerprint at the same place. Fingerprints are counted over all
documents with partial counts before the shuffle; only windows whose fingerprint occurs again go on. Such a place is
extended both ways by every window around it: a window is a match where all its line hashes equal those of an earlier
window (document by id, then line), and the matches of a place join to the longest repeated run. Lines of matches are
deleted, the earliest occurrence stays.

A line is thus deleted exactly if it lies in a window that occurred before: ``run`` successive lines, or fewer of
``words`` words. Equality is that of the fingerprint and of a hash of the window, 128 bits. No occurrence is paired
with all others: each window meets the earliest one of its kind, so a passage in a third of all documents costs one row for
each occurrence.

Cases: a null text stays null and has no lines; lines without a word separate nothing and stay where they are; texts
of fewer lines and words than a window has stay; a null id comes last; rows alike in id and text are one document and share its
result; an empty table gives an empty result; extra columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claritable.llm.common import WORD, documents, nested, query, settle, trimmed, unnested

#: Lines that a repeated run has at least.
RUN = 3
#: Words at which a run of fewer lines counts as well.
WORDS = 50
_SPACES = r"[\x20\x09-\x0D]+"


def _full(lines: Column) -> Column:
    """Places of the lines that have a word."""
    return F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(WORD), i)), lambda i: i.isNotNull())


def line_windows(docs: DataFrame, run: int = RUN, words: int = WORDS, id_column: str = "doc_id",
                 text_column: str = "text") -> DataFrame:
    """``doc_id, mark, windows``: for each window its place and lines, its fingerprint with the fingerprint's place, its
    hash."""
    rows = docs.select(
        F.col(id_column).alias("doc_id"), F.xxhash64(text_column).alias("mark"),
        F.transform(F.filter(F.split(text_column, "\n"), lambda x: x.rlike(WORD)), trimmed).alias("line"))
    rows = rows.select("doc_id", "mark", F.transform("line", lambda x: F.xxhash64(x)).alias("h"),
                       F.transform("line", lambda x: F.size(F.split(x, _SPACES))).alias("w"))

    def length(i: Column) -> Column:
        """Lines of the window at ``i``; null if the text ends before it."""
        tall = F.when(i + run <= F.size("h"), run)
        sums = [sum((F.get("w", i + j) for j in range(1, k)), F.get("w", i)) for k in range(1, run)]
        for k in range(run - 1, 0, -1):
            tall = F.when(sums[k - 1] >= words, k).otherwise(tall)
        return tall

    rows = rows.withColumn("long", F.transform("h", lambda _, i: length(i)))
    # Places are kept before the hashes are compared, so a window is built once.
    rows = rows.withColumn("span", F.filter(F.transform("long", lambda n, i: F.struct(i.alias("at"), n.alias("n"))),
                                            lambda s: s["n"].isNotNull()))
    rows = rows.withColumn("least", F.transform("span", lambda s: F.array_min(F.slice("h", s["at"] + 1, s["n"]))))
    return rows.select("doc_id", "mark", F.transform("span", lambda s, k: F.struct(
        s["at"].alias("at"), s["n"].alias("n"), F.get("least", k).alias("fp"),
        (s["at"] + s["n"] - F.array_position(F.reverse(F.slice("h", s["at"] + 1, s["n"])), F.get("least", k)))
        .cast("int").alias("fp_at"),
        F.xxhash64(F.slice("h", s["at"] + 1, s["n"])).alias("key"))).alias("windows"))


def repeated_windows(windows: DataFrame) -> DataFrame:
    """``doc_id, mark, at, n`` of the windows that equal an earlier one."""
    places = windows.select(F.explode(F.array_distinct(F.transform(
        "windows", lambda w: F.struct(w["fp"].alias("fp"), w["fp_at"].alias("fp_at"))))).alias("p"))
    again = settle(places.groupBy(F.col("p.fp").alias("fp")).count().where("count > 1").select("fp"))
    each = windows.select("doc_id", "mark", F.explode("windows").alias("w")).select(
        "doc_id", "mark", "w.at", "w.n", "w.fp", "w.key").join(again, "fp", "left_semi")
    order = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "mark", "at")
    first = (each.groupBy("fp", "key").agg(F.min(order).alias("first"), F.count("*").alias("n"))
             .where("n > 1").select("fp", "key", "first"))
    return each.join(first, ["fp", "key"]).where(order > F.col("first")).select("doc_id", "mark", "at", "n")


def deduplicate_lines(docs: DataFrame, run: int = RUN, words: int = WORDS, id_column: str = "doc_id",
                      text_column: str = "text") -> DataFrame:
    """``docs`` with later repeated runs deleted from the text, and ``n_lines``, ``n_removed``."""
    windows = settle(line_windows(docs, run, words, id_column, text_column))
    removed = repeated_windows(windows).groupBy(_key(F.col("doc_id"), F.col("mark")).alias("_key")).agg(
        F.array_distinct(F.flatten(F.transform(
            F.collect_set(F.struct("at", "n")), lambda w: F.sequence(w["at"], w["at"] + w["n"] - 1)))).alias("_removed"))
    found = nested(docs, _key=_key(F.col(id_column), F.xxhash64(text_column)), _text=F.col(text_column),
                   _lines=F.split(text_column, "\n")).join(removed, "_key", "left")
    found = found.withColumn("_full", F.coalesce(_full(F.col("_lines")), F.array().cast("array<int>")))
    found = found.withColumn("_gone", F.transform("_removed", lambda i: F.get("_full", i)))
    left = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_gone"))
    text = F.when(F.col("_gone").isNull(), F.col("_text")).otherwise(
        F.array_join(F.transform(left, lambda i: F.get("_lines", i)), "\n"))
    return unnested(found, docs, **{text_column: text}, n_lines=F.size("_full").cast("long"),
                    n_removed=F.coalesce(F.size("_gone"), F.lit(0)).cast("long"))


def _key(doc_id: Column, mark: Column) -> Column:
    return F.concat_ws(":", doc_id.cast("string"), mark.cast("string"))


_ENDS = " ".join(
    f"WHEN {' + '.join(f'coalesce(sizes[pos + {j}], 0)' for j in range(1, k + 1))} >= {WORDS} THEN {k}" for k in range(1, RUN))
SQL = rf"""
WITH raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
                    unnest(range(len(string_split(text, chr(10))))) AS raw_at FROM documents),
lines AS (SELECT *, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare,
                 row_number() OVER (PARTITION BY doc_id ORDER BY raw_at) - 1 AS pos
          FROM raw WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
listed AS (SELECT doc_id, list(bare ORDER BY pos) AS bares,
                  list(len(regexp_split_to_array(bare, '[\x20\x09-\x0D]+')) ORDER BY pos) AS sizes
           FROM lines GROUP BY doc_id),
spans AS (SELECT *, CASE {_ENDS} WHEN pos + {RUN} <= len(bares) THEN {RUN} END AS n
          FROM (SELECT *, unnest(range(len(bares))) AS pos FROM listed)),
win AS (SELECT doc_id, pos, n, bares[pos + 1:pos + n] AS w FROM spans WHERE n IS NOT NULL),
later AS (SELECT doc_id, pos, n FROM (
    SELECT doc_id, pos, n, row_number() OVER (PARTITION BY w ORDER BY doc_id, pos) AS k FROM win) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + n)) AS pos FROM later),
marked AS (SELECT raw.doc_id, raw.line, raw.raw_at, lines.pos IS NOT NULL AS full_line, gone.pos IS NOT NULL AS dead
           FROM raw LEFT JOIN lines USING (doc_id, raw_at) LEFT JOIN gone ON gone.doc_id = lines.doc_id
           AND gone.pos = lines.pos),
text AS (SELECT doc_id, count(*) FILTER (full_line) AS n_lines, count(*) FILTER (dead) AS n_removed,
                coalesce(string_agg(line, chr(10) ORDER BY raw_at) FILTER (NOT dead), '') AS text
         FROM marked GROUP BY doc_id)
SELECT d.doc_id, coalesce(t.n_lines, 0)::BIGINT AS n_lines, coalesce(t.n_removed, 0)::BIGINT AS n_removed,
       md5(CASE WHEN d.text IS NULL THEN NULL ELSE t.text END) AS text_md5
FROM documents d LEFT JOIN text t USING (doc_id)
"""


@query("op2_line_dedup", SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate_lines(documents(spark, sf_dir)).select(
        "doc_id", "n_lines", "n_removed", F.md5("text").alias("text_md5"))
