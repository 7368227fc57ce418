"""Quality rules: size, repetition, and lines that many documents of a host share. DataFrame functions only.

Cross-document line frequency: the distinct normalised lines of a document are hashed, the documents that hold a line
are counted for each host, and a line of more documents than the limit is removed everywhere but in the host's first
document (smallest id) that has it. A document of which too little is left is rejected. The limit follows the size of
the host, so it behaves alike on any amount of data.

Counts and verdicts need one shuffle of (host, line hash) with counts combined before it, and one join of the lines
with the few that are above the limit, whose hot keys the skew handling of the join splits. Texts are not shuffled for
this; ``drop_poor`` joins the verdicts and the removed lines to the texts by row key.

Cases: a null or blank text has no words and fails; a null host is a host of its own; a document with a null id is
never a host's first one; each row is a document, repeated rows too; texts are taken whole; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claritable.llm.common import SPACE_RUN, WORD, documents, nested, query, same, settle, trimmed, words_of

MIN_WORDS = 20
WINDOW = 8
MAX_REPEAT_PERCENT = 30
#: A line is above the limit in more than so many documents of a host and in more than one of ``HOST_SHARE`` of them.
MIN_DOCS = 20
HOST_SHARE = 20
#: A document is depleted if less than one of ``DEPLETED_SHARE`` words of its lines is left, or less than half of them
#: and fewer than ``MIN_WORDS``.
DEPLETED_SHARE = 5
SYMBOLS = "[#*$%&|<>]"


def normal_line(line: Column) -> Column:
    return F.lower(F.regexp_replace(trimmed(line), SPACE_RUN, " "))


def _with_repeats(rows: DataFrame) -> DataFrame:
    """Add ``n_repeat_words``, the words inside windows (given as hashes in order) that occur twice or more.

    Each step is a projection of its own: what a lambda reads besides its element must be a column, or it would be
    computed anew for every element.
    """
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    rows = rows.withColumn("placed", F.when(F.col("repeats"), F.array_sort(
        F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(none))
    rows = rows.withColumn("at", F.array_sort(F.transform(F.filter("placed", lambda s, k: (
        F.coalesce(F.get("placed", k - 1)["h"] == s["h"], F.lit(False))
        | F.coalesce(F.get("placed", k + 1)["h"] == s["h"], F.lit(False)))), lambda s: s["i"])))
    # Each place covers the words up to the next one, at most a window.
    cover = F.transform("at", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get("at", k + 1) - p, F.lit(WINDOW))))
    return rows.withColumn("n_repeat_words", F.aggregate(cover, F.lit(0), lambda a, x: a + x))


def features(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
             host_column: str = "source") -> DataFrame:
    """A row for each document with the rules' counts and its distinct lines as (hash, number of words)."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    rows = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(host_column), F.lit("")).alias("host"),
                       F.xxhash64(text_column).alias("mark"), text.alias("text"), words_of(text).alias("words"), F.split(text, "\n").alias("lines"))
    rows = rows.select(
        "*", F.size("words").alias("n_words"),
        F.filter("lines", lambda x: x.rlike(WORD)).alias("full"),
        F.when(F.size("words") >= WINDOW, F.transform(
            F.sequence(F.lit(1), F.size("words") - WINDOW + 1), lambda i: F.xxhash64(F.slice("words", i, WINDOW)),
        )).otherwise(F.array().cast("array<bigint>")).alias("windows"))
    rows = rows.select(
        "*", (F.size(F.array_distinct("windows")) < F.size("windows")).alias("repeats"),
        F.array_distinct(F.transform("full", normal_line)).alias("normal"))
    return _with_repeats(rows).select(
        F.monotonically_increasing_id().alias("row"), "doc_id", "host", "mark", F.col("n_words").cast("long"),
        F.length(F.regexp_replace("text", SPACE_RUN, "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("full") - F.size(F.array_distinct("full"))).cast("long").alias("n_dup_lines"),
        F.col("n_repeat_words").cast("long"),
        F.transform("normal", lambda x: F.struct(
            F.xxhash64(x).alias("line"), F.size(F.split(x, " ")).cast("long").alias("words"))).alias("lines"))


def line_frequency(lines: DataFrame, hosts: DataFrame, min_docs: int = MIN_DOCS,
                   host_share: int = HOST_SHARE) -> DataFrame:
    """``host, line, first_id`` of the lines above the limit."""
    counts = lines.groupBy("host", "line").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))
    return (counts.where(F.col("n") > min_docs).join(hosts, "host")
            .where(F.col("n") * host_share > F.col("host_docs")).select("host", "line", "first_id"))


def assess(docs: DataFrame, min_words: int = MIN_WORDS, max_repeat_percent: int = MAX_REPEAT_PERCENT,
           min_docs: int = MIN_DOCS, host_share: int = HOST_SHARE, depleted_share: int = DEPLETED_SHARE,
           id_column: str = "doc_id", text_column: str = "text", host_column: str = "source") -> DataFrame:
    """A row for each row of ``docs``: the counts, ``removed_words`` in lines above the limit, hashes of
    these lines (null if none), and the verdicts."""
    rows = settle(features(docs, id_column, text_column, host_column))
    lines = rows.select("row", "doc_id", "host", F.explode("lines").alias("l")).select(
        "row", "doc_id", "host", "l.line", "l.words")
    hosts = rows.groupBy("host").agg(F.count("*").alias("host_docs"))
    above = settle(line_frequency(lines, hosts, min_docs, host_share))
    removed = (lines.join(above, ["host", "line"]).where(~F.col("doc_id").eqNullSafe(F.col("first_id")))
               .groupBy("row").agg(F.sum("words").alias("removed_words"), F.collect_set("line").alias("removed_lines")))
    total = F.aggregate("lines", F.lit(0).cast("long"), lambda a, x: a + x["words"])
    removed_words = F.coalesce(F.col("removed_words"), F.lit(0).cast("long"))
    judged = rows.join(removed, "row", "left").select(
        "doc_id", "host", "mark", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        removed_words.alias("removed_words"), (total - removed_words).alias("left_words"), total.alias("line_words"),
        "removed_lines")
    failed = (F.col("n_words") < min_words) | (
        F.col("n_repeat_words") * 100 > F.col("n_words") * max_repeat_percent)
    depleted = (F.col("removed_words") > 0) & (
        ((F.col("left_words") < min_words) & (F.col("left_words") * 2 < F.col("line_words")))
        | (F.col("left_words") * depleted_share < F.col("line_words")))
    return judged.select("*", failed.alias("base_failed"), depleted.alias("depleted"),
                         (~failed & ~depleted).alias("kept"))


def drop_poor(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", host_column: str = "source",
              **rules) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns and the lines above the limit removed.

    Rows of the same id, host and text get the same verdict and text, and are dropped or kept together. Lines without
    a word stay, and so do all other columns, even if they describe the whole text.
    """
    options = {"id_column": id_column, "text_column": text_column, "host_column": host_column, **rules}
    keys = ["_id", "_host", "_mark"]
    found = assess(docs, **options).where(~F.col("kept") | F.col("removed_lines").isNotNull()).groupBy(
        F.col("doc_id").alias("_id"), F.col("host").alias("_host"), F.col("mark").alias("_mark")).agg(
        F.first("kept").alias("_kept"), F.first("removed_lines").alias("_gone"))
    marked = nested(docs, _id=F.col(id_column), _mark=F.xxhash64(text_column), _text=F.col(text_column),
                    _host=F.coalesce(F.col(host_column), F.lit("")))
    good = marked.alias("a").join(found.alias("b"), same(*keys)("a", "b"), "left").where("_kept is null or _kept")
    text = F.when(F.col("_gone").isNull(), F.col("_text")).otherwise(F.array_join(F.filter(
        F.split("_text", "\n"), lambda x: ~F.array_contains("_gone", F.xxhash64(normal_line(x)))), "\n"))
    columns = [text.alias(name) if name.lower() == text_column.lower() else F.col("doc")[name].alias(name)
               for name in docs.columns]
    return good.select(*columns)


SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
win AS (SELECT doc_id, i, array_to_string(words[i:i + 7], ' ') AS w
        FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM d WHERE len(words) >= 8)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS n FROM win) WHERE n > 1),
covered AS (SELECT doc_id, sum(c) AS n FROM (
              SELECT doc_id, least(8, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 8)) AS c FROM twice)
            GROUP BY doc_id),
raw AS (SELECT doc_id, host, line FROM (SELECT doc_id, host, unnest(string_split(text, chr(10))) AS line FROM d)
        WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM raw GROUP BY doc_id),
lines AS (SELECT DISTINCT doc_id, host,
                 lower(trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'))) AS line FROM raw),
sized AS (SELECT *, len(string_split(line, ' ')) AS words FROM lines),
hosts AS (SELECT host, count(*) AS host_docs FROM d GROUP BY host),
above AS (SELECT host, line, first_id FROM (
            SELECT host, line, count(*) AS n, min(doc_id) AS first_id FROM sized GROUP BY host, line)
          JOIN hosts USING (host) WHERE n > {MIN_DOCS} AND n * {HOST_SHARE} > host_docs),
gone AS (SELECT doc_id, sum(words) AS n FROM sized JOIN above USING (host, line) WHERE doc_id <> first_id
         GROUP BY doc_id),
total AS (SELECT doc_id, sum(words) AS n FROM sized GROUP BY doc_id),
counts AS (SELECT d.doc_id, len(d.words) AS n_words,
                  length(regexp_replace(d.text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
                  length(d.text) - length(regexp_replace(d.text, '{SYMBOLS}', '', 'g')) AS n_symbols,
                  coalesce(dup.n, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words,
                  coalesce(gone.n, 0) AS removed_words, coalesce(total.n, 0) AS line_words
           FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN covered USING (doc_id) LEFT JOIN gone USING (doc_id)
           LEFT JOIN total USING (doc_id)),
judged AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
                  removed_words > 0 AND (
                    line_words - removed_words < {MIN_WORDS} AND 2 * (line_words - removed_words) < line_words
                    OR (line_words - removed_words) * {DEPLETED_SHARE} < line_words) AS depleted FROM counts)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT base_failed AND NOT depleted AS kept, removed_words::BIGINT AS removed_words
FROM judged
"""


@query("op3_quality_rules", SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assess(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "removed_words")
