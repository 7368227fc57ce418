"""Mixing sources to target weights by Poisson replication. DataFrame functions only.

Each source gets a mean repetition rate: its share of the target over its share of the characters. A document is
repeated as often as a Poisson variable of that mean says, which is drawn by inverting the distribution at a uniform
number made from a hash of seed and id: the count is how many values of the cumulative distribution are at or below it.
Every document draws alone, so hot sources need no split and no counts are gathered but the totals of each source.
Copies then go to the place that a hash of seed, id and copy gives: the hash itself says the partition, since hashes
are even, so no range has to be sampled, and rows are sorted by it within.

A mean above ``PART`` is drawn as a sum of independent parts, so that no term underflows.

Cases: a null source is a source of its own; a null text has no characters; a source without characters keeps rate
one; a null id draws by a hash of the text; repeated rows of one id draw the same count; weights of sources that the
table lacks go to the others in proportion; an empty table gives an empty result; all columns are kept.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claritable.llm.common import documents, nested, query, settle, unnested

SEED = 17
#: Default target: shares in proportion to characters to this power, which lifts small sources.
POWER = 0.7
#: Largest mean of one draw, and sources whose rates may be sent to all tasks.
PART = 256
MOST_SOURCES = 10_000


def uniform(*parts: Column) -> Column:
    """An even number from 0 up to 1 with 52 bits, from the MD5 of the parts."""
    digest = F.md5(F.concat_ws(":", *parts))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def source_rates(docs: DataFrame, weights: Mapping[str, float] | None = None, power: float = POWER,
                 text_column: str = "text", source_column: str = "source") -> DataFrame:
    """``_source, rate``: mean repetitions of each source; the mix has as many characters as the table on average."""
    size = F.coalesce(F.length(text_column), F.lit(0)).cast("long")
    totals = settle(docs.groupBy(F.coalesce(F.col(source_column), F.lit("")).alias("_source")).agg(
        F.sum(size).alias("chars")))
    if weights is None:
        weight = F.pow(F.col("chars").cast("double"), F.lit(power))
    else:
        given = F.create_map(*[F.lit(x) for k, v in weights.items() for x in (k, float(v))])
        weight = F.coalesce(given[F.col("_source")], F.lit(0.0))
    totals = totals.withColumn("weight", weight)
    chars, all_weights = totals.agg(F.sum("chars"), F.sum(F.when(F.col("chars") > 0, F.col("weight")))).first()
    rate = F.col("weight") / F.lit(float(all_weights or 1)) * F.lit(float(chars or 0)) / F.col("chars")
    return totals.select("_source", F.when((F.col("chars") > 0), rate).otherwise(F.lit(1.0)).alias("rate"))


def distribution(rates: DataFrame) -> DataFrame:
    """Add ``parts``, the number of draws, and ``cdf``, the cumulative distribution of one draw from 0 on."""
    rates = rates.withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / PART).cast("int")))
    rates = rates.withColumn("mean", F.col("rate") / F.col("parts"))
    start = F.exp(-F.col("mean"))
    state = F.struct(start.alias("term"), start.alias("sum"), F.array(start).alias("cdf"))
    last = (F.col("mean") + 12 * F.sqrt("mean") + 30).cast("int")

    def step(a: Column, k: Column) -> Column:
        term = a["term"] * F.col("mean") / k
        return F.struct(term.alias("term"), (a["sum"] + term).alias("sum"),
                        F.concat(a["cdf"], F.array(a["sum"] + term)).alias("cdf"))

    return rates.select("_source", "parts", F.aggregate(
        F.sequence(F.lit(1), last), state, step, lambda a: a["cdf"]).alias("cdf"))


def mix(docs: DataFrame, weights: Mapping[str, float] | None = None, power: float = POWER, seed: int = SEED,
        partitions: int | None = None, id_column: str = "doc_id", text_column: str = "text",
        source_column: str = "source") -> DataFrame:
    """``docs`` with each row as often as drawn, in a global order by hash; adds ``copy`` and ``shuffle_key``."""
    spark = docs.sparkSession
    rates = distribution(source_rates(docs, weights, power, text_column, source_column))
    # A rate for each source: sent to all tasks if there are few, joined like any table if not.
    few = rates.select("_source").limit(MOST_SOURCES + 1).count() <= MOST_SOURCES
    marked = nested(docs, _source=F.coalesce(F.col(source_column), F.lit("")), _own=F.coalesce(
        F.col(id_column).cast("string"), F.md5(F.coalesce(F.col(text_column), F.lit("")))))
    drawn = marked.join(F.broadcast(rates) if few else rates, "_source")
    count = F.aggregate(F.transform(F.sequence(F.lit(1), F.col("parts")), lambda j: uniform(
        F.lit(str(seed)), F.col("_own"), j.cast("string"))), F.lit(0), lambda n, u: n + F.size(
            F.filter("cdf", lambda c: c <= u)))
    copies = drawn.withColumn("_n", count).where("_n > 0").withColumn(
        "copy", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    copies = copies.withColumn("shuffle_key", F.md5(F.concat_ws(
        ":", F.lit(str(seed)), F.lit("order"), "_own", F.col("copy").cast("string"))))
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    place = F.floor(F.conv(F.substring("shuffle_key", 1, 8), 16, 10).cast("long") * n / F.lit(1 << 32)).cast("int")
    placed = copies.drop("cdf", "parts").repartitionById(n, place).sortWithinPartitions("shuffle_key")
    return unnested(placed, docs, copy=F.col("copy"), shuffle_key=F.col("shuffle_key"))


SQL = f"""
WITH RECURSIVE d AS (SELECT *, coalesce(source, '') AS host, coalesce(length(text), 0) AS chars FROM documents),
totals AS (SELECT host, sum(chars)::BIGINT AS chars, pow(sum(chars)::DOUBLE, {POWER}) AS weight FROM d GROUP BY host),
rates AS (SELECT host, weight / (SELECT sum(weight) FROM totals) * (SELECT sum(chars)::DOUBLE FROM totals) / chars
                 AS rate FROM totals),
p AS (SELECT host, rate, 0 AS k, exp(-rate) AS term, exp(-rate) AS cum FROM rates
      UNION ALL
      SELECT host, rate, k + 1, term * rate / (k + 1), cum + term * rate / (k + 1) FROM p WHERE k < rate + 60),
u AS (SELECT *, ('0x' || substr(md5('{SEED}:' || doc_id || ':1'), 1, 13))::BIGINT / 4503599627370496.0 AS x FROM d),
n AS (SELECT u.doc_id, u.source, u.text, (SELECT count(*) FROM p WHERE p.host = u.host AND p.cum <= u.x) AS n FROM u),
c AS (SELECT doc_id, source, text, unnest(range(n))::INTEGER AS copy FROM n)
SELECT doc_id, source, text, copy, md5('{SEED}:order:' || doc_id || ':' || copy) AS shuffle_key FROM c
"""


@query("op8_mix_sources", SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select("doc_id", "source", "text", "copy", "shuffle_key")
