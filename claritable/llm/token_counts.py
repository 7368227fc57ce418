"""Token counts of whole texts, kept in a digest cache: no text is encoded twice, in this run or a later one.

A text's entry has two keys: the SHA-256 of its normalised content, and a digest of all that a count rests on (the bytes
of the vocabulary file, the library and its version, the normalisation). A run joins the digests of its texts to the
entries of its tokenizer version, encodes the distinct texts that have none, appends their counts, and reads the counts
of all rows back from the cache. The cache is a folder of Parquet files in a folder for each version; appending adds
whole files or none, and entries that two runs add at the same time are alike, so one of them is read.

Normalised content, by vocabulary: where the tokenizer drops white space and splits there (``word_bpe_49k``), runs of the
six ASCII white space characters count as one space and none at either end. The tokens cannot differ: no character
composes with a space, no token holds one, and the special strings have none. Any other vocabulary takes texts as they
are. By the same rule the tokens of a text are those of its words, and each word is encoded once per Python worker.

Digests travel, and texts only to meet their like: compressed, one for each digest and map task, so copies that fill a
third of all rows are combined before the shuffle. The counts of digests that hold a thousandth of all rows or more, of
which there are at most a thousand, are broadcast to their rows; the others are joined.

Cases: a null text counts as empty; empty and blank texts have no tokens; repeated rows and null ids keep their rows;
special strings are found in texts, as is the libraries' default; an empty table gives an empty result and an empty cache;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claritable.llm.common import SPACE_RUN, documents, query, settle, shared_dir, trimmed
from claritable.llm.tokens import vocabulary_path

VOCABULARY = "word_bpe_49k.json"
LIMIT = 2048
#: Vocabularies whose tokenizers drop white space and never join what lies around it.
SPACELESS = ("word_bpe_49k.json",)
#: Share of all rows from which a digest's count is broadcast: at most ``HOT`` digests reach it.
HOT = 1000
_KEEP = 400_000
_SPACES = re.compile(r"[ \t-\r]+")
_ENTRY = "text_sha256 binary, n_tokens long"


def version_digest(path: str) -> str:
    """Names what counts rest on."""
    name = os.path.basename(path)
    if name.endswith(".model"):
        import sentencepiece as library
    else:
        import tokenizers as library
    with open(path, "rb") as file:
        held = hashlib.file_digest(file, "sha256").hexdigest()
    rule = "spaces" if name in SPACELESS else "whole"
    return hashlib.sha256(f"{library.__name__} {library.__version__} {held} {rule}".encode()).hexdigest()


def normalised(text, path: str):
    """The content that decides the tokens."""
    whole = F.coalesce(text, F.lit(""))
    if os.path.basename(path) not in SPACELESS:
        return whole
    return trimmed(F.regexp_replace(whole, SPACE_RUN, " "))


def _whole_counter(path: str) -> Callable[[list[str]], list[int]]:
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return lambda texts: [len(x) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


class Counter:
    """``count(texts)`` gives the number of tokens of each whole text; holds at most ``keep`` words beside a batch's own."""

    def __init__(self, path: str, keep: int = _KEEP):
        self.whole, self.words = _whole_counter(path), os.path.basename(path) in SPACELESS
        self.keep, self.known = keep, {}

    def count(self, texts: list[str]) -> list[int]:
        if not self.words:
            return self.whole(texts)
        if len(self.known) > self.keep:
            self.known = {}
        known = self.known
        split = [_SPACES.split(text) for text in texts]
        new = list({word for words in split for word in words if word not in known})
        known.update(zip(new, self.whole(new), strict=True))
        return [sum(map(known.__getitem__, words)) for words in split]


_counters: dict[str, Counter] = {}


def _packed(rows: DataFrame) -> DataFrame:
    """``text_sha256, text`` with each text compressed."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            texts = [pack(x.as_py().encode()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary())], ["text_sha256", "text"])

    return rows.mapInArrow(scan, "text_sha256 binary, text binary")


def _counted(rows: DataFrame, path: str) -> DataFrame:
    """Entries of distinct packed texts."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        if path not in _counters:
            _counters[path] = Counter(path)
        counter = _counters[path]
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                n = counter.count([unpack(x.as_py()).decode() for x in part.column(1)])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64())], ["text_sha256", "n_tokens"])

    return rows.mapInArrow(scan, _ENTRY)


def cached(spark: SparkSession, cache: str, path: str) -> DataFrame:
    """``text_sha256, n_tokens`` of the tokenizer version, one entry for each digest."""
    folder = f"{cache}/version={version_digest(path)}"
    there = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
        return spark.createDataFrame([], _ENTRY)
    return spark.read.schema(_ENTRY).parquet(folder).groupBy("text_sha256").agg(F.min("n_tokens").alias("n_tokens"))


def fill(docs: DataFrame, cache: str, path: str, text_column: str = "text") -> None:
    """Append the counts of the distinct texts of ``docs`` that the cache lacks."""
    spark = docs.sparkSession
    content = normalised(F.col(text_column), path)
    known = cached(spark, cache, path)
    texts = docs.select(F.unhex(F.sha2(content, 256)).alias("text_sha256"), content.alias("text"))
    # One text for each digest and map task is moved, and stays where its digest meets the cache.
    distinct = _packed(texts).groupBy("text_sha256").agg(F.first("text").alias("text"))
    misses = distinct.join(known.select("text_sha256"), "text_sha256", "left_anti")
    _counted(misses, path).write.mode("append").parquet(f"{cache}/version={version_digest(path)}")


def token_counts(docs: DataFrame, cache: str, path: str | None = None, limit: int = LIMIT,
                 id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for each row of ``docs``, read from the cache after filling it."""
    path = path or vocabulary_path(VOCABULARY)
    fill(docs, cache, path, text_column)
    text = F.coalesce(F.col(text_column), F.lit(""))
    rows = settle(docs.select(
        F.col(id_column).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"),
        F.unhex(F.sha2(normalised(F.col(text_column), path), 256)).alias("text_sha256")))
    entries = cached(docs.sparkSession, cache, path)
    share = max(2, -(-rows.count() // HOT))
    often = rows.groupBy("text_sha256").count().where(F.col("count") >= share).select("text_sha256")
    hot = settle(entries.join(often, "text_sha256", "left_semi")).withColumnRenamed("n_tokens", "hot_tokens")
    marked = rows.join(F.broadcast(hot), "text_sha256", "left")
    rest = marked.where("hot_tokens IS NULL").drop("hot_tokens").join(entries, "text_sha256")
    frequent = marked.where("hot_tokens IS NOT NULL").withColumnRenamed("hot_tokens", "n_tokens")
    return rest.unionByName(frequent).select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


@query("op12_token_counts")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A cache of its own for each call, so that every call does the whole work; token_counts takes a lasting one.
    return token_counts(documents(spark, sf_dir), f"{shared_dir(spark)}/token-counts-{uuid.uuid4().hex}")
