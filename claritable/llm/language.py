"""Language identification with a convolutional network over bytes, trained here in numpy.

Bytes get embeddings; filters of several widths run over windows of fixed length, the maximum of each filter over a
window is its feature, and a softmax layer turns features into languages. A text is cut into windows from its first to
its last byte; the prediction is the mean of their probabilities, so all of the text counts.

Training fits on a sample: of each language about ``PER_LANGUAGE`` labelled documents, chosen by a hash of the id
against the language's count, ``PARTS`` excerpts of each; at most ``MOST_LANGUAGES`` languages, the most frequent ones.
That bounds what the driver holds. Documents whose CRC-32 of the id is divisible by 5 are never trained on. Label,
source and id are no inputs of a prediction.

Predicting needs no convolution at run time: the sum of two neighbouring bytes through a filter depends on the two
bytes alone, so all such sums are tabled once in each worker and looked up for whole batches of windows.

Cases: a null text and one without letters give ``und`` with score 0; a null id counts as an empty one; without any
labelled row all texts are ``und``; repeated rows are predicted alike; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claritable.llm.common import documents, query

PER_LANGUAGE = 1000
MOST_LANGUAGES = 100
PARTS = 3
#: Bytes of a window, filters of each width, size of an embedding.
WINDOW = 256
FILTERS = 12
SIZE = 8
WIDTHS = (2, 3, 4)
EPOCHS = 8
_LETTER = re.compile(r"[^\W\d_]")
#: Windows that are looked up at once.
_AT_ONCE = 256


def windows_of(data: bytes, window: int = WINDOW) -> np.ndarray:
    """All bytes in rows of ``window``; the last row is filled up with zeros."""
    rows = -(-len(data) // window)
    return np.frombuffer(data.ljust(rows * window, b"\0"), np.uint8).reshape(rows, window)


@dataclass
class ByteNetwork:
    """Weights: ``embed`` (256, size), ``conv[k]`` (width, size, filters), ``bias[k]``, ``out``, ``out_bias``."""

    languages: list[str]
    embed: np.ndarray
    conv: list[np.ndarray]
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray

    @classmethod
    def fresh(cls, languages: list[str], seed: int) -> ByteNetwork:
        r = np.random.default_rng(seed)
        draw = lambda scale, *shape: (r.standard_normal(shape) * scale).astype(np.float32)
        return cls(languages, draw(0.5, 256, SIZE), [draw((w * SIZE) ** -0.5, w, SIZE, FILTERS) for w in WIDTHS],
                   [np.zeros(FILTERS, np.float32) for _ in WIDTHS],
                   draw(0.2, FILTERS * len(WIDTHS), len(languages)), np.zeros(len(languages), np.float32))

    def weights(self) -> list[np.ndarray]:
        return [self.embed, *self.conv, *self.bias, self.out, self.out_bias]

    def gradients(self, rows: np.ndarray, labels: np.ndarray) -> list[np.ndarray]:
        """Of the mean loss over a batch; only the places of the maxima have a share."""
        n, length = rows.shape
        x = self.embed[rows]
        features, places = [], []
        for w, kernel, bias in zip(WIDTHS, self.conv, self.bias, strict=True):
            y = sum(x[:, j:length - w + 1 + j] @ kernel[j] for j in range(w)) + bias
            at = y.argmax(1)
            places.append(at)
            features.append(np.take_along_axis(y, at[:, None], 1)[:, 0])
        raw = np.concatenate(features, 1)
        hidden = np.maximum(raw, 0)
        scores = softmax(hidden @ self.out + self.out_bias)
        scores[np.arange(n), labels] -= 1
        scores /= n
        back = (scores @ self.out.T) * (raw > 0)
        d_embed, d_conv, d_bias = np.zeros_like(self.embed), [], []
        for k, (w, kernel, at) in enumerate(zip(WIDTHS, self.conv, places, strict=True)):
            g = back[:, k * FILTERS:(k + 1) * FILTERS]
            d_kernel = np.zeros_like(kernel)
            for j in range(w):
                used = np.take_along_axis(rows, at + j, 1)
                d_kernel[j] = np.einsum("nfe,nf->ef", self.embed[used], g)
                np.add.at(d_embed, used, g[:, :, None] * kernel[j].T[None])
            d_conv.append(d_kernel)
            d_bias.append(g.sum(0))
        return [d_embed, *d_conv, *d_bias, hidden.T @ scores, scores.sum(0)]

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Sums of two bytes through filters, and of the odd last byte: what prediction looks up."""
        def pair(kernel: np.ndarray) -> np.ndarray:
            return ((self.embed @ kernel[0])[:, None] + (self.embed @ kernel[1])[None]).reshape(65536, FILTERS)

        two, three, four = self.conv
        return (np.concatenate([pair(two), pair(three[:2]), pair(four[:2]), pair(four[2:])], 1),
                self.embed @ three[2])

    def predict(self, rows: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Probabilities of windows."""
        pairs, single = tables
        found = []
        for at in range(0, len(rows), _AT_ONCE):
            part = rows[at:at + _AT_ONCE]
            looked = pairs[part[:, :-1].astype(np.int32) * 256 + part[:, 1:]]
            f = FILTERS
            raw = [looked[:, :, :f].max(1), (looked[:, :-1, f:2 * f] + single[part[:, 2:]]).max(1),
                   (looked[:, :-2, 2 * f:3 * f] + looked[:, 2:, 3 * f:]).max(1)]
            hidden = np.maximum(np.concatenate([x + b for x, b in zip(raw, self.bias, strict=True)], 1), 0)
            found.append(softmax(hidden @ self.out + self.out_bias))
        return np.concatenate(found)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(texts: list[str], labels: list[str], epochs: int = EPOCHS, seed: int = 5, rate: float = 0.01,
          batch: int = 64) -> ByteNetwork:
    """Fit a network to windows of the texts with Adam."""
    languages = sorted(set(labels))
    known = {x: k for k, x in enumerate(languages)}
    net, r = ByteNetwork.fresh(languages, seed), np.random.default_rng(seed)
    if len(languages) < 2:
        return net
    rows, targets = [], []
    for text, label in zip(texts, labels, strict=True):
        data = text.encode()
        # A window, and a short piece, so that short texts and last windows are known too.
        for size in (WINDOW, int(r.integers(24, WINDOW))):
            if data:
                rows.append(windows_of(data[:size])[0])
                targets.append(known[label])
    rows, targets = np.stack(rows), np.array(targets)
    mean = [np.zeros_like(w) for w in net.weights()]
    square = [np.zeros_like(w) for w in net.weights()]
    step = 0
    for epoch in range(epochs):
        order = r.permutation(len(rows))
        pace = rate * (1 - epoch / epochs)
        for at in range(0, len(order), batch):
            step += 1
            own = order[at:at + batch]
            for w, g, m, v in zip(net.weights(), net.gradients(rows[own], targets[own]), mean, square, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= pace * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return net


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def training_texts(docs: DataFrame, per_language: int = PER_LANGUAGE, most_languages: int = MOST_LANGUAGES,
                   parts: int = PARTS, id_column: str = "doc_id", text_column: str = "text",
                   label_column: str = "lang") -> tuple[list[str], list[str]]:
    """Excerpts of a bounded sample of labelled documents, and their labels."""
    labelled = docs.where(F.col(label_column).isNotNull() & ~held_out(F.col(id_column))).select(
        F.col(label_column).alias("lang"), F.col(id_column).cast("string").alias("id"), F.col(text_column).alias("text"))
    counts = labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_languages).collect()
    if not counts:
        return [], []
    share = F.create_map(*[F.lit(x) for row in counts for x in (row["lang"], per_language / row["count"])])
    chance = F.pmod(F.xxhash64(F.lit("sample"), "id"), F.lit(1 << 30)) / F.lit(1 << 30)
    chosen = labelled.where(chance < share[F.col("lang")]).where(F.col("text").rlike(r"\p{L}"))
    place = F.pmod(F.xxhash64(F.lit("place"), "id", "part"),
                   F.greatest(F.length("text") - WINDOW, F.lit(0)) + 1).cast("int") + 1
    excerpts = (chosen.withColumn("part", F.explode(F.array(*map(F.lit, range(parts)))))
                .select("lang", "id", "part", F.col("text").substr(place, F.lit(WINDOW)).alias("excerpt")))
    rows = sorted(tuple(x) for x in excerpts.limit(2 * per_language * len(counts) * parts).collect())
    return [x[3] for x in rows], [x[0] for x in rows]


def identify(docs: DataFrame, net: ByteNetwork, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of each row."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = net.tables()
        for batch in batches:
            names, scores = [], []
            for value in batch.column(2):
                text = value.as_py()
                if not net.languages or not text or not _LETTER.search(text):
                    names.append("und")
                    scores.append(0.0)
                    continue
                mean = net.predict(windows_of(text.encode()), tables).mean(0)
                names.append(net.languages[int(mean.argmax())])
                scores.append(float(min(1, mean.max())))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()),
                                              pa.array(scores, pa.float64())],
                                             ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col(id_column).alias("doc_id"), held_out(F.col(id_column)).alias("held_out"),
                       F.col(text_column).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(scan, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


@query("op6_language_id")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return identify(docs, train(*training_texts(docs)))
