"""The pipeline against plain Python, stage by stage and as a whole."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from claritable.llm import mixing
from claritable.llm.tokens import vocabulary_path
from tests.llm.helpers import prose
from tests.llm.test_dedup import expected_exact, expected_groups, expected_quality, plain_print

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents():
    texts = [prose(k, 40 + 7 * k) for k in range(30)]
    texts += [texts[3], texts[3] + "  ", texts[5].replace(" ", "\n"), prose(4, 900), prose(4, 900) + " tail", "short", None,
              "again " * 50, prose(6, 2500), ""]
    return [(k, t, "en", ("a", "b", None)[k % 5 // 2], len(t or "")) for k, t in enumerate(texts)]


def plain_stages(rows):
    """Rows after each of the first four stages."""
    verdict = {key[0]: key[-1] for key in expected_quality(rows)}
    good = [r for r in rows if verdict[r[0]]]
    keep = {key[0] for key in expected_exact(good) if key[3]}
    exact = [r for r in good if r[0] in keep]
    prints = [(r[0], plain_print(r[1])) for r in exact]
    groups = expected_groups(prints)
    near = [r for r, (i, p) in zip(exact, prints, strict=True) if groups[p] == i]
    chars = Counter()
    for r in near:
        chars[r[3] or ""] += len(r[1])
    weights = {s: n ** mixing.POWER for s, n in chars.items()}
    mixed = []
    for r in near:
        source = r[3] or ""
        rate = weights[source] / sum(weights.values()) * sum(chars.values()) / chars[source]
        u = int(hashlib.md5(f"{mixing.SEED}:{r[0]}:1".encode()).hexdigest()[:13], 16) / 2 ** 52
        n, below = 0, math.exp(-rate)
        term = below
        while below <= u:
            n += 1
            term *= rate / n
            below += term
        mixed += [r] * n
    return good, exact, near, mixed


def plain_pieces(rows, end=0, capacity=2048):
    tokenizer = Tokenizer.from_file(vocabulary_path())
    tokenizer.encode_special_tokens = True
    out = Counter()
    for i, text, *_ in rows:
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, end], "<u4")
        first = len(ids) % capacity or min(len(ids), capacity)
        bounds = [0, *range(first, len(ids) + 1, capacity)]
        for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
            out[i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    return out


def test_pipeline(spark, tmp_path):
    rows = documents()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    wanted = plain_stages(rows)
    assert len(rows) > len(wanted[0]) > len(wanted[1]) > len(wanted[2])
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ")
        assert Counter(map(tuple, docs.collect())) == Counter(wanted[k]), name
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == plain_pieces(wanted[3])
    places = defaultdict(list)
    for r in got:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for members in places.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at
            at += length
        assert at <= 2048


def test_pipeline_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
