"""Centroid clusters, cached token counts and the conversation trie against plain Python."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from claritable.llm import centroids, prefix_trie, token_counts
from claritable.llm.tokens import vocabulary_path
from tests.llm.helpers import awkward, empty, prose, table

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def by_row(frame, *names):
    return Counter(tuple(r[n] for n in names) for r in frame.collect())


# Centroids

VECTORS = "vec_id long, embedding array<float>, label int, v string, cluster string, n long"


def vectors(spark, rows):
    return spark.createDataFrame([(i, x, 1, "v", None, 7) for i, x in rows], VECTORS).repartition(3)


def expected_clusters(rows, n, rounds):
    kept = [(i, [math.floor(1024 * float(np.float32(c))) for c in x]) for i, x in rows
            if x is not None and len(x) == 4 and all(c is not None and math.isfinite(c) for c in x)]
    hashed = sorted((i is None, hashlib.sha256(f"3:{i}".encode()).hexdigest() if i is not None else "",
                     np.array(x, "<i4").tobytes(), x) for i, x in kept)
    middle = [h[3] for h in hashed[:n]]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), k) for k, c in enumerate(middle))

    for _ in range(rounds):
        groups = defaultdict(list)
        for _, x in kept:
            groups[nearest(x)[1]].append(x)
        middle = [[sum(c) // len(groups[k]) for c in zip(*groups[k], strict=True)] if k in groups else m
                  for k, m in enumerate(middle)]
    found = [(i, *nearest(x)) for i, x in kept]
    inertia = Counter()
    for _, d, k in found:
        inertia[k] += d
    return Counter((i, k, d, inertia[k], sum(inertia.values()),
                    hashlib.sha256(",".join(map(str, middle[k])).encode()).hexdigest()) for i, d, k in found)


COLUMNS = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


@pytest.mark.parametrize("n,rounds", [(3, 4), (5, 0), (60, 2)])
def test_clusters(spark, n, rounds):
    r = random.Random(n)
    rows = [(i, [r.choice((-0.5, 0.0, 0.25, r.uniform(-1, 1))) for _ in range(4)]) for i in range(40)]
    rows += [(7, rows[7][1]), (None, [0.1, 0.2, 0.3, 0.4]), (50, None), (51, []), (52, [1.0] * 5), (53, [1.0, None, 0.0, 0.0]),
             (54, [1.0, math.nan, 0.0, 0.0]), (55, [math.inf, 0.0, 0.0, 0.0]), (56, [0.0] * 4), (57, [0.0] * 4)]
    got = centroids.clusters(vectors(spark, rows), n, rounds=rounds, size=4)
    assert by_row(got, *COLUMNS) == expected_clusters(rows, n, rounds)


def test_clusters_of_no_vectors_and_too_large_ones(spark):
    assert centroids.clusters(vectors(spark, [(1, None), (2, [1.0])])).collect() == []
    with pytest.raises(Exception, match="beyond"):
        centroids.clusters(vectors(spark, [(1, [1e9] * 4)]), size=4).collect()


@pytest.mark.parametrize("size,k,most", [(1, 9, 5), (64, 40, 900), (8, 1, 10), (16, 300, 1 << 24)])
def test_search_is_exact_and_passes_centroids_over(size, k, most):
    r = np.random.default_rng(size)
    middle, x = r.integers(-most, most + 1, (k, size)), r.integers(-most, most + 1, (700, size))
    middle[k // 2] = middle[0]
    if k > 100:  # vectors that lie near centroids
        x = np.clip(middle[r.integers(0, k, len(x))] + r.integers(-most // 50, most // 50, x.shape), -most, most)
    search = centroids.Search(middle)
    number, distance = search.nearest(x)
    every = ((x[:, None] - middle[None]) ** 2).sum(2)
    assert (number == every.argmin(1)).all() and (distance == every.min(1)).all()
    if k > 100:
        assert search.compared < 0.3 * k * len(x)


# Token counts

TEXTS = ["<|endoftext|>", "a<|startoftext|>b  c", "It's WE'LL 'S 12 3.4", "x́ ́y", " wide space\x1f.", "\x85",
         "İstanbul ẞ ﬁ", "emoji 😀😀 <|ENDOFTEXT|>", " \t lead and trail \r\n", "<| endoftext |>", "日本語テキスト", "a" * 5000]


def counted_whole(texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary_path(token_counts.VOCABULARY))
    return [len(tokenizer.encode(t or "", add_special_tokens=False).ids) for t in texts]


def test_words_count_as_whole_texts():
    r = random.Random(5)
    texts = TEXTS + ["".join(r.choice(" \t\n\x0b\x0cabéÅ'sS1.<|>́가") for _ in range(r.randrange(40)))
                     for _ in range(3000)] + [prose(k, 300) for k in range(5)]
    assert token_counts.Counter(vocabulary_path(token_counts.VOCABULARY), keep=10).count(texts) == counted_whole(texts)


def rows_of_texts():
    return awkward() + [(100 + k, t, "en", "s", 1, k, "m", None, "d") for k, t in enumerate(TEXTS)]


def expected_counts(rows):
    n = counted_whole([r[1] for r in rows])
    return Counter((r[0], len((r[1] or "").encode()), k, k > 2048) for r, k in zip(rows, n, strict=True))


def test_token_counts(spark, tmp_path):
    path, rows, cache = vocabulary_path(token_counts.VOCABULARY), rows_of_texts(), str(tmp_path / "cache")
    names = ("doc_id", "n_bytes", "n_tokens", "over_limit")
    assert by_row(token_counts.token_counts(table(spark, rows), cache), *names) == expected_counts(rows)
    folder = f"{cache}/version={token_counts.version_digest(path)}"
    distinct = len({SPACE.sub(" ", r[1] or "").strip(" ") for r in rows})
    assert spark.read.parquet(folder).count() == distinct
    # The same texts again and three more: only those are appended, and what is stored is believed.
    more = rows + [(200, "one more", "en", "s", 1, 0, "m", None, "d")] * 2 + [(201, " ONE", "en", "s", 1, 0, "m", None, "d"),
                                                                         (202, "two  more", "en", "s", 1, 0, "m", None, "d")]
    assert by_row(token_counts.token_counts(table(spark, more), cache), *names) == expected_counts(more)
    assert spark.read.parquet(folder).count() == distinct + 3
    stored = token_counts.cached(spark, cache, path).selectExpr("text_sha256", "n_tokens + 1000 AS n_tokens")
    other = str(tmp_path / "other")
    stored.write.parquet(f"{other}/version={token_counts.version_digest(path)}")
    got = by_row(token_counts.token_counts(table(spark, rows), other), *names)
    assert got == Counter({(i, b, n + 1000, n + 1000 > 2048): m for (i, b, n, _), m in expected_counts(rows).items()})


def test_hot_texts_doubled_entries_and_empty_table(spark, tmp_path):
    cache, path = str(tmp_path / "cache"), vocabulary_path(token_counts.VOCABULARY)
    rows = [(k, "same text here" if k % 3 else prose(k, 5), "en", "s", 1, k, "m", None, "d") for k in range(900)]
    for _ in range(2):
        token_counts.fill(table(spark, rows), cache, path)
    token_counts.cached(spark, cache, path).write.mode("append").parquet(
        f"{cache}/version={token_counts.version_digest(path)}")  # as two runs at a time would do
    got = token_counts.token_counts(table(spark, rows), cache)
    assert by_row(got, "doc_id", "n_bytes", "n_tokens", "over_limit") == expected_counts(rows)
    assert token_counts.token_counts(empty(spark), str(tmp_path / "none")).collect() == []


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_other_vocabularies_take_texts_as_they_are(spark, tmp_path, name):
    path = vocabulary_path(name)
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(
        table(spark, rows_of_texts()[-12:]), str(tmp_path), path).collect()}
    count = token_counts._whole_counter(path)
    assert got == {100 + k: count([t])[0] for k, t in enumerate(TEXTS)}
    assert got[108] != count([TEXTS[8].strip()])[0]


# Conversations

TURNS = "conv_id long, turn long, role string, text string, key string, block int, words string, depth int"


def turns(spark, rows):
    return spark.createDataFrame([(*r, "k", 1, None, 9) for r in rows], TURNS).repartition(3)


def expected_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    built = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = tuple(own.get(c - int(math.fmod(c, 20)), [])[:h] + t[h:])
    members = defaultdict(list)
    for c, t in built.items():
        for d in range(len(t) + 1):
            members[t[:d]].append(c)
    below = defaultdict(list)
    for node in members:
        for d in range(len(node) + 1):
            below[node[:d]].append(node)
    children = Counter(node[:-1] for node in members if node)

    def words(node):
        return sum(1 for w in SPACE.split(node[-1][1]) if w) if node else 0

    out = Counter()
    for node, ids in members.items():
        ends = sorted(c for c in ids if built[c] == node)
        out[min(ids), len(node), min(members[node[:-1]]) if node else None, len(ids), children[node],
            sum(1 for x in below[node] if not children[x]), sum((len(members[x]) - 1) * words(x) for x in below[node]),
            hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()] += 1
    return out


NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def chats(seed, n, most):
    r = random.Random(seed)
    rows = []
    for c in range(n):
        for turn in range(r.randrange(1, most)):
            rows.append((c, turn, ("user", "assistant")[turn % 2], r.choice(("yes", "no thanks", " a  b c ", "")) if turn else "system"))
    return rows


@pytest.mark.parametrize("block", [1, 3, 20, 1000])
def test_trie(spark, block):
    rows = chats(1, 90, 7)
    rows += [(200 + k, t, "user", "hello there") for k in range(30) for t in range(4)]  # alike, over several blocks
    rows += [(300, t, "user", f"turn {t}") for t in range(300)] + [(301, None, "user", "first"), (301, 0, None, None)]
    rows += [(-7, 0, "user", "minus"), (-20, 1, "x", "y"), (None, 0, "user", "nobody"), (302, None, None, None), (302, None, None, None)]
    rows += [(400 + k, 0, "user", "gone") for k in range(1, 15)]  # turnless where the opening is taken from nowhere
    rows += [(500, 0, "us", "er1"), (503, 0, "use", "r1")]
    got = by_row(prefix_trie.prefix_trie(turns(spark, rows), block), *NODE)
    assert got == expected_trie(rows)
    assert {r[1] for r in got} >= {0, 300}


@pytest.mark.parametrize("rows", [[], [(None, 0, "user", "x")], [(k, 0, "user", "x") for k in range(1, 20)
                                                               if zlib.crc32(str(k).encode()) % 4]])
def test_trie_without_turns(spark, rows):
    got = by_row(prefix_trie.prefix_trie(turns(spark, rows), 4), *NODE)
    assert got == expected_trie(rows)
    assert sum(got.values()) == (1 if len(rows) > 1 else 0)


def test_extents_by_brute_force():
    r = np.random.default_rng(3)
    for n in (1, 2, 7, 64, 100):
        lcp = r.integers(0, 4, n)
        lcp[0] = 0
        at, depth = np.repeat(np.arange(n), 4), np.tile(np.arange(1, 5), n)
        left, right = prefix_trie.extents(prefix_trie.sparse_table(lcp), at, depth)
        for a, d, x, y in zip(at, depth, left, right, strict=True):
            i, j = a, a
            while i > 0 and lcp[i] >= d:
                i -= 1
            while j + 1 < n and lcp[j + 1] >= d:
                j += 1
            assert (i, j) == (x, y)
        wide = r.integers(0, 1000, n)
        lo = r.integers(0, n, 50)
        hi = np.minimum(n - 1, lo + r.integers(0, n, 50))
        assert prefix_trie.least(prefix_trie.sparse_table(wide), lo, hi).tolist() == [
            int(wide[a:b + 1].min()) for a, b in zip(lo, hi, strict=True)]
