"""Scans, token files, packing, mixing and language identification."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations_with_replacement

import numpy as np
import pytest
from pyspark.sql import functions as F

from claritable.llm import language, mixing, packing, pii, secrets, token_files
from claritable.llm.common import shared_dir
from claritable.llm.spans import joined
from claritable.llm.tokens import Encoder, vocabulary_path
from tests.llm.helpers import awkward, empty, prose, table

DOCUMENTS = "/root/testdata/sf0.001/documents.parquet"


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer
    found = Tokenizer.from_file(vocabulary_path())
    found.encode_special_tokens = True
    return found


def ids_of(tokenizer, text, end):
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, end], "<u4")


def test_encoder_equals_whole_text_encoding(tokenizer, monkeypatch):
    r = random.Random(2)
    letters = ["a", "b", " ", "\n", "\t", "'s", ".", ",", "1", "é", " ", "\x85", "​", "!!", "漢", "<|endoftext|>"]
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 16))) for _ in range(4000)]
    texts += [t for _, t, *_ in awkward()] + ["w" * 200 + " x", "a  b", " a", "a "]
    texts += ["".join(r.choice(["ab", "C", "é", " ", " ", "\n", "\n\n", ".", ",", "$%", "'", "'s", "1", "ª", "\x85"])
                      for _ in range(r.randint(0, 24))) for _ in range(4000)]
    encoder = Encoder(vocabulary_path())
    for chunk in (1, 90, 1 << 23):
        monkeypatch.setattr("claritable.llm.tokens._CHUNK", chunk)
        for at in range(0, len(texts), 100):
            for text, ids in zip(texts[at:at + 100], encoder.encode(texts[at:at + 100]), strict=True):
                assert ids.tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids


def plain_pii(text):
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
              if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(x) for x in re.sub("[^0-9]", "", m[0])][::-1]
        check = sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(digits))
        if 14 <= len(digits) <= 19 and check % 10 == 0:
            found.append((m.start(), 2, m.end()))
    found += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text)
              if 10 <= sum(x.isdigit() for x in m[0]) <= 15]
    return sorted(found)


def test_pii_base_spans():
    r = random.Random(9)
    parts = [*"a1.@+- ()0295", "4111 1111 1111 1111", "+1 555 123 4567", "1.2.3.4", "x@y.z", "é", "0255.1.1.1"]
    for _ in range(20000):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 18)))
        assert sorted(pii.detect(text)) == plain_pii(text)
    assert pii.detect("9" * 200_000 + "." * 10 + "a" * 200_000) == []


@pytest.mark.parametrize("text,kind,found", [
    ("mail john [at] example [dot] com now", "email", "john [at] example [dot] com"),
    ("write to jo dot smith at example dot org please", "email", "jo dot smith at example dot org"),
    ("jоhn@exаmple.com", "email", "jоhn@exаmple.com"),
    ("joe​@x.com", "email", "joe​@x.com"),
    ("tel plus four nine one five one two three four five six seven eight.", "phone",
     "plus four nine one five one two three four five six seven eight"),
    ("４１１１ 1111 1111 1111", "card", "４１１１ 1111 1111 1111"),
    ("four one one one one one one one one one one one one one one one", "card", None),
    ("one nine two dot one six eight dot zero dot one", "ip", "one nine two dot one six eight dot zero dot one"),
    ("user[@]host[.]org", "email", None),
    ("to a(.)b@c(.)org", "email", "a(.)b@c(.)org"),
    ("from 192[.]168[.]0[.]1 on", "ip", "192[.]168[.]0[.]1"),
    ("at 192 dot 168 dot 1 dot 20 7 times", "ip", "192 dot 168 dot 1 dot 20"),
    ("jan [at] firma dot pl", "email", None),
    ("jan{at}mail dot firma dot ai, soon", "email", "jan{at}mail dot firma dot ai"),
    ("call +49 170 five five five 1234 now", "phone", "+49 170 five five five 1234"),
    ("card 4111 1111 one one one one 1111", "card", "4111 1111 one one one one 1111"),
    ("four two 1 dot 1 dot 0 dot 9", "ip", "four two 1 dot 1 dot 0 dot 9"[9:]),
])
def test_pii_behind_disguises(text, kind, found):
    base, more = pii.find_pii(text)
    assert [(pii.KINDS[k], text[a:b]) for a, k, b in more] == [(kind, found or text)]
    assert base == pii.detect(text)


def test_pii_leaves_plain_prose_alone():
    for text in ("we sat at the dot party", "look at polka dot party", "one two three and four", prose(3, 400),
                 "five of six came at ten", "at one point in time", "zero one two three four five six",
                 "1999 one of 2 point 5 million", "a list (.) of [.] marks", "five four dot com", "see section 3 dot 4 dot 5",
                 "look @ home dot dot", "3, 4, 5, six, seven of 12 point 10", "12 34 56 one two 78 90 12 34"):
        assert pii.find_pii(text) == ([], [])


def test_pii_base_spans_are_not_stretched_by_prose():
    for text, found in (("jo@x.com point out", "jo@x.com"), ("+1 555 123 4567 one more", "+1 555 123 4567"),
                        ("10.0.0.1 dot 5", "10.0.0.1"), ("4111 1111 1111 1111 one", "4111 1111 1111 1111")):
        base, more = pii.find_pii(text)
        assert [text[a:b] for a, _, b in base] == [found] and not more


def test_pii_takes_long_runs_in_linear_time():
    for text in ("12 " * 100_000 + "one two", "one " * 100_000, "a [.] " * 50_000, "1 dot " * 50_000, " " * 300_000 + "dot",
                 "x@" * 50_000 + " dot " * 50_000):
        pii.find_pii(text)


def test_pii_query(spark):
    extra = [(50, "a@b.co and a [at] b [dot] co", "en", "s", 0, 0, "", "", "")]
    got = {(r["doc_id"], r["spans"]): r for r in pii.scan_pii(table(spark, awkward() + extra)).collect()}
    row = got[50, "email:0:6,email:11:28"]
    assert row["n_email"] == 1 and row["n_added"] == 1 and row["n_card"] == 0
    assert row["base_sha256"] == hashlib.sha256(b"email:0:6").hexdigest()
    assert got[1, ""]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert pii.scan_pii(table(spark)).count() == len(awkward()) and pii.scan_pii(empty(spark)).count() == 0


def plain_secrets(text):
    either = lambda w: "".join(f"[{x}{x.upper()}]" for x in w)
    names = "|".join([*map(either, ("password", "passwd", "secret", "token")), either("api") + "_?" + either("key")])
    found = [(m.start(), 0, m.end()) for m in re.finditer(
        rf"""({names})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return sorted(found + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24])


def test_secret_base_spans():
    r = random.Random(11)
    parts = ["password", "PassWd", "secret", "api_key", "ApiKey", "token", " ", ":", "=", "'", '"', "abc", "Z9", "AKIA",
             "K", "0f" * 8, "A1B2C3D4", ".", "é"]
    for _ in range(20000):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 10)))
        assert sorted(secrets.detect(text)) == plain_secrets(text)


def test_random_strings_are_secrets_and_known_ones_are_not():
    find = secrets.finder(vocabulary_path(secrets.VOCABULARY))
    r = random.Random(12)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    caught = 0
    for _ in range(300):
        key = "".join(r.choice(letters) for _ in range(36))
        base, more = find(f"the value {key}, as given")
        caught += more == [(10, 3, 46)]
    assert caught >= 295
    for text in ("123e4567-e89b-12d3-a456-426614174000", hashlib.sha1(b"x").hexdigest(), "release-2024-01-15-build-7",
                 "get_user_profile_by_id_2", "com/example/project42/MainActivity", "0" * 40, prose(1, 300),
                 "Donaudampfschifffahrtsgesellschaft2"):
        assert find(text)[1] == []


def test_random_letters_are_secrets_and_long_words_are_not():
    find = secrets.finder(vocabulary_path(secrets.VOCABULARY))
    r = random.Random(13)
    for letters in ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"):
        caught = {"": 0, "prefix_env_": 0}
        for _ in range(300):
            for prefix in caught:
                key = prefix + "".join(r.choice(letters) for _ in range(32))
                caught[prefix] += find(f"the value {key}, as given")[1] == [(10, 3, 10 + len(key))]
        assert min(caught.values()) >= 295
    for text in ("Kraftfahrzeughaftpflichtversicherung", "getUserProfileByIdentifier", "electroencephalography",
                 "src/internationalization/configuration", "anticonstitutionnellement", "=" * 30):
        assert find(text)[1] == []


def test_secret_query(spark):
    got = secrets.scan_secrets(table(spark))
    assert got.count() == len(awkward()) and secrets.scan_secrets(empty(spark)).count() == 0
    assert {r["n_assign"] for r in got.collect()} == {0}


def test_huffman_round_trip():
    r = np.random.default_rng(3)
    for n, limit in ((1, 18), (2, 2), (7, 3), (300, 9), (5000, 13), (50257, 16)):
        ids = np.minimum(r.zipf(1.3, 30_000), n) - 1
        counts = np.bincount(ids, minlength=n)
        lengths = token_files.code_lengths(counts, limit)
        assert lengths.max() <= limit and (lengths > 0).sum() == (counts > 0).sum()
        if (counts > 0).sum() > 1:
            assert sum(2.0 ** -int(x) for x in lengths if x) == 1
        codes, decoder = token_files.canonical_codes(lengths), token_files.decoding_table(lengths, limit)
        for stride in (1, 7, 128):
            stream, begins, _ = token_files.pack_bits(ids, codes, lengths)
            assert (token_files.unpack_bits(stream, begins[::stride], len(ids), stride, decoder, limit) == ids).all()


def huffman_cost(counts):
    import heapq
    heap, cost = sorted(x for x in counts if x), 0
    while len(heap) > 1:
        both = heapq.heappop(heap) + heapq.heappop(heap)
        cost += both
        heapq.heappush(heap, both)
    return cost


def test_code_lengths_are_optimal():
    r = random.Random(5)
    for _ in range(30):
        counts = np.array([r.choice((0, 1, 2, 3, 5, 40, 900)) for _ in range(60)])
        lengths = token_files.code_lengths(counts, 24)
        assert int((lengths.astype(int) * counts).sum()) == huffman_cost(counts.tolist())
        tight = token_files.code_lengths(counts, 6)
        assert tight.max() <= 6


def test_damaged_blocks_are_noticed():
    lengths = token_files.code_lengths(np.array([5, 2, 1]))
    data = token_files.write_block([3, None], [np.array([0, 1, 2]), np.array([0])],
                                   token_files.canonical_codes(lengths), lengths)
    names, ids = token_files.read_block(data, token_files.decoding_table(lengths))
    assert names == [3, None] and [x.tolist() for x in ids] == [[0, 1, 2], [0]]
    with pytest.raises(ValueError):
        token_files.read_block(data[:-6] + b"\1" + data[-5:], token_files.decoding_table(lengths))


def test_token_files(spark, tokenizer):
    for k, (docs, options) in enumerate((
            (table(spark), {"block_ids": 50, "shard_ids": 2000}), (spark.read.parquet(DOCUMENTS), {}),
            (empty(spark), {}))):
        folder = f"{shared_dir(spark)}/files-{k}-{random.random()}"
        token_files.write_token_files(docs, folder, **options)
        got = token_files.read_token_files(spark, folder).orderBy("start").collect()
        rows = docs.select("doc_id", "text").collect()
        want = Counter()
        for row in rows:
            ids = ids_of(tokenizer, row["text"], 2)
            want[row["doc_id"], len(ids), zlib.crc32(ids.tobytes())] += 1
        assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
        start, order = 0, []
        for r in got:
            assert r["start"] == start
            start += r["n_tokens"]
            order.append((r["doc_id"] is not None, r["doc_id"] or 0))
        assert order == sorted(order)


def test_plans_place_every_piece_once():
    r = random.Random(8)
    for capacity, n in ((2048, 3000), (50, 400), (10, 30), (10, 0), (7, 5000)):
        pieces = Counter(min(capacity, 1 + int(r.lognormvariate(2, 1.2)) % capacity) for _ in range(n))
        plan = packing.plan_sequences(dict(pieces), capacity)
        placed = Counter()
        for lengths, times in plan:
            assert times > 0 and sum(lengths) <= capacity
            for x in lengths:
                placed[x] += times
        assert placed == pieces
        total = sum(k * v for k, v in pieces.items())
        best = -(-total // capacity)
        assert sum(x for _, x in plan) <= max(best + 1, 1.25 * best)


def test_exact_complements_fill_sequences():
    for pieces in ({7: 3, 3: 3}, {5: 2, 3: 2, 2: 2}, {4: 1, 3: 1, 2: 1, 1: 1}, {5: 4}):
        plan = packing.plan_sequences(pieces, 10)
        assert all(sum(lengths) == 10 for lengths, _ in plan)


def test_no_exact_combination_is_left():
    r = random.Random(3)
    for _ in range(200):
        capacity = r.choice([5, 12, 24, 30])
        counts = np.zeros(capacity + 1, np.int64)
        for _ in range(r.randint(0, 14)):
            counts[r.randint(1, capacity)] += r.choice([1, 1, 2, 3, 50])
        left, plan, placed = counts.copy(), [], Counter()
        packing._exact(left, capacity, plan)
        for lengths, times in plan:
            assert sum(lengths) == capacity and len(lengths) <= 4
            for x in lengths:
                placed[x] += times
        assert all(left[x] >= 0 and placed[x] + left[x] == counts[x] for x in range(capacity + 1))
        stock = np.flatnonzero(left).tolist()
        for n in range(1, 5):
            for lengths in combinations_with_replacement(stock, n):
                assert sum(lengths) != capacity or any(left[x] < k for x, k in Counter(lengths).items())


def test_packing_of_pieces_alike_in_all_columns(spark):
    got = packing.pack_documents(table(spark, [(None, "", "", "", 0, 0, "", "", "")] * 5000), capacity=64).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in got}) == 5000
    assert {r["length"] for r in got} == {1} and len({r["sequence_id"] for r in got}) == -(-5000 // 64)


def test_packing(spark, tokenizer):
    docs = table(spark)
    got = packing.pack_documents(docs, capacity=64).collect()
    want = Counter()
    for _i, text, *_ in awkward():
        ids = ids_of(tokenizer, text, 0)
        first = len(ids) % 64 or min(len(ids), 64)
        bounds = [0, *range(first, len(ids) + 1, 64)]
        for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
            want[_i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for members in sequences.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at
            at += length
        assert at <= 64
    total = sum(r["length"] for r in got)
    assert len(sequences) <= -(-total // 64) + 3
    assert packing.pack_documents(empty(spark)).count() == 0


def test_mixing_follows_weights(spark):
    rows = [(k, "word " * 20, "en", ("a", "b", None)[min(2, k % 10 // 4)], 0, k, "m", "c", "d") for k in range(6000)]
    docs = table(spark, rows)
    got = mixing.mix(docs, {"a": 1, "b": 1, "": 2}).select("doc_id", "source", "copy", "shuffle_key").collect()
    shares = Counter(r["source"] for r in got)
    for source, share in (("a", 0.25), ("b", 0.25), (None, 0.5)):
        assert abs(shares[source] / len(got) - share) < 0.02
    assert abs(len(got) - 6000) < 250
    copies = Counter(r["doc_id"] for r in got if r["source"] is None)
    drawn = Counter(copies.values())
    rate = 0.5 / 0.2  # a fifth of the rows are to be half of the mix
    for k in range(1, 7):
        expected = np.exp(-rate) * rate ** k / np.prod(np.arange(1, k + 1)) * 1200
        assert abs(drawn[k] - expected) < 5 * expected ** 0.5 + 5
    assert {(r["doc_id"], r["copy"]) for r in got} == {(i, c) for i, n in Counter(
        r["doc_id"] for r in got).items() for c in range(n)}
    again = mixing.mix(docs.repartition(7), {"a": 1, "b": 1, "": 2}).select("doc_id", "source", "copy", "shuffle_key")
    assert sorted(map(str, again.collect())) == sorted(map(str, got))


def test_mixing_order_and_awkward_rows(spark):
    got = mixing.mix(table(spark), partitions=4)
    rows = got.withColumn("part", F.spark_partition_id()).collect()
    keys = [r["shuffle_key"] for r in sorted(rows, key=lambda r: r["part"])]
    assert keys == sorted(keys) and len(keys) == len(rows)
    assert Counter(got.columns) == Counter(
        ["doc_id", "text", "lang", "source", "n_chars", "row", "mark", "doc", "copy", "shuffle_key"])
    assert not re.search("Python|Pandas|Arrow", got._jdf.queryExecution().toString())
    assert mixing.mix(empty(spark)).count() == 0


def test_large_rates_are_drawn_in_parts(spark):
    rows = [(k, "w", "en", "rare" if k < 4 else "common", 0, k, "m", "c", "d") for k in range(4000)]
    got = mixing.mix(table(spark, rows), {"rare": 1, "common": 1})
    n = Counter(r["source"] for r in got.select("source").collect())
    assert abs(n["rare"] - 2000) < 250 and abs(n["common"] - 2000) < 250


def test_gradients_are_those_of_the_loss():
    r = np.random.default_rng(6)
    net = language.ByteNetwork.fresh(["a", "b", "c"], 1)
    net.embed, net.out = 2.0 * net.embed.astype(float), 2.0 * net.out.astype(float)
    net.conv, net.bias = [2.0 * x.astype(float) for x in net.conv], [x.astype(float) for x in net.bias]
    net.out_bias = net.out_bias.astype(float)
    rows, labels = r.integers(0, 256, (5, 40)).astype(np.uint8), np.array([0, 1, 2, 1, 0])

    def loss():
        p = net.predict(rows, net.tables())
        return -np.log(p[np.arange(5), labels]).mean()

    for w, g in zip(net.weights(), net.gradients(rows, labels), strict=True):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old, step = w[at], 1e-6
        w[at] = old + step
        up = loss()
        w[at] = old - step
        down = loss()
        w[at] = old
        assert abs((up - down) / (2 * step) - g[at]) < 1e-3 * abs(g[at]) + 1e-6


def test_language_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts, labels = language.training_texts(docs)
    ids = {r["doc_id"] for r in docs.select("doc_id").collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0}
    net = language.train(texts, labels)
    got = language.identify(docs, net).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert {r["doc_id"] for r in got if r["held_out"]} == ids
    held = [r for r in got if r["held_out"]]
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)
    odd = language.identify(table(spark), net).collect()
    assert all(r["lang_pred"] == "und" for r in odd if r["doc_id"] in (1, 2, 3, 17))
    assert language.identify(empty(spark), net).count() == 0
    assert language.training_texts(empty(spark)) == ([], [])
    assert {r["lang_pred"] for r in language.identify(table(spark), language.train([], [])).collect()} == {"und"}


def test_secrets_of_a_text_with_many_keys_take_time_in_proportion():
    import time

    find = secrets.finder(vocabulary_path(secrets.VOCABULARY))
    r = random.Random(9)
    keys = ["".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(24))
            for _ in range(8000)]
    text = " ".join(f"token={k}" if i % 2 else k for i, k in enumerate(keys))
    find(text[:1000])
    started = time.process_time()
    base, more = find(text)
    assert len(base) == 4000 and len(more) >= 3990
    # Runs inside a base span are no spans of their own, whatever their order.
    assert not any(x <= a and b <= y for a, _, b in more[:200] for x, _, y in base)
    assert time.process_time() - started < 4
