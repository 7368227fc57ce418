"""Exact, line and near duplicates and quality rules against plain Python."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from claritable.llm import exact_dedup, line_dedup, quality, simhash
from claritable.llm.common import QUERIES
from claritable.llm.components import components
from tests.llm.helpers import SCHEMA, awkward, empty, prose, table

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def by_row(frame, *names):
    return Counter(tuple(r[n] for n in names) for r in frame.collect())


def expected_exact(rows):
    groups = defaultdict(list)
    for row in rows:
        groups[SPACE.sub("", row[1] or "")].append(row)
    out = Counter()
    for bare, members in groups.items():
        best = min(members, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0))
        for k, r in enumerate(members):
            first = r is best
            out[r[0], best[0], len(members), first, hashlib.sha256(bare.encode()).hexdigest()] += 1
    return out


@pytest.mark.parametrize("fan,run_rows", [(2, 3), (4, 1_000_000)])
def test_exact_dedup(spark, fan, run_rows):
    got = exact_dedup.exact_duplicates(table(spark), fan, run_rows)
    assert by_row(got, "doc_id", "keep_id", "group_size", "kept", "text_sha256") == expected_exact(awkward())


def test_exact_dedup_hot_group_and_rows_that_stay(spark):
    rows = [(k, ("same " * 5 if k % 3 else prose(k, 12)), "en", "s", 1, k, "m", None, "d") for k in range(400)]
    docs = table(spark, rows)
    stay = exact_dedup.drop_exact_duplicates(docs, 2, 40)
    assert stay.columns == docs.columns
    want = sorted(r[0] for r in rows if r[0] % 3 == 0) + [1]
    assert sorted(r["doc_id"] for r in stay.collect()) == sorted(want)
    kept = Counter((r["doc_id"], r["text"]) for r in exact_dedup.drop_exact_duplicates(table(spark)).collect())
    assert max(kept.values()) == 1
    assert Counter((i, hashlib.sha256(SPACE.sub("", t or "").encode()).hexdigest()) for i, t in kept) == Counter(
        {(keep, sha): 1 for _, keep, _, first, sha in expected_exact(awkward()) if first})


def test_exact_dedup_of_partitions_of_many_batches(spark):
    # A task's entries come in batches of 10,000 rows; here three of them, with one text over all.
    n, hot = 25_000, 12_000
    docs = spark.range(0, n, 1, 1).selectExpr(
        "id AS doc_id", f"CASE WHEN id % 25 < 12 THEN 'same' ELSE concat('t', id % {n - 1000}) END AS text")
    text = ["same" if k % 25 < 12 else f"t{k % (n - 1000)}" for k in range(n)]
    size, first = Counter(text), {}
    for k, t in enumerate(text):
        first.setdefault(t, k)
    assert size["same"] == hot and max(v for t, v in size.items() if t != "same") == 2
    got = exact_dedup.exact_duplicates(docs).select("doc_id", "keep_id", "group_size", "kept").collect()
    assert Counter(map(tuple, got)) == Counter((k, first[t], size[t], first[t] == k) for k, t in enumerate(text))
    stay = exact_dedup.drop_exact_duplicates(docs).select("doc_id").collect()
    assert sorted(r["doc_id"] for r in stay) == sorted(first.values())


def test_exact_dedup_query_of_one_large_row_group(spark, tmp_path):
    # A row group is one task, however small the partitions are.
    rows = spark.range(0, 30_000, 1, 1).selectExpr("id AS doc_id", "concat('text ', id % 20000, repeat(' ', int(id % 3))) AS text")
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    size, best = Counter(k % 20_000 for k in range(30_000)), {}
    for k in range(30_000):
        best[k % 20_000] = min(best.get(k % 20_000, (0, k)), (-(k % 3), k))
    got = QUERIES["op7_exact_dedup"](spark, str(tmp_path)).select("doc_id", "keep_id", "group_size", "kept").collect()
    assert Counter(map(tuple, got)) == Counter(
        (k, best[k % 20_000][1], size[k % 20_000], best[k % 20_000][1] == k) for k in range(30_000))


def expected_lines(rows, run=3, size=50):
    """Later runs deleted, straight from the definition; rows alike in id and text are one document."""
    docs = {}
    for i, text, *_ in rows:
        split = (text or "").split("\n")
        full = [k for k, x in enumerate(split) if SPACE.sub("", x)]
        mark = xxhash.xxh64_intdigest((text or "").encode(), 42) if text is not None else 42
        mark = mark - (1 << 64) if mark >> 63 else mark
        docs[(i is None, i or 0, mark)] = (i, text, split, full)
    seen, out = set(), {}
    gone = defaultdict(set)
    for key in sorted(docs):
        _, text, split, full = docs[key]
        for at in range(len(full)):
            own = next((full[at:at + k] for k in range(1, run + 1) if at + k <= len(full) and (
                k == run or sum(len(words(split[j])) for j in full[at:at + k]) >= size)), None)
            if own is None:
                continue
            window = tuple(split[k].strip(" \t\n\x0b\x0c\r") for k in own)
            if window in seen:
                gone[key].update(own)
            seen.add(window)
    for key, (i, text, split, full) in docs.items():
        left = text if text is None else "\n".join(x for k, x in enumerate(split) if k not in gone[key])
        out[i, text] = (left, len(full), len(gone[key]))
    return out


def test_line_dedup(spark):
    got = line_dedup.deduplicate_lines(table(spark).withColumnRenamed("row", "n_lines").withColumnRenamed("doc", "key"))
    want = expected_lines(awkward())
    assert sum(n for _, _, n in want.values()) > 20
    assert Counter((r["doc_id"], r["text"], r["n_lines"], r["n_removed"]) for r in got.collect()) == Counter(
        (r[0], *want[r[0], r[1]]) for r in awkward())


@pytest.mark.parametrize("run,size", [(1, 50), (2, 50), (4, 50), (4, 3), (3, 5), (5, 7)])
def test_line_dedup_window_lengths(spark, run, size):
    line = {c: " ".join([c] * (1 + k % 3)) for k, c in enumerate("abcdefg")}
    rows = [(k, "\n".join(line["abcdefg"[(k * j + j * j) % 7]] for j in range(14)), "", "", 0, 0, "", "", "")
            for k in range(12)]
    got = line_dedup.deduplicate_lines(table(spark, rows), run, size)
    want = expected_lines(rows, run, size)
    assert Counter((r["doc_id"], r["text"]) for r in got.collect()) == Counter((r[0], want[r[0], r[1]][0]) for r in rows)


def test_long_lines_that_repeat_alone(spark):
    long, two = prose(60, 60), f"{prose(61, 30)}\n{prose(62, 25)}"
    texts = [f"first\n{long}\nthird", f"{prose(1, 9)}\n{long}", long, prose(63, 49), prose(63, 49), two, f"start\n{two}\nend",
             f"{prose(61, 30)}\n{prose(64, 25)}"]
    rows = [(k, t, "", "", 0, 0, "", "", "") for k, t in enumerate(texts)]
    got = {r["doc_id"]: r["text"] for r in line_dedup.deduplicate_lines(table(spark, rows)).collect()}
    assert got == dict(enumerate([texts[0], prose(1, 9), "", texts[3], texts[4], two, "start\nend", texts[7]]))


def words(text):
    return [x for x in SPACE.split(text or "") if x]


def expected_quality(rows):
    hosts, holders, prepared = Counter(), defaultdict(list), []
    for k, (i, text, _, host, *_) in enumerate(rows):
        w = words(text)
        windows = [tuple(w[j:j + 8]) for j in range(len(w) - 7)]
        seen = Counter(windows)
        covered = {p for j, x in enumerate(windows) if seen[x] > 1 for p in range(j, j + 8)}
        full = [x for x in (text or "").split("\n") if words(x)]
        normal = dict.fromkeys(" ".join(words(x)).lower() for x in full)
        hosts[host or ""] += 1
        for x in normal:
            holders[host or "", x].append(i)
        prepared.append((i, host or "", w, text or "", len(full) - len(set(full)), len(covered), normal))
    out = Counter()
    for i, host, w, text, dup, rep, normal in prepared:
        gone = 0
        for x in normal:
            ids = holders[host, x]
            if len(ids) > quality.MIN_DOCS and len(ids) * quality.HOST_SHARE > hosts[host]:
                known = [y for y in ids if y is not None]
                gone += len(words(x)) if i is None and known or known and i != min(known) else 0
        total = sum(len(words(x)) for x in normal)
        left = total - gone
        failed = len(w) < 20 or 100 * rep > 30 * len(w)
        depleted = gone > 0 and (left < 20 and 2 * left < total or 5 * left < total)
        out[i, len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", text)), dup, rep, failed,
            not failed and not depleted] += 1
    return out


def test_quality(spark):
    menu = "\n".join(f"{prose(900 + k, 8)}" for k in range(4))
    rows = awkward() + [
        (100 + k, menu + "\n" + prose(k, 6 if k % 2 else 60) + "# $", "en", "src0", 1, k, "m", None, "d") for k in range(60)]
    got = quality.assess(table(spark, rows))
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    want = expected_quality(rows)
    assert by_row(got, *names) == want
    kept = quality.drop_poor(table(spark, rows))
    assert kept.columns == SCHEMA.replace(" long", "").replace(" string", "").replace(" int", "").split(", ")
    assert Counter(r["doc_id"] for r in kept.collect()) == sum(
        (Counter({k[0]: n}) for k, n in want.items() if k[-1]), Counter())
    dropped = [k for k in want if k[0] and k[0] >= 100 and not k[-1]]
    assert len(dropped) == 29 or len(dropped) == 30


def test_lines_above_the_limit_are_removed(spark):
    notice = "All rights reserved by the house"
    rows = [(None if k == 7 else k, "\n".join((f"  {notice.upper()} ", prose(k, 30), "", notice, prose(50 + k, 9))), "en",
             "src0", 1, k, "m", None, "d") for k in range(1, 31)]
    other = [(40, notice + "\n" + prose(40, 30), "en", "src1", 1, 0, "m", None, "d")]
    got = quality.drop_poor(table(spark, rows + other))
    want = Counter()
    for i, text, *_ in rows + other:
        bare = "\n".join(x for x in text.split("\n") if x.strip().lower() != notice.lower())
        want[i, text if i in (1, 40) else bare] += 1
    assert by_row(got, "doc_id", "text") == want
    assert not re.search("Python|Pandas|Arrow", got._jdf.queryExecution().toString())


def plain_print(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    parts = [b" ".join(w[k:k + 3]) for k in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(x, 42) for x in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def expected_groups(prints, radius=3):
    """Smallest id of each id's component, over (id, fingerprint) pairs."""
    unique = sorted({p for _, p in prints})
    parent = {p: p for p in unique}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    every = np.array(unique, np.uint64)
    for p in unique:
        for q in every[np.bitwise_count(every ^ np.uint64(p)) <= radius]:
            parent[find(int(q))] = find(p)
    least = {}
    for i, p in prints:
        if i is not None:
            least[find(p)] = min(least.get(find(p), i), i)
    return {p: least.get(find(p)) for p in unique}


def test_simhash(spark):
    rows = awkward() + [(200 + k, prose(5, 3000) + f" extra{k}", "", "", 0, 0, "", "", "") for k in range(30)]
    prints = [(r[0], plain_print(r[1])) for r in rows]
    groups = expected_groups(prints)
    got = simhash.near_duplicates(table(spark, rows))
    assert by_row(got, "doc_id", "fingerprint", "component_id") == Counter((i, f"{p:016x}", groups[p]) for i, p in prints)
    stay = simhash.drop_near_duplicates(table(spark, rows))
    assert stay.count() == len({groups[p] for _, p in prints})
    assert {r["doc_id"] for r in stay.collect()} == {groups[p] for _, p in prints}


def test_near_groups_without_an_id_of_their_own_stay(spark):
    texts = [(None, prose(1, 300)), (None, prose(2, 300)), (None, None), (5, prose(3, 300)), (5, prose(4, 300)),
             (None, prose(1, 300))]
    rows = [(i, t, "en", "s", 0, k, "m", None, "d") for k, (i, t) in enumerate(texts)]
    stay = simhash.drop_near_duplicates(table(spark, rows))
    assert Counter((r["doc_id"], r["text"]) for r in stay.collect()) == Counter(set(texts))


def test_masks_miss_no_pair():
    from itertools import combinations
    for positions, radius in ((list(range(64)), 3), (list(range(5, 40, 2)), 3), (list(range(12)), 2)):
        families = [set(m) for m in simhash.masks(positions, radius)]
        for n in range(1, radius + 1):
            for differ in list(combinations(positions, n))[:20000]:
                assert any(not m.intersection(differ) for m in families)


def test_hot_buckets_are_split_without_losing_links(spark):
    r = np.random.default_rng(4)
    centre = 0x0F0F_1234_ABCD_9876
    near = {centre}
    while len(near) < 1500:  # one dense cluster, with chains of neighbours
        base = int(r.choice(sorted(near)[:400]))
        for b in r.choice(64, r.integers(1, 4), replace=False):
            base ^= 1 << int(b)
        near.add(base)
    far = {int(x) for x in r.integers(0, 1 << 63, 300)}
    prints = list(enumerate(sorted(near | far)))
    nodes = spark.createDataFrame([(int(np.uint64(p).view(np.int64)),) for _, p in prints], "fp long")
    for most in (256, simhash.MOST):
        edges = simhash.near_edges(nodes, most=most)
        roots = {x["node"]: x["root"] for x in components(edges).collect()}
        signed = {p: int(np.uint64(p).view(np.int64)) for _, p in prints}
        got = defaultdict(set)
        for i, p in prints:
            got[roots.get(signed[p], signed[p])].add(i)
        want = defaultdict(set)
        groups = expected_groups(prints)
        for i, p in prints:
            want[groups[p]].add(i)
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
        if most == 256:
            assert edges.count() < 1500 * 1500 / 4


def test_components_of_long_chains(spark):
    chain = [(k, k + 1) for k in range(200)] + [(1000, 1001), (1001, 1001), (-5, 1001)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {**{k: 0 for k in range(1, 201)}, 1000: -5, 1001: -5}


def test_empty_tables(spark):
    none = empty(spark)
    assert exact_dedup.exact_duplicates(none).count() == 0
    assert exact_dedup.drop_exact_duplicates(none).count() == 0
    assert line_dedup.deduplicate_lines(none).count() == 0
    assert quality.assess(none).count() == 0 and quality.drop_poor(none).count() == 0
    assert simhash.near_duplicates(none).count() == 0 and simhash.drop_near_duplicates(none).count() == 0


def test_native_plans_have_no_python(spark):
    for frame in (line_dedup.deduplicate_lines(table(spark)), quality.assess(table(spark))):
        plan = frame._jdf.queryExecution().toString()
        assert not re.search("Python|Pandas|Arrow", plan)
