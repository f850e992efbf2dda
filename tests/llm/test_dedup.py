"""Exact, substring and SimHash de-duplication against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from xxhash import xxh64_intdigest

from shoplens.llm.components import components
from shoplens.llm.exact_dedup import exact_dedup
from shoplens.llm.simhash import simhash_groups, spanning
from shoplens.llm.substring_dedup import repeats


def order(row):
    return tuple((v is None, v) for v in row)


# -- exact ------------------------------------------------------------------

def brute_exact(rows):
    groups = defaultdict(list)
    for i, (doc, text) in enumerate(rows):
        groups[re.sub("[\x20\x09-\x0d]", "", text or "")].append((-len(text or ""), doc is None, doc or 0, i))
    out = []
    for norm, members in groups.items():
        keep = min(members)
        for m in members:
            out.append((rows[m[3]][0], rows[keep[3]][0], len(members), m == keep,
                        hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=order)


@pytest.mark.parametrize("bits", [64, 3])
def test_exact_dedup(docs, rows, bits):
    got = [tuple(r) for r in exact_dedup(docs, low=8, high=64, id_bits=bits).drop("key").collect()]
    assert sorted(got, key=order) == brute_exact(rows)


def test_exact_dedup_empty(empty):
    assert exact_dedup(empty).count() == 0


# -- substring --------------------------------------------------------------

def brute_substring(rows, window):
    least = {}
    split = [re.findall("[^\x20\x09-\x0d]+", t or "") for _, t in rows]
    for (doc, _), ws in zip(rows, split):
        if doc is not None:
            for i in range(len(ws) - window + 1):
                w = tuple(ws[i:i + window])
                least[w] = min(doc, least.get(w, doc))
    out = []
    for (doc, _), ws in zip(rows, split):
        gone = set()
        for i in range(len(ws) - window + 1):
            if doc is not None and least[tuple(ws[i:i + window])] < doc:
                gone.update(range(i, i + window))
        out.append((doc, len(ws), len(gone), " ".join(w for i, w in enumerate(ws) if i not in gone)))
    return sorted(out, key=order)


def substring_result(df):
    return sorted(((r.doc_id, r.n_words, sum(s.past - s.first for s in r.spans), r.kept_text) for r in df.collect()),
                  key=order)


def test_substring_dedup(docs, rows):
    assert substring_result(repeats(docs)) == brute_substring(rows, 50)


def test_substring_dedup_dense(spark):
    """Few words, so that anchors, blocks and windows repeat in all ways."""
    rnd = random.Random(11)
    rows = [(rnd.randrange(40), " ".join(rnd.choice("ab") for _ in range(rnd.randrange(40)))) for _ in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = substring_result(repeats(df, window=8, gram=3))
    assert got == brute_substring(rows, 8)


def test_substring_dedup_of_many_repeated_rows(spark):
    """A third of all rows is one row, with a passage of a smaller id in it."""
    rnd = random.Random(11)
    def words(n):
        return " ".join(f"w{rnd.randrange(5000)}" for _ in range(n))
    passage = words(80)
    rows = [(1, f"{words(20)} {passage} {words(20)}")] + [(7, f"{words(200)} {passage} {words(300)}")] * 1000
    rows += [(8 + i, words(30)) for i in range(1000)] + [(9000, rows[1][1])] * 200
    assert substring_result(repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(6))) == \
        sorted(brute_substring(rows, 50), key=order)


def test_substring_dedup_empty(empty):
    assert repeats(empty).count() == 0


# -- SimHash ----------------------------------------------------------------

def brute_fingerprint(text, k=4):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    ws = re.findall("[^\x20\x09-\x0d]+", lower)
    if not ws:
        return 0
    grams = [" ".join(ws[i:i + k]) for i in range(max(1, len(ws) - k + 1))]
    hashes = [xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(fps, bits):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def test_simhash(docs, rows):
    fps = [brute_fingerprint(t) for _, t in rows]
    roots = brute_components(fps, 4)
    least = {r: min((d for (d, _), x in zip(rows, roots) if x == r and d is not None), default=None) for r in set(roots)}
    want = sorted(((d, f"{f:016x}", least[r]) for (d, _), f, r in zip(rows, fps, roots)), key=order)
    for block in (2048, 3):
        got = simhash_groups(docs, block=block).select("doc_id", "fingerprint", "component_id").collect()
        assert sorted((tuple(r) for r in got), key=order) == want


@pytest.mark.parametrize("segments", [2, 3, 4])
def test_simhash_links_are_complete(spark, segments):
    """Chains of fingerprints around few centres, at every distance."""
    from shoplens.llm.simhash import links
    rnd = random.Random(3)
    fps = set()
    for _ in range(12):
        x = rnd.getrandbits(64)
        for _ in range(30):
            for _ in range(rnd.randrange(1, 7)):
                x ^= 1 << rnd.randrange(64)
            fps.add(x)
    fps = sorted(fps)
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    crowd = {2: 0, 3: 1, 4: 8}[segments]
    root = {r.node & (2 ** 64 - 1): r.root for r in components(links(df, 4, segments, block=5, crowd=crowd)).collect()}
    want, got = defaultdict(set), defaultdict(set)
    for f, r in zip(fps, brute_components(fps, 4)):
        want[r].add(f)
        got[root.get(f, ("alone", f))].add(f)
    assert sorted(map(sorted, want.values())) == sorted(map(sorted, got.values()))


def test_spanning_matches_all_pairs():
    import numpy as np
    rnd = random.Random(9)
    for n in (0, 1, 5, 11, 12, 300):
        fps = sorted({rnd.getrandbits(10) << 20 for _ in range(n)})
        out = spanning(np.array(fps, np.uint64), 2)
        assert all((a ^ b).bit_count() <= 2 for a, b in out)
        parts = len(set(brute_components(fps, 2)))
        assert len(out) == len(fps) - parts


def test_simhash_empty(empty):
    assert simhash_groups(empty).count() == 0


def test_components(spark):
    rnd = random.Random(1)
    edges = [(i, i + 1) for i in range(60)] + [(rnd.randrange(100, 400), rnd.randrange(100, 400)) for _ in range(200)]
    edges += [(500, 500), (501, 502), (502, 501), (700, 600)] + [(800, i) for i in range(801, 900)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    counts = Counter(map(find, parent))
    assert got == {x: find(x) for x in parent if counts[find(x)] > 1}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
