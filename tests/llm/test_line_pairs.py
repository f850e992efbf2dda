"""Comparisons of the members of a bucket, against plain ones."""

import random

from pyspark.sql import functions as F

from shoplens.llm import line_dedup as lines


def family(rnd, n):
    """Sets that share most of one base, many of them just not similar enough."""
    base = [rnd.randrange(1 << 60) for _ in range(80)]
    return [sorted(x for x in base if rnd.random() > 0.12) + [rnd.randrange(1 << 60) for _ in range(rnd.randrange(12))]
            for _ in range(n)]


def test_links_of_a_family(spark):
    """The join gives the similar pairs alone, and each of them once."""
    rnd = random.Random(3)
    sets = family(rnd, 120) + [[1, 2, 3, 4, 5], [9], [1, 2, 3, 4]]  # the last is just similar to the first
    minima = [[rnd.choice((-32768, 32767, 0, 1, 3, 4, -1)) if rnd.random() < 0.2 else 7 for _ in range(24)]
              for _ in sets[3:]] + [[7] * 24] * 3
    data = [(i, i // 2, s, *m) for i, (s, m) in enumerate(zip(sets, minima))]
    named = spark.createDataFrame(data, "node long, root long, set array<long>, " + ", ".join(
        f"m{i} short" for i in range(24)))
    bands = F.array(*[F.xxhash64(F.lit(b), *[f"m{i}" for i in range(3 * b, 3 * b + 3)]) for b in range(8)])
    named = named.select("node", "root", "set", *lines._packed(24), F.posexplode(bands).alias("band", "bucket"))
    got = [(r.a, r.b) for r in lines._links(named, 8, 3, 0.8).collect()]
    want = set()
    for a in range(len(sets)):
        for b in range(a):
            same = [x == y for x, y in zip(minima[a], minima[b])]
            both = len(set(sets[a]) & set(sets[b]))
            if (any(all(same[3 * k:3 * k + 3]) for k in range(8)) and sum(same) >= 11 and a // 2 != b // 2
                    and 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both)):
                want.add((b, a))
    assert len(got) == len(set(got)) and set(got) == want and (120, 122) in want
    assert 20 < len(want) < 120 * 119 / 4
