import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from streetloom.llm import simhash
from streetloom.graph.components import connected_components


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_classes(rows, radius=2):
    fps = [slow_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(d, fps[i], least.get(find(i))) for i, (d, _) in enumerate(rows)]


@pytest.mark.parametrize("text", [None, "", "  \t\n", "one", "Ab cD", "a b c", "a b c d a b c d", "É é x\x1fy \x0b z"])
def test_fingerprint_matches_definition(text):
    assert simhash.fingerprint(text) == slow_fingerprint(text)


def test_bucket_links_connect_what_brute_force_connects():
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(40)]
    values = sorted({b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(4))) & (2**64 - 1) for b in base for _ in range(12)})
    keys = np.array(sorted(rng.choices(range(5), k=len(values))), np.int64)
    a, b = simhash.bucket_links(keys, np.array(values, np.uint64))

    def classes(pairs):
        root = {v: v for v in values}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for x, y in pairs:
            root[find(x)] = find(y)
        return {frozenset(w for w in values if find(w) == find(v)) for v in values}

    brute = [(v, w) for i, v in enumerate(values) for j, w in enumerate(values[:i]) if keys[i] == keys[j] and (v ^ w).bit_count() <= 2]
    assert classes((int(x), int(y)) for x, y in zip(a, b, strict=True)) == classes(brute)


def test_components_and_first(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(300)]
    rows = [(None, "x y z"), (None, None), (7, ""), (3, None), (3, None), (9, "same id"), (9, "other text of it")]
    for d in range(100, 160):
        body = [rng.choice(words) for _ in range(200)]
        rows.append((d, " ".join(body)))
        for e in range(rng.randrange(4)):
            body[rng.randrange(200)] = "changed"
            rows.append((1000 + 10 * d + e, " ".join(body)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("clash"))
    for limit in (2048, 1):  # also with every bucket split again
        got = simhash.simhash_components(docs, split_above=limit).collect()
        want = slow_classes(rows)
        key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2] or 0)
        assert sorted(((r[0], r[1] % 2**64, r[2]) for r in got), key=key) == sorted(want, key=key)
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted({c for d, _, c in want if c is not None and d == c})
    assert ids.count(None) == 2


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.simhash_components(docs).collect() == []
    assert simhash.keep_first(docs).collect() == []


def test_connected_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1100)]
    edges += [(5, 5), (None, 3), (4, None), (1000, 1001)]
    root = {x: x for e in edges for x in e if x is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    linked = {x for a, b in edges if a is not None and b is not None and a != b for x in (a, b)}
    got = connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()
    assert sorted(tuple(r) for r in got) == sorted((x, find(x)) for x in linked)
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").collect() == []
