import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from streetloom.llm import suffix_array, substrings


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int(np.count_nonzero(np.diff(np.r_[False, gone].astype(int)) == 1))
        rest = bytes(np.frombuffer(d, np.uint8)[~gone])
        out.append((len(d), int(gone.sum()), spans, hashlib.sha256(rest).hexdigest()))
    return out


@pytest.mark.parametrize("small", [1024, 0])
def test_suffix_array_and_common_prefixes(small, monkeypatch):
    monkeypatch.setattr(suffix_array, "_SMALL", small)
    rng = random.Random(small)
    for _ in range(150):
        n, k = rng.randrange(1, 60), rng.choice([1, 2, 3, 20])
        s = np.array([rng.randrange(k) for _ in range(n)])
        want = sorted(range(n), key=lambda i: s[i:].tolist())
        assert suffix_array.suffix_array(s).tolist() == want
        got = suffix_array.permuted_lcp(s, np.array(want), 7)
        for rank, i in enumerate(want):
            j = want[rank - 1] if rank else n
            size = 0
            while size < 7 and max(i, j) + size < n and s[i + size] == s[j + size]:
                size += 1
            assert got[i] == size


def corpus(rng):
    words = [f"{a}{b}{c}" for a in "stkmn" for b in "aeioué" for c in "lrnst "]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = [prose(90) for _ in range(4)]
    texts = [None, "", "short", "=" * 900, "ab" * 300, prose(20)]
    texts += [prose(60), prose(60) + shared[0] + prose(30), shared[0] + prose(5), prose(8) + shared[0]]
    near = prose(300).split()
    for _ in range(12):
        near[rng.randrange(300)] = "edit"
        texts.append(" ".join(near))
    for _ in range(25):
        texts.append(prose(rng.randrange(50)) + rng.choice(shared)[rng.randrange(60) :] + prose(rng.randrange(50)) + rng.choice(shared)[: rng.randrange(400)])
    texts += [texts[6], texts[6], prose(40) + "\0" * 230 + prose(4) + "\0" * 215]
    return texts


@pytest.mark.parametrize("options", [{}, {"split_above": 2}, {"shard_bytes": 1}])
def test_removal_matches_brute_force(spark, options):
    texts = corpus(random.Random(3))
    rows = [(i, t, "clash", 5) for i, t in enumerate(texts)] + [(9, texts[9], "clash", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tag string, n_bytes long")
    got = substrings.remove_repeats(docs, **options)
    assert got.columns == ["doc_id", "text", "tag", "n_bytes", "n_removed", "n_spans", "removed", "kept_sha256"]
    want = brute([r[1] for r in rows], 200)
    found = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect())
    assert found == sorted((r[0], *w) for r, w in zip(rows, want, strict=True))


def test_long_text_is_cut_without_loss(spark, monkeypatch):
    rng = random.Random(4)
    part = "".join(rng.choice("abcdefgh ") for _ in range(700))
    filler = "".join(rng.choice("abcdefghijklmnop ") for _ in range(600_000))
    at = substrings._CHUNK - 350
    text = filler[:at] + part + filler[at:]
    docs = spark.createDataFrame([(1, text), (2, "x" + part + "y"), (None, "z" * 10)], "doc_id long, text string")
    got = {r.doc_id: r for r in substrings.remove_repeats(docs, kept_text=False).collect()}
    assert [tuple(x) for x in got[1].removed] == [(at, at + 700)]
    assert [tuple(x) for x in got[2].removed] == [(1, 701)]
    assert got[None].n_removed == 0


def test_empty_table(spark):
    assert substrings.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []
