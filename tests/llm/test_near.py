import random

import numpy as np

import corpus_pipeline
from streetloom.llm import near, simhash


def similarity(a, b):
    grams = lambda t: {tuple(w[i : i + 5]) for w in [(t or "").lower().split()] for i in range(max(1, len(w) - 4))}
    return len(grams(a) & grams(b)) / len(grams(a) | grams(b))


def first_of_classes(texts):
    least = {d: d for d in texts}
    links = [(d, e) for d in texts for e in texts if similarity(texts[d], texts[e]) >= 0.8]
    for _ in texts:
        for d, e in links:
            least[d] = min(least[d], least[e])
    return {d: t for d, t in texts.items() if least[d] == d}


def test_pipeline_stage_against_brute_force(spark):
    """Copies at similarities on both sides of 0.8; most of them differ in more than the two bits of op6."""
    rng, texts = random.Random(3), {}
    for base in range(30):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(60, 300))]
        for copy in range(rng.randrange(1, 5)):
            own = list(words)
            for at in rng.sample(range(len(own)), copy * len(own) // 100 + copy):
                own[at] = f"c{rng.randrange(5000)}"
            texts[base * 10 + copy] = " ".join(own)
    texts |= {900: None, 901: "", 902: "One  two", 903: "one two", 904: "one two three"}
    kept = first_of_classes(texts)
    apart = [d for d in texts if d not in kept and (simhash.fingerprint(texts[d]) ^ simhash.fingerprint(texts[d - d % 10])).bit_count() > 2]
    assert len(apart) > 10 and 25 < len(kept) < len(texts) - 10
    docs = spark.createDataFrame([(d, t, "x") for d, t in texts.items()], "doc_id long, text string, lang string")
    got = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert got.columns == docs.columns
    assert {r.doc_id: r.text for r in got.collect()} == kept


def test_no_square_of_a_group_is_missed(spark):
    """A class that its bucket's centre does not reach in one step, repeated rows, null ids."""
    words = [f"w{i}" for i in range(400)]
    chain = [" ".join(words[10 * i : 10 * i + 200]) for i in range(20)]
    rows = [*enumerate(chain), (3, chain[3]), (None, chain[0]), (None, "other")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = near.keep_first(docs).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted([(0, chain[0]), (None, chain[0]), (None, "other")], key=str)
    assert near.keep_first(docs.limit(0)).collect() == []


def test_look_alikes_make_no_pairs_by_the_square(spark, monkeypatch):
    """Copies of one text, each too far from every other: all stay, and no table of the stage grows by their square."""
    rng = random.Random(8)
    base = [f"w{rng.randrange(5000)}" for _ in range(150)]
    texts = {}
    for d in range(600):
        own = list(base)
        for at in rng.sample(range(150), 5):
            own[at] = f"x{d}.{at}"
        texts[d] = " ".join(own)
    assert max(similarity(texts[d], texts[d + 1]) for d in range(599)) < 0.8
    rows, kept = [], near.materialise

    def counted(df):
        out = kept(df)
        rows.append(out.count())
        return out

    monkeypatch.setattr(near, "materialise", counted)
    got = near.keep_first(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    assert {r.doc_id for r in got.collect()} == set(first_of_classes_of_sets(texts))
    assert max(rows) <= 100 * len(texts)


def first_of_classes_of_sets(texts):
    """As first_of_classes, with each set made once."""
    sets = {d: set(near.shingles(t).tolist()) for d, t in texts.items()}
    least = {d: d for d in texts}
    links = [(d, e) for d in sets for e in sets if d < e and len(sets[d] & sets[e]) / len(sets[d] | sets[e]) >= 0.8]
    for _ in range(20):
        for d, e in links:
            least[d] = least[e] = min(least[d], least[e])
    return [d for d in texts if least[d] == d]


def test_candidates_come_from_fingerprints(spark):
    """A bit is the majority of its hashes; sets meet whose fingerprints are close, however alike the texts are said to be."""
    ones = near.fingerprint(near.shingles("one two three"))
    assert ones.shape == (near.WORDS,) and 150 < sum(int(w).bit_count() for w in ones) < 362
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 64, near.WORDS, np.uint64)
    close = base.copy()
    close[:2] ^= np.uint64(0x5)
    far = rng.integers(0, 1 << 64, near.WORDS, np.uint64)
    rows = [(k, [int(w) for w in fp.view(np.int64)]) for k, fp in enumerate((base, close, far))]
    got = near.candidates(spark.createDataFrame(rows, "key long, fp array<long>")).collect()
    assert {frozenset(r) for r in got} == {frozenset((0, 1))}


def components(n, pairs):
    least = list(range(n))
    for _ in range(n):
        for a, b in pairs:
            least[a] = least[b] = min(least[a], least[b])
    return least


def test_buckets_connect_what_brute_force_connects():
    """Chains and random members, in small buckets and in one that is searched alone."""
    rng = np.random.default_rng(4)
    keys = np.sort(np.r_[rng.integers(0, 20, 100), np.full(500, 99)])
    fps = rng.integers(0, 1 << 64, (600, near.COMPARED), np.uint64)
    for i in range(1, 600):
        if rng.random() < 0.6:
            fps[i] = fps[max(0, i - rng.integers(1, 4))]
            for bit in rng.choice(256, rng.integers(0, 90), replace=False):
                fps[i, bit // 64] ^= np.uint64(1 << int(bit % 64))
    far = np.bitwise_count(fps[:, None] ^ fps[None]).sum(axis=2)
    a, b = np.nonzero((far <= near.RADIUS) & (keys[:, None] == keys[None]))
    got = near.close_rows(keys, fps)
    assert components(600, list(zip(*got, strict=True))) == components(600, list(zip(a.tolist(), b.tolist(), strict=True)))


def test_large_class_is_compared_in_parts(spark):
    """A chain as one class of candidates, cut into parts of three."""
    words = [f"w{i}" for i in range(400)]
    docs = spark.createDataFrame([(i, " ".join(words[10 * i : 10 * i + 200]), i) for i in range(20)], "doc_id long, text string, mark long")
    sig = near.signatures(docs, "doc_id", "text", "mark", 5)
    links = near.near_links(docs, sig, "doc_id", "text", "mark", 5, 0.8, split_above=3)
    assert near.connected_components(links, "a", "b").select("component").distinct().count() == 1


def test_thinned_links_have_the_same_components(spark):
    """A clique, a chain, loops and repeated links, over one and over many parts."""
    rows = [(a, b) for a in range(40) for b in range(a, 40)] + [(i, i + 1) for i in range(50, 90)] * 2
    links = spark.createDataFrame(rows, "a long, b long").repartition(8)
    whole = {tuple(r) for r in near.connected_components(links, "a", "b").collect()}
    for size, most in ((1 << 18, 79), (200, 400)):
        less = near.thinned(links, size)
        assert less.count() <= most and {tuple(r) for r in near.connected_components(less, "a", "b").collect()} == whole
    assert near.thinned(links.limit(0)).collect() == []
