import random

from streetloom.llm import decontaminate as dc


def distance(pattern, text):
    """Least edit distance of pattern to any substring of text, and the first end of one."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, c in enumerate(text, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (p != c)))
        row = new
    return min(row), row.index(min(row))


def test_myers_matches_dynamic_programming():
    rng = random.Random(0)
    for _ in range(400):
        p = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 80)))
        t = "".join(rng.choice("abc") for _ in range(rng.randrange(90)))
        if rng.random() < 0.5:
            t = t[:20] + p[: rng.randrange(len(p) + 1)] + t[20:]
        k = rng.randrange(20)
        d, end = distance(p, t)
        got = dc.myers(p, t, k)
        assert got == ((d, end) if d <= k and end else None) or (end == 0 and (got is None or got[0] == d))


def edited(rng, text, edits):
    for _ in range(edits):
        i = rng.randrange(len(text))
        text = text[:i] + rng.choice(["", "x", text[i] + "y"]) + text[i + 1 :]
    return text


def test_find_matches_brute_force(spark):
    rng = random.Random(3)
    words = [a + b for a in ["th", "er", "on", "qu", "é"] for b in ["a", "in", "or", "es"]]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, prose(rng.randrange(15, 40))) for i in range(12)] + [(50, None), (51, ""), (None, prose(20)), (52, "İstanbul " + prose(15))]
    rows = [(0, None, "x"), (1, "", "x"), (2, prose(400), "x")]
    for d in range(10, 90):
        _, item = rng.choice([x for x in items if x[1] and x[0] is not None])
        text = edited(rng, item, rng.randrange(0, 9))
        rows.append((d, prose(rng.randrange(30)) + " " + (text.upper() if d % 5 == 0 else text) + " " + prose(rng.randrange(30)), "x"))
    rows += [rows[10], (None, items[0][1], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(
        ((d, i, best[0]) for d, t, _ in rows for i, item in items if t and item and i is not None for best in [distance(dc.fold(item), dc.fold(t))] if best[0] <= dc.budget(item)),
        key=str,
    )
    for block_chars in (1_000_000, 300):
        got = dc.find_items(docs, bench, block_chars=block_chars).collect()
        assert sorted(((r.doc_id, r.item_id, r.distance) for r in got), key=str) == want
        text = dict((d, t) for d, t, _ in rows)
        for r in got:
            assert distance(dc.fold(dict(items)[r.item_id]), dc.fold(text[r.doc_id])[r.start : r.stop])[0] == r.distance
        kept = dc.drop_contaminated(docs, bench, block_chars=block_chars)
        assert kept.columns == docs.columns
        hit = {w[0] for w in want}
        assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted((d for d, _, _ in rows if d not in hit), key=str)


def test_empty(spark):
    docs = spark.createDataFrame([(1, "some text of it")], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert dc.find_items(docs, bench).collect() == []
    assert dc.drop_contaminated(docs, bench).count() == 1
    assert dc.find_items(docs.limit(0), spark.createDataFrame([(1, "some text")], "item_id long, text string")).collect() == []


def test_fold_is_by_character():
    for text in ("ΑΣ", "ΑΣΑ", "Σ İΣ", "AbC"):
        assert len(dc.fold(text)) == len(text)
    assert dc.fold("ΑΣ") + "α" == dc.fold("ΑΣΑ")
