import random

from streetloom.llm import lines


def brute(rows, min_words=5):
    """First places of all units by rank, then what is removed from each row."""
    norm = lambda u: " ".join("".join(c.lower() if c.isascii() else c for c in u).replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").replace("\t", " ").split(" ")).split(" ")
    key = lambda u: " ".join(w for w in norm(u) if w)
    first = {}
    for d, tag, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1])):
        for i, u in enumerate(t.split("\n") if t is not None else ()):
            if len(key(u).split(" ")) >= min_words:
                first.setdefault(key(u), (d, tag, i))
    out = []
    for d, tag, t in rows:
        units = t.split("\n") if t is not None else []
        gone = [len(key(u).split(" ")) >= min_words and first[key(u)] != (d, tag, i) for i, u in enumerate(units)]
        at, spans = 0, []
        for u, g in zip(units, gone, strict=True):
            if g:
                spans.append((at, at + len(u)))
            at += len(u) + 1
        out.append((d, None if t is None else "\n".join(u for u, g in zip(units, gone, strict=True) if not g), len(units), spans))
    return out


def test_matches_brute_force(spark):
    rng = random.Random(8)
    pool = ["a b c d e", "A  b\tc d E ", "short one", "", " ", "Éa b c d e f", "éa b c d e f", "x y z x y z x", *(" ".join(rng.choice("pqrst") for _ in range(7)) for _ in range(30))]
    rows = [(d, "\n".join(rng.choice(pool) for _ in range(rng.randrange(7)))) for d in range(60)]
    rows += [(100, None), (101, ""), (None, "a b c d e\nnew line of this text"), rows[5], rows[5], (7, "a b c d e\nother text with the id seven")]
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, n_units int")
    tags = {(r.doc_id, r.text): r.tag for r in docs.select("doc_id", "text", lines._tag(docs.text).alias("tag")).collect()}
    got = lines.remove_repeats(docs)
    assert got.columns == ["doc_id", "text", "n_units", "n_removed", "removed"]
    found = [(r.doc_id, r.text, r.n_units, [tuple(x) for x in r.removed]) for r in got.collect()]
    want = brute([(d, tags[d, t], t) for d, t in rows])
    assert sorted(found, key=str) == sorted(want, key=str)
    assert lines.remove_repeats(docs.limit(0)).collect() == []


def test_paragraphs_and_offsets(spark):
    docs = spark.createDataFrame([(1, "one two three four five\n\nx"), (2, "😀\n\nOne two  three four five\n\ny")], "doc_id long, text string")
    got = {r.doc_id: r for r in lines.remove_repeats(docs, separator="\n\n").collect()}
    assert got[1].n_removed == 0 and got[2].text == "😀\n\ny" and [tuple(x) for x in got[2].removed] == [(3, 27)]
