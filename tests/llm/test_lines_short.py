import random
import re

from streetloom.llm import lines, queries


def brute(rows, run_words):
    """Runs of repeated sentences or lines, one row (of distinct ids) after the other."""
    cut = lambda t: re.sub(r"(?<=[.!?])(?=[\t-\r ])|(?<=[\n\u3002\uff01\uff1f])", "\ufdd0", t).split("\ufdd0")
    key = lambda u: " ".join(w for w in re.split(r"[\t-\r ]+", "".join(c.lower() if c.isascii() else c for c in u)) if w)
    seen, out = set(), {}
    for d, text in sorted(rows):
        units = cut(text or "")
        solid, runs, now = [i for i, u in enumerate(units) if key(u)], [], []
        for i in [*solid, None]:
            if i is not None and key(units[i]) in seen:
                now.append(i)
                continue
            if sum(len(key(units[j]).split(" ")) for j in now) >= run_words:
                runs.append((now[0], now[-1]))
            now = []
            if i is not None:
                seen.add(key(units[i]))
        gone = {j for a, z in runs for j in range(a, z + 1)}
        spans = [(len("".join(units[:a])), len("".join(units[: z + 1]))) for a, z in runs]
        out[d] = (0 if text is None else len(units), len(gone), spans, None if text is None else "".join(u for j, u in enumerate(units) if j not in gone))
    return out


def test_runs_match_brute_force(spark):
    rng = random.Random(3)
    pool = ["One two three. ", "Four five six seven!\n", "eight\n", "\n", " \n", "\u4e00\u884c\u3002", "Nine ten. ", "No end ", "x? Y? ", *(f"{rng.choice('abc')} {rng.choice('abc')} {i % 9}. " for i in range(20))]
    rows = [(d, "".join(rng.choice(pool) for _ in range(rng.randrange(12)))) for d in range(80)] + [(200, None), (201, ""), (202, " "), (203, "\n" * 5), (204, "Word without end " * 3000), (205, "Word without end " * 3000)]
    clash = ["place", "runs", "row", "id", "own", "own_tag", "units", "tag", "at"]
    docs = spark.createDataFrame([(d, t, *range(9)) for d, t in rows], "doc_id long, text string, " + ", ".join(f"{c} int" for c in clash))
    got = lines.remove_repeats(docs, min_words=1, pattern=lines.SENTENCES, run_words=6)
    assert got.columns == [*docs.columns, "n_units", "n_removed", "removed"]
    found = {r.doc_id: (r.n_units, r.n_removed, [tuple(x) for x in r.removed], r.text) for r in got.collect()}
    assert found == brute(rows, 6)
    assert all([r[c] for c in clash] == list(range(9)) for r in got.limit(5).collect())


def test_clashing_names_by_line(spark):
    docs = spark.createDataFrame([(1, "a b c d e", 7, 8), (2, "a b c d e", 7, 8)], "doc_id long, text string, places int, __own int")
    got = {r.doc_id: r for r in lines.remove_repeats(docs).collect()}
    assert got[1].text == "a b c d e" and got[2].text == "" and got[2].places == 7 and got[2]["__own"] == 8


def test_query_removes_paragraphs_and_keeps_short_lines(spark, tmp_path):
    """A repeated paragraph of 20 words goes, whatever it stands beside; a short line that many texts share stays."""
    words = " ".join(f"w{i}" for i in range(12))
    passage = f"First {words}. Then {words}."
    rows = [(1, f"All rights reserved.\n{passage} Own end."), (2, f"Before this.  {passage}\nAll rights reserved."), (3, "ALL rights reserved.\nnew")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_units, r.n_removed, r.removed) for r in queries.op3_substring_dedup(spark, str(tmp_path)).collect()}
    # Of document 2 the two sentences (with the blanks before them) and the line after them repeat; the run goes on to that line.
    assert got[1] == (5, 0, "") and got[3] == (3, 0, "")
    assert got[2][0] == 5 and got[2][1] == 4 and got[2][2] == f"12-{len(rows[1][1])}"


def test_columns_of_other_operators_may_have_any_name(spark):
    from streetloom.llm import near, simhash, substrings

    clash = ["spans", "row", "own", "own_tag", "tag", "__tag", "__id", "__own", "__text"]
    docs = spark.createDataFrame([(1, "x y z " * 60, *range(9)), (2, "x y z " * 60, *range(9))], "doc_id long, text string, " + ", ".join(f"{c} int" for c in clash))
    for found in (substrings.remove_repeats(docs), simhash.keep_first(docs), near.keep_first(docs)):
        assert all([r[c] for c in clash] == list(range(9)) for r in found.collect())
    assert simhash.keep_first(docs).count() == 1
