import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from streetloom.llm import bpe, decontaminate, queries, simhash

WORDS = [f"{a}{b}{c}" for a in "stkmnpr" for b in "aeiou" for c in ("l", "rn", "st", "", "nd")]


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(12)
    prose = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    rows, labels, items = [], [], [(i, prose(30)) for i in range(4)]
    passage = prose(60)
    for d in range(300):
        body = prose(rng.randrange(80, 160)).split()
        bad = d % 10 == 3
        for word in ["scum", "moron", "trash", "idiot"] * bad:
            body.insert(rng.randrange(len(body)), word)
        rows.append([d, " ".join(body)])
        if d % 3:
            labels.append((d, int(bad), 1))
    for d in (20, 21, 45):
        rows[d][1] += " " + passage
    for d in (60, 61):
        rows[d][1] += "\n" + items[d % 4][1]
    near = prose(900).split()
    rows.append([400, " ".join(near)])
    rows.append([401, " ".join(near[:450] + ["changed"] + near[451:])])
    rows += [[402, rows[5][1]], [403, None], [404, ""]]
    rows = [(d, t, "en", f"s{d % 3}", len(t or "")) for d, t in rows]
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int, quality int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def without_repeats(docs):
    """Brute force of the third stage."""
    data = {d: (t or "").encode() for d, t in docs.items()}
    seen = Counter(b[i : i + 200] for b in data.values() for i in range(len(b) - 199))
    out = {}
    for d, b in data.items():
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                gone[i : i + 200] = True
        rest = bytes(np.frombuffer(b, np.uint8)[~gone]).decode("utf-8", "ignore")
        out[d] = None if docs[d] is None else rest
    return out


def first_of_classes(docs):
    ids = sorted(docs)
    fps = {d: simhash.fingerprint(docs[d]) for d in ids}
    least = {d: d for d in ids}
    for _ in ids:
        new = {d: min(least[e] for e in ids if (fps[d] ^ fps[e]).bit_count() <= 2) for d in ids}
        if new == least:
            break
        least = new
    return {d: docs[d] for d in ids if least[d] == d}


def test_stages_against_brute_force(spark, sf_dir):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "suffix_array_dedup", "benchmark_decontamination", "byte_bpe"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    own, kept = {r.doc_id: r.text for r in docs.collect()}, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, sf_dir).collect(), docs.schema)
        assert docs.columns == columns, name
        kept.append({r.doc_id: r.text for r in docs.collect()})
        assert all(r.n_chars == len(r.text or "") for r in docs.collect())
    toxic = {d for d in range(300) if d % 10 == 3}
    assert set(own) - set(kept[0]) == toxic
    assert kept[1] == first_of_classes(kept[0])
    assert kept[2] == without_repeats(kept[1])
    matcher = decontaminate.Matcher(list(enumerate(items)))
    assert kept[3] == {d: t for d, t in kept[2].items() if not any(decontaminate.fold(i) in decontaminate.fold(t) for i in items)}
    assert all(not matcher.find(t) for t in kept[3].values()) and not {60, 61} & set(kept[3])
    with open(queries.tokenizer()[0], "rb") as f:
        oracle = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(f.read()), special_tokens={})
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert set(got) == set(kept[3])
    for d, text in kept[3].items():
        ids = oracle.encode_ordinary(text or "")
        assert (got[d].n_tokens, got[d].ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert got[d].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_empty_documents(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect() == []
