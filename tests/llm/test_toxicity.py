import math
import random

import pytest
from pyspark.sql import functions as F

from streetloom.llm import toxicity


def slow_segments(scores):
    """Maximal scoring segments by their recursive definition: the best (then shortest, then first) one, then what is left and right of it."""
    if not scores or max(scores) <= 0:
        return []
    best = max(((sum(scores[a : b + 1]), -(b - a), -a, a, b) for a in range(len(scores)) for b in range(a, len(scores))))
    _, _, _, a, b = best
    right = [(x + b + 1, y + b + 1, s) for x, y, s in slow_segments(scores[b + 1 :])]
    return [*slow_segments(scores[:a]), (a, b, best[0]), *right]


def test_segments_match_definition():
    rng = random.Random(1)
    for _ in range(400):
        scores = [rng.choice([-0.75, -0.75, -0.75, 1.3, 2.1, 0.4]) for _ in range(rng.randrange(1, 22))]
        hits = [(i, s) for i, s in enumerate(scores) if s > 0]
        got = toxicity.segments(hits, 0.75)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in slow_segments(scores)]
        assert all(math.isclose(s, sum(scores[a : b + 1]), abs_tol=1e-9) for a, b, s in got)


def test_rate_solves_its_equation():
    import numpy as np

    scores, share = np.array([3.0, 6.0]), np.array([1e-3, 1e-5])
    rate = toxicity._rate(scores, share, 0.7)
    assert rate > 0
    assert math.isclose((1 - share.sum()) * math.exp(-0.7 * rate) + (share * np.exp(rate * scores)).sum(), 1, abs_tol=1e-6)


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(200)]
    rows, labels = [], []
    for d in range(800):
        body = [rng.choice(words) for _ in range(rng.randrange(20, 80))]
        bad = d % 8 == 0
        for _ in range(3 * bad):
            body.insert(rng.randrange(len(body)), rng.choice(["Scum", "moron,", "trash"]))
        rows.append((d, " ".join(body), "en"))
        labels.append((d, int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    return docs, spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int"), dict(labels)


def test_held_out(spark, tables):
    docs, labels, truth = tables
    model = toxicity.train(docs, labels, training=F.col("doc_id") % 3 != 0)
    assert {"scum", "moron", "trash"} <= set(model.scores)
    odd = spark.createDataFrame([(None, "x scum y moron", ""), (9000, None, ""), (9001, "", ""), (9001, "", ""), (9002, "scum moron trash " * 20000, "")], docs.schema)
    got = toxicity.score(docs.unionByName(odd), model).collect()
    assert len(got) == docs.count() + 5
    by_id = {r.doc_id: r for r in got}
    held = [d for d in truth if d % 3 == 0]
    assert sum((by_id[d].score >= 0.3) == bool(truth[d]) for d in held) >= 0.97 * len(held)
    assert by_id[9000].score == by_id[9001].score < 0.3 < by_id[9002].score
    assert by_id[None].passages
    kept = toxicity.drop_toxic(docs.unionByName(odd), model, 0.3)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in got if r.score < 0.3)


def test_no_labels_and_no_rows(spark, tables):
    docs, labels, _ = tables
    none = toxicity.train(docs, labels.limit(0))
    assert none.scores == {} and toxicity.score(docs.limit(2), none).first().score == 0.5
    assert toxicity.train(docs, labels.where("toxic = 0")).scores == {}
    assert toxicity.score(docs.limit(0), none).collect() == []
    assert toxicity.train(docs.limit(0), labels).scores == {}
