import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from streetloom.llm import quality
from streetloom.llm.common import one_text


def make(rng, good):
    words = [f"{a}{b}{c}" for a in "stkmn" for b in "aeiou" for c in ["l", "rn", "st", ""]]
    body = [rng.choice(words) for _ in range(rng.randrange(15, 90))]
    if not good:
        kind = rng.randrange(3)
        body = [w.upper() + "!!" for w in body] if kind == 0 else [w + rng.choice(["###", "%%%", "***"]) for w in body] if kind == 1 else " | ".join(body).split(" ")
    return " ".join(body) + "."


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(4)
    truth = {d: int(d % 5 > 0) for d in range(1200)}
    docs = spark.createDataFrame([(d, make(rng, y), "x") for d, y in truth.items()], "doc_id long, text string, upper string")
    labels = spark.createDataFrame([*truth.items(), (None, 1), (4, None)], "doc_id long, quality int")
    return docs, labels, truth


def test_held_out_and_compiled_rules(spark, tables):
    docs, labels, truth = tables
    model = quality.train(docs, labels, training=F.col("doc_id") % 3 != 1)
    assert 0 < len(model.rules) < 60 and all(1 <= len(r) <= quality.DEPTH for r, _ in model.rules)
    odd = spark.createDataFrame([(5000, None, ""), (5001, "", ""), (5001, "", ""), (None, "abc", ""), (5002, "word " * 100000, "")], docs.schema)
    rows = docs.unionByName(odd)
    got = quality.score(rows, model).collect()
    assert len(got) == 1205 and all(0 <= r.score <= 1 for r in got)
    by_id = {r.doc_id: r.score for r in got}
    held = [d for d in truth if d % 3 == 1]
    assert sum((by_id[d] >= 0.5) == bool(truth[d]) for d in held) >= 0.97 * len(held)
    assert by_id[5000] == by_id[5001]
    plain = model.predict(np.array([quality.statistics(r.text) for r in rows.collect()]))
    assert np.allclose([r.score for r in got], plain)


def test_training_is_bounded_and_repeatable(spark, tables):
    docs, labels, _ = tables
    a = quality.train(docs, labels, max_rows=400)
    b = quality.train(docs.repartition(7), labels.repartition(3), max_rows=400)
    assert a == b


def test_lasso_drops_what_does_not_help():
    rng = np.random.default_rng(1)
    z = rng.random((600, 30)) < 0.5
    y = (z[:, 3] ^ (rng.random(600) < 0.02)).astype(float)
    _, w = quality.lasso_logistic(z, y, 0.02)
    assert np.argmax(np.abs(w)) == 3 and np.count_nonzero(w) < 10


def test_one_label_or_none(spark, tables):
    docs, labels, _ = tables
    assert quality.train(docs, labels.limit(0)).rules == ()
    assert quality.score(docs.limit(1), quality.train(docs, labels.limit(0))).first().score == 0.5
    only = quality.train(docs, labels.where("quality = 1"))
    assert quality.score(docs.limit(1), only).first().score > 0.9
    assert quality.score(docs.limit(0), only).collect() == []


def test_an_id_teaches_one_text(spark):
    rows = [(1, "b c d", ""), (1, "a b c", ""), (1, "a b c", ""), (1, None, ""), (2, "x y !!", ""), (3, None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, upper string")
    marks = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id long, label int")
    pairs = docs.join(marks, "doc_id")
    got = one_text(pairs, "doc_id", "text", "label").collect()
    least = min(pairs.where("doc_id = 1").select("text", F.xxhash64("text").alias("h")).collect(), key=lambda r: r.h).text
    assert sorted(map(str, got)) == sorted(map(str, spark.createDataFrame([(least, 1), ("x y !!", 0), (None, 0)], "text string, label int").collect()))
