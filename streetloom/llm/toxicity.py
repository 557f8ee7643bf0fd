"""Toxic passages as maximum-scoring segments of token log-odds.

Training compares token counts of toxic and other labelled texts by log-odds
ratios with an informative Dirichlet prior (the pooled counts, scaled). A word
counts as itself and as its stems (its first four to seven letters), so that
inflected and compound forms share what is known of their stem. A word scores
the highest significant ratio among these; every other word costs a fixed
``drop``.
A text's toxic passages are all its maximal-scoring segments, found in one scan
(linear in its tokens). By extreme-value theory a text of ``n`` random tokens
holds on average ``K n exp(-lambda S)`` segments of score ``S`` or more; lambda
solves ``sum p exp(lambda s) = 1`` over the scores of clean text, K is counted
there. Segments that are rarer than ``rare`` by chance are kept, their evidence
``lambda S - ln(K n)`` is summed, and a logistic curve over that sum gives the
text's score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streetloom.plans.shared import materialise, release

from .common import columns_of, held, one_text, small

#: Labelled rows learned from, at most: those of least hash of the id.
MAX_TRAIN_ROWS = 30_000
#: Weight of the prior: this share of the pooled counts. A token seen only in toxic texts is significant from about a dozen on.
PRIOR_SHARE = 0.1
MIN_Z = 4.0
DROP = 0.7
RARE = 0.05
STEMS = range(4, 8)
MAX_KNOWN = 200_000  # scored words kept in a worker
_TOKEN = re.compile(r"\w+")


def tokens_of(text: str | None) -> list[str]:
    return _TOKEN.findall((text or "").lower())


def forms_of(word: str) -> list[str]:
    """The word, and its stems with a mark behind them."""
    return [word, *(word[:n] + "*" for n in STEMS if n < len(word))]


class _Scores(dict):
    """Scores of words met so far (0: not significant); emptied when full."""

    def __init__(self, known: dict[str, float]) -> None:
        self.known = known

    def __missing__(self, word: str) -> float:
        if len(self) >= MAX_KNOWN:
            self.clear()
        self[word] = found = max(self.known.get(f, 0.0) for f in forms_of(word))
        return found


def segments(hits: list[tuple[int, float]], drop: float) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments ``(first, last, score)`` of a sequence in which only ``hits`` score above ``-drop``.

    ``hits`` are ``(position, positive score)`` in order; all other positions
    score ``-drop``. Candidates are kept with the sums before and after them; a
    new one is merged leftwards while an earlier one starts lower and it ends
    higher (every merge removes a candidate, so the scan is linear in the hits).
    """
    kept: list[list[float]] = []  # first, last, sum before, sum after
    back: list[int] = []  # for each candidate the nearest earlier one with a smaller sum before, or -1
    total, at = 0.0, 0
    for position, score in hits:
        total -= drop * (position - at)
        new = [position, position, total, total + score]
        total, at = total + score, position + 1
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= new[2]:
                j = back[j]
            if j < 0 or kept[j][3] >= new[3]:
                back.append(j)
                kept.append(new)
                break
            new = [kept[j][0], new[1], kept[j][2], new[3]]
            del kept[j:], back[j:]
    return [(int(a), int(b), after - before) for a, b, before, after in kept]


@dataclass
class Model:
    """Token scores and calibration. ``curve`` maps summed evidence to a probability."""

    scores: dict[str, float] = field(default_factory=dict)
    drop: float = DROP
    rate: float = 1.0
    scale: float = 0.1
    rare: float = RARE
    curve: tuple[float, float] = (0.0, 0.0)
    _words: _Scores | None = field(default=None, repr=False, compare=False)

    def hits(self, tokens: list[str]) -> list[tuple[int, float]]:
        """Positions and scores of the significant words."""
        if self._words is None:
            self._words = _Scores(self.scores)
        return [(i, s) for i, s in enumerate(map(self._words.__getitem__, tokens)) if s]

    def passages(self, text: str | None) -> tuple[int, list[tuple[int, int, float]]]:
        """Number of tokens, and the significant segments as ``(first token, last token, evidence)``."""
        tokens = tokens_of(text)
        hits = self.hits(tokens)
        if not hits:
            return len(tokens), []
        chance = math.log(self.scale * len(tokens))
        found = ((a, b, self.rate * s - chance) for a, b, s in segments(hits, self.drop))
        least = -math.log(self.rare)
        return len(tokens), [x for x in found if x[2] >= least]

    def probability(self, evidence: float) -> float:
        a, b = self.curve
        return 1.0 / (1.0 + math.exp(-max(-40.0, min(40.0, a + b * evidence))))


def _sample(labels: DataFrame, id_col: str, label_col: str, training: F.Column | None, limit: int) -> DataFrame:
    """One label for each id (toxic if any of its rows is), at most ``limit`` of them."""
    rows = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    rows = rows if training is None else rows.where(training)
    one = rows.groupBy(id_col).agg(F.max(F.col(label_col).cast("int")).alias("__label"))
    return one.orderBy(F.xxhash64(id_col), id_col).limit(limit)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Token counts of each task: in toxic, in other texts. A text counts a form once, or one that is repeated on and on would look significant."""
    toxic: Counter = Counter()
    clean: Counter = Counter()

    def give() -> pa.RecordBatch:
        words = list(toxic.keys() | clean.keys())
        return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([toxic[w] for w in words], pa.int64()), pa.array([clean[w] for w in words], pa.int64())], ["token", "y1", "y0"])

    held("toxicity")
    for b in small(batches):
        for text, label in zip(b.column(0), b.column(1).to_pylist(), strict=True):
            (toxic if label else clean).update({f for word in set(tokens_of(text.as_py())) for f in forms_of(word)})
        if len(toxic) + len(clean) > 300_000:
            yield give()
            toxic.clear()
            clean.clear()
    yield give()


def _log_odds(y: F.Column, n: float, a: F.Column) -> F.Column:
    """Log-odds of a token with count ``y`` and prior ``a`` among ``n`` tokens, those of the prior included."""
    return F.log((y + a) / (F.lit(n) - y - a))


def _rate(scores: np.ndarray, share: np.ndarray, drop: float) -> float:
    """The positive root of ``sum p exp(rate s) = 1``; ``share``: how often each score occurs by chance."""
    rest = 1.0 - share.sum()
    low, high = 1e-9, 50.0 / max(scores.max(), 1e-9)
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if rest * math.exp(-drop * mid) + (share * np.exp(mid * scores)).sum() < 1 else (low, mid)
    return low


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Platt's curve: smoothed targets, and a light ridge so that separable data stay finite."""
    n1 = y.sum()
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (len(y) - n1 + 2))
    design, w = np.c_[np.ones_like(x), x / 10.0], np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -40, 40)))
        slope = design.T @ (p - t) + 1e-3 * w
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2), slope)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1] / 10.0)


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    training: F.Column | None = None, max_rows: int = MAX_TRAIN_ROWS, min_z: float = MIN_Z, drop: float = DROP, rare: float = RARE,
) -> Model:
    """Fits a model to the labelled rows that satisfy ``training``.

    At most ``max_rows`` labels are used (see :data:`MAX_TRAIN_ROWS`); that
    bounds what is broadcast, what comes back from scoring them (one number
    each) and, with their texts, the significant tokens. Of several texts of an
    id the one with the least XXH64 counts. Without labels of both
    kinds the model has no tokens and gives the smoothed base rate.
    """
    columns_of(docs, id_col, text_col)
    columns_of(labels, id_col, label_col)
    sample = F.broadcast(_sample(labels.select(id_col, label_col), id_col, label_col, training, max_rows))
    texts = one_text(docs.select(id_col, text_col).join(sample, id_col), id_col, text_col, "__label")
    # Copies count once, or a text copied often would make its words significant. (A text with both labels stays with each.)
    texts = materialise(texts.withColumn("__h", F.xxhash64(text_col)).dropDuplicates(["__h", "__label"]).drop("__h"))
    counts = materialise(texts.mapInArrow(_counts, "token string, y1 long, y0 long").groupBy("token").agg(F.sum("y1").alias("y1"), F.sum("y0").alias("y0")))
    n1, n0 = (n or 0 for n in counts.agg(F.sum("y1"), F.sum("y0")).first())
    rows = []
    if n1 and n0:
        a, all_a = F.lit(PRIOR_SHARE) * (F.col("y1") + F.col("y0")), PRIOR_SHARE * (n1 + n0)
        ratio = _log_odds(F.col("y1"), n1 + all_a, a) - _log_odds(F.col("y0"), n0 + all_a, a)
        z = ratio / F.sqrt(1 / (F.col("y1") + a) + 1 / (F.col("y0") + a))
        odds = counts.select("token", "y0", a.alias("a"), ratio.alias("ratio"), z.alias("z"))
        rows = odds.where((F.col("z") >= min_z) & (F.col("ratio") > 0)).collect()
    model = Model({r.token: float(r.ratio) for r in rows}, drop, rare=rare)
    if rows:
        share = np.array([(r.y0 + r.a) / (n0 + PRIOR_SHARE * (n1 + n0)) for r in rows])
        model.rate = _rate(np.array([r.ratio for r in rows]), share, drop)
        model = _with_scale(model, texts)
    found = np.array(texts.mapInArrow(_evidence(model), "evidence double, label int").toPandas().to_numpy(), float).reshape(-1, 2)
    if len(set(found[:, 1])) == 2:
        model.curve = _logistic(found[:, 0], found[:, 1])
    else:
        base = (found[:, 1].sum() + 1) / (len(found) + 2)
        model.curve = (math.log(base / (1 - base)), 0.0)
    release(texts)
    release(counts)
    return model


def _with_scale(model: Model, texts: DataFrame) -> Model:
    """K from clean texts: how many segments reach the least token score, against what lambda alone tells."""
    least = min(model.scores.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = seen = 0
        for b in small(batches):
            for text, label in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                if not label:
                    tokens = tokens_of(text.as_py())
                    size += len(tokens)
                    seen += sum(s >= least for _, _, s in segments(model.hits(tokens), model.drop))
        yield pa.RecordBatch.from_arrays([pa.array([size], pa.int64()), pa.array([seen], pa.int64())], ["size", "seen"])

    size, seen = texts.mapInArrow(run, "size long, seen long").agg(F.sum("size"), F.sum("seen")).first()
    model.scale = min(1.0, max(1e-3, (seen or 0) / max(1, size or 0) * math.exp(min(40.0, model.rate * least))))
    return model


def _evidence(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            sums = [sum(e for _, _, e in model.passages(t.as_py())[1]) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(sums, pa.float64()), b.column(1).cast(pa.int32())], ["evidence", "label"])

    return run


_SCORED = "score double, n_tokens long, passages array<struct<first:long,last:long,evidence:double>>"


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, score, n_tokens, passages``: ``passages`` are token positions, with the evidence of each.

    Null and empty texts have no passage and the score of texts without one.
    Repeated rows come back as often as they came. Only the text is scored.
    """
    columns_of(docs, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    shape = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("evidence", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("toxicity")
        own = shared.value
        for b in small(batches):
            found = [own.passages(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([
                b.column(0), pa.array([own.probability(sum(e for _, _, e in p)) for _, p in found], pa.float64()), pa.array([n for n, _ in found], pa.int64()),
                pa.array([[{"first": f, "last": s, "evidence": e} for f, s, e in p] for _, p in found], shape),
            ], [id_col, "score", "n_tokens", "passages"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, {_SCORED}")


def drop_toxic(docs: DataFrame, model: Model, threshold: float, text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` with a score below ``threshold``, all columns kept."""
    columns_of(docs, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("toxicity")
        own = shared.value
        for b in small(batches):
            keep = [own.probability(sum(e for _, _, e in own.passages(t.as_py())[1])) < threshold for t in b.column(at)]
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
