"""Text quality by a sparse ensemble of rules over text statistics.

Small boosted trees are grown on a sample of labelled rows; every path from a
root to a node is a rule, a conjunction of bounds on statistics. A logistic
regression with an L1 penalty picks and weighs few of the rules. The result is
compiled into one Spark column over the statistics.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns_of, held, one_text, small

#: Labelled rows learned from, at most: those of least hash of the id.
MAX_TRAIN_ROWS = 20_000
TREES, DEPTH, BINS, MIN_LEAF = 16, 3, 32, 20
PENALTIES = (0.01, 0.003, 0.001)

STATISTICS = (
    "log_bytes", "log_words", "word_length", "line_words", "lines_repeated", "words_distinct", "top_word", "letters", "upper", "digits",
    "punctuation", "symbols", "exclaims", "bars", "wide", "spaces", "entropy", "symbol_words", "stops",
)


def _class_table() -> np.ndarray:
    """Share tables over bytes: one row for each class of characters."""
    rows = np.zeros((8, 256))
    for b in range(256):
        c = chr(b)
        rows[0, b] = b < 128 and c.isalpha()
        rows[1, b] = b < 128 and c.isupper()
        rows[2, b] = b < 128 and c.isdigit()
        rows[3, b] = c in ".,;:!?'\"()-"
        rows[4, b] = 32 < b < 127 and not c.isalnum() and c not in ".,;:!?'\"()-"
        rows[5, b] = c == "!"
        rows[6, b] = c == "|"
        rows[7, b] = b >= 128
    return rows.T


_CLASSES = _class_table()
_SYMBOLS = tuple("#$%&*+/<=>@^_`{|}~\\[]")


def statistics(text: str | None) -> list[float]:
    """The values of :data:`STATISTICS`; all zero for a null or empty text."""
    if not text:
        return [0.0] * len(STATISTICS)
    counts = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    n = int(counts.sum())
    share = (counts @ _CLASSES / n).tolist()
    p = counts[counts > 0] / n
    words, lines = text.split(), text.split("\n")
    seen = Counter(words)
    nw, nl = len(words), len(lines)
    return [
        math.log1p(n), math.log1p(nw), (sum(map(len, words)) / nw if nw else 0.0), nw / nl, 1 - len(set(lines)) / nl,
        (len(seen) / nw if nw else 0.0), (max(seen.values()) / nw if nw else 0.0), share[0], share[1], share[2], share[3], share[4], share[5], share[6], share[7],
        1 - sum(map(len, words)) / len(text), float(-(p * np.log2(p)).sum()),
        (sum(c for w, c in seen.items() if w.endswith(_SYMBOLS)) / nw if nw else 0.0), (text.count(". ") + text.count(".\n")) / max(1, nw),
    ]


def with_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and the statistics of every text, as doubles."""
    columns_of(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("quality")
        for b in small(batches):
            values = np.array([statistics(t.as_py()) for t in b.column(1)], float).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c) for c in np.ascontiguousarray(values.T))], [id_col, *STATISTICS])

    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, " + ", ".join(f"{s} double" for s in STATISTICS)
    return docs.select(id_col, text_col).mapInArrow(run, schema)


#: A bound: statistic, whether values above the threshold fit (else those up to it), threshold.
Bound = tuple[str, bool, float]
Rule = tuple[Bound, ...]


@dataclass
class Ensemble:
    """Rules with weights; the score is the logistic of their sum."""

    intercept: float
    rules: tuple[tuple[Rule, float], ...] = ()

    def column(self) -> Column:
        """The score as an expression over the statistics."""
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            fits = F.lit(True)
            for name, above, threshold in rule:
                fits = fits & ((F.col(name) > threshold) if above else (F.col(name) <= threshold))
            total = total + F.when(fits, F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))

    def predict(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for rule, weight in self.rules:
            total += weight * _fits(rule, x)
        return 1 / (1 + np.exp(-total))


def _fits(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for name, above, threshold in rule:
        value = x[:, STATISTICS.index(name)]
        out &= (value > threshold) if above else (value <= threshold)
    return out


def _grow(binned: np.ndarray, edges: list[np.ndarray], slope: np.ndarray, curve: np.ndarray, rows: np.ndarray, rule: Rule, depth: int, out: list[tuple[Rule, np.ndarray]]) -> None:
    """Best split of ``rows`` by second-order gain; both sides become rules and are split on."""
    best = (1e-6, 0, 0)
    g_all, h_all = slope[rows].sum(), curve[rows].sum()
    for f in range(binned.shape[1]):
        b = binned[rows, f]
        n = np.cumsum(np.bincount(b, minlength=BINS))[:-1]
        g = np.cumsum(np.bincount(b, slope[rows], BINS))[:-1]
        h = np.cumsum(np.bincount(b, curve[rows], BINS))[:-1]
        gain = g**2 / (h + 1) + (g_all - g) ** 2 / (h_all - h + 1) - g_all**2 / (h_all + 1)
        gain[(n < MIN_LEAF) | (len(rows) - n < MIN_LEAF)] = -1
        at = int(gain.argmax())
        if gain[at] > best[0]:
            best = (float(gain[at]), f, at)
    if best[0] <= 1e-6:
        out.append((rule, rows))
        return
    _, f, at = best
    for above in (False, True):
        side = rows[(binned[rows, f] > at) == above]
        part = (*rule, (STATISTICS[f], above, float(edges[f][at])))
        if depth > 1:
            _grow(binned, edges, slope, curve, side, part, depth - 1, out)
        else:
            out.append((part, side))


def tree_rules(x: np.ndarray, y: np.ndarray) -> list[Rule]:
    """All root-to-node paths of boosted trees, each once, in order of growth."""
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    edges = [np.r_[e, np.full(BINS - len(e), np.inf)] for e in edges]
    margin, rules = np.zeros(len(y)), {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        leaves: list[tuple[Rule, np.ndarray]] = []
        _grow(binned, edges, p - y, p * (1 - p), np.arange(len(y)), (), DEPTH, leaves)
        for rule, rows in leaves:
            margin[rows] -= 0.5 * (p - y)[rows].sum() / ((p * (1 - p))[rows].sum() + 1)
            for upto in range(1, len(rule) + 1):
                rules[tuple(sorted(set(rule[:upto])))] = None
    return list(rules)


def lasso_logistic(z: np.ndarray, y: np.ndarray, penalty: float, steps: int = 250) -> tuple[float, np.ndarray]:
    """Intercept (not penalised) and weights, by accelerated proximal gradient."""
    n, m = z.shape
    design = np.c_[np.ones(n, np.float32), z.astype(np.float32)]
    v = np.ones(m + 1, np.float32)
    for _ in range(20):
        v = design.T @ (design @ v)
        v /= np.linalg.norm(v)
    rate = 1 / (0.25 * float(np.linalg.norm(design @ v)) ** 2 / n + 1e-9)
    w = np.zeros(m + 1, np.float32)
    ahead, t = w.copy(), 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(design @ ahead, -30, 30)))
        new = ahead - np.float32(rate) * (design.T @ (p - y).astype(np.float32) / np.float32(n))
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - rate * penalty, 0)
        t_new = (1 + math.sqrt(1 + 4 * t * t)) / 2
        ahead = new + np.float32((t - 1) / t_new) * (new - w)
        w, t = new, t_new
    return float(w[0]), w[1:].astype(float)


def _loss(p: np.ndarray, y: np.ndarray) -> float:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())


def fit(x: np.ndarray, y: np.ndarray) -> Ensemble:
    """Rules from trees on four fifths of the rows, the penalty by loss on the rest, weights from all rows.

    Without rows of both labels: no rules, and the smoothed base rate.
    """
    base = (y.sum() + 1) / (len(y) + 2)
    if len(set(y.tolist())) < 2:
        return Ensemble(math.log(base / (1 - base)))
    held = np.arange(len(y)) % 5 == 4
    part = ~held if len(set(y[~held].tolist())) == 2 and held.any() else np.ones(len(y), bool)
    rules = tree_rules(x[part], y[part])
    if not rules:
        return Ensemble(math.log(base / (1 - base)))
    z = np.stack([_fits(r, x) for r in rules], axis=1)

    def trial(penalty: float) -> float:
        b, w = lasso_logistic(z[part], y[part], penalty)
        return _loss(1 / (1 + np.exp(-(b + z[~part] @ w))), y[~part]) if (~part).any() else 0.0

    b, w = lasso_logistic(z, y, min(PENALTIES, key=trial))
    return Ensemble(b, tuple((r, float(v)) for r, v in zip(rules, w, strict=True) if v))


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    training: Column | None = None, max_rows: int = MAX_TRAIN_ROWS,
) -> Ensemble:
    """Fits an ensemble to labelled rows that satisfy ``training``.

    At most ``max_rows`` labels (see :data:`MAX_TRAIN_ROWS`) are broadcast, and
    their statistics come back to the driver. Of several labels of an id the
    least counts, of several texts of an id the one with the least XXH64; null
    ids and labels are left out.
    """
    columns_of(labels, id_col, label_col)
    rows = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    rows = rows if training is None else rows.where(training)
    one = rows.groupBy(id_col).agg(F.min(F.col(label_col).cast("int")).alias("__label"))
    sample = F.broadcast(one.orderBy(F.xxhash64(id_col), id_col).limit(max_rows))
    texts = one_text(docs.select(id_col, text_col).join(sample, id_col), id_col, text_col, "__label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("quality")
        for b in small(batches):
            values = [statistics(t.as_py()) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(values, pa.list_(pa.float64()))], ["label", "x"])

    found = texts.select(text_col, "__label").mapInArrow(run, "label int, x array<double>").toArrow()
    x = np.array(found["x"].to_pylist(), float).reshape(-1, len(STATISTICS))
    y = np.array(found["label"].to_pylist(), float)
    order = np.lexsort((*x.T, y))  # rows come in any order
    order = order[np.random.default_rng(7).permutation(len(order))]
    return fit(x[order], y[order])


def score(docs: DataFrame, model: Ensemble, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, score`` of every row; null and empty texts have statistics of zero. Only the text is looked at."""
    return with_statistics(docs, id_col, text_col).select(id_col, model.column().alias("score"))
