"""Near-duplicates by the Jaccard similarity of word shingles, found by SimHash.

Documents are compared as sets of hashed shingles; equal sets are one node,
whatever their number. Each set has a SimHash fingerprint of 512 bits. Two sets
of similarity ``s`` differ in a bit with probability ``acos(2 s / (1 + s)) / pi``
(0.15 at 0.8), so they meet in one of the bands, which are bits picked from the
fingerprint, but for a share of pairs that the number of bands keeps near
``MISSED``. Inside a band's bucket the first 256 bits are searched within
``RADIUS`` by the bit-sliced comparison of :mod:`.simhash`.

Only a spanning forest of what is close leaves a bucket, so neither a large
group of copies nor one of look-alikes makes pairs by the square of its size.
What these forests connect is a class of candidates; inside of it all sets are
compared exactly, and again only a forest of the verified links is kept.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streetloom.graph.components import connected_components
from streetloom.plans.shared import materialise, release

from .common import columns_of, held, small, unused
from .simhash import Forest, bucket_forest

SHINGLE = 5
SIMILARITY = 0.8
WORDS, COMPARED = 8, 4  # 64-bit words of a fingerprint, and how many of them are compared
RADIUS = 66
MISSED = 1e-5
SPLIT_ABOVE = 2048  # members of a class of candidates that are compared in one task
THIN = 1 << 18  # links between candidates that become one forest
_SLAB, _ROWS = 1 << 12, 1 << 16
_STEP = np.uint64(0x9E3779B97F4A7C15)
_RNG = np.random.default_rng(5)
_XOR = _RNG.integers(0, 1 << 64, WORDS, np.uint64)
_ODD = _RNG.integers(0, 1 << 64, WORDS, np.uint64) | np.uint64(1)


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles. Words as in ``simhash.fingerprint``.

    Fewer words than ``shingle``: the whole sequence is the one shingle. Null
    or no words: the one value 0.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(1, np.uint64)
    size, digest = min(shingle, len(words)), xxhash.xxh64_intdigest
    each = np.fromiter(map(digest, words), np.uint64, len(words))
    n = len(words) - size + 1
    out = np.full(n, size, np.uint64)
    for k in range(size):
        out = out * _STEP + each[k : k + n]
    out = (out ^ (out >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return np.unique(out ^ (out >> np.uint64(33)))


def fingerprint(values: np.ndarray) -> np.ndarray:
    """SimHash of a shingle set, ``WORDS`` words: a bit is set if it is in more than half of the values' hashes."""
    counts = np.zeros(64 * WORDS, np.int64)
    for at in range(0, len(values), _SLAB):
        h = (values[at : at + _SLAB, None] ^ _XOR) * _ODD
        h = (h ^ (h >> np.uint64(32))) * _STEP
        h ^= h >> np.uint64(29)
        counts += np.unpackbits(h.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint16)
    return np.packbits(2 * counts > len(values), bitorder="little").view(np.uint64)


def band_picks(sets: int, similarity: float = SIMILARITY) -> np.ndarray:
    """Which bits make each band (one row a band), for so many sets.

    A band has at least 12 bits and so many that about 256 unlike sets meet in
    a bucket; a band more for what longer bands miss.
    """
    bits = max(12, math.ceil(math.log2(max(sets, 1))) - 8)
    agree = (1 - math.acos(2 * similarity / (1 + similarity)) / math.pi) ** bits
    bands = 1 if agree == 1 else math.ceil(math.log(MISSED) / math.log1p(-agree))
    rng, each = np.random.default_rng(7), 64 * WORDS // bits
    rounds = [rng.permutation(64 * WORDS)[: each * bits].reshape(each, bits) for _ in range(-(-bands // each))]
    return np.concatenate(rounds)[:bands]


def bands(fps: np.ndarray, picks: np.ndarray) -> np.ndarray:
    """A row of keys for each fingerprint: the number of a band above its bits."""
    bits = np.unpackbits(np.ascontiguousarray(fps).view(np.uint8), axis=1, bitorder="little")
    out = np.repeat(np.arange(len(picks), dtype=np.int64)[None], len(fps), axis=0)
    for column in picks.T:
        out = out * 2 + bits[:, column]
    return out


def signatures(docs: DataFrame, id_col: str, text_col: str, tag: str, shingle: int) -> DataFrame:
    """``id_col, tag, key, fp`` of every row: digest and fingerprint of the shingle set."""
    names = [id_col, tag]
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names) + ", key long, fp array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("near")
        for b in small(batches):
            sets = [shingles(t.as_py(), shingle) for t in b.column(2)]
            keys = np.fromiter((xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets), np.uint64, len(sets))
            fps = [fingerprint(s).view(np.int64) for s in sets]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(keys.view(np.int64)), pa.array(fps, pa.list_(pa.int64()))], [*names, "key", "fp"])

    return docs.select(*names, text_col).mapInArrow(run, schema)


# --- forests inside a bucket or a class --------------------------------------


def forest_of(n: int, near: Callable[[int], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of a symmetric relation; ``near(i)`` tells which of the ``n`` members are linked with ``i``.

    Members that an earlier one reached are asked only if they stand outside
    the largest tree: of every other pair one member has been asked, or both
    are in that tree already.
    """
    forest, reached, asked = Forest(n), np.zeros(n, bool), np.zeros(n, bool)

    def ask(i: int) -> None:
        hits = np.flatnonzero(near(i))
        reached[hits] = True
        asked[i] = True
        forest.join(np.full(len(hits), i), hits)

    for i in range(n):
        if not reached[i]:
            ask(i)
    largest = np.bincount(forest.root).argmax()
    for i in np.flatnonzero(~asked & (forest.root != largest)):
        ask(int(i))
    leaf = np.flatnonzero(forest.root != np.arange(n))
    return leaf, forest.root[leaf]


def close_rows(keys: np.ndarray, fps: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """A forest, as numbers of rows, of the fingerprints within ``radius`` inside each run of equal ``keys``.

    The bit-sliced search looks at all buckets together, one offset a step, so
    it takes as many steps as the largest bucket has members. A few buckets
    far above the rest are searched one by one where that is less work.
    """
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[starts, len(keys)])
    order = np.argsort(-sizes, kind="stable")
    alone = np.cumsum(sizes[order] * (1e-5 + 1.2e-8 * sizes[order]))  # seconds, about; a step takes 3 ms
    apart = order[: int(np.argmin(np.r_[0, alone] + 3e-3 * np.r_[sizes[order], 0]))]
    together, found = np.ones(len(keys), bool), []
    for start, size in zip(starts[apart], sizes[apart], strict=True):
        together[start : start + size] = False
        own = fps[start : start + size]
        a, b = forest_of(size, lambda i, own=own: np.bitwise_count(own ^ own[i]).sum(axis=1) <= radius)
        found.append((a + start, b + start))
    rows = np.flatnonzero(together)
    a, b = bucket_forest(keys[rows], fps[rows], radius)
    found.append((rows[a], rows[b]))
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def alike(flat: np.ndarray, sizes: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the sets of at least ``similarity``; ``flat`` holds the sets one behind the other."""
    values, codes = np.unique(flat, return_inverse=True)
    ends = np.cumsum(sizes)
    starts, mark = ends - sizes, np.zeros(len(values), np.int32)

    def near(i: int) -> np.ndarray:
        own = codes[starts[i] : ends[i]]
        mark[own] = 1
        common = np.add.reduceat(mark[codes], starts)
        mark[own] = 0
        return common / (sizes + sizes[i] - common) >= similarity

    return forest_of(len(sizes), near)


def _whole(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Tables of at least ``rows`` rows, but the last, that hold all rows of their keys. Rows come sorted by the first column."""
    held("near")
    kept, n = [], 0
    for b in batches:
        if not b.num_rows:
            continue
        kept.append(b)
        n += b.num_rows
        if n < rows:
            continue
        table = pa.Table.from_batches(kept)
        keys = table.column(0).to_numpy()
        if whole := int(np.searchsorted(keys, keys[-1])):  # the last key may go on
            yield table.slice(0, whole)
            kept = table.slice(whole).to_batches()
        n -= whole
    if kept:
        yield pa.Table.from_batches(kept)


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


# --- tables --------------------------------------------------------------------


def candidates(first: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``a, b``: forests that connect the sets whose fingerprints are close in some bucket. ``first``: ``key, fp`` of each set."""
    picks = band_picks(first.count(), similarity)
    names = [f"f{k}" for k in range(COMPARED)]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("near")
        for b in small(batches, 512):
            fps = np.array(b.column(1).to_pylist(), np.int64).reshape(-1, WORDS)
            rows = [np.repeat(x, len(picks)) for x in (b.column(0).to_numpy(), *fps.T[:COMPARED])]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (bands(fps, picks).ravel(), *rows)], ["band", "key", *names])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole(batches, _ROWS):
            band, key, *fp = (c.to_numpy() for c in t.columns)
            a, b = close_rows(band, np.stack(fp, axis=1).view(np.uint64))
            yield _pairs(key[a], key[b])

    dealt = first.select("key", "fp").mapInArrow(deal, "band long, key long, " + ", ".join(f"{n} long" for n in names))
    return dealt.repartition("band").sortWithinPartitions("band").mapInArrow(search, "a long, b long").distinct()


def thinned(links: DataFrame, rows: int = THIN) -> DataFrame:
    """Fewer rows ``a, b`` with the same components: a forest for every so many rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = [np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()]) for b in batches if b.num_rows]
        if not ends:
            return
        nodes, codes = np.unique(np.concatenate(ends, axis=1), return_inverse=True)
        a, b = codes.reshape(2, -1)
        forest = Forest(len(nodes))
        forest.join(a, b)
        leaf = np.flatnonzero(forest.root != np.arange(len(nodes)))
        yield _pairs(nodes[leaf], nodes[forest.root[leaf]])

    return links.coalesce(max(1, -(-links.count() // rows))).mapInArrow(run, "a long, b long")


def verified(docs: DataFrame, first: DataFrame, classes: DataFrame, id_col: str, text_col: str, tag: str, shingle: int, similarity: float, split_above: int) -> DataFrame:
    """``a, b``: forests of the links of at least ``similarity`` inside each class (``node, component``).

    A class above ``split_above`` members is cut into parts, and every two
    parts meet in a task of their own.
    """
    size = classes.groupBy("component").agg(F.ceil(F.count("*") / split_above).alias("parts"))
    part = F.pmod(F.xxhash64("node"), F.col("parts"))
    other = F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)
    tasks = F.when(F.col("parts") == 1, F.array(F.xxhash64("component"))).otherwise(
        F.transform(F.filter(other, lambda x: x != part), lambda x: F.xxhash64("component", F.least(x, part), F.greatest(x, part)))
    )
    placed = classes.join(size.hint("rebalance"), "component").select(F.col("node").alias("key"), tasks.alias("tasks"))
    heads = first.join(placed, "key").select("key", "tasks", F.col(f"head.{id_col}").alias("__id"), F.col(f"head.{tag}").alias("__mark"))
    own = docs.select(F.col(id_col).alias("__id"), F.col(tag).alias("__mark"), F.col(text_col).alias("text"))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("near")
        for b in small(batches):
            words = [shingles(t.as_py(), shingle).view(np.int64) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(words, pa.list_(pa.int64()))], ["key", "tasks", "words"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole(batches, 1 << 10):
            t = t.combine_chunks()
            task, key, words = t.column(0).to_numpy(), t.column(1).to_numpy(), t.column(2)
            starts = np.flatnonzero(np.r_[True, task[1:] != task[:-1]])
            for start, stop in zip(starts, np.r_[starts[1:], len(task)], strict=True):
                keys, at = np.unique(key[start:stop], return_index=True)  # a row that repeats comes as often
                if len(keys) < 2:
                    continue
                sets = words.slice(start, stop - start).combine_chunks().take(pa.array(at))
                a, b = alike(sets.flatten().to_numpy(), sets.value_lengths().to_numpy().astype(np.int64), similarity)
                if len(a):
                    yield _pairs(keys[a], keys[b])

    sets = own.join(heads, ["__id", "__mark"]).select("key", "tasks", "text").mapInArrow(deal, "key long, tasks array<long>, words array<long>")
    dealt = sets.select(F.explode("tasks").alias("task"), "key", "words").repartition("task").sortWithinPartitions("task")
    return dealt.mapInArrow(compare, "a long, b long")


def near_links(
    docs: DataFrame, sig: DataFrame, id_col: str, text_col: str, tag: str,
    shingle: int, similarity: float, split_above: int = SPLIT_ABOVE,
) -> DataFrame:
    """Rows ``a, b`` whose components are those of the links of ``similarity`` among shingle sets."""
    first = materialise(sig.groupBy("key").agg(F.min(F.struct(id_col, tag)).alias("head"), F.first("fp").alias("fp")))
    close = materialise(candidates(first, similarity))
    classes = connected_components(thinned(close), "a", "b")
    found = materialise(verified(docs, first, classes, id_col, text_col, tag, shingle, similarity, split_above))
    release(first)
    release(close)
    return found


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one row of each class of near-duplicates: the one with the least id.

    A class is what links of at least ``similarity`` connect. Where the least
    id has several rows in its class, the text with the least XXH64 stays,
    once; an id that heads several classes stays once for each. All columns are
    kept. Rows with a null id stay and link nothing.
    """
    columns_of(docs, id_col, text_col)
    tag = unused(docs, "__tag")
    tagged = docs.withColumn(tag, F.xxhash64(text_col)).where(F.col(id_col).isNotNull())
    sig = materialise(signatures(tagged, id_col, text_col, tag, shingle))
    links = near_links(tagged, sig, id_col, text_col, tag, shingle, similarity)
    label = connected_components(links, "a", "b").withColumnRenamed("node", "key")
    own = sig.select(id_col, tag, "key").join(label, "key", "left").withColumn("component", F.coalesce("component", "key"))
    own = materialise(own.select(id_col, tag, "component"))
    least = own.groupBy("component").agg(F.min(F.struct(id_col, tag)).alias("head"))
    heads = materialise(least.select(f"head.{id_col}", f"head.{tag}"))
    once = tagged.join(heads, [id_col, tag], "left_semi").dropDuplicates([id_col, tag])
    release(sig)
    return once.select(docs.columns).unionByName(docs.where(F.col(id_col).isNull()))
