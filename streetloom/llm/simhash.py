"""SimHash fingerprints and bit-sliced search for near-duplicates.

Fingerprints of 64 bits are linked when at most ``radius`` bits differ. Pairs
are looked for only among distinct fingerprints that agree on two of four
16-bit blocks (with two differing bits at least two blocks are equal). Buckets
above ``split_above`` members are divided again by two of the four 8-bit parts
of the remaining 32 bits, which bounds a bucket at 2**16 distinct members
without dropping any link. Inside a bucket bit ``i`` of all members lies in one
machine-word plane; the distances of all members at a fixed offset are counted
at once by carry-save adders, and the count stops as soon as every lane is past
the radius. Only a spanning forest of links leaves a bucket.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streetloom.graph.components import connected_components
from streetloom.plans.shared import materialise

from .common import columns_of, held, small, unused

SHINGLE = 3
RADIUS = 2
SPLIT_ABOVE = 2048
_SEED = 42
_SLAB = 1 << 16
_BIT = np.uint64(1) << np.arange(64, dtype=np.uint64)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """SimHash of one text, unsigned. Null or no words: 0.

    Only A-Z are lower-cased; words are runs of bytes outside 0x20 and
    0x09-0x0D. Fewer words than ``shingle``: the whole sequence is the one
    shingle. A bit is set if it is set in more than half of the shingle hashes.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for at in range(0, n, _SLAB):
        upto = min(n, at + _SLAB)
        if n == 1:
            grams = [b" ".join(words)]
        else:
            grams = map(b" ".join, zip(*(words[at + k : upto + k] for k in range(shingle)), strict=True))
        h = np.fromiter((digest(g, _SEED) for g in grams), np.uint64, upto - at)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(_BIT[2 * counts > n].sum(dtype=np.uint64))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, keep: str | None = None) -> DataFrame:
    """``id_col, fp`` (fp: the 64 bits as a signed long), and the column ``keep``, of every row."""
    names = columns_of(docs, id_col, text_col, *[keep] * bool(keep))
    kept = [id_col, *names[2:]]
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept) + ", fp long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("simhash")
        for b in small(batches):
            fps = np.fromiter((fingerprint(t.as_py(), shingle) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), *b.columns[2:], pa.array(fps.view(np.int64))], [*kept, "fp"])

    return docs.select(*names).mapInArrow(run, schema)


# --- bit-sliced comparison -------------------------------------------------


def bit_planes(values: np.ndarray) -> np.ndarray:
    """Rows of packed words: bit ``j`` of plane ``i`` is bit ``i`` of value ``j``. A value is one word or a row of words."""
    words = len(values) // 64 + 2  # a spare word, so that shifts can read past the end
    size = 8 * (values.shape[1] if values.ndim > 1 else 1)
    lanes = np.zeros((words * 64, size), np.uint8)
    lanes[: len(values)] = np.ascontiguousarray(values, np.uint64).view(np.uint8).reshape(len(values), size)
    out = np.empty((8 * size, words), np.uint64)
    for i in range(len(out)):
        out[i] = np.packbits((lanes[:, i // 8] >> (i % 8)) & 1, bitorder="little").view(np.uint64)
    return out


def _shifted(plane: np.ndarray, by: int, words: int) -> np.ndarray:
    at, rest = divmod(by, 64)
    out = plane[at : at + words]
    if len(out) < words:
        out = np.concatenate([out, np.zeros(words - len(out), np.uint64)])
    if rest:
        high = plane[at + 1 : at + 1 + words]
        if len(high) < words:
            high = np.concatenate([high, np.zeros(words - len(high), np.uint64)])
        out = (out >> np.uint64(rest)) | (high << np.uint64(64 - rest))
    return out


def close_lanes(planes: np.ndarray, by: int, lanes: int, live: np.ndarray, radius: int) -> np.ndarray:
    """Lanes ``j`` below ``lanes`` for which values ``j`` and ``j + by`` differ in at most ``radius`` bits.

    ``live`` is a packed mask of the lanes that matter. The differing bits of
    all lanes are added plane by plane into bit-sliced counters; every eighth
    plane the block is given up if no live lane is still within the radius.
    """
    words = -(-lanes // 64)
    size = max(1, radius.bit_length())
    count = [np.zeros(words, np.uint64) for _ in range(size)]
    over = ~live[:words]

    def past() -> np.ndarray:
        """Lanes whose counter, or what ran over it, exceeds the radius."""
        above, equal = np.zeros(words, np.uint64), ~np.zeros(words, np.uint64)
        for k in reversed(range(size)):
            if radius >> k & 1:
                equal = equal & count[k]
            else:
                above = above | (equal & count[k])
                equal = equal & ~count[k]
        return above | over

    for i in range(len(planes)):
        carry = planes[i][:words] ^ _shifted(planes[i], by, words)
        for k in range(size):
            count[k], carry = count[k] ^ carry, count[k] & carry
        over |= carry
        if i % 8 == 7 and not np.any(~past()):
            return np.empty(0, np.int64)
    found = np.flatnonzero(np.unpackbits((~past()).view(np.uint8), bitorder="little"))
    return found[found < lanes]


class Forest:
    """Union-find over row numbers that keeps the least row as the root."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        root = self.root
        while True:
            ra, rb = root[a], root[b]
            apart = ra != rb
            if not apart.any():
                return
            a, b = a[apart], b[apart]
            low, high = np.minimum(ra[apart], rb[apart]), np.maximum(ra[apart], rb[apart])
            np.minimum.at(root, high, low)
            while not np.array_equal(up := root[root], root):
                root[:] = up


def bucket_forest(keys: np.ndarray, values: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links inside each run of equal ``keys``, as numbers of rows."""
    n, none = len(keys), np.empty(0, np.int64)
    if n < 2:
        return none, none
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[starts, n])
    order = np.argsort(-sizes, kind="stable")
    order = order[sizes[order] > 1]
    if not len(order):
        return none, none
    sizes = sizes[order]
    ends = np.cumsum(sizes)
    rows = np.arange(ends[-1]) - np.repeat(ends - sizes, sizes) + np.repeat(starts[order], sizes)
    left = np.repeat(ends, sizes) - np.arange(len(rows))  # members from a row to the end of its bucket
    planes, forest = bit_planes(values[rows]), Forest(len(rows))
    groups = len(sizes)
    for by in range(1, int(sizes[0])):
        while groups and sizes[groups - 1] <= by:
            groups -= 1
        lanes = int(ends[groups - 1])
        bits = np.zeros(-(-lanes // 64) * 64, np.uint8)
        bits[:lanes] = left[:lanes] > by
        hit = close_lanes(planes, by, lanes, np.packbits(bits, bitorder="little").view(np.uint64), radius)
        if len(hit):
            forest.join(hit, hit + by)
    leaf = np.flatnonzero(forest.root != np.arange(len(rows)))
    return rows[leaf], rows[forest.root[leaf]]


def bucket_links(keys: np.ndarray, values: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """:func:`bucket_forest` as values."""
    a, b = bucket_forest(keys, values, radius)
    return values[a], values[b]


def _link_batches(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, values = np.empty(0, np.int64), np.empty(0, np.uint64)

        def give(k: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
            a, b = bucket_links(k, v, radius)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for x in batches:
            if not x.num_rows:
                continue
            keys = np.concatenate([keys, x.column(0).to_numpy(zero_copy_only=False)])
            values = np.concatenate([values, x.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
            if len(keys) < _SLAB:
                continue
            whole = int(np.searchsorted(keys, keys[-1]))  # the last bucket may go on
            if whole:
                yield give(keys[:whole], values[:whole])
                keys, values = keys[whole:], values[whole:]
        yield give(keys, values)

    return run


def _block(col: F.Column, bit: int, width: int) -> F.Column:
    return F.shiftrightunsigned(col, bit).bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def _coarse(fp: F.Column) -> F.Column:
    """Six keys of 35 bits: which two of the 16-bit blocks, and their values."""
    return F.array(*(
        F.lit(t).cast("long") * F.lit(1 << 32) + _block(fp, 16 * i, 16) * F.lit(1 << 16) + _block(fp, 16 * j, 16)
        for t, (i, j) in enumerate(combinations(range(4), 2))
    ))


def _fine(fp: F.Column, key: F.Column) -> F.Column:
    """Six keys of 54 bits: the coarse one, and two of the 8-bit parts of the other two blocks."""
    table = F.shiftrightunsigned(key, 32)
    out = None
    for t, pair in enumerate(combinations(range(4), 2)):
        rest = [16 * k + half for k in range(4) if k not in pair for half in (0, 8)]
        keys = F.array(*(
            key * F.lit(1 << 19) + F.lit(s << 16).cast("long") + _block(fp, rest[i], 8) * F.lit(1 << 8) + _block(fp, rest[j], 8)
            for s, (i, j) in enumerate(combinations(range(4), 2))
        ))
        out = F.when(table == t, keys) if out is None else out.when(table == t, keys)
    return out


def near_links(fps: DataFrame, fp_col: str = "fp", radius: int = RADIUS, split_above: int = SPLIT_ABOVE) -> DataFrame:
    """Links ``a, b`` that connect all distinct values within ``radius`` (2 at most) bits, as a forest per bucket."""
    if not 0 <= radius <= 2:
        raise ValueError("the blocks are complete for a radius of 0, 1 or 2")
    keyed = fps.select(F.col(fp_col).alias("fp")).where("fp is not null").distinct()
    keyed = keyed.select(F.explode(_coarse(F.col("fp"))).alias("key"), "fp")
    size = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    some = keyed.join(size.hint("rebalance"), "key")
    few = some.where(F.col("n") <= split_above).select((F.col("key") * F.lit(1 << 19) + F.lit(7 << 16)).alias("key"), "fp")
    many = some.where(F.col("n") > split_above).select(F.explode(_fine(F.col("fp"), F.col("key"))).alias("key"), "fp")
    dealt = few.unionByName(many).repartition("key").sortWithinPartitions("key", "fp")
    return dealt.mapInArrow(_link_batches(radius), "a long, b long").distinct()


def _classes(fps: DataFrame, id_col: str, radius: int, split_above: int) -> DataFrame:
    """``fp, component_id`` of every distinct fingerprint of ``fps``."""
    first = materialise(fps.groupBy("fp").agg(F.min(id_col).alias("least")))
    label = connected_components(near_links(first, "fp", radius, split_above), "a", "b")
    member = label.join(first, label["node"] == first["fp"]).select("fp", "component", "least")
    member = member.groupBy("component").agg(F.min("least").alias("least")).join(member.select("fp", "component"), "component")
    classes = first.join(member.select("fp", F.col("least").alias("reached")), "fp", "left")
    return materialise(classes.select("fp", F.coalesce("reached", "least").alias("component_id")))


def simhash_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    shingle: int = SHINGLE, radius: int = RADIUS, split_above: int = SPLIT_ABOVE,
) -> DataFrame:
    """Near-duplicate class of every row of ``docs``.

    Returns ``id_col, fp, component_id``; ``component_id`` is the least id that
    links of at most ``radius`` bits can reach. Null and empty texts have
    fingerprint 0 and link like any other. Repeated rows come back as often as
    they came. A null id is kept, but names no class (a class of null ids only
    has the class null). Columns other than the two named are not read.
    """
    fps = materialise(fingerprints(docs, id_col, text_col, shingle))
    return fps.join(_classes(fps, id_col, radius, split_above), "fp").select(id_col, "fp", "component_id")


def keep_first(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    shingle: int = SHINGLE, radius: int = RADIUS, split_above: int = SPLIT_ABOVE,
) -> DataFrame:
    """``docs`` with one row of each near-duplicate class: the one with the least id.

    Where that id has several rows in its class, the text with the least
    XXH64 stays, once. All columns are kept. Rows with a null id stay.
    """
    name, tag = unused(docs, "__tag"), F.xxhash64(text_col)
    tagged = docs.select(id_col, text_col, tag.alias(name))
    fps = materialise(fingerprints(tagged, id_col, text_col, shingle, keep=name))
    found = fps.join(_classes(fps, id_col, radius, split_above), "fp").where(f"`{id_col}` = component_id")
    heads = materialise(found.groupBy(id_col).agg(F.min(name).alias(name)))
    once = docs.withColumn(name, tag).join(heads, [id_col, name], "left_semi").dropDuplicates([id_col])
    return once.select(docs.columns).unionByName(docs.where(F.col(id_col).isNull()))
