"""Removal of repeated byte strings, whole corpus, by suffix arrays of shards.

A string of ``length`` bytes is repeated if it starts at more than one place.
Which ones are is found in four steps, none of which holds more than a bounded
piece of text:

1. Every window of ``length`` bytes chooses its anchor, the 48-byte gram of
   least hash (leftmost of equals). Equal windows choose equal anchors, so
   windows need comparing only where their anchors are equal. Neighbouring
   windows mostly share an anchor; such a run is one row, with a hash of the
   anchor and one of all bytes that the run's windows cover (its context).
2. Anchors that occur once are done. Equal contexts are collapsed to one with
   a count before anything is moved; windows of a context that occurs twice
   are repeated.
3. Of anchors with several different contexts, one copy of each context goes
   to the shard of its anchor. A shard is sorted by induced sorting
   (:mod:`.suffix_array`); a window is repeated if the permuted common prefix
   with a neighbour in the array covers it. An anchor with more than
   ``split_above`` contexts is not gathered: its windows are counted by hash,
   each on its own.
4. Spans of repeated windows go back to their rows and are cut out.
"""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streetloom.plans.shared import materialise, release

from .common import columns_of, held, small
from .suffix_array import permuted_lcp, suffix_array

LENGTH = 200
GRAM = 48
SPLIT_ABOVE = 8192
SHARD_BYTES = 1 << 19
_CHUNK = 1 << 18  # bytes hashed at once; position bits of the keys that windows are ranked by
_U = np.uint64


def _mixed(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> _U(32))) * _U(0x9FB21C651E98DF25)
    x = (x ^ (x >> _U(29))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


class _Rolling:
    """Polynomial hashes (mod 2**64, of mixed bytes) of any stretch of a buffer, from running sums."""

    BASE = 0x5851F42D4C957F2D

    def __init__(self, size: int) -> None:
        with np.errstate(over="ignore"):
            self.table = _mixed(np.arange(1, 257, dtype=_U) * _U(0x2545F4914F6CDD1D))
            self.power = np.cumprod(np.r_[_U(1), np.full(size, self.BASE, _U)])
            self.inverse = np.cumprod(np.r_[_U(1), np.full(size, pow(self.BASE, -1, 1 << 64), _U)])

    def sums(self, data: np.ndarray) -> np.ndarray:
        out = np.zeros(len(data) + 1, _U)
        np.cumsum(self.table[data] * self.power[: len(data)], out=out[1:])
        return out

    def hashes(self, sums: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return (sums[stop] - sums[start]) * self.inverse[start]

    def grams(self, sums: np.ndarray, size: int) -> np.ndarray:
        n = len(sums) - size
        return (sums[size:] - sums[:n]) * self.inverse[:n]


_ROLLING: list[_Rolling] = []


def _rolling() -> _Rolling:
    if not _ROLLING:
        _ROLLING.append(_Rolling(_CHUNK))
    return _ROLLING[0]


def _sliding_min(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, by doubling."""
    span = 1
    while 2 * span <= width:
        keys = np.minimum(keys[:-span], keys[span:])
        span *= 2
    rest = width - span
    return np.minimum(keys[:-rest], keys[rest:]) if rest else keys


def anchor_runs(data: np.ndarray, valid: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: first start, number of starts, anchor hash, context hash.

    ``valid`` marks the window starts that count, for instance those that do
    not cross from one text to the next; runs are cut where it is false.
    """
    roll, n = _rolling(), len(data) - length + 1
    sums = roll.sums(data)
    hashes = roll.grams(sums, gram)
    mask = _U(_CHUNK - 1)
    keys = (_mixed(hashes) & ~mask) | np.arange(len(hashes), dtype=_U)
    anchor = (_sliding_min(keys, length - gram + 1) & mask).astype(np.int64)
    anchor[~valid[:n]] = -1
    first = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
    count = np.diff(np.r_[first, n])
    keep = anchor[first] >= 0
    first, count = first[keep], count[keep]
    at = anchor[first]
    context = roll.hashes(sums, first, first + count - 1 + length)
    shape = (count * 1024 + at - first).astype(_U)
    return first, count, _mixed(hashes[at]), _mixed(context + _mixed(shape))


def _chunks(texts: Iterable[bytes], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Buffers of at most 256 KiB: bytes, valid starts, and for each byte its text and the position there.

    Texts are laid end to end; longer ones are cut with an overlap, so that
    each of their windows lies whole in exactly one buffer.
    """
    parts: list[tuple[int, int, bytes]] = []
    size = 0

    def flush():
        data = np.frombuffer(b"".join(p for _, _, p in parts), np.uint8)
        sizes = np.array([len(p) for _, _, p in parts])
        begin = np.cumsum(sizes) - sizes
        at = np.arange(len(data)) - np.repeat(begin, sizes)
        valid = np.repeat(sizes, sizes) - at >= length
        return data, valid, np.repeat([i for i, _, _ in parts], sizes), at + np.repeat([o for _, o, _ in parts], sizes)

    for i, text in enumerate(texts):
        for offset in range(0, max(1, len(text) - length + 1), _CHUNK - length + 1):
            part = text[offset : offset + _CHUNK]
            if len(part) < length:
                continue
            if size + len(part) > _CHUNK:
                yield flush()
                parts, size = [], 0
            parts.append((i, offset, part))
            size += len(part)
    if parts:
        yield flush()


def _utf8(text: pa.Scalar) -> bytes:
    return (text.as_py() or "").encode("utf-8", "surrogatepass")


def _runs(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """``id, tag, start, count, anchor, context`` of all runs of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("substrings")
        for b in batches:
            for data, valid, row, place in _chunks(map(_utf8, b.column(2)), length):
                first, count, anchor, context = anchor_runs(data, valid, length, gram)
                own = pa.array(row[first])
                yield pa.RecordBatch.from_arrays([
                    b.column(0).take(own), b.column(1).take(own), pa.array(place[first]), pa.array(count.astype(np.int32)),
                    pa.array(anchor.view(np.int64)), pa.array(context.view(np.int64)),
                ], ["id", "tag", "start", "count", "anchor", "context"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, tag long, start long, count int, anchor long, context long")


def repeated_starts(contexts: list[bytes], times: list[int], length: int) -> list[np.ndarray]:
    """For each context a mask of its windows that occur again in these contexts; ``times``: how often a context occurs."""
    size = np.array([len(c) for c in contexts])
    text = np.zeros(int(size.sum()) + len(size), np.uint16)  # 0 stands behind each context
    begin = np.cumsum(size + 1) - size - 1
    inside = np.ones(len(text), bool)
    inside[begin + size] = False
    text[inside] = np.frombuffer(b"".join(contexts), np.uint8).astype(np.uint16) + 1
    order = suffix_array(text, 257)
    common = permuted_lcp(text, order, length)
    room = np.repeat(begin + size, size + 1) - np.arange(len(text))
    # A window's equals are neighbours in the array, so looking at the one before and the one after is enough.
    hit = common >= length
    hit[order[:-1]] |= common[order[1:]] >= length
    hit &= room >= length
    return [hit[b : b + n - length + 1] | (t > 1) for b, n, t in zip(begin.tolist(), size.tolist(), times, strict=True)]


def _spans(mask: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.r_[False, mask, False].astype(np.int8)))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


_FOUND = "anchor long, context long, first int, stop int"


def _sort_shards(length: int, shard_bytes: int):
    """Takes ``anchor, context, times, bytes`` ordered by the first two; gives the spans of repeated starts.

    Equal rows may follow each other (they come from equal rows of the input) and count once.
    """

    def give(rows: list[tuple]) -> pa.RecordBatch:
        masks = repeated_starts([r[3] for r in rows], [r[2] for r in rows], length)
        out = [(r[0], r[1], a, b) for r, m in zip(rows, masks, strict=True) for a, b in _spans(m)]
        columns = list(zip(*out, strict=True)) or [[]] * 4
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["anchor", "context", "first", "stop"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("substrings")
        rows: list[tuple] = []
        size, last = 0, (None, None)
        for b in small(batches):
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if row[:2] == last:
                    continue
                if size >= shard_bytes and row[0] != last[0]:
                    yield give(rows)
                    rows, size = [], 0
                rows.append(row)
                size, last = size + len(row[3]), row[:2]
        if rows:
            yield give(rows)

    return run


def _count_windows(contexts: DataFrame, length: int) -> DataFrame:
    """The same for anchors with very many contexts: every window is a row of its own, counted by its hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for anchor, context, times, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                n = len(data) - length + 1
                keys = [xxhash.xxh3_128_digest(data[i : i + length]) for i in range(n)]
                yield pa.RecordBatch.from_arrays([
                    pa.array([anchor] * n, pa.int64()), pa.array([context] * n, pa.int64()), pa.array(range(n), pa.int32()),
                    pa.array([times] * n, pa.int64()), pa.array(keys, pa.binary()),
                ], ["anchor", "context", "first", "times", "key"])

    windows = contexts.mapInArrow(run, "anchor long, context long, first int, times long, key binary")
    often = windows.groupBy("key").agg(F.sum("times").alias("n")).where("n > 1")
    return windows.join(often.hint("rebalance"), "key").select("anchor", "context", "first", (F.col("first") + 1).alias("stop"))


def _tagged(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows as ``id, tag, text``: an id and a hash of the text name a row; rows that share both are equal."""
    columns_of(docs, id_col, text_col)
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("tag"), F.col(text_col).alias("text"))


def repeated_spans(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    length: int = LENGTH, gram: int = GRAM, split_above: int = SPLIT_ABOVE, shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """``id, tag, spans``: for each row with repeated strings the bytes to remove, as ``(start, stop)``.

    Spans may overlap and have no order. Rows are named by id and a hash of
    their text; equal rows are repeats of each other.
    """
    if not 0 < length - gram < 1024:
        raise ValueError("the gram must be shorter than the string, by less than 1024 bytes")
    rows = _tagged(docs, id_col, text_col)
    runs = materialise(_runs(rows, length, gram))
    again = runs.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor")
    shared = materialise(runs.join(again.hint("rebalance"), "anchor"))
    release(runs)

    one = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "tag", "start", "count")).alias("one")
    kinds = materialise(shared.groupBy("anchor", "context").agg(F.count("*").alias("times"), one))
    mixed = kinds.groupBy("anchor").agg(F.count("*").alias("kinds"), F.min("times").alias("least")).where("kinds > 1 and least = 1")
    wanted = kinds.join(mixed.hint("rebalance"), "anchor").select("one.*", "anchor", "context", "times", "kinds")
    asked = wanted.groupBy("id", "tag").agg(F.collect_list(F.struct("start", "count", "anchor", "context", "times", "kinds")).alias("asked"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            for text, rows in zip(b.column(0), b.column(1), strict=True):
                data, rows = _utf8(text), rows.as_py()
                yield pa.RecordBatch.from_arrays([
                    *(pa.array([r[c] for r in rows], pa.int64()) for c in ("anchor", "context", "times", "kinds")),
                    pa.array([data[r["start"] : r["start"] + r["count"] - 1 + length] for r in rows], pa.binary()),
                ], ["anchor", "context", "times", "kinds", "bytes"])

    met = rows.join(asked, (rows["id"].eqNullSafe(asked["id"])) & (rows["tag"] == asked["tag"])).select("text", "asked")
    contexts = materialise(met.mapInArrow(cut, "anchor long, context long, times long, kinds long, bytes binary"))
    few = contexts.where(F.col("kinds") <= split_above).drop("kinds").repartition("anchor").sortWithinPartitions("anchor", "context")
    sorted_out = few.mapInArrow(_sort_shards(length, shard_bytes), _FOUND)
    counted = _count_windows(contexts.where(F.col("kinds") > split_above).drop("kinds").dropDuplicates(["anchor", "context"]), length)
    whole = kinds.where("times > 1").select("anchor", "context", F.lit(0).alias("first"), F.col("one.count").alias("stop"))
    found = sorted_out.unionByName(counted).unionByName(whole)
    found = materialise(found.groupBy("anchor", "context").agg(F.collect_set(F.struct("first", "stop")).alias("starts")))

    placed = shared.join(found, ["anchor", "context"]).select("id", "tag", "start", F.explode("starts").alias("s"))
    span = F.struct((F.col("start") + F.col("s.first")).alias("start"), (F.col("start") + F.col("s.stop") - 1 + length).alias("stop"))
    spans = materialise(placed.select("id", "tag", span.alias("span")).groupBy("id", "tag").agg(F.collect_set("span").alias("spans")))
    for done in (shared, kinds, contexts, found):
        release(done)
    gc.collect()
    return spans


def cut_out(data: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, list[tuple[int, int]]]:
    """The bytes outside ``spans``, and the spans as maximal disjoint runs in order."""
    runs: list[list[int]] = []
    for start, stop in sorted(spans):
        if runs and start <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], stop)
        else:
            runs.append([start, stop])
    edges = [0, *(x for r in runs for x in r), len(data)]
    return b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)), [tuple(r) for r in runs]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kept_text: bool = True, **options) -> DataFrame:
    """Every row of ``docs`` without the bytes of repeated strings.

    Removes each byte covered by a string of ``length`` (200) bytes that also
    starts elsewhere, in any row or in the same one; strings are judged on the
    input. Returns the columns of ``docs`` but ``text_col``, and ``n_bytes,
    n_removed, n_spans, removed array<struct<start,stop>>`` (bytes),
    ``kept_sha256``; with ``kept_text`` also ``text_col`` with what is left (of
    a character cut in two the rest is dropped). Columns of ``docs`` with a
    name that is added here are replaced.

    Null texts count as empty and stay null. Texts under ``length`` bytes stay
    as they are. Repeated rows repeat each other and lose all from ``length``
    bytes on. Null ids are rows like others.
    """
    spans = repeated_spans(docs, id_col, text_col, **options).withColumnsRenamed({"id": "__id", "tag": "__tag"})
    added = ["n_bytes", "n_removed", "n_spans", "removed", "kept_sha256"]
    kept = [c for c in docs.columns if c not in added and (kept_text or c != text_col)]
    types = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = ", ".join(f"`{c}` {types[c]}" for c in kept) + ", n_bytes long, n_removed long, n_spans long, removed array<struct<start:long,stop:long>>, kept_sha256 string"
    shape = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("substrings")
        for b in small(batches):
            texts, sizes, cuts, digests = [], [], [], []
            for text, found in zip(b.column(0), b.column(1), strict=True):
                data = _utf8(text)
                rest, runs = cut_out(data, [(s["start"], s["stop"]) for s in found.as_py() or ()])
                sizes.append(len(data))
                cuts.append([{"start": s, "stop": e} for s, e in runs])
                digests.append(hashlib.sha256(rest).hexdigest())
                texts.append(rest.decode("utf-8", "ignore") if text.is_valid else None)
            removed = [sum(r["stop"] - r["start"] for r in c) for c in cuts]
            new = [pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array([len(c) for c in cuts], pa.int64()), pa.array(cuts, shape), pa.array(digests, pa.string())]
            row = b.column(2)
            old = {row.type.field(k).name: row.field(k) for k in range(row.type.num_fields)}
            yield pa.RecordBatch.from_arrays([*(pa.array(texts, pa.string()) if c == text_col else old[c] for c in kept), *new], [*kept, *added])

    # All other columns travel in one struct, so that none of their names can meet those used here.
    text, row = F.col(f"`{text_col}`"), F.struct(*(F.col(f"`{c}`") for c in kept if c != text_col))
    left = docs.select(text.alias("text"), F.col(f"`{id_col}`").alias("own"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("own_tag"), row.alias("row"))
    joined = left.join(spans, left["own"].eqNullSafe(spans["__id"]) & (left["own_tag"] == spans["__tag"]), "left")
    return joined.select(left["text"], spans["spans"], left["row"]).mapInArrow(run, schema)
