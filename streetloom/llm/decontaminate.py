"""Benchmark items in documents, up to a bounded edit distance.

An item that may have ``k`` edits is cut into ``k + 1`` pieces; wherever it
occurs within ``k`` edits, at least one piece occurs unchanged. All pieces are
looked for at once by an Aho-Corasick automaton, and around every hit the item
is verified by Myers' bit-parallel dynamic programming. Letters are compared in
lower case.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import columns_of, held, small

ERROR_RATE = 0.05
#: Characters of items searched in one pass over the documents; more items take more passes.
BLOCK_CHARS = 1_000_000


def fold(text: str | None) -> str:
    """Lower case, character by character, so that offsets stay."""
    low = (text or "").replace("\u03a3", "\u03c3").lower()  # lower() alone folds a capital sigma by what follows it
    return low if len(low) == len(text or "") else "".join(c if len(c.lower()) != 1 else c.lower() for c in text)


def budget(item: str, rate: float = ERROR_RATE) -> int:
    return int(len(item) * rate)


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """``errors + 1`` pieces of nearly equal length, with their offsets."""
    n = errors + 1
    cuts = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def myers(pattern: str, text: str, errors: int) -> tuple[int, int] | None:
    """Least distance of ``pattern`` to a substring of ``text``, and where the first such ends; None above ``errors``.

    Column ``j`` of the edit matrix is held as the positions at which it rises
    and falls by one; one step of word arithmetic gives the next column.
    """
    m = len(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    where: dict[str, int] = {}
    for i, c in enumerate(pattern):
        where[c] = where.get(c, 0) | 1 << i
    rise, fall, distance = full, 0, m
    best: tuple[int, int] | None = None
    for j, c in enumerate(text):
        match = where.get(c, 0)
        diagonal = (((match & rise) + rise) ^ rise) | match | fall
        right_up = fall | (full & ~(diagonal | rise))
        right_down = rise & diagonal
        if right_up & top:
            distance += 1
        elif right_down & top:
            distance -= 1
        right_up = (right_up << 1) & full  # a match may begin anywhere: row zero stays zero
        right_down = (right_down << 1) & full
        rise = right_down | (full & ~((match | fall) | right_up))
        fall = right_up & (match | fall)
        if distance <= errors and (best is None or distance < best[0]):
            best = distance, j + 1
    return best


class Matcher:
    """Finds the items of one block in texts."""

    def __init__(self, items: list[tuple[int, str]], rate: float = ERROR_RATE) -> None:
        self.items = [(i, fold(t)) for i, t in items]
        self.errors = [budget(t, rate) for _, t in self.items]
        found: dict[str, list[tuple[int, int]]] = {}
        for n, ((_, item), errors) in enumerate(zip(self.items, self.errors, strict=True)):
            for offset, piece in pieces(item, errors) if item else ():
                found.setdefault(piece, []).append((n, offset))
        self.machine = ahocorasick.Automaton()
        for piece, places in found.items():
            self.machine.add_word(piece, (len(piece), places))
        self.empty = not found
        if found:
            self.machine.make_automaton()

    def find(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """``(item, start, stop, distance)`` of the best occurrence (then the first) of each item found, by item."""
        if not text or self.empty:
            return []
        low = fold(text)
        best: dict[int, tuple[int, int, int]] = {}
        tried: dict[int, tuple[int, int]] = {}  # of each item the stretch of starts last searched
        for end, (size, places) in self.machine.iter(low):
            for n, offset in places:
                start = end + 1 - size - offset
                item, k = self.items[n][1], self.errors[n]
                if n in best and best[n][0] == 0:
                    continue
                if low.startswith(item, max(0, start)) and start >= 0:
                    best[n] = (0, start, start + len(item))
                    continue
                if n in tried and tried[n][0] <= start <= tried[n][1]:
                    continue
                tried[n] = (start, start)
                at = max(0, start - k)
                hit = myers(item, low[at : start + len(item) + k], k)
                if hit and (n not in best or hit[0] < best[n][0]):
                    stop = at + hit[1]
                    back = myers(item[::-1], low[max(0, stop - len(item) - k) : stop][::-1], hit[0])
                    best[n] = (hit[0], stop - (back[1] if back else len(item)), stop)
        return sorted((self.items[n][0], s, e, d) for n, (d, s, e) in best.items())


def item_blocks(benchmark: DataFrame, item_col: str, text_col: str, block_chars: int) -> Iterator[tuple[tuple[int, str], ...]]:
    """The items in blocks of bounded size, read one partition at a time.

    Equal texts are searched once for each id. Null ids, null and empty texts are left out.
    """
    rows = benchmark.select(item_col, text_col).where(F.col(item_col).isNotNull() & (F.length(text_col) > 0)).distinct()
    block: list[tuple[int, str]] = []
    size = 0
    for row in rows.toLocalIterator():
        if block and size + len(row[1]) > block_chars:
            yield tuple(sorted(block))
            block, size = [], 0
        block.append((row[0], row[1]))
        size += len(row[1])
    if block:
        yield tuple(sorted(block))


def _matcher(block: tuple, rate: float) -> Matcher:
    """The automaton of a block, made once in each worker process; two are kept at most."""
    kept, key = held("decontaminate"), (rate, block)
    if key not in kept:
        while len(kept) > 1:
            del kept[next(iter(kept))]
        kept[key] = Matcher(list(block), rate)
    return kept[key]


def find_items(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    rate: float = ERROR_RATE, block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """``id_col, item_col, start, stop, distance``: each item that occurs in each document, at its best place.

    An item of ``n`` characters occurs where a stretch of the document is
    within ``int(rate * n)`` edits of it (in lower case). Offsets are code
    points. Null and empty documents hold nothing; items that are null or
    empty, or have a null id, are never found. Repeated rows come back as often
    as they hold an item. Every block of items is one pass over the documents.
    """
    columns_of(docs, id_col, text_col)
    columns_of(benchmark, item_col, item_text_col)
    kinds = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    schema = f"`{id_col}` {kinds[0]}, `{item_col}` {kinds[1]}, start long, stop long, distance long"
    out = docs.sparkSession.createDataFrame([], schema)
    for block in item_blocks(benchmark, item_col, item_text_col, block_chars):
        out = out.unionByName(docs.select(id_col, text_col).mapInArrow(_finding(docs.sparkSession.sparkContext.broadcast(block), rate, [id_col, item_col], benchmark), schema))
    return out


def _finding(shared, rate: float, names: list[str], benchmark: DataFrame):
    kind = to_arrow_type(benchmark.schema[names[1]].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            own = _matcher(shared.value, rate)
            hits = [(row, *hit) for row, text in enumerate(b.column(1)) for hit in own.find(text.as_py())]
            row, item, start, stop, distance = zip(*hits, strict=True) if hits else ([],) * 5
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), pa.array(item, kind), *(pa.array(x, pa.int64()) for x in (start, stop, distance))], [*names, "start", "stop", "distance"])

    return run


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    rate: float = ERROR_RATE, block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, all columns kept; no shuffle."""
    columns_of(docs, text_col)
    at, schema = docs.columns.index(text_col), docs.schema
    for block in item_blocks(benchmark, item_col, item_text_col, block_chars):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in small(batches):
                own = _matcher(shared.value, rate)
                yield b.filter(pa.array([not own.find(t.as_py()) for t in b.column(at)], pa.bool_()))

        docs = docs.mapInArrow(run, schema)
    return docs
