"""Byte-level BPE by a lazily determinised transducer, and its streaming inverse.

A sequence of tokens is the BPE encoding of its bytes exactly if no merge would
ever cross the boundary of two neighbours. So every prefix of a text has one
encoding, which the transducer extends byte by byte. One of its states is a set
of open tokens: the trie node of the bytes read since a possible token start,
and the token before that start. A byte moves all open tokens down the trie;
the only one that completes a vocabulary entry which may follow its
predecessor is the last token of the new prefix. Sets are numbered and their
transitions stored when first met, so a seen transition is one table lookup.
A token is emitted as soon as all open tokens agree on what lies before them,
which takes at most the longest token of lookahead.

Texts have most of their pre-tokens in common, but the rare ones of many texts
are many. These are run together: sorted, they form a trie, and the states of
all its prefixes are determined level by level with arrays, each prefix once.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import columns_of, held, small

MAX_STATES = 100_000
MAX_PIECES = 150_000
MAX_PAIRS = 300_000
_FLUSH = 4096
_SHORT = 64  # bytes of a pre-token that is kept, and run together with others
_CROWD = 1 << 15  # pre-tokens run together at once, which bounds the arrays
_SLOTS = 19  # bits of the number of pairs of tokens that the arrays remember
_ENDLESS = 1 << 60
_BITS = 24  # room for a token id; an open token is its node above its predecessor's id plus one
_LOW = (1 << _BITS) - 1


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks of a ``.tiktoken`` file: a base64 token and its rank on each line."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines()) if token}


class Vocabulary:
    """Token bytes, merge trees and the trie of the tokens that merges can make."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.bytes = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.bytes[rank] = token
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._follows: dict[int, bool] = {}
        self.kids: list[dict[int, int]] = [{}]
        self.token: list[int] = [-1]
        self.depth: list[int] = [0]
        for token, rank in ranks.items():
            if len(token) == 1 or self.halves(rank):
                self._plant(token, rank)

    def _plant(self, token: bytes, rank: int) -> None:
        node = 0
        for byte in token:
            below = self.kids[node].get(byte)
            if below is None:
                below = self.kids[node][byte] = len(self.kids)
                self.kids.append({})
                self.token.append(-1)
                self.depth.append(self.depth[node] + 1)
            node = below
        self.token[node] = rank

    def halves(self, rank: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for a byte, or if merges never make it."""
        if rank not in self._halves:
            parts = [self.bytes[rank][i : i + 1] for i in range(len(self.bytes[rank]))]
            while len(parts) > 2:
                best, at = min((self.ranks.get(parts[i] + parts[i + 1], _ENDLESS), i) for i in range(len(parts) - 1))
                if best >= rank:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            self._halves[rank] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
        return self._halves[rank]

    def follows(self, left: int, right: int) -> bool:
        """Whether the boundary between two tokens outlives all merges.

        Runs time backwards: while the two sides are taken apart, latest merge
        first, no pair that met at the boundary may have had a merge that came
        before the one which absorbed either of the two. Of equal merges the
        leftmost comes first.
        """
        known = self._follows.get(left << _BITS | right)
        if known is not None:
            return known
        a, b, a_gone, b_gone, good = left, right, _ENDLESS, _ENDLESS, True
        while True:
            merge = self.ranks.get(self.bytes[a] + self.bytes[b])
            if merge is not None and merge < a_gone and merge <= b_gone:
                good = False
                break
            a_parts, b_parts = self.halves(a), self.halves(b)
            if a_parts and (not b_parts or a > b):
                a, a_gone = a_parts[1], a
            elif b_parts:
                b, b_gone = b_parts[0], b
            else:
                break
        if len(self._follows) >= MAX_PAIRS:
            self._follows.clear()
        self._follows[left << _BITS | right] = good
        return good


class Transducer:
    """Maps the bytes of one pre-token to its tokens."""

    def __init__(self, vocabulary: Vocabulary, max_states: int = MAX_STATES) -> None:
        self.words, self.max_states = vocabulary, max_states
        self._reset()

    def _reset(self) -> None:
        self._number: dict[tuple[int, ...], int] = {}
        self._open: list[tuple[int, ...]] = []
        self._next: list[dict[int, tuple[int, int]]] = []
        self._state((0,))

    def _state(self, key: tuple[int, ...]) -> int:
        found = self._number.get(key)
        if found is None:
            found = self._number[key] = len(self._open)
            self._open.append(key)
            self._next.append({})
        return found

    def _determinise(self, state: int, byte: int) -> tuple[int, int]:
        """The state after ``byte`` and the last token of the prefix that it ends."""
        kids, tokens, known, follows = self.words.kids, self.words.token, self.words._follows, self.words.follows
        last, still = -1, []
        for one in self._open[state]:
            below = kids[one >> _BITS].get(byte)
            if below is None:
                continue
            before, token = one & _LOW, tokens[below]
            if last < 0 <= token:
                good = True if not before else known.get((before - 1) << _BITS | token)
                if follows(before - 1, token) if good is None else good:
                    last = token
            if kids[below]:
                still.append(below << _BITS | before)
        if last < 0:
            raise ValueError(f"the vocabulary lacks byte {byte}")
        still.append(last + 1)  # a token may begin here: the root, behind the last token
        step = self._state(tuple(still)), last
        self._next[state][byte] = step
        return step

    def _finish(self, state: int, byte: int) -> int:
        """The last token only, for the end of a piece, where no state is needed."""
        step = self._next[state].get(byte)
        if step is not None:
            return step[1]
        kids, tokens, known, follows = self.words.kids, self.words.token, self.words._follows, self.words.follows
        for one in self._open[state]:
            below = kids[one >> _BITS].get(byte)
            if below is not None and (token := tokens[below]) >= 0:
                before = one & _LOW
                good = True if not before else known.get((before - 1) << _BITS | token)
                if follows(before - 1, token) if good is None else good:
                    return token
        raise ValueError(f"the vocabulary lacks byte {byte}")

    def _settled(self, state: int, last: list[int]) -> int:
        """The longest prefix on whose tokens all open tokens agree."""
        size, here = self.words.bytes, len(last) - 1
        starts = sorted(here - self.words.depth[one >> _BITS] for one in self._open[state])
        path, at = {0}, starts[0]
        while at:
            path.add(at)
            at -= len(size[last[at]])
        agreed = starts[0]
        for at in starts[1:]:
            while at not in path:
                at -= len(size[last[at]])
            agreed = min(agreed, at)
        return agreed

    def _back(self, last: list[int], upto: int) -> list[int]:
        size, out = self.words.bytes, []
        while upto:
            out.append(last[upto])
            upto -= len(size[last[upto]])
        return out[::-1]

    def encode(self, piece: bytes) -> list[int]:
        out: list[int] = []
        if not piece:
            return out
        last, state, table = [-1], 0, self._next
        for byte in piece[:-1]:
            step = table[state].get(byte)
            if step is None:
                step = self._determinise(state, byte)
            state, token = step
            last.append(token)
            if len(last) > _FLUSH:
                done = self._settled(state, last)
                out += self._back(last, done)
                last = [-1, *last[done + 1 :]]
        last.append(self._finish(state, piece[-1]))
        out += self._back(last, len(last) - 1)
        if len(self._open) > self.max_states:
            self._reset()
        return out


class Together:
    """Maps the bytes of many short pre-tokens to their tokens: the transducer by arrays."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        words, ranks = vocabulary, vocabulary.ranks
        self.token = np.array(words.token, np.int32)
        self.inner = np.array([bool(k) for k in words.kids])
        self.size = np.array([len(b) for b in words.bytes], np.int32)
        halves = [words.halves(r) if words.bytes[r] else None for r in range(len(words.bytes))]
        self.left, self.right = (np.array([h[i] if h else -1 for h in halves], np.int64) for i in (0, 1))
        edges = np.array([(node << 8 | byte, below) for node, kids in enumerate(words.kids) for byte, below in kids.items()], np.int64).reshape(-1, 2)
        edges = edges[np.argsort(edges[:, 0])]
        # Of each node and quarter of the bytes: a bit for each byte that leads on, and the number of edges before.
        quarter = edges[:, 0] >> 6
        self.bits = np.zeros(4 * len(words.kids), np.uint64)
        np.bitwise_or.at(self.bits, quarter, np.uint64(1) << (edges[:, 0] & 63).astype(np.uint64))
        self.first = np.searchsorted(quarter, np.arange(4 * len(words.kids))).astype(np.int32)
        self.below = np.append(edges[:, 1], -1).astype(np.int32)
        # All pairs of tokens that a merge joins, sorted, and its rank.
        pairs = [(ranks[a] << _BITS | ranks[b], rank) for t, rank in ranks.items() for i in range(1, len(t)) if (a := t[:i]) in ranks and (b := t[i:]) in ranks]
        made = np.array(sorted(pairs), np.int64).reshape(-1, 2)
        self.pairs, self.merged = np.append(made[:, 0], _ENDLESS), np.append(made[:, 1], _ENDLESS)
        self.seen = np.full(1 << _SLOTS, -1, np.int64)  # the last pair of each slot, and whether it may meet
        self.meets = np.zeros(1 << _SLOTS, bool)

    def _down(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The trie node below each node; -1 if there is none."""
        at = node << 2 | byte >> 6
        bits, bit = self.bits[at], np.uint64(1) << (byte & 63).astype(np.uint64)
        edge = self.first[at] + np.bitwise_count(bits & (bit - np.uint64(1)))
        return self.below[np.where((bits & bit) != 0, edge, -1)]

    def _meet(self, pairs: np.ndarray) -> np.ndarray:
        """``Vocabulary.follows`` of pairs of tokens, by way of those met before."""
        slot = (pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - _SLOTS)).astype(np.int64)
        out, new = self.meets[slot], np.flatnonzero(self.seen[slot] != pairs)
        if new.size:
            fresh, back = np.unique(pairs[new], return_inverse=True)
            good = self._outlives(fresh >> _BITS, fresh & _LOW)
            out[new] = good[back]
            # Two fresh pairs may share a slot: the one that is written stands for both arrays.
            self.seen[slot[new]] = np.arange(new.size)
            won = self.seen[slot[new]]
            self.seen[slot[new]], self.meets[slot[new]] = pairs[new[won]], out[new[won]]
        return out

    def _outlives(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``Vocabulary.follows``, for all pairs at once."""
        good, at = np.ones(len(a), bool), np.arange(len(a))
        a_gone, b_gone = np.full(len(a), _ENDLESS), np.full(len(a), _ENDLESS)
        while at.size:
            pair = a << _BITS | b
            known = np.searchsorted(self.pairs, pair)
            merge = np.where(self.pairs[known] == pair, self.merged[known], _ENDLESS)
            bad = (merge < a_gone) & (merge <= b_gone)
            good[at[bad]] = False
            a_made, b_made = self.right[a] >= 0, self.left[b] >= 0
            take_a = a_made & (~b_made | (a > b))
            take_b = b_made & ~take_a
            a, a_gone = np.where(take_a, self.right[a], a), np.where(take_a, a, a_gone)
            b, b_gone = np.where(take_b, self.left[b], b), np.where(take_b, b, b_gone)
            on = (take_a | take_b) & ~bad
            at, a, b, a_gone, b_gone = at[on], a[on], b[on], a_gone[on], b_gone[on]
        return good

    def encode(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """Tokens of each piece; pieces are distinct, sorted and not empty."""
        n, size = len(pieces), np.fromiter(map(len, pieces), np.int64, len(pieces))
        width = int(size.max(initial=0))
        if not n:
            return []
        text = np.array(pieces, f"S{width}").view(np.uint8).reshape(n, width).astype(np.int32)
        differs = text[1:] != text[:-1]
        shared = np.where(differs.any(1), differs.argmax(1), width)
        shared = np.append(0, np.minimum(shared, np.minimum(size[1:], size[:-1])))
        last = np.zeros((n, width), np.int32)
        # Open tokens of the prefixes of one level: their trie nodes and predecessors plus one, prefix by prefix.
        node, before = np.zeros(1, np.int32), np.zeros(1, np.int32)
        count, start, owner = np.ones(1, np.int64), np.zeros(1, np.int64), np.zeros(n, np.int64)
        for level in range(width):
            longer = size > level
            new = longer & (shared <= level)
            row = np.flatnonzero(new)
            parent = owner[row]
            owner = np.cumsum(new) - 1  # holds for the longer pieces; those of one prefix stand together
            many = count[parent]
            who = np.repeat(np.arange(row.size), many)
            one = np.arange(who.size) + (start[parent] - np.cumsum(many) + many)[who]
            below = self._down(node[one], text[row, level][who])
            on = np.flatnonzero(below >= 0)
            who, below, prior = who[on], below[on], before[one[on]]
            token = self.token[below]
            ends = np.flatnonzero(token >= 0)
            good = prior[ends] == 0
            ask = np.flatnonzero(~good)
            good[ask] = self._meet((prior[ends[ask]].astype(np.int64) - 1) << _BITS | token[ends[ask]])
            ends = ends[good][::-1]
            done = np.full(row.size, -1, np.int32)
            done[who[ends]] = token[ends]  # of one prefix the first stands
            if row.size and done.min() < 0:
                raise ValueError(f"the vocabulary lacks byte {text[row[done.argmin()], level]}")
            last[longer, level] = done[owner[longer]]
            still = np.flatnonzero(self.inner[below])
            count = np.bincount(who[still], minlength=row.size) + 1
            stop = np.cumsum(count)
            start = stop - count
            node, before = np.zeros(int(count.sum()), np.int32), np.empty(int(count.sum()), np.int32)
            to = np.arange(still.size) + who[still]
            node[to], before[to] = below[still], prior[still]
            before[stop - 1] = done + 1  # a token may begin here: the root, behind the last token
        return self._back(last, size)

    def _back(self, last: np.ndarray, size: np.ndarray) -> list[tuple[int, ...]]:
        row, upto, rounds = np.arange(len(size)), size, []
        while row.size:
            token = last[row, upto - 1]
            rounds.append((row, token))
            upto = upto - self.size[token]
            row, upto = row[upto > 0], upto[upto > 0]
        many = np.bincount(np.concatenate([r for r, _ in rounds]), minlength=len(size))
        stop = np.cumsum(many)
        flat = np.empty(int(stop[-1]), np.int32)
        for k, (row, token) in enumerate(rounds):
            flat[stop[row] - 1 - k] = token
        ids = flat.tolist()
        return [tuple(ids[a:b]) for a, b in zip((stop - many).tolist(), stop.tolist(), strict=True)]


# What the classes L, N and White_Space of Unicode hold below U+0100.
_L = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
_N = "0-9\xb2\xb3\xb9\xbc-\xbe"
_S = "\t-\r \x85\xa0"


def latin_pattern(pattern: str) -> re.Pattern:
    """``pattern`` for texts below U+0100, where the standard library's faster engine can be used."""
    groups = {r"[^\s\p{L}\p{N}]": f"[^{_S}{_L}{_N}]", r"\p{L}": f"[{_L}]", r"\p{N}": f"[{_N}]", r"\s": f"[{_S}]", r"\S": f"[^{_S}]"}
    for name, body in groups.items():
        pattern = pattern.replace(name, body)
    return re.compile(pattern)


class _Pieces(dict):
    """Tokens of each pre-token met so far; emptied when full."""

    def __init__(self, vocabulary: Vocabulary, limit: int) -> None:
        self.ranks, self.limit, self.run, self.run_all = vocabulary.ranks, limit, Transducer(vocabulary).encode, Together(vocabulary).encode

    def learn(self, pieces: set[str]) -> None:
        """Runs those together that are short and not known yet; ``pieces`` are ``limit`` at most."""
        new = pieces.difference(self)
        if len(self) + len(new) > self.limit:
            self.clear()
            new = pieces
        open_ = {}
        for piece in new:
            data = piece.encode("utf-8", "surrogatepass")
            whole = self.ranks.get(data)
            if whole is not None:
                self[piece] = (whole,)
            elif len(data) <= _SHORT:
                open_[data] = piece
        order = sorted(open_)
        for at in range(0, len(order), _CROWD):
            part = order[at : at + _CROWD]
            self.update(zip(map(open_.__getitem__, part), self.run_all(part), strict=True))

    def __missing__(self, piece: str) -> tuple[int, ...]:
        data = piece.encode("utf-8", "surrogatepass")
        whole = self.ranks.get(data)
        found = (whole,) if whole is not None else tuple(self.run(data))
        if len(data) <= _SHORT:
            if len(self) >= self.limit:
                self.clear()
            self[piece] = found
        return found


class Encoder:
    """Text to ids: each match of ``pattern`` separately, no special tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, max_pieces: int = MAX_PIECES) -> None:
        self.words = Vocabulary(ranks)
        self._any, self._latin = regex.compile(pattern), latin_pattern(pattern)
        self._pieces = _Pieces(self.words, max_pieces)

    def _split(self, text: str | None) -> list[str]:
        if not text:
            return []
        try:
            text.encode("latin-1")
            return self._latin.findall(text)
        except UnicodeEncodeError:
            return self._any.findall(text)

    def _ids(self, found: list[str]) -> list[int]:
        return list(chain.from_iterable(map(self._pieces.__getitem__, found)))

    def encode(self, text: str | None) -> list[int]:
        return self._ids(self._split(text))

    def encode_all(self, texts: Iterable[str | None]) -> Iterator[list[int]]:
        """Ids of each text; pre-tokens of many texts, or of a part of a long one, are run together."""
        waiting: list[list[str]] = []
        count, most = 0, max(1, self._pieces.limit)
        for text in texts:
            found = self._split(text)
            if count + len(found) > most:
                yield from self._together(waiting)
                waiting, count = [], 0
            if len(found) > most:
                yield list(chain.from_iterable(chain.from_iterable(self._together([found[at : at + most]])) for at in range(0, len(found), most)))
            else:
                waiting.append(found)
                count += len(found)
        yield from self._together(waiting)

    def _together(self, several: list[list[str]]) -> Iterator[list[int]]:
        self._pieces.learn(set().union(*several))
        return map(self._ids, several)


class Decoder:
    """Ids to bytes, or to text piece by piece."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self._bytes = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self._bytes[rank] = token

    def to_bytes(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self._bytes.__getitem__, ids))

    def stream(self, ids: Iterable[int], size: int = 1024) -> Iterator[str]:
        """Text of ``size`` ids at a time; characters cut by a boundary wait for the next piece."""
        utf8, run = Utf8(), []
        for i in ids:
            run.append(i)
            if len(run) == size:
                yield utf8.feed(self.to_bytes(run))
                run = []
        yield utf8.feed(self.to_bytes(run)) + utf8.end()


class Utf8:
    """Incremental UTF-8 decoder; each maximal ill-formed part becomes U+FFFD.

    The state is the bytes of the character begun so far (three at most). Which
    bytes may follow depends on the first byte alone, and for the second byte
    on its range.
    """

    #: Fixed values of the encoding: first byte -> (length, least and greatest second byte).
    FIRST = (
        {b: (2, 0x80, 0xBF) for b in range(0xC2, 0xE0)}
        | {0xE0: (3, 0xA0, 0xBF)} | {b: (3, 0x80, 0xBF) for b in range(0xE1, 0xF0)} | {0xED: (3, 0x80, 0x9F)}
        | {0xF0: (4, 0x90, 0xBF)} | {b: (4, 0x80, 0xBF) for b in range(0xF1, 0xF4)} | {0xF4: (4, 0x80, 0x8F)}
    )

    def __init__(self) -> None:
        self.begun = b""

    def _open_tail(self, data: bytes) -> int:
        """How many bytes at the end begin a character that more bytes could complete."""
        for back in range(1, min(3, len(data)) + 1):
            lead = data[-back]
            if lead in self.FIRST:
                length, low, high = self.FIRST[lead]
                rest = data[len(data) - back + 1 :]
                fits = back < length and (not rest or low <= rest[0] <= high) and all(0x80 <= b <= 0xBF for b in rest)
                return back if fits else 0
            if not 0x80 <= lead <= 0xBF:
                return 0
        return 0

    def feed(self, data: bytes) -> str:
        data = self.begun + data
        cut = len(data) - self._open_tail(data)
        self.begun = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def end(self) -> str:
        left, self.begun = self.begun, b""
        return "�" if left else ""


def _once(kind: type, *key):
    """One encoder or decoder of each vocabulary in a worker process, whatever the number of tasks."""
    name = (kind, *(hashlib.sha256(k).digest() if isinstance(k, bytes) else k for k in key))
    kept = held("bpe")
    if name not in kept:
        kept[name] = kind(read_ranks(key[0]), *key[1:])
    return kept[name]


def _file(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """``docs`` with the ids of ``text_col`` as ``out_col array<int>``.

    Null and empty texts give an empty array. ``out_col`` replaces a column of
    that name. The rank file is read on the driver and broadcast (its size is
    that of the vocabulary, which no input makes larger).
    """
    columns_of(docs, text_col)
    ranks = docs.sparkSession.sparkContext.broadcast(_file(ranks_path))
    kept = [c for c in docs.columns if c != out_col]
    at = kept.index(text_col)
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept) + f", `{out_col}` array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            own = _once(Encoder, ranks.value, pattern)
            ids = pa.array(own.encode_all(t.as_py() for t in b.column(at)), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*b.columns, ids], [*kept, out_col])

    return docs.select(*kept).mapInArrow(run, schema)


def decode(df: DataFrame, ranks_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``df`` with the text of ``ids_col`` as ``out_col string``; null or empty ids give an empty string."""
    columns_of(df, ids_col)
    ranks = df.sparkSession.sparkContext.broadcast(_file(ranks_path))
    kept = [c for c in df.columns if c != out_col]
    at = kept.index(ids_col)
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept) + f", `{out_col}` string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            own = _once(Decoder, ranks.value)
            text = pa.array(("".join(own.stream(i.as_py() or ())) for i in b.column(at)), pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, text], [*kept, out_col])

    return df.select(*kept).mapInArrow(run, schema)


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes every text, decodes its ids, and returns digests of both.

    ``id_col, n_tokens, ids_sha256`` (of the decimal ids joined by commas),
    ``decoded_sha256`` (of the decoded bytes). Null texts count as empty.
    """
    columns_of(docs, id_col, text_col)
    ranks = docs.sparkSession.sparkContext.broadcast(_file(ranks_path))
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            there, back = _once(Encoder, ranks.value, pattern), _once(Decoder, ranks.value)
            decimal = _once(_Decimal, ranks.value).of
            count, ids_sha, text_sha = [], [], []
            for ids in there.encode_all(t.as_py() for t in b.column(1)):
                count.append(len(ids))
                ids_sha.append(hashlib.sha256(",".join(map(decimal, ids)).encode()).hexdigest())
                text_sha.append(hashlib.sha256(back.to_bytes(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(count, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(id_col, text_col).mapInArrow(run, schema)


class _Decimal:
    """Decimal strings of all ids."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.of = list(map(str, range(max(ranks.values(), default=-1) + 1))).__getitem__
