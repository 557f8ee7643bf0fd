"""Suffix arrays by induced sorting, and permuted common prefixes.

The alphabet of a text is small, so its buckets are scanned with array
operations: all entries of a bucket that are known at some moment induce their
predecessors together, in scan order, until the bucket stops growing. That does
the same linear work as the scan by single entries. The reduced text of a
recursion has a large alphabet and is scanned entry by entry.
"""

from __future__ import annotations

import numpy as np

_SMALL = 1024  # alphabets up to this size are scanned by buckets


def classify(s: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one (S-type). The text's end counts as smallest."""
    n = len(s)
    rises = np.zeros(n, np.int8)
    rises[:-1] = np.sign(s[1:].astype(np.int64) - s[:-1])
    rises[-1] = -1
    # Equal neighbours take the type of the first difference to the right.
    where = np.where(rises != 0, np.arange(n), n)
    return rises[np.minimum.accumulate(where[::-1])[::-1]] > 0


def _leftmost(s_type: np.ndarray) -> np.ndarray:
    """Positions of S-type suffixes right of an L-type one."""
    return np.flatnonzero(s_type[1:] & ~s_type[:-1]) + 1


def _spread(chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Stable order by character; the characters present, their counts, and each entry's rank among its equals."""
    order = np.argsort(chars, kind="stable")
    sorted_chars = chars[order]
    first = np.flatnonzero(np.r_[True, sorted_chars[1:] != sorted_chars[:-1]])
    counts = np.diff(np.r_[first, len(chars)])
    return order, sorted_chars[first], counts, np.arange(len(chars)) - np.repeat(first, counts)


def _induce_buckets(s: np.ndarray, s_type: np.ndarray, seeds: np.ndarray, sigma: int) -> np.ndarray:
    n = len(s)
    sizes = np.bincount(s, minlength=sigma)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    sa = np.full(n, -1, np.int64)
    seed_of: dict[int, np.ndarray] = {}
    if len(seeds):
        order, chars, counts, _ = _spread(s[seeds])
        seed_of = dict(zip(chars.tolist(), np.split(seeds[order], np.cumsum(counts)[:-1]), strict=True))
    heads, tails = starts.copy(), ends.copy()

    def place(block: np.ndarray, smaller: bool) -> None:
        at = block - 1
        at = at[(at >= 0) & (s_type[at] == smaller)]
        if not len(at):
            return
        order, chars, counts, rank = _spread(s[at])
        if smaller:
            sa[np.repeat(tails[chars], counts) - 1 - rank] = at[order]
            tails[chars] -= counts
        else:
            sa[np.repeat(heads[chars], counts) + rank] = at[order]
            heads[chars] += counts

    present = np.flatnonzero(sizes)
    place(np.array([n]), False)
    for c in present.tolist():
        seen = starts[c]
        while seen < heads[c]:
            upto = heads[c]
            place(sa[seen:upto], False)
            seen = upto
        if c in seed_of:
            place(seed_of[c], False)
    for c in present[::-1].tolist():
        seen = ends[c]
        while seen > tails[c]:
            downto = tails[c]
            place(sa[downto:seen][::-1], True)
            seen = downto
        place(sa[starts[c] : heads[c]][::-1], True)
    return sa


def _induce_entries(s: np.ndarray, s_type: np.ndarray, seeds: np.ndarray, sigma: int) -> np.ndarray:
    n, text, kind = len(s), s.tolist(), s_type.tolist()
    sizes = np.bincount(s, minlength=sigma)
    ends = np.cumsum(sizes)
    sa, tails = [-1] * n, ends.tolist()
    for at in reversed(seeds.tolist()):
        tails[text[at]] -= 1
        sa[tails[text[at]]] = at
    heads = (ends - sizes).tolist()
    sa[heads[text[n - 1]]] = n - 1
    heads[text[n - 1]] += 1
    for at in sa:
        if at > 0 and not kind[at - 1]:
            c = text[at - 1]
            sa[heads[c]] = at - 1
            heads[c] += 1
    tails = ends.tolist()
    for i in range(n - 1, -1, -1):
        at = sa[i]
        if at > 0 and kind[at - 1]:
            c = text[at - 1]
            tails[c] -= 1
            sa[tails[c]] = at - 1
    return np.array(sa, np.int64)


def _names(s: np.ndarray, lms: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Ranks of the leftmost-smaller substrings, given in induced order; equal substrings share one."""
    stop = np.r_[lms[1:], len(s) - 1]
    after = np.empty(len(s), np.int64)
    after[lms] = stop
    a, b = order[:-1], order[1:]
    size = after[a] - a
    same = (size == after[b] - b) & (b != lms[-1]) & (a != lms[-1])
    live = np.flatnonzero(same)
    k = 0
    while len(live):
        differs = s[a[live] + k] != s[b[live] + k]
        same[live[differs]] = False
        live = live[~differs & (size[live] > k)]
        k += 1
    return np.r_[0, np.cumsum(~same)]


def suffix_array(s: np.ndarray, sigma: int | None = None) -> np.ndarray:
    """Start positions of the suffixes of ``s`` (integers from 0) in order; a suffix comes before its extensions."""
    n = len(s)
    if n < 2:
        return np.arange(n)
    sigma = int(s.max()) + 1 if sigma is None else sigma
    induce = _induce_buckets if sigma <= _SMALL else _induce_entries
    s_type = classify(s)
    lms = _leftmost(s_type)
    if len(lms) > 1:
        mark = np.zeros(n, bool)
        mark[lms] = True
        found = induce(s, s_type, lms, sigma)
        order = found[mark[found]]
        names = _names(s, lms, order)
        if names[-1] + 1 < len(lms):
            name_at = np.empty(n, np.int64)
            name_at[order] = names
            order = lms[suffix_array(name_at[lms], int(names[-1]) + 1)]
        lms = order
    return induce(s, s_type, lms, sigma)


def permuted_lcp(s: np.ndarray, sa: np.ndarray, limit: int) -> np.ndarray:
    """For every position the common prefix of its suffix with the one before it in ``sa``, at most ``limit``.

    From one position of the text to the next these values fall by at most one.
    So every 64th is computed in full, and each halving of the stride only
    extends what the position one stride before leaves.
    """
    n = len(s)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    room = np.where(before >= 0, np.minimum(limit, n - np.maximum(np.arange(n), before)), 0)
    out = np.zeros(n, np.int64)

    def extend(at: np.ndarray) -> None:
        while len(at):
            at = at[out[at] < room[at]]
            at = at[s[at + out[at]] == s[before[at] + out[at]]]
            out[at] += 1

    extend(np.arange(0, n, 64))
    for stride in (32, 16, 8, 4, 2, 1):
        at = np.arange(stride, n, 2 * stride)
        out[at] = np.clip(out[at - stride] - stride, 0, room[at])
        extend(at)
    return out
