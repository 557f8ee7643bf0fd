"""Polygon constructions that columns cannot express, as numpy functions and Arrow-batched UDFs."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T

Ring = list[tuple[float, float]]


def hull(points: np.ndarray) -> np.ndarray:
    """Convex hull, anticlockwise, by monotone chains."""
    pts = np.unique(points, axis=0)
    if len(pts) < 3:
        return pts

    def chain(order: np.ndarray) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for p in order:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out

    return np.array(chain(pts)[:-1] + chain(pts[::-1])[:-1])


def least_rectangle(points: np.ndarray) -> tuple[float, float, float]:
    """Long side, short side and direction (degrees, of the long side) of the least-area enclosing rectangle."""
    h = hull(points)
    if len(h) < 3:
        d = h[-1] - h[0] if len(h) else np.zeros(2)
        return float(np.hypot(*d)), 0.0, math.degrees(math.atan2(d[1], d[0])) % 180
    side = np.roll(h, -1, axis=0) - h
    angle = np.arctan2(side[:, 1], side[:, 0])
    c, s = np.cos(angle), np.sin(angle)
    along, across = np.outer(c, h[:, 0]) + np.outer(s, h[:, 1]), np.outer(-s, h[:, 0]) + np.outer(c, h[:, 1])
    w, b = np.ptp(along, axis=1), np.ptp(across, axis=1)
    k = int(np.argmin(w * b))
    turn = math.degrees(angle[k]) + (0 if w[k] >= b[k] else 90)
    return float(max(w[k], b[k])), float(min(w[k], b[k])), turn % 180


def least_circle(points: np.ndarray) -> float:
    """Radius of the least enclosing circle."""
    return float(least_circles(np.asarray(points, float)[None])[0]) if len(points) else 0.0


_CHUNK = 1 << 20  # numbers in a temporary array


def _of_three(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centres and radii of the circles through three points, row by row; an infinite radius if they lie on a line."""
    u, v = b - a, c - a
    den = 2 * (u[:, 0] * v[:, 1] - u[:, 1] * v[:, 0])
    uu, vv = (u * u).sum(1), (v * v).sum(1)
    flat = np.abs(den) <= 1e-12 * np.maximum(uu, vv)
    den = np.where(flat, 1.0, den)
    rel = np.stack([(v[:, 1] * uu - u[:, 1] * vv) / den, (u[:, 0] * vv - v[:, 0] * uu) / den], 1)
    return a + rel, np.where(flat, np.inf, np.hypot(rel[:, 0], rel[:, 1]))


def least_circles(points: np.ndarray) -> np.ndarray:
    """Radii of the least enclosing circles of sets of equally many points, ``(sets, points, 2)``.

    A circle rests on up to three points. The point furthest outside goes into
    the next one, the least that holds it and those three; radii only grow.
    """
    rest = np.repeat(points[:, :1], 3, axis=1)
    centre, radius = points[:, 0].copy(), np.zeros(len(points))
    todo = np.arange(len(points))
    while len(todo):
        p = points[todo]
        away = np.hypot(*np.moveaxis(p - centre[todo, None], 2, 0))
        far = away.argmax(1)
        out = away[np.arange(len(todo)), far] > radius[todo] * (1 + 1e-12) + 1e-12
        todo, far = todo[out], far[out]
        if not len(todo):
            break
        new, old = points[todo, far], rest[todo]
        four = np.concatenate([old, new[:, None]], 1)
        best, best_at, best_rest = np.full(len(todo), np.inf), new.copy(), np.repeat(new[:, None], 3, axis=1)
        for i, j in ((0, 0), (1, 1), (2, 2), (0, 1), (0, 2), (1, 2)):
            if i == j:
                at = (old[:, i] + new) / 2
                size = np.hypot(*(old[:, i] - at).T)
            else:
                at, size = _of_three(new, old[:, i], old[:, j])
            held = (np.hypot(*np.moveaxis(four - at[:, None], 2, 0)) <= size[:, None] * (1 + 1e-9) + 1e-9).all(1)
            better = held & (size < best)
            best[better], best_at[better] = size[better], at[better]
            best_rest[better] = np.stack([new, old[:, i], old[:, j]], 1)[better]
        grown = np.isfinite(best) & (best > radius[todo])
        todo = todo[grown]
        centre[todo], radius[todo], rest[todo] = best_at[grown], best[grown], best_rest[grown]
    return radius


def least_rectangles(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Long sides, short sides and directions of the least rectangles around sets of equally many points.

    A least rectangle lies along a side of the hull, so along a line through
    two of the points; every such direction is tried.
    """
    n = points.shape[1]
    i, j = np.triu_indices(n, 1)
    side = points[:, j] - points[:, i]
    size = np.hypot(side[..., 0], side[..., 1])
    none = size == 0
    unit = side / np.where(none, 1.0, size)[..., None]
    along = np.einsum("mpc,mkc->mpk", unit, points)
    across = np.einsum("mpc,mkc->mpk", np.stack([-unit[..., 1], unit[..., 0]], -1), points)
    w, b = np.ptp(along, axis=2), np.ptp(across, axis=2)
    k = np.where(none, np.inf, w * b).argmin(1)
    rows = np.arange(len(points))
    w, b, d = w[rows, k], b[rows, k], unit[rows, k]
    turn = np.degrees(np.arctan2(d[:, 1], d[:, 0])) + np.where(w >= b, 0, 90)
    return np.maximum(w, b), np.minimum(w, b), turn % 180


_FRAME = T.StructType([T.StructField(n, T.DoubleType()) for n in ("long_side", "short_side", "direction", "radius")])
_MANY_CORNERS = 16  # beyond that the hull is found first, ring by ring


def frames(x: np.ndarray, y: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Long side, short side, direction and radius for rings given by flat coordinates; ring ``k`` is ``first[k]:first[k + 1]``.

    Rings of equally many corners go through numpy together. NaN for a ring without points.
    """
    out, size = np.full((len(first) - 1, 4), np.nan), np.diff(first)
    xy = np.stack([x, y], 1)
    for n in np.unique(size[size > 0]):
        which = np.flatnonzero(size == n)
        if n > _MANY_CORNERS:
            for k in which:
                h = hull(xy[first[k] : first[k + 1]])
                out[k] = (*least_rectangle(h), least_circles(h[None])[0])
            continue
        step = max(1, _CHUNK // int(n * n * n))
        for part in (which[a : a + step] for a in range(0, len(which), step)):
            points = xy[first[part][:, None] + np.arange(n)]
            if n == 1:
                out[part] = 0.0
            else:
                out[part, :3] = np.stack(least_rectangles(points), 1)
                out[part, 3] = least_circles(points)
    return out


@F.arrow_udf(_FRAME)
def frame_of(rings: pa.Array) -> pa.Array:
    """Least rectangle and least circle around each ring; null for a null or empty one."""
    rings = rings.combine_chunks() if isinstance(rings, pa.ChunkedArray) else rings
    points = rings.flatten()
    size = pc.fill_null(pc.list_value_length(rings), 0).to_numpy(zero_copy_only=False)
    first = np.concatenate([[0], np.cumsum(size)])
    x, y = (points.field(c).to_numpy(zero_copy_only=False).astype(float) for c in (0, 1))
    found = frames(x, y, first)
    empty = pa.array(size == 0)
    names = [f.name for f in _FRAME.fields]
    return pa.StructArray.from_arrays([pc.if_else(empty, pa.scalar(None, pa.float64()), pa.array(found[:, c])) for c in range(4)], names)


# --- nearest boxes -----------------------------------------------------------

_BLOCK = 8  # samples along a block that shares its candidates


def nearest_boxes(xs: np.ndarray, ys: np.ndarray, ids: np.ndarray, boxes: np.ndarray, within: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Ids, and how many of the samples ``xs x ys`` have them nearest (of equal ones the least id); None if a sample has none ``within``.

    A block of samples tests only boxes that may be nearest to one of them:
    none nearer to the block than every other box's furthest corner allows.
    """
    order = np.argsort(ids, kind="stable")
    ids, boxes = ids[order], boxes[order]
    won = np.zeros(len(ids), np.int64)
    x_parts, y_parts = ([v[a : a + _BLOCK] for a in range(0, len(v), _BLOCK)] for v in (xs, ys))
    bx, by = (np.array([(p[0], p[-1]) for p in parts]) for parts in (x_parts, y_parts))

    def bounds(block: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest distance in one direction between samples of a block and a box."""
        near = np.maximum(0, np.maximum(low[None] - block[:, 1:], block[:, :1] - high[None]))
        far = np.maximum(0, np.maximum(low[None] - block[:, :1], block[:, 1:] - high[None]))
        return near**2, far**2

    (nx, fx), (ny, fy) = bounds(bx, boxes[:, 0], boxes[:, 2]), bounds(by, boxes[:, 1], boxes[:, 3])
    for i, px in enumerate(x_parts):
        near, far = nx[i][None] + ny, fx[i][None] + fy
        keep = near <= far.min(1, keepdims=True) * (1 + 1e-9)
        for j, py in enumerate(y_parts):
            some = np.flatnonzero(keep[j])
            b = boxes[some]
            dx = np.maximum(0, np.maximum(b[:, 0] - px[:, None], px[:, None] - b[:, 2])) ** 2
            dy = np.maximum(0, np.maximum(b[:, 1] - py[:, None], py[:, None] - b[:, 3])) ** 2
            d = dx[:, None] + dy[None]
            best = d.argmin(2)
            if np.take_along_axis(d, best[..., None], 2).max() > within * within:
                return None
            won += np.bincount(some[best.ravel()], minlength=len(ids))
    hit = won > 0
    return ids[hit], won[hit]


# --- rings --------------------------------------------------------------------


def signed_area(ring: Ring) -> float:
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1], strict=True)) / 2


def sides_of(ring: Ring) -> list[tuple]:
    """Sides of a closed or open ring, outer side on the right (the ring is turned anticlockwise)."""
    open_ = ring[:-1] if len(ring) > 1 and ring[0] == ring[-1] else ring
    if signed_area(open_) < 0:
        open_ = open_[::-1]
    return [(a, b) for a, b in zip(open_, open_[1:] + open_[:1], strict=True) if a != b]


def _between(a, b, p) -> bool:
    """Whether ``p`` lies on the inside of side a-b."""
    cross = (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])
    along = (p[0] - a[0]) * (b[0] - a[0]) + (p[1] - a[1]) * (b[1] - a[1])
    size = (b[0] - a[0]) ** 2 + (b[1] - a[1]) ** 2
    return abs(cross) <= 1e-9 * max(1.0, size) and 0 < along < size


def dissolve(rings: list[Ring]) -> list[Ring]:
    """Rings of the union of polygons that touch but do not overlap: sides are cut at the others' corners, and parts walked in both directions vanish."""
    sides = [s for r in rings for s in sides_of(r)]
    corners = {p for s in sides for p in s}
    parts: dict[tuple, int] = {}
    for a, b in sides:
        cuts = sorted((p for p in corners if _between(a, b, p)), key=lambda p: (p[0] - a[0]) * (b[0] - a[0]) + (p[1] - a[1]) * (b[1] - a[1]))
        stops = [a, *cuts, b]
        for p, q in zip(stops, stops[1:], strict=False):
            if parts.get((q, p)):
                parts[q, p] -= 1
            else:
                parts[p, q] = parts.get((p, q), 0) + 1
    after: dict[tuple, list[tuple]] = {}
    for (p, q), n in sorted(parts.items()):
        after.setdefault(p, []).extend([q] * n)
    return walk_faces(after)


def walk_faces(after: dict[tuple, list[tuple]]) -> list[Ring]:
    """Closed walks over directed sides; at each point the sharpest left turn is taken, so areas stay on the left and apart."""
    out: list[Ring] = []
    left = {p: list(q) for p, q in after.items()}
    for start in sorted(left):
        while left[start]:
            ring, here, to = [start], start, left[start].pop()
            while to != start:
                ring.append(to)
                back = math.atan2(here[1] - to[1], here[0] - to[0])
                ways = left.get(to) or []
                if not ways:
                    ring = []
                    break
                best = min(ways, key=lambda w: (back - math.atan2(w[1] - to[1], w[0] - to[0])) % (2 * math.pi) or 2 * math.pi)
                ways.remove(best)
                here, to = to, best
            if len(ring) > 2:
                out.append(ring)
    return out


def filled_and_net_area(rings: list[Ring]) -> tuple[float, float]:
    """Area of the union with its courtyards, and without."""
    areas = [signed_area(r) for r in dissolve(rings)]
    return sum(a for a in areas if a > 0), sum(areas)


@F.arrow_udf(T.DoubleType())
def filled_area(groups: pa.Array) -> pa.Array:
    """Area with its courtyards of the union of each row's closed rings, ``array<array<struct<x, y>>>``."""
    out = []
    for g in groups:
        rings = [[(p["x"], p["y"]) for p in r] for r in g.as_py() or ()]
        out.append(filled_and_net_area(rings)[0] if rings else None)
    return pa.array(out, pa.float64())


def faces(segments: list[tuple]) -> list[Ring]:
    """Bounded faces of a set of segments that meet only at their ends, anticlockwise; dangling ends are pruned first."""
    near: dict[tuple, set] = {}
    for a, b in segments:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    ends = [p for p, q in near.items() if len(q) == 1]
    while ends:
        p = ends.pop()
        for q in near.pop(p, ()):
            near[q].discard(p)
            if len(near[q]) == 1:
                ends.append(q)
    turn = {p: sorted(q, key=lambda w, p=p: math.atan2(w[1] - p[1], w[0] - p[0])) for p, q in near.items() if q}
    seen, out = set(), []
    for p in sorted(turn):
        for q in turn[p]:
            if (p, q) in seen:
                continue
            ring, a, b = [], p, q
            while (a, b) not in seen:
                seen.add((a, b))
                ring.append(a)
                ways = turn[b]
                a, b = b, ways[ways.index(a) - 1]  # the next way clockwise keeps the face on the left
            if signed_area(ring) > 0:
                out.append(ring)
    return out


def inset_convex(ring: Ring, by: float) -> Ring:
    """A convex ring moved inwards: the part of it at least ``by`` from each side's line."""
    sides = sides_of(ring)
    poly = [a for a, _ in sides]
    for a, b in sides:
        size = math.hypot(b[0] - a[0], b[1] - a[1])
        depth = lambda p, a=a, b=b, size=size: ((b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])) / size - by
        new = []
        for p, q in zip(poly, poly[1:] + poly[:1], strict=True):
            dp, dq = depth(p), depth(q)
            if dp >= 0:
                new.append(p)
            if dp * dq < 0:
                t = dp / (dp - dq)
                new.append((p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])))
        poly = new
        if not poly:
            return []
    return poly


def inside(ring: Ring, p: tuple) -> bool:
    """Even-odd test."""
    hit = False
    for a, b in zip(ring, ring[1:] + ring[:1], strict=True):
        if (a[1] > p[1]) != (b[1] > p[1]) and p[0] < (b[0] - a[0]) * (p[1] - a[1]) / (b[1] - a[1]) + a[0]:
            hit = not hit
    return hit


def covered_length(line: Ring, rings: list[Ring]) -> float:
    """How much of a closed line lies inside any of the rings."""
    total = 0.0
    for a, b in zip(line, line[1:] + line[:1], strict=True):
        cuts = {0.0, 1.0}
        dx, dy = b[0] - a[0], b[1] - a[1]
        for r in rings:
            for p, q in sides_of(r):
                ex, ey = q[0] - p[0], q[1] - p[1]
                den = dx * ey - dy * ex
                if abs(den) > 1e-12:
                    t, u = ((p[0] - a[0]) * ey - (p[1] - a[1]) * ex) / den, ((p[0] - a[0]) * dy - (p[1] - a[1]) * dx) / den
                    if 0 < t < 1 and 0 <= u <= 1:
                        cuts.add(t)
        stops = sorted(cuts)
        for s, e in zip(stops, stops[1:], strict=False):
            m = (s + e) / 2
            if any(inside(r, (a[0] + m * dx, a[1] + m * dy)) for r in rings):
                total += (e - s) * math.hypot(dx, dy)
    return total


def ring_of(polygon) -> Ring:
    """The outer ring of a polygon value, open."""
    ring = [(p["x"], p["y"]) for p in polygon[0]]
    return ring[:-1] if len(ring) > 1 and ring[0] == ring[-1] else ring


# --- distributions ------------------------------------------------------------


def fit_distribution(values: np.ndarray) -> dict:
    """Better of Cauchy and log-normal by squared error to a density histogram, with a KS statistic and a grade."""
    x = np.sort(values[np.isfinite(values)].astype(float))
    none = {"name": "zero", "a": None, "b": None, "error": None, "ks": None, "quality": "UNDEFINED"}
    if len(x) < 2 or x[0] == x[-1]:
        return none
    density, edges = np.histogram(x, bins=min(50, max(5, int(math.sqrt(len(x))))), density=True)
    mid = (edges[:-1] + edges[1:]) / 2
    q1, q2, q3 = np.quantile(x, [0.25, 0.5, 0.75])
    tries = []
    if q3 > q1:
        loc, scale = q2, (q3 - q1) / 2
        tries.append(("cauchy", loc, scale, 1 / (np.pi * scale * (1 + ((mid - loc) / scale) ** 2)), 0.5 + np.arctan((x - loc) / scale) / np.pi))
    if x[0] > 0:
        mu, sd = np.log(x).mean(), np.log(x).std()
        if sd > 0:
            erf = np.array([math.erf(v) for v in (np.log(x) - mu) / (sd * math.sqrt(2))])
            tries.append(("lognorm", mu, sd, np.exp(-((np.log(mid) - mu) ** 2) / (2 * sd**2)) / (mid * sd * math.sqrt(2 * np.pi)), (1 + erf) / 2))
    if not tries:
        return none
    rank = np.arange(1, len(x) + 1) / len(x)
    scored = [(float(((d - density) ** 2).sum()), float(np.maximum(np.abs(c - rank), np.abs(c - rank + 1 / len(x))).max()), n, float(a), float(b)) for n, a, b, d, c in tries]
    error, ks, name, a, b = min(scored)
    quality = "GOOD" if error < 0.2 and ks < 0.2 else "OK" if error < 1.0 and ks < 0.4 else "BAD"
    return {"name": "zero" if quality == "BAD" else name, "a": a, "b": b, "error": error, "ks": ks, "quality": quality}
