"""Plots (buildings reached over each other on the way to the road) and Delaunay neighbours."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streetloom.functions.geometry import hypot
from streetloom.graph.components import connected_components
from streetloom.operators.buildings import plot_seeds
from streetloom.operators.spatial import box_join

TRIM = 0.5


def plot_ids(houses: DataFrame, edges: DataFrame, closest: DataFrame, cell: float = 100.0) -> DataFrame:
    """``id, plot_id``: houses whose line to the road meets another house's box share that one's plot.

    Lines are trimmed by half a metre at both ends; those under a metre meet
    nothing. A line counts with the house that it meets first (of equally near
    ones the least id). Plots are named by their least house; a house of up to
    10 square metres is its own.
    """
    seeds = plot_seeds(houses, edges, closest)
    span = hypot(F.col("px") - F.col("cx"), F.col("py") - F.col("cy"))
    t = F.try_divide(F.lit(TRIM), span)
    lines = seeds.where(span >= 2 * TRIM).select(
        "id", "cx", "cy", (F.col("cx") + t * (F.col("px") - F.col("cx"))).alias("ax"), (F.col("cy") + t * (F.col("py") - F.col("cy"))).alias("ay"),
        (F.col("px") - t * (F.col("px") - F.col("cx"))).alias("bx"), (F.col("py") - t * (F.col("py") - F.col("cy"))).alias("by"),
    )
    lines = lines.withColumns({"minx": F.least("ax", "bx"), "miny": F.least("ay", "by"), "maxx": F.greatest("ax", "bx"), "maxy": F.greatest("ay", "by")})

    def enters(a: str, b: str, low: str, high: str) -> tuple:
        """Share of the line at which it enters and leaves the box in one direction."""
        d = F.col(b) - F.col(a)
        s, e = F.try_divide(F.col(low) - F.col(a), d), F.try_divide(F.col(high) - F.col(a), d)
        inside = (F.col(a) >= F.col(low)) & (F.col(a) <= F.col(high))
        return F.coalesce(F.least(s, e), F.when(inside, 0.0).otherwise(2.0)), F.coalesce(F.greatest(s, e), F.when(inside, 1.0).otherwise(-1.0))

    (s1, e1), (s2, e2) = enters("l_ax", "l_bx", "r_minx", "r_maxx"), enters("l_ay", "l_by", "r_miny", "r_maxy")
    first, last = F.greatest(F.lit(0.0), s1, s2), F.least(F.lit(1.0), e1, e2)
    boxes = houses.select("id", "minx", "miny", "maxx", "maxy")
    hits = box_join(lines, boxes, cell, (F.col("l_id") != F.col("r_id")) & (first <= last)).withColumn("at", first)
    nearest = hits.groupBy(F.col("l_id").alias("a")).agg(F.min(F.struct("at", F.col("r_id").alias("b")))["b"].alias("b"))
    found = connected_components(nearest, "a", "b").withColumnsRenamed({"node": "id", "component": "p"})
    return houses.select("id").join(found, "id", "left").select("id", F.coalesce("p", "id").alias("plot_id"))


_NEAREST, _ROWS = 32, 256  # others that all points try first; points that go through numpy together


def _cut(cell: np.ndarray, owner: np.ndarray, count: np.ndarray, depth: np.ndarray, by: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Convex cells less what lies beyond a line, row by row.

    ``cell`` (rows, slots, 2) holds ``count`` corners in order, ``owner`` whose
    bisector leads from each corner to the next, ``depth`` how far a corner is
    on the near side of the line, which belongs to ``by``.
    """
    rows, slots = depth.shape
    used = np.arange(slots)[None] < count[:, None]
    after = (np.arange(slots)[None] + 1) % count[:, None]
    depth_after = np.take_along_axis(depth, after, 1)
    stays, stays_after = depth >= 0, depth_after >= 0
    kept, crossed = used & stays, used & (stays != stays_after)
    place = np.cumsum(kept + crossed.astype(int), 1) - kept - crossed
    wide = max(slots, int((kept.sum(1) + crossed.sum(1)).max()))
    new, new_owner = np.zeros((rows, wide, 2)), np.full((rows, wide), -1)
    r, k = np.nonzero(kept)
    new[r, place[r, k]], new_owner[r, place[r, k]] = cell[r, k], owner[r, k]
    r, k = np.nonzero(crossed)
    t = (depth[r, k] / (depth[r, k] - depth_after[r, k]))[:, None]
    at = place[r, k] + kept[r, k]
    new[r, at] = cell[r, k] + t * (cell[r, after[r, k]] - cell[r, k])
    new_owner[r, at] = np.where(stays[r, k], by[r], owner[r, k])
    return new, new_owner, kept.sum(1) + crossed.sum(1)


def delaunay_pairs(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs ``i, j`` in both directions of points whose bisector bounds the Voronoi cells, in order of ``i``.

    A cell starts as a box far around all points and is cut by the bisectors of
    the other points in order of distance, until the next is more than twice as
    far as the cell's furthest corner; no later one can cut it. The nearest
    points are tried for many cells at once. The few cells that stay open then,
    which reach the border, look which of all others cut them at all.
    """
    n = len(points)
    if n < 2:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    points = points - points.min(0)
    far = 10 * (np.ptp(points, axis=0).max() + 1)
    box = np.array([(-far, -far), (far, -far), (far, far), (-far, far)])
    out_i, out_j = [], []
    step = max(1, min(_ROWS, (1 << 22) // n))
    for first in range(0, n, step):
        mine = np.arange(first, min(first + step, n))
        rel = points[None] - points[mine, None]
        size = np.einsum("ijk,ijk->ij", rel, rel)
        k = min(_NEAREST + 1, n)
        near = np.argpartition(size, k - 1, axis=1)[:, :k] if k < n else np.broadcast_to(np.arange(n), (len(mine), n))
        near = np.take_along_axis(near, np.lexsort((near, np.take_along_axis(size, near, 1))), 1)
        near_size = np.take_along_axis(size, near, 1)
        cell, owner, count = np.tile(box, (len(mine), 1, 1)), np.full((len(mine), 4), -1), np.full(len(mine), 4)
        reach = np.full(len(mine), 8 * far * far)  # four times the square of the furthest corner's distance
        for c in range(k):
            open_ = np.flatnonzero(near_size[:, c] <= reach)
            if not len(open_):
                break
            j = near[open_, c]
            used = np.arange(cell.shape[1])[None] < count[open_, None]
            depth = np.where(used, near_size[open_, c, None] / 2 - np.einsum("ijk,ik->ij", cell[open_], rel[open_, j]), 0.0)
            hit = (depth < 0).any(1)
            if not hit.any():
                continue
            rows = open_[hit]
            new, new_owner, new_count = _cut(cell[rows], owner[rows], count[rows], depth[hit], j[hit])
            more = new.shape[1] - cell.shape[1]
            if more > 0:
                cell, owner = np.pad(cell, ((0, 0), (0, more), (0, 0))), np.pad(owner, ((0, 0), (0, more)), constant_values=-1)
            cell[rows], owner[rows], count[rows] = new, new_owner, new_count
            used = np.arange(cell.shape[1])[None] < new_count[:, None]
            reach[rows] = 4 * np.where(used, (new**2).sum(2), 0).max(1)
        for r in np.flatnonzero(near_size[:, -1] <= reach) if k < n else ():
            one, whose, corners = cell[r : r + 1], owner[r : r + 1], count[r : r + 1]
            others = np.flatnonzero((size[r] > near_size[r, -1]) & (size[r] <= reach[r]))
            while len(others):
                depth = size[r, others, None] / 2 - rel[r, others] @ one[0, : corners[0]].T
                others = others[(depth < 0).any(1)]
                if len(others):
                    j = others[np.lexsort((others, size[r, others]))[0]]
                    depth = np.zeros((1, one.shape[1]))
                    depth[0, : corners[0]] = size[r, j] / 2 - one[0, : corners[0]] @ rel[r, j]
                    one, whose, corners = _cut(one, whose, corners, depth, np.array([j]))
                    others = others[others != j]
            found = np.unique(whose[0, : corners[0]])
            found = found[found >= 0]
            count[r] = 0
            out_i.append(np.full(len(found), mine[r]))
            out_j.append(found)
        used = (np.arange(owner.shape[1])[None] < count[:, None]) & (owner >= 0)
        r, c = np.nonzero(used)
        out_i.append(mine[r])
        out_j.append(owner[r, c])
    i, j = np.concatenate(out_i), np.concatenate(out_j)
    pairs = np.unique(i * n + j)
    return pairs // n, pairs % n


def delaunay_neighbours(points: np.ndarray) -> list[np.ndarray]:
    """Neighbours of each point."""
    i, j = delaunay_pairs(points)
    return np.split(j, np.searchsorted(i, np.arange(1, len(points)))) if len(points) else []


def neighbour_distance(houses: DataFrame, by: str = "city") -> DataFrame:
    """``by, id, neighbor_distance``: mean gap between a house's box and those of its Delaunay neighbours; null without any.

    A city's triangulation depends on all its houses, so one city is one task.
    """

    def one(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id").reset_index(drop=True)
        low, high = pdf[["minx", "miny"]].to_numpy(float), pdf[["maxx", "maxy"]].to_numpy(float)
        i, j = delaunay_pairs((low + high) / 2)
        gap = np.hypot(*np.maximum(0, np.maximum(low[j] - high[i], low[i] - high[j])).T)
        n = np.bincount(i, minlength=len(pdf))
        mean = np.bincount(i, gap, minlength=len(pdf)) / np.maximum(n, 1)
        return pd.DataFrame({by: key[0], "id": pdf["id"], "neighbor_distance": pd.Series(mean).where(n > 0)})

    slim = houses.select(by, "id", "minx", "miny", "maxx", "maxy")
    return slim.groupBy(by).applyInPandas(one, f"{by} string, id long, neighbor_distance double")
