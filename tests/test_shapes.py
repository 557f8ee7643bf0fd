"""Frames and courtyards of shapes that are no axis-parallel rectangles."""

import math

import pytest

from streetloom.operators import buildings as b


def polygons(spark, shapes):
    rows = []
    for i, rings in enumerate(shapes):
        closed = [[(float(x), float(y)) for x, y in [*r, r[0]]] for r in rings]
        xs, ys = zip(*closed[0], strict=True)
        rows.append((i, closed, min(xs), min(ys), max(xs), max(ys)))
    return spark.createDataFrame(rows, "id long, geom array<array<struct<x:double,y:double>>>, minx double, miny double, maxx double, maxy double")


def box(x, y, w, h):
    return [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]


def test_frames(spark):
    s = math.sqrt(0.5)
    turned = [(4 * s * a - 2 * s * c, 4 * s * a + 2 * s * c) for a, c in ((0, 0), (1, 0), (1, 1), (0, 1))]  # 4 x 2, turned by 45 degrees
    ell = [(0, 0), (4, 0), (4, 2), (2, 2), (2, 4), (0, 4)]
    many = [(5 * math.cos(t * math.pi / 20), 5 * math.sin(t * math.pi / 20)) for t in range(40)]
    shapes = [[box(0, 0, 8, 6)], [turned], [ell], [[(0, 0), (4, 0), (0, 3)]], [many]]
    df = b.framed(b.measured(polygons(spark, shapes)))
    rows = {r.id: r for r in df.collect()}
    assert rows[0].elongation == pytest.approx(0.75) and rows[0].rectangularity == pytest.approx(1) and rows[0].orientation == pytest.approx(0)
    assert rows[1].elongation == pytest.approx(0.5) and rows[1].rectangularity == pytest.approx(1) and rows[1].orientation == pytest.approx(45)
    assert rows[2].rectangularity == pytest.approx(12 / 16) and rows[2].circular_compactness == pytest.approx(12 / (math.pi * 8))  # rests on (4, 0), (0, 4)
    assert rows[3].rectangularity == pytest.approx(0.5) and rows[3].shape_index == pytest.approx(math.sqrt(6 / math.pi) / 2.5)
    assert rows[4].shape_index == pytest.approx(math.sqrt(rows[4].area / math.pi) / 5)


def test_frames_of_nothing(spark):
    df = spark.createDataFrame([(0, None, None, None)], "id long, geom array<array<struct<x:double,y:double>>>, area double, perimeter double")
    assert b.framed(df).first().elongation is None


def test_courtyards(spark):
    around = [box(0, 0, 10, 2), box(0, 2, 2, 6), box(8, 2, 2, 6), box(0, 8, 10, 2)]  # a ring of four round 6 x 6
    row = [box(100, 0, 8, 6), box(108, 0, 8, 9)]
    holed = [[box(200, 0, 10, 10), box(203, 3, 2, 2)]]
    df = polygons(spark, [[r] for r in around] + [[r] for r in row] + holed)
    grouped = df.join(b.building_groups(df), "id")
    rows = {r.building_group_id: r for r in b.group_courtyards(grouped).collect()}
    assert sorted(rows) == [0, 4, 6]
    assert rows[0].building_group_area == pytest.approx(64) and rows[0].building_group_courtyard_index == pytest.approx(36 / 64)
    assert rows[4].building_group_area == pytest.approx(120) and rows[4].building_group_courtyard_index == 0
    assert rows[6].building_group_area == pytest.approx(96) and rows[6].building_group_courtyard_index == pytest.approx(4 / 96)
