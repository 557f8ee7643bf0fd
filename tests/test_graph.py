import pytest
from pyspark.sql import functions as F

from streetloom.functions.scalars import edge_class, type_category
from streetloom.graph import roads

TWO_WAY = {"primary": ["10-5", "9-8", "10-11", "11-12"], "motorway": ["5-6", "6-7", "5-2", "1-2"], "residential": ["10-9", "8-6", "4-3", "4-13", "14-13"]}
ONE_WAY = [(13, 4, 1, "motorway"), (11, 2, 0, "residential"), (3, 2, 0, "residential"), (3, 5, 0, "residential")]


@pytest.fixture(scope="module")
def graph(spark):
    rows = [(int(a), int(b), 0, h) for h, links in TWO_WAY.items() for link in links for a, b in (link.split("-"), link.split("-")[::-1])] + ONE_WAY
    e = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "edge_id long, u long, v long, key int, highway string")
    return e.withColumns({"edge_class": edge_class(F.col("highway")), "type_category": type_category(F.col("highway"))}), rows


def slow(rows, start, steps, lower, higher, both):
    grade = lambda h: {"motorway": 4, "primary": 3, "residential": 2}[h]
    own = grade(rows[start][3])
    seen = {start} | {i for i, r in enumerate(rows) if (r[1], r[0], r[2]) == rows[start][:3]}
    edge = set(seen)
    for _ in range(steps):
        ends = {x for i in edge for x in rows[i][:2]}
        new = {i for i, r in enumerate(rows) if r[0] in ends or (both and r[1] in ends)}
        edge = {i for i in new - seen if (lower or grade(rows[i][3]) >= own) and (higher or grade(rows[i][3]) <= own)}
        seen |= edge
    return seen


@pytest.mark.parametrize("options", [{}, {"both": True, "lower": True, "higher": True}, {"both": True, "higher": True}, {"lower": True}])
def test_neighbourhoods(graph, options):
    e, rows = graph
    got = {}
    for r in roads.edge_neighbourhood(e, 3, **options).collect():
        got.setdefault(r.start, set()).add(r.edge_id)
    full = {"lower": False, "higher": False, "both": False} | options
    assert got == {i: slow(rows, i, 3, **full) for i in range(len(rows))}


def chain(spark, points, links, highway="residential"):
    rows = [(i, a, b, 0, highway, *points[a], *points[b]) for i, (a, b) in enumerate(links)]
    e = spark.createDataFrame(rows, "edge_id long, u long, v long, key int, highway string, x1 double, y1 double, x2 double, y2 double")
    e = e.withColumns({"length": F.sqrt((F.col("x2") - F.col("x1")) ** 2 + (F.col("y2") - F.col("y1")) ** 2), "type_category": type_category(F.col("highway"))})
    n = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in points.items()], "node_id long, x double, y double")
    return e, roads.node_degrees(n, e)


def test_walks_on_a_ring_end(spark):
    points = {0: (0.0, 0.0), 1: (100.0, 0.0), 2: (100.0, 100.0), 3: (0.0, 100.0)}
    e, n = chain(spark, points, [(0, 1), (1, 2), (2, 3), (3, 0)])
    e = e.join(roads.forward_angles(e), "edge_id")
    assert {r.section_id for r in roads.sections(e, n).collect()} == {0}
    assert [r.distance_to_last_intersection for r in roads.distance_to_last_intersection(e, n, most_rounds=8).collect()] == [None] * 4
    assert {r.forward_angle for r in e.collect()} == {90.0}
    assert {r.continuity for r in roads.continuity(e).collect()} == {0.1}
    assert len(roads.stretch_linearity(e).collect()) == 4


def test_straight_road(spark):
    points = {i: (i * 200.0, 0.0) for i in range(8)}
    e, n = chain(spark, points, [(i, i + 1) for i in range(7)])
    e = e.join(roads.forward_angles(e), "edge_id")
    assert {r.continuity for r in roads.continuity(e).collect()} == {1.0}
    assert all(abs(r.stretch_linearity - 1) < 1e-9 for r in roads.stretch_linearity(e).collect())
    back = {r.edge_id: r.distance_to_last_intersection for r in roads.distance_to_last_intersection(e, n).collect()}
    assert back == {i: 200.0 * (i + 1) for i in range(7)}
    assert roads.forward_angles(e.drop("forward_angle", "forward_angle_abs", "next_segment", "previous_segment")).where("forward_angle is null").count() == 1


def test_right_neighbour_of_parallel_streets(spark):
    points = {0: (0.0, 0.0), 1: (100.0, 0.0), 2: (0.0, 50.0), 3: (100.0, 60.0)}
    e, _ = chain(spark, points, [(0, 1), (2, 3)])
    got = {r.edge_id: r for r in roads.right_neighbours(e).collect()}
    assert tuple(got[0].right_neighbour) == (2, 3, 0) and abs(got[0].right_neighbour_angle_deviation - 5.710593) < 1e-6 and abs(got[0].right_neighbour_distance - 50) < 0.5
    assert got[1].right_neighbour is None and got[1].right_neighbour_distance is None


def test_right_neighbour_near_and_far(spark):
    """Rays that find nothing near their middle see the rest of their reach; one found near beats one found on the way."""
    points = {0: (0.0, 0.0), 1: (100.0, 0.0), 2: (0.0, 250.0), 3: (100.0, 250.0), 4: (1000.0, 0.0), 5: (1100.0, 0.0), 6: (1000.0, 90.0), 7: (1100.0, 90.0), 8: (1000.0, 200.0), 9: (1100.0, 200.0), 10: (2000.0, 0.0), 11: (2100.0, 0.0), 12: (2000.0, 310.0), 13: (2100.0, 310.0)}
    e, _ = chain(spark, points, [(0, 1), (2, 3), (4, 5), (6, 7), (8, 9), (10, 11), (12, 13)])
    got = {r.edge_id: (r.right_neighbour and r.right_neighbour.u, r.right_neighbour_distance) for r in roads.right_neighbours(e).collect()}
    assert got == {0: (2, 250.0), 1: (None, None), 2: (6, 90.0), 3: (8, 110.0), 4: (None, None), 5: (None, None), 6: (None, None)}
