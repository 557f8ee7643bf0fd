import math

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from streetloom.functions import kernels as k


def turned(points, degrees):
    a = math.radians(degrees)
    return np.array([(x * math.cos(a) - y * math.sin(a), x * math.sin(a) + y * math.cos(a)) for x, y in points])


def test_rectangle_frame_at_any_angle():
    for degrees in (0, 17, 45, 90, 133):
        long_, short, direction = k.least_rectangle(turned([(0, 0), (6, 0), (6, 2), (0, 2)], degrees))
        assert math.isclose(long_, 6, abs_tol=1e-9) and math.isclose(short, 2, abs_tol=1e-9)
        assert min(abs(direction - degrees % 180), 180 - abs(direction - degrees % 180)) < 1e-6


@given(st.lists(st.tuples(st.integers(-50, 50), st.integers(-50, 50)), min_size=3, max_size=25))
@settings(max_examples=60, deadline=None)
def test_circle_holds_all_points_and_is_least(points):
    pts = np.array(points, float)
    r = k.least_circle(pts)
    far = max(math.dist(p, q) for p in points for q in points)
    assert far / 2 - 1e-6 <= r <= far / math.sqrt(3) + 1e-6


def test_l_shape_and_courtyard():
    square = lambda x, y, s=1: [(x, y), (x + s, y), (x + s, y + s), (x, y + s)]
    ring = [square(x, y) for x in range(3) for y in range(3) if (x, y) != (1, 1)]
    assert k.filled_and_net_area(ring) == (9.0, 8.0)
    assert k.filled_and_net_area([square(0, 0), square(1, 0), square(0, 1)]) == (3.0, 3.0)
    assert k.filled_and_net_area([square(0, 0), square(5, 5)]) == (2.0, 2.0)
    assert k.filled_and_net_area([square(0, 0, 2), square(2, 0), square(2, 1)]) == (6.0, 6.0)  # walls that meet in parts


def test_faces_of_a_lattice_with_dead_ends():
    lines = [((x, y), (x + 1, y)) for x in range(2) for y in range(3)] + [((x, y), (x, y + 1)) for x in range(3) for y in range(2)]
    found = k.faces([*lines, ((0, 0), (-1, -1)), ((-1, -1), (-2, -1))])
    assert sorted(k.signed_area(r) for r in found) == [1.0] * 4
    assert k.faces([((0, 0), (1, 0))]) == []


def test_inset_and_cover():
    line = k.inset_convex([(0, 0), (10, 0), (10, 10), (0, 10)], 2)
    assert math.isclose(k.signed_area(line), 36)
    assert k.inset_convex([(0, 0), (3, 0), (3, 3), (0, 3)], 2) == []
    assert math.isclose(k.covered_length(line, [[(1, 1), (5, 1), (5, 3), (1, 3)]]), 3 + 1)


def test_distribution_grades():
    rng = np.random.default_rng(1)
    assert k.fit_distribution(rng.lognormal(1, 0.4, 4000))["name"] == "lognorm"
    assert k.fit_distribution(rng.standard_cauchy(400) * 0.01 + 5)["quality"] in ("GOOD", "OK", "BAD")
    assert k.fit_distribution(np.array([1.0]))["quality"] == "UNDEFINED" and k.fit_distribution(np.array([2.0, 2.0, np.nan]))["name"] == "zero"


@given(st.lists(st.tuples(st.floats(0, 100), st.floats(0, 100)), min_size=3, max_size=14, unique=True))
@settings(max_examples=40, deadline=None)
def test_delaunay_neighbours_see_each_other(points):
    from streetloom.operators.plots import delaunay_neighbours

    pts = np.array(points)
    near = delaunay_neighbours(pts)
    gaps = np.hypot(*(pts[:, None] - pts[None]).transpose(2, 0, 1))
    np.fill_diagonal(gaps, np.inf)
    for i, n in enumerate(near):
        if np.sort(gaps[i])[0] > 1e-3:
            assert int(gaps[i].argmin()) in n or np.isclose(np.sort(gaps[i])[0], np.sort(gaps[i])[1])  # the nearest point is always one


def test_delaunay_of_a_square_with_its_middle():
    from streetloom.operators.plots import delaunay_neighbours

    near = delaunay_neighbours(np.array([(0, 0), (4, 0), (4, 4), (0, 4), (2, 2.1)], float))
    assert near[4].tolist() == [0, 1, 2, 3] and 4 in near[0] and 2 not in near[0]
