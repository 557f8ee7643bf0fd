"""Road-graph metrics.

Edges: ``edge_id, u, v, key, highway, type_category, length, x1, y1, x2, y2``
(the ends are those of nodes ``u`` and ``v``). Nodes: ``node_id, x, y``. Every
metric is a frame of the id and its new columns, to be joined where wanted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streetloom.config import CONFIG
from streetloom.functions.geometry import hypot, segment_distance_squared, segment_gap, segments_cross
from streetloom.functions.scalars import axis_deviation, bearing, is_major, normalised_angle
from streetloom.graph.components import connected_components
from streetloom.operators.spatial import box_join
from streetloom.plans.shared import materialise, release

LINE = ("x1", "y1", "x2", "y2")


def with_bearing(edges: DataFrame) -> DataFrame:
    return edges.withColumn("bearing", bearing(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")))


# --- nodes -------------------------------------------------------------------


def neighbours(edges: DataFrame) -> DataFrame:
    """Distinct neighbours of each node in either direction: ``node_id, other``."""
    return edges.select(F.inline(F.array(
        F.struct(F.col("u").alias("node_id"), F.col("v").alias("other")), F.struct(F.col("v").alias("node_id"), F.col("u").alias("other")),
    ))).distinct()


def node_degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node_id, node_degree, node_major_degree, is_intersection, is_major_intersection``."""
    counts = neighbours(edges).groupBy("node_id").agg(F.count("*").alias("node_degree"))
    major = neighbours(edges.where((F.col("key") == 0) & is_major(F.col("type_category")))).groupBy("node_id").agg(F.count("*").alias("node_major_degree"))
    out = nodes.select("node_id").join(counts, "node_id", "left").join(major, "node_id", "left").fillna(0)
    return out.withColumns({"is_intersection": F.col("node_degree") > 2, "is_major_intersection": F.col("node_major_degree") > 2})


def average_neighbour_degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Mean out-degree of the nodes that a node leads to; 0 if it leads nowhere."""
    links = edges.select("u", "v").distinct()
    out_degree = edges.groupBy("u").agg(F.count("*").alias("d")).withColumnRenamed("u", "w")
    mean = links.join(out_degree, links["v"] == out_degree["w"], "left").groupBy(F.col("u").alias("node_id")).agg(F.avg(F.coalesce("d", F.lit(0))).alias("average_neighbor_degree"))
    return nodes.select("node_id").join(mean, "node_id", "left").fillna(0.0)


def square_clustering(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Squares through a node by the squares there could be, over pairs of its neighbours."""
    near = edges.where("u <> v").select(F.col("u").alias("n"), F.col("v").alias("w")).distinct()
    degree = near.groupBy("n").agg(F.count("*").alias("d"))
    a, b = near.select("n", F.col("w").alias("a")), near.select("n", F.col("w").alias("b"))
    pairs = a.join(b, "n").where("a < b").join(degree.select(F.col("n").alias("a"), F.col("d").alias("da")), "a", "left").join(degree.select(F.col("n").alias("b"), F.col("d").alias("db")), "b", "left")
    pairs = materialise(pairs.fillna(0, ["da", "db"]))
    common = pairs.select("n", "a", "b").join(near.select(F.col("n").alias("a"), F.col("w").alias("c")), "a").join(near.select(F.col("n").alias("b"), F.col("w").alias("c")), ["b", "c"])
    squares = common.where("c <> n").groupBy("n", "a", "b").agg(F.count("*").alias("q"))
    joined = near.select(F.col("n").alias("a"), F.col("w").alias("b")).withColumn("linked", F.lit(1))
    full = pairs.join(squares, ["n", "a", "b"], "left").join(joined, ["a", "b"], "left").fillna(0, ["q", "linked"])
    taken = F.col("q") + 1 + F.col("linked")
    possible = (F.col("da") - taken) + (F.col("db") - taken) + F.col("q")
    total = full.groupBy(F.col("n").alias("node_id")).agg(F.sum("q").alias("q"), F.sum(possible).alias("p"))
    return nodes.select("node_id").join(total, "node_id", "left").select("node_id", F.coalesce(F.when(F.col("p") > 0, F.col("q") / F.col("p")), F.lit(0.0)).alias("clustering"))


# --- one step along the road -------------------------------------------------


def _turns(edges: DataFrame) -> DataFrame:
    """Each edge beside each node that its end leads on to, and the angle of that turn."""
    here = with_bearing(edges).select("edge_id", "u", "v", "key", "bearing")
    on = with_bearing(edges).groupBy(F.col("u").alias("v"), F.col("v").alias("w")).agg(F.min("bearing").alias("next_bearing"))
    return here.join(on, "v").where("w <> u").withColumn("angle", normalised_angle(F.col("next_bearing") - F.col("bearing")))


def forward_angles(edges: DataFrame) -> DataFrame:
    """``edge_id, forward_angle, forward_angle_abs, next_segment, previous_segment``.

    Of several ways on the straightest is taken (of equal ones the node of
    least id), and none if that turns by more than 45 degrees; a single way on
    is always taken. Pointers are ``struct<u, v, key>`` with key 0. Of several
    edges that lead on to one, the last by ``(u, v, key)`` is its previous one.
    """
    best = _turns(edges).groupBy("edge_id", "u", "v", "key").agg(F.count("*").alias("ways"), F.min(F.struct(F.abs("angle").alias("size"), "w", "angle")).alias("b"))
    taken = best.where((F.col("ways") == 1) | (F.col("b.size") <= CONFIG.forward_angle_cut))
    taken = taken.select("edge_id", "u", "v", "key", F.col("b.w").alias("w"), F.col("b.angle").alias("forward_angle"))
    before = taken.groupBy(F.col("v").alias("u"), F.col("w").alias("v")).agg(F.max(F.struct("u", "v", "key")).alias("previous_segment"))
    before = before.withColumn("key", F.lit(0))
    out = edges.select("edge_id", "u", "v", "key").join(taken.drop("u", "v", "key"), "edge_id", "left").join(before, ["u", "v", "key"], "left")
    ahead = F.when(F.col("w").isNotNull(), F.struct(F.col("v").alias("u"), F.col("w").alias("v"), F.lit(0).alias("key")))
    return out.select("edge_id", "forward_angle", F.abs("forward_angle").alias("forward_angle_abs"), ahead.alias("next_segment"), "previous_segment")


def along(edges: DataFrame, pointer: str, values: dict[str, str]) -> DataFrame:
    """Columns of the edge that ``pointer`` names, under new names: ``edge_id, new...``."""
    target = edges.select(F.struct("u", "v", "key").alias("__at"), *(F.col(old).alias(new) for old, new in values.items()))
    return edges.select("edge_id", pointer).join(target, F.col(pointer) == F.col("__at"), "left").select("edge_id", *values.values())


def left_angles(edges: DataFrame, nodes: DataFrame, major: bool = False) -> DataFrame:
    """Largest turn to the left at an intersection: ``edge_id, [major_]intersection_left_angle``.

    Null unless the end is an intersection, where the largest turn is to the
    right, and where it is the way straight on. ``major``: only major roads.
    ``edges`` need ``forward_angle``, ``nodes`` their degrees.
    """
    name, mark = ("major_intersection_left_angle", "is_major_intersection") if major else ("intersection_left_angle", "is_intersection")
    roads = edges.where(is_major(F.col("type_category"))) if major else edges
    largest = _turns(roads).groupBy("edge_id").agg(F.max("angle").alias("turn"))
    at = nodes.where(F.col(mark)).select(F.col("node_id").alias("v"))
    kept = roads.select("edge_id", "v", "forward_angle").join(at, "v").join(largest, "edge_id")
    value = F.when((F.col("turn") >= 0) & ~F.col("turn").eqNullSafe(F.col("forward_angle")), F.col("turn"))
    return edges.select("edge_id").join(kept.select("edge_id", value.alias(name)), "edge_id", "left")


def next_node_degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``edge_id, next_node_degree, next_node_major_degree``: degrees of the node at the end."""
    at = nodes.select(F.col("node_id").alias("v"), F.col("node_degree").alias("next_node_degree"), F.col("node_major_degree").alias("next_node_major_degree"))
    return edges.select("edge_id", "v").join(at, "v", "left").drop("v")


def city_center_bearing(edges: DataFrame, x: Column, y: Column) -> DataFrame:
    """Angle between an edge and the direction from its end to the centre, in [0, 90]."""
    ax, ay, bx, by = F.col("x1") - F.col("x2"), F.col("y1") - F.col("y2"), x - F.col("x2"), y - F.col("y2")
    cosine = F.try_divide(ax * bx + ay * by, hypot(ax, ay) * hypot(bx, by))
    angle = F.pmod(180 - F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))), F.lit(180.0))
    return edges.select("edge_id", F.when(cosine.isNotNull(), F.when(angle > 90, 180 - angle).otherwise(angle)).alias("city_center_bearing"))


def on_domain_border(edges: DataFrame, extent: DataFrame, most: float = CONFIG.domain_border) -> DataFrame:
    """Whether an edge comes within ``most`` of the border of the extent's box (one row: ``minx, miny, maxx, maxy``)."""
    e = F.broadcast(extent.select(*(F.col(c).alias("e_" + c) for c in ("minx", "miny", "maxx", "maxy"))))
    gap = F.least(
        F.abs(F.least("x1", "x2") - F.col("e_minx")), F.abs(F.col("e_maxx") - F.greatest("x1", "x2")),
        F.abs(F.least("y1", "y2") - F.col("e_miny")), F.abs(F.col("e_maxy") - F.greatest("y1", "y2")),
    )
    return edges.join(e).select("edge_id", (gap < most).alias("on_domain_border"))


def orientation_deviation(edges: DataFrame) -> DataFrame:
    """Mean deviation of an edge's axis from those of the edges that share an end: ``neighboring_street_orientation_deviation``."""
    ends = with_bearing(edges).select("edge_id", F.pmod("bearing", F.lit(180.0)).alias("axis"), F.explode(F.array("u", "v")).alias("node"))
    other = ends.select(F.col("edge_id").alias("o"), F.col("axis").alias("other_axis"), "node")
    pairs = ends.join(other, "node").where("edge_id <> o").select("edge_id", "o", "axis", "other_axis").distinct()
    mean = pairs.groupBy("edge_id").agg(F.avg(axis_deviation(F.col("axis"), F.col("other_axis"))).alias("neighboring_street_orientation_deviation"))
    return edges.select("edge_id").join(mean, "edge_id", "left")


# --- the neighbour on the right ----------------------------------------------


def right_neighbours(edges: DataFrame, reach: float = CONFIG.right_ray, least: float = CONFIG.right_min, offset: float = 1.0, inclusive: bool = True) -> DataFrame:
    """Nearest edge that a ray at a right angle from an edge's middle crosses.

    ``edge_id, right_neighbour struct<u, v, key>, right_neighbour_angle_deviation, right_neighbour_distance``.
    The ray turns the edge's direction by +90 degrees and begins ``offset``
    away (for edges longer than that). Edges nearer to the middle than
    ``least`` do not count; of equally near ones the least ``(u, v, key)``.

    Rays look near their middle first, where each is one row. Whatever is found
    there is nearer than all that lies beyond; only rays that found nothing are
    laid out over cells along their whole length.
    """
    own, ray, line = [F.col(f"own_{c}") for c in LINE], [F.col(f"ray_{c}") for c in LINE], [F.col(c) for c in LINE]
    dx, dy = line[2] - line[0], line[3] - line[1]
    span, cx, cy = hypot(dx, dy), (line[0] + line[2]) / 2, (line[1] + line[3]) / 2
    ux, uy, skip = F.try_divide(dx, span), F.try_divide(dy, span), F.when(span > offset, offset).otherwise(0.0)
    shot = [cx - uy * skip, cy + ux * skip, cx - uy * reach, cy + ux * reach]
    # Written first, and the ray's columns below the joins: folded into one another, these expressions make methods too long for the JVM to compile.
    edges = materialise(edges.select("edge_id", "u", "v", "key", *LINE))
    rays = edges.where(span > 0).select(F.col("edge_id").alias("id"), cx.alias("cx"), cy.alias("cy"), *(v.alias(f"own_{c}") for c, v in zip(LINE, line, strict=True)), *(v.alias(f"ray_{c}") for c, v in zip(LINE, shot, strict=True)))
    lines = edges.select("edge_id", "u", "v", "key", *LINE)
    box = lambda p: {"minx": F.least(p[0], p[2]), "miny": F.least(p[1], p[3]), "maxx": F.greatest(p[0], p[2]), "maxy": F.greatest(p[1], p[3])}
    rays, lined = rays.withColumns(box(ray)), box(line)
    meets = (F.col("minx") <= lined["maxx"]) & (lined["minx"] <= F.col("maxx")) & (F.col("miny") <= lined["maxy"]) & (lined["miny"] <= F.col("maxy"))
    gap = F.sqrt(segment_distance_squared(F.col("cx"), F.col("cy"), *line))
    far = gap >= least if inclusive else gap > least
    slope = lambda p: bearing(p[2] - p[0], p[3] - p[1])
    picked = F.struct(gap.alias("gap"), F.struct("u", "v", "key").alias("edge"), *LINE, *(F.col(f"own_{c}") for c in LINE))
    hit = meets & (F.col("id") != F.col("edge_id")) & segments_cross(ray, line) & far

    near = reach / 3
    cell = 2 * near
    at = lambda v: F.floor(v / cell).cast("long")
    spans = [F.sequence(at(F.least(p, q) - near), at(F.greatest(p, q) + near)) for p, q in (("x1", "x2"), ("y1", "y2"))]
    close = rays.withColumns({"__cx": at(F.col("cx")), "__cy": at(F.col("cy"))}).join(lines.withColumn("__cx", F.explode(spans[0])).withColumn("__cy", F.explode(spans[1])), ["__cx", "__cy"])
    close = close.where(hit).groupBy("id", "__cx", "__cy").agg(F.min(picked).alias("b"))
    close = materialise(close.where(F.col("b.gap") <= near).select("id", "b"))

    # A ray is long and thin: cells much smaller than its reach leave few lines to test.
    pairs = box_join(rays.join(close.select("id"), "id", "left_anti"), lines.withColumns(box(line)), min(reach / 4, 200.0))
    names = {"id": "l_id", **{c: f"l_{c}" for c in rays.columns[1:]}, **{c: f"r_{c}" for c in lines.columns}}
    wide = pairs.select(*(F.col(old).alias(new) for new, old in names.items())).where(hit).groupBy("id").agg(F.min(picked).alias("b"))
    best = close.unionByName(wide).select(F.col("id").alias("edge_id"), "b.*")
    best = best.select("edge_id", "edge", axis_deviation(slope(own), slope(line)).alias("turn"), segment_gap(own, line).alias("apart"))
    names = {"edge": "right_neighbour", "turn": "right_neighbour_angle_deviation", "apart": "right_neighbour_distance"}
    return edges.select("edge_id").join(best, "edge_id", "left").withColumnsRenamed(names)


def right_major_neighbours(edges: DataFrame) -> DataFrame:
    """The same among major roads: 2000 m, more than 50 m away, ray from the middle itself."""
    roads = edges.where(is_major(F.col("type_category")))
    found = right_neighbours(roads, CONFIG.right_major_ray, CONFIG.right_major_min, 0.0, inclusive=False)
    names = {c: c.replace("right_", "right_major_") for c in found.columns if c != "edge_id"}
    return edges.select("edge_id").join(found.withColumnsRenamed(names), "edge_id", "left")


# --- sections ----------------------------------------------------------------


def _sections(edges: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """Components of ``links`` (``a, b`` edge ids); an edge without links is its own."""
    found = connected_components(links, "a", "b").withColumnsRenamed({"node": "edge_id", "component": "__section"})
    return edges.select("edge_id").join(found, "edge_id", "left").select("edge_id", F.coalesce("__section", "edge_id").alias(name))


def sections(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``edge_id, section_id``: runs of edges through nodes of degree two, named by their least edge id."""
    through = nodes.where("node_degree = 2").select(F.col("node_id").alias("n"))
    first = edges.where("key = 0")
    a = first.select(F.col("edge_id").alias("a"), F.col("u").alias("from"), F.col("v").alias("n"))
    b = first.select(F.col("edge_id").alias("b"), F.col("u").alias("n"), F.col("v").alias("to"))
    return _sections(edges, a.join(through, "n").join(b, "n").where(F.col("from") != F.col("to")), "section_id")


def major_sections(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``edge_id, major_section_id``: runs of major roads along ``next_segment`` through nodes of major degree two; null for others."""
    roads = edges.where(is_major(F.col("type_category")))
    through = nodes.where("node_major_degree = 2").select(F.col("node_id").alias("v"))
    a = roads.join(through, "v").select(F.col("edge_id").alias("a"), F.col("next_segment").alias("on"))
    b = roads.select(F.col("edge_id").alias("b"), F.struct("u", "v", "key").alias("on"))
    found = _sections(roads, a.join(b, "on"), "major_section_id")
    return edges.select("edge_id").join(found, "edge_id", "left")


def section_lengths(edges: DataFrame, section: str, name: str) -> DataFrame:
    """``edge_id`` and the summed length of its section; null without one."""
    total = edges.where(F.col(section).isNotNull()).groupBy(section).agg(F.sum("length").alias(name))
    return edges.select("edge_id", section).join(total, section, "left").select("edge_id", name)


def dead_end_sections(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``edge_id, dead_end_section``: whether an edge of its section touches a node of degree one away from the border."""
    single = nodes.where("node_degree = 1").select("node_id")
    ends = edges.where(~F.col("on_domain_border")).select("section_id", F.explode(F.array("u", "v")).alias("node_id"))
    dead = ends.join(single, "node_id", "left_semi").select("section_id").distinct().withColumn("dead_end_section", F.lit(True))
    return edges.select("edge_id", "section_id").join(dead, "section_id", "left").select("edge_id", F.coalesce("dead_end_section", F.lit(False)).alias("dead_end_section"))


# --- walks -------------------------------------------------------------------


def distance_to_last_intersection(edges: DataFrame, nodes: DataFrame, mark: str = "is_intersection", name: str = "distance_to_last_intersection", most_rounds: int = 40) -> DataFrame:
    """Length back to the last intersection, the edge itself included.

    At a node that is none the way back goes over the predecessor of least id
    other than the edge's end. Pointers are doubled: each round joins every
    open walk with the walk of the edge it has reached, so a walk of ``n``
    edges takes ``log2(n)`` joins. A walk that runs in a circle is null.
    """
    stop = nodes.select(F.col("node_id").alias("u"), F.col(mark).alias("stop"))
    first = edges.where("key = 0").select(F.col("edge_id").alias("back"), F.col("u").alias("from"), F.col("v").alias("u"))
    here = edges.select("edge_id", "u", "v", "length").join(stop, "u", "left")
    back = here.where(~F.coalesce("stop", F.lit(True))).join(first, "u").where(F.col("from") != F.col("v"))
    back = back.groupBy("edge_id").agg(F.min(F.struct("from", "back"))["back"].alias("to"))
    walk = materialise(here.select("edge_id", F.col("length").alias("sum")).join(back, "edge_id", "left"))
    for _ in range(most_rounds):
        if walk.where("to is not null").isEmpty():
            break
        step = walk.select(F.col("edge_id").alias("to"), F.col("sum").alias("more"), F.col("to").alias("next"))
        new = materialise(walk.join(step, "to", "left").select("edge_id", (F.col("sum") + F.coalesce("more", F.lit(0.0))).alias("sum"), F.col("next").alias("to")))
        release(walk)
        walk = new
        if walk.where("to is not null and sum < 1e12").isEmpty():
            break
    return walk.select("edge_id", F.when(F.col("to").isNull(), F.col("sum")).alias(name))


def continuity(edges: DataFrame, most: float = CONFIG.continuity_length, angle: float = CONFIG.continuity_angle) -> DataFrame:
    """Length of what an edge reaches over its pointers with turns below ``angle``, up to ``most``, by ``most``.

    An edge leads ahead to its next segment, and back to the previous segment
    where that one leads straight to it. A way back therefore always undoes a
    way ahead, and edges linked in both directions form paths and rings, of
    which all is reached from any part. Sums along them are found by doubled
    pointers that rest once they hold ``most``. A path whose last edge leads
    into the side of another path reaches that one too, and what it reaches.
    """
    edges = materialise(edges.select("edge_id", "u", "v", "key", "length", "next_segment", "previous_segment", "forward_angle"))  # read five times
    at = edges.select(F.struct("u", "v", "key").alias("at"), F.col("edge_id").alias("ahead"))
    straight = edges.where(F.abs("forward_angle") < angle)
    ahead = straight.where("next_segment is not null").select("edge_id", F.col("next_segment").alias("at")).join(at, "at").select("edge_id", "ahead")
    before = edges.where("previous_segment is not null").select(F.col("edge_id").alias("ahead"), F.col("previous_segment").alias("at"))
    before = before.join(straight.select(F.struct("u", "v", "key").alias("at"), F.col("edge_id").alias("back")), "at").select("ahead", "back")
    ways = materialise(ahead.join(before, "ahead", "left").select("edge_id", "ahead", (F.col("edge_id") == F.col("back")).alias("mutual")))
    size = edges.select("edge_id", "length")
    mutual = ways.where("mutual").select("edge_id", "ahead")
    forward = _saturated_walk(size, mutual.select("edge_id", F.col("ahead").alias("to")), most)
    backward = _saturated_walk(size, mutual.select(F.col("ahead").alias("edge_id"), F.col("edge_id").alias("to")), most)
    # A ring's least edge is met again from the edge after it; all of a ring have that edge as the least on their walk.
    after = mutual.join(forward.select(F.col("edge_id").alias("ahead"), "low", "low_at"), "ahead").where("low = edge_id")
    rings = after.join(size, "edge_id").select(F.col("edge_id").alias("low"), (F.col("low_at") + F.col("length")).alias("ring"))
    both = forward.join(backward.select("edge_id", F.col("sum").alias("behind")), "edge_id").join(size, "edge_id").join(rings, "low", "left")
    total = F.coalesce("ring", F.col("sum") + F.col("behind") - F.col("length"))
    paths = materialise(both.select("edge_id", F.when(F.col("ring").isNull(), F.col("end")).alias("end"), F.least(total, F.lit(most)).alias("total")))
    # Paths that end at the side of another: the walk goes on from path to path.
    side = ways.where("not coalesce(mutual, false)").select(F.col("edge_id").alias("end"), F.col("ahead").alias("edge_id"))
    onto = materialise(side.join(paths, "edge_id").select(side["end"].alias("from_end"), paths["end"].alias("to_end"), F.col("total").alias("more"), F.coalesce(paths["end"], -F.col("edge_id") - 1).alias("path")))
    walk = materialise(onto.select(F.col("from_end").alias("end"), F.when(F.col("from_end") == F.col("path"), 0.0).otherwise(F.col("more")).alias("sum"), F.col("to_end").alias("here"), F.array("from_end", "path").alias("seen"), (F.col("from_end") == F.col("path")).alias("done")))
    kept = []
    while True:
        open_ = ~F.col("done") & (F.col("sum") < most) & F.col("here").isNotNull()
        kept.append(walk.where(~open_).select("end", "sum"))
        rest = walk.where(open_)
        if rest.isEmpty():
            break
        step = rest.join(onto.withColumnRenamed("from_end", "here_"), F.col("here") == F.col("here_"), "left")
        new = F.col("path").isNotNull() & ~F.coalesce(F.array_contains("seen", F.col("path")), F.lit(False))
        walk = materialise(step.select("end", F.when(new, F.col("sum") + F.col("more")).otherwise(F.col("sum")).alias("sum"), F.col("to_end").alias("here"), F.when(new, F.array_append("seen", F.col("path"))).otherwise(F.col("seen")).alias("seen"), (~new).alias("done")))
    further = kept[0]
    for part in kept[1:]:
        further = further.unionByName(part)
    whole = paths.join(further, "end", "left").select("edge_id", F.least(F.col("total") + F.coalesce("sum", F.lit(0.0)), F.lit(most)).alias("s"))
    return whole.select("edge_id", (F.col("s") / most).alias("continuity"))


def _saturated_walk(size: DataFrame, links: DataFrame, most: float, most_rounds: int = 60) -> DataFrame:
    """Sums of ``length`` along one-way pointers: ``edge_id, sum, end, low, low_at``.

    Doubled pointers; a walk rests when its sum is ``most`` or more, so that
    few rounds are needed however long a road is. ``end`` is the last edge of
    a walk that came to an end (null of one that rests), ``low`` the least edge
    that it met and ``low_at`` the sum before that edge.
    """
    begin = F.col("edge_id")
    walk = materialise(size.join(links, "edge_id", "left").select("edge_id", F.col("length").alias("sum"), F.when(F.col("length") < most, F.col("to")).alias("to"), F.when(F.col("to").isNull(), begin).alias("end"), begin.alias("low"), F.lit(0.0).alias("low_at")))
    for _ in range(most_rounds):
        moving = walk.where("to is not null")
        if moving.isEmpty():
            return walk
        step = walk.select(F.col("edge_id").alias("to"), F.col("sum").alias("b_sum"), F.col("to").alias("b_to"), F.col("end").alias("b_end"), F.col("low").alias("b_low"), F.col("low_at").alias("b_at"))
        total, lower = F.col("sum") + F.col("b_sum"), F.col("b_low") < F.col("low")
        moved = moving.join(step, "to").select(
            "edge_id", total.alias("sum"), F.when(total < most, F.col("b_to")).alias("to"), F.col("b_end").alias("end"),
            F.least("low", "b_low").alias("low"), F.when(lower, F.col("sum") + F.col("b_at")).otherwise(F.col("low_at")).alias("low_at"),
        )
        new = materialise(walk.where("to is null").unionByName(moved))
        release(walk)
        walk = new
    raise RuntimeError(f"walks did not come to rest in {most_rounds} rounds")


def stretch_linearity(edges: DataFrame, most: float = CONFIG.stretch_length, angle: float = CONFIG.stretch_angle) -> DataFrame:
    """``edge_id, stretch_linearity, stretch_curvilinearity``.

    A stretch grows from an edge by turns, first backwards, then forwards, over
    turns below ``angle``, until it is ``most`` long. Both ends are carried in
    one row, so each round is two joins on the pointer.
    """
    ends = edges.select(
        F.col("edge_id").alias("id"), "length", F.col("x1").alias("sx"), F.col("y1").alias("sy"), F.col("x2").alias("ex"), F.col("y2").alias("ey"),
        F.when(F.abs("forward_angle") < angle, F.col("next_segment")).alias("on"), F.col("previous_segment").alias("back"), F.struct("u", "v", "key").alias("at"),
        (F.abs("forward_angle") < angle).alias("straight"),
    )
    ends = materialise(ends)
    back = ends.where("straight").select(F.col("at").alias("back"), F.col("id").alias("bid"), F.col("length").alias("bl"), F.col("sx").alias("bx"), F.col("sy").alias("by"), F.col("back").alias("bb"))
    on = ends.select(F.col("at").alias("on"), F.col("id").alias("oid"), F.col("length").alias("ol"), F.col("ex").alias("ox"), F.col("ey").alias("oy"), F.col("on").alias("oo"))
    open_ = ends.select("id", F.col("length").alias("sum"), "sx", "sy", "ex", "ey", "back", "on", F.array("id").alias("seen"))
    done = None

    def grow(df: DataFrame, side: DataFrame, pointer: str, sid: str, length: str, x: str, y: str, after: str, px: str, py: str) -> DataFrame:
        j = df.join(side, pointer, "left")
        takes = F.col(sid).isNotNull() & (F.col("sum") < most) & ~F.coalesce(F.array_contains("seen", F.col(sid)), F.lit(False))
        new = {
            "sum": F.when(takes, F.col("sum") + F.col(length)).otherwise(F.col("sum")), px: F.when(takes, F.col(x)).otherwise(F.col(px)),
            py: F.when(takes, F.col(y)).otherwise(F.col(py)), pointer: F.when(takes, F.col(after)), "seen": F.when(takes, F.array_append("seen", F.col(sid))).otherwise(F.col("seen")),
        }
        return j.select(*(new.get(c, F.col(c)).alias(c) for c in df.columns))

    state = materialise(open_)
    while True:
        ready = (F.col("sum") >= most) | (F.col("back").isNull() & F.col("on").isNull())
        part = state.where(ready).select("id", "sum", "sx", "sy", "ex", "ey")
        done = part if done is None else done.unionByName(part)
        rest = state.where(~ready)
        if rest.isEmpty():
            break
        state = materialise(grow(grow(rest, back, "back", "bid", "bl", "bx", "by", "bb", "sx", "sy"), on, "on", "oid", "ol", "ox", "oy", "oo", "ex", "ey"))
    ratio = F.least(F.try_divide(hypot(F.col("sx") - F.col("ex"), F.col("sy") - F.col("ey")), F.col("sum")), F.lit(0.9999))
    value = F.log(1 / (1 - ratio)) / F.log(F.lit(1 / (1 - 0.9999)))
    return done.select(F.col("id").alias("edge_id"), value.alias("stretch_linearity"), (1 - value).alias("stretch_curvilinearity"))


def edge_neighbourhood(edges: DataFrame, steps: int, lower: bool = False, higher: bool = False, both: bool = False, starts: DataFrame | None = None, group: str = "edge_id") -> DataFrame:
    """Edges reached from each start in at most ``steps``: ``start, edge_id, step``.

    ``edges`` need ``edge_class``. A start and its inverse are at step 0; each
    step goes to the out-edges (``both``: all edges) of both ends. Edges of a
    lower or higher class than the start's are passed over unless allowed.
    ``group`` names a column whose equal values start together (such as the
    section), as one ``start``; edges of different class in it still follow
    their own class.

    The frontier is one of nodes, of which there are fewer than edges, and each
    is expanded once; edges are looked up at the end.
    """
    slim = edges.select("edge_id", "u", "v", "key", "edge_class", F.col(group).alias("start"))
    out = slim.select(F.col("u").alias("node"), F.col("edge_id").alias("to"), F.col("edge_class").alias("to_class"), F.array("u", "v").alias("ends"))
    if both:
        out = out.unionByName(slim.select(F.col("v").alias("node"), F.col("edge_id").alias("to"), F.col("edge_class").alias("to_class"), F.array("u", "v").alias("ends")))
    first = (slim if starts is None else slim.join(starts, "edge_id", "left_semi")).where("start is not null").withColumnRenamed("edge_class", "start_class")
    inverse = slim.select(F.col("edge_id").alias("inverse"), F.col("u").alias("v"), F.col("v").alias("u"), "key")
    seed = first.select("start", "edge_id").unionByName(first.join(inverse, ["u", "v", "key"]).select("start", F.col("inverse").alias("edge_id")))
    allowed = F.lit(True)
    if not lower:
        allowed = allowed & (F.col("to_class") >= F.col("start_class"))
    if not higher:
        allowed = allowed & (F.col("to_class") <= F.col("start_class"))

    def onto(nodes: DataFrame, there: DataFrame) -> DataFrame:
        if lower or higher:
            return nodes.join(there, "node").where(allowed)
        return nodes.join(there.withColumnRenamed("to_class", "start_class"), ["node", "start_class"])

    links = materialise(out.select("node", "to_class", F.explode("ends").alias("next")).where("node <> next").distinct())
    frontier = materialise(first.select("start", "start_class", F.explode(F.array("u", "v")).alias("node")).distinct().withColumn("level", F.lit(1)))
    seen, key = frontier, ["start", "start_class", "node"]
    for level in range(2, steps + 1):
        new = onto(frontier.drop("level"), links).select("start", "start_class", F.col("next").alias("node")).distinct()
        frontier = materialise(new.join(seen.select(*key), key, "left_anti").withColumn("level", F.lit(level)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    found = seed.withColumn("step", F.lit(0))
    if steps > 0:
        found = found.unionByName(onto(seen, out.drop("ends")).select("start", F.col("to").alias("edge_id"), F.col("level").alias("step")))
    return found.groupBy("start", "edge_id").agg(F.min("step").alias("step"))
