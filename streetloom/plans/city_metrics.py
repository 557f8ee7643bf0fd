"""The registry of all metrics, and the neighbourhood aggregates that follow them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streetloom.config import CONFIG
from streetloom.functions import scalars
from streetloom.graph import roads
from streetloom.operators import aggregates as agg
from streetloom.operators import buildings as b
from streetloom.operators.plots import neighbour_distance, plot_ids
from streetloom.operators.spatial import nearest_segment
from streetloom.plans.registry import Layers, Metric, Registry
from streetloom.plans.shared import materialise


def default_registry() -> Registry:
    r = Registry()

    def edge(name: str, gives: tuple[str, ...], compute, needs: tuple[str, ...] = ()) -> None:
        r.add(Metric(name, "road_edges", "edge_id", gives, compute, needs))

    def house(name: str, gives: tuple[str, ...], compute, needs: tuple[str, ...] = ()) -> None:
        r.add(Metric(name, "buildings", "id", gives, compute, needs))

    e, n, h = (lambda x: x["road_edges"]), (lambda x: x["road_nodes"]), (lambda x: x["buildings"])
    degrees = ("node_degree", "node_major_degree", "is_intersection", "is_major_intersection")
    r.add(Metric("node_degrees", "road_nodes", "node_id", degrees, lambda x: roads.node_degrees(n(x), e(x))))
    r.add(Metric("average_neighbor_degree", "road_nodes", "node_id", ("average_neighbor_degree",), lambda x: roads.average_neighbour_degree(n(x), e(x))))
    r.add(Metric("clustering", "road_nodes", "node_id", ("clustering",), lambda x: roads.square_clustering(n(x), e(x))))
    edge("speed_kph", ("speed_kph",), lambda x: e(x).select("edge_id", scalars.speed_kph(F.col("highway")).alias("speed_kph")))
    edge("travel_time", ("travel_time",), lambda x: e(x).select("edge_id", scalars.travel_time(F.col("length"), F.col("speed_kph")).alias("travel_time")), ("road_edges.speed_kph",))
    edge("bearing", ("bearing",), lambda x: roads.with_bearing(e(x)))
    pointers = ("forward_angle", "forward_angle_abs", "next_segment", "previous_segment")
    edge("forward_angle", pointers, lambda x: roads.forward_angles(e(x)))
    before = {"forward_angle": "previous_segment_forward_angle", "length": "previous_segment_length"}
    edge("previous_segment_values", tuple(before.values()), lambda x: roads.along(e(x), "previous_segment", before), ("road_edges.forward_angle",))
    edge("next_node_degree", ("next_node_degree", "next_node_major_degree"), lambda x: roads.next_node_degrees(e(x), n(x)), ("road_nodes.node_degree",))
    edge("section_id", ("section_id",), lambda x: roads.sections(e(x), n(x)), ("road_nodes.node_degree",))
    edge("major_section_id", ("major_section_id",), lambda x: roads.major_sections(e(x), n(x)), ("road_nodes.node_major_degree", "road_edges.next_segment"))
    edge("section_length", ("section_length",), lambda x: roads.section_lengths(e(x), "section_id", "section_length"), ("road_edges.section_id",))
    edge("major_section_length", ("major_section_length",), lambda x: roads.section_lengths(e(x), "major_section_id", "major_section_length"), ("road_edges.major_section_id",))
    edge("on_domain_border", ("on_domain_border",), lambda x: roads.on_domain_border(e(x), x["extents"]))
    edge("dead_end_section", ("dead_end_section",), lambda x: roads.dead_end_sections(e(x), n(x)), ("road_edges.section_id", "road_edges.on_domain_border", "road_nodes.node_degree"))
    edge("continuity", ("continuity",), lambda x: roads.continuity(e(x)), ("road_edges.forward_angle",))
    edge("stretch_linearity", ("stretch_linearity", "stretch_curvilinearity"), lambda x: roads.stretch_linearity(e(x)), ("road_edges.forward_angle",))
    edge("intersection_left_angle", ("intersection_left_angle",), lambda x: roads.left_angles(e(x), n(x)), ("road_nodes.is_intersection", "road_edges.forward_angle"))
    edge("major_intersection_left_angle", ("major_intersection_left_angle",), lambda x: roads.left_angles(e(x), n(x), True), ("road_nodes.is_major_intersection", "road_edges.forward_angle"))
    edge("distance_to_last_intersection", ("distance_to_last_intersection",), lambda x: roads.distance_to_last_intersection(e(x), n(x)), ("road_nodes.is_intersection",))
    last = {"mark": "is_major_intersection", "name": "distance_to_last_major_intersection"}
    edge("distance_to_last_major_intersection", (last["name"],), lambda x: roads.distance_to_last_intersection(e(x).where(scalars.is_major(F.col("type_category"))), n(x), **last), ("road_nodes.is_major_intersection",))
    edge("city_center_bearing", ("city_center_bearing",), lambda x: _center_bearing(x))
    edge("neighboring_street_orientation_deviation", ("neighboring_street_orientation_deviation",), lambda x: roads.orientation_deviation(e(x)))
    right = ("right_neighbour", "right_neighbour_angle_deviation", "right_neighbour_distance")
    edge("right_neighbour", right, lambda x: roads.right_neighbours(e(x)))
    edge("right_major_neighbour", tuple(c.replace("right_", "right_major_") for c in right), lambda x: roads.right_major_neighbours(e(x)))
    house("measures", ("area", "perimeter", "x", "y"), lambda x: b.measured(h(x)))
    house("frame", ("equivalent_rectangular_index", "elongation", "rectangularity", "shape_index", "circular_compactness", "orientation"), lambda x: b.framed(h(x)), ("buildings.area",))
    house("ratios", ("fractal_dimension", "perimeter_area_ratio", "squareness"), lambda x: b.simple_ratios(h(x)), ("buildings.area",))
    house("shared_walls_ratio", ("shared_walls_ratio",), lambda x: b.shared_walls(h(x)), ("buildings.perimeter",))
    house("building_group_id", ("building_group_id",), lambda x: b.building_groups(h(x)))
    house("group_spread", ("building_group_area_std", "building_group_elongation_std"), lambda x: _group_spread(h(x)), ("buildings.building_group_id", "buildings.area", "buildings.elongation"))
    house("courtyards", ("building_group_courtyard_index",), lambda x: h(x).select("id", "building_group_id").join(b.group_courtyards(h(x)), "building_group_id"), ("buildings.building_group_id",))
    shapes = ("elongation", "rectangularity", "circular_compactness", "fractal_dimension", "perimeter_area_ratio")
    r.add(Metric("enclosure_shapes", "enclosures", "enclosure_id", shapes, lambda x: b.simple_ratios(b.framed(b.measured(x["enclosures"])))))
    ratio = "enclosure_building_area_ratio"
    r.add(Metric(ratio, "enclosures", "enclosure_id", (ratio,), lambda x: b.enclosure_building_ratio(x["enclosures"], h(x)), ("buildings.enclosure_id", "buildings.area")))
    house("enclosure_id", ("enclosure_id",), lambda x: b.largest_enclosure(h(x), x["enclosures"]))
    house("land_use_category", ("land_use_category",), lambda x: b.landuse_of(h(x), x["landuse"]))
    house("closest_road_edge_id", ("closest_road_edge_id",), lambda x: nearest_segment(h(x), e(x), CONFIG.nearest_street, "id", "edge_id").withColumnRenamed("edge_id", "closest_road_edge_id"), ("buildings.x",))
    house("plot_id", ("plot_id",), lambda x: plot_ids(h(x), e(x), h(x).select("id", F.col("closest_road_edge_id").alias("edge_id"))), ("buildings.closest_road_edge_id", "buildings.area"))
    house("neighbor_distance", ("neighbor_distance",), lambda x: neighbour_distance(h(x) if "city" in h(x).columns else h(x).withColumn("city", F.lit(""))))
    house("coverage", ("building_group_enclosure_perimeter_coverage",), lambda x: h(x).select("id", "building_group_id").join(b.perimeter_coverage(h(x), x["enclosures"]), "building_group_id", "left"), ("buildings.building_group_id",))
    house("approximate_height", ("approximate_height",), lambda x: _height(h(x)))
    house("form_factor", ("form_factor",), lambda x: h(x).select("id", b.form_factor(F.col("area"), F.col("perimeter"), F.col("approximate_height")).alias("form_factor")), ("buildings.area", "buildings.approximate_height"))
    house("neighbours", ("alignment", "covered_area"), lambda x: b.neighbour_metrics(h(x)), ("buildings.orientation", "buildings.x"))
    return r


def _group_spread(h: DataFrame) -> DataFrame:
    out = agg.group_spread(h.select("id", "building_group_id", "area", "elongation"), "building_group_id", ["area", "elongation"])
    return out.withColumnsRenamed({"area_std": "building_group_area_std", "elongation_std": "building_group_elongation_std"})


def _center_bearing(x: Layers) -> DataFrame:
    """The city centre is one row, read on the driver."""
    c = x["city_center"].select("x", "y").first()
    return roads.city_center_bearing(x["road_edges"], F.lit(c.x), F.lit(c.y))


def _height(h: DataFrame) -> DataFrame:
    tags = [F.col(c) if c in h.columns else None for c in ("real_height", "real_levels")]
    return h.select("id", scalars.approximate_height(*tags, F.col("ghsl_height")).alias("approximate_height"))


# --- neighbourhoods of streets -------------------------------------------------

REGULAR_MEANS = [
    "stretch_linearity", "forward_angle", "continuity", "stretch_curvilinearity", "intersection_left_angle", "right_neighbour_angle_deviation",
    "right_neighbour_distance", "forward_angle_abs", "neighboring_street_orientation_deviation", "section_length",
]
REGULAR_WEIGHTED = ["stretch_curvilinearity", "continuity", "right_neighbour_angle_deviation", "right_neighbour_distance", "forward_angle_abs", "section_length"]
MAJOR_MEANS = ["right_major_neighbour_angle_deviation", "right_major_neighbour_distance", "major_section_length"]
MAJOR_WEIGHTED = ["stretch_curvilinearity", "continuity", "right_major_neighbour_angle_deviation", "right_major_neighbour_distance", "forward_angle_abs"]


def street_context(edges: DataFrame, major: bool = False) -> DataFrame:
    """Aggregates over the streets around each section, beside every edge of it.

    A section's neighbourhood is what its edges reach in five steps over edges
    of their class (``major``: seven steps among major roads, higher classes
    allowed). Aggregates are weighted by length; a missing distance to the
    right counts as 300. Source columns that do not exist are left out.
    """
    suffix, section = ("::nb_major::", "major_section_id") if major else ("::nb::", "section_id")
    means, weighted = (MAJOR_MEANS, MAJOR_WEIGHTED) if major else (REGULAR_MEANS, REGULAR_WEIGHTED)
    rows = edges.withColumn("edge_class", scalars.edge_class(F.col("highway")))
    if major:
        rows = rows.where(scalars.is_major(F.col("type_category")))
    elif "right_neighbour_distance" in rows.columns:
        rows = rows.fillna(300.0, ["right_neighbour_distance"])
    has = lambda names: [c for c in names if c in rows.columns]
    reached = roads.edge_neighbourhood(rows, CONFIG.major_steps if major else CONFIG.regular_steps, higher=major, group=section)
    other = rows.where(F.col(section).isNotNull()).select("edge_id", F.col(section).alias("other"))
    pairs = reached.join(other, "edge_id").select(F.col("start").alias("focal"), "other").distinct()
    used = dict.fromkeys([*has(means), *has(weighted), "length", "bearing", *has(["dead_end_section", "continuity"])])
    members = materialise(pairs.join(rows.select(F.col(section).alias("other"), *used), "other"))  # three aggregates read it
    plain = agg.mean_std(has(means), suffix, ("forward_angle_abs",)) + [agg.weighted_mean(F.col(c), F.col("length")).alias(f"{c}{suffix}weighted_mean") for c in has(weighted)]
    plain.append(agg.cardinal_share(F.col("bearing")).alias("bearing_cardinality" + suffix[:-2]))
    if "dead_end_section" in rows.columns and not major:
        plain.append(agg.weighted_share(F.col("dead_end_section"), F.col("length")).alias(f"dead_end_sections{suffix}weighted_percentage"))
    out = members.groupBy("focal").agg(*plain)
    out = out.join(agg.angle_entropy(members, ["focal"], "bearing", "length", "angle_entropy" + suffix[:-2]), "focal", "left")
    if "continuity" in rows.columns:
        out = out.join(agg.weighted_median(members, ["focal"], "continuity", "length", f"continuity{suffix}weighted_median"), "focal", "left")
    return edges.select("edge_id", F.col(section).alias("focal")).join(out, "focal", "left").drop("focal")


# --- neighbourhoods of buildings -----------------------------------------------

BUILDING_MEANS = [
    "area", "building_group_enclosure_perimeter_coverage", "shared_walls_ratio", "shape_index", "equivalent_rectangular_index", "elongation",
    "covered_area", "alignment", "squareness",
]


def building_context(h: DataFrame, by: list[str] = ()) -> DataFrame:
    """Aggregates over the buildings within 300 m, with ``::nb_radius_300::`` in their names."""
    s = "::nb_radius_300::"
    has = lambda names: [c for c in names if c in h.columns]
    out = agg.mean_std(has(BUILDING_MEANS), s) + [F.avg(c).alias(f"{c}{s}mean") for c in has(["building_group_elongation_std", "building_group_area_std"])]
    if "approximate_height" in h.columns:
        out += [f("approximate_height").alias(f"approximate_height{s}{n}") for f, n in ((F.avg, "mean"), (F.stddev_samp, "std"), (F.max, "max"))]
    if "land_use_category" in h.columns:
        out.append(F.mode(F.col("land_use_category"), True).alias(f"land_use_category{s}mode"))
    return b.radius_context(h, out, CONFIG.building_radius, list(by))


def influence_templates(df: DataFrame, cluster: str, histograms: list[str], influences: list[str]) -> DataFrame:
    """For each cluster, histogram column and bin: its probability, and the best-fitting distribution of each influence in it.

    ``cluster, histogram, bin, low, high, probability, median, influence, fit``.
    """
    import pandas as pd

    from streetloom.functions.kernels import fit_distribution

    fit_type = "struct<name:string,a:double,b:double,error:double,ks:double,quality:string>"

    def one(key, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(*key, fit_distribution(pdf["value"].dropna().to_numpy(float)))], columns=["cluster", "histogram", "bin", "influence", "fit"])

    parts = F.array(*(F.struct(F.lit(c).alias("histogram"), F.col(f"`{c}`").cast("double").alias("x")) for c in histograms))
    long = df.where(F.col(cluster).isNotNull()).select(F.col(cluster).cast("string").alias("cluster"), *(F.col(f"`{c}`").alias(c) for c in influences), F.inline(parts)).where("x is not null")
    bins = agg.probability_histogram(long, ["cluster", "histogram"], "x")
    edges = bins.select("cluster", "histogram", "bin", "low", "high")
    values = F.array(*(F.struct(F.lit(c).alias("influence"), F.col(f"`{c}`").cast("double").alias("value")) for c in influences))
    inside = long.join(edges, ["cluster", "histogram"]).where((F.col("x") >= F.col("low")) & (F.col("x") < F.col("high"))).select("cluster", "histogram", "bin", F.inline(values))
    fits = inside.groupBy("cluster", "histogram", "bin", "influence").applyInPandas(one, f"cluster string, histogram string, bin int, influence string, fit {fit_type}")
    return bins.join(fits, ["cluster", "histogram", "bin"], "left")
