"""Road-graph queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streetloom.fixtures import road_edges, road_nodes, with_ctes
from streetloom.functions.scalars import edge_class
from streetloom.graph import roads
from streetloom.plans.shared import materialise
from streetloom.queries.base import Registered, r6, sql6

REGISTERED = Registered()
query = REGISTERED.query


def _degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roads.node_degrees(road_nodes(spark, sf_dir), road_edges(spark, sf_dir))


def _pointed(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = road_edges(spark, sf_dir)
    return e.join(roads.forward_angles(e), "edge_id")


@query(with_ctes(["degrees_"], "SELECT node_id, node_degree, node_major_degree, node_degree > 2 AS is_intersection, node_major_degree > 2 AS is_major_intersection FROM degrees_"))
def node_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _degrees(spark, sf_dir)


@query(with_ctes(["edges"], f""", l AS (SELECT DISTINCT u, v FROM edges), d AS (SELECT u, count(*) AS d FROM edges GROUP BY u) SELECT node_id, {sql6('coalesce(avg(CASE WHEN l.v IS NOT NULL THEN coalesce(d.d, 0) END), 0)', 'average_neighbor_degree')}
  FROM nodes LEFT JOIN l ON l.u = node_id LEFT JOIN d ON d.u = l.v GROUP BY node_id"""))
def average_neighbor_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roads.average_neighbour_degree(road_nodes(spark, sf_dir), road_edges(spark, sf_dir)).select("node_id", r6("average_neighbor_degree", "average_neighbor_degree"))


@query(with_ctes(["edges"], f""", near AS (SELECT DISTINCT u AS n, v AS w FROM edges WHERE u <> v), d AS (SELECT n, count(*) AS d FROM near GROUP BY n),
  pairs AS (SELECT x.n, x.w AS a, y.w AS b, coalesce(da.d, 0) AS da, coalesce(db.d, 0) AS db, (SELECT count(*) FROM near p JOIN near q ON p.w = q.w WHERE p.n = x.w AND q.n = y.w AND p.w <> x.n) AS q, CASE WHEN EXISTS (SELECT 1 FROM near k WHERE k.n = x.w AND k.w = y.w) THEN 1 ELSE 0 END AS linked
    FROM near x JOIN near y ON x.n = y.n AND x.w < y.w LEFT JOIN d da ON da.n = x.w LEFT JOIN d db ON db.n = y.w)
  SELECT node_id, {sql6('coalesce(CASE WHEN sum(da + db - 2 * (q + 1 + linked) + q) > 0 THEN sum(q) * 1.0 / sum(da + db - 2 * (q + 1 + linked) + q) END, 0)', 'clustering')} FROM nodes LEFT JOIN pairs ON n = node_id GROUP BY node_id"""))
def square_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roads.square_clustering(road_nodes(spark, sf_dir), road_edges(spark, sf_dir)).select("node_id", r6("clustering", "clustering"))


@query(with_ctes(["edges"], f"SELECT edge_id, {sql6('length', 'length')}, {sql6('degrees(atan2(y2 - y1, x2 - x1))', 'bearing')} FROM edges"))
def bearings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roads.with_bearing(road_edges(spark, sf_dir)).select("edge_id", r6("length", "length"), r6("bearing", "bearing"))


@query(with_ctes(["forward"], f"""SELECT f.edge_id, {sql6('forward_angle', 'forward_angle')}, {sql6('abs(forward_angle)', 'forward_angle_abs')}, CASE WHEN f.w IS NOT NULL THEN f.v END AS next_u, f.w AS next_v, p.pu AS previous_u, p.pk AS previous_key FROM forward f LEFT JOIN (
  SELECT v, w AS to_, u AS pu, key AS pk FROM (SELECT *, row_number() OVER (PARTITION BY v, w ORDER BY u DESC, key DESC) AS rn FROM forward WHERE w IS NOT NULL) WHERE rn = 1) p ON p.v = f.u AND p.to_ = f.v AND f.key = 0"""))
def forward_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = roads.forward_angles(road_edges(spark, sf_dir))
    return found.select(
        "edge_id", r6("forward_angle", "forward_angle"), r6("forward_angle_abs", "forward_angle_abs"), F.col("next_segment.u").alias("next_u"), F.col("next_segment.v").alias("next_v"),
        F.col("previous_segment.u").alias("previous_u"), F.col("previous_segment.key").alias("previous_key"),
    )


@query(with_ctes(["forward"], f"""SELECT f.edge_id, {sql6('p.forward_angle', 'previous_segment_forward_angle')}, {sql6('p.length', 'previous_segment_length')} FROM forward f LEFT JOIN (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY v, w ORDER BY u DESC, key DESC) AS rn FROM forward WHERE w IS NOT NULL) WHERE rn = 1) p ON p.v = f.u AND p.w = f.v AND f.key = 0"""))
def previous_segment_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = roads.along(_pointed(spark, sf_dir), "previous_segment", {"forward_angle": "a", "length": "l"})
    return found.select("edge_id", r6("a", "previous_segment_forward_angle"), r6("l", "previous_segment_length"))


@query(with_ctes(["degrees_"], "SELECT edge_id, node_degree AS next_node_degree, node_major_degree AS next_node_major_degree FROM edges JOIN degrees_ ON node_id = v"))
def next_node_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roads.next_node_degrees(road_edges(spark, sf_dir), _degrees(spark, sf_dir))


@query(with_ctes(["forward", "degrees_"], f"""SELECT f.edge_id, {sql6('CASE WHEN node_degree > 2 AND m.turn >= 0 AND (f.forward_angle IS NULL OR m.turn <> f.forward_angle) THEN m.turn END', 'intersection_left_angle')}
  FROM forward f JOIN degrees_ ON node_id = f.v LEFT JOIN (SELECT edge_id, max(angle) AS turn FROM turns GROUP BY edge_id) m USING (edge_id)"""))
def left_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roads.left_angles(_pointed(spark, sf_dir), _degrees(spark, sf_dir)).select("edge_id", r6("intersection_left_angle", "intersection_left_angle"))


@query()
def major_left_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roads.left_angles(_pointed(spark, sf_dir), _degrees(spark, sf_dir), True).select("edge_id", r6("major_intersection_left_angle", "major_intersection_left_angle"))


@query(with_ctes(["edges"], f"""SELECT edge_id, {sql6('CASE WHEN a > 90 THEN 180 - a ELSE a END', 'city_center_bearing')} FROM (SELECT edge_id, (180 - degrees(acos(greatest(-1, least(1, ((x1 - x2) * (1000 - x2) + (y1 - y2) * (900 - y2)) / (sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2)) * sqrt((1000 - x2) * (1000 - x2) + (900 - y2) * (900 - y2)))))))) AS a FROM edges)"""))
def city_center_bearings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roads.city_center_bearing(road_edges(spark, sf_dir), F.lit(1000.0), F.lit(900.0)).select("edge_id", r6("city_center_bearing", "city_center_bearing"))


@query(with_ctes(["edges"], f""", n AS (SELECT edge_id, u AS node, axis FROM a UNION ALL SELECT edge_id, v, axis FROM a), a AS (SELECT edge_id, u, v, b - 180 * floor(b / 180) AS axis FROM (SELECT edge_id, u, v, degrees(atan2(y2 - y1, x2 - x1)) AS b FROM edges)),
  p AS (SELECT DISTINCT x.edge_id, y.edge_id AS o, abs(x.axis - y.axis) AS d FROM n x JOIN n y ON x.node = y.node AND x.edge_id <> y.edge_id) SELECT edge_id, {sql6('avg(CASE WHEN d > 90 THEN 180 - d ELSE d END)', 'deviation')} FROM edges LEFT JOIN p USING (edge_id) GROUP BY edge_id""".replace(", n AS", ", a AS (SELECT edge_id, u, v, b - 180 * floor(b / 180) AS axis FROM (SELECT edge_id, u, v, degrees(atan2(y2 - y1, x2 - x1)) AS b FROM edges)), n AS").replace(" UNION ALL SELECT edge_id, v, axis FROM a), a AS (SELECT edge_id, u, v, b - 180 * floor(b / 180) AS axis FROM (SELECT edge_id, u, v, degrees(atan2(y2 - y1, x2 - x1)) AS b FROM edges)),", " UNION ALL SELECT edge_id, v, axis FROM a),")))
def orientation_deviations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roads.orientation_deviation(road_edges(spark, sf_dir)).select("edge_id", r6("neighboring_street_orientation_deviation", "deviation"))


def _extent(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(-1100.0, -1100.0, 2500.0, 2400.0)], "minx double, miny double, maxx double, maxy double")


@query(with_ctes(["edges"], "SELECT edge_id, least(abs(least(x1, x2) + 1100), abs(2500 - greatest(x1, x2)), abs(least(y1, y2) + 1100), abs(2400 - greatest(y1, y2))) < 1000 AS on_domain_border FROM edges"))
def domain_border(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roads.on_domain_border(road_edges(spark, sf_dir), _extent(spark))


_SECTIONS = """, link AS (SELECT a.edge_id AS a, b.edge_id AS b FROM edges a JOIN degrees_ ON node_id = a.v AND node_degree = 2 JOIN edges b ON b.u = a.v AND b.v <> a.u AND b.key = 0 WHERE a.key = 0),
  both_ AS (SELECT a, b FROM link UNION SELECT b, a FROM link), reach(id, to_) AS (SELECT edge_id, edge_id FROM edges UNION SELECT r.id, b FROM reach r JOIN both_ ON a = r.to_), section AS (SELECT id AS edge_id, min(to_) AS section_id FROM reach GROUP BY id)"""


@query(with_ctes(["degrees_"], _SECTIONS + f" SELECT edge_id, section_id, {sql6('sum(length) OVER (PARTITION BY section_id)', 'section_length')} FROM section JOIN edges USING (edge_id)", recursive=True))
def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = road_edges(spark, sf_dir)
    found = e.join(roads.sections(e, _degrees(spark, sf_dir)), "edge_id")
    return found.select("edge_id", "section_id").join(roads.section_lengths(found, "section_id", "section_length"), "edge_id").select("edge_id", "section_id", r6("section_length", "section_length"))


@query(with_ctes(["degrees_"], _SECTIONS + """ SELECT edge_id, coalesce(max(CASE WHEN NOT border AND (a.node_degree = 1 OR b.node_degree = 1) THEN 1 ELSE 0 END) OVER (PARTITION BY section_id) = 1, false) AS dead_end_section FROM (SELECT *, least(abs(least(x1, x2) + 1100), abs(2500 - greatest(x1, x2)), abs(least(y1, y2) + 1100), abs(2400 - greatest(y1, y2))) < 1000 AS border FROM edges)
  JOIN section USING (edge_id) JOIN degrees_ a ON a.node_id = u JOIN degrees_ b ON b.node_id = v""", recursive=True))
def dead_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, n = road_edges(spark, sf_dir), _degrees(spark, sf_dir)
    full = e.join(roads.sections(e, n), "edge_id").join(roads.on_domain_border(e, _extent(spark)), "edge_id")
    return roads.dead_end_sections(full, n)


@query()
def major_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _pointed(spark, sf_dir)
    found = e.join(roads.major_sections(e, _degrees(spark, sf_dir)), "edge_id")
    return found.select("edge_id", "major_section_id").join(roads.section_lengths(found, "major_section_id", "major_section_length"), "edge_id").select("edge_id", "major_section_id", r6("major_section_length", "major_section_length"))


@query(with_ctes(["degrees_"], f""", back AS (SELECT edge_id, to_ FROM (SELECT a.edge_id, p.edge_id AS to_, row_number() OVER (PARTITION BY a.edge_id ORDER BY p.u) AS rn FROM edges a JOIN degrees_ ON node_id = a.u AND node_degree <= 2 JOIN edges p ON p.v = a.u AND p.u <> a.v AND p.key = 0) WHERE rn = 1),
  walk(edge_id, here, total, step) AS (SELECT edge_id, edge_id, length, 0 FROM edges UNION ALL SELECT w.edge_id, b.to_, w.total + e.length, w.step + 1 FROM walk w JOIN back b ON b.edge_id = w.here JOIN edges e ON e.edge_id = b.to_ WHERE w.step < 200)
  SELECT edge_id, {sql6('CASE WHEN max(step) < 200 THEN max(total) END', 'distance')} FROM walk GROUP BY edge_id""", recursive=True))
def distance_to_last_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = roads.distance_to_last_intersection(road_edges(spark, sf_dir), _degrees(spark, sf_dir))
    return found.select("edge_id", r6("distance_to_last_intersection", "distance"))


_LINKS = """, straight AS (SELECT f.*, e.edge_id AS next_id FROM forward f JOIN edges e ON e.u = f.v AND e.v = f.w AND e.key = 0 WHERE abs(f.forward_angle) < 25), prev AS (SELECT f.edge_id, p.edge_id AS prev_id FROM forward f JOIN (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY v, w ORDER BY u DESC, key DESC) AS rn FROM forward WHERE w IS NOT NULL) WHERE rn = 1) p ON p.v = f.u AND p.w = f.v AND f.key = 0 WHERE abs(p.forward_angle) < 25), link AS (SELECT edge_id AS a, next_id AS b FROM straight UNION SELECT edge_id, prev_id FROM prev)"""


@query(with_ctes(["forward"], _LINKS + f""", reach(id, to_, step) AS (SELECT edge_id, edge_id, 0 FROM edges UNION SELECT r.id, b, step + 1 FROM reach r JOIN link ON a = r.to_ WHERE step < 16)
  SELECT id AS edge_id, {sql6('least(sum(length), 1000) / 1000', 'continuity')} FROM (SELECT DISTINCT id, to_ FROM reach) JOIN edges ON edge_id = to_ GROUP BY id""", recursive=True))
def continuity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roads.continuity(_pointed(spark, sf_dir)).select("edge_id", r6("continuity", "continuity"))


@query()
def stretch_linearity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roads.stretch_linearity(_pointed(spark, sf_dir)).select("edge_id", r6("stretch_linearity", "stretch_linearity"), r6("stretch_curvilinearity", "stretch_curvilinearity"))


_SIDE = "sign(({2} - {0}) * ({5} - {1}) - ({3} - {1}) * ({4} - {0}))".format
_RAY, _TO = ("rx1", "ry1", "rx2", "ry2"), ("e.x1", "e.y1", "e.x2", "e.y2")


def _right_sql(rows: str, reach: float, test: str, offset: float, name: str) -> str:
    cross = f"{_SIDE(*_RAY, 'e.x1', 'e.y1')} * {_SIDE(*_RAY, 'e.x2', 'e.y2')} < 0 AND {_SIDE(*_TO, 'rx1', 'ry1')} * {_SIDE(*_TO, 'rx2', 'ry2')} < 0"
    t = "greatest(0, least(1, ((cx - e.x1) * (e.x2 - e.x1) + (cy - e.y1) * (e.y2 - e.y1)) / (e.length * e.length)))"
    return f""", roads AS (SELECT * FROM edges WHERE {rows}), rays AS (SELECT *, cx - uy * skip AS rx1, cy + ux * skip AS ry1, cx - uy * {reach} AS rx2, cy + ux * {reach} AS ry2 FROM (SELECT *, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy, (x2 - x1) / length AS ux, (y2 - y1) / length AS uy, CASE WHEN length > {offset} THEN {offset} ELSE 0.0 END AS skip FROM roads)),
  hits AS (SELECT r.edge_id, e.u, e.v, e.key, {t} AS t, cx, cy, e.x1, e.y1, e.x2, e.y2 FROM rays r JOIN roads e ON e.edge_id <> r.edge_id AND greatest(rx1, rx2) >= least(e.x1, e.x2) AND greatest(e.x1, e.x2) >= least(rx1, rx2) AND greatest(ry1, ry2) >= least(e.y1, e.y2) AND greatest(e.y1, e.y2) >= least(ry1, ry2) AND {cross}),
  near AS (SELECT *, row_number() OVER (PARTITION BY edge_id ORDER BY d, u, v, key) AS rn FROM (SELECT *, sqrt(power(x1 + t * (x2 - x1) - cx, 2) + power(y1 + t * (y2 - y1) - cy, 2)) AS d FROM hits) WHERE d {test})
  SELECT edge_id, {sql6('d', 'gap')} FROM edges LEFT JOIN (SELECT * FROM near WHERE rn = 1) {name} USING (edge_id)"""


@query(with_ctes(["edges"], _right_sql("true", 300, ">= 6", 1.0, "n")))
def right_neighbour_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance of the middle to the neighbour on the right (the neighbour itself may be either direction of a street)."""
    return _gaps(road_edges(spark, sf_dir), roads.right_neighbours(road_edges(spark, sf_dir)), "right_neighbour")


@query(with_ctes(["edges"], _right_sql("type_category IN ('major', 'highway')", 2000, "> 50", 0.0, "n")))
def right_major_neighbour_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gaps(road_edges(spark, sf_dir), roads.right_major_neighbours(road_edges(spark, sf_dir)), "right_major_neighbour")


def _gaps(e: DataFrame, found: DataFrame, pointer: str) -> DataFrame:
    from streetloom.functions.geometry import segment_distance_squared

    other = e.select(F.struct("u", "v", "key").alias(pointer), *(F.col(c).alias("o" + c) for c in roads.LINE))
    both = e.join(found.select("edge_id", pointer), "edge_id").join(other, pointer, "left")
    gap = F.sqrt(segment_distance_squared((F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2, *(F.col("o" + c) for c in roads.LINE)))
    return both.select("edge_id", F.when(F.col(pointer).isNotNull(), F.round(gap, 6) + F.lit(0.0)).alias("gap"))


@query()
def right_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = roads.right_neighbours(road_edges(spark, sf_dir))
    return found.select("edge_id", F.col("right_neighbour.u").alias("u"), F.col("right_neighbour.v").alias("v"), r6("right_neighbour_angle_deviation", "angle_deviation"), r6("right_neighbour_distance", "distance"))


@query(with_ctes(["edges"], """, c AS (SELECT edge_id, u, v, key, CASE WHEN highway IN ('motorway') THEN 4 WHEN highway IN ('primary','secondary','tertiary') THEN 3 WHEN highway IN ('living_street','residential','service') THEN 2 ELSE 1 END AS k FROM edges),
  reach(start, k, id, step) AS (SELECT edge_id, k, edge_id, 0 FROM c UNION SELECT a.edge_id, a.k, b.edge_id, 0 FROM c a JOIN c b ON b.u = a.v AND b.v = a.u AND b.key = a.key
    UNION SELECT r.start, r.k, o.edge_id, r.step + 1 FROM reach r JOIN c e ON e.edge_id = r.id JOIN c o ON (o.u = e.u OR o.u = e.v) AND o.k = r.k WHERE r.step < 5)
  SELECT start, count(DISTINCT id) AS n, CAST(sum(DISTINCT id) AS BIGINT) AS ids FROM reach GROUP BY start""", recursive=True))
def edge_bfs_5(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = road_edges(spark, sf_dir).withColumn("edge_class", edge_class(F.col("highway")))
    return roads.edge_neighbourhood(e, 5).groupBy("start").agg(F.count("*").alias("n"), F.sum("edge_id").alias("ids"))


@query()
def street_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    from streetloom.plans.city_metrics import street_context as context

    e, n = materialise(_pointed(spark, sf_dir)), _degrees(spark, sf_dir)
    e = materialise(roads.with_bearing(e.join(roads.sections(e, n), "edge_id")))
    e = e.join(roads.section_lengths(e, "section_id", "section_length"), "edge_id").join(roads.right_neighbours(e).select("edge_id", "right_neighbour_distance"), "edge_id")
    return context(materialise(e))
