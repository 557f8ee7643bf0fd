"""Buildings, enclosures, grids, rasters, clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streetloom.fixtures import AFFINE, buildings, enclosures, landuse, raster, road_edges, table, with_ctes
from streetloom.functions import geometry as g
from streetloom.operators import buildings as b
from streetloom.operators import grid as gr
from streetloom.operators import learning, plots
from streetloom.operators.spatial import nearest_neighbours, nearest_segment
from streetloom.plans.shared import materialise
from streetloom.queries.base import Registered, r6, sql6
from streetloom.sources.city import tiles_of

REGISTERED = Registered()
query = REGISTERED.query


def houses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.measured(buildings(spark, sf_dir))


@query(with_ctes(["buildings"], f"""SELECT a.id, {sql6('avg(b.area)', 'area_mean')}, {sql6('stddev_samp(b.area)', 'area_std')}, {sql6('max(b.ghsl_height)', 'height_max')}, count(*) AS n
  FROM buildings a JOIN buildings b ON (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 90000 GROUP BY a.id"""))
def radius300_area_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = houses(spark, sf_dir).select("id", "x", "y", "area", "ghsl_height")
    found = b.radius_context(h, [F.avg("area").alias("m"), F.stddev_samp("area").alias("s"), F.max("ghsl_height").alias("h"), F.count("*").alias("n")])
    return found.select("id", r6("m", "area_mean"), r6("s", "area_std"), r6("h", "height_max"), "n")


@query(with_ctes(["buildings"], f"""SELECT id, area, CAST(perimeter AS DOUBLE) AS perimeter, x, y, true AS rectangle, {sql6('2 * ln(perimeter / 4) / ln(area)', 'fractal_dimension')}, {sql6('perimeter / area', 'perimeter_area_ratio')},
  {sql6('0', 'squareness')}, {sql6('(perimeter * ghsl_height + area) / power(area * ghsl_height, 2.0 / 3)', 'form_factor')} FROM buildings"""))
def building_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = b.simple_ratios(houses(spark, sf_dir))
    factor = b.form_factor(F.col("area"), F.col("perimeter"), F.col("ghsl_height"))
    return h.select("id", "area", "perimeter", "x", "y", g.is_rectangle(F.col("geom")).alias("rectangle"), r6("fractal_dimension", "fractal_dimension"), r6("perimeter_area_ratio", "perimeter_area_ratio"), r6("squareness", "squareness"), r6(factor, "form_factor"))


@query(with_ctes(["buildings"], f"""SELECT id, {sql6('1', 'equivalent_rectangular_index')}, {sql6('least(8, h) / greatest(8, h)', 'elongation')}, {sql6('1', 'rectangularity')}, {sql6('sqrt(area / pi()) / (sqrt(64 + h * h) / 2)', 'shape_index')},
  {sql6('area / (pi() * (64 + h * h) / 4)', 'circular_compactness')}, {sql6('0', 'orientation')} FROM buildings"""))
def building_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["equivalent_rectangular_index", "elongation", "rectangularity", "shape_index", "circular_compactness", "orientation"]
    return b.framed(houses(spark, sf_dir)).select("id", *(r6(n, n) for n in names))


_TOUCH = "touch AS (SELECT a.id AS a, b.id AS b FROM buildings a JOIN buildings b ON a.id <> b.id AND a.id // 4 = b.id // 4 AND a.minx <= b.maxx AND b.minx <= a.maxx AND a.miny <= b.maxy AND b.miny <= a.maxy)"


@query(with_ctes(["buildings"], "SELECT a.id AS a, b.id AS b FROM buildings a JOIN buildings b ON a.id < b.id AND a.minx <= b.maxx AND b.minx <= a.maxx AND a.miny <= b.maxy AND b.miny <= a.maxy"))
def touching_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.touching(buildings(spark, sf_dir))


@query(with_ctes(["buildings"], f", {_TOUCH}, reach(id, to_) AS (SELECT id, id FROM buildings UNION SELECT r.id, t.b FROM reach r JOIN touch t ON t.a = r.to_) SELECT id, min(to_) AS building_group_id FROM reach GROUP BY id", recursive=True))
def building_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.building_groups(buildings(spark, sf_dir))


@query(with_ctes(["buildings"], f"SELECT a.id, {sql6('coalesce(sum(CASE WHEN b.id IS NULL THEN 0 ELSE least(a.maxy, b.maxy) - greatest(a.miny, b.miny) END), 0) / any_value(a.perimeter)', 'shared_walls_ratio')} FROM buildings a LEFT JOIN buildings b ON a.id <> b.id AND (a.maxx = b.minx OR b.maxx = a.minx) AND a.miny < b.maxy AND b.miny < a.maxy GROUP BY a.id"))
def shared_walls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.shared_walls(houses(spark, sf_dir)).select("id", r6("shared_walls_ratio", "shared_walls_ratio"))


@query(with_ctes(["buildings"], f""", {_TOUCH}, reach(id, to_) AS (SELECT id, id FROM buildings UNION SELECT r.id, t.b FROM reach r JOIN touch t ON t.a = r.to_), groups_ AS (SELECT id, min(to_) AS building_group_id FROM reach GROUP BY id)
  SELECT building_group_id, {sql6('sum(area)', 'building_group_area')}, {sql6('0', 'building_group_courtyard_index')}, {sql6('stddev_samp(area)', 'building_group_area_std')} FROM groups_ JOIN buildings USING (id) GROUP BY building_group_id""", recursive=True))
def group_dissolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = materialise(houses(spark, sf_dir).select("id", "area", "geom", "minx", "miny", "maxx", "maxy"))
    pairs = materialise(b.touching(h))
    grouped = materialise(h.join(b.building_groups(h, pairs), "id"))
    spread = grouped.groupBy("building_group_id").agg(F.stddev_samp("area").alias("s"))
    found = b.group_courtyards(grouped, pairs).join(spread, "building_group_id")
    return found.select("building_group_id", r6("building_group_area", "building_group_area"), r6("building_group_courtyard_index", "building_group_courtyard_index"), r6("s", "building_group_area_std"))


_MEET = "a.minx <= e.maxx AND e.minx <= a.maxx AND a.miny <= e.maxy AND e.miny <= a.maxy"


@query(with_ctes(["buildings", "enclosures"], f"SELECT id, enclosure_id FROM buildings LEFT JOIN (SELECT a.id, e.enclosure_id, row_number() OVER (PARTITION BY a.id ORDER BY e.area DESC, e.enclosure_id) AS rn FROM buildings a JOIN enclosures e ON {_MEET}) b USING (id) WHERE coalesce(rn, 1) = 1"))
def largest_enclosures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.largest_enclosure(buildings(spark, sf_dir), enclosures(spark, sf_dir))


@query(with_ctes(["buildings", "enclosures"], f"""SELECT e.enclosure_id, {sql6('coalesce(sum(b.area), 0) / any_value(e.area)', 'ratio')} FROM enclosures e LEFT JOIN (SELECT id, area, enclosure_id FROM (SELECT a.id, a.area, e.enclosure_id, row_number() OVER (PARTITION BY a.id ORDER BY e.area DESC, e.enclosure_id) AS rn
  FROM buildings a JOIN enclosures e ON {_MEET}) WHERE rn = 1) b ON b.enclosure_id = e.enclosure_id GROUP BY e.enclosure_id"""))
def enclosure_building_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    h, e = houses(spark, sf_dir), enclosures(spark, sf_dir)
    found = b.enclosure_building_ratio(e, h.select("id", "area").join(b.largest_enclosure(h, e), "id"))
    return found.select("enclosure_id", r6("enclosure_building_area_ratio", "ratio"))


@query(with_ctes(["enclosures"], f"""SELECT enclosure_id, {sql6('least(maxx - minx, maxy - miny) / greatest(maxx - minx, maxy - miny)', 'elongation')}, {sql6('2 / pi()', 'circular_compactness')}, {sql6('4 * (maxx - minx) / area', 'perimeter_area_ratio')}, {sql6('2 * ln(maxx - minx) / ln(area)', 'fractal_dimension')} FROM enclosures"""))
def enclosure_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = b.simple_ratios(b.framed(b.measured(enclosures(spark, sf_dir))))
    return e.select("enclosure_id", *(r6(n, n) for n in ("elongation", "circular_compactness", "perimeter_area_ratio", "fractal_dimension")))


@query(with_ctes(["buildings", "landuse"], f"SELECT id, landuse_class AS land_use_category FROM buildings LEFT JOIN (SELECT a.id, e.landuse_class, row_number() OVER (PARTITION BY a.id ORDER BY e.landuse_id) AS rn FROM buildings a JOIN landuse e ON {_MEET}) b USING (id) WHERE coalesce(rn, 1) = 1"))
def land_use_of_buildings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.landuse_of(buildings(spark, sf_dir), landuse(spark, sf_dir))


_GAP = """power(x - x1 - t * (x2 - x1), 2) + power(y - y1 - t * (y2 - y1), 2)"""


@query(with_ctes(["buildings", "edges"], f"""SELECT id, edge_id, {sql6('sqrt(d)', 'distance')} FROM (SELECT id, edge_id, d, row_number() OVER (PARTITION BY id ORDER BY round(d, 9), edge_id) AS rn FROM (SELECT id, edge_id, {_GAP} AS d FROM (
  SELECT id, x, y, edge_id, x1, y1, x2, y2, greatest(0, least(1, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / (length * length))) AS t FROM buildings JOIN edges ON least(x1, x2) - 200 <= x AND x <= greatest(x1, x2) + 200 AND least(y1, y2) - 200 <= y AND y <= greatest(y1, y2) + 200)) WHERE d <= 40000) WHERE rn = 1""").replace("edge_id, {", "edge_id, {").replace("SELECT id, edge_id, round", "SELECT id, round"))
def nearest_streets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = nearest_segment(houses(spark, sf_dir).select("id", "x", "y"), road_edges(spark, sf_dir), 200.0, "id", "edge_id")
    return found.select("id", r6("distance", "distance"))


@query(with_ctes(["buildings"], f"""SELECT a.id, {sql6('any_value(a.area) + sum(a.b_area)', 'covered_area')}, {sql6('max(a.d)', 'furthest')} FROM (SELECT a.id, a.area, b.area AS b_area, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d,
  row_number() OVER (PARTITION BY a.id ORDER BY (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), b.id) AS rn FROM buildings a JOIN buildings b ON a.id <> b.id AND abs(a.x - b.x) < 700 AND abs(a.y - b.y) < 700) a WHERE rn <= 20 GROUP BY a.id"""))
def knn20_covered_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = houses(spark, sf_dir)
    near = nearest_neighbours(h.select("id", "x", "y"), 20, "id", 100.0)
    other = h.select(F.col("id").alias("neighbour"), F.col("area").alias("other_area"))
    found = near.join(other, "neighbour").groupBy("id").agg(F.sum("other_area").alias("s"), F.max("distance").alias("f")).join(h.select("id", "area"), "id")
    return found.select("id", r6(F.col("area") + F.col("s"), "covered_area"), r6("f", "furthest"))


@query(with_ctes(["enclosures"], """, r AS (SELECT enclosure_id AS id, minx + 10 AS ax, miny + 10 AS ay, maxx - 10 AS bx, maxy - 10 AS by_ FROM enclosures) SELECT id, 2 * (bx - ax + by_ - ay) AS inset_perimeter, round((least(bx, ax + 100) - ax + 10) / (2 * (bx - ax + by_ - ay)), 6) + 0.0 AS coverage FROM r"""))
def perimeter_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = enclosures(spark, sf_dir)
    strip = e.select(F.col("enclosure_id").alias("building_group_id"), F.col("minx"), (F.col("miny") + 5).alias("miny"), (F.col("minx") + 110).alias("maxx"), (F.col("miny") + 20).alias("maxy"), F.col("minx").alias("x0"))
    one = strip.withColumn("geom", g.rectangle(F.col("minx") + 5.0, F.col("miny"), F.col("maxx"), F.col("maxy")))
    whole = (2 * (F.col("maxx") - F.col("minx") - 20 + F.col("maxy") - F.col("miny") - 20)).alias("inset_perimeter")
    cover = one.select("building_group_id", "geom").join(e.select(F.col("enclosure_id").alias("building_group_id"), F.col("geom").alias("around")), "building_group_id")
    found = b.coverage_of(cover)
    return found.join(e.select(F.col("enclosure_id").alias("building_group_id"), whole), "building_group_id").select(F.col("building_group_id").alias("id"), "inset_perimeter", r6("building_group_enclosure_perimeter_coverage", "coverage"))


@query(with_ctes(["buildings", "edges"], f"""SELECT id, {sql6('sqrt(d)', 'length')} FROM (SELECT id, min({_GAP}) AS d FROM (SELECT id, x, y, x1, y1, x2, y2, greatest(0, least(1, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / (length * length))) AS t
  FROM buildings JOIN edges ON least(x1, x2) - 200 <= x AND x <= greatest(x1, x2) + 200 AND least(y1, y2) - 200 <= y AND y <= greatest(y1, y2) + 200 WHERE area > 10) GROUP BY id) WHERE d <= 40000"""))
def plot_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    h, e = materialise(houses(spark, sf_dir).select("id", "area", "x", "y")), road_edges(spark, sf_dir)
    closest = nearest_segment(h, e, 200.0, "id", "edge_id")
    return b.plot_seeds(h, e, closest).select("id", r6(g.hypot(F.col("cx") - F.col("px"), F.col("cy") - F.col("py")), "length"))


@query("SELECT 'c' || c AS city, CAST(2 * (c + 1) AS BIGINT) AS faces, CAST(2 * (c + 1) * 100 AS DOUBLE) AS area FROM generate_series(0, 2) t(c)")
def enclosures_from_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faces of lattices of 2 x (c + 1) squares of ten metres, with a dead end."""
    c = F.col("c")
    cells = spark.range(3).select(F.col("id").alias("c"), F.explode(F.sequence(F.lit(0), F.lit(1))).alias("i")).withColumn("j", F.explode(F.sequence(F.lit(0), c.cast("int"))))
    x, y = F.col("i") * 10.0, F.col("j") * 10.0
    corners = [(x, y), (x + 10, y), (x + 10, y + 10), (x, y + 10), (x, y)]
    sides = F.array(*(F.struct(p.alias("x1"), q.alias("y1"), r.alias("x2"), s.alias("y2")) for (p, q), (r, s) in zip(corners, corners[1:], strict=False)))
    lines = cells.select(F.concat(F.lit("c"), c).alias("city"), F.inline(sides))
    dead = spark.range(3).select(F.concat(F.lit("c"), "id").alias("city"), F.lit(0.0).alias("x1"), F.lit(0.0).alias("y1"), F.lit(-5.0).alias("x2"), F.lit(-5.0).alias("y2"))
    return b.polygonise(lines.unionByName(dead)).groupBy("city").agg(F.count("*").alias("faces"), F.sum("area").alias("area"))


@query()
def tessellation(spark: SparkSession, sf_dir: str) -> DataFrame:
    h, e = houses(spark, sf_dir), enclosures(spark, sf_dir)
    placed = h.join(b.largest_enclosure(h, e), "id")
    return b.tessellation_areas(placed, e).select("enclosure_id", "id", r6("area", "area"))


@query()
def plot_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    h, e = materialise(houses(spark, sf_dir).drop("geom")), road_edges(spark, sf_dir)
    return plots.plot_ids(h, e, materialise(nearest_segment(h, e, 200.0, "id", "edge_id")))


@query()
def neighbour_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    cities = buildings(spark, sf_dir).withColumn("city", F.concat(F.lit("c"), F.expr("id div 500")))
    return plots.neighbour_distance(cities).select("id", r6("neighbor_distance", "neighbor_distance"))


@query(f"WITH g AS (SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j FROM generate_series(0, 29) a(i), generate_series(0, 9) c(j)) SELECT i, j, CAST(CASE (i + j) % 3 WHEN 0 THEN 255 WHEN 1 THEN 0 ELSE 242 END AS INTEGER) AS red, CAST(CASE (i + j) % 3 WHEN 0 THEN 0 WHEN 1 THEN 0 ELSE 60 END AS INTEGER) AS green, CAST(CASE (i + j) % 3 WHEN 0 THEN 255 WHEN 1 THEN 0 ELSE 60 END AS INTEGER) AS blue FROM g")
def grid_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    step = (F.col("i") + F.col("j")) % 3
    return gr.coloured_bands(_grid(spark).withColumn("use", F.when(step == 0, "retail").when(step == 2, "forest")), "use")


@query(with_ctes(["enclosures", "buildings"], "SELECT DISTINCT e.enclosure_id AS tile_id FROM enclosures e JOIN buildings a ON a.minx <= e.maxx AND e.minx <= a.maxx AND a.miny <= e.maxy AND e.miny <= a.maxy"))
def tiles_met(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles_of(buildings(spark, sf_dir), enclosures(spark, sf_dir).withColumnRenamed("enclosure_id", "tile_id"))


# --- grid and raster -----------------------------------------------------------

_PLACED = """placed AS (SELECT *, greatest(0, least(maxx, 100 * i + 100) - greatest(minx, 100 * i)) * greatest(0, least(maxy, 100 * j + 100) - greatest(miny, 100 * j)) AS overlap FROM (
  SELECT *, unnest(generate_series(CAST(floor(miny / 100) AS BIGINT), CAST(greatest(floor(miny / 100), ceil(maxy / 100) - 1) AS BIGINT))) AS j FROM (
    SELECT *, unnest(generate_series(CAST(floor(minx / 100) AS BIGINT), CAST(greatest(floor(minx / 100), ceil(maxx / 100) - 1) AS BIGINT))) AS i FROM buildings)))"""
_GROWN = """grid AS (SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j FROM (SELECT unnest(generate_series(least(0, min(i)), greatest(29, max(i)))) AS i, least(0, min(j)) AS low, greatest(9, max(j)) AS high FROM placed), LATERAL (SELECT unnest(generate_series(low, high)) AS j))"""
_GRID = "grid AS (SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j FROM generate_series(0, 29) a(i), generate_series(0, 9) c(j))"


def _grid(spark: SparkSession) -> DataFrame:
    return gr.create_grid(spark, 0, 0, 3050, 1000)


@query(f"WITH {_GRID} SELECT i, j, {sql6('sqrt(power(100 * i + 50 - 1500, 2) + power(100 * j + 50 - 400, 2))', 'distance')} FROM (SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j FROM generate_series(0, 29) a(i), generate_series(0, 9) c(j))")
def grid_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gr.distance_to(_grid(spark), F.lit(1500), F.lit(400)).select("i", "j", r6("distance_to_city_center", "distance"))


@query(with_ctes(["buildings"], f""", {_PLACED}, {_GROWN}, modes AS (SELECT i, j, class FROM (SELECT i, j, class, row_number() OVER (PARTITION BY i, j ORDER BY count(*) DESC, class) AS rn FROM placed GROUP BY i, j, class) WHERE rn = 1),
  most AS (SELECT i, j, class FROM (SELECT i, j, class, row_number() OVER (PARTITION BY i, j ORDER BY sum(overlap) DESC, class) AS rn FROM placed GROUP BY i, j, class) WHERE rn = 1)
  SELECT g.i, g.j, any_value(m.class) AS mode_class, any_value(s.class) AS most_class, {sql6('avg(p.ghsl_height)', 'mean_height')}, {sql6('coalesce(sum(p.ghsl_height), 0)', 'sum_height')}, count(p.real_height) AS n
  FROM grid g LEFT JOIN placed p ON p.i = g.i AND p.j = g.j LEFT JOIN modes m ON m.i = g.i AND m.j = g.j LEFT JOIN most s ON s.i = g.i AND s.j = g.j GROUP BY g.i, g.j"""))
def grid_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The city's frame of 30 x 10 cells, grown to all buildings."""
    placed = gr.cells_of(buildings(spark, sf_dir).drop("geom"), 0, 0)
    left, right, low, high = placed.agg(F.min("i"), F.max("i"), F.min("j"), F.max("j")).first()
    (left, right), (low, high) = ((min(0, a or 0), max(n, b or 0)) for a, b, n in ((left, right, 29), (low, high, 9)))
    grid = gr.create_grid(spark, 100 * left, 100 * low, 100 * (right + 1), 100 * (high + 1)).withColumns({"i": F.col("i") + left, "j": F.col("j") + low})
    found = gr.grid_aggregates(grid, placed, "b", mode=["class"], most=["class"], mean=["ghsl_height"], total=["ghsl_height"], count=["real_height"])
    return found.select("i", "j", F.col("`b::class::mode`").alias("mode_class"), F.col("`b::class::most_intersecting`").alias("most_class"), r6(F.col("`b::ghsl_height::mean`"), "mean_height"), r6(F.col("`b::ghsl_height::sum`"), "sum_height"), F.col("`b::real_height::count`").alias("n"))


@query(f"""WITH {_GRID}, v AS (SELECT i, j, CASE WHEN (i * 7 + j * 3) % 11 = 0 THEN 99 ELSE (i * i + j) % 4 END AS v FROM grid)
  SELECT i, j, CAST(v AS INTEGER) AS mode_kernel3 FROM (SELECT g.i, g.j, v.v, row_number() OVER (PARTITION BY g.i, g.j ORDER BY count(*) DESC, v.v) AS rn FROM grid g, (VALUES (-1), (0), (1)) a(a), (VALUES (-1), (0), (1)) b(b), v
  WHERE v.i = greatest(0, least(29, g.i + a)) AND v.j = greatest(0, least(9, g.j + b)) GROUP BY g.i, g.j, v.v) WHERE rn = 1""")
def grid_mode_kernel3(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, j = F.col("i"), F.col("j")
    values = _grid(spark).withColumn("v", F.when((i * 7 + j * 3) % 11 != 0, (i * i + j) % 4))
    return gr.modal_filter(values, "v", "mode_kernel3").select("i", "j", "mode_kernel3")


@query(with_ctes(["buildings"], "SELECT b.id, r.value FROM buildings b LEFT JOIN (SELECT id // 100 AS row, id % 100 AS col, CAST(id * 37 % 101 AS DOUBLE) AS value FROM generate_series(0, 9999) t(id)) r ON r.col = CAST(trunc((b.x + 10) / 50) AS BIGINT) AND r.row = CAST(trunc((4000 - b.y) / 50) AS BIGINT)"))
def raster_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gr.sample_raster(houses(spark, sf_dir).select("id", "x", "y"), raster(spark, sf_dir), AFFINE).select("id", "value")


@query("""SELECT row, col, CAST(coalesce(CASE WHEN row < 60 THEN row * 100 + col END, row * 1000 + col) AS DOUBLE) AS value FROM generate_series(0, 99) a(row), generate_series(0, 49) b(col) WHERE row BETWEEN 20 AND 79""".replace("SELECT row, col,", "SELECT CAST(row AS INTEGER) AS row, CAST(col AS INTEGER) AS col,"))
def raster_mosaic(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = spark.range(5000).select(F.expr("cast(id div 50 as int)").alias("row"), (F.col("id") % 50).cast("int").alias("col"))
    a = cells.where("row < 60").withColumn("value", (F.col("row") * 100 + F.col("col")).cast("double"))
    c = cells.where("row >= 40").withColumn("value", (F.col("row") * 1000 + F.col("col")).cast("double"))
    return gr.crop(gr.mosaic([a, c]), AFFINE, -10, 50, 1e9, 3000)


@query(f"""WITH RECURSIVE {_GRID}, v AS (SELECT i * 10 + j AS cell, i, j, (i // 3 + j // 2) % 3 AS v FROM grid), link AS (SELECT a.cell AS a, b.cell AS b FROM v a JOIN v b ON a.v = b.v AND abs(a.i - b.i) + abs(a.j - b.j) = 1),
  reach(cell, to_) AS (SELECT cell, cell FROM v UNION SELECT r.cell, l.b FROM reach r JOIN link l ON l.a = r.to_), p AS (SELECT cell, min(to_) AS patch FROM reach GROUP BY cell)
  SELECT CAST(patch AS BIGINT) AS patch, count(*) AS cells, count(*) * 10000.0::DOUBLE AS area, CAST((4 * count(*) - sum(n)) * 100 AS DOUBLE) AS perimeter FROM p JOIN (SELECT v.cell, count(l.b) AS n FROM v LEFT JOIN link l ON l.a = v.cell GROUP BY v.cell) USING (cell) GROUP BY patch""")
def grid_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = _grid(spark).withColumn("v", (F.expr("i div 3") + F.expr("j div 2")) % 3)
    return gr.patches(values, "v").select("patch", "cells", "area", "perimeter")


@query(f"WITH {_GRID} SELECT i, j, CAST(trunc((i + j) / 38.0 * 255) AS INTEGER) AS band FROM grid")
def grid_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gr.scaled_band(_grid(spark).withColumn("v", (F.col("i") + F.col("j")).cast("double")), "v").select("i", "j", "band")


@query("""SELECT id, CASE id % 4 WHEN 0 THEN 17 WHEN 1 THEN 22 WHEN 2 THEN 99 ELSE 14 END AS building, CASE id % 3 WHEN 0 THEN 99 WHEN 1 THEN CAST(id % 7 AS INTEGER) ELSE 3 END AS street FROM generate_series(0, 999) t(id)""")
def grid_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("id")
    label = F.when(i % 4 == 0, "detached").when(i % 4 == 1, "terraced").when(i % 4 == 2, "NONE").otherwise("apartments")
    cluster = F.when(i % 3 == 0, "none").when(i % 3 == 1, F.concat((i % 7).cast("string"), F.lit(".0"))).otherwise("3.7")
    return spark.range(1000).select("id", gr.class_code(label).alias("building"), gr.cluster_code(cluster).alias("street"))


# --- learning ------------------------------------------------------------------


def _vectors(spark: SparkSession, sf_dir: str, n: int = 64) -> tuple[DataFrame, list[str]]:
    names = [f"e{i}" for i in range(n)]
    # Written first: a filter over 64 aliases takes the optimizer 2 ** 64 constraints.
    return materialise(table(spark, sf_dir, "embeddings").select("vec_id", "label", *(F.get("embedding", F.lit(i)).cast("double").alias(c) for i, c in enumerate(names)))), names


@query()
def kmeans_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, names = _vectors(spark, sf_dir)
    return learning.k_means(df, "vec_id", names, prefix="k").groupBy("cluster").agg(F.count("*").alias("n"))


@query()
def gmm_bic(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, names = _vectors(spark, sf_dir, 3)
    return spark.createDataFrame(learning.mixture_sweep(df, names, range(2, 5))[0])


@query()
def building_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = materialise(b.framed(houses(spark, sf_dir)).select("id", "class", "area", "elongation", "ghsl_height", "real_levels"))  # read in each pass of the forest
    model, accuracy, weights = learning.train_classifier(h, "class", ["area", "elongation", "ghsl_height"], ["real_levels"], ["stadium"])
    rows = [("accuracy", accuracy), *sorted(weights.items())]
    return spark.createDataFrame(rows, "name string, value double")


@query()
def influence_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from streetloom.plans.city_metrics import influence_templates as templates

    return templates(table(spark, sf_dir, "lineitem"), "l_returnflag", ["l_extendedprice"], ["l_quantity", "l_discount"])


@query(with_ctes(["buildings"], "SELECT class, count(*) AS n FROM buildings GROUP BY class"))
def cluster_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return buildings(spark, sf_dir).groupBy("class").agg(F.count("*").alias("n"))

