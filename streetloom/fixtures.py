"""A synthetic city, derived from the driver's tables by integer arithmetic.

The same tables are given as DuckDB text (:data:`CTES`), so that every query
has a counterpart in plain SQL.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from streetloom.functions.geometry import rectangle
from streetloom.functions.scalars import landuse_class, type_category

TAGS = ["house", "church", "office", "school", "shed", "no_such_tag", "hospital", "stadium"]
LANDUSES = ["residential", "warehouse", "mall", "bank", "airport", "forest"]
SMALL_ROADS = ["residential", "living_street", "service", "footway", "primary_link"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a table that one task turns into the city. Files of keys pack so well that a split by bytes leaves millions to one.
ROWS_A_TASK = 50_000


def spread(spark: SparkSession, sf_dir: str, name: str, key: str, *others: str) -> DataFrame:
    """``key`` and ``others`` of a table, dealt by key over as many tasks as its rows ask for."""
    whole = table(spark, sf_dir, name)
    rows = whole.count()
    slim = whole.select(key, *others)
    return slim.repartition(rows // ROWS_A_TASK + 1, key) if rows > ROWS_A_TASK else slim


def _div(a: Column, n: int) -> Column:
    return F.floor(a / n).cast("long")


def _pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*(F.lit(v) for v in values)), index.cast("int") + 1)


def buildings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of four houses on a lattice; in two of three rows they touch."""
    i = F.col("id")
    group = _div(i, 4)
    base = spread(spark, sf_dir, "part", "p_partkey", "p_retailprice").select(F.col("p_partkey").alias("id"), (F.col("p_retailprice") / 100).alias("ghsl_height"))
    boxed = base.select(
        "id", "ghsl_height", (60 * (group % 50) + (i % 4) * F.when(group % 3 == 0, 9).otherwise(8)).cast("double").alias("minx"), (60 * _div(group, 50)).cast("double").alias("miny"),
        (6 + group % 11 + i % 3).cast("double").alias("h"),
        F.when(i % 3 == 0, None).when(i % 7 == 0, "n/a").otherwise((i % 20).cast("string")).alias("real_height"),
        F.when(i % 5 == 0, None).otherwise((1 + i % 6).cast("string")).alias("real_levels"), _pick(TAGS, i % 8).alias("class"),
    )
    boxed = boxed.withColumns({"maxx": F.col("minx") + 8, "maxy": F.col("miny") + F.col("h")}).drop("h")
    return boxed.withColumn("geom", rectangle(*(F.col(c) for c in ("minx", "miny", "maxx", "maxy"))))


def _squares(spark: SparkSession, sf_dir: str, size: int, grow: Column) -> DataFrame:
    rows = (table(spark, sf_dir, "part").count() // 200 * 60) // size + 1
    cell = spark.range(11 * rows).select(F.col("id"), _div(F.col("id"), rows).alias("ex"), (F.col("id") % rows).alias("ey"))
    low = cell.withColumns({"minx": (size * F.col("ex") - 20).cast("double"), "miny": (size * F.col("ey") - 20).cast("double")})
    return low.withColumns({"maxx": F.col("minx") + size + grow, "maxy": F.col("miny") + size + grow})


def enclosures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squares of about 300 m that overlap a little."""
    sq = _squares(spark, sf_dir, 300, (F.col("ex") * 7 + F.col("ey") * 3) % 40)
    sq = sq.withColumn("area", (F.col("maxx") - F.col("minx")) * (F.col("maxy") - F.col("miny")))
    return sq.select(F.col("id").alias("enclosure_id"), "minx", "miny", "maxx", "maxy", "area", rectangle(*(F.col(c) for c in ("minx", "miny", "maxx", "maxy"))).alias("geom"))


def landuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    sq = _squares(spark, sf_dir, 500, F.lit(0))
    sq = sq.withColumn("landuse", _pick(LANDUSES, (F.col("ex") + F.col("ey")) % 6))
    return sq.select(F.col("id").alias("landuse_id"), "landuse", landuse_class(F.col("landuse")).alias("landuse_class"), "minx", "miny", "maxx", "maxy")


def side(spark: SparkSession, sf_dir: str) -> int:
    return isqrt(table(spark, sf_dir, "customer").count())


def _x(k: Column, m: int) -> Column:
    return ((k % m) * 80 + k * 7919 % 15 - 7).cast("double")


def _y(k: Column, m: int) -> Column:
    return (_div(k, m) * 80 + k * 104729 % 15 - 7).cast("double")


def road_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lattice of 80 m with a jitter of up to 7 m."""
    m = side(spark, sf_dir)
    k = F.col("c_custkey")
    return spread(spark, sf_dir, "customer", "c_custkey").select(k.alias("node_id"), _x(k, m).alias("x"), _y(k, m).alias("y"))


def road_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lattice links both ways without some, some of them one way, a few of them twice."""
    customers = spread(spark, sf_dir, "customer", "c_custkey")
    n = table(spark, sf_dir, "customer").count()
    m = isqrt(n)
    k = F.col("c_custkey")
    ways = F.array(*(F.struct(F.lit(d).cast("long").alias("dir"), (k + step).alias("v")) for d, step in enumerate((1, m, -1, -m))))
    links = customers.select(k.alias("u"), F.inline(ways)).where((F.col("v") >= 0) & (F.col("v") < n))
    u, v = F.col("u"), F.col("v")
    links = links.where(((F.col("dir") % 2 == 1) | (_div(u, m) == _div(v, m))) & (u * v % 11 != 0) & ((u * 3 + v * 5) % 17 != 0))
    keys = F.when((u + v) % 29 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    links = links.withColumn("key", F.explode(keys))
    low = F.least(u, v)
    across = F.col("dir") % 2 == 0
    road = (
        F.when(across & (_div(low, m) % 16 == 4), "motorway").when(across & (_div(low, m) % 8 == 0), "primary")
        .when(~across & (low % m % 8 == 0), "secondary").when(~across & (low % m % 8 == 4), "tertiary").otherwise(_pick(SMALL_ROADS, low % 5))
    )
    ends = links.select(
        (u * 8 + F.col("dir") * 2 + F.col("key")).alias("edge_id"), "u", "v", "key", road.alias("highway"),
        _x(u, m).alias("x1"), _y(u, m).alias("y1"), _x(v, m).alias("x2"), _y(v, m).alias("y2"),
    )
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    return ends.withColumns({"length": F.sqrt(dx * dx + dy * dy), "type_category": type_category(F.col("highway"))})


def raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """100 x 100 cells with values from modular arithmetic; its affine map is :data:`AFFINE`."""
    return spark.range(10_000).select(F.expr("cast(id div 100 as int)").alias("row"), (F.col("id") % 100).cast("int").alias("col"), (F.col("id") * 37 % 101).cast("double").alias("value"))


AFFINE = (50.0, 0.0, -10.0, 0.0, -50.0, 4000.0)

CATEGORY_SQL = """CASE WHEN highway IN ('motorway','motorway_link','trunk','trunk_link') THEN 'highway'
  WHEN highway IN ('primary','secondary','tertiary') THEN 'major'
  WHEN highway IN ('living_street','residential','pedestrian','unclassified','service') THEN 'street'
  WHEN highway IN ('path','footway','steps') THEN 'path' END"""

CTES = {
    "buildings": """buildings AS (SELECT *, minx + 8 AS maxx, miny + h AS maxy, 8 * h AS area, 2 * (8 + h) AS perimeter, minx + 4 AS x, miny + h / 2 AS y FROM (
  SELECT p_partkey AS id, p_retailprice / 100 AS ghsl_height,
    CAST(60 * ((p_partkey // 4) % 50) + (p_partkey % 4) * (CASE WHEN (p_partkey // 4) % 3 = 0 THEN 9 ELSE 8 END) AS DOUBLE) AS minx,
    CAST(60 * ((p_partkey // 4) // 50) AS DOUBLE) AS miny, CAST(6 + (p_partkey // 4) % 11 + p_partkey % 3 AS DOUBLE) AS h,
    CASE WHEN p_partkey % 3 = 0 THEN NULL WHEN p_partkey % 7 = 0 THEN 'n/a' ELSE CAST(p_partkey % 20 AS VARCHAR) END AS real_height,
    CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE CAST(1 + p_partkey % 6 AS VARCHAR) END AS real_levels,
    ['house','church','office','school','shed','no_such_tag','hospital','stadium'][p_partkey % 8 + 1] AS class FROM part))""",
    "enclosures": """enclosures AS (SELECT *, (maxx - minx) * (maxy - miny) AS area FROM (SELECT id AS enclosure_id, minx, miny, minx + 300 + grow AS maxx, miny + 300 + grow AS maxy FROM (
  SELECT ex * nrows + ey AS id, CAST(300 * ex - 20 AS DOUBLE) AS minx, CAST(300 * ey - 20 AS DOUBLE) AS miny, (ex * 7 + ey * 3) % 40 AS grow
  FROM (SELECT (count(*) // 200 * 60) // 300 + 1 AS nrows FROM part), generate_series(0, 10) a(ex), generate_series(0, 2000) b(ey) WHERE ey < nrows)))""",
    "landuse": """landuse AS (SELECT *, CASE landuse WHEN 'residential' THEN 'residential' WHEN 'warehouse' THEN 'industrial' WHEN 'mall' THEN 'retail' WHEN 'bank' THEN 'commercial' WHEN 'airport' THEN 'airport' END AS landuse_class
  FROM (SELECT ex * nrows + ey AS landuse_id, CAST(500 * ex - 20 AS DOUBLE) AS minx, CAST(500 * ey - 20 AS DOUBLE) AS miny, CAST(500 * ex + 480 AS DOUBLE) AS maxx, CAST(500 * ey + 480 AS DOUBLE) AS maxy,
  ['residential','warehouse','mall','bank','airport','forest'][(ex + ey) % 6 + 1] AS landuse
  FROM (SELECT (count(*) // 200 * 60) // 500 + 1 AS nrows FROM part), generate_series(0, 10) a(ex), generate_series(0, 2000) b(ey) WHERE ey < nrows))""",
    "size": "size AS (SELECT count(*) AS n, CAST(floor(sqrt(count(*))) AS BIGINT) AS m FROM customer)",
    "nodes": """nodes AS (SELECT c_custkey AS node_id, CAST((c_custkey % m) * 80 + c_custkey * 7919 % 15 - 7 AS DOUBLE) AS x, CAST((c_custkey // m) * 80 + c_custkey * 104729 % 15 - 7 AS DOUBLE) AS y FROM customer, size)""",
    "edges": f"""edges AS (SELECT *, sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) AS length, {CATEGORY_SQL} AS type_category FROM (
  SELECT u * 8 + dir * 2 + key AS edge_id, u, v, CAST(key AS INTEGER) AS key, CASE WHEN dir % 2 = 0 AND (least(u, v) // m) % 16 = 4 THEN 'motorway' WHEN dir % 2 = 0 AND (least(u, v) // m) % 8 = 0 THEN 'primary'
    WHEN dir % 2 = 1 AND least(u, v) % m % 8 = 0 THEN 'secondary' WHEN dir % 2 = 1 AND least(u, v) % m % 8 = 4 THEN 'tertiary'
    ELSE ['residential','living_street','service','footway','primary_link'][least(u, v) % 5 + 1] END AS highway, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2
  FROM (SELECT c_custkey AS u, c_custkey + CASE dir WHEN 0 THEN 1 WHEN 1 THEN m WHEN 2 THEN -1 ELSE -m END AS v, dir, n, m, key FROM customer, size, (VALUES (0), (1), (2), (3)) d(dir), (VALUES (0), (1)) k(key)) l
  JOIN nodes a ON a.node_id = u JOIN nodes b ON b.node_id = v
  WHERE v >= 0 AND v < n AND (dir % 2 = 1 OR u // m = v // m) AND u * v % 11 <> 0 AND (u * 3 + v * 5) % 17 <> 0 AND (key = 0 OR (u + v) % 29 = 0)))""",
    "turns": """turns AS (SELECT edge_id, u, v, key, w, (d + 180) - 360 * floor((d + 180) / 360) - 180 AS angle FROM (
  SELECT a.edge_id, a.u, a.v, a.key, b.v AS w, degrees(atan2(b.y2 - b.y1, b.x2 - b.x1)) - degrees(atan2(a.y2 - a.y1, a.x2 - a.x1)) AS d
  FROM edges a JOIN (SELECT DISTINCT u, v, x1, y1, x2, y2 FROM edges) b ON b.u = a.v AND b.v <> a.u))""",
    "degrees_": """degrees_ AS (SELECT node_id, count(DISTINCT other) AS node_degree, count(DISTINCT CASE WHEN major THEN other END) AS node_major_degree FROM (
  SELECT n.node_id, o.other, o.major FROM nodes n LEFT JOIN (SELECT u AS node_id, v AS other, key = 0 AND type_category IN ('major', 'highway') AS major FROM edges UNION ALL SELECT v, u, key = 0 AND type_category IN ('major', 'highway') FROM edges) o USING (node_id)) GROUP BY node_id)""",
    "forward": """forward AS (SELECT e.edge_id, e.u, e.v, e.key, e.length, b.w, b.angle AS forward_angle FROM edges e LEFT JOIN (
  SELECT edge_id, w, angle FROM (SELECT *, count(*) OVER (PARTITION BY edge_id) AS ways, row_number() OVER (PARTITION BY edge_id ORDER BY abs(angle), w) AS rn FROM turns) WHERE rn = 1 AND (ways = 1 OR abs(angle) <= 45)) b USING (edge_id))""",
}
_NEEDS = {"nodes": ["size"], "edges": ["size", "nodes"], "turns": ["edges"], "degrees_": ["nodes", "edges"], "forward": ["turns"]}


def with_ctes(names: list[str], body: str, recursive: bool = False) -> str:
    """``body`` behind the named tables and those that they need."""
    order: list[str] = []

    def need(name: str) -> None:
        for n in _NEEDS.get(name, ()):
            need(n)
        if name not in order:
            order.append(name)

    for name in names:
        need(name)
    return f"WITH {'RECURSIVE ' * recursive}" + ",\n".join(CTES[n] for n in order) + "\n" + body
