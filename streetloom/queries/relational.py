"""Column, aggregate, window and set operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streetloom.config import BUILDING_SUBTYPES
from streetloom.fixtures import CATEGORY_SQL, buildings, enclosures, landuse, road_edges, table, with_ctes
from streetloom.functions import scalars as s
from streetloom.graph.roads import with_bearing
from streetloom.operators import aggregates as agg
from streetloom.operators import columns as c
from streetloom.queries.base import Registered, r6, sql6
from streetloom.sources.city import combine

REGISTERED = Registered()
query = REGISTERED.query
_SUBTYPE_SQL = "CASE " + " ".join(f"WHEN class IN ({', '.join(repr(t) for t in ts)}) THEN '{k}'" for k, ts in BUILDING_SUBTYPES.items() if ts) + " END"


@query(with_ctes(["edges"], f"""SELECT edge_id, highway, {CATEGORY_SQL} AS type_category, CAST(CASE WHEN highway IN ('motorway','motorway_link','trunk','trunk_link') THEN 4 WHEN highway IN ('primary','secondary','tertiary') THEN 3
  WHEN highway IN ('living_street','residential','pedestrian','unclassified','service') THEN 2 ELSE 1 END AS INTEGER) AS edge_class,
  CASE highway WHEN 'motorway' THEN 110.0::DOUBLE WHEN 'primary' THEN 80 WHEN 'secondary' THEN 70 WHEN 'tertiary' THEN 60 WHEN 'residential' THEN 30 WHEN 'primary_link' THEN 60 WHEN 'living_street' THEN 20 WHEN 'service' THEN 20 ELSE 50 END AS speed_kph,
  {sql6("length / (CASE highway WHEN 'motorway' THEN 110.0 WHEN 'primary' THEN 80 WHEN 'secondary' THEN 70 WHEN 'tertiary' THEN 60 WHEN 'residential' THEN 30 WHEN 'primary_link' THEN 60 WHEN 'living_street' THEN 20 WHEN 'service' THEN 20 ELSE 50 END / 3.6)", "travel_time")} FROM edges"""))  # fmt: skip
def road_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.col("highway")
    e = road_edges(spark, sf_dir).withColumn("speed_kph", s.speed_kph(h))
    return e.select("edge_id", "highway", s.type_category(h).alias("type_category"), s.edge_class(h).alias("edge_class"), "speed_kph", r6(s.travel_time(F.col("length"), F.col("speed_kph")), "travel_time"))


@query(with_ctes(["landuse"], "SELECT landuse_id, landuse, landuse_class FROM landuse"))
def landuse_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return landuse(spark, sf_dir).select("landuse_id", "landuse", "landuse_class")


@query(with_ctes(["buildings"], f"SELECT id, class, {_SUBTYPE_SQL} AS subtype FROM buildings"))
def building_subtypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    osm = buildings(spark, sf_dir).withColumnRenamed("class", "building").withColumn("geom_type", F.lit("Polygon"))
    return c.osm_buildings(osm).select("id", "class", "subtype")


@query(with_ctes(["buildings"], f"SELECT id, {sql6('coalesce(TRY_CAST(real_height AS DOUBLE), TRY_CAST(real_levels AS DOUBLE) * 3, ghsl_height)', 'approximate_height')} FROM buildings"))
def approximate_height(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = buildings(spark, sf_dir)
    return b.select("id", r6(s.approximate_height(F.col("real_height"), F.col("real_levels"), F.col("ghsl_height")), "approximate_height"))


@query("""SELECT n_nationkey, upper(substr(trim(n), 1, 1)) || lower(substr(trim(n), 2)) AS city, regexp_replace(n, '[^A-Za-z0-9_-]', '_', 'g') AS file_name, regexp_replace(n, '[^A-Za-z0-9_ ]', ' ', 'g') AS layer_name
  FROM (SELECT n_nationkey, ' ' || n_name || '.x-y ' AS n FROM nation)""")
def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.lit(" "), "n_name", F.lit(".x-y ")).alias("n"))
    return n.select("n_nationkey", s.capitalised(F.col("n")).alias("city"), s.file_name(F.col("n")).alias("file_name"), s.layer_name(F.col("n")).alias("layer_name"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS west, CASE WHEN event_id % 3 <> 0 THEN value + 10 > 12 AND value < 12 END AS inside, CASE WHEN event_id % 2 = 0 THEN true ELSE false END AS flag,
  [event_id, event_id + 1] AS ids FROM events""".replace("[event_id, event_id + 1] AS ids", "event_id + 1 AS last_id"))
def parsed_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where(F.col("value").isNotNull())
    text = F.concat_ws(",", F.format_string("%.2f", "value"), F.lit("-5"), F.format_string("%.2f", F.col("value") + 10), F.lit("5.5"))
    e = e.withColumn("box", s.bbox(F.when(F.col("event_id") % 3 == 0, F.concat(text, F.lit(",1"))).otherwise(text)))
    ids = s.id_list(F.concat(F.lit("["), "event_id", F.lit(", "), F.col("event_id") + 1, F.lit("]")))
    return e.select("event_id", F.col("box.west").alias("west"), s.in_bbox(F.lit(12.0), F.lit(0.0), F.col("box")).alias("inside"), s.boolean(F.when(F.col("event_id") % 2 == 0, "True").otherwise("FALSE")).alias("flag"), F.element_at(ids, -1).alias("last_id"))


_LINES = ["l_quantity", "l_discount", "l_extendedprice"]
_KEY = "l_orderkey, l_linenumber, l_partkey, l_suppkey"


@query(f"SELECT {_KEY}, " + ", ".join(sql6(f"({x} - min({x}) OVER ()) / (max({x}) OVER () - min({x}) OVER ())", x) for x in _LINES) + " FROM lineitem")
def min_max_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.min_max(table(spark, sf_dir, "lineitem"), _LINES).select(*_KEY.split(", "), *(r6(x, x) for x in _LINES))


@query(f"SELECT {_KEY}, " + ", ".join(sql6(f"({x} - avg({x}) OVER ()) / stddev_samp({x}) OVER ()", x) for x in _LINES) + " FROM lineitem")
def z_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.z_scores(table(spark, sf_dir, "lineitem"), _LINES).select(*_KEY.split(", "), *(r6(x, x) for x in _LINES))


@query(f"SELECT {_KEY}, " + ", ".join(sql6(f"least(({x} - lo_{x}) / (hi_{x} - lo_{x}), 1.0)", x) for x in _LINES) + " FROM lineitem, (SELECT " + ", ".join(f"min({x}) AS lo_{x}, quantile_cont({x}, 0.99) AS hi_{x}" for x in _LINES) + " FROM lineitem)")
def normalised_and_clipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.normalise_and_clip(table(spark, sf_dir, "lineitem"), _LINES).select(*_KEY.split(", "), *(r6(x, x) for x in _LINES))


@query("SELECT l_returnflag, greatest(0.02, least(l_discount, 0.07)) AS clipped, count(*) AS n FROM lineitem GROUP BY ALL")
def clipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", s.clip(F.col("l_discount"), 0.02, 0.07).alias("clipped")).agg(F.count("*").alias("n"))


@query("SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS rn FROM orders) WHERE (rn - 1) % 20 = 0")
def every_twentieth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.every_nth(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"], 20).select("o_orderkey")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_id FROM orders")
def row_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.with_row_id(table(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"], "row_id")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority NOT IN ('5-LOW')")
def filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").where(c.parse_filter("o_orderstatus=P"))
    return c.training_rows(o, "o_orderpriority", ["5-LOW"]).select("o_orderkey", "o_totalprice")


@query("SELECT p_partkey, coalesce(CASE WHEN p_partkey % 3 = 0 THEN -1.0 END, p_retailprice) AS p_retailprice, CASE WHEN p_partkey % 3 = 0 THEN 'sale' END AS note FROM part")
def updated_by_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    new = p.where("p_partkey % 3 = 0").select("p_partkey", F.lit(-1.0).alias("p_retailprice"), F.lit("sale").alias("note"))
    return c.update_from(p, new, ["p_partkey"])


@query("SELECT CAST(s_suppkey AS BIGINT) AS k, s_name AS name, NULL AS segment FROM supplier UNION ALL SELECT c_custkey, c_name, c_mktsegment FROM customer")
def union_of_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"))
    b = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return c.union_all([a, b])


@query("""SELECT 'NATION_' || c_nationkey AS city, count(*) AS n FROM customer GROUP BY ALL""")
def combined_cities(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer")
    cities = {f"NATION_{k}": customers.where(F.col("c_nationkey") == k) for k in range(25)}
    return combine(cities, "c_custkey", sample=False).groupBy("city").agg(F.count("*").alias("n"))


@query("""SELECT l_returnflag, least(count(*), 10000) AS n FROM lineitem GROUP BY l_returnflag""")
def sampled_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumn("k", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return agg.sample_groups(rows, "l_returnflag", "k").groupBy("l_returnflag").agg(F.count("*").alias("n"))


@query(f"""SELECT l_suppkey, {sql6('sum(l_discount * l_quantity) / sum(l_quantity)', 'weighted_mean')}, {sql6("sum(CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE 0 END) / sum(l_quantity)", 'weighted_share')},
  {sql6('avg(l_tax)', 'tax_mean')}, {sql6('stddev_samp(l_tax)', 'tax_std')} FROM lineitem GROUP BY l_suppkey""")
def weighted_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.col("l_quantity")
    found = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(
        agg.weighted_mean(F.col("l_discount"), w).alias("weighted_mean"), agg.weighted_share(F.col("l_returnflag") == "A", w).alias("weighted_share"), *agg.mean_std(["l_tax"], "_"),
    )
    return found.select("l_suppkey", r6("weighted_mean", "weighted_mean"), r6("weighted_share", "weighted_share"), r6("l_tax_mean", "tax_mean"), r6("l_tax_std", "tax_std"))


@query("""SELECT l_suppkey, min(x) AS weighted_median FROM (SELECT l_suppkey, l_extendedprice AS x, sum(l_quantity) OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice) AS cum, sum(l_quantity) OVER (PARTITION BY l_suppkey) AS total FROM lineitem)
  WHERE cum >= total / 2 GROUP BY l_suppkey""")
def weighted_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg.weighted_median(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_extendedprice", "l_quantity", "weighted_median")


@query(with_ctes(["edges"], f"""SELECT highway, {sql6('-sum(p * log2(p))', 'angle_entropy')} FROM (SELECT highway, w / sum(w) OVER (PARTITION BY highway) AS p FROM (
  SELECT highway, least(floor((b + 185) / (360.0 / 35)), 34) AS bin, sum(length) AS w FROM (SELECT highway, length, degrees(atan2(y2 - y1, x2 - x1)) AS b FROM edges) WHERE b + 5 BETWEEN -180 AND 180 GROUP BY ALL)) WHERE p > 0 GROUP BY highway"""))
def angle_entropies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg.angle_entropy(with_bearing(road_edges(spark, sf_dir)), ["highway"], "bearing", "length", "e").select("highway", r6("e", "angle_entropy"))


@query(with_ctes(["edges"], f"""SELECT highway, {sql6('avg(CASE WHEN abs(b) <= 5 OR abs(b - 90) <= 5 + 90e-5 OR abs(b - 180) <= 5 + 180e-5 OR abs(b - 270) <= 5 + 270e-5 OR abs(b - 360) <= 5 + 360e-5 THEN 1.0 ELSE 0.0 END)', 'bearing_cardinality')}
  FROM (SELECT highway, degrees(atan2(y2 - y1, x2 - x1)) AS b FROM edges) GROUP BY highway"""))
def cardinal_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_bearing(road_edges(spark, sf_dir)).groupBy("highway").agg(agg.cardinal_share(F.col("bearing")).alias("s")).select("highway", r6("s", "bearing_cardinality"))


@query(f"SELECT o_custkey, o_orderkey, {sql6('stddev_samp(o_totalprice) OVER (PARTITION BY o_custkey)', 'spread')} FROM orders")
def group_spreads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg.group_spread(table(spark, sf_dir, "orders"), "o_custkey", ["o_totalprice"]).select("o_custkey", "o_orderkey", r6("o_totalprice_std", "spread"))


@query(f"""SELECT 'o_orderkey' AS "column", {sql6('count(o_orderkey) * 1.0 / count(*)', 'known')}, {sql6('min(o_orderkey)', 'least')}, {sql6('max(o_orderkey)', 'greatest')}, {sql6('avg(o_orderkey)', 'mean')}, count(*) AS rows FROM orders
  UNION ALL SELECT 'o_orderstatus', count(o_orderstatus) * 1.0 / count(*), NULL, NULL, NULL, count(*) FROM orders UNION ALL SELECT 'o_totalprice', count(o_totalprice) * 1.0 / count(*), min(o_totalprice), max(o_totalprice), round(avg(o_totalprice), 6), count(*) FROM orders""")
def layer_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = agg.profile(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"))
    return found.select("column", r6("known", "known"), r6("least", "least"), r6("greatest", "greatest"), r6("mean", "mean"), "rows")


@query("SELECT p_type AS value, count(*) AS count FROM part GROUP BY p_type ORDER BY count DESC, value LIMIT 7")
def top_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg.top_values(table(spark, sf_dir, "part"), "p_type")


@query(f"""SELECT l_returnflag, CAST(bin AS INTEGER) AS bin, {sql6('lo + bin * w', 'low')}, {sql6('coalesce(n, 0) * 1.0 / sum(coalesce(n, 0)) OVER (PARTITION BY l_returnflag)', 'probability')}, {sql6('coalesce(mid, 0)', 'median')} FROM
  (SELECT l_returnflag, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, (max(l_extendedprice) - min(l_extendedprice)) / 10 AS w FROM lineitem GROUP BY ALL) s CROSS JOIN generate_series(0, 9) g(bin)
  LEFT JOIN (SELECT l_returnflag, least(floor((l_extendedprice - lo) / w), 9) AS bin, count(*) AS n, quantile_cont(l_extendedprice, 0.5) AS mid FROM lineitem JOIN (SELECT l_returnflag, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, (max(l_extendedprice) - min(l_extendedprice)) / 10 AS w
  FROM lineitem GROUP BY ALL) USING (l_returnflag) WHERE l_extendedprice < hi GROUP BY ALL) f USING (l_returnflag, bin)""")
def probability_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = agg.probability_histogram(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice")
    return found.select("l_returnflag", "bin", r6("low", "low"), r6("probability", "probability"), r6("median", "median"))


_Z = " UNION ALL ".join(f"SELECT l_suppkey, '{x}' AS feature, (avg({x}) - (SELECT avg({x}) FROM lineitem)) / (SELECT stddev_samp({x}) FROM lineitem) AS z FROM lineitem GROUP BY l_suppkey" for x in [*_LINES, "l_tax"])


@query(f"SELECT l_suppkey, feature, {sql6('z', 'z')}, CAST(rn AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY abs(z) DESC, feature) AS rn FROM ({_Z})) WHERE rn <= 3")
def cluster_z_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg.group_z_scores(table(spark, sf_dir, "lineitem"), "l_suppkey", [*_LINES, "l_tax"]).select("l_suppkey", "feature", r6("z", "z"), F.col("rank").cast("int").alias("rank"))


@query("SELECT l_suppkey, l_linenumber AS mode FROM (SELECT l_suppkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY count(*) DESC, l_linenumber) AS rn FROM lineitem GROUP BY ALL) WHERE rn = 1".replace("GROUP BY ALL", "GROUP BY l_suppkey, l_linenumber"))
def smallest_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg.smallest_mode(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_linenumber", "mode")


@query(with_ctes(["enclosures"], "SELECT enclosure_id, minx, maxy FROM enclosures WHERE minx < 700 AND maxx > 100 AND miny < 900 AND maxy > 50"))
def boxes_in_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = enclosures(spark, sf_dir)
    box = F.struct(F.col("minx").alias("xmin"), F.col("maxx").alias("xmax"), F.col("miny").alias("ymin"), F.col("maxy").alias("ymax"))
    return c.in_extent(e.withColumn("bbox", box), 100, 50, 700, 900).select("enclosure_id", "minx", "maxy")


@query("SELECT p_partkey, 'ml' || p_partkey % 3 AS source, CASE WHEN p_partkey % 4 > 0 THEN p_size / 100.0 END AS confidence, CASE WHEN p_partkey % 4 > 0 THEN p_name END AS name, CAST(CASE WHEN p_partkey % 2 = 0 THEN p_retailprice ELSE 4.5 END AS DOUBLE) AS height FROM part".replace("'ml' || p_partkey % 3 AS source", "CASE WHEN p_partkey % 4 > 0 THEN 'ml' || p_partkey % 3 END AS source"))
def overture_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    one = F.struct(F.concat(F.lit("ml"), k % 3).alias("dataset"), (F.col("p_size") / 100.0).alias("confidence"))
    raw = table(spark, sf_dir, "part").select(
        k, F.when(k % 4 > 0, F.array(one)).otherwise(F.array().cast("array<struct<dataset:string,confidence:double>>")).alias("sources"),
        F.when(k % 4 > 0, F.struct(F.col("p_name").alias("primary"))).alias("names"), F.when(k % 2 == 0, F.col("p_retailprice")).alias("height"), F.lit(4.5).alias("roof_height"), F.lit(2).alias("num_floors"),
    )
    return c.overture_buildings(raw).select("p_partkey", "source", "confidence", "name", F.col("real_height").cast("double").alias("height"))
