"""Area queries take all rows of their tables."""

from pyspark.sql import functions as F

from streetloom.operators import buildings as b
from streetloom.queries import areas

SF = "/root/testdata/sf0.001"


def test_tessellation_keeps_every_building(spark):
    got = {r.id: r.area for r in areas.tessellation(spark, SF).collect()}
    placed = areas.houses(spark, SF).join(b.largest_enclosure(areas.houses(spark, SF), areas.enclosures(spark, SF)), "id")
    assert set(got) == {r.id for r in placed.select("id").collect()}
    assert any(a % 100 for a in got.values())


def test_building_without_a_sample_has_no_area(spark):
    e = spark.createDataFrame([(1, 0.0, 0.0, 20.0, 20.0)], "enclosure_id long, minx double, miny double, maxx double, maxy double")
    h = spark.createDataFrame([(1, 7, 0.0, 0.0, 9.0, 9.0, 81.0), (1, 8, 0.0, 0.0, 9.0, 9.0, 81.0)], "enclosure_id long, id long, minx double, miny double, maxx double, maxy double, area double")
    assert {tuple(r) for r in b.tessellation_areas(h, e).collect()} == {(1, 7, 400.0), (1, 8, 0.0)}


def parts(spark, path, n):
    spark.range(1, n + 1).select(F.col("id").alias("p_partkey"), F.lit(900.0).alias("p_retailprice")).coalesce(1).write.parquet(f"{path}/part.parquet")
    return str(path)


def test_grid_grows_to_all_buildings(spark, tmp_path):
    sf = parts(spark, tmp_path, 4000)
    got = areas.grid_aggregates(spark, sf).agg(F.max("j"), F.sum("n"), F.count("*")).first()
    met = areas.gr.cells_of(areas.buildings(spark, sf).drop("geom"), 0, 0).agg(F.max("j"), F.count("real_height")).first()
    assert met[0] > 9 and (got[0], got[1], got[2]) == (met[0], met[1], 30 * (met[0] + 1))


def test_tiles_are_met_by_all_buildings(spark):
    houses, tiles = areas.buildings(spark, SF).collect(), areas.enclosures(spark, SF).collect()
    want = {t.enclosure_id for t in tiles for h in houses if h.minx <= t.maxx and t.minx <= h.maxx and h.miny <= t.maxy and t.miny <= h.maxy}
    assert {r.tile_id for r in areas.tiles_met(spark, SF).collect()} == want


def test_kmeans_takes_whole_vectors(spark, monkeypatch):
    seen, own = [], areas.learning.k_means
    monkeypatch.setattr(areas.learning, "k_means", lambda df, key, names, **rest: (seen.append(len(names)), own(df, key, names, **rest))[1])
    found = {r.cluster: r.n for r in areas.kmeans_embeddings(spark, SF).collect()}
    assert seen == [64] and len(found) == 8 and sum(found.values()) == areas.table(spark, SF, "embeddings").count()
