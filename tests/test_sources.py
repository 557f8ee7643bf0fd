import sqlite3
import struct

import pytest
from pyspark.sql import functions as F

from streetloom.plans.city_metrics import default_registry
from streetloom.plans.registry import Metric, Registry
from streetloom.sources import city, geopackage


def blob(kind, rings):
    return b"GP\x00\x01" + struct.pack("<i", 4326) + geopackage.encode_wkb(kind, rings)


@pytest.fixture()
def package(tmp_path):
    path = str(tmp_path / "a.gpkg")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE gpkg_contents (table_name TEXT, data_type TEXT)")
        db.execute("CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT)")
        db.execute("INSERT INTO gpkg_contents VALUES ('houses', 'features'), ('heights', 'tiles')")
        db.execute("INSERT INTO gpkg_geometry_columns VALUES ('houses', 'geom')")
        db.execute("CREATE TABLE houses (fid INTEGER PRIMARY KEY, geom BLOB, name TEXT, height REAL, ok BOOLEAN)")
        square = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0), (0.0, 0.0)]
        rows = [(1, blob("Polygon", [square]), "a", 1.5, 1), (2, blob("Point", [[(3.0, 4.0)]]), None, None, 0), (9, None, "c", 2.0, None), (10, blob("LineString", [[(0.0, 0.0), (1.0, 1.0)]]), "d", 2.5, 1)]
        db.executemany("INSERT INTO houses VALUES (?, ?, ?, ?, ?)", rows)
    return path


def test_geopackage(spark, package):
    assert geopackage.list_layers(package) == ["houses"] and geopackage.list_layers(package, "tiles") == ["heights"]
    got = {r.fid: r for r in geopackage.read_layer(spark, package, "houses", rows_per_task=2).collect()}
    assert sorted(got) == [1, 2, 9, 10]
    assert (got[1].geom_type, got[1].name, got[1].height, got[1].ok, len(got[1].geom[0])) == ("Polygon", "a", 1.5, True, 5)
    assert (got[2].geom[0][0].x, got[2].geom[0][0].y, got[2].height) == (3.0, 4.0, None) and got[9].geom is None and got[10].geom_type == "LineString"
    with pytest.raises(ValueError):
        geopackage.read_layer(spark, package, "nothing")


def test_wkb_byte_orders():
    big = struct.pack(">BI2d", 0, 1, 5.0, 6.0)
    assert geopackage.decode_wkb(big) == ("Point", [[(5.0, 6.0)]])
    multi = struct.pack("<BII", 1, 6, 1) + geopackage.encode_wkb("Polygon", [[(0.0, 0.0), (1.0, 0.0), (0.0, 1.0), (0.0, 0.0)]])
    assert geopackage.decode_wkb(multi)[0] == "MultiPolygon"


def test_city_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("delft", 1, "a"), ("delft", 2, "b"), ("lima", 3, "a")], "city string, id long, kind string")
    made = city.City({"buildings": rows})
    made.write(str(tmp_path))
    assert city.list_layers(spark, str(tmp_path)) == ["buildings"]
    back = city.City.read(spark, str(tmp_path), ["buildings"], "delft")
    assert back.count("buildings") == 2 and back.count("buildings", "kind=a") == 1
    assert sorted(r.id for r in back.column("buildings", "id").collect()) == [1.0, 2.0]
    with pytest.raises(ValueError):
        back.count("buildings", "kind=a=b")
    city.City({"buildings": rows.where("city = 'lima'").withColumn("id", F.lit(9).cast("long"))}).write(str(tmp_path))
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/buildings").collect()) == [1, 2, 9]
    assert city.drop_layer(spark, str(tmp_path), "buildings") and not city.drop_layer(spark, str(tmp_path), "buildings")


def test_city_list_and_templates(spark, tmp_path):
    (tmp_path / "cities.txt").write_text("#no\nDelft,Netherlands,4.3,51.9,4.4,52.1,100000\n")
    assert city.read_city_list(spark, str(tmp_path / "cities.txt")).first().Population == 100000.0
    got = city.write_templates(spark.createDataFrame([(3, 0.5)], "k int, p double"), "k", str(tmp_path / "t")).collect()
    assert [tuple(r) for r in got] == [("cluster_3", '{"k":3,"p":0.5}')]


def test_registry_order_and_gates(spark):
    layer = spark.range(3).withColumnRenamed("id", "k")
    r = Registry()
    r.add(Metric("c", "l", "k", ("c",), lambda x: x["l"].select("k", (F.col("b") + 1).alias("c")), ("l.b",)))
    r.add(Metric("b", "l", "k", ("b",), lambda x: x["l"].select("k", (F.col("k") * 2).alias("b"))))
    r.add(Metric("bad", "l", "k", ("z",), lambda x: x["l"].select("nothing")))
    assert [m.name for m in r.order(["c"])] == ["b", "c"]
    out, _, failed = r.run({"l": layer})
    assert list(failed) == ["bad"] and sorted(x.c for x in out["l"].collect()) == [1, 3, 5]
    again, spent, _ = r.run(out, ["c"])
    assert spent == {}
    with pytest.raises(Exception):  # noqa: B017
        r.run({"l": layer}, ["bad"], crash_early=True)
    names = [m.name for m in default_registry().order()]
    assert names.index("node_degrees") < names.index("section_id") < names.index("dead_end_section")
