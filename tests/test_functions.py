import math

import pytest
from pyspark.sql import functions as F

from tessera.functions import crs, markup, numbers, text
from tessera.operators import sizes
from tessera.sources import config


def lonlat_to_utm(lon, lat, zone):
    """The forward series, in plain Python."""
    n = crs.N1
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    p, d = math.radians(lat), math.radians(lon - (zone * 6 - 183))
    k = 2 * math.sqrt(n) / (1 + n)
    t = math.sinh(math.atanh(math.sin(p)) - k * math.atanh(k * math.sin(p)))
    xi, eta = math.atan2(t, math.cos(d)), math.atanh(math.sin(d) / math.sqrt(1 + t * t))
    x = sum(a * math.cos(2 * j * xi) * math.sinh(2 * j * eta) for j, a in enumerate(alpha, 1)) + eta
    y = sum(a * math.sin(2 * j * xi) * math.cosh(2 * j * eta) for j, a in enumerate(alpha, 1)) + xi
    return crs.EASTING + crs.SCALE * crs.RADIUS * x, crs.SCALE * crs.RADIUS * y


def test_utm_round_trip(spark):
    places = [(-123.0, 45.0, 10), (-120.2, 60.5, 10), (3.0, 0.0, 31), (8.9, 47.4, 32)]
    rows = [(lon, lat, z, *lonlat_to_utm(lon, lat, z)) for lon, lat, z in places]
    df = spark.createDataFrame(rows, "lon double, lat double, z int, x double, y double")
    lon, lat = crs.utm_to_lonlat(F.col("z"), F.col("x"), F.col("y"))
    for r in df.select("lon", "lat", lon.alias("a"), lat.alias("b")).collect():
        assert r.a == pytest.approx(r.lon, abs=1e-8) and r.b == pytest.approx(r.lat, abs=1e-8)
    assert lonlat_to_utm(3.0, 0.0, 31) == pytest.approx((500000.0, 0.0))


def test_wkt():
    wkt = 'PROJCS["a, b",GEOGCS["g",AUTHORITY["EPSG","4326"]],PARAMETER["x",1],AUTHORITY["EPSG","32610"]]'
    d = markup.wkt_description(wkt)
    assert (d["kind"], d["name"], d["code"]) == ("PROJCS", "a, b", 32610)
    lines = markup.wkt_indented(wkt).split("\n")
    assert lines[0] == 'PROJCS["a, b",' and lines[1] == '    GEOGCS["g",' and len(lines) == 5
    assert markup.wkt_description("plain") == dict.fromkeys(("kind", "name", "code", "horizontal", "vertical"))


def test_texts(spark):
    one = spark.range(1)
    show = lambda c: one.select(c).first()[0]
    assert show(numbers.duration(F.lit(3725.4))) == "1h 2m 5s"
    assert show(numbers.dms(F.lit(-1.5), "N", "S")) == "1° 30' 00.00\" S"
    assert show(text.slug(F.lit("  A b/C! "))) == "a-bc"
    assert show(text.markdown_row(F.lit("a|b"), F.lit("x\ny"))) == "| a\\|b | x<br>y |"
    assert show(markup.significant(F.lit(-0.0))) == "0" and show(markup.significant(F.lit(1234567.89))) == "1234568"
    assert show(markup.decoded(F.lit(b"caf\xe9"))) == "café" and show(markup.decoded(F.lit("é".encode()))) == "é"
    assert show(markup.pretty_json(F.lit("{]"))) is None


def test_bounded(spark):
    assert sizes.bounded(spark.range(5), 5).count() == 5 and sizes.bounded(spark.range(6), 5).count() == 6
    assert "BroadcastHashJoin" in spark.range(9).join(sizes.bounded(spark.range(5)), "id")._jdf.queryExecution().toString()


def test_config(spark, tmp_path):
    assert config.setting("[a.b]\nc = 3", "a.b.c") == 3 and config.setting("x = 1", "x.y", 0) == 0
    assert config.preset("gpm") == config.preset("error")
    with pytest.raises(ValueError):
        config.preset("nothing")
    config.write_lookup(spark.createDataFrame([("B", 2), ("a", 1), ("A", 5)], "name string, code long"), f"{tmp_path}/l")
    assert {(r.name, r.code) for r in config.read_lookup(spark, f"{tmp_path}/l").collect()} == {("a", 1), ("b", 2)}


def test_geokey_numbers_as_sql_writes_them(spark, tmp_path):
    """Signed zeros, halves whose doubles lie below, large and small numbers, nulls: rounding and digits are DuckDB's."""
    import duckdb

    from tessera.plans import lookup_queries

    values = [-0.0, 0.0, -0.004, 0.004, -0.005, 1.005, 2.675, -2.675, 1015.015, 0.125, 0.375, 9999999.99, 1e7, -12345678.9, 123456789012345.0, 1e15, 1e16, -1.5e17, 1e300, float("nan"), float("inf"), float("-inf"), None]
    rows = [(i, f"Customer#{i:09d}", v) for i, v in enumerate(values)] + [(len(values), None, 1.5)]
    spark.createDataFrame(rows, "c_custkey long, c_name string, c_acctbal double").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    query, sql = lookup_queries.QUERIES["s07_geokey_decode"]
    got = query(spark, str(tmp_path))
    with duckdb.connect() as db:
        db.sql(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet/*.parquet'")
        want = db.sql(sql)
        assert sorted(map(tuple, got.select(*want.columns).collect()), key=repr) == sorted(want.fetchall(), key=repr)
