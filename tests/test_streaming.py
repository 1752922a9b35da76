import numpy as np
from pyspark.sql import functions as F

from tessera.operators import stats
from tessera.sources import tiff, tiff_format as T
from tessera.streaming import statistics as S


def run(df, name, mode):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return query


def test_stream_equals_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    run(S.windowed_statistics(stream, "ts", "value", "event_type", late="400 days"), "w", "complete")
    want = S.windowed_statistics(events, "ts", "value", "event_type")
    got = spark.table("w")
    assert got.count() == want.count() and got.exceptAll(want).isEmpty()


def test_arriving_rasters(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"{k}.tif").write_bytes(T.write_tiff([(np.full((4, 5), k, np.uint8), T.Layout(T.LZW))]))
    pixels = tiff.pixels(S.arriving_files(spark, str(tmp_path))).select("path", F.explode("data").alias("value"))
    flags = {c: F.lit(False) for c in ("is_nodata", "is_masked", "is_alpha0")}
    run(pixels.withColumns(flags).groupBy("path").agg(F.count_if(stats.valid(F.col("value"))).alias("n"), F.max("value").alias("hi")), "r", "complete")
    assert sorted((r.path[-5], r.n, r.hi) for r in spark.table("r").collect()) == [("0", 20, 0.0), ("1", 20, 1.0), ("2", 20, 2.0)]
