from pyspark.sql import functions as F

from larkspur.operators import embedding_cache as C


def test_hits_misses_and_what_is_kept(spark):
    at = lambda day: F.lit(day).cast("timestamp_ntz")
    texts = spark.createDataFrame([(1, "Heart  rate", "m"), (2, "heart rate ", "m"), (3, "heart rate", "n"), (4, None, "m"), (5, "old", "m"), (6, "new\ntext", "m"), (7, "New text", "m"), (8, "x", None)], "id int, text string, model string")
    known = spark.createDataFrame([("heart rate", "m", 1.0, "2024-03-01"), ("heart rate", "m", 2.0, "2024-03-02"), ("heart rate", "m", 3.0, "2025-01-01"), ("old", "m", 4.0, "2023-01-01")], "text string, model string, v double, day string")
    cache = known.select(C.cache_key(F.col("text"), F.col("model")).alias("cache_key"), F.array("v").alias("embedding"), F.col("day").cast("timestamp_ntz").alias("created_at"))
    found = C.looked_up(texts, cache, at("2024-03-05"))
    assert {r.id: (r.hit, r.embedding) for r in found.collect()} == {1: (True, [2.0]), 2: (True, [2.0]), **{i: (False, None) for i in range(3, 9)}}
    fetch = C.to_fetch(found)
    assert sorted((r.model, r.text) for r in fetch.collect()) == [("m", "New text"), ("m", "old"), ("n", "heart rate")]
    after = C.stored(cache, fetch.select("cache_key", F.array(F.lit(9.0)).alias("embedding")), at("2024-03-05"))
    again = C.looked_up(texts, after, at("2024-03-06"))
    assert {r.id for r in again.where("hit").collect()} == {1, 2, 3, 5, 6, 7} and after.count() == 4
    assert C.looked_up(texts, cache.limit(0), at("2024-03-05")).where("hit").count() == 0 and C.to_fetch(found.limit(0)).count() == 0
