"""Landed files, sinks and the model layer."""

import json

from pyspark.sql import functions as F

from tickloom.operators import models
from tickloom.sources.landed import Settings, capabilities, dedup_bars, first_pages, landed_json
from tickloom.sources.sinks import as_json, markdown, write_events


def test_landed_json_skips_empty_files_and_keeps_first(spark, tmp_path):
    for i, rows in enumerate(([{"date": "2024-01-02 09:30:00", "open": 1.0, "close": 2.0}], [], [{"date": "2024-01-02 09:30:00", "open": 5.0}])):
        (tmp_path / f"{i}.json").write_text(json.dumps(rows))
    rows = landed_json(spark, f"{tmp_path}/*.json").withColumns({"symbol": F.lit("s"), "ts": F.col("date")})
    assert rows.count() == 2 and dedup_bars(rows, "open").collect()[0]["open"] == 1.0


def test_first_pages_and_capabilities(spark):
    pages = spark.createDataFrame([(0, 1), (0, 2), (1, 3), (2, 4), (2, 5)], "page int, id int")
    assert {r["id"] for r in first_pages(pages, "page", 2).collect()} == {1, 2, 3}
    seen = spark.createDataFrame([("a", 200), ("a", 402), ("b", 200)], "endpoint string, status int")
    assert {r["endpoint"]: r["available"] for r in capabilities(seen).collect()} == {"a": False, "b": True}
    assert Settings.from_dict({"ret_z": 3, "other": 1}).ret_z == 3


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1.23456, float("nan"))], "k string, x double, y double")
    assert json.loads(as_json(rows, "k").collect()[0]["json"]) == {"k": "a", "x": 1.2346}
    write_events(rows, f"{tmp_path}/t", ["k"])
    assert spark.read.parquet(f"{tmp_path}/t").count() == 1
    assert markdown(rows, ["k", "x"]).splitlines()[2] == "| a | 1.2346 |"


def test_purged_rows_keep_off_the_test_span(spark):
    rows = models.folds(spark.range(100).select(F.col("id").alias("pos"), (F.col("id") + 5).alias("stop")), "pos", 4)
    assert rows.where("fold = 0").count() == 30 and rows.select("fold").distinct().count() == 5
    lo = rows.where("fold = 2").agg(F.min("pos")).first()[0]
    kept = models.purged(rows, 2, "pos", "stop", 7)
    assert kept.count() and kept.agg(F.max("stop")).first()[0] < lo - 7


def test_catalysts_take_all_items_in_turn(spark, tmp_path):
    import datetime as dt

    from tickloom.sources.market import catalysts

    events = [(i, dt.datetime(2024, 1, 2) + dt.timedelta(minutes=i), i, "error", 1.0 + i, '{"k": 1}') for i in range(60)]
    spark.createDataFrame(events, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    spark.createDataFrame([(10 * i + 3, f"item {i}") for i in range(7)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["news_id"]: r["headline"] for r in catalysts(spark, str(tmp_path)).collect()}
    assert got == {i: f"item {i % 7}" for i in range(60)}
