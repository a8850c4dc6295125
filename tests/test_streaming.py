"""Streams end with the batch result, over several files and restarts."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tavola.operators import access, guard, inventory, reports
from tavola.sources.chain import Chain
from tavola.streaming import jobs
from tests.conftest import rows


def test_totals_over_files_and_restart(spark, data, tmp_path):
    items = Chain(spark, data).items
    folder, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    items.where("order_id % 3 = 0").repartition(3).write.parquet(folder)
    jobs.run(jobs.order_totals(jobs.read_files(spark, folder, "*.parquet")), "update", out, state)
    items.where("order_id % 3 <> 0 OR order_id < 300").repartition(2).write.mode("append").parquet(folder)
    jobs.run(jobs.order_totals(jobs.read_files(spark, folder, "*.parquet")), "update", out, state)

    got = jobs.latest(jobs.results(spark, out), ["order_id"])
    whole = spark.read.parquet(folder)
    orders = whole.select(F.col("order_id").alias("id")).distinct()
    assert rows(got) == rows(inventory.order_totals(orders, whole))
    assert jobs.results(spark, out).select("batch").distinct().count() == 2


def by_hour(log):
    return log.groupBy("restaurant_id", F.date_trunc("hour", F.col("order_time").cast("timestamp")).alias("hour_start")).agg(
        F.count(F.lit(1)).alias("orders_count"))


def test_hourly_load_in_any_form_and_order(spark, data, tmp_path):
    log = Chain(spark, data).order_log
    want = rows(by_hour(log))
    keys = ["restaurant_id", "hour_start"]
    for name, parts in (("one", 1), ("folder", 3), ("scattered", 5)):
        folder = str(tmp_path / name)
        log.orderBy(F.xxhash64("id")).repartition(parts).write.parquet(f"{folder}/log.parquet")
        for batch in (None, 1):
            stream = jobs.hourly_load(jobs.read_files(spark, folder, "log.parquet", batch))
            assert rows(jobs.finished(stream, "update", lambda r: jobs.latest(r, keys))) == want


def test_dropped_rows_are_counted(spark, tmp_path):
    at = dt.datetime(2024, 1, 1, 12)
    folder = str(tmp_path / "in")
    dropped = []
    for hours in ((0, 9), (0, 20)):
        made = spark.createDataFrame([(1, at + dt.timedelta(hours=h)) for h in hours], "restaurant_id int, order_time timestamp")
        made.coalesce(1).write.mode("append").parquet(folder)
        stream = jobs.hourly_load(jobs.read_files(spark, folder, "*.parquet"), "1 hour")
        jobs.run(stream, "append", str(tmp_path / "out"), str(tmp_path / "state"), dropped)
    assert dropped[0] == 0 and dropped[1] >= 1


def test_late_rows_are_dropped_behind_the_watermark(spark, tmp_path):
    at = dt.datetime(2024, 1, 1, 12)
    folder = str(tmp_path / "in")

    def put(*hours):
        data = [(1, at + dt.timedelta(hours=h)) for h in hours]
        spark.createDataFrame(data, "restaurant_id int, order_time timestamp").coalesce(1).write.mode("append").parquet(folder)

    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    put(0, 9)
    jobs.run(jobs.hourly_load(jobs.read_files(spark, folder, "*.parquet"), "1 hour"), "append", out, state)
    put(0, 20)
    jobs.run(jobs.hourly_load(jobs.read_files(spark, folder, "*.parquet"), "1 hour"), "append", out, state)
    got = {r["hour_start"]: r["orders_count"] for r in jobs.results(spark, out).collect()}
    assert got[at] == 1


def test_screening_matches_batch(spark, data, tmp_path):
    log = Chain(spark, data).sql_log.select("log_id", "sql")
    folder = str(tmp_path / "in")
    log.repartition(2).write.parquet(folder)
    stream = jobs.screened(jobs.read_files(spark, folder, "*.parquet"))
    got = jobs.results(spark, jobs.run(stream, folder=str(tmp_path / "out"))).drop("batch")
    assert rows(got, "log_id", "layer", "allowed", "reason") == rows(guard.scan(log), "log_id", "layer", "allowed", "reason")


def test_live_load_equals_report(spark, data):
    c = Chain(spark, data)
    live = rows(reports.hourly_load(c.order_log, c.restaurants, states=None).agg(F.sum("order_count")))
    assert live == [(c.order_log.count(),)]


def test_guarded_inserts_survive_a_failure_between_the_sinks(spark, tmp_path):
    folder, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    orders = spark.createDataFrame([(i, i % 2) for i in range(20)], "id long, restaurant_id int")
    viewers = spark.createDataFrame([(1, "waiter", 1), (2, "admin", None), (3, "cook", 1)], "user_id long, role string, restaurant_id int")
    made = [(o, u) for o in range(25) for u in (1, 2, 3, 4)]
    spark.createDataFrame(made[:60], "order_id long, user_id long").repartition(2).write.parquet(folder)
    stream = jobs.read_files(spark, folder, "*.parquet")

    def check(rows_):
        return access.check_item_inserts(rows_, orders, viewers)

    def broken(rows_):
        # The first sink reads no rejected row, so it is written; the second one fails.
        return check(rows_).withColumn("user_id", F.when(F.col("accepted"), F.col("user_id")).otherwise(F.raise_error(F.lit("down"))))

    with pytest.raises(Exception, match="down"):
        jobs.run_guarded(stream, broken, out, state)
    jobs.run_guarded(stream, check, out, state)
    spark.createDataFrame(made[60:], "order_id long, user_id long").write.mode("append").parquet(folder)
    good, bad = jobs.run_guarded(jobs.read_files(spark, folder, "*.parquet"), check, out, state)
    want = check(spark.createDataFrame(made, "order_id long, user_id long"))
    assert rows(jobs.results(spark, good).drop("batch")) == rows(want.where("accepted").drop("accepted"))
    assert rows(jobs.results(spark, bad).drop("batch")) == rows(want.where("NOT accepted").drop("accepted"))
