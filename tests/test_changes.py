"""Streams of item changes against a walk in order, with replays and a restart; snapshots; split statement files."""

import random
from decimal import Decimal

import pytest

from tavola.sources import corpus, snapshots
from tavola.streaming import changes, jobs
from tests.conftest import rows

SCHEMA = "item_id long, version long, old_order_id long, order_id long, qty int, price_at_order decimal(12,2)"


def log(seed):
    rng = random.Random(seed)
    place, version, out = {}, {}, []
    for _ in range(300):
        item = rng.randrange(40)
        old = place.get(item)
        new = None if old is not None and rng.random() < 0.3 else rng.randrange(12)
        version[item] = version.get(item, 0) + 1
        out.append((item, version[item], old, new, rng.choice([1, 2, 3, None]), Decimal(rng.randrange(1, 900)) / 100))
        if new is None:
            place.pop(item)
        else:
            place[item] = new
    return out


def walk(made):
    now, seen = {}, set()
    for item, _, old, new, qty, price in made:
        seen |= {o for o in (old, new) if o is not None}
        now.pop(item, None)
        if new is not None:
            now[item] = (new, (qty or 0) * price)
    return {o: sum((v for place, v in now.values() if place == o), Decimal(0)) for o in seen}


def test_totals_follow_changes(spark, tmp_path):
    made = log(1)
    folder, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    rng = random.Random(2)
    # The second part repeats changes of the first; parts are shuffled, so later changes come before earlier ones.
    for part in (made[:150], made[150:] + rng.sample(made[:150], 60), made[:20]):
        part = rng.sample(part, len(part))
        spark.createDataFrame([*part, (None, 1, None, 1, 1, Decimal(1)), (1, None, None, 1, 1, Decimal(1))], SCHEMA).repartition(2).write.mode("append").parquet(folder)
        jobs.run(changes.order_totals(jobs.read_files(spark, folder, "*.parquet")), "update", out, state)
    got = {r["order_id"]: r["total_amount"] for r in jobs.latest(jobs.results(spark, out), ["order_id"]).collect()}
    assert got == walk(made)


def test_snapshot_is_all_or_nothing(spark, tmp_path):
    base = str(tmp_path / "store")
    one = spark.createDataFrame([(1,)], "id int")
    assert snapshots.versions(spark, base) == []
    with pytest.raises(FileNotFoundError):
        snapshots.read(spark, base)
    assert snapshots.commit(spark, base, {"orders": one, "batches": one}) == 1
    broken = spark.range(3).selectExpr("assert_true(id < 2, 'broken') AS x", "id")
    with pytest.raises(Exception, match="broken"):
        snapshots.commit(spark, base, {"orders": one.union(one), "batches": broken})
    seen = snapshots.read(spark, base)
    assert seen["orders"].count() == 1 and seen["batches"].count() == 1
    assert snapshots.commit(spark, base, {"orders": one.union(one)}, expected=1) == 2
    with pytest.raises(snapshots.Conflict):
        snapshots.commit(spark, base, {"orders": one}, expected=1)
    assert snapshots.versions(spark, base) == [1, 2]
    assert snapshots.read(spark, base)["orders"].count() == 2 and snapshots.read(spark, base, 1)["orders"].count() == 1


def test_split_file_equals_whole_text(spark, tmp_path):
    rng = random.Random(3)
    lines = ["SELECT 0;", ""]
    for n in range(1, 200):
        lines.append(f"  {n}. question {n}" if n % 9 else f"{n}) other {n}")
        lines += rng.choice([["SELECT 1;"], ["", "select a", "  from b; select c"], ["WITH x AS (", "SELECT ';')", "SELECT * FROM x"], ["no statement"], []])
    path = tmp_path / "q.txt"
    path.write_text("\n".join(lines))
    whole = corpus.statements_of(spark.read.text(str(path), wholetext=True))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
    try:
        assert spark.read.text(str(path)).rdd.getNumPartitions() > 5
        got = rows(corpus.read_statements_split(spark, str(path)), "section", "description", "part", "sql")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == rows(whole, "section", "description", "part", "sql") and len(got) > 100


def test_state_has_a_row_for_many_orders(spark, tmp_path):
    """No call to the state for each item: 40 orders of 3 items are two rows."""
    folder = str(tmp_path / "in")
    spark.createDataFrame([(10 * o + i, 1, None, o, 1, Decimal(2)) for o in range(40) for i in range(3)], SCHEMA).write.parquet(folder)
    stream = changes.order_totals(jobs.read_files(spark, folder, "*.parquet"))
    run = stream.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True)
    seen = []
    query = run.foreachBatch(lambda batch, _: seen.extend(r["total_amount"] for r in batch.collect())).start()
    query.awaitTermination()
    assert seen == [Decimal(6)] * 40
    assert max(p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators) == 2
