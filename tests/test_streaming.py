import random
from datetime import datetime, timedelta

import pytest

from freshet.operators.temporal import add_antecedent_precipitation_index
from freshet.streaming.stateful import ROCKSDB, antecedent_index, hourly_means, ordered_antecedent_index

T0 = datetime(2024, 1, 1)


def run(spark, tmp_path, rows, schema, build, name, sort):
    for k, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = build(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).option("path", str(tmp_path / "out")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(120)
    return sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select(*sort).collect())


def test_index_carries_its_state_over_batches(spark, tmp_path):
    schema = "station_id string, ts timestamp, rainfall_mm_hr double"
    batches = [[("a", T0, 10.0), ("b", T0, 1.0), ("a", T0 + timedelta(hours=1), 10.0)], [("a", T0 + timedelta(hours=2), 10.0), ("a", T0, 99.0)]]
    got = run(spark, tmp_path, batches, schema, antecedent_index, "api", ["station_id", "ts", "antecedent_precipitation_index"])
    assert [(k, round(v, 6)) for k, _, v in got] == [("a", 10.0), ("a", 19.0), ("a", 27.1), ("b", 1.0)]


def test_rows_of_one_time_in_a_batch_all_count(spark, tmp_path):
    schema = "station_id string, ts timestamp, rainfall_mm_hr double"
    batches = [[("a", T0, 10.0), ("a", T0, 10.0)], [("a", T0, 5.0), ("a", T0 + timedelta(hours=1), 1.0), ("a", T0 + timedelta(hours=1), 1.0)]]
    got = run(spark, tmp_path, batches, schema, antecedent_index, "ties", ["station_id", "ts", "antecedent_precipitation_index"])
    assert sorted(round(v, 6) for _, _, v in got) == [10.0, 17.29, 18.1, 19.0]


def test_hourly_means_behind_the_watermark(spark, tmp_path):
    schema = "station_id string, ts timestamp, x double"
    batches = [[("a", T0, 1.0), ("a", T0 + timedelta(minutes=30), 3.0)], [("a", T0 + timedelta(hours=9), 5.0)]]
    got = run(spark, tmp_path, batches, schema, lambda s: hourly_means(s, ["x"], keys=["station_id"]), "means", ["station_id", "ts", "x"])
    assert got == [("a", T0, 2.0)]


@pytest.fixture
def rocksdb(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


RAIN = "station_id string, ts timestamp, rainfall_mm_hr double"
INDEX = ["station_id", "ts", "antecedent_precipitation_index"]
#: Passes the watermark over all rows before it.
LAST = ("z", T0 + timedelta(days=30), 0.0)


def shuffled(seed):
    """Rows of three stations, each at most three hours behind the newest that came before it."""
    rng = random.Random(seed)
    rows = [(k, T0 + timedelta(minutes=20 * i), None if (k, i) == ("c", 30) else round(rng.uniform(0, 9), 2)) for i in range(40) for k in "abc" if (k, i % 7) != ("b", 3)]
    # a place drawn from the three hours after its time: no row comes later than that behind another
    rows.sort(key=lambda r: r[1] + timedelta(minutes=rng.uniform(0, 175)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_any_arrival_order_within_the_watermark_gives_the_batch_result(spark, tmp_path, rocksdb, seed):
    rows = shuffled(seed)
    assert rows != sorted(rows, key=lambda r: r[1])
    batches = [rows[i : i + 23] for i in range(0, len(rows), 23)] + [[LAST]]
    got = run(spark, tmp_path, batches, RAIN, lambda s: ordered_antecedent_index(s, late="3 hours"), "ordered", INDEX)
    batch = add_antecedent_precipitation_index(spark.createDataFrame(rows, RAIN), keys=["station_id"])
    want = sorted(tuple(r) for r in batch.select(*INDEX).collect())
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert all(g[2] == pytest.approx(w[2], abs=1e-9) if w[2] is not None else g[2] is None for g, w in zip(got, want, strict=True))
    assert sum(g[2] is None for g in got) == 10


def test_rows_of_a_quiet_key_are_given_out_by_timer_and_state_stays_small(spark, tmp_path, rocksdb):
    hour = timedelta(hours=1)
    batches = [[("quiet", T0, 1.0), ("a", T0, 1.0)]] + [[("a", T0 + k * 3 * hour, 1.0)] for k in range(1, 5)]
    for part in batches:
        spark.createDataFrame(part, RAIN).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        build = ordered_antecedent_index(spark.readStream.schema(RAIN).parquet(str(tmp_path / "in")))
        q = build.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    held = q.lastProgress["stateOperators"][0]["numRowsTotal"]
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select(*INDEX).collect())
    assert ("quiet", T0, 1.0) in got
    assert [g[1] for g in got if g[0] == "a"] == [T0 + k * 3 * hour for k in range(4)]
    assert held <= 12  # two keys' numbers, one row and one timer with its index, after five batches


def test_rows_behind_the_watermark_nulls_ties_and_rows_without_time_or_key(spark, tmp_path, rocksdb):
    hour = timedelta(hours=1)
    first = [("a", T0, 2.0), ("a", T0, 1.0), ("a", None, 5.0), (None, T0, 5.0), ("n", T0, 1.0), ("n", T0 + hour, float("nan")), ("n", T0 + 2 * hour, 1.0), ("a", T0 + 9 * hour, 1.0)]
    got = run(spark, tmp_path, [first, [("a", T0 + hour, 99.0), ("a", T0 + 8 * hour, 4.0)], [LAST]], RAIN, ordered_antecedent_index, "edges", INDEX)
    assert [(k, (t - T0) / hour, v if v is None else round(v, 6)) for k, t, v in got] == [("a", 0, 1.0), ("a", 0, 2.9), ("a", 8, 6.61), ("a", 9, 6.949), ("n", 0, 1.0), ("n", 1, None), ("n", 2, None)]


def test_replay_of_a_table_file_by_file_and_as_one_batch(spark, tmp_path):
    from freshet.streaming.replay import replay

    hour = timedelta(hours=1)
    path = str(tmp_path / "table")
    for rows in ([("a", T0, 1.0), ("b", T0, 2.0)], [("a", T0 + 9 * hour, 1.0)], [("a", T0 + 10 * hour, 1.0)], [("a", T0 + hour, 5.0), ("a", T0 + 18 * hour, 1.0)]):
        spark.createDataFrame(rows, RAIN).coalesce(1).write.mode("append").parquet(path)
    store = spark.conf.get("spark.sql.streaming.stateStore.providerClass")

    def got(**options):
        rows = replay(spark, path, ordered_antecedent_index, **options).select(*INDEX).collect()
        return sorted((k, (t - T0) / hour, round(v, 6)) for k, t, v in rows)

    assert got() == [("a", 0, 1.0), ("a", 1, 5.9), ("a", 9, 6.31), ("a", 10, 6.679), ("b", 0, 2.0)]  # the last row is still held
    assert got(files_per_trigger=1) == [("a", 0, 1.0), ("a", 9, 1.9), ("a", 10, 2.71), ("b", 0, 2.0)]  # hour 1 came behind the watermark of two batches
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == store


def test_replay_of_an_empty_table_and_of_a_single_file(spark, tmp_path):
    from freshet.streaming.replay import replay

    spark.createDataFrame([], RAIN).write.parquet(str(tmp_path / "none"))
    assert replay(spark, str(tmp_path / "none"), ordered_antecedent_index).count() == 0
    spark.createDataFrame([("a", T0, 1.0), ("a", T0 + timedelta(hours=9), 2.0)], RAIN).coalesce(1).write.parquet(str(tmp_path / "one"))
    (part,) = (tmp_path / "one").glob("part-*")
    part.rename(tmp_path / "readings.parquet")
    rows = replay(spark, str(tmp_path / "readings.parquet"), ordered_antecedent_index).collect()
    assert [(r["station_id"], r["antecedent_precipitation_index"]) for r in rows] == [("a", 1.0)]


def test_shared_folder_is_below_the_checkpoint_folder_and_new_each_time(spark):
    from freshet.sources.shared import shared_folder

    a, b = shared_folder(spark, "x"), shared_folder(spark, "x")
    assert a != b and all(p.startswith(spark.conf.get("spark.checkpoint.dir")) for p in (a, b))


def test_what_a_key_holds_is_one_value(spark, tmp_path, rocksdb):
    rows = [(k, T0 + timedelta(minutes=i), float(i)) for i in range(60) for k in "ab"]
    spark.createDataFrame(rows, RAIN).coalesce(1).write.parquet(str(tmp_path / "in"))
    build = ordered_antecedent_index(spark.readStream.schema(RAIN).parquet(str(tmp_path / "in")))
    q = build.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] == 2
    assert spark.read.parquet(str(tmp_path / "out")).count() == 0
