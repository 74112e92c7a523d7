"""Hand-made edge cases and properties of the time-series operators."""

import datetime as dt

import duckdb
import numpy as np
import pytest
from pyspark.errors import ArithmeticException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridcast import config
from gridcast.functions import columns
from gridcast.operators import calendar, forecasts, screening, split_scale, timegrid, windows
from gridcast.plans.registry import ORACLES, QUERIES
from gridcast.sources import series, sinks
from gridcast.streaming.resample import event_stream, resample_stream

DAY0 = dt.date(2024, 1, 1)


def days(n, value=lambda k: k, key="a"):
    return [(key, DAY0 + dt.timedelta(days=k), value(k)) for k in range(n)]


def test_screening_priority(spark):
    wave = lambda k: k % 17 + 1
    rows = days(259, wave, "short") + days(260, wave, "long_enough") + days(300, lambda k: 5, "const")
    rows += days(300, lambda k: None if k == 3 else -1 if k == 4 else wave(k), "null_first")
    rows += days(300, lambda k: -1 if k == 4 else wave(k), "neg") + days(300, lambda k: 10_000 if k == 4 else wave(k), "out")
    df = spark.createDataFrame(rows, "id string, day date, nb long")
    got = {r["id"]: r["status"] for r in screening.screen(df).collect()}
    assert got == {"short": "few", "long_enough": "valid", "const": "zero_variance", "null_first": "null", "neg": "negative", "out": "outlier"}
    assert {r["status"]: r["n"] for r in screening.summary(screening.screen(df)).collect()}["valid"] == 1
    assert {r["id"] for r in screening.keep_valid(df, screening.screen(df)).select("id").distinct().collect()} == {"long_enough"}
    assert "neg" not in {r["id"] for r in screening.exclude(df, ["neg", "243"]).collect()}
    assert screening.outlier_rows(df).filter("id = 'out'").count() == 1


def grid(spark, values, minutes=False):
    rows = [("a", DAY0, h, v) for h, v in values.items()]
    return timegrid.complete(spark.createDataFrame(rows, "i string, day date, hr int, nb long"), ["i", "day"], ["hr"])


def test_fill_of_leading_trailing_and_empty(spark):
    g = grid(spark, {3: 30, 10: 100, 19: 190})
    got = {r["hr"]: r["nb"] for r in timegrid.fill(g, ["i", "day"], ["hr"]).collect()}
    assert [got[h] for h in (0, 2, 3, 9, 10, 18, 19, 23)] == [30, 30, 30, 30, 100, 100, 190, 190] and len(got) == 24
    forward = {r["hr"]: r["nb"] for r in timegrid.fill(g, ["i", "day"], ["hr"], backward=False).collect()}
    assert forward[2] is None and forward[23] == 190
    once = timegrid.fill(g, ["i", "day"], ["hr"])
    assert sorted(map(tuple, timegrid.fill(once, ["i", "day"], ["hr"]).collect())) == sorted(map(tuple, once.collect()))
    empty = timegrid.fill(grid(spark, {5: None}), ["i", "day"], ["hr"])
    assert empty.filter("nb IS NOT NULL").count() == 0
    assert {r["nb"] for r in empty.select(columns.zero_filled(F.col("nb")).alias("nb")).collect()} == {0.0}


def test_keep_first_and_align_without_fan_out(spark):
    rows = [("a", DAY0, 1, 2, 9, 90), ("a", DAY0, 1, 2, 4, 40), ("a", DAY0, 1, 3, 1, 10)]
    df = spark.createDataFrame(rows, "i string, day date, hr int, mi int, ord int, nb long")
    got = sorted(tuple(r) for r in timegrid.keep_first(df, ["i", "day", "hr", "mi"], ["ord"]).select("mi", "ord", "nb").collect())
    assert got == [(2, 4, 40), (3, 1, 10)]
    day = spark.createDataFrame([("a", DAY0, 5)], "i string, day date, nb long")
    hour = spark.createDataFrame([("a", DAY0, h, h) for h in range(24)], "i string, day date, hr int, nb long")
    ten = spark.createDataFrame([("a", DAY0, h, m, h * 10 + m) for h in range(24) for m in range(6)], "i string, day date, hr int, mi int, nb long")
    got = timegrid.align(day, hour, ten)
    assert got.count() == 144 and got.filter("nb_10min <> hr * 10 + mi").count() == 0


@pytest.mark.parametrize(("n", "want"), [(10, (6, 1, 3)), (1, (0, 0, 1)), (0, (0, 0, 0)), (101, (60, 10, 31))])
def test_split_sizes(spark, n, want):
    df = spark.createDataFrame(days(n), "i string, day date, nb long")
    got = split_scale.split(split_scale.positions(df)).collect()
    assert tuple(sum(r["split"] == s for r in got) for s in ("train", "val", "test")) == want
    order = [r["split"] for r in sorted(got, key=lambda r: r["pos"])]
    assert order == sorted(order, key=["train", "val", "test"].index) and [r["pos"] for r in sorted(got, key=lambda r: r["day"])] == list(range(n))


def test_share_guard_and_modes(spark):
    with pytest.raises(ValueError):
        config.check_shares(0.6, 0.1, 0.5)
    df = spark.createDataFrame(days(10), "i string, day date, nb long")
    parted = split_scale.split(split_scale.positions(df))
    with pytest.raises(ValueError):
        split_scale.scaling(parted, 1)
    with pytest.raises(ValueError):
        split_scale.scaling(parted, 3, parted)
    rows, scalers = split_scale.scaling(parted)
    got = {r["pos"]: r["y"] for r in rows.collect()}
    assert got[0] == 0.0 and got[5] == 1.0 and got[9] == 9 / 5  # beyond the training range, not clipped
    back, _ = split_scale.scaling(rows.select("i", "pos", "y"), 2, scalers, value="y", out="nb")
    assert all(abs(r["nb"] - r["pos"]) < 1e-9 for r in back.collect())
    const = split_scale.split(split_scale.positions(spark.createDataFrame(days(10, lambda k: 7), "i string, day date, nb long")))
    assert {r["y"] for r in split_scale.scaling(const)[0].collect()} == {0.0}


@pytest.mark.parametrize("block", [4096, 7])
def test_windows_equal_numpy(spark, block):
    values = np.random.default_rng(0).random(83).tolist()
    rows = [("a", "train", 100 + k, v) for k, v in enumerate(values)] + [("a", "test", 200 + k, v) for k, v in enumerate(values[:12])]
    rows += [("a", "val", 300 + k, 0.0) for k in range(11)] + [("b", "test", k, float(k)) for k in range(40)]
    df = spark.createDataFrame(rows, "i string, split string, pos long, y double").repartition(5)
    got = windows.sliding_windows(df, 9, 3, block=block).collect()
    for key, split, v, step in (("a", "train", values, 5), ("a", "test", values[:12], 1), ("b", "test", list(map(float, range(40))), 1)):
        want = np.lib.stride_tricks.sliding_window_view(np.array(v), 12)[::step]
        own = sorted((r for r in got if (r["i"], r["split"]) == (key, split)), key=lambda r: r["win_idx"])
        assert [r["win_idx"] for r in own] == list(range(len(want)))
        assert all(r["x"] + r["y"] == w.tolist() for r, w in zip(own, want, strict=True))
    assert not [r for r in got if r["split"] == "val"]
    with pytest.raises(ValueError):
        windows.sliding_windows(df, 9, 3, strict=True)


def test_window_exports(spark, tmp_path):
    rows = [("a", "test", k, float(k)) for k in range(6)]
    w = windows.sliding_windows(spark.createDataFrame(rows, "i string, split string, pos long, y double"), 2, 1)
    sinks.export_windows_csv(w, f"file://{tmp_path}/csv", 2, 1)
    back = spark.read.option("header", True).csv(f"file://{tmp_path}/csv")
    assert back.columns == ["i", "split", "win_idx", "x_0", "x_1", "y_0"] and back.count() == 4
    again = sinks.read_windows_csv(spark, f"file://{tmp_path}/csv", 2, 1)
    key = lambda r: r["win_idx"]
    assert sorted(again.collect(), key=key) == sorted(w.collect(), key=key)
    sinks.write_windows(w, f"file://{tmp_path}/w", "7-1", "day")
    assert sinks.read_windows(spark, f"file://{tmp_path}/w", "7-1", "day", "test").count() == 4
    for _ in range(2):
        sinks.append_metrics(spark.createDataFrame([("gru", 0.5)], "model string, rmse double"), f"file://{tmp_path}/m")
    assert spark.read.parquet(f"file://{tmp_path}/m").count() == 2
    sinks.export_metrics_csv(spark.read.parquet(f"file://{tmp_path}/m"), f"file://{tmp_path}/mc")
    (part,) = (tmp_path / "mc").glob("part-*.csv")
    assert part.read_text().split() == ["model,rmse", "gru,0.5", "gru,0.5"]


def test_metric_edges(spark):
    df = spark.createDataFrame([("zero", 0.0, 0.0), ("zero", 0.0, 0.0), ("opp", 1.0, -1.0), ("opp", 2.0, -2.0)], "i string, y double, yp double")
    got = {r["i"]: r for r in forecasts.metrics(df, "i").collect()}
    assert got["zero"]["smape"] == 0 and got["zero"]["nrmse"] is None and got["opp"]["smape"] == 100
    y, p = np.random.default_rng(1).random((2, 50))
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(y, p)], "y double, yp double")
    r = forecasts.metrics(df).first()
    assert np.isclose(r["rmse"], np.sqrt(np.mean((y - p) ** 2))) and np.isclose(r["nrmse"], r["rmse"] / np.ptp(y)) and 0 <= r["smape"] <= 100


def test_calendar_month_end(spark):
    rows = [(k + 1, dt.datetime(2023, 2, 26) + dt.timedelta(days=d)) for k, d in enumerate([0, 1, 2, 4, 5])]  # 1 March is missing
    times = spark.createDataFrame(rows, "id_time long, time timestamp")
    assert [r["id_time"] for r in calendar.gap_report(times, "day").collect()] == [4]
    assert [(r["id_time"], r["gap"]) for r in calendar.real_gaps(times, 86_400).collect()] == [(4, 172_800)]


def test_partition_invariance(spark):
    rows = [(f"e{k % 3}", DAY0 + dt.timedelta(days=k // 3), k * 7 % 11) for k in range(240)]
    seen = []
    for parts in (1, 4, 50):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        df = spark.createDataFrame(rows, "i string, day date, nb long").repartition(parts)
        scaled, _ = split_scale.scaling(split_scale.split(split_scale.positions(df)))
        w = windows.sliding_windows(scaled, 5, 2)
        seen.append(sorted((r["i"], r["split"], r["win_idx"], *r["x"], *r["y"]) for r in w.collect()))
    spark.conf.set("spark.sql.shuffle.partitions", 8)
    assert seen[0] == seen[1] == seen[2] and seen[0]


def test_columns(spark):
    df = spark.createDataFrame([(None,), (7.0,), (243.9,)], "x double")
    assert [r[0] for r in df.select(columns.normalised_entity(F.col("x"))).collect()] == ["30", "7", "243"]
    assert spark.range(1).select(columns.day_key(F.lit(None), F.lit("d"))).first()[0] is None


@pytest.mark.parametrize("kind, raw, want", [
    ("long", [None, 0, -7, 32767, 32768, -32769, 65566, 2**53 + 1, 2**63 - 1], ["30", "0", "-7", "32767", "32768", "-32769", "65566", "9007199254740993", "9223372036854775807"]),
    ("double", [None, 7.0, -0.5, 32768.9, -40000.9, 89999.0], ["30", "7", "0", "32768", "-40000", "89999"]),
    ("string", [None, "30.0", " 8 ", "89999.0", "9007199254740993"], ["30", "30", "8", "89999", "9007199254740993"]),
])
def test_entities_past_a_short_stay_apart(spark, kind, raw, want):
    df = spark.createDataFrame([(k, x) for k, x in enumerate(raw)], f"k int, x {kind}")
    got = df.select("k", columns.normalised_entity(F.col("x"))).collect()
    assert [r[1] for r in sorted(got)] == want


@pytest.mark.parametrize("x", [float("nan"), float("inf"), 1e19])
def test_entities_that_are_no_whole_number_are_errors(spark, x):
    with pytest.raises(ArithmeticException):
        spark.createDataFrame([(x,)], "x double").select(columns.normalised_entity(F.col("x"))).collect()


def test_normalised_ids_of_more_users_than_a_short_counts(spark, tmp_path):
    """Copies of the events with shifted users: the SQL's id where it has one, the user's own beyond."""
    con = duckdb.connect()
    con.execute("CREATE TABLE events AS SELECT event_id + k * 1000 AS event_id, user_id + k * 15000 AS user_id FROM '/root/testdata/sf0.001/events.parquet', range(4) t(k)")
    con.execute("INSERT INTO events VALUES (4000, NULL)")
    con.execute(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    users = dict(con.execute("SELECT event_id, user_id FROM events").fetchall())
    con.execute("DELETE FROM events WHERE user_id > 32767")
    want = {e: str(u) for e, u in users.items()} | dict(con.execute(ORACLES["normalize_institution_id"]).fetchall())
    got = QUERIES["normalize_institution_id"](spark, str(tmp_path)).collect()
    assert len(got) == len(want) == 4001 and dict(map(tuple, got)) == want and want[4000] == "30"
    assert max(users[e] for e in users if users[e] is not None) > 32767


def test_csv_sources(spark, tmp_path):
    (tmp_path / "12.csv").write_text("id_time,n_bytes\n2,5\n1,\n")
    (tmp_path / "7.csv").write_text("id_time,n_bytes\n1,3.5\n")
    got = sorted(tuple(r) for r in series.scan_entities(spark, f"file://{tmp_path}").fillna(-1).collect())
    assert got == [("12", 1, -1.0), ("12", 2, 5.0), ("7", 1, 3.5)]
    (tmp_path / "times").mkdir()
    (tmp_path / "times" / "t.csv").write_text("id_time,time\n1,2024-01-01 00:10:00+00:00\n")
    row = series.read_times(spark, f"file://{tmp_path}/times").select(F.date_format("time", "HH:mm")).first()
    assert row[0] == "00:10"


def test_stream_equals_batch(spark, tmp_path):
    rows = [(1 + k % 2, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=7 * k), k) for k in range(300)]
    schema = "i long, ts timestamp, nb long"
    spark.createDataFrame(rows[:200], schema).coalesce(1).write.parquet(f"file://{tmp_path}/in", mode="append")
    spark.createDataFrame([*rows[200:], (1, dt.datetime(2024, 2, 1), 0)], schema).coalesce(1).write.parquet(f"file://{tmp_path}/in", mode="append")
    struct = T.StructType([T.StructField("i", T.LongType()), T.StructField("ts", T.TimestampType()), T.StructField("nb", T.LongType())])
    out = resample_stream(event_stream(spark, f"file://{tmp_path}/in", struct, 1), "hour", late="2 days")
    query = out.writeStream.format("memory").queryName("hourly").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
    query.awaitTermination(60)
    got = {(r["i"], r["time"]): r["nb"] for r in spark.table("hourly").collect()}
    want = {}
    for i, ts, nb in rows:
        key = (i, ts.replace(minute=0))
        want[key] = want.get(key, 0) + nb
    assert got == want
