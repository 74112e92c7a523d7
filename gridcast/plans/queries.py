"""Spark side of the registry: the engine's operators composed over the test tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import PER_DAY, WINDOWS
from ..functions.columns import day_key, normalised_entity, zero_filled
from ..operators import calendar, forecasts, models, sarima, screening, split_scale, timegrid, tuning, windows
from ..session import shared_dir
from ..sources import series, sinks

#: Window of the registered queries: a day in, four hours out.
INPUTS, OUTPUTS = 24, 4
SLOTS = {"day": (), "hour": ("hr",), "10min": ("hr", "mi")}


def _day(df: DataFrame) -> DataFrame:
    """Dates as text, so that engines agree on their type."""
    return df.withColumn("day", F.col("day").cast("string"))


def _series(spark: SparkSession, d: str, granularity: str) -> DataFrame:
    return series.resample(series.events(spark, d), granularity)


def _grid(spark: SparkSession, d: str, granularity: str = "10min") -> DataFrame:
    return timegrid.complete(_series(spark, d, granularity), ["i", "day"], list(SLOTS[granularity]))


def _filled(spark: SparkSession, d: str, granularity: str = "hour") -> DataFrame:
    if granularity == "day":
        return _series(spark, d, "day")
    return timegrid.fill(_grid(spark, d, granularity), ["i", "day"], list(SLOTS[granularity]))


def _split(spark: SparkSession, d: str, granularity: str = "hour") -> DataFrame:
    return split_scale.split(split_scale.positions(_filled(spark, d, granularity), slots=SLOTS[granularity]))


def _scaled(spark: SparkSession, d: str, granularity: str = "hour") -> DataFrame:
    rows, _ = split_scale.scaling(_split(spark, d, granularity))
    return rows.select("i", "pos", "split", "y")


def _windows(spark: SparkSession, d: str) -> DataFrame:
    return windows.sliding_windows(_scaled(spark, d), INPUTS, OUTPUTS)


def _pred(spark: SparkSession, d: str, granularity: str = "hour", lag: int | None = None) -> DataFrame:
    return forecasts.lagged(_scaled(spark, d, granularity), lag or PER_DAY[granularity])


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns or ("rmse", "mae", "nrmse", "smape")})


def _times(spark: SparkSession, d: str, unit: str, by: tuple[str, ...] = ()) -> DataFrame:
    return timegrid.time_dimension(series.events(spark, d), unit, by=by)


def _text(time: str = "time") -> Column:
    return F.date_format(time, "yyyy-MM-dd HH:mm:ss").alias("time")


def _scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/gridcast/{name}-{uuid.uuid4().hex}"


def project_series(spark, d):
    return series.events(spark, d).select("i", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "nb")


def join_time_dim(spark, d):
    times = _times(spark, d, "hour")
    hours = series.events(spark, d).groupBy("i", F.date_trunc("hour", "ts").alias("time")).agg(F.sum("nb").alias("nb"))
    keyed = timegrid.join_times(hours, times, on="time").select("i", "id_time", "nb")
    return timegrid.join_times(keyed, times).select("i", "id_time", _text(), "nb")


def derive_time_keys(spark, d):
    rows = timegrid.with_time_keys(series.events(spark, d))
    rows = rows.withColumn("id", day_key(F.col("i"), F.col("day"), F.col("hr")))
    return _day(rows.select("event_id", "day", "hr", "mi", "sec", "dom", "id"))


def normalize_institution_id(spark, d):
    rows = spark.read.parquet(f"{d}/events.parquet")
    return rows.select("event_id", normalised_entity(F.col("user_id")).alias("id_institution"))


def fill_zero_cast(spark, d):
    return _day(_grid(spark, d, "hour").withColumn("nb", zero_filled(F.col("nb"))))


def screen_institutions(spark, d):
    return screening.screen(series.supplier_series(spark, d))


def quantile_bounds(spark, d):
    return screening.quantile_bounds(series.supplier_series(spark, d))


def outlier_rows(spark, d):
    return _day(screening.outlier_rows(series.supplier_series(spark, d)))


def screening_summary(spark, d):
    return screening.summary(screening.screen(series.supplier_series(spark, d)))


def filter_valid_semi(spark, d):
    rows = series.supplier_series(spark, d)
    return _day(screening.keep_valid(rows, screening.screen(rows)))


def exclude_anti(spark, d):
    return _day(screening.exclude(series.supplier_series(spark, d), ["7", "8", "243"]))


def filter_id_time_gt(spark, d):
    return _times(spark, d, "hour").filter(F.col("id_time") > 700).select("id_time", _text())


def min_length_filter(spark, d):
    return screening.min_length(_series(spark, d, "hour"), INPUTS, OUTPUTS, "i")


def select_institution(spark, d):
    return _scaled(spark, d).filter(F.col("i") == 3)


def distinct_ids(spark, d):
    return _series(spark, d, "day").select("i").distinct()


def distinct_day_rows(spark, d):
    aligned = timegrid.align(_series(spark, d, "day"), _series(spark, d, "hour"))
    return _day(aligned.select("i", "day", F.col("nb_day").alias("nb")).distinct())


def dedup_keep_first(spark, d):
    rows = timegrid.with_time_keys(series.events(spark, d)).select("i", "day", "hr", "mi", "ts", "event_id", "nb")
    return _day(timegrid.keep_first(rows, ["i", "day", "hr", "mi"], ["ts", "event_id"]).drop("ts"))


def join_day_hour(spark, d):
    return _day(timegrid.align(_series(spark, d, "day"), _series(spark, d, "hour")))


def join_day_hour_10min(spark, d):
    return _day(timegrid.align(*(_series(spark, d, g) for g in ("day", "hour", "10min"))))


def grid_spine(spark, d):
    return _day(timegrid.spine(_series(spark, d, "day").select("i", "day"), minutes=True))


def complete_grid(spark, d):
    return _day(_grid(spark, d))


def complete_days(spark, d):
    return _day(timegrid.complete_days(_series(spark, d, "day")))


def forward_fill(spark, d):
    return _day(timegrid.fill(_grid(spark, d), ["i", "day"], ["hr", "mi"], backward=False))


def fill_gaps(spark, d):
    return _day(timegrid.fill(_grid(spark, d), ["i", "day"], ["hr", "mi"]))


def sorted_grid(spark, d):
    rows = split_scale.positions(_grid(spark, d), slots=("hr", "mi"))
    return _day(rows.drop("n").orderBy("i", "pos"))


def lag_diff(spark, d):
    return calendar.lag_diff(_times(spark, d, "hour"), "hour")


def time_gap_report(spark, d):
    """Every entity's time table, at all granularities."""
    parts = {g: calendar.gap_report(_times(spark, d, g, ("i",)), g, ("i",)) for g in PER_DAY}
    return windows.union_granularities(parts)


def real_gaps(spark, d):
    return calendar.real_gaps(_times(spark, d, "hour", ("i",)), 3600, ("i",))


def time_dim_counts(spark, d):
    parts = {g: _times(spark, d, g).agg(F.count("*").alias("n")) for g in PER_DAY}
    return windows.union_granularities(parts)


def temporal_split(spark, d):
    return _split(spark, d).select("i", "pos", "split")


def minmax_fit(spark, d):
    return split_scale.fit_scaler(_split(spark, d))


def minmax_transform(spark, d):
    return _scaled(spark, d).drop("split")


def inverse_scale(spark, d):
    parted = _split(spark, d)
    rows, scalers = split_scale.scaling(parted)
    back, _ = split_scale.scaling(rows.select("i", "pos", "y"), 2, scalers, value="y", out="nb")
    return back.select("i", "pos", F.round("nb", 6).alias("nb"))


def roundtrip_scale(spark, d):
    parted = _split(spark, d)
    rows, scalers = split_scale.scaling(parted)
    back = split_scale.inverse(rows.select("i", "pos", "y", F.col("nb").alias("was")), scalers)
    return back.select("i", "pos", (F.abs(F.col("nb") - F.col("was")) < 1e-6).alias("same"))


def _ends(w: DataFrame) -> DataFrame:
    x, y = (lambda k: F.get("x", F.lit(k)).alias(f"x_{k}")), (lambda k: F.get("y", F.lit(k)).alias(f"y_{k}"))
    return w.select("i", "split", "win_idx", x(0), x(INPUTS - 1), y(0), y(OUTPUTS - 1))


def sliding_windows(spark, d):
    return _ends(_windows(spark, d))


def feature_target_split(spark, d):
    one = _windows(spark, d).select("i", "split", "win_idx", F.concat("x", "y").alias("w"))
    return _ends(windows.feature_target(one, INPUTS, OUTPUTS))


def horizon_slice(spark, d):
    return windows.flatten(windows.horizon(_windows(spark, d), 2))


def flatten_windows(spark, d):
    return windows.flatten(_windows(spark, d))


def roundtrip_windows(spark, d):
    path = _scratch(spark, "windows")
    sinks.write_windows(_windows(spark, d), path, "1-0", "hour")
    read = [sinks.read_windows(spark, path, "1-0", "hour", s) for s in ("train", "val", "test")]
    return _ends(read[0].unionByName(read[1]).unionByName(read[2]))


def roundtrip_windows_csv(spark, d):
    path = _scratch(spark, "windows-csv")
    sinks.export_windows_csv(_windows(spark, d), path, INPUTS, OUTPUTS)
    return _ends(sinks.read_windows_csv(spark, path, INPUTS, OUTPUTS, key_type="long"))


def stored_scalers(spark, d):
    """Scales by the registry that was written for one of two granularities."""
    path = _scratch(spark, "scalers")
    for g in ("day", "hour"):
        sinks.write_scalers(split_scale.fit_scaler(_split(spark, d, g)), path, g)
    rows, _ = split_scale.scaling(_split(spark, d), 1, sinks.read_scalers(spark, path, "hour"))
    return rows.select("i", "pos", "y")


def stored_valid_ids(spark, d):
    path = _scratch(spark, "valid")
    rows = series.supplier_series(spark, d)
    sinks.write_valid(screening.screen(rows), path)
    return _day(rows.join(sinks.read_valid(spark, path), "id", "left_semi"))


def pair_pred_truth(spark, d):
    scaled = _scaled(spark, d)
    truth = scaled.filter(F.col("split") == "test").select("i", "pos", "y")
    return forecasts.pair(truth, _pred(spark, d).drop("y"), ["i", "pos"])


def metrics_overall(spark, d):
    return _rounded(forecasts.metrics(_pred(spark, d)))


def metrics_by_institution(spark, d):
    return _rounded(forecasts.metrics(_pred(spark, d), "i"))


def metrics_by_granularity(spark, d):
    return _rounded(forecasts.metrics(windows.union_granularities({g: _pred(spark, d, g) for g in PER_DAY}), "granularity"))


def _by_model(spark, d) -> DataFrame:
    scaled = _scaled(spark, d)
    parts = [forecasts.lagged(scaled, k).withColumn("model", F.lit(m)) for m, k in (("seasonal", 24), ("last", 1))]
    return parts[0].unionByName(parts[1])


def metrics_by_model(spark, d):
    return _rounded(forecasts.metrics(_by_model(spark, d), "model"))


def metrics_cube(spark, d):
    return _rounded(forecasts.metrics_cube(_by_model(spark, d), "model", "i"))


def metrics_of_windows(spark, d):
    pairs = forecasts.window_mean(_windows(spark, d).filter(F.col("split") == "test"))
    return _rounded(forecasts.metrics_of_windows(pairs, "i"), "rmse", "mae")


def nrmse_train_range(spark, d):
    train = _scaled(spark, d).filter(F.col("split") == "train")
    return _rounded(forecasts.nrmse_train_range(_pred(spark, d), train, "i"), "nrmse")


def rmse_by_horizon(spark, d):
    scalers = split_scale.fit_scaler(_split(spark, d))
    test = _windows(spark, d).filter(F.col("split") == "test")
    test = test.withColumn("yp", F.slice("x", INPUTS - PER_DAY["hour"] + 1, OUTPUTS))
    test = split_scale.inverse_arrays(test, scalers, ("y", "yp"))
    flat = test.select("i", F.posexplode(F.arrays_zip("y", "yp")).alias("step", "v")).select("i", "step", "v.y", "v.yp")
    return _rounded(forecasts.rmse_by_step(flat), "rmse")


def metric_max(spark, d):
    return _rounded(forecasts.metric_max(forecasts.metrics(_by_model(spark, d), "model")), "max_value")


def union_granularities(spark, d):
    def keyed(g: str) -> DataFrame:
        parts = [F.col("day").cast("string"), *(F.lpad(F.col(s).cast("string"), 2, "0") for s in SLOTS[g])]
        return _series(spark, d, g).select("i", F.concat_ws(" ", *parts).alias("ts_key"), "nb")

    return windows.union_granularities({g: keyed(g) for g in PER_DAY})


def _numbered_hours(spark, d) -> DataFrame:
    at = F.row_number().over(timegrid.W.partitionBy("i").orderBy("day", "hr")).cast("long")
    return _series(spark, d, "hour").select("i", at.alias("id_time"), F.col("nb").cast("double").alias("n_bytes"))


def reread_processed(spark, d):
    """Writes the hourly series as CSV with ids as numbers and reads it again."""
    path = _scratch(spark, "processed")
    sinks.write_series_csv(_numbered_hours(spark, d).withColumnRenamed("i", "id_institution"), path)
    schema = T.StructType([T.StructField("id_institution", T.DoubleType()), *series.SERIES.fields])
    return series.read_processed(spark, path, schema)


def scan_time_csv(spark, d):
    """Writes the time dimension as CSV with UTC offsets and reads it again."""
    path = _scratch(spark, "times")
    text = F.date_format(F.col("time").cast("timestamp"), "yyyy-MM-dd HH:mm:ssxxx").alias("time")
    sinks.write_series_csv(_times(spark, d, "hour").select("id_time", text), path)
    return series.read_times(spark, path).select("id_time", _text())


def append_metrics(spark, d):
    """Metrics of one model after the other, appended to one table."""
    path = _scratch(spark, "metrics")
    for model in ("seasonal", "last"):
        sinks.append_metrics(forecasts.metrics(_by_model(spark, d).filter(F.col("model") == model), "model"), path)
    return _rounded(spark.read.parquet(path))


def scan_institution_csv(spark, d):
    """Writes the hourly series as one CSV an entity, named by it, and scans the folder."""
    path = _scratch(spark, "entities")
    hours = _numbered_hours(spark, d)
    hours.repartition("i").write.option("header", True).partitionBy("i").csv(path)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for folder in fs.globStatus(hadoop.Path(f"{path}/i=*")):
        for part in fs.globStatus(hadoop.Path(folder.getPath(), "part-*.csv")):
            fs.rename(part.getPath(), hadoop.Path(path, folder.getPath().getName().removeprefix("i=") + ".csv"))
        fs.delete(folder.getPath(), True)
    return series.scan_entities(spark, path)


def trial_grid(spark, d):
    return tuning.trial_grid(spark, "gru").unionByName(tuning.trial_grid(spark, "mlp"))


def _history(spark, d) -> DataFrame:
    trials = reduce(DataFrame.unionByName, (tuning.trial_grid(spark, kind) for kind in models.KINDS))
    return tuning.run_trials(trials, _windows(spark, d), limit=2000)


def train_history(spark, d):
    return _history(spark, d)


def best_trial(spark, d):
    return tuning.best_trial(_history(spark, d))


def score_model(spark, d):
    w = _windows(spark, d)
    fitted = models.train_on(w, models.Spec("gru", units=32, epochs=3))
    return models.score(w.filter(F.col("split") == "test"), fitted).select("i", "win_idx", "y", "yp")


def train_ten_minute(spark, d):
    """History of the fixed ten-minute model, a week in and a day out, over all windows."""
    inputs, outputs = WINDOWS["7-1"].size("10min")
    fitted = models.train_on(windows.sliding_windows(_scaled(spark, d, "10min"), inputs, outputs), models.TEN_MINUTE)
    rows = [(h["epoch"], k, v) for h in fitted.history for k, v in h.items() if k != "epoch"]
    return spark.createDataFrame(rows, "epoch int, metric string, value double")


def sarima_forecast(spark, d):
    return sarima.forecast_series(_scaled(spark, d), sarima.Order((1, 0, 1), (0, 1, 0, 24)), 24)


def _resampler(granularity: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: _day(_series(spark, d, granularity))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "resample_day": _resampler("day"),
    "resample_hour": _resampler("hour"),
    "resample_10min": _resampler("10min"),
} | {
    f.__name__: f
    for f in (
        project_series, join_time_dim, derive_time_keys, normalize_institution_id, fill_zero_cast,
        screen_institutions, quantile_bounds, outlier_rows, screening_summary, filter_valid_semi, exclude_anti,
        filter_id_time_gt, min_length_filter, select_institution, distinct_ids, distinct_day_rows, dedup_keep_first,
        join_day_hour, join_day_hour_10min, grid_spine, complete_grid, complete_days, forward_fill, fill_gaps,
        sorted_grid, lag_diff, time_gap_report, real_gaps, time_dim_counts, temporal_split, minmax_fit,
        minmax_transform, inverse_scale, roundtrip_scale, sliding_windows, feature_target_split, horizon_slice,
        flatten_windows, roundtrip_windows, pair_pred_truth, metrics_overall, metrics_by_institution,
        metrics_by_granularity, metrics_by_model, metrics_cube, metrics_of_windows, nrmse_train_range,
        rmse_by_horizon, metric_max, union_granularities, scan_institution_csv, scan_time_csv, reread_processed,
        roundtrip_windows_csv, stored_scalers, stored_valid_ids, append_metrics, trial_grid, train_history,
        best_trial, score_model, train_ten_minute, sarima_forecast,
    )
}
