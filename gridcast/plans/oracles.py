"""DuckDB side of the registry: each query's meaning in SQL over the same tables."""

from __future__ import annotations

EVENTS = "ev AS (SELECT event_id, ts, user_id % 10 AS i, CAST(round(value * 100) AS BIGINT) AS nb FROM events)"
DAY = "dd AS (SELECT i, CAST(ts AS DATE) AS day, CAST(sum(nb) AS BIGINT) AS nb FROM ev GROUP BY ALL)"
HOUR = "hh AS (SELECT i, CAST(ts AS DATE) AS day, CAST(hour(ts) AS INTEGER) AS hr, CAST(sum(nb) AS BIGINT) AS nb FROM ev GROUP BY ALL)"
TEN = "mm AS (SELECT i, CAST(ts AS DATE) AS day, CAST(hour(ts) AS INTEGER) AS hr, CAST(minute(ts) // 10 AS INTEGER) AS mi, CAST(sum(nb) AS BIGINT) AS nb FROM ev GROUP BY ALL)"
HOUR_SPINE = "hs AS (SELECT i, day, CAST(h AS INTEGER) AS hr FROM (SELECT DISTINCT i, day FROM hh), range(24) t(h))"
TEN_SPINE = "ms AS (SELECT i, day, CAST(h AS INTEGER) AS hr, CAST(m AS INTEGER) AS mi FROM (SELECT DISTINCT i, day FROM mm), range(24) t(h), range(6) u(m))"
HOUR_GRID = "hg AS (SELECT hs.i, hs.day, hs.hr, hh.nb FROM hs LEFT JOIN hh USING (i, day, hr))"
TEN_GRID = "mg AS (SELECT ms.i, ms.day, ms.hr, ms.mi, mm.nb FROM ms LEFT JOIN mm USING (i, day, hr, mi))"


def _forward(order: str) -> str:
    return f"last_value(nb IGNORE NULLS) OVER (PARTITION BY i, day ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def _fill(order: str) -> str:
    return f"coalesce({_forward(order)}, first_value(nb IGNORE NULLS) OVER (PARTITION BY i, day ORDER BY {order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"


def _scaled(tag: str, filled: str, order: str) -> str:
    """CTEs p<tag> (positions), s<tag> (split), c<tag> (scalers), y<tag> (scaled)."""
    return f"""
p{tag} AS (SELECT i, nb, row_number() OVER (PARTITION BY i ORDER BY {order}) - 1 AS pos, count(*) OVER (PARTITION BY i) AS n FROM {filled}),
s{tag} AS (SELECT i, pos, nb, CASE WHEN pos < floor(n * CAST(0.6 AS DOUBLE)) THEN 'train'
  WHEN pos < floor(n * CAST(0.6 AS DOUBLE)) + floor(n * CAST(0.1 AS DOUBLE)) THEN 'val' ELSE 'test' END AS split FROM p{tag}),
c{tag} AS (SELECT i, CAST(min(nb) AS DOUBLE) AS data_min, CAST(max(nb) AS DOUBLE) AS data_max FROM s{tag} WHERE split = 'train' GROUP BY i),
y{tag} AS (SELECT i, pos, split, nb, (nb - data_min) / CASE WHEN data_max = data_min THEN 1.0::DOUBLE ELSE data_max - data_min END AS y FROM s{tag} JOIN c{tag} USING (i))"""


HOUR_FILLED = f"hf AS (SELECT i, day, hr, {_fill('hr')} AS nb FROM hg)"
TEN_FILLED = f"mf AS (SELECT i, day, hr, mi, {_fill('hr, mi')} AS nb FROM mg)"
H = f"WITH {EVENTS}, {HOUR}"
HF = f"{H}, {HOUR_SPINE}, {HOUR_GRID}, {HOUR_FILLED}"
HY = f"{HF}, {_scaled('h', 'hf', 'day, hr')}"
M = f"WITH {EVENTS}, {TEN}"
MG = f"{M}, {TEN_SPINE}, {TEN_GRID}"
ALL = f"{HY}, {DAY}, {_scaled('d', 'dd', 'day')}, {TEN}, {TEN_SPINE}, {TEN_GRID}, {TEN_FILLED}, {_scaled('m', 'mf', 'day, hr, mi')}"


def _lagged(tag: str, lag: int) -> str:
    return f"SELECT a.i, a.pos, a.y, b.y AS yp FROM y{tag} a JOIN y{tag} b ON a.i = b.i AND a.pos = b.pos + {lag} WHERE a.split = 'test'"


RMSE, MAE = "sqrt(avg((y - yp) * (y - yp)))", "avg(abs(y - yp))"
NRMSE = f"{RMSE} / nullif(max(y) - min(y), 0)"
SMAPE = "100 * avg(abs(y - yp) / greatest(abs(y) + abs(yp), 1e-7::DOUBLE))"
METRICS = f"round({RMSE}, 6) AS rmse, round({MAE}, 6) AS mae, round({NRMSE}, 6) AS nrmse, round({SMAPE}, 6) AS smape"

SUPPLIERS = """
su AS (SELECT l_suppkey AS id, CAST(l_shipdate AS DATE) AS day, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS nb FROM lineitem GROUP BY ALL),
qb AS (
  SELECT id, count(*) AS n, count(*) - count(nb) AS nulls, min(nb) AS low, max(nb) AS high,
         quantile_cont(CAST(nb AS DOUBLE), 0.2) AS q20, quantile_cont(CAST(nb AS DOUBLE), 0.8) AS q80 FROM su GROUP BY id
), fe AS (SELECT *, q20 - 1.5 * (q80 - q20) AS lo, q80 + 1.5 * (q80 - q20) AS hi FROM qb),
st AS (SELECT id, n, q20, q80, CASE WHEN n < 260 THEN 'few' WHEN nulls > 0 THEN 'null' WHEN low = high THEN 'zero_variance'
  WHEN low < 0 THEN 'negative' WHEN high > hi OR low < lo THEN 'outlier' ELSE 'valid' END AS status FROM fe)"""
SU = f"WITH {SUPPLIERS}"
SU_DAY = "id, CAST(day AS VARCHAR) AS day, nb"


def _start(unit: str) -> str:
    return "time_bucket(INTERVAL 10 MINUTE, ts)" if unit == "10min" else f"date_trunc('{unit}', ts)"


def _times(unit: str) -> str:
    return f"SELECT row_number() OVER (ORDER BY time) AS id_time, CAST(time AS TIMESTAMP) AS time FROM (SELECT DISTINCT {_start(unit)} AS time FROM ev)"


def _times_of_each(unit: str) -> str:
    return f"SELECT i, row_number() OVER (PARTITION BY i ORDER BY time) AS id_time, CAST(time AS TIMESTAMP) AS time FROM (SELECT DISTINCT i, {_start(unit)} AS time FROM ev)"


def _diff(part: str, table: str) -> str:
    return f"SELECT id_time, CAST({part}(time) - lag({part}(time)) OVER (ORDER BY id_time) AS INTEGER) AS diff FROM {table}"


def _gaps(unit: str, part: str, cycle: int, fall: int, regular: int) -> str:
    diffs = f"SELECT i, id_time, CAST({part}(time) - lag({part}(time)) OVER (PARTITION BY i ORDER BY id_time) AS INTEGER) AS diff FROM ({_times_of_each(unit)})"
    return f"SELECT '{unit}' AS granularity, * FROM ({diffs}) WHERE NOT ((id_time % {cycle} = 0 AND diff = {fall}) OR diff = {regular})"


TIME = "strftime(time, '%Y-%m-%d %H:%M:%S') AS time"
WINDOWS = """
ws AS (SELECT *, pos - min(pos) OVER (PARTITION BY i, split) AS sp, count(*) OVER (PARTITION BY i, split) AS m, CASE split WHEN 'test' THEN 1 ELSE 5 END AS st FROM yh),
wi AS (SELECT i, split, sp, sp // st AS win_idx FROM ws WHERE sp % st = 0 AND sp + 28 <= m)"""
W = f"{HY}, {WINDOWS}"
ENDS = f"""{W} SELECT wi.i, wi.split, wi.win_idx, a.y AS x_0, b.y AS x_23, c.y AS y_0, e.y AS y_3 FROM wi
JOIN ws a ON a.i = wi.i AND a.split = wi.split AND a.sp = wi.sp JOIN ws b ON b.i = wi.i AND b.split = wi.split AND b.sp = wi.sp + 23
JOIN ws c ON c.i = wi.i AND c.split = wi.split AND c.sp = wi.sp + 24 JOIN ws e ON e.i = wi.i AND e.split = wi.split AND e.sp = wi.sp + 27"""


def _flat(steps: int) -> str:
    return f"""{W} SELECT wi.i, wi.split, wi.win_idx, CAST(k AS INTEGER) AS step, a.y AS v FROM wi, range({steps}) t(k)
JOIN ws a ON a.i = wi.i AND a.split = wi.split AND a.sp = wi.sp + 24 + k"""


MODELS = f"pm AS (SELECT 'seasonal' AS model, * FROM ({_lagged('h', 24)}) UNION ALL SELECT 'last', * FROM ({_lagged('h', 1)}))"
D = "CAST(day AS VARCHAR) AS day"
NUMBERED_HOURS = f"{H} SELECT CAST(i AS VARCHAR) AS id_institution, row_number() OVER (PARTITION BY i ORDER BY day, hr) AS id_time, CAST(nb AS DOUBLE) AS n_bytes FROM hh"

ORACLES = {
    "project_series": f"WITH {EVENTS} SELECT i, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, nb FROM ev",
    "resample_day": f"WITH {EVENTS}, {DAY} SELECT i, {D}, nb FROM dd",
    "resample_hour": f"{H} SELECT i, {D}, hr, nb FROM hh",
    "resample_10min": f"{M} SELECT i, {D}, hr, mi, nb FROM mm",
    "join_time_dim": f"WITH {EVENTS}, tm AS ({_times('hour')}), hs AS (SELECT i, date_trunc('hour', ts) AS time, CAST(sum(nb) AS BIGINT) AS nb FROM ev GROUP BY ALL) SELECT i, id_time, strftime(tm.time, '%Y-%m-%d %H:%M:%S') AS time, nb FROM hs JOIN tm ON hs.time = tm.time",
    "derive_time_keys": f"WITH {EVENTS} SELECT event_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, CAST(hour(ts) AS INTEGER) AS hr, CAST(minute(ts) // 10 AS INTEGER) AS mi, CAST(second(ts) AS INTEGER) AS sec, CAST(day(ts) AS INTEGER) AS dom, i || '_' || CAST(CAST(ts AS DATE) AS VARCHAR) || '_' || hour(ts) AS id FROM ev",
    "normalize_institution_id": "SELECT event_id, CAST(CAST(coalesce(CAST(user_id AS DOUBLE), 30) AS SMALLINT) AS VARCHAR) AS id_institution FROM events",
    "fill_zero_cast": f"{H}, {HOUR_SPINE}, {HOUR_GRID} SELECT i, {D}, hr, CAST(coalesce(nb, 0) AS DOUBLE) AS nb FROM hg",
    "screen_institutions": f"{SU} SELECT id, n, q20, q80, status FROM st",
    "quantile_bounds": f"{SU} SELECT id, q20, q80, lo, hi FROM fe",
    "outlier_rows": f"{SU} SELECT su.id, CAST(day AS VARCHAR) AS day, nb FROM su JOIN fe USING (id) WHERE nb > hi OR nb < lo",
    "screening_summary": f"{SU} SELECT status, count(*) AS n FROM st GROUP BY status",
    "filter_valid_semi": f"{SU} SELECT {SU_DAY} FROM su WHERE id IN (SELECT id FROM st WHERE status = 'valid')",
    "exclude_anti": f"{SU} SELECT {SU_DAY} FROM su WHERE id NOT IN (7, 8, 243)",
    "filter_id_time_gt": f"WITH {EVENTS}, tm AS ({_times('hour')}) SELECT id_time, {TIME} FROM tm WHERE id_time > 700",
    "min_length_filter": f"{H} SELECT i, count(*) AS n FROM hh GROUP BY i HAVING count(*) > 280",
    "select_institution": f"{HY} SELECT i, pos, split, y FROM yh WHERE i = 3",
    "distinct_ids": f"WITH {EVENTS} SELECT DISTINCT i FROM ev",
    "distinct_day_rows": f"WITH {EVENTS}, {DAY} SELECT DISTINCT i, {D}, nb FROM dd",
    "dedup_keep_first": f"WITH {EVENTS}, rn AS (SELECT i, CAST(ts AS DATE) AS day, CAST(hour(ts) AS INTEGER) AS hr, CAST(minute(ts) // 10 AS INTEGER) AS mi, event_id, nb, row_number() OVER (PARTITION BY i, CAST(ts AS DATE), hour(ts), minute(ts) // 10 ORDER BY ts, event_id) AS k FROM ev) SELECT i, {D}, hr, mi, event_id, nb FROM rn WHERE k = 1",
    "join_day_hour": f"{H}, {DAY} SELECT dd.i, CAST(dd.day AS VARCHAR) AS day, dd.nb AS nb_day, hr, hh.nb AS nb_hour FROM dd LEFT JOIN hh USING (i, day)",
    "join_day_hour_10min": f"{H}, {DAY}, {TEN} SELECT dd.i, CAST(dd.day AS VARCHAR) AS day, dd.nb AS nb_day, hh.hr, hh.nb AS nb_hour, mi, mm.nb AS nb_10min FROM dd LEFT JOIN hh USING (i, day) LEFT JOIN mm ON mm.i = dd.i AND mm.day = dd.day AND mm.hr = hh.hr",
    "grid_spine": f"{M}, {TEN_SPINE} SELECT i, {D}, hr, mi FROM ms",
    "complete_grid": f"{MG} SELECT i, {D}, hr, mi, nb FROM mg",
    "complete_days": f"WITH {EVENTS}, {DAY}, sp AS (SELECT i, min(day) AS a, max(day) AS b FROM dd GROUP BY i) SELECT i, CAST(CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS VARCHAR) AS day FROM sp",
    "forward_fill": f"{MG} SELECT i, {D}, hr, mi, {_forward('hr, mi')} AS nb FROM mg",
    "fill_gaps": f"{MG} SELECT i, {D}, hr, mi, {_fill('hr, mi')} AS nb FROM mg",
    "sorted_grid": f"{MG} SELECT i, {D}, hr, mi, nb, row_number() OVER (PARTITION BY i ORDER BY day, hr, mi) - 1 AS pos FROM mg",
    "lag_diff": f"WITH {EVENTS}, tm AS ({_times('hour')}), df AS ({_diff('hour', 'tm')}) SELECT * FROM df WHERE diff IS NOT NULL",
    "time_gap_report": f"WITH {EVENTS} {_gaps('day', 'day', 31, -30, 1)} UNION ALL {_gaps('hour', 'hour', 24, -23, 1)} UNION ALL {_gaps('10min', 'minute', 6, -50, 10)}",
    "real_gaps": f"WITH {EVENTS}, g AS (SELECT i, id_time, CAST(epoch(time) - lag(epoch(time)) OVER (PARTITION BY i ORDER BY id_time) AS BIGINT) AS gap FROM ({_times_of_each('hour')})) SELECT * FROM g WHERE gap <> 3600",
    "time_dim_counts": f"WITH {EVENTS} SELECT 'day' AS granularity, count(*) AS n FROM ({_times('day')}) UNION ALL SELECT 'hour', count(*) FROM ({_times('hour')}) UNION ALL SELECT '10min', count(*) FROM ({_times('10min')})",
    "temporal_split": f"{HY} SELECT i, pos, split FROM sh",
    "minmax_fit": f"{HY} SELECT i, data_min, data_max FROM ch",
    "minmax_transform": f"{HY} SELECT i, pos, y FROM yh",
    "inverse_scale": f"{HY} SELECT i, pos, round(CAST(nb AS DOUBLE), 6) AS nb FROM yh",
    "roundtrip_scale": f"{HY} SELECT i, pos, TRUE AS same FROM yh",
    "sliding_windows": ENDS,
    "feature_target_split": ENDS,
    "roundtrip_windows": ENDS,
    "horizon_slice": _flat(2),
    "flatten_windows": _flat(4),
    "pair_pred_truth": f"{HY} {_lagged('h', 24)}",
    "metrics_overall": f"{HY} SELECT {METRICS} FROM ({_lagged('h', 24)})",
    "metrics_by_institution": f"{HY} SELECT i, {METRICS} FROM ({_lagged('h', 24)}) GROUP BY i",
    "metrics_by_granularity": f"{ALL} SELECT granularity, {METRICS} FROM (SELECT 'day' AS granularity, * FROM ({_lagged('d', 1)}) UNION ALL SELECT 'hour', * FROM ({_lagged('h', 24)}) UNION ALL SELECT '10min', * FROM ({_lagged('m', 144)})) GROUP BY granularity",
    "metrics_by_model": f"{HY}, {MODELS} SELECT model, {METRICS} FROM pm GROUP BY model",
    "metrics_cube": f"{HY}, {MODELS} SELECT model, i, {METRICS} FROM pm GROUP BY CUBE (model, i)",
    "metrics_of_windows": f"{W}, xm AS (SELECT wi.i, wi.sp, avg(a.y) AS yp FROM wi JOIN ws a ON a.i = wi.i AND a.split = wi.split AND a.sp BETWEEN wi.sp AND wi.sp + 23 WHERE wi.split = 'test' GROUP BY wi.i, wi.sp) SELECT xm.i, round({RMSE}, 6) AS rmse, round({MAE}, 6) AS mae FROM xm JOIN ws a ON a.i = xm.i AND a.split = 'test' AND a.sp BETWEEN xm.sp + 24 AND xm.sp + 27 GROUP BY xm.i",
    "nrmse_train_range": f"{HY} SELECT i, round({RMSE} / greatest((SELECT max(y) - min(y) FROM yh WHERE split = 'train'), 1e-7::DOUBLE), 6) AS nrmse FROM ({_lagged('h', 24)}) GROUP BY i",
    "rmse_by_horizon": f"{W}, pr AS (SELECT CAST(k AS INTEGER) AS step, CAST(a.nb AS DOUBLE) AS y, CAST(b.nb AS DOUBLE) AS yp FROM wi, range(4) t(k) JOIN ws a ON a.i = wi.i AND a.split = wi.split AND a.sp = wi.sp + 24 + k JOIN ws b ON b.i = wi.i AND b.split = wi.split AND b.sp = wi.sp + k WHERE wi.split = 'test') SELECT step, round({RMSE}, 6) AS rmse FROM pr GROUP BY step",
    "metric_max": f"{HY}, {MODELS} SELECT round(greatest(max(rmse), max(mae), max(nrmse), max(smape)), 6) AS max_value FROM (SELECT model, {RMSE} AS rmse, {MAE} AS mae, {NRMSE} AS nrmse, {SMAPE} AS smape FROM pm GROUP BY model)",
    "scan_institution_csv": NUMBERED_HOURS,
    "reread_processed": NUMBERED_HOURS,
    "scan_time_csv": f"WITH {EVENTS}, tm AS ({_times('hour')}) SELECT id_time, {TIME} FROM tm",
    "roundtrip_windows_csv": ENDS,
    "stored_scalers": f"{HY} SELECT i, pos, y FROM yh",
    "stored_valid_ids": f"{SU} SELECT {SU_DAY} FROM su WHERE id IN (SELECT id FROM st WHERE status = 'valid')",
    "append_metrics": f"{HY}, {MODELS} SELECT model, {METRICS} FROM pm GROUP BY model",
    "union_granularities": f"{H}, {DAY}, {TEN} SELECT 'day' AS granularity, i, CAST(day AS VARCHAR) AS ts_key, nb FROM dd UNION ALL SELECT 'hour', i, CAST(day AS VARCHAR) || ' ' || lpad(CAST(hr AS VARCHAR), 2, '0'), nb FROM hh UNION ALL SELECT '10min', i, CAST(day AS VARCHAR) || ' ' || lpad(CAST(hr AS VARCHAR), 2, '0') || ' ' || lpad(CAST(mi AS VARCHAR), 2, '0'), nb FROM mm",
}
