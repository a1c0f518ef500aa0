"""DuckDB SQL with the results of the registered queries."""

from __future__ import annotations

GRID = """
n_sensors AS (SELECT greatest(1, count(DISTINCT user_id) // 30) AS n FROM events),
found AS (SELECT CAST(user_id % (SELECT n FROM n_sensors) AS VARCHAR) AS sensor_id, CAST(epoch_us(ts) // 3600000000 AS BIGINT) AS t, round(avg(value), 6) AS speed FROM events GROUP BY 1, 2),
span AS (SELECT min(t) AS lo, max(t) AS hi FROM found),
spine AS (SELECT sensor_id, unnest(generate_series(lo, hi)) AS t FROM (SELECT DISTINCT sensor_id FROM found) CROSS JOIN span),
base AS (SELECT s.sensor_id, s.t, make_timestamp(s.t * 3600000000) AS ts, coalesce(f.speed, 0.0) AS speed FROM spine s LEFT JOIN found f ON f.sensor_id = s.sensor_id AND f.t = s.t),
grid AS (SELECT *, CASE WHEN speed > 0 THEN speed END AS v, hour(ts) AS hour, isodow(ts) - 1 AS day_of_week, isodow(ts) >= 6 AS is_weekend, CAST(ts AS DATE) AS date FROM base)"""
FLOW = (
    GRID
    + """,
flow AS (SELECT sensor_id, quantile_cont(v, 0.85) AS free_flow FROM grid GROUP BY 1),
rated AS (SELECT g.*, f.free_flow, CASE WHEN f.free_flow <> 0 THEN g.v / f.free_flow END AS ratio FROM grid g LEFT JOIN flow f USING (sensor_id)),
state AS (SELECT *, coalesce(ratio < 0.5, false) AS c50, coalesce(ratio < 0.6, false) AS c60, coalesce(ratio < 0.7, false) AS c70 FROM rated)"""
)


def runs(source: str, flag: str, name: str, extra: str = "") -> str:
    """CTE of the runs of a true flag."""
    return f"""
{name}_islands AS (SELECT sensor_id, t, {flag} AS flag, row_number() OVER (PARTITION BY sensor_id ORDER BY t) - row_number() OVER (PARTITION BY sensor_id, {flag} ORDER BY t) AS island FROM {source}),
{name} AS (SELECT sensor_id, min(t) AS run_start, max(t) AS run_end, count(*) AS run_steps FROM {name}_islands WHERE flag GROUP BY sensor_id, island)"""


def q(body: str, ctes: str = GRID) -> str:
    return f"WITH {ctes}\n{body}"


def q6(value: str, quantile: float) -> str:
    """A quantile to six places, ties up, as doubles lie on either side of one: readings have six places, so nine decimal places hold their quantiles exactly."""
    return f"round(CAST(quantile_cont({value}, {quantile}) AS DECIMAL(38, 9)), 6)::DOUBLE"


ZERO = GRID + ", shares AS (SELECT ts, t, count(*) FILTER (speed = 0) AS zeros, count(*) AS sensors FROM grid GROUP BY 1, 2)"
ZEROS = GRID + "," + runs("(SELECT *, speed = 0 AS z FROM grid)", "z", "zruns")
JUMPS = """jumps AS (SELECT *, coalesce(abs(speed - lag(speed) OVER (PARTITION BY sensor_id ORDER BY t)) > 40, false) AS is_large_jump, lag(speed) OVER (PARTITION BY sensor_id ORDER BY t) AS before FROM grid)"""
PROFILE = f"count(v) AS valid_count, count(*) AS total_count, round(1 - count(v) / count(*), 6) AS missing_rate, round(avg(v), 6) AS mean_speed, {q6('v', 0.5)} AS median_speed"
CRUNS = FLOW + "," + runs("state", "c60", "cruns")
EVENTS = CRUNS + """,
run_events AS (SELECT s.sensor_id, count(r.run_steps) AS event_count, round(coalesce(avg(r.run_steps * 60), 0), 6) AS mean_event_minutes, CAST(coalesce(max(r.run_steps) * 60, 0) AS BIGINT) AS max_event_minutes
    FROM (SELECT DISTINCT sensor_id FROM grid) s LEFT JOIN cruns r USING (sensor_id) GROUP BY 1),
rates AS (SELECT sensor_id, count(v) AS valid_count, round(count(*) FILTER (c50) / nullif(count(v), 0), 6) AS congestion_rate_50, round(count(*) FILTER (c60) / nullif(count(v), 0), 6) AS congestion_rate_60, round(count(*) FILTER (c70) / nullif(count(v), 0), 6) AS congestion_rate_70 FROM state GROUP BY 1),
risk AS (SELECT sensor_id, round(count(v) / count(*), 6) AS coverage_rate, round(quantile_cont(v, 0.85), 6) AS free_flow_speed, round(avg(v), 6) AS mean_speed, round(quantile_cont(v, 0.5), 6) AS median_speed, round(quantile_cont(v, 0.1), 6) AS p10_speed,
    round(stddev_pop(v), 6) AS std_speed FROM grid GROUP BY 1),
whole_risk AS (SELECT * FROM risk JOIN (SELECT * EXCLUDE (valid_count) FROM rates) USING (sensor_id) JOIN run_events USING (sensor_id))"""
PLACES = "places AS (SELECT CAST(s_suppkey AS VARCHAR) AS sensor_id, round(34 + s_acctbal / 100000, 6) AS latitude, round(-118 - s_nationkey / 100, 6) AS longitude FROM supplier WHERE s_acctbal IS NOT NULL AND s_nationkey IS NOT NULL)"
W = "WINDOW w AS (PARTITION BY sensor_id ORDER BY t)"


def frame(a: int, b: int) -> str:
    side = lambda k: f"{-k} PRECEDING" if k < 0 else f"{k} FOLLOWING" if k else "CURRENT ROW"
    return f"OVER (PARTITION BY sensor_id ORDER BY t ROWS BETWEEN {side(a)} AND {side(b)})"


FUTURE = {k: f"CASE WHEN count(*) {frame(1, 6)} = 6 THEN count(*) FILTER (c{k}) {frame(1, 6)} ELSE -1 END" for k in (50, 60, 70)}
LABELS = FLOW + f", labelled AS (SELECT *, {', '.join(f'CAST(({f}) >= 3 AS INTEGER) AS label_{k}' for k, f in FUTURE.items())}, count(v) {frame(1, 6)} = 6 AS future_complete FROM state)"
SCORED = LABELS + ", scored AS (SELECT sensor_id, ts, label_60 AS y, round(1 - least(ratio, 1.0), 6) AS p FROM labelled WHERE future_complete AND ratio IS NOT NULL)"
SWEEP = SCORED + """,
edges AS (SELECT k / 100.0 AS threshold FROM (SELECT CAST(unnest(generate_series(10, 90)) AS DOUBLE) AS k)),
counted AS (SELECT threshold, count(*) FILTER (p >= threshold AND y = 1) AS tp, count(*) FILTER (p >= threshold AND y = 0) AS fp, count(*) FILTER (p < threshold AND y = 1) AS fn FROM edges CROSS JOIN scored GROUP BY 1),
sweep AS (SELECT threshold, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision FROM counted)"""
AXIS = """axis AS (SELECT lo, hi - lo + 1 AS n, CAST(floor((hi - lo + 1) * 0.7e0) AS BIGINT) AS a, CAST(floor((hi - lo + 1) * 0.1e0) AS BIGINT) AS b FROM span),
parts AS (SELECT 'train' AS split, 0 AS start_index, a - 1 AS end_index, lo FROM axis UNION ALL SELECT 'validation', a, a + b - 1, lo FROM axis UNION ALL SELECT 'test', a + b, n - 1, lo FROM axis)"""
TRAIN = GRID + ", " + AXIS + """,
train AS (SELECT g.* FROM grid g, axis WHERE g.t - lo < a),
tbase AS (SELECT sensor_id, count(v) AS valid_count, quantile_cont(v, 0.5) AS median_speed, quantile_cont(v, 0.85) AS free_flow FROM train GROUP BY 1),
tstate AS (SELECT t.*, b.free_flow, coalesce(CASE WHEN b.free_flow <> 0 THEN t.v / b.free_flow END < 0.6, false) AS hit FROM train t JOIN tbase b USING (sensor_id)),
tstats AS (SELECT b.*, h.hits / nullif(b.valid_count, 0) AS congestion_rate FROM tbase b JOIN (SELECT sensor_id, count(*) FILTER (hit) AS hits FROM tstate GROUP BY 1) h USING (sensor_id)),
cells AS (SELECT sensor_id, is_weekend, hour AS time_slot, quantile_cont(v, 0.5) AS median, count(*) FILTER (hit) / nullif(count(v), 0) AS rate FROM tstate GROUP BY ALL),
periods AS (SELECT s.sensor_id, w.is_weekend, h.time_slot, coalesce(c.median, s.median_speed) AS period_median_speed, coalesce(c.rate, s.congestion_rate) AS period_congestion_rate
    FROM tstats s CROSS JOIN (VALUES (false), (true)) w(is_weekend) CROSS JOIN (SELECT CAST(unnest(generate_series(0, 23)) AS BIGINT) AS time_slot) h
    LEFT JOIN cells c ON c.sensor_id = s.sensor_id AND c.is_weekend = w.is_weekend AND c.time_slot = h.time_slot)"""
LAG = lambda c, k: f"lag({c}, {k}) OVER (PARTITION BY sensor_id ORDER BY t)"
ROLL = ", ".join(f"CASE WHEN count(v) {frame(-(k - 1), 0)} = {k} THEN round({fn}(v) {frame(-(k - 1), 0)}, 9) END AS speed_{name}_{k}" for k in (3, 6, 12) for name, fn in (("mean", "avg"), ("min", "min"), ("std", "stddev_pop")))
DECLINE = """falls AS (SELECT *, coalesce(v < lag(v) OVER (PARTITION BY sensor_id ORDER BY t), false) AS falls FROM {0}),
declines AS (SELECT * EXCLUDE (falls), t - max(CASE WHEN NOT falls THEN t END) OVER (PARTITION BY sensor_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS decline_steps FROM falls)"""
CALENDAR = "round(sin(hour * 2 * pi() / 24), 9) AS hour_sin, round(cos(hour * 2 * pi() / 24), 9) AS hour_cos, round(sin(day_of_week * 2 * pi() / 7), 9) AS dow_sin, round(cos(day_of_week * 2 * pi() / 7), 9) AS dow_cos"
MODEL = TRAIN + """,
mrated AS (SELECT g.*, s.free_flow, s.median_speed AS sensor_median_speed, s.congestion_rate AS sensor_congestion_rate, CASE WHEN s.free_flow <> 0 THEN g.v / s.free_flow END AS ratio FROM grid g LEFT JOIN tstats s USING (sensor_id)),
mstate AS (SELECT *, coalesce(ratio < 0.5, false) AS c50, coalesce(ratio < 0.6, false) AS c60, coalesce(ratio < 0.7, false) AS c70 FROM mrated),""" + DECLINE.format("mstate") + f""",
mwindows AS (SELECT *, {", ".join(f"{LAG('ratio', k)} AS ratio_lag_{k}" for k in (1, 2, 3, 6, 12))}, {ROLL}, {", ".join(f"(v - {LAG('v', k)}) / {k * 60} AS trend_{k}" for k in (2, 3, 6))}, v - {LAG('v', 1)} AS speed_change,
    count(v) {frame(-12, 0)} = 13 AS history_complete, count(v) {frame(1, 6)} = 6 AS future_complete, {", ".join(f"CAST(({f}) >= 3 AS INTEGER) AS label_{k}" for k, f in FUTURE.items())}, {CALENDAR} FROM declines),
model AS (SELECT m.*, p.period_median_speed, p.period_congestion_rate, m.v - p.period_median_speed AS deviation_from_period, s.split, s.split IS NOT NULL AND history_complete AND future_complete AS usable
    FROM mwindows m LEFT JOIN periods p ON p.sensor_id = m.sensor_id AND p.is_weekend = m.is_weekend AND p.time_slot = m.hour LEFT JOIN parts s ON m.t - s.lo BETWEEN s.start_index + 12 AND s.end_index - 6)"""
FEATURES = ["v", "ratio", *(f"ratio_lag_{k}" for k in (1, 2, 3, 6, 12)), *(f"speed_{a}_{k}" for k in (3, 6, 12) for a in ("mean", "min", "std")), "trend_2", "trend_3", "trend_6", "speed_change", "hour_sin", "hour_cos", "dow_sin", "dow_cos", "free_flow", "sensor_median_speed", "sensor_congestion_rate", "period_median_speed", "period_congestion_rate", "deviation_from_period"]
HEAT = FLOW + ", heat AS (SELECT date, sensor_id, hour, avg(CAST(c60 AS INTEGER)) AS rate FROM state WHERE v IS NOT NULL GROUP BY ALL)"
EDGES = PLACES + """,
steps AS (SELECT l_suppkey AS a, lead(l_suppkey) OVER w AS b, abs(l_extendedprice - lead(l_extendedprice) OVER w) AS cost FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_extendedprice)),
raw_edges AS (SELECT CAST(a AS VARCHAR) AS from_id, CAST(b AS VARCHAR) AS to_id, round(min(cost), 2) AS cost FROM steps WHERE b IS NOT NULL GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY from_id ORDER BY cost, to_id) AS k FROM raw_edges WHERE from_id <> to_id AND cost IS NOT NULL AND from_id IN (SELECT sensor_id FROM places) AND to_id IN (SELECT sensor_id FROM places)),
pruned AS (SELECT least(from_id, to_id) AS a_id, greatest(from_id, to_id) AS b_id, min(cost) AS cost FROM ranked WHERE k <= 2 AND cost <= 3000 GROUP BY 1, 2)"""
def matching(threshold: float, steps: int, before: int, after: int) -> str:
    """CTEs of events and their controls, up to ``matches``."""
    size, reach = before + after + 1, (before + after + 1) // 2
    whole, near = frame(-before, after), frame(-reach, reach)
    found = FLOW + "," + runs(f"(SELECT *, coalesce(ratio < {threshold}, false) AS hit FROM rated)", "hit", "eruns")
    return "RECURSIVE " + (found + f""",
joined_runs AS (SELECT s.*, r.run_start, r.run_steps FROM (SELECT *, coalesce(ratio < {threshold}, false) AS hit FROM rated) s LEFT JOIN eruns r ON r.sensor_id = s.sensor_id AND s.t BETWEEN r.run_start AND r.run_end),
around AS (SELECT *, list(ratio) {whole} AS around, count(*) {whole} AS room, count(ratio) {whole} AS finite, count(*) FILTER (ratio IS NOT NULL AND NOT hit) {near} AS fine FROM joined_runs),
events_ AS (SELECT sensor_id, is_weekend, hour, t, row_number() OVER (PARTITION BY sensor_id, is_weekend, hour ORDER BY t) AS k FROM around WHERE t = run_start AND run_steps >= {steps} AND room = {size} AND finite = {size}),
controls AS (SELECT sensor_id, is_weekend, hour, list(t ORDER BY t) AS ts FROM around WHERE room = {size} AND fine = {2 * reach + 1} GROUP BY 1, 2, 3),
joined AS (SELECT e.*, coalesce(c.ts, []) AS ts FROM events_ e LEFT JOIN controls c USING (sensor_id, is_weekend, hour)),
picks AS (
    SELECT sensor_id, is_weekend, hour, k, t, list_sort(list_transform(ts, lambda c: {{'gap': abs(c - t), 'c': c}}))[1].c AS control_t, list_sort(list_transform(ts, lambda c: {{'gap': abs(c - t), 'c': c}}))[1].c AS fresh, CAST([] AS BIGINT[]) AS used FROM joined WHERE k = 1
    UNION ALL
    SELECT sensor_id, is_weekend, hour, k, t, coalesce(fresh, list_sort(list_transform(ts, lambda c: {{'gap': abs(c - t), 'c': c}}))[1].c), fresh, used FROM (
        SELECT j.*, list_sort(list_transform(list_filter(j.ts, lambda c: NOT list_contains(list_append(p.used, p.fresh), c)), lambda c: {{'gap': abs(c - j.t), 'c': c}}))[1].c AS fresh, list_append(p.used, p.fresh) AS used
        FROM joined j JOIN picks p ON p.sensor_id = j.sensor_id AND p.is_weekend = j.is_weekend AND p.hour = j.hour AND j.k = p.k + 1)),
matches AS (SELECT sensor_id, t AS event_t, control_t, fresh IS NULL AND control_t IS NOT NULL AS is_reused FROM picks)""").lstrip()


MATCH, SHORT_MATCH = matching(0.6, 3, 12, 6), matching(0.25, 2, 3, 2)
ALL_FEATURES = [*FEATURES, "decline_steps", "hour", "day_of_week", "weekend", "time_slot"]
CHECKS = """SELECT c.*, l.after_previous FROM (SELECT split, sum(n)::BIGINT AS n_rows, sum(nulls)::BIGINT AS null_rows, count(*) FILTER (n > 1) AS repeated_keys, count(DISTINCT sensor_id) AS sensors, sum(odd)::BIGINT AS odd_targets, min(lo) <> max(hi) AS has_both_classes,
    CASE WHEN sum(nulls) = 0 AND count(*) FILTER (n > 1) = 0 AND sum(odd) = 0 THEN 'PASS' ELSE 'FAIL' END AS verdict
    FROM (SELECT split, sensor_id, ts, count(*) AS n, count(*) FILTER (ratio IS NULL) AS nulls, count(*) FILTER (target NOT IN (0, 1)) AS odd, min(target) AS lo, max(target) AS hi FROM {0} GROUP BY 1, 2, 3) GROUP BY 1) c
    JOIN (SELECT split, coalesce(first_t > lag(last_t) OVER (ORDER BY CASE split WHEN 'train' THEN 0 WHEN 'validation' THEN 1 ELSE 2 END), true) AS after_previous FROM (SELECT split, min(t) AS first_t, max(t) AS last_t FROM {0} GROUP BY 1)) l USING (split)"""
NEAR_SUM = " + ".join(f"coalesce(lag({{0}}, {k}) OVER w, 0)" for k in (1, 2, 3))
#: Columns of the orders table, and whether their footers bound them.
ORDER_COLUMNS = [("o_orderkey", True), ("o_custkey", True), ("o_orderstatus", False), ("o_totalprice", True), ("o_orderdate", False), ("o_orderpriority", False)]


def profile_of(before: int, after: int) -> str:
    quartiles = ", ".join(f"CASE WHEN count({s}) = count(*) THEN round(quantile_cont({s}, {p}), 6) END AS {n}_{name}" for s, n in (("o.e", "event"), ("o.c", "control")) for p, name in ((0.25, "p25"), (0.5, "median"), (0.75, "p75")))
    return f"""SELECT o.k - {before + 1} AS offset_steps, (o.k - {before + 1}) * 60 AS offset_minutes, count(*) AS events, {quartiles}
        FROM (SELECT unnest(e.around) AS e, unnest(c.around) AS c, CAST(unnest(generate_series(1, {before + after + 1})) AS BIGINT) AS k FROM matches m JOIN around e ON e.sensor_id = m.sensor_id AND e.t = m.event_t JOIN around c ON c.sensor_id = m.sensor_id AND c.t = m.control_t) o GROUP BY o.k"""


R9 = lambda names: ", ".join(f"round({n}, 9) AS {n}" for n in names)

ORACLES: dict[str, str] = {
    "dense_grid": q("SELECT sensor_id, ts, speed FROM grid"),
    "grid_validation": q("SELECT CAST(count(*) AS BIGINT) AS n_rows, count(DISTINCT sensor_id) AS sensors, count(DISTINCT t) AS steps, CAST(0 AS BIGINT) AS repeated_keys, max(t) - min(t) + 1 - count(DISTINCT t) AS missing_steps, count(*) = count(DISTINCT sensor_id) * (max(t) - min(t) + 1) AS is_grid FROM grid"),
    "hourly_pattern": q(f"SELECT hour, {PROFILE}, {q6('v', 0.1)} AS p10_speed, {q6('v', 0.9)} AS p90_speed, round(avg(speed), 6) AS mean_with_zero, {q6('speed', 0.5)} AS median_with_zero FROM grid GROUP BY hour"),
    "weekday_hour_pattern": q(f"SELECT day_of_week, dayname(ts) AS weekday, hour, {PROFILE} FROM grid GROUP BY ALL"),
    "day_type_hour_pattern": q(f"""SELECT d.day_type, h.hour, count(g.v) AS valid_count, count(g.t) AS total_count, round(avg(v), 6) AS mean_speed, {q6('v', 0.5)} AS median_speed, {q6('v', 0.1)} AS p10_speed, {q6('v', 0.9)} AS p90_speed
        FROM (VALUES ('Weekday', false), ('Weekend', true)) d(day_type, flag) CROSS JOIN (SELECT CAST(unnest(generate_series(0, 23)) AS BIGINT) AS hour) h LEFT JOIN grid g ON g.is_weekend = d.flag AND g.hour = h.hour GROUP BY 1, 2"""),
    "daily_trend": q(f"SELECT date, {PROFILE}, round(avg(speed), 6) AS mean_with_zero FROM grid GROUP BY date"),
    "sensor_risk": q("SELECT r.*, p.latitude, p.longitude FROM whole_risk r LEFT JOIN places p USING (sensor_id)", EVENTS + ", " + PLACES),
    "run_event_metrics": q("SELECT * FROM run_events", EVENTS),
    "free_flow_q85": q("SELECT sensor_id, round(free_flow, 9) AS free_flow FROM flow", FLOW),
    "congestion_state_rates": q("SELECT * FROM rates", EVENTS),
    "quality_summary": q("""SELECT count(*) AS cells, count(v) AS valid_cells, count(*) FILTER (speed = 0) AS zero_cells, round(count(*) FILTER (speed = 0) / count(*), 6) AS zero_rate,
        (SELECT count(*) FROM shares WHERE zeros = sensors) AS systemwide_timestamps, (SELECT count(*) FROM shares WHERE zeros >= ceil(sensors * 0.5)) AS majority_timestamps,
        (SELECT CAST(coalesce(sum(run_steps), 0) AS BIGINT) FROM zruns WHERE run_steps >= 12) AS long_run_cells, count(*) FILTER (is_large_jump) AS large_jumps, count(*) FILTER (is_large_jump AND (speed = 0 OR before = 0)) AS large_jumps_from_zero,
        count(*) FILTER (is_large_jump AND NOT (speed = 0 OR before = 0)) AS positive_large_jumps FROM jumps""", ZEROS + ", " + JUMPS + ", shares AS (SELECT ts, count(*) FILTER (speed = 0) AS zeros, count(*) AS sensors FROM grid GROUP BY 1)"),
    "quality_flags": q("""SELECT j.sensor_id, j.ts, j.speed, j.is_large_jump, j.is_large_jump AND (j.speed = 0 OR coalesce(j.before = 0, false)) AS is_large_jump_from_zero, j.speed = 0 AS is_zero_observation, coalesce(z.run_steps >= 12, false) AS is_long_sensor_zero_run,
        s.zeros = s.sensors AS is_systemwide_zero, s.zeros >= ceil(s.sensors * 0.5) AS is_majority_zero FROM jumps j JOIN (SELECT t, count(*) FILTER (speed = 0) AS zeros, count(*) AS sensors FROM grid GROUP BY 1) s USING (t) LEFT JOIN zruns z ON z.sensor_id = j.sensor_id AND j.t BETWEEN z.run_start AND z.run_end""", ZEROS + ", " + JUMPS),
    "systemwide_zero": q("SELECT ts, zeros, sensors, zeros = sensors AS is_systemwide_zero, zeros >= ceil(sensors * 0.5) AS is_majority_zero FROM shares", ZERO),
    "majority_zero": q("SELECT make_timestamp(run_start * 3600000000) AS start_ts, make_timestamp(run_end * 3600000000) AS end_ts, run_steps AS steps, run_steps * 60 AS minutes FROM mruns", ZERO + "," + runs("(SELECT 'all' AS sensor_id, t, zeros >= ceil(sensors * 0.5) AS m FROM shares)", "m", "mruns")),
    "long_zero_runs": q("SELECT g.sensor_id, g.ts FROM grid g JOIN zruns z ON z.sensor_id = g.sensor_id AND g.t BETWEEN z.run_start AND z.run_end WHERE z.run_steps >= 3", ZEROS),
    "large_jumps": q("SELECT sensor_id, ts, speed = 0 OR before = 0 AS is_large_jump_from_zero FROM jumps WHERE is_large_jump", GRID + ", " + JUMPS),
    "sensor_audit": q("""SELECT j.sensor_id, count(*) AS n_rows, CAST(0 AS BIGINT) AS missing, count(*) FILTER (speed = 0) AS zeros, count(*) FILTER (speed < 0) AS negatives, round(count(*) FILTER (speed = 0) / count(*), 6) AS zero_rate, round(min(speed), 6) AS min,
        round(quantile_cont(speed, 0.01), 6) AS p01, round(quantile_cont(speed, 0.5), 6) AS median, round(avg(speed), 6) AS mean, round(quantile_cont(speed, 0.99), 6) AS p99, round(max(speed), 6) AS max, round(stddev_samp(speed), 6) AS std,
        CAST(coalesce(any_value(z.longest), 0) AS BIGINT) AS longest_zero_run, count(*) FILTER (is_large_jump) AS large_jumps, count(DISTINCT speed) AS distinct_values FROM jumps j LEFT JOIN (SELECT sensor_id, max(run_steps) AS longest FROM zruns GROUP BY 1) z USING (sensor_id) GROUP BY 1""", ZEROS + ", " + JUMPS),
    "zero_runs_audit": q("SELECT sensor_id, make_timestamp(run_start * 3600000000) AS start_ts, make_timestamp(run_end * 3600000000) AS end_ts, run_steps AS steps, run_steps * 60 AS minutes FROM zruns", ZEROS),
    "top_zero_timestamps": q("SELECT ts, zeros, round(zeros / sensors, 6) AS zero_share FROM shares ORDER BY zeros DESC, ts LIMIT 100", ZERO),
    "interval_counts": "SELECT epoch_us(ts) - epoch_us(before) AS micros, count(*) AS n FROM (SELECT ts, lag(ts) OVER (ORDER BY ts) AS before FROM (SELECT DISTINCT ts FROM events)) WHERE before IS NOT NULL GROUP BY 1",
    "global_quantiles": q("""SELECT round(quantile_cont(v, 0.01), 6) AS p01, round(quantile_cont(v, 0.05), 6) AS p05, round(quantile_cont(v, 0.95), 6) AS p95, round(quantile_cont(v, 0.99), 6) AS p99, count(*) FILTER (speed = 70) AS equal_count, count(DISTINCT date) AS days,
        (SELECT min(n) FROM (SELECT count(*) AS n FROM grid GROUP BY date)) AS min_day_rows, (SELECT max(n) FROM (SELECT count(*) AS n FROM grid GROUP BY date)) AS max_day_rows FROM grid"""),
    "clean_table": q("""SELECT j.ts, j.sensor_id, round(CAST(CAST(j.speed AS FLOAT) AS DOUBLE), 3) AS speed_raw, round(CAST(CAST(j.v AS FLOAT) AS DOUBLE), 3) AS speed_valid, j.hour, j.day_of_week, j.is_weekend, round(CAST(CAST(p.latitude AS FLOAT) AS DOUBLE), 3) AS latitude, round(CAST(CAST(p.longitude AS FLOAT) AS DOUBLE), 3) AS longitude, j.speed = 0 AS is_zero_observation, s.zeros = s.sensors AS is_systemwide_zero,
        s.zeros >= ceil(s.sensors * 0.5) AS is_majority_zero, coalesce(z.run_steps >= 12, false) AS is_long_sensor_zero_run, j.is_large_jump, j.is_large_jump AND (j.speed = 0 OR coalesce(j.before = 0, false)) AS is_large_jump_from_zero, p.sensor_id IS NOT NULL AS has_valid_location
        FROM jumps j JOIN (SELECT t, count(*) FILTER (speed = 0) AS zeros, count(*) AS sensors FROM grid GROUP BY 1) s USING (t) LEFT JOIN zruns z ON z.sensor_id = j.sensor_id AND j.t BETWEEN z.run_start AND z.run_end LEFT JOIN places p ON p.sensor_id = j.sensor_id""", ZEROS + ", " + JUMPS + ", " + PLACES),
    "lag_features": q(f"SELECT sensor_id, ts, {', '.join(f'round({LAG('ratio', k)}, 9) AS ratio_lag_{k}' for k in (1, 2, 3, 6, 12))} FROM rated", FLOW),
    "rolling_features": q(f"SELECT sensor_id, ts, {ROLL} FROM rated", FLOW),
    "trend_features": q(f"SELECT sensor_id, ts, {', '.join(f'round((v - {LAG('v', k)}) / {k * 60}, 9) AS trend_{k}' for k in (2, 3, 6))}, round(v - {LAG('v', 1)}, 9) AS speed_change FROM rated", FLOW),
    "decline_steps": q("SELECT sensor_id, ts, decline_steps FROM declines", GRID + ", " + DECLINE.format("grid")),
    "calendar_features": q(f"SELECT sensor_id, ts, hour, day_of_week, is_weekend, hour AS time_slot, {CALENDAR} FROM grid"),
    "history_mask": q(f"SELECT sensor_id, ts, count(v) {frame(-12, 0)} = 13 AS history_complete FROM rated", FLOW),
    "future_label": q(f"SELECT sensor_id, ts, {FUTURE[60]} AS future_count, count(v) {frame(1, 6)} = 6 AS future_complete FROM state", FLOW),
    "label_sensitivity": q("SELECT sensor_id, " + ", ".join(f"count(*) FILTER (future_complete AND label_{k} = 1) AS positives_{k}" for k in (50, 60, 70)) + " FROM labelled GROUP BY 1", LABELS),
    "time_split": q("SELECT p.split, count(*) AS cells, min(g.ts) AS first_ts, max(g.ts) AS last_ts FROM grid g JOIN parts p ON g.t - p.lo BETWEEN p.start_index AND p.end_index GROUP BY 1", GRID + ", " + AXIS),
    "segment_purge": q("SELECT split, CAST(start_index AS BIGINT) AS start_index, CAST(end_index AS BIGINT) AS end_index, CAST(end_index - start_index + 1 AS BIGINT) AS observations, CAST(start_index + 12 AS BIGINT) AS sample_start, CAST(end_index - 6 AS BIGINT) AS sample_end FROM parts", GRID + ", " + AXIS),
    "train_stats": q("SELECT sensor_id, valid_count, round(median_speed, 9) AS median_speed, round(free_flow, 9) AS free_flow, round(congestion_rate, 9) AS congestion_rate FROM tstats", TRAIN),
    "period_stats": q("SELECT sensor_id, is_weekend, time_slot, round(period_median_speed, 9) AS period_median_speed, round(period_congestion_rate, 9) AS period_congestion_rate FROM periods", TRAIN),
    "feature_table": q(f"SELECT sensor_id, ts, split, {R9(FEATURES)}, decline_steps, hour, day_of_week, CAST(is_weekend AS INTEGER) AS weekend, hour AS time_slot, CAST(label_60 AS BIGINT) AS target FROM model WHERE usable", MODEL),
    "split_summary": q("""SELECT split, count(*) AS candidates, count(*) FILTER (NOT history_complete) AS excluded_history, count(*) FILTER (history_complete AND NOT future_complete) AS excluded_future, count(*) FILTER (usable) AS usable,
        count(*) FILTER (usable AND label_50 = 1) AS positives_50, count(*) FILTER (usable AND label_60 = 1) AS positives_60, count(*) FILTER (usable AND label_70 = 1) AS positives_70, min(CASE WHEN usable THEN ts END) AS first_ts, max(CASE WHEN usable THEN ts END) AS last_ts,
        round(count(*) FILTER (usable AND label_60 = 1) / nullif(count(*) FILTER (usable), 0), 6) AS positive_rate FROM model WHERE split IS NOT NULL GROUP BY 1""", MODEL),
    "dataset_checks": q("SELECT split, count(*) AS n_rows, CAST(0 AS BIGINT) AS null_rows, CAST(0 AS BIGINT) AS repeated_keys, count(DISTINCT sensor_id) AS sensors, CAST(0 AS BIGINT) AS odd_targets, min(label_60) <> max(label_60) AS has_both_classes, 'PASS' AS verdict FROM model WHERE usable GROUP BY 1", MODEL),
    "leakage_report": q("SELECT split, min(t) AS first_t, max(t) AS last_t, true AS after_previous FROM model WHERE usable GROUP BY 1", MODEL),
    "heatmap_cells": q("SELECT date, sensor_id, hour, round(rate, 9) AS rate FROM heat", HEAT),
    "heatmap_top40": q("""SELECT date, sensor_id, round(mean_rate, 6) AS mean_rate, place FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY round(mean_rate, 9) DESC, sensor_id) AS place FROM (
        SELECT h.date, h.sensor_id, sum(h.rate) / any_value(d.hours) AS mean_rate FROM heat h JOIN (SELECT date, count(DISTINCT hour) AS hours FROM heat GROUP BY 1) d USING (date) GROUP BY 1, 2)) WHERE place <= 40""", HEAT),
    "heatmap_pivot": q("SELECT date, sensor_id, " + ", ".join(f"round(coalesce(max(CASE WHEN hour = {h} THEN rate END), 0.0), 6) AS h{h:02d}" for h in range(24)) + " FROM heat GROUP BY 1, 2", HEAT),
    "replay_tail": q("SELECT sensor_id, ts, speed FROM (SELECT *, row_number() OVER (PARTITION BY sensor_id ORDER BY t DESC) AS k FROM grid) WHERE k <= 288"),
    "recent_window": q("SELECT sensor_id, ts, speed FROM grid WHERE sensor_id = '0' ORDER BY ts DESC LIMIT 13"),
    "sensor_edges": q("SELECT * FROM pruned", EDGES),
    "corridor_bands": q("""SELECT a_id, b_id, round(cost, 6) AS cost, round((a.percent + b.percent) / 2, 6) AS percent, CASE WHEN (a.percent + b.percent) / 2 < 20 THEN '0-20%' WHEN (a.percent + b.percent) / 2 < 40 THEN '20-40%' WHEN (a.percent + b.percent) / 2 < 60 THEN '40-60%'
        WHEN (a.percent + b.percent) / 2 < 80 THEN '60-80%' ELSE '80-100%' END AS band FROM pruned JOIN shares a ON a.sensor_id = a_id JOIN shares b ON b.sensor_id = b_id""",
        EDGES + ", shares AS (SELECT CAST(l_suppkey AS VARCHAR) AS sensor_id, 100.0 * count(*) FILTER (l_quantity < 25) / count(*) AS percent FROM lineitem WHERE CAST(l_suppkey AS VARCHAR) IN (SELECT sensor_id FROM places) GROUP BY 1)"),
    "map_centre": q("SELECT round(avg(latitude), 6) AS latitude, round(avg(longitude), 6) AS longitude FROM places", PLACES),
    "risk_bands": q("SELECT CASE WHEN p < 0.4 THEN 'low' WHEN p < 0.7 THEN 'medium' ELSE 'high' END AS risk, count(*) AS n, round(avg(y), 6) AS positive_rate FROM scored GROUP BY 1", SCORED),
    "threshold_sweep": q("SELECT * FROM sweep", SWEEP),
    "best_threshold": q("SELECT * FROM sweep ORDER BY f1 DESC, recall DESC, precision DESC, threshold LIMIT 1", SWEEP),
    "confusion_metrics": q("""SELECT tp, fp, fn, tn, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1,
        round((tp + fn) / (tp + fp + fn + tn), 6) AS positive_rate, round((tp + fp) / (tp + fp + fn + tn), 6) AS predicted_rate FROM (SELECT count(*) FILTER (p >= 0.5 AND y = 1) AS tp, count(*) FILTER (p >= 0.5 AND y = 0) AS fp, count(*) FILTER (p < 0.5 AND y = 1) AS fn, count(*) FILTER (p < 0.5 AND y = 0) AS tn FROM scored)""", SCORED),
    "roc_auc": q("""SELECT round((sum(CASE WHEN y = 1 THEN r END) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)), 6) AS auc
        FROM (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2 AS r FROM scored)""", SCORED),
    "roc_points": q("""SELECT round(p, 9) AS threshold, round(sum(neg) OVER (ORDER BY p DESC) / sum(neg) OVER (), 6) AS fpr, round(sum(pos) OVER (ORDER BY p DESC) / sum(pos) OVER (), 6) AS tpr
        FROM (SELECT p, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg FROM scored GROUP BY 1)""", SCORED),
    "class_balance": q("SELECT count(*) AS n_rows, count(*) FILTER (y = 1) AS positives, round(coalesce(count(*) FILTER (y = 0) / nullif(count(*) FILTER (y = 1), 0), 1), 6) AS positive_weight FROM scored", SCORED),
    "spearman_ranks": q("SELECT round(corr(r50, r60), 6) AS spearman_50_60, round(corr(r60, r70), 6) AS spearman_60_70 FROM (SELECT " + ", ".join(f"rank() OVER (ORDER BY congestion_rate_{k}) + (count(*) OVER (PARTITION BY congestion_rate_{k}) - 1) / 2 AS r{k}" for k in (50, 60, 70)) + " FROM whole_risk WHERE coverage_rate >= 0.75)", EVENTS),
    "zero_sensitivity": q("SELECT \"by\", round(avg(gap), 6) AS mean_gap, round(max(gap), 6) AS max_gap FROM (SELECT 'hour' AS \"by\", avg(v) - avg(speed) AS gap FROM grid GROUP BY hour UNION ALL SELECT 'day', avg(v) - avg(speed) FROM grid GROUP BY date) GROUP BY 1"),
    "weekday_weekend_gap": q(f"SELECT round(avg(m) FILTER (NOT is_weekend), 6) AS weekday_speed, round(avg(m) FILTER (is_weekend), 6) AS weekend_speed, round(avg(m) FILTER (is_weekend) - avg(m) FILTER (NOT is_weekend), 6) AS gap FROM (SELECT is_weekend, hour, {q6('v', 0.5)} AS m FROM grid WHERE hour BETWEEN 7 AND 9 GROUP BY 1, 2)"),
    "weekday_pivot": q("SELECT day_of_week, " + ", ".join(f"max(CASE WHEN hour = {h} THEN m END) AS h{h:02d}" for h in range(24)) + f" FROM (SELECT day_of_week, hour, {q6('v', 0.5)} AS m FROM grid GROUP BY 1, 2) GROUP BY 1"),
    "coverage_topk": q("SELECT * FROM whole_risk WHERE coverage_rate >= 0.75 ORDER BY congestion_rate_60 DESC, sensor_id LIMIT 15", EVENTS),
    "slowest_hours": q(f"SELECT hour, {PROFILE}, {q6('v', 0.1)} AS p10_speed, {q6('v', 0.9)} AS p90_speed, round(avg(speed), 6) AS mean_with_zero, {q6('speed', 0.5)} AS median_with_zero FROM grid GROUP BY hour ORDER BY median_speed, hour LIMIT 1"),
    "importance_rollup": "SELECT CASE WHEN p_size % 2 = 0 THEN 'type' ELSE lower(p_brand) END AS feature, round(sum(p_retailprice), 6) AS importance FROM part GROUP BY 1",
    "metric_melt": q("UNPIVOT (SELECT sensor_id, coverage_rate, congestion_rate_50, congestion_rate_60, congestion_rate_70 FROM whole_risk) ON COLUMNS(* EXCLUDE sensor_id) INTO NAME metric VALUE value", EVENTS),
    "train_sample": q("SELECT sensor_id, ts FROM grid WHERE speed > 0 ORDER BY md5(sensor_id || '|' || t || '|42'), sensor_id || '|' || t LIMIT 500"),
    "matched_controls": q("SELECT * FROM matches", MATCH),
    "event_profile": q(profile_of(12, 6), MATCH),
    "short_event_controls": q("SELECT * FROM matches", SHORT_MATCH),
    "short_event_profile": q(profile_of(3, 2), SHORT_MATCH),
    "neighbour_features": q(f"""SELECT sensor_id, make_timestamp(t * 3600000000) AS ts, t, {", ".join(f"coalesce(lag(n, {k}) OVER w, 0) AS near_count_{k}, round(lag(s, {k}) OVER w / lag(n, {k}) OVER w, 9) AS near_mean_{k}, lag(lo, {k}) OVER w AS near_min_{k}" for k in (1, 2, 3))},
        round(({NEAR_SUM.format("s")}) / nullif({NEAR_SUM.format("n")}, 0), 9) AS near_mean FROM near {W}""", EDGES.replace(PLACES, GRID + ", " + PLACES) + """,
        pairs AS (SELECT from_id AS a, to_id AS b FROM raw_edges WHERE from_id <> to_id UNION SELECT to_id, from_id FROM raw_edges WHERE from_id <> to_id),
        near AS (SELECT g.sensor_id, g.t, m.n, m.s, m.lo FROM grid g LEFT JOIN (SELECT p.a AS sensor_id, o.t, count(*) AS n, sum(o.v) AS s, min(o.v) AS lo FROM pairs p JOIN grid o ON o.sensor_id = p.b WHERE o.v IS NOT NULL GROUP BY 1, 2) m USING (sensor_id, t))"""),
    "group_errors": q("""SELECT concat_ws('+', CASE WHEN gd = 0 THEN 'day_type' END, CASE WHEN gp = 0 THEN 'period' END, CASE WHEN gs = 0 THEN 'sensor_id' END) AS "grouping", day_type, period, sensor_id, tp, fp, fn, tn,
        round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, brier, bias FROM (
        SELECT grouping(day_type) AS gd, grouping(period) AS gp, grouping(sensor_id) AS gs, day_type, period, sensor_id, count(*) FILTER (p >= 0.5 AND y = 1) AS tp, count(*) FILTER (p >= 0.5 AND y = 0) AS fp, count(*) FILTER (p < 0.5 AND y = 1) AS fn, count(*) FILTER (p < 0.5 AND y = 0) AS tn, round(avg((p - y) * (p - y)), 6) AS brier, round(avg(p - y), 6) AS bias
        FROM (SELECT *, CASE WHEN hour(ts) IN (7, 8, 9, 16, 17, 18) THEN 'peak' ELSE 'other' END AS period, CASE WHEN isodow(ts) >= 6 THEN 'Weekend' ELSE 'Weekday' END AS day_type FROM scored) GROUP BY GROUPING SETS ((), (period), (day_type), (period, day_type), (sensor_id)))""", SCORED),
    "short_gaps": q("""SELECT sensor_id, ts, t, speed, age, round(CASE WHEN age <= 3 THEN last_v ELSE period_median_speed END, 9) AS filled, CASE WHEN age = 0 THEN 'read' WHEN age <= 3 THEN 'carried' WHEN period_median_speed IS NOT NULL THEN 'period' END AS filled_from FROM (
        SELECT g.*, g.t - last_value(CASE WHEN v IS NOT NULL THEN t END IGNORE NULLS) OVER w AS age, last_value(v IGNORE NULLS) OVER w AS last_v, p.period_median_speed FROM grid g LEFT JOIN periods p ON p.sensor_id = g.sensor_id AND p.is_weekend = g.is_weekend AND p.time_slot = g.hour
        WINDOW w AS (PARTITION BY g.sensor_id ORDER BY t ROWS UNBOUNDED PRECEDING))""", TRAIN),
    "calibration_curve": q("""SELECT bin, n, round(mean_p, 6) AS mean_p, round(rate, 6) AS positive_rate, round(mean_p - rate, 6) AS gap FROM (SELECT CAST(least(floor(p * 10), 9) AS INTEGER) AS bin, count(*) AS n, avg(p) AS mean_p, avg(y) AS rate FROM scored GROUP BY 1)""", SCORED),
    "calibration_scores": q("""SELECT (SELECT round(avg((p - y) * (p - y)), 6) FROM scored) AS brier, (SELECT round(sum(gap) / sum(n), 6) FROM (SELECT count(*) AS n, abs(sum(p) - sum(y)) AS gap FROM scored GROUP BY least(floor(p * 10), 9))) AS calibration_error,
        (SELECT round(sum(pos * tp / seen) / sum(pos), 6) FROM (SELECT pos, sum(pos) OVER (ORDER BY p DESC) AS tp, sum(n) OVER (ORDER BY p DESC) AS seen FROM (SELECT p, count(*) AS n, count(*) FILTER (y = 1) AS pos FROM scored GROUP BY p))) AS pr_auc""", SCORED),
    "isotonic_fit": q("""SELECT max(p) AS high, sum(m)::BIGINT AS n, any_value(value) AS value FROM (SELECT i, any_value(p) AS p, any_value(m) AS m, round(max(least_after), 9) AS value FROM (
        SELECT b.i, b.p, b.m, min((c.s - coalesce(a.s, 0)) / (c.n - coalesce(a.n, 0))) AS least_after FROM points b JOIN (SELECT 0 AS i, 0 AS s, 0 AS n UNION ALL SELECT i, s, n FROM points) a ON a.i < b.i JOIN points c ON c.i >= b.i GROUP BY a.i, b.i, b.p, b.m) GROUP BY i) GROUP BY value""",
        SCORED + """, points AS (SELECT *, row_number() OVER (ORDER BY p) AS i, sum(m) OVER (ORDER BY p) AS n, sum(pos) OVER (ORDER BY p) AS s FROM (SELECT round(p, 2) AS p, count(*) AS m, sum(y) AS pos FROM scored GROUP BY 1))"""),
    "permuted_column": q("""SELECT a.sensor_id, a.ts, b.speed FROM (SELECT *, row_number() OVER (ORDER BY md5(sensor_id || '|' || t || '|84'), sensor_id || '|' || t) AS r FROM grid) a JOIN (SELECT speed, row_number() OVER (ORDER BY md5(sensor_id || '|' || t || '|85'), sensor_id || '|' || t) AS r FROM grid) b USING (r)"""),
    "stored_splits": q(CHECKS.format("usable_rows"), MODEL + ", usable_rows AS (SELECT split, sensor_id, ts, t, ratio, label_60 AS target FROM model WHERE usable)"),
    "faulty_dataset_checks": q(CHECKS.format("broken"), MODEL + """, one AS (SELECT CASE WHEN t % 13 = 0 THEN 'train' ELSE split END AS split, sensor_id, ts, t, CASE WHEN t % 5 <> 0 THEN ratio END AS ratio, CASE WHEN t % 11 = 0 THEN 2 ELSE label_60 END AS target FROM model WHERE usable),
        broken AS (SELECT * FROM one UNION ALL SELECT * FROM one WHERE t % 7 = 0)"""),
    "faulty_grid_validation": q("""SELECT count(*) AS n_rows, count(DISTINCT sensor_id) AS sensors, count(DISTINCT ts) AS steps, count(*) - count(DISTINCT (ts, sensor_id)) AS repeated_keys, CAST((epoch_us(max(ts)) - epoch_us(min(ts))) / 3600000000 + 1 - count(DISTINCT ts) AS BIGINT) AS missing_steps, false AS is_grid FROM faulty""",
        GRID + ", fewer AS (SELECT sensor_id, t, ts FROM grid WHERE t % 89 <> 0), faulty AS (SELECT sensor_id, CASE WHEN sensor_id = '0' AND t % 101 = 0 THEN ts + INTERVAL 30 MINUTE ELSE ts END AS ts FROM fewer UNION ALL SELECT sensor_id, ts FROM fewer WHERE sensor_id = '0' AND t % 97 = 0)"),
    "explanation_reference": q(" UNION ALL ".join(f"SELECT '{c}' AS feature, round(quantile_cont({c}, 0.5), 9)::DOUBLE AS value, NULL::VARCHAR AS name, scope FROM scoped GROUP BY scope" for c in ALL_FEATURES) + " UNION ALL SELECT 'sensor_id', NULL, min(sensor_id), scope FROM (SELECT scope, sensor_id, count(*) AS n, max(count(*)) OVER (PARTITION BY scope) AS most FROM scoped GROUP BY 1, 2) WHERE n = most GROUP BY scope",
        MODEL + """, trained AS (SELECT *, CAST(is_weekend AS INTEGER) AS weekend, hour AS time_slot FROM model WHERE usable AND split = 'train'), scoped AS (SELECT *, 'all' AS scope FROM trained UNION ALL SELECT *, 'first_sensor' FROM trained WHERE sensor_id = (SELECT min(sensor_id) FROM trained))"""),
    "factor_table": "SELECT p_brand AS feature, value, delta, printf('%.3f', value) AS value_text, printf('%+.4f', delta) AS delta_text, CASE WHEN delta > 0 THEN 'raises' WHEN delta < 0 THEN 'lowers' ELSE 'neutral' END AS direction FROM (SELECT *, round(value / 100 - 9, 4) AS delta FROM (SELECT p_brand, max(p_retailprice) AS value FROM part GROUP BY 1))",
    "footer_counts": "UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS n_rows, count(*) - count({c}) AS nulls, {f'CAST(min({c}) AS VARCHAR)' if b else 'CAST(NULL AS VARCHAR)'} AS least, {f'CAST(max({c}) AS VARCHAR)' if b else 'CAST(NULL AS VARCHAR)'} AS greatest FROM orders " for c, b in ORDER_COLUMNS),
    "congested_runs": q("SELECT * FROM cruns", CRUNS),
    "location_lookup": q("SELECT s.sensor_id, p.latitude, p.longitude FROM (SELECT DISTINCT sensor_id FROM grid) s LEFT JOIN places p USING (sensor_id)", GRID + ", " + PLACES),
    "key_uniqueness": q("SELECT DISTINCT sensor_id, 'a' AS only_in FROM grid WHERE sensor_id NOT IN (SELECT CAST(s_suppkey AS VARCHAR) FROM supplier) UNION ALL SELECT DISTINCT CAST(s_suppkey AS VARCHAR), 'b' FROM supplier WHERE CAST(s_suppkey AS VARCHAR) NOT IN (SELECT sensor_id FROM grid)"),
    "distinct_dates": q("SELECT DISTINCT date FROM grid"),
    "slug": "SELECT p_partkey, regexp_replace(regexp_replace(lower(concat_ws(' / ', p_name, p_brand, p_type)), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM part",
    "safe_casts": "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(event_id AS DOUBLE) END AS number, CASE WHEN event_id % 3 = 0 THEN event_type ELSE strftime(ts, '%Y-%m-%d %H:%M') END AS minute FROM events",
}
