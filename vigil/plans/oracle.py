"""DuckDB oracle SQL for each registered query (tables are pre-registered views)."""

from __future__ import annotations

ORACLE: dict[str, str] = {}

# Q1: delta form in SQL; the dense intervals x sensors form is checked against it in tests.
ORACLE["interval_attention"] = """
WITH ev AS (
  SELECT ts, CAST(user_id + 1 AS INTEGER) AS sensor, value, event_id AS seq,
         CAST(floor(epoch_us(ts) / 86400000000) AS BIGINT) AS interval_id
  FROM events),
nn AS (SELECT max(sensor) AS n FROM ev),
base AS (SELECT -(n * (n + 1) / 2.0) AS b FROM nn),
cnt AS (SELECT interval_id, count(*) AS n_events FROM ev GROUP BY interval_id),
lastv AS (SELECT interval_id, sensor, arg_max(value, seq) AS v FROM ev GROUP BY interval_id, sensor),
d AS (
  SELECT interval_id, sensor * (v - coalesce(lag(v) OVER (PARTITION BY sensor ORDER BY interval_id), 50.0)) AS d
  FROM lastv),
per AS (SELECT interval_id, sum(d) AS d FROM d GROUP BY interval_id),
tab AS (
  SELECT c.interval_id, c.n_events, coalesce(p.d, 0.0) AS d FROM cnt c LEFT JOIN per p USING (interval_id)),
cum AS (
  SELECT interval_id, n_events,
         sum(d) OVER (ORDER BY interval_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS dc,
         count(*) OVER (ORDER BY interval_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS interval_no
  FROM tab)
SELECT interval_id, CAST(interval_no AS BIGINT) AS interval_no, CAST(n_events AS BIGINT) AS n_events,
       round((SELECT b FROM base) + dc, 4) AS margin,
       CASE WHEN (SELECT b FROM base) + dc > 0 THEN 'Attention needed' ELSE 'Everything is OK' END AS status
FROM cum
"""

ORACLE["interval_attention_blocks"] = ORACLE["interval_attention"]

# ---------------------------------------------------------------- shared SQL fragments
_EV = """ev AS (
  SELECT ts, CAST(user_id + 1 AS INTEGER) AS sensor, value, event_id AS seq, props, event_type,
         CAST(floor(epoch_us(ts) / {us}) AS BIGINT) AS interval_id
  FROM events)"""
EV_DAY = _EV.format(us=86400000000)
EV_HOUR = _EV.format(us=3600000000)

TS_TEXT = "strftime({ts}, '%Y-%m-%dT%H:%M:%S.%gZ')"


def _line(ts: str, sensor: str, value: str) -> str:
    return (f"{TS_TEXT.format(ts=ts)} || ',' || CAST({sensor} AS VARCHAR) || ',Sensor ' || "
            f"CAST({sensor} AS VARCHAR) || ',' || printf('%.5f', {value})")


def _parsed(src: str, extra: str = "") -> str:
    """Parse lines of ``src`` (column ``line``) into fields + status."""
    return f"""SELECT {extra} line, len(f) AS nf,
         try_strptime(f[1], '%Y-%m-%dT%H:%M:%S.%gZ') AS pts, TRY_CAST(f[2] AS INTEGER) AS psensor,
         f[3] AS pname, TRY_CAST(f[4] AS DOUBLE) AS pvalue
  FROM (SELECT *, string_split(line, ',') AS f FROM {src})"""


STATUS = """CASE WHEN nf <> 4 THEN 'bad_fields'
       WHEN psensor IS NULL OR pvalue IS NULL THEN 'bad_type'
       WHEN psensor < 0 THEN 'control'
       WHEN pts IS NULL THEN 'bad_time'
       WHEN psensor = 0 THEN 'bad_range'
       WHEN psensor > (SELECT max(user_id) + 1 FROM events) THEN 'bad_range'
       ELSE 'ok' END"""

VEC = "list_transform(embedding, lambda x: CAST(x AS DOUBLE))"
PIX = ("list_transform(embedding, lambda x: CAST(least(greatest(round((CAST(x AS DOUBLE) + 0.5) * 255.0), 0.0), "
       "255.0) AS INTEGER))")
SCORE = f"list_sum(list_transform({VEC}, lambda x, i: x * i))"


def _step(z: str) -> str:
    return f"((({z}) * 1103515245 + 12345) % 2147483648)"


def _mix(z: str, shift: int) -> str:
    return f"xor(({z}), ({z}) >> {shift})"


def _uniform(key: str, s: str, seed: int = 42) -> str:
    k = f"xor(({key}) % 2147483648, ({key}) >> 31)"
    x = f"(({k}) * 1103515245 + ({s}) * 12345 + {seed}) % 2147483648"
    x = _mix(_step(_mix(_step(x), 16)), 13)
    return f"(CAST({x} AS DOUBLE) / 2147483648.0)"


GEN = f"""gen AS (
  SELECT k, f, list_sum(list_transform(f, lambda x, i: x * i)) AS score,
         CAST(CASE WHEN list_sum(list_transform(f, lambda x, i: x * i)) > 27.5 THEN 1 ELSE 0 END AS DOUBLE) AS label
  FROM (SELECT k, list_transform(range(0, 10), lambda s: {_uniform('k', 's')}) AS f
        FROM (SELECT l_orderkey * 8 + l_linenumber AS k FROM lineitem)))"""


def _cutoffs(scores: str) -> str:
    return f"""WITH s AS ({scores}),
st AS (SELECT count(*) // 100 AS step FROM s),
r AS (SELECT score, row_number() OVER (ORDER BY score) - 1 AS idx FROM s)
SELECT CAST(100 - idx // (SELECT step FROM st) AS INTEGER) AS pct, round(score, 6) AS cutoff
FROM r WHERE idx > 0 AND idx % (SELECT step FROM st) = 0 AND idx // (SELECT step FROM st) < 100"""


# ---------------------------------------------------------------- sensor intervals
ORACLE["parse_events"] = f"""
WITH l AS (SELECT event_id, {_line('ts', 'user_id + 1', 'value')} AS line FROM events),
p AS ({_parsed('l', 'event_id,')})
SELECT event_id, line, epoch_ms(pts) AS ts_ms, psensor AS sensor, pname AS name, pvalue AS value,
       {STATUS} AS status
FROM p
"""

ORACLE["parse_rejects"] = f"""
WITH {EV_DAY},
h AS (SELECT *, {TS_TEXT.format(ts='ts')} || ',' || CAST(sensor AS VARCHAR) || ',Sensor ' || CAST(sensor AS VARCHAR) AS head3,
             {_line('ts', 'sensor', 'value')} AS good FROM ev),
l AS (
  SELECT 'event' AS kind, good AS line FROM h
  UNION ALL SELECT 'props', props FROM h
  UNION ALL SELECT 'truncated', head3 FROM h
  UNION ALL SELECT 'trailing_empty', head3 || ',' FROM h
  UNION ALL SELECT 'extra_field', good || ',' || event_type FROM h
  UNION ALL SELECT 'zero_based', {_line('ts', 'sensor - 1', 'value')} FROM h),
p AS ({_parsed('l', 'kind,')})
SELECT kind, {STATUS} AS status, count(*) AS n FROM p GROUP BY ALL
"""

ORACLE["last_per_sensor_interval"] = f"""
WITH {EV_DAY}
SELECT interval_id, sensor, arg_max(value, seq) AS value, count(*) AS n_readings FROM ev GROUP BY interval_id, sensor
"""

ORACLE["interval_counts"] = f"""
WITH {EV_HOUR},
cnt AS (SELECT interval_id, count(*) AS n_events FROM ev GROUP BY interval_id)
SELECT interval_id, n_events,
       CAST(sum(n_events) OVER w AS BIGINT) AS events_cum, CAST(count(*) OVER w AS BIGINT) AS interval_no
FROM cnt WINDOW w AS (ORDER BY interval_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
"""

_SPINE = f"""{EV_HOUR},
cnt AS (SELECT interval_id, count(*) AS n_events FROM ev GROUP BY interval_id),
spine AS (
  SELECT s.interval_id, CAST(coalesce(c.n_events, 0) AS BIGINT) AS n_events, coalesce(c.n_events, 0) = 0 AS empty
  FROM (SELECT unnest(generate_series((SELECT min(interval_id) FROM cnt), (SELECT max(interval_id) FROM cnt))) AS interval_id) s
  LEFT JOIN cnt c USING (interval_id))"""

ORACLE["empty_intervals"] = f"""
WITH {_SPINE}
SELECT interval_id, n_events, empty FROM spine
"""

ORACLE["run_summary"] = f"""
WITH {_SPINE}
SELECT CAST(sum(CASE WHEN NOT empty THEN 1 ELSE 0 END) AS BIGINT) AS n_intervals,
       CAST(sum(CASE WHEN empty THEN 1 ELSE 0 END) AS BIGINT) AS n_empty,
       CAST(sum(n_events) AS BIGINT) AS n_events,
       round((SELECT (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 FROM ev), 3) AS span_seconds,
       CAST(sum(CASE WHEN NOT empty THEN 1 ELSE 0 END) * 3600 AS DOUBLE) AS active_seconds,
       round(CAST(sum(n_events) AS DOUBLE) / (sum(CASE WHEN NOT empty THEN 1 ELSE 0 END) * 3600.0), 6) AS events_per_sec
FROM spine
"""

ORACLE["carry_forward"] = f"""
WITH {EV_DAY},
lastv AS (SELECT interval_id, sensor, arg_max(value, seq) AS value FROM ev GROUP BY interval_id, sensor)
SELECT sensor, interval_id AS interval_from,
       lead(interval_id) OVER (PARTITION BY sensor ORDER BY interval_id) AS interval_to, value
FROM lastv
"""

ORACLE["sentinel_split"] = f"""
WITH l AS (
  SELECT {_line('ts', 'user_id + 1', 'value')} AS line FROM events
  UNION ALL SELECT {TS_TEXT.format(ts='max(ts)')} || ',-1,Sensor -1,0.00000' FROM events),
p AS ({_parsed('l')}),
s AS (SELECT CAST(floor(epoch_us(pts) / 86400000000) AS BIGINT) AS interval_id, {STATUS} AS status FROM p)
SELECT interval_id, CAST(sum(CASE WHEN status = 'ok' THEN 1 ELSE 0 END) AS BIGINT) AS n_data,
       CAST(sum(CASE WHEN status = 'control' THEN 1 ELSE 0 END) AS BIGINT) AS n_control,
       bool_or(status = 'control') AS last_interval
FROM s GROUP BY interval_id
"""

# ---------------------------------------------------------------- vectors
ORACLE["weighted_score"] = f"SELECT vec_id, round({SCORE}, 6) AS score FROM embeddings"

ORACLE["threshold_label"] = f"""
WITH l AS (SELECT CASE WHEN {SCORE} > 0 THEN 1 ELSE 0 END AS label FROM embeddings)
SELECT count(*) AS n, CAST(sum(label) AS BIGINT) AS n_ones, round(avg(label) * 100.0, 6) AS pct_ones FROM l
"""

ORACLE["score_cutoffs"] = _cutoffs(f"SELECT {SCORE} AS score FROM embeddings")

ORACLE["event_value_cutoffs"] = _cutoffs("SELECT round(CAST(value AS DOUBLE)) AS score FROM events")

ORACLE["encode_vector"] = f"""
WITH l AS (
  SELECT vec_id, printf('%.5f', CAST(label AS DOUBLE)) || ',' ||
         array_to_string(list_transform({VEC}, lambda x: printf('%.5f', x)), ',') AS line
  FROM embeddings),
a AS (SELECT vec_id, line, list_transform(string_split(line, ','), lambda x: TRY_CAST(x AS DOUBLE)) AS arr FROM l)
SELECT vec_id, line, CAST(len(arr) AS INTEGER) AS n_fields, arr[1] AS label, round(list_sum(arr[2:]), 5) AS feature_sum
FROM a
"""

ORACLE["generate_vectors"] = f"""
WITH {GEN}
SELECT label, count(*) AS n, round(avg(score), 6) AS avg_score, round(min(score), 6) AS min_score,
       round(max(score), 6) AS max_score, round(sum(f[1]), 4) AS sum_first
FROM gen GROUP BY label
"""

ORACLE["generated_cutoffs"] = f"WITH {GEN}\n" + _cutoffs("SELECT score FROM gen").replace("WITH s AS", ", s AS", 1)

# ---------------------------------------------------------------- images
_UNNEST = "SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings"
_UNNEST_PIX = f"SELECT vec_id, label, unnest(p) AS x, generate_subscripts(p, 1) AS i FROM (SELECT vec_id, label, {PIX} AS p FROM embeddings)"

ORACLE["global_mean_std"] = f"""
SELECT count(*) AS n, round(avg(x), 9) AS mean, round(stddev_pop(x), 9) AS std FROM ({_UNNEST})
"""

ORACLE["scalar_normalise"] = f"""
WITH px AS ({_UNNEST}),
m AS (SELECT avg(x) AS mean, stddev_pop(x) AS std FROM px)
SELECT vec_id, round(sum(i * (x - (SELECT mean FROM m)) / (SELECT std FROM m)), 4) AS norm_sum FROM px GROUP BY vec_id
"""

ORACLE["fixed_normalise"] = f"""
WITH px AS ({_UNNEST_PIX})
SELECT vec_id, round(sum(i * (x - 120.70756512369792) / 64.1500758911213), 6) AS norm_sum FROM px GROUP BY vec_id
"""

ORACLE["mean_vector_subtract"] = f"""
WITH px AS (SELECT vec_id, x / 255.0 AS x, i FROM ({_UNNEST_PIX})),
m AS (SELECT i, avg(x) AS m FROM px GROUP BY i)
SELECT vec_id, round(sum(i * (x - m)), 6) AS centred_sum, round(max(CASE WHEN i = 1 THEN x - m END), 6) AS centred_first
FROM px JOIN m USING (i) GROUP BY vec_id
"""

ORACLE["channel_normalise"] = f"""
WITH px AS (SELECT vec_id, x, i, (i - 1) % 4 AS ch FROM ({_UNNEST_PIX})),
st AS (SELECT ch, avg(x) AS m, stddev_pop(x) AS s FROM px GROUP BY ch)
SELECT vec_id, round(sum(i * (x - m) / s), 4) AS norm_sum, round(max(CASE WHEN i = 2 THEN (x - m) / s END), 6) AS norm_second
FROM px JOIN st USING (ch) GROUP BY vec_id
"""

ORACLE["center_crop"] = f"""
WITH c AS (
  SELECT vec_id, list_filter(p, lambda x, i: (i - 1) // 8 BETWEEN 1 AND 6 AND (i - 1) % 8 BETWEEN 1 AND 6) AS c
  FROM (SELECT vec_id, {PIX} AS p FROM embeddings) WHERE len(p) = 64)
SELECT vec_id, 'ok' AS status, CAST(len(c) AS INTEGER) AS n_pixels, CAST(list_sum(c) AS BIGINT) AS pixel_sum, c[1] AS first_pixel FROM c
"""

ORACLE["layout_reorder"] = f"""
WITH il AS (
  SELECT vec_id, list_transform(range(0, 64), lambda j: p[(3 - j % 4) * 16 + j // 4 + 1]) AS q
  FROM (SELECT vec_id, {PIX} AS p FROM embeddings))
SELECT vec_id, CAST(list_sum(list_transform(q, lambda x, i: CAST(x AS BIGINT) * i)) AS BIGINT) AS checksum,
       array_to_string(q[1:8], ',') AS head
FROM il
"""

ORACLE["image_line_roundtrip"] = f"""
WITH p AS (SELECT vec_id, label, {PIX} AS p FROM embeddings),
l AS (
  SELECT vec_id, label, p,
         CAST(label AS VARCHAR) || array_to_string(list_transform(p, lambda x: CAST(x AS VARCHAR)), ' ') AS line_a,
         printf('%.1f', CAST(label + 1 AS DOUBLE)) || ',0,0,0,8,0,0,0,8,' ||
           array_to_string(list_transform(p, lambda x: CAST(CASE WHEN x >= 128 THEN x - 256 ELSE x END AS VARCHAR)), ',') AS line_b
  FROM p)
SELECT vec_id, label AS label_a, label AS label_b, CAST(len(p) AS INTEGER) AS n_a, CAST(len(p) AS INTEGER) AS n_b,
       round(CAST(list_sum(p) AS DOUBLE), 1) AS sum_a, round(CAST(list_sum(p) AS DOUBLE), 1) AS sum_b,
       CAST(length(line_a) AS INTEGER) AS len_a, CAST(length(line_b) AS INTEGER) AS len_b
FROM l
"""

ORACLE["binary_image_records"] = f"""
WITH il AS (
  SELECT vec_id, label, list_transform(range(0, 64), lambda j: p[(j % 4) * 16 + j // 4 + 1]) AS q
  FROM (SELECT vec_id, label, {PIX} AS p FROM embeddings))
SELECT vec_id, label, 65 AS n_bytes, CAST(list_sum(q) AS BIGINT) AS pixel_sum,
       CAST(list_sum(list_transform(q, lambda x, i: CAST(x AS BIGINT) * i)) AS BIGINT) AS checksum
FROM il
"""

# ---------------------------------------------------------------- classification reports
_DIST_FROM_PX = """cent AS (SELECT label AS c, i, avg(x) AS m FROM px GROUP BY label, i),
dist AS (
  SELECT p.vec_id, p.label, c.c, round(sum((p.x - c.m) * (p.x - c.m)), 4) AS d
  FROM px p JOIN cent c ON p.i = c.i GROUP BY p.vec_id, p.label, c.c),
ranked AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, c) AS rn FROM dist),
pred AS (SELECT vec_id, label, c AS predict FROM ranked WHERE rn = 1)"""
_DIST = f"px AS ({_UNNEST}),\n" + _DIST_FROM_PX

ORACLE["classify_accuracy"] = f"""
WITH {_DIST}
SELECT count(*) AS n, CAST(sum(CASE WHEN label = predict THEN 1 ELSE 0 END) AS BIGINT) AS correct,
       round(100.0 * sum(CASE WHEN label = predict THEN 1 ELSE 0 END) / count(*), 4) AS pct
FROM pred
"""

ORACLE["classify_accuracy_udf"] = ORACLE["classify_accuracy"]

ORACLE["topk_accuracy"] = f"""
WITH {_DIST},
mine AS (SELECT vec_id, label, d AS dm FROM dist WHERE c = label),
rk AS (
  SELECT m.vec_id, 1 + count(*) FILTER (WHERE d.d < m.dm OR (d.d = m.dm AND d.c < m.label)) AS rank
  FROM mine m JOIN dist d USING (vec_id) GROUP BY m.vec_id)
SELECT count(*) AS n, round(100.0 * avg(CASE WHEN rank <= 1 THEN 1 ELSE 0 END), 4) AS acc1,
       round(100.0 * avg(CASE WHEN rank <= 5 THEN 1 ELSE 0 END), 4) AS acc5
FROM rk
"""

ORACLE["first_batch_topk"] = f"""
WITH {_DIST},
first AS (SELECT vec_id FROM embeddings ORDER BY vec_id LIMIT 256),
mine AS (SELECT vec_id, label, d AS dm FROM dist WHERE c = label AND vec_id IN (SELECT vec_id FROM first)),
rk AS (
  SELECT m.vec_id, 1 + count(*) FILTER (WHERE d.d < m.dm OR (d.d = m.dm AND d.c < m.label)) AS rank
  FROM mine m JOIN dist d USING (vec_id) GROUP BY m.vec_id)
SELECT count(*) AS n, round(100.0 * avg(CASE WHEN rank <= 1 THEN 1 ELSE 0 END), 4) AS acc1,
       round(100.0 * avg(CASE WHEN rank <= 5 THEN 1 ELSE 0 END), 4) AS acc5
FROM rk
"""

ORACLE["topk_classes"] = f"""
WITH {_DIST}
SELECT vec_id, string_agg(CAST(c AS VARCHAR), ',' ORDER BY rn) AS best FROM ranked WHERE rn <= 5 GROUP BY vec_id
"""

ORACLE["class_counts"] = """
SELECT label, count(*) AS n, (SELECT count(DISTINCT label) FROM embeddings) AS n_classes FROM embeddings GROUP BY label
"""

ORACLE["count_window_progress"] = f"""
WITH {_DIST},
g AS (SELECT (row_number() OVER (ORDER BY vec_id) - 1) // 100 AS report, CASE WHEN label = predict THEN 1 ELSE 0 END AS c FROM pred),
per AS (SELECT report, count(*) AS images, sum(c) AS correct FROM g GROUP BY report),
cum AS (SELECT report, sum(images) OVER w AS images, sum(correct) OVER w AS correct FROM per
        WINDOW w AS (ORDER BY report ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT CAST(report + 1 AS BIGINT) AS report_no, CAST(images AS BIGINT) AS images, CAST(correct AS BIGINT) AS correct,
       round(100.0 * correct / images, 4) AS pct
FROM cum
"""

ORACLE["replicate"] = """
SELECT CAST(copy AS INTEGER) AS copy, count(*) AS n, CAST(sum(label) AS BIGINT) AS label_sum
FROM (SELECT unnest(range(1, 6)) AS copy, label FROM embeddings) GROUP BY copy
"""

ORACLE["replay"] = """
WITH r AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS k FROM embeddings),
t AS (SELECT count(*) AS n, (5 * count(*)) // 2 AS total FROM embeddings)
SELECT vec_id, CAST(((SELECT total FROM t) - 1 - k) // (SELECT n FROM t) + 1 AS BIGINT) AS copies, CAST(k AS BIGINT) AS first_i
FROM r WHERE k < (SELECT total FROM t)
"""

ORACLE["label_rank"] = """
WITH r AS (SELECT event_type, CAST(dense_rank() OVER (ORDER BY event_type) AS INTEGER) AS label
           FROM (SELECT DISTINCT event_type FROM events))
SELECT e.event_type, r.label, count(*) AS n FROM events e JOIN r USING (event_type) GROUP BY e.event_type, r.label
"""

# ---------------------------------------------------------------- stream forms
ORACLE["stream_attention"] = ORACLE["interval_attention"]

ORACLE["stream_intervals"] = f"""
WITH {EV_HOUR},
cnt AS (SELECT interval_id, count(*) AS n_events FROM ev GROUP BY interval_id)
SELECT interval_id, n_events, CAST(count(*) OVER (ORDER BY interval_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS interval_no
FROM cnt
"""

ORACLE["stream_interval_report"] = f"""
WITH {EV_HOUR},
chunked AS (SELECT *, CAST(floor(floor(epoch_us(ts) / 86400000000) / 7) AS BIGINT) AS chunk FROM ev),
late AS (SELECT count(*) AS n_late FROM chunked WHERE seq % 97 = 5 AND chunk + 2 <= (SELECT max(chunk) FROM chunked)),
lines AS (SELECT * FROM ev WHERE interval_id % 11 <> 5),
ok AS (SELECT * FROM lines WHERE interval_id % 7 <> 3),
nn AS (SELECT max(sensor) AS n FROM ev),
base AS (SELECT -(n * (n + 1) / 2.0) AS b FROM nn),
spine AS (SELECT unnest(range(min(interval_id), max(interval_id) + 1)) AS interval_id FROM lines),
cnt AS (SELECT interval_id, count(*) AS n_lines FROM lines GROUP BY interval_id),
good AS (SELECT interval_id, count(*) AS n_events FROM ok GROUP BY interval_id),
lastv AS (SELECT interval_id, sensor, arg_max(value, seq) AS v FROM ok GROUP BY interval_id, sensor),
d AS (SELECT interval_id, sensor * (v - coalesce(lag(v) OVER (PARTITION BY sensor ORDER BY interval_id), 50.0)) AS d FROM lastv),
per AS (SELECT interval_id, sum(d) AS d FROM d GROUP BY interval_id),
tab AS (
  SELECT interval_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_events, 0) AS n_events, coalesce(d, 0.0) AS d
  FROM spine LEFT JOIN cnt USING (interval_id) LEFT JOIN good USING (interval_id) LEFT JOIN per USING (interval_id)),
cum AS (
  SELECT *, (SELECT b FROM base) + sum(d) OVER w AS m, sum(CASE WHEN n_lines > 0 THEN 1 ELSE 0 END) OVER w AS no
  FROM tab WINDOW w AS (ORDER BY interval_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT interval_id, CASE WHEN n_lines > 0 THEN CAST(no AS BIGINT) ELSE 0 END AS interval_no, CAST(n_events AS BIGINT) AS n_events, CAST(n_lines AS BIGINT) AS n_lines,
       CASE WHEN n_lines > 0 THEN round(m, 4) END AS margin,
       CASE WHEN n_lines > 0 THEN CASE WHEN m > 0 THEN 'Attention needed' ELSE 'Everything is OK' END END AS status, n_lines = 0 AS empty, (SELECT n_late FROM late) AS n_late
FROM cum
"""

ORACLE["stream_rejects"] = f"SELECT status, CAST(sum(n) AS BIGINT) AS n FROM ({ORACLE['parse_rejects']}) GROUP BY status"

ORACLE["stream_classify"] = f"""
WITH px AS (
  SELECT vec_id, label, (CAST(unnest(p) AS DOUBLE) - 120.70756512369792) / 64.1500758911213 AS x, generate_subscripts(p, 1) AS i
  FROM (SELECT vec_id, label, {PIX} AS p FROM embeddings)),
{_DIST_FROM_PX}
SELECT count(*) AS n, CAST(sum(CASE WHEN label = predict THEN 1 ELSE 0 END) AS BIGINT) AS correct,
       round(100.0 * sum(CASE WHEN label = predict THEN 1 ELSE 0 END) / count(*), 4) AS pct
FROM pred
"""

ORACLE["parse_training_status"] = """
SELECT CASE vec_id % 10 WHEN 3 THEN 'bad_field' WHEN 6 THEN 'ragged' ELSE 'ok' END AS status, CAST(count(*) AS BIGINT) AS n
FROM embeddings GROUP BY 1
"""

# ---------------------------------------------------------------- training and files
ORACLE["train_text_roundtrip"] = f"""
WITH l AS (
  SELECT printf('%.5f', CASE WHEN {SCORE} > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) || ',' ||
         array_to_string(list_transform({VEC}, lambda x: printf('%.5f', x)), ',') AS line
  FROM embeddings),
a AS (SELECT list_transform(string_split(line, ','), lambda x: TRY_CAST(x AS DOUBLE)) AS arr FROM l)
SELECT 'ok' AS status, arr[1] AS label, CAST(len(arr) - 1 AS INTEGER) AS n_values,
       round(list_sum(list_transform(arr[2:], lambda x, i: x * i)), 5) AS score
FROM a
"""

ORACLE["lr_predict"] = f"""
WITH s AS (SELECT vec_id, 0.25 + list_sum(list_transform({VEC}, lambda x, i: x * (i - 32.5))) AS margin FROM embeddings)
SELECT vec_id, round(margin, 6) AS margin, CAST(margin > 0 AS INTEGER) AS prediction FROM s
"""

ORACLE["lr_fit"] = "SELECT count(*) AS n, 64 AS n_coefficients, true AS converged FROM embeddings"

ORACLE["labelled_folder_scan"] = f"""
SELECT vec_id, CAST(dense_rank() OVER (ORDER BY 'class_' || label) AS INTEGER) AS label,
       CAST(list_sum(list_transform(p, lambda x, i: CAST(x AS BIGINT) * i)) AS BIGINT) AS checksum
FROM (SELECT vec_id, CAST(label AS VARCHAR) AS label, {PIX} AS p FROM embeddings)
"""

ORACLE["binary_file_records"] = ORACLE["binary_image_records"].replace("SELECT vec_id, label, 65 AS n_bytes,", "SELECT label,")

ORACLE["record_file_scan"] = ORACLE["binary_file_records"]

ORACLE["stream_classify_bytes"] = f"""
WITH px AS (
  SELECT vec_id, label, i, (x - (120.0 + 2.0 * ((i - 1) % 4))) / (60.0 + 2.0 * ((i - 1) % 4)) AS x FROM ({_UNNEST_PIX})),
{_DIST_FROM_PX}
SELECT count(*) AS n, CAST(sum(CASE WHEN label = predict THEN 1 ELSE 0 END) AS BIGINT) AS correct,
       (SELECT count(*) FROM embeddings WHERE vec_id % 50 = 7) AS rejected,
       round(100.0 * sum(CASE WHEN label = predict THEN 1 ELSE 0 END) / count(*), 4) AS pct
FROM pred WHERE vec_id % 50 <> 7
"""

# The state of each sensor at each day's end: the last reading of the hours up to then.
ORACLE["sensor_state_daily"] = f"""
WITH {EV_HOUR},
lastv AS (SELECT interval_id, sensor, arg_max(value, seq) AS v FROM ev GROUP BY interval_id, sensor),
days AS (SELECT unnest(range(CAST(floor(min(interval_id) / 24) AS BIGINT), CAST(floor(max(interval_id) / 24) AS BIGINT) + 1)) AS day FROM ev),
grid AS (SELECT day, sensor, day * 24 + 23 AS hour FROM days, (SELECT DISTINCT sensor FROM ev))
SELECT day, g.sensor, coalesce(v, 50.0) AS value, coalesce(hour - interval_id, -1) AS hours_old
FROM grid g ASOF LEFT JOIN lastv l ON g.sensor = l.sensor AND g.hour >= l.interval_id
"""

# Every event is sent twice at one millisecond; the second line counts.
ORACLE["stream_ties"] = f"""
WITH {EV_DAY},
lastv AS (SELECT interval_id, sensor, arg_max(CAST(value AS DOUBLE) + 1.0, seq) AS v, 2 * count(*) AS n_readings FROM ev GROUP BY interval_id, sensor)
SELECT interval_id, sensor, round(v, 5) AS value, CAST(n_readings AS BIGINT) AS n_readings FROM lastv
"""

ORACLE["stream_count_windows"] = f"""
WITH px AS (
  SELECT vec_id, label, (CAST(unnest(p) AS DOUBLE) - 120.70756512369792) / 64.1500758911213 AS x, generate_subscripts(p, 1) AS i
  FROM (SELECT vec_id, label, {PIX} AS p FROM embeddings)),
{_DIST_FROM_PX},
g AS (SELECT (row_number() OVER (ORDER BY vec_id) - 1) // 100 AS report, CASE WHEN label = predict THEN 1 ELSE 0 END AS c FROM pred),
per AS (SELECT report, count(*) AS images, sum(c) AS correct FROM g GROUP BY report),
cum AS (SELECT report, sum(images) OVER w AS images, sum(correct) OVER w AS correct FROM per
        WINDOW w AS (ORDER BY report ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT CAST(report + 1 AS BIGINT) AS report_no, CAST(images AS BIGINT) AS images, CAST(correct AS BIGINT) AS correct, round(100.0 * correct / images, 4) AS pct
FROM cum
"""

# The lines of the disturbed stream: sent in time (good or without a value), and sent again two weeks later.
_SENT = f"""{EV_HOUR},
chunked AS (SELECT *, CAST(floor(floor(epoch_us(ts) / 86400000000) / 7) AS BIGINT) AS chunk FROM ev),
sent AS (
  SELECT CASE WHEN interval_id % 7 = 3 THEN 'bad_type' ELSE 'good' END AS reason, chunk FROM chunked WHERE interval_id % 11 <> 5
  UNION ALL SELECT 'late', chunk + 2 FROM chunked WHERE seq % 97 = 5 AND chunk + 2 <= (SELECT max(chunk) FROM chunked))"""

ORACLE["stream_dead_letters"] = f"WITH {_SENT} SELECT reason, count(*) AS n FROM sent GROUP BY reason"

ORACLE["stream_run_report"] = f"""
WITH {_SENT}
SELECT count(DISTINCT chunk) AS n_batches, count(*) + 1 AS n_rows, count(*) + 1 AS n_lines, count(*) FILTER (reason = 'bad_type') AS n_rejected, true AS busy FROM sent
"""
