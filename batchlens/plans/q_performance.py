"""Duration, trend and anomaly queries."""

from pyspark.sql import functions as F

from batchlens.functions import clock as c
from batchlens.operators import performance as p
from batchlens.plans.registry import query
from batchlens.plans.sqltext import clock, day_clock, since
from batchlens.sources.testdata import AS_OF

START, END = day_clock("business_date", "start_time_ms"), day_clock("business_date", "end_time_ms")

DAILY = {"daily": f"""
    SELECT j.name AS job_name, cast(business_date AS varchar) AS business_date, avg(duration_ms) AS avg_duration_ms, count(*) AS execution_count
    FROM {{jce}} e JOIN {{job}} j ON j.id = e.job_id WHERE {since(30)} AND duration_ms IS NOT NULL GROUP BY 1, 2"""}

STATS = """round(avg(h.duration_ms), 3) AS hist_avg_ms,
       round(CASE WHEN count(h.duration_ms) = 1 THEN 0.0::double ELSE stddev_samp(h.duration_ms) END, 3) AS hist_std_ms,
       count(h.duration_ms) AS hist_sample_count"""


@query("p1_job_performance", f"""
    SELECT j.name AS job_name, round(avg(duration_ms) / 1000.0, 6) AS avg_duration_seconds, min(duration_ms) / 1000 AS min_duration_seconds,
           max(duration_ms) / 1000 AS max_duration_seconds, count(*) AS execution_count,
           count(*) FILTER (status = 'COMPLETED') AS success_count, count(*) FILTER (status = 'FAILED') AS failure_count
    FROM {{jce}} e JOIN {{job}} j ON j.id = e.job_id WHERE {since(30)} AND duration_ms IS NOT NULL GROUP BY 1""")
def p1(t):
    return p.job_performance(t.jce, t.job, AS_OF).withColumn("avg_duration_seconds", F.round("avg_duration_seconds", 6))


@query("p2_duration_timeseries", "SELECT * REPLACE (round(avg_duration_ms, 4) AS avg_duration_ms) FROM {daily}", DAILY)
def p2(t):
    return p.duration_timeseries(t.jce, t.job, AS_OF).withColumn("avg_duration_ms", F.round("avg_duration_ms", 4))


@query("p3_duration_trend", """
    WITH pts AS (SELECT *, row_number() OVER (PARTITION BY job_name ORDER BY business_date) - 1 AS x FROM {daily}),
    fit AS (SELECT job_name, count(*) AS n,
                   (count(*) * sum(x * avg_duration_ms) - sum(x) * sum(avg_duration_ms)) / nullif(count(*) * sum(x * x) - sum(x) * sum(x), 0) AS slope
            FROM pts GROUP BY 1)
    SELECT job_name, n AS data_points, round(slope, 2) AS slope_ms_per_day,
           CASE WHEN n < 7 THEN 'insufficient_data' WHEN slope > 500 THEN 'deteriorating' WHEN slope < -500 THEN 'improving' ELSE 'stable' END AS trend
    FROM fit""", DAILY)
def p3(t):
    return p.duration_trend(t.jce, t.job, AS_OF)


@query("p4_slow_jobs", f"""
    SELECT j.name AS job_name, e.id AS execution_id, {START} AS start_time, {END} AS end_time, status,
           duration_ms // 1000 AS duration_seconds, round(duration_ms / 60000.0, 2) AS duration_minutes
    FROM {{jce}} e JOIN {{job}} j ON j.id = e.job_id WHERE {since(7)} AND duration_ms > 120000
    ORDER BY duration_ms DESC, e.id LIMIT 10""")
def p4(t):
    return p.slow_jobs(t.jce, t.job, AS_OF, threshold_minutes=2)


@query("p5_compare_jobs", f"""
    SELECT j.name AS job_name, count(*) AS executions, count(*) FILTER (status = 'FAILED') AS failures,
           round(100.0::double * count(*) FILTER (status = 'FAILED') / count(*), 2) AS failure_rate,
           round(avg(duration_ms) / 1000, 2) AS avg_duration_seconds, round(avg(duration_ms) / 1000 / 60.0, 2) AS avg_duration_minutes
    FROM {{jce}} e JOIN {{job}} j ON j.id = e.job_id WHERE {since(30)} AND duration_ms IS NOT NULL GROUP BY 1""")
def p5(t):
    return p.compare_jobs(t.jce, t.job, AS_OF)


@query("p6_avg_duration", f"""
    SELECT s.id AS sic_id, round(avg(e.duration_ms), 4) AS avg_duration_ms, count(e.duration_ms) AS sample_size
    FROM {{sic}} s LEFT JOIN (SELECT * FROM {{jce}} WHERE {since(30)} AND duration_ms IS NOT NULL) e ON e.sic_id = s.id GROUP BY 1""")
def p6(t):
    return p.avg_duration(t.jce, t.sic, AS_OF).withColumn("avg_duration_ms", F.round("avg_duration_ms", 4))


@query("p7_circular_mean_finish", f"""
    WITH a AS (SELECT s.id AS sic_id, count(e.end_time_ms) AS n,
                      atan2(avg(sin(e.end_time_ms / 86400000.0 * 2 * pi())), avg(cos(e.end_time_ms / 86400000.0 * 2 * pi()))) AS m
               FROM {{sic}} s LEFT JOIN (SELECT * FROM {{jce}} WHERE {since(30)}) e ON e.sic_id = s.id GROUP BY 1),
    f AS (SELECT sic_id, n, cast(floor(CASE WHEN m < 0 THEN m + 2 * pi() ELSE m END / (2 * pi()) * 86400000) AS bigint) // 1000 * 1000 AS ms FROM a)
    SELECT sic_id, n AS sample_count, ms AS finish_ms, {clock("ms")} AS avg_finish_time FROM f""")
def p7(t):
    return p.circular_mean_finish(t.jce, t.sic, AS_OF)


@query("p8_anomaly_baseline", f"""
    SELECT s.id AS sic_id, {STATS} FROM {{sic}} s LEFT JOIN (SELECT * FROM {{jce}}
        WHERE business_date >= DATE '2024-01-25' - 30 AND business_date < DATE '2024-01-25' AND duration_ms IS NOT NULL) h ON h.sic_id = s.id GROUP BY 1""")
def p8(t):
    df = p.anomaly_baseline(t.jce, t.sic, "2024-01-25")
    return df.withColumn("hist_avg_ms", F.round("hist_avg_ms", 3)).withColumn("hist_std_ms", F.round("hist_std_ms", 3))


@query("p8_rolling_baseline", f"""
    WITH d AS (SELECT DISTINCT sic_id, business_date FROM {{jce}} WHERE duration_ms IS NOT NULL)
    SELECT d.sic_id, d.business_date, {STATS}
    FROM d LEFT JOIN {{jce}} h ON h.sic_id = d.sic_id AND h.business_date >= d.business_date - 30 AND h.business_date < d.business_date
    GROUP BY 1, 2""")
def p8_rolling(t):
    df = p.rolling_baseline(t.jce)
    return df.withColumn("hist_avg_ms", F.round("hist_avg_ms", 3)).withColumn("hist_std_ms", F.round("hist_std_ms", 3))


@query("p9_duration_anomaly", """
    WITH d AS (SELECT DISTINCT sic_id, business_date FROM {jce}),
    b AS (SELECT d.sic_id, d.business_date, avg(h.duration_ms) AS m, count(h.duration_ms) AS n,
                 CASE WHEN count(h.duration_ms) = 1 THEN 0.0::double ELSE stddev_samp(h.duration_ms) END AS s
          FROM d LEFT JOIN {jce} h ON h.sic_id = d.sic_id AND h.business_date >= d.business_date - 30 AND h.business_date < d.business_date
          GROUP BY 1, 2)
    SELECT e.id AS execution_id, e.sic_id, e.business_date, e.duration_ms, n AS hist_sample_count,
           CASE WHEN n >= 5 THEN e.duration_ms > m + 2.0 * s END AS is_duration_anomaly,
           CASE WHEN n >= 5 AND m > 0 THEN round(e.duration_ms / m, 3) END AS anomaly_deviation_factor,
           cast(trunc(m) AS bigint) AS hist_avg_int_ms, CASE WHEN s <> 0 THEN cast(trunc(s) AS bigint) END AS hist_std_int_ms
    FROM {jce} e JOIN b USING (sic_id, business_date)""")
def p9(t):
    return p.duration_anomaly(t.jce)


@query("p10_clock_conversions", f"""
    SELECT id AS execution_id, {clock("start_time_ms + duration_ms")} AS projected_clock, start_time_ms // 1000 * 1000 AS clock_ms,
           cast(execution_date AS date) AS parsed_date, epoch_us(start_ts) // 1000 % 86400000 AS ms_of_day
    FROM {{jce}}""")
def p10(t):
    text = c.ms_to_clock(F.col("start_time_ms"))
    iso = F.date_format("start_ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return t.jce.select(
        F.col("id").alias("execution_id"),
        c.ms_to_clock(F.col("start_time_ms") + F.col("duration_ms")).alias("projected_clock"),
        c.clock_to_ms(text).alias("clock_ms"),
        c.parse_date(iso).alias("parsed_date"),
        c.ms_of_day(c.parse_timestamp(iso)).alias("ms_of_day"),
    )
