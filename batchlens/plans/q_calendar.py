"""Calendar dimension, rule evaluation and calendar anomalies."""

from pyspark.sql import functions as F

from batchlens.operators import calendar as c
from batchlens.operators import traverse as tr
from batchlens.plans.registry import SHARED, query

FIRST, LAST, REGION = "2024-01-01", "2024-01-31", "US"

SHARED.update({
    "cal": """
        SELECT *, CASE WHEN wd THEN sum(wd::int) OVER (PARTITION BY y, m ORDER BY d) END AS bms,
               CASE WHEN wd THEN sum(wd::int) OVER (PARTITION BY y, m ORDER BY d DESC) END AS bme,
               CASE WHEN wd THEN sum(wd::int) OVER (PARTITION BY y, q ORDER BY d) END AS bqs,
               CASE WHEN wd THEN sum(wd::int) OVER (PARTITION BY y, q ORDER BY d DESC) END AS bqe,
               CASE WHEN wd THEN sum(wd::int) OVER (PARTITION BY y ORDER BY d) END AS bys,
               CASE WHEN wd THEN sum(wd::int) OVER (PARTITION BY y ORDER BY d DESC) END AS bye
        FROM (SELECT d, year(d) AS y, quarter(d) AS q, month(d) AS m, day(d) AS dom, isodow(d) AS dow, dayofyear(d) AS doy,
                     weekofyear(d) AS wk, isoyear(d) AS wy, (day(d) - 1) // 7 + 1 AS occ, isodow(d) <= 5 AS wd
              FROM (SELECT cast(unnest(generate_series(make_date(y0 - 1, 1, 1)::timestamp, make_date(y1 + 1, 12, 31)::timestamp, INTERVAL 1 DAY)) AS date) AS d
                    FROM (SELECT min(year(business_date)) AS y0, max(year(business_date)) AS y1 FROM {jce})))""",
    "rule_match": f"""
        SELECT rule_id, evaluator_fn, d AS business_date, coalesce(CASE evaluator_fn
            WHEN 'nth_dow_month' THEN mok AND dow = cast(json_extract(p, '$.dayOfWeek') AS int) AND list_contains(wo, occ)
            WHEN 'nth_multi_dow_month' THEN mok AND list_contains(cast(json_extract(p, '$.daysOfWeek') AS int[]), dow) AND list_contains(wo, occ)
            WHEN 'nth_dom' THEN mok AND list_contains(cast(json_extract(p, '$.daysOfMonth') AS int[]), dom)
            WHEN 'nth_first_biz_month' THEN mok AND list_contains(fs, bms)
            WHEN 'nth_last_biz_month' THEN mok AND list_contains(fe, bme)
            WHEN 'nth_first_biz_quarter' THEN qok AND list_contains(fs, bqs)
            WHEN 'nth_last_biz_quarter' THEN qok AND list_contains(fe, bqe)
            WHEN 'first_biz_year' THEN bys = 1 WHEN 'last_biz_year' THEN bye = 1
            WHEN 'holiday' THEN EXISTS (SELECT 1 FROM {{holiday}} h WHERE h.holiday_date = d
                 AND upper(trim(h.region)) IN ('ALL', upper(trim(coalesce(json_extract_string(p, '$.region'), '{REGION}')))))
            WHEN 'graph_property' THEN CASE json_extract_string(p, '$.propertyName') WHEN 'isWeekend' THEN NOT wd WHEN 'isWeekday' THEN wd END
            WHEN 'named_holiday' THEN list_contains(cast(json_extract(p, '$.holidayDates') AS varchar[]), cast(d AS varchar))
            WHEN 'specific_date' THEN list_contains(list_transform(cast(json_extract(p, '$.targetDates') AS varchar[]), lambda x: try_cast(x[1:10] AS date)), d)
            END, false) AS matched
        FROM (SELECT *, coalesce(len(ms), 0) = 0 OR list_contains(ms, m) AS mok, coalesce(len(qs), 0) = 0 OR list_contains(qs, q) AS qok FROM (
              SELECT r.*, c.*, cast(json_extract(p, '$.weekOccurrences') AS int[]) AS wo, cast(json_extract(p, '$.months') AS int[]) AS ms,
                     cast(json_extract(p, '$.quarters') AS int[]) AS qs, cast(json_extract(p, '$.bizDayFromStart') AS int[]) AS fs,
                     cast(json_extract(p, '$.bizDayFromEnd') AS int[]) AS fe
              FROM (SELECT *, CASE WHEN json_valid(params) THEN params ELSE '{{}}' END AS p FROM {{business_calendar}}) r, {{cal}} c))""",
    "ruled": """
        SELECT s.id AS sic_id, s.job_id, s.job_group_id, a.rule_id, a.rule_type,
               CASE WHEN a.context_type = 'SIC' THEN 'SIC' ELSE 'JOB_GROUP' END AS scope
        FROM {sic} s JOIN {calendar_rule_assoc} a ON (a.context_type = 'SIC' AND a.context_id = s.id)
             OR (a.context_type = 'JOB_GROUP' AND a.context_id = s.job_group_id)""",
    "plan": f"""
        SELECT sic_id, job_id, job_group_id, business_date, CASE WHEN reason = 'allowed' THEN true ELSE false END AS should_run, reason FROM (
            SELECT sic_id, job_id, job_group_id, business_date,
                   CASE WHEN count(*) FILTER (rule_type = 'ALLOWS') = 0 THEN 'deny_only_no_explicit_allow'
                        WHEN count(*) FILTER (rule_type = 'ALLOWS' AND matched) = 0 THEN 'no_allow_matched'
                        WHEN count(*) FILTER (rule_type = 'DENIES' AND matched) > 0 THEN 'denied_by:' || min(r.rule_id) FILTER (rule_type = 'DENIES' AND matched)
                        ELSE 'allowed' END AS reason
            FROM {{ruled}} r JOIN {{rule_match}} m ON m.rule_id = r.rule_id
            WHERE business_date BETWEEN DATE '{FIRST}' AND DATE '{LAST}' GROUP BY ALL)""",
    "executed": f"""
        SELECT DISTINCT e.sic_id, g.business_date FROM {{jge}} g JOIN {{jce}} e ON e.jge_id = g.id
        WHERE g.business_date BETWEEN DATE '{FIRST}' AND DATE '{LAST}'""",
    "anomaly": """
        SELECT coalesce(p.sic_id, x.sic_id) AS sic_id, coalesce(p.business_date, x.business_date) AS business_date,
               CASE WHEN p.sic_id IS NULL THEN 'wrongly_executed' ELSE 'missed' END AS anomaly_type
        FROM (SELECT * FROM {plan} WHERE should_run) p FULL JOIN {executed} x ON p.sic_id = x.sic_id AND p.business_date = x.business_date
        WHERE p.sic_id IS NULL OR x.sic_id IS NULL""",
})


def days(t):
    return c.calendar_days(c.days_between(c.years_of(t.jce)))


def matches(t, first=FIRST, last=LAST):
    return c.evaluate_rules(t.business_calendar, days(t), t.holiday, first, last, REGION)


def plan(t):
    return c.eligible(t.sic, t.calendar_rule_assoc, matches(t), FIRST, LAST)


def executed(t):
    return c.executed_contexts(t.jge, t.jce, FIRST, LAST)


@query("i13_calendar_days", """
    SELECT d, y AS year, q AS quarter, m AS month, dom AS day_of_month, dow AS day_of_week, doy AS day_of_year, wk AS week_of_year, wy AS week_year,
           date_diff('day', date_trunc('week', date_trunc('month', d)), date_trunc('week', d)) // 7 + 1 AS week_of_month, occ AS dow_occurrence,
           CASE WHEN wd THEN 'WEEKDAY' ELSE 'WEEKEND' END AS day_type,
           dom = 1 AS is_first_of_month, d = last_day(d) AS is_last_of_month, dom = 1 AND m % 3 = 1 AS is_first_of_quarter, d = last_day(d) AND m % 3 = 0 AS is_last_of_quarter,
           doy = 1 AS is_first_of_year, m = 12 AND dom = 31 AS is_last_of_year,
           date_trunc('week', date_trunc('month', d)) = date_trunc('week', d) AS is_first_week_of_month,
           date_trunc('week', last_day(d)) = date_trunc('week', d) AS is_last_week_of_month,
           bms AS biz_from_month_start, bme AS biz_from_month_end, bqs AS biz_from_quarter_start, bqe AS biz_from_quarter_end,
           bys AS biz_from_year_start, bye AS biz_from_year_end, wy || '-W' || lpad(cast(wk AS varchar), 2, '0') AS week_id
    FROM {cal}""")
def i13_days(t):
    return days(t)


@query("i13_calendar_weeks", """
    WITH pm AS (SELECT wy, wk, y, m, count(*) AS n, min(d) AS sd FROM {cal} GROUP BY ALL),
    b AS (SELECT *, row_number() OVER (PARTITION BY wy, wk ORDER BY y DESC, n DESC, m) AS rn FROM pm)
    SELECT wy || '-W' || lpad(cast(wk AS varchar), 2, '0') AS week_id, wy AS year, wk AS week_of_year,
           date_diff('day', date_trunc('week', date_trunc('month', sd)), date_trunc('week', sd)) // 7 + 1 AS week_of_month,
           date_trunc('week', last_day(sd)) = date_trunc('week', sd) AS is_last_week_of_month,
           cast(date_trunc('week', sd) AS date) AS start_date, cast(date_trunc('week', sd) AS date) + 6 AS end_date, m AS month
    FROM b WHERE rn = 1""")
def i13_weeks(t):
    return c.calendar_weeks(days(t))


@query("i13_week_months", """
    SELECT DISTINCT wy || '-W' || lpad(cast(wk AS varchar), 2, '0') AS week_id, y || '-' || lpad(cast(m AS varchar), 2, '0') AS month_id,
           date_diff('day', date_trunc('week', date_trunc('month', d)), date_trunc('week', d)) // 7 + 1 AS week_of_month FROM {cal}""")
def i13_bridge(t):
    return c.week_months(days(t))


@query("i13_calendar_periods", """
    SELECT 'MONTH' AS level, y || '-' || lpad(cast(m AS varchar), 2, '0') AS period_id, min(d) AS start_date, max(d) AS end_date, count(*) AS total_days FROM {cal} GROUP BY y, m
    UNION ALL SELECT 'QUARTER', y || '-Q' || q, min(d), max(d), count(*) FROM {cal} GROUP BY y, q
    UNION ALL SELECT 'YEAR', cast(y AS varchar), min(d), max(d), count(*) FROM {cal} GROUP BY y""")
def i13_periods(t):
    return c.calendar_periods(days(t))


EVALUATOR_QUERIES = {
    "e1_nth_dow_month": "nth_dow_month", "e2_nth_multi_dow_month": "nth_multi_dow_month", "e3_nth_dom": "nth_dom",
    "e4_nth_first_biz_month": "nth_first_biz_month", "e5_nth_last_biz_month": "nth_last_biz_month",
    "e6_nth_first_biz_quarter": "nth_first_biz_quarter", "e7_nth_last_biz_quarter": "nth_last_biz_quarter",
    "e8_first_biz_year": "first_biz_year", "e9_last_biz_year": "last_biz_year", "e10_holiday": "holiday",
    "e11_graph_property": "graph_property", "e12_named_holiday": "named_holiday", "e13_specific_date": "specific_date",
}


def _evaluator_query(name, fn):
    @query(name, f"""
        SELECT m.rule_id, m.business_date, m.matched, count(e.id) AS runs
        FROM {{rule_match}} m LEFT JOIN {{jce}} e ON e.business_date = m.business_date
        WHERE evaluator_fn = '{fn}' AND m.business_date BETWEEN DATE '2024-01-01' AND DATE '2024-12-31' GROUP BY ALL""")
    def run(t):
        """The evaluator over a year of days, with the number of runs booked to each day."""
        rules = t.business_calendar.where(F.col("evaluator_fn") == fn)
        found = c.evaluate_rules(rules, days(t), t.holiday, "2024-01-01", "2024-12-31", REGION)
        runs = t.jce.groupBy("business_date").agg(F.count("*").alias("runs"))
        return found.join(runs, "business_date", "left").select(
            "rule_id", "business_date", "matched", F.coalesce("runs", F.lit(0)).alias("runs")
        )


for _name, _fn in EVALUATOR_QUERIES.items():
    _evaluator_query(_name, _fn)


@query("e14_month_quarter_restriction", """
    SELECT r.rule_id, c.d, count(e.id) AS runs FROM {business_calendar} r, {cal} c LEFT JOIN {jce} e ON e.business_date = c.d
    WHERE c.y = 2024 AND CASE WHEN r.rule_id = 'RULE_02' THEN c.m IN (1, 2, 3) WHEN r.rule_id = 'RULE_05' THEN c.q = 1 ELSE true END GROUP BY ALL""")
def e14(t):
    rules = t.business_calendar.select(
        "rule_id", F.from_json("params", c.PARAMS).alias("p"),
        F.explode(F.sequence(F.lit("2024-01-01").cast("date"), F.lit("2024-12-31").cast("date"))).alias("d"),
    )
    ok = rules.where(c.allowed_by(F.col("p.months"), F.month("d")) & c.allowed_by(F.col("p.quarters"), F.quarter("d")))
    runs = t.jce.groupBy(F.col("business_date").alias("d")).agg(F.count("*").alias("runs"))
    return ok.join(runs, "d", "left").select("rule_id", "d", F.coalesce("runs", F.lit(0)).alias("runs"))


@query("e15_evaluate_rule", "SELECT * FROM {rule_match} WHERE business_date IN (SELECT business_date FROM {jge}) AND year(business_date) = 2024")
def e15(t):
    ran = t.jge.select("business_date").distinct()
    return matches(t, "2024-01-01", "2024-12-31").join(ran, "business_date", "left_semi")


@query("e16_rule_map", "SELECT sic_id, job_group_id, rule_id, rule_type, scope FROM {ruled}")
def e16(t):
    return c.rule_map(t.sic, t.calendar_rule_assoc)


@query("e16_rule_map_of_group", "SELECT sic_id, job_group_id, rule_id, rule_type, scope FROM {ruled} WHERE job_group_id = 'JG_3'")
def e16_group(t):
    return c.rule_map(t.sic, t.calendar_rule_assoc, t.job_group, "NATION_3")


@query("e17_eligible", "SELECT * FROM {plan}")
def e17(t):
    return plan(t)


@query("e18_executed_contexts", "SELECT * FROM {executed}")
def e18(t):
    return executed(t)


@query("e19_calendar_anomalies", """
    SELECT *, CASE WHEN anomaly_type = 'missed' THEN 'calendar rules permitted execution but no run was found'
                   ELSE 'ran on a day not permitted by calendar rules' END AS reason FROM {anomaly}""")
def e19(t):
    return c.calendar_anomalies(plan(t), executed(t))


@query("e19_anomaly_summary", """
    SELECT business_date, count(p) AS planned_count, count(x) AS executed_count, count(*) FILTER (p IS NULL) AS wrongly_executed_count,
           count(*) FILTER (x IS NULL) AS missed_count, count(*) FILTER (p IS NULL OR x IS NULL) AS anomaly_count
    FROM (SELECT sic_id, business_date, 1 AS p FROM {plan} WHERE should_run) a FULL JOIN (SELECT *, 1 AS x FROM {executed}) b USING (sic_id, business_date)
    GROUP BY business_date""")
def e19_summary(t):
    return c.anomaly_summary(plan(t), executed(t))


@query("e20_cascading_impact", """
    WITH RECURSIVE r AS (SELECT DISTINCT a.business_date, e.dst_id AS node, 1 AS d FROM {anomaly} a JOIN {sic_precedes} e ON e.src_id = a.sic_id
        UNION SELECT r.business_date, e.dst_id, r.d + 1 FROM r JOIN {sic_precedes} e ON e.src_id = r.node WHERE r.d < 50)
    SELECT r.business_date, r.node AS sic_id, j.name AS job_name, min(r.d) AS min_distance
    FROM r JOIN {sic} s ON s.id = r.node LEFT JOIN {job} j ON j.id = s.job_id GROUP BY ALL""")
def e20(t):
    roots = c.calendar_anomalies(plan(t), executed(t)).select("business_date", F.col("sic_id").alias("node"))
    hit = tr.reachable(t.sic_precedes, roots, ["business_date"], min_hops=1)
    names = t.sic.join(t.job.select(F.col("id").alias("job_id"), F.col("name").alias("job_name")), "job_id", "left")
    return hit.join(names.select(F.col("id").alias("node"), "job_name"), "node").select(
        "business_date", F.col("node").alias("sic_id"), "job_name", F.col("distance").alias("min_distance")
    )
