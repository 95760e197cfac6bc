"""Every evaluator on every day of a leap and a common year against plain Python."""

import datetime as dt
import json

from pyspark.sql import functions as F

from batchlens.operators import calendar as cal


def biz(days, d, reverse=False):
    picked = [x for x in days if x.isoweekday() <= 5 and (x >= d if reverse else x <= d)]
    return len(picked)


def plain(fn, p, d, holidays, region):
    month = [x for x in year(d.year) if x.month == d.month]
    quarter = [x for x in year(d.year) if (x.month - 1) // 3 == (d.month - 1) // 3]
    in_month = not p.get("months") or d.month in p["months"]
    in_quarter = not p.get("quarters") or (d.month - 1) // 3 + 1 in p["quarters"]
    work, occ = d.isoweekday() <= 5, (d.day - 1) // 7 + 1
    if fn == "nth_dow_month":
        return in_month and d.isoweekday() == p["dayOfWeek"] and occ in p["weekOccurrences"]
    if fn == "nth_multi_dow_month":
        return in_month and d.isoweekday() in p["daysOfWeek"] and occ in p["weekOccurrences"]
    if fn == "nth_dom":
        return in_month and d.day in p["daysOfMonth"]
    if fn == "nth_first_biz_month":
        return in_month and work and biz(month, d) in p["bizDayFromStart"]
    if fn == "nth_last_biz_month":
        return in_month and work and biz(month, d, True) in p["bizDayFromEnd"]
    if fn == "nth_first_biz_quarter":
        return in_quarter and work and biz(quarter, d) in p["bizDayFromStart"]
    if fn == "nth_last_biz_quarter":
        return in_quarter and work and biz(quarter, d, True) in p["bizDayFromEnd"]
    if fn == "first_biz_year":
        return work and biz(year(d.year), d) == 1
    if fn == "last_biz_year":
        return work and biz(year(d.year), d, True) == 1
    if fn == "holiday":
        r = p.get("region", region).strip().upper()
        return any(h == d and reg.strip().upper() in ((r, "ALL") if r != "ALL" else ("ALL",)) for h, reg in holidays)
    if fn == "graph_property":
        monday = d - dt.timedelta(days=d.weekday())
        last = max(month)
        return {
            "Day.isLastOfQuarter": d.month % 3 == 0 and d == last, "Week.isFirstWeekOfMonth": monday <= month[0] <= monday + dt.timedelta(6),
            "Week.isLastWeekOfMonth": monday <= last <= monday + dt.timedelta(6), "Week.isLastWeekOfYear": d.isocalendar()[1] >= 52,
            "Week.isFirstWeekOfYear": d.isocalendar()[1] == 1, "Month.isLastOfQuarter": d.month % 3 == 0, "Quarter.isFirstOfYear": d.month <= 3,
        }.get(f"{p['nodeName']}.{p['propertyName']}", False)
    if fn == "named_holiday":
        return d.isoformat() in p["holidayDates"]
    if fn == "specific_date":
        return d.isoformat() in [x[:10] for x in p["targetDates"]]
    return False


def year(y):
    return [dt.date(y, 1, 1) + dt.timedelta(i) for i in range((dt.date(y + 1, 1, 1) - dt.date(y, 1, 1)).days)]


RULES = [
    ("nth_dow_month", {"dayOfWeek": 2, "weekOccurrences": [1, 5]}), ("nth_multi_dow_month", {"daysOfWeek": [1, 7], "weekOccurrences": [2, 3], "months": [2, 12]}),
    ("nth_dom", {"daysOfMonth": [1, 29, 31], "months": []}), ("nth_first_biz_month", {"bizDayFromStart": [1, 4, 20]}), ("nth_last_biz_month", {"bizDayFromEnd": [1, 2]}),
    ("nth_first_biz_quarter", {"bizDayFromStart": [1, 30], "quarters": [2, 4]}), ("nth_last_biz_quarter", {"bizDayFromEnd": [1, 60]}), ("first_biz_year", {}), ("last_biz_year", {}),
    ("holiday", {}), ("holiday", {"region": "all"}), ("holiday", {"region": "in"}), ("graph_property", {"nodeName": "Day", "propertyName": "isLastOfQuarter"}),
    *(("graph_property", {"nodeName": "Week", "propertyName": x}) for x in ("isFirstWeekOfMonth", "isLastWeekOfMonth", "isFirstWeekOfYear", "isLastWeekOfYear")),
    ("graph_property", {"nodeName": "Month", "propertyName": "isLastOfQuarter"}), ("graph_property", {"nodeName": "Quarter", "propertyName": "isFirstOfYear"}),
    ("graph_property", {"nodeName": "Year", "propertyName": "isLeap"}), ("named_holiday", {"holidayDates": ["2023-02-28", "2024-02-29", "x"]}),
    ("specific_date", {"targetDates": ["2024-03-01T10:00", "bad", "2023-12-31"]}), ("unheard_of", {}),
]


def test_evaluators_on_every_day(spark):
    holidays = [(dt.date(2023, 1, 2), "ALL"), (dt.date(2024, 7, 4), " us "), (dt.date(2024, 8, 15), "IN")]
    days = cal.calendar_days(cal.days_between(spark.sql("SELECT DATE '2023-01-01' AS first_day, DATE '2024-12-31' AS last_day")))
    rules = spark.createDataFrame([(f"r{i:02d}", fn, json.dumps(p)) for i, (fn, p) in enumerate(RULES)], "rule_id string, evaluator_fn string, params string")
    named = spark.createDataFrame(holidays, "holiday_date date, region string")
    got = {(r.rule_id, r.business_date): r.matched for r in cal.evaluate_rules(rules, days, named, "2023-01-01", "2024-12-31", "US").collect()}
    for i, (fn, p) in enumerate(RULES):
        for d in year(2023) + year(2024):
            assert got[(f"r{i:02d}", d)] == plain(fn, p, d, holidays, "US"), (fn, p, d)


def test_missing_arguments_bad_params_and_new_evaluators(spark):
    days = cal.calendar_days(cal.days_between(spark.sql("SELECT DATE '2024-01-01' AS first_day, DATE '2024-12-31' AS last_day")))
    none = spark.createDataFrame([], "holiday_date date, region string")
    cal.register_evaluator("even_day", lambda: F.col("day_of_month") % 2 == 0)
    rules = spark.createDataFrame(
        [("a", "nth_dom", None), ("b", "nth_dom", "nope"), ("c", "nth_dow_month", '{"dayOfWeek":1}'), ("d", "even_day", "{}"), ("e", "first_biz_year", '{"date":"2024-01-01"}')],
        "rule_id string, evaluator_fn string, params string")
    hits = cal.evaluate_rules(rules, days, none, "2024-01-01", "2024-01-31", "US").where("matched").groupBy("rule_id").count().collect()
    cal.EVALUATORS.pop("even_day")
    assert {r.rule_id: r["count"] for r in hits} == {"d": 15, "e": 31}
