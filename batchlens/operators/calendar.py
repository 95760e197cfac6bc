"""Calendar dimension and calendar-rule evaluation as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from batchlens.session import LoopState

PARAMS = (
    "date STRING, region STRING, dayOfWeek INT, daysOfWeek ARRAY<INT>, weekOccurrences ARRAY<INT>, months ARRAY<INT>, "
    "quarters ARRAY<INT>, bizDayFromStart ARRAY<INT>, bizDayFromEnd ARRAY<INT>, daysOfMonth ARRAY<INT>, "
    "nodeName STRING, propertyName STRING, holidayDates ARRAY<STRING>, targetDates ARRAY<STRING>"
)


# ---- dimension ---------------------------------------------------------------

def days_between(first_last: DataFrame) -> DataFrame:
    """One row per day of a one-row (first_day, last_day) frame."""
    return first_last.select(F.explode(F.sequence("first_day", "last_day")).alias("d"))


def years_of(runs: DataFrame) -> DataFrame:
    """Full years around the business dates in the data, one year of margin each side."""
    return runs.agg(
        F.make_date(F.year(F.min("business_date")) - 1, F.lit(1), F.lit(1)).alias("first_day"),
        F.make_date(F.year(F.max("business_date")) + 1, F.lit(12), F.lit(31)).alias("last_day"),
    )


def _monday(d: Column) -> Column:
    return F.date_sub(d, F.weekday(d))


def calendar_days(days: DataFrame) -> DataFrame:
    """Day dimension with positions, flags and business-day ordinals (Mon-Fri).

    The input must hold whole years, so that ordinals from either end are right.
    """
    d = F.col("d")
    month_start, month_end = F.trunc(d, "month").cast("date"), F.last_day(d)
    quarter_start = F.trunc(d, "quarter").cast("date")
    quarter_end = F.last_day(F.add_months(quarter_start, 2))
    first_week = _monday(month_start)
    base = days.select(
        d,
        F.year(d).alias("year"), F.quarter(d).alias("quarter"), F.month(d).alias("month"), F.day(d).alias("day_of_month"),
        (F.weekday(d) + 1).alias("day_of_week"), F.dayofyear(d).alias("day_of_year"),
        F.weekofyear(d).alias("week_of_year"), F.extract(F.lit("YEAROFWEEK"), d).cast("int").alias("week_year"),
        (F.floor(F.datediff(_monday(d), first_week) / 7) + 1).cast("int").alias("week_of_month"),
        F.expr("(day(d) - 1) div 7 + 1").cast("int").alias("dow_occurrence"),
        F.when(F.weekday(d) >= 5, "WEEKEND").otherwise("WEEKDAY").alias("day_type"),
        (d == month_start).alias("is_first_of_month"), (d == month_end).alias("is_last_of_month"),
        (d == quarter_start).alias("is_first_of_quarter"), (d == quarter_end).alias("is_last_of_quarter"),
        (F.dayofyear(d) == 1).alias("is_first_of_year"), ((F.month(d) == 12) & (F.day(d) == 31)).alias("is_last_of_year"),
        month_start.between(_monday(d), F.date_add(_monday(d), 6)).alias("is_first_week_of_month"),
        month_end.between(_monday(d), F.date_add(_monday(d), 6)).alias("is_last_week_of_month"),
    )
    working = F.when(F.col("day_type") == "WEEKDAY", 1).otherwise(0)

    def ordinal(scope: list[str], order: Column) -> Column:
        return F.when(
            F.col("day_type") == "WEEKDAY", F.sum(working).over(Window.partitionBy(*scope).orderBy(order)).cast("int")
        )

    out = base
    for name, scope in (("month", ["year", "month"]), ("quarter", ["year", "quarter"]), ("year", ["year"])):
        out = out.withColumn(f"biz_from_{name}_start", ordinal(scope, F.asc("d")))
        out = out.withColumn(f"biz_from_{name}_end", ordinal(scope, F.desc("d")))
    return out.withColumn("week_id", F.format_string("%d-W%02d", "week_year", "week_of_year"))


def calendar_weeks(days: DataFrame) -> DataFrame:
    """ISO weeks with their primary month: most days, then the earlier month.

    A week on a year boundary takes its month from its days in the later year.
    """
    per_month = days.groupBy("week_id", "week_year", "week_of_year", "year", "month").agg(
        F.count("*").alias("n"), F.min("week_of_month").alias("wom"), F.min("d").alias("some_day"),
        F.max("is_last_week_of_month").alias("is_last"),
    )
    best = F.max_by(
        F.struct("month", "wom", "is_last", "some_day"), F.struct(F.col("year"), F.col("n"), -F.col("month"))
    ).alias("b")
    return per_month.groupBy("week_id", "week_year", "week_of_year").agg(best).select(
        "week_id", F.col("week_year").alias("year"), "week_of_year",
        F.col("b.wom").alias("week_of_month"), F.col("b.is_last").alias("is_last_week_of_month"),
        _monday(F.col("b.some_day")).alias("start_date"), F.date_add(_monday(F.col("b.some_day")), 6).alias("end_date"),
        F.col("b.month").alias("month"),
    )


def week_months(days: DataFrame) -> DataFrame:
    """Bridge between weeks and every month they touch."""
    return days.select("week_id", F.format_string("%d-%02d", "year", "month").alias("month_id"), "week_of_month").distinct()


def calendar_periods(days: DataFrame) -> DataFrame:
    """Months, quarters and years with first and last day and length."""
    def level(name: str, ident: Column, keys: list[str]) -> DataFrame:
        return days.groupBy(*keys).agg(F.min("d").alias("start_date"), F.max("d").alias("end_date"), F.count("*").alias("total_days")).select(
            F.lit(name).alias("level"), ident.alias("period_id"), "start_date", "end_date", "total_days"
        )

    return (
        level("MONTH", F.format_string("%d-%02d", "year", "month"), ["year", "month"])
        .unionByName(level("QUARTER", F.format_string("%d-Q%d", "year", "quarter"), ["year", "quarter"]))
        .unionByName(level("YEAR", F.col("year").cast("string"), ["year"]))
    )


# ---- evaluators ----------------------------------------------------------------

def allowed_by(restriction: Column, value: Column) -> Column:
    """Optional month/quarter restriction: missing or empty means every one."""
    return (F.size(F.coalesce(restriction, F.array().cast("array<int>"))) == 0) | F.array_contains(restriction, value)


def _has(listed: Column, value: Column) -> Column:
    return F.array_contains(listed, value)


def _flag_map() -> Column:
    pairs = {
        "Day.isFirstOfMonth": F.col("is_first_of_month"), "Day.isLastOfMonth": F.col("is_last_of_month"),
        "Day.isFirstOfQuarter": F.col("is_first_of_quarter"), "Day.isLastOfQuarter": F.col("is_last_of_quarter"),
        "Day.isFirstOfYear": F.col("is_first_of_year"), "Day.isLastOfYear": F.col("is_last_of_year"),
        "Day.isWeekday": F.col("day_type") == "WEEKDAY", "Day.isWeekend": F.col("day_type") == "WEEKEND",
        "Week.isFirstWeekOfMonth": F.col("is_first_week_of_month"), "Week.isLastWeekOfMonth": F.col("is_last_week_of_month"),
        "Week.isFirstWeekOfYear": F.col("week_of_year") == 1, "Week.isLastWeekOfYear": F.col("week_of_year") >= 52,
        "Month.isFirstOfQuarter": F.col("month") % 3 == 1, "Month.isLastOfQuarter": F.col("month") % 3 == 0,
        "Month.isFirstOfYear": F.col("month") == 1, "Month.isLastOfYear": F.col("month") == 12,
        "Quarter.isFirstOfYear": F.col("quarter") == 1, "Quarter.isLastOfYear": F.col("quarter") == 4,
    }
    flat = [x for k, v in pairs.items() for x in (F.lit(k), v)]
    return F.create_map(*flat)


# evaluator name -> condition over the day columns and the rule's params struct ``p``
EVALUATORS: dict[str, Callable[[], Column]] = {
    "nth_dow_month": lambda: allowed_by(F.col("p.months"), F.col("month"))
    & (F.col("day_of_week") == F.col("p.dayOfWeek")) & _has(F.col("p.weekOccurrences"), F.col("dow_occurrence")),
    "nth_multi_dow_month": lambda: allowed_by(F.col("p.months"), F.col("month"))
    & _has(F.col("p.daysOfWeek"), F.col("day_of_week")) & _has(F.col("p.weekOccurrences"), F.col("dow_occurrence")),
    "nth_dom": lambda: allowed_by(F.col("p.months"), F.col("month")) & _has(F.col("p.daysOfMonth"), F.col("day_of_month")),
    "nth_first_biz_month": lambda: allowed_by(F.col("p.months"), F.col("month"))
    & _has(F.col("p.bizDayFromStart"), F.col("biz_from_month_start")),
    "nth_last_biz_month": lambda: allowed_by(F.col("p.months"), F.col("month"))
    & _has(F.col("p.bizDayFromEnd"), F.col("biz_from_month_end")),
    "nth_first_biz_quarter": lambda: allowed_by(F.col("p.quarters"), F.col("quarter"))
    & _has(F.col("p.bizDayFromStart"), F.col("biz_from_quarter_start")),
    "nth_last_biz_quarter": lambda: allowed_by(F.col("p.quarters"), F.col("quarter"))
    & _has(F.col("p.bizDayFromEnd"), F.col("biz_from_quarter_end")),
    "first_biz_year": lambda: F.col("biz_from_year_start") == 1,
    "last_biz_year": lambda: F.col("biz_from_year_end") == 1,
    "holiday": lambda: F.col("holiday_hit"),
    "graph_property": lambda: F.try_element_at(_flag_map(), F.concat_ws(".", "p.nodeName", "p.propertyName")),
    "named_holiday": lambda: _has(F.col("p.holidayDates"), F.col("d").cast("string")),
    "specific_date": lambda: F.exists(F.col("p.targetDates"), lambda x: F.try_to_date(F.substring(x, 1, 10), "yyyy-MM-dd") == F.col("d")),
}


def register_evaluator(name: str, condition: Callable[[], Column]) -> None:
    """Add an evaluator: a condition over day columns and ``p`` (the rule's params)."""
    EVALUATORS[name] = condition


def evaluate_rules(rules: DataFrame, calendar: DataFrame, holidays: DataFrame, first: str, last: str, region: str) -> DataFrame:
    """Whether each rule matches each day of a date range.

    Rules expand over the range and meet the calendar by date.  A region or
    date inside the params wins over the caller's.  Missing arguments, unreadable
    params and unknown evaluators give no match.
    """
    asked = rules.select(
        "rule_id", "evaluator_fn", F.from_json("params", PARAMS).alias("p"),
        F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("business_date"),
    ).withColumn("d", F.coalesce(F.try_to_date(F.substring("p.date", 1, 10), "yyyy-MM-dd"), "business_date"))
    asked = asked.withColumn("rule_region", F.upper(F.trim(F.coalesce("p.region", F.lit(region)))))
    named = holidays.select(F.col("holiday_date").alias("d"), F.upper(F.trim("region")).alias("rule_region")).distinct()
    joined = (
        asked.join(calendar, "d", "left")
        .join(named.withColumn("regional", F.lit(True)), ["d", "rule_region"], "left")
        .join(named.where(F.col("rule_region") == "ALL").select("d", F.lit(True).alias("everywhere")), "d", "left")
        .withColumn("holiday_hit", F.coalesce("regional", F.lit(False)) | F.coalesce("everywhere", F.lit(False)))
    )
    verdict = F.lit(False)
    for name, condition in EVALUATORS.items():
        verdict = F.when(F.col("evaluator_fn") == name, condition()).otherwise(verdict)
    return joined.select("rule_id", "evaluator_fn", "business_date", F.coalesce(verdict, F.lit(False)).alias("matched"))


def rule_map(sics: DataFrame, assoc: DataFrame, job_group: DataFrame | None = None, group: str | None = None) -> DataFrame:
    """Rules that govern each context: its own and those of its group.

    ``group`` (id or name) limits the scope; contexts without rules do not appear.
    """
    scope = sics.select(F.col("id").alias("sic_id"), "job_group_id")
    if group is not None:
        ids = job_group.where((F.col("id") == group) | (F.col("name") == group)).select(F.col("id").alias("job_group_id"))
        scope = scope.join(ids, "job_group_id", "left_semi")
    inherited = assoc.where(F.col("context_type") == "JOB_GROUP").select(
        F.col("context_id").alias("job_group_id"), "rule_id", "rule_type"
    )
    own = assoc.where(F.col("context_type") == "SIC").select(F.col("context_id").alias("sic_id"), "rule_id", "rule_type")
    via_group = scope.join(inherited, "job_group_id").withColumn("scope", F.lit("JOB_GROUP"))
    direct = scope.join(own, "sic_id").withColumn("scope", F.lit("SIC"))
    return via_group.unionByName(direct).select("sic_id", "job_group_id", "rule_id", "rule_type", "scope")


def eligible(sics: DataFrame, assoc: DataFrame, matches: DataFrame, first: str, last: str) -> DataFrame:
    """Planned or not, with reason, for every ruled context and day of a range.

    Rules are reduced per owner and day before they fan out to the contexts of
    a group, so a very large group costs one row per context and day.
    """
    hits = matches.where("matched").join(assoc, "rule_id").groupBy("context_type", "context_id", "business_date").agg(
        F.bool_or(F.col("rule_type") == "ALLOWS").alias("allow_hit"),
        F.min(F.when(F.col("rule_type") == "DENIES", F.col("rule_id"))).alias("deny_rule"),
    )
    hits, _ = LoopState(matches.sparkSession, "hits").save(hits)  # read for groups and for contexts
    kinds = assoc.groupBy("context_type", "context_id").agg(F.bool_or(F.col("rule_type") == "ALLOWS").alias("has_allow"))

    def part(kind: str, key: str, suffix: str) -> tuple[DataFrame, DataFrame]:
        def pick(df: DataFrame, cols: list[str]) -> DataFrame:
            return df.where(F.col("context_type") == kind).select(
                F.col("context_id").alias(key), *([] if df is kinds else ["business_date"]),
                *(F.col(c).alias(f"{c}_{suffix}") for c in cols),
            )
        return pick(kinds, ["has_allow"]), pick(hits, ["allow_hit", "deny_rule"])

    g_kind, g_hit = part("JOB_GROUP", "job_group_id", "g")
    s_kind, s_hit = part("SIC", "sic_id", "s")
    ruled = (
        sics.select(F.col("id").alias("sic_id"), "job_id", "job_group_id")
        .join(g_kind, "job_group_id", "left").join(s_kind, "sic_id", "left")
        .where(F.col("has_allow_g").isNotNull() | F.col("has_allow_s").isNotNull())
        .withColumn("business_date", F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))))
    )
    j = ruled.join(g_hit, ["job_group_id", "business_date"], "left").join(s_hit, ["sic_id", "business_date"], "left")

    def either(c: str) -> Column:
        return F.coalesce(f"{c}_g", F.lit(False)) | F.coalesce(f"{c}_s", F.lit(False))

    denied = F.least("deny_rule_g", "deny_rule_s")
    reason = (
        F.when(~either("has_allow"), "deny_only_no_explicit_allow")
        .when(~either("allow_hit"), "no_allow_matched")
        .when(denied.isNotNull(), F.concat(F.lit("denied_by:"), denied))
        .otherwise("allowed")
    )
    out = j.select("sic_id", "job_id", "job_group_id", "business_date", reason.alias("reason"))
    return out.withColumn("should_run", F.col("reason") == "allowed")


def executed_contexts(jge: DataFrame, runs: DataFrame, first: str, last: str) -> DataFrame:
    """Contexts that ran, by the business date of their group run."""
    window = jge.where(F.col("business_date").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    return window.select(F.col("id").alias("jge_id"), "business_date").join(
        runs.select("jge_id", "sic_id"), "jge_id"
    ).select("sic_id", "business_date").distinct()


def calendar_anomalies(plan: DataFrame, executed: DataFrame) -> DataFrame:
    """Contexts that ran unplanned, and planned ones that did not run, per date."""
    planned = plan.where("should_run").select("sic_id", "business_date", F.lit(True).alias("planned"))
    ran = executed.select("sic_id", "business_date", F.lit(True).alias("ran"))
    both = planned.join(ran, ["sic_id", "business_date"], "full_outer")
    return both.where(F.col("planned").isNull() | F.col("ran").isNull()).select(
        "sic_id", "business_date",
        F.when(F.col("planned").isNull(), "wrongly_executed").otherwise("missed").alias("anomaly_type"),
        F.when(F.col("planned").isNull(), "ran on a day not permitted by calendar rules")
        .otherwise("calendar rules permitted execution but no run was found").alias("reason"),
    )


def anomaly_summary(plan: DataFrame, executed: DataFrame) -> DataFrame:
    """Planned, executed and anomaly counts per date."""
    planned = plan.where("should_run").select("sic_id", "business_date", F.lit(1).alias("planned"))
    both = planned.join(executed.select("sic_id", "business_date", F.lit(1).alias("ran")), ["sic_id", "business_date"], "full_outer")
    p, r = F.col("planned").isNotNull(), F.col("ran").isNotNull()
    return both.groupBy("business_date").agg(
        F.count_if(p).alias("planned_count"), F.count_if(r).alias("executed_count"),
        F.count_if(r & ~p).alias("wrongly_executed_count"), F.count_if(p & ~r).alias("missed_count"),
        F.count_if(p != r).alias("anomaly_count"),
    )
