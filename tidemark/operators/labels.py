"""Labels and their leakage-safe features: every feature reads events strictly before its instant."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import cyclic, median_of, saturate
from tidemark.operators.sessions import person_order
from tidemark import schemas as S
from tidemark.schemas import DAY, HOUR


def return_labels(sessioned: DataFrame, *, horizon_hours: float) -> DataFrame:
    """Per session and category: does the category recur within the horizon after the session's end?

    Sessions do not overlap, so the next event of the category is the first of the next session that holds it.
    """
    ends = Window.partitionBy("person_id", "session_no")
    per = (
        sessioned.withColumn("window_end", F.max("us").over(ends)).withColumn("n_session", F.count("*").over(ends))
        .groupBy("person_id", "session_no", "category")
        .agg(F.first("window_end").alias("window_end"), F.min("us").alias("first_us"), F.count("*").alias("n_in_session"), F.first("n_session").alias("n_session"))
    )
    following = F.lead("first_us").over(Window.partitionBy("person_id", "category").orderBy("session_no"))
    horizon = int(horizon_hours * HOUR)
    return per.withColumn("next_us", following).withColumn(
        "outcome", F.coalesce(F.col("next_us") <= F.col("window_end") + horizon, F.lit(False))
    ).withColumn("n_categories", F.count("*").over(ends))


def return_features(sessioned: DataFrame, *, horizon_hours: float, feature_set: str = "fs_3") -> DataFrame:
    """return_labels with the columns of a feature set, fs_3 or fs_2. Label instants join the event stream as probes; range frames end 1 µs before."""
    names = S.feature_names(feature_set)
    if feature_set not in ("fs_2", "fs_3"):
        raise ValueError(f"{feature_set} has no columns of return labels")
    horizon = int(horizon_hours * HOUR)
    labels = return_labels(sessioned, horizon_hours=horizon_hours)
    probes = labels.select("person_id", "category", F.col("window_end").alias("us"), F.col("session_no"), F.lit(0).alias("is_event"))
    stream = sessioned.select("person_id", "category", "us", "session_no", F.lit(1).alias("is_event")).unionByName(probes)
    event = lambda c: F.when(F.col("is_event") == 1, c)
    own, every = Window.partitionBy("person_id", "category").orderBy("us"), Window.partitionBy("person_id").orderBy("us")
    week, month = own.rangeBetween(-7 * DAY, -1), own.rangeBetween(-30 * DAY, -1)
    past = own.rangeBetween(Window.unboundedPreceding, -1)
    framed = stream.select(
        "person_id", "category", "session_no", "is_event", F.col("us").alias("window_end"),
        F.max(event(F.col("us"))).over(past).alias("last"), F.min(event(F.col("us"))).over(past).alias("first"),
        F.sum("is_event").over(week).alias("n7"), F.sum("is_event").over(month).alias("n30"),
        F.size(F.collect_set(event(F.floor(F.col("us") / DAY))).over(week)).alias("days7"),
        F.size(F.collect_set(event(F.col("session_no"))).over(week)).alias("sessions7"),
        F.sum("is_event").over(every.rangeBetween(-30 * DAY, -1)).alias("all30"),
    ).where("is_event = 0")
    resolved = Window.partitionBy("person_id", "category").orderBy("window_end").rangeBetween(Window.unboundedPreceding, -horizon)
    # The last return may land at the very instant of the label; it is then not yet known (strictly before). Only the
    # label before, exactly a horizon old, can have it.
    last = Window.partitionBy("person_id", "category").orderBy("session_no")
    landing = F.lag(F.col("outcome")).over(last) & (F.lag("next_us").over(last) == F.col("window_end")) & (F.lag("window_end").over(last) == F.col("window_end") - horizon)
    prior = labels.withColumn("n_prior", F.count("*").over(resolved)).withColumn(
        "n_returned", F.coalesce(F.sum(F.col("outcome").cast("int")).over(resolved), F.lit(0)) - F.coalesce(landing.cast("int"), F.lit(0))
    )
    joined = prior.join(framed.drop("is_event"), ["person_id", "category", "session_no", "window_end"])
    at = F.timestamp_micros("window_end")
    first_hours = (F.col("window_end") - F.col("first")) / HOUR
    zero = F.lit(0.0)
    made = joined.select(
        "person_id", "category", "session_no", "window_end", "outcome", first_hours.alias("hoursSinceFirstSeen"),
        F.col("n_prior").cast("double").alias("priorSessionCount"),
        ((F.col("window_end") - F.col("last")) / HOUR).alias("hoursSinceLastSeen"),
        F.coalesce("n7", zero).cast("double").alias("eventCount7d"), F.coalesce("n30", zero).cast("double").alias("eventCount30d"),
        F.col("days7").cast("double").alias("daysSeen7d"), F.col("sessions7").cast("double").alias("sessionCount7d"),
        (F.coalesce("n30", zero) / F.nullif(F.col("all30"), F.lit(0))).alias("categoryShare30d"),
        (F.col("n_returned") / F.nullif(F.col("n_prior"), F.lit(0))).alias("priorReturnRate"),
        F.col("n_session").cast("double").alias("sessionEventCount"), F.col("n_categories").cast("double").alias("sessionCategoryCount"),
        F.col("n_in_session").cast("double").alias("categoryEventsInSession"), F.hour(at).cast("double").alias("hourOfDay"), F.weekday(at).cast("double").alias("dayOfWeek"),
    )
    full = made.withColumn("firstSeenSaturation", _first_seen_saturation()).withColumn("priorSessionRate", _prior_session_rate())
    return full.select("person_id", "category", "session_no", "window_end", "outcome", *names)


def _first_seen_saturation():
    return saturate(F.col("hoursSinceFirstSeen"), S.FIRST_SEEN_HOURS)


def _prior_session_rate():
    days = F.greatest(F.coalesce(F.col("hoursSinceFirstSeen") / 24, F.lit(0.0)), F.lit(1.0))
    return saturate(F.col("priorSessionCount") / days, S.PRIOR_SESSION_RATE)


def migrate_features(rows: DataFrame) -> DataFrame:
    """Rows of fs_2 as rows of fs_3: two columns that grow without bound give way to their saturated forms, in their places.

    Rows without ``priorSessionCount`` were written by no version of the features and are left out; count them by
    :func:`migration_counts`. Other columns stay.
    """
    made = rows.where("priorSessionCount is not null").withColumn("firstSeenSaturation", _first_seen_saturation())
    swapped = {"hoursSinceFirstSeen": "firstSeenSaturation", "priorSessionCount": "priorSessionRate"}
    return made.withColumn("priorSessionRate", _prior_session_rate()).select(*(swapped.get(c, c) for c in rows.columns))


def migration_counts(rows: DataFrame) -> DataFrame:
    """One row: (found, migrated, skipped) of :func:`migrate_features`."""
    known = F.count("priorSessionCount")
    return rows.agg(F.count("*").alias("found"), known.alias("migrated"), (F.count("*") - known).alias("skipped"))


def engaged_labels(sessioned: DataFrame, *, trailing: int = 20, min_prior: int = 10) -> DataFrame:
    """visit_engaged with the columns of as_2n: is the dwell above the median of the category's trailing dwelled visits?"""
    w = person_order()
    n = F.row_number().over(w)
    day = F.floor(F.col("us") / DAY)
    by_domain = Window.partitionBy("person_id", "domain")
    visits = sessioned.withColumn("n", n).withColumn("day", day)
    visits = visits.select(
        "*", (F.row_number().over(Window.partitionBy("person_id", "session_no").orderBy("us", "event_id")) - 1).alias("position"),
        F.lag("category").over(w).alias("prev_category"), F.lag("domain").over(w).alias("prev_domain"), F.lag("dwell_seconds").over(w).alias("prev_dwell"),
        (F.row_number().over(by_domain.orderBy("n")) - 1).alias("domain_visits"), F.count("*").over(by_domain.orderBy("n").rangeBetween(-100, -1)).alias("domain_recent"),
        (F.row_number().over(Window.partitionBy("person_id", "domain", "day").orderBy("n")) == 1).cast("int").alias("first_today"),
    )
    days = F.sum("first_today").over(by_domain.orderBy("day").rangeBetween(-6, -1))
    visits = visits.withColumn("days_recent", F.coalesce(days, F.lit(0)) + 1 - F.col("first_today"))
    dwelled = visits.where("dwell_seconds is not null")
    tail = lambda *key: Window.partitionBy("person_id", *key).orderBy("n").rowsBetween(-trailing, -1)
    framed = dwelled.withColumn("window", F.collect_list("dwell_seconds").over(tail("category"))).withColumn("domain_window", F.collect_list("dwell_seconds").over(tail("domain")))
    labelled = framed.where(F.size("window") >= min_prior).withColumn("threshold", median_of(F.col("window")))
    at, over = F.timestamp_micros("us"), F.col("threshold") + 1.0
    sin, cos = cyclic(F.hour(at), 24.0)
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    return labelled.select(
        "person_id", "event_id", "category", "session_no", F.col("us").alias("window_end"), (F.col("dwell_seconds") > F.col("threshold")).alias("outcome"),
        saturate(F.col("threshold"), S.DWELL_SECONDS).alias("dwellLevel"), (F.element_at("window", -1) / over).alias("lastDwellRatio"),
        (F.aggregate("window", F.lit(0.0), lambda a, x: a + x) / F.size("window") / over).alias("meanRatio"), saturate(F.col("position").cast("double"), S.POSITION).alias("sessionPosition"),
        flag(F.col("position") == 0).alias("isSessionStart"), flag(F.col("prev_category") == F.col("category")).alias("sameAsPrevious"), sin.alias("hourSin"), cos.alias("hourCos"),
        flag(F.weekday(at) >= 5).alias("isWeekend"), saturate(F.col("domain_visits").cast("double"), S.DOMAIN_VISITS).alias("domainVisits"),
        (F.col("domain_recent") / F.least(F.col("n") - 1, F.lit(100))).alias("domainShare"), flag(F.col("days_recent") >= 4).alias("isDailyDomain"),
        saturate(median_of(F.col("domain_window")), S.DWELL_SECONDS).alias("domainDwellLevel"), flag(F.col("prev_domain") == F.col("domain")).alias("prevSameDomain"),
        (F.col("prev_dwell") / over).alias("prevDwellRatio"),
    )


def presence_labels(events: DataFrame) -> DataFrame:
    """browsing_next_hour with the columns of pr_1, for every hour strictly between a person's first and last active hour."""
    hourly = events.groupBy("person_id", F.floor(F.col("us") / HOUR).alias("hour")).agg(F.count("*").alias("n"), F.max("us").alias("last_us"))
    spans = hourly.groupBy("person_id").agg(F.min("hour").alias("lo"), F.max("hour").alias("hi"))
    spine = spans.select("person_id", "lo", "hi", F.explode(F.sequence("lo", "hi")).alias("hour"))
    grid = spine.join(hourly, ["person_id", "hour"], "left").withColumn("active", F.col("n").isNotNull().cast("int"))
    w = Window.partitionBy("person_id").orderBy("hour")
    back = lambda k: w.rowsBetween(-k, -1)
    same = [F.lag("active", 24 * k).over(w) for k in range(1, 8)]
    held = sum((x.isNotNull().cast("int") for x in same[1:]), same[0].isNotNull().cast("int"))
    rate = sum((F.coalesce(x, F.lit(0)) for x in same[1:]), F.coalesce(same[0], F.lit(0))) / F.nullif(held, F.lit(0))
    hour_of_day = F.pmod("hour", F.lit(24))
    weekday = F.pmod(F.floor(F.col("hour") / 24) + 3, F.lit(7))  # day 0 was a Thursday
    sin, cos = cyclic(hour_of_day, 24.0)
    zero = F.lit(0)
    framed = grid.select(
        "person_id", "hour", "lo", "hi", (F.col("active") == 1).alias("outcome"), sin.alias("hourSin"), cos.alias("hourCos"), (weekday >= 5).cast("double").alias("isWeekend"),
        saturate((F.col("hour") * HOUR - F.last("last_us", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))) / 60e6, S.LAST_VISIT_MINUTES).alias("minutesSinceLast"),
        saturate(F.coalesce(F.lag("n").over(w), zero).cast("double"), S.VISITS_LAST_HOUR).alias("visitsLastHour"),
        saturate(F.coalesce(F.sum("n").over(back(6)), zero).cast("double"), S.VISITS_LAST_SIX_HOURS).alias("visitsLastSixHours"),
        rate.alias("sameHourRate7d"), F.avg("active").over(back(168)).alias("activeHourShare7d"),
    )
    return framed.where("hour > lo and hour < hi").drop("lo", "hi")


def day_grid(events: DataFrame) -> DataFrame:
    """(person_id, day, rn, category, n): every complete UTC day (the first and last are cut) and category; absent is 0."""
    counts = events.groupBy("person_id", F.floor(F.col("us") / DAY).alias("day"), "category").agg(F.count("*").alias("n"))
    spans = counts.groupBy("person_id").agg(F.min("day").alias("lo"), F.max("day").alias("hi"), F.collect_set("category").alias("categories"))
    spine = spans.where("hi - lo >= 2").select("person_id", "lo", F.explode(F.sequence(F.col("lo") + 1, F.col("hi") - 1)).alias("day"), "categories")
    cells = spine.select("person_id", "day", (F.col("day") - F.col("lo")).alias("rn"), F.explode("categories").alias("category"))
    return cells.join(counts, ["person_id", "day", "category"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def block_labels(grid: DataFrame, *, trailing: int = 10, min_prior: int = 6) -> DataFrame:
    """block_volume with the columns of bs_1: is the day's count above the median of the trailing days?

    A category's history starts on the first complete day that holds it; ``above`` is known from its second day.
    """
    w = Window.partitionBy("person_id", "category").orderBy("rn")
    totals = Window.partitionBy("person_id", "rn")
    seen = grid.withColumn("total", F.sum("n").over(totals)).withColumn("begun", F.sum("n").over(w) > 0).where("begun")
    tail = w.rowsBetween(-trailing, -1)
    framed = seen.select(
        "person_id", "category", "day", "rn", "n", F.collect_list("n").over(tail).alias("window"), F.row_number().over(w).alias("k"), F.lag("n").over(w).alias("previous"), F.lag("total").over(w).alias("previous_total"),
        F.collect_list("total").over(tail).alias("total_window"),
    ).withColumn("threshold", median_of(F.col("window")))
    above = framed.withColumn("above", (F.col("n") > F.col("threshold")).cast("int"))
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    stated = above.withColumn("last_not", F.max(F.when(F.coalesce("above", F.lit(0)) == 0, F.col("k"))).over(past)).withColumn("last_above", F.max(F.when(F.col("above") == 1, F.col("k"))).over(past)).withColumn("prev_above", F.lag("above").over(w))
    active = F.size(F.filter("window", lambda x: x > 0))
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    sin, cos = cyclic(F.pmod(F.col("day") + 3, F.lit(7)), 7.0)
    return stated.where((F.col("k") > min_prior) & (2 * active >= F.size("window"))).select(
        "person_id", "category", "day", (F.col("above") == 1).alias("outcome"), F.coalesce("prev_above", F.lit(0)).cast("double").alias("prevAbove"),
        (F.col("previous") / (F.col("threshold") + 1.0)).alias("lastRatio"), saturate((F.col("k") - 1 - F.coalesce("last_not", F.lit(0))).cast("double"), S.STREAK).alias("streakAbove"),
        saturate((F.col("k") - 1 - F.col("last_above")).cast("double"), S.STREAK).alias("daysSinceAbove"), saturate(F.col("threshold").cast("double"), S.MEDIAN_LEVEL).alias("medianLevel"),
        (active / F.size("window")).alias("activeRate10"), F.coalesce(total("window") / F.nullif(total("total_window"), F.lit(0)), F.lit(0.0)).alias("topicShare10"),
        (F.col("previous_total") / (F.coalesce(median_of(F.col("total_window")), F.lit(0.0)) + 1.0)).alias("totalRatio"), sin.alias("dayOfWeekSin"), cos.alias("dayOfWeekCos"),
    )


def novelty(events: DataFrame, *, lookback_days: int = 30) -> DataFrame:
    """(person_id, day, n_domains, n_new): domains of a day that the person had not visited in the days before its first visit.

    A day whose look-back holds no visit has nothing to be new against and is left out.
    """
    visits = events.where("domain is not null").withColumn("day", F.floor(F.col("us") / DAY))
    days = visits.groupBy("person_id", "day").agg(F.min("us").alias("first_at"), F.max("us").alias("last_at"))
    start = F.col("first_at") - lookback_days * DAY
    judged = days.withColumn("before", F.lag("last_at").over(Window.partitionBy("person_id").orderBy("day"))).where(F.col("before") >= start)
    seen = visits.groupBy("person_id", "domain", "day").agg(F.max("us").alias("last_seen"))
    seen = seen.withColumn("seen_before", F.lag("last_seen").over(Window.partitionBy("person_id", "domain").orderBy("day")))
    fresh = F.col("seen_before").isNull() | (F.col("seen_before") < start)
    return seen.join(judged, ["person_id", "day"]).groupBy("person_id", "day").agg(F.count("*").alias("n_domains"), F.count_if(fresh).alias("n_new"))


def dormancy(grid: DataFrame, *, absent: int = 2) -> DataFrame:
    """(person_id, n_dormant, n_returned): days on which a category already seen had been absent, and those that bring it back."""
    w = Window.partitionBy("person_id", "category").orderBy("rn")
    framed = grid.withColumn("quiet", F.sum("n").over(w.rowsBetween(-absent, -1))).withColumn("ever", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    return framed.where((F.col("quiet") == 0) & (F.col("ever") > 0)).groupBy("person_id").agg(F.count("*").alias("n_dormant"), F.count_if(F.col("n") > 0).alias("n_returned"))
