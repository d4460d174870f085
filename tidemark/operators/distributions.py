"""Gaps, histograms, coverage, concentration, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.sessions import person_order
from tidemark.schemas import DAY, HOUR


def gap_percentiles(events: DataFrame, points: tuple[float, ...] = (0.1, 0.5, 0.9)) -> DataFrame:
    """(person_id, n_gaps, p..): exact interpolated percentiles of the seconds between neighbouring events."""
    gaps = events.withColumn("gap", (F.col("us") - F.lag("us").over(person_order())) / 1e6).where("gap is not null")
    return gaps.groupBy("person_id").agg(F.count("*").alias("n_gaps"), *(F.percentile("gap", p).alias(f"p{int(100 * p)}") for p in points))


def gap_histogram(events: DataFrame, *, per_decade: int = 4) -> DataFrame:
    """(person_id, bin, n): gaps above zero by the floor of their decimal logarithm in steps."""
    gaps = events.withColumn("gap", (F.col("us") - F.lag("us").over(person_order())) / 1e6).where("gap > 0")
    return gaps.groupBy("person_id", F.floor(F.log10("gap") * per_decade).alias("bin")).agg(F.count("*").alias("n"))


def visits_per_day(events: DataFrame) -> DataFrame:
    return events.groupBy("person_id", F.floor(F.col("us") / DAY).alias("day")).agg(F.count("*").alias("n"))


def ranked_domains(events: DataFrame) -> DataFrame:
    """Domains of each person by count (ties by name), with the running share of all visits."""
    n = events.where("domain is not null").groupBy("person_id", "domain").agg(F.count("*").alias("n"))
    w = Window.partitionBy("person_id").orderBy(F.desc("n"), "domain")
    return n.select("person_id", "domain", "n", F.row_number().over(w).alias("place"), (F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)) / F.sum("n").over(Window.partitionBy("person_id"))).alias("cumulative_share"))


def concentration(events: DataFrame, tops: tuple[int, ...] = (1, 3, 5, 10, 20)) -> DataFrame:
    ranked = ranked_domains(events)
    return ranked.groupBy("person_id").agg(*((F.sum(F.when(F.col("place") <= k, F.col("n")).otherwise(0)) / F.sum("n")).alias(f"top{k}") for k in tops), F.count_if(F.col("n") == 1).alias("seen_once"))


def session_spread(sessioned: DataFrame, least: tuple[int, ...] = (2, 3, 5)) -> DataFrame:
    """Per person: domains seen in at least so many sessions."""
    per = sessioned.groupBy("person_id", "domain").agg(F.countDistinct("session_no").alias("s"))
    return per.groupBy("person_id").agg(F.count("*").alias("n_domains"), *(F.count_if(F.col("s") >= k).alias(f"in{k}") for k in least))


def browsing_summary(sessioned: DataFrame) -> DataFrame:
    """Per person and category: events, share; and the person's totals."""
    per = sessioned.groupBy("person_id", "category").agg(F.count("*").alias("n"), F.min("us").alias("lo"), F.max("us").alias("hi"), F.max("session_no").alias("s"))
    w = Window.partitionBy("person_id")
    total = F.sum("n").over(w)
    return per.select(
        "person_id", "category", "n", (F.col("n") / total).alias("share"), total.alias("n_events"), F.max("s").over(w).alias("n_sessions"), F.count("*").over(w).alias("n_categories"),
        ((F.max("hi").over(w) - F.min("lo").over(w)) / (24.0 * HOUR)).alias("span_days"), F.row_number().over(w.orderBy(F.desc("n"), "category")).alias("place"),
    )


def weekday_rates(labels: DataFrame, *, least: int = 20) -> DataFrame:
    """(weekday, n, rate) of return labels, all persons; weekdays with fewer labels than ``least`` are left out."""
    return labels.where("category <> 'unknown'").groupBy(F.weekday(F.timestamp_micros("window_end")).alias("weekday")).agg(F.count("*").alias("n"), F.avg(F.col("outcome").cast("double")).alias("rate")).where(F.col("n") >= least)


def gap_valley(events: DataFrame, *, bins: int = 40) -> DataFrame:
    """(person_id, n_gaps, valley_seconds): the trough between the two modes of a person's gaps on a log scale.

    Null with fewer than 20 gaps above zero, with gaps within half a decade, or where the trough isn't below half of
    the lower mode. Counts are smoothed over three bins; modes are an eighth of the bins (3 at least) apart; of a
    flat trough the middle counts. Only ``bins`` counts a person are gathered.
    """
    gaps = events.withColumn("gap", (F.col("us") - F.lag("us").over(person_order())) / 1e6).where("gap > 0")
    logs = gaps.select("person_id", F.log10("gap").alias("x"))
    span = logs.groupBy("person_id").agg(F.count("*").alias("n_gaps"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    wide = (F.col("n_gaps") >= 20) & (F.col("hi") - F.col("lo") >= 0.5)
    place = F.least(F.floor((F.col("x") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins)), F.lit(bins - 1)).cast("int")
    per_bin = logs.join(span.where(wide), "person_id").groupBy("person_id", place.alias("bin")).agg(F.count("*").alias("n"))
    found = per_bin.groupBy("person_id").agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("by_bin"))
    every = F.sequence(F.lit(0), F.lit(bins - 1))

    def counted(i):
        at = F.greatest(F.lit(0), F.least(i, F.lit(bins - 1)))
        return F.coalesce(F.try_element_at("by_bin", at), F.lit(0).cast("long"))

    found = found.withColumn("smooth", F.transform(every, lambda i: counted(i - 1) + counted(i) + counted(i + 1)))
    found = found.withColumn("a", F.array_position("smooth", F.array_max("smooth")).cast("int") - 1)
    far = F.transform(every, lambda i: F.when(F.abs(i - F.col("a")) >= max(3, bins // 8), F.get("smooth", i)))
    found = found.withColumn("far", far).withColumn("z", F.array_position("far", F.array_max("far")).cast("int") - 1)
    left, right = F.least("a", "z"), F.greatest("a", "z")
    found = found.withColumn("depth", F.array_min(F.slice("smooth", left + 1, right - left + 1)))
    tied = F.filter(F.sequence(left, right), lambda i: F.get("smooth", i) == F.col("depth"))
    lower = F.least(F.array_max("smooth"), F.array_max("far"))
    found = found.select("person_id", F.when(2 * F.col("depth") < lower, F.get(tied, F.floor(F.size(tied) / 2).cast("int"))).alias("trough"))
    valley = F.pow(F.lit(10.0), F.col("lo") + (F.col("trough") + 0.5) * ((F.col("hi") - F.col("lo")) / bins))
    return span.join(found, "person_id", "left").select("person_id", "n_gaps", valley.alias("valley_seconds"))


def history_halves(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(person_id, domain) of the events up to, and after, the middle of each person's own history."""
    middle = events.groupBy("person_id").agg(F.expr("(min(us) + max(us)) div 2").alias("middle"))
    rows = events.where("domain is not null").join(middle, "person_id")
    return tuple(rows.where(where).select("person_id", "domain") for where in ("us <= middle", "us > middle"))
