"""Sessions: boundaries by gaps, shapes, primary category, category runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import saturate
from tidemark.schemas import DOMAIN_COUNT, DURATION_MINUTES, VISIT_COUNT


def person_order() -> Window:
    return Window.partitionBy("person_id").orderBy("us", "event_id")


def sessionise(events: DataFrame, *, timeout_seconds: float) -> DataFrame:
    """Events with session_no (from 1, per person) and session_start; a gap of exactly the timeout stays inside."""
    w = person_order()
    gap = F.col("us") - F.lag("us").over(w)
    numbered = events.withColumn("session_no", F.sum(F.when(gap.isNull() | (gap > int(timeout_seconds * 1e6)), 1).otherwise(0)).over(w))
    return numbered.withColumn("session_start", F.min("us").over(Window.partitionBy("person_id", "session_no")))


def session_shapes(sessioned: DataFrame) -> DataFrame:
    """Per session: counts, saturated descriptors and the evenness of its categories (entropy over its maximum)."""
    key = ["person_id", "session_no"]
    by_category = sessioned.groupBy(*key, "category").agg(
        F.count("*").alias("n"), F.min("us").alias("lo"), F.max("us").alias("hi"), F.collect_set("domain").alias("domains")
    )
    total = Window.partitionBy(*key)
    share = F.col("n") / F.sum("n").over(total)
    shaped = by_category.withColumn("h", -share * F.ln(share)).groupBy(*key).agg(
        F.sum("n").alias("n_events"), F.count("*").alias("n_categories"), F.size(F.array_distinct(F.flatten(F.collect_list("domains")))).alias("n_domains"),
        ((F.max("hi") - F.min("lo")) / 1e6).alias("duration_seconds"), F.sum("h").alias("h"),
        F.min(F.struct((-F.col("n")).alias("n"), "category"))["category"].alias("primary_category"),
    )
    n = F.col("n_events")
    return shaped.select(
        *key, "n_events", "n_categories", F.col("n_domains").cast("long").alias("n_domains"), "duration_seconds", "primary_category",
        saturate(n.cast("double"), VISIT_COUNT).alias("visitLevel"), saturate(F.col("n_domains").cast("double"), DOMAIN_COUNT).alias("domainLevel"),
        saturate(F.col("duration_seconds") / 60, DURATION_MINUTES).alias("durationLevel"), (1 - F.col("n_domains") / n).alias("repeatRate"),
        F.when(F.col("n_categories") < 2, F.lit(0.0)).otherwise(F.col("h") / F.ln("n_categories")).alias("evenness"),
    )


def category_transitions(sessioned: DataFrame) -> DataFrame:
    """One row for each change of category between runs of a person's events, within and across sessions."""
    w = person_order()
    change = F.coalesce((F.col("category") != F.lag("category").over(w)).cast("int"), F.lit(1))
    runs = (
        sessioned.withColumn("run", F.sum(change).over(w))
        .groupBy("person_id", "run")
        .agg(F.first("category").alias("category"), F.count("*").alias("n"), F.min_by("event_id", F.struct("us", "event_id")).alias("event_id"),
             F.min("us").alias("us"), F.min("session_no").alias("first_session"), F.max("session_no").alias("last_session"))
    )
    r = Window.partitionBy("person_id").orderBy("run")
    return runs.select(
        "person_id", "event_id", "us", F.lag("category").over(r).alias("from_category"), F.col("category").alias("to_category"),
        F.lag("category", 2).over(r).alias("previous_category"), F.lag("n").over(r).alias("from_run_events"),
        (F.lag("last_session").over(r) == F.col("first_session")).alias("within_session"), F.col("first_session").alias("session_no"),
    ).where("from_category is not null")
