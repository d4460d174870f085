"""Registered queries over calendar blocks by each person's zone, and the eligibility gate of a population study."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import registrable_domain
from tidemark.operators import blocks, calendars, evaluation, labels
from tidemark.plans.queries import events, predictions, rounded, sessioned, table
from tidemark.plans.studies import rivals_and_rates
from tidemark.sources.categories import categorised

#: The zone of a person is that of their number modulo four; blocks of a week need less history than days.
ZONES = ("UTC", "America/New_York", "Asia/Kolkata", "Europe/Berlin")
LEAST_BLOCKS = {"day": 6, "weekday": 1, "weekend": 1}


def _zoned(spark, sf_dir) -> DataFrame:
    zone = F.element_at(F.array(*map(F.lit, ZONES)), (F.pmod("person_id", F.lit(len(ZONES))) + 1).cast("int"))
    return events(spark, sf_dir).withColumn("zone", zone)


def _kinds(make) -> DataFrame:
    """The union of ``make(kind)`` over the kinds, each with its name."""
    return reduce(DataFrame.unionByName, (make(kind).withColumn("kind", F.lit(kind)) for kind in calendars.KINDS))


def zoned_grid(spark, sf_dir):
    """Visits by person, kind of block, block and category in local time, empty ones too."""
    rows = _zoned(spark, sf_dir)
    return _kinds(lambda kind: calendars.grid(rows, kind, F.col("zone")))


def zoned_block_volume(spark, sf_dir):
    """block_volume on local days, working weeks and weekends."""
    rows = _zoned(spark, sf_dir)
    return rounded(_kinds(lambda kind: labels.block_labels(calendars.grid(rows, kind, F.col("zone")), min_prior=LEAST_BLOCKS[kind]).select(
        "person_id", "category", "day", "outcome", "lastRatio", "medianLevel", "activeRate10", "topicShare10"
    )))


def zoned_volume_stats(spark, sf_dir):
    rows = _zoned(spark, sf_dir)
    return _kinds(lambda kind: blocks.block_volume_stats(calendars.grid(rows, kind, F.col("zone")), least=LEAST_BLOCKS[kind]))


def zoned_dormancy(spark, sf_dir):
    rows = _zoned(spark, sf_dir)
    return _kinds(lambda kind: labels.dormancy(calendars.grid(rows, kind, F.col("zone")), absent=2 if kind == "day" else 1))


def zoned_novelty(spark, sf_dir):
    rows = _zoned(spark, sf_dir)
    return _kinds(lambda kind: calendars.novelty(rows, kind, F.col("zone"), lookback_days=7).drop("kind"))


def local_day_visits(spark, sf_dir):
    return rounded(calendars.visits_per_local_day(_zoned(spark, sf_dir), F.col("zone")))


def eligibility(spark, sf_dir):
    """Who takes part in the population study, and why the others don't; every person has a row."""
    made = sessioned(spark, sf_dir)
    return evaluation.eligibility(made, labels.return_labels(made, horizon_hours=24), visits=60, sessions=20, labels=45)


def panel_measurement(spark, sf_dir):
    """Every eligible person's labels, test rows, rate and gain of the category rate over the base rate."""
    gate = eligibility(spark, sf_dir).where("reason is null").drop("reason")
    return rounded(evaluation.measured(gate, predictions(spark, sf_dir), challenger="category_rate", reference="base_rate"))


def width_ladder(spark, sf_dir):
    """How wide the interval of each rival against the category rate is, on each person's common test rows."""
    made = rivals_and_rates(spark, sf_dir)
    return rounded(evaluation.width_ladder(made, "category_rate"))


def resolved_layers(spark, sf_dir):
    """Pages by category and the layer that gave it: the map holds the domains of two pages or more, every ninth page overrides."""
    rows = table(spark, sf_dir, "pages").select(F.col("page_id").alias("person_id"), registrable_domain(F.col("url")).alias("domain"))
    known = rows.where("domain is not null")
    mapped = known.groupBy("domain").agg(F.count("*").alias("n")).where("n >= 2").select("domain", F.lit("shared").alias("category"))
    chosen = known.where("person_id % 9 = 0").select("person_id", "domain", F.when(F.col("person_id") % 2 == 0, "own").otherwise("").alias("category"))
    return categorised(rows, mapped, chosen).groupBy("category", "layer").agg(F.count("*").alias("n"))


ALL = (resolved_layers, width_ladder, zoned_grid, zoned_block_volume, zoned_volume_stats, zoned_dormancy, zoned_novelty, local_day_visits, eligibility, panel_measurement)
