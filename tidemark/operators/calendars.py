"""Calendar blocks by each person's own zone: local days, working weeks and weekends, one grid for every label.

Local time doesn't depend on the session's time zone: instants become wall-clock times by the zone's name, so days on
which clocks change have 23 or 25 hours.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Kinds of blocks: days, Monday to Friday, and Saturday with Sunday; a block is named by its first day.
KINDS = ("day", "weekday", "weekend")
_EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"


def local_time(us: Column, zone: Column | str) -> Column:
    """Wall-clock time (TIMESTAMP_NTZ) of microseconds since 1970 in a zone; an unknown zone raises."""
    seconds = (us.cast("decimal(20, 0)") / F.lit(1_000_000).cast("decimal(7, 0)")).cast("decimal(18, 6)")
    utc = F.expr(_EPOCH) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)
    return F.convert_timezone(F.lit("UTC"), F.lit(zone) if isinstance(zone, str) else zone, utc)


def local_day(us: Column, zone: Column | str) -> Column:
    """Days since 1970 of the local date."""
    return F.datediff(local_time(us, zone).cast("date"), F.expr("date'1970-01-01'")).cast("long")


def day_start(day: Column, zone: Column | str) -> Column:
    """Microseconds since 1970 of a local midnight."""
    midnight = F.expr(_EPOCH) + F.make_dt_interval(day.cast("int"))
    utc = F.convert_timezone(F.lit(zone) if isinstance(zone, str) else zone, F.lit("UTC"), midnight)
    return (F.unix_micros(F.convert_timezone(F.lit("UTC"), F.current_timezone(), utc).cast("timestamp"))).cast("long")


def block_of(day: Column, kind: str) -> Column:
    """The first day of the block of a kind that holds the day; null where it holds none (day 4 was a Monday)."""
    if kind not in KINDS:
        raise ValueError(f"unknown kind of block {kind!r}; one of {', '.join(KINDS)}")
    place = F.pmod(day + 3, F.lit(7))
    if kind == "weekday":
        return F.when(place < 5, day - place)
    return F.when(place >= 5, day - place + 5) if kind == "weekend" else day


def _placed(events: DataFrame, kind: str, zone: Column | str) -> DataFrame:
    return events.withColumn("day", block_of(local_day(F.col("us"), zone), kind)).where("day is not null")


def grid(events: DataFrame, kind: str = "day", zone: Column | str = "UTC") -> DataFrame:
    """(person_id, kind, day, rn, category, n): every complete block of a person and each of the kind's categories; absent is 0.

    The first and last block are cut, as the history may start or end inside them; ``day`` is a block's first day and
    ``rn`` its number after the first. The label operators take this grid in place of ``labels.day_grid``.
    ``zone`` may be a column of ``events``.
    """
    step = 1 if kind == "day" else 7
    counts = _placed(events, kind, zone).groupBy("person_id", "day", "category").agg(F.count("*").alias("n"))
    spans = counts.groupBy("person_id").agg(F.min("day").alias("lo"), F.max("day").alias("hi"), F.collect_set("category").alias("categories"))
    inner = F.explode(F.sequence(F.col("lo") + step, F.col("hi") - step, F.lit(step).cast("long"))).alias("day")
    spine = spans.where(F.col("hi") - F.col("lo") >= 2 * step).select("person_id", "lo", inner, "categories")
    number = F.expr(f"(day - lo) div {step}")
    cells = spine.select("person_id", "day", number.alias("rn"), F.explode("categories").alias("category"))
    full = cells.join(counts, ["person_id", "day", "category"], "left")
    return full.select("person_id", F.lit(kind).alias("kind"), "day", "rn", "category", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def visits_per_local_day(events: DataFrame, zone: Column | str = "UTC") -> DataFrame:
    """(person_id, day, n, hours): visits of each local day that has any, and how many hours the day has in its zone."""
    name = F.lit(zone) if isinstance(zone, str) else zone
    per = events.withColumn("zone", name).withColumn("day", local_day(F.col("us"), F.col("zone"))).groupBy("person_id", "zone", "day").agg(F.count("*").alias("n"))
    hours = (day_start(F.col("day") + 1, F.col("zone")) - day_start(F.col("day"), F.col("zone"))) / 3_600_000_000
    return per.select("person_id", "day", "n", hours.alias("hours"))


def novelty(events: DataFrame, kind: str = "day", zone: Column | str = "UTC", *, lookback_days: int = 30) -> DataFrame:
    """(person_id, kind, day, n_domains, n_new): domains of a block not visited in the days before its first visit.

    A block whose look-back holds no visit is left out; a block without visits has no domains and no row.
    """
    visits = _placed(events.where("domain is not null"), kind, zone)
    start = F.col("first_at") - lookback_days * 86_400_000_000
    blocks = visits.groupBy("person_id", "day").agg(F.min("us").alias("first_at"))
    every = events.where("domain is not null").select("person_id", "domain", "us")
    # Visits before a block, of all kinds: the block's first instant joins the person's visits as a probe.
    probes = blocks.select("person_id", F.col("first_at").alias("us"), F.lit(1).alias("probe"))
    timed = every.select("person_id", "us", F.lit(0).alias("probe")).unionByName(probes)
    past = Window.partitionBy("person_id").orderBy("us").rangeBetween(Window.unboundedPreceding, -1)
    before = timed.withColumn("before", F.max(F.when(F.col("probe") == 0, F.col("us"))).over(past)).where("probe = 1")
    judged = blocks.join(before.select("person_id", F.col("us").alias("first_at"), "before"), ["person_id", "first_at"]).where(F.col("before") >= start)
    own = visits.select("person_id", "day", "domain").distinct().join(judged.select("person_id", "day", "first_at"), ["person_id", "day"])
    asked = own.select("person_id", "domain", F.col("first_at").alias("us"), "day", F.lit(1).alias("probe"))
    seen = every.withColumn("day", F.lit(None).cast("long")).withColumn("probe", F.lit(0)).unionByName(asked)
    of_domain = Window.partitionBy("person_id", "domain").orderBy("us").rangeBetween(Window.unboundedPreceding, -1)
    last = seen.withColumn("last", F.max(F.when(F.col("probe") == 0, F.col("us"))).over(of_domain)).where("probe = 1")
    fresh = F.col("last").isNull() | (F.col("last") < F.col("us") - lookback_days * 86_400_000_000)
    per = last.groupBy("person_id", "day").agg(F.count("*").alias("n_domains"), F.count_if(fresh).alias("n_new"))
    return per.select("person_id", F.lit(kind).alias("kind"), "day", "n_domains", "n_new")
