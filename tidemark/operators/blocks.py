"""Calendar blocks by zone and kind, and studies of sessions, domains and labels over the whole history."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.sessions import person_order
from tidemark.schemas import DAY

PERSON = "person_id"
KINDS = ("day", "weekday", "weekend")


def local_day(us: str = "us", offset_minutes: int = 0) -> Column:
    """Days since 1970 in a zone at a fixed offset from UTC."""
    return F.floor((F.col(us) + offset_minutes * 60_000_000) / DAY).cast("long")


def _block(kind: str) -> Column:
    """The first day of the block that holds ``day``; null where the day has none of that kind (day 4 was a Monday)."""
    monday = F.col("day") - F.pmod(F.col("day") + 3, F.lit(7))
    place = F.pmod(F.col("day") + 3, F.lit(7))
    if kind == "weekday":
        return F.when(place < 5, monday)
    return F.when(place >= 5, monday + 5) if kind == "weekend" else F.col("day")


def calendar_blocks(events: DataFrame, *, kind: str, offset_minutes: int = 0) -> DataFrame:
    """(person_id, kind, block, n, active_days, complete): every block from a person's first to last, empty ones too.

    Days, Monday to Friday, or Saturday and Sunday, by local day. The first and last block may be cut by the ends of the
    history, so they are not complete.
    """
    if kind not in KINDS:
        raise ValueError(f"unknown kind of block: {kind}")
    step = 1 if kind == "day" else 7
    placed = events.withColumn("day", local_day("us", offset_minutes)).withColumn("block", _block(kind)).where("block is not null")
    found = placed.groupBy(PERSON, "block").agg(F.count("*").alias("n"), F.countDistinct("day").alias("active_days"))
    ends = found.groupBy(PERSON).agg(F.min("block").alias("lo"), F.max("block").alias("hi"))
    spine = ends.select(PERSON, "lo", "hi", F.explode(F.sequence("lo", "hi", F.lit(step).cast("long"))).alias("block"))
    zero = F.lit(0).cast("long")
    return spine.join(found, [PERSON, "block"], "left").select(
        PERSON, F.lit(kind).alias("kind"), "block", F.coalesce("n", zero).alias("n"), F.coalesce("active_days", zero).alias("active_days"),
        ((F.col("block") > F.col("lo")) & (F.col("block") < F.col("hi"))).alias("complete"),
    )


def block_volume_stats(grid: DataFrame, *, trailing: int = 10, least: int = 6) -> DataFrame:
    """How block labels would fall, for each person: more than the trailing median, as much, and topics that qualify.

    A topic is judged from ``least`` earlier blocks on, counted from the block on which it first occurs; it qualifies in
    a block if it occurs in half the trailing window or more.
    """
    w = Window.partitionBy(PERSON, "category").orderBy("rn")
    begun = grid.withColumn("__seen", F.sum("n").over(w)).where("__seen > 0")
    window = w.rowsBetween(-trailing, -1)
    judged = begun.withColumn("k", F.row_number().over(w)).withColumn("prior", F.collect_list("n").over(window))
    judged = judged.where(F.col("k") > least).withColumn("active", F.size(F.filter("prior", lambda x: x > 0)))
    ordered, size = F.sort_array("prior"), F.size("prior")
    low, high = F.get(ordered, F.floor((size - 1) / 2).cast("int")), F.get(ordered, F.floor(size / 2).cast("int"))
    judged = judged.withColumn("median", (low + high) / 2).withColumn("fits", 2 * F.col("active") >= size)
    fits = F.col("fits")
    return judged.groupBy(PERSON).agg(
        F.count_if(fits).alias("labels"), F.count_if(fits & (F.col("n") > F.col("median"))).alias("strict"),
        F.count_if(fits & (F.col("n") >= F.col("median"))).alias("inclusive"), F.count_if(fits & (F.col("n") == F.col("median"))).alias("ties"),
        F.count_if(fits & (F.col("median") == 0)).alias("zero_medians"), F.countDistinct(F.when(fits, F.col("category"))).alias("topics"),
        F.size(F.array_except(F.collect_set(F.when(~fits, F.col("category"))), F.collect_set(F.when(fits, F.col("category"))))).cast("long").alias("rejected_topics"),
    )


def absorbed_boundaries(sessioned: DataFrame) -> DataFrame:
    """(person_id, boundaries, absorbed): session boundaries, and those with one category on both sides."""
    w = person_order()
    crossed = sessioned.select(PERSON, "session_no", "category", F.lag("session_no").over(w).alias("s"), F.lag("category").over(w).alias("c"))
    at = crossed.where("s <> session_no")
    return at.groupBy(PERSON).agg(F.count("*").alias("boundaries"), F.count_if(F.col("c") == F.col("category")).alias("absorbed"))


def next_session_floors(shapes: DataFrame) -> DataFrame:
    """(person_id, n, same_rate, mode_rate): how often the next session keeps the primary category, or has the commonest."""
    w = Window.partitionBy(PERSON).orderBy("session_no")
    pairs = shapes.select(PERSON, "primary_category", F.lead("primary_category").over(w).alias("after")).where("after is not null")
    mode = pairs.groupBy(PERSON, "after").agg(F.count("*").alias("k")).groupBy(PERSON).agg(F.max("k").alias("most"))
    same = F.avg((F.col("primary_category") == F.col("after")).cast("double"))
    per = pairs.groupBy(PERSON).agg(F.count("*").alias("n"), same.alias("same_rate"))
    return per.join(mode, PERSON).select(PERSON, "n", "same_rate", (F.col("most") / F.col("n")).alias("mode_rate"))


def session_label_volume(sessioned: DataFrame, *, horizon_hours: int) -> DataFrame:
    """(person_id, n_labels, n_positive) with sessions as buckets: does the category come again after the session's end?"""
    w = Window.partitionBy(PERSON, "category").orderBy("session_no")
    per = sessioned.groupBy(PERSON, "session_no").agg(F.max("us").alias("end")).join(
        sessioned.groupBy(PERSON, "session_no", "category").agg(F.min("us").alias("first")), [PERSON, "session_no"]
    )
    again = F.coalesce(F.lead("first").over(w) <= F.col("end") + horizon_hours * 3_600_000_000, F.lit(False))
    return per.withColumn("again", again).groupBy(PERSON).agg(F.count("*").alias("n_labels"), F.count_if("again").alias("n_positive"))


def head_domains(events: DataFrame, n: int) -> DataFrame:
    """(person_id, domain) of the ``n`` most frequent domains, ties by name."""
    counted = events.where("domain is not null").groupBy(PERSON, "domain").agg(F.count("*").alias("c"))
    w = Window.partitionBy(PERSON).orderBy(F.desc("c"), "domain")
    return counted.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n).select(PERSON, "domain")


def proxy_categories(events: DataFrame, n: int = 10) -> DataFrame:
    """Events whose category is their domain if it is one of the n - 1 most frequent, else ``other``."""
    head = head_domains(events, n - 1).withColumn("__head", F.col("domain"))
    return events.join(head, [PERSON, "domain"], "left").withColumn("category", F.coalesce("__head", F.lit("other"))).drop("__head")


def relabelled(events: DataFrame, n: int, *, merged: bool) -> DataFrame:
    """Events whose ``n`` head domains are categories of their own, or one together; the rest stay as they are."""
    head = head_domains(events, n).withColumn("__head", F.lit("head") if merged else F.concat(F.lit("domain:"), "domain"))
    return events.join(head, [PERSON, "domain"], "left").withColumn("category", F.coalesce("__head", "category")).drop("__head")


def histogram(rows: DataFrame, key: str, value: str, bins: int = 20) -> DataFrame:
    """(key, bin, n) over equal steps from the least to the greatest value of each key; the last bin is closed."""
    ends = rows.where(F.col(value).isNotNull()).groupBy(key).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    step = (F.col("hi") - F.col("lo")) / bins
    at = F.when(step == 0, 0).otherwise(F.least(F.floor((F.col(value) - F.col("lo")) / step), F.lit(bins - 1)))
    placed = rows.where(F.col(value).isNotNull()).join(ends, key).select(key, at.cast("int").alias("bin"))
    return placed.groupBy(key, "bin").agg(F.count("*").alias("n"))


def null_shares(rows: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """(feature, share): the share of nulls in each column, in one pass."""
    shares = rows.agg(*(F.avg(F.col(c).isNull().cast("double")).alias(c) for c in names))
    return shares.select(F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).alias("share")) for c in names))).alias("s")).select("s.*")


def domain_shift(events: DataFrame) -> DataFrame:
    """Each person's domains before and after the middle of their history: shared, lost and fresh ones, and the L1 distance."""
    ends = events.groupBy(PERSON).agg(F.min("us").alias("lo"), F.max("us").alias("hi"))
    late = F.col("us") - F.col("lo") > F.col("hi") - F.col("us")
    placed = events.where("domain is not null").join(ends, PERSON).withColumn("late", late)
    n = placed.groupBy(PERSON, "domain").agg(F.count_if(~F.col("late")).alias("a"), F.count_if("late").alias("b"))
    w = Window.partitionBy(PERSON)
    share = lambda c: F.coalesce(F.col(c) / F.nullif(F.sum(c).over(w), F.lit(0)), F.lit(0.0))
    apart = n.withColumn("d", F.abs(share("a") - share("b")))
    held = lambda c: F.collect_set(F.when(F.col(c) > 0, F.col("domain")))
    sets = apart.groupBy(PERSON).agg(held("a").alias("x"), held("b").alias("y"), F.sum("d").alias("distance"))
    sized = lambda f, a, b, name: F.size(f(a, b)).cast("long").alias(name)
    return sets.select(
        PERSON, sized(F.array_intersect, "x", "y", "shared"), sized(F.array_except, "x", "y", "lost"), sized(F.array_except, "y", "x", "fresh"), "distance"
    )


def latest_events(events: DataFrame, n: int = 5) -> DataFrame:
    """The last ``n`` events of each person, newest first."""
    w = Window.partitionBy(PERSON).orderBy(F.desc("us"), F.desc("event_id"))
    return events.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def label_definitions(parts: dict[str, DataFrame]) -> DataFrame:
    """(definition, labels, positives, persons) of several label volumes."""
    named = [df.select(F.lit(name).alias("definition"), PERSON, "n_labels", "n_positive") for name, df in parts.items()]
    every = reduce(DataFrame.unionByName, named)
    return every.groupBy("definition").agg(F.sum("n_labels").alias("labels"), F.sum("n_positive").alias("positives"), F.count("*").alias("persons"))


def rule_summary(rules: DataFrame, sets: DataFrame) -> DataFrame:
    """(person_id, n_rules, best_lift, covered): rules, their best lift, and sessions that hold some rule's antecedent."""
    best = rules.groupBy(PERSON).agg(F.count("*").alias("n_rules"), F.max("lift").alias("best_lift"))
    items = sets.select(PERSON, "session_no", F.explode("items").alias("antecedent"))
    covered = items.join(rules.select(PERSON, "antecedent").distinct(), [PERSON, "antecedent"], "left_semi")
    held = covered.groupBy(PERSON).agg(F.countDistinct("session_no").alias("covered"))
    return best.join(held, PERSON, "left").withColumn("covered", F.coalesce("covered", F.lit(0).cast("long")))
