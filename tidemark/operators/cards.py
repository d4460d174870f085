"""What usually follows: the next-category card, the board of all topics, its hub, and counts behind predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PERSON = "person_id"


def _shares(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, category, n, denominator, share, place): answers, most frequent first, ties by name."""
    counted = rows.groupBy(*keys, F.col("to_category").alias("category")).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*keys)
    share = F.col("n") / F.col("denominator")
    place = F.row_number().over(w.orderBy(F.desc("n"), "category"))
    return counted.withColumn("denominator", F.sum("n").over(w)).withColumn("share", share).withColumn("place", place)


def topic_board(changes: DataFrame, *, least: int = 10) -> DataFrame:
    """Answers after each topic that has at least ``least`` of them; ``unknown`` is no answer."""
    shown = changes.where("to_category <> 'unknown'")
    return _shares(shown, [PERSON, "from_category"]).where(F.col("denominator") >= least)


def next_category_card(changes: DataFrame, *, least: int = 10, total: int = 20) -> DataFrame:
    """What follows each person's current category: their own answers if it has ``least``, else all but itself.

    The current category is the answer of the last change. Persons with fewer than ``total`` answers have no rows;
    ``basis`` says which changes were counted.
    """
    shown = changes.where("to_category <> 'unknown'")
    current = changes.groupBy(PERSON).agg(F.max_by("to_category", F.struct("us", "event_id")).alias("current"))
    enough = shown.groupBy(PERSON).agg(F.count("*").alias("total_changes")).where(F.col("total_changes") >= total)
    asked = shown.join(current, PERSON).join(enough, PERSON)
    of_current = F.count_if(F.col("from_category") == F.col("current")).over(Window.partitionBy(PERSON))
    basis = F.when(of_current >= least, "conditional").otherwise("overall")
    based = asked.withColumn("basis", basis)
    fits = F.when(F.col("basis") == "conditional", F.col("from_category") == F.col("current")).otherwise(F.col("to_category") != F.col("current"))
    return _shares(based.where(fits), [PERSON, "current", "basis", "total_changes"]).withColumnRenamed("current", "from_category")


def hub_topic(board: DataFrame) -> DataFrame:
    """(person_id, category, leads_from, topics) where more than half of the board's topics lead to one first."""
    first = board.where("place = 1")
    leads = first.groupBy(PERSON, "category").agg(F.count("*").alias("leads_from"))
    topics = first.groupBy(PERSON).agg(F.count("*").alias("topics"))
    return leads.join(topics, PERSON).where("leads_from * 2 > topics")


def board_readiness(changes: DataFrame, *, least: int = 10) -> DataFrame:
    """(person_id, ready, closest): topics with enough answers, and the most answers of a topic without."""
    n = changes.where("to_category <> 'unknown'").groupBy(PERSON, "from_category").agg(F.count("*").alias("n"))
    short = F.max(F.when(F.col("n") < least, F.col("n")))
    return n.groupBy(PERSON).agg(F.count_if(F.col("n") >= least).alias("ready"), F.coalesce(short, F.lit(0).cast("long")).alias("closest"))


def scorecard(resolved: DataFrame) -> DataFrame:
    """Counts by outcome, accuracy on scored predictions and the lead over always saying yes; needs ``p``.

    A probability of exactly one half calls against a recurrence.
    """
    hit, scored = F.col("outcome") == "hit", F.col("outcome").isin("hit", "miss")
    right = F.count_if(scored & ((F.col("p") > 0.5) == hit))
    n = F.nullif(F.count_if(scored), F.lit(0))
    counts = [F.count_if(F.col("outcome") == x).alias(x) for x in ("hit", "miss", "pending", "expired")]
    return resolved.groupBy(PERSON).agg(
        F.count("*").alias("total"), *counts, F.count_if(scored).alias("scored"), (F.count_if(hit) / n).alias("outcome_rate"),
        (right / n).alias("accuracy"), right.alias("correct"), (right - F.count_if(hit)).alias("ahead_of_always_yes"),
    )
