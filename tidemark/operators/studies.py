"""Smaller studies: redirects, engagement gate, label volume, excursions, rank correlation, multiclass accuracy, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.sessions import person_order
from tidemark.schemas import DAY, HOUR


def redirect_confusion(visits: DataFrame, thresholds_us: tuple[int, ...]) -> DataFrame:
    """Confusion of "the gap to the referring visit is at most the threshold" against the flag ``redirect``.

    ``visits``: person_id, us, event_id, redirect; the referring visit is the person's previous one.
    """
    gap = F.col("us") - F.lag("us").over(person_order())
    known = visits.select("redirect", gap.alias("gap")).where("gap is not null")
    rows = known.select("redirect", "gap", F.explode(F.array(*map(F.lit, thresholds_us))).alias("threshold_us")).withColumn("said", F.col("gap") <= F.col("threshold_us"))
    per = rows.groupBy("threshold_us").agg(
        F.count_if(F.col("said") & F.col("redirect")).alias("tp"), F.count_if(F.col("said") & ~F.col("redirect")).alias("fp"), F.count_if(~F.col("said") & F.col("redirect")).alias("fn")
    )
    none = F.lit(0)
    precision, recall = F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), none), F.col("tp") / F.nullif(F.col("tp") + F.col("fn"), none)
    return per.select("*", precision.alias("precision"), recall.alias("recall"), (2 * F.col("tp") / F.nullif(2 * F.col("tp") + F.col("fp") + F.col("fn"), none)).alias("f1"))


def engagement_gate(events: DataFrame, labelled: DataFrame, *, visits: int, sessions: int, labels: int) -> DataFrame:
    """Per person: dwelled visits, sessions with a label, labels, and whether all reach their minimum."""
    dwelled = events.groupBy("person_id").agg(F.count("dwell_seconds").alias("n_dwelled"))
    made = labelled.groupBy("person_id").agg(F.countDistinct("session_no").alias("n_sessions"), F.count("*").alias("n_labels"))
    zero = F.lit(0).cast("long")
    joined = dwelled.join(made, "person_id", "left").select("person_id", "n_dwelled", F.coalesce("n_sessions", zero).alias("n_sessions"), F.coalesce("n_labels", zero).alias("n_labels"))
    return joined.withColumn("passed", (F.col("n_dwelled") >= visits) & (F.col("n_sessions") >= sessions) & (F.col("n_labels") >= labels))


def label_volume(events: DataFrame, *, bucket_us: int, horizon_hours: int) -> DataFrame:
    """Return labels if a fixed window stood for a session: per person, labels and positives.

    The next event of the category is the first of its next bucket.
    """
    per = events.groupBy("person_id", "category", F.floor(F.col("us") / bucket_us).alias("bucket")).agg(F.min("us").alias("first_us"))
    following = F.lead("first_us").over(Window.partitionBy("person_id", "category").orderBy("bucket"))
    scored = per.withColumn("outcome", F.coalesce(following <= (F.col("bucket") + 1) * bucket_us + horizon_hours * HOUR, F.lit(False)))
    return scored.groupBy("person_id").agg(F.count("*").alias("n_labels"), F.count_if("outcome").alias("n_positive"))


def excursions(folded: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """(fold, feature, n, outside, widest): test values beyond the training range, in range widths.

    A person's training range is the running range of earlier folds.
    """
    values = folded.select("person_id", "fold", F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).alias("x")) for c in columns))).alias("v")).select("person_id", "fold", "v.feature", "v.x")
    per = values.groupBy("person_id", "feature", "fold").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    before = Window.partitionBy("person_id", "feature").orderBy("fold").rowsBetween(Window.unboundedPreceding, -1)
    ranges = per.select("person_id", "feature", "fold", F.min("lo").over(before).alias("lo"), F.max("hi").over(before).alias("hi"))
    test = values.where("fold > 0 and x is not null").join(ranges, ["person_id", "feature", "fold"]).where("lo is not null")
    over = F.greatest(F.col("lo") - F.col("x"), F.col("x") - F.col("hi"), F.lit(0.0))
    return test.groupBy("fold", "feature").agg(F.count("*").alias("n"), F.count_if(over > 0).alias("outside"), F.max(over / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0))).alias("widest"))


def spearman(rows: DataFrame, group: list[str], x: str, y: str) -> DataFrame:
    """Rank correlation with average ranks for ties, per group."""

    def rank(c: str):
        return F.rank().over(Window.partitionBy(*group).orderBy(c)) + (F.count("*").over(Window.partitionBy(*group, c)) - 1) / 2

    return rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*group, rank(x).alias("rx"), rank(y).alias("ry")).groupBy(*group).agg(F.count("*").alias("n"), F.corr("rx", "ry").alias("rho"))


def top_k(changes: DataFrame, *, k: int = 2) -> DataFrame:
    """Per person: accuracy of the most frequent answers, and of those from the same source, trained on the first 60 %.

    A source ranks all answers by their counts, smoothed towards the overall shares; ties go to the first category by
    name. A source never seen in training falls back to the overall ranking.
    """
    w = Window.partitionBy("person_id")
    split = changes.withColumn("rn", F.row_number().over(w.orderBy("us", "event_id"))).withColumn("train", F.col("rn") <= F.floor(F.count("*").over(w) * 0.6))
    train, test = split.where("train"), split.where("not train")

    def ranking(counts: DataFrame, keys: list[str], score, name: str) -> DataFrame:
        listed = F.sort_array(F.collect_list(F.struct((-score).alias("k"), "to_category")))
        return counts.groupBy(*keys).agg(F.transform(listed, lambda s: s["to_category"]).alias(name))

    overall = train.groupBy("person_id", "to_category").agg(F.count("*").alias("m")).withColumn("all", F.sum("m").over(Window.partitionBy("person_id")))
    counts = train.groupBy("person_id", "from_category", "to_category").agg(F.count("*").alias("n"))
    every = counts.select("person_id", "from_category").distinct().join(overall, "person_id").join(counts, ["person_id", "from_category", "to_category"], "left")
    # in the order of (n + m / all): the smoothed probability, in whole numbers
    by_source = ranking(every, ["person_id", "from_category"], F.coalesce("n", F.lit(0)) * F.col("all") + F.col("m"), "source")
    joined = test.join(ranking(overall, ["person_id"], F.col("m"), "overall"), "person_id").join(by_source, ["person_id", "from_category"], "left")
    joined = joined.withColumn("source", F.coalesce("source", "overall"))
    hit = lambda c, m: F.avg(F.array_contains(F.slice(c, 1, m), F.col("to_category")).cast("double"))
    return joined.groupBy("person_id").agg(F.count("*").alias("n"), hit("overall", 1).alias("mode_top1"), hit("overall", k).alias("mode_topk"), hit("source", 1).alias("table_top1"), hit("source", k).alias("table_topk"))


def retention(events: DataFrame, *, keep_days: int, now_us: int | Column) -> DataFrame:
    """Per person: events that raw retention keeps and deletes at ``now_us``, a number or a scalar subquery."""
    old = F.col("us") < now_us - keep_days * DAY
    return events.groupBy("person_id").agg(F.count_if(~old).alias("kept"), F.count_if(old).alias("deleted"))


def coverage_gaps(switches: DataFrame) -> DataFrame:
    """(person_id, from_us, to_us) from switches (person_id, event_id, us, on), ties by event: opening twice or closing twice changes nothing.

    A gap that is still open ends in null.
    """
    w = person_order()
    changed = switches.withColumn("before", F.lag("on").over(w)).where((F.col("on") != F.col("before")) | (F.col("before").isNull() & ~F.col("on")))
    return changed.select("person_id", F.col("us").alias("from_us"), F.lead("us").over(w).alias("to_us"), "on").where("not on").drop("on")
