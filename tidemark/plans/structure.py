"""Registered queries over structure in a person's history: session types with their nulls, rules against chance, halves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.operators import clustering, patterns, sessions
from tidemark.plans.queries import TIMEOUT, events, rounded, sessioned

#: Shape features that the clustering sees; hour and weekend are held out.
SHAPE = ("visitLevel", "domainLevel", "durationLevel", "repeatRate", "evenness")
#: Cluster counts of the sweep, the least number of a person's sessions, and runs of the nulls and of stability.
SWEEP, LEAST, NULL_RUNS, STABILITY_RUNS = range(2, 9), 20, 20, 15


def _shapes(spark, sf_dir) -> DataFrame:
    """Session shapes of persons with enough sessions, with ``x``, the local start hour and the weekend flag (UTC)."""
    made = sessioned(spark, sf_dir)
    starts = made.groupBy("person_id", "session_no").agg(F.min("us").alias("us"))
    shapes = sessions.session_shapes(made).join(starts, ["person_id", "session_no"])
    enough = shapes.groupBy("person_id").agg(F.count("*").alias("n_sessions")).where(F.col("n_sessions") >= LEAST).select("person_id")
    timed = shapes.withColumn("hour", F.pmod(F.floor(F.col("us") / schemas.HOUR), F.lit(24)))
    day = F.floor(F.col("us") / schemas.DAY)
    return clustering.standardised(timed.withColumn("weekend", F.pmod(day + 3, F.lit(7)) >= 5).join(enough, "person_id"), ["person_id"], SHAPE)


def session_types(spark, sf_dir):
    """Per person and k: silhouette, its bands over permuted columns and over one normal, stability, and both verdicts."""
    points = _shapes(spark, sf_dir).select("person_id", "session_no", "x").checkpoint()
    by = ["person_id", "k"]
    own = clustering.swept_silhouettes(points, ["person_id"], "session_no", SWEEP)
    nulls = clustering.null_bands(points, ["person_id"], "session_no", SWEEP, len(SHAPE), runs=NULL_RUNS)
    band = lambda name: nulls.where(F.col("null") == name).select(*by, *(F.col(c).alias(f"{name}_{c}") for c in ("median", "low", "high"))).hint("merge")
    steady = clustering.swept_stability(points, ["person_id"], "session_no", SWEEP, runs=STABILITY_RUNS).select(*by, "stability").hint("merge")
    joined = own.join(band("permuted"), by).join(band("gaussian"), by).join(steady, by)
    above = {f"above_{n}": F.coalesce(F.col("silhouette") > F.col(f"{n}_high"), F.lit(False)) for n in ("permuted", "gaussian")}
    return rounded(joined.withColumns(above))


def _clustered(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    points = _shapes(spark, sf_dir)
    blocks = clustering.blocked(points, ["person_id"], "session_no")
    marked = clustering.labelled(blocks, clustering.kmeans(blocks, ["person_id"], 2), ["person_id"])
    return points, clustering.assignments(marked, ["person_id"], "session_no")


def session_clusters(spark, sf_dir):
    """The cluster of each session among two of its person."""
    return _clustered(spark, sf_dir)[1]


def session_profiles(spark, sf_dir):
    """What the two clusters of a person's sessions look like, in features they were and weren't made from."""
    points, found = _clustered(spark, sf_dir)
    held_out = points.withColumn("evening", (F.col("hour") >= 18).cast("double")).withColumn("onWeekend", F.col("weekend").cast("double"))
    joined = held_out.join(found, ["person_id", "session_no"])
    medians = joined.groupBy("person_id", "cluster").agg(
        *(F.percentile(c, 0.5).alias(f"median_{c}") for c in ("n_events", "n_domains", "duration_seconds"))
    )
    own = clustering.profiles(held_out, found, ["person_id"], "session_no", (*SHAPE, "evening", "onWeekend"))
    return rounded(own.join(medians, ["person_id", "cluster"]))


def rule_null_band(spark, sf_dir):
    """Each person's number of category rules against 50 runs of sets of the same sizes without associations."""
    sets = patterns.item_sets(sessioned(spark, sf_dir), ["person_id", "session_no"], "category")
    return rounded(patterns.null_rule_band(sets, ["person_id"], ["session_no"], support=5, confidence=0.3, lift=1.0))


def half_agreement(spark, sf_dir):
    """Do a person's domains group together in both halves of the history?"""
    return rounded(patterns.half_agreement(patterns.half_clusters(events(spark, sf_dir), timeout_seconds=TIMEOUT, least=2, threshold=0.4)))


def cluster_stats(spark, sf_dir):
    return rounded(patterns.cluster_stats(events(spark, sf_dir), timeout_seconds=TIMEOUT, least=2, threshold=0.4))


ALL = (session_types, session_clusters, session_profiles, rule_null_band, half_agreement, cluster_stats)
