"""Rolling-origin folds, baselines, scores, calibration, abstention, bootstrap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import resampling

#: Fixed value: the one-sided quantile of the lower bound of an accuracy.
Z = 1.645


def rolling_folds(labels: DataFrame, *, folds: int = 5, fraction: float = 0.4, least: int = 20, order: tuple[str, ...] = ("window_end", "category")) -> DataFrame:
    """Labels with rn, train_stop and fold (0: before the first test window). Persons with too few labels are left out.

    Training of a fold is every row with rn <= train_stop: the windows expand, tests follow each other.
    """
    w = Window.partitionBy("person_id")
    counted = labels.withColumn("rn", F.row_number().over(w.orderBy(*order))).withColumn("n_labels", F.count("*").over(w)).where(F.col("n_labels") >= max(least, 2 * folds))
    start = F.greatest(F.floor(F.col("n_labels") * fraction), F.lit(folds))
    chunk = F.floor((F.col("n_labels") - start) / folds)
    fold = F.when(F.col("rn") <= start, 0).otherwise(F.least(F.floor((F.col("rn") - start - 1) / chunk) + 1, F.lit(folds)))
    return counted.withColumn("fold", fold.cast("int")).withColumn("train_stop", F.when(F.col("fold") > 0, start + (F.col("fold") - 1) * chunk))


def baselines(folded: DataFrame, *, smoothing: float = 5.0) -> DataFrame:
    """Test rows with p of the models base_rate and category_rate, trained on all earlier windows.

    Training sums come from running totals at fold ends, so no label meets another label.
    """
    y = F.col("outcome").cast("double")
    per = folded.groupBy("person_id", "fold", "category").agg(F.count("*").alias("n"), F.sum(y).alias("pos"))
    # (fold, category) cells that a test row may ask for, with the totals of all folds before.
    asks = folded.where("fold > 0").select("person_id", "fold", "category").distinct()
    cells = asks.join(per.withColumnRenamed("fold", "f"), ["person_id", "category"], "left").where("f is null or f < fold").groupBy("person_id", "fold", "category").agg(F.sum("n").alias("n_cat"), F.sum("pos").alias("pos_cat"))
    before = Window.partitionBy("person_id").orderBy("fold").rowsBetween(Window.unboundedPreceding, -1)
    overall = folded.groupBy("person_id", "fold").agg(F.count("*").alias("n"), F.sum(y).alias("pos")).select("person_id", "fold", (F.sum("pos").over(before) / F.sum("n").over(before)).alias("base_rate"))
    test = folded.where("fold > 0").join(overall, ["person_id", "fold"]).join(cells, ["person_id", "fold", "category"], "left")
    zero = F.lit(0.0)
    return test.withColumn("category_rate", (F.coalesce("pos_cat", zero) + smoothing * F.col("base_rate")) / (F.coalesce("n_cat", zero) + smoothing)).drop("n_cat", "pos_cat")


def long_predictions(test: DataFrame, models: tuple[str, ...] = ("base_rate", "category_rate")) -> DataFrame:
    stacked = F.explode(F.array(*(F.struct(F.lit(m).alias("model"), F.col(m).alias("p")) for m in models))).alias("s")
    return test.select("person_id", "category", "session_no", "window_end", "fold", F.col("outcome").cast("double").alias("y"), stacked).select("*", "s.model", "s.p").drop("s")


def scores(predicted: DataFrame) -> DataFrame:
    """Brier score, log loss, skill against base_rate, per person and model; empty groups have no row."""
    q = F.least(F.greatest("p", F.lit(1e-6)), F.lit(1 - 1e-6))
    per = predicted.where("category <> 'unknown'").groupBy("person_id", "model").agg(
        F.count("*").alias("n"), F.avg("y").alias("rate"), F.avg(F.pow(F.col("p") - F.col("y"), 2)).alias("brier"), F.avg(-(F.col("y") * F.ln(q) + (1 - F.col("y")) * F.ln(1 - q))).alias("log_loss")
    )
    reference = F.max(F.when(F.col("model") == "base_rate", F.col("brier"))).over(Window.partitionBy("person_id"))
    return per.withColumn("skill", 1 - F.col("brier") / F.nullif(reference, F.lit(0.0)))


def reliability(predicted: DataFrame, bins: int = 10) -> DataFrame:
    """(model, bin, n, mean_p, rate): the top bin is closed; a bin is found by comparing edges, empty ones are kept."""
    number = sum(((F.col("p") >= F.lit((k + 1) / bins)).cast("int") for k in range(bins - 1)), F.lit(0))
    found = predicted.select("model", number.alias("bin"), "p", "y").groupBy("model", "bin").agg(F.count("*").alias("n"), F.avg("p").alias("mean_p"), F.avg("y").alias("rate"))
    every = predicted.select("model").distinct().select("model", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return every.join(found, ["model", "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def calibration_errors(curve: DataFrame) -> DataFrame:
    """Expected and maximum calibration error of each model from its reliability curve."""
    gap = F.abs(F.col("mean_p") - F.col("rate"))
    return curve.groupBy("model").agg((F.sum(F.col("n") * gap) / F.sum("n")).alias("ece"), F.max(gap).alias("mce"))


def accuracy_coverage(predicted: DataFrame, steps: int = 50) -> DataFrame:
    """(model, threshold, answered, correct, accuracy, coverage, wilson): answers whose confidence reaches the threshold."""
    confidence, hit = F.greatest("p", 1 - F.col("p")), (F.col("p") > 0.5).cast("double") == F.col("y")
    cuts = F.array(*(F.lit(0.5 + 0.5 * k / steps) for k in range(steps)))
    # a prediction is counted once, at the number of thresholds that it reaches; those of a threshold are a running sum
    reached = predicted.select("model", F.size(F.filter(cuts, lambda t: confidence >= t)).alias("reached"), hit.alias("hit"))
    counted = reached.groupBy("model", "reached").agg(F.count("*").alias("c"), F.count_if("hit").alias("h"))
    places = F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("reached")
    spine = counted.select("model").distinct().select("model", places).join(counted, ["model", "reached"], "left")
    w = Window.partitionBy("model").orderBy(F.desc("reached")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    zero = F.lit(0).cast("long")
    summed = spine.select(
        "model", "reached", F.coalesce(F.sum("c").over(w), zero).alias("answered"), F.coalesce(F.sum("h").over(w), zero).alias("correct"),
        F.sum("c").over(Window.partitionBy("model")).alias("n"),
    )
    per = summed.where("reached > 0").withColumn("threshold", F.get(cuts, F.col("reached") - 1))
    n, p, z = F.nullif("answered", F.lit(0)), F.col("correct") / F.nullif("answered", F.lit(0)), Z
    low = (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
    return per.select("model", "threshold", "answered", "correct", p.alias("accuracy"), (F.col("answered") / F.col("n")).alias("coverage"), low.alias("wilson"))


def brier_bootstrap(predicted: DataFrame, *, challenger: str, reference: str, resamples: int = 2000, seed: int = resampling.SEED) -> DataFrame:
    """(person_id, point, low, high, clusters): paired percentile bootstrap over sessions, positive if the challenger wins.

    Spark sums each session's differences; blocks of resamples are spread over tasks.
    """
    error = F.pow(F.col("p") - F.col("y"), 2)
    signed = F.when(F.col("model") == reference, error).when(F.col("model") == challenger, -error)
    sums = predicted.groupBy("person_id", "session_no").agg(F.sum(signed).alias("diff"), F.count_if(F.col("model") == challenger).alias("n"))
    return resampling.intervals(sums, ["person_id"], "session_no", "diff", "n", resamples=resamples, seed=seed)


def transition_table(changes: DataFrame, *, smoothing: float = 1.0) -> DataFrame:
    """(person_id, from_category, to_category, n, p): counts smoothed towards the person's overall answers."""
    n = changes.groupBy("person_id", "from_category", "to_category").agg(F.count("*").alias("n"))
    answers = changes.groupBy("person_id", "to_category").agg(F.count("*").alias("m"))
    vocabulary = changes.select("person_id", "from_category").distinct().join(answers, "person_id")
    full = vocabulary.join(n, ["person_id", "from_category", "to_category"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    row, person = Window.partitionBy("person_id", "from_category"), Window.partitionBy("person_id", "from_category")
    marginal = F.col("m") / F.sum("m").over(person)
    return full.select("person_id", "from_category", "to_category", "n", ((F.col("n") + smoothing * marginal) / (F.sum("n").over(row) + smoothing)).alias("p"))


def next_category_ranking(table: DataFrame, k: int = 3) -> DataFrame:
    """(person_id, from_category, ranking): the ``k`` likeliest answers, ties by name."""
    w = Window.partitionBy("person_id", "from_category").orderBy(F.desc("p"), "to_category")
    top = table.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)
    return top.groupBy("person_id", "from_category").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "to_category"))), lambda x: x["to_category"]).alias("ranking"))


def resolve_predictions(predictions: DataFrame, events: DataFrame, gaps: DataFrame, now_us: int | Column) -> DataFrame:
    """Outcome of each (person_id, category, start_us, end_us): expired, hit, pending or miss, tested in that order.

    Expired: a coverage gap (person_id, from_us, to_us; an open one has no end) overlaps the window, or the oldest
    retained event is later than its start. Gaps and hits meet predictions on equal keys and by range.
    ``now_us`` is a number, or a scalar subquery (``df.scalar()``).
    """
    now_us = now_us if isinstance(now_us, Column) else F.lit(now_us)
    oldest = events.groupBy("person_id").agg(F.min("us").alias("oldest"))
    covered = gaps.select(F.col("person_id").alias("gp"), "from_us", F.coalesce("to_us", now_us).alias("to_us"))
    inside = (F.col("person_id") == F.col("gp")) & (F.col("from_us") < F.col("end_us")) & (F.col("to_us") > F.col("start_us"))
    gapped = predictions.join(covered, inside, "left_semi").select("person_id", "category", "start_us").distinct().withColumn("gap", F.lit(True))
    seen = events.select(F.col("person_id").alias("ep"), F.col("category").alias("ec"), "us")
    met = (F.col("person_id") == F.col("ep")) & (F.col("category") == F.col("ec")) & (F.col("us") > F.col("start_us")) & (F.col("us") <= F.col("end_us"))
    hits = predictions.join(seen, met, "left_semi").select("person_id", "category", "start_us").distinct().withColumn("hit", F.lit(True))
    key = ["person_id", "category", "start_us"]
    joined = predictions.join(oldest, "person_id", "left").join(gapped, key, "left").join(hits, key, "left")
    expired = F.col("gap").isNotNull() | F.col("oldest").isNull() | (F.col("oldest") > F.col("start_us"))
    return joined.select(*predictions.columns, F.when(expired, "expired").when(F.col("hit"), "hit").when(F.col("end_us") >= now_us, "pending").otherwise("miss").alias("outcome"))


def eligibility(sessioned: DataFrame, labels_: DataFrame, *, visits: int, sessions: int, labels: int) -> DataFrame:
    """(person_id, visits, sessions, labels, reason) of every person: the first quantity that falls short, null if none does.

    The quantities say nothing about scores; exclusions are rows, so that they can be counted.
    """
    seen = sessioned.groupBy("person_id").agg(F.count("*").alias("visits"), F.countDistinct("session_no").alias("sessions"))
    made = labels_.groupBy("person_id").agg(F.count("*").alias("labels"))
    joined = seen.join(made, "person_id", "left").withColumn("labels", F.coalesce("labels", F.lit(0).cast("long")))
    short = F.when(F.col("visits") < visits, "visits").when(F.col("sessions") < sessions, "sessions").when(F.col("labels") < labels, "labels")
    return joined.select("person_id", "visits", "sessions", "labels", short.alias("reason"))


def measured(eligible: DataFrame, predicted: DataFrame, *, challenger: str, reference: str) -> DataFrame:
    """The eligible persons with test rows: ``test_rows``, ``base_rate`` and ``gain``, the reference's Brier score less the challenger's."""
    error = F.pow(F.col("p") - F.col("y"), 2)
    of = lambda model: F.avg(F.when(F.col("model") == model, error))
    per = predicted.groupBy("person_id").agg(
        F.count_if(F.col("model") == reference).alias("test_rows"), F.avg(F.when(F.col("model") == reference, F.col("y"))).alias("base_rate"),
        (of(reference) - of(challenger)).alias("gain"),
    )
    return eligible.join(per, "person_id")


def width_ladder(predicted: DataFrame, shipped: str, *, resamples: int = resampling.RESAMPLES) -> DataFrame:
    """(person_id, against, rows, point, low, high, width): each other model's Brier score less the shipped one's on common rows.

    Rows are resampled, not clusters: the ladder asks how much an interval narrows as two models share more, and a
    handful of clusters would hide that. A row counts for a rung if both models predict it.
    """
    key = ["person_id", "fold", "session_no", "category"]
    error = F.pow(F.col("p") - F.col("y"), 2)
    own = predicted.where(F.col("model") == shipped).select(*key, error.alias("own"))
    other = predicted.where(F.col("model") != shipped).select(*key, F.col("model").alias("against"), error.alias("error"))
    paired = other.join(own, key).select(
        "person_id", "against", F.struct("fold", "session_no", "category").alias("row"), (F.col("error") - F.col("own")).alias("diff"), F.lit(1).alias("one")
    )
    found = resampling.intervals(paired, ["person_id", "against"], "row", "diff", "one", resamples=resamples)
    return found.select("person_id", "against", F.col("clusters").alias("rows"), "point", "low", "high", (F.col("high") - F.col("low")).alias("width"))
