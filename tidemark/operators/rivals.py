"""Rival predictors on rolling folds, threshold choice, fold wins, and multiclass accuracy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PERSON = "person_id"


def base_rates(folded: DataFrame) -> DataFrame:
    """(person_id, fold, base_rate): the share of positives in all earlier folds; 0.5 without any."""
    y = F.col("outcome").cast("double")
    before = Window.partitionBy(PERSON).orderBy("fold").rowsBetween(Window.unboundedPreceding, -1)
    per = folded.groupBy(PERSON, "fold").agg(F.count("*").alias("n"), F.sum(y).alias("pos"))
    return per.select(PERSON, "fold", F.coalesce(F.sum("pos").over(before) / F.sum("n").over(before), F.lit(0.5)).alias("base_rate"))


def keyed_rate(folded: DataFrame, key: Column, name: str, *, smoothing: float = 5.0) -> DataFrame:
    """Rows of ``folded`` with ``name``: the rate of their key in earlier folds, smoothed towards the base rate.

    Keys meet as cells of (person, key, fold), never label by label. Rows of the first window, which none precedes,
    are left out; a key that training has not seen gets the base rate. ``folded`` needs ``base_rate``.
    """
    keyed = folded.withColumn("__key", key.cast("string"))
    cells = keyed.groupBy(PERSON, "__key", "fold").agg(F.count("*").alias("n"), F.sum(F.col("outcome").cast("double")).alias("pos"))
    before = Window.partitionBy(PERSON, "__key").orderBy("fold").rowsBetween(Window.unboundedPreceding, -1)
    known = cells.select(PERSON, "__key", "fold", F.sum("n").over(before).alias("__n"), F.sum("pos").over(before).alias("__pos"))
    joined = keyed.where("fold > 0").join(known, [PERSON, "__key", "fold"], "left")
    zero = F.lit(0.0)
    rate = (F.coalesce("__pos", zero) + smoothing * F.col("base_rate")) / (F.coalesce("__n", zero) + smoothing)
    return joined.withColumn(name, rate).drop("__key", "__n", "__pos")


def same_as_last(folded: DataFrame, *, alpha: float = 0.05) -> DataFrame:
    """Test rows with ``same_as_last``: the category's last outcome in training, as 1 - alpha or alpha."""
    ends = folded.groupBy(PERSON, "category", "fold").agg(F.max_by("outcome", "rn").alias("__end"))
    before = Window.partitionBy(PERSON, "category").orderBy("fold").rowsBetween(Window.unboundedPreceding, -1)
    known = ends.withColumn("__last", F.last("__end", ignorenulls=True).over(before)).drop("__end")
    joined = folded.where("fold > 0").join(known, [PERSON, "category", "fold"])
    p = F.when(F.col("__last").isNull(), F.col("base_rate")).when(F.col("__last"), 1 - alpha).otherwise(alpha)
    return joined.withColumn("same_as_last", p).drop("__last")


def majority_class() -> Column:
    """A hard 1 where more than half of training is positive, else 0."""
    return F.when(F.col("base_rate") > 0.5, 1.0).otherwise(0.0)


def chosen_threshold(curve: DataFrame, *, target: float = 0.9, least: int = 20) -> DataFrame:
    """The lowest threshold of each model whose Wilson bound reaches ``target`` on ``least`` answers.

    Where none does, the strictest threshold, with target_met false. ``curve`` is that of accuracy_coverage.
    """
    good = (F.col("wilson") >= target) & (F.col("answered") >= least)
    lowest, last = F.min(F.when(good, F.col("threshold"))), F.max("threshold")
    per = curve.groupBy("model").agg(F.coalesce(lowest, last).alias("threshold"), lowest.isNotNull().alias("target_met"))
    return curve.join(per, ["model", "threshold"]).select("model", "threshold", "target_met", "answered", "accuracy", "coverage", "wilson")


def fold_wins(predicted: DataFrame, challenger: str, reference: str) -> DataFrame:
    """(person_id, wins, folds, tail): folds whose Brier score the challenger lowers, and chance's tail for as many."""
    error = F.pow(F.col("p") - F.col("y"), 2)
    per = predicted.groupBy(PERSON, "fold").agg(
        F.avg(F.when(F.col("model") == challenger, error)).alias("a"), F.avg(F.when(F.col("model") == reference, error)).alias("b")
    )
    counted = per.groupBy(PERSON).agg(F.count_if(F.col("a") < F.col("b")).alias("wins"), F.count("*").alias("folds"))
    # C(folds, k) from C(folds, k - 1), added up from k = wins on
    def step(held, k):
        c = held["c"] * (F.col("folds") - k + 1) / k
        return F.struct(c.alias("c"), (held["s"] + F.when(k >= F.col("wins"), c).otherwise(0.0)).alias("s"))

    first = F.struct(F.lit(1.0).alias("c"), F.when(F.col("wins") == 0, 1.0).otherwise(0.0).alias("s"))
    tail = F.aggregate(F.sequence(F.lit(1), F.col("folds").cast("int")), first, step)["s"] / F.pow(F.lit(2.0), F.col("folds"))
    return counted.withColumn("tail", tail)


def worst_cases(predicted: DataFrame) -> DataFrame:
    """Each person's and model's test row with the largest squared error; ties by fold, session and category."""
    w = Window.partitionBy(PERSON, "model").orderBy(F.desc("error"), "fold", "session_no", "category")
    # errors that differ in the last digits only count as ties
    scored = predicted.withColumn("error", F.round(F.pow(F.col("p") - F.col("y"), 2), 9))
    return scored.withColumn("place", F.row_number().over(w)).where("place = 1").drop("place")


def category_scores(predicted: DataFrame, *, floor: int = 20) -> DataFrame:
    """Brier score of each category and model over all persons, from ``floor`` test rows on."""
    error = F.avg(F.pow(F.col("p") - F.col("y"), 2))
    return predicted.groupBy("category", "model").agg(F.count("*").alias("n"), error.alias("brier")).where(F.col("n") >= floor)


def multiclass_predictions(folded: DataFrame) -> DataFrame:
    """The rows of the test folds of transitions with the answers global_mode, transition_table, bounce_back and constrained_mode.

    Counts are those of all earlier folds. The global mode is the most frequent answer; the transition table's is that
    of the source, its counts smoothed towards the overall shares; ties go by name. The bounce-back is the category
    before the source, and the constrained mode the global one among answers other than the source. What training has
    not seen (a source, or a category to bounce back to) gets the global mode, and so does a first change.
    """

    def running(keys: list[str]) -> DataFrame:
        """Counts of answers before each fold, for every fold that the answer precedes."""
        spine = folded.select(PERSON, "fold").distinct()
        n = folded.groupBy(*keys, "to_category", "fold").agg(F.count("*").alias("c"))
        every = n.select(*keys, "to_category").distinct().join(spine, PERSON)
        w = Window.partitionBy(*keys, "to_category").orderBy("fold").rowsBetween(Window.unboundedPreceding, -1)
        filled = every.join(n, [*keys, "to_category", "fold"], "left").withColumn("n", F.sum("c").over(w)).where("n > 0")
        return filled.select(*keys, "to_category", "fold", "n")

    def best(score):
        return F.min(F.struct((-score).alias("k"), "to_category"))["to_category"]

    overall, conditional = running([PERSON]), running([PERSON, "from_category"])
    mode = overall.groupBy(PERSON, "fold").agg(best(F.col("n")).alias("global_mode"))
    shares = overall.select(PERSON, "to_category", "fold", F.col("n").alias("m"), F.sum("n").over(Window.partitionBy(PERSON, "fold")).alias("all"))
    smoothed = conditional.join(shares, [PERSON, "to_category", "fold"])
    table = smoothed.groupBy(PERSON, "from_category", "fold").agg(best(F.col("n") * F.col("all") + F.col("m")).alias("likely"))
    sources = folded.select(PERSON, "from_category").distinct()
    other = overall.join(sources, PERSON).where("to_category <> from_category")
    constrained = other.groupBy(PERSON, "from_category", "fold").agg(best(F.col("n")).alias("constrained"))
    known = overall.select(PERSON, "fold", F.col("to_category").alias("previous_category"), F.lit(True).alias("known"))
    test = folded.where("fold > 0").join(mode, [PERSON, "fold"]).join(table, [PERSON, "from_category", "fold"], "left")
    test = test.join(constrained, [PERSON, "from_category", "fold"], "left").join(known, [PERSON, "fold", "previous_category"], "left")
    return test.select(
        *folded.columns, "global_mode", F.coalesce("likely", "global_mode").alias("transition_table"),
        F.when(F.col("known"), F.col("previous_category")).otherwise(F.col("global_mode")).alias("bounce_back"),
        F.coalesce("constrained", "global_mode").alias("constrained_mode"),
    )


def multiclass_accuracy(folded: DataFrame) -> DataFrame:
    """Accuracy of the answers of :func:`multiclass_predictions`, for each person."""
    right = lambda c: F.avg((F.col(c) == F.col("to_category")).cast("double")).alias(c)
    names = ("global_mode", "transition_table", "bounce_back", "constrained_mode")
    return multiclass_predictions(folded).groupBy(PERSON).agg(F.count("*").alias("n"), *map(right, names))
