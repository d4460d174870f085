"""The registered queries: operators composed over the driver's tables, with a 12-hour session timeout and a 24-hour horizon."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.functions.columns import registrable_domain, resolve
from tidemark.operators import distributions, evaluation, labels, models, patterns, resampling, rivals, sessions, studies
from tidemark.sources.events import from_event_table

TIMEOUT, HORIZON = 43_200, 24


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_event_table(table(spark, sf_dir, "events"))


def sessioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.sessionise(events(spark, sf_dir), timeout_seconds=TIMEOUT)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, since engines add in different orders; adding 0 removes negative zeros."""
    return df.select(*((F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def session_boundaries(spark, sf_dir):
    return sessioned(spark, sf_dir).select("person_id", "event_id", "session_no", "session_start")


def session_shape(spark, sf_dir):
    return rounded(sessions.session_shapes(sessioned(spark, sf_dir)))


def return_labels(spark, sf_dir):
    return labels.return_labels(sessioned(spark, sf_dir), horizon_hours=HORIZON).select("person_id", "category", "session_no", "window_end", "outcome")


def feature_vector_fs3(spark, sf_dir):
    return rounded(labels.return_features(sessioned(spark, sf_dir), horizon_hours=HORIZON))


def feature_vector_fs2(spark, sf_dir):
    return rounded(labels.return_features(sessioned(spark, sf_dir), horizon_hours=HORIZON, feature_set="fs_2"))


def migrated_features(spark, sf_dir):
    """Rows of the older feature set carried to the newer one: those that it would have made."""
    return rounded(labels.migrate_features(labels.return_features(sessioned(spark, sf_dir), horizon_hours=HORIZON, feature_set="fs_2")))


def category_base_rate(spark, sf_dir):
    made = labels.return_labels(sessioned(spark, sf_dir), horizon_hours=HORIZON)
    y = F.col("outcome").cast("double")
    return rounded(made.groupBy("category").agg(F.count("*").alias("n"), F.avg(y).alias("rate")))


def visit_engaged(spark, sf_dir):
    return rounded(labels.engaged_labels(sessioned(spark, sf_dir)))


def browsing_next_hour(spark, sf_dir):
    return rounded(labels.presence_labels(events(spark, sf_dir)))


def calendar_blocks(spark, sf_dir):
    return labels.day_grid(events(spark, sf_dir)).select("person_id", "category", "day", "n")


def block_volume(spark, sf_dir):
    return rounded(labels.block_labels(labels.day_grid(events(spark, sf_dir))))


def novelty(spark, sf_dir):
    return labels.novelty(events(spark, sf_dir), lookback_days=7)


def novelty_summary(spark, sf_dir):
    """Per person: judged days, the share with a new domain, and the mean number of new ones."""
    made = labels.novelty(events(spark, sf_dir), lookback_days=7)
    return rounded(made.groupBy("person_id").agg(
        F.count("*").alias("labels"), F.avg((F.col("n_new") > 0).cast("double")).alias("base_rate"), F.avg("n_new").alias("mean_new_domains")
    ))


def dormancy(spark, sf_dir):
    return labels.dormancy(labels.day_grid(events(spark, sf_dir)))


def category_transitions(spark, sf_dir):
    return sessions.category_transitions(sessioned(spark, sf_dir)).drop("us")


def transition_table(spark, sf_dir):
    return rounded(evaluation.transition_table(sessions.category_transitions(sessioned(spark, sf_dir))))


def next_category_ranking(spark, sf_dir):
    made = evaluation.transition_table(sessions.category_transitions(sessioned(spark, sf_dir)))
    ranked = evaluation.next_category_ranking(rounded(made))
    return ranked.select("person_id", "from_category", F.array_join("ranking", ",").alias("ranking"))


def gap_percentiles(spark, sf_dir):
    return rounded(distributions.gap_percentiles(events(spark, sf_dir)), 3)


def gap_histogram(spark, sf_dir):
    return distributions.gap_histogram(events(spark, sf_dir))


def visits_per_day(spark, sf_dir):
    return distributions.visits_per_day(events(spark, sf_dir))


def domain_coverage(spark, sf_dir):
    return rounded(distributions.ranked_domains(events(spark, sf_dir)))


def concentration(spark, sf_dir):
    return rounded(distributions.concentration(events(spark, sf_dir)))


def session_spread(spark, sf_dir):
    return distributions.session_spread(sessioned(spark, sf_dir))


def browsing_summary(spark, sf_dir):
    return rounded(distributions.browsing_summary(sessioned(spark, sf_dir)))


def day_of_week_rates(spark, sf_dir):
    return rounded(distributions.weekday_rates(labels.return_labels(sessioned(spark, sf_dir), horizon_hours=HORIZON)))


def url_domains(spark, sf_dir):
    domain = registrable_domain(F.col("url"))
    category, source = resolve(domain)
    return table(spark, sf_dir, "pages").select("page_id", domain.alias("domain"), category.alias("category"), source.alias("layer"))


def unknown_rate(spark, sf_dir):
    category, _ = resolve(registrable_domain(F.col("url")))
    return rounded(table(spark, sf_dir, "pages").select(category.alias("c")).agg(F.avg((F.col("c") == "unknown").cast("double")).alias("rate"), F.count("*").alias("n")))


def association_rules(spark, sf_dir):
    sets = patterns.item_sets(sessioned(spark, sf_dir), ["person_id", "session_no"], "category")
    return rounded(patterns.association_rules(sets, ["person_id"], support=5, confidence=0.3, lift=1.0).drop("n_sets"))


def basket_rules(spark, sf_dir):
    """The rules over orders: a basket holds the months in which an order's lines ship."""
    lines = table(spark, sf_dir, "lineitem").select(F.lit(1).alias("all"), "l_orderkey", F.date_format("l_shipdate", "MM").alias("month"))
    sets = patterns.item_sets(lines, ["all", "l_orderkey"], "month")
    return rounded(patterns.association_rules(sets, ["all"], support=5, confidence=0.1, lift=0.5).drop("all", "n_sets"))


def jaccard_links(spark, sf_dir):
    return rounded(patterns.jaccard_links(sessioned(spark, sf_dir), least=2, threshold=0.4))


def cooccurrence_clusters(spark, sf_dir):
    return patterns.clusters(patterns.jaccard_links(sessioned(spark, sf_dir), least=2, threshold=0.4))


def folded(spark, sf_dir):
    return evaluation.rolling_folds(labels.return_labels(sessioned(spark, sf_dir), horizon_hours=HORIZON))


def rolling_origin_folds(spark, sf_dir):
    return folded(spark, sf_dir).select("person_id", "category", "session_no", "rn", "fold", "train_stop")


def predictions(spark, sf_dir):
    return evaluation.long_predictions(evaluation.baselines(folded(spark, sf_dir)))


def baseline_predictions(spark, sf_dir):
    return rounded(predictions(spark, sf_dir).select("person_id", "category", "session_no", "fold", "model", "p", "y"))


def baseline_scores(spark, sf_dir):
    return rounded(evaluation.scores(predictions(spark, sf_dir)))


def reliability_curve(spark, sf_dir):
    return rounded(evaluation.reliability(predictions(spark, sf_dir)), 5)


def calibration_errors(spark, sf_dir):
    return rounded(evaluation.calibration_errors(evaluation.reliability(predictions(spark, sf_dir))), 5)


def accuracy_coverage(spark, sf_dir):
    return rounded(evaluation.accuracy_coverage(predictions(spark, sf_dir)))


def _gaps(rows):
    """Collection is on while events of a type other than ``view`` arrive."""
    return studies.coverage_gaps(rows.select("person_id", "event_id", "us", (F.col("category") != "view").alias("on")))


def prediction_resolution(spark, sf_dir):
    """Predictions of all return labels, settled at the last event; coverage gaps are those of :func:`coverage_gaps`."""
    rows = events(spark, sf_dir)
    made = labels.return_labels(sessions.sessionise(rows, timeout_seconds=TIMEOUT), horizon_hours=HORIZON)
    asked = made.select("person_id", "category", F.col("window_end").alias("start_us"), (F.col("window_end") + HORIZON * schemas.HOUR).alias("end_us"))
    return evaluation.resolve_predictions(asked, rows, _gaps(rows), rows.agg(F.max("us")).scalar())


def scorecard(spark, sf_dir):
    return prediction_resolution(spark, sf_dir).groupBy("person_id").agg(*(F.count_if(F.col("outcome") == x).alias(x) for x in ("hit", "miss", "pending", "expired")))


def role_transitions(spark, sf_dir):
    """Runs of roles in conversations: a conversation is a person, a turn an instant."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("person_id"), F.col("turn").alias("event_id"), F.col("turn").alias("us"), F.col("role").alias("category"), F.lit(1).alias("session_no"))
    return sessions.category_transitions(turns).groupBy("from_category", "to_category").agg(F.count("*").alias("n"), F.sum("from_run_events").alias("run_events"))


def logistic_backtest(spark, sf_dir):
    made = evaluation.rolling_folds(labels.return_features(sessioned(spark, sf_dir), horizon_hours=HORIZON))
    return rounded(models.backtest(made, schemas.FS_3, nullable=schemas.NULLABLE["fs_3"]))


def platt_calibration(spark, sf_dir):
    """Brier score of the logistic predictions of each person, raw and calibrated on the folds before."""
    made = evaluation.rolling_folds(labels.return_features(sessioned(spark, sf_dir), horizon_hours=HORIZON))
    found = models.calibrate(models.backtest(made, schemas.FS_3, nullable=schemas.NULLABLE["fs_3"]))
    miss = lambda c: F.avg(F.pow(F.col(c) - F.col("y"), 2))
    return rounded(found.groupBy("person_id").agg(F.count("*").alias("n"), miss("raw").alias("brier_raw"), miss("p").alias("brier_calibrated")))


def calibrated_backtest(spark, sf_dir):
    """Brier score and calibration error of each person's model before and after Platt's sigmoid, from nested 70/30 splits."""
    made = evaluation.rolling_folds(labels.return_features(sessioned(spark, sf_dir), horizon_hours=HORIZON))
    found = models.calibrated_backtest(made, schemas.FS_3, nullable=schemas.NULLABLE["fs_3"]).where("category <> 'unknown'")
    long = F.explode(F.array(*(F.struct(F.lit(m).alias("model"), F.col(c).alias("p")) for m, c in (("raw", "raw"), ("calibrated", "p"))))).alias("s")
    stacked = found.select("person_id", "y", "n_fit", "n_calibration", long).select("person_id", "y", "n_fit", "n_calibration", "s.model", "s.p")
    bins = stacked.withColumn("bin", F.least(F.floor(F.col("p") * 10), F.lit(9))).groupBy("person_id", "model", "bin").agg(
        F.count("*").alias("n"), F.avg("p").alias("mean_p"), F.avg("y").alias("rate"), F.sum(F.pow(F.col("p") - F.col("y"), 2)).alias("error"),
        F.max("n_calibration").alias("n_calibration"),
    )
    gap = F.abs(F.col("mean_p") - F.col("rate"))
    return rounded(bins.groupBy("person_id", "model").agg(
        F.sum("n").alias("n"), (F.sum("error") / F.sum("n")).alias("brier"), (F.sum(F.col("n") * gap) / F.sum("n")).alias("ece"), F.max(gap).alias("mce"),
        F.max("n_calibration").alias("n_calibration"),
    ))


def convergence_budget(spark, sf_dir):
    """Brier score and log loss over all persons' test rows after so many steps, from one training."""
    made = evaluation.rolling_folds(labels.return_features(sessioned(spark, sf_dir), horizon_hours=HORIZON))
    found = models.budgets(made, schemas.FS_3, (500, 1000, 2000, 4000), nullable=schemas.NULLABLE["fs_3"]).where("category <> 'unknown'")
    q = F.least(F.greatest("p", F.lit(1e-6)), F.lit(1 - 1e-6))
    loss = -(F.col("y") * F.ln(q) + (1 - F.col("y")) * F.ln(1 - q))
    return rounded(found.groupBy("steps").agg(F.count("*").alias("n"), F.avg(F.pow(F.col("p") - F.col("y"), 2)).alias("brier"), F.avg(loss).alias("log_loss")))


def resumed_models(spark, sf_dir):
    """Every person's model of all labels, trained in two chunks with the table of models between them."""
    rows = labels.return_features(sessioned(spark, sf_dir), horizon_hours=HORIZON)
    options = {"feature_set": "fs_3", "chunk": 1000, "total": 2000, "nullable": schemas.NULLABLE["fs_3"]}
    held = models.advance(rows, spark.createDataFrame([], models.MODEL), schemas.FS_3, **options).checkpoint()
    return rounded(models.advance(rows, held, schemas.FS_3, **options).select("person_id", "n_rows", "steps", "settled", "bias"))


def brier_bootstrap(spark, sf_dir):
    return evaluation.brier_bootstrap(predictions(spark, sf_dir), challenger="category_rate", reference="base_rate", resamples=10_000)


def redirect_confusion(spark, sf_dir):
    """A short dwell stands for a redirect: the table has no transition flags."""
    rows = events(spark, sf_dir).withColumn("redirect", F.col("dwell_seconds") < 10)
    return rounded(studies.redirect_confusion(rows, tuple(k * schemas.HOUR for k in (1, 2, 4, 8, 12, 24, 48))))


def engagement_gate(spark, sf_dir):
    made = sessioned(spark, sf_dir)
    return studies.engagement_gate(made, labels.engaged_labels(made), visits=60, sessions=15, labels=20)


def label_volume_day(spark, sf_dir):
    return studies.label_volume(events(spark, sf_dir), bucket_us=schemas.DAY, horizon_hours=HORIZON)


def label_volume_window(spark, sf_dir):
    return studies.label_volume(events(spark, sf_dir), bucket_us=6 * schemas.HOUR, horizon_hours=HORIZON)


def excursion_share(spark, sf_dir):
    made = evaluation.rolling_folds(labels.return_features(sessioned(spark, sf_dir), horizon_hours=HORIZON))
    return rounded(studies.excursions(made, ("hoursSinceLastSeen", "eventCount30d", "priorSessionRate")))


def spearman_dwell(spark, sf_dir):
    """Per category, over persons: does the number of visits go with the mean dwell?"""
    per = events(spark, sf_dir).groupBy("category", "person_id").agg(F.count("*").alias("n"), F.avg("dwell_seconds").alias("dwell"))
    return rounded(studies.spearman(per, ["category"], "n", "dwell"))


def top_k_accuracy(spark, sf_dir):
    return rounded(studies.top_k(sessions.category_transitions(sessioned(spark, sf_dir))))


def retention_split(spark, sf_dir):
    rows = events(spark, sf_dir)
    return studies.retention(rows, keep_days=14, now_us=rows.agg(F.max("us")).scalar())


def coverage_gaps(spark, sf_dir):
    return _gaps(events(spark, sf_dir))


def accuracy_interval(spark, sf_dir):
    """How far the transition table's accuracy lies above the global mode's, for each person; sessions are resampled."""
    made = evaluation.rolling_folds(sessions.category_transitions(sessioned(spark, sf_dir)), order=("us", "event_id"))
    test = rivals.multiclass_predictions(made)
    right = lambda c: (F.col(c) == F.col("to_category")).cast("double")
    sums = test.groupBy("person_id", "session_no").agg(F.sum(right("transition_table") - right("global_mode")).alias("diff"), F.count("*").alias("n"))
    rows = test.groupBy("person_id").agg(F.count("*").alias("rows"))
    found = resampling.intervals(sums, ["person_id"], "session_no", "diff", "n").join(rows, "person_id")
    return rounded(found.withColumn("excludes_zero", resampling.excludes_zero()).withColumn("rows_to_exclude_zero", resampling.rows_to_exclude_zero("rows")))


def population_interval(spark, sf_dir):
    """The mean over persons of the category rate's gain in Brier score over the base rate; persons are resampled."""
    error = F.pow(F.col("p") - F.col("y"), 2)
    gain = F.avg(F.when(F.col("model") == "base_rate", error)) - F.avg(F.when(F.col("model") == "category_rate", error))
    per = predictions(spark, sf_dir).groupBy("person_id").agg(gain.alias("gain")).select(F.lit("all").alias("population"), "person_id", "gain", F.lit(1).alias("one"))
    return rounded(resampling.intervals(per, ["population"], "person_id", "gain", "one"))


ALL = (
    redirect_confusion, engagement_gate, label_volume_day, label_volume_window, excursion_share, spearman_dwell, top_k_accuracy, retention_split, coverage_gaps,
    session_boundaries, session_shape, return_labels, feature_vector_fs3, category_base_rate, visit_engaged, browsing_next_hour, calendar_blocks,
    block_volume, novelty, dormancy, category_transitions, transition_table, next_category_ranking, gap_percentiles, gap_histogram, visits_per_day,
    domain_coverage, concentration, session_spread, browsing_summary, day_of_week_rates, url_domains, unknown_rate, association_rules, basket_rules,
    jaccard_links, cooccurrence_clusters, rolling_origin_folds, baseline_predictions, baseline_scores, reliability_curve, calibration_errors,
    accuracy_coverage, prediction_resolution, scorecard, role_transitions, logistic_backtest, platt_calibration, brier_bootstrap,
    accuracy_interval, population_interval, calibrated_backtest, novelty_summary, convergence_budget,
    resumed_models, feature_vector_fs2, migrated_features,
)
