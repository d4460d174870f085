"""Registered queries over rivals, cards, blocks and whole-history studies."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.functions.columns import registrable_domain, resolve
from tidemark.operators import blocks, cards, distributions, evaluation, labels, patterns, rivals, sessions, studies
from tidemark.plans.queries import HORIZON, events, folded, prediction_resolution, predictions, rounded, sessioned, table

MODELS = ("base_rate", "majority_class", "time_of_day", "same_as_last")


def _rivals(spark, sf_dir):
    made = folded(spark, sf_dir)
    based = made.join(rivals.base_rates(made), ["person_id", "fold"])
    bucket = F.floor(F.pmod(F.floor(F.col("window_end") / schemas.HOUR), F.lit(24)) / 6)
    timed = rivals.keyed_rate(based, bucket, "time_of_day")
    last = rivals.same_as_last(based).select("person_id", "rn", "same_as_last")
    return timed.join(last, ["person_id", "rn"]).withColumn("majority_class", rivals.majority_class())


def rival_predictions(spark, sf_dir):
    return rounded(_rivals(spark, sf_dir).select("person_id", "category", "session_no", "fold", *MODELS))


def rivals_and_rates(spark, sf_dir):
    """Long predictions of the rivals and of the category rate."""
    return evaluation.long_predictions(_rivals(spark, sf_dir), MODELS[1:]).unionByName(predictions(spark, sf_dir))


def rival_scores(spark, sf_dir):
    return rounded(evaluation.scores(evaluation.long_predictions(_rivals(spark, sf_dir), MODELS)))


def domain_rate(spark, sf_dir):
    """The rival of visit_engaged: the rate of the visit's domain in earlier folds."""
    rows = sessioned(spark, sf_dir)
    made = labels.engaged_labels(rows).join(rows.select("person_id", "event_id", "domain"), ["person_id", "event_id"])
    made = evaluation.rolling_folds(made.select("person_id", "event_id", "domain", "window_end", "outcome"), order=("window_end", "event_id"))
    based = made.join(rivals.base_rates(made), ["person_id", "fold"])
    return rounded(rivals.keyed_rate(based, F.col("domain"), "p").select("person_id", "event_id", "fold", "base_rate", "p"))


def presence_rivals(spark, sf_dir):
    """The rivals of browsing_next_hour: whether the last hour was active, and the rhythm of the same hour."""
    made = labels.presence_labels(events(spark, sf_dir)).select("person_id", "hour", "outcome", "visitsLastHour", "sameHourRate7d")
    made = evaluation.rolling_folds(made, order=("hour",))
    based = made.join(rivals.base_rates(made), ["person_id", "fold"])
    kept = rivals.keyed_rate(based, F.col("visitsLastHour") > 0, "persistence").withColumn("rhythm", F.coalesce("sameHourRate7d", "base_rate"))
    return rounded(kept.select("person_id", "hour", "fold", "persistence", "rhythm"))


def threshold_choice(spark, sf_dir):
    curve = evaluation.accuracy_coverage(predictions(spark, sf_dir))
    return rounded(rivals.chosen_threshold(curve, target=0.6))


def fold_wins(spark, sf_dir):
    return rounded(rivals.fold_wins(predictions(spark, sf_dir), "category_rate", "base_rate"))


def worst_cases(spark, sf_dir):
    return rounded(rivals.worst_cases(predictions(spark, sf_dir)).select("person_id", "model", "fold", "session_no", "category", "p", "y", "error"))


def category_scores(spark, sf_dir):
    return rounded(rivals.category_scores(predictions(spark, sf_dir)))


def _changes(spark, sf_dir):
    return sessions.category_transitions(sessioned(spark, sf_dir))


def multiclass_accuracy(spark, sf_dir):
    made = evaluation.rolling_folds(_changes(spark, sf_dir), order=("us", "event_id"))
    return rounded(rivals.multiclass_accuracy(made))


def topic_board(spark, sf_dir):
    return rounded(cards.topic_board(_changes(spark, sf_dir), least=5))


def next_category_card(spark, sf_dir):
    return rounded(cards.next_category_card(_changes(spark, sf_dir)))


def hub_topic(spark, sf_dir):
    return cards.hub_topic(cards.topic_board(_changes(spark, sf_dir), least=5))


def board_readiness(spark, sf_dir):
    return cards.board_readiness(_changes(spark, sf_dir), least=5)


def scorecard_accuracy(spark, sf_dir):
    """The scorecard of predictions whose probability is the category's rate over all persons."""
    made = labels.return_labels(sessioned(spark, sf_dir), horizon_hours=HORIZON)
    rate = made.groupBy("category").agg(F.avg(F.col("outcome").cast("double")).alias("p"))
    return rounded(cards.scorecard(prediction_resolution(spark, sf_dir).join(rate, "category")))


def _zone_blocks(kind):
    def query(spark, sf_dir):
        return blocks.calendar_blocks(events(spark, sf_dir), kind=kind, offset_minutes=330)

    query.__name__ = f"blocks_{kind}"
    return query


def block_volume_stats(spark, sf_dir):
    return blocks.block_volume_stats(labels.day_grid(events(spark, sf_dir)))


def absorbed_boundaries(spark, sf_dir):
    return blocks.absorbed_boundaries(sessioned(spark, sf_dir))


def next_session_floors(spark, sf_dir):
    return rounded(blocks.next_session_floors(sessions.session_shapes(sessioned(spark, sf_dir))))


def label_volume_session(spark, sf_dir):
    return blocks.session_label_volume(sessioned(spark, sf_dir), horizon_hours=HORIZON)


def label_definitions(spark, sf_dir):
    rows = events(spark, sf_dir)
    parts = {f"{h}h": studies.label_volume(rows, bucket_us=h * schemas.HOUR, horizon_hours=HORIZON) for h in (3, 6, 12, 24)}
    return blocks.label_definitions(parts | {"session": label_volume_session(spark, sf_dir)})


def proxy_categories(spark, sf_dir):
    rows = blocks.proxy_categories(events(spark, sf_dir), 6)
    return rows.groupBy("person_id", "category").agg(F.count("*").alias("n"))


def counterfactual_labels(spark, sf_dir):
    """Return labels if the three head domains were topics of their own, one topic, or none."""
    rows = events(spark, sf_dir)
    ways = {"as_is": rows, "separate": blocks.relabelled(rows, 3, merged=False), "merged": blocks.relabelled(rows, 3, merged=True)}
    out = None
    for way, made in ways.items():
        made = labels.return_labels(sessions.sessionise(made, timeout_seconds=43_200), horizon_hours=HORIZON)
        own = made.agg(F.count("*").alias("n"), F.avg(F.col("outcome").cast("double")).alias("rate")).select(F.lit(way).alias("way"), "n", "rate")
        out = own if out is None else out.unionByName(own)
    return rounded(out)


def unknown_domains(spark, sf_dir):
    """Pages of domains that no rule places, ranked."""
    domain = registrable_domain(F.col("url"))
    category, _ = resolve(domain)
    rows = table(spark, sf_dir, "pages").select(domain.alias("domain"), category.alias("category")).where("category = 'unknown' and domain is not null")
    return rows.groupBy("domain").agg(F.count("*").alias("n"))


def dwell_histogram(spark, sf_dir):
    return blocks.histogram(events(spark, sf_dir), "category", "dwell_seconds")


def feature_null_shares(spark, sf_dir):
    made = labels.return_features(sessioned(spark, sf_dir), horizon_hours=HORIZON)
    return rounded(blocks.null_shares(made, schemas.FS_3))


def domain_shift(spark, sf_dir):
    return rounded(blocks.domain_shift(events(spark, sf_dir)))


def latest_events(spark, sf_dir):
    return blocks.latest_events(events(spark, sf_dir)).select("person_id", "event_id", "us", "category", "place")


def fresh_predictions(spark, sf_dir):
    """Predictions that the settled ones don't hold yet: an anti join on person, category and start."""
    known = prediction_resolution(spark, sf_dir)
    settled = known.where("outcome in ('hit', 'miss')").select("person_id", "category", "start_us")
    return known.select("person_id", "category", "start_us", "end_us").join(settled, ["person_id", "category", "start_us"], "left_anti")


def rule_summary(spark, sf_dir):
    sets = patterns.item_sets(sessioned(spark, sf_dir), ["person_id", "session_no"], "category")
    rules = patterns.association_rules(sets, ["person_id"], support=5, confidence=0.3, lift=1.0)
    return rounded(blocks.rule_summary(rules, sets))


def gap_valley(spark, sf_dir):
    return rounded(distributions.gap_valley(events(spark, sf_dir)))


def kept_domains(spark, sf_dir):
    """Domains that a person visits in both halves of the history."""
    first, second = distributions.history_halves(events(spark, sf_dir))
    return first.intersect(second)


def dropped_domains(spark, sf_dir):
    """Domains of the first half of a person's history that the second lacks."""
    first, second = distributions.history_halves(events(spark, sf_dir))
    return first.subtract(second)


ALL = (
    rival_predictions, rival_scores, domain_rate, presence_rivals, threshold_choice, fold_wins, worst_cases, category_scores, multiclass_accuracy,
    topic_board, next_category_card, hub_topic, board_readiness, scorecard_accuracy, *map(_zone_blocks, blocks.KINDS), block_volume_stats,
    absorbed_boundaries, next_session_floors, label_volume_session, label_definitions, proxy_categories, counterfactual_labels, unknown_domains,
    dwell_histogram, feature_null_shares, domain_shift, latest_events, fresh_predictions, rule_summary, gap_valley, kept_domains, dropped_domains,
)
