"""What an import of browser history keeps: ordered verdicts over the visit graph, and how they compare with the truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import registrable_domain
from tidemark.sources.events import is_redirect, is_visible

#: Visits that one referrer has at least to be dealt to several tasks.
HUB = 10_000

#: The verdicts in order, the reasons of a preparation in order, the longest gap of a redirect.
VERDICTS = ("api-hidden", "out-of-window", "subframe", "redirect", "not-web", "kept")
REASONS = ("malformed", "out-of-window", "subframe", "redirect", "not-web", "kept")
REDIRECT_GAP_US = 50_000


def _subframe(transition: Column) -> Column:
    return transition.bitwiseAND(F.lit(255)).isin(3, 4)


def _copied(times: DataFrame, hubs: DataFrame, salt: int) -> DataFrame:
    """(__p, __v, __at, __s): a row for each visit of ``times``, ``salt`` rows for each of ``hubs``."""
    joined = times.select(F.col("person_id").alias("__p"), F.col("visit_id").alias("__v"), "__at").join(F.broadcast(hubs), ["__p", "__v"], "left")
    last = F.when(F.col("__hub"), F.lit(salt - 1)).otherwise(F.lit(0))
    return joined.select("__p", "__v", "__at", F.explode(F.sequence(F.lit(0), last)).alias("__s"))


def with_gap(visits: DataFrame, referrers: DataFrame | None = None, *, salt: int = 16, hub: int = HUB) -> DataFrame:
    """``visits`` (person_id, visit_id, from_visit, us, …) with ``gap``: the time since the referring visit; null if unknown.

    Only referrers among ``referrers`` (default: all visits) count, of the same person; a null or zero referrer is none
    and doesn't travel. A visit that refers ``hub`` others or more is one row that ``salt`` tasks get, so that none of
    them meets all its children. Of such visits there is one in ``hub`` at most, so every task may hold their table; the
    referrers themselves are never broadcast, as their number grows with the visits.
    """
    known = visits if referrers is None else referrers
    times = known.where("visit_id is not null").groupBy("person_id", "visit_id").agg(F.max("us").alias("__at"))
    referred = F.coalesce(F.col("from_visit") != 0, F.lit(False))
    children = visits.where(referred).groupBy(F.col("person_id").alias("__p"), F.col("from_visit").alias("__v")).agg(F.count("*").alias("__n"))
    hubs = children.where(F.col("__n") >= hub).select("__p", "__v", F.lit(True).alias("__hub"))
    marked = hubs.select(F.col("__p").alias("__hp"), F.col("__v").alias("__hv"), "__hub")
    own = (F.col("person_id") == F.col("__hp")) & (F.col("from_visit") == F.col("__hv"))
    part = F.when(F.col("__hub"), F.pmod(F.xxhash64("visit_id", "us"), F.lit(salt)).cast("int")).otherwise(F.lit(0))
    some = visits.where(referred).join(F.broadcast(marked), own, "left").withColumn("__salt", part).drop("__hp", "__hv", "__hub")
    met = (F.col("person_id") == F.col("__p")) & (F.col("from_visit") == F.col("__v")) & (F.col("__salt") == F.col("__s"))
    joined = some.join(_copied(times, hubs, salt).hint("merge"), met, "left").withColumn("gap", F.col("us") - F.col("__at")).drop("__p", "__v", "__s", "__at", "__salt")
    return joined.unionByName(visits.where(~referred).withColumn("gap", F.lit(None).cast("long")))


def likely_redirect(limit_us: int = REDIRECT_GAP_US) -> Column:
    return F.coalesce(F.col("gap").between(0, limit_us), F.lit(False))


def prepare(visits: DataFrame, *, start_us: int | Column, end_us: int | Column, limit_us: int = REDIRECT_GAP_US) -> DataFrame:
    """``visits`` with ``verdict``: the first of REASONS that holds, ``kept`` for the others. Nothing is dropped.

    Visits of no time or URL are malformed. A redirect is one within ``limit_us`` of its referrer; a referrer that
    isn't among the visits can't be judged, and its visit stays.
    """
    timed = with_gap(visits)
    verdict = (
        F.when(F.col("url").isNull() | F.col("us").isNull(), "malformed").when(~F.col("us").between(start_us, end_us), "out-of-window")
        .when(_subframe(F.col("transition")), "subframe").when(likely_redirect(limit_us), "redirect")
        .when(registrable_domain(F.col("url")).isNull(), "not-web").otherwise("kept")
    )
    return timed.withColumn("verdict", verdict)


def simulate(visits: DataFrame, *, start_us: int | Column, end_us: int | Column, limit_us: int = REDIRECT_GAP_US) -> DataFrame:
    """The visits of pages that a person saw in the window, with ``verdict``: what the history API hides, then what an import skips.

    The API offers a page if one of its visits in the window is visible, and then hands over all its visits.
    Referrers are looked up among what it hands over, as an import has no others.
    """
    page = ["person_id", "url"]
    inside = visits.withColumn("__inside", F.col("us").between(start_us, end_us))
    shown = F.col("__inside") & is_visible(F.col("transition"))
    flags = inside.groupBy(*page).agg(F.max("__inside").alias("seen"), F.max(shown).alias("offered")).where("seen")
    corpus = visits.join(flags.select(*page, "offered"), page)
    fetched = with_gap(corpus.where("offered"))
    verdict = (
        F.when(~F.col("us").between(start_us, end_us), "out-of-window").when(_subframe(F.col("transition")), "subframe")
        .when(likely_redirect(limit_us), "redirect").when(registrable_domain(F.col("url")).isNull(), "not-web").otherwise("kept")
    )
    hidden = corpus.where(~F.col("offered")).withColumn("gap", F.lit(None).cast("long")).withColumn("verdict", F.lit("api-hidden"))
    return fetched.withColumn("verdict", verdict).unionByName(hidden).drop("offered")


def crosstab(judged: DataFrame) -> DataFrame:
    """(truth, one column for each verdict): redirect hops by the browser's own flags, and navigations that were chosen."""
    truth = F.when(is_redirect(F.col("transition")), "redirect hop").otherwise("chosen navigation")
    return judged.groupBy(truth.alias("truth")).agg(*(F.count_if(F.col("verdict") == v).alias(v.replace("-", "_")) for v in VERDICTS))


def compare_domains(judged: DataFrame, exported: DataFrame) -> DataFrame:
    """One row: events and domains of what an import would keep and of an export, domains of one side, and the L1 distance.

    ``exported`` has a domain for each event.
    """
    count = lambda df, name: df.groupBy("domain").agg(F.count("*").alias(name))
    kept = judged.where("verdict = 'kept'").select(registrable_domain(F.col("url")).alias("domain"))
    both = count(kept, "a").join(count(exported, "b"), "domain", "full_outer").select("domain", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in "ab"))
    zero = F.lit(0).cast("long")
    total = lambda c: F.coalesce(F.sum(c), zero)
    per = both.agg(
        total(F.col("a")).alias("simulated_events"), total(F.col("b")).alias("exported_events"), F.count_if(F.col("a") > 0).alias("simulated_domains"),
        F.count_if(F.col("b") > 0).alias("exported_domains"), F.count_if(F.col("b") == 0).alias("only_simulated"), F.count_if(F.col("a") == 0).alias("only_exported"),
        total(F.abs(F.col("a") - F.col("b"))).alias("disagreement"),
    )
    return per.withColumn("disagreement_share", F.coalesce(F.col("disagreement") / F.nullif("exported_events", F.lit(0)), F.lit(0.0)))


def redirect_scores(visits: DataFrame, thresholds_us: tuple[int, ...]) -> DataFrame:
    """(threshold_us, tp, fp, fn, tn, precision, recall, f1, resolvable): the gap rule against the browser's flags.

    ``resolvable`` is the share of true redirects whose referrer is among the visits: the ceiling of the recall.
    """
    rows = with_gap(visits).select(is_redirect(F.col("transition")).alias("truth"), "gap")
    each = rows.select("truth", "gap", F.explode(F.array(*map(F.lit, thresholds_us))).alias("threshold_us"))
    said, truth = F.coalesce(F.col("gap").between(F.lit(0), F.col("threshold_us")), F.lit(False)), F.col("truth")
    per = each.groupBy("threshold_us").agg(
        F.count_if(said & truth).alias("tp"), F.count_if(said & ~truth).alias("fp"), F.count_if(~said & truth).alias("fn"), F.count_if(~said & ~truth).alias("tn"),
        (F.count_if(truth & F.col("gap").isNotNull()) / F.nullif(F.count_if(truth), F.lit(0))).alias("resolvable"),
    )
    none = F.lit(0)
    return per.select(
        "*", (F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), none)).alias("precision"), (F.col("tp") / F.nullif(F.col("tp") + F.col("fn"), none)).alias("recall"),
        (2 * F.col("tp") / F.nullif(2 * F.col("tp") + F.col("fp") + F.col("fn"), none)).alias("f1"),
    )
