"""Co-occurrence: item sets, one-to-one association rules and what chance gives, Jaccard links, components, their agreement."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import clustering, sessions
from tidemark.operators.sessions import person_order
from tidemark.operators.work import spread

#: Seed and runs of the null rule band.
SEED, NULL_RUNS = 20260901, 50
#: Items in the sets of a group whose null a task draws itself, and numbers that it works on at once.
HELD, CELLS = 4096, 1 << 20


def item_sets(rows: DataFrame, basket: list[str], item: str, least: int = 2) -> DataFrame:
    """The distinct items of each basket with at least ``least`` of them."""
    return rows.where(F.col(item).isNotNull()).groupBy(*basket).agg(F.sort_array(F.collect_set(item)).alias("items")).where(F.size("items") >= least)


def _pairs(sets: DataFrame, keep: list[str]) -> DataFrame:
    """Each pair a < b of each set, from the set's own array: no self-join of baskets."""
    heads = sets.select(*keep, "items", F.posexplode("items").alias("k", "a"))
    return heads.select(*keep, "a", F.explode(F.expr("slice(items, k + 2, size(items))")).alias("b"))


def association_rules(sets: DataFrame, group: list[str], *, support: int, confidence: float, lift: float) -> DataFrame:
    """Rules a -> b of each group with support, confidence and lift at least as given, in both directions."""
    total = sets.groupBy(*group).agg(F.count("*").alias("n_sets"))
    single = sets.select(*group, F.explode("items").alias("item")).groupBy(*group, "item").agg(F.count("*").alias("n"))
    pair = _pairs(sets, group).groupBy(*group, "a", "b").agg(F.count("*").alias("support")).where(F.col("support") >= support)
    both = pair.select(*group, F.col("a").alias("antecedent"), F.col("b").alias("consequent"), "support").unionByName(pair.select(*group, F.col("b").alias("antecedent"), F.col("a").alias("consequent"), "support"))
    named = both.join(single.select(*group, F.col("item").alias("antecedent"), F.col("n").alias("n_antecedent")), [*group, "antecedent"]).join(
        single.select(*group, F.col("item").alias("consequent"), F.col("n").alias("n_consequent")), [*group, "consequent"]
    ).join(total, group)
    scored = named.withColumn("confidence", F.col("support") / F.col("n_antecedent")).withColumn("lift", F.col("confidence") * F.col("n_sets") / F.col("n_consequent"))
    return scored.where((F.col("confidence") >= confidence) & (F.col("lift") >= lift))


def jaccard_links(sessioned: DataFrame, *, least: int = 3, threshold: float = 0.5) -> DataFrame:
    """(person_id, a, b, shared, jaccard): domains whose sessions overlap; only pairs that share a session arise."""
    member = sessioned.where("domain is not null").select("person_id", "session_no", "domain").distinct()
    size = member.groupBy("person_id", "domain").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    kept = member.join(size, ["person_id", "domain"])
    sets = kept.groupBy("person_id", "session_no").agg(F.sort_array(F.collect_set(F.struct("domain", "n"))).alias("items"))
    shared = _pairs(sets, ["person_id"]).groupBy("person_id", F.col("a.domain").alias("a"), F.col("b.domain").alias("b"), F.col("a.n").alias("n_a"), F.col("b.n").alias("n_b")).agg(F.count("*").alias("shared"))
    return shared.select("person_id", "a", "b", "shared", (F.col("shared") / (F.col("n_a") + F.col("n_b") - F.col("shared"))).alias("jaccard")).where(F.col("jaccard") >= threshold)


def clusters(links: DataFrame) -> DataFrame:
    """(person_id, domain, cluster): components of the links, named by their least domain; singletons have no row.

    Least labels spread along the links until none changes; a person's links are few, the persons many.
    """
    both = links.select("person_id", F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select("person_id", F.col("b").alias("u"), F.col("a").alias("v"))).checkpoint()
    label = both.groupBy("person_id", "u").agg(F.least(F.first("u"), F.min("v")).alias("cluster"))
    while True:
        near = both.join(label.select("person_id", F.col("u").alias("v"), F.col("cluster").alias("c")), ["person_id", "v"]).groupBy("person_id", "u").agg(F.min("c").alias("c"))
        new = label.join(near, ["person_id", "u"]).select("person_id", "u", F.least("cluster", "c").alias("next"), "cluster").checkpoint()
        moved = new.where(F.col("next") != F.col("cluster")).limit(1).count()
        label = new.select("person_id", "u", F.col("next").alias("cluster"))
        if not moved:
            return label.select("person_id", F.col("u").alias("domain"), "cluster")


def uniform(*parts: Column | str) -> Column:
    """A number in (0, 1) that depends on its arguments alone: 52 bits of the MD5 digest of their texts."""
    digest = F.md5(F.concat_ws("|", *(F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts)))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / 2.0**52


def null_sets(sets: DataFrame, group: list[str], basket: list[str], *, runs: int = NULL_RUNS, seed: int = SEED) -> DataFrame:
    """(group, basket, run, items): for each run a set of each basket's size, drawn from its group's items.

    Items are drawn without replacement in proportion to the baskets that hold them: the least of -ln(u) / weight are
    the draw, u a hash of (seed, run, group, basket, item). So a set keeps its exact size.
    """
    weights = sets.select(*group, F.explode("items").alias("item")).groupBy(*group, "item").agg(F.count("*").alias("weight"))
    wanted = sets.select(*group, *basket, F.size("items").alias("wanted"), F.explode(F.sequence(F.lit(1), F.lit(runs))).alias("run"))
    keyed = wanted.join(weights, group).withColumn("key", -F.ln(uniform(F.lit(seed), "run", *group, *basket, "item")) / F.col("weight"))
    place = F.row_number().over(Window.partitionBy(*group, *basket, "run").orderBy("key", "item"))
    kept = keyed.withColumn("place", place).where("place <= wanted")
    return kept.groupBy(*group, *basket, "run").agg(F.sort_array(F.collect_list("item")).alias("items"))


def null_rule_band(
    sets: DataFrame, group: list[str], basket: list[str], *, support: int, confidence: float, lift: float, runs: int = NULL_RUNS, seed: int = SEED,
    level: float = 0.95,
) -> DataFrame:
    """(group, rules, median, low, high): each group's number of rules, and its band over runs of :func:`null_sets`.

    A run without a rule counts as 0. The band's ends are rounded outwards.
    """
    limits = {"support": support, "confidence": confidence, "lift": lift}
    large = sets.groupBy(*group).agg(F.sum(F.size("items")).alias("__n")).where(F.col("__n") > HELD).select(*group)
    if large.isEmpty():
        return _held_band(sets, group, basket, runs, seed, level, limits)
    held = _held_band(sets.join(large, group, "left_anti"), group, basket, runs, seed, level, limits)
    return held.unionByName(_drawn_band(sets.join(large, group, "left_semi"), group, basket, runs, seed, level, limits))


def _held_band(sets: DataFrame, group: list[str], basket: list[str], runs: int, seed: int, level: float, limits: dict) -> DataFrame:
    """:func:`null_rule_band` of groups that a task may hold: it draws the sets of :func:`null_sets` and counts their rules."""
    name = F.concat_ws("|", *(F.col(c).cast("string") for c in (*group, *basket)))
    rows = sets.groupBy(*group).agg(F.collect_list(F.struct(name.alias("name"), F.col("items").cast("array<string>").alias("items"))).alias("sets"))
    tail = 50 * (1 - level)

    def rules(chosen: np.ndarray) -> np.ndarray:
        """The rules of each run; ``chosen`` is (runs, sets, items)."""
        member = chosen.astype(float)
        single, pair = member.sum(axis=1), member.transpose(0, 2, 1) @ member
        with np.errstate(divide="ignore", invalid="ignore"):
            confidence = pair / single[:, :, None]
            lift = confidence * chosen.shape[1] / single[:, None, :]
            good = (pair >= limits["support"]) & (confidence >= limits["confidence"]) & (lift >= limits["lift"])
        good[:, range(pair.shape[1]), range(pair.shape[1])] = False
        return good.sum(axis=(1, 2))

    def of(held: list[dict]) -> tuple[int, float, float, float]:
        items = sorted({i for s in held for i in s["items"]}, key=str.encode)
        if not items:
            return 0, 0.0, 0.0, 0.0
        at = {item: k for k, item in enumerate(items)}
        own = np.zeros((1, len(held), len(items)), bool)
        for k, s in enumerate(held):
            own[0, k, [at[i] for i in s["items"]]] = True
        weight, wanted = own[0].sum(axis=0), own[0].sum(axis=1)
        ends, names = [i.encode() for i in items], [f"{s['name']}|".encode() if s["name"] else b"" for s in held]
        step, counts = max(1, CELLS // own.size), []
        for first in range(1, runs + 1, step):
            some = range(first, min(first + step, runs + 1))
            heads = [f"{seed}|{run}|".encode() + n for run in some for n in names]
            digest = np.frombuffer(b"".join([hashlib.md5(h + end, usedforsecurity=False).digest()[:8] for h in heads for end in ends]), ">u8")
            u = ((digest >> np.uint64(12)).astype(float) + 0.5) / 2.0**52
            order = (-np.log(u).reshape(len(some), len(held), -1) / weight).argsort(axis=2, kind="stable")
            chosen = np.zeros(order.shape, bool)
            np.put_along_axis(chosen, order, np.broadcast_to(np.arange(len(items)) < wanted[None, :, None], order.shape), axis=2)
            counts.append(rules(chosen))
        drawn = np.percentile(np.concatenate(counts), [50, tail, 100 - tail])
        return int(rules(own)[0]), *map(float, drawn)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [of(held) for held in batch.column(batch.schema.get_field_index("sets")).to_pylist()]
            columns = [batch.column(batch.schema.get_field_index(c)) for c in group]
            values = [pa.array([m[k] for m in made], pa.float64() if k else pa.int64()) for k in range(4)]
            yield pa.RecordBatch.from_arrays([*columns, *values], names=[*group, "rules", "median", "low", "high"])

    keys = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in group)
    found = spread(rows, *group).mapInArrow(run, f"{keys}, rules long, median double, low double, high double")
    return found.select(*group, "rules", "median", F.floor(F.round("low", 9)).alias("low"), F.ceil(F.round("high", 9)).alias("high"))


def _drawn_band(sets: DataFrame, group: list[str], basket: list[str], runs: int, seed: int, level: float, limits: dict) -> DataFrame:
    """:func:`null_rule_band` of groups of any size, from a table of the drawn sets."""
    found = association_rules(sets, group, **limits).groupBy(*group).agg(F.count("*").alias("rules"))
    drawn = association_rules(null_sets(sets, group, basket, runs=runs, seed=seed), [*group, "run"], **limits)
    per_run = drawn.groupBy(*group, "run").agg(F.count("*").alias("n"))
    groups = sets.select(*group).distinct()
    spine = groups.withColumn("run", F.explode(F.sequence(F.lit(1), F.lit(runs))))
    counts = spine.join(per_run, [*group, "run"], "left").select(*group, F.coalesce("n", F.lit(0).cast("long")).cast("double").alias("n"))
    band = clustering.band(counts, group, "n", level)
    joined = groups.join(found, group, "left").join(band, group)
    return joined.select(
        *group, F.coalesce("rules", F.lit(0).cast("long")).alias("rules"), "median", F.floor(F.round("low", 9)).alias("low"), F.ceil(F.round("high", 9)).alias("high")
    )


def half_clusters(events: DataFrame, *, timeout_seconds: float, least: int = 3, threshold: float = 0.5) -> DataFrame:
    """(person_id, half, domain, cluster) of the first and second half of each person's events, each clustered alone."""
    order = person_order()
    half = F.when(F.row_number().over(order) <= F.floor(F.count("*").over(Window.partitionBy("person_id")) / 2), 1).otherwise(2)
    halves = events.withColumn("half", half).withColumn("person_id", F.struct("person_id", "half"))  # halves never meet
    links = jaccard_links(sessions.sessionise(halves, timeout_seconds=timeout_seconds), least=least, threshold=threshold)
    return clusters(links).select("person_id.person_id", "person_id.half", "domain", "cluster")


def half_agreement(halves: DataFrame) -> DataFrame:
    """(person_id, items, agreement) over the domains that are clustered in both halves; persons with none have no row."""
    one = lambda half, name: halves.where(F.col("half") == half).select("person_id", "domain", F.col("cluster").alias(name))
    return clustering.agreement(one(1, "first").join(one(2, "second"), ["person_id", "domain"]), ["person_id"], "first", "second")


def cluster_stats(events: DataFrame, *, timeout_seconds: float, least: int = 3, threshold: float = 0.5) -> DataFrame:
    """Per person: domains, events, domains in ``least`` sessions, clusters, clustered domains, their share of the events,
    the largest cluster and the agreement of the two halves (null without two shared domains)."""
    sessioned = sessions.sessionise(events, timeout_seconds=timeout_seconds).where("domain is not null")
    per_domain = sessioned.groupBy("person_id", "domain").agg(F.count("*").alias("n"), F.countDistinct("session_no").alias("sessions"))
    found = clusters(jaccard_links(sessioned, least=least, threshold=threshold))
    joined = per_domain.join(found, ["person_id", "domain"], "left")
    sizes = joined.groupBy("person_id", "cluster").agg(F.count("*").alias("size"), F.sum("n").alias("n"), F.count_if(F.col("sessions") >= least).alias("clusterable"))
    clustered = F.col("cluster").isNotNull()
    stats = sizes.groupBy("person_id").agg(
        F.sum("size").alias("domains"), F.sum("n").alias("events"), F.sum("clusterable").alias("clusterable_domains"), F.count("cluster").alias("clusters"),
        F.coalesce(F.sum(F.when(clustered, F.col("size"))), F.lit(0).cast("long")).alias("clustered_domains"),
        (F.coalesce(F.sum(F.when(clustered, F.col("n"))), F.lit(0).cast("long")) / F.sum("n")).alias("events_covered"),
        F.coalesce(F.max(F.when(clustered, F.col("size"))), F.lit(0).cast("long")).alias("largest_cluster"),
    )
    agreed = half_agreement(half_clusters(events, timeout_seconds=timeout_seconds, least=least, threshold=threshold))
    return stats.join(agreed.select("person_id", F.col("agreement").alias("half_agreement")), "person_id", "left")
