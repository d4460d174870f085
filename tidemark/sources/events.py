"""Adapters to the canonical event table: person_id, event_id, occurred_at, us, category, domain, dwell_seconds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Microseconds between 1601 and 1970, and the low-byte names of page transitions.
WEBKIT_EPOCH = 11_644_473_600_000_000
TRANSITIONS = ("link", "typed", "auto_bookmark", "auto_subframe", "manual_subframe", "generated", "start_page", "form_submit", "reload", "keyword", "keyword_generated")
CHAIN_END, REDIRECT = 0x20000000, 0xC0000000


#: Firefox's visit types from 1 on, and the numbers of redirects, subframes and downloads.
FIREFOX_TYPES = ("link", "typed", "auto_bookmark", "auto_subframe", "redirect_permanent", "redirect_temporary", "download", "manual_subframe", "reload")
FIREFOX_REDIRECTS, FIREFOX_SUBFRAMES, FIREFOX_DOWNLOAD = (5, 6), (4, 8), 7
VIEWS = ("shipped", "chosen", "raw")


def known_view(view: str) -> None:
    if view not in VIEWS:
        raise ValueError(f"unknown view {view!r}; one of {', '.join(VIEWS)}")


def from_event_table(events: DataFrame) -> DataFrame:
    """The driver's ``events``: user, type, JSON key and value become person, category, domain and dwell."""
    at = F.col("ts").cast("timestamp")
    return events.select(
        F.col("user_id").alias("person_id"), "event_id", at.alias("occurred_at"), F.unix_micros(at).alias("us"),
        F.col("event_type").alias("category"), F.get_json_object("props", "$.k").alias("domain"), F.col("value").alias("dwell_seconds"),
    )


def webkit_instant(us: Column) -> Column:
    return F.timestamp_micros(us - WEBKIT_EPOCH)


def transition_core(raw: Column) -> Column:
    names = F.array(*map(F.lit, TRANSITIONS))
    return F.coalesce(F.get(names, raw.bitwiseAND(F.lit(255)).cast("int")), F.lit("unknown"))


def visit_type_name(raw: Column) -> Column:
    """The name of a Firefox visit type, in the words of the other browser's transitions."""
    return F.coalesce(F.get(F.array(*map(F.lit, FIREFOX_TYPES)), (raw - 1).cast("int")), F.lit("unknown"))


def is_redirect(raw: Column) -> Column:
    return raw.cast("long").bitwiseAND(F.lit(REDIRECT)) != 0


def is_visible(raw: Column) -> Column:
    """The end of a redirect chain, not a subframe and not a keyword expansion."""
    low = raw.bitwiseAND(F.lit(255))
    return (raw.cast("long").bitwiseAND(F.lit(CHAIN_END)) != 0) & ~low.isin(3, 4, 10)


def chromium_visits(visits: DataFrame, urls: DataFrame, view: str = "shipped") -> DataFrame:
    """Visits joined to their URLs; ``shipped`` keeps all visits of a URL with a visible one, ``chosen`` the
    chain starts that were picked, ``raw`` everything. A zero duration is an absent one."""
    known_view(view)
    joined = visits.join(urls.select(F.col("id").alias("url"), F.col("url").alias("page")), "url")
    if view == "shipped":
        joined = joined.join(joined.where(is_visible(F.col("transition"))).select("page").distinct(), "page", "left_semi")
    elif view == "chosen":
        low = F.col("transition").bitwiseAND(F.lit(255))
        joined = joined.where(~is_redirect(F.col("transition")) & ~low.isin(3, 4))
    return joined.select(
        "id", "page", webkit_instant(F.col("visit_time")).alias("visited_at"), transition_core(F.col("transition")).alias("transition"),
        (F.nullif("visit_duration", F.lit(0)) / 1e6).alias("duration_seconds"),
    )


def firefox_visits(
    visits: DataFrame, places: DataFrame, view: str = "shipped", *, exclude_subframes: bool = True, exclude_downloads: bool = True
) -> DataFrame:
    """Visits joined to places; Firefox keeps no durations.

    ``shipped`` keeps all visits of a page with a visible one (no subframe, and no later redirect came from it),
    ``chosen`` drops redirects, ``raw`` keeps everything; subframes and downloads go unless asked for.
    """
    known_view(view)
    kind = F.col("visit_type")
    joined = visits.join(places.select(F.col("id").alias("place_id"), F.col("url").alias("page")), "place_id")
    if view == "shipped":
        sources = visits.where(kind.isin(*FIREFOX_REDIRECTS) & (F.col("from_visit") != 0)).select(F.col("from_visit").alias("id")).distinct()
        visible = joined.where(~kind.isin(*FIREFOX_SUBFRAMES)).join(sources, "id", "left_anti").select("page").distinct()
        joined = joined.join(visible, "page", "left_semi")
    elif view == "chosen":
        joined = joined.where(~kind.isin(*FIREFOX_REDIRECTS))
    if exclude_subframes:
        joined = joined.where(~kind.isin(*FIREFOX_SUBFRAMES))
    if exclude_downloads:
        joined = joined.where(kind != FIREFOX_DOWNLOAD)
    return joined.select(
        "id", "page", F.timestamp_micros("visit_date").alias("visited_at"), visit_type_name(kind).alias("transition"), F.lit(None).cast("double").alias("duration_seconds")
    )


def read_panel(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(events, dropped counts) of a panel CSV; rows without stamp, seconds or domain, or below zero, are counted out."""
    rows = spark.read.csv(path, header=True, mode="PERMISSIVE")
    at, dwell = F.try_to_timestamp(F.trim("used_at")), F.expr("try_cast(trim(active_seconds) AS double)")
    good = F.coalesce(at.isNotNull() & (dwell >= 0) & (F.trim("domain") != ""), F.lit(False))
    events = rows.where(good).select(F.trim("panelist_id").alias("person_id"), at.alias("occurred_at"), F.unix_micros(at).alias("us"), F.trim("domain").alias("domain"), dwell.alias("dwell_seconds"))
    return events, rows.groupBy(F.trim("panelist_id").alias("person_id")).agg(F.count_if(~good).alias("dropped"))


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """Events of an export document, dwell summed from its attention spans (absent stays null)."""
    span = "spanId string, eventId string, startedAt string, endedAt string, activeSeconds double, endReason string"
    event = "eventId string, occurredAt string, source string, domain string, category string, transition string, dwellSeconds double, sessionId string"
    doc = spark.read.schema(f"schema string, events array<struct<{event}>>, attention array<struct<{span}>>").json(path, multiLine=True)
    known = doc.where(F.col("schema").rlike(r"\.export\.v[123]$") | F.raise_error(F.concat(F.lit("unknown schema "), F.col("schema"))).isNotNull())
    spans = known.select(F.inline("attention")).groupBy("eventId").agg(F.sum("activeSeconds").alias("dwell"))
    return known.select(F.inline("events")).join(spans, "eventId", "left").select(
        F.col("eventId").alias("event_id"), F.to_timestamp("occurredAt").alias("occurred_at"), "domain", "category", "transition", "source", F.coalesce("dwell", "dwellSeconds").alias("dwell_seconds")
    )
