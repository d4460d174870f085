"""Local days and blocks against the standard library's zones, clock changes included."""

import random
from collections import Counter
from datetime import UTC, date, datetime, timedelta
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from tidemark.operators import blocks, calendars, labels

ZONES = ("UTC", "America/New_York", "Asia/Kolkata", "Europe/Berlin")
SCHEMA = "person_id long, event_id long, us long, category string, domain string, zone string"
EPOCH = date(1970, 1, 1)


def instants(seed, start, days, count):
    rng = random.Random(seed)
    first = int(datetime(*start, tzinfo=UTC).timestamp() * 1e6)
    return sorted(first + rng.randrange(days * 86_400_000_000) for _ in range(count))


@pytest.fixture(scope="module")
def rows():
    rng, out = random.Random(1), []
    for person in range(4):
        for k, us in enumerate(instants(person, (2024, 3, 1), 45, 150)):
            out.append((person, k, us, rng.choice("ab"), rng.choice("xyz") + ".com", ZONES[person]))
    return out


@pytest.fixture(scope="module")
def events(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def local(us, zone):
    return (datetime(1970, 1, 1, tzinfo=UTC) + timedelta(microseconds=us)).astimezone(ZoneInfo(zone))


def block(us, zone, kind):
    at = local(us, zone).date()
    if kind == "day":
        return (at - EPOCH).days
    if (at.weekday() < 5) != (kind == "weekday"):
        return None
    return (at - timedelta(days=at.weekday() - (0 if kind == "weekday" else 5)) - EPOCH).days


@pytest.mark.parametrize("session", ["UTC", "Asia/Tokyo"])
def test_local_days_in_any_session_zone(spark, rows, events, session):
    spark.conf.set("spark.sql.session.timeZone", session)
    try:
        got = {(r.person_id, r.event_id): r.d for r in events.select("person_id", "event_id", calendars.local_day(F.col("us"), F.col("zone")).alias("d")).collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == {(p, e): block(us, z, "day") for p, e, us, _, _, z in rows}


@pytest.mark.parametrize("kind", calendars.KINDS)
def test_grid_equals_a_plain_count(rows, events, kind):
    got = {(r.person_id, r.day, r.category): (r.rn, r.n) for r in calendars.grid(events, kind, F.col("zone")).collect()}
    step, want = 1 if kind == "day" else 7, {}
    for person in range(4):
        own = [(block(us, z, kind), c) for p, _, us, c, _, z in rows if p == person]
        counts = Counter(x for x in own if x[0] is not None)
        held = sorted({b for b, _ in counts})
        for day in range(held[0] + step, held[-1], step):
            for category in {c for _, c in counts}:
                want[person, day, category] = ((day - held[0]) // step, counts[day, category])
    assert got == want


def test_days_of_23_and_25_hours(spark, events):
    got = {(r.person_id, r.day): r.hours for r in calendars.visits_per_local_day(events, F.col("zone")).collect()}
    spring = {p: (date(2024, 3, d) - EPOCH).days for p, d in ((1, 10), (3, 31))}
    assert got[1, spring[1]] == 23 and got[3, spring[3]] == 23
    assert {h for (p, d), h in got.items() if (p, d) not in ((1, spring[1]), (3, spring[3]))} == {24.0}
    autumn = [(1, 1, int(datetime(2024, 11, 3, 12, tzinfo=UTC).timestamp() * 1e6), "a", "x.com", "America/New_York")]
    assert calendars.visits_per_local_day(spark.createDataFrame(autumn, SCHEMA), F.col("zone")).first().hours == 25


def test_utc_days_are_the_plain_grid_and_labels_take_it(events):
    own = calendars.grid(events).drop("kind")
    plain = labels.day_grid(events).select(own.columns)
    assert sorted(map(tuple, own.collect())) == sorted(map(tuple, plain.collect()))
    zoned = calendars.grid(events, "weekend", F.col("zone"))
    assert labels.block_labels(zoned, min_prior=1).count() > 0 and labels.dormancy(zoned).columns == ["person_id", "n_dormant", "n_returned"]
    assert blocks.block_volume_stats(zoned, least=1).count() == 4


@pytest.mark.parametrize("kind", calendars.KINDS)
def test_novelty_equals_a_plain_loop(rows, events, kind):
    got = {(r.person_id, r.day): (r.n_domains, r.n_new) for r in calendars.novelty(events, kind, F.col("zone"), lookback_days=3).collect()}
    want = {}
    for person in range(4):
        own = [(us, d, block(us, z, kind)) for p, _, us, _, d, z in rows if p == person]
        for day in {b for _, _, b in own} - {None}:
            first = min(us for us, _, b in own if b == day)
            prior = {d for us, d, _ in own if first - 3 * 86_400_000_000 <= us < first}
            if prior:
                held = {d for _, d, b in own if b == day}
                want[person, day] = (len(held), len(held - prior))
    assert got == want


def test_unknown_kinds_and_empty_tables(spark, events):
    with pytest.raises(ValueError, match="unknown kind"):
        calendars.grid(events, "month")
    assert calendars.grid(spark.createDataFrame([], SCHEMA)).collect() == []
