"""Keyed tables: upserts, replays, lost jobs, compaction, deletion with counts, retention."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.sources import stores

EVENT = "person_id long, event_id long, us long, category string, domain string"


@pytest.fixture
def table(spark, tmp_path):
    return stores.KeyedTable(spark, f"file://{tmp_path}/events", StructType.fromDDL(EVENT), stores.KEYS["events"], stores.storable_event(), ("us",))


def rows(spark, *given):
    return spark.createDataFrame([(p, e, us, c, "x.com") for p, e, us, c in given], EVENT)


def held(table):
    return sorted((r.person_id, r.event_id, r.category) for r in table.read().collect())


def test_the_newest_batch_of_a_key_wins(spark, table):
    assert held(table) == [] and table.count() == 0
    table.put(rows(spark, (1, 1, 5, "a"), (1, 2, 6, "a"), (2, 1, 7, "a")))
    table.put(rows(spark, (1, 2, 6, "b"), (3, 1, 9, "b")))
    want = [(1, 1, "a"), (1, 2, "b"), (2, 1, "a"), (3, 1, "b")]
    assert held(table) == want
    assert table.compact() and held(table) == want and not table.compact()
    table.put(rows(spark, (2, 1, 7, "c")))
    assert held(table) == [(1, 1, "a"), (1, 2, "b"), (2, 1, "c"), (3, 1, "b")]
    assert {r.category: r.n for r in table.counts("category").collect()} == {"a": 1, "b": 2, "c": 1}


def test_within_a_batch_the_latest_row_wins(spark, table):
    table.put(rows(spark, (1, 1, 5, "old"), (1, 1, 8, "new"), (1, 1, 6, "mid")))
    assert held(table) == [(1, 1, "new")]


def test_a_batch_that_comes_again_changes_nothing(spark, table):
    assert table.put(rows(spark, (1, 1, 5, "a")), batch=7)
    assert table.put(rows(spark, (1, 1, 5, "b")), batch=8)
    assert not table.put(rows(spark, (1, 1, 5, "a")), batch=7)
    assert held(table) == [(1, 1, "b")]
    table.compact()
    assert not table.put(rows(spark, (1, 1, 5, "a")), batch=8) and held(table) == [(1, 1, "b")]


def test_a_lost_job_leaves_nothing_that_counts(spark, table, tmp_path):
    table.put(rows(spark, (1, 1, 5, "a")))
    rows(spark, (1, 1, 5, "half")).write.parquet(f"{table.path}/batch=1")
    (tmp_path / "events" / "batch=1" / "_SUCCESS").unlink()
    rows(spark, (9, 9, 9, "half")).write.parquet(f"{table.path}/snapshot=1")
    (tmp_path / "events" / "snapshot=1" / "_SUCCESS").unlink()
    assert held(table) == [(1, 1, "a")]
    assert table.put(rows(spark, (1, 1, 5, "b")), batch=1) and held(table) == [(1, 1, "b")]


def test_a_bad_row_keeps_its_whole_batch_out(spark, table):
    bad = spark.createDataFrame([(1, 1, 5, "a", "x.com"), (1, 2, 5, "a", "https://x.com/path")], EVENT)
    with pytest.raises(Exception, match="may not hold"):
        table.put(bad)
    with pytest.raises(ValueError, match="holds"):
        table.put(rows(spark, (1, 1, 5, "a")).withColumn("url", F.lit("u")))
    assert held(table) == []


def test_null_keys_are_keys(spark, tmp_path):
    meta = stores.KeyedTable(spark, f"file://{tmp_path}/meta", StructType.fromDDL("name string, value string"), stores.KEYS["meta"])
    for value in ("1", "2"):
        meta.put(spark.createDataFrame([(None, value), ("k", value)], "name string, value string"))
        meta.compact()
    meta.put(spark.createDataFrame([(None, "3")], "name string, value string"))
    assert sorted((r.name or "", r.value) for r in meta.read().collect()) == [("", "3"), ("k", "2")]


def test_delete_everything_and_retention(spark, table, tmp_path):
    span_schema = "person_id long, event_id long, started_us long, ended_us long"
    spans = stores.KeyedTable(spark, f"file://{tmp_path}/spans", StructType.fromDDL(span_schema), stores.KEYS["spans"], stores.storable_span())
    table.put(rows(spark, (1, 1, 5, "a"), (1, 2, 6, "a"), (2, 1, 7, "a")))
    spans.put(spark.createDataFrame([(1, 1, 5, 9), (1, 2, 6, 9)], span_schema))
    with pytest.raises(Exception, match="may not hold"):
        spans.put(spark.createDataFrame([(1, 1, 5, 5)], span_schema))
    assert stores.expire(table, spans, 6) == 1
    assert held(table) == [(1, 2, "a"), (2, 1, "a")] and spans.count() == 1
    tables = {"events": table, "spans": spans}
    assert not stores.is_empty(tables)
    assert stores.delete_everything(tables) == {"events": 2, "spans": 1} and stores.is_empty(tables)
    assert not table.put(rows(spark, (1, 1, 5, "a")), batch=0) and stores.is_empty(tables)
    table.put(rows(spark, (4, 4, 4, "d")))
    assert held(table) == [(4, 4, "d")]
