"""Panel CSV and export readers, and the tables beside them."""

import json

import pytest

from tidemark.sources import events, panel


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("panel")
    (path / "visits.csv").write_text(
        "panelist_id,used_at,active_seconds,domain\n"
        "p1,2018-10-01 10:00:00,12.5,A.example\np1,2018-10-01 10:01:00,0,b.example\np1,,3,b.example\np2,2018-10-02 00:00:00,-1,a.example\n"
        "p2,2018-10-02 00:00:05,x,a.example\np2,2018-10-02 00:00:07,2, \n,2018-10-02 00:00:07,2,c.example\np2 ,2018-10-02 00:00:09,4,\"c.example\"\n"
    )
    (path / "domains.csv").write_text('domain,category_names\nA.EXAMPLE,"news, media"\nb.example,\n,lost\n')
    (path / "people.csv").write_text("panelist_id,gender,age_recode\np1,f,18-24\np2,,\n,m,65+\n")
    return f"file://{path}"


def test_visits_and_dropped_counts(spark, folder):
    made, dropped = events.read_panel(spark, f"{folder}/visits.csv")
    rows = {(r.person_id, r.domain, r.dwell_seconds) for r in made.collect()}
    assert {("p1", "A.example", 12.5), ("p1", "b.example", 0.0), ("p2", "c.example", 4.0)} <= rows
    assert {r.person_id: r.dropped for r in dropped.collect() if r.person_id} == {"p1": 1, "p2": 3}
    assert {r.person_id: r.visits for r in panel.visits_per_panelist(spark, f"{folder}/visits.csv").collect()} == {"p1": 3, "p2": 4}


def test_categories_and_people(spark, folder, tmp_path):
    made, _ = events.read_panel(spark, f"{folder}/visits.csv")
    known = panel.read_domain_categories(spark, f"{folder}/domains.csv")
    assert {tuple(r) for r in known.collect()} == {("a.example", "news"), ("b.example", "uncategorized")}
    named = {r.domain: r.category for r in panel.with_categories(made, known).collect()}
    assert named["A.example"] == "news" and named["c.example"] == "uncategorized"
    people = panel.read_demographics(spark, f"{folder}/people.csv")
    assert {tuple(r) for r in people.collect()} == {("p1", "f", "18-24"), ("p2", "", "")}
    gains = spark.createDataFrame([("p1", 0.2), ("p2", -0.1), ("p3", 0.3)], "person_id string, gain double")
    table = {r.gender: (r.n, round(r.mean_gain, 6), r.share_positive) for r in panel.group_table(gains, people, "gender").collect()}
    assert table == {"f": (1, 0.2, 1.0), "": (2, 0.1, 0.5)}
    panel.write_shards(made, f"file://{tmp_path}/shards", 3)
    back = spark.read.parquet(f"file://{tmp_path}/shards")
    assert back.count() == made.count()


def test_export_reader(spark, tmp_path):
    event = {"eventId": "e1", "occurredAt": "2026-01-02T03:04:05Z", "source": "live", "domain": "a.example", "category": "news", "transition": "link"}
    other = event | {"eventId": "e2", "dwellSeconds": 7.0}
    spans = [{"spanId": f"s{k}", "eventId": "e1", "startedAt": "x", "endedAt": "y", "activeSeconds": s, "endReason": "idle"} for k, s in enumerate((2.0, 3.5))]
    path = tmp_path / "export.json"
    path.write_text(json.dumps({"schema": "any.export.v3", "events": [event, other], "attention": spans}))
    got = {r.event_id: (r.domain, r.dwell_seconds) for r in events.read_export(spark, f"file://{path}").collect()}
    assert got == {"e1": ("a.example", 5.5), "e2": ("a.example", 7.0)}
    path.write_text(json.dumps({"schema": "any.export.v9", "events": [event], "attention": []}))
    with pytest.raises(Exception, match="unknown schema"):
        events.read_export(spark, f"file://{path}").collect()
