"""Import verdicts on hand-made visit graphs."""

from pyspark.sql import functions as F

from tidemark.operators import imports

SCHEMA = "person_id long, visit_id long, from_visit long, us long, transition long, url string"
END, HOP = 0x20000000, 0x40000000
WEB = "https://www.a.example/x"


def judged(spark, rows, way=imports.simulate, **options):
    df = spark.createDataFrame(rows, SCHEMA)
    return {(r.person_id, r.visit_id): r.verdict for r in way(df, start_us=0, end_us=10**9, **options).collect()}


def test_verdicts_in_order(spark):
    rows = [
        (1, 1, None, 10, END, WEB), (1, 2, 1, 10 + 50_000, END | HOP, "https://b.example/"), (1, 3, 1, 10 + 50_001, END, "https://c.example/"),
        (1, 4, 1, 60, END | 3, "https://d.example/"), (1, 5, 0, 70, END, "chrome://settings"), (1, 6, None, 2 * 10**9, END, WEB),
        (1, 7, None, 90, 0, "https://hidden.example/"), (1, 8, None, 3 * 10**9, END, "https://late.example/"),
        (1, 9, None, 95, END, "https://d.example/"),
    ]
    assert judged(spark, rows) == {
        (1, 1): "kept", (1, 2): "redirect", (1, 3): "kept", (1, 4): "subframe", (1, 5): "not-web", (1, 6): "out-of-window", (1, 7): "api-hidden", (1, 9): "kept",
    }  # visit 8's page was not seen in the window at all


def test_a_referrer_that_is_not_handed_over_judges_nothing(spark):
    rows = [(1, 1, None, 10, 0, "https://hidden.example/"), (1, 2, 1, 20, END, WEB)]
    assert judged(spark, rows) == {(1, 1): "api-hidden", (1, 2): "kept"}
    assert judged(spark, rows, imports.prepare) == {(1, 1): "kept", (1, 2): "redirect"}


def test_persons_never_meet_and_malformed_comes_first(spark):
    rows = [(1, 1, None, 10, END, WEB), (2, 2, 1, 20, END, WEB), (2, 3, 2, None, 3, WEB), (2, 4, 2, 30, 3, None), (2, 5, 2, 25, END, WEB), (2, 6, 2, 15, END, WEB)]
    got = judged(spark, rows, imports.prepare)
    assert got == {(1, 1): "kept", (2, 2): "kept", (2, 3): "malformed", (2, 4): "malformed", (2, 5): "redirect", (2, 6): "kept"}


def test_a_hub_that_refers_all_visits(spark):
    rows = [(1, 0, None, 0, END, WEB)] + [(1, k, 0 if k % 2 else None, k, END, f"https://s{k}.example/") for k in range(1, 400)]
    hub = spark.createDataFrame([(1, 7, None, 5, END, WEB), *((1, k, 7, 5 + k, END, WEB) for k in range(10, 300))], SCHEMA)
    assert imports.with_gap(hub).where("gap is not null").count() == 290
    assert set(judged(spark, rows).values()) == {"kept"}  # a zero referrer is none


def test_only_hubs_are_copied_and_referrers_are_not_broadcast(spark):
    rows = [(1, 1, None, 5, END, WEB), *((1, k, 1, 5 + k, END, WEB) for k in range(2, 60)), *((2, k, k - 1, k * k, END, WEB) for k in range(2, 60))]
    df = spark.createDataFrame(rows, SCHEMA)
    times = df.groupBy("person_id", "visit_id").agg(F.max("us").alias("__at"))
    hubs = spark.createDataFrame([(1, 1, True)], "__p long, __v long, __hub boolean")
    assert imports._copied(times, hubs, 16).count() == len(rows) + 15
    want = {(p, v, us - (5 if p == 1 else f * f)) for p, v, f, us, _, _ in rows if f and (p, f) != (2, 1)}
    for hub in (10, 10_000):
        made = imports.with_gap(df, hub=hub)
        assert {(r.person_id, r.visit_id, r.gap) for r in made.where("gap is not null").collect()} == want
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=merge" in plan and "sequence(0, 15)" not in plan  # no table of 16 times the visits, which looks small enough to broadcast


def test_crosstab_comparison_and_scores(spark):
    rows = [(1, 1, None, 10, END, WEB), (1, 2, 1, 20, END | HOP, "https://b.example/"), (1, 3, 99, 30, END | HOP, "https://c.example/"), (1, 4, 1, 15, END, "https://d.example/")]
    df = spark.createDataFrame(rows, SCHEMA)
    made = imports.simulate(df, start_us=0, end_us=100)
    cross = {r.truth: (r.redirect, r.kept) for r in imports.crosstab(made).collect()}
    assert cross == {"redirect hop": (1, 1), "chosen navigation": (1, 1)}
    exported = spark.createDataFrame([("a.example",), ("a.example",), ("z.example",)], "domain string")
    row = imports.compare_domains(made, exported).first()
    assert (row.simulated_events, row.exported_events, row.only_simulated, row.only_exported, row.disagreement) == (2, 3, 1, 1, 3)
    score = {r.threshold_us: (r.tp, r.fp, r.fn, r.tn, r.resolvable) for r in imports.redirect_scores(df, (5, 10)).collect()}
    assert score == {5: (0, 1, 2, 1, 0.5), 10: (1, 1, 1, 1, 0.5)}


def test_redirect_scores_do_not_broadcast_the_referrers(spark):
    rows = [(1, k, k - 1, 10 * k, END | (HOP if k % 2 else 0), WEB) for k in range(1, 100)]
    made = imports.redirect_scores(spark.createDataFrame(rows, SCHEMA), (5, 10))
    assert {r.threshold_us: (r.tp, r.fp, r.fn, r.tn, r.resolvable) for r in made.collect()} == {5: (0, 0, 50, 49, 49 / 50), 10: (49, 49, 1, 0, 49 / 50)}
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=merge" in plan and "sequence(0, 15)" not in plan


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert judged(spark, []) == {} and imports.crosstab(none.withColumn("verdict", F.lit("kept"))).collect() == []
    row = imports.compare_domains(none.withColumn("verdict", F.lit("kept")), spark.createDataFrame([], "domain string")).first()
    assert row.simulated_events == row.exported_events == 0
