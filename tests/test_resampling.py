"""The split bootstrap: its draws, its sums over chunks and blocks, and its agreement with a whole one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import resampling

SCHEMA = "k string, c long, t double, w long"


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(9)
    return [(k, c, float(rng.normal(0.3, 1)), int(rng.integers(1, 5))) for k, n in (("a", 40), ("b", 300), ("one", 1)) for c in range(n)]


def found(spark, rows, **options):
    return {r.k: r for r in resampling.intervals(spark.createDataFrame(rows, SCHEMA), ["k"], "c", "t", "w", **options).collect()}


def whole(rows, key, resamples, seed):
    t, w = (np.array([r[i] for r in rows if r[0] == key]) for i in (2, 3))
    rng = np.random.default_rng(seed)
    pick = rng.integers(0, len(t), (resamples, len(t)))
    return t.sum() / w.sum(), *np.percentile(t[pick].sum(axis=1) / w[pick].sum(axis=1), [2.5, 97.5])


@pytest.mark.parametrize("chunk", [4096, 16])
def test_intervals_agree_with_a_whole_bootstrap(spark, rows, chunk):
    got = found(spark, rows, chunk=chunk)
    for key in ("a", "b"):
        point, low, high = whole(rows, key, 10_000, 1)
        width = high - low
        assert got[key].point == pytest.approx(point)
        assert abs(got[key].low - low) < 0.06 * width and abs(got[key].high - high) < 0.06 * width
    only = next(r for r in rows if r[0] == "one")
    assert (got["one"].low, got["one"].high) == pytest.approx((only[2] / only[3],) * 2)
    assert {k: r.clusters for k, r in got.items()} == {"a": 40, "b": 300, "one": 1}


def test_one_chunk_equals_the_same_draws_in_a_loop(spark, rows):
    df = spark.createDataFrame([r for r in rows if r[0] == "a"], SCHEMA)
    got = resampling.intervals(df, ["k"], "c", "t", "w", resamples=1100, seed=3, block=500).first()
    ordered = df.select(F.xxhash64("c").alias("h"), "t", "w", F.xxhash64("k").alias("key")).orderBy("h").collect()
    t, w, key = np.array([r.t for r in ordered]), np.array([float(r.w) for r in ordered]), ordered[0].key
    ratios = []
    for block, count in enumerate((500, 500, 100)):
        total, weight = resampling.drawn(t, w, np.full(count, 40), 3, key, block, 0)
        ratios += (total / weight).tolist()
    assert np.allclose([got.low, got.high], np.percentile(ratios, [2.5, 97.5]))


def test_a_small_key_is_resampled_by_one_task_with_the_same_draws(rows):
    for key, block in (("a", 500), ("b", 300), ("one", 500)):
        t, w = (np.array([float(r[i]) for r in rows if r[0] == key]) for i in (2, 3))
        for weight in (w, np.ones(len(w))):
            want = []
            for number, count in enumerate([block] * (1000 // block) + [1000 % block] * (1000 % block > 0)):
                total, by = resampling.drawn(t, weight, np.full(count, len(t)), 5, 77, number, 0)
                want += (total / by).tolist()
            assert np.allclose(resampling.ratios(t, weight, 1000, 5, 77, block), want, rtol=1e-12, atol=1e-12)
    ordered = np.sort(np.random.default_rng(1).normal(size=101))
    assert np.allclose([resampling.between(ordered, f) for f in (0.0, 0.025, 0.5, 1.0)], np.percentile(ordered, [0, 2.5, 50, 100]))


def test_resamples_are_not_shuffled(spark, rows):
    made = resampling.intervals(spark.createDataFrame(rows, SCHEMA), ["k"], "c", "t", "w", resamples=1000, chunk=60)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "explode(" not in plan and plan.count("MapInArrow") == 2  # no copy of the clusters for each block
    got = {r.k: r for r in made.collect()}
    assert {k: r.clusters for k, r in got.items()} == {"a": 40, "b": 300, "one": 1}
    assert all(got[k].low < got[k].point < got[k].high for k in ("a", "b"))


def test_reruns_and_partitions_change_nothing(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    one = sorted(map(tuple, resampling.intervals(df.coalesce(1), ["k"], "c", "t", "w", resamples=700, chunk=16).collect()))
    two = sorted(map(tuple, resampling.intervals(df.repartition(7), ["k"], "c", "t", "w", resamples=700, chunk=16).collect()))
    assert [r[0] for r in one] == [r[0] for r in two]
    assert np.allclose([r[1:] for r in one], [r[1:] for r in two], atol=1e-12)


def test_chunks_share_all_draws():
    sizes = [5, 17, 1, 30, 8]
    got = np.stack([resampling.shares(sizes, k, 2000, 7, 99, 3) for k in range(5)])
    assert (got.sum(axis=0) == 61).all() and (got >= 0).all()
    expected = np.array(sizes)
    assert np.allclose(got.mean(axis=1), expected, atol=0.5)
    spread = expected * (1 - expected / 61)
    assert np.allclose(got.var(axis=1), spread, rtol=0.15)


def test_work_is_spread(spark, rows):
    from tidemark.operators.work import spread

    df = spread(spark.createDataFrame(rows, SCHEMA), "k", "c")
    assert df.select(F.spark_partition_id().alias("p")).distinct().count() > 8


def test_rows_to_exclude_zero(spark):
    df = spark.createDataFrame([(0.1, -0.1, 0.3, 50), (0.1, 0.05, 0.2, 50), (0.0, -1.0, 1.0, 50)], "point double, low double, high double, n long")
    got = df.select(resampling.rows_to_exclude_zero("n").alias("x"), resampling.excludes_zero().alias("e")).collect()
    assert [(r.x, r.e) for r in got] == [(200, False), (None, True), (None, False)]


def test_empty_input(spark):
    assert found(spark, []) == {}


def test_brier_bootstrap_shuffles_no_resamples(spark):
    from tidemark.operators import evaluation

    rng, rows = np.random.default_rng(6), []
    for person in range(3):
        for k in range(60):
            y = float(rng.random() < 0.5)
            rows += [(person, k % 5, k, "a", k, model, float(rng.random()), y) for model in ("new", "old")]
    df = spark.createDataFrame(rows, "person_id long, fold int, session_no long, category string, window_end long, model string, p double, y double")
    made = evaluation.brier_bootstrap(df, challenger="new", reference="old", resamples=1000)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "explode(" not in plan and "block" not in plan and plan.count("MapInArrow") == 1
    got = made.collect()
    assert len(got) == 3 and all(r.low < r.point < r.high for r in got)


def test_width_ladder_on_common_rows(spark):
    from tidemark.operators import evaluation

    rng, rows = np.random.default_rng(2), []
    for k in range(200):
        y, base = float(rng.random() < 0.5), float(rng.random())
        for model, p in (("shipped", base), ("near", min(1.0, base + 0.01)), ("far", float(rng.random()))):
            if not (model == "near" and k >= 150):  # near lacks some rows
                rows.append((1, k % 5, k, "a", k, model, p, y))
    df = spark.createDataFrame(rows, "person_id long, fold int, session_no long, category string, window_end long, model string, p double, y double")
    got = {r.against: r for r in evaluation.width_ladder(df, "shipped", resamples=2000).collect()}
    assert (got["near"].rows, got["far"].rows) == (150, 200) and got["near"].width < got["far"].width / 5
    own = {k: (p - y) ** 2 for _, _, k, _, _, m, p, y in rows if m == "shipped"}
    far = np.array([(p - y) ** 2 - own[k] for _, _, k, _, _, m, p, y in rows if m == "far"])
    draws = far[np.random.default_rng(1).integers(0, 200, (10_000, 200))].mean(axis=1)
    low, high = np.percentile(draws, [2.5, 97.5])
    assert got["far"].point == pytest.approx(far.mean()) and abs(got["far"].width - (high - low)) < 0.1 * (high - low)
