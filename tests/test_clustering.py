"""k-means, silhouette, nulls and agreement against plain loops, in one block and in many."""

import math
import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import clustering

SCHEMA = "g long, k int, id long, a double, b double, c double"
FEATURES = ("a", "b", "c")


@pytest.fixture(scope="module")
def points(spark):
    rng, rows = random.Random(4), []
    for g, n in ((1, 60), (2, 37), (3, 5), (4, 1)):
        for i in range(n):
            at = 5.0 * (i % 2)
            rows.append((g, 2 + g % 2, 1000 * g + i, at + rng.gauss(0, 1), at + rng.gauss(0, 1), 1.0 if g == 2 else rng.random()))
    rows += [(5, 2, 5000 + i, 1.0, 1.0, 1.0) for i in range(6)]  # all rows equal
    return clustering.standardised(spark.createDataFrame(rows, SCHEMA), ["g"], FEATURES).checkpoint()


def fitted(points, by, k, size, **options):
    blocks = clustering.blocked(points, by, "id", size=size)
    centers = clustering.kmeans(blocks, by, k, **options)
    return centers, clustering.labelled(blocks, centers, by)


def groups(points):
    out = {}
    for r in points.orderBy("g", "id").collect():
        out.setdefault(r.g, []).append((r.id, r.x))
    return out


def plain_silhouette(xs, labels):
    members = {}
    for x, c in zip(xs, labels, strict=True):
        members.setdefault(c, []).append(x)
    if len(members) < 2:
        return None
    total = 0.0
    for x, c in zip(xs, labels, strict=True):
        if len(members[c]) == 1:
            continue
        near = sum(math.dist(x, o) for o in members[c]) / (len(members[c]) - 1)
        far = min(sum(math.dist(x, o) for o in some) / len(some) for own, some in members.items() if own != c)
        if max(near, far) > 0:
            total += (far - near) / max(near, far)
    return total / len(xs)


def test_standardised_columns(points):
    for g, rows in groups(points).items():
        x = np.array([v for _, v in rows])
        assert np.allclose(x.mean(axis=0), 0, atol=1e-9)
        assert all(abs(s - 1) < 1e-9 or s < 1e-9 for s in x.std(axis=0))
        assert g != 5 or not x.any()


def test_a_fit_is_a_fixed_point_of_a_plain_step(points):
    centers, marked = fitted(points, ["g"], 2, 4096)
    own = {r.g: (r.inertia, np.array(r.centroids).reshape(2, -1)) for r in centers.collect()}
    label = {(r.g, r.id): r.cluster for r in clustering.assignments(marked, ["g"], "id").collect()}
    assert set(own) == {1, 2, 3, 5}  # one row can't make two clusters
    for g, rows in groups(points).items():
        if g == 4:
            continue
        inertia, centroids = own[g]
        total = 0.0
        for cluster in range(2):
            some = [x for i, x in rows if label[g, i] == cluster]
            if some:
                assert np.allclose(np.mean(some, axis=0), centroids[cluster])
        for i, x in rows:
            away = [math.dist(x, c) ** 2 for c in centroids]
            assert label[g, i] == away.index(min(away))
            total += min(away)
        assert total == pytest.approx(inertia, abs=1e-9)


def test_the_best_restart_is_no_worse_than_plain_ones(points):
    centers, _ = fitted(points, ["g"], 3, 4096)
    own = {r.g: r.inertia for r in centers.collect()}
    rng = random.Random(1)
    for g in (1, 2):
        xs = [np.array(x) for _, x in groups(points)[g]]
        best = math.inf
        for _ in range(10):
            cs = rng.sample(xs, 3)
            for _ in range(60):
                near = [min(range(3), key=lambda c: math.dist(x, cs[c])) for x in xs]
                cs = [np.mean([x for x, n in zip(xs, near, strict=True) if n == c] or [cs[c]], axis=0) for c in range(3)]
            best = min(best, sum(min(math.dist(x, c) for c in cs) ** 2 for x in xs))
        assert own[g] <= best * 1.02


def test_many_blocks_give_what_one_gives(points):
    one, marked = fitted(points, ["g"], 2, 4096, restarts=4)
    many, spread = fitted(points, ["g"], 2, 8, restarts=4)
    a, b = ({r.g: (r.inertia, *r.centroids) for r in df.collect()} for df in (one, many))
    assert set(a) == set(b)
    for g in a:
        assert a[g] == pytest.approx(b[g], abs=1e-9)
    la, lb = ({(r.g, r.id): r.cluster for r in clustering.assignments(m, ["g"], "id").collect()} for m in (marked, spread))
    assert la == lb
    sa, sb = ({r.g: (r.n, r.silhouette) for r in clustering.silhouette(m, ["g"]).collect()} for m in (marked, spread))
    assert {g: n for g, (n, _) in sa.items()} == {g: n for g, (n, _) in sb.items()}
    for g, (_, value) in sa.items():
        assert sb[g][1] == (None if value is None else pytest.approx(value))


def test_silhouette_equals_a_plain_loop(points):
    _, marked = fitted(points, ["g"], 3, 4096)
    label = {(r.g, r.id): r.cluster for r in clustering.assignments(marked, ["g"], "id").collect()}
    got = {r.g: r.silhouette for r in clustering.silhouette(marked, ["g"]).collect()}
    for g, rows in groups(points).items():
        if g != 4:
            want = plain_silhouette([x for _, x in rows], [label[g, i] for i, _ in rows])
            assert got[g] == (None if want is None else pytest.approx(want))
    assert got[5] is None and got[1] > 0.3


def test_k_may_come_from_a_column(points):
    centers, _ = fitted(points, ["g", "k"], "k", 8)
    width = {r.g: len(r.centroids) // 3 for r in centers.collect()}
    assert width == {1: 3, 2: 2, 3: 3, 5: 2}


def test_permuted_rows_keep_columns_and_part_them(points):
    made = clustering.permuted(points, ["g"], "id", runs=3)
    again = {tuple(r) for r in made.select("g", "run", "id", F.col("x").cast("string")).collect()}
    assert again == {tuple(r) for r in made.repartition(7).select("g", "run", "id", F.col("x").cast("string")).collect()}
    for g, rows in groups(points).items():
        want = np.sort(np.array([x for _, x in rows]), axis=0)
        for run in (1, 2, 3):
            got = np.array([r.x for r in made.where(f"g = {g} and run = {run}").collect()])
            assert np.array_equal(np.sort(got, axis=0), want)


def test_one_normal_has_the_groups_moments(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(400, 2)) @ np.array([[2.0, 1.0], [0.0, 0.5]]) + 3
    rows = [(1, i, [float(v) for v in (*x, 7.0)]) for i, x in enumerate(base)]
    points = spark.createDataFrame(rows, "g long, id long, x array<double>")
    got = np.array([r.x for r in clustering.gaussian(points, ["g"], "id", 3, runs=50).collect()])
    assert got.shape == (20_000, 3)
    assert np.allclose(got[:, :2].mean(axis=0), base.mean(axis=0), atol=0.1)
    assert np.allclose(np.cov(got[:, :2].T), np.cov(base.T), atol=0.2)
    assert np.allclose(got[:, 2], 7, atol=1e-3)


def test_two_modes_stand_above_both_nulls_and_one_mode_does_not(spark):
    rng = np.random.default_rng(8)
    rows = [(1, i, [float(v) for v in rng.normal(size=2) + 8 * (i % 2)]) for i in range(80)] + [(2, 100 + i, [float(v) for v in rng.normal(size=2)]) for i in range(80)]
    points = spark.createDataFrame(rows, "g long, id long, x array<double>")
    own = {r.g: r.silhouette for r in clustering.silhouettes(points, ["g"], "id", 2).collect()}
    bands = {(r.g, r["null"]): r for r in clustering.null_bands(points, ["g"], "id", [2], 2, runs=20).collect()}
    assert own[1] > bands[1, "gaussian"].high and own[1] > bands[1, "permuted"].high
    assert own[2] <= bands[2, "gaussian"].high
    assert all(r.runs == 20 and r.low <= r.median <= r.high for r in bands.values())
    steady = {r.g: r.stability for r in clustering.stability(points, ["g"], "id", 2, runs=8).collect()}
    assert steady[1] == 1.0 and steady[2] < 1.0


def test_a_sweep_in_one_task_equals_the_tables_of_draws(spark, points):
    known = points.select("g", F.col("id"), "x").checkpoint()
    swept = known.withColumn("k", F.explode(F.array(F.lit(2), F.lit(3))))
    near = lambda a, b: a == b or (None not in (a, b) and a == pytest.approx(b, abs=1e-9))

    def same(one, two, keys, values):
        a, b = ({tuple(r[c] for c in keys): tuple(r[c] for c in values) for r in df.collect()} for df in (one, two))
        assert a.keys() == b.keys() and all(near(x, y) for key in a for x, y in zip(a[key], b[key], strict=True))

    same(clustering.swept_silhouettes(known, ["g"], "id", (2, 3)), clustering.silhouettes(swept, ["g", "k"], "id", "k"), ["g", "k"], ["n", "silhouette"])
    same(clustering.swept_stability(known, ["g"], "id", (2, 3), runs=3), clustering.stability(swept, ["g", "k"], "id", "k", runs=3), ["g", "k"], ["stability", "runs"])
    made = clustering.permuted(known, ["g"], "id", 3).withColumn("null", F.lit("permuted")).unionByName(
        clustering.gaussian(known, ["g"], "id", 3, 3).withColumn("null", F.lit("gaussian"))
    ).withColumn("k", F.explode(F.array(F.lit(2), F.lit(3))))
    by = ["g", "k", "null"]
    plain = clustering.band(clustering.silhouettes(made, [*by, "run"], "id", "k"), by, "silhouette")
    bands = clustering.null_bands(known, ["g"], "id", (2, 3), 3, runs=3)
    same(bands, plain, by, ["median", "low", "high", "runs"])
    # a group beyond the size goes by its blocks and has a row too
    same(clustering.swept_silhouettes(known, ["g"], "id", (2, 3), size=50), clustering.silhouettes(swept, ["g", "k"], "id", "k"), ["g", "k"], ["n", "silhouette"])
    plan = bands._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan  # no table of groups, runs and k that looks small enough to broadcast


def test_agreement_equals_enumeration(spark):
    rng = random.Random(6)
    rows = [(g, i, rng.randrange(3), rng.choice("xyz")) for g, n in ((1, 30), (2, 2), (3, 1)) for i in range(n)]
    got = {r.g: (r.items, r.agreement) for r in clustering.agreement(spark.createDataFrame(rows, "g long, i long, a long, b string"), ["g"], "a", "b").collect()}
    for g in (1, 2, 3):
        own = [(a, b) for h, _, a, b in rows if h == g]
        pairs = list(combinations(own, 2))
        want = sum((p[0] == q[0]) == (p[1] == q[1]) for p, q in pairs) / len(pairs) if pairs else None
        assert got[g] == (len(own), None if want is None else pytest.approx(want))


def test_a_held_null_band_equals_the_table_of_draws(spark, monkeypatch):
    from tidemark.operators import patterns

    rng = random.Random(11)
    rows = [(g, k, sorted(rng.sample("abcdé中", rng.randrange(2, 5)))) for g, n in ((1, 40), (2, 25), (3, 1)) for k in range(n)]
    sets = spark.createDataFrame(rows, "g long, s long, items array<string>")
    limits = {"support": 3, "confidence": 0.3, "lift": 1.0, "runs": 12}
    held = patterns.null_rule_band(sets, ["g"], ["s"], **limits)
    plan = held._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Generate" not in plan  # no row for each set, run and item
    got = sorted(map(tuple, held.collect()))
    for most in (0, 100):
        monkeypatch.setattr(patterns, "HELD", most)
        assert sorted(map(tuple, patterns.null_rule_band(sets, ["g"], ["s"], **limits).collect())) == got
    assert [r[0] for r in got] == [1, 2, 3] and got[0][1] > 0 and got[2][1:] == (0, 0.0, 0, 0)
    monkeypatch.setattr(patterns, "CELLS", 1)
    assert sorted(map(tuple, patterns.null_rule_band(sets, ["g"], ["s"], **limits).collect())) == got


def test_empty_input(spark):
    none = spark.createDataFrame([], "g long, id long, x array<double>")
    assert clustering.silhouettes(none, ["g"], "id", 2).collect() == []
    assert clustering.stability(none, ["g"], "id", 2, runs=2).collect() == []
    with pytest.raises(ValueError, match="at least 2"):
        clustering.kmeans(clustering.blocked(none, ["g"], "id"), ["g"], 1)
