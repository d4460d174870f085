"""The spread models against plain loops over persons and folds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import models

COLUMNS = ("a", "b", "c")
SCHEMA = "person_id long, category string, session_no long, window_end long, fold int, rn int, outcome boolean, a double, b double, c double"


@pytest.fixture(scope="module")
def rows():
    rng, out = np.random.default_rng(2), []
    for person in range(9):
        n = 200 if person == 4 else 30 + 3 * person
        for k in range(n):
            a, b = rng.normal(size=2)
            fold = 0 if k < 0.4 * n else min(5, 1 + int((k - 0.4 * n) // (0.12 * n)))
            out.append((person, "xy"[k % 2], k, k, fold, k + 1, bool(a + rng.normal() > 0), float(a), None if k % 7 == 0 else float(b), 1.0))
    return out


@pytest.fixture(scope="module")
def folded(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def plain_fit(x, y, steps, penalty):
    n, w, b = len(y), np.zeros(x.shape[1]), 0.0
    bound = (1 + (x * x).sum(axis=1)).sum() / (4 * n) + penalty / n
    for _ in range(steps):
        miss = 1 / (1 + np.exp(-np.clip(x @ w + b, -40, 40))) - y
        w, b = w - (x.T @ miss + penalty * w) / n / bound, b - miss.sum() / n / bound
    return w, b


def matrices(rows, person, nullable):
    own = [r for r in rows if r[0] == person]
    x = np.array([[np.nan if v is None else v for v in r[7:]] for r in own])
    x = np.concatenate([x, np.isnan(x[:, [COLUMNS.index(c) for c in nullable]]).astype(float)], axis=1)
    return x, np.array([float(r[6]) for r in own]), np.array([r[4] for r in own])


def standard(train, other):
    fill = np.nanmean(train, axis=0)
    filled = np.where(np.isnan(train), fill, train)
    scale = filled.std(axis=0)
    scale[scale == 0] = 1
    return (filled - filled.mean(axis=0)) / scale, (np.where(np.isnan(other), fill, other) - filled.mean(axis=0)) / scale


def logit(p):
    return np.log(p / (1 - p))


@pytest.mark.parametrize("batch", [0, 25])
def test_backtest_equals_a_plain_loop_and_is_spread(spark, rows, folded, batch):
    if batch:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        made = models.backtest(folded, COLUMNS, steps=60, nullable=("b",))
        got = {(r.person_id, r.session_no): (r.fold, r.y, r.p) for r in made.collect()}
        tasks = made.select(F.spark_partition_id().alias("t")).distinct().count()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert tasks > 4  # nine persons, an explicit number of partitions
    want = {}
    for person in range(9):
        x, y, fold = matrices(rows, person, ("b",))
        for k in range(1, 6):
            train, test = standard(x[fold < k], x[fold == k])
            w, b = plain_fit(train, y[fold < k], 60, 1.0)
            for at, row in zip(np.nonzero(fold == k)[0], test, strict=True):
                want[person, int(at)] = (k, y[at], 1 / (1 + np.exp(-(row @ w + b))))
    assert got.keys() == want.keys()
    assert all(got[k][:2] == want[k][:2] and got[k][2] == pytest.approx(want[k][2], abs=1e-9) for k in want)


def test_units_of_unlike_size_step_together(monkeypatch):
    rng = np.random.default_rng(5)
    xs = [rng.normal(size=(n, 3)) for n in (2, 50, 7, 400, 7)]
    ys = [(x[:, 0] > 0).astype(float) for x in xs]
    want = [plain_fit(x, y, 40, 1.0) for x, y in zip(xs, ys, strict=True)]
    for cells in (1, 100, 1 << 20):
        monkeypatch.setattr(models, "CELLS", cells)
        for (w, b), (u, c) in zip(models.fit_units(xs, ys, 40, 1.0), want, strict=True):
            assert np.allclose(w, u) and b == pytest.approx(c)


def test_undeclared_nulls_raise(folded):
    with pytest.raises(Exception, match="b is null but not declared nullable"):
        models.backtest(folded, COLUMNS, steps=1, nullable=("a",)).collect()


def test_nested_splits_fit_first_and_calibrate_last(rows, folded):
    made = models.calibrated_backtest(folded, COLUMNS, steps=60, nullable=("b",), include_calibration=True)
    got = {}
    for r in made.collect():
        got.setdefault((r.person_id, r.fold, r.part), []).append(r)
    for person in (0, 4):
        x, y, fold = matrices(rows, person, ("b",))
        for k in range(1, 6):
            before = np.nonzero(fold < k)[0]
            cut = int(len(before) * 0.7)
            fit, later, own = before[:cut], before[cut:], np.nonzero(fold == k)[0]
            train, late = standard(x[fit], x[later])
            _, test = standard(x[fit], x[own])
            w, b = plain_fit(train, y[fit], 60, 1.0)
            raw, raw_late = (1 / (1 + np.exp(-(m @ w + b))) for m in (test, late))
            hits = int(y[later].sum())
            found = sorted(got[person, k, "test"], key=lambda r: r.session_no)
            assert [r.session_no for r in found] == own.tolist() and np.allclose([r.raw for r in found], raw)
            assert {(r.n_fit, r.n_calibration) for r in found} == {(len(fit), len(later))}
            assert sorted(r.session_no for r in got[person, k, "calibration"]) == later.tolist()
            if len(later) < 30:
                assert [r.p for r in found] == [r.raw for r in found]
            else:
                soft = np.where(y[later] == 1, (hits + 1) / (hits + 2), 1 / (len(later) - hits + 2))
                slope, offset = plain_fit(logit(raw_late)[:, None], soft, 2000, 0.0)
                assert np.allclose([r.p for r in found], 1 / (1 + np.exp(-(slope[0] * logit(raw) + offset))), atol=1e-6)


def test_empty_input(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert models.backtest(none, COLUMNS).collect() == []
    assert models.calibrated_backtest(none, COLUMNS).collect() == []


def test_budgets_are_snapshots_of_one_descent(folded):
    made = models.budgets(folded, COLUMNS, (5, 20, 60), nullable=("b",)).collect()
    got = {(r.person_id, r.session_no, r.steps): r.p for r in made}
    for steps in (5, 60):
        own = {(r.person_id, r.session_no): r.p for r in models.backtest(folded, COLUMNS, steps=steps, nullable=("b",)).collect()}
        assert len(own) * 3 == len(got) and all(got[(*k, steps)] == pytest.approx(p, abs=1e-12) for k, p in own.items())


def advanced(folded, held, chunk, **options):
    options = {"feature_set": "f1", "total": 50, "nullable": ("b",)} | options
    return models.advance(folded, held, COLUMNS, chunk=chunk, **options)


def test_chunks_equal_one_training(spark, folded):
    none = spark.createDataFrame([], models.MODEL)
    whole = {r.person_id: r for r in advanced(folded, none, 50).collect()}
    held = none
    for steps in (20, 40, 50, 50):
        held = advanced(folded, held, 20).checkpoint()
        assert {(r.steps, r.settled) for r in held.collect()} == {(steps, steps == 50)}
    for r in held.collect():
        assert np.allclose(r.weights, whole[r.person_id].weights, atol=1e-12) and r.bias == pytest.approx(whole[r.person_id].bias)
        assert r.n_rows == whole[r.person_id].n_rows


def test_new_rows_and_other_feature_sets_start_anew(spark, folded):
    held = advanced(folded, spark.createDataFrame([], models.MODEL), 50).checkpoint()
    fewer = folded.where("person_id <> 2 or rn > 3")
    again = {r.person_id: (r.steps, r.n_rows) for r in advanced(fewer, held, 10).collect()}
    assert again.pop(2)[0] == 10 and {s for s, _ in again.values()} == {50}
    assert {r.steps for r in advanced(folded, held, 10, feature_set="f2").collect()} == {10}
    assert advanced(folded.where("person_id = 1"), held, 10).count() == 1


def test_scores_are_those_of_the_models(spark, rows, folded):
    held = advanced(folded, spark.createDataFrame([], models.MODEL), 50)
    got = {(r.person_id, r.session_no): r.p for r in models.score(folded, held.where("person_id < 8"), COLUMNS, ("b",)).collect()}
    assert all(p is None for (who, _), p in got.items() if who == 8)
    for person in (0, 4):
        x, y, _ = matrices(rows, person, ("b",))
        train, _ = standard(x, x)
        w, b = plain_fit(train, y, 50, 1.0)
        for k, row in enumerate(train):
            assert got[person, k] == pytest.approx(1 / (1 + np.exp(-(row @ w + b))), abs=1e-9)
