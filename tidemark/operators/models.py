"""Logistic regression per person and fold, its calibration, and nested splits of the training windows.

Persons are spread over an explicit number of tasks and sorted by person and time; a task fits many (person, fold) units
side by side, as rows of one array, so no step of the descent is spent on one unit alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.work import spread

#: Steps of the model and of the calibration, share of a training window that calibrates, least rows for it.
STEPS, PLATT_STEPS, CALIBRATION_SHARE, LEAST_CALIBRATION = 4000, 2000, 0.3, 30
#: Numbers of the padded design matrices that a task fits at once.
CELLS = 1 << 19

_KEY = ["person_id", "category", "session_no", "window_end", "fold"]
_SCHEMA = "person_id long, category string, session_no long, window_end long, fold int, y double"


def design(frame: pd.DataFrame, columns: tuple[str, ...], nullable: tuple[str, ...] | None = None) -> np.ndarray:
    """Feature columns, then a missing indicator for each nullable one; by default all are. Other nulls raise ValueError."""
    raw = frame[list(columns)].to_numpy(float)
    held = columns if nullable is None else nullable
    for at, name in enumerate(columns):
        if name not in held and np.isnan(raw[:, at]).any():
            raise ValueError(f"{name} is null but not declared nullable")
    return np.concatenate([raw, np.isnan(raw[:, [columns.index(c) for c in held]]).astype(float)], axis=1)


def prepare(train: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Column means of known values, then means and population deviations of the filled columns; 0 deviates by 1."""
    known = ~np.isnan(train)
    fill = np.where(known.any(axis=0), np.where(known, train, 0).sum(axis=0) / np.maximum(known.sum(axis=0), 1), 0.0)
    filled = np.where(known, train, fill)
    scale = filled.std(axis=0)
    return fill, filled.mean(axis=0), np.where(scale == 0, 1.0, scale)


def ready(x: np.ndarray, prepared: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    fill, mean, scale = prepared
    return (np.where(np.isnan(x), fill, x) - mean) / scale


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def descents(
    xs: list[np.ndarray], ys: list[np.ndarray], at: list[tuple[int, ...]], penalty: float, starts: list[tuple[np.ndarray, float]] | None = None
) -> list[list[tuple[np.ndarray, float]]]:
    """Each unit's weights and bias after the numbers of steps in ``at`` (ascending), from zero or from ``starts``.

    Steps have size 1/L; the penalty of one observation spares the bias. Units of like size and like length of descent
    step together, so where a unit's rows stand in the batch changes nothing.
    """
    out: list[list[tuple[np.ndarray, float]]] = [[] for _ in xs]
    order = sorted(range(len(xs)), key=lambda u: (at[u], len(ys[u])))
    first = 0
    while first < len(order):
        stop = first + 1
        while stop < len(order) and at[order[stop]] == at[order[first]] and (stop - first + 1) * len(ys[order[stop]]) * xs[order[stop]].shape[1] <= CELLS:
            stop += 1
        some = order[first:stop]
        longest, width = max(1, len(ys[some[-1]])), xs[some[0]].shape[1]
        x, y, there = np.zeros((len(some), longest, width)), np.zeros((len(some), longest)), np.zeros((len(some), longest))
        w, b = np.zeros((len(some), width)), np.zeros((len(some), 1))
        for k, u in enumerate(some):
            x[k, : len(ys[u])], y[k, : len(ys[u])], there[k, : len(ys[u])] = xs[u], ys[u], 1.0
            if starts is not None:
                w[k], b[k, 0] = starts[u]
        n = there.sum(axis=1)
        bound = (there * (1 + (x * x).sum(axis=2))).sum(axis=1) / (4 * n) + penalty / n
        rate, across = (1 / (n * bound))[:, None], np.ascontiguousarray(x.transpose(0, 2, 1))
        done = 0
        for want in at[some[0]]:
            for _ in range(want - done):
                miss = (sigmoid((x @ w[:, :, None])[:, :, 0] + b) - y) * there
                w -= rate * ((across @ miss[:, :, None])[:, :, 0] + penalty * w)
                b -= rate * miss.sum(axis=1, keepdims=True)
            done = want
            for k, u in enumerate(some):
                out[u].append((w[k].copy(), float(b[k, 0])))
        first = stop
    return out


def fit_units(xs: list[np.ndarray], ys: list[np.ndarray], steps: int, penalty: float) -> list[tuple[np.ndarray, float]]:
    """Weights and bias of each unit after ``steps`` steps from zero."""
    return [found[0] for found in descents(xs, ys, [(steps,)] * len(xs), penalty)]


def fit_logistic(x: np.ndarray, y: np.ndarray, steps: int = STEPS, penalty: float = 1.0) -> tuple[np.ndarray, float]:
    """:func:`fit_units` of one unit."""
    return fit_units([x], [y], steps, penalty)[0]


def _logit(p: np.ndarray) -> np.ndarray:
    q = np.clip(p, 1e-9, 1 - 1e-9)
    return np.log(q / (1 - q))


def fit_platts(ps: list[np.ndarray], ys: list[np.ndarray], steps: int = PLATT_STEPS) -> list[tuple[float, float]]:
    """Slope and offset of a sigmoid over each unit's logits, fitted to soft targets; (1, 0) where a class is missing."""
    out, fits = [(1.0, 0.0)] * len(ps), []
    for u, y in enumerate(ys):
        hits = int(y.sum())
        if 0 < hits < len(y):
            fits.append((u, np.where(y == 1, (hits + 1) / (hits + 2), 1 / (len(y) - hits + 2))))
    found = fit_units([_logit(ps[u])[:, None] for u, _ in fits], [soft for _, soft in fits], steps, 0.0)
    for (u, _), (w, b) in zip(fits, found, strict=True):
        out[u] = float(w[0]), b
    return out


def fit_platt(p: np.ndarray, y: np.ndarray, steps: int = PLATT_STEPS) -> tuple[float, float]:
    """:func:`fit_platts` of one unit."""
    return fit_platts([p], [y], steps)[0]


def calibrated(p: np.ndarray, slope: float, offset: float) -> np.ndarray:
    return p if (slope, offset) == (1.0, 0.0) else sigmoid(slope * _logit(p) + offset)


def _persons(frames: Iterator[pd.DataFrame], width: int, copies: int) -> Iterator[list[pd.DataFrame]]:
    """Whole persons of a sorted stream, as many at once as CELLS allow; a larger one alone.

    ``copies`` of a person's rows are held while it is fitted. A person's rows are those of one group and are taken whole.
    """
    held: list[pd.DataFrame] = []
    size, rest = 0, None
    for frame in frames:
        frame = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
        if not len(frame):
            continue
        rest = frame[frame["person_id"] == frame["person_id"].iloc[-1]]
        for _, person in frame.iloc[: len(frame) - len(rest)].groupby("person_id", sort=False):
            held.append(person.reset_index(drop=True))
            size += len(person) * width * copies
            if size >= CELLS:
                yield held
                held, size = [], 0
        rest = rest.reset_index(drop=True)
    if rest is not None:
        held.append(rest)
    if held:
        yield held


def _by_person(df: DataFrame, order: list[str], work, schema: str, width: int, copies: int) -> DataFrame:
    """``work`` of lists of whole persons, spread over tasks; each person's rows come in ``order``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for persons in _persons(frames, width, copies):
            yield work(persons)

    return spread(df, "person_id").sortWithinPartitions("person_id", *order).mapInPandas(run, schema)


def _rows(folded: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    return folded.select(*_KEY, "rn", F.col("outcome").cast("double").alias("outcome"), *columns)


def _folds(person: pd.DataFrame) -> range:
    return range(1, int(person["fold"].max()) + 1)


def _tests(persons: list[pd.DataFrame], columns: tuple[str, ...], nullable: tuple[str, ...] | None) -> tuple[list, list, list]:
    """Prepared training rows, their outcomes, and (keys, outcomes, prepared rows) of the test, for each person and fold."""
    xs, ys, tests = [], [], []
    for person in persons:
        x, y, fold = design(person, columns, nullable), person["outcome"].to_numpy(float), person["fold"].to_numpy()
        for k in _folds(person):
            before, own = fold < k, fold == k
            prepared = prepare(x[before])
            xs.append(ready(x[before], prepared))
            ys.append(y[before])
            tests.append((person.loc[own, _KEY], y[own], ready(x[own], prepared)))
    return xs, ys, tests


def backtest(folded: DataFrame, columns: tuple[str, ...], *, steps: int = STEPS, nullable: tuple[str, ...] | None = None) -> DataFrame:
    """(person_id, category, session_no, window_end, fold, y, p) of the test rows; a fold trains on all earlier ones.

    A null in a column that isn't ``nullable`` raises ValueError; by default every column is.
    """
    return budgets(folded, columns, (steps,), nullable=nullable).drop("steps")


def budgets(folded: DataFrame, columns: tuple[str, ...], steps: tuple[int, ...], *, nullable: tuple[str, ...] | None = None) -> DataFrame:
    """The rows of :func:`backtest` for each number of ``steps`` (ascending): snapshots of one descent, so a sweep is one training."""

    def work(persons: list[pd.DataFrame]) -> pd.DataFrame:
        xs, ys, tests = _tests(persons, columns, nullable)
        out = []
        for (own, y, x), found in zip(tests, descents(xs, ys, [tuple(steps)] * len(xs), 1.0), strict=True):
            out += [own.assign(y=y, steps=n, p=sigmoid(x @ w + b)) for n, (w, b) in zip(steps, found, strict=True)]
        return pd.concat(out)

    return _by_person(_rows(folded, columns), ["rn"], work, f"{_SCHEMA}, steps long, p double", 2 * len(columns), 5)


def calibrate(predicted: DataFrame, *, steps: int = PLATT_STEPS) -> DataFrame:
    """The predictions of :func:`backtest` with ``raw`` and ``p``: a fold is calibrated by Platt's sigmoid over the folds before it.

    The first fold has nothing before it and keeps its probabilities.
    """

    def work(persons: list[pd.DataFrame]) -> pd.DataFrame:
        ps, ys, tests = [], [], []
        for person in persons:
            raw, y, fold = (person[c].to_numpy() for c in ("raw", "y", "fold"))
            for k in np.unique(fold):
                ps.append(raw[fold < k])
                ys.append(y[fold < k])
                tests.append(person[fold == k])
        out = [own.assign(p=calibrated(own["raw"].to_numpy(), *fit)) for own, fit in zip(tests, fit_platts(ps, ys, steps), strict=True)]
        return pd.concat(out)

    given = predicted.withColumnRenamed("p", "raw")
    return _by_person(given, ["fold", "window_end", "category"], work, f"{_SCHEMA}, raw double, p double", 1, 5)


def calibrated_backtest(
    folded: DataFrame, columns: tuple[str, ...], *, steps: int = STEPS, nullable: tuple[str, ...] | None = None, share: float = CALIBRATION_SHARE,
    least: int = LEAST_CALIBRATION, include_calibration: bool = False,
) -> DataFrame:
    """Test rows with ``raw`` and ``p`` from a nested split of each fold's training window.

    The window's first rows by time fit the model, its last ``share`` calibrate it by Platt's sigmoid; fewer than
    ``least`` rows leave the probabilities as they are. ``part`` is ``test``, or ``calibration`` if those rows are
    asked for, as a threshold must be chosen on them. A fold without rows to fit or to calibrate is left out.
    """

    def work(persons: list[pd.DataFrame]) -> pd.DataFrame:
        xs, ys, held = [], [], []
        for person in persons:
            x, y, fold = design(person, columns, nullable), person["outcome"].to_numpy(float), person["fold"].to_numpy()
            for k in _folds(person):
                before = np.nonzero(fold < k)[0]
                cut = int(len(before) * (1 - share))
                fit, later, own = before[:cut], before[cut:], np.nonzero(fold == k)[0]
                if not len(fit) or not len(later):
                    continue
                prepared = prepare(x[fit])
                xs.append(ready(x[fit], prepared))
                ys.append(y[fit])
                held.append((person, k, y, later, ready(x[later], prepared), own, ready(x[own], prepared)))
        raw = []
        for (*_, later_x, _, own_x), (w, b) in zip(held, fit_units(xs, ys, steps, 1.0), strict=True):
            raw.append((sigmoid(later_x @ w + b), sigmoid(own_x @ w + b)))
        enough = [len(later) >= least for _, _, _, later, *_ in held]
        platts = fit_platts(
            [p if e else p[:0] for (p, _), e in zip(raw, enough, strict=True)], [h[2][h[3]] if e else h[2][:0] for h, e in zip(held, enough, strict=True)]
        )
        out = []
        for (person, k, y, later, _, own, _), (p_later, p_own), platt in zip(held, raw, platts, strict=True):
            parts = [("test", own, p_own)] + ([("calibration", later, p_later)] if include_calibration else [])
            for part, rows, p in parts:
                named = person.iloc[rows][_KEY].assign(fold=k, y=y[rows], raw=p, p=calibrated(p, *platt), part=part)
                out.append(named.assign(n_fit=int((person["fold"] < k).sum()) - len(later), n_calibration=len(later)))
        columns_ = [*_KEY, "y", "raw", "p", "part", "n_fit", "n_calibration"]
        return pd.concat(out)[columns_] if out else pd.DataFrame({c: [] for c in columns_})

    schema = f"{_SCHEMA}, raw double, p double, part string, n_fit long, n_calibration long"
    return _by_person(_rows(folded, columns), ["rn"], work, schema, 2 * len(columns), 5)


#: A model in training: what it was made from, how far it is, and its numbers; ``settled`` once it has all its steps.
MODEL = (
    "person_id long, feature_set string, n_rows long, steps long, settled boolean, fill array<double>, mean array<double>, scale array<double>, "
    "weights array<double>, bias double"
)


def advance(
    rows: DataFrame, held: DataFrame, columns: tuple[str, ...], *, feature_set: str, chunk: int, total: int = STEPS, nullable: tuple[str, ...] | None = None
) -> DataFrame:
    """The MODEL rows of all persons after at most ``chunk`` more steps of those that aren't settled.

    ``rows``: person_id, category, window_end, outcome and the columns; ``held``: earlier MODEL rows, or none. A model
    goes on from its own numbers, so chunks give what one training gives. It starts anew if the number of its rows has
    changed, or if it is of another feature set, whose numbers would fall on the wrong columns. A person without rows
    has no model.
    """
    names = [part.split(" ")[0] for part in MODEL.split(", ")]
    state = held.where(F.col("feature_set") == feature_set).select(*names)

    def work(persons: list[pd.DataFrame]) -> pd.DataFrame:
        xs, ys, at, starts, kept = [], [], [], [], []
        for person in persons:
            own, before = person[person["n_rows"].isna()], person[person["n_rows"].notna()]
            if not len(own):
                continue
            x, y = design(own, columns, nullable), own["outcome"].to_numpy(float)
            old = before.iloc[0] if len(before) and int(before["n_rows"].iloc[0]) == len(own) else None
            if old is None:
                prepared, done, start = prepare(x), 0, (np.zeros(x.shape[1]), 0.0)
            else:
                prepared = tuple(np.array(old[c], float) for c in ("fill", "mean", "scale"))
                done, start = int(old["steps"]), (np.array(old["weights"], float), float(old["bias"]))
            xs.append(ready(x, prepared))
            ys.append(y)
            at.append((max(0, min(chunk, total - done)),))
            starts.append(start)
            kept.append((int(own["person_id"].iloc[0]), len(own), done, prepared))
        out = []
        for (who, n, done, prepared), (more,), found in zip(kept, at, descents(xs, ys, at, 1.0, starts), strict=True):
            w, b = found[0]
            out.append((who, feature_set, n, done + more, done + more >= total, *(p.tolist() for p in prepared), w.tolist(), b))
        return pd.DataFrame(out, columns=names)

    kept = rows.select("person_id", "category", "window_end", F.col("outcome").cast("double").alias("outcome"), *columns)
    both = kept.unionByName(state, allowMissingColumns=True)
    return _by_person(both, ["window_end", "category"], work, MODEL, 2 * len(columns), 3)


def score(rows: DataFrame, models: DataFrame, columns: tuple[str, ...], nullable: tuple[str, ...] | None = None) -> DataFrame:
    """``rows`` with ``p`` by their person's MODEL row, in column expressions; persons without a model have a null p."""
    held = columns if nullable is None else nullable
    raw = F.array(*(F.col(c).cast("double") for c in columns), *(F.col(c).isNull().cast("double") for c in held))
    own = models.select("person_id", F.struct("fill", "mean", "scale", "weights", "bias").alias("__m"))
    joined = rows.join(own, "person_id", "left").withColumn("__x", raw)
    at = F.sequence(F.lit(0), F.lit(len(columns) + len(held) - 1))

    def term(i):
        x = F.coalesce(F.get("__x", i), F.get("__m.fill", i))
        return (x - F.get("__m.mean", i)) / F.get("__m.scale", i) * F.get("__m.weights", i)

    z = F.aggregate(F.transform(at, term), F.lit(0.0), lambda a, t: a + t) + F.col("__m.bias")
    p = F.when(F.col("__m").isNotNull(), 1 / (1 + F.exp(-F.least(F.greatest(z, F.lit(-40.0)), F.lit(40.0)))))
    return joined.withColumn("p", p).drop("__m", "__x")
