"""k-means of every group's rows side by side, their silhouette, and the checks that tell types from a partition of noise.

A group (a person, or a person and a run) is cut into blocks of bounded size by a hash of its rows, so no task ever holds
a group. Groups of one block are fitted in one pass over the blocks; larger ones in rounds, in which blocks give partial
sums and a small table holds each group's centroids. Random numbers are hashes of (seed, group, restart, draw, row): a
rerun of a lost task gives the same rows, and no order matters.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.work import spread

#: Seed, restarts, runs of the nulls and of stability, share of a subsample, most iterations.
SEED, RESTARTS, NULL_RUNS, STABILITY_RUNS, FRACTION, ITERATIONS = 20260902, 10, 50, 25, 0.8, 100
#: Rows of a block, and numbers of the distances that a task works on at once.
BLOCK, CELLS = 4096, 1 << 20

_GOLDEN, _MIX_A, _MIX_B = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX_A
    x = (x ^ (x >> np.uint64(27))) * _MIX_B
    return x ^ (x >> np.uint64(31))


def _uniform(seed: int, groups: np.ndarray, draw: int, restarts: int, rows: np.ndarray) -> np.ndarray:
    """(groups * restarts, rows) numbers in (0, 1) that depend on their arguments alone; ``rows`` is (groups, rows)."""
    key = _mixed(np.array([seed & (2**64 - 1)], np.uint64) + _GOLDEN)
    key = _mixed(_mixed(key + groups.view(np.uint64) + _GOLDEN) + np.array([draw], np.uint64) + _GOLDEN)
    per = _mixed(key[:, None] + _GOLDEN * np.arange(1, restarts + 1, dtype=np.uint64))
    cell = _mixed(per[:, :, None] ^ rows.view(np.uint64)[:, None, :])
    return ((cell >> np.uint64(11)).astype(float).reshape(-1, rows.shape[1]) + 0.5) / 2.0**53


def _squares(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """(fits, rows, clusters) squared distances of (fits, rows, width) to (fits, clusters, width)."""
    total, planes = np.zeros((len(x), centroids.shape[1], x.shape[1])), np.ascontiguousarray(x.transpose(2, 0, 1))
    for axis, plane in enumerate(planes):  # no array has all four dimensions, and rows lie side by side
        away = plane[:, None, :] - centroids[:, :, axis, None]
        total += np.multiply(away, away, out=away)
    return total.transpose(0, 2, 1)


def _seed_keys(x: np.ndarray, centroids: np.ndarray, u: np.ndarray, near: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Exponential keys of the rows, weighted by the squared distance to the nearest centroid, and unweighted ones.

    The least key of all rows is a draw in proportion to the weights; where all weights are 0, the unweighted one counts.
    ``near``: those distances, if they are known.
    """
    plain = -np.log(u)
    if not centroids.shape[1]:
        return plain, plain
    near = _squares(x, centroids).min(axis=2) if near is None else near
    with np.errstate(divide="ignore"):
        return np.where(near > 0, plain / near, np.inf), plain


def _partial(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(counts, sums, inertia, farthest) of each fit; the farthest row is (distance, x), of equal ones the first."""
    squares = _squares(x, centroids)
    near = squares.min(axis=2)
    hit, free = squares.transpose(0, 2, 1) == near[:, None, :], np.ones(near.shape, bool)
    for cluster in range(hit.shape[1]):  # of equal distances the first
        hit[:, cluster] &= free
        free &= ~hit[:, cluster]
    member = hit.astype(float)
    top, every = near.argmax(axis=1), np.arange(len(near))
    far = np.concatenate([near[every, top][:, None], x[every, top]], axis=1)
    return member.sum(axis=2), member @ x, near.sum(axis=1), far


def _moved(counts: np.ndarray, sums: np.ndarray, far: np.ndarray) -> np.ndarray:
    """New centroids: means of members; an empty cluster starts again at the row farthest from its centroid."""
    means = sums / np.maximum(counts, 1)[:, :, None]
    return np.where((counts > 0)[:, :, None], means, far[:, None, :])


def _fit(x: np.ndarray, rows: np.ndarray, groups: np.ndarray, k: int, restarts: int, seed: int, iterations: int) -> tuple[np.ndarray, np.ndarray]:
    """(inertia, centroids) of the best restart, the first of equal ones, of groups of one block and one size."""
    n_groups, n, width = x.shape
    each = np.repeat(x, restarts, axis=0) if n_groups > 1 else np.broadcast_to(x, (restarts, n, width))
    every, centroids, near = np.arange(len(each)), np.zeros((len(each), 0, width)), np.full((len(each), n), np.inf)
    for draw in range(k):
        keys, plain = _seed_keys(each, centroids, _uniform(seed, groups, draw, restarts, rows), near)
        pick = np.where(np.isfinite(keys).any(axis=1), keys.argmin(axis=1), plain.argmin(axis=1))
        centroids = np.concatenate([centroids, each[every, pick][:, None, :]], axis=1)
        near = np.minimum(near, _squares(each, centroids[:, -1:])[:, :, 0])
    moving = every
    for _ in range(iterations):
        counts, sums, _, far = _partial(each[moving], centroids[moving])
        new = _moved(counts, sums, far[:, 1:])
        still = (new != centroids[moving]).any(axis=(1, 2))
        centroids[moving] = new
        moving = moving[still]
        if not len(moving):
            break
    inertia = _partial(each, centroids)[2].reshape(n_groups, restarts)
    best = inertia.argmin(axis=1)
    own = np.arange(n_groups)
    return inertia[own, best], centroids.reshape(n_groups, restarts, k, width)[own, best]


def standardised(points: DataFrame, by: list[str], features: tuple[str, ...]) -> DataFrame:
    """``points`` with ``x``: the features less their group's mean, over its population deviation; 0 where none varies.

    Rows with a null feature are left out.
    """
    known = points.where(" and ".join(f"`{c}` is not null" for c in features))
    of = {c: (F.avg(c).alias(f"__m{i}"), F.stddev_pop(c).alias(f"__s{i}")) for i, c in enumerate(features)}
    joined = known.join(known.groupBy(*by).agg(*(a for pair in of.values() for a in pair)), by)
    x = F.array(*((F.col(c) - F.col(f"__m{i}")) / F.when(F.col(f"__s{i}") > 0, F.col(f"__s{i}")).otherwise(1.0) for i, c in enumerate(features)))
    return joined.withColumn("x", x).drop(*(f"__{p}{i}" for i in range(len(features)) for p in "ms"))


def blocked(points: DataFrame, by: list[str], row: str, *, size: int = BLOCK) -> DataFrame:
    """(by, group, block, blocks, ids, rows, x): the groups' rows in blocks of about ``size``, in the order of their hashes.

    ``points`` has ``x``, an array of doubles. ``x`` of a block is flat; ``group`` and ``rows`` are hashes.
    """
    counts = points.groupBy(*by).agg(F.ceil(F.count("*") / size).cast("int").alias("blocks"))
    keyed = points.select(*by, F.col(row).alias("id"), F.xxhash64(row).alias("h"), "x").join(counts, by)
    held = keyed.withColumn("block", F.pmod(F.xxhash64("h"), F.col("blocks")).cast("int"))
    rows = held.groupBy(*by, "blocks", "block").agg(F.sort_array(F.collect_list(F.struct("h", "id", "x"))).alias("r"))
    return rows.select(
        *by, F.xxhash64(*by).alias("group"), "block", "blocks", F.col("r.id").alias("ids"), F.col("r.h").alias("rows"), F.flatten("r.x").alias("x")
    )


def _keys(df: DataFrame, by: list[str]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by)


def _matrix(flat: list[float], rows: int) -> np.ndarray:
    return np.array(flat, float).reshape(rows, -1)


def _over_blocks(df: DataFrame, by: list[str], work, result: str) -> DataFrame:
    """``work(row)`` of each block as a row (by, *result); the row is a dict of the block's columns."""
    names = [part.split(" ")[0] for part in result.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [work(row) for row in batch.to_pylist()]
            columns = [batch.column(batch.schema.get_field_index(c)) for c in by]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array([m[i] for m in made], t) for i, t in enumerate(types))], names=[*by, *names])

    kinds = {"double": pa.float64(), "long": pa.int64(), "array<double>": pa.list_(pa.float64()), "array<int>": pa.list_(pa.int32())}
    types = [kinds[part.split(" ")[1]] for part in result.split(", ")]
    return df.mapInArrow(run, f"{_keys(df, by)}, {result}")


def _number_of(k: int | str, row: dict) -> int:
    return row[k] if isinstance(k, str) else k


def _number(k: int | str) -> Column:
    return F.col(k) if isinstance(k, str) else F.lit(k)


def kmeans(
    blocks: DataFrame, by: list[str], k: int | str, *, restarts: int = RESTARTS, seed: int = SEED, iterations: int = ITERATIONS
) -> DataFrame:
    """(by, inertia, centroids) of each group of at least ``k`` rows: the best of the restarts, the first of equal ones.

    Seeds are drawn in proportion to the squared distance to the nearest one so far. A fit ends when no centroid moves,
    or after ``iterations``; an empty cluster starts again at the row farthest from its centroid. ``centroids`` is flat.
    ``k`` may name an integer column of ``by``, so that a sweep over k is one pass.
    """
    if not isinstance(k, str) and k < 2:
        raise ValueError(f"k must be at least 2, got {k}")

    def fits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, held = batch.to_pylist(), {}
            for at, row in enumerate(found):
                held.setdefault((len(row["rows"]), _number_of(k, row)), []).append(at)
            made: list = [None] * len(found)
            for (n, number), places in held.items():  # groups of one size step side by side
                width = len(found[places[0]]["x"]) // n
                step = max(1, CELLS // (restarts * n * number * width))
                for at in range(0, len(places), step):
                    some = places[at : at + step]
                    x = np.array([found[p]["x"] for p in some]).reshape(-1, n, width)
                    rows, groups = np.array([found[p]["rows"] for p in some]), np.array([found[p]["group"] for p in some])
                    inertia, centroids = _fit(x, rows, groups, number, restarts, seed, iterations)
                    for p, i, c in zip(some, inertia, centroids, strict=True):
                        made[p] = float(i), c.ravel().tolist()
            columns = [batch.column(batch.schema.get_field_index(c)) for c in by]
            values = pa.array([m[0] for m in made], pa.float64()), pa.array([m[1] for m in made], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*columns, *values], names=[*by, "inertia", "centroids"])

    alone = blocks.where((F.col("blocks") == 1) & (F.size("rows") >= _number(k)))
    single = alone.mapInArrow(fits, f"{_keys(blocks, by)}, inertia double, centroids array<double>")
    several = blocks.where("blocks > 1")  # more rows than any k
    if several.isEmpty():
        return single
    return single.unionByName(_kmeans_in_rounds(several, by, k, restarts, seed, iterations))


def _kmeans_in_rounds(blocks: DataFrame, by: list[str], number: int | str, restarts: int, seed: int, iterations: int) -> DataFrame:
    """:func:`kmeans` of groups of several blocks: a round is a pass over the blocks of the groups that still move."""
    state = blocks.groupBy(*by).agg(F.lit(0).alias("step"), F.lit(False).alias("settled"), F.array().cast("array<double>").alias("centroids"))
    state_schema = f"{_keys(blocks, by)}, step int, settled boolean, centroids array<double>"

    def centroids_of(flat: list[float], width: int) -> np.ndarray:
        return np.array(flat, float).reshape(restarts, -1, width)

    def block_part(row: dict) -> tuple[list[float]]:
        rows = np.array(row["rows"], np.int64)
        x = _matrix(row["x"], len(rows))
        centroids = centroids_of(row["centroids"], x.shape[1])
        each = np.broadcast_to(x, (restarts, *x.shape))
        if row["step"] < _number_of(number, row):  # the best seed of the block: weighted key, plain key, x for both
            u = _uniform(seed, np.array([row["group"]], np.int64), row["step"], restarts, rows[None, :])
            keys, plain = _seed_keys(each, centroids, u)
            a, b, every = keys.argmin(axis=1), plain.argmin(axis=1), np.arange(restarts)
            return (np.concatenate([keys[every, a][:, None], plain[every, b][:, None], x[a], x[b]], axis=1).ravel().tolist(),)
        counts, sums, inertia, far = _partial(each, centroids)
        return (np.concatenate([counts, sums.reshape(restarts, -1), inertia[:, None], far], axis=1).ravel().tolist(),)

    def together(pdf: pd.DataFrame) -> pd.DataFrame:
        k = _number_of(number, {c: int(pdf[c].iloc[0]) for c in by if c == number})
        step, old = int(pdf["step"].iloc[0]), np.array(pdf["centroids"].iloc[0], float)
        parts = np.stack([np.array(p, float) for p in pdf.sort_values("block")["part"]]).reshape(len(pdf), restarts, -1)
        every = np.arange(restarts)
        if step < k:
            width = (parts.shape[2] - 2) // 2
            a, b = parts[:, :, 0].argmin(axis=0), parts[:, :, 1].argmin(axis=0)
            seeds = np.where(np.isfinite(parts[:, :, 0].min(axis=0))[:, None], parts[a, every, 2 : 2 + width], parts[b, every, 2 + width :])
            new = np.concatenate([old.reshape(restarts, -1, width), seeds[:, None, :]], axis=1)
            settled = False
        else:
            width = old.size // (restarts * k)
            before = old.reshape(restarts, k, width)
            counts, sums = parts[:, :, :k].sum(axis=0), parts[:, :, k : k + k * width].sum(axis=0).reshape(restarts, k, width)
            farthest = parts[:, :, k + k * width + 1].argmax(axis=0)
            new = _moved(counts, sums, parts[farthest, every, k + k * width + 2 :])
            settled = step - k + 1 >= iterations or bool(np.allclose(new, before, rtol=1e-12, atol=1e-12))
        out = {c: [pdf[c].iloc[0]] for c in by} | {"step": [step + 1], "settled": [settled], "centroids": [new.ravel().tolist()]}
        return pd.DataFrame(out)

    done: DataFrame | None = None
    while True:
        moving = blocks.join(state, by)
        part_schema = "block long, step long, part array<double>"
        parts = _over_blocks(moving, by, lambda row: (row["block"], row["step"], *block_part(row)), part_schema)
        state = parts.join(state.select(*by, "centroids"), by).groupBy(*by).applyInPandas(together, state_schema).checkpoint()
        now = state.where("settled")
        done = now if done is None else done.unionByName(now)
        state = state.where("not settled")
        if state.isEmpty():
            break

    def inertia(row: dict) -> tuple[list[float]]:
        rows = np.array(row["rows"], np.int64)
        x = _matrix(row["x"], len(rows))
        return (_partial(np.broadcast_to(x, (restarts, *x.shape)), centroids_of(row["centroids"], x.shape[1]))[2].tolist(),)

    sums = _over_blocks(blocks.join(done, by), by, inertia, "inertia array<double>")
    per = sums.select(*by, F.posexplode("inertia").alias("restart", "i")).groupBy(*by, "restart").agg(F.sum("i").alias("i"))
    best = per.groupBy(*by).agg(F.min(F.struct("i", "restart")).alias("b"))
    width = F.size("centroids") / restarts
    own = F.slice("centroids", (F.col("b.restart") * width + 1).cast("int"), width.cast("int"))
    return done.join(best, by).select(*by, F.col("b.i").alias("inertia"), own.alias("centroids"))


def labelled(blocks: DataFrame, centers: DataFrame, by: list[str]) -> DataFrame:
    """The blocks of the fitted groups with ``labels``: the nearest centroid of each row, of equal ones the first."""

    def nearest(row: dict) -> tuple:
        x = _matrix(row["x"], len(row["ids"]))
        labels = _squares(x[None], np.array(row["centroids"], float).reshape(1, -1, x.shape[1]))[0].argmin(axis=1)
        return row["group"], row["block"], row["blocks"], row["rows"], row["x"], labels.tolist(), len(row["centroids"]) // x.shape[1]

    result = "group long, block long, blocks long, rows array<long>, x array<double>, labels array<int>, n_clusters long"
    kinds = {"array<long>": pa.list_(pa.int64())}
    joined = blocks.join(centers.select(*by, "centroids"), by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [nearest(row) for row in batch.to_pylist()]
            types = [pa.int64(), pa.int64(), pa.int64(), kinds["array<long>"], pa.list_(pa.float64()), pa.list_(pa.int32()), pa.int64()]
            columns = [batch.column(batch.schema.get_field_index(c)) for c in [*by, "ids"]]
            names = [*by, "ids", "group", "block", "blocks", "rows", "x", "labels", "n_clusters"]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array([m[i] for m in made], t) for i, t in enumerate(types))], names=names)

    ids = blocks.schema["ids"].dataType.simpleString()
    return joined.mapInArrow(run, f"{_keys(blocks, by)}, ids {ids}, {result}")


def assignments(marked: DataFrame, by: list[str], row: str) -> DataFrame:
    """(by, row, cluster) of the rows of :func:`labelled`."""
    pairs = F.explode(F.arrays_zip("ids", "labels")).alias("p")
    return marked.select(*by, pairs).select(*by, F.col("p.ids").alias(row), F.col("p.labels").alias("cluster"))


def _distance_sums(x: np.ndarray, others: np.ndarray, labels: np.ndarray, k: int) -> np.ndarray:
    """(rows, k): sums of the Euclidean distances to the members of each cluster among ``others``."""
    out = np.zeros((len(x), k))
    for at in range(0, len(x), 512):  # 512 x BLOCK distances at once
        distance = np.sqrt(((x[at : at + 512, None, :] - others[None, :, :]) ** 2).sum(axis=2))
        for cluster in range(k):
            out[at : at + 512, cluster] = distance[:, labels == cluster].sum(axis=1)
    return out


def _widths(sums: np.ndarray, labels: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Silhouette width of each row; 0 for the only row of its cluster and where all distances are 0."""
    every = np.arange(len(labels))
    own = sums[every, labels] / np.maximum(counts[labels] - 1, 1)
    means = np.where(counts > 0, sums / np.maximum(counts, 1), np.inf)
    means[every, labels] = np.inf
    other = means.min(axis=1)
    widest = np.maximum(own, other)
    return np.where((counts[labels] < 2) | (widest == 0), 0.0, (other - own) / np.where(widest == 0, 1.0, widest))


def silhouette(marked: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, silhouette): the mean width over each group's rows, by Euclidean distance; null if under two clusters hold rows.

    Every row meets all rows of its group, block by block: a pair of blocks is a unit of work of bounded size.
    """

    def alone(row: dict) -> tuple[int, float | None]:
        labels = np.array(row["labels"])
        x = _matrix(row["x"], len(labels))
        counts = np.bincount(labels, minlength=row["n_clusters"])
        if (counts > 0).sum() < 2:
            return len(labels), None
        return len(labels), float(_widths(_distance_sums(x, x, labels, row["n_clusters"]), labels, counts).mean())

    single = _over_blocks(marked.where("blocks = 1"), by, alone, "n long, silhouette double")
    several = marked.where("blocks > 1")
    if several.isEmpty():
        return single

    def pair(row: dict) -> tuple[int, list[float]]:
        labels = np.array(row["their_labels"])
        x, others = _matrix(row["x"], len(row["labels"])), _matrix(row["their_x"], len(labels))
        return row["block"], _distance_sums(x, others, labels, row["n_clusters"]).ravel().tolist()

    theirs = several.select(*by, F.col("x").alias("their_x"), F.col("labels").alias("their_labels"))
    spread = several.join(theirs, by).repartition(*by, "block", F.xxhash64("their_x"))
    sums = _over_blocks(spread, by, pair, "block long, sums array<double>")
    cells = sums.select(*by, "block", F.posexplode("sums").alias("cell", "s")).groupBy(*by, "block", "cell").agg(F.sum("s").alias("s"))
    whole = cells.groupBy(*by, "block").agg(F.transform(F.sort_array(F.collect_list(F.struct("cell", "s"))), lambda c: c["s"]).alias("sums"))
    counts = several.select(*by, F.explode("labels").alias("c")).groupBy(*by, "c").agg(F.count("*").alias("m"))
    table = counts.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("c", "m"))).alias("of")).select(*by, "of")
    joined = several.join(whole, [*by, "block"]).join(table, by)
    listed = F.transform(F.sequence(F.lit(0), (F.col("n_clusters") - 1).cast("int")), lambda c: F.coalesce(F.element_at("of", c), F.lit(0).cast("long")))

    def widths(row: dict) -> tuple[int, float | None]:
        labels, counts = np.array(row["labels"]), np.array(row["counts"])
        if (counts > 0).sum() < 2:
            return len(labels), None
        return len(labels), float(_widths(_matrix(row["sums"], len(labels)), labels, counts).sum())

    parts = _over_blocks(joined.withColumn("counts", listed).drop("of"), by, widths, "n long, w double")
    multi = parts.groupBy(*by).agg(F.sum("n").alias("n"), (F.sum("w") / F.sum("n")).alias("silhouette"))
    return single.unionByName(multi)


def permuted(points: DataFrame, by: list[str], row: str, runs: int = NULL_RUNS, seed: int = SEED) -> DataFrame:
    """(by, run, row, x): for each run the groups' rows with every column permuted on its own.

    A permutation orders the rows of a column by a hash of (seed, run, column, row); rows are numbered from 1.
    """
    repeated = points.select(*by, row, "x", F.explode(F.sequence(F.lit(1), F.lit(runs))).alias("run"))
    cells = repeated.select(*by, "run", row, F.posexplode("x").alias("column", "v"))
    order = F.xxhash64(F.lit(seed), "run", "column", row)
    placed = cells.withColumn("place", F.row_number().over(Window.partitionBy(*by, "run", "column").orderBy(order, row)))
    rows = placed.groupBy(*by, "run", "place").agg(F.sort_array(F.collect_list(F.struct("column", "v"))).alias("c"))
    return rows.select(*by, "run", F.col("place").alias(row), F.col("c.v").alias("x"))


def _normal(*parts: Column | str) -> Column:
    """A standard normal number that depends on its arguments alone."""
    def uniform(salt: int) -> Column:
        return (F.shiftrightunsigned(F.xxhash64(F.lit(salt), *parts), 11).cast("double") + 0.5) / 2.0**53

    return F.sqrt(-2 * F.ln(uniform(1))) * F.cos(2 * F.pi() * uniform(2))


def gaussian(points: DataFrame, by: list[str], row: str, width: int, runs: int = NULL_RUNS, seed: int = SEED, ridge: float = 1e-9) -> DataFrame:
    """(by, run, row, x): for each run as many rows as the group has, from one normal of its mean and covariance.

    The covariance's Cholesky factor is made of columns; its pivots are ``ridge`` at least, so constant columns do.
    """
    cell = [F.col("x")[i] for i in range(width)]
    means = points.groupBy(*by).agg(*(F.avg(cell[i]).alias(f"m{i}") for i in range(width)))
    near = points.join(means, by)
    off = [cell[i] - F.col(f"m{i}") for i in range(width)]
    factor = near.groupBy(*by).agg(
        *(F.first(f"m{i}").alias(f"m{i}") for i in range(width)), *(F.avg(off[i] * off[j]).alias(f"c{i}_{j}") for i in range(width) for j in range(i + 1))
    )
    for j in range(width):  # column by column of the factor
        pivot = F.col(f"c{j}_{j}") - sum((F.pow(F.col(f"l{j}_{p}"), 2) for p in range(j)), F.lit(0.0))
        factor = factor.withColumn(f"l{j}_{j}", F.sqrt(F.greatest(pivot, F.lit(ridge))))
        for i in range(j + 1, width):
            rest = F.col(f"c{i}_{j}") - sum((F.col(f"l{i}_{p}") * F.col(f"l{j}_{p}") for p in range(j)), F.lit(0.0))
            factor = factor.withColumn(f"l{i}_{j}", rest / F.col(f"l{j}_{j}"))
    drawn = points.select(*by, row, F.explode(F.sequence(F.lit(1), F.lit(runs))).alias("run"))
    for j in range(width):
        drawn = drawn.withColumn(f"z{j}", _normal(F.lit(seed), F.lit(j), "run", row, *by))
    joined = drawn.join(factor, by)
    x = [F.col(f"m{i}") + sum((F.col(f"l{i}_{j}") * F.col(f"z{j}") for j in range(i + 1)), F.lit(0.0)) for i in range(width)]
    return joined.select(*by, "run", row, F.array(*x).alias("x"))


def silhouettes(points: DataFrame, by: list[str], row: str, k: int | str, **options) -> DataFrame:
    """(by, n, silhouette) of a fresh fit of each group."""
    blocks = blocked(points, by, row, size=options.pop("size", BLOCK))
    return silhouette(labelled(blocks, kmeans(blocks, by, k, **options), by), by)


def band(runs: DataFrame, by: list[str], value: str, level: float = 0.95) -> DataFrame:
    """(by, median, low, high, runs) of a value over runs; runs without a value don't count."""
    tail = (1 - level) / 2
    cut = lambda p, name: F.percentile(value, p).alias(name)
    return runs.groupBy(*by).agg(cut(0.5, "median"), cut(tail, "low"), cut(1 - tail, "high"), F.count(value).alias("runs"))


def _sized(points: DataFrame, by: list[str], size: int) -> tuple[DataFrame, DataFrame | None]:
    """``points`` of groups of up to ``size`` rows, which a task may hold, and those of larger ones; None if there are none."""
    large = points.groupBy(*by).agg(F.count("*").alias("__n")).where(F.col("__n") > size).select(*by)
    if large.isEmpty():
        return points, None
    return points.join(large, by, "left_anti"), points.join(large, by, "left_semi")


def _packed(points: DataFrame, by: list[str], row: str) -> DataFrame:
    """(by, ids, rows, x) of each group in the order of the rows' hashes, as :func:`blocked` has it, spread over tasks."""
    held = points.select(*by, F.col(row).alias("id"), F.xxhash64(row).alias("h"), "x")
    rows = held.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("h", "id", "x"))).alias("r"))
    return spread(rows, *by).select(*by, F.col("r.id").alias("ids"), F.col("r.h").alias("rows"), F.flatten("r.x").alias("x"))


def _hashed(*parts: Column | str) -> Column:
    """A hash of ``parts`` and the id, for each of a group's ids."""
    return F.transform("ids", lambda i: F.xxhash64(*parts, i))


def _over_sizes(packed: DataFrame, by: list[str], ks: list[int], restarts: int, work, value: str) -> DataFrame:
    """(by, k, n, ``value``): ``work(cells, k, x)`` of groups of one size side by side, for each k that they have rows for.

    ``cells`` maps the list columns to (groups, …) arrays and ``x`` is (groups, rows, width). A value that is no number
    is null. ``groups`` of ``packed`` has random seeds for each k in turn.
    """
    lists = [c for c, kind in packed.dtypes if kind in ("array<bigint>", "array<double>") and c != "ids" and c not in by]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {c: batch.column(batch.schema.get_field_index(c)) for c in (*by, *lists)}
            parts = {c: (columns[c].offsets.to_numpy(), columns[c].values.to_numpy()) for c in lists}
            sizes = np.diff(parts["rows"][0])
            for n in np.unique(sizes).tolist():
                places = np.nonzero(sizes == n)[0]
                step = max(1, CELLS // (n * max(restarts * max(ks), n)))
                for at in range(0, len(places), step):
                    some = places[at : at + step]
                    cells = {c: np.stack([values[offsets[p] : offsets[p + 1]] for p in some]) for c, (offsets, values) in parts.items()}
                    own = [columns[c].take(pa.array(some)) for c in by]
                    ready = None
                    for number, k in enumerate(ks):
                        if k > n:
                            continue
                        ready, found = work(cells | {"groups": cells["groups"].reshape(len(some), -1, len(ks))[:, :, number]}, k, ready)
                        made = pa.array(found, pa.float64(), mask=np.isnan(found))
                        yield pa.RecordBatch.from_arrays([*own, pa.array([k] * len(some), pa.int32()), pa.array([n] * len(some), pa.int64()), made], names=[*by, "k", "n", value])

    return packed.select(*by, *lists).mapInArrow(run, f"{_keys(packed, by)}, k int, n long, {value} double")


def _labels(x: np.ndarray, rows: np.ndarray, groups: np.ndarray, k: int, restarts: int, seed: int, iterations: int) -> np.ndarray:
    """(groups, rows): the nearest centroid of each row in the best fit of its group."""
    return _squares(x, _fit(x, rows, groups, k, restarts, seed, iterations)[1]).argmin(axis=2)


def _mean_widths(x: np.ndarray, labels: np.ndarray, k: int, distances: np.ndarray | None) -> np.ndarray:
    """The mean silhouette width of each group; no number if under two clusters hold rows."""
    member = (labels[:, :, None] == np.arange(k)).astype(float)
    counts = member.sum(axis=1)
    sums = np.stack([_distance_sums(one, one, own, k) for one, own in zip(x, labels, strict=True)]) if distances is None else distances @ member
    size = np.take_along_axis(counts, labels, axis=1)
    own = np.take_along_axis(sums, labels[:, :, None], axis=2)[:, :, 0] / np.maximum(size - 1, 1)
    others = (counts[:, None, :] > 0) & (member == 0)
    other = np.where(others, sums / np.maximum(counts, 1)[:, None, :], np.inf).min(axis=2)
    widest = np.maximum(own, other)
    with np.errstate(invalid="ignore"):
        widths = np.where((size < 2) | (widest == 0), 0.0, (other - own) / np.where(widest == 0, 1.0, widest))
    return np.where((counts > 0).sum(axis=1) < 2, np.nan, widths.mean(axis=1))


def _scored(packed: DataFrame, by: list[str], ks: list[int], drawn, *, restarts: int = RESTARTS, seed: int = SEED, iterations: int = ITERATIONS) -> DataFrame:
    """(by, k, n, silhouette): fit, labels and widths of a group in one task; ``drawn(cells)`` gives its (rows' hashes, x)."""

    def work(cells: dict, k: int, ready: tuple | None) -> tuple:
        if ready is None:
            rows, x = drawn(cells)
            # what all k share; a large group's distances go slice by slice
            ready = rows, x, np.sqrt(_squares(x, x)) if x.shape[1] <= 1024 else None
        rows, x, distances = ready
        labels = _labels(x, rows, cells["groups"][:, 0], k, restarts, seed, iterations)
        return ready, _mean_widths(x, labels, k, distances)

    return _over_sizes(packed, by, ks, restarts, work, "silhouette")


def _as_they_are(cells: dict) -> tuple[np.ndarray, np.ndarray]:
    return cells["rows"], cells["x"].reshape(*cells["rows"].shape, -1)


def _permuted_cells(cells: dict) -> tuple[np.ndarray, np.ndarray]:
    """What :func:`permuted` gives: each column in the order of its hashes, then the places in the order of theirs."""
    rows, x = _as_they_are(cells)
    order = cells["order"].reshape(len(x), -1, x.shape[1]).argsort(axis=2, kind="stable").transpose(0, 2, 1)
    places = cells["places"].argsort(axis=1, kind="stable")
    return np.take_along_axis(cells["places"], places, axis=1), np.take_along_axis(np.take_along_axis(x, order, axis=1), places[:, :, None], axis=1)


def _gaussian_cells(cells: dict, ridge: float = 1e-9) -> tuple[np.ndarray, np.ndarray]:
    """What :func:`gaussian` gives, from the standard normal numbers ``z`` of each column."""
    rows, x = _as_they_are(cells)
    mean = x.mean(axis=1, keepdims=True)
    off, width = x - mean, x.shape[2]
    covariance, factor = off.transpose(0, 2, 1) @ off / x.shape[1], np.zeros((len(x), width, width))
    for j in range(width):
        factor[:, j, j] = np.sqrt(np.maximum(covariance[:, j, j] - (factor[:, j, :j] ** 2).sum(axis=1), ridge))
        for i in range(j + 1, width):
            factor[:, i, j] = (covariance[:, i, j] - (factor[:, i, :j] * factor[:, j, :j]).sum(axis=1)) / factor[:, j, j]
    z = cells["z"].reshape(len(x), width, -1)
    return rows, mean + (factor @ z).transpose(0, 2, 1)


def _seeds(ks: list[int], by: list[str], *after: Column | str) -> Column:
    return F.array(*(F.xxhash64(*by, F.lit(k), *after) for k in ks)).alias("groups")


def swept_silhouettes(points: DataFrame, by: list[str], row: str, ks: Iterable[int], *, size: int = BLOCK, **options) -> DataFrame:
    """(by, k, n, silhouette) of a fresh fit of each group for each of ``ks``; a group of up to ``size`` rows is read once."""
    ks = list(ks)
    small, large = _sized(points, by, size)
    found = _scored(_packed(small, by, row).select("*", _seeds(ks, by)), by, ks, _as_they_are, **options)
    if large is None:
        return found
    swept = large.withColumn("k", F.explode(F.array(*map(F.lit, ks))))
    return found.unionByName(silhouettes(swept, [*by, "k"], row, "k", size=size, **options))


def _null_silhouettes(points: DataFrame, by: list[str], row: str, ks: list[int], width: int, runs: int, seed: int, **options) -> DataFrame:
    """(by, run, k, n, silhouette, null) of groups that a task may hold: it draws the nulls itself from hashes made here."""
    each = _packed(points, by, row).withColumn("run", F.explode(F.sequence(F.lit(1), F.lit(runs))))
    columns, key = range(width), [*by, "run"]
    places = F.transform(F.sequence(F.lit(1), F.size("ids")), lambda p: F.xxhash64(p.cast(points.schema[row].dataType))).alias("places")
    order = F.flatten(F.array(*(_hashed(F.lit(seed), "run", F.lit(c)) for c in columns))).alias("order")
    numbers = lambda c: F.transform("ids", lambda i: _normal(F.lit(seed), F.lit(c), "run", i, *by))
    normal = F.flatten(F.array(*map(numbers, columns))).alias("z")
    mixed = each.select(*key, "ids", "rows", "x", order, places, _seeds(ks, by, F.lit("permuted"), "run"))
    drawn = each.select(*key, "ids", "rows", "x", normal, _seeds(ks, by, F.lit("gaussian"), "run"))
    made = {"permuted": _scored(mixed, key, ks, _permuted_cells, seed=seed, **options), "gaussian": _scored(drawn, key, ks, _gaussian_cells, seed=seed, **options)}
    return made["permuted"].withColumn("null", F.lit("permuted")).unionByName(made["gaussian"].withColumn("null", F.lit("gaussian")))


def null_bands(
    points: DataFrame, by: list[str], row: str, ks: Iterable[int], width: int, *, runs: int = NULL_RUNS, seed: int = SEED, size: int = BLOCK, **options
) -> DataFrame:
    """(by, k, null, median, low, high, runs): the silhouette's band over permuted columns and over one normal."""
    ks = list(ks)
    small, large = _sized(points, by, size)
    scored = _null_silhouettes(small, by, row, ks, width, runs, seed, **options)
    if large is not None:
        made = permuted(large, by, row, runs, seed).withColumn("null", F.lit("permuted")).unionByName(
            gaussian(large, by, row, width, runs, seed).withColumn("null", F.lit("gaussian"))
        )
        swept = made.withColumn("k", F.explode(F.array(*map(F.lit, ks))))
        scored = scored.unionByName(silhouettes(swept, [*by, "k", "null", "run"], row, "k", seed=seed, size=size, **options))
    return band(scored, [*by, "k", "null"], "silhouette")


def agreement(pairs: DataFrame, by: list[str], left: str, right: str) -> DataFrame:
    """(by, items, agreement): the share of pairs of items that two partitions both join or both part; null below two.

    ``pairs`` has a row for each item with its class in both. Pairs are counted from the classes' sizes, never formed:
    all pairs, less those joined on one side, plus twice those joined on both.
    """
    choose = lambda c: F.col(c) * (F.col(c) - 1) / 2
    cells = pairs.groupBy(*by, left, right).agg(F.count("*").cast("double").alias("c"))
    both = cells.groupBy(*by).agg(F.sum(choose("c")).alias("both"), F.sum("c").alias("n"))
    one = lambda side: cells.groupBy(*by, side).agg(F.sum("c").alias("c")).groupBy(*by).agg(F.sum(choose("c")).alias(f"in_{side}"))
    joined = both.join(one(left), by).join(one(right), by)
    share = (choose("n") - F.col(f"in_{left}") - F.col(f"in_{right}") + 2 * F.col("both")) / F.nullif(choose("n"), F.lit(0.0))
    return joined.select(*by, F.col("n").cast("long").alias("items"), share.alias("agreement"))


def stability(
    points: DataFrame, by: list[str], row: str, k: int | str, *, runs: int = STABILITY_RUNS, fraction: float = FRACTION, seed: int = SEED, **options
) -> DataFrame:
    """(by, stability, runs): how often rows that two subsamples share are joined or parted by both of their fits.

    A subsample has the rows with the least hashes of (seed, run, half, row): ``fraction`` of them, ``k`` at least.
    Runs in which two subsamples share under two rows don't count; groups of under ``k`` rows have no row.
    """
    halves = points.select(*by, row, "x", F.explode(F.sequence(F.lit(1), F.lit(runs))).alias("run"), F.explode(F.array(F.lit(1), F.lit(2))).alias("half"))
    key = [*by, "run", "half"]
    order = Window.partitionBy(*key).orderBy(F.xxhash64(F.lit(seed), "run", "half", row), row)
    numbered = halves.withColumn("place", F.row_number().over(order)).withColumn("n", F.count("*").over(Window.partitionBy(*key)))
    size = F.greatest(_number(k).cast("long"), F.floor(F.col("n") * fraction))
    kept = numbered.where((F.col("n") >= _number(k)) & (F.col("place") <= size)).select(*key, row, "x")
    blocks = blocked(kept, key, row, size=options.pop("size", BLOCK))
    found = assignments(labelled(blocks, kmeans(blocks, key, k, seed=seed, **options), key), key, row)
    shared = found.groupBy(*by, "run", row).agg(
        F.max(F.when(F.col("half") == 1, F.col("cluster"))).alias("left"), F.max(F.when(F.col("half") == 2, F.col("cluster"))).alias("right")
    ).where("left is not null and right is not null")
    return agreement(shared, [*by, "run"], "left", "right").groupBy(*by).agg(F.avg("agreement").alias("stability"), F.count("agreement").alias("runs"))


def swept_stability(
    points: DataFrame, by: list[str], row: str, ks: Iterable[int], *, runs: int = STABILITY_RUNS, fraction: float = FRACTION, seed: int = SEED,
    size: int = BLOCK, restarts: int = RESTARTS, iterations: int = ITERATIONS,
) -> DataFrame:
    """(by, k, stability, runs) of :func:`stability` for each of ``ks``; both subsamples of a run of a small group are one task's."""
    ks = list(ks)
    small, large = _sized(points, by, size)
    each = _packed(small, by, row).withColumn("run", F.explode(F.sequence(F.lit(1), F.lit(runs))))
    order = F.flatten(F.array(*(_hashed(F.lit(seed), "run", F.lit(half)) for half in (1, 2)))).alias("order")
    groups = F.array(*(F.xxhash64(*by, F.lit(k), "run", F.lit(half)) for half in (1, 2) for k in ks)).alias("groups")

    def work(cells: dict, k: int, ready: None) -> tuple:
        rows, x = _as_they_are(cells)
        n, member, held = x.shape[1], [], []
        taken = max(k, int(np.floor(n * fraction)))
        order = cells["order"].reshape(len(x), 2, n).argsort(axis=2, kind="stable")
        for half in (0, 1):
            kept = np.sort(order[:, half, :taken], axis=1)  # in the order of the rows' hashes again
            labels = _labels(
                np.take_along_axis(x, kept[:, :, None], axis=1), np.take_along_axis(rows, kept, axis=1), cells["groups"][:, half], k, restarts, seed, iterations
            )
            of = np.full((len(x), n), -1)
            np.put_along_axis(of, kept, labels, axis=1)
            member.append((of[:, :, None] == np.arange(k)).astype(float))
            held.append(of >= 0)
        both = held[0] & held[1]
        cell = (member[0] * both[:, :, None]).transpose(0, 2, 1) @ member[1]
        choose = lambda c: c * (c - 1) / 2
        pairs = choose(both.sum(axis=1).astype(float))
        same = pairs - choose(cell.sum(axis=2)).sum(axis=1) - choose(cell.sum(axis=1)).sum(axis=1) + 2 * choose(cell).sum(axis=(1, 2))
        return None, np.where(pairs > 0, same / np.where(pairs > 0, pairs, 1.0), np.nan)

    key = [*by, "run"]
    made = _over_sizes(each.select(*key, "ids", "rows", "x", order, groups), key, ks, restarts, work, "agreement")
    found = made.groupBy(*by, "k").agg(F.avg("agreement").alias("stability"), F.count("agreement").alias("runs"))
    if large is None:
        return found
    swept = large.withColumn("k", F.explode(F.array(*map(F.lit, ks))))
    return found.unionByName(
        stability(swept, [*by, "k"], row, "k", runs=runs, fraction=fraction, seed=seed, size=size, restarts=restarts, iterations=iterations)
    )


def profiles(points: DataFrame, found: DataFrame, by: list[str], row: str, features: tuple[str, ...]) -> DataFrame:
    """(by, cluster, n, share, mean of each feature) of the clusters of :func:`assignments`, in the features' own units."""
    joined = points.join(found, [*by, row])
    per = joined.groupBy(*by, "cluster").agg(F.count("*").alias("n"), *(F.avg(c).alias(c) for c in features))
    return per.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*by)))
