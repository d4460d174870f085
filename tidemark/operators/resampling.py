"""Percentile bootstraps over clusters, split over tasks by key, block of resamples and chunk of clusters.

A resample of n clusters takes each some number of times; the numbers are multinomial. A chunk of a key's clusters gets
its share of a resample's draws from a tree of binomial splits over the chunks' sizes, which every unit of work walks on
its own: the random numbers depend on (seed, key, block, node) alone. So units need nothing of one another, a large key
is no single task, and Spark adds their sums. Few clusters make one chunk, and the tree has no split: the task that has
it makes all blocks and hands on the interval alone, so the resamples of a small key are never shuffled. Of larger keys,
a chunk travels once, and 16 bytes of sums for each resample and chunk do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.work import spread

#: Seed, number of resamples and level of the intervals.
SEED, RESAMPLES, LEVEL = 20260828, 10_000, 0.95
#: Resamples of a unit of work, and clusters of a chunk. Both settle which random numbers are drawn.
BLOCK, CHUNK = 500, 4096
#: Chunks whose sums a task hands on together.
UNITS = 4

_MASK = 2**64 - 1


def _generator(seed: int, key: int, block: int, node: int) -> np.random.Generator:
    return np.random.Generator(np.random.Philox(key=[(seed ^ key) & _MASK, (block << 32 | node) & _MASK]))


def shares(sizes: list[int], place: int, resamples: int, seed: int, key: int, block: int) -> np.ndarray:
    """How many draws of each resample fall to chunk ``place``: n draws are split in halves of the chunks, down to it."""
    low, high, draws = 0, len(sizes), np.full(resamples, sum(sizes))
    while high - low > 1:
        middle = (low + high) // 2
        share = sum(sizes[low:middle]) / sum(sizes[low:high])
        left = _generator(seed, key, block, 1 + (low << 16 | high)).binomial(draws, share)
        low, high, draws = (low, middle, left) if place < middle else (middle, high, draws - left)
    return draws


def drawn(total: np.ndarray, weight: np.ndarray, draws: np.ndarray, seed: int, key: int, block: int, place: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of ``total`` and ``weight`` over each resample's draws from a chunk's clusters."""
    pick = _generator(seed, key, block, _MASK >> 32 ^ place).integers(0, len(total), int(draws.sum()))
    of = np.repeat(np.arange(len(draws)), draws)
    return np.bincount(of, total[pick], len(draws)), np.bincount(of, weight[pick], len(draws))


def ratios(total: np.ndarray, weight: np.ndarray, resamples: int, seed: int, key: int, block: int) -> np.ndarray:
    """The ratio of each resample of a key of one chunk: those of :func:`drawn`, in which every resample has as many draws."""
    n, found = len(total), []
    even = bool((weight == weight[0]).all())
    for number, at in enumerate(range(0, resamples, block)):
        size = min(block, resamples - at)
        pick = _generator(seed, key, number, _MASK >> 32).integers(0, n, size * n)
        sums = total.take(pick).reshape(size, n).sum(axis=1)
        found.append(sums / (n * weight[0] if even else weight.take(pick).reshape(size, n).sum(axis=1)))
    return np.concatenate(found)


def between(ordered: np.ndarray, fraction: float) -> float:
    """:func:`quantile` of a sorted array."""
    at = fraction * (len(ordered) - 1)
    low, part = int(at), at - int(at)
    return float(ordered[low] if part == 0 else ordered[low] * (1 - part) + ordered[low + 1] * part)


def quantile(ordered: Column, n: int, fraction: float) -> Column:
    """Linearly interpolated quantile of a sorted array of ``n`` numbers."""
    at = fraction * (n - 1)
    low, part = int(at), at - int(at)
    first = F.get(ordered, F.lit(low))
    return first if part == 0 else first * (1 - part) + F.get(ordered, F.lit(low + 1)) * part


def intervals(
    clusters: DataFrame, by: list[str], cluster: str, total: str, weight: str, *, resamples: int = RESAMPLES, level: float = LEVEL, seed: int = SEED,
    block: int = BLOCK, chunk: int = CHUNK,
) -> DataFrame:
    """(by, point, low, high, clusters): the ratio of two sums and its percentile interval, resampling whole clusters.

    ``clusters`` has a row for each cluster of a key with its ``total`` and ``weight`` (above 0 somewhere in each
    cluster, so no resample is empty). A key without clusters has no row; one cluster gives an interval of no width.
    """
    named = clusters.select(*by, F.col(cluster).alias("cluster"), F.col(total).cast("double").alias("total"), F.col(weight).cast("double").alias("weight"))
    named = named.checkpoint()  # read by all that follows; what made it runs once
    points = named.groupBy(*by).agg(F.count("*").alias("clusters"), (F.sum("total") / F.sum("weight")).alias("point"))
    hashed = named.join(points.withColumn("chunks", F.ceil(F.col("clusters") / chunk)), by).withColumn("h", F.xxhash64("cluster"))
    alone, tail = hashed.where("chunks = 1"), (1 - level) / 2
    whole = alone.groupBy(*by, "clusters", "point").agg(F.sort_array(F.collect_list(F.struct("h", "cluster", "total", "weight"))).alias("c"))
    keys = ", ".join(f"`{c}` {whole.schema[c].dataType.simpleString()}" for c in by)

    def run_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = lambda c: batch.column(batch.schema.get_field_index(c))  # noqa: B023, E731
            ends = []
            for key, total, weight in zip(column("key").to_pylist(), column("totals"), column("weights"), strict=True):
                ordered = np.sort(ratios(total.values.to_numpy(), weight.values.to_numpy(), resamples, seed, key, block))
                ends.append((between(ordered, tail), between(ordered, 1 - tail)))
            made = (pa.array([e[k] for e in ends], pa.float64()) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([*(column(c) for c in (*by, "point")), *made, column("clusters")], names=[*by, "point", "low", "high", "clusters"])

    carried = whole.select(*by, "point", "clusters", F.xxhash64(*by).alias("key"), F.col("c.total").alias("totals"), F.col("c.weight").alias("weights"))
    small = spread(carried, *by).mapInArrow(run_whole, f"{keys}, point double, low double, high double, clusters long")

    if points.where(F.col("clusters") > chunk).isEmpty():
        return small
    placed = hashed.where("chunks > 1").withColumn("chunk", F.pmod("h", F.col("chunks")))
    chunks = placed.groupBy(*by, "chunk").agg(F.sort_array(F.collect_list(F.struct("h", "cluster", "total", "weight"))).alias("c"))
    sizes = chunks.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("chunk", F.size("c").alias("n")))).alias("s"))
    units = chunks.join(sizes, by).select(
        *by, F.xxhash64(*by).alias("key"), (F.array_position("s.chunk", F.col("chunk")) - 1).alias("place"), F.col("s.n").alias("sizes"), "c.total", "c.weight"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = range(-(-resamples // block))
        for whole in batches:
            for at in range(0, whole.num_rows, UNITS):
                batch = whole.slice(at, UNITS)
                column = lambda c: batch.column(batch.schema.get_field_index(c))  # noqa: B023, E731
                totals, weights = [], []
                for key, place, sizes, total, weight in zip(*(column(c).to_pylist() for c in ("key", "place", "sizes", "total", "weight")), strict=True):
                    total, weight = np.array(total), np.array(weight)
                    for number in blocks:
                        draws = shares(sizes, place, min(block, resamples - number * block), seed, key, number)
                        sums = drawn(total, weight, draws, seed, key, number, place)
                        totals.append(sums[0])
                        weights.append(sums[1])
                each = pa.array(np.repeat(np.arange(batch.num_rows), len(blocks)))
                made = (pa.array(x, pa.list_(pa.float64())) for x in (totals, weights))
                numbers = pa.array(list(blocks) * batch.num_rows, pa.int32())
                yield pa.RecordBatch.from_arrays([*(column(c).take(each) for c in by), numbers, column("place").take(each), *made], names=[*by, "block", "place", "totals", "weights"])

    made = spread(units, *by, "place").mapInArrow(run, f"{keys}, block int, place long, totals array<double>, weights array<double>")
    joined = made.groupBy(*by, "block").agg(F.sort_array(F.collect_list(F.struct("place", "totals", "weights"))).alias("p"))
    added = lambda name: F.reduce(
        F.slice("p", 2, F.greatest(F.size("p") - 1, F.lit(0))), F.get("p", F.lit(0))[name], lambda a, x: F.zip_with(a, x[name], lambda u, v: u + v)
    )
    per_block = joined.select(*by, F.zip_with(added("totals"), added("weights"), lambda t, w: t / w).alias("r"))
    per_key = per_block.groupBy(*by).agg(F.sort_array(F.flatten(F.collect_list("r"))).alias("r"))  # a number for each resample
    ends = per_key.select(*by, quantile(F.col("r"), resamples, tail).alias("low"), quantile(F.col("r"), resamples, 1 - tail).alias("high"))
    return small.unionByName(points.join(ends, by).select(*by, "point", "low", "high", "clusters"))


def excludes_zero() -> Column:
    return (F.col("low") > 0) | (F.col("high") < 0)


def rows_to_exclude_zero(rows: str) -> Column:
    """Rows at which an interval of :func:`intervals` would clear zero if its point stayed; null where it does, or the point is 0.

    The half-width shrinks as one over the root of the rows.
    """
    half = (F.col("high") - F.col("low")) / 2
    need = F.ceil(F.col(rows) * F.pow(half / F.abs("point"), 2))
    return F.when(~excludes_zero() & (F.col("point") != 0), need)
