"""Predictions settled by a stream against the batch resolution, whatever the order of arrival, and the registry on it."""

import random

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.operators import evaluation, studies
from tidemark.sources import stores
from tidemark.streaming import live

HOUR = 3_600_000_000


def history(seed, persons=6):
    rng = random.Random(seed)
    events, predictions, switches = [], [], []
    for person in range(persons):
        us = 0
        for k in range(60):
            us += rng.randrange(1, 5 * HOUR)
            events.append((person, 100 * person + k, us, rng.choice("abc")))
            if rng.random() < 0.5:
                predictions.append((person, rng.choice("abcd"), us, us + 10 * HOUR))
            if rng.random() < 0.1:
                switches.append((person, len(switches), us + rng.randrange(-HOUR, HOUR), rng.random() < 0.5))
    return events, sorted(set(predictions)), switches


def tables(spark, events, predictions, switches):
    return (
        spark.createDataFrame(events, "person_id long, event_id long, us long, category string"),
        spark.createDataFrame(predictions, "person_id long, category string, start_us long, end_us long"),
        spark.createDataFrame(switches, "person_id long, event_id long, us long, on boolean"),
    )


def replayed(spark, df, folder, name, slices, sink=None):
    """Stream the rows in files by time, shuffled within each; a last row far in the future passes all windows."""
    last = df.agg(F.max("us")).first()[0]
    step = last // slices + 1
    files = [df.where((F.col("us") >= k * step) & (F.col("us") < (k + 1) * step) | ((F.col("us") < 0) & F.lit(k == 0))) for k in range(slices)]
    beyond = df.sparkSession.createDataFrame([(-1, last + k * 1000 * HOUR, live.EVENT, "a", None) for k in (1, 2)], df.schema)
    for k, part in enumerate([*files, beyond.limit(1), beyond.where(f"us > {last + 1500 * HOUR}")]):
        part.orderBy(F.xxhash64("us")).coalesce(1).write.mode("append").parquet(f"{folder}/{name}")
        source = spark.readStream.schema(df.schema).parquet(f"{folder}/{name}")
        made = live.settle_predictions(source, delay="1 hour")
        out = made.writeStream.option("checkpointLocation", f"{folder}/{name}-state").trigger(availableNow=True)
        target = out.foreachBatch(sink) if sink else out.format("parquet").option("path", f"{folder}/{name}-out")
        target.start().awaitTermination()
    return None if sink else spark.read.parquet(f"{folder}/{name}-out")


def test_stream_equals_batch(spark, tmp_path):
    given = history(3)
    events, predictions, switches = tables(spark, *given)
    rows = live.resolution_stream(events, predictions, switches)
    got = [tuple(r) for r in replayed(spark, rows, tmp_path, "s", 4).collect()]
    end = max(p[3] for p in given[1]) + HOUR
    batch = evaluation.resolve_predictions(predictions, events, studies.coverage_gaps(switches), end)
    want = sorted(tuple(r) for r in batch.collect())
    assert sorted(r for r in got if r[4] != "pending") == want
    assert sorted(r[:4] for r in got if r[4] == "pending") == sorted(given[1])
    assert {r[4] for r in want} == {"hit", "miss", "expired"}


def test_the_registry_takes_each_outcome_once(spark, tmp_path):
    given = history(5, persons=2)
    events, predictions, switches = tables(spark, *given)
    schema = StructType.fromDDL("person_id long, target string, subject string, window_start long, window_end long, outcome string")
    registry = stores.KeyedTable(spark, f"file://{tmp_path}/registry", schema, stores.KEYS["predictions"], latest=("settled",))
    registry = stores.KeyedTable(spark, f"file://{tmp_path}/registry", schema, stores.KEYS["predictions"])

    def sink(batch, number):
        named = batch.select("person_id", F.lit("return_24h").alias("target"), F.col("category").alias("subject"), F.col("start_us").alias("window_start"), F.col("end_us").alias("window_end"), "outcome")
        settled = named.withColumn("open", F.col("outcome") == "pending")
        newest = settled.groupBy("person_id", "target", "subject", "window_start", "window_end").agg(F.min_by("outcome", "open").alias("outcome"))
        for _ in range(2):  # a batch that is replayed changes nothing
            registry.put(newest, number)

    replayed(spark, live.resolution_stream(events, predictions, switches), tmp_path, "r", 2, sink)
    counts = {r.outcome: r.n for r in registry.counts("outcome").collect()}
    assert "pending" not in counts and sum(counts.values()) == len(given[1])
