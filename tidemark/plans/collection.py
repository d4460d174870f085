"""Registered queries over what collection does: imports and their verdicts, keyed stores, predictions settled by a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark import schemas
from tidemark.operators import imports, labels, sessions
from tidemark.plans.queries import HORIZON, TIMEOUT, events, rounded
from tidemark.sources import stores
from tidemark.streaming import live

#: Days of history that an import asks for, and the longest gap of a redirect: the table's visits are hours apart.
DAYS, GAP_US = 20, 2 * schemas.HOUR
#: Runs of the replayed stream, and the person whose rows are its clock.
SLICES, CLOCK = 4, -1


def folder(spark: SparkSession, name: str) -> str:
    """A new place in the folder that driver and executors share."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{shared}/tidemark/{name}-{uuid.uuid4().hex}"


def visits(spark, sf_dir) -> DataFrame:
    """The events as a browser's visits: four of five refer to the person's previous one, keys make URLs and flags.

    Keys divisible by 7 are pages without a registrable domain; odd ones end a redirect chain, those over 80 are hops.
    """
    rows = events(spark, sf_dir).withColumn("k", F.col("domain").cast("long"))
    core = F.when(F.col("category") == "click", 1).when(F.col("category") == "signup", 3).when(F.col("category") == "purchase", 8).otherwise(0)
    flags = F.when(F.col("k") % 2 == 1, 0x20000000).otherwise(0) + F.when(F.col("k") > 80, 0x40000000).otherwise(0)
    before = F.lag("event_id").over(Window.partitionBy("person_id").orderBy("us", "event_id"))
    site = F.concat(F.lit("site"), (F.col("k") % 50).cast("string"))
    return rows.select(
        "person_id", F.col("event_id").alias("visit_id"), F.when(F.col("k") % 5 != 0, before).alias("from_visit"), "us",
        (core + flags).cast("long").alias("transition"),
        F.when(F.col("k") % 7 == 0, F.concat(F.lit("chrome://"), site)).otherwise(F.concat(F.lit("https://www."), site, F.lit(".co.uk/p"))).alias("url"),
    )


def _window(made: DataFrame) -> dict:
    """The last days before the table's last visit."""
    last = made.agg(F.max("us")).scalar()
    return {"start_us": last - DAYS * schemas.DAY, "end_us": last, "limit_us": GAP_US}


def _simulated(made: DataFrame) -> DataFrame:
    return imports.simulate(made, **_window(made))


def import_verdicts(spark, sf_dir):
    """Visits by verdict of the simulated import, for each person."""
    return _simulated(visits(spark, sf_dir)).groupBy("person_id", "verdict").agg(F.count("*").alias("n"))


def import_skips(spark, sf_dir):
    """Visits by verdict of the preparation, for each person."""
    made = visits(spark, sf_dir)
    return imports.prepare(made, **_window(made)).groupBy("person_id", "verdict").agg(F.count("*").alias("n"))


def import_crosstab(spark, sf_dir):
    return imports.crosstab(_simulated(visits(spark, sf_dir)))


def import_comparison(spark, sf_dir):
    """What the simulated import keeps against an export that knows all web pages of the window."""
    made = visits(spark, sf_dir)
    window = _window(made)
    web = made.where(F.col("us").between(window["start_us"], window["end_us"]) & F.col("url").startswith("https")).select(
        F.regexp_extract("url", r"www\.(.*)/p", 1).alias("domain")
    )
    return rounded(imports.compare_domains(_simulated(made), web))


def redirect_scores(spark, sf_dir):
    return rounded(imports.redirect_scores(visits(spark, sf_dir), tuple(h * schemas.HOUR for h in (1, 2, 4, 8, 12, 24, 48))))


def _stored(spark, sf_dir) -> stores.KeyedTable:
    """An event store after an import, corrections of long dwells, a replay of the import, and a compaction between them."""
    schema = StructType.fromDDL("person_id long, event_id long, us long, category string, domain string")
    table = stores.KeyedTable(spark, folder(spark, "events"), schema, stores.KEYS["events"], stores.storable_event(), ("us", "category"))
    rows = events(spark, sf_dir)
    columns = [f.name for f in schema]
    table.put(rows.select(*columns), 0)
    table.compact()
    table.put(rows.where("dwell_seconds > 20").withColumn("category", F.lit("long")).select(*columns), 1)
    table.put(rows.where("dwell_seconds > 40").withColumn("category", F.lit("longest")).select(*columns), 2)
    table.put(rows.select(*columns), 0)  # comes again and changes nothing
    return table


def stored_events(spark, sf_dir):
    return _stored(spark, sf_dir).read()


def stored_counts(spark, sf_dir):
    """Events by category in the store, in time order's first and last instant."""
    return _stored(spark, sf_dir).read().groupBy("category").agg(F.count("*").alias("n"), F.min("us").alias("first_us"), F.max("us").alias("last_us"))


def streamed_resolution(spark, sf_dir):
    """Predictions of the return labels settled by a stream that replays events, switches and predictions slice by slice.

    A clock's two rows far ahead let the watermark pass all windows. The outcome is that of the batch after the last
    window's end.
    """
    rows = events(spark, sf_dir)
    made = labels.return_labels(sessions.sessionise(rows, timeout_seconds=TIMEOUT), horizon_hours=HORIZON)
    asked = made.select("person_id", "category", F.col("window_end").alias("start_us"), (F.col("window_end") + HORIZON * schemas.HOUR).alias("end_us"))
    switches = rows.select("person_id", "us", (F.col("category") != "view").alias("on"))
    ends = rows.agg(F.min("us").alias("first"), F.max("us").alias("last"))
    part = (F.col("us") - ends.select("first").scalar()) * SLICES / (ends.select("last").scalar() - ends.select("first").scalar() + 1)
    sliced = live.resolution_stream(rows, asked, switches).withColumn("slice", F.floor(part))
    clock = ends.select(F.explode(F.array(F.lit(1), F.lit(2))).alias("tick"), "last").select(
        F.lit(CLOCK).alias("person_id"), (F.col("last") + F.col("tick") * 100 * schemas.DAY).alias("us"), F.lit(live.EVENT).alias("kind"),
        F.lit("tick").alias("category"), F.lit(None).cast("long").alias("end_us"), (F.lit(SLICES - 1) + F.col("tick")).cast("long").alias("slice"),
    )
    place = folder(spark, "stream")
    whole = sliced.unionByName(clock)
    whole.write.parquet(f"{place}/all")
    held = spark.read.schema(whole.schema).parquet(f"{place}/all")
    for k in range(SLICES + 2):
        held.where(F.col("slice") == k).write.mode("append").parquet(f"{place}/in")
        out = live.settle_predictions(spark.readStream.schema(whole.schema).parquet(f"{place}/in"), delay="1 hour")
        run = out.writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/state")
        run.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{place}/out").where("outcome <> 'pending'")


ALL = (import_verdicts, import_skips, import_crosstab, import_comparison, redirect_scores, stored_events, stored_counts, streamed_resolution)
