"""Keyed tables on Parquet: upserts in numbered batches, compaction, deletion with counts.

A put writes its rows as a batch of their own and never touches older files, so its cost is the batch's. A read takes
the newest row of each key: what the latest snapshot holds and no later batch replaces, and the later batches' newest rows.
Compaction writes a new snapshot. A batch or snapshot counts only once Spark has marked its folder complete: a lost job
leaves nothing behind that a read would see, and a batch that is put again under its number changes nothing, as
``foreachBatch`` needs. One writer at a time; readers keep the files that they have planned with until a compaction
after theirs removes them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Keys of the stores: what a second put of the same key replaces.
KEYS = {
    "events": ("person_id", "event_id"), "spans": ("person_id", "event_id", "started_us"), "features": ("person_id", "feature_set", "subject", "window_end"),
    "labels": ("person_id", "target", "subject", "window_end"), "predictions": ("person_id", "target", "subject", "window_start"), "meta": ("name",),
}
OUTCOMES = ("pending", "hit", "miss", "expired")


def storable_event() -> Column:
    """A registrable name for a domain (no scheme, path, port, user or white space), a category, an instant, and its keys."""
    whole = [F.col(c).isNotNull() for c in ("category", "us", "person_id", "event_id")]
    check = F.coalesce(F.col("domain").rlike(r"^[^\s/:?#@]+$"), F.lit(False))
    for known in whole:
        check = check & known
    return check


def storable_span() -> Column:
    """A span of an event that ends after it starts: an empty one is no measurement."""
    return F.coalesce(F.col("event_id").isNotNull() & (F.col("ended_us") > F.col("started_us")), F.lit(False))


def storable_prediction() -> Column:
    """A probability within [0, 1], a window that ends after it starts, a known outcome, and no data from inside the window."""
    within = F.col("probability").between(0.0, 1.0) & (F.col("window_end") > F.col("window_start"))
    return F.coalesce(within & F.col("outcome").isin(*OUTCOMES) & (F.col("data_cutoff") <= F.col("window_start")), F.lit(False))


@dataclass(frozen=True)
class KeyedTable:
    """A table at ``path`` with rows of ``schema``; a key's newest batch wins.

    Of one batch's rows of a key the last by ``latest`` (columns, all by default) is kept. ``check`` must hold for
    every row of a put, else the put raises and writes nothing that counts; so do missing or other columns. Nulls are
    keys like any other value.
    """

    spark: SparkSession
    path: str
    schema: StructType
    keys: tuple[str, ...]
    check: Column | None = None
    latest: tuple[str, ...] = ()

    def _numbers(self, kind: str) -> list[int]:
        """Numbers of the complete batches or snapshots, in order; a listing of folders."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        pattern = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}=*/_SUCCESS")
        found = pattern.getFileSystem(conf).globStatus(pattern) or []
        return sorted(int(f.getPath().getParent().getName().split("=")[1]) for f in found)

    def _remove(self, kind: str, number: int) -> None:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}={number}")
        folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)

    def _state(self) -> tuple[int | None, list[int]]:
        """(the latest snapshot, the batches after it). A snapshot's number is that of the last batch it holds."""
        snapshots = self._numbers("snapshot")
        last = snapshots[-1] if snapshots else None
        return last, [n for n in self._numbers("batch") if last is None or n > last]

    def _read(self, kind: str, numbers: list[int]) -> DataFrame:
        parts = [self.spark.read.schema(self.schema).parquet(f"{self.path}/{kind}={n}").withColumn("__batch", F.lit(n)) for n in numbers]
        out = parts[0] if parts else self.spark.createDataFrame([], self.schema).withColumn("__batch", F.lit(0))
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    def next_batch(self) -> int:
        last, batches = self._state()
        return max([-1 if last is None else last, *batches]) + 1

    def put(self, rows: DataFrame, batch: int | None = None) -> bool:
        """Write ``rows`` as batch ``batch`` (default: the next); False if that batch, or a later snapshot, is there already."""
        last, batches = self._state()
        number = self.next_batch() if batch is None else batch
        if number in batches or (last is not None and number <= last):
            return False
        if set(rows.columns) != {f.name for f in self.schema}:
            raise ValueError(f"{self.path} holds {self.schema.names}, not {rows.columns}")
        kept = rows.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in self.schema))
        if self.check is not None:
            bad = F.raise_error(F.lit(f"a row that {self.path} may not hold"))
            kept = kept.where(F.when(F.coalesce(self.check, F.lit(False)), F.lit(True)).otherwise(bad.cast("boolean")))
        order = self.latest or tuple(f.name for f in self.schema if f.name not in self.keys)
        newest = F.row_number().over(Window.partitionBy(*self.keys).orderBy(*(F.desc(c) for c in order))) if order else None
        if newest is None:
            kept = kept.dropDuplicates(list(self.keys))
        else:
            kept = kept.withColumn("__n", newest).where("__n = 1").drop("__n")
        kept.write.mode("overwrite").parquet(f"{self.path}/batch={number}")
        return True

    def read(self) -> DataFrame:
        """The newest row of each key. Rows of the snapshot are dropped by a join with the later batches' keys alone."""
        last, batches = self._state()
        names = [f.name for f in self.schema]
        base = self._read("snapshot", [] if last is None else [last]).select(*names)
        if not batches:
            return base
        changes = self._read("batch", batches)
        if len(batches) > 1:
            newest = F.row_number().over(Window.partitionBy(*self.keys).orderBy(F.desc("__batch")))
            changes = changes.withColumn("__n", newest).where("__n = 1")
        changes = changes.select(*names)
        if last is None:
            return changes
        keys = changes.select(*(F.col(k).alias(f"__{k}") for k in self.keys))
        same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in self.keys]
        return base.join(keys, same, "left_anti").unionByName(changes)

    def where(self, condition: Column | str) -> DataFrame:
        return self.read().where(condition)

    def count(self) -> int:
        return self.read().count()

    def counts(self, column: str) -> DataFrame:
        return self.read().groupBy(column).agg(F.count("*").alias("n"))

    def compact(self) -> bool:
        """Write a snapshot of all batches and remove what it replaces; False if there is nothing to do."""
        last, batches = self._state()
        if not batches:
            return False
        self.read().write.mode("overwrite").parquet(f"{self.path}/snapshot={batches[-1]}")
        self._tidy()
        return True

    def _tidy(self) -> None:
        """Remove snapshots but the last, and batches that it holds; also those that an earlier, lost call has left."""
        snapshots = self._numbers("snapshot")
        for number in snapshots[:-1]:
            self._remove("snapshot", number)
        for number in self._numbers("batch"):
            if number <= snapshots[-1]:
                self._remove("batch", number)

    def replace(self, rows: DataFrame) -> None:
        """Make ``rows``, which may come from this table, all that it holds."""
        rows.write.mode("overwrite").parquet(f"{self.path}/snapshot={self.next_batch()}")
        self._tidy()

    def clear(self) -> int:
        """Delete all rows and return how many there were. Numbers go on, so an old batch that comes again stays out."""
        held = self.count()
        self.replace(self.spark.createDataFrame([], self.schema))
        return held


def delete_everything(tables: dict[str, KeyedTable]) -> dict[str, int]:
    """Clear every table, attention spans included; the numbers of rows that were deleted."""
    return {name: table.clear() for name, table in tables.items()}


def is_empty(tables: dict[str, KeyedTable]) -> bool:
    return all(table.read().isEmpty() for table in tables.values())


def expire(events: KeyedTable, spans: KeyedTable | None, before_us: int) -> int:
    """Raw retention: drop events before ``before_us``, and the spans of events that are gone; derived stores stay.

    The kept rows become the new snapshot. The number of events that were dropped.
    """
    held = events.count()
    events.replace(events.where(F.col("us") >= before_us))
    if spans is not None:
        own = events.read().select("person_id", "event_id")
        spans.replace(spans.read().join(own, ["person_id", "event_id"], "left_semi"))
    return held - events.count()
