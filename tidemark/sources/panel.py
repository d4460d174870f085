"""Tables beside a panel's visits: categories of domains, the panelists, counts, shards of whole panelists, and group tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the category of a domain that the panel's map doesn't hold.
UNCATEGORIZED = "uncategorized"


def _cell(name: str) -> Column:
    return F.coalesce(F.trim(name), F.lit(""))


def read_domain_categories(spark: SparkSession, path: str) -> DataFrame:
    """(domain, category) of a CSV with ``domain`` and ``category_names``: the first of the names, which commas part.

    Domains are lower-cased; rows without one are left out, and of rows that repeat one the last category by name counts.
    """
    rows = spark.read.csv(path, header=True, mode="PERMISSIVE")
    first = F.trim(F.split(_cell("category_names"), ",")[0])
    named = rows.select(F.lower(_cell("domain")).alias("domain"), F.when(first == "", UNCATEGORIZED).otherwise(first).alias("category"))
    return named.where("domain <> ''").groupBy("domain").agg(F.max("category").alias("category"))


def read_demographics(spark: SparkSession, path: str) -> DataFrame:
    """(person_id, gender, age_band) of a CSV; what is missing is an empty text, not a group of its own name."""
    rows = spark.read.csv(path, header=True, mode="PERMISSIVE")
    named = rows.select(_cell("panelist_id").alias("person_id"), _cell("gender").alias("gender"), _cell("age_recode").alias("age_band"))
    return named.where("person_id <> ''").groupBy("person_id").agg(F.max(F.struct("gender", "age_band")).alias("d")).select("person_id", "d.*")


def visits_per_panelist(spark: SparkSession, path: str) -> DataFrame:
    """(person_id, visits): all rows of the visit file that name a panelist, malformed ones too."""
    rows = spark.read.csv(path, header=True, mode="PERMISSIVE").select(_cell("panelist_id").alias("person_id"))
    return rows.where("person_id <> ''").groupBy("person_id").agg(F.count("*").alias("visits"))


def with_categories(events: DataFrame, categories: DataFrame) -> DataFrame:
    """``events`` with ``category`` by their domain; a domain that the map doesn't hold is uncategorized. Joined by size."""
    mapped = categories.select(F.col("domain").alias("__domain"), F.col("category").alias("__category"))
    joined = events.drop("category").join(mapped, F.lower(F.trim("domain")) == F.col("__domain"), "left")
    return joined.withColumn("category", F.coalesce("__category", F.lit(UNCATEGORIZED))).drop("__domain", "__category")


def write_shards(events: DataFrame, path: str, shards: int) -> None:
    """Write ``events`` as files of whole persons in the order of their visits; a person's rows lie in one file."""
    events.repartition(shards, "person_id").sortWithinPartitions("person_id", "us").write.parquet(path)


def group_table(measured: DataFrame, people: DataFrame, group: str, least: int = 1) -> DataFrame:
    """(group, n, mean_gain, share_positive) of measured persons by a column of ``people``; groups under ``least`` are left out.

    Persons without an entry, or with an empty one, are the group ''.
    """
    joined = measured.join(people.select("person_id", group), "person_id", "left").withColumn(group, F.coalesce(group, F.lit("")))
    per = joined.groupBy(group).agg(
        F.count("*").alias("n"), F.avg("gain").alias("mean_gain"), F.avg((F.col("gain") > 0).cast("double")).alias("share_positive")
    )
    return per.where(F.col("n") >= least)
