"""Category maps and suffix lists from JSON files, validated when they are read, and the layered lookup of a domain."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.columns import resolve


@dataclass(frozen=True)
class CategoryMap:
    """``domains`` (domain, category) stays a table; rules (kind, value, category) apply in order where it has no answer."""

    version: int
    categories: dict[str, str]
    rules: tuple[tuple[str, str, str], ...]
    domains: DataFrame


def _document(spark: SparkSession, path: str) -> DataFrame:
    """A whole file as one row, from any file system that Spark reads."""
    return spark.read.text(path, wholetext=True)


def load_suffixes(spark: SparkSession, path: str) -> tuple[str, ...]:
    """The suffixes of two labels in a file with ``multiPartSuffixes``; a missing or empty list raises ValueError."""
    found = json.loads(_document(spark, path).first()["value"]).get("multiPartSuffixes")
    if not isinstance(found, list) or not found:
        raise ValueError(f"{path} has no multiPartSuffixes list")
    return tuple(sorted({str(x).strip().lower() for x in found}))


def load_category_map(spark: SparkSession, path: str) -> CategoryMap:
    """The map in a JSON file; missing keys, categories that it doesn't define and unknown kinds of rules raise ValueError.

    Domains are lower-cased; of names that differ in case alone, the last by spelling counts.
    """
    document = _document(spark, path)
    schema = "version int, categories map<string, string>, rules array<struct<kind: string, value: string, category: string>>, domains map<string, string>"
    parsed = document.select(F.from_json("value", schema).alias("m")).select("m.*")
    head = parsed.select("version", "categories", "rules", F.col("domains").isNotNull().alias("has_domains")).first()
    missing = [k for k, there in (("version", head.version is not None), ("categories", head.categories is not None), ("domains", head.has_domains)) if not there]
    if missing:
        raise ValueError(f"{path} is missing required keys: {missing}")
    rules = tuple((r.kind, (r.value or "").lower(), r.category) for r in head.rules or ())
    bad = sorted({kind for kind, _, _ in rules if kind not in ("suffix", "contains")})
    if bad:
        raise ValueError(f"{path} has unsupported rule kinds: {bad}")
    named = parsed.select(F.explode("domains").alias("name", "category"))
    domains = named.groupBy(F.lower("name").alias("domain")).agg(F.max_by("category", "name").alias("category"))
    used = {r.category for r in domains.select("category").distinct().collect()} | {c for _, _, c in rules}  # at most the categories
    undefined = sorted(used - set(head.categories))
    if undefined:
        raise ValueError(f"{path} references undefined categories: {undefined}")
    return CategoryMap(head.version, head.categories, rules, domains)


def categorised(
    rows: DataFrame, domains: DataFrame, overrides: DataFrame | None = None, rules: tuple[tuple[str, str, str], ...] | None = None
) -> DataFrame:
    """``rows`` (with ``domain``) with ``category`` and ``layer``: a person's override, the map, the first rule, else ``unknown``.

    ``domains``: (domain, category), a row for each; ``overrides``: (person_id, domain, category), where '' overrides
    nothing. Lookups trim and lower-case the domain. The tables join by their size.
    """
    key = F.lower(F.trim("domain"))
    mapped = domains.select(F.col("domain").alias("__domain"), F.col("category").alias("__mapped"))
    joined = rows.drop("category").join(mapped, key == F.col("__domain"), "left").drop("__domain")
    own = F.lit(None).cast("string")
    if overrides is not None:
        chosen = overrides.select(F.col("person_id").alias("__person"), F.lower(F.trim("domain")).alias("__domain"), F.col("category").alias("__own"))
        met = (F.col("person_id") == F.col("__person")) & (key == F.col("__domain"))
        joined, own = joined.join(chosen, met, "left").drop("__person", "__domain"), F.col("__own")
    category, layer = resolve(F.col("domain"), own, F.col("__mapped"), rules)
    return joined.withColumn("category", category).withColumn("layer", layer).drop("__mapped", "__own")
