"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.scratch import discard, materialise


#: The links of one node are joined in so many parts, so that a hub's don't meet in one task.
SALTS = 8


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """Link the neighbours ``v`` of each ``u`` to the least of ``u`` and its neighbours."""
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))  # partial minima before the shuffle
    parts = least.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("part"))
    joined = pairs.withColumn("part", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")).join(parts, ["u", "part"])
    if large:
        linked = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        linked = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))
        )
    return linked.where("u <> v").distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, component) for every node of an edge; the component is its least node.

    Nulls and self-links are ignored; an empty edge table gives an empty result. The edges stay in
    tables; per round the driver sees one count and one checksum.
    """
    now = materialise(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v")))
        .distinct(),
        "edges",
    )
    seen = None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        star = _star(_star(both, large=True), large=False)
        new = materialise(star, "edges")
        mark = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(now)
        now = new
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
