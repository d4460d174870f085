"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

A spaced seed is a mask over token positions: the hash of a window covers the positions the mask names
and ignores the others, so a substituted token at an ignored position does not lose the hit. Hashes of the
benchmark join hashes of the documents; each hit fixes an alignment, along which an overlap around the hit
is compared token by token and must agree in most positions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.scratch import free, materialise

#: Token offsets that each mask hashes. The first tolerates one substitution in every five tokens, the
#: second irregular ones; six tokens decide, which keeps chance hits of common words rare.
MASKS = ((0, 1, 2, 3, 5, 6), (0, 1, 3, 4, 7, 9))
#: A benchmark side of up to so many seeds (three numbers each) is broadcast; a larger one is joined by a shuffle.
BROADCAST_SEEDS = 1_000_000


def tokens(text: Column) -> Column:
    """Hashes of the lower-cased words; ASCII marks and white space part words (null text: none)."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x00-/:-@\[-`{-\x7f]+")
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


def _seed(t: str, number: int, mask: Sequence[int]):
    """The hash of a window from its place."""

    def made(at: Column) -> Column:
        return F.xxhash64(F.lit(number), *(F.get(F.col(t), at + o) for o in mask))

    return made


def _windows(rows: DataFrame, t: str, at: str, keep: list[str]) -> DataFrame:
    """``keep``, ``at`` and ``seed`` for each mask and window of the tokens ``t``; the rows carry no tokens."""
    parts = []
    for number, mask in enumerate(MASKS):
        last = F.size(t) - 1 - max(mask)
        made = F.transform(F.sequence(F.lit(0), last), _seed(t, number, mask))
        parts.append(F.when(last >= 0, made).otherwise(F.array().cast("array<bigint>")))
    sizes = [F.greatest(F.size(t) - max(mask), F.lit(0)) for mask in MASKS]
    placed = rows.select(*keep, sizes[0].alias("n"), F.posexplode(F.concat(*parts)).alias("k", "seed"))
    return placed.select(*keep, F.when(F.col("k") < F.col("n"), F.col("k")).otherwise(F.col("k") - F.col("n")).alias(at), "seed")


def _tokenised(rows: DataFrame, id_col: str, text_col: str, id_as: str, as_: str) -> DataFrame:
    """Ids and tokens; through a one-element explode, so that no filter above computes the tokens again."""
    return rows.select(F.col(id_col).alias(id_as), F.explode(F.array(tokens(F.col(text_col)))).alias(as_))


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 20,
    agree: float = 0.8,
) -> DataFrame:
    """(id, items, n_hits, best_share) for each contaminated document; clean documents have no row.

    A document is contaminated by an item if some ``window`` aligned tokens around a seed hit (all tokens of a
    shorter item) agree in a share of at least ``agree``. ``items`` lists the item ids in order, ``n_hits``
    counts the verified seed hits, ``best_share`` is the highest share of agreeing tokens.

    Null and empty texts, and items with fewer tokens than the shortest mask, match nothing. Copies of an item
    each count. Documents that repeat an id are reported under it once; rows with a null id are reported under
    null. Empty tables give an empty result. Other columns are ignored.
    """
    items = materialise(_tokenised(benchmark, item_col, item_text_col, "item", "it"), "items")
    seeds = materialise(_windows(items, "it", "ip", ["item"]).distinct(), "seeds")
    if seeds.count() <= BROADCAST_SEEDS:
        seeds = F.broadcast(seeds)
    placed = _windows(_tokenised(docs, id_col, text_col, "id", "t"), "t", "p", ["id"]).join(seeds, "seed")
    found = materialise(placed.select("id", "item", "p", "ip"), "hits")
    # Tokens come back for documents with a hit only, and join the hits by id; rows that repeat an id are all compared.
    # The ids are written, so that the join goes by their size, which is small next to the texts'.
    hit = free(docs, "__hit")
    own = materialise(found.select(F.col("id").alias(hit)).distinct(), "hit_ids")
    held = docs.join(own, F.col(f"`{id_col}`").eqNullSafe(F.col(hit)), "left_semi")
    held = _tokenised(held, id_col, text_col, "hid", "t")
    # Hits grow with the documents: always a merge by id, of the texts with a hit only.
    hits = found.join(held.hint("merge"), F.col("id").eqNullSafe(F.col("hid"))).join(items, "item")
    shift = F.col("p") - F.col("ip")  # document position less item position
    w = F.least(F.size("it"), F.lit(window))
    low = F.greatest(F.lit(0), -shift)
    high = F.least(F.size("it"), F.size("t") - shift) - w
    start = F.least(F.greatest(F.col("ip") - window // 4, low), high)
    # One comparison for each place in the window, not a lambda over arrays: the hit is decided where it arises.
    same = sum(
        (
            ((F.lit(k) < w) & (F.get("t", start + shift + k) == F.get("it", start + k))).cast("int")
            for k in range(1, window)
        ),
        (F.get("t", start + shift) == F.get("it", start)).cast("int"),
    )
    verified = hits.where(start >= low).where(same >= agree * w).select("id", "item", (same / w).alias("share"))
    return verified.groupBy("id").agg(
        F.sort_array(F.collect_set("item")).alias("items"), F.count("*").alias("n_hits"), F.max("share").alias("best_share")
    ).withColumnRenamed("id", id_col)


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` without the contaminated rows; rows with a null id stay unless null is contaminated."""
    name = free(docs, "__bad")
    bad = materialise(contaminated(docs, benchmark, id_col, **options).select(F.col(id_col).alias(name)), "bad")  # joined by its size
    return docs.join(bad, F.col(f"`{id_col}`").eqNullSafe(F.col(name)), "left_anti")
