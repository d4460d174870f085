"""SimHash near-duplicates through a byte-position inverted index with count filtering.

A fingerprint is eight positional bytes. Two fingerprints that differ in at most four bits differ
in at most four bytes, so they share at least four positional bytes. The index holds the positional
bytes in groups of three, chosen so that every four positions contain a group (20 groups suffice:
the Turan system T(8,4,3)); each pair that meets in a posting list has its shared positional bytes
tallied, pairs below four are dropped and the rest are verified by Hamming distance.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce
from itertools import combinations, islice

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import connected_components
from tidemark.llm.scratch import TEXTS, materialise

#: Shingles are hashed in chunks of so many, which bounds memory for very long texts.
CHUNK = 1 << 15
#: Posting lists of up to so many fingerprints are joined; longer ones are compared in blocks.
SMALL_LIST = 48
#: Fingerprints in one block of a long posting list.
BLOCK = 2048

_hash = partial(xxhash.xxh64_intdigest, seed=42)


def simhash(text: str | None, width: int = 4) -> int:
    """64-bit SimHash over ``width``-word shingles (XXH64, seed 42), repeats included.

    A-Z are lower-cased. Fewer words than ``width``: one shingle of them all. No words: 0.
    """
    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return 0
    if len(words) < width:
        return _hash(b" ".join(words))
    shingles = map(_hash, map(b" ".join, zip(*(words[k:] for k in range(width)), strict=False)))
    n, counts = len(words) - width + 1, np.zeros(64, np.int64)
    while len(h := np.fromiter(islice(shingles, CHUNK), np.uint64)):
        h = np.concatenate([h, np.zeros(-len(h) % 128, np.uint64)]).view(np.uint8).reshape(-1, 128, 8)
        counts += np.unpackbits(h, axis=2, bitorder="little").sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def _fingerprint_batches(width: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.array([simhash(x, width) for x in batch.column(1).to_pylist()], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints)], names=["id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """(id, fp): the SimHash of each row's whole text as a signed long."""
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), text_col).mapInArrow(partial(_fingerprint_batches, width), f"id {kind}, fp long")


def _position_groups() -> list[tuple[int, ...]]:
    """Position triples such that any four of the eight positions contain one of them."""
    part = [0, 0, 0, 1, 1, 1, 2, 2]

    def good(t: tuple[int, ...]) -> bool:
        n = [sum(part[p] == k for p in t) for k in range(3)]
        return 3 in n or any(n[k] == 2 and n[(k + 1) % 3] == 1 for k in range(3))

    return [t for t in combinations(range(8), 3) if good(t)]


def _byte(fp: Column, position: int) -> Column:
    return F.shiftrightunsigned(fp, 8 * position).bitwiseAND(F.lit(255))


def _posting_key(fp: Column, number: int, triple: tuple[int, ...]) -> Column:
    bits = (F.shiftleft(_byte(fp, p), 8 * k) for k, p in enumerate(triple))
    return reduce(lambda x, y: x.bitwiseOR(y), bits, F.lit(number << 24).cast("long"))


def _block_links(differ: int, group: pd.DataFrame) -> pd.DataFrame:
    """Links within one pair of blocks, as one star for each connected set.

    The shared positional bytes of each two fingerprints are tallied; only pairs that reach the minimum are verified.
    """
    group = group.drop_duplicates("node").sort_values("node")
    node, fp = group["node"].to_numpy(), group["fp"].to_numpy().view(np.uint64)
    places = np.ascontiguousarray(fp).view(np.uint8).reshape(-1, 8).T
    a, b, step = [], [], max(1, (1 << 21) // max(1, len(node)))
    for k in range(0, len(node), step):
        tally = np.zeros((len(fp[k : k + step]), len(fp)), np.uint8)
        for own in places:
            tally += own[k : k + step, None] == own[None, :]
        i, j = np.nonzero(tally >= 8 - differ)
        near = np.bitwise_count(fp[k + i] ^ fp[j]) <= differ
        a.append(k + i[near])
        b.append(j[near])
    a, b, label = np.concatenate(a), np.concatenate(b), np.arange(len(node))
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        new = np.minimum(new, new[new])
        if (new == label).all():
            break
        label = new
    own = label != np.arange(len(node))
    return pd.DataFrame({"a": node[own], "b": node[label[own]]})


def links(reps: DataFrame, differ: int = 4) -> DataFrame:
    """Links (a, b) between distinct fingerprints of ``reps`` (node, fp) that span all components."""
    groups = _position_groups()
    keys = F.array(*(_posting_key(F.col("fp"), k, t) for k, t in enumerate(groups)))
    posted = reps.select("node", "fp", F.explode(keys).alias("key"))
    many = materialise(posted.groupBy("key").agg(F.count("*").alias("m")).where("m > 1"), "lists")
    shared = materialise(posted.join(many, "key"), "postings")
    small = shared.where(F.col("m") <= SMALL_LIST)
    a, b = (small.select("key", *(F.col(c).alias(f"{c}_{s}") for c in ("node", "fp"))) for s in "ab")
    tally = reduce(lambda x, y: x + y, ((_byte(F.col("fp_a"), p) == _byte(F.col("fp_b"), p)).cast("int") for p in range(8)))
    near = (
        a.join(b, "key")
        .where(F.col("node_a") < F.col("node_b"))
        .where(tally >= 8 - differ)
        .where(F.bit_count(F.col("fp_a").bitwiseXOR(F.col("fp_b"))) <= differ)
        .select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
    )
    blocks = F.ceil(F.col("m") / BLOCK)
    large = (
        shared.where(F.col("m") > SMALL_LIST)
        .withColumn("own", F.pmod(F.xxhash64("fp"), blocks))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
        .select("node", "fp", "key", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"))
        .groupBy("key", "p", "q")
        .applyInPandas(partial(_block_links, differ), "a long, b long")
    )
    return near.unionByName(large).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", differ: int = 4, width: int = 4) -> DataFrame:
    """(id, fingerprint, component_id) for each row of ``docs``; ids are longs.

    Fingerprints of ``width``-word shingles link at ``differ`` (at most 4) or fewer bits; component_id is the least id reachable.
    Copies share one fingerprint and enter the index once, so no group of copies is expanded. Null and
    empty texts have fingerprint 0 and link like any other. Rows with a null id keep their place and
    take the component of their fingerprint. Repeated rows and ids give a row each; an empty table
    gives an empty result. Other columns are ignored.
    """
    if not 0 <= differ <= 4:
        raise ValueError("the position groups guarantee a meeting up to 4 differing bits")
    prints = materialise(fingerprints(docs, id_col, text_col, width), "fingerprints", TEXTS)
    reps = prints.groupBy("fp").agg(F.min("id").alias("node"))
    found = connected_components(links(reps.where("node is not null"), differ))
    classes = reps.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return prints.join(classes, "fp").select(
        F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )
