"""Near-duplicate paragraphs: MinHash banding, exact Jaccard, connected components.

Paragraphs are runs of words that the text's own content cuts: a boundary between two words is a cut if the hash of
the two is least among its neighbours, so a passage is cut alike wherever it stands and however its lines break.
Each distinct paragraph enters the bands once, however often it occurs. Paragraphs that meet in a band are
candidates; their shingle sets are compared exactly, and of each component of similar paragraphs the first
occurrence stays. The others are removed where neighbours together have enough words to be a passage.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.components import connected_components
from tidemark.llm.scratch import discard, materialise, numbered

SHINGLE = 5
#: A cut is least among so many boundaries on either side, which gives 7 to 64 words and 13 on average.
NEAR, MOST = 6, 64
#: Neighbouring repeated paragraphs are removed if they have so many words together; stock lines have fewer.
LEAST = 15
#: Wanted recall of pairs at the similarity itself, and hashes that bands may use.
RECALL, HASHES = 0.99, 3
#: Collision lists of up to so many paragraphs are joined; longer ones are compared in blocks.
SMALL_LIST, BLOCK = 32, 1024
#: Paragraphs are emitted after so many words, which bounds memory.
PART = 400_000
_MIX = np.uint64(0x9E3779B97F4A7C15)
_hash = partial(xxhash.xxh64_intdigest, seed=7)


def tune(similarity: float, recall: float = 0.999, hashes: int = 36) -> tuple[int, int]:
    """(bands, rows): the most rows per band at which pairs of ``similarity`` meet with probability ``recall``."""
    for rows in range(hashes, 0, -1):
        bands = hashes // rows
        if 1 - (1 - similarity**rows) ** bands >= recall:
            return bands, rows
    return hashes, 1


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * _MIX
    return x ^ (x >> np.uint64(32))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8").lower().split()


def _word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_hash, words), np.uint64, len(words))


def shingles(w: np.ndarray) -> np.ndarray:
    """Hashes of the 5-word shingles of word hashes, in order; needs at least 5."""
    n = len(w) - SHINGLE + 1
    out = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        out = _mixed(out + w[k : k + n])
    return out


def paragraphs(w: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of words, cut by content; those under 5 words (at the ends of a text) are left out."""
    cuts = np.zeros(0, np.int64)
    if len(w) > 1:
        g = _mixed(w[:-1] * _MIX + w[1:])
        wide = np.concatenate([np.full(NEAR, ~np.uint64(0)), g, np.full(NEAR, ~np.uint64(0))])
        sides = np.lib.stride_tricks.sliding_window_view(wide, NEAR).min(axis=1)
        cuts = np.nonzero((g < sides[: len(g)]) & (g <= sides[NEAR + 1 : NEAR + 1 + len(g)]))[0] + 1  # the first of equal ones
    edges = [0, *cuts.tolist(), len(w)]
    parts = []
    for low, high in zip(edges, edges[1:], strict=False):
        parts += [(k, min(k + MOST, high)) for k in range(low, high, MOST)]
    return [(a, b) for a, b in parts if b - a >= SHINGLE]


def _coefficients(hashes: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240501)
    return rng.integers(1, 1 << 63, hashes, np.uint64) | np.uint64(1), rng.integers(0, 1 << 63, hashes, np.uint64)


def band_keys(flat: np.ndarray, starts: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A row of ``bands`` keys for each set; the sets follow each other in ``flat``, from ``starts`` on."""
    a, b = _coefficients(bands * rows)
    keys = np.broadcast_to(np.arange(bands, dtype=np.uint64), (len(starts), bands)).copy()
    for k in range(rows):
        least = [np.minimum.reduceat((flat * x + y) >> np.uint64(17), starts) for x, y in zip(a[k::rows], b[k::rows], strict=True)]
        keys = _mixed(keys + np.stack(least, axis=1))
    return keys


def _occurrence_batches(bands: int, rows: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, number, first, n_words, h, c, bands, shingles) of each paragraph, some PART words at a time."""
    for batch in batches:
        of, number, first, length, h, c, sets = [], [], [], [], [], [], []

        def out() -> pa.RecordBatch:
            n = np.array([len(x) for x in sets])
            flat, ends = np.concatenate(sets), np.cumsum(n)
            keys = band_keys(flat, ends - n, bands, rows).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, bands, dtype=np.int32)), pa.array(keys.ravel()))
            short = pa.array((flat >> np.uint64(32)).astype(np.uint32).view(np.int32))  # 32 bits tell a pair's shingles apart
            kept = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), short)
            return pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(of)), *(pa.array(x, pa.int32()) for x in (number, first, length)),
                    pa.array(np.array(h, np.uint64).view(np.int64)), pa.array(np.array(c, np.uint32).view(np.int32)), lists, kept,
                ],
                names=["id", "number", "first", "n_words", "h", "c", "bands", "shingles"],
            )

        size = 0
        for row, text in enumerate(batch.column(1).to_pylist()):
            words = words_of(text)
            w = _word_hashes(words)
            every = shingles(w) if len(w) >= SHINGLE else None
            for k, (a, b) in enumerate(paragraphs(w)):
                joined = b" ".join(words[a:b])
                of.append(row)
                number.append(k)
                first.append(a)
                length.append(b - a)
                h.append(_hash(joined))
                c.append(zlib.crc32(joined))
                sets.append(every[a : b - SHINGLE + 1])
                size += b - a
                if size > PART:
                    yield out()
                    of, number, first, length, h, c, sets, size = [], [], [], [], [], [], [], 0
        if of:
            yield out()


def _near(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """Whether each two sets reach the Jaccard similarity, by products of their incidence matrix."""
    size, n = np.array([len(x) for x in sets]), len(sets)
    kinds, at, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), size)
    shared = np.cumsum(count > 1) - 1  # a shingle of one set alone adds nothing
    keep = count[at] > 1
    row, at = row[keep], shared[at[keep]]
    many = int((count > 1).sum())
    step, total = min(max(1, (1 << 24) // n), many), np.zeros((n, n), np.float32)
    for low in range(0, many, step or 1):
        own = (at >= low) & (at < low + step)
        matrix = np.zeros((n, step), np.float32)
        matrix[row[own], at[own] - low] = 1
        total += matrix @ matrix.T
    np.fill_diagonal(total, size)
    return total >= similarity * (size[:, None] + size[None, :] - total) - 1e-6


def _block_links(similarity: float, group: pd.DataFrame) -> pd.DataFrame:
    """Links within one pair of blocks, as one star for each connected set."""
    group = group.drop_duplicates("h").sort_values("h")
    names, near = group["h"].to_numpy(), _near([np.asarray(x) for x in group["set"]], similarity)
    label = np.arange(len(names))
    while True:
        new = np.where(near, label[None, :], len(names)).min(axis=1)
        new = np.minimum(new, new[new])
        if (new == label).all():
            break
        label = new
    own = label != np.arange(len(names))
    return pd.DataFrame({"a": names[own], "b": names[label[own]]})


def similar_links(found: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) between distinct paragraphs; ``found`` has every paragraph's (h, bands, shingles).

    What follows from few collisions is written before it is joined, so that Spark sees its size and doesn't shuffle
    all paragraphs for it unless it is large. Of lists with the same paragraphs one is compared.
    """
    posted = found.select("h", F.explode("bands").alias("key"))
    apart = posted.groupBy("key").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).where("lo < hi")  # combined before the shuffle
    met = materialise(apart.select("key"), "meetings")
    every = materialise(posted.join(met, "key").distinct(), "collisions")
    lists = every.groupBy("key").agg(F.count("*").alias("m"), F.bit_xor("h").alias("x"), F.bit_xor(F.xxhash64("h")).alias("y"))
    lists = materialise(lists.groupBy("m", "x", "y").agg(F.min("key").alias("key")).select("key", "m"), "lists")
    shared = every.join(lists, "key")
    names = materialise(every.select("h").distinct(), "names")
    sets = found.select("h", "shingles").join(names, "h").dropDuplicates(["h"]).select("h", F.array_distinct("shingles").alias("set"))
    sets = materialise(sets, "sets")
    small = shared.where(F.col("m") <= SMALL_LIST)
    pairs = small.select("key", F.col("h").alias("a")).join(small.select("key", F.col("h").alias("b")), "key").where("a < b").select("a", "b").distinct()
    both = pairs.join(sets.select(F.col("h").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("h").alias("b"), F.col("set").alias("y")), "b")
    near = both.where(F.size(F.array_intersect("x", "y")) >= similarity * F.size(F.array_union("x", "y"))).select("a", "b")
    blocks = F.ceil(F.col("m") / BLOCK)
    large = (
        shared.where(F.col("m") > SMALL_LIST)
        .withColumn("own", F.pmod(F.xxhash64("h"), blocks))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
        .select("h", "key", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"))
        .join(sets, "h")
        .groupBy("key", "p", "q")
        .applyInPandas(partial(_block_links, similarity), "a long, b long")
    )
    return near.unionByName(large).distinct()


def repeated_passages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, least: int = LEAST
) -> DataFrame:
    """(id, n_paragraphs, passages) of every document with paragraphs; passages are those to remove.

    A paragraph repeats if one like it, in its component of similar ones, stands in a document with a smaller id or
    earlier in its own. Runs of repeated neighbours with at least ``least`` words are passages, arrays of (first,
    n_words, paragraphs): the number of the first word from 0, of the words, and of the paragraphs. The first of
    each component is never removed; ties can't be, as ids and places differ.

    Paragraphs have at least 5 words, so shorter texts, and null and empty ones, have none, and neither do rows
    with a null id. Rows that repeat an id count as one document. Copies are those with equal 64-bit and 32-bit
    hashes. Very long texts are emitted in parts. Empty tables give an empty result. Other columns are ignored.
    """
    bands, rows = tune(similarity, RECALL, HASHES)
    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    kind = named.schema["id"].dataType.simpleString()
    found = materialise(
        named.mapInArrow(
            partial(_occurrence_batches, bands, rows), f"id {kind}, number int, first int, n_words int, h long, c int, bands array<long>, shingles array<int>"
        ),
        "paragraphs",
    )
    at = F.struct("id", "number")
    classes = connected_components(similar_links(found, similarity)).withColumnRenamed("node", "h")
    copies = found.groupBy("h").agg(F.min(F.struct("id", "number", "c")).alias("at"), F.count("*").alias("n"))
    label = copies.join(classes, "h", "left").where("component is not null or n > 1")
    label = materialise(label.select("h", "at.c", F.struct("at.id", "at.number").alias("at"), F.coalesce("component", "h").alias("class")), "labels")
    first = label.groupBy("class").agg(F.min("at").alias("first"))
    known = materialise(label.join(first, "class").select("h", "c", F.col("first").alias("before")), "known")
    again = found.select("id", "number", F.col("first").alias("word"), "n_words", "h", "c").join(known, ["h", "c"]).where(at != F.col("before"))
    island = F.col("number") - F.row_number().over(Window.partitionBy("id").orderBy("number"))
    runs = (
        again.dropDuplicates(["id", "number"])
        .withColumn("island", island)
        .groupBy("id", "island")
        .agg(F.min("word").alias("first"), F.sum("n_words").cast("int").alias("n_words"), F.count("*").cast("int").alias("paragraphs"))
        .where(F.col("n_words") >= least)
        .groupBy("id")
        .agg(F.sort_array(F.collect_list(F.struct("first", "n_words", "paragraphs"))).alias("passages"))
    )
    runs = materialise(runs, "runs")
    every = found.groupBy("id").agg((F.max("number") + 1).cast("long").alias("n_paragraphs")).join(runs, "id", "left")
    none = F.array().cast("array<struct<first:int,n_words:int,paragraphs:int>>")
    out = materialise(every.select(F.col("id").alias(id_col), "n_paragraphs", F.coalesce("passages", none).alias("passages")), "passages")
    for used in (found, label, known, runs):
        discard(used)
    return out


_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def _cut(text: str, passages: list[dict]) -> str:
    """The text without the words of its passages; white space before them stays."""
    data = text.encode("utf-8")
    spans = [m.span() for m in _WORD.finditer(data)]
    parts, done = [], 0
    for p in passages:
        parts.append(data[done : spans[p["first"]][0]])
        done = spans[p["first"] + p["n_words"] - 1][1]
    return b"".join([*parts, data[done:]]).decode("utf-8")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, least: int = LEAST) -> DataFrame:
    """``docs`` with the words of the passages to remove cut out of the text; all other rows and columns stay.

    The passages are those of :func:`repeated_passages`, which says what becomes of nulls, ties, repeats and empty
    tables; ids should be unique here, since word numbers hold for one text.
    """
    gone = repeated_passages(docs, id_col, text_col, similarity, least).where(F.size("passages") > 0)
    plain = numbered(docs)
    names, place = plain.columns, docs.columns.index(text_col)
    own = F.col(names[docs.columns.index(id_col)]) == F.col("other")
    joined = plain.join(gone.select(F.col(id_col).alias("other"), F.col("passages").alias("gone")), own, "left").drop("other")

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            cols = list(batch.columns[:-1])
            texts = zip(cols[place].to_pylist(), batch.column(len(cols)).to_pylist(), strict=True)
            cols[place] = pa.array([_cut(t, g) if g else t for t, g in texts], cols[place].type)
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return joined.mapInArrow(batches, plain.schema).toDF(*docs.columns)
