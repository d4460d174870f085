"""Phrase collocation mining in two passes over shards (SON partitioning), with exact counts, scores and rankings.

The documents are cut into shards that a task mines completely in memory. A phrase that the whole language holds
``support`` times must, in some shard with the share w of the language's words, be found w * support times or more. So
the union of what the shards find frequent at that lowered support holds every frequent phrase. A second pass counts
all candidates in every shard, and Spark adds the counts: they are exact.

Words are counted first, so that shards look only at phrases of frequent words. What later passes need of the words and
of the candidates' union are Bloom filters of fixed size, whatever the corpus: shards set bits, Spark joins them. False
positives cost work, not exactness, as every shard counts whatever the filters let through and rare phrases go at the end.
With many shards a language's local support falls to one, and the union would hold every phrase of frequent words. Then
every phrase counts as a shard's candidate, and the shards' counts, added by the phrases' hashes, leave those that reach
``support``: pairs first, then what consists of such pairs. Phrases of one hash add up, so none is lost.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.scratch import discard, materialise

#: Words of a shard; one document more may go beyond.
SHARD = 3_000_000
#: Bytes of text that are split at once, up to the end of a piece.
SLICE = 4_000_000
#: Shards beyond which candidates' counts are added before the union: half a hundred, where the lowered support nears one.
SUMMED = 50
#: Bits of the filters of words (4 MB) and of candidates (16 MB).
WORD_BITS, PHRASE_BITS = 1 << 25, 1 << 27
#: Parts of a language's phrases when its first ones are found.
SALT = 64
#: Rows of a batch that a task hands on.
ROWS = 100_000

#: Marks between pieces; blank and tab part words, and A-Z become a-z.
_MARKS, _LOWER = b".,;:!?\n\x0b\x0c\r", bytes(range(65, 91))
_TABLE = bytes(10 if b in _MARKS else 32 if b == 9 else b + 32 if b in _LOWER else b for b in range(256))


class _Shard:
    """Words of one language, as numbers in the order of their first appearance; -1 parts pieces."""

    def __init__(self) -> None:
        self.number: dict[bytes, int] = defaultdict()
        self.number.default_factory = self.number.__len__
        self.number[b""], self.number[b"\n"]  # noqa: B018  0 is between two blanks, 1 the end of a piece
        self.parts: list[np.ndarray] = []
        self.total = 0

    def add(self, text: bytes) -> None:
        """A text or a part of it that ends with a piece."""
        words = text.replace(b"\n", b" \n ").split(b" ")
        number = self.number
        ids = np.array([number[w] for w in words], np.int32)
        ids = ids[ids > 0]
        self.parts.append(ids)
        self.parts.append(np.ones(1, np.int32))
        self.total += int((ids > 1).sum())

    def words(self) -> tuple[np.ndarray, list[bytes]]:
        """(numbers of words from 0, -1 between pieces; the words)."""
        return np.concatenate(self.parts) - 2, list(self.number)[2:]


def _slices(text: bytes, step: int) -> Iterator[bytes]:
    """The text lower-cased, in slices of ``step`` bytes or more that end with pieces."""
    text = text.translate(_TABLE)
    at = 0
    while at < len(text):
        stop = text.find(b"\n", at + step) + 1 or len(text)
        yield text[at:stop]
        at = stop


def _shards(rows: Iterator[pa.RecordBatch], shard: int) -> Iterator[tuple[dict[str, _Shard], dict[str, tuple]]]:
    """Shards of the (lang, text, ...) rows of a task by language, and the other columns' values of each language."""
    shards: dict[str, _Shard] = defaultdict(_Shard)
    values: dict[str, tuple] = {}
    size, step = 0, min(shard, SLICE)
    for batch in rows:
        lengths = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            before = int(lengths[at - 1]) if at else 0
            stop = max(at + 1, int(np.searchsorted(lengths, before + step)))
            columns = [c.to_pylist() for c in batch.slice(at, stop - at).columns]
            at = stop
            texts: dict[str, list[bytes]] = defaultdict(list)
            for lang, text in zip(columns[0], columns[1], strict=True):
                texts[lang].append(text)
            values.update(zip(columns[0], zip(*columns[2:], strict=True), strict=False))
            for lang, some in texts.items():
                for part in _slices(b"\n".join(some), step):
                    before = shards[lang].total
                    shards[lang].add(part)
                    size += shards[lang].total - before
            if size >= shard:
                yield shards, values
                shards.clear()
                size = 0
    if shards:
        yield shards, values


def _hashes(lang: str, words: list[bytes]) -> np.ndarray:
    seed = xxhash.xxh32_intdigest(lang.encode())
    return np.array([xxhash.xxh64_intdigest(w, seed) for w in words], np.uint64)


def _joined(head: np.ndarray, tail: np.ndarray) -> np.ndarray:
    """Hash of a phrase from the hash of what precedes its last word, and that word's."""
    mixed = (head ^ (head >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + tail
    return mixed ^ (mixed >> np.uint64(29))


def _bits(hashes: np.ndarray, size: int) -> np.ndarray:
    """The two bits of each hash in a filter of ``size`` bits (a power of two)."""
    last = np.uint64(size - 1)
    mixed = hashes * np.uint64(0xC2B2AE3D27D4EB4F)
    return np.stack([(mixed >> np.uint64(32)) & last, (hashes ^ (hashes >> np.uint64(28))) & last]).astype(np.int64)


def _set(hashes: np.ndarray, size: int) -> pa.RecordBatch:
    """(place, bits): the 64-bit words of the filter that hold bits of the hashes."""
    at = np.unique(_bits(hashes, size))
    place, first = np.unique(at >> 6, return_index=True)
    bits = np.bitwise_or.reduceat(np.uint64(1) << (at & 63).astype(np.uint64), first) if len(at) else np.zeros(0, np.uint64)
    return pa.RecordBatch.from_arrays([pa.array(place, pa.int64()), pa.array(bits.view(np.int64), pa.int64())], names=["place", "bits"])


def _joined_filter(parts: DataFrame, size: int) -> np.ndarray:
    """The filter of all (place, bits) rows; at most size / 64 of them reach the driver."""
    table = parts.groupBy("place").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(size // 64, np.int64)
    out[table.column("place").to_numpy()] = table.column("bits").to_numpy()
    return out.view(np.uint64)


def word_filter(words: DataFrame, size: int = WORD_BITS) -> np.ndarray:
    """The filter of all (lang, phrase) rows of one word."""

    def bits(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            by_lang: dict[str, list[bytes]] = defaultdict(list)
            for lang, word in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by_lang[lang].append(word.encode())
            for lang, some in by_lang.items():
                yield _set(_hashes(lang, some), size)

    return _joined_filter(words.select("lang", "phrase").mapInArrow(bits, "place long, bits long"), size)


def _present(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = _bits(hashes, 64 * len(bits))
    return ((bits[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) > 0).all(axis=0)


def _grown(ids: np.ndarray, count: int, longest: int, keep) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, first places, counts) of the phrases of two words or more that ``keep`` takes, level by level.

    ``keep(length, counts, head, tail)`` is a mask over a level's distinct phrases: their counts, the numbers of the
    phrases without the last word (in the order in which those were kept), and their last words. It is asked for
    words first. A phrase counts only where both phrases that are a word shorter are kept.
    """
    kept = keep(1, np.bincount(ids[ids >= 0], minlength=count), None, np.arange(count))
    at = np.nonzero(ids >= 0)[0].astype(np.int32 if len(ids) < 2**31 else np.int64)
    at = at[kept[ids[at]]]  # places where a kept phrase starts
    number, span = ids[at].astype(np.int64), max(1, count)  # and its number
    for length in range(2, longest + 1):
        follows = np.nonzero(at[1:] == at[:-1] + 1)[0]
        if not len(follows):
            return
        key = number[follows] * span + number[follows + 1]
        distinct, first, inverse, counts = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
        place = at[follows[first]]
        kept = keep(length, counts, distinct // span, ids[place + length - 1])
        yield length, place[kept], counts[kept]
        stay, fresh = kept[inverse], np.cumsum(kept) - 1
        at, number, span = at[follows[stay]], fresh[inverse[stay]].astype(np.int64), max(1, int(kept.sum()))


def _batches(lang: str, ids: np.ndarray, words: list[bytes], length: int, places: np.ndarray, counts: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """(lang, phrase[, n]) of the phrases that start at ``places``."""
    for k in range(0, len(places), ROWS):
        own = places[k : k + ROWS]
        texts = [b" ".join([words[w] for w in row]).decode("utf-8", "replace") for row in ids[own[:, None] + np.arange(length)].tolist()]
        columns = [pa.array([lang] * len(own), pa.string()), pa.array(texts, pa.string())]
        if counts is not None:
            columns.append(pa.array(counts[k : k + ROWS], pa.int64()))
        yield pa.RecordBatch.from_arrays(columns, names=["lang", "phrase", "n"][: len(columns)])


def _words(docs: DataFrame, shard: int) -> DataFrame:
    """(lang, phrase, n) of all words; the phrase is null in the row of a language's total."""

    def count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shards, _ in _shards(rows, shard):
            for lang, held in shards.items():
                ids, words = held.words()
                total = pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([None], pa.string()), pa.array([held.total])], names=["lang", "phrase", "n"])
                yield total
                counts = np.bincount(ids[ids >= 0], minlength=len(words))
                yield from _batches(lang, np.arange(len(words)), words, 1, np.arange(len(words)), counts)

    return docs.mapInArrow(count, "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def _candidates(docs: DataFrame, words: Broadcast, support: int, longest: int, shard: int, size: int) -> DataFrame:
    """(place, bits): the union of the shards' phrases of two words or more at the support lowered to the shard's share.

    ``docs`` has (lang, text, total): the language's number of words beside each text.
    """

    def mine(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shards, values in _shards(rows, shard):
            for lang, held in shards.items():
                ids, names = held.words()
                hashes = _hashes(lang, names)
                least = max(1, -(-support * held.total // max(1, values[lang][0])))
                known = [hashes]  # of the phrases kept last

                def keep(length, counts, head, tail, least=least, hashes=hashes, known=known):
                    if length == 1:
                        return (counts >= least) & _present(words.value, hashes)
                    known[0] = _joined(known[0][head], hashes[tail])[counts >= least]
                    return counts >= least

                for _ in _grown(ids, len(names), longest, keep):
                    yield _set(known[0], size)

    return docs.mapInArrow(mine, "place long, bits long")


def _sums(docs: DataFrame, words: Broadcast, longest: int, shard: int, pairs: Broadcast | None = None) -> DataFrame:
    """(h, n): hashes and counts in a shard of all pairs of frequent words; given ``pairs``, of the longer phrases made of those."""

    def mine(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shards, _ in _shards(rows, shard):
            for held in shards.items():
                ids, names = held[1].words()
                hashes = _hashes(held[0], names)
                known, made = [hashes], []

                def keep(length, counts, head, tail, hashes=hashes, known=known, made=made):
                    if length == 1:
                        return _present(words.value, hashes)
                    known[0] = _joined(known[0][head], hashes[tail])
                    if length == 2 and pairs is not None:
                        kept = _present(pairs.value, known[0])
                        known[0] = known[0][kept]
                        return kept
                    made.append((known[0], counts))
                    return np.ones(len(counts), bool)

                for _ in _grown(ids, len(names), 2 if pairs is None else longest, keep):
                    for own, counts in made:
                        for k in range(0, len(own), ROWS):
                            columns = [pa.array(own[k : k + ROWS].view(np.int64)), pa.array(counts[k : k + ROWS], pa.int64())]
                            yield pa.RecordBatch.from_arrays(columns, names=["h", "n"])
                    made.clear()

    return docs.mapInArrow(mine, "h long, n long")


def _frequent(sums: DataFrame, support: int, size: int) -> DataFrame:
    """(place, bits): the filter's bits of the hashes whose counts add up to ``support``."""

    def bits(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            yield _set(batch.column(0).to_numpy().view(np.uint64), size)

    # a shard has each hash once, so sums before the exchange would save nothing
    return sums.repartition("h").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= support).select("h").mapInArrow(bits, "place long, bits long")


def _counts(docs: DataFrame, words: Broadcast, phrases: Broadcast, longest: int, shard: int) -> DataFrame:
    """(lang, phrase, n): exact counts of all candidates, and of what else the bitmaps let through."""

    def count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shards, _ in _shards(rows, shard):
            for lang, held in shards.items():
                ids, names = held.words()
                hashes = _hashes(lang, names)
                known = [hashes]  # of the phrases kept last

                def keep(length, counts, head, tail, hashes=hashes, known=known):
                    if length == 1:
                        return _present(words.value, hashes)
                    own = _joined(known[0][head], hashes[tail])
                    kept = _present(phrases.value, own)
                    known[0] = own[kept]
                    return kept

                for length, places, counts in _grown(ids, len(names), longest, keep):
                    yield from _batches(lang, ids, names, length, places, counts)

    return docs.mapInArrow(count, "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def phrases(
    docs: DataFrame, *, support: int = 100, longest: int = 5, shard: int = SHARD,
    bits: tuple[int, int] = (WORD_BITS, PHRASE_BITS), summed: int = SUMMED, lang_col: str = "lang", text_col: str = "text",
) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, n) of every phrase of one to ``longest`` words found ``support`` times, (lang, total) of all words).

    Words stand within pieces; occurrences may overlap. A null language is ``und``, a null text empty. Both tables lie
    in the shared folder. A language without words has a total of 0. ``shard`` (words), ``bits`` (of the filters of words
    and of candidates, powers of two) and ``summed`` (shards) change the work only.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    every = materialise(_words(rows, shard).where((F.col("n") >= support) | F.col("phrase").isNull()), "words")
    words = every.where("phrase is not null")
    totals = materialise(every.where("phrase is null").select("lang", F.col("n").alias("total")), "totals")
    shards = -(-(totals.agg(F.sum("total")).first()[0] or 1) // shard)
    full = rows.coalesce(shards)  # full shards, so that the lowered support is as high as it can be
    word_bits = spark.sparkContext.broadcast(word_filter(words, bits[0]))
    if shards > summed:
        pairs = _joined_filter(_frequent(_sums(full, word_bits, longest, shard), support, bits[1]), bits[1])
        longer = _sums(full, word_bits, longest, shard, spark.sparkContext.broadcast(pairs))
        union = pairs | _joined_filter(_frequent(longer, support, bits[1]), bits[1])
    else:
        known = full.join(totals, "lang")  # a row for each language, joined by its size
        union = _joined_filter(_candidates(known.select("lang", "text", "total"), word_bits, support, longest, shard, bits[1]), bits[1])
    phrase_bits = spark.sparkContext.broadcast(union)
    counted = _counts(full, word_bits, phrase_bits, longest, shard).where(F.col("n") >= support)
    found = materialise(words.unionByName(counted), "phrases")
    discard(every)
    return found, totals


def score(a: str, n: str, left: str, right: str) -> Column:
    """floor(1000 a n / (l r)) of columns of longs, exact while 1000 a n has at most 38 digits."""
    wide = {c: f"cast(`{c}` as decimal(20, 0))" for c in (a, n, left, right)}
    return F.expr(f"(cast(1000 as decimal(4, 0)) * {wide[a]} * {wide[n]}) div ({wide[left]} * {wide[right]})")


def collocations(
    docs: DataFrame, *, support: int = 100, longest: int = 5, top: int = 2000, shard: int = SHARD,
    bits: tuple[int, int] = (WORD_BITS, PHRASE_BITS), summed: int = SUMMED, lang_col: str = "lang", text_col: str = "text",
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's best phrases of two words or more.

    a, l and r count the phrase, its first part and the rest at its lowest-scoring cut (ties: the shortest first
    part); n counts the language's words; the score is floor(1000 a n / (l r)), exact while 1000 a n has at most 38
    digits. Phrases that always stand within one longer frequent phrase are dropped. Ties in score go by a, then by
    the phrase's bytes. An empty table, or one without frequent phrases, gives no rows.
    """
    found, totals = phrases(docs, support=support, longest=longest, shard=shard, bits=bits, summed=summed, lang_col=lang_col, text_col=text_col)
    size = F.size(F.split("phrase", " "))
    held = found.where(size > 1)

    def part(first: Column, n: Column) -> Column:
        return F.array_join(F.slice(F.split("phrase", " "), first, n), " ")

    one = F.lit(1)
    longer = held.where(size > 2).select("lang", F.explode(F.array(part(one, size - 1), part(one + 1, size - 1))).alias("phrase"), "n")
    within = longer.groupBy("lang", "phrase").agg(F.max("n").alias("most"))  # a phrase two words longer holds one that is one longer
    kept = held.join(within, ["lang", "phrase"], "left").where(F.col("most").isNull() | (F.col("most") < F.col("n"))).drop("most")
    cuts = kept.withColumn("k", F.explode(F.sequence(one, size - 1))).select(
        "lang", "phrase", F.col("n").alias("a"), "k", part(one, F.col("k")).alias("first"), part(F.col("k") + 1, size - F.col("k")).alias("rest")
    )
    parts = found.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l"))
    cut = cuts.join(parts, ["lang", "first"]).join(parts.select("lang", F.col("first").alias("rest"), F.col("l").alias("r")), ["lang", "rest"])
    scored = cut.join(totals, "lang").withColumn("n", F.col("total")).withColumn("score", score("a", "n", "l", "r"))
    best = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("b")).select("lang", "phrase", "a", "b.l", "b.r", "n", "b.score")
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    salted = best.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(SALT)))
    first = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
