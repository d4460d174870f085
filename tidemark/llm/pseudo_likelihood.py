"""Masked pseudo-likelihood: a bidirectional window network scores every word from both of its sides.

The network adds the embeddings of the words in a window on either side of a masked word, passes them through
a hidden layer and predicts the word in two steps, its class and its place in the class, so a prediction costs
the square root of the vocabulary. Training covers the whole corpus: each partition fits the shared start on
its own texts, the partitions' weights are averaged by a shuffle, and the average starts the next round.

Words that are too rare for an entry of their own share the network's entry of their shape, and are then
predicted within the shape by their frequency in the whole corpus. Those counts stay a table, which is joined; tasks hold
those of the most frequent of these words, as they make up most occurrences.

Texts are split and looked up once: a table of their entries as numbers serves training and scoring.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace
from itertools import accumulate, chain, compress, repeat
from math import isqrt, log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.scratch import discard, materialise

#: Words on either side, size of an embedding, least number of classes (and words in a class), words in a training step.
SIDE, SIZE, CLASSES, STEP = 2, 16, 32, 4096
#: Of N words in the corpus, those found sqrt(N) / RARE times or more have entries of their own: at most RARE * sqrt(N),
#: and 1,020 at least. All others share the entry of their shape (3 entries); 0 is the edge.
RARE = 4
#: Words without an entry whose counts tasks hold: the most frequent ones.
COMMON = 100_000
#: Words are scored in pieces of so many, which bounds memory.
PIECE = 1 << 14


@dataclass(frozen=True)
class Network:
    words: dict[str, int]
    weights: tuple[np.ndarray, ...]  # embeddings, hidden, class, word; biases are the last rows
    counts: DataFrame  # (word, shape, n) of the whole corpus
    shapes: dict[int, tuple[int, int]]  # occurrences and number of the words without an entry, by shape
    common: list[tuple[str, int, int]]  # (word, shape, n) of the most frequent words without an entry


_DIGIT = re.compile(r"\d")


def split_words(text: str | None) -> list[str]:
    return (text or "").lower().split()


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, shape, n) over all rows."""

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(list(seen), pa.string()), pa.array(_shapes(seen), pa.int8()), pa.array(list(seen.values()), pa.int64())], names=["word", "shape", "n"]
            )

        for batch in rows:
            for text in batch.column(0).to_pylist():
                seen.update(split_words(text))
                if len(seen) > 200_000:
                    yield out()
                    seen.clear()
        yield out()

    rows = docs.select(text_col).mapInArrow(batches, "word string, shape byte, n long")
    rows = rows.repartition("word")  # tasks have counted: counting again before the shuffle costs more than the rows that it saves
    return rows.groupBy("word").agg(F.first("shape").alias("shape"), F.sum("n").alias("n"))


def _shapes(words: Iterable[str]) -> list[int]:
    digit = _DIGIT.search
    return [1 if w.isalpha() else 2 if digit(w) else 3 for w in words]


def codes(words: dict[str, int], common: list[tuple[str, int, int]]) -> dict[str, int]:
    """Entries of words, and -(4 * place + shape) of those in ``common``."""
    return {w: -(4 * k + shape) for k, (w, shape, _) in enumerate(common)} | words


def codes_of(coded: dict[str, int], own: list[str]) -> np.ndarray:
    found = np.fromiter(map(coded.get, own, repeat(0)), np.int32, len(own))
    none = np.flatnonzero(found == 0)
    found[none] = _shapes(map(own.__getitem__, none.tolist()))
    return found


def ids_of(coded: dict[str, int], own: list[str]) -> np.ndarray:
    found = codes_of(coded, own)
    return np.where(found < 0, -found & 3, found)


def _start(classes: int = CLASSES, seed: int = 11) -> tuple[np.ndarray, ...]:
    """Embeddings and three layers; the last row of a layer is its bias."""
    rng, v = np.random.default_rng(seed), classes * classes
    normal = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
    biased = lambda *shape: np.concatenate([normal(*shape), np.zeros((*shape[:-2], 1, shape[-1]), np.float32)], axis=-2)
    return normal(2 * SIDE, v, SIZE), biased(SIZE, SIZE), biased(SIZE, classes), biased(classes, SIZE, classes)


def _contexts(ids: np.ndarray) -> np.ndarray:
    """The words on either side of each word; 0 beyond the ends."""
    wide = np.concatenate([gap := np.zeros(SIDE, ids.dtype), ids, gap])
    n = len(ids)
    return np.stack([wide[k : k + n] for k in range(2 * SIDE + 1) if k != SIDE])


def _kind(top: int) -> type:
    """The type of numbers below ``top``."""
    return np.uint16 if top <= 1 << 16 else np.int32


def _joined(texts: list[np.ndarray]) -> np.ndarray:
    """Texts in a row, an edge after each, so that they are handled together."""
    gap = np.zeros(SIDE, np.uint16)
    return np.concatenate([y for x in texts for y in (x, gap)])


def _order(ids: np.ndarray, top: int) -> np.ndarray:
    return np.argsort(ids.astype(_kind(top), copy=False), kind="stable")  # short ones by radix


def _exp(x: np.ndarray) -> None:
    """Exponentials in place."""
    if x.size and x.max() > 60:  # beyond it, float32 sums would overflow
        np.minimum(x, 60, out=x)
    np.exp(x, out=x)


def _forward(weights: tuple[np.ndarray, ...], context: np.ndarray, ids: np.ndarray):
    """Inputs, the hidden layer (with a one for the bias), and the slice of each class: words are sorted by class.

    From the hidden layer on, a word is a column: sums over it and factors of it then run along memory.
    """
    emb, hid, _, own = weights
    x, h = emb[0].take(context[0], axis=0), np.empty((SIZE + 1, len(ids)), np.float32)
    for k in range(1, len(context)):
        x += emb[k].take(context[k], axis=0)
    top, h[SIZE] = h[:SIZE], 1
    np.matmul(hid[:SIZE].T, x.T, out=top)
    top += hid[SIZE][:, None]
    np.tanh(top, out=top)
    classes = len(own)
    edges = np.searchsorted(ids, np.arange(classes + 1) * classes).tolist()
    slices = [(k, slice(a, b)) for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)) if b > a]
    return x, h, slices


def log_probabilities(weights: tuple[np.ndarray, ...], ids: np.ndarray) -> np.ndarray:
    """The natural logarithm of each word's conditional probability given both of its sides."""
    out, context, classes = np.empty(len(ids)), _contexts(ids), len(weights[3])
    for k in range(0, len(ids), PIECE):
        order = _order(ids[k : k + PIECE], classes * classes)
        own = ids[k : k + PIECE][order]
        _, h, slices = _forward(weights, context[:, k : k + PIECE][:, order], own)
        found, place = np.empty(len(own)), own % classes
        for c, at in slices:  # a class at a time, which stays in the processor's cache
            e_class, e_own = weights[2].T @ h[:, at], weights[3][c].T @ h[:, at]
            _exp(e_class)
            _exp(e_own)
            sums = e_class.sum(axis=0).astype(float) * e_own.sum(axis=0)
            found[at] = e_class[c].astype(float) * e_own[place[at], np.arange(len(sums))] / sums
        out[k + order] = np.log(np.maximum(found, 1e-12))
    return out


def _step(weights: tuple[np.ndarray, ...], context: np.ndarray, ids: np.ndarray, rate: float) -> None:
    """One step of stochastic gradient ascent on the words' log-probabilities, in place."""
    emb, hid, cls, own = weights
    classes = len(own)
    order = _order(ids, classes * classes)
    ids, context = ids[order], context[:, order]
    x, h, slices = _forward(weights, context, ids)
    both = np.empty((2 * classes, len(ids)), np.float32)
    g_class, g_own = both[:classes], both[classes:]
    np.matmul(cls.T, h, out=g_class)
    for k, at in slices:
        np.matmul(own[k].T, h[:, at], out=g_own[:, at])
    _exp(both)
    rate = np.float32(rate / len(ids))
    for g, at in ((g_class, ids // classes), (g_own, ids % classes)):  # gradients, with the rate in them
        g *= rate / g.sum(axis=0)
        g.reshape(-1)[at.astype(np.intp) * len(ids) + np.arange(len(ids))] -= rate
    g_h, part = cls[:SIZE] @ g_class, np.empty((SIZE, len(ids)), np.float32)
    for k, at in slices:
        g, layer = g_own[:, at], own[k]
        np.matmul(layer[:SIZE], g, out=part[:, at])
        layer -= h[:, at] @ g.T
    g_h += part
    cls -= h @ g_class.T
    top = h[:SIZE]
    g_h *= 1 - top * top
    g_x = g_h.T @ hid[:SIZE].T
    hid[:SIZE] -= x.T @ g_h.T
    hid[SIZE] -= g_h.sum(axis=1)
    for k in range(len(context)):
        by = _order(context[k], emb.shape[1])
        own_ids = context[k].take(by)
        at = np.flatnonzero(np.concatenate([[True], own_ids[1:] != own_ids[:-1]]))
        pairs = g_x.take(by, axis=0).view(np.complex64)  # two numbers are added at once
        emb[k][own_ids[at]] -= np.add.reduceat(pairs, at, axis=0).view(np.float32)


def _flat(weights: tuple[np.ndarray, ...]) -> np.ndarray:
    return np.concatenate([w.ravel() for w in weights])


def _shaped(flat: np.ndarray, like: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    out, at = [], 0
    for w in like:
        out.append(flat[at : at + w.size].reshape(w.shape).astype(np.float32).copy())
        at += w.size
    return tuple(out)


def vocabulary(docs: DataFrame, text_col: str = "text") -> Network:
    """The network before its training.

    Its vocabulary is every word of all texts; the most frequent ones, by count, then by word, have entries of
    their own, and their number grows with the corpus as RARE says. The driver holds the entries, whose number grows
    no faster than the root of the corpus, the words in ``common``, and how many words have each count.
    """
    counts = materialise(word_counts(docs, text_col), "words")
    sizes = counts.groupBy("n", "shape").agg(F.count("*").alias("words")).orderBy(F.desc("n")).collect()
    shapes = {shape: tuple(sum(x) for x in zip(*((r.n * r.words, r.words) for r in sizes if r.shape == shape), strict=True)) for shape in {r.shape for r in sizes}}
    least = sum(n for n, _ in shapes.values()) ** 0.5 / RARE
    classes = max(CLASSES, isqrt(sum(r.words for r in sizes if r.n >= least) + 3) + 1)
    entries = classes * classes - 4
    reach = [r.n for r, before in zip(sizes, accumulate((r.words for r in sizes), initial=0), strict=False) if before < entries + COMMON]
    top = counts.where(F.col("n") >= min(reach, default=0)).orderBy(F.desc("n"), "word").limit(entries + COMMON).toArrow().to_pylist()
    common = [(r["word"], r["shape"], r["n"]) for r in top[entries:]]
    top = top[:entries]
    for r in top:
        n, size = shapes[r["shape"]]
        shapes[r["shape"]] = n - r["n"], size - 1
    return Network({r["word"]: k + 4 for k, r in enumerate(top)}, _start(classes), counts, shapes, common)


def encode(docs: DataFrame, network: Network, id_col: str, text_col: str) -> DataFrame:
    """(id, n_words, ids, held, rare) of each row's whole text.

    ids are its words' entries as bytes of ``_kind``; held sums the logarithms that ``within_shape`` gives the words in
    ``common``, and rare has a row for each word without an entry or a count here: its hash, and 4 times its bytes plus shape.
    """
    mass = {shape: log(max(n + size, 1)) for shape, (n, size) in network.shapes.items()}
    within = np.array([log(n) - mass[shape] for _, shape, n in network.common])  # as within_shape has it
    shared = docs.sparkSession.sparkContext.broadcast((network.words, network.common, within))
    kind, number = docs.schema[id_col].dataType.simpleString(), _kind(network.weights[0].shape[1])

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, common, within = shared.value
        coded = codes(words, common)
        for batch in rows:
            for at in range(0, batch.num_rows, 64):
                own = batch.slice(at, 64)
                texts = [split_words(x) for x in own.column(1).to_pylist()]
                every, n = list(chain.from_iterable(texts)), list(map(len, texts))
                flat, ends = codes_of(coded, every), np.cumsum([0, *n])
                held, bare = flat < 0, (flat > 0) & (flat < 4)
                rest = np.zeros(len(flat) + 1)
                rest[1:][held] = within[-flat[held] >> 2]
                rest = np.diff(np.cumsum(rest)[ends])
                rare = list(compress(every, bare.tolist()))
                places = np.concatenate([[0], np.cumsum(bare)])[ends].astype(np.int32)
                ids = np.split(np.where(held, -flat & 3, flat).astype(number), ends[1:-1])
                written = list(map(str.encode, rare))
                keys = np.fromiter(map(xxhash.xxh64_intdigest, written, repeat(42)), np.uint64, len(rare)).view(np.int64)  # equals Spark's xxhash64 of a string
                look = 4 * np.fromiter(map(len, written), np.int64, len(rare)) + flat[bare]
                rare = pa.ListArray.from_arrays(places, pa.StructArray.from_arrays([pa.array(keys), pa.array(look)], ["h", "look"]))
                ids = pa.array([x.tobytes() for x in ids], pa.binary())
                yield pa.RecordBatch.from_arrays([own.column(0), pa.array(n, pa.int64()), ids, pa.array(rest), rare], names=["id", "n_words", "ids", "held", "rare"])

    return docs.select(F.col(id_col).alias("id"), text_col).mapInArrow(
        batches, f"id {kind}, n_words long, ids binary, held double, rare array<struct<h: bigint, look: bigint>>"
    )


def fit(coded: DataFrame, network: Network, rounds: int = 1, rate: float = 2.0) -> Network:
    """Train the network on the ids of a table by :func:`encode`.

    In a round every partition takes gradient steps on all of its words. Partitions' weights are averaged by the
    number of their words.
    """
    weights, number = network.weights, _kind(network.weights[0].shape[1])
    for _ in range(rounds):
        shared = coded.sparkSession.sparkContext.broadcast(weights)

        def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, waiting, size, steps, seen = tuple(w.copy() for w in shared.value), [], 0, 0, 0

            def step(texts: list[np.ndarray]) -> None:
                ids = _joined(texts)
                words = ids > 0
                _step(own, _contexts(ids)[:, words], ids[words], rate / (1 + steps / 200) ** 0.5)

            for batch in rows:
                for text in batch.column(0).to_pylist():
                    ids = np.frombuffer(text, number)
                    seen += len(ids)
                    for k in range(0, len(ids), STEP):
                        waiting.append(ids[k : k + STEP])
                        size += len(waiting[-1])
                        if size >= STEP:
                            step(waiting)
                            steps, waiting, size = steps + 1, [], 0
            if size:
                step(waiting)
            if seen:
                flat = _flat(own).astype(np.float64) * seen
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat), pa.array(np.full(len(flat), seen, np.int64))], names=["k", "w", "n"])

        summed = coded.select("ids").mapInArrow(batches, "k int, w double, n long").groupBy("k").agg((F.sum("w") / F.sum("n")).alias("w"))
        mean = materialise(summed, "weights").orderBy("k").toArrow()  # as many rows as the network has weights
        if len(mean):
            weights = _shaped(mean["w"].to_numpy(), weights)
    return replace(network, weights=weights)


def train(docs: DataFrame, text_col: str = "text", rounds: int = 1, rate: float = 2.0) -> Network:
    """Fit the network to all rows: :func:`vocabulary`, then :func:`fit`."""
    network = vocabulary(docs, text_col)
    if not rounds:
        return network
    coded = materialise(encode(docs.select(F.lit(0).alias("id"), F.col(text_col).alias("text")), network, "id", "text"), "coded")
    fitted = fit(coded, network, rounds, rate)
    discard(coded)
    return fitted


def within_shape(network: Network) -> Column:
    """The logarithm of a word's probability within its shape; columns: shape, size in bytes, and its count n or null.

    Words of the corpus have their frequency; as in Witten and Bell's estimate, unseen ones have together as much
    as the number of different words, and share it by length: 1 / 512 for each byte, which adds up to 1 at most.
    """
    seen = unseen = F.lit(0.0)
    for shape in (1, 2, 3):
        n, size = network.shapes.get(shape, (0, 0))
        here = F.col("shape") == shape
        seen = F.when(here, F.lit(-log(max(n + size, 1)))).otherwise(seen)
        unseen = F.when(here, F.lit(log(size / (n + size)) if size else 0.0)).otherwise(unseen)
    return F.when(F.col("n").isNotNull(), F.ln("n") + seen).otherwise(unseen - F.col("size") * log(512))


def _score(coded: DataFrame, network: Network, id_col: str) -> DataFrame:
    shared, number = coded.sparkSession.sparkContext.broadcast(network.weights), _kind(network.weights[0].shape[1])
    kind = coded.schema["id"].dataType.simpleString()

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value
        for batch in rows:
            for at in range(0, batch.num_rows, 64):
                own = batch.slice(at, 64)
                texts = [np.frombuffer(x, number) for x in own.column(3).to_pylist()]
                n = np.array(list(map(len, texts)))
                logs = np.concatenate([[0.0], np.cumsum(log_probabilities(weights, _joined(texts)))])
                ends = np.cumsum(n + SIDE) - SIDE
                total = logs[ends] - logs[ends - n] + own.column(4).to_numpy()
                yield pa.RecordBatch.from_arrays([*own.columns[:3], pa.array(total)], names=["row", "id", "n_words", "own"])

    scored = coded.select("row", "id", "n_words", "ids", "held").mapInArrow(batches, f"row long, id {kind}, n_words long, own double")
    counts = network.counts.groupBy(F.xxhash64("word").alias("h")).agg(F.sum("n").alias("n"))  # words as 64-bit numbers
    # Hashed, since sorting the occurrences costs more than the join; a partition's counts are few beside its occurrences.
    rare = coded.select("row", F.inline("rare")).join(counts.hint("shuffle_hash"), "h", "left")
    rare = rare.withColumns({"shape": F.col("look").bitwiseAND(3), "size": F.shiftright("look", 2)})
    rest = rare.groupBy("row").agg(F.sum(within_shape(network)).alias("rest"))
    total = F.col("own") + F.coalesce("rest", F.lit(0.0))
    return scored.join(rest, "row", "left").select(
        F.col("id").alias(id_col), "n_words", total.alias("log_likelihood"), F.when(F.col("n_words") > 0, total / F.col("n_words")).alias("per_word")
    )


def _coded(docs: DataFrame, network: Network, id_col: str, text_col: str) -> DataFrame:
    """:func:`encode`, written once, with a number for each row."""
    return materialise(encode(docs, network, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "scored")


def score(docs: DataFrame, network: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, log_likelihood, per_word) of each row's whole text.

    log_likelihood sums the conditional log-probabilities of all words, of those without an entry the shape's
    and the word's within it; per_word is their mean, null without words (null, empty and blank texts have a sum
    of 0). Rows are scored one by one, repeated ones each; an empty table gives an empty result. Other columns
    are ignored.
    """
    return _score(_coded(docs, network, id_col, text_col), network, id_col)


def train_and_score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """:func:`score` of all rows under the network that :func:`train` fits to them; texts are split and looked up once."""
    network = vocabulary(docs, text_col)
    coded = _coded(docs, network, id_col, text_col)
    return _score(coded, fit(coded, network), id_col)
