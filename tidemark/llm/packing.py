"""Best-fit packing of token sequences by exact-complement hashing.

Only the number of pieces of each length decides how to pack, and lengths are at most the capacity, so the
plan is made from a histogram: sums of two lengths are indexed, single and triple sums are looked up through the
counts and that index, and for each long piece the combination that exactly fills its gap is consumed under the
counts that are left. What finds no exact filling is packed best-fit, whole counts at a time. The plan is a short table (some rows for each length);
pieces are numbered within their length and joined to it by ranges of numbers.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm.scratch import TEXTS, materialise

#: Word encodings that a worker remembers; when full, it starts anew.
MEMORY = 200_000
#: Text is tokenised in parts of about so many bytes, which bounds memory.
PART = 4_000_000
_OTHER_SPACE = re.compile(r"[^\S \n]")


#: Fixed value: the split of byte-level BPE into parts that merges never cross.
_SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


@dataclass(frozen=True)
class _Encoder:
    """A tokenizer file, a faster equal of its merges, its tokens' bytes, its special strings, and a memory."""

    path: str
    merges: tiktoken.Encoding
    lengths: np.ndarray
    special: tuple[str, ...]
    known: dict[str, bytes]


def _byte_symbols() -> dict[str, int]:
    """The printable symbol that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


@cache
def _encoder(path: str) -> _Encoder:
    """The encoder of a byte-level BPE file of the tokenizers library.

    In such a file ids follow the order of merges, so they serve as ranks of an encoder that gives the same ids
    three times as fast; the tests hold the two equal. Special tokens' strings are left to the library itself.
    """
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    special = tuple(x["content"] for x in spec["added_tokens"])
    symbols = _byte_symbols()
    ranks = {bytes(symbols[c] for c in token): n for token, n in spec["model"]["vocab"].items() if token not in special}
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    lengths[list(ranks.values())] = [len(x) for x in ranks]
    merges = tiktoken.Encoding(path, pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={})
    return _Encoder(path, merges, lengths, special, {})


@cache
def _library(path: str) -> Tokenizer:
    """The library's own tokenizer; loaded only where a special token's string occurs."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark spreads the work over cores
    return Tokenizer.from_file(path)


def _whole(encoder: _Encoder, text: str) -> bytes:
    if any(x in text for x in encoder.special):
        return array("I", _library(encoder.path).encode(text, add_special_tokens=False).ids).tobytes()
    return array("I", encoder.merges.encode_ordinary(text)).tobytes()


def _learn(encoder: _Encoder, words: list[str]) -> None:
    """Encode words in one go; the tokens' lengths in bytes part them again. A mark after a letter is a part of its own."""
    known, stems = encoder.known, {w: w[:-1] for w in words if w[-1] in ",." and w[-2:-1].isalpha()}
    plain = list(dict.fromkeys(x for w in words if (x := stems.get(w, w)) not in known))
    written = [w if w[0] == "\n" else " " + w for w in plain]
    data, at = _whole(encoder, "".join(written)), 0
    ids = np.frombuffer(data, "<u4")
    ends = np.searchsorted(np.cumsum(encoder.lengths[ids]), np.cumsum([len(w.encode()) for w in written])) + 1
    for word, end in zip(plain, (4 * ends).tolist(), strict=True):
        known[word] = data[at:end]
        at = end
    marks = {x: _whole(encoder, x) for x in ",."}
    for word, stem in stems.items():
        known[word] = known[stem] + marks[word[-1]]


def encode(path: str, texts: list[str]) -> list[bytes]:
    """Token ids of each text as little-endian unsigned 32-bit bytes, by the tokenizer file at ``path``.

    Byte-level BPE splits before a single blank or line feed that stands between others, so a text's ids are those
    of its words, each with the blank or line feed before it; words are encoded once and remembered (under their
    own letters, with the line feed if there is one). Texts with other white space, or with a special token's
    string, are encoded whole.
    """
    encoder = _encoder(path)
    if len(encoder.known) > MEMORY:
        encoder.known.clear()
    known, parted = encoder.known, []
    new: dict[str, None] = {}
    for text in texts:
        words = text.replace("\n", " \n").split(" ")
        if "" in words or "\n" in words or _runs(text) or any(x in text for x in encoder.special):
            parted.append(None)
            continue
        parted.append(words)
        new.update(dict.fromkeys([w for w in words[1:] if w not in known]))
    if new:
        _learn(encoder, list(new))
    return [
        _whole(encoder, text) if words is None else _whole(encoder, words[0]) + b"".join([known[w] for w in words[1:]])
        for text, words in zip(texts, parted, strict=True)
    ]


def _runs(text: str) -> bool:
    """Whether white space other than line feeds occurs, or any at an end or beside a blank."""
    return text[:1].isspace() or text[-1:].isspace() or " \n" in text or "\n " in text or bool(_OTHER_SPACE.search(text))


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, part, piece, start, length, ids_crc32): each text's ids and ``end_id``, cut if longer than ``capacity``.

    Pieces have ``capacity`` ids; the first takes what is left and may be shorter. ``part`` numbers the Spark
    partitions, for the numbering of pieces without moving them.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    end = np.array([end_id], "<u4").tobytes()

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            column, sizes = batch.column(1), pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()
            of, piece, start, length, crc = [], [], [], [], []
            k = 0
            while k < len(sizes):
                size, stop = 0, k
                while stop < len(sizes) and (stop == k or size + sizes[stop] <= PART):
                    size += sizes[stop]
                    stop += 1
                texts = [x or "" for x in column.slice(k, stop - k).to_pylist()]
                for number, ids in enumerate(encode(tokenizer, texts), k):
                    ids += end
                    n = len(ids) // 4
                    at, no, cut = 0, 0, n % capacity or capacity
                    while at < n:
                        of.append(number)
                        piece.append(no)
                        start.append(at)
                        length.append(cut)
                        crc.append(zlib.crc32(memoryview(ids)[4 * at : 4 * (at + cut)]))
                        at, no, cut = at + cut, no + 1, capacity
                k = stop
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(of, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                names=["id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(F.col(id_col).alias("id"), text_col).mapInArrow(batches, f"id {kind}, piece int, start long, length long, ids_crc32 long")


#: An exact filling's pieces have at least this share of the longest one that fits, tried in this order.
SLACKS = (1.0, 0.95, 0.8, 0.5, 0.0)


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths of one sequence, longest first) with the number of sequences of each.

    An exact filling of small pieces in place of a large one that fits uses up what later gaps need. So a filling
    counts only if its longest piece comes near the longest that fits; each of SLACKS is tried, the plan with the
    fewest sequences is taken, and of equal ones the first.
    """
    return min((_plan(histogram, capacity, slack) for slack in SLACKS), key=lambda p: sum(n for _, n in p))


def pair_sums(lengths: list[int], capacity: int) -> dict[int, np.ndarray]:
    """The index of pair sums: for each sum below ``capacity`` the larger parts, longest first."""
    present = np.zeros(capacity + 1, bool)
    present[lengths] = True
    own = np.array(sorted(lengths, reverse=True), np.int64)
    index = {s: own[(2 * own >= s) & (own < s)] for s in range(2, capacity)}
    return {s: a[present[s - a]] for s, a in index.items()}


def _plan(histogram: dict[int, int], capacity: int, slack: float) -> list[tuple[tuple[int, ...], int]]:
    """Exact complements by the index of single, pair and triple sums, then best fit of the rest."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        left[length] = n
    pairs = pair_sums([k for k, n in histogram.items() if n], capacity)
    nothing = np.zeros(0, np.int64)
    out: list[tuple[tuple[int, ...], int]] = []

    def take(*pattern: int) -> None:
        """As many sequences of the pattern as the counts allow."""
        need = {x: pattern.count(x) for x in pattern}
        n = min(int(left[x]) // k for x, k in need.items())
        if n > 0:
            for x, k in need.items():
                left[x] -= n * k
            out.append((pattern, n))

    def longest(gap: int) -> int:
        fits = np.nonzero(left[1 : gap + 1])[0]
        return int(fits[-1]) + 1 if len(fits) else 0

    for first in range(capacity, 0, -1):  # single complements of all lengths come first
        if left[first] and first == capacity:
            take(first)
        elif left[first] and capacity - first <= first:
            take(first, capacity - first)
    for first in range(capacity - 1, 0, -1):
        gap = capacity - first
        top = min(longest(gap), first) if left[first] and gap > 1 else 0
        for a in range(top, max(1, int(slack * top)) - 1, -1) if top else ():
            if left[first] and left[a] and gap > a:
                if gap - a <= a:  # a pair sum
                    take(first, a, gap - a)
                parts = pairs.get(gap - a, nothing)  # a triple sum: a and a pair
                least = slack * min(longest(gap - a), a)
                parts = parts[(parts <= a) & (parts >= least) & (left[parts] > 0) & (left[gap - a - parts] > 0)]
                for x in parts.tolist():
                    if not (left[first] and left[a]):
                        break
                    take(first, a, x, gap - a - x)
    for first in range(capacity, 0, -1):  # best fit of the rest, whole counts at a time
        while left[first]:
            pattern, gap = [first], capacity - first
            left[first] -= 1
            while gap and (x := longest(gap)):
                pattern.append(x)
                left[x] -= 1
                gap -= x
            for x in pattern:
                left[x] += 1
            take(*pattern)
    return out


def _plan_rows(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, from, to, first_sequence, offset): piece numbers [from, to) of a length and where they go."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for pattern, n in patterns:
        offset = 0
        for length in pattern:
            low = used.get(length, 0)
            rows.append((length, low, low + n, sequence, offset))
            used[length] = low + n
            offset += length
        sequence += n
    return rows


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset) for each piece of each row's whole text.

    Null texts are empty and have the end id alone. Repeated rows are packed again; rows with a null id too.
    Equal lengths are dealt in any order. An empty table gives an empty result. Other columns are ignored.
    """
    spark = docs.sparkSession
    cut = materialise(pieces(docs, tokenizer, capacity, end_id, id_col, text_col), "pieces", TEXTS)
    # Numbers within a length come from counts for each group of rows, so no length meets in one task.
    held = cut.withColumn("part", F.xxhash64("id", "piece", "ids_crc32").bitwiseAND(F.lit(1023)))
    counts = held.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    total = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # a row for each length
    rows = _plan_rows(plan(total, capacity))
    table = spark.createDataFrame(rows, "length long, low long, high long, sequence long, offset long")
    within = Window.partitionBy("length", "part").orderBy("id", "piece")
    numbered = held.withColumn("k", F.row_number().over(within) - 1).join(bases, ["length", "part"])
    placed = numbered.withColumn("k", F.col("k") + F.col("base")).alias("p").join(
        F.broadcast(table).alias("t"),  # bounded by the capacity: a few rows for each length
        (F.col("p.length") == F.col("t.length")) & (F.col("k") >= F.col("low")) & (F.col("k") < F.col("high")),
    )
    return placed.select(
        F.col("id").alias(id_col), "piece", "start", F.col("p.length").alias("length"), "ids_crc32",
        (F.col("sequence") + F.col("k") - F.col("low")).alias("sequence_id"), "offset",
    )
