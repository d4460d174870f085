"""Language identification by bit-sliced Bloom filters over letter trigrams.

Each filter slot holds one bit for each language, so one probe returns the set of all languages that
contain a trigram. A text's trigrams are counted for each language; the counts are corrected for the
filter's false positives, and the language with the most decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from tidemark.llm.scratch import TEXTS, free, materialise, numbered

#: Symbols of a trigram: letters below this stand for themselves, others are hashed into the rest.
_PLAIN, _SYMBOLS = 592, 1024
#: Probes of a trigram in the filter.
PROBES = 3
#: Texts are handled in pieces of so many characters, which bounds memory.
PIECE = 1 << 20


@cache
def _symbol_table() -> np.ndarray:
    """Symbol of each code point; 0 for what is no letter."""
    table = np.zeros(0x110000, np.int32)
    for cp in range(0x110000):
        if chr(cp).isalpha():
            table[cp] = cp if cp < _PLAIN else _PLAIN + cp * 2654435761 % (1 << 32) % (_SYMBOLS - _PLAIN)
    return table


def _trigrams(text: str) -> Iterator[np.ndarray]:
    """Trigrams around each letter of the lower-cased text; neighbours that are no letters are blanks."""
    text = f" {text.lower()} "
    for k in range(0, len(text) - 2, PIECE):
        cps = np.frombuffer(text[k : k + PIECE + 2].encode("utf-32-le", "surrogatepass"), np.uint32)
        s = _symbol_table()[cps]
        grams = (s[:-2] << 20) | (s[1:-1] << 10) | s[2:]
        yield grams[s[1:-1] > 0]


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Count trigrams for each language, over texts of about 8 * PIECE characters in all at a time."""

    def rows(lang: str, parts: list[np.ndarray]) -> pa.RecordBatch:
        grams, n = np.unique(np.concatenate(parts), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(n)), pa.array(grams), pa.array(n)], names=["lang", "gram", "n"])

    parts: dict[str, list[np.ndarray]] = {}
    size = 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for grams in _trigrams(text or ""):
                parts.setdefault(lang, []).append(grams)
                size += len(grams)
                if size > 8 * PIECE:
                    yield from map(rows, parts, parts.values())
                    parts, size = {}, 0
    yield from map(rows, parts, parts.values())


@dataclass(frozen=True)
class Model:
    """``bits[slot]`` has ``words`` 64-bit words with a bit for each language in ``langs``."""

    langs: tuple[str, ...]
    bits: np.ndarray
    false_rate: np.ndarray


def _slots(grams: np.ndarray, size: int) -> np.ndarray:
    """PROBES slots of each trigram (size is a power of two)."""
    h = grams.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    step = (h >> np.uint64(40)) | np.uint64(1)
    return np.stack([((h >> np.uint64(20)) + np.uint64(k) * step) & np.uint64(size - 1) for k in range(PROBES)]).astype(np.int64)


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least_share: float = 1e-5, contrast: float = 0.1) -> Model:
    """Learn the filter from all rows with a language.

    A language contains a trigram that makes up at least ``least_share`` of the language's trigrams and at
    least ``contrast`` times the highest share in any language. The shares of a language add up to 1, so it
    contains at most 1 / least_share trigrams, however large the table: the filter's size is bounded.
    Null languages and texts are left out; with no rows left, the model knows no language.
    """
    counts = (
        docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
        .select(F.col(lang_col).cast("string"), text_col)
        .mapInArrow(_count_batches, "lang string, gram int, n long")
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
    )
    counts = materialise(counts, "trigrams", TEXTS)
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    shares = counts.join(totals, "lang").select("lang", "gram", (F.col("n") / F.col("total")).alias("share"))
    kept = shares.where(F.col("share") >= least_share)
    peak = kept.groupBy("gram").agg(F.max("share").alias("peak"))
    chosen = kept.join(peak, "gram").where(F.col("share") >= contrast * F.col("peak")).select("lang", "gram")
    table = chosen.toArrow()  # at most 1 / least_share rows for each language
    langs = tuple(sorted(set(table["lang"].to_pylist())))
    words = max(1, -(-len(langs) // 64))
    size = 1 << max(16, (24 * max(1, len(table))).bit_length())
    bits = np.zeros((size, words), np.uint64)
    number = {lang: k for k, lang in enumerate(langs)}
    grams, owner = table["gram"].to_numpy(), np.array([number[x] for x in table["lang"].to_pylist()], np.int64)
    for k in range(len(langs)):
        for slots in _slots(grams[owner == k], size):
            bits[slots, k // 64] |= np.uint64(1 << (k % 64))
    fill = np.array([((bits[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)).mean() for k in range(len(langs))])
    return Model(langs, bits, fill**PROBES)


def _decide(model: Model, text: str | None) -> tuple[str, float]:
    """The language and the corrected share of the text's trigrams that it contains."""
    total, seen = 0, np.zeros(len(model.langs))
    for grams in _trigrams(text or ""):
        total += len(grams)
        if len(grams) and len(model.langs):
            slots = _slots(grams, len(model.bits))
            sets = model.bits[slots[0]] & model.bits[slots[1]] & model.bits[slots[2]]
            if len(model.langs) <= 8:
                hits = np.bincount(sets[:, 0].astype(np.int64), minlength=256)
                which = np.nonzero(hits)[0]
                seen += [hits[which[(which >> k) & 1 == 1]].sum() for k in range(len(model.langs))]
            else:
                seen += [((sets[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)).sum() for k in range(len(model.langs))]
    if not total or not model.langs:
        return "und", 0.0
    true = np.clip((seen - total * model.false_rate) / (1 - model.false_rate), 0, total)
    best = int(true.argmax())  # ties: the first language by name
    return model.langs[best], float(true[best] / total)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Each row's ``id_col`` and ``carry`` columns with ``lang_pred`` and ``score`` (0 to 1), names that those may not have.

    ``und`` with score 0 if the text is null or has no letter, or the model knows no language. Ties go to
    the first language by name. Rows are judged one by one; repeated rows and ids give a row each.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is bounded by train()

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            found = [_decide(shared.value, x) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())],
                names=[*batch.schema.names[1:], "lang_pred", "score"],
            )

    cols = list(dict.fromkeys((id_col, *carry)))
    schema = StructType([*(docs.schema[c] for c in cols), StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return docs.select(F.col(text_col).alias(free(docs, "__text")), *cols).mapInArrow(batches, schema)


def keep_known(docs: DataFrame, model: Model, least: float, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose language holds at least the share ``least`` of their trigrams; all columns, whatever their names."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is bounded by train()
    plain, place = numbered(docs), docs.columns.index(text_col)  # a text travels once

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            found = [_decide(shared.value, x) for x in batch.column(place).to_pylist()]
            yield batch.filter(pa.array([lang != "und" and score >= least for lang, score in found], pa.bool_()))

    return materialise(plain.mapInArrow(batches, plain.schema), "known", TEXTS).toDF(*docs.columns)


def held_out(id_col: str = "doc_id"):
    """Whether crc32 of the id as text leaves remainder 1 by 3 (null ids: not held out)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))
