"""Byte-level BPE encoding by segment trees over adjacent pair ranks, and decoding.

A text is split into parts that merges never cross. A part's symbols are the leaves of a segment tree: a leaf holds
the rank of the merge of its symbol with the next one, and each node the least (rank, place) below it. So the root is
the leftmost merge of the lowest rank; merging changes three leaves and the nodes above them, a logarithmic number,
until the root holds no merge. Trees of parts of one width are rows of one array and step side by side.
Parts are encoded once and remembered. Texts are independent rows: nothing is shuffled.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import pre_tokenizers

#: Encodings of parts and words that a worker remembers; when full, it starts anew.
MEMORY = 400_000
#: Texts are split in pieces of about so many characters; a longer part is taken whole.
PIECE = 1_000_000
#: Parts that wait for one another, so that new ones are encoded together.
PARTS = 200_000
#: Cells of the trees that step side by side.
CELLS = 1 << 20
#: Bytes of ids or texts after which a batch is handed on.
BATCH = 8_000_000

#: Fixed value: the split of byte-level BPE into parts.
_SPLIT = regex.compile(r"'(?:[stmd]|re|ve|ll)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_OTHER_SPACE = re.compile(r"[^\S \n]")
#: Outside these blocks the letters and numbers depend on the Unicode version; there the library's own split is used.
_UNSTABLE = regex.compile(
    r"[^\u0000-\u0557\u0590-\u088e\u0900-\u0c5b\u1e00-\u206f\u20a0-\u2bff\u2c60-\ua7cd"
    r"\uac00-\ud7a3\uf900-\uffff\U0001f000-\U0001faff]"
)


@dataclass(frozen=True)
class Vocabulary:
    """A tokenizer file's ids of bytes, pairs in order with their ranks, ids by rank, tokens' bytes, special strings.

    ``known`` remembers the ids of parts, ``words`` those of words behind a blank.
    """

    of_byte: np.ndarray
    pairs: np.ndarray
    ranks: np.ndarray
    made: np.ndarray
    data: np.ndarray
    starts: np.ndarray
    special: dict[str, int]
    known: dict[str, bytes] = field(default_factory=dict)
    words: dict[str, bytes] = field(default_factory=dict)


def _symbols() -> dict[str, int]:
    """The printable symbol that byte-level vocabularies write for each byte: itself, else one from U+0100 on."""
    out: dict[str, int] = {}
    for byte in range(256):
        printable = 33 <= byte < 127 or byte >= 161 and byte != 173
        out[chr(byte) if printable else chr(256 + sum(v < 256 and ord(s) > 255 for s, v in out.items()))] = byte
    return out


@cache
def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a byte-level BPE file of the tokenizers library; other kinds raise ValueError."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, split = spec["model"], spec["pre_tokenizer"] or {}
    if model["type"] != "BPE" or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or spec["normalizer"]:
        raise ValueError(f"{path} is no plain byte-level BPE")
    ids, symbols = model["vocab"], _symbols()
    added = {x["content"]: x["id"] for x in spec["added_tokens"]}
    if any(x["single_word"] or x["lstrip"] or x["rstrip"] for x in spec["added_tokens"]):
        raise ValueError(f"{path} has special tokens that take their surroundings")
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    size = max([*ids.values(), *added.values()]) + 1
    pair = np.array([ids[a] * size + ids[b] for a, b in merges], np.int64)
    order = np.argsort(pair, kind="stable")
    token = [b""] * size
    for text, n in ids.items():
        token[n] = bytes(symbols[c] for c in text) if all(c in symbols for c in text) else text.encode()
    for text, n in added.items():
        token[n] = text.encode()
    of_byte = np.zeros(256, np.int64)
    for symbol, byte in symbols.items():
        of_byte[byte] = ids[symbol]
    return Vocabulary(
        of_byte, pair[order], order.astype(np.int64), np.array([ids[a + b] for a, b in merges], np.int64),
        np.frombuffer(b"".join(token), np.uint8), np.cumsum([0, *map(len, token)]), added,
    )


def _lookup(vocab: Vocabulary, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the merge of each pair, whether there is one)."""
    want = a * (len(vocab.starts) - 1) + b
    at = np.minimum(np.searchsorted(vocab.pairs, want), len(vocab.pairs) - 1)
    return at, vocab.pairs[at] == want


def _merged(vocab: Vocabulary, parts: list[bytes], width: int) -> list[bytes]:
    """Ids of parts of 2 to ``width`` bytes each (``width`` a power of two), as little-endian unsigned 32-bit bytes.

    Row by row, the symbol at ``place`` of part ``row`` is cell ``row * width + place`` of flat arrays.
    """
    m = len(parts)
    sizes = np.array([len(x) for x in parts])
    live = (np.arange(width) < sizes[:, None]).ravel()
    symbol = np.full(m * width, -1, np.int64)
    symbol[live] = vocab.of_byte[np.frombuffer(b"".join(parts), np.uint8)]
    follow = np.tile(np.arange(1, width + 1), m)
    before = np.tile(np.arange(-1, width - 1), m)
    follow[np.arange(m) * width + sizes - 1] = width
    narrow = (int(vocab.ranks.max()) + 1) * width < 2**31
    none = np.int32(2**31 - 1) if narrow else np.int64(2**62)
    tree = np.full((m, 2 * width), none)
    both = symbol.reshape(m, width)
    at, found = _lookup(vocab, both[:, :-1], both[:, 1:])
    found &= live.reshape(m, width)[:, 1:]
    tree[:, width : 2 * width - 1] = np.where(found, vocab.ranks[at] * width + np.arange(width - 1), none)
    level = width
    while level > 1:
        tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
        level //= 2
    tree = tree.ravel()
    row = np.nonzero(tree[1 :: 2 * width] < none)[0]
    while len(row):
        cell, root = row * width, row * (2 * width)
        rank, left = np.divmod(tree[root + 1].astype(np.int64), width)
        right = follow[cell + left]
        beyond = follow[cell + right]
        merged = vocab.made[rank]
        symbol[cell + left] = merged
        symbol[cell + right] = -1
        follow[cell + left] = beyond
        inside = beyond < width
        before[(cell + beyond)[inside]] = left[inside]
        prior = before[cell + left]
        # the merged symbol's pair, the right symbol's (gone) and the prior symbol's; a missing prior repeats the first
        some = prior >= 0
        first = np.where(some, prior, left)
        at, found = _lookup(
            vocab, np.concatenate([merged, symbol[cell + first]]), np.concatenate([symbol[cell + np.where(inside, beyond, left)], merged])
        )
        new = np.where(found & np.concatenate([inside, some]), vocab.ranks[at] * width + np.concatenate([left, first]), none)
        tree[root + width + right] = none
        tree[root + width + first] = new[len(row) :]
        tree[root + width + left] = new[: len(row)]
        node = width + np.concatenate([first, left, right])
        root = np.concatenate([root, root, root])
        for _ in range(width.bit_length() - 1):
            node >>= 1
            lower = root + 2 * node
            tree[root + node] = np.minimum(tree[lower], tree[lower + 1])
        row = row[tree[row * (2 * width) + 1] < none]
    kept = symbol >= 0
    data, ends = symbol[kept].astype("<u4").tobytes(), 4 * np.cumsum(kept.reshape(m, width).sum(axis=1))
    return [data[a:b] for a, b in zip([0, *ends.tolist()], ends.tolist(), strict=False)]


def learn(vocab: Vocabulary, parts: list[str]) -> dict[str, bytes]:
    """Ids of each of the distinct ``parts``, trees of one width side by side."""
    out, by_width = {}, {}
    for part in parts:
        data = part.encode()
        if len(data) == 1:
            out[part] = vocab.of_byte[data[0]].astype("<u4").tobytes()
        else:
            by_width.setdefault(1 << (len(data) - 1).bit_length(), []).append((part, data))
    for width, held in by_width.items():
        step = max(1, CELLS // width)
        for k in range(0, len(held), step):
            some = held[k : k + step]
            out.update(zip((p for p, _ in some), _merged(vocab, [d for _, d in some], width), strict=True))
    return out


def split(text: str, piece: int | None = None) -> Iterator[list[str]]:
    """The parts of a text, in lists. A piece's last part may go on beyond it, so the next piece starts with it."""
    piece = piece or PIECE
    at, size = 0, piece
    while at < len(text):
        stop = min(len(text), at + size)
        some = text[at:stop]
        if _UNSTABLE.search(some):
            own = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str(some)
            parts = [some[a:b] for _, (a, b) in own]
        else:
            parts = _SPLIT.findall(some)
        if stop < len(text):
            stop -= len(parts.pop()) if len(parts) > 1 else stop - at
            if parts and parts[-1] == "'":  # perhaps the start of 're, 've or 'll
                stop -= len(parts.pop())
            if stop <= at:  # one part fills the piece
                size *= 2
                continue
        at, size = stop, piece
        yield parts


def _sections(vocab: Vocabulary, text: str) -> Iterator[str | bytes]:
    """The stretches between special tokens' strings, and the ids of those."""
    marks = [x for x in vocab.special if x in text]
    if marks:
        pattern, at = regex.compile("|".join(map(regex.escape, sorted(marks, key=len, reverse=True)))), 0
        for found in pattern.finditer(text):
            yield text[at : found.start()]
            yield np.array([vocab.special[found.group()]], "<u4").tobytes()
            at = found.end()
        text = text[at:]
    yield text


def _regular(text: str) -> bool:
    """Whether white space is single blanks and line feeds, with something else at their sides.

    Parts never cross the place before such a blank.
    """
    odd = "  " in text or " \n" in text or "\n " in text or text[:1].isspace() or text[-1:].isspace()
    return not odd and not _OTHER_SPACE.search(text)


def _stretches(text: str) -> Iterator[tuple[bool, list[str]]]:
    """(False, parts) or, of regular texts after their first word, (True, words that stand behind a blank)."""
    if not _regular(text):
        yield from ((False, parts) for parts in split(text))
        return
    first = text.find(" ")
    yield from ((False, parts) for parts in split(text if first < 0 else text[:first]))
    while first >= 0:
        stop = text.find(" ", first + PIECE)
        yield True, (text[first + 1 : stop] if stop >= 0 else text[first + 1 :]).split(" ")
        first = stop


def _remember(vocab: Vocabulary, waiting: list[tuple[int, bool, list[str]]]) -> None:
    """Learn the parts and words that ``waiting`` needs and the memory lacks; a full memory starts anew."""
    if len(vocab.known) + len(vocab.words) > MEMORY:
        vocab.known.clear()
        vocab.words.clear()
    known, words = vocab.known, vocab.words
    new_words = list(dict.fromkeys([x for _, is_words, xs in waiting if is_words for x in xs if x not in words]))
    cut = [p for parts in split("".join([" " + x for x in new_words])) for p in parts]  # a part with a blank begins a word
    new = [x for _, is_words, xs in waiting if not is_words for x in xs if x not in known] + [x for x in cut if x not in known]
    known.update(learn(vocab, list(dict.fromkeys(new))))
    ids = [known[x] for x in cut]
    begins = [k for k, x in enumerate(cut) if x[0] == " "]
    ends = [*begins[1:], len(cut)][: len(begins)]
    found = [ids[k] if end == k + 1 else b"".join(ids[k:end]) for k, end in zip(begins, ends, strict=True)]
    words.update(zip(new_words, found, strict=True))


def encode_texts(vocab: Vocabulary, texts: list[str]) -> list[bytes]:
    """Ids of whole texts, as little-endian unsigned 32-bit bytes; special tokens' strings are those tokens."""
    out: list[list[bytes]] = [[] for _ in texts]
    waiting: list[tuple[int, bool, list[str]]] = []
    places: list[int] = []

    def settle() -> None:
        _remember(vocab, waiting)
        for (k, is_words, xs), place in zip(waiting, places, strict=True):
            held = vocab.words if is_words else vocab.known
            out[k][place] = b"".join([held[x] for x in xs])
        waiting.clear()
        places.clear()

    size = 0
    for k, text in enumerate(texts):
        for section in _sections(vocab, text):
            if isinstance(section, bytes):
                out[k].append(section)
                continue
            for is_words, xs in _stretches(section):
                waiting.append((k, is_words, xs))
                places.append(len(out[k]))
                out[k].append(b"")
                size += len(xs)
                if size > PARTS:
                    settle()
                    size = 0
    settle()
    return [b"".join(x) for x in out]


def decode_ids(vocab: Vocabulary, data: bytes) -> str:
    """The text of ids; unknown ids have no bytes, and bytes that are no UTF-8 become U+FFFD."""
    ids = np.frombuffer(data, "<u4").astype(np.int64)
    ids = ids[ids < len(vocab.starts) - 1]
    start, size = vocab.starts[ids], vocab.starts[ids + 1] - vocab.starts[ids]
    ends = np.cumsum(size)
    if not len(ids) or not ends[-1]:
        return ""
    place = np.arange(ends[-1]) + np.repeat(start - (ends - size), size)
    return vocab.data[place].tobytes().decode("utf-8", "replace")


def _runs(values: pa.Array, most: int) -> Iterator[slice]:
    """Slices of a column of strings or bytes of about ``most`` bytes together, one value at least."""
    at, size = 0, 0
    for k, n in enumerate(pc.binary_length(values).to_pylist(), 1):
        size += n
        if size > most or k == len(values):
            yield slice(at, k)
            at, size = k, 0


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): the ids of each row's whole text, as little-endian unsigned 32-bit bytes.

    A null text is empty and has no ids. Repeated rows and null ids have a row each; an empty table gives an empty
    result; other columns are ignored. Texts of any length are split in pieces; a part that merges may cross as a
    whole (letters without a break, say) takes about 60 bytes of memory for each of its bytes.
    """
    read = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(tokenizer)
        for batch in rows:
            for s in _runs(batch.column(1), BATCH):
                ids = pa.array(encode_texts(vocab, batch.column(1)[s].to_pylist()), pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0)[s], ids], names=["id", "ids"])

    kind = read.schema["id"].dataType.simpleString()
    return read.mapInArrow(run, f"id {kind}, ids binary").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, tokenizer: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, ids, text): the text of each row's ids, special tokens included; null ids give an empty text."""
    read = encoded.select(F.col(id_col).alias("id"), F.coalesce(ids_col, F.lit(b"")).alias("ids"))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(tokenizer)
        for batch in rows:
            for s in _runs(batch.column(1), BATCH):
                texts = pa.array([decode_ids(vocab, x) for x in batch.column(1)[s].to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0)[s], batch.column(1)[s], texts], names=["id", "ids", "text"])

    kind = read.schema["id"].dataType.simpleString()
    return read.mapInArrow(run, f"id {kind}, ids binary, text string").withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, text): :func:`decode` of :func:`encode`, in one worker instead of two."""
    read = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(tokenizer)
        for batch in rows:
            for s in _runs(batch.column(1), BATCH):
                ids = encode_texts(vocab, batch.column(1)[s].to_pylist())
                texts = pa.array([decode_ids(vocab, x) for x in ids], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0)[s], pa.array(ids, pa.binary()), texts], names=["id", "ids", "text"])

    kind = read.schema["id"].dataType.simpleString()
    return read.mapInArrow(run, f"id {kind}, ids binary, text string").withColumnRenamed("id", id_col)
