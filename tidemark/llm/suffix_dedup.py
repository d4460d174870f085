"""Exact repeats of 50 bytes across documents, by a distributed difference-cover suffix sort.

Suffixes are dealt to tasks by their text. In every 50-byte string, the leftmost of its 24-byte substrings with the least
hash, its anchor, depends on the string alone; so equal strings have equal anchors, and strings of one anchor are sorted
together. The strings of an anchor in a text are a stretch of 27 starts at most, which travels as one row.

In a task, positions fall into three residues modulo 3, counted from the anchor. Suffixes of residues 1 and 2 are the
sample: their triples of 8-byte letters get names by their order. A suffix's name, the name 24 bytes on and the two bytes
after them order its first 50 bytes; a suffix of residue 0 is ordered by its first byte and the sampled suffix one byte
on. Adjacent suffixes with an equal prefix of 50 bytes are repeats; the least document of each run keeps its bytes. Counted
from the anchor, equal strings have equal residues, so no way to compare two residues is needed.

Only text that can repeat is sorted: text around anchors that occur in one document only is left out. Anchors also cut
each text into chunks; of equal chunks only the one of the least document is sorted. All strings of the others start in
that document too, so they are repeats, and the least document that holds a string is always the first holder of the chunk
around it. Near copies thus leave only their edited chunks in the sort.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.scratch import materialise

#: Bytes of a repeat, of a shared substring, and of a sampled triple.
REPEAT, ANCHOR, TRIPLE = 50, 24, 24
_SPAN = REPEAT - ANCHOR + 1
#: A substring ends a chunk if this divides its hash; 16 gives about 220 bytes.
CHUNK = 16
#: Texts are searched in pieces of so many bytes, which bounds memory.
PIECE = 1 << 20
#: Anchors that a task packs at once, and chunks whose anchors make up a bucket (about 16 each).
PACK, CHUNKS = 1 << 20, 1 << 14
#: Strings of an anchor that so many texts hold are keyed one by one; bytes of pieces that are sorted at once.
MANY, SORTED = 10_000, 1 << 20
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def _words(data: np.ndarray) -> np.ndarray:
    """The big-endian 8-byte letter at each position that has one."""
    return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, 8)).view(">u8")[:, 0].astype(np.uint64)


def _substring_hashes(data: np.ndarray) -> np.ndarray:
    w = _words(data)
    n = len(data) - ANCHOR + 1
    h = w[:n] * _ODD[0]
    for k in (1, 2):
        h = (h ^ (h >> np.uint64(31))) * _ODD[k] + w[8 * k : 8 * k + n]
    h = (h ^ (h >> np.uint64(29))) * _ODD[0]
    return h ^ (h >> np.uint64(32))


def _sliding(op: np.ufunc, x: np.ndarray, width: int) -> np.ndarray:
    """``op`` over each ``width`` neighbours, by doubling."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = op(x[:-step], x[step:])
        have += step
    return x


def anchors(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(place, hash) of the substrings that are least in some 50-byte string of ``data``."""
    places, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    raw = np.frombuffer(data, np.uint8)
    for at in range(0, len(raw) - REPEAT + 1, PIECE):
        h = _substring_hashes(raw[at : at + PIECE + REPEAT - 1])
        low = _sliding(np.minimum, h, _SPAN)
        edge = np.zeros(_SPAN - 1, np.uint64)
        chosen = np.nonzero(_sliding(np.maximum, np.concatenate([edge, low, edge]), _SPAN) == h)[0]
        places.append(chosen + at)
        hashes.append(h[chosen])
    place, first = np.unique(np.concatenate(places), return_index=True)
    return place, np.concatenate(hashes)[first]


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8")


def chunks(data: bytes) -> list[tuple[int, int]]:
    """Ranges of string starts, cut where the text itself says so; the last start is 50 bytes before the end."""
    last = len(data) - REPEAT + 1
    if last <= 0:
        return []
    place, h = anchors(data)
    fresh = np.concatenate([[True], place[1:] > place[:-1] + 1])  # one cut at most in a run of one letter
    cut = place[fresh & (h % np.uint64(CHUNK) == 0)]
    edges = [0, *cut[(cut > 0) & (cut < last)].tolist(), last]
    return list(zip(edges, edges[1:], strict=False))


def _chunk_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, low, high, k0, k1): each chunk's starts and the 128-bit digest of the bytes that its strings cover."""
    for batch in batches:
        for k in range(0, batch.num_rows, 500):
            part = batch.slice(k, 500)
            of, low, high, digest = [], [], [], bytearray()
            for row, text in enumerate(part.column(1).to_pylist()):
                data = _bytes(text)
                for x, y in chunks(data):
                    of.append(row)
                    low.append(x)
                    high.append(y)
                    digest += hashlib.blake2b(data[x : y + REPEAT - 1], digest_size=16).digest()
            key = np.frombuffer(bytes(digest), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(of, pa.int64())), pa.array(low, pa.int64()), pa.array(high, pa.int64()), *(pa.array(key[:, j]) for j in (0, 1))],
                names=["doc", "low", "high", "k0", "k1"],
            )


def _first_starts(n: int, later: list[dict] | None) -> np.ndarray:
    """A text of n bytes: does each of its 50-byte strings lie in a chunk that no smaller document holds?"""
    mine = np.ones(max(0, n - REPEAT + 1), bool)
    for x in later or ():
        mine[x["low"] : x["high"]] = False
    return mine


def _first_anchors(data: bytes, mine: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The anchors inside strings that start where ``mine`` is true."""
    place, h = anchors(data)
    total = np.concatenate([[0], np.cumsum(mine)])
    inside = total[np.minimum(place + 1, len(mine))] > total[np.clip(place - _SPAN + 1, 0, len(mine))]
    return place[inside], h[inside]


def _code(h: np.ndarray, buckets: int) -> np.ndarray:
    """An anchor's bucket and the low half of its hash, which tells the anchors of a bucket apart well enough to prune by."""
    low = h & np.uint64(0xFFFFFFFF)
    return ((h >> np.uint64(32)) % np.uint64(buckets) << np.uint64(32) | low).view(np.int64)


def _zipped(x: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(x), codec="zstd", asbytes=True)


def _unzipped(data: bytes, n: int, kind: type) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, decompressed_size=n * np.dtype(kind).itemsize, codec="zstd", asbytes=True), kind)


def _anchor_batches(buckets: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, n, lows, docs): the anchors of many texts, packed by bucket; a text's documents rise, so steps are sent."""
    docs: list[np.ndarray] = []
    codes: list[np.ndarray] = []

    def packed() -> pa.RecordBatch:
        doc, code = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (docs, codes))
        order = np.lexsort((doc, code >> 32))
        doc, code = doc[order], code[order]
        at = np.nonzero(np.concatenate([[True], np.diff(code >> 32) > 0]))[0] if len(code) else np.zeros(0, np.int64)
        ends = np.append(at[1:], len(code))
        return pa.RecordBatch.from_arrays(
            [
                pa.array((code[at] >> 32).astype(np.int32)), pa.array((ends - at).astype(np.int32)),
                pa.array([code[x:y].astype(np.uint32).tobytes() for x, y in zip(at, ends, strict=True)], pa.binary()),
                pa.array([_zipped(np.diff(doc[x:y], prepend=0)) for x, y in zip(at, ends, strict=True)], pa.binary()),
            ],
            names=["bucket", "n", "lows", "docs"],
        )

    waiting = 0
    for batch in batches:
        for doc, text, later in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            data = _bytes(text)
            mine = _first_starts(len(data), later)
            if doc is None or not mine.any():
                continue
            codes.append(np.unique(_code(_first_anchors(data, mine)[1], buckets)))
            docs.append(np.full(len(codes[-1]), doc))
            waiting += len(codes[-1])
            if waiting > PACK:
                yield packed()
                docs.clear()
                codes.clear()
                waiting = 0
    yield packed()


def _shared_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, code): the anchors of a bucket that two rows or more hold; those of many rows have their code inverted."""

    def told(doc: np.ndarray, code: np.ndarray, many: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(np.where(many, ~code, code))], names=["doc", "code"])

    def settled(final: bool) -> Iterator[pa.RecordBatch]:
        nonlocal many
        doc, code = (np.concatenate(x) for x in zip(*held, strict=True))
        found, back, n = np.unique(code, return_inverse=True, return_counts=True)
        often = (n >= MANY) | np.isin(found, many)
        many = np.union1d(many, found[often])
        out = (often | (n > 1) & final)[back]
        yield told(doc[out], code[out], often[back][out])
        held[:] = [] if final else [(doc[~out], code[~out])]

    many, held, bucket, size = np.zeros(0, np.int64), [], None, 0
    for batch in batches:
        for own, n, lows, docs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if own != bucket and held:
                yield from settled(True)
                many, size = many[:0], 0
            bucket = own
            held.append((np.cumsum(_unzipped(docs, n, np.int64)), np.frombuffer(lows, np.uint32).astype(np.int64) | own << 32))
            size += n
            if size > 2 * PACK:  # an anchor of very many texts: those texts need not wait
                yield from settled(False)
                size = len(held[0][0])
    if held:
        yield from settled(True)


def _reach(place: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each anchor of a text of n bytes, the first and last start of the strings whose leftmost least substring it is."""
    count, each = len(place), np.arange(len(place))
    before, after = place - _SPAN, place + _SPAN
    for ends, step in ((before, -1), (after, 1)):
        open_, k = each, step
        while len(open_):
            other = open_ + k
            open_ = open_[(other >= 0) & (other < count)]
            other = open_ + k
            near = np.abs(place[other] - place[open_]) < _SPAN
            open_, other = open_[near], other[near]
            stops = h[other] <= h[open_] if step < 0 else h[other] < h[open_]
            ends[open_[stops]] = place[other[stops]]
            open_, k = open_[~stops], k + step
    return np.maximum(before + 1, 0), np.minimum(np.minimum(place, after - _SPAN), n - REPEAT)


def _stretches(buckets: int, doc: int, text: str, later: list[dict] | None, shared: list[int]) -> Iterator[tuple[int, int, int, bytes]]:
    """(key, start, at, piece): the stretch of strings of each shared anchor, with the anchor at ``at``.

    Strings of an anchor that very many texts share come one by one, under a key of their own.
    """
    data = _bytes(text)
    total = np.concatenate([[0], np.cumsum(_first_starts(len(data), later))])
    place, h = anchors(data)
    low, high = _reach(place, h, len(data))
    code, own = _code(h, buckets), np.array(shared, np.int64)
    often = np.isin(code, ~own[own < 0])
    wanted = (low <= high) & (often | np.isin(code, own))
    wanted[wanted] = total[high[wanted] + 1] > total[low[wanted]]
    for x, y, p, key, single in zip(*(a[wanted].tolist() for a in (low, high, place, h.view(np.int64), often)), strict=True):
        if single:
            for s in range(x, y + 1):
                piece = data[s : s + REPEAT]
                yield xxhash.xxh64_intdigest(piece) - (1 << 63), s, p - s, piece
        else:
            yield key, x, p - x, data[x : y + REPEAT]


def _stretch_batches(buckets: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, doc, starts, at, piece): for each shared anchor, the stretch of its strings, and where in the text it stands.

    Equal strings have the same anchor at the same place in them, so they get one key. Of equal pieces in a batch only the
    least document's are sent, in one row, as the others repeat; they go on as ranges of starts, keyed by document:
    ``at`` starts from the one in ``starts`` on and no piece.
    """
    names = ["key", "doc", "starts", "at", "piece"]
    for batch in batches:
        ids: dict[bytes, int] = {}
        rows: list[list[int]] = [[] for _ in range(5)]
        for doc, text, later, shared in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if doc is not None and shared is not None:
                for key, start, at, piece in _stretches(buckets, doc, text, later, shared):
                    for col, x in zip(rows, (key, doc, start, at, ids.setdefault(piece, len(ids))), strict=True):
                        col.append(x)
        key, doc, start, at, own = (np.array(c, np.int64) for c in rows)
        least = np.full(len(ids), np.iinfo(np.int64).max)
        np.minimum.at(least, own, doc)
        gone = np.nonzero(doc > least[own])[0]
        size = np.array([len(x) - REPEAT + 1 for x in ids], np.int64)
        if len(gone):  # neighbouring ranges become one
            d, low = doc[gone], start[gone]
            high = low + size[own[gone]]
            edge = np.nonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (low[1:] != high[:-1])]))[0]
            low, d, high = low[edge], d[edge], high[np.append(edge[1:], len(gone)) - 1]
            single = pa.ListArray.from_arrays(pa.array(np.arange(len(d) + 1, dtype=np.int32)), pa.array(low))
            yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(d), single, pa.array((high - low).astype(np.int32)), pa.nulls(len(d), pa.binary())], names=names)
        kept = np.nonzero(doc == least[own])[0]
        kept = kept[np.argsort(own[kept], kind="stable")]  # each piece has rows here, all of one document
        edge = np.searchsorted(own[kept], np.arange(len(ids) + 1))
        starts, first = pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.array(start[kept])), kept[edge[:-1]]
        yield pa.RecordBatch.from_arrays([pa.array(key[first]), pa.array(least), starts, pa.array(at[first].astype(np.int32)), pa.array(list(ids), pa.binary())], names=names)


def _names(key: np.ndarray) -> np.ndarray:
    """The place of each key in the order of the different ones."""
    return np.unique(key, return_inverse=True)[1].astype(np.uint64)


def repeated_strings(pieces: list[bytes], at: np.ndarray, docs: np.ndarray) -> list[np.ndarray]:
    """For each piece, whether a piece of a smaller document has the string at each of its starts too.

    Residues modulo 3 count from ``at``. Suffixes of residues 1 and 2 are the sample, and triples of their 8-byte letters
    get names by their order. A name, the one 24 bytes on and the two bytes after it order a sampled suffix to 50 bytes;
    one of residue 0 is its first byte and the sampled suffix one byte on. Adjacent ones that are equal are repeats.
    """
    size = np.array([len(x) for x in pieces])
    first = np.cumsum(size) - size
    data = np.frombuffer(b"".join(pieces) + bytes(REPEAT + 2 * TRIPLE), np.uint8)
    n, u = int(size.sum()), np.uint64
    off = np.arange(n) - np.repeat(first, size)
    left = np.repeat(size, size) - off
    residue = (off - np.repeat(at, size)) % 3
    short = n < 1 << 21
    letter = _names(_words(data)[: n + 2 * TRIPLE])
    p = np.nonzero((residue > 0) & (left >= TRIPLE))[0]
    one, two, three = letter[p], letter[p + 8], letter[p + 16]
    name = np.zeros(n + REPEAT, u)
    name[p] = _names(one << u(42) | two << u(21) | three if short else _names(one << u(32) | two) << u(32) | three)
    p = np.nonzero(left >= REPEAT)[0]
    way = (residue[p] == 0).astype(np.int64)
    x, y = name[p + way], name[p + way + TRIPLE]
    b = data.astype(u)
    rest = b[p + 48 * (1 - way)] << u(8) | b[p + 49]
    pair = x << u(21) | y if short else _names(x << u(32) | y)
    key = way.astype(u) << u(63) | pair << u(16) | rest
    order = np.argsort(key)
    key = key[order]
    edge = np.nonzero(np.concatenate([[True], key[1:] != key[:-1]]))[0]
    own = np.repeat(docs, size)[p]
    least = np.empty(len(p), np.int64)
    least[order] = np.repeat(np.minimum.reduceat(own[order], edge), np.diff(np.append(edge, len(p))))
    return np.split(least < own, np.cumsum(size - REPEAT + 1)[:-1])


def _repeat_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, low, high): ranges of starts that repeat; rows come by key, piece and document.

    Of equal pieces the first row is sorted. Those of other documents repeat as a whole, those of its own as it does.
    Rows without a piece are ranges already.
    """
    pieces: list[bytes] = []
    at, docs, starts, size, last = [], [], [], 0, None

    def ranges() -> Iterator[tuple[int, int, int]]:
        for doc, own, gone in zip(docs, starts, repeated_strings(pieces, np.array(at), np.array(docs)), strict=True):
            if gone.any():
                edge = np.nonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))[0].tolist()
                for x, y in zip(edge[::2], edge[1::2], strict=True):
                    for s in own:
                        yield doc, s + x, s + y
        for x in (pieces, at, docs, starts):
            x.clear()

    def told(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
        doc, low, high = zip(*rows, strict=True) if rows else ([],) * 3
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (doc, low, high)], names=["doc", "low", "high"])

    for batch in batches:
        rows = []
        for key, doc, own, here, piece in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if piece is None:
                rows.append((doc, own[0], own[0] + here))
                continue
            if key != last and size > SORTED:
                rows += ranges()
                size = 0
            if key == last and pieces and piece == pieces[-1]:
                if doc == docs[-1]:
                    starts[-1] += own
                else:
                    rows += [(doc, s, s + len(piece) - REPEAT + 1) for s in own]
                continue
            last = key
            pieces.append(piece)
            at.append(here)
            docs.append(doc)
            starts.append(own)
            size += len(piece)
        yield told(rows)
    if pieces:
        yield told(list(ranges()))


def later_chunks(docs: DataFrame) -> tuple[DataFrame, int]:
    """(doc, later): the chunks of each text that a text with a smaller ``doc`` holds too, as ranges of starts; and the number of all chunks."""
    found = materialise(docs.mapInArrow(_chunk_batches, "doc long, low long, high long, k0 long, k1 long"), "chunks")
    firsts = found.groupBy("k0", "k1").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last")
    again = found.join(firsts, ["k0", "k1"]).where("doc > first")
    return materialise(_by_doc(again, "later"), "later"), found.count()


def _by_doc(ranges: DataFrame, name: str) -> DataFrame:
    return ranges.groupBy("doc").agg(F.collect_list(F.struct("low", "high")).alias(name))


def repeats(docs: DataFrame, later: DataFrame, buckets: int) -> DataFrame:
    """(doc, places): where other 50-byte strings start that also start in a text with a smaller ``doc``, as ranges.

    ``docs`` has (doc long, text), one row for each id; ``later`` is their :func:`later_chunks`.
    """
    judged = docs.join(later.hint("shuffle_hash"), "doc", "left").select("doc", "text", "later")
    packed = judged.mapInArrow(partial(_anchor_batches, buckets), "bucket int, n int, lows binary, docs binary")
    shared = packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_shared_batches, "doc long, code long")
    wanted = shared.groupBy("doc").agg(F.collect_list("code").alias("shared"))
    asked = judged.join(wanted.hint("shuffle_hash"), "doc", "left").select("doc", "text", "later", "shared")
    pieces = asked.mapInArrow(partial(_stretch_batches, buckets), "key long, doc long, starts array<long>, at int, piece binary")
    ordered = pieces.repartition("key").sortWithinPartitions("key", "piece", "doc")
    return _by_doc(ordered.mapInArrow(_repeat_batches, "doc long, low long, high long"), "places")


def _kept(data: bytes, places: list[dict] | None, later: list[dict] | None) -> tuple[int, int, str, list[tuple[int, int]]]:
    starts = ~_first_starts(len(data), [*(later or ()), *(places or ())])
    change = np.zeros(len(data) + 1, np.int64)
    at = np.nonzero(starts)[0]
    change[at] += 1
    change[at + REPEAT] -= 1
    gone = np.concatenate([[False], np.cumsum(change)[:-1] > 0, [False]])
    edge = np.nonzero(gone[1:] != gone[:-1])[0].tolist()
    spans = list(zip(edge[::2], edge[1::2], strict=True))
    digest, done = hashlib.sha256(), 0
    for x, y in spans:
        digest.update(data[done:x])
        done = y
    digest.update(data[done:])
    return sum(y - x for x, y in spans), len(spans), digest.hexdigest(), spans


def _result_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text, places, later in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
            data = _bytes(text)
            removed, n, sha, spans = _kept(data, places, later)
            rows.append((len(data), removed, n, sha, [{"start": a, "end": b} for a, b in spans]))
        n_bytes, n_removed, n_spans, sha, spans = zip(*rows, strict=True) if rows else ([],) * 5
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(x, pa.int64()) for x in (n_bytes, n_removed, n_spans)), pa.array(sha, pa.string()), pa.array(spans, kind)],
            names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"],
        )


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, spans) for each row; ids are longs.

    Each byte of a text that a 50-byte string covers which also starts in a text with a smaller id is removed;
    spans are the maximal removed runs of bytes. A null text is empty; texts under 50 bytes lose nothing. Of
    rows with equal texts, the one with the least id counts as first. Rows with a null id are reported and
    neither lose bytes nor make others lose them; rows that repeat an id count as one document and should hold one
    text (if not, a place that repeats in one of the texts is removed from all). An empty table gives an empty result. Other columns are ignored.
    """
    named = docs.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    later, n = later_chunks(named.where("doc is not null"))
    places = repeats(named, later, n // CHUNKS + 1)
    # Left joins by document all along, so that the texts are shuffled once; filters on documents would part the plans.
    joined = named.join(later.hint("shuffle_hash"), "doc", "left").join(places.hint("shuffle_hash"), "doc", "left")
    span = "array<struct<start:long,end:long>>"
    return joined.select("doc", "text", "places", "later").mapInArrow(
        _result_batches, f"id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans {span}"
    ).withColumnRenamed("id", id_col)
