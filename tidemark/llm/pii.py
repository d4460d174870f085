"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes.

The patterns give the base spans. The field is trained on a small labelled table of made-up sentences: personal data
in the patterns' forms and in forms that the patterns miss, among numbers that are no personal data. It is decoded by
Viterbi in numpy batches and adds spans that look like personal data in their shape and place and that no pattern took.
Base spans are never changed.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.scratch import TEXTS, materialise, numbered

#: The kinds in the order in which spans are listed.
KINDS = ("email", "ip", "card", "phone")
#: The patterns of the kinds, with possessive repeats where nothing is ever given back.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

#: Tokens that the field decodes: those with a digit or an @. All others are outside every span.
_OPEN = re.compile(r"\S*[0-9@]\S*")
#: Rows of the labelled table.
TRAIN_ROWS = 3_000


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Each @ is tried once with the longest local part since the last span: linear in the text."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start; code points, end exclusive. Kinds may overlap each other."""
    text, out = text or "", []
    if "@" in text:
        out += [("email", s, e) for s, e in _emails(text)]
    if not _DIGIT.search(text):
        return out
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(int(x.lstrip("0")[:4] or 0) <= 255 for x in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "") if m.end() - m.start() <= 40 else ""
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return out


# ---- tokens and shapes

_CLASS = str.maketrans({**{c: "9" for c in "0123456789"}})
_LETTERS = re.compile(r"[^\W\d_]+")
_ENDS = "\"'.,;:!?#$%&*"
_PLACES = ("prev", "own", "next", "coarse")
_SHAPES = 1 << 12


def shape(token: str) -> str:
    """Letter runs become one letter, digits 9 (runs over four: their length in bands), marks stay.

    A number of 13 to 19 digits also says whether it passes Luhn's check.
    """
    plain = token.translate(_CLASS)
    s = re.sub("9{5,}", lambda m: f"9*{min(8, len(m[0]) // 3)}", _LETTERS.sub("x", plain))
    if 13 <= plain.count("9") <= 19 and "x" not in s:
        s += "+" if luhn("".join(c for c in token if c in "0123456789")) else "-"
    return s


def coarse_shape(token: str) -> str:
    """The shape with every run of digits as one, whatever its length, and no marks at its ends."""
    return re.sub("9+", "9", _LETTERS.sub("x", token.translate(_CLASS))).strip(_ENDS)


def _shape_id(token: str, of: Callable[[str], str] = shape) -> int:
    if not token:
        return 0
    return 1 + int.from_bytes(hashlib.blake2b(of(token).encode(), digest_size=4).digest(), "little") % (_SHAPES - 1)


@dataclass(frozen=True)
class Field:
    """Weights: ``emit[place, shape, label]`` and ``move[label, label]``; label 0 is outside, k+1 is KINDS[k]."""

    emit: np.ndarray
    move: np.ndarray


def _chains(text: str) -> Iterator[tuple[list[tuple[int, int]], np.ndarray]]:
    """Runs of open tokens that only white space parts, with (prev, own, next, coarse own) shape ids.

    A token without digit or @ has label 0 for certain, so the chain splits there without loss.
    """
    run: list[tuple[int, int]] = []

    def done() -> tuple[list[tuple[int, int]], np.ndarray]:
        before = text[max(0, run[0][0] - 40) : run[0][0]].split()
        after = text[run[-1][1] : run[-1][1] + 40].split()
        ids = [_shape_id(before[-1] if before else ""), *(_shape_id(text[s:e]) for s, e in run), _shape_id(after[0] if after else "")]
        coarse = [_shape_id(text[s:e], coarse_shape) for s, e in run]
        return run, np.stack([ids[:-2], ids[1:-1], ids[2:], coarse], axis=1)

    for m in _OPEN.finditer(text):
        if run and text[run[-1][1] : m.start()].strip():
            yield done()
            run = []
        run.append(m.span())
    if run:
        yield done()


def _scores(field: Field, ids: np.ndarray) -> np.ndarray:
    return sum(field.emit[k][ids[..., k]] for k in range(len(_PLACES)))


def labelled_table(rows: int = TRAIN_ROWS, seed: int = 5) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Made-up sentences with the (kind, start, end) of their personal data, the same for one seed.

    A third of the items are in the patterns' forms, a third in forms that they miss (national phone numbers, masked
    @ and dots, cards of 15 digits or with other marks), and a third numbers that are no personal data.
    """
    rng = random.Random(seed)

    def digits(n: int) -> str:
        return str(rng.randrange(1, 10)) + "".join(str(rng.randrange(10)) for _ in range(n - 1))

    def word() -> str:
        return "".join(rng.choice("abcdefghiklmnoprstuvwzéüñ") for _ in range(rng.randrange(2, 10)))

    def card(n: int, good: bool = True) -> str:
        while True:
            number = digits(n)
            if luhn(number) == good:
                return number

    def parted(number: str, sizes: tuple[int, ...], mark: str) -> str:
        ends = [sum(sizes[: k + 1]) for k in range(len(sizes))]
        return mark.join(number[e - n : e] for e, n in zip(ends, sizes, strict=True))

    def ip(dot: str = ".") -> str:
        return dot.join(str(rng.randrange(256)) for _ in range(4))

    def name() -> str:
        return word() + rng.choice(["", ".", "_", "-"]) + rng.choice([word(), digits(2), ""]) + rng.choice(["", "x"])

    def site() -> str:
        return rng.choice(["", "mail.", f"mail{rng.randrange(10)}."]) + word() + rng.choice([".com", ".org", ".example.com", ".de"])

    four = (4, 4, 4, 4)
    known = [
        ("email", lambda: f"{name()}@{site()}"),
        ("ip", ip),
        ("card", lambda: card(16)),
        ("card", lambda: parted(card(16), four, rng.choice(" -"))),
        ("phone", lambda: f"+{digits(rng.randrange(1, 3))} ({rng.choice('0123456789')}{digits(2)}) {digits(3)}-{digits(4)}"),
        ("phone", lambda: f"+{digits(2)} {digits(2)} {digits(7)}"),
    ]
    missed = [
        ("phone", lambda: f"({rng.choice('0123456789')}{digits(2)}) {digits(3)}-{digits(4)}"),
        ("phone", lambda: f"({digits(3)}){digits(3)}-{digits(4)}"),
        ("phone", lambda: f"{digits(3)}-{digits(3)}-{digits(4)}"),
        ("phone", lambda: f"{digits(3)}.{digits(3)}.{digits(4)}"),
        ("phone", lambda: f"0{digits(3)}/{digits(7)}"),
        ("email", lambda: f"{name()}[@]{site()}"),
        ("email", lambda: f"{name()}(@){site()}"),
        ("email", lambda: f"{name()}@[{ip()}]"),
        ("ip", lambda: ip("[.]")),
        ("card", lambda: parted(card(15), (4, 6, 5), rng.choice(" -"))),
        ("card", lambda: parted(card(16), four, rng.choice("._/"))),
    ]
    other = [
        lambda: f"{digits(4)}-{rng.randrange(10, 13)}-{rng.randrange(10, 29)}", lambda: f"{rng.randrange(1, 29)}/{rng.randrange(1, 13)}/{digits(4)}",
        lambda: f"{rng.randrange(10, 24)}:{rng.randrange(10, 60)}", lambda: f"${digits(2)}.{digits(2)}", lambda: f"{digits(2)}.{digits(1)}%",
        lambda: f"{digits(1)}.{digits(1)}", lambda: f"v{digits(1)}.{digits(1)}.{digits(2)}", lambda: f"{digits(1)}.{digits(2)}.{digits(1)}",
        lambda: digits(rng.randrange(1, 13)), lambda: card(16, good=False), lambda: parted(card(16, good=False), four, rng.choice(" -")),
        lambda: f"INV-{digits(5)}", lambda: f"{word()}{digits(2)}", lambda: f"@{word()}", lambda: f"{digits(1)}th", lambda: f"#{digits(3)}",
        lambda: 'token = "' + "".join(rng.choice("0123456789abcdef") for _ in range(40)) + '"', lambda: f"{digits(1)},{digits(3)}",
        lambda: f"{digits(3)}-{digits(3)}", lambda: f"({digits(4)})", lambda: f"{digits(2)}-{digits(2)}", lambda: f"{digits(3)}.{digits(3)}",
    ]
    table = []
    for _ in range(rows):
        parts, spans, at = [], [], 0

        def say(text: str, kind: str | None = None) -> None:
            nonlocal at
            if kind:
                spans.append((kind, at, at + len(text)))
            parts.append(text)
            at += len(text)

        for _ in range(rng.randrange(1, 5)):
            say(" ".join(word() for _ in range(rng.randrange(0, 6))) + " ")
            which = rng.randrange(3)
            if which == 2:
                say(rng.choice(other)())
            else:
                kind, made = rng.choice((known, missed)[which])
                say(made(), kind)
            say(rng.choice([" ", " ", " ", ", ", ". ", "!! ", "\n", "### "]))
        say(word())
        table.append(("".join(parts), spans))
    return table


def train(table: list[tuple[str, list[tuple[str, int, int]]]], rounds: int = 80, rate: float = 0.5, decay: float = 1e-4) -> Field:
    """Maximum likelihood of the label chains, by full-batch AdaGrad on forward-backward sums.

    ``table`` has texts with their (kind, start, end); an empty one gives a field that adds nothing.
    """
    labels = 1 + len(KINDS)
    emit, move = np.zeros((len(_PLACES), _SHAPES, labels)), np.zeros((labels, labels))
    emit[1, :, 0] = 2.0  # a shape that training never saw is outside
    by_length: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    for text, found in table:
        spans = [(s, e, 1 + KINDS.index(kind)) for kind, s, e in found]
        for run, ids in _chains(text):
            for k in range(0, len(run), 64):
                own = run[k : k + 64]
                gold = np.array([next((y for s, e, y in spans if s < b and e > a), 0) for a, b in own])
                by_length.setdefault(len(own), []).append((ids[k : k + 64], gold))
    groups = [(np.stack([x for x, _ in g]), np.stack([y for _, y in g])) for g in by_length.values()]
    total = max(1, sum(len(y) for _, y in groups))
    sums = [np.full_like(emit, 1e-8), np.full_like(move, 1e-8)]
    for _ in range(rounds if groups else 0):
        g_emit, g_move = -decay * emit, -decay * move
        g_emit[1, :, 0] += decay * 2.0
        for ids, gold in groups:
            n, length = gold.shape
            s = _scores(Field(emit, move), ids)
            fwd, bwd = np.empty_like(s), np.zeros_like(s)
            fwd[:, 0] = s[:, 0]
            for t in range(1, length):
                fwd[:, t] = s[:, t] + _lse(fwd[:, t - 1, :, None] + move, 1)
            for t in range(length - 2, -1, -1):
                bwd[:, t] = _lse(move + (s[:, t + 1] + bwd[:, t + 1])[:, None, :], 2)
            z = _lse(fwd[:, -1], 1)
            expected = np.exp(fwd + bwd - z[:, None, None])
            diff = (np.eye(labels)[gold] - expected) / total
            for k in range(len(_PLACES)):
                np.add.at(g_emit[k], ids[..., k].ravel(), diff.reshape(-1, labels))
            for t in range(1, length):
                pair = fwd[:, t - 1, :, None] + move + (s[:, t] + bwd[:, t])[:, None, :] - z[:, None, None]
                np.add.at(g_move, (gold[:, t - 1], gold[:, t]), 1 / total)
                g_move -= np.exp(pair).sum(axis=0) / total
        for w, g, q in ((emit, g_emit, sums[0]), (move, g_move, sums[1])):
            q += g * g
            w += rate * g / np.sqrt(q)
    return Field(emit.astype(np.float32), move.astype(np.float32))


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def viterbi(field: Field, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best labels of a batch of equally long chains, and each token's margin over label 0."""
    s = _scores(field, ids)
    n, length, _ = s.shape
    best, back = s[:, 0], np.zeros(s.shape, np.int64)
    for t in range(1, length):
        step = best[:, :, None] + field.move
        back[:, t] = step.argmax(axis=1)
        best = step.max(axis=1) + s[:, t]
    out = np.empty((n, length), np.int64)
    out[:, -1] = best.argmax(axis=1)
    for t in range(length - 1, 0, -1):
        out[:, t - 1] = back[np.arange(n), t, out[:, t]]
    own = np.take_along_axis(s, out[..., None], axis=2)[..., 0]
    return out, own - s[..., 0]


_TRIM = "()[]{}<>\"'.,;:!?"
_TRIM_END = "([{<>\"'.,;:!?#$%&*"


def added_spans(field: Field, texts: list[str | None], base: list[list[tuple[str, int, int]]], margin: float = 1.0) -> list[list[tuple[str, int, int]]]:
    """Spans of the field for each text that touch no base span; neighbours of one kind are one span."""
    jobs: dict[int, list[tuple[int, list[tuple[int, int]], np.ndarray]]] = {}
    for k, text in enumerate(texts):
        if text and ("@" in text or _DIGIT.search(text)):
            for run, ids in _chains(text):
                jobs.setdefault(len(run), []).append((k, run, ids))
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    for group in jobs.values():
        step = max(1, 200_000 // len(group[0][1]))
        for g in range(0, len(group), step):
            part = group[g : g + step]
            for (k, run, _), path, over in zip(part, *viterbi(field, np.stack([x for _, _, x in part])), strict=True):
                t = 0
                while t < len(run):
                    end = t + 1
                    while path[t] and end < len(run) and path[end] == path[t]:
                        end += 1
                    if path[t] and over[t:end].min() >= margin:
                        s, e = run[t][0], run[end - 1][1]
                        piece = texts[k][s:e]
                        open_at = piece.find("(")  # an area code keeps its bracket
                        front = _TRIM.replace("(", "") if 0 <= open_at < piece.find(")") else _TRIM
                        s, e = s + len(piece) - len(piece.lstrip(front)), e - (len(piece) - len(piece.rstrip(_TRIM_END)))
                        if s < e and not any(a < e and b > s for _, a, b in base[k]):
                            out[k].append((KINDS[path[t] - 1], s, e))
                    t = end
    return [sorted(x, key=lambda y: (KINDS.index(y[0]), y[1])) for x in out]


def find(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base, added): arrays of (kind, start, end) for each row, over the whole text.

    Null and empty texts have no spans. Rows are judged one by one, so repeated rows, ties and null ids do
    not matter; an empty table gives an empty result. Other columns are ignored.
    """
    span = "array<struct<kind:string,start:long,end:long>>"
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        typ = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in rows:
            texts = batch.column(1).to_pylist()
            base = [base_spans(x) for x in texts]
            added = added_spans(shared.value, texts, base)
            rows_of = [pa.array([[dict(zip(("kind", "start", "end"), y, strict=True)) for y in x] for x in z], typ) for z in (base, added)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *rows_of], names=["id", "base", "added"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col)).mapInArrow(batches, f"id {kind}, base {span}, added {span}")


def redact(docs: DataFrame, field: Field, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets, and ``length_col`` set to the new length.

    Overlapping spans are merged and named by the first. Null and empty texts stay as they are; rows are judged one by
    one, so repeats and ties do not matter. An empty table gives an empty result; other columns stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field)
    plain = numbered(docs)
    names, place = plain.columns, docs.columns.index(text_col)

    def clean(text: str, spans: list[tuple[str, int, int]]) -> str:
        parts, done = [], 0
        for kind, s, e in sorted(spans, key=lambda x: (x[1], x[2])):
            if s >= done:
                parts += [text[done:s], f"<{kind}>"]
            done = max(done, e)
        return "".join([*parts, text[done:]]) if parts else text

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            texts = batch.column(place).to_pylist()
            base = [base_spans(x) for x in texts]
            added = added_spans(shared.value, texts, base)
            new = [x if x is None else clean(x, b + a) for x, b, a in zip(texts, base, added, strict=True)]
            cols = list(batch.columns)
            cols[place] = pa.array(new, batch.column(place).type)
            yield pa.RecordBatch.from_arrays(cols, names=names)

    out = materialise(plain.mapInArrow(batches, plain.schema), "redacted", TEXTS)
    if length_col in docs.columns:
        length = names[docs.columns.index(length_col)]
        out = out.withColumn(length, F.length(names[place]).cast(plain.schema[length].dataType))
    return out.toDF(*docs.columns)
