"""Conversation repair against enumeration of all edits, and the whole query against a plain loop."""

import hashlib
import random
import re
import zlib
from functools import cache

import pytest

from tidemark.llm import conversations
from tidemark.llm.registry import op13_conversations

SF = "/root/testdata/sf0.001"
GOAL = re.compile(r"(s?(ua)+)?")
SCHEMA = "conv_id long, turn long, role string, text string"


def faults(rows):
    """The first fault of each (role, text), in order."""
    seen, out = set(), []
    for role, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]", text)
        fault = "blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append(fault)
    return out


def enumerated(initials, fault):
    """(cost, audit) by trying every sequence of edits that costs no more than deleting all."""
    most, best = 2 * len(initials), []

    def go(k, made, cost, letters):
        if cost > most:
            return
        if k == len(initials) and GOAL.fullmatch(made):
            best.append((cost, letters))
        for x in "ua":
            go(k, made + x, cost + 5, letters + "I")
        if k < len(initials):
            go(k + 1, made, cost + 2, letters + "D")
            if fault[k] not in ("blank", "duplicate"):
                stay = 5 if fault[k] == "truncated" else 0
                go(k + 1, made + (initials[k] or "?"), cost + stay, letters + "K")
                for x in "ua":
                    go(k + 1, made + x, cost + stay + 1, letters + "R")

    go(0, "", 0, "")
    return min(best)


def recursed(initials, fault):
    """(cost, audit) by whole strings from the end; for sequences too long to enumerate."""

    @cache
    def least(k, last):
        options = [(0, "")] if k == len(initials) and last in ("", "a") else []
        follow = "a" if last == "u" else "u"
        if k < len(initials):
            ways = [("D", 2, last)]
            if fault[k] not in ("blank", "duplicate"):
                stay = 5 if fault[k] == "truncated" else 0
                if initials[k] == follow or initials[k] == "s" and last == "":
                    ways.append(("K", stay, initials[k]))
                ways.append(("R", stay + 1, follow))
            for letter, cost, now in ways:
                rest = least(k + 1, now)
                options.append((cost + rest[0], letter + rest[1]))
        if k == len(initials) and last in ("s", "u"):
            options.append((5 * (2 if last == "s" else 1), "II" if last == "s" else "I"))
        elif k < len(initials):
            for n in (1, 2):
                now = last
                for _ in range(n):
                    now = "a" if now == "u" else "u"
                direct = [("D", 2, now)]
                if fault[k] not in ("blank", "duplicate"):
                    stay = 5 if fault[k] == "truncated" else 0
                    nxt = "a" if now == "u" else "u"
                    direct += [("R", stay + 1, nxt)] + ([("K", stay, nxt)] if initials[k] == nxt else [])
                for letter, cost, then in direct:
                    rest = least(k + 1, then)
                    options.append((5 * n + cost + rest[0], "I" * n + letter + rest[1]))
        return min(options)

    return least(0, "")


def repaired(rows, audit):
    length = sum(x != "D" for x in audit)
    roles = iter(["system"] * (length % 2) + ["user", "assistant"] * (length // 2))
    given, out = iter(rows), []
    for edit in audit:
        row = next(given) if edit != "I" else None
        if edit != "D":
            role = next(roles)
            out.append(f"{row[0] if edit == 'K' else role}:{'' if edit == 'I' else row[1]}")
    return out


def expected(rows, solve=recursed):
    """One conversation's (turn, role, text) rows, in any order."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(f"{r[1]}\0{r[2]}".encode()).hexdigest()))
    turns = [t for t, _, _ in rows if t is not None]
    plain = [(role, text) for _, role, text in rows]
    fault, initials = faults(plain), [role[:1] for role, _ in plain]
    cost, audit = solve(tuple(initials), tuple(fault))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    counts = [fault.count(x) for x in ("blank", "duplicate", "truncated")]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    made = "\n".join(repaired(plain, audit))
    return (gaps, *counts, illegal, cost, audit, hashlib.sha256(made.encode()).hexdigest())


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        way = zlib.crc32(name.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        role = "user" if way == 4 else role
        text = "" if way == 1 else re.sub("[.!?]", "", text) if way == 2 else text
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(way, 1)
    return out


def random_conversations(rng, count, most):
    made = []
    for conv in range(count):
        for _ in range(rng.randrange(1, most + 1)):
            text = rng.choice(["a.", "b.", "c!", "d? ", "open", "", " \n", "a.b", "e.", "f."])
            made.append((conv, rng.choice([None, *range(12)]), rng.choice(["user", "assistant", "system", "user", "assistant", "tool", ""]), text))
    return made


def by_conversation(rows):
    out = {}
    for conv, *row in rows:
        out.setdefault(conv, []).append(tuple(row))
    return out


def found(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    audits = conversations.audit(df)
    shas = {r.conv_id: r.sha256 for r in conversations.digests(conversations.repair(df, audits)).collect()}
    none = hashlib.sha256().hexdigest()
    return {r.conv_id: (*r[1:], shas.get(r.conv_id, none)) for r in audits.collect()}


def test_short_conversations_equal_enumeration(spark):
    rows = random_conversations(random.Random(1), 150, 5)
    want = {c: expected(r, enumerated) for c, r in by_conversation(rows).items()}
    assert found(spark, rows) == want == {c: expected(r) for c, r in by_conversation(rows).items()}


@pytest.mark.parametrize("spill", [2, 64, 1 << 20])
def test_long_conversations_spill_over_batches(spark, monkeypatch, spill):
    rng = random.Random(spill)
    rows = random_conversations(rng, 3, 400) + [(None, k, "user" if k % 2 else "assistant", f"{k}.") for k in range(300)]
    monkeypatch.setattr(conversations, "SPILL", spill)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 37)
    try:
        assert found(spark, rows) == {c: expected(r) for c, r in by_conversation(rows).items()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_backpointers_go_to_a_file_and_come_back():
    rng, program = random.Random(7), conversations._Program({}, [])
    rows = [(rng.choice("uas"), rng.choice(["", "", "blank", "truncated"])) for _ in range(3000)]
    old, conversations.SPILL = conversations.SPILL, 128
    try:
        for k, (initial, fault) in reversed(list(enumerate(rows))):
            program.feed(k, initial, fault)
        assert program.file is not None
        got = program.result()
    finally:
        conversations.SPILL = old
    plain = conversations._Program({}, [])
    for k, (initial, fault) in reversed(list(enumerate(rows))):
        plain.feed(k, initial, fault)
    assert got == plain.result() and len(got[-1]) >= 3000


def test_repaired_rows_alternate_and_keep_texts(spark):
    rows = random_conversations(random.Random(3), 40, 8)
    df = spark.createDataFrame(rows, SCHEMA)
    made = by_conversation((r.conv_id, r.place, r.role, r.edit) for r in conversations.repair(df, conversations.audit(df)).collect())
    for some in made.values():
        some.sort()
        assert [p for p, _, _ in some] == list(range(len(some)))
        assert GOAL.fullmatch("".join(role[0] for _, role, _ in some))


def test_damage_and_query_equal_a_plain_loop(spark, tmp_path):
    given = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    given += [(None, None, None, None), (None, None, None, None), (None, 4, "user", "x."), (900, 0, "user", None), (901, 3, "user", "long. " * 20_000)]
    given += [(c, t, "user", "same.") for c in range(1000, 1030) for t in range(3)] + given[:5]
    extra = spark.createDataFrame([(*r, "x") for r in given], SCHEMA + ", digest string")
    extra.write.parquet(f"{tmp_path}/conversations.parquet")
    rows = damage(given)
    want = {c: expected(r) for c, r in by_conversation(rows).items()}
    none = (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
    got = {r[0]: tuple(r[1:]) for r in op13_conversations(spark, str(tmp_path)).collect()}
    assert got == {c: want.get(c, none) for c, *_ in given}


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    assert op13_conversations(spark, str(tmp_path)).collect() == []
