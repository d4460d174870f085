"""Live operators on Structured Streaming state: session cursor, attention spans, and predictions settled by timers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def session_cursor(events: DataFrame, *, timeout_seconds: float) -> DataFrame:
    """(person_id, event_id, us, session_start) of each arriving event, streaming.

    An event later than the timeout after the last one opens a session. A late event joins the session that is
    open and never moves the cursor back; none is dropped, so no watermark is set.
    """
    limit = int(timeout_seconds * 1e6)

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, last = state.get if state.exists else (None, None)
        rows = pd.concat(list(batches)).sort_values(["us", "event_id"])
        starts = []
        for us in rows["us"]:
            if last is None or us - last > limit:
                start = int(us)
            last = int(us) if last is None else max(last, int(us))
            starts.append(start)
        state.update((start, last))
        yield pd.DataFrame({"person_id": key[0], "event_id": rows["event_id"], "us": rows["us"], "session_start": starts})

    return events.groupBy("person_id").applyInPandasWithState(
        advance, "person_id long, event_id long, us long, session_start long", "start long, last long", "append", GroupStateTimeout.NoTimeout
    )


def attention_spans(signals: DataFrame, *, cap_seconds: int = 1800) -> DataFrame:
    """(person_id, event_id, started_us, ended_us, end_reason) from signals (person_id, us, kind, tab, event_id), streaming.

    ``begin`` ends the open span as navigated; ``switch`` as tab-switch and reopens the tab's event, if it has one;
    ``close``, ``idle``, ``blur`` and ``shutdown`` end it. Empty spans vanish; longer ones are cut at the cap.
    """
    reasons = {"begin": "navigated", "switch": "tab-switch", "close": "tab-closed", "idle": "idle", "blur": "blur", "shutdown": "shutdown"}

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        event, began, tab, tabs, events = state.get if state.exists else (None, None, None, [], [])
        known, out = dict(zip(tabs, events, strict=True)), []
        for row in pd.concat(list(batches)).sort_values("us").itertuples():
            if row.kind == "close" and row.tab != tab:
                known.pop(row.tab, None)
                continue
            if event is not None and row.us > began:
                out.append((key[0], event, began, min(row.us, began + cap_seconds * 1_000_000), reasons[row.kind]))
            event = began = None
            if row.kind == "begin":
                event, began, tab, known[row.tab] = row.event_id, row.us, row.tab, row.event_id
            elif row.kind == "switch":
                tab, event = row.tab, known.get(row.tab)
                began = row.us if event is not None else None
            elif row.kind == "close":
                known.pop(row.tab, None)
            for old in list(known)[:-200]:
                del known[old]
        state.update((event, began, tab, list(known), list(known.values())))
        yield pd.DataFrame(out, columns=["person_id", "event_id", "started_us", "ended_us", "end_reason"])

    return signals.groupBy("person_id").applyInPandasWithState(
        step, "person_id long, event_id long, started_us long, ended_us long, end_reason string",
        "event long, began long, tab long, tabs array<long>, events array<long>", "append", GroupStateTimeout.NoTimeout,
    )


#: Kinds of the rows that settle predictions.
PREDICTION, EVENT, OFF, ON = "prediction", "event", "off", "on"


def resolution_stream(events: DataFrame, predictions: DataFrame, switches: DataFrame) -> DataFrame:
    """The rows (person_id, us, kind, category, end_us) of :func:`settle_predictions`, from streams or tables.

    ``events``: person_id, us, category. ``predictions``: person_id, category, start_us, end_us. ``switches``: person_id,
    us, on (collection goes on or off).
    """
    none, long = F.lit(None).cast("string"), F.lit(None).cast("long")
    return events.select("person_id", "us", F.lit(EVENT).alias("kind"), "category", long.alias("end_us")).unionByName(
        predictions.select("person_id", F.col("start_us").alias("us"), F.lit(PREDICTION).alias("kind"), "category", "end_us")
    ).unionByName(switches.select("person_id", "us", F.when(F.col("on"), ON).otherwise(OFF).alias("kind"), none.alias("category"), long.alias("end_us")))


def settle_predictions(rows: DataFrame, *, delay: str = "1 hour") -> DataFrame:
    """(person_id, category, start_us, end_us, outcome), streaming: ``pending`` when a prediction's start is past, then once
    ``hit``, ``miss`` or ``expired`` when its end is.

    ``rows`` come in any order within ``delay``; later ones are dropped. They wait in the state until the watermark has
    passed them and are then taken in the order of time, so the outcome doesn't depend on how they arrive. A timer at
    the earliest waiting row or window end wakes persons that send nothing more. An outcome is the one of
    ``evaluation.resolve_predictions`` just after the window's end: expired if collection was off for some time in the
    window, or if no event is as old as its start; else hit if an event of the category falls in (start, end].
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        oldest, off, open_, waiting = (state.get if state.exists else (None, None, [], []))
        open_, waiting = [list(x) for x in open_], [tuple(x) for x in waiting]
        if not state.hasTimedOut:
            for frame in batches:
                for us, kind, category, end in zip(frame["us"], frame["kind"], frame["category"], frame["end_us"], strict=True):
                    waiting.append((int(us), kind, category, None if pd.isna(end) else int(end)))
        now = state.getCurrentWatermarkMs() * 1000  # all rows before it are there
        due = sorted((r for r in waiting if r[0] < now), key=lambda r: (r[0], r[1], r[2] or "", r[3] or 0))
        waiting, out = [r for r in waiting if r[0] >= now], []

        def close(until: int) -> None:
            """Settle the windows that end before ``until``, in the order of their ends."""
            for window in sorted((w for w in open_ if w[2] < until), key=lambda w: (w[2], w[1], w[0])):
                category, start, end, hit, gap = window
                gone = gap or (off is not None and off < end) or oldest is None or oldest > start
                out.append((key[0], category, start, end, "expired" if gone else "hit" if hit else "miss"))
                open_.remove(window)

        for us, kind, category, end in due:
            close(us)
            if kind == EVENT:
                oldest = us if oldest is None else oldest
                for window in open_:
                    if window[0] == category and window[1] < us <= window[2]:
                        window[3] = True
            elif kind == PREDICTION:
                open_.append([category, us, end, False, False])
                out.append((key[0], category, us, end, "pending"))
            elif kind == OFF:
                off = us if off is None else off
            elif off is not None:
                for window in open_:
                    if off < window[2] and us > window[1]:
                        window[4] = True
                off = None
        close(now)
        state.update((oldest, off, [tuple(w) for w in open_], waiting))
        times = [w[2] + 1 for w in open_] + [r[0] + 1 for r in waiting]
        if times:
            state.setTimeoutTimestamp(max(-(-min(times) // 1000), now // 1000 + 1))
        yield pd.DataFrame(out, columns=["person_id", "category", "start_us", "end_us", "outcome"])

    timed = rows.withColumn("at", F.timestamp_micros("us")).withWatermark("at", delay)
    return timed.groupBy("person_id").applyInPandasWithState(
        step, "person_id long, category string, start_us long, end_us long, outcome string",
        "oldest long, off long, open array<struct<category: string, start: long, end: long, hit: boolean, gap: boolean>>, "
        "waiting array<struct<us: long, kind: string, category: string, end: long>>",
        "append", GroupStateTimeout.EventTimeTimeout,
    )
