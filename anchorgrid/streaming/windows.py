"""Structured Streaming forms of the anchor window, motion and presence operators.

The batch operators read stored streams; these read the same rows as they arrive. State is
bounded by the watermark, so it does not grow with the length of a stream.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stream_anchor_windows(
    anchors: DataFrame, events: DataFrame, *, left: str, right: str, late: str,
    anchor_time: str = "anchor_ts", event_time: str = "ts", player: tuple[str, str] | None = None,
) -> DataFrame:
    """Inner stream-stream join: events in ``[anchor - left, anchor + right)``.

    Both sides carry a watermark of ``late`` and the time range bounds how long either side's
    state is kept. ``player`` names the equal columns (anchor side, event side).
    """
    a, e = anchors.withWatermark(anchor_time, late), events.withWatermark(event_time, late)
    near = (F.col(event_time) >= F.col(anchor_time) - F.expr(f"INTERVAL {left}")) & (
        F.col(event_time) < F.col(anchor_time) + F.expr(f"INTERVAL {right}"))
    if player is not None:
        near = near & (F.col(player[0]) == F.col(player[1]))
    return a.join(e, near, "inner")


def _codes(columns: list, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(stream of each row, first row of each stream) for rows of the same key values; null is a value."""
    code = np.zeros(n, np.int64)
    for column in columns:
        part = pd.factorize(column, use_na_sentinel=False)[0]
        code = pd.factorize(code * (part.max(initial=0) + 1) + part)[0]
    return code, np.unique(code, return_index=True)[1]


def stream_rates(
    events: DataFrame, key: list[str], late: str, t: str = "ts", value: str = "value", forget_ms: int | None = None, groups: int = 2048,
) -> DataFrame:
    """Rate of change to the previous event of the same stream, in event-time order.

    Rows wait in the state of their stream until the watermark has passed them, so a row that
    arrives late but inside the watermark still gets its place; only rows that come after their
    place was left are dropped. The first event of a stream and one without time since the last
    have rate zero. A stream's state holds its last row and what arrived in the last ``late``; with
    ``forget_ms`` a stream begins anew after a longer pause, and gives its state up when the watermark is that far.

    Streams are dealt to ``groups`` groups by the hash of their key. A group is one call and one state, in which all its streams are
    arrays, so a stream costs its rows and no call of its own.
    """
    kinds = dict(events.dtypes)
    # keys go as text, as numbers beside a null would become floating
    schema = ", ".join(f"{k} string" for k in key) + f", {t} timestamp, {value} double, rate double"
    # the streams that have given out a row, and the rows that wait; each with its key
    lists = ", ".join(f"{side}_{i} array<string>" for side in ("given", "waiting") for i in range(len(key)))
    state_schema = f"{lists}, given_micros array<bigint>, given_values array<double>, waiting_micros array<bigint>, waiting_values array<double>"

    longest = float("inf") if forget_ms is None else forget_ms
    wide = len(key)

    def step(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get) if state.exists else [[]] * (2 * wide + 4)

        def kept(keys: list, micros: list, values: list, old: bool) -> pd.DataFrame:
            named = {k: pd.Series(list(x), dtype=object) for k, x in zip(key, keys)}
            return pd.DataFrame({**named, "micros": np.asarray(micros, np.int64), "x": np.asarray(values, float), "old": old})

        frames = [kept(held[:wide], *held[2 * wide : 2 * wide + 2], True), kept(held[wide : 2 * wide], *held[2 * wide + 2 :], False)]
        for batch in batches:
            micros = batch[t].astype("datetime64[us]").astype("int64").to_numpy()
            frames.append(kept([batch[k].astype(object).where(batch[k].notna(), None) for k in key], micros, batch[value].to_numpy(dtype=float), False))
        rows = pd.concat([f for f in frames if len(f)] or frames[:1], ignore_index=True)
        code, firsts = _codes([rows[k] for k in key], len(rows))
        micros, x, old = rows["micros"].to_numpy(), rows["x"].to_numpy(), rows["old"].to_numpy(dtype=bool)
        # what a stream has given out lies before its rows; rows of one time by their value, whatever came first
        past = np.full(len(firsts), np.iinfo(np.int64).min)
        past[code[old]] = micros[old]
        order = np.lexsort((x, micros, ~old, code))
        order = order[old[order] | (micros[order] >= past[code[order]])]
        code, micros, x, old = code[order], micros[order], x[order], old[order]
        mark = state.getCurrentWatermarkMs() * 1000
        ready = old | (micros <= mark)
        begins = np.diff(code, prepend=-1) != 0
        seconds = np.where(begins, 0.0, np.diff(micros, prepend=micros[:1]) / 1e6)
        rate = np.divide(np.diff(x, prepend=x[:1]), seconds, out=np.zeros(len(x)), where=(seconds > 0) & (seconds * 1000 <= longest))
        out = ready & ~old
        if out.any():
            keys = {k: rows[k].to_numpy()[firsts[code[out]]] for k in key}
            yield pd.DataFrame({**keys, t: pd.to_datetime(micros[out], unit="us"), value: x[out], "rate": rate[out]})
        # the last row given out by each stream
        last = np.flatnonzero(ready)[np.diff(code[ready], append=-1) != 0]
        waits = np.flatnonzero(~ready)
        if forget_ms is not None:
            newest = micros[last] // 1000
            last = last[(newest + forget_ms >= mark // 1000) | np.isin(code[last], code[waits])]
        if not len(last) and not len(waits):
            if state.exists:
                state.remove()
            return
        names = [rows[k].to_numpy()[firsts] for k in key]
        state.update((*([*name[code[at]]] for at in (last, waits) for name in names), micros[last].tolist(), x[last].tolist(), micros[waits].tolist(), x[waits].tolist()))
        # the first time at which a row that waits is given out or a stream gives up its state
        next_ms = [*(micros[waits] // 1000), *([] if forget_ms is None else micros[last] // 1000 + forget_ms)]
        if next_ms:
            # the watermark may already be past it
            state.setTimeoutTimestamp(int(max(min(next_ms), state.getCurrentWatermarkMs())) + 1)

    named = [F.col(k).cast("string").alias(k) for k in key]
    rows = events.withWatermark(t, late).select(*named, t, F.col(value).cast("double").alias(value), F.pmod(F.hash(*named), F.lit(groups)).alias("__group"))
    out = rows.groupBy("__group").applyInPandasWithState(step, schema, state_schema, "append", GroupStateTimeout.EventTimeTimeout)
    return out.select(*[F.col(k).cast(kinds[k]).alias(k) for k in key], t, value, "rate")


def stream_presence(events: DataFrame, size: str, slide: str | None, late: str, kind: str = "event_type", t: str = "ts", value: str = "value") -> DataFrame:
    """Rows and mean value per event type and tumbling or sliding window."""
    frame = F.window(t, size, slide) if slide else F.window(t, size)
    return events.withWatermark(t, late).groupBy(frame.alias("w"), kind).agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean_value")).select("w.start", "w.end", kind, "n", "mean_value")


def stream_turns(events: DataFrame, gap: str, late: str, speaker: list[str], t: str = "ts") -> DataFrame:
    """Turns as sessions: rows of a speaker with pauses shorter than ``gap``."""
    return events.withWatermark(t, late).groupBy(F.session_window(t, gap).alias("w"), *speaker).agg(
        F.count(F.lit(1)).alias("n")).select("w.start", "w.end", *speaker, "n")


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Process all rows that are there, write Parquet, and return what was written."""
    query = (
        stream.writeStream.outputMode(mode).format("parquet").option("path", path)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def closing_rows(events: DataFrame, late: str, t: str = "ts", **marks) -> DataFrame:
    """One row of ``events``' columns that lies past every window and wait of ``late``: what ends a stored stream.

    ``marks`` are the values that tell it apart; everything else is null. A window, a session or a waiting row is only given out
    once the watermark has passed it, so the last ones of a stored stream need a row after them.
    """
    # twice the delay and a year: beyond the end of any window that an event can lie in
    end = events.agg((F.max(t) + F.expr(f"INTERVAL {late}") * 2 + F.expr("INTERVAL 366 DAYS")).alias(t))
    given = {t: F.col(t), **{name: F.lit(value) for name, value in marks.items()}}
    return end.select(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in events.schema.fields])
