"""Streams that arrive out of order give what the stored rows give."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from anchorgrid.streaming import windows as sw

START = pd.Timestamp("2024-01-01")


def arriving(spark, folder, parts, late):
    """Files of the parts in order, then the closing row."""
    schema = "kind string, ts timestamp, value double"
    frames = [spark.createDataFrame(p, schema) for p in parts]
    for frame in frames:
        frame.coalesce(1).write.mode("append").parquet(folder)
    whole = frames[0]
    for frame in frames[1:]:
        whole = whole.unionByName(frame)
    sw.closing_rows(whole, late, kind="closing").coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def rates(frame):
    rows = frame.sort_values(["kind", "ts"], kind="stable")
    seconds = rows.groupby("kind")["ts"].diff().dt.total_seconds()
    rate = rows.groupby("kind")["value"].diff() / seconds
    return rows.assign(rate=np.where(seconds > 0, rate, 0.0)).reset_index(drop=True)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(6)
    seconds = np.sort(rng.choice(100_000, 240, replace=False))
    return pd.DataFrame({"kind": rng.choice(["a", "b", "c"], 240), "ts": START + pd.to_timedelta(seconds, unit="s"), "value": rng.normal(size=240).round(3)})


def test_late_rows_keep_their_place(spark, tmp_path, rows):
    rng = np.random.default_rng(1)
    arrival = (rows.ts - START).dt.total_seconds() + rng.integers(0, 7000, len(rows))
    parts = [rows[(arrival // 30_000) == i] for i in range(4)]
    assert any(p.ts.min() < q.ts.max() for p, q in zip(parts[1:], parts))  # some do come late
    stream = sw.stream_rates(arriving(spark, f"{tmp_path}/in", parts, "2 hours"), ["kind"], "2 hours")
    got = sw.run_available(stream, f"{tmp_path}/out", f"{tmp_path}/state").where("kind <> 'closing'").toPandas().sort_values(["kind", "ts"]).reset_index(drop=True)
    want = rates(rows)
    assert got.ts.tolist() == want.ts.tolist() and got.rate.tolist() == pytest.approx(want.rate.tolist())


def test_rows_later_than_the_watermark_are_left_out(spark, tmp_path, rows):
    late = rows.iloc[[5]]
    rest = rows.drop(late.index)
    parts = [rest[:120], rest[120:], late]
    stream = sw.stream_rates(arriving(spark, f"{tmp_path}/in", parts, "10 minutes"), ["kind"], "10 minutes")
    got = sw.run_available(stream, f"{tmp_path}/out", f"{tmp_path}/state").where("kind <> 'closing'")
    assert got.count() == 239 and got.where(F.col("ts") == F.lit(late.ts.iloc[0])).isEmpty()


def test_closing_row_gives_out_the_last_windows(spark, tmp_path, rows):
    stream = sw.stream_presence(arriving(spark, f"{tmp_path}/in", [rows], "1 hour"), "2 hours", "1 hour", "1 hour", kind="kind")
    got = sw.run_available(stream, f"{tmp_path}/out", f"{tmp_path}/state").toPandas()
    assert got.n.sum() == 2 * len(rows) and (got.end - got.start == pd.Timedelta("2h")).all()
    assert got.end.max() >= rows.ts.max() and set(got.kind) == {"a", "b", "c"}


@pytest.mark.parametrize("forget_ms,begins", [(None, 3), (5 * 86_400_000, 6)])
def test_idle_streams_begin_anew_only_when_told(spark, tmp_path, rows, forget_ms, begins):
    far = rows.assign(ts=rows.ts + pd.Timedelta("30 days"))
    one = rows[:1].assign(ts=START + pd.Timedelta("20 days"), kind="d")  # moves the watermark between the two
    parts = [rows, one, far]
    stream = sw.stream_rates(arriving(spark, f"{tmp_path}/in", parts, "1 hour"), ["kind"], "1 hour", forget_ms=forget_ms)
    got = sw.run_available(stream, f"{tmp_path}/out", f"{tmp_path}/state").where("kind IN ('a', 'b', 'c')").toPandas()
    assert len(got) == 2 * len(rows) and (got.rate == 0).sum() - (rates(rows).rate == 0).sum() * 2 + 6 == begins


def test_files_of_one_arrival_are_not_late_behind_each_other(spark, tmp_path):
    from anchorgrid.plans import load_all

    days = lambda a, b, step: [(START + pd.Timedelta(days=a) + pd.Timedelta(minutes=i)) for i in range(0, (b - a) * 1440, step)]
    for part in (days(10, 30, 20), days(0, 10, 60)):  # the larger file, which is read first, holds the later rows
        frame = pd.DataFrame({"event_id": range(len(part)), "ts": part, "user_id": 1, "event_type": "a", "value": 1.0, "props": "{}"})
        spark.createDataFrame(frame).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    got = load_all()[0]["Z2_stream_rates"](spark, str(tmp_path)).collect()
    assert [r.n for r in got] == [20 * 72 + 10 * 24]


def test_streams_of_a_group_share_a_state(spark, tmp_path):
    rng = np.random.default_rng(3)
    seconds = np.sort(rng.choice(200_000, 1200, replace=False))
    users = [None if u == 0 else 2**60 + int(u) for u in rng.integers(0, 90, 1200)]  # beyond what a double tells apart
    kinds = rng.choice(["a", "b", "None", None], 1200).tolist()
    frame = pd.DataFrame({"kind": kinds, "user": pd.Series(users, dtype=object), "ts": START + pd.to_timedelta(seconds, unit="s"), "value": rng.normal(size=1200).round(3)})
    turn = np.minimum(2, (seconds + rng.integers(0, 7000, 1200)) // 70_000)
    schema = "kind string, user long, ts timestamp, value double"
    rows = lambda part: [(k, u, t.to_pydatetime(), v) for k, u, t, v in part.itertuples(index=False)]
    for i in range(3):
        spark.createDataFrame(rows(frame[turn == i]), schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    whole = spark.createDataFrame(rows(frame), schema)
    sw.closing_rows(whole, "2 hours", kind="closing").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = sw.stream_rates(stream, ["kind", "user"], "2 hours", groups=4).writeStream.format("parquet").option("path", f"{tmp_path}/out").option(
        "checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    assert max(p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators) <= 4
    got = spark.read.parquet(f"{tmp_path}/out").where("kind IS DISTINCT FROM 'closing'")
    assert got.dtypes == [("kind", "string"), ("user", "bigint"), ("ts", "timestamp"), ("value", "double"), ("rate", "double")]
    last, want = {}, []
    for k, u, t, v in rows(frame):
        before = last.get((k, u))
        want.append((t, k, u, v, pytest.approx((v - before[1]) / (t - before[0]).total_seconds() if before else 0.0)))
        last[(k, u)] = (t, v)
    assert sorted(((r.ts, r.kind, r.user, r.value, r.rate) for r in got.collect()), key=lambda x: x[0]) == want
