"""Streaming forms on the events table, run to the end of the stored rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from anchorgrid.functions.hashing import draw
from anchorgrid.plans.registry import query
from anchorgrid.plans.roles import q6, r6
from anchorgrid.session import scratch
from anchorgrid.streaming import windows as sw


def stream(t):
    """The events file as a stream with a zoned timestamp."""
    schema = t.read("events").schema
    rows = t.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(t.sf_dir)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def arriving(t, form, late, turn=None, **marks):
    """``form`` of the events, which arrive in three turns in the order of ``turn`` or all at once, and then of a closing row.

    Each arrival is one run over all files that came, so the number of batches is that of the arrivals however many files a turn has,
    and no file of a turn is late behind another.
    """
    folder, kept = f"{scratch(t.spark, 'arriving')}/events", scratch(t.spark, "stream")
    rows = t.read("events").withColumn("ts", F.col("ts").cast("timestamp"))
    turns = [rows] if turn is None else [rows.filter(turn == place) for place in range(3)]
    closing, idle = sw.closing_rows(rows, late, **marks).coalesce(1), "spark.sql.streaming.noDataMicroBatches.enabled"
    before = t.spark.conf.get(idle)
    try:
        for part in (*turns, closing):
            # the stream goes on after a turn, so only the last run has a batch without rows
            t.spark.conf.set(idle, before if part is closing else "false")
            part.write.mode("append").parquet(folder)
            out = sw.run_available(form(t.spark.readStream.schema(rows.schema).parquet(folder)), f"{kept}/out", f"{kept}/state")
    finally:
        t.spark.conf.set(idle, before)
    return out


def finish(out):
    folder = scratch(out.sparkSession, "stream")
    return sw.run_available(out, f"{folder}/out", f"{folder}/state")


@query("Z1_stream_anchor_windows", """SELECT a.event_id AS anchor_id, e.event_id FROM events a JOIN events e ON e.user_id = a.user_id
  AND e.ts >= a.ts - INTERVAL 6 HOUR AND e.ts < a.ts + INTERVAL 6 HOUR WHERE a.event_type = 'purchase'""")
def _(t):
    anchors = stream(t).filter("event_type = 'purchase'").select(F.col("event_id").alias("anchor_id"), F.col("ts").alias("anchor_ts"), F.col("user_id").alias("player"))
    events = stream(t).select("event_id", "ts", "user_id")
    out = sw.stream_anchor_windows(anchors, events, left="6 HOURS", right="6 HOURS", late="1 hour", player=("player", "user_id"))
    return finish(out).select("anchor_id", "event_id")


# every row arrives up to 12 hours late, in one of three turns
@query("Z2_stream_rates", f"""SELECT event_type, user_id, count(*) AS n, {q6('sum(rate)', 9)} AS total, {q6('max(rate)', 9)} AS largest FROM (SELECT event_type, user_id, CASE WHEN lag(ts) OVER w IS NULL OR ts <= lag(ts) OVER w THEN 0.0
  ELSE (value - lag(value) OVER w) / (epoch_us(ts) - epoch_us(lag(ts) OVER w)) * 1000000.0::DOUBLE END AS rate FROM events WINDOW w AS (PARTITION BY event_type, user_id ORDER BY ts, value)) GROUP BY 1, 2""")
def _(t):
    arrival = F.unix_seconds("ts") + draw("late", F.col("event_id")) % 43_200
    span = t.read("events").agg(F.min(F.unix_seconds(F.col("ts").cast("timestamp"))).alias("a"), F.max(F.unix_seconds(F.col("ts").cast("timestamp"))).alias("b")).first()
    turn = F.least(F.lit(2), F.floor((arrival - span["a"]) * 3 / F.lit(span["b"] - span["a"] + 43_200)))
    form = lambda rows: sw.stream_rates(rows.select("event_type", "user_id", "ts", "value"), ["event_type", "user_id"], "2 days")
    out = arriving(t, form, "2 days", turn, event_type="closing", user_id=-1)
    out = out.filter("event_type <> 'closing'")
    return out.groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("rate"), 9).alias("total"), r6(F.max("rate"), 9).alias("largest"))


@query("Z3_stream_presence", f"""SELECT epoch_us(time_bucket(INTERVAL 6 HOUR, ts)) AS start_us, event_type, count(*) AS n, {q6('avg(value)')} AS mean_value FROM events GROUP BY 1, 2""")
def _(t):
    out = arriving(t, lambda rows: sw.stream_presence(rows, "6 hours", None, "1 day"), "1 day", event_type="closing")
    return out.select(F.unix_micros("start").alias("start_us"), "event_type", "n", r6(F.col("mean_value")).alias("mean_value"))


# every row lies in four windows of a day that start six hours apart
@query("Z3_stream_sliding", f"""SELECT epoch_us(time_bucket(INTERVAL 6 HOUR, ts)) - i * 21600000000 AS start_us, event_type, count(*) AS n, {q6('avg(value)')} AS mean_value FROM events, (SELECT unnest(range(0, 4)) AS i) GROUP BY 1, 2""")
def _(t):
    out = arriving(t, lambda rows: sw.stream_presence(rows, "1 day", "6 hours", "1 day"), "1 day", event_type="closing")
    return out.select(F.unix_micros("start").alias("start_us"), "event_type", "n", r6(F.col("mean_value")).alias("mean_value"))


@query("Z3_stream_turns", """SELECT epoch_us(min(ts)) AS start_us, epoch_us(max(ts) + INTERVAL 12 HOUR) AS end_us, user_id, count(*) AS n FROM (
  SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 12 HOUR THEN 0 ELSE 1 END AS fresh FROM events))
  GROUP BY user_id, session""")
def _(t):
    out = arriving(t, lambda rows: sw.stream_turns(rows, "12 hours", "1 day", ["user_id"]), "1 day", user_id=-1)
    return out.select(F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "user_id", "n")
