"""The test tables in the roles the operators expect, as DataFrames and as SQL fragments.

Each SQL constant is the body of a common table expression that mirrors the DataFrame
property of the same name, so a query and its SQL twin start from the same rows.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from anchorgrid.functions.hashing import draw


def h32(expr: str) -> str:
    """SQL twin of :func:`anchorgrid.functions.hashing.draw`."""
    return f"(('0x' || substr(md5({expr}), 1, 8))::BIGINT)"


def h60(expr: str) -> str:
    return f"(('0x' || substr(md5({expr}), 1, 15))::BIGINT)"


EV = """SELECT event_id, epoch_us(ts) // 1000 AS t, user_id, event_type, value,
  CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
  user_id % 10 AS experiment, epoch_us(ts) // 86400000000 AS chunk FROM events"""

# a cue word is a purchase, a scope word a signup of the same user on the same day
CUES = f"SELECT * FROM ({EV}) WHERE event_type = 'purchase'"
SCOPES = f"SELECT * FROM ({EV}) WHERE event_type = 'signup'"

PREDS = f"""SELECT doc_id AS sample_id, source AS group_id, lang, fold, quality AS label, model,
  p100 / 100.0::DOUBLE AS probability, (45 + 2 * fold) / 100.0::DOUBLE AS threshold,
  CAST(p100 / 100.0::DOUBLE >= (45 + 2 * fold) / 100.0::DOUBLE AS INTEGER) AS prediction
  FROM (SELECT l.doc_id, d.source, d.lang, l.quality, m.model,
    {h32("'fold:' || d.source")} % 5 AS fold,
    CASE WHEN m.model = 'a'
      THEN 1 + {h32("'a:' || l.doc_id")} % 59 + 25 * l.quality + d.n_chars % 15
      ELSE 1 + {h32("'b:' || l.doc_id")} % 74 + 10 * l.quality + d.n_chars % 15 END AS p100
    FROM labels l JOIN documents d USING (doc_id), (VALUES ('a'), ('b')) m(model))"""

# 4 channels x 16 frames per vector
GRID = """SELECT vec_id AS sample_id, label AS class10, CAST(label >= 5 AS INTEGER) AS label,
  (i - 1) // 16 AS channel, (i - 1) % 16 AS frame, embedding[i]::DOUBLE AS value
  FROM embeddings, (SELECT unnest(range(1, 65)) AS i)"""

# one channel of 64 frames per vector
SERIES = """SELECT vec_id AS sample_id, CAST(label >= 5 AS INTEGER) AS label,
  i - 1 AS frame, embedding[i]::DOUBLE AS value
  FROM embeddings, (SELECT unnest(range(1, 65)) AS i)"""

# a frame is present when the hash of its position is not a multiple of five
PGRID = f"""SELECT *, CAST({h32("'p:' || sample_id || ':' || channel || ':' || frame")} % 5 <> 0
  AS INTEGER) AS present FROM ({GRID})"""


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def ev(self) -> DataFrame:
        millis = F.unix_millis(F.col("ts").cast("timestamp"))
        return self.read("events").select(
            "event_id", millis.alias("t"), "user_id", "event_type", "value",
            F.get_json_object("props", "$.k").cast("bigint").alias("k"),
            (F.col("user_id") % 10).alias("experiment"),
            F.expr("unix_millis(cast(ts as timestamp)) div 86400000").alias("chunk"),
        )

    @property
    def cues(self) -> DataFrame:
        return self.ev.filter(F.col("event_type") == "purchase")

    @property
    def scopes(self) -> DataFrame:
        return self.ev.filter(F.col("event_type") == "signup")

    @cached_property
    def preds(self) -> DataFrame:
        docs = self.read("documents").select("doc_id", "source", "lang", "n_chars")
        base = self.read("labels").join(docs, "doc_id").withColumn(
            "fold", draw("fold", F.col("source")) % 5
        )
        tail = F.col("n_chars") % 15
        a = 1 + draw("a", F.col("doc_id")) % 59 + 25 * F.col("quality") + tail
        b = 1 + draw("b", F.col("doc_id")) % 74 + 10 * F.col("quality") + tail
        model = F.explode(F.array(
            F.struct(F.lit("a").alias("model"), a.alias("p100")),
            F.struct(F.lit("b").alias("model"), b.alias("p100")),
        )).alias("m")
        threshold = (45 + 2 * F.col("fold")) / F.lit(100.0)
        return base.select("*", model).select(
            F.col("doc_id").alias("sample_id"), F.col("source").alias("group_id"), "lang", "fold",
            F.col("quality").alias("label"), F.col("m.model").alias("model"),
            (F.col("m.p100") / F.lit(100.0)).alias("probability"), threshold.alias("threshold"),
        ).withColumn("prediction", (F.col("probability") >= F.col("threshold")).cast("int"))

    @cached_property
    def grid(self) -> DataFrame:
        return self.read("embeddings").select(
            F.col("vec_id").alias("sample_id"), F.col("label").alias("class10"),
            (F.col("label") >= 5).cast("int").alias("label"),
            F.posexplode("embedding").alias("pos", "x"),
        ).select(
            "sample_id", "class10", "label", F.expr("cast(pos div 16 as bigint)").alias("channel"),
            (F.col("pos") % 16).cast("bigint").alias("frame"), F.col("x").cast("double").alias("value"),
        )

    @cached_property
    def series(self) -> DataFrame:
        return self.read("embeddings").select(
            F.col("vec_id").alias("sample_id"), (F.col("label") >= 5).cast("int").alias("label"),
            F.posexplode("embedding").alias("pos", "x"),
        ).select(
            "sample_id", "label", F.col("pos").cast("bigint").alias("frame"),
            F.col("x").cast("double").alias("value"),
        )

    @cached_property
    def pgrid(self) -> DataFrame:
        seen = draw("p", F.col("sample_id"), F.col("channel"), F.col("frame")) % 5 != 0
        return self.grid.withColumn("present", seen.cast("int"))


def r6(column, digits: int = 6):
    """Round for comparison; adding zero turns -0.0 into 0.0."""
    return F.round(column, digits) + F.lit(0.0)


def q6(expr: str, digits: int = 6) -> str:
    return f"(round({expr}, {digits}) + 0.0)"


# a scope word belongs to the latest cue of the same user on the same day
LINKS = f"""SELECT event_id AS negation_id, 'cue_tokens' AS field, event_id AS word_id FROM ({CUES})
  UNION ALL
  SELECT c.event_id, 'scope_tokens', s.event_id FROM ({SCOPES}) s
  ASOF JOIN ({CUES}) c ON s.user_id = c.user_id AND s.chunk = c.chunk AND s.t >= c.t"""


def links(t: Tables) -> DataFrame:
    from anchorgrid.operators.ordered import Ordered

    both = t.ev.filter(F.col("event_type").isin("purchase", "signup"))
    is_cue = F.col("event_type") == "purchase"
    line = Ordered(both, ["user_id", "chunk"], ["t", "event_type", "event_id"]).carried(
        F.when(is_cue, F.col("event_id")), "cue", -1
    ).done()
    return line.filter(F.col("cue").isNotNull()).select(
        F.col("cue").alias("negation_id"),
        F.when(is_cue, "cue_tokens").otherwise("scope_tokens").alias("field"),
        F.col("event_id").alias("word_id"),
    )


def words(t: Tables) -> DataFrame:
    return t.ev.select(
        F.col("event_id").alias("word_id"), "experiment", F.col("user_id").alias("player"), "chunk",
        F.col("event_type").alias("text"), F.col("t").alias("time_ms"), "k",
    )


WORDS = f"""SELECT event_id AS word_id, experiment, user_id AS player, chunk, event_type AS text,
  t AS time_ms, k FROM ({EV})"""
