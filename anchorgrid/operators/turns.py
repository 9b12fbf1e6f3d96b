"""Speaker turns, turn positions, sentences and part-of-speech joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from anchorgrid.operators.ordered import Ordered, with_group_size


def speaker_turns(words: DataFrame, experiment: str, player: str, order: list[str]) -> DataFrame:
    """Add ``turn``: 0-based number of the same-speaker run inside the experiment."""
    line = Ordered(words, [experiment], order).neighbour([player], "__prev", -1)
    changed = F.when(F.col("__prev").isNull() | (F.col(f"__prev.{player}") != F.col(player)), 1).otherwise(0)
    return line.running({"turn": changed.cast("bigint")}).done().withColumn("turn", F.col("turn") - 1).drop("__prev")


def turn_positions(words: DataFrame, experiment: str, order: list[str]) -> DataFrame:
    """Add ``position_bin``: third of the turn by word order, one word alone is its middle."""
    rows = Ordered(words, [experiment, "turn"], order).numbered("__i").done()
    rows = with_group_size(rows, [experiment, "turn"], "__n")
    at = F.when(F.col("__n") == 1, F.lit(0.5)).otherwise((F.col("__i") - 1) / (F.col("__n") - 1))
    third = F.when(at < 1 / 3, "early").when(at < 2 / 3, "middle").otherwise("late")
    return rows.withColumn("position_bin", third).drop("__i", "__n")


def sentences(tokens: DataFrame, audio: str, order: list[str], text: str, end_rule: str = r"[.!?]$") -> DataFrame:
    """Add ``sentence`` and ``token_ix``: a token that ends a sentence closes its slice.

    Ids stay on their token rows; what follows the last end is one more sentence.
    """
    ends = F.col(text).rlike(end_rule).cast("bigint")
    line = Ordered(tokens, [audio], order).running({"__closed": ends}).done()
    line = line.withColumn("sentence", F.col("__closed") - ends).drop("__closed")
    rows = Ordered(line, [audio, "sentence"], order).numbered("token_ix").done()
    return rows.withColumn("token_ix", F.col("token_ix") - 1)


def character_spans(tokens: DataFrame, keys: list[str], order: list[str], text: str) -> DataFrame:
    """Add ``start`` and ``stop``: offsets of the token in its space-joined text."""
    size = F.length(F.when(F.trim(text) == "", F.lit(" ")).otherwise(F.col(text)))
    line = Ordered(tokens, keys, order).running({"__upto": size + 1}).done()
    return line.withColumn("stop", F.col("__upto") - 1).withColumn("start", F.col("__upto") - 1 - size).drop("__upto")


def pos_by_overlap(words: DataFrame, tagged: DataFrame, keys: list[str], id_column: str, bucket: int = 64) -> DataFrame:
    """(id, pos): first usable tagged token that overlaps the word's characters.

    words: keys, id, start, stop; tagged: keys, start, stop, pos, is_space, is_punct. Both
    sides are put into character buckets, so a long text is many equi-join keys.
    """
    def bucketed(df, a, b):
        return df.withColumn("__b", F.explode(F.sequence(F.floor(F.col(a) / bucket), F.floor((F.col(b) - 1) / bucket))))

    left = bucketed(words.select(*keys, id_column, F.col("start").alias("ws"), F.col("stop").alias("we")), "ws", "we")
    right = bucketed(tagged.filter(~F.col("is_space")).select(
        *keys, F.col("start").alias("ts"), F.col("stop").alias("te"), "pos", "is_punct"), "ts", "te")
    met = left.join(right, [*keys, "__b"]).filter((F.col("ts") < F.col("we")) & (F.col("te") > F.col("ws")))
    # lexical tokens come first, punctuation only when nothing else overlaps
    return met.groupBy(id_column).agg(F.min_by("pos", F.struct("is_punct", "ts")).alias("pos"))


def label_coordinates(labels: DataFrame) -> DataFrame:
    """Tag arrays of sentences -> one coordinate per cue or scope token.

    labels: audio, sentence, negations array<array<string>> with [CUE] and [SCO] per token.
    A negation without any cue token is an error.
    """
    one = labels.select("audio", "sentence", F.posexplode("negations").alias("negation", "tags"))
    checked = one.withColumn("tags", F.when(F.array_contains("tags", "[CUE]"), F.col("tags")).otherwise(
        F.raise_error(F.concat_ws(" ", F.lit("negation without cue in"), F.col("audio").cast("string"),
                                  F.col("sentence").cast("string"))).cast("array<string>")))
    rows = checked.select("audio", "sentence", "negation", F.posexplode("tags").alias("token", "tag"))
    field = F.when(F.col("tag") == "[CUE]", "cue_tokens").when(F.col("tag") == "[SCO]", "scope_tokens")
    return rows.withColumn("field", field).filter("field is not null").drop("tag")
