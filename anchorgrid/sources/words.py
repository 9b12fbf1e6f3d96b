"""Word scans and negation links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

TARGET_FIELDS = {"cue": ("cue_tokens",), "scope": ("scope_tokens",),
                 "cueandscope": ("cue_tokens", "scope_tokens")}


def negation_links(negations: DataFrame) -> DataFrame:
    """(negation_id, field, word_id): one row per reference of a negation record."""
    fields = [
        negations.select("negation_id", F.lit(f).alias("field"), F.explode(f).alias("word_id"))
        for f in ("cue_tokens", "scope_tokens")
    ]
    return fields[0].unionByName(fields[1])


def scan_words(words: DataFrame, links: DataFrame, target: str) -> DataFrame:
    """Words referenced by at least one negation through the fields of ``target``.

    The test is per field: looking only at the first negation of a word would lose words.
    """
    wanted = links.filter(F.col("field").isin(*TARGET_FIELDS[target])).select("word_id")
    return words.join(wanted, "word_id", "left_semi")


def scan_non_negation(words: DataFrame, links: DataFrame) -> DataFrame:
    return words.join(links.select("word_id"), "word_id", "left_anti")


def scan_turn_words(words: DataFrame) -> DataFrame:
    return words.select("word_id", "experiment", "player", "text", "time_ms")


def modality_scan(tables: dict[str, DataFrame], start: Column | None = None, stop: Column | None = None) -> DataFrame:
    """Union of modality tables tagged with their name, limited to ``[start, stop)`` ms."""
    parts = []
    for name, table in tables.items():
        if start is not None:
            table = table.filter((F.col("time_ms") >= start) & (F.col("time_ms") < stop))
        parts.append(table.withColumn("event_type", F.lit(name)))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def read_transcripts(tokens: DataFrame) -> DataFrame:
    """One row per audio: parallel arrays of tokens and word ids in time order.

    An audio is one recording, the unit the sentence step works on; rows are combined on
    the map side before they are shuffled.
    """
    pairs = F.array_sort(F.collect_list(F.struct("time_ms", "word_id", "text")))
    return tokens.groupBy("audio").agg(pairs.alias("p")).select(
        "audio", F.col("p.text").alias("tokens"), F.col("p.word_id").alias("word_ids")
    )


def coordinates_to_links(coordinates: DataFrame, tokens: DataFrame) -> DataFrame:
    """Replace (sentence, token) coordinates by word ids; a coordinate without word fails.

    coordinates: negation_id, field, audio, sentence, token; tokens: audio, sentence, token,
    word_id.
    """
    key = ["audio", "sentence", "token"]
    joined = coordinates.join(tokens.select(*key, "word_id"), key, "left")
    missing = F.raise_error(F.concat_ws(
        " ", F.lit("no word at coordinate"), *[F.col(k).cast("string") for k in key]
    )).cast(dict(tokens.dtypes)["word_id"])
    return joined.withColumn("word_id", F.coalesce("word_id", missing))


def negation_records(links: DataFrame) -> DataFrame:
    """Back to one row per negation with its two token arrays."""
    pick = lambda f: F.array_sort(F.collect_set(F.when(F.col("field") == f, F.col("word_id"))))
    return links.groupBy("negation_id").agg(
        pick("cue_tokens").alias("cue_tokens"), pick("scope_tokens").alias("scope_tokens")
    )


def write_negations(links: DataFrame, path: str) -> None:
    """Replace the whole negation table; every check has run before the old rows go."""
    negation_records(links).write.mode("overwrite").parquet(path)
