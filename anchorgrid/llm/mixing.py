"""Mixing sources to target weights by capped water-filling, in DataFrame functions only.

Targets share all words by weight. A source stops at ``max_epochs`` times its own size and what it cannot take is
shared out again by weight. With sources in the order of cap / weight the level of the water has a closed form over
running sums, so no loop is needed.

A source's target is met in whole repetitions of all its documents and one more pass over documents in a seeded
order, until the rest is used up; the document in which it runs out is taken in part. Documents fall
into slots of that order by the first digits of their hash, slot sums show in which slot the rest ends, and only
that slot's documents are ordered one by one. No source is ever sorted whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from anchorgrid.llm.common import n_words, stash

#: Hex digits of the hash that name a slot: 4096 slots per source.
SLOT_DIGITS = 3


def source_targets(sizes: DataFrame, max_epochs: int = 3, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """(source, source_size, target) from rows (source, size). Sources stand by code point, null last, and weigh ``weights`` in turn."""
    cap = F.lit(max_epochs) * F.col("source_size")
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    nth = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    weighed = sources.withColumn("weight", F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (nth + 1).cast("int")))
    # one window over one row per source: the order in which rising water reaches the caps
    order = Window.orderBy((cap / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum(cap).over(before), F.lit(0))).cast("double") / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    )
    filled = weighed.withColumn("level", level).withColumn("full", F.col("level") * F.col("weight") >= cap)
    # the first source the water does not fill fixes the level of all that follow
    final = F.first(F.when(~F.col("full"), F.col("level")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    filled = filled.withColumn("final", final)
    return filled.select("source", "source_size", F.when(F.col("final").isNull(), cap.cast("double")).otherwise(F.col("final") * F.col("weight")).alias("target"))


def mix(documents: DataFrame, max_epochs: int = 3, weights: tuple[int, ...] = (1, 2, 3), seed: str = "mix") -> DataFrame:
    """Per row of ``documents``: doc_id, source, row_key, size, source_size, target, taken.

    ``size`` is the number of words (null text: 0), ``taken`` the words the mix takes with repeats counted, at most
    ``max_epochs`` times the size. A source's taken words add up to its rounded target. ``row_key`` is the md5 that orders rows;
    rows alike in doc_id and text are interchangeable. A null source is a source, a null doc_id a value like any other. Empty tables give no rows.
    """
    key = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    docs = stash(documents.select("doc_id", "source", key.alias("row_key"), n_words("text").alias("size"), F.crc32(F.coalesce("text", F.lit(""))).alias("text_key")), "sizes")
    docs = docs.withColumn("slot", F.substring("row_key", 1, SLOT_DIGITS))
    targets = stash(source_targets(docs.groupBy("source", "slot").agg(F.sum("size").alias("size")), max_epochs, weights), "targets")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    targets = targets.withColumn("whole", whole).withColumn("rest", F.greatest(F.lit(0), F.round("target").cast("long") - F.col("whole") * F.col("source_size")))
    slots = docs.groupBy("source", "slot").agg(F.sum("size").alias("slot_size"))
    slots = slots.withColumn("slot_before", F.sum("slot_size").over(Window.partitionBy("source").orderBy("slot")) - F.col("slot_size"))
    ends = slots.join(targets, slots.source.eqNullSafe(targets.source)).where("slot_before <= rest AND rest < slot_before + slot_size")
    ends = ends.select(slots.source.alias("end_source"), F.col("slot").alias("end_slot"))
    targets = targets.join(ends, targets.source.eqNullSafe(F.col("end_source")), "left").drop("end_source").withColumnRenamed("source", "of")
    # the rows of a source meet its target slot by slot, so a large source is spread
    per_slot = slots.withColumnRenamed("source", "of_source").join(targets, F.col("of_source").eqNullSafe(F.col("of"))).drop("of", "slot_size").withColumnRenamed("slot", "of_slot")
    placed = docs.join(per_slot, (F.col("slot") == F.col("of_slot")) & F.col("source").eqNullSafe(F.col("of_source")))
    last = F.col("slot") == F.col("end_slot")
    within = Window.partitionBy("source", "slot").orderBy("row_key", "size", "text_key").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("slot_before") + F.coalesce(F.sum("size").over(within), F.lit(0))
    part = F.least("size", F.greatest(F.lit(0).cast("long"), F.col("rest") - before))
    ended = placed.where(last).withColumn("extra", part)
    # without an ending slot the rest covers all documents or none
    other = placed.where(F.coalesce(~last, F.lit(True))).withColumn(
        "extra", F.when(F.coalesce(F.col("slot") < F.col("end_slot"), F.col("rest") > 0), F.col("size")).otherwise(F.lit(0).cast("long"))
    )
    taken: Column = F.col("whole") * F.col("size") + F.col("extra")
    return other.unionByName(ended).select("doc_id", "source", "row_key", "text_key", "size", "source_size", "target", taken.alias("taken"))


def repeat_documents(documents: DataFrame, **parameters) -> DataFrame:
    """The mix as documents: each row as often as the mix takes it, a part of a document rounded to none or all of it.

    Columns are those of ``documents``. A document without words is kept once: it takes no share of the words.
    """
    times = mix(documents, **parameters)
    times = times.withColumn("times", F.when(F.col("size") == 0, F.lit(1)).otherwise(F.round(F.col("taken") / F.col("size"))).cast("int"))
    times = times.groupBy(F.col("doc_id").alias("mix_id"), F.col("text_key").alias("mix_text")).agg(F.sum("times").alias("times_sum"), F.count("*").alias("rows_alike"))
    names = documents.columns
    docs = documents.select([F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    at = {c: f"c{i}" for i, c in enumerate(names)}
    docs = docs.withColumn("mix_key", F.crc32(F.coalesce(F.col(at["text"]), F.lit(""))))
    out = docs.join(times, F.col(at["doc_id"]).eqNullSafe(F.col("mix_id")) & (F.col("mix_key") == F.col("mix_text")))
    # rows alike share what was taken of them
    out = out.withColumn("nth_alike", F.row_number().over(Window.partitionBy("mix_id", "mix_text").orderBy("mix_key")))
    count = (F.floor(F.col("times_sum") / F.col("rows_alike")) + (F.col("nth_alike") <= F.col("times_sum") % F.col("rows_alike")).cast("int")).cast("int")
    out = out.where(count > 0).withColumn("nth", F.explode(F.sequence(F.lit(1), count)))
    return out.select([F.col(f"c{i}").alias(c) for i, c in enumerate(names)])
