"""Sharding by sampled splitters: near-equal bytes per shard.

The sort key of a row is (hash of its text, hash of its doc_id), so equal texts lie next to each other and a text
that fills several shards can still be cut. A sample in which a row's chance grows with its size gives the
splitters of many more ranges than shards. Exact sizes of the ranges are summed; a range found overfull is subdivided by
the hash of the doc_id. Only rows of one range are ever ordered together: range sums tell where each
starts, and a running sum inside gives every row its place, from which shard and slot follow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from anchorgrid.llm.common import stash

#: Leading bits of the key that name a cell; a row is compared only with the splitters of its cell.
CELL_BITS = 12
ADDED = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]


def size_weighted_splitters(keyed: DataFrame, ranges: int, per_range: int) -> list[tuple[int, int]]:
    """At most ``ranges`` - 1 keys (k1, k2) at quantiles of a sample of about ``ranges * per_range`` rows weighted by size."""
    total = keyed.agg(F.sum("size").alias("total")).first().total
    if not total:
        return []
    chance = F.col("size") * F.lit(ranges * per_range / total)  # rows above the step stand for themselves
    roll = (F.xxhash64(F.lit("splitter"), "k1", "k2").bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53)))
    sample = keyed.where(roll < chance).select("k1", "k2", F.greatest(F.lit(1.0), chance).alias("weight"))
    # the sample's size is set by the two parameters, whatever the input
    rows = sorted((r.k1, r.k2, r.weight) for r in sample.collect())
    step = sum(r[2] for r in rows) / ranges if rows else 1.0
    filled, quantile, out = 0.0, 1, set()
    for k1, k2, weight in rows:
        filled += weight
        if quantile < ranges and filled >= step * quantile:
            out.add((k1, k2))
            quantile = int(filled / step) + 1  # a row wider than a range passes several quantiles
    return sorted(out)


def place(rows: DataFrame, shards: int = 24, ranges_per_shard: int = 32, per_range: int = 16, overfull: float = 4.0) -> DataFrame:
    """Adds shard (0 to ``shards`` - 1) and slot (gapless from 0 in its shard) to rows with doc_id, text_key, size.

    A shard holds its share of the bytes to within one row at either end. ``text_key`` is any long that equal texts share.
    """
    ranges = shards * ranges_per_shard
    keyed = rows.withColumn("k1", F.xxhash64("text_key")).withColumn("k2", F.xxhash64("doc_id", "text_key"))
    splitters = size_weighted_splitters(keyed, ranges, per_range)
    spark = rows.sparkSession
    # cell -> (splitters below the cell, splitters inside it): at most 2 ** CELL_BITS rows
    cell_of = lambda k1: k1 >> (64 - CELL_BITS)
    cells: dict[int, list[tuple[int, int]]] = {c: [] for c in range(-(1 << CELL_BITS - 1), 1 << CELL_BITS - 1)}
    for k in splitters:
        cells[cell_of(k[0])].append(k)
    table, below = [], 0
    for c in sorted(cells):
        table.append((c, below, [k[0] for k in cells[c]], [k[1] for k in cells[c]]))
        below += len(cells[c])
    lookup = spark.createDataFrame(table, "cell int, below int, s1 array<long>, s2 array<long>")
    pairs = F.arrays_zip("s1", "s2")
    passed = F.size(F.filter(pairs, lambda s: (s["s1"] < F.col("k1")) | ((s["s1"] == F.col("k1")) & (s["s2"] <= F.col("k2")))))
    ranged = keyed.withColumn("cell", F.shiftright("k1", 64 - CELL_BITS).cast("int")).join(F.broadcast(lookup), "cell")
    ranged = ranged.withColumn("range", F.col("below") + F.when(F.size("s1") == 0, F.lit(0)).otherwise(passed)).drop("cell", "below", "s1", "s2")
    sums = ranged.groupBy("range").agg(F.sum("size").alias("bytes"))  # at most `ranges` rows
    mean = sums.agg((F.sum("bytes") / F.lit(float(ranges))).alias("mean"))
    parts = sums.crossJoin(F.broadcast(mean)).select("range", F.greatest(F.lit(1), F.ceil(F.col("bytes") / F.col("mean") / F.lit(overfull))).cast("int").alias("parts"))
    ranged = ranged.join(F.broadcast(parts), "range").withColumn("part", F.pmod(F.xxhash64("k2", "size"), F.col("parts")).cast("int")).drop("parts")
    starts = ranged.groupBy("range", "part").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    before = Window.orderBy("range", "part").rowsBetween(Window.unboundedPreceding, -1)  # over a few thousand range sums
    starts = starts.select(
        "range", "part",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("range_bytes"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("range_rows"),
        F.sum("bytes").over(Window.partitionBy()).alias("all_bytes"),
    )
    inside = Window.partitionBy("range", "part").orderBy("k1", "k2", "doc_id", "size")
    placed = ranged.join(F.broadcast(starts), ["range", "part"]).withColumn("rank", F.col("range_rows") + F.row_number().over(inside) - 1)
    ahead = F.col("range_bytes") + F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # the shard in which the middle of the row lies
    shard = F.least(F.lit(shards - 1), F.floor((2 * ahead + F.col("size")) * F.lit(float(shards)) / (2 * F.col("all_bytes"))))
    placed = placed.withColumn("shard", F.coalesce(shard, F.lit(0)).cast("int")).drop("k1", "k2", "range", "part", "range_bytes", "range_rows", "all_bytes")
    firsts = stash(placed.groupBy("shard").agg(F.min("rank").alias("first")), "firsts")  # one row per shard
    return placed.join(F.broadcast(firsts), "shard").withColumn("slot", F.col("rank") - F.col("first")).drop("rank", "first")


def sized(documents: DataFrame) -> DataFrame:
    """``documents`` with size (UTF-8 bytes of the text plus 8), text_crc32 and text_key."""
    text = F.coalesce("text", F.lit(""))
    rows = documents.withColumn("size", F.octet_length(text).cast("long") + 8)
    return rows.withColumn("text_crc32", F.crc32(text.cast("binary"))).withColumn("text_key", F.xxhash64(text))


def shard_table(documents: DataFrame, shards: int = 24, **parameters) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document, without moving texts."""
    rows = stash(sized(documents).select("doc_id", "size", "text_crc32", "text_key"), "sizes")
    return _told(place(rows, shards, **parameters)).select("doc_id", *ADDED)


def _told(placed: DataFrame) -> DataFrame:
    return placed.withColumn("law", F.lit("bytes")).withColumn("slot", F.col("slot").cast("long")).withColumn("grown_shard", F.lit(None).cast("int"))


def shard_documents(documents: DataFrame, shards: int = 24, **parameters) -> DataFrame:
    """Columns of ``documents`` plus size, text_crc32, law ('bytes'), shard, slot, grown_shard (null).

    Size is the UTF-8 bytes of the text (null: none) plus 8. Equal texts lie next to each other. Null doc_ids and repeated
    rows are placed like all others; an empty table gives no rows. Columns named like the added ones are replaced.
    """
    rows = documents.drop(*ADDED, "text_key", "k1", "k2", "range", "part", "rank", "cell")
    placed = place(sized(rows), shards, **parameters).drop("text_key")
    return _told(placed).select([c for c in documents.columns if c not in ADDED] + ADDED)
