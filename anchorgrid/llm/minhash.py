"""Near-duplicate documents by b-bit MinHash, links confirmed on full sets.

Documents with equal shingle sets collapse to the smallest doc_id first. Each remaining set gets ``hashes`` minima; groups
of minima (bands) name the buckets, and the low bits of the minima are packed into bit planes. The share of
positions where all planes agree, counted with xor and bit counts and corrected for chance agreement, estimates the
similarity of two members of a bucket; only pairs near or above the threshold are confirmed on their full sets.

Groups of any size: first every member of a bucket meets one centre, twice with different centres, which links most of a group with one
pair per member. Then only buckets that still hold several components are searched whole, in blocks, for pairs of different
components, with longer one-bit signatures made for the members left. Pairs inside one component can add nothing and are
never made. At a similarity of 0.8, 5 pairs in 100 million share no band of 32 with 4 minima, and the
margins of the estimates (0.2 for 128 positions of 4 bits, 0.06 for 2048 of 1 bit) miss 3 in a million.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from anchorgrid.llm.common import coded, hash64, mix, slices, stash, windows_hash, words_of
from anchorgrid.llm.components import connected_components

_SIGNED = "doc_id long, n_shingles long, set1 long, set2 long, bands array<long>, planes array<long>"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, hashes): the sorted distinct shingle hashes of every text; fewer words than ``width`` make one shingle."""
    offsets, words = words_of(texts)
    code, distinct = coded(words)
    h = hash64(pc.ascii_lower(distinct))[code]
    n = np.diff(offsets)
    run = windows_hash(h, width)
    doc = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(run))
    fits = at + width <= offsets[doc[at] + 1] if len(at) else np.zeros(0, bool)
    owner, value = doc[at][fits], run[fits]
    for i in np.flatnonzero((n > 0) & (n < width)).tolist():
        owner = np.append(owner, i)
        value = np.append(value, windows_hash(h[offsets[i] : offsets[i + 1]], int(n[i])) ^ np.uint64(n[i]))
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
    owner, value = owner[new], value[new]
    return np.searchsorted(owner, np.arange(len(n) + 1)), value


def _signer(width: int, bands: int, rows: int, bits: int):
    hashes = bands * rows
    rng = np.random.default_rng(20)
    a = rng.integers(0, 1 << 63, hashes, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 1 << 63, hashes, dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            offsets, value = shingle_sets(batch.column("text"), width)
            n = np.diff(offsets)
            full = np.flatnonzero(n)
            if not len(full):
                continue
            starts = offsets[:-1][full]
            minima = np.stack([np.minimum.reduceat(value * x + y, starts) for x, y in zip(a, b)], axis=1)
            minima = mix(minima)
            key = np.zeros((len(full), bands), np.uint64)
            for j in range(rows):
                key = mix(key * np.uint64(0x9E3779B97F4A7C15) + minima[:, j::rows])
            key ^= np.arange(bands, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)
            planes = [np.packbits(((minima >> np.uint64(p)) & np.uint64(1)).astype(np.uint8), axis=1).view(np.int64) for p in range(bits)]
            planes = np.hstack(planes)
            lists = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel().view(np.int64)))
            sums = [np.add.reduceat(mix(value ^ np.uint64(s)), starts).view(np.int64) for s in (1, 2)]
            yield pa.record_batch(
                [batch.column("doc_id").take(pa.array(full)), pa.array(n[full], pa.int64()), pa.array(sums[0]), pa.array(sums[1]), lists(np.ascontiguousarray(key)), lists(np.ascontiguousarray(planes))],
                names=["doc_id", "n_shingles", "set1", "set2", "bands", "planes"],
            )

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            offsets, value = shingle_sets(batch.column("text"), width)
            yield pa.record_batch([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(value.view(np.int64)))], names=["node", "shingles"])

    return run


def _longer(hashes: int, most: int = 100_000):
    """One-bit signatures of ``hashes`` positions from (node, shingles)."""
    rng = np.random.default_rng(21)
    a = rng.integers(0, 1 << 63, hashes, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 1 << 63, hashes, dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("shingles")
            ends = lists.offsets.to_numpy().astype(np.int64)
            value = lists.values.to_numpy().view(np.uint64)
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, "right")) - 1)
                part, starts = value[ends[at] : ends[to]], ends[at:to] - ends[at]
                bits = np.stack([(mix(np.minimum.reduceat(part * x + y, starts)) & np.uint64(1)).astype(np.uint8) for x, y in zip(a, b)], axis=1)
                packed = np.packbits(bits, axis=1).view(np.int64)
                yield pa.record_batch(
                    [batch.column("node").slice(at, to - at), pa.ListArray.from_arrays(pa.array(np.arange(0, packed.size + 1, packed.shape[1]), pa.int32()), pa.array(packed.ravel()))],
                    names=["node", "longer"],
                )
                at = to

    return run


def estimate(x: Column, y: Column, hashes: int, bits: int) -> Column:
    """Similarity estimated from packed planes, corrected for the 2 ** -bits chance that low bits agree anyway."""
    words = hashes // 64
    agree = F.lit(0)
    for w in range(words):
        differ = F.lit(0).cast("long")
        for p in range(bits):
            differ = differ.bitwiseOR(x[p * words + w].bitwiseXOR(y[p * words + w]))
        agree = agree + F.lit(64) - F.bit_count(differ)
    chance = 2.0**-bits
    return (agree / F.lit(float(hashes)) - F.lit(chance)) / F.lit(1 - chance)


def _search(hashes: int, bits: int, least: float, longer: int, longer_least: float, most: int = 20_000):
    """Pairs of different components of one cell whose two estimates reach the bounds, in their first common bucket only."""

    def similarity(x: np.ndarray, y: np.ndarray, planes: int) -> np.ndarray:
        words = x.shape[1] // planes
        differ = np.bitwise_or.reduce((x ^ y).reshape(len(x), planes, words), axis=1)
        chance = 2.0**-planes
        return ((64 * words - np.bitwise_count(differ).sum(axis=1, dtype=np.int64)) / (64.0 * words) - chance) / (1 - chance)

    def run(x: pa.Table, y: pa.Table) -> pa.Table:
        found = [np.zeros((2, 0), np.int64)]
        if x.num_rows and y.num_rows:
            y = y.rename_columns([c.removesuffix("_b") for c in y.column_names])
            (a, ca), (b, cb) = ([t.column(c).to_numpy() for c in ("node", "component")] for t in (x, y))
            rows = lambda t, c: t.column(c).combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1).view(np.uint64)
            (pa_, la, ba), (pb, lb, bb) = ([rows(t, c) for c in ("planes", "longer", "bands")] for t in (x, y))
            bucket = np.int64(x.column("bucket")[0].as_py()).view(np.uint64)
            many = max(1, most // len(b))
            for top in range(0, len(a), many):
                i, j = np.nonzero((a[top : top + many, None] < b) & (ca[top : top + many, None] != cb))
                i += top
                keep = similarity(pa_[i], pb[j], bits) >= least
                i, j = i[keep], j[keep]
                keep = similarity(la[i], lb[j], 1) >= longer_least
                i, j = i[keep], j[keep]
                same = ba[i] == bb[j]
                keep = ba[i, same.argmax(axis=1)] == bucket
                found.append(np.stack([a[i[keep]], b[j[keep]]]))
        out = np.hstack(found)
        return pa.table({"a": out[0], "b": out[1]})

    return run


def near_duplicates(documents: DataFrame, width: int = 4, percent: int = 80, bands: int = 32, rows: int = 4, bits: int = 4, margin: float = 0.2, longer: int = 2048, longer_margin: float = 0.06, block: int = 512) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, kept.

    Words are lower-cased in A-Z. Two documents are linked where 100 * |common shingles| >= ``percent`` * |all shingles|, and
    component_id is the smallest doc_id reachable over links. Null, empty and blank texts have no shingles and stand alone.
    A null doc_id stands alone with a null component and is kept. Rows that repeat a doc_id are one node with the links of all of them.
    ``kept`` marks the document its component is named after. Other columns are not read.
    """
    hashes = bands * rows
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = docs.where("doc_id IS NOT NULL AND text IS NOT NULL")
    signed = stash(known.mapInArrow(_signer(width, bands, rows, bits), _SIGNED), "signatures")
    equal = ["set1", "set2", "n_shingles"]
    classes = stash(signed.groupBy(*equal).agg(F.min("doc_id").alias("node")), "classes")
    nodes = signed.join(classes.select(F.col("node").alias("doc_id")), "doc_id", "left_semi").select(F.col("doc_id").alias("node"), "bands", "planes")
    spread = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = spread.groupBy("bucket").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select("bucket")
    members = stash(spread.join(shared, "bucket").distinct(), "members")
    active = members.select("node").distinct()
    planes = stash(nodes.join(active, "node", "left_semi").select("node", "planes", "bands"), "planes")
    wanted = known.join(active.withColumnRenamed("node", "doc_id"), "doc_id", "left_semi")
    sets = stash(wanted.mapInArrow(_sets(width), "node long, shingles array<long>"), "sets")
    least = percent / 100 - margin

    def likely(pairs: DataFrame) -> DataFrame:
        x, y = planes.select(F.col("node").alias("a"), F.col("planes").alias("pa")), planes.select(F.col("node").alias("b"), F.col("planes").alias("pb"))
        pairs = pairs.join(x, "a").join(y, "b").withColumn("like", estimate(F.col("pa"), F.col("pb"), hashes, bits))
        return pairs.where(F.col("like") >= least).select("a", "b", "like")

    def confirmed(pairs: DataFrame) -> DataFrame:
        x, y = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
        both = pairs.select("a", "b").join(x, "a").join(y, "b").withColumn("common", F.size(F.array_intersect("sa", "sb")).cast("long"))
        return both.where(F.col("common") * 100 >= percent * (F.size("sa") + F.size("sb") - F.col("common"))).select("a", "b")

    def placed(links: DataFrame) -> DataFrame:
        """Members of the buckets that hold more than one component."""
        where = connected_components(links)
        of = members.join(where, "node", "left").withColumn("component", F.coalesce("component", "node"))
        of = stash(of, "placed")
        mixed = of.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n")).where("lo < hi").select("bucket", "n")
        return of.join(mixed, "bucket")

    found = None
    for turn in range(2):
        centre = members.groupBy("bucket").agg(F.min_by("node", F.xxhash64(F.lit(turn), "node") if turn else F.col("node")).alias("a"))
        star = members.join(centre, "bucket").where("node <> a").select("a", F.col("node").alias("b")).distinct()
        best = likely(star).groupBy("b").agg(F.max_by("a", F.struct("like", -F.col("a"))).alias("a"))  # one pair per member
        links = stash(confirmed(best), "links")
        found = links if found is None else found.unionByName(links)
    open_members = stash(placed(found), "open")
    finer = sets.join(open_members.select("node").distinct(), "node", "left_semi").mapInArrow(_longer(longer), "node long, longer array<long>")
    left = open_members.withColumn("blocks", F.ceil(F.col("n") / block).cast("int")).join(planes, "node").join(stash(finer, "longer"), "node")
    # every pair of blocks of a bucket is a cell of at most about ``block`` rows a side, so no cell needs to be split again
    mine, others = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    own = ("node", "component", "planes", "longer", "bands")
    x = left.select("bucket", mine.alias("row"), others.alias("col"), *own).groupBy("bucket", "row", "col")
    y = left.select(F.col("bucket").alias("bucket_b"), others.alias("row_b"), mine.alias("col_b"), *(F.col(c).alias(f"{c}_b") for c in own)).groupBy("bucket_b", "row_b", "col_b")
    rest = x.cogroup(y).applyInArrow(_search(hashes, bits, least, longer, percent / 100 - longer_margin), "a long, b long")
    links = stash(found.unionByName(confirmed(rest)), "links")
    where = stash(connected_components(links), "components")

    named = signed.select("doc_id", *equal).join(classes, equal).select("doc_id", "n_shingles", "set1", "node")
    named = named.join(where, "node", "left").select("doc_id", "n_shingles", F.coalesce("component", "node").alias("component_id"))
    # rows repeating a doc_id with other texts: all in the component of the smallest
    named = named.groupBy("doc_id").agg(F.max("n_shingles").alias("n_shingles"), F.min("component_id").alias("component_id"))
    out = docs.select("doc_id").join(named, "doc_id", "left")
    return out.select(
        "doc_id", F.coalesce("n_shingles", F.lit(0).cast("long")).alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"),
        F.coalesce(F.col("doc_id") == F.coalesce("component_id", "doc_id"), F.lit(True)).alias("kept"),
    )


def drop_near_duplicates(documents: DataFrame, **parameters) -> DataFrame:
    """``documents`` with one document of each component; see :func:`near_duplicates`."""
    gone = stash(near_duplicates(documents, **parameters).where("NOT kept").select(F.col("doc_id").alias("gone_id")).distinct(), "gone")
    return documents.join(gone, documents["doc_id"] == gone["gone_id"], "left_anti")
