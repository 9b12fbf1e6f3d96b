"""Near-duplicate lines by a segment-partition edit join.

Equal lines collapse first. A line of the least length or more is cut into ``edits`` + 1 segments of nearly equal length; two
lines within ``edits`` edits share a segment at a place that the lengths and the segment's number leave only few choices
for. Segments are the index, those few substrings of longer or equal lines the probes, and both meet in a hash bucket.
Buckets with one line are dropped. In a bucket the lines of a block wait while the others stream past, and pairs are
verified by a bit-parallel automaton over the 2 * ``edits`` + 1 diagonals of the band, many pairs at a time. A pair that
meets in several buckets counts in the first only, so each block sends back sums of links and a spanning forest, never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from anchorgrid.llm.common import slices, stash
from anchorgrid.llm.components import connected_components

_LINKED = "a long, b long, n long"


def _segment(length, i, edits: int):
    """(start from 0, length) of segment ``i`` in a line of ``length`` characters; works on columns and on integers."""
    parts = edits + 1
    if isinstance(length, Column):
        k, r = F.floor(length / parts).cast("int"), (length % parts).cast("int")
        return k * i + F.greatest(F.lit(0), i - F.lit(parts) + r), k + (r >= F.lit(parts) - i).cast("int")
    k, r = divmod(length, parts)
    return k * i + max(0, i - parts + r), k + (r >= parts - i)


def _shifts(delta: int, i: int, edits: int) -> range:
    """Places, relative to segment ``i`` of a line ``delta`` shorter, where a probe must look."""
    return range(max(-i, delta - edits + i), min(i, delta + edits - i) + 1)


def within(left: list[str], right: list[str], edits: int) -> np.ndarray:
    """Whether the edit distance of each pair is at most ``edits``: a bit per diagonal and a word per number of edits, for all pairs at once."""
    m, n = (np.array([len(x) for x in side], np.int64) for side in (left, right))
    out = np.zeros(len(left), bool)
    possible = np.flatnonzero(np.abs(m - n) <= edits)
    possible = possible[np.argsort(m[possible], kind="stable")]
    at = 0
    while at < len(possible):
        to = at + 1
        while to < len(possible) and (to - at) * int(m[possible[to]]) < 2_000_000 and to - at < 20_000:
            to += 1
        rows, at = possible[at:to], to
        longest = int(max(m[rows].max(), n[rows].max()))
        a = np.full((len(rows), longest), -1, np.int64)
        b = np.full((len(rows), longest + 2 * edits), -2, np.int64)  # shifted by `edits`
        for i, r in enumerate(rows.tolist()):
            a[i, : m[r]] = np.frombuffer(left[r].encode("utf-32-le", "surrogatepass"), np.uint32)
            b[i, edits : edits + n[r]] = np.frombuffer(right[r].encode("utf-32-le", "surrogatepass"), np.uint32)
        a, b = np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)
        full = (1 << (2 * edits + 1)) - 1
        state = [np.full(len(rows), ((1 << (k + 1)) - 1) << edits, np.int64) & full for k in range(edits + 1)]
        goal = 1 << (n[rows] - m[rows] + edits)
        for i in range(int(m[rows].max()) + 1):
            done = m[rows] == i
            if done.any():
                out[rows[done]] = (state[edits][done] & goal[done]) != 0
            if i == longest:
                break
            match = np.zeros(len(rows), np.int64)
            for d in range(2 * edits + 1):
                match |= (a[i] == b[i + d]).astype(np.int64) << d
            before, new = None, []
            for k in range(edits + 1):
                now = state[k] & match
                if k:
                    now |= before | (before >> 1) | (new[k - 1] << 1)
                before = state[k]
                new.append(now & full)
            state = new
    return out


def _first_meeting(u: str, v: str, edits: int) -> tuple[int, int, bool]:
    """(segment, shift, whether ``u`` is the indexed line) of the first bucket two lines share; ``u`` is the shorter, or the first of two as long."""
    delta = len(v) - len(u)
    for i in range(edits + 1):
        start, size = _segment(len(u), i, edits)
        for shift in _shifts(delta, i, edits):
            at = start + shift
            if at >= 0 and at + size <= len(v) and u[start : start + size] == v[at : at + size]:
                return i, shift, True
            if not delta and shift and at >= 0 and at + size <= len(u) and v[start : start + size] == u[at : at + size]:
                return i, shift, False
    raise ValueError("lines within the distance share a segment")


class _Forest:
    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        while self.up.setdefault(x, x) != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def _joiner(edits: int):
    """Rows sorted by (bucket, cell, waits first): links of each cell as rows (a, b, null) of a forest and (a, null, links)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, waiting = None, []
        for batch in slices(batches, "line", 4_000_000):
            rows = batch.to_pydict()
            left, right = [], []
            for bucket, cell, streams, node, probe, segment, shift, line in zip(*(rows[c] for c in ("bucket", "cell", "streams", "node", "probe", "segment", "shift", "line"))):
                if (bucket, cell) != now:
                    now, waiting = (bucket, cell), []
                if not streams:
                    waiting.append((node, line))
                    continue
                for other, text in waiting:
                    if other != node and (probe or other < node) and 0 <= len(line) - len(text) <= edits:
                        left.append((other, text))
                        right.append((node, line, segment, shift))
            if not left:
                continue
            forest, count, edges = _Forest(), {}, []
            for i in np.flatnonzero(within([x[1] for x in left], [x[1] for x in right], edits)).tolist():
                (a, u), (b, v, segment, shift) = left[i], right[i]
                first = (u, v, True) if len(u) < len(v) or a < b else (v, u, False)
                if _first_meeting(first[0], first[1], edits) != (segment, shift, first[2] if shift or len(u) < len(v) else True):
                    continue
                for x in (a, b):
                    count[x] = count.get(x, 0) + 1
                if forest.join(a, b):
                    edges.append((a, b, None))
            out = edges + [(x, None, n) for x, n in count.items()]
            if out:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out)], names=["a", "b", "n"])

    return run


def distinct_lines(documents: DataFrame) -> DataFrame:
    """(node, line, doc_id, line_no, n_rows): every distinct line freed of outer white space, where it stands first and how often."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "line"))
    rows = rows.withColumn("line", F.btrim("line", F.lit(" \t\r\x0b\x0c"))).where("line <> ''")
    lines = rows.groupBy("line").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "line_no")).alias("first"), F.count("*").alias("n_rows"))
    return lines.select(F.xxhash64("line").alias("node"), "line", "first.doc_id", "first.line_no", "n_rows")


def edit_links(lines: DataFrame, edits: int, min_chars: int, block: int = 256) -> DataFrame:
    """Rows (a, b, null) that connect near lines and (a, null, links) to be summed, from (node, line)."""
    long = lines.where(F.length("line") >= min_chars).select("node", "line")
    # lines as long meet with their own segments, so a probe without shift is made for shorter ones only
    entries = [(False, i, 0, 0) for i in range(edits + 1)]
    entries += [(True, i, d, s) for i in range(edits + 1) for d in range(edits + 1) for s in _shifts(d, i, edits) if d or s]
    tuples = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("probe", "segment", "delta", "shift"), e)]) for e in entries])
    spread = long.withColumn("e", F.explode(tuples)).select("node", "line", "e.*").withColumn("length", F.length("line"))
    start, size = _segment(F.col("length") - F.col("delta"), F.col("segment"), edits)
    spread = spread.withColumn("start", start + F.col("shift")).withColumn("size", size)
    spread = spread.where((F.col("length") - F.col("delta") >= min_chars) & (F.col("start") >= 0) & (F.col("start") + F.col("size") <= F.col("length")))
    bucket = F.xxhash64(F.col("length") - F.col("delta"), "segment", F.substr("line", F.col("start") + 1, F.col("size")))
    spread = spread.select(bucket.alias("bucket"), "node", "probe", "segment", "shift")
    # one exchange serves both the count and the join
    spread = spread.repartition("bucket")
    shared = spread.groupBy("bucket").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.min("probe").alias("probe"), F.sum((~F.col("probe")).cast("long")).alias("n"))
    shared = shared.where("lo < hi AND NOT probe").select("bucket", "n")
    met = stash(spread.join(shared, "bucket"), "met")
    texts = long.join(met.select("node").distinct(), "node", "left_semi")
    met = met.join(texts, "node").withColumn("cells", F.ceil(F.col("n") / block).cast("int"))
    waits = met.where(~F.col("probe")).withColumn("cell", F.pmod(F.xxhash64("node"), F.col("cells")).cast("int")).withColumn("streams", F.lit(False))
    streams = met.withColumn("cell", F.explode(F.sequence(F.lit(0), F.col("cells") - 1))).withColumn("streams", F.lit(True))
    both = waits.unionByName(streams).select("bucket", "cell", "streams", "node", "probe", "segment", "shift", "line")
    return both.repartition("bucket", "cell").sortWithinPartitions("bucket", "cell", "streams").mapInArrow(_joiner(edits), _LINKED)


def line_classes(documents: DataFrame, edits: int = 2, min_chars: int = 24, block: int = 256) -> DataFrame:
    """One row per distinct line: doc_id, line_no (where it stands first), n_rows, n_links, class_doc_id, class_line_no, kept.

    Lines lose outer ASCII white space; empty lines are no lines, so null and empty texts give none. ``n_links`` counts the different lines
    within ``edits`` edits; lines shorter than ``min_chars`` have none and are only matched when equal. A class is what links
    connect, named after its first line by (doc_id, line_no); null doc_ids come last. ``kept`` marks that line. Rows alike give equal lines and
    add to n_rows. A line's node is its 64-bit hash: 10 billion different lines hold about three that share one by chance.
    """
    lines = stash(distinct_lines(documents), "lines")
    linked = stash(edit_links(lines, edits, min_chars, block), "links")
    counts = linked.where("n IS NOT NULL").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n_links"))
    where = stash(connected_components(linked.where("b IS NOT NULL").select("a", "b")), "components")
    places = lines.select("node", "doc_id", "line_no", "n_rows")
    member = places.join(where, "node")
    firsts = member.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "line_no")).alias("first"))
    named = stash(where.join(firsts, "component").join(counts, "node").select("node", "n_links", F.col("first.doc_id").alias("class_doc"), F.col("first.line_no").alias("class_line")), "classes")
    out = places.join(named, "node", "left")
    alone = F.col("n_links").isNull()
    out = out.withColumn("class_doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("class_doc"))).withColumn("class_line_no", F.when(alone, F.col("line_no")).otherwise(F.col("class_line")))
    kept = F.col("doc_id").eqNullSafe(F.col("class_doc_id")) & (F.col("line_no") == F.col("class_line_no"))
    return out.select("doc_id", "line_no", "n_rows", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), "class_doc_id", "class_line_no", kept.alias("kept"))


def _keep_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        texts = []
        for text, kept in zip(batch.column("text").to_pylist(), batch.column("kept").to_pylist()):
            kept = set(kept or ())
            texts.append(None if text is None else "\n".join(x for i, x in enumerate(text.split("\n")) if i in kept or not x.strip(" \t\r\x0b\x0c")))
        yield pa.record_batch([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])


def drop_repeated_lines(documents: DataFrame, **parameters) -> DataFrame:
    """(doc_id, text) with only the first line of every class left; empty lines and null texts stay as they are."""
    kept = line_classes(documents, **parameters).where("kept").groupBy("doc_id").agg(F.collect_list("line_no").alias("kept"))  # bounded by the document
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(kept, "doc_id", "left")
    return docs.mapInArrow(_keep_lines, "doc_id long, text string")
