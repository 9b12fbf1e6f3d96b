"""Substring dedup by super-k-mers.

A window is ``width`` consecutive words of one document. Its minimiser is the word pair in it with the
least hash. Neighbouring windows with the same minimiser travel as one packed string to the bucket of that
minimiser, so equal windows always meet. In the bucket the windows are sorted and equal ones compared
word by word; each gets the smallest doc_id that holds it. A window of a larger doc_id is a repeat, and all
words it covers are removed.

Hot minimisers: pairs that make up more than a fixed share of a sample come last in the order, so only windows made
of hot pairs alone have one. A census over all documents, pre-aggregated in the tasks, gives each of those windows its count and
smallest doc_id; the few with more than a fixed share of the census are looked up where they stand and never
travel, the others travel one by one by their own hash. A bucket much larger than its share skips the sorting and its windows are
grouped by their whole text. All ways give the same answer, the sample only decides which is taken.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from anchorgrid.llm.common import coded, hash64, joined, mix, slices, stash, words_of

_HOT = np.uint64(1 << 63)
_PARTS = "bucket long, packed binary, doc_id long, at int, stop int"
_RANGES = "doc_id long, at int, stop int, words string"


def _pairs(words: pa.Array) -> np.ndarray:
    """63-bit hash of each word with its successor."""
    codes, distinct = coded(words)
    h = hash64(distinct)[codes]
    return mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]) >> np.uint64(1) if len(h) > 1 else h[:0]


def _pack(doc: np.ndarray, at: np.ndarray, texts: list[bytes]) -> bytes:
    """Super-k-mers as one compressed string: count, doc_ids, places, lengths, texts."""
    size = np.fromiter(map(len, texts), np.int32, len(texts))
    raw = b"".join([np.int64(len(texts)).tobytes(), doc.astype(np.int64).tobytes(), at.astype(np.int32).tobytes(), size.tobytes(), *texts])
    return np.int64(len(raw)).tobytes() + pa.compress(raw, "zstd", asbytes=True)


def _unpack(packed: list[bytes]) -> pa.Table:
    docs, places, texts = [], [], []
    for blob in packed:
        raw = pa.decompress(blob[8:], int(np.frombuffer(blob, np.int64, 1)[0]), "zstd", asbytes=True)
        n = int(np.frombuffer(raw, np.int64, 1)[0])
        docs.append(np.frombuffer(raw, np.int64, n, 8))
        places.append(np.frombuffer(raw, np.int32, n, 8 + 8 * n))
        ends = 8 + 16 * n + np.concatenate([[0], np.cumsum(np.frombuffer(raw, np.int32, n, 8 + 12 * n), dtype=np.int64)])
        texts.append(pa.Array.from_buffers(pa.large_string(), n, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(raw)]))
    return pa.table({"doc_id": np.concatenate(docs), "at": np.concatenate(places), "packed": pa.chunked_array(texts)})


def _keys(words: pa.Array, width: int, hot: np.ndarray) -> np.ndarray:
    """Minimiser of every run of ``width`` words, with the top bit where all its pairs are hot."""
    pair = _pairs(words)
    if len(hot):
        pair = np.where(hot[np.minimum(np.searchsorted(hot, pair), len(hot) - 1)] == pair, pair | _HOT, pair)
    least, span = pair, 1  # least pair of `span` neighbours, doubled up to width - 1
    while span * 2 <= width - 1:
        least, span = np.minimum(least[:-span], least[span:]), span * 2
    rest = width - 1 - span
    return np.minimum(least[: len(least) - rest], least[rest:]) if rest else least


def _inside(offsets: np.ndarray, n: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(document of each word, whether a window of one document starts at each of the first n - width + 1 words)."""
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    first = np.arange(n - width + 1)
    return doc, first + width <= offsets[doc[first] + 1]


def _hot_windows(width: int, hot: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            offsets, words = words_of(batch.column("text"))
            if len(words) < width:
                continue
            doc, valid = _inside(offsets, len(words), width)
            at = np.flatnonzero(valid & (_keys(words, width, hot) >= _HOT))
            if len(at):
                text = words.to_numpy(zero_copy_only=False)
                ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
                rows = pa.table({"words": pa.array([" ".join(text[p : p + width]) for p in at.tolist()]), "doc_id": pa.array(ids[doc[at]].astype(np.int64))})
                seen = rows.group_by("words").aggregate([("doc_id", "min"), ("doc_id", "count")])
                yield from seen.rename_columns(["words", "least", "n"]).combine_chunks().to_batches()

    return run


def hot_windows(documents: DataFrame, width: int, hot: np.ndarray, share: int) -> dict[str, int]:
    """Smallest doc_id of the windows that make up more than 1/``share`` of all windows of hot pairs: fewer than ``share``."""
    if not len(hot):
        return {}
    census = documents.mapInArrow(_hot_windows(width, hot), "words string, least long, n long").groupBy("words")
    census = stash(census.agg(F.min("least").alias("least"), F.sum("n").alias("n")), "hot-windows")
    total = census.agg(F.sum("n").alias("n")).first().n or 0
    return {r.words: r.least for r in census.where(F.col("n") * share > total).select("words", "least").collect()}


def _super_kmers(width: int, hot: np.ndarray, known: dict[str, int], buckets: int, flush_bytes: int = 16_000_000):
    """Rows (bucket, packed): runs of windows with one minimiser, those of a bucket packed together as they come.

    Rows without ``packed`` are ranges (doc_id, at, stop) found on the way, from windows in ``known``.
    """

    def flush(held: list[tuple]) -> pa.RecordBatch:
        bucket, doc, at = (np.concatenate([h[i] for h in held]) for i in range(3))
        texts = [t for h in held for t in h[3]]
        order = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(np.concatenate([[True], bucket[order][1:] != bucket[order][:-1]]))
        rows = [_pack(doc[g], at[g], [texts[i] for i in g.tolist()]) for g in np.split(order, cuts[1:])]
        none = [None] * len(rows)
        return _parts(bucket[order[cuts]], rows, none, none, none)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in slices(batches, "text"):
            offsets, words = words_of(batch.column("text"))
            n = len(words)
            if n < width:
                continue
            key = _keys(words, width, hot)
            doc, valid = _inside(offsets, n, width)
            cold = valid & (key < _HOT)
            same = np.zeros(len(key), bool)
            same[1:] = cold[1:] & cold[:-1] & (key[1:] == key[:-1]) & (doc[1 : len(key)] == doc[: len(key) - 1])
            starts = np.flatnonzero(cold & ~same)
            ends = np.flatnonzero(cold & ~np.append(same[1:], False))
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            text = joined(words)
            byte = np.concatenate([[0], np.cumsum(pc.binary_length(words).to_numpy().astype(np.int64) + 1)])
            cut = lambda a, b: [text[x:y] for x, y in zip(byte[a].tolist(), (byte[b + width] - 1).tolist())]
            single = np.flatnonzero(valid & (key >= _HOT))
            if len(single):
                found = [known.get(t.decode()) for t in cut(single, single)]
                met = np.array([x is not None for x in found])
                least = np.array([0 if x is None else x for x in found], np.int64)
                late = single[met & (least < ids[doc[single]].astype(np.int64))]
                if len(late):
                    apart = np.concatenate([[True], (np.diff(late) != 1) | (doc[late[1:]] != doc[late[:-1]])])
                    a, b = late[apart], late[np.append(apart[1:], True)]
                    base = offsets[doc[a]]
                    yield _parts(mix(ids[doc[a]].astype(np.uint64)) % np.uint64(buckets), [None] * len(a), ids[doc[a]].astype(np.int64), a - base, b + width - base)
                single = single[~met]
            places, lasts = np.concatenate([starts, single]), np.concatenate([ends, single])
            if not len(places):
                continue
            packed = cut(places, lasts)
            route = np.concatenate([mix(key[starts]), hash64(pa.array(packed[len(starts) :], pa.binary()))])
            held.append(((route % np.uint64(buckets)).astype(np.int64), ids[doc[places]].astype(np.int64), places - offsets[doc[places]], packed))
            size += int((byte[lasts + width] - byte[places]).sum())
            if size >= flush_bytes:
                yield flush(held)
                held, size = [], 0
        if held:
            yield flush(held)

    return run


def _parts(bucket, packed, doc, at, stop) -> pa.RecordBatch:
    arrays = [pa.array(np.asarray(bucket).astype(np.int64)), pa.array(packed, pa.binary()), pa.array(doc, pa.int64()), pa.array(at, pa.int32()), pa.array(stop, pa.int32())]
    return pa.record_batch(arrays, names=["bucket", "packed", "doc_id", "at", "stop"])


def _pair_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        pair, count = np.unique(_pairs(words_of(batch.column("text"))[1]), return_counts=True)
        yield pa.record_batch([pa.array(pair.view(np.int64)), pa.array(count.astype(np.int64))], names=["pair", "n"])


def hot_pairs(documents: DataFrame, one_in: int, share: int) -> tuple[np.ndarray, int]:
    """(word pairs with more than 1/``share`` of a document sample's pairs, pairs in all by the sample): fewer than ``share`` values."""
    sample = documents.where((F.xxhash64("doc_id") % one_in) == 0)
    counts = sample.mapInArrow(_pair_counts, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counts = stash(counts, "pairs")
    total = counts.agg(F.sum("n").alias("n")).first().n or 0
    rows = counts.where(F.col("n") * share > total).select("pair").collect()
    return np.sort(np.array([r.pair for r in rows], np.int64).view(np.uint64)), total * one_in


def _emit(doc, at, stop, words) -> pa.RecordBatch:
    return pa.record_batch(
        [pa.array(doc, pa.int64()), pa.array(at, pa.int32()), pa.array(stop, pa.int32()), pa.array(words, pa.string())],
        names=["doc_id", "at", "stop", "words"],
    )


def _windows(table: pa.Table, width: int):
    """(codes, row of each window, its first position in codes, distinct words, first position of each row)."""
    offsets, words = words_of(table.column("packed").combine_chunks())
    codes, _ = coded(words)
    per_row = np.diff(offsets) - width + 1
    row = np.repeat(np.arange(len(per_row)), per_row)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(per_row) - per_row, per_row)
    return codes, row, offsets[row] + nth, nth, words


def _sorted_bucket(table: pa.Table, width: int) -> pa.RecordBatch | None:
    """Ranges of words that windows of smaller documents repeat; ``table`` holds whole keys."""
    codes, row, pos, nth, _ = _windows(table, width)
    doc = table.column("doc_id").to_numpy()
    value = np.random.default_rng(7).integers(0, 1 << 63, int(codes.max()) + 1, dtype=np.uint64)[codes]
    rolling = np.zeros(len(codes) - width + 1, np.uint64)
    for j in range(width):
        rolling = rolling * np.uint64(0x9E3779B97F4A7C15) + value[j : len(rolling) + j]
    h = rolling[pos]
    order = np.argsort(h, kind="stable")
    new = np.concatenate([[True], h[order][1:] != h[order][:-1]])
    group = np.cumsum(new) - 1
    again = np.flatnonzero(~new)  # all but the first of each group: their words must be those of the one before
    if any((codes[pos[order[again]] + j] != codes[pos[order[again - 1]] + j]).any() for j in range(width)):  # two texts, one hash
        columns = [codes[pos + j] for j in range(width)]
        order = np.lexsort(columns)
        new = np.concatenate([[True], np.any([c[order][1:] != c[order][:-1] for c in columns], axis=0)])
        group = np.cumsum(new) - 1
    least = np.minimum.reduceat(doc[row[order]], np.flatnonzero(new))[group]
    repeat = np.zeros(len(pos), bool)
    repeat[order] = least < doc[row[order]]
    hit = np.flatnonzero(repeat)
    if not len(hit):
        return None
    joined = (np.diff(hit) == 1) & (row[hit[1:]] == row[hit[:-1]])
    a = hit[np.concatenate([[True], ~joined])]
    b = hit[np.concatenate([~joined, [True]])]
    at = table.column("at").to_numpy()
    return _emit(doc[row[a]], at[row[a]] + nth[a], at[row[b]] + nth[b] + width, [None] * len(a))


def _single_windows(table: pa.Table, width: int) -> Iterator[pa.RecordBatch]:
    """Every window as a row of its own with its text."""
    for piece in slices(iter(table.combine_chunks().to_batches()), "packed"):
        piece = pa.table(piece)
        _, row, pos, nth, words = _windows(piece, width)
        text = words.to_numpy(zero_copy_only=False)
        at = piece.column("at").to_numpy()[row] + nth
        yield _emit(piece.column("doc_id").to_numpy()[row], at, at + width, [" ".join(text[p : p + width]) for p in pos.tolist()])


def _buckets(width: int, bucket_windows: int):
    """Rows sorted by bucket: one bucket at a time, one that is too large goes on as single windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        now, size = None, 0

        def whole() -> Iterator[pa.RecordBatch]:
            found = _sorted_bucket(_unpack(held), width) if held else None
            if found is not None:
                yield found

        for batch in batches:
            ranges = batch.filter(pc.is_null(batch.column("packed")))
            if ranges.num_rows:
                yield _emit(ranges.column("doc_id"), ranges.column("at"), ranges.column("stop"), [None] * ranges.num_rows)
            batch = batch.filter(pc.is_valid(batch.column("packed")))
            for bucket, packed in zip(batch.column("bucket").to_pylist(), batch.column("packed").to_pylist()):
                if bucket != now:
                    yield from whole()
                    held, now, size = [], bucket, 0
                if size is not None:
                    held.append(packed)
                    size += int(np.frombuffer(packed, np.int64, 1)[0])
                    if size <= bucket_windows * 25:  # bytes a window takes before compression, at most
                        continue
                    size, waiting, held = None, held, []
                else:
                    waiting = [packed]
                for blob in waiting:
                    yield from _single_windows(_unpack([blob]), width)
        yield from whole()

    return run


def repeated_ranges(documents: DataFrame, width: int = 13, bucket_windows: int = 100_000, sample_one_in: int = 20, hot_share: int = 4000, window_share: int = 10_000) -> DataFrame:
    """Rows (doc_id, at, stop): words at..stop-1 lie in windows that start in a smaller doc_id too. Ranges may overlap."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    hot, pairs = hot_pairs(docs, sample_one_in, hot_share)
    buckets = max(64, pairs // bucket_windows)  # grows with the input; a bucket takes four times its share before it counts as too large
    known = hot_windows(docs, width, hot, window_share)
    parts = docs.mapInArrow(_super_kmers(width, hot, known, buckets), _PARTS)
    parts = parts.repartition("bucket").sortWithinPartitions("bucket")
    found = stash(parts.mapInArrow(_buckets(width, 4 * bucket_windows), _RANGES), "repeats")
    singles = found.where("words IS NOT NULL")
    least = singles.groupBy("words").agg(F.min("doc_id").alias("least"))
    late = singles.join(least, "words").where("least < doc_id").select("doc_id", "at", "stop")
    return found.where("words IS NULL").select("doc_id", "at", "stop").unionByName(late)


def _keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        ids, total, removed, digest = batch.column("doc_id"), [], [], []
        for text, ranges in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("ranges").to_pylist()):
            words = (text or b"").split()
            total.append(len(words))
            if ranges:
                keep = np.ones(len(words), bool)
                for r in ranges:
                    keep[r["at"] : r["stop"]] = False
                words = [w for w, k in zip(words, keep.tolist()) if k]
            removed.append(total[-1] - len(words))
            digest.append(b" ".join(words))
        sha = [hashlib.sha256(d).hexdigest() for d in digest]
        yield pa.record_batch(
            [ids, pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.binary()).cast(pa.string()), pa.array(sha)],
            names=["doc_id", "n_words", "n_removed", "kept_text", "kept_sha256"],
        )


def substring_dedup(documents: DataFrame, width: int = 13, **parameters) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_text (kept words joined by one space), kept_sha256.

    Null and empty texts have no words and hash the empty string. A null doc_id is returned with nothing removed and
    removes nothing. Rows with one doc_id are one document: they never repeat each other, and a word position removed
    in one is removed in all. Of equal texts only the smallest doc_id keeps its windows. Other columns are not read.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ranges = repeated_ranges(docs, width, **parameters)
    ranges = ranges.groupBy("doc_id").agg(F.collect_list(F.struct("at", "stop")).alias("ranges"))  # bounded by the document's length
    return docs.join(ranges, "doc_id", "left").mapInArrow(_keep, "doc_id long, n_words long, n_removed long, kept_text string, kept_sha256 string")
