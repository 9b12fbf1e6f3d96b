"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from anchorgrid.session import scratch

#: ASCII white space: what separates words everywhere in this subpackage.
SPACE = r"[\x20\x09-\x0D]+"


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a new table in the shared folder and read it back.

    What follows re-reads files instead of replaying what lies before, also after losing an executor.
    """
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def n_words(text) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.size(F.array_remove(F.split(text, SPACE), "")), F.lit(0)).cast("long")


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 300_000) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces of about ``most`` bytes of ``column``; one row is never cut."""
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            done = size[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(size, done + most, "right")))
            yield batch.slice(at, to - at)
            at = to


def words_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(offsets, words): row i has words offsets[i]:offsets[i+1]; a null text has none."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
    flat, offsets = lists.flatten(), lists.offsets.to_numpy()
    offsets = offsets - offsets[0]
    full = pc.greater(pc.binary_length(flat), 0)
    before = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
    return before[offsets].astype(np.int64), flat.filter(full)


def coded(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(code of each word, distinct words)."""
    encoded = words.dictionary_encode()
    if len(words) == 0:
        return np.zeros(0, np.int64), words
    return encoded.indices.to_numpy().astype(np.int64), encoded.dictionary


def joined(words: pa.Array) -> bytes:
    """All words with one space between neighbours."""
    row = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words)
    return pc.binary_join(row, pa.scalar(" ", words.type))[0].as_buffer().to_pybytes()


_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]  # of the base and of its inverse, grown when needed


def hash64(strings: pa.Array) -> np.ndarray:
    """64-bit hashes of strings, the same in every process: a polynomial over the bytes, then mixed."""
    strings = strings.cast(pa.large_binary())
    if len(strings) == 0:
        return np.zeros(0, np.uint64)
    ends = np.frombuffer(strings.buffers()[1], np.int64)[strings.offset : strings.offset + len(strings) + 1]
    data = np.frombuffer(strings.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    if len(_POWERS[0]) < len(data) + 1:
        for i, base in enumerate((int(_BASE), pow(int(_BASE), -1, 1 << 64))):
            _POWERS[i] = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(2 * len(data), base, np.uint64)]))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _POWERS[0][: len(data)])])
    return mix((total[ends[1:]] - total[ends[:-1]]) * _POWERS[1][ends[:-1]])


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64 on unsigned 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def windows_hash(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` neighbours of ``hashes``; row borders are the caller's."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    for j in range(n):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + hashes[j : len(hashes) - n + 1 + j])
    return out
