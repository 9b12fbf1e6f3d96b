"""Fill-in-the-middle documents: a text is cut twice at drawn units and its parts are put in another order between marks.

Where the units of a text lie is found chunk by chunk. A rolling hash over the bytes ends a chunk wherever its top bits are zero, so equal
passages fall into equal chunks wherever they stand. The summary of a chunk (how many units begin in it, and what its two borders need to know) is
kept in a cache whose keys are the bytes themselves: a hit is an equal chunk, never only an equal hash. The counts of the chunks are added up, and only
the chunk that holds a cut is looked into.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import partial
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from anchorgrid.llm.common import mix, slices

#: Marks before prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
WINDOW = 32  # bytes the rolling hash sees
BLOCK = 1 << 20  # bytes of a text hashed at once
CACHE_BYTES = 16 << 20  # of each of the two generations of a task's cache

_GEAR = (mix(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)
_SPACES = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def rolling_hash(data: np.ndarray) -> np.ndarray:
    """Hash of the last 32 bytes at each byte: the sum of their gear values, each shifted by its distance."""
    h = _GEAR[data]
    width = 1
    while width < WINDOW:
        h[width:] += h[:-width] << np.uint32(width)
        width *= 2
    return h


def chunk_ends(data: np.ndarray, mean: int) -> list[int]:
    """Ends of the chunks of a text, about ``mean`` bytes apart (a power of two) and at most eight times that; the last one is the text's end."""
    limit, most = np.uint32(1 << (32 - mean.bit_length() + 1)), 8 * mean
    ends, last = [], 0
    for at in range(0, len(data), BLOCK):
        lead = max(0, at - WINDOW)
        hit = np.flatnonzero(rolling_hash(data[lead : at + BLOCK]) < limit) + lead + 1
        for end in [*hit[(hit > at) & (hit >= WINDOW)].tolist(), min(at + BLOCK, len(data))]:
            while end - last > most:
                last += most
                ends.append(last)
            if end > last and (end < at + BLOCK or end == len(data)):
                ends.append(end)
                last = end
    return ends


def point_starts(data: np.ndarray) -> tuple[np.ndarray, bool, bool]:
    """Where code points begin after the first byte, whether the first byte can begin one, whether one can begin after the last byte."""
    lead = (data & 0xC0) != 0x80
    return lead[1:], bool(lead[0]), True


def word_starts(data: np.ndarray) -> tuple[np.ndarray, bool, bool]:
    """The same for units of white space and the word after it."""
    space = _SPACES[data]
    return space[1:] & ~space[:-1], bool(space[0]), not space[-1]


UNITS: dict[str, Callable] = {"point": point_starts, "word": word_starts}


class Units:
    """Unit counts of whole texts out of cached chunk summaries."""

    def __init__(self, unit: str, mean: int) -> None:
        self.starts, self.mean = UNITS[unit], mean
        self.young, self.old, self.held = {}, {}, 0

    def summary(self, chunk: bytes) -> tuple[int, bool, bool]:
        """(units that begin after the first byte, can the first byte begin one, can one begin after the last)."""
        found = self.young.get(chunk)
        if found is None:
            found = self.old.get(chunk)
            if found is None:
                inner, first, after = self.starts(np.frombuffer(chunk, np.uint8))
                found = (int(np.count_nonzero(inner)), first, after)
            if self.held > CACHE_BYTES:
                self.old, self.young, self.held = self.young, {}, 0
            self.young[chunk] = found
            self.held += len(chunk)
        return found

    def read(self, data: bytes) -> None:
        """Take in a text: how many of its units begin before each chunk."""
        self.data = data
        ends = chunk_ends(np.frombuffer(data, np.uint8), self.mean)
        self.at = [0, *ends]
        counts, self.opens, open_ = [], [], True
        for a, b in zip(self.at, ends):
            inner, first, after = self.summary(data[a:b])
            begins = a == 0 or (first and open_)
            counts.append(inner + begins)
            self.opens.append(begins)
            open_ = after
        self.before = [0, *accumulate(counts)]

    @property
    def n(self) -> int:
        return self.before[-1]

    def byte_of(self, unit: int) -> int:
        """The byte at which unit number ``unit`` begins; the end of the text for the number after the last."""
        if unit >= self.n:
            return len(self.data)
        i = bisect_right(self.before, unit) - 1
        inner = self.starts(np.frombuffer(self.data, np.uint8, self.at[i + 1] - self.at[i], self.at[i]))[0]
        spots = [0, *(np.flatnonzero(inner) + 1).tolist()] if self.opens[i] else (np.flatnonzero(inner) + 1).tolist()
        return self.at[i] + spots[unit - self.before[i]]


def draws(seed: int, key: str) -> tuple[int, ...]:
    """Four 32-bit draws of a row."""
    digits = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    return tuple(int(digits[i : i + 8], 16) for i in range(0, 32, 8))


def _rearranged(batches: Iterator[pa.RecordBatch], unit: str, seed: int, mean: int, plain: int, spm: int, marks: tuple[str, str, str], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    units = Units(unit, mean)
    p, s, m = (x.encode() for x in marks)
    for batch in slices(batches, "text"):
        out = []
        for key, text in zip(batch.column("key").to_pylist(), batch.column("text").cast(pa.large_binary()).to_pylist()):
            text = text or b""
            units.read(text)
            h1, h2, h3, h4 = draws(seed, key)
            first, second = sorted((h1 % (units.n + 1), h2 % (units.n + 1)))
            if not text or h3 % 100 >= 100 - plain or p in text or s in text or m in text:
                out.append((units.n, "plain", None, None, text))
                continue
            a, b = units.byte_of(first), units.byte_of(second)
            ahead, middle, behind = text[:a], text[a:b], text[b:]
            form = "spm" if h4 % 100 < spm else "psm"
            parts = [s, behind, p, ahead, m, middle] if form == "spm" else [p, ahead, s, behind, m, middle]
            out.append((units.n, form, first, second - first, b"".join(parts)))
        columns = [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.large_binary()))]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns[:4], columns[4].cast(pa.large_string()).cast(pa.string())], schema=schema)


def fill_in_middle(
    df: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", unit: str = "point", seed: int = 1,
    plain_percent: int = 10, spm_percent: int = 20, marks: tuple[str, str, str] = MARKS, mean_chunk: int = 512,
) -> DataFrame:
    """(id, n, form, prefix_units, middle_units, output) for every row: the text with its middle moved to the end.

    ``n`` counts the units of the text, ``unit`` is ``point`` (code points) or ``word`` (white space and the word after it). Two cuts, how a row is
    arranged (``psm``: prefix, suffix, middle; ``spm``: suffix first) and whether it stays ``plain`` follow from the sha256 of seed and id alone, so repeated ids
    are cut alike if their texts are, and reruns agree. Rows stay plain with ``plain_percent`` of 100, without text (null and empty: output empty, 0
    units) and where the text holds one of the ``marks``; their units are null. A null id draws as the word null. No row is dropped, no text is
    cut off whatever its length; an empty table gives an empty one. Other columns of ``df`` are not returned, so their names cannot clash. One narrow
    pass, no shuffle; a task holds one piece of texts and at most two cache generations of 16 MB.
    """
    if mean_chunk & (mean_chunk - 1) or mean_chunk < WINDOW:
        raise ValueError("the mean chunk size is a power of two of at least 32")
    rows = df.select(F.col(id_column), F.coalesce(F.col(id_column).cast("string"), F.lit("null")).alias("key"), F.col(text_column).alias("text"))
    schema = T.StructType([T.StructField(id_column, df.schema[id_column].dataType)]
                          + [T.StructField(c, t) for c, t in (("n", T.LongType()), ("form", T.StringType()), ("prefix_units", T.LongType()), ("middle_units", T.LongType()), ("output", T.StringType()))])
    return rows.mapInArrow(partial(_rearranged, unit=unit, seed=seed, mean=mean_chunk, plain=plain_percent, spm=spm_percent, marks=marks, schema=to_arrow_schema(schema)), schema)


def restored(output, form, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text before the arrangement. It held no mark and no mark can arise where parts meet, so the marks found are those that were set."""
    parts = F.split(output, "|".join(re.escape(m) for m in marks), -1)
    part = lambda i: F.get(parts, F.lit(i))
    return F.when(F.col(form) == "psm", F.concat(part(1), part(3), part(2))).when(F.col(form) == "spm", F.concat(part(2), part(3), part(1))).otherwise(F.col(output))
