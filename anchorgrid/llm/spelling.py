"""Spelling variants: words one edit apart, found by partition-and-enumerate signatures of their letter multisets.

The letters of a word are a binary vector with one place for the k-th occurrence of each letter. One replaced letter changes two places of it, one
inserted or deleted letter one place. The places are dealt to ``parts`` parts; at most two (one) of them hold a change, so two words agree on
all the others, and the words that agree on one choice of parts meet under one exact signature. As one edit also leaves the first or the last half of a word as
it was, a signature names one half besides. Pairs that meet are verified by their edit distance.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from anchorgrid.llm.common import mix, slices, stash

#: Letters of a run; all of them are one byte in Latin-1.
RUN = rb"[A-Za-z\xC0-\xFF]"
PIECE = 1 << 20  # bytes of a text looked at at once
FLUSH = 200_000  # words of a task counted before they are handed on

SAME, SHORT, LONG = 0, 1, 2


def _pieces(data: bytes, breaks: re.Pattern) -> Iterator[bytes]:
    """``data`` in pieces of about a megabyte that end between runs."""
    at = 0
    while at < len(data):
        found = breaks.search(data, at + PIECE)
        to = found.start() if found else len(data)
        yield data[at:to]
        at = to


def _counted(batches: Iterator[pa.RecordBatch], least: int, one_in: int) -> Iterator[pa.RecordBatch]:
    runs, breaks = re.compile(RUN + b"{%d,}" % least), re.compile(rb"[^A-Za-z\xC0-\xFF]")
    counts: dict[bytes, int] = {}

    def handed():
        words = pa.array([w.decode("latin-1") for w in counts], pa.string())
        return pa.RecordBatch.from_arrays([words, pa.array(counts.values(), pa.int64())], names=["word", "n"])

    for batch in slices(batches, "text"):
        for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist()):
            if not text:
                continue
            head = zlib.crc32(f"{key}:".encode())
            # what Latin-1 lacks becomes a question mark, which is no letter
            for piece in _pieces(text.encode("latin-1", "replace").lower(), breaks):
                for run, n in Counter(runs.findall(piece)).items():
                    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), head)
                    if h % one_in == 0:
                        spot = h % len(run)
                        run = run[:spot] + run[spot + 1 :]
                        if len(run) < least:
                            continue
                    counts[run] = counts.get(run, 0) + n
                if len(counts) >= FLUSH:
                    yield handed()
                    counts.clear()
    if counts:
        yield handed()


def word_counts(df: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", least: int = 7, one_in: int = 31) -> DataFrame:
    """(word, n): how often each run of Latin letters with at least ``least`` code points occurs, A-Z lower-cased.

    Where ``one_in`` divides the crc32 of ``id:run``, the run loses the code point at crc32 % length first, a seeded misspelling. A null id is the word null there; null
    and empty texts have no runs. Each task adds up its rows first, at most 200,000 words at a time.
    """
    rows = df.select(F.coalesce(F.col(id_column).cast("string"), F.lit("null")).alias("key"), F.col(text_column).alias("text"))
    return rows.mapInArrow(partial(_counted, least=least, one_in=one_in), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _ordered_hash(letters: np.ndarray, place: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """Hash of the letters of each row at their places."""
    out = np.zeros(n, np.uint64)
    np.add.at(out, row, mix(letters * np.uint64(0x100000001B3) + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    return mix(out)


def signatures(words: pa.Array, parts_two: int, parts_one: int) -> Iterator[tuple[int, np.ndarray]]:
    """(kind, signature of every word): one edit apart, two words of one length share a SAME signature, others a SHORT one of the shorter and a LONG one of the longer."""
    text = words.to_pylist()
    size = np.array([len(w) for w in text], np.int64)
    letters = np.frombuffer("".join(text).encode("utf-32-le"), np.uint32).astype(np.uint64)
    row = np.repeat(np.arange(len(text)), size)
    place = np.arange(len(letters)) - np.repeat(np.cumsum(size) - size, size)

    order = np.lexsort((letters, row))
    x, r = letters[order], row[order]
    new = np.concatenate([[True], (x[1:] != x[:-1]) | (r[1:] != r[:-1])])[: len(x)]
    starts = np.flatnonzero(new)
    spot = x * np.uint64(4096) + (np.arange(len(x)) - np.repeat(starts, np.diff(np.append(starts, len(x))))).astype(np.uint64)  # letter and how many-th
    value = mix(spot + np.uint64(1))

    def projections(parts):
        sums = np.zeros((len(text), parts), np.uint64)
        np.add.at(sums, (r, (mix(spot + np.uint64(77)) % np.uint64(parts)).astype(np.int64)), value)
        return sums

    def halves(length):
        """Hashes of the first half of words seen as ``length`` long, and of what follows it counted from the end."""
        half = (length // 2)[row]
        first = place < half
        last = place >= size[row] - (length[row] - half)
        return [_ordered_hash(letters[k], p[k], row[k], len(text)) for k, p in ((first, place), (last, size[row] - place))]

    for kinds, changes, parts in (((SAME,), 2, parts_two), ((SHORT, LONG), 1, parts_one)):
        sums = projections(parts)
        for kind in kinds:
            length = size - 1 if kind == LONG else size
            for side, kept in enumerate(halves(length)):
                for choice, subset in enumerate(combinations(range(parts), parts - changes)):
                    tag = np.uint64(((changes * 2 + side) << 10) + choice) + length.astype(np.uint64) * np.uint64(1 << 20)
                    yield kind, mix(mix(sums[:, subset].sum(axis=1) + mix(tag)) + kept)


def _signed(batches: Iterator[pa.RecordBatch], parts_two: int, parts_one: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            for kind, values in signatures(batch.column("word"), parts_two, parts_one):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(values.view(np.int64)), pa.array(np.full(len(values), kind, np.int8)), batch.column("word"), batch.column("n")], names=["signature", "kind", "word", "n"])


def near_pairs(words: DataFrame, *, parts_two: int = 4, parts_one: int = 3) -> DataFrame:
    """(a, n_a, b, n_b) for all pairs of different words of ``words`` (word, n) that differ by one inserted, deleted or replaced code point, each once.

    Both sides of the join read one exchange of signatures. A signature that many words share is split by the skew join; its pairs never leave
    the join unless they verify. Nothing is broadcast: a compressed file of words is small and its signatures are a hundred times as large, which no estimate knows.
    """
    signed = words.select("word", "n").mapInArrow(partial(_signed, parts_two=parts_two, parts_one=parts_one), "signature long, kind byte, word string, n long")
    a, b = signed.hint("merge").alias("a"), signed.alias("b")
    # (SAME, SAME) or (SHORT, LONG); written over both sides at once, or each side would filter and shuffle for itself
    kinds = F.col("b.kind") - 2 * F.col("a.kind") == 0
    order = (F.col("a.kind") != SAME) | (F.col("a.word") < F.col("b.word"))
    met = a.join(b, (F.col("a.signature") == F.col("b.signature")) & kinds & order & (F.levenshtein("a.word", "b.word", 1) == 1))
    return met.select(F.col("a.word").alias("a"), F.col("a.n").alias("n_a"), F.col("b.word").alias("b"), F.col("b.n").alias("n_b")).distinct()


def variant_roots(forms: DataFrame) -> DataFrame:
    """(word, root): the last word reached from ``word`` along ``forms`` (word, form), which never form a circle.

    Every round doubles the steps taken, so the rounds grow with the logarithm of the longest chain.
    """
    up = stash(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = up.select(F.col("word").alias("root"), F.col("root").alias("next"))
        up = stash(up.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if up.where("moved").isEmpty():
            return up.select("word", "root")
        up = up.select("word", "root")


def spelling_variants(
    df: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", least: int = 7, least_n: int = 2, ratio: int = 10, one_in: int = 31,
    parts_two: int = 4, parts_one: int = 3,
) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of at least ``least`` code points that occurs at least ``least_n`` times in all texts.

    ``n_near`` counts the words one edit away. ``form`` is the most frequent of these (ties: the smallest in code-point order) if it occurs at least
    ``ratio`` times as often, else null; ``root`` is where the forms lead in the end, the word itself without a form. Frequencies grow
    along forms, so there are no circles. Null and empty texts have no words; repeated rows count each time; an empty table gives an empty one. Other columns of
    ``df`` are not read, so their names cannot clash.
    """
    words = stash(word_counts(df, id_column=id_column, text_column=text_column, least=least, one_in=one_in).where(F.col("n") >= least_n), "words")
    pairs = near_pairs(words, parts_two=parts_two, parts_one=parts_one)
    sides = F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("m")), F.struct(F.col("b").alias("word"), F.col("a").alias("other"), F.col("n_a").alias("m")))).alias("s")
    near = pairs.select(sides).select("s.*").groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), F.col("other"))).alias("best"))
    frequent = -F.col("best.m") >= ratio * F.col("n")
    found = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(frequent, F.col("best.other")).alias("form"), F.when(frequent, -F.col("best.m")).alias("form_n"))
    found = stash(found, "forms")
    roots = variant_roots(found.where("form IS NOT NULL"))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
