"""Benchmark decontamination by canonical templates.

Words are lower-cased and freed of outer punctuation; numbers, names (capitalised inside a sentence) and units (after
a number) become typed placeholders. Windows of template words are hashed and joined to those of the
benchmark, and windows of the words themselves where an item has placeholders. Neighbouring hits of one item on one alignment form a run, and inside a run every slot value of the item
must stand for one value of the document throughout, and the other way round, so a re-parameterised
question is found and a chance likeness of frames is not. A run counts once it covers ``min_run`` words or the item.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from anchorgrid.llm.common import coded, hash64, mix, slices, stash, words_of

# The units that form a slot after a number.
UNITS = (
    "%", "percent", "mm", "cm", "m", "km", "meter", "meters", "metre", "metres", "kilometer", "kilometers", "inch", "inches", "foot", "feet", "yard", "yards",
    "mile", "miles", "mg", "g", "kg", "gram", "grams", "kilogram", "kilograms", "ounce", "ounces", "pound", "pounds", "ton", "tons", "ml", "l", "liter", "liters",
    "litre", "litres", "gallon", "gallons", "second", "seconds", "minute", "minutes", "hour", "hours", "day", "days", "week", "weeks", "month", "months",
    "year", "years", "cent", "cents", "dollar", "dollars", "euro", "euros", "degree", "degrees", "watt", "watts", "volt", "volts", "newton", "newtons",
)
# Words that open a sentence and are no names, so that none stands for another there.
OPENERS = (
    "what", "which", "who", "whom", "whose", "where", "when", "why", "how", "is", "are", "was", "were", "am", "do", "does", "did", "can", "could", "will", "would",
    "shall", "should", "may", "might", "must", "has", "have", "had", "the", "this", "that", "these", "those", "there", "here", "if", "in", "on", "at", "of", "for", "from",
    "by", "with", "as", "and", "or", "but", "so", "not", "no", "an", "it", "its", "he", "she", "they", "we", "you", "his", "her", "their", "our", "your", "my", "to",
    "each", "every", "all", "some", "one", "after", "before", "while", "since", "because", "then", "let", "find", "give", "name", "choose", "explain", "suppose",
)
SLOTS = ("<number>", "<unit>", "<name>")
_SLOT_HASH = hash64(pa.array(SLOTS, pa.large_string()))
_BASE, _LITERAL = np.uint64(0x9E3779B97F4A7C15), 1 << 32


class Template(NamedTuple):
    """The words of some rows. Template words are the words themselves; ``group`` folds neighbouring slots of one kind into one."""

    offsets: np.ndarray  # row i has words offsets[i]:offsets[i+1]
    kind: np.ndarray  # slot of each word or -1
    other: np.ndarray  # the other kind a word can have by what stands before it, or -2
    hash: np.ndarray  # of the template word
    literal: np.ndarray  # of the word
    loose: np.ndarray  # whether the kind hangs on what stands before
    code: np.ndarray
    values: np.ndarray  # distinct words, by code


def template(texts: pa.Array) -> Template:
    offsets, words = words_of(texts)
    code, distinct = coded(words)
    if not len(distinct):
        none = np.zeros(0, np.int8)
        return Template(offsets, none, none, np.zeros(0, np.uint64), np.zeros(0, np.uint64), none, code, np.zeros(0, object))
    flag = lambda a: a.to_numpy(zero_copy_only=False).astype(bool)
    bare = pc.replace_substring_regex(distinct, r"^[^\p{L}\p{N}%]+|[^\p{L}\p{N}%]+$", "")
    lower = pc.utf8_lower(bare)
    empty = flag(pc.equal(pc.binary_length(bare), 0))[code]
    number = flag(pc.match_substring_regex(bare, r"^\p{Nd}[\p{Nd}.,:/]*%?$"))[code]
    title = flag(pc.match_substring_regex(bare, r"^\p{Lu}[\p{Ll}'’-]*\p{Ll}$"))[code]
    unit = flag(pc.is_in(lower, pa.array(UNITS, lower.type)))[code]
    opener = flag(pc.is_in(lower, pa.array(OPENERS, lower.type)))[code]
    ends = flag(pc.match_substring_regex(distinct, r"[.!?:][^\p{L}\p{N}]*$"))[code]
    opens = np.ones(len(code), bool)
    opens[1:] = ends[:-1]
    opens[offsets[:-1][np.diff(offsets) > 0]] = True
    after_number = np.zeros(len(code), bool)
    after_number[1:] = number[:-1]
    kind = np.where(number, 0, np.where(after_number & unit, 1, np.where(title & ~opens, 2, -1))).astype(np.int8)
    other = np.where(kind > 0, -1, np.where((kind < 0) & title & ~opener, 2, -2)).astype(np.int8)
    literal = hash64(lower)[code]
    h = np.where(kind >= 0, _SLOT_HASH[kind], literal)
    full = ~empty
    before = np.concatenate([[0], np.cumsum(full)])
    return Template(before[offsets], kind[full], other[full], h[full], literal[full], (title | unit)[full], code[full], lower.to_numpy(zero_copy_only=False))


class _Windows(NamedTuple):
    """Windows that start at words ``at``; the first template word ends at ``then``, the others are groups."""

    at: np.ndarray
    first: np.ndarray  # kind of the first template word
    then: np.ndarray
    ends: np.ndarray  # end of each group
    group: np.ndarray  # group of each word; one more for the end
    literal: bool
    folded: bool
    other: bool


def _families(t: Template, starts_only: bool) -> Iterator[_Windows]:
    """Windows of words, of folded slots and of literal words; the first word also in its other kind (items: that of the item)."""
    n = len(t.kind)
    at, each = np.arange(n), np.arange(n + 1)
    row_start = np.zeros(n + 1, bool)
    row_start[t.offsets] = True
    same = np.zeros(n + 1, bool)  # a slot of the kind of the one before it
    same[1:n] = (t.kind[1:] >= 0) & (t.kind[1:] == t.kind[:-1]) & ~row_start[1:n]
    group = np.cumsum(~same) - 1
    heads = np.flatnonzero(~same)[:-1]
    ends = np.flatnonzero(~same)[1:]
    other = np.flatnonzero((t.other > -2) & (row_start[:n] | (not starts_only)))
    # a name put before names is one with them
    merged = (t.other[other] == 2) & (np.append(t.kind, -1)[other + 1] == 2) & ~row_start[other + 1] if len(other) else np.zeros(0, bool)
    yield _Windows(at, t.kind, at + 1, each[1:], each, False, False, False)
    yield _Windows(other, t.other[other], other + 1, each[1:], each, False, False, True)
    yield _Windows(heads, t.kind[heads], ends, ends, group, False, True, False)
    yield _Windows(other, t.other[other], np.where(merged, ends[np.minimum(group[other + 1], len(ends) - 1)], other + 1), ends, group, False, True, True)
    # windows without slots are the same in the first family, apart from the kind of their first word
    yield _Windows(at, t.kind, at + 1, each[1:], each, True, False, False)


def _window_rows(batch: pa.RecordBatch, key: str, sizes, min_literal, known: np.ndarray | None) -> pa.RecordBatch | None:
    t = template(batch.column("text"))
    n = len(t.kind)
    if not n or known is not None and not len(known):
        return None
    lengths = np.diff(t.offsets)
    doc = np.repeat(np.arange(batch.num_rows), lengths)
    out = []
    for w in _families(t, known is None):
        count = len(w.ends)
        head = np.concatenate([[0], w.ends[:-1]])
        plain = np.concatenate([[0], np.cumsum(t.kind[head] < 0)])
        base = t.literal if w.literal else t.hash[head]
        second = w.group[w.then]
        own = t.literal[w.at]
        if not w.literal:
            own = np.where(w.first >= 0, _SLOT_HASH[w.first], own)
        limit = t.offsets[doc[w.at] + 1]
        if known is None:  # windows of an item are as long as allowed
            start = w.at == t.offsets[doc[w.at]]
            whole = np.zeros(batch.num_rows, np.int64)
            whole[doc[w.at[start]]] = (1 + w.group[limit] - second)[start]
        for size in sizes:
            last = second + size - 2
            fits = last < count
            stop = w.then if size == 1 else w.ends[np.minimum(last, count - 1)]
            fits &= stop <= limit
            literal = (w.first < 0) + plain[np.minimum(last + 1, count)] - plain[np.minimum(second, count)]
            if w.folded:
                fits &= stop - w.at > size
            if w.literal:
                fits &= (literal < size) | (known is not None) & t.loose[w.at]
            if known is None:
                fits &= np.minimum(whole[doc[w.at]], max(sizes)) == size
                if not w.literal:
                    fits &= literal >= min(min_literal, size)
            some = np.flatnonzero(fits)
            hashes = mix(own[some])
            for j in range(size - 1):
                hashes = mix(hashes * _BASE + base[second[some] + j])
            hashes = hashes ^ np.uint64(size + (_LITERAL if w.literal else 0))
            if known is not None:
                hit = known[np.minimum(np.searchsorted(known, hashes), len(known) - 1)] == hashes
                some, hashes = some[hit], hashes[hit]
            for i, value in zip(some.tolist(), hashes.view(np.int64).tolist()):
                p, q, g = int(w.at[i]), int(w.then[i]), int(second[i])
                borders = [p, q, *w.ends[g : g + size - 1].tolist()]
                kinds = [int(w.first[i]), *t.kind[borders[1:-1]].tolist()]
                parts = [" ".join(t.values[c] for c in t.code[a:b].tolist()) for a, b in zip(borders, borders[1:])]
                held = [x for x, k in zip(parts, kinds) if k >= 0]
                names = parts if w.literal else [SLOTS[k] if k >= 0 else x for x, k in zip(parts, kinds)]
                spans = [b - a for a, b in zip(borders, borders[1:])] if w.folded else None
                d = int(doc[p])
                text = ("= " if w.literal else "") + " ".join(names)
                out.append((value, d, p - int(t.offsets[d]), size, int(lengths[d]), text, None if w.literal and known is not None else held, spans, w.other))
    if not out:
        return None
    ids = batch.column(key).to_numpy(zero_copy_only=False)
    columns = list(zip(*out))
    return pa.record_batch(
        [
            pa.array(columns[0], pa.int64()), pa.array([int(ids[d]) for d in columns[1]], pa.int64()), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.int32()),
            pa.array(columns[4], pa.int32()), pa.array(columns[5], pa.string()), pa.array(columns[6], pa.list_(pa.string())), pa.array(columns[7], pa.list_(pa.int32())),
            pa.array(columns[8], pa.bool_()),
        ],
        names=["hash", key, "at", "size", "length", "template", "slots", "spans", "other"],
    )


def _windows(key: str, sizes, min_literal: int, known: np.ndarray | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1_000_000):
            found = _window_rows(batch, key, sizes, min_literal, known)
            if found is not None:
                yield found

    return run


class _Run:
    """Neighbouring windows of an item on one alignment whose slots agree."""

    def __init__(self, start: int, at: int):
        self.start, self.stop, self.at, self.end = start, start, at, at
        self.there, self.back, self.places, self.reworded = {}, {}, set(), False

    def agrees(self, pairs) -> bool:
        return all(self.there.get(a, b) == b and self.back.get(b, a) == a for a, b in pairs)

    def add(self, pairs, places):
        self.there.update(pairs)
        self.back.update((b, a) for a, b in pairs)
        self.places.update(places)
        self.stop, self.end = max(self.stop, places[-1][0]), max(self.end, places[-1][1])
        self.reworded |= any(a != b for a, b in pairs)

    @property
    def slots(self) -> int:
        return len({word for a in self.there for word in a.split(" ")})

    def within(self, run: _Run) -> bool:
        return run.start <= self.start and self.stop <= run.stop and not self.places.isdisjoint(run.places)


def _chains(hits) -> Iterator[_Run]:
    """Runs of the windows ``hits`` of one item in one document, sorted by place in the document.

    A window joins a run when both put the same words of item and document side by side at its start. A folded slot may have another
    number of words on each side, so the distance between item and document may change inside a run, but only there.
    """
    runs: list[_Run] = []
    open_at: dict[tuple[int, int], list[_Run]] = {}

    def close():
        runs.sort(key=lambda r: (r.start - r.stop, r.reworded, r.at - r.end if r.reworded else r.end - r.at, r.at))  # verbatim ones before others, with whole names
        kept: list[_Run] = []
        for r in runs:
            if not any(r.within(x) for x in kept):
                kept.append(r)
        yield from sorted(kept, key=lambda r: (r.at, r.start))
        runs.clear()
        open_at.clear()

    last = -1
    for hit in hits:
        i, d, size = hit["item_at"], hit.get("at", hit["item_at"]), hit["size"]
        if d > last:
            yield from close()
        one = [1] * size
        steps = zip(itertools.accumulate(hit.get("item_spans") or one, initial=i), itertools.accumulate(hit.get("spans") or one, initial=d))
        places = list(steps)
        pairs = set(zip(hit["item_slots"], hit["slots"]))
        if len(dict(pairs)) != len(pairs) or len({b for _, b in pairs}) != len(pairs):
            continue  # the window contradicts itself
        joined = [r for r in open_at.get((i, d), ()) if r.agrees(pairs)]
        if not joined:
            joined = [_Run(i, d)]
            runs += joined
        for r in joined:
            for place in places:
                if place not in r.places:
                    open_at.setdefault(place, []).append(r)
            r.add(pairs, places)
        last = max(last, places[-1][1])
    yield from close()


def _consistent(hits: list[dict]) -> list[tuple[int, int, int]]:
    """Runs (first word in the item, words, slots) of ``hits`` sorted by place."""
    return [(r.start, r.stop - r.start, r.slots) for r in _chains(hits)]


def _runs(min_run: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for part in range(0, batch.num_rows, 1000):
                yield from batch.slice(part, 1000).to_pylist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_())
        names = ["doc_id", "item_id", "first_word", "n_words", "n_slots", "reworded"]
        out = []
        for (doc, item), hits in itertools.groupby(rows(batches), key=lambda r: (r["doc_id"], r["item_id"])):
            first = next(hits)
            for r in _chains(itertools.chain([first], hits)):
                if r.stop - r.start >= min(min_run, first["length"]):
                    out.append((doc, item, r.at, r.stop - r.start, r.slots, r.reworded))
            if len(out) >= 1000:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)
                out = []
        if out:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

    return run


def leaks(documents: DataFrame, benchmark: DataFrame, width: int = 8, min_literal: int = 4, min_run: int = 13, block: int = 1_000_000) -> DataFrame:
    """Rows (doc_id, item_id, first_word, n_words, n_slots, reworded): passages of items in documents, in template words.

    Places and lengths count words, those of the item for a passage. Items shorter than ``width`` words are one window. Windows with fewer than
    ``min_literal`` literal words are found word by word only, also items of one or two words. Neighbouring slots of one kind are searched one by one and as one
    slot, and the first word of an item both as a word and as a name. Null or empty texts and rows with a null id give nothing. Rows repeating an id are searched alike and reported once per passage. The
    hashes of the benchmark are shipped to tasks in blocks of ``block`` values, one pass over the documents for each.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id IS NOT NULL AND text IS NOT NULL")
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    kinds = "hash long, {} long, at int, size int, length int, template string, slots array<string>, spans array<int>, other boolean"
    known = stash(items.mapInArrow(_windows("item_id", range(1, width + 1), min_literal, None), kinds.format("item_id")), "items").dropDuplicates(["hash", "item_id", "at", "template", "spans"])
    sizes = sorted(r.size for r in known.select("size").distinct().collect())  # at most width numbers
    hashes = known.select("hash").distinct()
    blocks = -(-hashes.count() // block)
    found = None
    for i in range(blocks):
        part = hashes.where(F.pmod(F.xxhash64("hash"), F.lit(blocks)) == i)
        values = np.sort(part.toArrow().column("hash").to_numpy().view(np.uint64))  # about `block` values
        hits = docs.mapInArrow(_windows("doc_id", sizes, min_literal, values), kinds.format("doc_id"))
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        return documents.sparkSession.createDataFrame([], "doc_id long, item_id long, first_word int, n_words int, n_slots int, reworded boolean")
    known = known.select("hash", "template", "size", "item_id", F.col("at").alias("item_at"), F.col("length"), F.col("slots").alias("item_slots"), F.col("spans").alias("item_spans"), F.col("other").alias("item_other"))
    pairs = found.drop("length", "other").join(known, ["hash", "template", "size"])
    # a first word that is the same on both sides is found in its literal form
    pairs = pairs.where(~F.col("item_other") | (F.get("item_slots", F.lit(0)) != F.get("slots", F.lit(0)))).withColumn("slots", F.coalesce("slots", "item_slots"))
    pairs = pairs.select("doc_id", "item_id", "at", "item_at", "size", "length", "item_slots", "slots", "item_spans", "spans")
    placed = pairs.repartition("doc_id", "item_id").sortWithinPartitions("doc_id", "item_id", "at", "item_at")
    return placed.mapInArrow(_runs(min_run), "doc_id long, item_id long, first_word int, n_words int, n_slots int, reworded boolean")


def decontaminate(documents: DataFrame, benchmark: DataFrame, **parameters) -> DataFrame:
    """``documents`` without those that hold a benchmark passage; documents with a null id or text stay."""
    hit = leaks(documents, benchmark, **parameters).select(F.col("doc_id").alias("leak_id")).distinct()
    hit = stash(hit, "leaks")
    return documents.join(hit, documents["doc_id"] == hit["leak_id"], "left_anti")
