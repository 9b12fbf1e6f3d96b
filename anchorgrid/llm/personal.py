"""Personal data in texts, also in disguise: e-mail and IP addresses, card and phone numbers.

What stands plainly is found by pattern. Then transducers rewrite the text into a plain one: look-alike, full-width and invisible characters, digits
spelled out or written with letters, at and dot in words or brackets. A tape keeps every rewrite, so that what the patterns find in the plain text
is mapped back to the characters of the source.
"""

from __future__ import annotations

import html
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache, partial
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from anchorgrid.llm.common import slices

#: Kinds in the order of results.
KINDS = ("email", "ip", "card", "phone")

# Letters of other scripts that look like ASCII letters.
LOOKALIKES = dict(zip(
    "асԁеһіјӏорԛѕԝхуѵАВСЕНІЈКМОРЅТХУЗ" "αιοκνρυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧ" "օոսցհɑɡıѐёϳо",
    "acdehijlopqswxyvABCEHIJKMOPSTXY3" "aiokvpuxABEZHIKMNOPTYX" "onughagieejo"))

# Spelled digits of English, German, French and Spanish.
DIGITS = {
    "0": "zero oh null zéro cero", "1": "one eins un uno", "2": "two zwei zwo deux dos", "3": "three drei trois tres", "4": "four vier quatre cuatro",
    "5": "five fünf cinq cinco", "6": "six sechs seis", "7": "seven sieben sept siete", "8": "eight acht huit ocho", "9": "nine neun neuf nueve",
}
DOT_WORDS = "dot punkt point punto"
AT_WORDS = "at ät arroba"
PLUS_WORDS = "plus más"
TIMES = {"double": 2, "triple": 3}

# Last labels of a domain that a spelled dot may lead to.
TOP_LABELS = frozenset(
    "com org net edu gov mil int info biz name pro io co me tv ai app dev eu uk us ca mx br ar de at ch fr be nl lu es pt it ie gr pl cz se no dk fi ru ua tr in cn jp kr au nz za example test".split())


# -- what stands plainly ------------------------------------------------------------------------------

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a run of digits is entered at its first digit only: where that one fails, the others fail for the same reason
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NO_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    """Whether the check digit is right."""
    doubled = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (doubled + sum(map(int, digits[::-2]))) % 10 == 0


def plain_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of everything the patterns find, by kind, then start; leftmost, without overlaps in one kind, in linear time."""
    found, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            last = domain.end()
            found.append(("email", start, last))
        else:
            last = max(last, at)
        at = text.find("@", max(at + 1, last))
    for m in _IP.finditer(text):
        if all(len(part) < 4 or len(part.lstrip("0")) < 4 for part in m.group().split(".")) and all(int(part.lstrip("0") or 0) <= 255 for part in m.group().split(".")):
            found.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = _NO_DIGIT.sub("", m.group()) if m.end() - m.start() < 40 else ""
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_NO_DIGIT.sub("", m.group())) <= 15:
                found.append(("phone", m.start(), m.end()))
    return found


# -- the tape -----------------------------------------------------------------------------------------


class Tape:
    """A text under rewrites that knows from which characters of the source each of its own came."""

    def __init__(self, source: str) -> None:
        self.text, self.changed, self._rewrites = source, False, []

    def swap(self, text: str) -> None:
        """Go on with ``text``, which differs in single characters only."""
        if text != self.text:
            self.text, self.changed = text, True

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Put the text of each (start, end, text) in the place of what stands there; edits are in order and do not overlap."""
        if not edits:
            return
        parts, spots, kept, size = [], [], 0, 0
        for start, end, put in edits:
            parts += (self.text[kept:start], put)
            size += start - kept
            spots.append((size, len(put), start, end))
            size += len(put)
            kept = end
        parts.append(self.text[kept:])
        self.text, self.changed = "".join(parts), True
        if any((size, end - start) != (1, 1) for _, size, start, end in spots):
            self._rewrites.append(([s[0] for s in spots], spots))

    def source(self, start: int, end: int) -> tuple[int, int]:
        """The span of the source that a span of at least one character of the text came from."""
        last = end - 1
        for ats, spots in reversed(self._rewrites):
            start, last = _back(ats, spots, start)[0], _back(ats, spots, last)[1]
        return start, last + 1


def _back(ats: list[int], spots: list[tuple[int, int, int, int]], i: int) -> tuple[int, int]:
    """First and last character before one rewrite that character ``i`` after it came from."""
    k = bisect_right(ats, i) - 1
    if k < 0:
        return i, i
    at, size, start, end = spots[k]
    if i < at + size:
        return start, end - 1
    return end + i - at - size, end + i - at - size


# -- transducers: each gives the edits that make a text plainer -----------------------------------------

_STRANGE = re.compile("[\u00a0\u00ad\u0131\u017f\u0250-\U0010ffff]+")
_ENTITY = re.compile(r"&(?:#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|commat|period|plus|nbsp|hyphen|shy);")


@lru_cache(maxsize=1 << 16)
def plain_character(c: str) -> str | None:
    """The ASCII character that ``c`` is a form of, nothing for an invisible one, None where it stands for itself."""
    kind = unicodedata.category(c)
    if kind == "Cf":
        return ""
    if kind == "Zs":
        return " "
    if kind == "Nd":
        return str(unicodedata.decimal(c))
    if kind == "Pd" or c == "\u2212":
        return "-"
    if c == "\u3002":
        return "."
    plain = unicodedata.normalize("NFKC", c)
    return plain if len(plain) == 1 and "!" <= plain <= "~" else None


def plain_width(text: str) -> str:
    """Wide, styled and foreign forms of ASCII characters, dashes and spaces as these; one character for each."""
    if text.isascii():
        return text
    found = set().union(*_STRANGE.findall(text))
    table = {ord(c): put for c in found if (put := plain_character(c))}
    return text.translate(table) if table else text


def invisible(text: str) -> list[tuple[int, int, str]]:
    """Characters that do not show, and character references."""
    edits = []
    if not text.isascii():
        edits += [(i, i + 1, "") for m in _STRANGE.finditer(text) for i, c in enumerate(m.group(), m.start()) if plain_character(c) == ""]
    if "&" in text:
        for m in _ENTITY.finditer(text):
            c = html.unescape(m.group())
            put = c if c.isascii() else plain_character(c) if len(c) == 1 else None
            if put is not None:
                edits.append((m.start(), m.end(), put))
        edits.sort()
    return edits


def lookalikes(text: str) -> list[tuple[int, int, str]]:
    """Letters of other scripts in words that consist of them and of ASCII characters alone."""
    edits, upto, fits = [], 0, False
    if text.isascii():
        return edits
    for m in _STRANGE.finditer(text):
        for i, c in enumerate(m.group(), m.start()):
            if c not in LOOKALIKES:
                continue
            if i >= upto:
                start, upto = i, i + 1
                while start > 0 and text[start - 1].isalnum():
                    start -= 1
                while upto < len(text) and text[upto].isalnum():
                    upto += 1
                fits = all(x.isascii() or x in LOOKALIKES for x in text[start:upto])
            if fits:
                edits.append((i, i + 1, LOOKALIKES[c]))
    return edits


_MIXED = re.compile(r"(?<![^\W_])(?=[OoIl]*[0-9])[0-9]*[OoIl][0-9OoIl]*(?![^\W_])")
_AS_DIGIT = str.maketrans("OoIl", "0011")


def lettered_digits(text: str) -> list[tuple[int, int, str]]:
    """O and l that stand among at least as many digits."""
    return [(m.start(), m.end(), m.group().translate(_AS_DIGIT)) for m in _MIXED.finditer(text) if 2 * len(_NO_DIGIT.sub("", m.group())) >= len(m.group())]


_VALUES = {w: d for d, words in DIGITS.items() for w in words.split()} | dict.fromkeys(DOT_WORDS.split(), ".") | dict.fromkeys(PLUS_WORDS.split(), "+")


def _any_of(words: list[str]) -> str:
    """A pattern of the words, by first letter."""
    return "(?:%s)" % "|".join(f"{a}(?:{'|'.join(w[1:] for w in group)})" for a, group in groupby(sorted(words), lambda w: w[0]))


_DIGIT_WORD = _any_of([w for w, value in _VALUES.items() if value not in ".+"])
_DOT_WORD = _any_of(DOT_WORDS.split())
# in lower case: a spelled digit and another digit or a dot after it, or a plus or a dot between digits; only a text with one of them is looked at closely
_PROMISING = re.compile(r"[ \t\n(,./+-]%s[ \t\n.,()/-]{1,3}(?:%s|%s|[0-9])|[0-9][ \t]{1,3}%s[ \t]{1,3}[0-9]|(?:%s)[ \t]{1,3}[0-9]" % (
    _DIGIT_WORD, _DIGIT_WORD, _DOT_WORD, _DOT_WORD, PLUS_WORDS.replace(" ", "|")))
_TOKEN = re.compile(r"(?<![^\W_])(?:(%s)[ -])?(%s)(?![^\W_])|[0-9]+" % ("|".join(TIMES), "|".join(_VALUES)), re.IGNORECASE)
_GAP = re.compile(r"[ \t\n.,()/-]{0,3}")


def spelled_digits(text: str) -> list[tuple[int, int, str]]:
    """Digits spelled out beside other digits, a spelled plus before them and a spelled dot between them."""
    if not _PROMISING.search("\n" + text.lower()):
        return []
    tokens = []  # start, end, what is put there
    kinds = []  # "d" for digits as they are, "s" for spelled ones, else "." or "+"
    for m in _TOKEN.finditer(text):
        value = _VALUES[m.group(2).lower()] if m.group(2) else m.group()
        tokens.append((m.start(), m.end(), value * TIMES.get((m.group(1) or "").lower(), 1)))
        kinds.append("d" if m.group(2) is None else value if value in ".+" else "s")
    linked = [bool(b[0] - a[1] <= 3 and _GAP.fullmatch(text, a[1], b[0])) for a, b in zip(tokens, tokens[1:])]
    before = ["", *(k if x else "" for k, x in zip(kinds, linked))]
    after = [*(k if x else "" for k, x in zip(kinds[1:], linked)), ""]
    digits = ("d", "s")
    # a single word beside a single number ("555-1373. Un ...") says nothing
    put = [
        (b + a) not in ("", "d") or text[max(0, t[0] - 1) : t[0]] == "+" if k == "s" else b in digits and a in digits if k == "." else k == "+" and a in digits
        for t, k, b, a in zip(tokens, kinds, before, after)]
    edits = []
    for i, ((start, end, value), kind) in enumerate(zip(tokens, kinds)):
        if put[i]:
            edits.append((start, end, value))
        if not after[i] or end == tokens[i + 1][0]:
            continue
        pair, gap = kind + after[i], text[end : tokens[i + 1][0]]
        if (pair == "ss" and put[i] and put[i + 1]) or (kind in ".+" and put[i]) or (after[i] == "." and put[i + 1]):
            edits.append((end, end + len(gap), ""))
        elif pair in ("ds", "sd") and (put[i] or put[i + 1]) and gap not in (" ", "-") and not gap.strip(" \t\n,"):
            edits.append((end, end + len(gap), " "))
    return edits


_BRACKETED = re.compile(r"[\[({<][ \t]{0,3}(?:(%s|@)|(?:%s|\.))[ \t]{0,3}[\])}>]" % (AT_WORDS.replace(" ", "|"), DOT_WORDS.replace(" ", "|")), re.IGNORECASE)


def bracketed_signs(text: str) -> list[tuple[int, int, str]]:
    """[at] and (dot) between letters or digits, with up to three spaces on each side."""
    edits = []
    for m in _BRACKETED.finditer(text):
        start, end = m.start(), m.end()
        while start > max(0, m.start() - 3) and text[start - 1] in " \t":
            start -= 1
        while end < min(len(text), m.end() + 3) and text[end] in " \t":
            end += 1
        if start and end < len(text) and text[start - 1] in _LOCAL and text[end] in _LOCAL and start >= (edits[-1][1] if edits else 0):
            edits.append((start, end, "@" if m.group(1) else "."))
    return edits


_AT = re.compile(r"(?<=[A-Za-z0-9])(?:[ \t]{1,3}(?:%s)[ \t]{1,3}|_at_|[ \t]{0,3}@[ \t]{0,3})(?=[A-Za-z0-9])" % AT_WORDS.replace(" ", "|"), re.IGNORECASE)
_LABEL = re.compile(r"[A-Za-z0-9-]+")
_DOT = re.compile(r"\.(?=[A-Za-z0-9-])|(?:[ \t]{1,3}(?:%s)[ \t]{1,3}|_dot_|[ \t]{1,3}\.[ \t]{1,3})(?=[A-Za-z0-9-])" % DOT_WORDS.replace(" ", "|"), re.IGNORECASE)
_DOT_BEFORE = re.compile(r"(?:[ \t]{1,3}(?:%s)[ \t]{1,3}|_dot_)$" % DOT_WORDS.replace(" ", "|"), re.IGNORECASE)
_DOT_REACH = 6 + max(map(len, DOT_WORDS.split()))


def worded_signs(text: str) -> list[tuple[int, int, str]]:
    """``name at host dot com``: with a spelled dot, a spaced @ or a name that can hardly be a word."""
    edits, done = [], 0
    for m in _AT.finditer(text):
        if m.start() < done:
            continue
        label = _LABEL.match(text, m.end())
        dots, upto, spelled = [], None, 0
        while label:
            if dots and label.group().lower() in TOP_LABELS:
                upto, spelled = len(dots), sum(text[a:b] != "." for a, b in dots)
            dot = _DOT.match(text, label.end())
            label = dot and _LABEL.match(text, dot.end())
            if dot:
                dots.append(dot.span())
        sign = m.group()
        if upto is None or (sign == "@" and not spelled):
            continue
        start, names = m.start(), []
        while True:
            edge = start
            while start > done and text[start - 1] in _LOCAL and not (text[start - 1] == "_" and text[max(done, start - 5) : start].lower() == "_dot_"):
                start -= 1
            before = _DOT_BEFORE.search(text, max(done, start - _DOT_REACH), start) if start < edge else None
            if not before or before.start() <= done or text[before.start() - 1] not in _LOCAL:
                break
            names.append(before.span())
            start = before.start()
        name = text[start : m.start()]
        odd = any(c.isalpha() for c in name) and any(c in "._+-0123456789" for c in name.strip("._+-"))
        if not (spelled or names or "@" in sign or odd):
            continue
        edits += [(a, b, ".") for a, b in reversed(names)]
        if sign != "@":
            edits.append((m.start(), m.end(), "@"))
        edits += [(a, b, ".") for a, b in dots[:upto] if text[a:b] != "."]
        done = dots[upto - 1][1]
    return edits


TRANSDUCERS = (invisible, lookalikes, lettered_digits, spelled_digits, bracketed_signs, worded_signs)


def personal_data(text: str) -> list[tuple[str, int, int, bool, str]]:
    """(kind, start, end, disguised, plain form) by kind, start and end; spans count code points of ``text``, the end is exclusive.

    A disguised span stands beside the plain ones; it is left out only where a plain one of its kind covers it.
    """
    plain = plain_spans(text)
    found = [(kind, a, b, False, text[a:b]) for kind, a, b in plain]
    tape = Tape(text)
    tape.swap(plain_width(text))
    for step in TRANSDUCERS:
        tape.rewrite(step(tape.text))
    if tape.changed:
        known = {kind: [(a, b) for k, a, b in plain if k == kind] for kind in KINDS}
        for kind, a, b in plain_spans(tape.text):
            start, end = tape.source(a, b)
            ahead = bisect_right(known[kind], (start, len(text) + 1)) - 1
            if text[start:end] != tape.text[a:b] and not (ahead >= 0 and known[kind][ahead][1] >= end):
                found.append((kind, start, end, True, tape.text[a:b]))
        found.sort(key=lambda s: (KINDS.index(s[0]), s[1], s[2], s[3]))
    return found


def masked(text: str, spans: list[tuple[str, int, int, bool, str]]) -> str:
    """The text with every span, overlapping ones as one, in the place of which stands the kind of the first."""
    out, kept = [], 0
    for kind, a, b, *_ in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= kept:
            out += (text[kept:a], f"<{kind}>")
        kept = max(kept, b)
    return "".join(out) + text[kept:]


SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("disguised", T.BooleanType()), T.StructField("plain", T.StringType())])
_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("disguised", pa.bool_()), ("plain", pa.string())])
_FIELDS = [f.name for f in SPAN]


def _searched(batches: Iterator[pa.RecordBatch], mask: bool) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        texts = [t or "" for t in batch.column("text").to_pylist()]
        found = [personal_data(t) for t in texts]
        spans = pa.array([[dict(zip(_FIELDS, s)) for s in f] for f in found], pa.list_(_SPAN))
        columns = [batch.column(0), spans] + ([pa.array(list(map(masked, texts, found)), pa.string())] if mask else [])
        yield pa.RecordBatch.from_arrays(columns, names=[batch.schema.names[0], "spans", "masked"][: len(columns)])


def find_personal(df: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", mask: bool = False) -> DataFrame:
    """(id, spans) for every row, with ``mask`` also the text with each span replaced by its kind.

    ``spans`` holds kind, start, end (code points, end exclusive), disguised and the plain form, sorted by kind as in ``KINDS``, start and end. Null and empty
    texts have no spans and an empty masked text; repeated rows and null ids are rows like others; whole texts are read in linear time. An empty table gives an empty one.
    Other columns of ``df`` are not returned, so their names cannot clash. One narrow pass without a shuffle.
    """
    schema = T.StructType([T.StructField(id_column, df.schema[id_column].dataType), T.StructField("spans", T.ArrayType(SPAN))] + ([T.StructField("masked", T.StringType())] if mask else []))
    rows = df.select(F.col(id_column), F.col(text_column).alias("text"))
    return rows.mapInArrow(partial(_searched, mask=mask), schema)
