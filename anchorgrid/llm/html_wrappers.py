"""Main text of HTML pages by wrappers inferred per host.

A wrapper is a union-free regular expression over tags and text slots. A page's token stream is first folded: neighbouring
groups of the same shape become one repeated group. Then the streams of a few pages of a host are aligned one
after another: text that differs becomes a slot, parts that one side lacks become optional, one against many becomes repeated.
The wrapper shows where the text of the host varies and which texts are fixed, and so names the element
that holds the article, the least one with all text that varies; every page of the host is read along it. Where elements are named article (or else main)
all outermost ones are read. A page that does not fit its host's wrapper is read by a wrapper
of its own.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from anchorgrid.llm.common import slices, stash

# Element names by their role in HTML, and words in class and id that mark what is not article text.
RAW = ("script", "style", "noscript", "template", "svg", "iframe", "object", "canvas", "select", "button", "textarea", "head", "math", "audio", "video")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
SKIPPED = frozenset("nav footer aside form menu dialog".split()) | frozenset(RAW)
SKIP_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disclaimer disqus footer "
    "masthead menu modal nav navbar navigation newsletter notice pager pagination popup promo promotion related replies reply respond share sharing sidebar "
    "social sponsor sponsored subscribe toolbar widget widgets".split()
)
SKIP_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
CLOSES = {"li": ("ul", "ol"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?/][^>]*>|<[a-zA-Z/][^>]*>|[^<]+|<", re.S)
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_END = {name: re.compile(rf"</{name}\b[^>]*>", re.I) for name in RAW}
_WORDS = re.compile(r"[^a-z0-9]+")
_CELLS = ("td", "th")
NAMES = ("article", "main")
DEEPEST = 200


class Node:
    """An element: label for the alignment, children (nodes, or pairs of text and whether it is a link)."""

    __slots__ = ("name", "label", "skip", "children")

    def __init__(self, name: str, label: str, skip: bool):
        self.name, self.label, self.skip, self.children = name, label, skip, []


def _marks(name: str, attributes: str) -> tuple[str, bool]:
    """(label, whether the element is no article text) from a start tag."""
    skip = name in SKIPPED
    if not attributes or "=" not in attributes and "hidden" not in attributes:
        return name, skip
    words, label = [], name
    for key, value in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), entities.unescape(value.strip("\"'")).lower()
        if key in ("class", "id"):
            label += ("." if key == "class" else "#") + re.sub(r"\d+", "0", " ".join(value.split()))
            words += _WORDS.split(value)
        elif key == "role":
            skip = skip or value in SKIP_ROLES
            label += f"@{value}"
        elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            skip = True
    return label, skip or name not in ("html", "body", "article", "main") and not SKIP_WORDS.isdisjoint(words)


def parse(text: str) -> Node:
    """Element tree of a page; unclosed and stray tags are mended the way browsers do in the common cases."""
    root = Node("", "", False)
    stack, links, at, n = [root], 0, 0, len(text)
    deeper: dict[str, int] = {}  # open elements below the deepest level that gets nodes
    while at < n:
        m = _TOKEN.match(text, at)
        at = m.end()
        name = m.group(2)
        if name is None:
            data = m.group()
            if data[0] != "<" or data == "<":
                data = entities.unescape(data) if "&" in data else data
                if stack[-1].children and isinstance(stack[-1].children[-1], tuple) and stack[-1].children[-1][1] == bool(links):
                    data = stack[-1].children.pop()[0] + data
                stack[-1].children.append((data, bool(links)))
            continue
        name = name.lower()
        if m.group(1):
            if name == "a":
                links = max(0, links - 1)
            if deeper.get(name):
                deeper[name] -= 1
            elif any(x.name == name for x in stack[1:]):
                while stack.pop().name != name:
                    pass
                if name != "a" and name not in INLINE:
                    links = 0
            continue
        label, skip = _marks(name, m.group(3))
        if name in RAW and name != "head":
            end = _END[name].search(text, at)
            at = end.end() if end else n if name in ("script", "style") else at
            continue
        if name in VOID:
            if name in ("br", "hr"):
                stack[-1].children.append((" ", bool(links)))
            continue
        if name in INLINE and not skip:
            links += name == "a"
            continue
        if name in CLOSES:
            same = ("td", "th") if name in _CELLS else ("dt", "dd") if name in ("dt", "dd") else (name,)
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name in CLOSES[name]:
                    break
                if stack[i].name in same:
                    del stack[i:]
                    break
        elif name not in INLINE:
            for i in range(len(stack) - 1, 0, -1):  # a block ends an open paragraph
                if stack[i].name == "p":
                    del stack[i:]
                    links = 0
                    break
                if stack[i].name not in INLINE:
                    break
        if len(stack) >= DEEPEST and not skip:
            deeper[name] = deeper.get(name, 0) + 1
            stack[-1].children.append((" ", bool(links)))
            continue
        node = Node(name, label, skip or name == "head")
        stack[-1].children.append(node)
        stack.append(node)
    return root


# A rule is a dict: l label ("#" for text, "()" for a group), c parts, t fixed text or None for a slot, r repeated, o optional,
# s skipped, n characters of slots, a those in links.


def _rule(node) -> dict | None:
    if isinstance(node, tuple):
        text = " ".join(node[0].split())
        return {"l": "#", "t": text, "n": len(text), "a": len(text) * node[1]} if text else None
    parts = [] if node.skip else fold([r for r in map(_rule, node.children) if r])
    return {"l": node.label, "s": node.skip, "c": parts, "n": sum(p["n"] for p in parts), "a": sum(p["a"] for p in parts)}


def unify(a: dict, b: dict) -> dict:
    """The least rule that covers both; their labels are equal."""
    both = {"l": a["l"], "n": a["n"] + b["n"], "a": a["a"] + b["a"]}
    for flag in ("r", "o", "s"):
        if a.get(flag) or b.get(flag):
            both[flag] = True
    if a["l"] == "#":
        both["t"] = a["t"] if a["t"] == b["t"] else None
    else:
        both["c"] = align(a["c"], b["c"])
    return both


def _shorter(rules: list[dict]) -> list[dict]:
    return [r | {"o": True} for r in rules]


def align(a: list[dict], b: list[dict]) -> list[dict]:
    """Parts of two rules side by side along a longest common subsequence of labels, the rest optional."""
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i]["l"] == b[j]["l"] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < n and j < m:
        if a[i]["l"] == b[j]["l"]:
            out.append(unify(a[i], b[j]))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            out += _shorter(a[i : i + 1])
            i += 1
        else:
            out += _shorter(b[j : j + 1])
            j += 1
    return fold(out + _shorter(a[i:]) + _shorter(b[j:]))


def fold(parts: list[dict], longest: int = 3) -> list[dict]:
    """Neighbouring parts with equal labels become one repeated part, neighbouring equal groups one repeated group."""
    out: list[dict] = []
    for part in parts:
        if out and out[-1]["l"] == part["l"] and part["l"] != "()":
            out[-1] = unify(out[-1], part) | {"r": True}
        else:
            out.append(part)
        for size in range(2, longest + 1):  # a group just completed that repeats the one before
            if len(out) >= 2 * size and [p["l"] for p in out[-size:]] == [p["l"] for p in out[-2 * size : -size]]:
                group = [unify(x, y) for x, y in zip(out[-2 * size : -size], out[-size:])]
                out[-2 * size :] = [{"l": "()", "c": group, "r": True, "n": sum(g["n"] for g in group), "a": sum(g["a"] for g in group)}]
                break
            if len(out) > size and out[-size - 1]["l"] == "()" and [p["l"] for p in out[-size:]] == [p["l"] for p in out[-size - 1]["c"]]:
                group = [unify(x, y) for x, y in zip(out[-size - 1]["c"], out[-size:])]
                out[-size - 1 :] = [{"l": "()", "c": group, "r": True, "n": sum(g["n"] for g in group), "a": sum(g["a"] for g in group)}]
                break
    return out


def infer(pages: list[str]) -> dict:
    """The wrapper of some pages: rule, number of pages and the path of labels to the article."""
    rule = None
    for page in pages:
        own = _rule(parse(page))
        rule = own if rule is None else unify(rule, own)
    rule = rule or {"l": "", "c": [], "n": 0, "a": 0}
    path, named = article_path(rule, len(pages))
    fixed = [] if named or len(pages) < 3 else sorted(set(_fixed(rule)))
    return {"path": path, "named": named, "fixed": fixed}


def _elements(rule: dict) -> Iterator[dict]:
    for part in rule.get("c", ()):
        if part["l"] == "()":
            yield from _elements(part)
        elif part["l"] != "#":
            yield part


def _fixed(rule: dict) -> Iterator[str]:
    for part in rule.get("c", ()):
        if part["l"] == "#":
            if part["t"] is not None and not part.get("o"):
                yield part["t"]
        else:
            yield from _fixed(part)


def _varying(rule: dict, pages: int) -> float:
    """Characters in slots outside links; with one page every text is a slot."""
    if rule["l"] == "#":
        return 0 if rule["t"] is not None and pages > 1 and not rule.get("o") else rule["n"] - rule["a"]
    return 0 if rule.get("s") else sum(_varying(p, pages) for p in rule["c"])


def article_path(rule: dict, pages: int) -> tuple[list[str], bool]:
    """(labels from the root to the least element with all that varies, whether elements say that they are the article)."""
    if any(r["n"] for name in NAMES for r in _named(rule, name)):
        return [], True
    path, total = [], _varying(rule, pages)
    while total:
        # go down while one element holds all of what varies
        inner = max(_elements(rule), key=lambda r: _varying(r, pages), default=None)
        if inner is None or inner.get("r") or _varying(inner, pages) < total:
            break
        rule, path = inner, [*path, inner["l"]]
    return path, False


def _named(rule: dict, name: str) -> Iterator[dict]:
    for part in _elements(rule):
        if not part.get("s"):
            if re.split(r"[.#@]", part["l"])[0] == name:
                yield part
            else:
                yield from _named(part, name)


def _articles(node: Node, name: str) -> Iterator[Node]:
    """The outermost elements of a name, in page order."""
    for child in node.children:
        if isinstance(child, Node) and not child.skip:
            if child.name == name:
                yield child
            else:
                yield from _articles(child, name)


def _blocks(node: Node, fixed: frozenset[str]) -> Iterator[str]:
    """Texts between block borders, in page order."""
    pieces: list[str] = []

    def walk(x) -> Iterator[str]:
        for child in x.children:
            if isinstance(child, tuple):
                if not fixed or " ".join(child[0].split()) not in fixed:
                    pieces.append(child[0])
            elif not child.skip:
                inline = child.name in INLINE or child.name in _CELLS
                if inline:
                    pieces.append(" ")
                else:
                    yield from flush()
                yield from walk(child)
                if inline:
                    pieces.append(" ")
                else:
                    yield from flush()

    def flush() -> Iterator[str]:
        text = " ".join("".join(pieces).split())
        pieces.clear()
        if text:
            yield text

    yield from walk(node)
    yield from flush()


def extract(page: str, wrapper: dict | None) -> str:
    """The article of a page, blocks joined by an empty line."""
    root = parse(page)
    for w in (wrapper, None):
        if w is None:
            rule = _rule(root) or {"l": "", "c": [], "n": 0, "a": 0}
            path, named = article_path(rule, 1)
            w = {"path": path, "named": named, "fixed": []}
        level = [root]
        for label in w["path"]:
            level = [c for x in level for c in x.children if isinstance(c, Node) and c.label == label and not c.skip]
        for part in [list(_articles(root, name)) for name in NAMES] if w["named"] else [level]:
            found = "\n\n".join(b for x in part for b in _blocks(x, frozenset(w["fixed"])))
            if found:
                return found
    return ""


def host_of(url) -> Column:
    return F.coalesce(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1), F.lit(""))


def _infer_host(pages: pd.DataFrame) -> pd.DataFrame:
    ordered = pages.sort_values(["page_id", "html"], na_position="last")
    return pd.DataFrame({"host": [pages["host"].iloc[0]], "wrapper": [json.dumps(infer([h for h in ordered["html"] if h]))]})


def host_wrappers(pages: DataFrame, per_host: int = 6) -> DataFrame:
    """(host, wrapper) from at most ``per_host`` pages of each host, chosen by the hash of their id."""
    seeded = pages.where("html IS NOT NULL").select("page_id", host_of(F.col("url")).alias("host"), F.xxhash64("page_id", "url").alias("seed"))
    rank = F.row_number().over(Window.partitionBy("host").orderBy("seed", "page_id"))
    chosen = stash(seeded.withColumn("nth", rank).where(F.col("nth") <= per_host).select("host", "page_id", "seed"), "sample")
    sample = pages.select("page_id", "html", host_of(F.col("url")).alias("host"), F.xxhash64("page_id", "url").alias("seed")).join(chosen, ["host", "page_id", "seed"])
    return stash(sample.dropDuplicates(["host", "page_id", "seed"]).select("host", "page_id", "html").groupBy("host").applyInPandas(_infer_host, "host string, wrapper string"), "wrappers")


def _extractor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, dict] = {}
    for batch in slices(batches, "html"):
        texts = []
        for page, wrapper in zip(batch.column("html").to_pylist(), batch.column("wrapper").to_pylist()):
            if wrapper is not None and wrapper not in known:
                known = known if len(known) < 1000 else {}
                known[wrapper] = json.loads(wrapper)
            texts.append(extract(page or "", known.get(wrapper)))
        yield pa.record_batch(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            names=["page_id", "url", "text", "n_chars"],
        )


def main_text(pages: DataFrame, per_host: int = 6) -> DataFrame:
    """Per page: page_id, url, text, n_chars (code points).

    A null or empty html has the empty text. Pages without a host in their url share one wrapper. Rows alike are read alike, null ids
    and urls are returned as they are, other columns are not read; an empty table gives no rows.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    wrappers = host_wrappers(rows, per_host)
    joined = rows.withColumn("host", host_of(F.col("url"))).join(wrappers, "host", "left").select("page_id", "url", "html", "wrapper")
    return joined.mapInArrow(_extractor, "page_id long, url string, text string, n_chars long")
