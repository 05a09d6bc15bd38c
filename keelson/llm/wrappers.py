"""HTML extraction by wrappers: union-free regular expressions inferred for each host.

A wrapper describes the pages of a host: elements in order, each required,
optional (?) or repeated (+, *), groups of elements that repeat together, and
text slots.  Inference starts with one page, folds repeats among siblings, and
aligns the next page's token stream with the expression so far: where both
agree, slots are merged (a slot whose text differs varies); what only one has
becomes optional; equal neighbours become a repeated group.  Expressions align
with expressions in the same way, so tasks fold their own pages first and only
partial wrappers are shuffled; a host that holds a third of all pages sends at
most one row a task.

A host's wrapper then says of each of its slots whether it is article, and pages
are cut by that alone.  Evidence, in this order:

* kind: slots inside nav, footer, aside, form and other elements that never hold
  an article, or in hidden ones, are furniture;
* place: if the wrapper has article or main elements, the article is below the
  outermost, or below inner ones that hold nearly all of its text; pages of the
  host without them fall back to their other slots;
* variation: a slot with one text on half the pages or more (three at least),
  while others vary, is template (but an article's title); so are lists made of links outside the article;
* name: what is still open, and stands in an element whose class or id calls it a
  menu, notice, advert or reader comment, is left out.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.llm.html_blocks import ROOT_TAGS, TEXT, Node, blocks, parse
from keelson.llm.link_trust import host_of
from keelson.llm.scratch import materialize, small_batches

GROUP = "()"
#: Pages, and share of the pages, that must show one and the same text before a slot counts as template.
TEMPLATE_PAGES = 3
TEMPLATE_SHARE = 0.5
#: Inner article elements with so much of the text of the outer one replace it.
INNER_SHARE = 0.8
LINK_SHARE = 0.6
SALTS = 16
HOSTS_IN_MEMORY = 5000

# A wrapper node is a list: [sig, furniture, least, many, children, slot]; slot is
# None or [pages, hash of the one text or None if it varies, characters, characters in links,
# whether a page has several texts there].
# The root's slot counts the pages.
SIG, FURNITURE, LEAST, MANY, CHILDREN, SLOT = range(6)


def _lift(node: Node) -> list:
    if node.sig == TEXT:
        return [TEXT, 0, 1, False, [], [1, xxhash.xxh32_intdigest(node.text.encode("utf-8", "replace")), len(node.text), node.link_chars, False]]
    return [node.sig, node.furniture, 1, False, _fold([_lift(c) for c in node.children]), None if node.sig else [1, None, 0, 0, False]]


def _same(a: list, b: list) -> bool:
    return a[SIG] == b[SIG] and (a[SIG] != GROUP or [c[SIG] for c in a[CHILDREN]] == [c[SIG] for c in b[CHILDREN]])


def _merge(a: list, b: list, one_page: bool) -> list:
    """One node for two aligned ones; ``one_page``: they are repeats on a page, not the same place of two pages."""
    slot = a[SLOT] or b[SLOT]
    if a[SLOT] and b[SLOT]:
        if one_page:  # the texts of repeats in their order: a list that never changes stays one text
            pages, text, mixed = max(a[SLOT][0], b[SLOT][0]), a[SLOT][1], a[SLOT][4] or b[SLOT][4]
            if a[SLOT][1] != b[SLOT][1]:
                text, mixed = None if None in (a[SLOT][1], b[SLOT][1]) else xxhash.xxh32_intdigest(f"{a[SLOT][1]} {b[SLOT][1]}"), True
        else:
            pages, text, mixed = a[SLOT][0] + b[SLOT][0], a[SLOT][1] if a[SLOT][1] == b[SLOT][1] else None, a[SLOT][4] or b[SLOT][4]
        slot = [pages, text, a[SLOT][2] + b[SLOT][2], a[SLOT][3] + b[SLOT][3], mixed]
    children = [_merge(x, y, one_page) for x, y in zip(a[CHILDREN], b[CHILDREN], strict=True)] if a[SIG] == GROUP else _align(a[CHILDREN], b[CHILDREN], one_page)
    return [a[SIG], min(a[FURNITURE], b[FURNITURE]), min(a[LEAST], b[LEAST]), a[MANY] or b[MANY], children, slot]


def _fold(nodes: list, one_page: bool = True) -> list:
    """Runs of equal siblings, then of equal groups of siblings, shortest first, as repeated nodes."""
    out: list = []
    for node in nodes:
        if out and _same(out[-1], node):
            out[-1] = _merge(out[-1], node, one_page)
            out[-1][MANY], out[-1][LEAST] = True, max(out[-1][LEAST], node[LEAST])
        else:
            out.append(node)
    i = 0
    while i < len(out):
        period = 0
        if out[i][SIG] != GROUP:
            for j in range(i + 2, (len(out) + i) // 2 + 1):  # a group begins again where its first element does
                if out[j][SIG] == GROUP:
                    break
                if _same(out[i], out[j]) and all(x[SIG] != GROUP and _same(x, y) for x, y in zip(out[i:j], out[j : 2 * j - i], strict=True)):
                    period = j - i
                    break
        if period:
            first, end = out[i : i + period], i + period
            group = [GROUP, 0, 1, True, first, None]
            while end + period <= len(out) and all(map(_same, first, out[end : end + period])):
                group[CHILDREN] = [_merge(x, y, one_page) for x, y in zip(group[CHILDREN], out[end : end + period], strict=True)]
                end += period
            out[i:end] = [group]
        i += 1
    return out


def _matches(a: list, b: list) -> list[tuple[int, int]]:
    """Places of two lists that are aligned, rising in both: their common ends, and between
    them the most of equal elements of equal count that don't cross.  In n log n steps."""
    low, high = 0, 0
    while low < min(len(a), len(b)) and a[low] == b[low]:
        low += 1
    while high < min(len(a), len(b)) - low and a[-1 - high] == b[-1 - high]:
        high += 1
    seen: Counter = Counter()
    at = {}
    for i in range(low, len(a) - high):
        at[a[i], seen[a[i]]] = i
        seen[a[i]] += 1
    seen.clear()
    met = []
    for j in range(low, len(b) - high):
        if (i := at.get((b[j], seen[b[j]]))) is not None:
            met.append((i, j))
        seen[b[j]] += 1
    # the longest rising run of i, by patience sorting
    tops: list[int] = []
    ends: list[int] = []
    before: list[int] = []
    for k, (i, _) in enumerate(met):
        pile = bisect_left(tops, i)
        before.append(ends[pile - 1] if pile else -1)
        tops[pile : pile + 1], ends[pile : pile + 1] = [i], [k]
    middle, k = [], ends[-1] if ends else -1
    while k >= 0:
        middle.append(met[k])
        k = before[k]
    return [(k, k) for k in range(low)] + middle[::-1] + [(len(a) - k, len(b) - k) for k in range(high, 0, -1)]


def _align(a: list, b: list, one_page: bool = False) -> list:
    """The children lists of two aligned elements as one: what both have is merged, the rest is optional."""

    def optional(nodes: list) -> list:
        return [[x[SIG], x[FURNITURE], 0, *x[MANY:]] for x in nodes]

    names = [[(x[SIG], *(c[SIG] for c in x[CHILDREN])) if x[SIG] == GROUP else x[SIG] for x in side] for side in (a, b)]
    if names[0] == names[1]:
        return [_merge(x, y, one_page) for x, y in zip(a, b, strict=True)]
    out, i, j = [], 0, 0
    for x, y in _matches(*names):
        out += optional(a[i:x]) + optional(b[j:y])
        out.append(_merge(a[x], b[y], one_page))
        i, j = x + 1, y + 1
    return _fold(out + optional(a[i:]) + optional(b[j:]), one_page)


def infer(page: str | None) -> list:
    """The wrapper of one page."""
    return _lift(parse(page))


def combine(a: list, b: list) -> list:
    """The wrapper of the pages of two wrappers."""
    return _merge(a, b, False)


def expression(wrapper: list) -> str:
    """A wrapper as a regular expression, for people."""

    def show(node: list) -> str:
        mark = {(1, False): "", (0, False): "?", (1, True): "+", (0, True): "*"}[node[LEAST], node[MANY]]
        if node[SIG] == TEXT:
            return ("#" if node[SLOT][1] is None or node[SLOT][4] else "'text'") + mark
        inner = " ".join(map(show, node[CHILDREN]))
        if node[SIG] == GROUP:
            return f"({inner}){mark}"
        return f"<{node[SIG]}>{mark}" + (f"({inner})" if inner else "")

    return " ".join(map(show, wrapper[CHILDREN]))


HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
LISTS = frozenset(("ul", "ol", "table", "div", "section", "p", "td"))


def _tag(sig: str) -> str:
    return re.split(r"[.#!]", sig, maxsplit=1)[0]


@dataclass
class _Slot:
    """What the wrapper knows about the text at a path."""

    pages: int = 0
    text: int | None = None
    chars: int = 0
    links: int = 0
    furniture: int = 0
    known: bool = False


def _under(path: str, roots: Iterable[str]) -> bool:
    return any(path == r or path.startswith(r + "\n") for r in roots)


def rules(wrapper: list) -> dict:
    """{"roots": [paths], "drop": [paths]}: where the article is, and the slots that aren't
    part of it; paths of signatures joined by newlines."""
    slots: dict[str, _Slot] = {}
    lists: dict[str, list[int]] = {}
    found_roots: dict[str, None] = {}

    def walk(node: list, path: tuple, furniture: int) -> tuple[int, int]:
        furniture = max(furniture, node[FURNITURE])
        if node[SIG] == TEXT:
            s = slots.setdefault("\n".join(path), _Slot())
            s.text = node[SLOT][1] if not s.known or s.text == node[SLOT][1] else None
            s.pages, s.chars, s.links, s.known = min(wrapper[SLOT][0], s.pages + node[SLOT][0]), s.chars + node[SLOT][2], s.links + node[SLOT][3], True
            s.furniture = max(s.furniture, furniture)
            return node[SLOT][2], node[SLOT][3]
        below = path if node[SIG] in ("", GROUP) else (*path, node[SIG])
        if below != path and not furniture and _tag(node[SIG]) in ROOT_TAGS:
            found_roots["\n".join(below)] = None
        chars = links = 0
        for c in node[CHILDREN]:
            x, y = walk(c, below, furniture)
            chars, links = chars + x, links + y
        if chars and not furniture and below != path and _tag(node[SIG]) in LISTS:
            known = lists.setdefault("\n".join(below), [0, 0])
            known[0] += chars
            known[1] += links
        return chars, links

    walk(wrapper, (), 0)

    def text_below(roots: Iterable[str]) -> int:
        roots = list(roots)
        return sum(s.chars for p, s in slots.items() if not s.furniture and _under(p, roots))

    def outermost(paths: Iterable[str]) -> list[str]:
        out: list[str] = []
        for p in sorted(paths):
            if not _under(p, out):
                out.append(p)
        return out

    roots, settled = outermost(p for p in found_roots if text_below([p])), []
    while roots:
        root = roots.pop()
        inner = outermost(p for p in found_roots if p != root and _under(p, [root]))
        if inner and text_below(inner) >= INNER_SHARE * text_below([root]):
            roots += inner
        else:
            settled.append(root)

    heavy = [p for p, (chars, links) in lists.items() if links > LINK_SHARE * chars and not _under(p, settled)]
    # where nothing but furniture and links varies, the host's pages are copies and no text can be told to be template
    varying = [p for p, s in slots.items() if s.text is None and not s.furniture and not _under(p, heavy)]
    varies = {inside: any(_under(p, settled) is inside for p in varying) for inside in (False, True)}
    pages_inside = max((s.pages for p, s in slots.items() if _under(p, settled)), default=0)
    drop = []
    for path, s in slots.items():
        inside = _under(path, settled)
        tags = [_tag(x) for x in path.split("\n")]
        of = pages_inside if inside else wrapper[SLOT][0]
        title = inside and tags[-1] == "h1"
        template = varies[inside] and not title and s.text is not None and s.pages >= max(TEMPLATE_PAGES, TEMPLATE_SHARE * of)
        page_header = "header" in tags and not (inside and tags[-1] in HEADINGS)
        if s.furniture or template or page_header or (not inside and _under(path, heavy)):
            drop.append(path)
    return {"roots": sorted(settled), "drop": sorted(drop)}


def extract(page: str | None, known: dict | None = None) -> str:
    """The text of a page that its host's wrapper calls article; without ``known`` all its text."""
    found = [("\n".join(path), node) for path, node in blocks(parse(page))]
    if known:
        drop, roots = set(known["drop"]), known["roots"]
        found = [x for x in found if x[0] not in drop]
        rooted = [x for x in found if _under(x[0], roots)]
        found = rooted or found
    return " ".join(node.text for _, node in found)


# ---------------------------------------------------------------- Spark


def _partial_wrappers(batches: Iterable[pa.RecordBatch]):
    """(host, html) to (host, salt, wrapper): a row for each host a task has seen."""
    held: dict[str, list] = {}
    salt = None

    def flush():
        rows = pa.record_batch([pa.array(list(held)), pa.array([salt] * len(held), pa.int32()), pa.array([json.dumps(w) for w in held.values()])], ["host", "salt", "wrapper"])
        held.clear()
        return rows

    for batch in batches:
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if salt is None:
                salt = xxhash.xxh32_intdigest((page or "").encode("utf-8", "replace")) % SALTS
            fresh = infer(page)
            held[host] = combine(held[host], fresh) if host in held else fresh
        if len(held) >= HOSTS_IN_MEMORY:
            yield flush()
    if held:
        yield flush()


def _fold_wrappers(keys: list[str]):
    def run(key, group):
        import pandas as pd

        whole = None
        for text in sorted(group["wrapper"]):
            fresh = json.loads(text)
            whole = fresh if whole is None else combine(whole, fresh)
        return pd.DataFrame([(*key, json.dumps(whole))], columns=[*keys, "wrapper"])

    return run


def _host_rules(batches: Iterable[pa.RecordBatch]):
    for batch in batches:
        yield pa.record_batch([batch.column(0), pa.array([json.dumps(rules(json.loads(w))) for w in batch.column(1).to_pylist()])], ["site", "rules"])


def infer_wrappers(pages: DataFrame, html_col: str = "html", host: Column | None = None) -> DataFrame:
    """(host, wrapper as JSON) for every host of ``pages``."""
    small_batches(pages.sparkSession)
    host = host_of(F.col("url").cast("string")) if host is None else host
    rows = pages.select(host.alias("host"), F.col(html_col).cast("string").alias("html"))
    partial = rows.mapInArrow(_partial_wrappers, "host string, salt int, wrapper string")
    salted = partial.groupBy("host", "salt").applyInPandas(_fold_wrappers(["host", "salt"]), "host string, salt int, wrapper string")
    return salted.groupBy("host").applyInPandas(_fold_wrappers(["host"]), "host string, wrapper string")


def _extracted(batches: Iterable[pa.RecordBatch]):
    parsed: dict[str | None, dict | None] = {None: None}
    for batch in batches:
        out = []
        for page, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if text not in parsed:
                if len(parsed) > 10_000:
                    parsed.clear()
                parsed[text] = None if text is None else json.loads(text)
            out.append(extract(page, parsed[text]))
        yield pa.record_batch([batch.column(0), pa.array(out, pa.string())], ["row", "text"])


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text) for every row of ``pages``.

    NULL and empty html, and pages without an article, have an empty text.  Pages
    whose url is NULL or has no host share the host ''.  Texts of any length are read
    whole, elements of any depth keep what holds them.  Rows with NULL ids and
    repeated rows stay; an empty table gives an empty result.  Other columns,
    whatever their names, are not read."""
    host = host_of(F.col(url_col).cast("string"))
    sites = infer_wrappers(pages, html_col, host).mapInArrow(_host_rules, "site string, rules string")
    sites = materialize(sites, "wrapper-rules")  # its size is known now, so Spark broadcasts it only if it is small
    rows = pages.select(F.struct(F.col(id_col).alias("id"), F.col(url_col).alias("url")).alias("row"), F.col(html_col).cast("string").alias("html"), host.alias("host"))
    joined = rows.join(sites, F.col("host") == F.col("site"), "left").select("row", "html", "rules")
    kinds = {c: pages.schema[c].dataType.simpleString() for c in (id_col, url_col)}
    found = joined.mapInArrow(_extracted, f"row struct<id:{kinds[id_col]},url:{kinds[url_col]}>, text string")
    return found.select("row.id", "row.url", "text")
