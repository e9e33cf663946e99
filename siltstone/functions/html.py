"""Pages as Markdown: the main part of a page, without what is around it.

The subset: headings, paragraphs, lists, links, emphasis, tables, code and line breaks; other tags give their text.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .text import MONTHS, SHORT_MONTHS

# Tags, and parts of an id or class, of what isn't content; tags without an end; where the main part may be.
NOISE_TAGS = ["script", "style", "nav", "header", "footer", "aside", "form"]
NOISE_NAMES = ["breadcrumb", "skip", "menu", "sidebar", "social", "share", "feedback", "pagination", "footer"]
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BLOCKS = {"p", "div", "section", "article", "main", "ul", "ol", "table", "blockquote", "pre", "body", "html", "dl", "tr"} | {f"h{i}" for i in range(1, 7)}


class _Tree(HTMLParser):
    """Nested (tag, attributes, children); a paragraph or item ends where the next begins."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root: tuple = ("", {}, [])
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        own = {"p": {"p"}, "li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}.get(tag, {"p"} if tag in BLOCKS else set())
        while len(self.open) > 1 and self.open[-1][0] in own:
            self.open.pop()
        node = (tag, {k: v or "" for k, v in attrs}, [])
        self.open[-1][2].append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_endtag(self, tag):
        if any(n[0] == tag for n in self.open[1:]):
            while self.open.pop()[0] != tag:
                pass

    def handle_data(self, data):
        self.open[-1][2].append(data)


def _walk(node):
    """All tags below a node, in their order."""
    stack = [iter(node[2])]
    while stack:
        child = next(stack[-1], None)
        if child is None:
            stack.pop()
        elif not isinstance(child, str):
            yield child
            stack.append(iter(child[2]))


def _main(root):
    """The first there is of: main, article, a main role, two classes of content, body."""
    tests = [
        lambda t, a: t == "main",
        lambda t, a: t == "article",
        lambda t, a: a.get("role") == "main",
        lambda t, a: "field--name-body" in a.get("class", "").split(),
        lambda t, a: "region-content" in a.get("class", "").split(),
        lambda t, a: t == "body",
    ]
    return next((n for test in tests for n in _walk(root) if test(n[0], n[1])), root)


def _noise(node) -> bool:
    names = f"{node[1].get('id', '')} {node[1].get('class', '')}".lower()
    return node[0] in NOISE_TAGS or any(k in names for k in NOISE_NAMES)


def _parts(node, depth: int):
    """A node's Markdown, as a generator that yields (child, depth) for each child that it needs and is sent its Markdown."""
    if isinstance(node, str):
        return re.sub(r"\s+", " ", node)
    tag, attrs, children = node
    children = [c for c in children if isinstance(c, str) or not _noise(c)]
    if tag in ("ul", "ol"):
        items = []
        for c in children:
            if not isinstance(c, str):
                items.append((yield c, depth + 1).strip())
        marks = [f"{i}. " if tag == "ol" else "- " for i in range(1, len(items) + 1)]
        return "\n" + "\n".join("  " * depth + m + x for m, x in zip(marks, items)) + "\n" + ("" if depth else "\n")
    if tag == "table":
        rows = []
        for n in _walk(node):
            if n[0] == "tr":
                cells = []
                for c in n[2]:
                    if not isinstance(c, str) and c[0] in ("td", "th"):
                        cells.append((yield c, depth).strip().replace("\n", " "))
                rows += [cells] if cells else []
        lines = ["| " + " | ".join(r) + " |" for r in rows]
        return "\n\n" + "\n".join([*lines[:1], *(["| " + " | ".join(["---"] * len(rows[0])) + " |"] if rows else []), *lines[1:]]) + "\n\n"
    inner = ""
    for c in children:
        inner += c if tag == "pre" and isinstance(c, str) else (yield c, depth)
    if tag == "pre":
        return "\n\n```\n" + inner.strip("\n") + "\n```\n\n"
    if re.fullmatch(r"h[1-6]|dt", tag):
        return "\n\n" + "#" * (2 if tag == "dt" else int(tag[1])) + " " + inner.strip() + "\n\n"
    if tag == "br":
        return "  \n"
    if tag == "hr":
        return "\n\n---\n\n"
    if tag in ("strong", "b", "em", "i", "code") and inner.strip():
        mark = {"strong": "**", "b": "**", "code": "`"}.get(tag, "*")
        return inner[: len(inner) - len(inner.lstrip())] + mark + inner.strip() + mark + inner[len(inner.rstrip()) :]
    if tag == "a" and inner.strip() and attrs.get("href"):
        return f"[{inner.strip()}]({attrs['href']})"
    return f"\n\n{inner.strip()}\n\n" if tag in BLOCKS else inner


def _render(node) -> str:
    """The Markdown of a tree of any depth."""
    open_, told = [_parts(node, 0)], None
    while open_:
        try:
            open_.append(_parts(*open_[-1].send(told)))
            told = None
        except StopIteration as end:
            open_.pop()
            told = end.value
    return told


def page_markdown(page: str) -> str:
    tree = _Tree()
    tree.feed(page)
    tree.close()
    text = re.sub(r"[ \t]+\n(?!\n)", lambda m: m[0] if m[0].startswith("  ") else "\n", _render(_main(tree.root)))
    lines = [x if x.lstrip().startswith(("-", "|")) or re.match(r"\s*\d+\. ", x) else x.strip() for x in text.split("\n")]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip() + "\n"


@F.pandas_udf(StringType())
def to_markdown(pages: pd.Series) -> pd.Series:
    """The main part of each page as Markdown; null for null."""
    return pages.map(page_markdown, na_action="ignore")


def title(page: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(page, r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))


def page_text(page: Column) -> Column:
    """All text of a page without its tags."""
    return F.regexp_replace(F.regexp_replace(page, r"(?s)<[^>]*>", " "), r"\s+", " ")


# How pages say when they were last changed.
REVIEWED = r"(?i)Last\s+Reviewed/Updated\s*:?\s*(\d{1,2}/\d{1,2}/\d{4})"
UPDATED = r"(?i)(?:Last\s+updated|Updated)\s*:?\s*([A-Za-z]+\.?\s+\d{1,2},\s*\d{4}|\d{1,2}/\d{1,2}/\d{4})"


def last_updated(text: Column) -> Column:
    """The day that a page says it was last changed: of the first pattern that gives one."""

    def day(found: Column) -> Column:
        numeric = F.try_to_date(F.when(found.rlike(r"^\d"), found), "M/d/yyyy")
        name = F.lower(F.regexp_extract(found, r"^([A-Za-z]{3})", 1))
        month = F.array_position(F.array(*(F.lit(m[:3].lower()) for m in MONTHS)), name)
        known = F.lower(F.regexp_extract(found, r"^([A-Za-z]+)", 1)).isin([m.lower() for m in MONTHS + SHORT_MONTHS])
        parts = F.concat_ws("-", F.regexp_extract(found, r"(\d{4})$", 1), month.cast("string"), F.regexp_extract(found, r"\s(\d{1,2}),", 1))
        return F.coalesce(numeric, F.try_to_date(F.when(known & (month > 0), parts), "yyyy-M-d"))

    found = lambda p: F.nullif(F.regexp_extract(text, p, 1), F.lit(""))
    return F.coalesce(day(found(REVIEWED)), day(found(UPDATED)))
