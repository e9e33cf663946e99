"""Answers as blocks and inline runs, and the embedder that stands in for a model where there is none."""

from __future__ import annotations

import hashlib
import json
import math
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType

from .text import CITED, day_month_year

INLINE = re.compile(rf"{CITED}|\*\*(?P<bold>.+?)\*\*|\*(?P<star>.+?)\*|_(?P<line>.+?)_|\[(?P<label>[^\[\]]*)\]\((?P<url>[^()]*)\)")
LINES = [("heading", re.compile(r"#{1,6}\s+(.*)$")), ("bullet-list", re.compile(r"[-*•]\s+(.*)$")), ("numbered-list", re.compile(r"\d+\.\s+(.*)$"))]


def inline(text: str) -> list[dict]:
    """Runs of text, citations, bold, italic and links to the web; what has none of these shapes is text."""
    out, last = [], 0
    for m in INLINE.finditer(text):
        if m.start() > last:
            out.append({"kind": "text", "value": text[last : m.start()]})
        italic = m["star"] if m["star"] is not None else m["line"]
        if m[1] is not None:
            out.append({"kind": "citation", "indices": [int(x) for x in m[1].split(",")]})
        elif m["bold"] is not None:
            out.append({"kind": "bold", "children": inline(m["bold"])})
        elif italic is not None:
            out.append({"kind": "italic", "children": inline(italic)})
        elif re.match(r"https?://", m["url"], re.I):
            out.append({"kind": "link", "label": m["label"], "url": m["url"]})
        else:
            out.append({"kind": "text", "value": m[0]})
        last = m.end()
    return out + ([{"kind": "text", "value": text[last:]}] if last < len(text) else [])


def blocks(paragraph: str) -> list[dict]:
    """Headings, lists and runs of other lines; neighbouring items of one kind make one list."""
    out: list[dict] = []
    for line in filter(None, map(str.strip, paragraph.split("\n"))):
        kind, text = next(((k, m[1]) for k, p in LINES if (m := p.match(line))), ("paragraph", line))
        same = bool(out) and out[-1]["kind"] == kind != "heading"
        if kind.endswith("list"):
            out[-1]["items"].append(text) if same else out.append({"kind": kind, "items": [text]})
        elif same:
            out[-1]["text"] += " " + text
        else:
            out.append({"kind": kind, "text": text})
    return out


@F.pandas_udf(StringType())
def inline_json(text: pd.Series) -> pd.Series:
    return text.map(lambda t: json.dumps(inline(t), ensure_ascii=False), na_action="ignore")


@F.pandas_udf(StringType())
def blocks_json(text: pd.Series) -> pd.Series:
    return text.map(lambda t: json.dumps(blocks(t), ensure_ascii=False), na_action="ignore")


def embedder(size: int, most: int | None = None):
    """A column function text -> unit vector of ``size`` numbers from hashes of the text, the same everywhere; texts of more than ``most`` characters
    are an error, never cut."""

    def vector(text: str) -> list[float]:
        if most is not None and len(text) > most:
            raise ValueError(f"a text of {len(text)} characters, above {most}")
        raw = b"".join(hashlib.sha256(text.encode() + k.to_bytes(4, "big")).digest() for k in range(-(-size // 4)))
        values = [int.from_bytes(raw[8 * i : 8 * i + 8], "big") / float(2**64 - 1) * 2 - 1 for i in range(size)]
        norm = math.sqrt(sum(v * v for v in values)) or 1.0
        return [v / norm for v in values]

    @F.pandas_udf(ArrayType(DoubleType()))
    def embed(text: pd.Series) -> pd.Series:
        return text.map(vector, na_action="ignore")

    return embed


def stub_answer(contexts: Column) -> Column:
    """What a generator without a model says: it cites the first passages, if there are any."""
    cited = F.when(contexts == 1, "[1]").otherwise("[1, 2]")
    return F.when(contexts <= 0, "Stub answer. No context was retrieved for this question, so the sources do not cover it.").otherwise(F.concat(F.lit("Stub answer. The retrieved context addresses this question "), cited, F.lit(".")))


def freshness_label(band: Column, age_hours: Column, oldest: Column) -> Column:
    """What a reader is told of when sources were checked; null where nothing can be said."""
    days = F.greatest(F.lit(1), F.floor(F.coalesce(age_hours, F.lit(0.0)) / 24))
    recent = F.concat(F.lit("Sources checked "), days.cast("string"), F.when(days == 1, " day ago").otherwise(" days ago"))
    return F.when(band == "current", "Sources checked today").when(band == "recent", recent).when((band == "stale") & oldest.isNotNull(), F.concat(F.lit("Sources last checked "), day_month_year(oldest)))


def broken_label(broken: Column, total: Column, oldest_success: Column, any_never: Column) -> Column:
    """What a reader is told of sources that fail: since when, unless one never worked; null if none fails."""
    said = F.concat(broken.cast("string"), F.lit(" of "), total.cast("string"), F.when(total == 1, " source").otherwise(" sources"), F.lit(" not reachable"))
    since = F.when(~any_never & oldest_success.isNotNull(), F.concat(F.lit(" since "), day_month_year(oldest_success))).otherwise("")
    return F.when(broken > 0, F.concat(said, since))
