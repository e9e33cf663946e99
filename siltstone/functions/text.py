"""Text guards, redaction and presentation as column expressions. Regex classes are ASCII ones throughout."""

from __future__ import annotations

import hashlib
import hmac
import json
import re
import unicodedata
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

CITED = r"\[(\d+(?:\s*,\s*\d+)*)\]"
# Patterns of personal data and what stands in for them, in the order in which they are applied.
REDACTIONS = [
    (r"(?i)[a-z0-9._%+\-]+@[a-z0-9.\-]+\.[a-z]{2,}", "[redacted-email]"),
    (r"(?i)\bA[- ]?\d{7,9}\b", "[redacted-a-number]"),
    (r"\b\d{3}-\d{2}-\d{4}\b", "[redacted-ssn]"),
    (r"\+?\d{0,3}[-. ]?\(?\d{3}\)?[-. ]?\d{3}[-. ]?\d{4}\b", "[redacted-phone]"),
]
# Phrases that ask for advice.
ADVICE = ["should i", "should we", "which is better", "which one should", "which visa is best", "which status is best", "is it better to", "will i be approved", "my chances", "what would you do", "can you recommend", "would you recommend"]
# Lines of pages that carry no content.
BOILERPLATE = r"(?i)^(?:\s*|\[[^\]]*\]\([^)]*\)|(?:last\s+updated|last\s+reviewed/updated)\s*:?.*|skip\s+to\b.*|[-*_]{3,}|return to top|print|share)$"
# Names of months, and how pages shorten them.
MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]
SHORT_MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Sept", "Oct", "Nov", "Dec"]
# Numbers that are no figures, namely those of citations, forms, dates, addresses and numeric dates.
NOT_FIGURES = [
    r"\[\s*\d+(?:\s*,\s*\d+)*\s*\]",
    r"\b[A-Z]-\d+[A-Z]?\b",
    r"\b(?:" + "|".join(MONTHS) + r")\s+\d{1,2},?\s+\d{4}\b",
    r"\b(?:" + "|".join(SHORT_MONTHS) + r")\.?\s+\d{1,2},?\s+\d{4}\b",
    r"https?://\S+",
    r"\b\d{1,2}/\d{1,2}/\d{2}(?:\d{2})?\b",
]
FIGURE = r"(?:" + "|".join(NOT_FIGURES) + r")|(\d+(?:,\d{3})*)"
YEAR = r"^(?:19\d\d|20\d\d|2100)$"
# Headings of a list of sources.
SOURCE_LIST = r"(?i)\n\s*(?:\*\*)?(?:source\s*urls?|sources|references|citations?)(?:\*\*)?\s*:?\s*\n"
# Tokens of a changed line that are worth showing.
HIGHLIGHT = r"(?i)\d+[\s-]?(?:days?|months?|years?)\b|\$\d[\d,]*(?:\.\d+)?|\b(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?\s+\d{1,2},\s*\d{4}\b|\b(?:19|20)\d{2}\b|\bI-\d{2,4}[A-Z]?\b|\b(?:must|may|eligible|required|deadline|effective|extension)\b"
# Function words of questions, and words that name a topic.
STOP_WORDS = "a am an and are as at be been being but by can could did do does for from had has have how i if in is it its just me my no not of on or please shall should so some that the there this to was we were what when where which who why will with would you your".split()
ANCHORS = "f-1 f1 j-1 j1 m-1 m1 opt stem h-1b h1b i-20 i20 i-765 i765 i-983 i983 i-129 i129 sevis dso uscis ead cap-gap unemployment extension cap travel employer".split()
# Scripts that don't set words apart, by their code points.
RUN_ON = r"[\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{0E00}-\x{0E7F}]"
# Families of models, the first that a name holds.
MODEL_FAMILIES = ["nemotron", "gpt-oss", "gemma", "qwen", "glm", "deepseek", "minimax", "kimi", "mistral", "nomic"]
# What an answer claims to be (subjects), what it claims by it (predicates by label), and what denies it.
SUBJECTS = r"this\s+(?:answer|response|guidance|information|tool|site|is)|these\s+answers|i\s+am|i'm|we\s+are|we're|as\s+your|speaking\s+as"
PREDICATES = {
    "authoritative": r"\bauthoritative\b",
    "authorized_by": r"\bauthorized\s+by\b",
    "affiliated_with": r"\baffiliated\s+with\b",
    "on_behalf_of": r"\bon\s+behalf\s+of\b",
    "agency_guidance": r"\b(?:uscis|dhs|ice|sevp|government)\s+guidance\b",
    "agency_role": r"\b(?:uscis|dhs|ice|sevp)\s+(?:officer|official|tool|bot|representative|agency)\b",
    "legal_advice": r"\blegal\s+advice\b",
    "legal_opinion": r"\blegal\s+opinion\b",
    "attorney_persona": r"\byour\s+(?:[a-z]+\s+){0,2}(?:attorney|lawyer|counsel)\b",
    "official_guidance": r"\bofficial(?:ly)?\b(?=(?:\s+[A-Za-z][\w'-]*){0,3}\s+(?:guidance|advice|policy|position|statement|determination|ruling|interpretation)\b)",
    "official_self_claim": r"\b(?:(?:this\s+(?:answer|response|tool|site|information|guidance)|these\s+answers)\s+(?:is|are)|i\s+am|i'm|we\s+are|we're)\s+(?P<claim>official(?:ly)?)\b",
}
ROLES = {
    "agency_role": r"\bas\s+an?\s+(?:uscis|dhs|ice|sevp)\s+(?:officer|official|representative|employee|adjudicator)\b",
    "attorney_persona": r"\bas\s+an?\s+(?:lawyer|attorney|counsel)\b",
}
DENIALS = r"\bnot\b|n't\b|\bnever\b|\bno\b|\bunofficial\b|\bcannot\b|\bunable\b|\bnor\b|\bneither\b"
REDIRECT = r"(?i)\bdso\b|designated school official|licensed immigration attorney"


def cited(text: Column) -> Column:
    """Sorted distinct numbers in brackets like [1] or [1, 3]."""
    groups = F.regexp_extract_all(text, F.lit(CITED), F.lit(1))
    numbers = F.flatten(F.transform(groups, lambda g: F.transform(F.split(g, ","), lambda x: F.trim(x).cast("int"))))
    return F.array_sort(F.array_distinct(numbers))


def citation_reason(indices: Column, contexts: Column, response_type: Column) -> Column:
    """Why an answer's citations don't hold; null if they do. Only an answer must cite."""
    outside = F.exists(indices, lambda i: (i < 1) | (i > contexts))
    return F.when(outside, "citation_index_out_of_range").when((response_type == "answer") & (F.size(indices) == 0), "answer_missing_citation")


def hallucinated(indices: Column, contexts: Column) -> Column:
    return F.size(F.filter(indices, lambda i: (i < 1) | (i > contexts))).cast("long")


def unreferenced(indices: Column, contexts: Column) -> Column:
    return F.greatest(F.lit(0), contexts - F.size(F.filter(indices, lambda i: (i >= 1) & (i <= contexts)))).cast("long")


def fold_markup(text: Column) -> Column:
    """Full-width citation marks of other systems as [n]."""
    return F.regexp_replace(text, "【\\s*(\\d+)\\s*(?:†[^】]*)?】", "[$1]")


def strip_sources(text: Column) -> Column:
    """A text up to the first heading of a list of sources."""
    return F.when(text.rlike(SOURCE_LIST), F.regexp_replace(F.regexp_replace(text, SOURCE_LIST + r"[\s\S]*$", ""), r"\s+$", "")).otherwise(text)


def segments(text: Column) -> Column:
    """Runs of text and citations, which join to the text again: structs of value and whether it cites."""
    parts = F.split(F.regexp_replace(text, CITED, "\u0001[$1]\u0001"), "\u0001")
    return F.filter(F.transform(parts, lambda p: F.struct(p.alias("value"), p.rlike("^" + CITED + "$").alias("cites"))), lambda p: F.length(p["value"]) > 0)


def redact(text: Column) -> Column:
    for pattern, name in REDACTIONS:
        text = F.regexp_replace(text, pattern, name)
    return text


def redact_question(body: Column) -> Column:
    """A JSON object with its ``question`` redacted and all other values as they were; any other body, or question, unchanged. Fields come in the order of
    their names. A body that has a field twice is read by Python, which takes the last."""
    whole = F.try_parse_json(body)
    question = F.try_variant_get(whole, "$.question", "variant")
    plain = redact(F.try_variant_get(whole, "$.question", "string"))
    fields = F.map_entries(F.try_variant_get(whole, "$", "map<string,variant>"))
    said = F.try_variant_get(F.parse_json(F.to_json(F.struct(plain.alias("q")))), "$.q", "variant")
    redacted = F.transform(fields, lambda f: F.struct(f["key"].alias("key"), F.when(f["key"] == "question", said).otherwise(f["value"]).alias("value")))
    other = F.when(whole.isNull() & body.rlike(r"^\s*\{"), _redact_question(F.when(whole.isNull() & body.rlike(r"^\s*\{"), body)))
    return F.when(F.schema_of_variant(question) == "STRING", F.to_json(F.map_from_entries(redacted))).otherwise(F.coalesce(other, body))


@F.pandas_udf(StringType())
def _redact_question(body: pd.Series) -> pd.Series:
    patterns = [(re.compile(p, re.ASCII), name) for p, name in REDACTIONS]

    def one(raw):
        try:
            fields = json.loads(raw)
        except (TypeError, ValueError, RecursionError):
            return raw
        if not isinstance(fields, dict) or not isinstance(fields.get("question"), str):
            return raw
        for p, name in patterns:
            fields["question"] = p.sub(name, fields["question"])
        return json.dumps(fields, ensure_ascii=False)

    return body.map(one, na_action="ignore")


@F.pandas_udf(StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def nfkc(text: Column) -> Column:
    """A text by NFKC; only texts beyond ASCII go to Python."""
    return F.coalesce(_nfkc(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)


def session_hash(value: Column, secret: str) -> Column:
    """HMAC-SHA256 in hexadecimal, as two native hashes."""
    key = hashlib.sha256(secret.encode()).digest() if len(secret) > 64 else secret.encode()
    pads = [bytes(b ^ p for b in key.ljust(64, b"\0")) for p in (0x36, 0x5C)]
    inner, outer = (F.unhex(F.lit(p.hex())) for p in pads)
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, value.cast("binary")), 256))), 256)


def session_or_hash(header: Column, peer: Column, secret: str) -> Column:
    """A forwarded session if it looks like a hash, else that of the peer."""
    return F.when(header.rlike("^[0-9a-f]{64}$"), header).otherwise(session_hash(peer, secret))


def session_hash_of(value: str, secret: str) -> str:
    return hmac.new(secret.encode(), value.encode(), hashlib.sha256).hexdigest()


def asks_advice(question: Column) -> Column:
    return F.exists(F.array(*map(F.lit, ADVICE)), lambda p: F.contains(F.lower(question), p))


def figures(text: Column) -> Column:
    """Sorted distinct numbers, without those of citations, forms, dates and addresses, and without years. One pass: what is no
    figure is matched before a figure could begin in it."""
    found = F.transform(F.regexp_extract_all(text, F.lit(FIGURE), F.lit(1)), lambda x: F.replace(x, F.lit(","), F.lit("")))
    return F.array_sort(F.array_distinct(F.filter(found, lambda x: (F.length(x) > 0) & ~x.rlike(YEAR))))


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, however often ``f`` names it."""
    return F.transform(F.array(value), f)[0]


def sentence_parts(text: Column) -> Column:
    """Sentences with the white space after each: structs of sentence and separator, which join to the text again. A shortened
    month's full stop before a day ends no sentence."""
    marked = F.regexp_replace(text, r"([.!?])(\s+)", "$1\u0001$2\u0002")
    whole = F.regexp_replace(marked, r"\b((?:" + "|".join(SHORT_MONTHS) + r")\.)\x01(\s+)\x02(\d)", "$1$2$3")
    return F.transform(F.split(whole, "\u0002"), lambda p: let(F.split(p, "\u0001"), lambda s: F.struct(s[0].alias("sentence"), F.coalesce(F.get(s, F.lit(1)), F.lit("")).alias("separator"))))


def date_pattern(day: Column) -> Column:
    """A pattern of all ways in which a text may state a day, by the month's name or a short form of it."""
    of = lambda names: F.element_at(F.array(*map(F.lit, names)), F.month(day))
    short = of([m[:3] for m in MONTHS[:8]] + ["Sep|Sept"] + [m[:3] for m in MONTHS[9:]])
    return F.concat(F.lit(r"\b(?:"), of(MONTHS), F.lit("|"), short, F.lit(r")\.?\s+0?"), F.dayofmonth(day).cast("string"), F.lit(r"\b,?\s+"), F.year(day).cast("string"), F.lit(r"\b"))


def content_words(question: Column) -> Column:
    """Words without function words and without the punctuation and symbols around them, in small letters."""
    bare = F.transform(F.split(question, r"(?U)\s+"), lambda w: F.lower(F.regexp_replace(w, r"^[\p{P}\p{S}]+|[\p{P}\p{S}]+$", "")))
    return F.filter(bare, lambda w: (F.length(w) > 0) & ~w.isin(STOP_WORDS))


def too_vague(question: Column, words: int = 3, chars: int = 10) -> Column:
    """Fewer than ``words`` content words, unless two or more name a topic; in scripts that don't set words apart, fewer than
    ``chars`` characters that are neither space nor punctuation."""
    own = content_words(question)
    named = (F.size(own) >= 2) & F.exists(own, lambda w: w.isin(ANCHORS))
    return F.when(question.rlike(RUN_ON), F.length(F.regexp_replace(question, r"(?U)[\s\p{P}\p{S}]", "")) < chars).otherwise((F.size(own) < words) & ~named)


def other_letter(text: Column) -> Column:
    """Whether a text has a letter of a script other than Latin."""
    return text.rlike(r"[\p{L}&&\P{IsLatin}]")


def other_script(question: Column) -> Column:
    """Whether it has such a letter, and no content word with a Latin one."""
    return other_letter(question) & ~F.exists(content_words(question), lambda w: w.rlike(r"\p{IsLatin}"))


def leak_class(text: Column, rules: list[str], formats: list[str], layouts: list[str], versions: list[str]) -> Column:
    """Which of a prompt's parts a text repeats, the first of: rule_text, context_format, version_hash; null if none.

    ``rules`` and ``formats`` are spans of the prompt, compared without emphasis, case and kinds of quotes and spaces; ``layouts``
    are patterns of the text as it is, ``versions`` the prompts' hashes.
    """

    def plain(c: Column) -> Column:
        return F.lower(F.regexp_replace(F.regexp_replace(F.translate(c, "‘’“”", "\'\'\"\""), r"[*_`#]", ""), r"(?U)\s+", " "))

    whole = plain(nfkc(text))
    held = lambda spans: [F.contains(whole, plain(F.lit(s))) for s in spans]
    either = lambda tests: reduce(Column.__or__, tests, F.lit(False))
    return F.when(either(held(rules)), "rule_text").when(either(held(formats) + [text.rlike(p) for p in layouts]), "context_format").when(either(held(versions)), "version_hash")


@F.pandas_udf(StringType())
def authority_claim(text: pd.Series) -> pd.Series:
    """By what an answer claims to speak for an authority; null if it doesn't.

    A sentence is read from left to right: a subject opens a claim, a denial closes it, and a predicate while it is open makes it.
    """
    marks = re.compile(rf"(?P<subject>\b(?:{SUBJECTS})\b)|(?P<denial>{DENIALS})", re.I)
    predicates = [(k, re.compile(p, re.I)) for k, p in PREDICATES.items()]
    roles = [(k, re.compile(p, re.I)) for k, p in ROLES.items()]
    denial = re.compile(DENIALS, re.I)

    def sentence(s: str) -> str | None:
        events = [(m.start(), 1 if m["subject"] else 0, "") for m in marks.finditer(s)]
        events += [(m.start("claim") if k == "official_self_claim" else m.start(), 2, k) for k, p in predicates for m in p.finditer(s)]
        subject = None
        for at, kind, label in sorted(events, key=lambda e: (e[0], -e[1])):
            if kind == 2 and subject is not None and at > subject:
                return label
            if kind == 1 and subject is None:
                subject = at
            if kind == 0:
                subject = None
        for label, p in roles:
            if (m := p.search(s)) and not denial.search(m[0]):
                return label
        return None

    def one(t: str) -> str | None:
        return next((c for s in re.split(r"(?<=[.!?])\s+", t.strip()) if s and (c := sentence(s))), None)

    return text.map(one, na_action="ignore")


def has_redirect(text: Column) -> Column:
    return text.rlike(REDIRECT)


def advice_verdict(reply: Column) -> Column:
    """The boolean ``advice`` of the JSON object in a model's reply; null for anything else."""
    whole = F.try_parse_json(F.regexp_extract(reply, r"(?s)\{.*\}", 0))
    return F.when(F.schema_of_variant(F.try_variant_get(whole, "$.advice", "variant")) == "BOOLEAN", F.try_variant_get(whole, "$.advice", "boolean"))


def model_family(model: Column) -> Column:
    """The first family that a model's name holds; an error for a name of none."""
    out = None
    for family in MODEL_FAMILIES:
        hit = F.contains(F.lower(model), F.lit(family))
        out = F.when(hit, family) if out is None else out.when(hit, family)
    return out.otherwise(F.raise_error(F.concat(F.lit("a model of no known family: "), F.coalesce(model, F.lit("null"))))).cast("string")


def snippet(text: Column, most: int = 240) -> Column:
    """White space folded; a longer text is cut before the word that ``most`` characters end in."""

    def cut(flat: Column) -> Column:
        return F.when(F.length(flat) <= most, flat).otherwise(F.concat(F.regexp_replace(F.left(flat, F.lit(most)), r"\s\S*$", ""), F.lit("...")))

    return let(F.trim(F.regexp_replace(text, r"\s+", " ")), cut)


def paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"\n\s*\n"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: F.length(p) > 0)


def without_notice(paragraphs_: Column) -> Column:
    """Paragraphs without a last one that repeats a notice on a rule's force."""
    last = F.try_element_at(paragraphs_, F.lit(-1))
    notice = last.rlike(r"^(?:One|Some) of the sources above describes? a rule that ")
    return F.when(notice, F.slice(paragraphs_, 1, F.greatest(F.size(paragraphs_) - 1, F.lit(0)))).otherwise(paragraphs_)


def lead(text: Column, most: int = 90) -> Column:
    """The first sentence of the first paragraph, if it is short and more follows."""
    parts = paragraphs(text)
    first = F.regexp_extract(F.coalesce(F.try_element_at(parts, F.lit(1)), F.lit("")), r"^[\s\S]*?[.!?](?=\s|$)", 0)
    more = (F.size(parts) > 1) | (F.length(F.try_element_at(parts, F.lit(1))) > F.length(first))
    return F.when((F.length(first) > 0) & (F.length(first) <= most) & more, first)


def clean_heading(heading: Column) -> Column:
    """A heading without emphasis and links around all of it, however many of them. No more layers are looked for than there are marks
    that open one at its start and marks that close one, so that a long heading without them costs no more than its length."""
    peel = lambda c: F.trim(F.regexp_replace(c, r"^\*\*(.+)\*\*$|^__(.+)__$|^\[(.+)\]\([^)]*\)$", "$1$2$3"))

    def bare(c: Column) -> Column:
        opened = F.regexp_count(F.regexp_extract(c, r"^[ *_\[]*", 0), F.lit(r"\*\*|__|\["))
        layers = F.least(opened, F.regexp_count(c, F.lit(r"\*\*|__|\]\(")))
        return F.when(c.rlike(r"^[*_\[]"), F.aggregate(F.array_repeat(F.lit(0), layers), c, lambda x, _: peel(x))).otherwise(c)

    return let(F.trim(heading), bare)


def breadcrumb(title: Column, parent: Column, heading: Column) -> Column:
    return F.concat_ws(" > ", title, F.nullif(parent, F.lit("")), F.nullif(heading, title))


def quote_of_chunk(content: Column) -> Column:
    """The prose of a chunk below its first blank line, without images; empty if it is short."""
    body = F.regexp_extract(content, r"^[\s\S]*?\n\s*\n([\s\S]*)$", 1)

    def cut(flat: Column) -> Column:
        short = F.concat(F.regexp_replace(F.left(flat, F.lit(240)), r"\s+\S*$", ""), F.lit("..."))
        return F.when(F.length(flat) < 40, "").when(F.length(flat) <= 240, flat).otherwise(short)

    return let(F.trim(F.regexp_replace(F.regexp_replace(body, r"!\[[^\]]*\]\([^)]*\)", ""), r"\s+", " ")), cut)


def quote_of_snippet(snippet_: Column, heading: Column) -> Column:
    """A snippet without the breadcrumb that ends in its heading, unless little would be left."""
    at = F.instr(snippet_, heading)
    before = F.left(snippet_, at - 1)
    rest = F.trim(F.substring(snippet_, at + F.length(heading), F.length(snippet_)))
    crumb = heading.isNotNull() & (F.length(heading) > 0) & (at > 0) & ((at == 1) | before.endswith("> ")) & (F.length(rest) >= 40)
    return F.when(crumb, rest).otherwise(F.trim(snippet_))


def citation_url(resolved: Column, source: Column) -> Column:
    return F.coalesce(F.nullif(resolved, F.lit("")), source)


def hostname(url: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(url, r"^[a-z]+://([^/:?#]+)", 1), r"^www\.", "")


def slug(url: Column) -> Column:
    last = F.regexp_extract(url, r"([^/?#]+)/*(?:[?#].*)?$", 1)
    return F.regexp_replace(F.regexp_replace(F.lower(last), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def source_label(url: Column) -> Column:
    """Host and last part of the path."""
    host, path = F.regexp_extract(url, r"^[a-z]+://([^/?#]+)", 1), F.regexp_extract(url, r"^[a-z]+://[^/?#]+([^?#]*)", 1)
    return F.concat_ws("/", host, F.nullif(F.regexp_extract(path, r"([^/]+)/*$", 1), F.lit("")))


def domain_hint(url: Column) -> Column:
    return F.split_part(F.regexp_replace(F.lower(F.regexp_extract(url, r"^[a-z]+://([^/?#]+)", 1)), r"^www\.", ""), F.lit("."), F.lit(1))


def snapshot_name(topic: Column, url: Column) -> Column:
    path = F.regexp_extract(url, r"^[a-z]+://[^/?#]+([^?#]*)", 1)
    last = F.coalesce(F.nullif(F.regexp_extract(path, r"([^/]+)/*$", 1), F.lit("")), F.regexp_extract(url, r"^[a-z]+://([^/?#]+)", 1))
    return F.concat(topic, F.lit("-"), domain_hint(url), F.lit("-"), F.regexp_replace(F.regexp_replace(F.lower(last), "[^a-z0-9]+", "-"), "^-+|-+$", ""), F.lit(".md"))


def plain_hyphens(text: Column) -> Column:
    """Hyphens of form and visa names as non-breaking ones."""
    return F.regexp_replace(F.regexp_replace(text, r"(?i)\b(E)-(Verify)\b", "$1‑$2"), r"\b([A-Za-z]{1,3})-(\d{1,4}[A-Za-z]?)\b", "$1‑$2")


def mask_address(text: Column) -> Column:
    """Database addresses without their passwords."""
    return F.regexp_replace(text, r"://([^:/@]+):[^@]*@", "://$1:***@")


def stat_cell(value: Column, n: Column, total: Column) -> Column:
    return F.concat(F.coalesce(F.format_string("%.3f", value), F.lit("n/a")), F.lit("("), n.cast("string"), F.lit("/"), total.cast("string"), F.lit(")"))


def highlights(lines: Column) -> Column:
    """Numbers, dates, forms and words of rules in lines, each once in its first spelling."""
    found = F.flatten(F.transform(lines, lambda x: F.regexp_extract_all(x, F.lit(HIGHLIGHT), F.lit(0))))

    def firsts(found: Column) -> Column:
        """Of found ones in the order of their spelling in small letters and place, each that differs from the one before, by place."""
        one = F.sort_array(F.transform(found, lambda x, i: F.struct(F.lower(x).alias("key"), i.alias("i"), x.alias("x"))))
        new = lambda s: F.filter(F.transform(s, lambda x, j: F.when((j == 0) | (F.get(s, j - 1)["key"] != x["key"]), F.struct(x["i"], x["x"]))), lambda x: x.isNotNull())
        return F.transform(F.sort_array(let(one, new)), lambda x: x["x"])

    return firsts(found)


def is_boilerplate(line: Column) -> Column:
    return F.regexp_replace(line, r"^\s+|\s+$", "").rlike(BOILERPLATE)


def content_lines(body: Column) -> Column:
    """Lines to compare: characters by NFKC, quotes and dashes folded, white space collapsed, boilerplate left out."""
    folded = F.translate(F.replace(nfkc(body), F.lit("…"), F.lit("...")), "‘’“”–—", "''\"\"--")
    lines = F.transform(F.split(folded, "\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    return F.filter(lines, lambda x: ~x.rlike(BOILERPLATE))


def grade(words: Column, sentences_: Column, syllables: Column) -> Column:
    """Flesch-Kincaid reading grade; a syllable is a run of vowels."""
    return 0.39 * words / sentences_ + 11.8 * syllables / words - 15.59


def iso_day(text: Column) -> Column:
    """The day that a text begins with in ISO form, else null."""
    return F.try_to_date(F.nullif(F.regexp_extract(text, r"^(\d{4}-\d{2}-\d{2})", 1), F.lit("")), "yyyy-MM-dd")


def short_date(day: Column) -> Column:
    return F.date_format(day, "MMM d, yyyy")


def day_month_year(day: Column) -> Column:
    return F.date_format(day, "d MMM yyyy")


def long_date(day: Column) -> Column:
    return F.date_format(day, "MMMM d, yyyy")
