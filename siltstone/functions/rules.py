"""What is said of a rule's force: notes for prompts, notices for readers, and how a rule's fields must fit together.

A rule is in force if its status says so or there is none; days are shown, never compared, but for checking entries.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import long_date

STATUSES = ["in_force", "scheduled", "enjoined", "not_in_force"]
ORDINALS = ["first", "second", "third", "fourth", "fifth"]
# Wording of notes and notices; %d is a rule's day, %t today, %l links.
TODAY_NOT = "is not in force today, %t. Do not state its figures as current."
NOTES = {
    ("in_force", True): "This passage describes a rule that took effect on %d (on or before today, %t).",
    ("in_force", False): "This passage describes a rule that is in force today, %t.",
    ("scheduled", True): "This passage describes a rule that takes effect on %d (after today, %t).",
    ("scheduled", False): "This passage describes a rule that " + TODAY_NOT,
    ("enjoined", True): "This passage describes a rule that was scheduled to take effect on %d but is blocked by a court order and " + TODAY_NOT,
    ("enjoined", False): "This passage describes a rule that is blocked by a court order and " + TODAY_NOT,
    ("not_in_force", True): "This passage describes a rule dated %d that " + TODAY_NOT,
    ("not_in_force", False): "This passage describes a rule that " + TODAY_NOT,
}
QUALIFIERS = {
    "scheduled": "That figure comes from a rule that takes effect on %d. It is not the rule in force today, %t.",
    "enjoined": "That figure comes from a rule that is blocked by a court order and is not in force today, %t.",
    "not_in_force": "That figure comes from a rule that is not in force today, %t.",
}
MAINTAINER = " That is recorded by this site's maintainer; the page above does not say it."
BLOCKED = "a rule that has been blocked by a court order and is not in force."
#: (status, evidenced, dated) -> words after the subject; None in evidenced stands for either.
NOTICES = {
    ("enjoined", True, True): "a rule that was scheduled to take effect on %d. A court has blocked it and it is not in force.",
    ("enjoined", True, False): BLOCKED,
    ("enjoined", False, True): "a rule that was scheduled to take effect on %d. It has since been blocked by a court order and is not in force." + MAINTAINER,
    ("enjoined", False, False): BLOCKED + MAINTAINER,
    ("not_in_force", True, None): "a rule that is not in force.",
    ("not_in_force", False, None): "a rule that is not in force." + MAINTAINER,
    ("in_force", None, True): "a rule that took effect on %d, so the answer differs before and after that date.",
    ("scheduled", None, True): "a rule that takes effect on %d, so the answer differs before and after that date.",
    ("in_force", None, False): "a rule that is in force today, %t.",
}
#: The same for a reader's page, where links follow the words.
SHOWN = {
    ("enjoined", True, True): "A rule affecting this answer was scheduled to take effect on %d. A court has blocked it and it is not in force. ",
    ("enjoined", True, False): "A rule affecting this answer has been blocked by a court order and is not in force. ",
    ("enjoined", False, True): "A rule affecting this answer was scheduled to take effect on %d. It has since been blocked by a court order and is not in force." + MAINTAINER + " ",
    ("enjoined", False, False): "A rule affecting this answer has been blocked by a court order and is not in force." + MAINTAINER + " ",
    ("not_in_force", True, None): "A rule affecting this answer is not in force. ",
    ("not_in_force", False, None): "A rule affecting this answer is not in force." + MAINTAINER + " ",
    ("in_force", None, True): "A rule affecting this answer took effect on %d, so the answer differs before and after that date. ",
    ("scheduled", None, True): "A rule affecting this answer takes effect on %d, so the answer differs before and after that date. ",
    ("in_force", None, False): "A rule affecting this answer is currently in force. ",
    ("scheduled", None, False): "A rule affecting this answer is currently in force. ",
}
UNKNOWN = "This page does not know the status of a rule affecting this answer. "
LABELS = {("enjoined", True): "court's order", ("not_in_force", True): "source for that"}


def in_force(status: Column) -> Column:
    return status.isNull() | (status == "in_force")


def _fill(wording: str, day: Column, today: Column) -> Column:
    return F.replace(F.replace(F.lit(wording), F.lit("%d"), F.coalesce(long_date(day), F.lit(""))), F.lit("%t"), F.coalesce(long_date(today), F.lit("")))


def note(status: Column, day: Column, today: Column) -> Column:
    """The line under a passage's heading in a prompt; null for a passage without a rule. An unknown status is an error."""
    out = F.when(status.isNull() & day.isNull(), F.lit(None).cast("string"))
    for (s, dated), wording in NOTES.items():
        out = out.when((F.coalesce(status, F.lit("in_force")) == s) & (day.isNotNull() == F.lit(dated)), _fill(wording, day, today))
    return out.otherwise(F.raise_error(F.concat(F.lit("no wording for the status "), status)).cast("string"))


def qualifier(status: Column, day: Column, today: Column) -> Column:
    """The sentence that follows a figure of a rule that isn't in force."""
    out = None
    for s, wording in QUALIFIERS.items():
        out = F.when(status == s, _fill(wording, day, today)) if out is None else out.when(status == s, _fill(wording, day, today))
    return out


def passage(number: Column, url: Column, content: Column, status: Column, day: Column, today: Column) -> Column:
    """One passage of a prompt's context: its number and source, its note if it has one, and its text."""
    return F.concat(F.lit("["), number.cast("string"), F.lit("] Source: "), url, F.lit("\n"), F.coalesce(F.concat(note(status, day, today), F.lit("\n")), F.lit("")), content)


# Fixed value: what a generator is asked.
PROMPT = ("Context passages:\n\n", "\n\nQuestion: ", "\n")


def user_prompt(question: Column, context: Column) -> Column:
    """The prompt of a question; ``context`` is what its passages are shown as."""
    before, between, after = PROMPT
    return F.concat(F.lit(before), F.coalesce(context, F.lit("")), F.lit(between), question, F.lit(after))


def links(urls: Column, label: Column) -> Column:
    """URLs as links joined in prose."""
    many = F.transform(urls, lambda u, i: F.concat(F.when(i < len(ORDINALS), F.concat(F.lit("[the "), F.element_at(F.array(*map(F.lit, ORDINALS)), F.least(i, F.lit(len(ORDINALS) - 1)).cast("int") + 1), F.lit(" "))).otherwise("[a "), label, F.lit("]("), u, F.lit(")")))
    n = F.size(urls)
    one = F.concat(F.lit("[the "), label, F.lit("]("), F.element_at(urls, 1), F.lit(")"))
    comma = F.when(n == 2, " and ").otherwise(", and ")
    return F.when(n == 1, one).otherwise(F.concat(F.array_join(F.slice(many, 1, F.greatest(n - 1, F.lit(0))), ", "), comma, F.try_element_at(many, F.lit(-1))))


def notice(status: Column, evidenced: Column, day: Column, urls: Column, sources: Column, today: Column) -> Column:
    """The sentences on one rule: ``urls`` of the passages that describe it, and ``sources`` of its status, which are linked where
    it isn't in force."""
    known, told = F.coalesce(status, F.lit("in_force")), F.coalesce(evidenced, F.lit(False))
    subject = F.when(F.size(urls) == 1, "One of the sources above describes ").otherwise("Some of the sources above describe ")
    words = _worded(NOTICES, known, told, day, today)
    gone = known.isin("enjoined", "not_in_force")
    label = F.when(gone & ~told, "rule as published")
    for (s, e), name in LABELS.items():
        label = label.when((known == s) & (told == F.lit(e)), name)
    target = F.when(gone & (F.size(sources) > 0), sources).otherwise(urls)
    return F.concat(subject, words, F.lit(" See "), links(target, label.otherwise("source")), F.lit("."))


def _worded(wordings: dict, status: Column, evidenced: Column, day: Column, today: Column) -> Column:
    words = None
    for (s, e, d), wording in wordings.items():
        hit = (status == s) & (F.lit(True) if e is None else evidenced == F.lit(e)) & (F.lit(True) if d is None else day.isNotNull() == F.lit(d))
        words = F.when(hit, _fill(wording, day, today)) if words is None else words.when(hit, _fill(wording, day, today))
    return words


def notice_parts(status: Column, evidenced: Column, day: Column, urls: Column, source: Column) -> Column:
    """What a reader's page shows of one rule: a struct of text and links (label, url). A status that isn't known is said to be so."""
    told = F.coalesce(evidenced, F.lit(False))
    words = F.coalesce(_worded(SHOWN, status, told, day, day), F.lit(UNKNOWN))
    gone = F.coalesce(status.isin("enjoined", "not_in_force"), F.lit(False))
    name = F.when(~told, "rule as published").when(status == "enjoined", LABELS["enjoined", True]).otherwise(LABELS["not_in_force", True])
    target = F.when(gone & source.isNotNull(), F.array(source)).otherwise(urls)
    ordinal = lambda i: F.element_at(F.array(*map(F.lit, ORDINALS)), F.least(i, F.lit(len(ORDINALS) - 1)).cast("int") + 1)
    plain = lambda i: F.concat(F.lit("the "), F.when(i < len(ORDINALS), ordinal(i)).otherwise("next"), F.lit(" source"))
    named = lambda i: F.when(i < len(ORDINALS), F.concat(F.lit("the "), ordinal(i), F.lit(" "), name)).otherwise(F.concat(F.lit("a "), name))
    alone = F.when(gone, F.concat(F.lit("the "), name)).otherwise("Read the source")
    label = lambda i: F.when(F.size(target) == 1, alone).when(gone, named(i)).otherwise(plain(i))
    return F.struct(words.alias("text"), F.transform(target, lambda u, i: F.struct(label(i).alias("label"), u.alias("url"))).alias("links"))


def entry_error(status: Column, day: Column, source: Column, evidences: Column, today: Column) -> Column:
    """The first of a rule's fields that doesn't fit the others; null if all do. ``evidences`` is text as it was entered."""
    boolean = F.lower(evidences).isin("true", "false")
    return (
        F.when(source.isNotNull() & evidences.isNull(), "source_without_evidence")
        .when(source.isNotNull() & ~boolean, "evidence_not_boolean")
        .when(status.isNull() & day.isNotNull(), "date_without_status")
        .when(~status.isin(STATUSES), "unknown_status")
        .when((status == "scheduled") & day.isNull(), "scheduled_without_date")
        .when((status == "scheduled") & (day <= today), "scheduled_not_in_future")
        .when((status == "in_force") & (day > today), "in_force_in_future")
        .when(status.isin("enjoined", "not_in_force") & (F.coalesce(source, F.lit("")) == ""), "status_without_source")
    )
