"""License scans as an exact set-similarity join of text blocks with license templates.

A text's blocks for a template are all runs of as many consecutive words as the template has, divided by the threshold;
lines don't matter. Tokens are ordered by the number of documents that hold them, rarest first. A block that holds a
share t of a template of L tokens must share one of its first L - ceil(t * L) + 1 tokens in that order, so only places of
those are joined on, each with the words around it; how many template tokens stand around a place (length), and how many
of them come later in the order than the shared one (position) then bound the overlap, and the blocks through what is
left are verified. The index of the templates is broadcast: of the fixed list it is a few hundred rows, and a table of templates is
taken in rounds of bounded size. The documents are never shuffled, only what matches.

For the phrases a block is a run of just their words, all of which must stand in their order.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

# Phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# Words of notices by label; a block with a share of THRESHOLD of one's distinct words bears its label.
NOTICES = {
    "agpl-3.0": "licensed under the gnu affero general public license version 3",
    "apache-2.0": "licensed under the apache license version 2 0",
    "bsd-3-clause": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "cc-by-4.0": "licensed under a creative commons attribution 4 0 international license",
    "cc-by-nc-4.0": "licensed under cc by nc 4 0",
    "cc-by-sa-4.0": "licensed under a creative commons attribution sharealike 4 0 international license",
    "cc0-1.0": "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
    "gpl-3.0": "this work is licensed under the gnu general public license version 3",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "mit-notice": "released under the mit license",
    "mpl-2.0": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "unlicense": "this is free and unencumbered software released into the public domain",
}
THRESHOLD = 0.8
#: Bytes of a table's templates that are looked for at once; a row of their index is a few times as large as a template.
ROUND_BYTES = 1 << 20
#: What stands between words.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of a text with A-Z lower-cased; a null text has none."""
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_remove(F.split(lower, GAP), "")


def _strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def templates(threshold: float = THRESHOLD, notices: list[tuple[str, list[str]]] | None = None, phrases: bool = True) -> list[dict]:
    """What is looked for: phrases, and notices as (label, words)."""
    out = [{"label": v, "phrase": True, "text": k.split(), "share": 1.0} for k, v in PHRASES.items()] if phrases else []
    out += [{"label": k, "phrase": False, "text": v, "share": threshold} for k, v in ([(k, v.split()) for k, v in NOTICES.items()] if notices is None else notices)]
    for i, t in enumerate(out):
        t |= {"template": i, "size": len(set(t["text"])), "need": math.ceil(t["share"] * len(set(t["text"])) - 1e-9), "width": math.ceil(len(t["text"]) / t["share"] - 1e-9)}
    return out


def rounds_of(notices: DataFrame, threshold: float, limit: int) -> list[list[dict]]:
    """Templates of a table (label, text) by rounds of about ``limit`` bytes; rows without a label or a word are left out, and equal ones are one. The phrases
    are in the first."""
    told = notices.select(F.col("label").cast("string").alias("label"), words(F.col("text")).alias("words")).where("label IS NOT NULL AND size(words) > 0").distinct()
    size = told.agg(F.sum(F.octet_length("label") + F.octet_length(F.array_join("words", " ")))).first()[0] or 0
    n = max(1, -(-size // limit))
    part = F.pmod(F.xxhash64("label", "words"), F.lit(n))
    listed = lambda i: sorted((r["label"], list(r["words"])) for r in told.where(part == i).collect())
    return [known for i in range(n) if (known := templates(threshold, listed(i), phrases=i == 0))]


def scan(docs: DataFrame, threshold: float = THRESHOLD, key: str = "doc_id", text: str = "text", notices: DataFrame | None = None, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """A row for each row of ``docs``: key, n_words, n_base, first_word, last_word, base_labels, labels, score.

    ``score`` is the greatest share of a template that a block holds, among those at or above its threshold (phrases: all of it,
    so 1.0), else 0. Null and empty texts have no words, no labels (empty strings) and null places; repeated rows are
    scanned each for itself; other columns are left out. ``notices``: a table (label, text) in place of the fixed notices.
    """
    picked = docs.select(F.monotonically_increasing_id().alias("__row"), F.col(key).alias("__key"), F.col(text).alias("__text"))
    rounds = [templates(threshold)] if notices is None else rounds_of(notices, threshold, round_bytes)
    picked = cut(picked, "license-texts") if len(rounds) > 1 else picked
    slim, found = None, []
    for known in rounds:
        own, some = matches(picked, known)
        slim = own if slim is None else slim
        found.append(some)
    hits = reduce(DataFrame.unionByName, found).groupBy("__row").agg(
        F.count("start").alias("n"),
        F.min("start").alias("first_word"),
        F.max("start").alias("last_word"),
        F.collect_set(F.when(F.col("phrase"), F.col("label"))).alias("base"),
        F.collect_set("label").alias("all"),
        F.max("share").alias("share"),
    )
    joined = lambda c: F.coalesce(F.array_join(F.array_sort(c), ","), F.lit(""))
    return slim.drop("blocks").join(hits, "__row", "left").select(
        F.col("__key").alias(key),
        "n_words",
        F.coalesce("n", F.lit(0)).cast("long").alias("n_base"),
        F.col("first_word").cast("long").alias("first_word"),
        F.col("last_word").cast("long").alias("last_word"),
        joined("base").alias("base_labels"),
        joined("all").alias("labels"),
        F.coalesce("share", F.lit(0.0)).alias("score"),
    )


def matches(picked: DataFrame, known: list[dict]) -> tuple[DataFrame, DataFrame]:
    """(__row, __key, n_words, blocks of each text; __row, label, phrase, start, share of each match) of texts (__row, __key, __text)."""
    tokens = sorted({w for t in known for w in t["text"]})
    held = picked.select(F.explode(F.array_intersect(words(F.col("__text")), _strings(tokens))).alias("token"))
    often = {r["token"]: r["n"] for r in held.groupBy("token").agg(F.count("*").alias("n")).collect()}  # a row for each template token
    order = sorted(tokens, key=lambda w: (often.get(w, 0), w))
    place = {w: i for i, w in enumerate(order)}
    index = []
    for t in known:
        own = sorted(set(t["text"]), key=place.get)
        for i, w in enumerate(own[: t["size"] - t["need"] + 1]):
            index.append((w, i, t["label"], t["phrase"], t["text"], t["text"].index(w), own, own[i + 1 :], t["size"], t["need"], t["width"]))
    spark = picked.sparkSession
    lookup = F.broadcast(spark.createDataFrame(index, "token string, at int, label string, phrase boolean, run array<string>, nth int, own array<string>, later array<string>, size int, need int, width int"))

    first, reach = sorted({r[0] for r in index}), max(r[-1] for r in index)
    slim = picked.select("__row", "__key", words(F.col("__text")).alias("words"))
    # places of tokens that are joined on, each with the words within reach
    found = F.filter(F.transform("words", lambda w, i: F.when(w.isin(first), i)), lambda i: i.isNotNull())
    slim = slim.select("__row", "__key", F.size("words").cast("long").alias("n_words"), "words", found.alias("places"))
    around = F.transform("places", lambda i: F.struct(i.alias("i"), F.least(i, F.lit(reach - 1)).alias("before"), F.slice("words", F.greatest(F.lit(1), i - reach + 2), F.lit(2 * reach - 1)).alias("near")))
    slim = cut(slim.select("__row", "__key", "n_words", around.alias("blocks")), "license")
    found = slim.select("__row", F.explode("blocks").alias("x")).select("__row", "x.*").withColumn("token", F.element_at("near", F.col("before") + 1))
    found = found.join(lookup, "token")
    # the words that blocks of this template's width through the place reach, and where among them the place is
    low = F.greatest(F.lit(0), F.col("before") - F.col("width") + 1)
    found = found.withColumn("mine", F.slice("near", low + 1, F.col("before") - low + F.col("width"))).withColumn("before", F.col("before") - low)
    length = F.size(F.array_intersect("mine", "own")) >= F.col("need")
    position = 1 + F.col("at") + F.size(F.array_intersect("mine", "later")) >= F.col("need")
    found = found.where(length & position)
    # blocks that the text is too short for are all of it
    last = F.greatest(F.lit(0), F.least(F.col("before"), F.size("mine") - F.col("width")))
    most = F.array_max(F.transform(F.sequence(F.lit(0), last), lambda s: F.size(F.array_intersect(F.slice("mine", s + 1, F.col("width")), F.col("own")))))
    start = F.col("before") - F.col("nth")
    stands = (start >= 0) & (F.slice("mine", F.greatest(F.lit(0), start) + 1, F.size("run")) == F.col("run"))
    found = found.withColumn("share", F.when(F.col("phrase"), F.when(stands, F.lit(1.0)).otherwise(0.0)).otherwise(most / F.col("size")))
    found = found.where((F.col("phrase") & (F.col("share") == 1.0)) | (~F.col("phrase") & (F.col("share") * F.col("size") >= F.col("need") - 1e-9)))
    found = found.withColumn("start", F.when(F.col("phrase"), F.col("i") - F.col("nth")))
    return slim, found.select("__row", "label", "phrase", "start", "share")


def _sql() -> str:
    rows = ", ".join(f"({t['template']}, '{t['label']}', {str(t['phrase']).lower()}, {t['text']!r}, {t['need']}, {t['width']})" for t in templates())
    return rf"""
WITH t(id, label, phrase, run, need, width) AS (VALUES {rows}),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words FROM d),
p AS (SELECT r, label, list_filter(range(0, len(words) - len(run) + 1), lambda i: words[i + 1 : i + len(run)] = run) AS starts FROM w, t WHERE phrase AND list_has_all(words, run)),
n AS (SELECT r, label, need, len(list_distinct(run)) AS size, list_max(list_transform(range(0, greatest(1, len(words) - width + 1)), lambda i: len(list_intersect(words[i + 1 : i + width], run)))) AS held
      FROM w, t WHERE NOT phrase AND len(list_intersect(words, run)) >= need),
h AS (SELECT r, label, label AS base, len(starts) AS n, list_min(starts) AS a, list_max(starts) AS z, 1.0::DOUBLE AS share FROM p WHERE len(starts) > 0
      UNION ALL SELECT r, label, NULL, 0, NULL, NULL, held / size::DOUBLE FROM n WHERE held >= need),
g AS (SELECT r, sum(n) AS n, min(a) AS a, max(z) AS z, string_agg(DISTINCT base, ',' ORDER BY base) AS base, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS share FROM h GROUP BY r)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, a::BIGINT AS first_word, z::BIGINT AS last_word,
       coalesce(base, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(share, 0)::DOUBLE AS score
FROM w LEFT JOIN g USING (r)
"""


SCAN_SQL = _sql()
