"""Language identification and the pipeline's first stages against plain versions, written from their descriptions."""

import math
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from siltstone.llm import lang_id

from .test_llm import DATA, lines_removed, words_apart


def trigram_counts(text):
    kept = [c if c > 127 else ord(chr(c).lower()) if chr(c).isalpha() else 32 for c in (text or "").encode()]
    around = [32, *kept, 32]
    out = Counter()
    for a, b, c in zip(around, around[1:], around[2:]):
        if (a, b, c) != (32, 32, 32):
            out[((a * 0x9E3779B1 + b * 0x85EBCA77 + c * 0xC2B2AE3D) % 2**32 * 0x27D4EB2F % 2**32) >> 20] += 1
    return out


def has_letter(text):
    return bool(re.search(r"[^\W\d_]", text or ""))


def separate(rows, sides):
    """Weights and bias of a machine by dual coordinate descent over hinge losses."""
    x = np.zeros((len(rows), 4097))
    for i, counts in enumerate(rows):
        for k, n in counts.items():
            x[i, k] = np.float64(np.float32(n / sum(counts.values()))) * 30.0
    x[:, -1] = 1
    w, pull, random = np.zeros(4097), [0.0] * len(rows), np.random.default_rng(0)
    for _ in range(30):
        for i in random.permutation(len(rows)):
            before = pull[i]
            pull[i] = min(10.0, max(0.0, before - (sides[i] * float(w @ x[i]) - 1) / float(x[i] @ x[i])))
            w += (pull[i] - before) * sides[i] * x[i]
    return w


def plain_languages(rows):
    """doc_id -> (language, score) of rows (doc_id, text, lang)."""
    least = {}
    for doc_id, text, lang in rows:
        if lang is not None and has_letter(text) and zlib.crc32(str(doc_id).encode()) % 5:
            h = xxhash.xxh64_intdigest(text.encode(), 42)
            h -= 2**64 if h >> 63 else 0
            best = least.get((lang, h % 256))
            least[lang, h % 256] = min((h, text), best) if best else (h, text)
    train = [(lang, trigram_counts(text)) for (lang, _), (_, text) in least.items()]
    as_bytes = lambda c: np.array([np.float32(c[k] / sum(c.values())) for k in range(4096)], np.float32).tobytes()
    train.sort(key=lambda r: (r[0], as_bytes(r[1])))
    langs = sorted({lang for lang, _ in train})
    family = {lang: lang_id.FAMILY.get(lang, lang) for lang in langs}

    def machines(classes, of):
        out = {}
        for a, b in combinations(classes, 2):
            some = [(c, of[lang]) for lang, c in train if of[lang] in (a, b)]
            out[a, b] = separate([c for c, _ in some], [1.0 if k == a else -1.0 for _, k in some])
        return out

    families = sorted(set(family.values()))
    first = machines(families, family)
    second = {f: machines(own := [x for x in langs if family[x] == f], {x: x for x in own} | {x: None for x in langs if x not in own}) for f in families}

    def decide(classes, found, counts):
        n = max(1, sum(counts.values()))
        worst = {c: math.inf for c in classes}
        for (a, b), w in found.items():
            margin = sum(w[k] * 30.0 * v for k, v in counts.items()) / n + w[-1]
            worst[a], worst[b] = min(worst[a], margin), min(worst[b], -margin)
        best = max(classes, key=lambda c: worst[c])
        return best, 1 / (1 + math.exp(-min(30, max(-30, 4 * worst[best]))))

    out = {}
    for doc_id, text, _ in rows:
        if not has_letter(text):
            out[doc_id] = ("und", 0.0, 0.0)
            continue
        counts = trigram_counts(text)
        f, sure = decide(families, first, counts)
        lang, more = decide([x for x in langs if family[x] == f], second[f], counts)
        out[doc_id] = (lang, sure * more, min(sure, more))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet").where(F.length("text") < 2500)


def test_languages_equal_a_plain_version(docs):
    rows = [(r.doc_id, r.text, r.lang) for r in docs.collect()]
    want = plain_languages(rows)
    got = {r.doc_id: r for r in lang_id.identify(docs).collect()}
    assert len(got) == len(want) > 100
    for k, (lang, score, _) in want.items():
        assert got[k].lang_pred == lang and abs(got[k].score - score) < 1e-5


def alike(a, b):
    longer = max(len(a), len(b))
    most = int(0.2 * longer + 1e-9)
    if abs(len(a) - len(b)) > most or longer - sum((Counter(a) & Counter(b)).values()) > most:
        return False
    return words_apart(a, b) <= most


def test_first_stages_equal_plain_ones(spark, docs):
    rows = sorted((r.doc_id, r.text, r.lang) for r in docs.where("text IS NOT NULL").collect())
    told = plain_languages(rows)
    now = [(k, t) for k, t, _ in rows if told[k][0] != "und" and told[k][2] >= 0.5]
    found = corpus_pipeline.language(spark, docs.where("text IS NOT NULL"), DATA)
    assert {(r.doc_id, r.text, r.lang) for r in found.collect()} == {(k, t, told[k][0]) for k, t in now}

    lost = lines_removed(now)
    now = [(k, lost[k][2]) for k, _ in now if lost[k][0] == 0 or lost[k][2].strip()]
    found = spark.createDataFrame(corpus_pipeline.lines(spark, found, DATA).collect(), docs.schema)
    assert {(r.doc_id, r.text) for r in found.collect()} == set(now)

    words = {k: t.split() for k, t in now}
    least = {k: k for k in words}
    for a, b in combinations(sorted(words), 2):
        if words[a] and words[b] and least[a] != least[b] and alike(words[a], words[b]):
            x, y = sorted((least[a], least[b]))
            least = {k: x if v == y else v for k, v in least.items()}
    found = corpus_pipeline.near_copies(spark, found, DATA)
    assert {r.doc_id for r in found.collect()} == {k for k, v in least.items() if k == v}
