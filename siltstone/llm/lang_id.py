"""Language identification in two steps: the family first, then one language of it.

Texts are bags of hashed byte trigrams. Families, and the languages within a family, are told apart by linear support
vector machines, one for each pair; the class that loses by the least in its worst pair wins.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fold, slices, utf8

#: Hashed trigrams.
BITS = 12
#: A language's training texts at most: one for each remainder of a hash of the text.
PER_LANGUAGE = 256
#: What trigram frequencies are multiplied by, so that a difference of one hundredth counts.
SCALE = 30.0
UNKNOWN = "und"
# Families of languages by ISO 639-1 code; any other language is a family of its own.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nl nn no nb sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv",
    "celtic": "br cy ga gd gv",
    "indo-iranian": "as bn fa gu hi ku mr ne or pa ps sd si tg ur",
    "uralic": "et fi hu",
    "turkic": "az ba kk ky tk tr tt ug uz",
    "semitic": "am ar he mt ti",
    "dravidian": "kn ml ta te",
    "austronesian": "id jv mg mi ms su tl",
}
FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes.split()}


def _byte_classes() -> np.ndarray:
    """A-Z as a-z; letters and bytes above 127 as themselves; all others as a space."""
    out = np.full(256, 32, np.uint32)
    out[97:123] = out[65:91] = np.arange(97, 123)
    out[128:] = np.arange(128, 256)
    return out


CLASSES = _byte_classes()


def trigrams(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashed trigrams of all texts, where each text's begin). Each text has a space before and after it; a trigram of
    nothing but spaces is no trigram and hashes to 2 ** BITS."""
    n, size = len(at) - 1, np.diff(at)
    out = np.full(len(data) + 2 * n, 32, np.uint32)
    out[np.arange(len(data)) + np.repeat(2 * np.arange(n) + 1, size)] = CLASSES[data]
    code = np.full(len(out), 1 << BITS, np.uint32)
    mixed = (out[:-2] * np.uint32(0x9E3779B1) + out[1:-1] * np.uint32(0x85EBCA77) + out[2:] * np.uint32(0xC2B2AE3D)) * np.uint32(0x27D4EB2F)
    code[:-2] = np.where((out[:-2] | out[1:-1] | out[2:]) == 32, 1 << BITS, mixed >> np.uint32(32 - BITS))
    begin = at + 2 * np.arange(n + 1)
    code[begin[1:] - 1] = code[begin[1:] - 2] = 1 << BITS  # these would run into the next text
    return code, begin


def fit_pair(x: np.ndarray, y: np.ndarray, cost: float = 10.0, rounds: int = 30) -> np.ndarray:
    """Weights and bias of a linear support vector machine by dual coordinate descent; y is 1 or -1."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, alpha, norm = np.zeros(x.shape[1]), np.zeros(len(x)), (x * x).sum(axis=1)
    rng = np.random.default_rng(0)
    for _ in range(rounds):
        for i in rng.permutation(len(x)):
            new = min(cost, max(0.0, alpha[i] - (y[i] * (w @ x[i]) - 1) / norm[i]))
            w += (new - alpha[i]) * y[i] * x[i]
            alpha[i] = new
    return w


def steps(langs: list[str]) -> Iterator[tuple[list[str], dict[str, str]]]:
    """(classes, class of each language) of each choice: among the families, then among the languages of each family."""
    family = {x: FAMILY.get(x, x) for x in langs}
    yield sorted(set(family.values())), family
    for f in sorted(set(family.values())):
        own = {x: x for x in langs if family[x] == f}
        yield sorted(own), own


class Pairwise:
    """One machine for each pair of classes."""

    def __init__(self, classes: list[str], first: int):
        self.classes, self.first = classes, first
        self.pairs = list(combinations(range(len(classes)), 2))

    def decide(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(class number, margin of its closest pair) for each row of all machines' margins."""
        worst = np.full((len(margins), len(self.classes)), np.inf)
        for k, (a, b) in enumerate(self.pairs, self.first):
            worst[:, a] = np.minimum(worst[:, a], margins[:, k])
            worst[:, b] = np.minimum(worst[:, b], -margins[:, k])
        best = worst.argmax(axis=1)
        return best, worst[np.arange(len(best)), best]


class Model:
    """Families, their languages, and a weight for each machine and trigram."""

    def __init__(self, langs: list[str], machines: list[np.ndarray]):
        groups = list(steps(langs))
        self.families, self.steps = groups[0][0], []
        for classes, _ in groups:
            self.steps.append(Pairwise(classes, sum(len(s.pairs) for s in self.steps)))
        w = np.array(machines).reshape(-1, (1 << BITS) + 1)
        self.bias = w[:, -1].copy()
        self.weights = np.ascontiguousarray(np.vstack([w[:, :-1].T * SCALE, np.zeros(len(w))]).T)  # 0 for what is no trigram

    def predict(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language, score, sureness of the less sure step) of each text."""
        code, begin = trigrams(data, at)
        sums = lambda v: np.diff(np.concatenate([[0.0], np.cumsum(v)])[begin])
        n = np.maximum(1, sums(code != 1 << BITS))
        margins = np.array([sums(w[code]) / n for w in self.weights]).reshape(-1, len(n)).T + self.bias
        family, m = self.steps[0].decide(margins)
        sure = lambda m: 1 / (1 + np.exp(-np.clip(4 * m, -30, 30)))
        score, least, lang = sure(m), sure(m), np.empty(len(n), object)
        for f, step in enumerate(self.steps[1:]):
            rows = family == f
            best, m = step.decide(margins[rows])
            lang[rows] = np.array(step.classes, object)[best]
            score[rows] *= sure(m)
            least[rows] = np.minimum(least[rows], sure(m))
        return lang, score, least


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE) -> Model | None:
    """Learn from at most ``per_language`` texts of each language: of all rows with a language whose id isn't held out,
    those with the least hash of the text for each remainder of it. None if no row can be learned from. Each machine is
    learned in a task of its own, from the texts of its classes; a machine's weights are some 32 KB."""
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}") & (F.coalesce(fold(F.col(key)), F.lit(1)) != 0))
    rows = rows.select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(text).alias("h"))
    least = rows.groupBy("lang", F.pmod("h", F.lit(per_language)).alias("part")).agg(F.min("h").alias("h")).select("lang", "h")
    chosen = rows.join(F.broadcast(least), ["lang", "h"]).dropDuplicates(["lang", "h"]).select("lang", "text")
    chosen = cut(chosen, "chosen")  # a bounded number of texts, read several times

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            code, begin = trigrams(*utf8(batch.column("text")))
            out = []
            for a, b in zip(begin[:-1], begin[1:]):
                x = np.bincount(code[a:b], minlength=(1 << BITS) + 1)[: 1 << BITS]
                out.append((x / max(1, x.sum())).astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(out, pa.binary())], ["lang", "x"])

    found = chosen.mapInArrow(run, "lang string, x binary")
    langs = sorted(r["lang"] for r in chosen.select("lang").distinct().collect())  # a row for each language
    if not langs:
        return None
    roles = []
    machine = 0
    for classes, named in steps(langs):
        for a, b in combinations(classes, 2):
            roles += [(machine, x, 1.0 if c == a else -1.0) for x, c in named.items() if c in (a, b)]
            machine += 1

    def learn(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["lang", "x"])
        x = np.frombuffer(b"".join(rows.x), np.float32).reshape(len(rows), -1) * np.float64(SCALE)
        return pd.DataFrame({"machine": rows.machine[:1], "w": [fit_pair(x, rows.y.to_numpy()).tobytes()]})

    weights: dict[int, bytes] = {}
    if roles:
        dealt = found.join(F.broadcast(docs.sparkSession.createDataFrame(roles, "machine int, lang string, y double")), "lang")
        weights = {r["machine"]: r["w"] for r in dealt.groupBy("machine").applyInPandas(learn, "machine int, w binary").collect()}
    return Model(langs, [np.frombuffer(weights[k], np.float64) for k in range(machine)])


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Every row of ``docs`` with held_out, lang_pred, score (0 to 1) and sure after its own columns.

    The score is the product of both steps' sureness, and sure the lesser of them: below one half, another class won in a pair of machines.

    Rows whose crc32 of the id as text is 0 modulo 5 are held out, and so never learned from. The prediction reads the
    whole text and nothing else; a null text, or one without a letter, is ``und`` with score 0, and so are all where no
    row bears a language. A null id isn't held out. Columns of ``docs`` with a new column's name are left out.
    """
    model = fit(docs, key, text, lang)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    own = [c for c in docs.columns if c not in ("held_out", "lang_pred", "score", "sure", "__letter")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in slices(batches, text):
            lang, score, sure = model.predict(*utf8(batch.column(text))) if model else (np.full(batch.num_rows, UNKNOWN, object), *np.zeros((2, batch.num_rows)))
            silent = ~batch.column("__letter").to_numpy(zero_copy_only=False).astype(bool)
            lang[silent], score[silent], sure[silent] = UNKNOWN, 0.0, 0.0
            columns = [c for n, c in zip(batch.schema.names, batch.columns) if n != "__letter"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(lang, pa.string()), pa.array(score), pa.array(sure)], [*(n for n in batch.schema.names if n != "__letter"), "lang_pred", "score", "sure"])

    picked = docs.select(*own, F.coalesce(fold(F.col(key)) == 0, F.lit(False)).alias("held_out"), F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("__letter"))
    schema = picked.drop("__letter").schema.add("lang_pred", "string").add("score", "double").add("sure", "double")
    return picked.mapInArrow(run, schema)
