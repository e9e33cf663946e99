"""Tokens of text with their types, by a state machine over classes of characters, and the vocabulary that is joined with texts.

A token is the longest run that the machine accepts from where it stands. Hyphenated words give the whole and then its
parts; a URL gives itself, its host and its path; what is in no token stands between. Words, and they alone, are stemmed.

Texts are cut at white space, which no token spans. The machine and the stemmer run once over each different run, and the
texts are joined with what they found; a run that very many texts hold is broadcast or dealt out.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stems import stem

# States of the machine. Each line: state, the type that it accepts (or -), and where the classes of characters lead:
# L letter, D digit, and - . @ : / + as themselves; * any that is no space.
MACHINE = """
start    -        L=word D=uint -=sign +=sign
sign     -        D=int
int      int      D=int .=signed
signed   -        D=real
real     float    D=real
uint     uint     D=uint L=numword .=point -=dash @=at
point    -        D=float L=host
float    float    D=float .=dotted L=hostnum @=at
dotted   -        D=version
version  version  D=version .=dotted
word     word     L=word D=numword -=dash .=dot @=at :=colon
numword  numword  L=numword D=numword -=dash .=dot @=at
dash     -        L=hword D=hnum
hword    hword    L=hword D=numhword -=dash .=dot @=at
hnum     -        D=hnum L=numhword -=dash .=dot @=at
numhword numhword L=numhword D=numhword -=dash .=dot @=at
dot      -        L=host D=hostnum
host     host     L=host D=hostnum -=hostdash .=dot /=path @=at
hostnum  -        D=hostnum L=host -=hostdash .=dot @=at
hostdash -        L=host D=hostnum -=hostdash
path     url      *=path
at       -        L=mail D=mail
mail     -        L=mail D=mail -=mail .=maildot
maildot  -        L=email D=mail
email    email    L=email D=mail -=mail .=maildot
colon    -        /=slash
slash    -        /=protocol
protocol protocol
"""
STATES = {row[0]: (None if row[1] == "-" else row[1], dict((s[0], s[2:]) for s in row[2:])) for row in map(str.split, MACHINE.strip().splitlines())}
#: Types that are indexed as stems, as they are in small letters, or not at all.
STEMMED = ("word", "hword", "part")
PLAIN = ("numword", "numhword", "numpart", "uint", "int", "float", "version", "host", "url", "path", "email")
#: A text is cut at these, of which Java and Python agree.
SPACE = r"[ \t\n\x0B\f\r]+"


def tokens_of(run: str) -> list[tuple[str, str]]:
    """(type, token) of a run without white space, in their order."""
    kinds = ["L" if c.isalpha() else "D" if c.isdecimal() else c for c in run]
    out, i, n = [], 0, len(run)
    while i < n:
        state, at, kind, end = "start", i, None, i
        while at < n:
            to = STATES[state][1]
            state = to.get("*") or to.get(kinds[at])
            if not state:
                break
            at += 1
            if STATES[state][0]:
                kind, end = STATES[state][0], at
        if not kind or (kind == "int" and i and kinds[i - 1] in "LD"):
            i += 1
            continue
        token = run[i:end]
        kind = "numhword" if kind == "hword" and "D" in kinds[i:end] else kind
        out.append((kind, token))
        if kind in ("hword", "numhword"):
            out += [("part" if p.isalpha() else "numpart" if not p.isdecimal() else "uint", p) for p in token.split("-")]
        elif kind == "url":
            host, _, path = token.partition("/")
            out += [("host", host), ("path", "/" + path)]
        i = end
    return out


def lexeme(kind: str, token: str, stop: frozenset[str]) -> str | None:
    """What a token is indexed by; none for function words and protocols."""
    token = token.lower()
    if kind in STEMMED:
        return None if token in stop else stem(token)
    return token if kind in PLAIN else None


def runs(text: Column) -> Column:
    """A text cut at white space."""
    return F.filter(F.split(text, SPACE), lambda x: x != "")


def vocabulary(found: DataFrame, stop_words: list[str]) -> DataFrame:
    """run, tokens (type, token, lexeme) of each different ``run``."""
    stop = frozenset(stop_words)

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            frame["tokens"] = [[{"type": k, "token": t, "lexeme": lexeme(k, t, stop)} for k, t in tokens_of(r)] for r in frame["run"]]
            yield frame

    return found.select("run").distinct().mapInPandas(parse, "run string, tokens array<struct<type:string,token:string,lexeme:string>>")


def typed_tokens(docs: DataFrame, key: str, text: str, stop_words: list[str]) -> DataFrame:
    """key, run, at, type, token, lexeme: all tokens of texts; ``run`` and ``at`` give their order within a text."""
    placed = docs.select(key, F.posexplode(runs(F.col(text))).alias("place", "run"))
    met = placed.join(vocabulary(placed, stop_words), "run")
    return met.select(key, F.col("place").alias("run"), F.posexplode("tokens").alias("at", "t")).select(key, "run", "at", "t.*")
