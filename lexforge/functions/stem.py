"""The Snowball stemmer for French, after its published description, as a pandas UDF.

Words come in lower case. Regions: RV is what follows the third letter of a word that begins with two
vowels, else the first vowel behind the first letter (three words' beginnings are exempt); R1 is what
follows the first non-vowel after a vowel, R2 the same within R1. Vowels that act as consonants are
marked by capitals while the rules run.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Vowels, and the endings of each rule.
VOWELS = "aeiouyâàëéêèïîôûù"
_I_VERB = "îmes ît îtes i ie ies ir ira irai iraIent irais irait iras irent irez iriez irions irons iront is issaIent issais issait issant issante issantes issants isse issent isses issez issiez issions issons it".split()
_OTHER_VERB = "é ée ées és èrent er era erai eraIent erais erait eras erez eriez erions erons eront ez iez".split()
_A_VERB = "âmes ât âtes a ai aIent ais ait ant ante antes ants as asse assent asses assiez assions".split()
_PLAIN = "ance iqUe isme able iste eux ances iqUes ismes ables istes".split()
_STEP1 = {
    **dict.fromkeys(_PLAIN, "plain"), **dict.fromkeys("atrice ateur ation atrices ateurs ations".split(), "ation"), **dict.fromkeys(("logie", "logies"), "logie"), **dict.fromkeys("usion ution usions utions".split(), "usion"), **dict.fromkeys(("ence", "ences"), "ence"),
    **dict.fromkeys(("ement", "ements"), "ement"), **dict.fromkeys(("ité", "ités"), "ité"), **dict.fromkeys("if ive ifs ives".split(), "if"), "eaux": "eaux", "aux": "aux", **dict.fromkeys(("euse", "euses"), "euse"), **dict.fromkeys(("issement", "issements"), "issement"), "amment": "amment", "emment": "emment", **dict.fromkeys(("ment", "ments"), "ment"),
}


def _longest(word: str, endings) -> str | None:
    return max((e for e in endings if word.endswith(e)), key=len, default=None)


class _Word:
    """A word while the rules run, with the places where its regions begin."""

    def __init__(self, word: str) -> None:
        v = VOWELS
        w = re.sub(f"(?<=[{v}])([ui])(?=[{v}])", lambda m: m[1].upper(), word)
        w = re.sub(f"(?<=[{v}])y|y(?=[{v}])", "Y", w)
        self.w = re.sub("(?<=q)u", "U", w)
        first = re.search(f"[{v}]", self.w[1:])
        self.rv = 3 if re.match(f"[{v}]{{2}}|par|col|tap", self.w) else first.start() + 2 if first else len(self.w)
        self.r1 = self._after(0)
        self.r2 = self._after(self.r1)

    def _after(self, at: int) -> int:
        m = re.compile(f"[{VOWELS}][^{VOWELS}]").search(self.w, at)
        return m.end() if m else len(self.w)

    def has(self, end: str, region: int) -> bool:
        return self.w.endswith(end) and len(self.w) - len(end) >= region

    def cut(self, end: str, region: int, put: str = "") -> bool:
        """Replaces an ending that lies in a region."""
        ok = self.has(end, region)
        if ok:
            self.w = self.w[: len(self.w) - len(end)] + put
        return ok

    def either(self, end: str, other: str) -> None:
        """Deletes an ending in R2, else replaces it."""
        if self.w.endswith(end) and not self.cut(end, self.r2):
            self.cut(end, 0, other)


def _standard(s: _Word) -> tuple[bool, bool]:
    """Whether the word changed, and whether the verb rules are tried all the same."""
    end = _longest(s.w, _STEP1)
    kind, before = _STEP1.get(end or ""), s.w
    if kind == "plain":
        s.cut(end, s.r2)
    elif kind == "ation":
        if s.cut(end, s.r2):
            s.either("ic", "iqU")
    elif kind in ("logie", "usion", "ence"):
        s.cut(end, s.r2, {"logie": "log", "usion": "u", "ence": "ent"}[kind])
    elif kind == "ement":
        if s.cut(end, s.rv):
            if s.cut("iv", s.r2):
                s.cut("at", s.r2)
            elif s.w.endswith("eus"):
                s.cut("eus", s.r2) or s.cut("eus", s.r1, "eux")
            elif s.w.endswith(("abl", "iqU")):
                s.cut(s.w[-3:], s.r2)
            elif s.w.endswith(("ièr", "Ièr")):
                s.cut(s.w[-3:], s.rv, "i")
    elif kind == "ité":
        if s.cut(end, s.r2):
            if s.w.endswith("abil"):
                s.either("abil", "abl")
            elif s.w.endswith("ic"):
                s.either("ic", "iqU")
            else:
                s.cut("iv", s.r2)
    elif kind == "if":
        if s.cut(end, s.r2) and s.cut("at", s.r2):
            s.either("ic", "iqU")
    elif kind == "eaux":
        s.cut(end, 0, "eau")
    elif kind == "aux":
        s.cut(end, s.r1, "al")
    elif kind == "euse":
        s.cut(end, s.r2) or s.cut(end, s.r1, "eux")
    elif kind == "issement":
        if s.w[: -len(end)][-1:] not in VOWELS:
            s.cut(end, s.r1)
    elif kind in ("amment", "emment"):
        s.cut(end, s.rv, "ant" if kind == "amment" else "ent")
    elif kind == "ment":
        stem = s.w[: -len(end)]
        if stem[-1:] and stem[-1] in VOWELS and len(stem) - 1 >= s.rv:
            s.w = stem
    return s.w != before, kind in ("amment", "emment", "ment")


def _verb(s: _Word) -> bool:
    region = s.w[s.rv :]
    end = _longest(region, _I_VERB)
    if end and len(region) > len(end) and region[: -len(end)][-1] not in VOWELS:
        s.w = s.w[: -len(end)]
        return True
    end = _longest(region, [*_OTHER_VERB, *_A_VERB, "ions"])
    if end is None or (end == "ions" and not s.has("ions", s.r2)):
        return False
    s.w = s.w[: -len(end)]
    if end in _A_VERB:
        s.cut("e", s.rv)
    return True


def _residual(s: _Word) -> None:
    if re.search("(?:[^aiouès]|Hi)s$", s.w):
        s.w = s.w[:-1]
    if s.has("ion", max(s.r2, s.rv)) and s.w[:-3][-1:] in ("s", "t") and len(s.w) - 4 >= s.rv:
        s.w = s.w[:-3]
        return
    for end in ("ière", "Ière", "ier", "Ier"):
        if s.cut(end, s.rv, "i"):
            return
    s.cut("e", s.rv)


def stem_word(word: str) -> str:
    s = _Word(word)
    changed, more = _standard(s)
    if not changed or more:
        changed = _verb(s) or changed
    if changed:
        if s.w.endswith("Y"):
            s.w = s.w[:-1] + "i"
        elif s.w.endswith("ç"):
            s.w = s.w[:-1] + "c"
    else:
        _residual(s)
    if s.w.endswith(("enn", "onn", "ett", "ell", "eill")):
        s.w = s.w[:-1]
    s.w = re.sub(f"[éè](?=[^{VOWELS}]+$)", "e", s.w)
    return s.w.lower()


def _stems(words: pd.Series) -> pd.Series:
    memo: dict[str, str] = {}

    def of(w: str) -> str:
        if w not in memo:
            if len(memo) > 200_000:
                memo.clear()
            memo[w] = stem_word(w)
        return memo[w]

    return words.map(lambda ws: [of(w) for w in ws])


def stem(words: Column) -> Column:
    return F.pandas_udf(_stems, "array<string>")(words)
