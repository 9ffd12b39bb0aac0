"""The published Snowball stemmer for French, and analyzers built on it.

The stemmer is the one Python function in the library's core. It sees each distinct term once: analyzers collect the
distinct terms, stem them in Arrow batches and join the stems back.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from palimpsest.config import EXTRA_STOP_WORDS
from palimpsest.functions.text import drop_punctuation, fold_accents, nfc, split_elisions

_VOWELS = frozenset("aeiouyâàëéêèïîôûù")


def _longest(word: str, suffixes: list[str]) -> str:
    return next((s for s in suffixes if word.endswith(s)), "")


def _by_length(text: str) -> list[str]:
    return sorted(text.split(), key=len, reverse=True)


# The suffix lists of the published algorithm.
_PLAIN = "ance iqUe isme able iste eux ances iqUes ismes ables istes".split()
_ATION = "atrice ateur ation atrices ateurs ations".split()
_STEP1 = _by_length(
    " ".join(_PLAIN + _ATION) + " logie logies usion ution usions utions ence ences ement ements ité ités if ive ifs ives eaux aux euse euses "
    "issement issements amment emment ment ments"
)
_I_VERBS = _by_length(
    "îmes ît îtes i ie ies ir ira irai iraIent irais irait iras irent irez iriez irions irons iront is issaIent issais issait issant issante "
    "issantes issants isse issent isses issez issiez issions issons it"
)
_E_VERBS = "é ée ées és èrent er era erai eraIent erais erait eras erez eriez erions erons eront ez iez".split()
_A_VERBS = "âmes ât âtes a ai aIent ais ait ant ante antes ants as asse assent asses assiez assions".split()
_VERBS = _by_length(" ".join(_E_VERBS + _A_VERBS) + " ions")


def _marked(word: str) -> str:
    """Vowels that stand as consonants in upper case."""
    out = list(word)
    for i, c in enumerate(word):
        before = i > 0 and out[i - 1] in _VOWELS
        after = i + 1 < len(word) and word[i + 1] in _VOWELS
        if c == "u" and i > 0 and word[i - 1] == "q" or c in "ui" and before and after or c == "y" and (before or after):
            out[i] = c.upper()
    return "".join(out)


def _after_cluster(word: str, start: int) -> int:
    for i in range(start + 1, len(word)):
        if word[i] not in _VOWELS and word[i - 1] in _VOWELS:
            return i + 1
    return len(word)


def _rv(word: str) -> int:
    if word[:2] and len(word) > 1 and word[0] in _VOWELS and word[1] in _VOWELS:
        return min(3, len(word))
    if word.startswith(("par", "col", "tap")):
        return 3
    return next((i + 1 for i in range(1, len(word)) if word[i] in _VOWELS), len(word))


class _Word:
    def __init__(self, word: str) -> None:
        self.w = _marked(word)
        self.rv = _rv(self.w)
        self.r1 = _after_cluster(self.w, 0)
        self.r2 = _after_cluster(self.w, self.r1) if self.r1 < len(self.w) else len(self.w)

    def at(self, suffix: str, region: int) -> bool:
        return bool(suffix) and self.w.endswith(suffix) and len(self.w) - len(suffix) >= region

    def cut(self, suffix: str, new: str = "") -> None:
        self.w = self.w[: len(self.w) - len(suffix)] + new

    def cut_if(self, suffix: str, region: int, otherwise: str | None = None) -> bool:
        """Cuts a suffix that lies in the region; else puts ``otherwise`` in its place, if given."""
        if not self.w.endswith(suffix):
            return False
        if self.at(suffix, region):
            self.cut(suffix)
        elif otherwise is not None:
            self.cut(suffix, otherwise)
        return True


def _standard(x: _Word) -> tuple[bool, bool]:
    """Step 1: whether it changed the word, and whether verb suffixes are looked for all the same."""
    s = _longest(x.w, _STEP1)
    before = x.w
    stem = x.w[: len(x.w) - len(s)]
    if not s:
        return False, False
    if s in _PLAIN:
        x.cut_if(s, x.r2)
    elif s in _ATION:
        if x.at(s, x.r2):
            x.cut(s)
            x.cut_if("ic", x.r2, "iqU")
    elif s.startswith("logie"):
        if x.at(s, x.r2):
            x.cut(s, "log")
    elif s in ("usion", "ution", "usions", "utions"):
        if x.at(s, x.r2):
            x.cut(s, "u")
    elif s.startswith("ence"):
        if x.at(s, x.r2):
            x.cut(s, "ent")
    elif s in ("ement", "ements"):
        if x.at(s, x.rv):
            x.cut(s)
            if x.w.endswith("iv"):
                if x.at("iv", x.r2):
                    x.cut("iv")
                    if x.at("at", x.r2):
                        x.cut("at")
            elif x.w.endswith("eus"):
                if x.at("eus", x.r2):
                    x.cut("eus")
                elif x.at("eus", x.r1):
                    x.cut("eus", "eux")
            elif x.w.endswith(("abl", "iqU")):
                x.cut_if(x.w[-3:], x.r2)
            elif x.at("ièr", x.rv) or x.at("Ièr", x.rv):
                x.cut("ièr", "i")
    elif s in ("ité", "ités"):
        if x.at(s, x.r2):
            x.cut(s)
            if not x.cut_if("abil", x.r2, "abl") and not x.cut_if("ic", x.r2, "iqU"):
                x.cut_if("iv", x.r2)
    elif s in ("if", "ive", "ifs", "ives"):
        if x.at(s, x.r2):
            x.cut(s)
            if x.at("at", x.r2):
                x.cut("at")
                x.cut_if("ic", x.r2, "iqU")
    elif s == "eaux":
        x.cut("x")
    elif s == "aux":
        if x.at(s, x.r1):
            x.cut("ux", "l")
    elif s in ("euse", "euses"):
        if x.at(s, x.r2):
            x.cut(s)
        elif x.at(s, x.r1):
            x.cut(s, "eux")
    elif s in ("issement", "issements"):
        if x.at(s, x.r1) and stem and stem[-1] not in _VOWELS:
            x.cut(s)
    elif s in ("amment", "emment"):
        if x.at(s, x.rv):
            x.cut(s, s[0] + "nt")
        return x.w != before, True
    elif stem and stem[-1] in _VOWELS and len(stem) - 1 >= x.rv:
        x.cut(s)
        return True, True
    return x.w != before, False


def _verbs(x: _Word) -> bool:
    """Steps 2a and 2b."""
    rest = x.w[x.rv :]
    s = _longest(rest, _I_VERBS)
    if s and len(rest) > len(s) and rest[-len(s) - 1] not in _VOWELS:
        x.cut(s)
        return True
    s = _longest(rest, _VERBS)
    if s == "ions":
        if x.at(s, x.r2):
            x.cut(s)
            return True
        return False
    if s in _E_VERBS:
        x.cut(s)
        return True
    if s:
        x.cut(s)
        if x.at("e", x.rv):
            x.cut("e")
        return True
    return False


def _residual(x: _Word) -> None:
    """Step 4."""
    if len(x.w) > 1 and x.w[-1] == "s" and x.w[-2] not in "aiouès":
        x.cut("s")
    if x.at("ion", x.r2) and len(x.w) - 4 >= x.rv and x.w[-4] in "st":
        x.cut("ion")
        return
    for s in ("ière", "Ière", "ier", "Ier"):
        if x.at(s, x.rv):
            x.cut(s, "i")
            return
    if x.at("e", x.rv):
        x.cut("e")
    elif x.at("ë", x.rv) and x.w.endswith("guë"):
        x.cut("ë")


def french_stem(word: str) -> str:
    """The stem of a lower-case word."""
    if not word:
        return word
    x = _Word(word)
    changed, verbs_too = _standard(x)
    if not changed or verbs_too:
        changed = _verbs(x) or changed
    if changed:
        if x.w.endswith("Y"):
            x.cut("Y", "i")
        elif x.w.endswith("ç"):
            x.cut("ç", "c")
    else:
        _residual(x)
    if x.w.endswith(("enn", "onn", "ett", "ell", "eill")):
        x.w = x.w[:-1]
    i = len(x.w) - 1
    while i >= 0 and x.w[i] not in _VOWELS:
        i -= 1
    if 0 <= i < len(x.w) - 1 and x.w[i] in "éè":
        x.w = x.w[:i] + "e" + x.w[i + 1 :]
    return x.w.lower()


def stem_all(words: pd.Series) -> pd.Series:
    """The stems of a batch."""
    return words.map(lambda w: None if w is None else french_stem(w))


def stem_table(terms: DataFrame, column: str = "term") -> DataFrame:
    """term, stem of the distinct terms of a column; null terms fall out."""
    distinct = terms.select(F.col(column).alias("term")).filter("term is not null").distinct()
    return distinct.select("term", pandas_udf(stem_all, "string")("term").alias("stem"))


def stop_words(extended: bool = True) -> list[str]:
    """Stop words for French as they ship with Spark, with the extra list or without, each with and without accents."""
    from pyspark.ml.feature import StopWordsRemover

    base = set(StopWordsRemover.loadDefaultStopWords("french"))
    if extended:
        base |= EXTRA_STOP_WORDS
    plain = str.maketrans("àâäçéèêëîïôöùûüÿ", "aaaceeeeiioouuuy")
    return sorted(base | {w.translate(plain) for w in base})


def raw_terms(text: Column, analyzer: str) -> Column:
    """Terms before stop words and stems, as an array: ``topic`` splits elisions, ``bow`` drops punctuation and digits. Null text gives []."""
    t = nfc(F.coalesce(text, F.lit("")))
    t = split_elisions(t) if analyzer == "topic" else drop_punctuation(t, digits=True)
    parts = F.split(F.trim(F.regexp_replace(t, "\\s+", " ")), " ")
    return F.filter(F.transform(parts, lambda w: fold_accents(F.lower(w))), lambda w: w != "")


def analyze(docs: DataFrame, key: list[str], text: str, analyzer: str = "bow", extended: bool = True) -> DataFrame:
    """key, pos, stem: the stems of each text in order, stop words left out.

    ``topic`` also leaves out terms and stems of one character. Stems are made once per distinct term and joined back.
    """
    flat = docs.select(*key, F.posexplode(raw_terms(F.col(text), analyzer)).alias("pos", "term"))
    flat = flat.filter(~F.col("term").isin(stop_words(extended)))
    if analyzer == "topic":
        flat = flat.filter(F.length("term") > 1)
    out = flat.join(stem_table(flat), "term").select(*key, "pos", "stem")
    return out.filter(F.length("stem") > 1) if analyzer == "topic" else out


def index_terms(text: Column, stop: list[str]) -> Column:
    """Terms as a default index of French text makes them: lower case, word tokens, no stop words, no term of one character; not stemmed.

    Stop words are compared in lower case; null text gives [].
    """
    terms = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([\\p{L}\\p{N}_]+)"), F.lit(1))
    return F.filter(terms, lambda w: (F.length(w) > 1) & ~w.isin(stop))
