"""Tokens, stems, stopwords and query parsing.

Two tokenizers share one definition of a token (a run of letters, digits and
private-use characters): ``simple_tokens`` is a JVM expression and stays inside
whole-stage code; ``stem_tokens`` folds diacritics and stems on top, in Python.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN_CLASS = r"[\p{L}\p{N}\p{Co}]+"

# The English function words that never count as keywords.
STOPWORDS = frozenset(
    """
    a about above after again against all am an and any are as at be because
    been before being below between both but by can could did do does doing
    down during each few for from further had has have having he her here hers
    herself him himself his how i if in into is it its itself just me more most
    my myself no nor not now of off on once only or other ought our ours
    ourselves out over own same shall she should so some such than that the
    their theirs them themselves then there these they this those through to
    too under until up very was we were what when where which while who whom
    whose why with would you your yours yourself yourselves
    s t ll re ve don doesn didn isn aren wasn weren hasn haven hadn wouldn
    shouldn couldn
    """.split()
)

_WORD = re.compile(r"[^\W_]+")


def simple_tokens(text: Column) -> Column:
    """array<string> of the lower-cased tokens of a text; empty for null."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(TOKEN_CLASS), F.lit(0)), F.array().cast("array<string>"))


def collapse_whitespace(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def normalize_tags(tags: Column, most: int = 50) -> Column:
    """Trimmed, lower-cased, non-empty tags in order of first occurrence."""
    cleaned = F.filter(F.transform(tags, lambda t: F.lower(F.trim(t))), lambda t: t != "")
    return F.slice(F.array_distinct(cleaned), 1, most)


# -- query parsing, on the driver ---------------------------------------------


def is_stopword(word: str) -> bool:
    """An English function word; of a contraction, every part must be one."""
    parts = [p for p in re.split("['’]", (word or "").casefold()) if p]
    return bool(parts) and all(p in STOPWORDS for p in parts)


def query_terms(query: str, limit: int = 32) -> list[str]:
    """Distinct casefolded words of a query, in order."""
    return list(dict.fromkeys(w.casefold() for w in _WORD.findall(query or "")))[:limit]


def content_terms(terms) -> list[str]:
    terms = list(terms)
    return [t for t in terms if not is_stopword(t)] or terms


def keyword_terms(query: str, limit: int = 32) -> list[str]:
    """Query words that count as keywords; all of them if all are stopwords."""
    return content_terms(query_terms(query, len(query or "")))[:limit]


def content_tokens(query: str) -> list[str]:
    """Distinct whitespace-separated tokens with a word in them, without stopwords unless nothing else is left."""
    kept: dict[str, str] = {}
    for token in (query or "").replace('"', "").split():
        if _WORD.search(token):
            kept.setdefault(token.casefold(), token)
    strong = [t for t in kept.values() if not all(is_stopword(w) for w in _WORD.findall(t))]
    return strong or list(kept.values())


def all_tokens(query: str) -> list[str]:
    """Every whitespace-separated token of a query, repeats included."""
    return [t for t in (x.replace('"', "") for x in (query or "").split()) if t]


# -- folding and stemming --------------------------------------------------------


@lru_cache(4096)
def _fold_char(c: str) -> str:
    low = c.lower()
    low = low if len(low) == 1 else low[0]
    parts = unicodedata.normalize("NFD", low)
    return parts[0] if len(parts) > 1 and parts[0].isascii() and all(unicodedata.combining(p) for p in parts[1:]) else low


def _is_token_char(c: str) -> bool:
    kind = unicodedata.category(c)
    return kind[0] in "LN" or kind == "Co"


def fold_tokens(text: str | None) -> list[str]:
    """Lower-cased tokens without diacritics; a combining mark inside a token is skipped."""
    if not text:
        return []
    if text.isascii():
        return re.findall(r"[a-z0-9]+", text.lower())
    out, current = [], []
    for c in text:
        if _is_token_char(c):
            current.append(_fold_char(c))
        elif current and unicodedata.combining(c):
            continue
        elif current:
            out.append("".join(current))
            current = []
    if current:
        out.append("".join(current))
    return out


def _shape(word: str) -> str:
    """The word as c (consonants) and v (vowels); y is a vowel after a consonant."""
    out = []
    for i, c in enumerate(word):
        vowel = c in "aeiou" or (c == "y" and i > 0 and out[-1] == "c")
        out.append("v" if vowel else "c")
    return "".join(out)


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _ends_cvc(stem: str) -> bool:
    return _shape(stem)[-3:] == "cvc" and stem[-1] not in "wxy"


# The published suffix rules of the Porter algorithm (steps 2 to 4).
_STEP2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("logi", "log"), ("bli", "ble"), ("alli", "al"),
    ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"),
    ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
)
_STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _longest(word: str, rules):
    """The rule with the longest suffix that the word has and that leaves something."""
    fits = [r for r in rules if word.endswith(r if isinstance(r, str) else r[0]) and len(word) > len(r if isinstance(r, str) else r[0])]
    return max(fits, key=lambda r: len(r if isinstance(r, str) else r[0]), default=None)


@lru_cache(1 << 16)
def porter(word: str) -> str:
    """The Porter stem of a folded token (Porter, 1980)."""
    if len(word) < 3 or len(word.encode()) > 64:
        return word
    if word.endswith("s"):
        if word.endswith("sses") or (word.endswith("ies") and len(word) > 3):
            word = word[:-2]
        elif not word.endswith("ss"):
            word = word[:-1]
    again = False
    if word.endswith("eed"):
        if _measure(word[:-3]) > 0:
            word = word[:-1]
    elif word.endswith("ed") and "v" in _shape(word[:-2]):
        word, again = word[:-2], True
    elif word.endswith("ing") and "v" in _shape(word[:-3]):
        word, again = word[:-3], True
    if again:
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c" and word[-1] not in "lsz":
            word = word[:-1]
        elif _measure(word) == 1 and _ends_cvc(word):
            word += "e"
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    for rules in (_STEP2, _STEP3):
        rule = _longest(word, rules)
        if rule and _measure(word[: -len(rule[0])]) > 0:
            word = word[: -len(rule[0])] + rule[1]
    suffix = _longest(word, _STEP4)
    if suffix:
        stem = word[: -len(suffix)]
        if _measure(stem) > 1 and (suffix != "ion" or stem.endswith(("s", "t"))):
            word = stem
    if word.endswith("e"):
        m = _measure(word[:-1])
        if m > 1 or (m == 1 and not _ends_cvc(word[:-1])):
            word = word[:-1]
    if word.endswith("ll") and _measure(word[:-1]) > 1:
        word = word[:-1]
    return word


def stem_tokens(text: str | None) -> list[str]:
    return [porter(t) for t in fold_tokens(text)]
