"""Splitting long texts into overlapping passages of whole sentences and lines."""

from __future__ import annotations

import json
import re
from bisect import bisect_left
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import UsageError
from . import markdown

VERSION, MAX_PASSAGES = 1, 1000
DEFAULT = {"version": VERSION, "max_words": 200, "overlap_words": 40}

# Scripts whose characters count as one word each, and what ends a sentence.
_SCRIPTS = "぀-ヿ㐀-䶿一-鿿가-힯豈-﫿"
_WORD = re.compile(rf"[{_SCRIPTS}]|[^\s{_SCRIPTS}]+")
_STOP = re.compile(r"[.!?…][\"'”’)\]]*\s+|[。！？][\"'”’)\]」』]*\s*")


def count_words(text: str | None) -> int:
    """Runs of non-space characters; ideographs and kana count one each."""
    return len(_WORD.findall(text or ""))


#: what a setting may be called instead of being spelled out
SPOKEN = {"": None, "off": None, "none": None, "false": None, "on": DEFAULT, "default": DEFAULT, "true": DEFAULT}


def _whole(low: int, high: int):
    return lambda x: isinstance(x, int) and not isinstance(x, bool) and low <= x <= high


#: in order: key, its value where it is missing, and what a value must be, both given the keys before it
RULES = (
    ("version", lambda so_far: VERSION, lambda so_far: _whole(VERSION, VERSION)),
    ("max_words", lambda so_far: DEFAULT["max_words"], lambda so_far: _whole(16, 4000)),
    ("overlap_words", lambda so_far: min(DEFAULT["overlap_words"], so_far["max_words"] // 2), lambda so_far: _whole(0, so_far["max_words"] // 2)),
)


def normalize_chunking(setting) -> dict | None:
    """A valid setting as a dict, or None for off. Settings are dicts, JSON of one, or the words of ``SPOKEN``."""
    word = str(setting).strip().lower()
    if word in SPOKEN:
        return SPOKEN[word] and dict(SPOKEN[word])
    try:
        given = json.loads(setting) if isinstance(setting, str) else setting
    except ValueError:
        raise UsageError(f"invalid chunking setting {setting!r}") from None
    if given is None or isinstance(given, bool):
        return dict(DEFAULT) if given else None
    unknown = set(given) - {key for key, _, _ in RULES} if isinstance(given, dict) else {str(given)}
    if unknown:
        raise UsageError(f"a chunking setting has version, max_words and overlap_words; not {', '.join(sorted(map(str, unknown)))}")
    out: dict = {}
    for key, missing, rule in RULES:
        out[key] = given.get(key, missing(out))
        if not rule(out)(out[key]):
            raise UsageError(f"chunking: {key} can't be {out[key]!r}")
    return out


def chunking_text(setting: dict | None) -> str:
    return "off" if setting is None else json.dumps(setting, sort_keys=True, separators=(",", ":"))


def chunking_of(text: str | None) -> dict | None:
    """A stored setting; what cannot be read counts as off."""
    try:
        return normalize_chunking(text)
    except UsageError:
        return None


def _blocks(body: str):
    """(start, end, is heading): runs of prose lines, and every other line by itself."""
    prose, fenced = None, False
    for m in re.finditer(r"[^\r\n]+", body):
        kind, _ = markdown.block(m.group())
        alone = fenced or kind != markdown.TEXT
        blank = not m.group().strip()
        if prose and (alone or blank):
            yield *prose, False
            prose = None
        if alone and not blank:
            yield *m.span(), kind == markdown.HEADING and not fenced
            fenced ^= kind == markdown.FENCE
        elif not blank:
            prose = (prose[0] if prose else m.start(), m.end())
    if prose:
        yield *prose, False


def _pieces(body: str, most: int) -> list[tuple[int, int, int, bool]]:
    """(start, end, words, is heading) of the sentences, lines and cut-up long ones a passage is made of."""
    out = []
    for start, end, heading in _blocks(body):
        ends = [m.end() for m in _STOP.finditer(body, start, end)]
        groups: dict[int, list[tuple[int, int]]] = {}
        for m in _WORD.finditer(body, start, end):
            groups.setdefault(bisect_left(ends, m.start() + 1), []).append(m.span())
        for words in groups.values():
            size = len(words) if len(words) <= most // 2 else max(1, most // 8)
            for i in range(0, len(words), size):
                part = words[i : i + size]
                out.append((part[0][0], part[-1][1], len(part), heading))
    return out


def split_passages(body: str | None, setting: dict | None) -> list[str]:
    """Slices of ``body`` in order; the whole body if it is short or chunking is off.

    A passage takes pieces up to max_words. It doesn't end on a heading if text
    follows, and it starts with up to overlap_words of the pieces before its
    first new one, unless that is a heading. A document has ``MAX_PASSAGES``
    passages at most: what follows is in no passage (and so not in its vectors),
    but in the document's text and terms as ever.
    """
    body = body or ""
    if setting is None or count_words(body) <= setting["max_words"]:
        return [body]
    most, overlap = setting["max_words"], setting["overlap_words"]
    pieces = _pieces(body, most)
    if not pieces:
        return [body]
    before = [0, *accumulate(p[2] for p in pieces)]
    out: list[str] = []
    first = new = 0
    while new < len(pieces) and len(out) < MAX_PASSAGES:
        stop = new + 1
        while stop < len(pieces) and before[stop + 1] - before[first] <= most:
            stop += 1
        if new + 1 < stop < len(pieces) and pieces[stop - 1][3]:
            stop -= 1
        out.append(body[pieces[first][0] : pieces[stop - 1][1]])
        room = 0 if stop == len(pieces) or pieces[stop][3] else min(overlap, most - pieces[stop][2])
        back = stop
        while back - 1 > first and before[stop] - before[back - 1] <= room:
            back -= 1
        first, new = back, stop
    return out


def with_passages(docs: DataFrame, setting: dict | None, id_col: str = "doc_id", body_col: str = "body") -> DataFrame:
    """(doc_id, seq, text): the passages of every document, one Arrow pass without a shuffle."""
    if setting is None:
        return docs.select(F.col(id_col).alias("doc_id"), F.lit(0).alias("seq"), F.coalesce(F.col(body_col), F.lit("")).alias("text"))

    @F.pandas_udf("array<string>")
    def run(bodies: pd.Series) -> pd.Series:
        return bodies.map(lambda b: split_passages(b, setting))

    return docs.select(F.col(id_col).alias("doc_id"), F.posexplode(run(F.col(body_col))).alias("seq", "text"))
