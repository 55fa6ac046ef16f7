"""Metadata restrictions, applied before ranking."""

from __future__ import annotations

import datetime as dt
import math
import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import UsageError

MAX_VALUES, MAX_CHARS = 50, 512


def _strings(name: str, value) -> list[str]:
    value = [] if value is None else [value] if isinstance(value, str) else value
    if not isinstance(value, (list, tuple)) or not all(isinstance(v, str) for v in value):
        raise UsageError(f"filter {name!r} must be a list of strings")
    if len(value) > MAX_VALUES or any(len(v) > MAX_CHARS for v in value):
        raise UsageError(f"filter {name!r} takes at most {MAX_VALUES} values of {MAX_CHARS} characters")
    return list(value)


def folder_name(raw: str) -> str:
    parts = [p for p in raw.strip().replace("\\", "/").split("/") if p]
    while parts and parts[0] == ".":
        parts = parts[1:]
    return "/".join(parts)


def _ext(raw: str) -> str:
    out = raw.strip().lower()
    out = out if out.startswith(".") or not out else "." + out
    if not re.fullmatch(r"\.[^\s/\\]{1,31}", out):
        raise UsageError(f"invalid file type {raw!r} (expected e.g. '.md')")
    return out


def _tag(raw: str) -> str:
    if not raw.strip():
        raise UsageError("tag filters cannot be blank")
    return raw.strip().lower()


def epoch(name: str, value, last: bool) -> float | None:
    """Epoch seconds of a number, a day (its start, or as an upper bound its end) or an ISO time; days and times without a zone are those of this machine's zone."""
    if value is None or (isinstance(value, str) and not value.strip()):
        return None
    try:
        if isinstance(value, bool):
            raise ValueError
        if isinstance(value, (int, float)):
            if not math.isfinite(value):
                raise ValueError
            return float(value)
        text = value.strip()
        moment = dt.datetime.fromisoformat(text.replace("Z", "+00:00"))
        if last and re.fullmatch(r"\d{4}-\d{2}-\d{2}", text) and moment.date() < dt.date.max:
            return (moment + dt.timedelta(days=1)).timestamp() - 0.001  # days differ in length where clocks change
        return moment.timestamp()
    except (ValueError, AttributeError, OverflowError):
        raise UsageError(f"filter {name!r} must be epoch seconds or a YYYY-MM-DD date") from None


@dataclass(frozen=True)
class SearchFilters:
    """Folders (with all below; '' is the root alone), file types, any of some tags, inclusive times; all kinds must hold."""

    folders: tuple[str, ...] = ()
    exts: tuple[str, ...] = ()
    tags: tuple[str, ...] = ()
    modified_after: float | None = None
    modified_before: float | None = None

    def __post_init__(self):
        for name, clean in (("folders", folder_name), ("exts", _ext), ("tags", _tag)):
            object.__setattr__(self, name, tuple(dict.fromkeys(map(clean, _strings(name, getattr(self, name))))))
        after, before = epoch("modified_after", self.modified_after, False), epoch("modified_before", self.modified_before, True)
        if after is not None and before is not None and after > before:
            raise UsageError("modified_after must not be later than modified_before")
        object.__setattr__(self, "modified_after", after)
        object.__setattr__(self, "modified_before", before)

    @classmethod
    def of(cls, value) -> "SearchFilters":
        if isinstance(value, SearchFilters):
            return value
        if value is not None and not isinstance(value, dict):
            raise UsageError("filters must be a dict")
        unknown = sorted(map(str, set(value or {}) - set(cls.__dataclass_fields__)))
        if unknown:
            raise UsageError(f"unknown filter {unknown[0]!r}")
        return cls(**(value or {}))

    def is_empty(self) -> bool:
        return self == SearchFilters()

    def to_dict(self) -> dict:
        return {k: list(v) if isinstance(v, tuple) else v for k in self.__dataclass_fields__ if (v := getattr(self, k)) not in ((), None)}

    def column(self) -> Column:
        """The predicate on folder, ext, tags and mtime; rows without the metadata never pass a filter on it."""
        kinds = []
        if self.folders:
            own = F.lower("folder")
            kinds.append(reduce(Column.__or__, [(own == f.lower()) | (own.startswith(f.lower() + "/") if f else F.lit(False)) for f in self.folders]))
        if self.exts:
            kinds.append(F.col("ext").isin(*self.exts))
        if self.tags:
            kinds.append(F.arrays_overlap("tags", F.array(*map(F.lit, self.tags))))
        if self.modified_after is not None:
            kinds.append(F.col("mtime") >= self.modified_after)
        if self.modified_before is not None:
            kinds.append(F.col("mtime") <= self.modified_before)
        return F.coalesce(reduce(Column.__and__, kinds), F.lit(False)) if kinds else F.lit(True)


def allowed(documents: DataFrame, filters) -> DataFrame | None:
    """(doc_id) that pass, or None for no restriction."""
    f = SearchFilters.of(filters)
    return None if f.is_empty() else documents.where(f.column()).select("doc_id")
