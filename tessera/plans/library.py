"""A registry of named collections in one JSON file."""

from __future__ import annotations

import json
import re
import time
import unicodedata

from pyspark.sql import SparkSession

from ..errors import DataError, UsageError
from .store import Collection, Files

VERSION = 1


def slugify(name: str) -> str:
    plain = unicodedata.normalize("NFKD", name).encode("ascii", "ignore").decode().lower()
    return re.sub(r"[^a-z0-9]+", "-", plain).strip("-") or "collection"


def validate_name(name: str) -> str:
    name = " ".join((name or "").split())
    if not 0 < len(name) <= 80:
        raise UsageError("a name has 1 to 80 characters")
    return name


class Library:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark)
        self._file = f"{self.root}/collections.json"

    def _load(self) -> dict:
        if not self.files.exists(self._file):
            return {"version": VERSION, "active": None, "collections": []}
        try:
            state = json.loads(self.files.read(self._file))
            known = state["version"]
        except (ValueError, KeyError, TypeError):
            self.files.copy(self._file, f"{self._file}.damaged-{int(time.time())}")
            return {"version": VERSION, "active": None, "collections": []}
        if known > VERSION:
            raise DataError("the registry was written by a newer version")
        return state

    def _save(self, state: dict) -> None:
        self.files.write(self._file, json.dumps(state, indent=1))

    def list(self) -> list[dict]:
        return self._load()["collections"]

    def get(self, name: str) -> dict:
        for c in self.list():
            if name.casefold() in (c["id"], c["name"].casefold()):
                return c
        raise UsageError(f"no collection {name!r}")

    def open(self, name: str | None = None, embedder=None) -> Collection:
        name = name or self._load()["active"]
        if name is None:
            raise UsageError("there is no active collection")
        return Collection(self.spark, self.get(name)["path"], embedder)

    def create(self, name: str, **settings) -> dict:
        name, state = validate_name(name), self._load()
        if any(c["name"].casefold() == name.casefold() for c in state["collections"]):
            raise UsageError(f"a collection {name!r} exists")
        taken, base, n = {c["id"] for c in state["collections"]}, slugify(name), 1
        slug = base
        while slug in taken:
            n += 1
            slug = f"{base}-{n}"
        Collection.create(self.spark, f"{self.root}/{slug}", name, **settings)
        return self._add(state, slug, name, f"{self.root}/{slug}")

    def register(self, name: str, path: str) -> dict:
        """Add a collection that lies elsewhere."""
        Collection(self.spark, path).manifest  # noqa: B018
        return self._add(self._load(), slugify(name), validate_name(name), path)

    def _add(self, state: dict, slug: str, name: str, path: str) -> dict:
        entry = {"id": slug, "name": name, "path": path, "created_at": time.time()}
        state["collections"].append(entry)
        state["active"] = state["active"] or slug
        self._save(state)
        return entry

    def remove(self, name: str, delete: bool = False) -> None:
        entry, state = self.get(name), self._load()
        state["collections"] = [c for c in state["collections"] if c["id"] != entry["id"]]
        if state["active"] == entry["id"]:
            state["active"] = state["collections"][0]["id"] if state["collections"] else None
        self._save(state)
        if delete:
            self.files.delete(entry["path"])

    def rename(self, name: str, new: str) -> dict:
        entry, state = self.get(name), self._load()
        for c in state["collections"]:
            if c["id"] == entry["id"]:
                c["name"] = validate_name(new)
        self._save(state)
        return self.get(new)

    def set_active(self, name: str) -> None:
        entry, state = self.get(name), self._load()
        state["active"] = entry["id"]
        self._save(state)

    def backup_path(self, name: str) -> str:
        return f"{self.root}/backups/{self.get(name)['id']}-{time.strftime('%Y%m%dT%H%M%S', time.gmtime())}"

    def backups(self, name: str) -> list[str]:
        slug = self.get(name)["id"]
        return [f"{self.root}/backups/{b}" for b in self.files.children(f"{self.root}/backups") if re.fullmatch(rf"{re.escape(slug)}-\d{{8}}T\d{{6}}", b)]
