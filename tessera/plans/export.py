"""Results for people and programs: Markdown, JSON, a stream of stages; date presets."""

from __future__ import annotations

import datetime as dt
import json
import queue
import re
import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .search import Corpus, results, search


def export_name(query: str, suffix: str, day: dt.date | None = None) -> str:
    slug = re.sub(r"[^a-z0-9]+", "-", query.lower()).strip("-")[:40] or "results"
    return f"search-{slug}-{(day or dt.date.today()).isoformat()}.{suffix}"


def to_json(shown: DataFrame) -> DataFrame:
    """(qid, rank, json): one JSON object a hit, as Spark writes it."""
    return shown.select("qid", "rank", F.to_json(F.struct(*[c for c in shown.columns])).alias("json"))


def to_markdown(shown: DataFrame, query: str, most: int = 100) -> str:
    """A list of the first hits; highlighted words are bold."""
    lines = [f"# Results for “{query}”", ""]
    for r in shown.orderBy("rank").limit(most).collect():
        text = "".join(f"**{s.text}**" if s.highlight else s.text for s in r.snippet or [])
        lines += [f"{r['rank']}. **{r.title or r.doc_id}** ({r.confidence}, {r.score:.4f})", f"   {r.source or r.doc_id}", f"   {' '.join(text.split())}", ""]
    return "\n".join(lines)


def search_events(spark: SparkSession, corpus: Corpus, query: str, **kw):
    """Newline-delimited JSON while a search runs: its stages, then the result or the error."""
    said: queue.Queue = queue.Queue()

    def run() -> None:
        try:
            hits = search(spark, corpus, query, on_stage=lambda s: said.put({"event": "stage", "stage": s}), **kw)
            rows = [r.asDict(True) for r in results(hits, corpus, query).orderBy("rank").collect()]
            said.put({"event": "result", "hits": rows})
        except Exception as e:
            said.put({"event": "error", "error": str(e)[:500]})
        said.put(None)

    threading.Thread(target=run, daemon=True).start()
    while (item := said.get()) is not None:
        yield json.dumps(item, default=str, ensure_ascii=False) + "\n"


def date_preset(name: str, now: dt.datetime | None = None) -> dict:
    """modified_after of the last day, week, month (30 days) or year (365 days); nothing for any time."""
    days = {"any": None, "day": 1, "week": 7, "month": 30, "year": 365}[name]
    return {} if days is None else {"modified_after": ((now or dt.datetime.now(dt.UTC)) - dt.timedelta(days=days)).timestamp()}
