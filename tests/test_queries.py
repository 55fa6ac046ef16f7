"""Every registered query of the engine against its SQL."""

import os
import re
import sqlite3
import unicodedata

import duckdb
import pytest

from tessera.plans import queries


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for t in os.listdir(sf):
        con.sql(f"create view {t.removesuffix('.parquet')} as select * from read_parquet('{sf}/{t}')")
    return con


def plain(v):
    return round(float(v), 9) + 0.0 if isinstance(v, float) or type(v).__name__ == "Decimal" else v


def sqlite_bm25(got, texts, db):
    """The porter index against SQLite's own full-text search."""
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table f using fts5(body, tokenize='porter unicode61')")
    con.executemany("insert into f(rowid, body) values (?, ?)", [(i, t or "") for i, t in texts.items()])
    want = []
    for q, text in queries.QUERY_SET:
        words = [w for w in dict.fromkeys(text.split()) if w != "the"]
        match = " OR ".join(f'"{w}"' for w in words)
        rows = sorted((-round(-s, 6), i) for i, s in con.execute("select rowid, bm25(f) from f where f match ?", (match,)))[: queries.K]
        want += [(q, n, i, -s) for n, (s, i) in enumerate(rows, 1)]
    found = sorted((r.qid, r.rank, r.doc_id, r.score) for r in got)
    assert [f[:3] for f in found] == [w[:3] for w in sorted(want)] and [f[3] for f in found] == pytest.approx([w[3] for w in sorted(want)], abs=1e-5) and len(want) >= 30


def words_in(text):
    """Words of a text one character at a time; ideographs, kana and hangul are words of their own."""
    n, inside = 0, False
    for c in text or "":
        single = any(k in unicodedata.name(c, "") for k in ("CJK UNIFIED", "HIRAGANA", "KATAKANA", "HANGUL SYLLABLE"))
        n += single or (not c.isspace() and not inside)
        inside = not c.isspace() and not single
    return n


def passage_counts(got, texts, db):
    assert {r.doc_id: r.words for r in got} == {i: words_in(t) for i, t in texts.items()}
    assert all((r.passages == 1) if r.words <= 200 else (r.passages >= -(-r.words // 200)) for r in got)


def passage_rows(got, texts, db):
    """Slices in order that cover every word, none above the limit, the next one starting before the last one ends."""
    by = {}
    for r in sorted(got, key=lambda r: (r.doc_id, r.seq)):
        by.setdefault(r.doc_id, []).append(r.text)
    assert set(by) == set(texts)
    for i, parts in by.items():
        text, at, covered = texts[i] or "", 0, 0
        if words_in(text) <= 200:
            assert parts == [text]
            continue
        for p in parts:
            # a run of one word has a passage at many places: the last one that leaves no word uncovered is meant
            word = re.compile(r"\S").search(text, covered)
            found = text.rfind(p, at, word.start() + len(p)) if word else -1
            assert found >= at and words_in(p) <= 200 and not text[covered:found].strip()
            at, covered = found + 1, max(covered, found + len(p))
        assert not text[covered:].strip()


def front_matter(got, texts, db):
    meta = {i: (s, lang) for i, s, lang in db.sql("select doc_id, source, lang from documents").fetchall()}
    assert len(got) == len(texts)
    for r in got:
        source, lang = meta[r.doc_id]
        assert (r.title, r.tags, r.body) == (source, [lang, "x"], texts[r.doc_id] or "")


def highlights(got, texts, db):
    """Lit words begin like a query word; unlit words equal none."""
    asked = {q: text.lower().split() for q, text in queries.QUERY_SET}
    plain = lambda w: "".join(c for c in unicodedata.normalize("NFKD", w.lower()) if not unicodedata.combining(c))
    assert len(got) >= 30
    for r in got:
        words = [plain(w) for w in asked[r.qid] if w != "the"]
        for s in r.segments:
            for w in map(plain, re.findall(r"[^\W_]+", s.text)):
                assert any(w.startswith(q[:4]) for q in words) if s.highlight else w not in words
        assert any(s.highlight for s in r.segments)


CHECKS = {"lexical_porter_bm25": sqlite_bm25, "passage_word_counts": passage_counts, "split_passages_rows": passage_rows, "front_matter_parse": front_matter, "highlight_segments": highlights}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, sf, db, name):
    df = queries.QUERIES[name](spark, sf)
    got = df.collect()
    if name not in queries.ORACLE:
        texts = dict(db.sql("select doc_id, text from documents").fetchall())
        return CHECKS[name](got, texts, db)
    want = db.sql(queries.ORACLE[name])
    columns = want.columns
    assert sorted(columns) == sorted(df.columns)
    assert sorted(str(tuple(plain(r[c]) for c in columns)) for r in got) == sorted(str(tuple(map(plain, r))) for r in want.fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and set(queries.QUERIES) <= set(e.queries())
