"""Spelling variants, benchmark decontamination and the audit of filters against brute force, and their defined edge cases."""

import random
import re
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import ann, common, decontam, embdedup, entry, filteraudit, spelling, trainorder

from test_registered import against_sql
from test_small_operators import docs_of


def words_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


# -- spelling -------------------------------------------------------------------


def one_edit(a, b):
    """Whether b comes from a by one inserted, deleted or replaced code point."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_spelling(docs, typo, min_length, min_count, ratio):
    n = Counter()
    for d, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % typo == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= min_length and k >= min_count}
    near = {w: [x for x in n if one_edit(w, x)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out, key=str)


def test_neighbourhood_is_whole_and_distinct():
    rng = random.Random(5)
    for word in ["aabbba", "aaa", "a", "éab", *("".join(rng.choice("abé") for _ in range(rng.randint(1, 9))) for _ in range(40))]:
        got = [c for _, c in spelling.neighbourhood([word], "abé")]
        want = {word[:i] + word[i + 1 :] for i in range(len(word))} | {word[:i] + a + word[i:] for i in range(len(word) + 1) for a in "abé"}
        want |= {word[:i] + a + word[i + 1 :] for i in range(len(word)) for a in "abé"}
        assert len(got) == len(set(got)) and set(got) == want - {word}
    # the hashes that are tested before strings are made are those of the strings
    seen = set()
    made = [c for _, c in spelling.neighbourhood(["abcab", "bbcab", "c" * 50], "abc", lambda h: seen.update(h.reshape(-1).tolist()) or (h == h))]
    assert set(spelling.word_hashes(made).tolist()) <= seen


def test_spelling_equals_brute_force(spark, monkeypatch):
    rng = random.Random(7)
    base = ["".join(rng.choice("abcdé") for _ in range(rng.randint(4, 9))) for _ in range(60)]
    pool = []
    for w in base:
        pool += [w] * rng.choice([1, 2, 30, 200])
        for _ in range(3):
            i = rng.randrange(len(w))
            pool += [rng.choice([w[:i] + w[i + 1 :], w[:i] + "a" + w[i:], w[:i] + "é" + w[i + 1 :]]).title()] * rng.choice([1, 3, 40])
    rng.shuffle(pool)
    docs = [(i, ", ".join(pool[i::40])) for i in range(40)] + [(3, "abcde " * 30), (None, "abcde1abcde"), (50, None), (51, ""), (52, "x" * 30000 + " " + "x" * 64), (53, "x" * 29999 + " " + "xy" * 32 + "x"), (54, "x" * 30000 + " " + "x" * 65)]
    docs += [(55 + i, " ".join(["xy" * 32 + "x", "x" * 64, "x" * 65, "x" * 29999, "xy" * 31 + "xyy"] * (1 + 5 * (i == 1)))) for i in range(2)]
    want = brute_spelling(docs, 7, 4, 2, 3)
    assert sum(r[1] is not None for r in want) > 20 and any(r[2] != r[1] for r in want if r[1])
    for held, most in ((400_000, 1 << 27), (10, 1 << 10)):  # a counter that overflows and a filter that is too small change nothing
        monkeypatch.setattr(spelling, "HELD", held)
        monkeypatch.setattr(spelling, "MAX_BITS", most)
        got = [tuple(r) for r in spelling.spelling_variants(docs_of(spark, docs).repartition(3), min_length=4, min_count=2, ratio=3, typo=7).collect()]
        assert sorted(got, key=str) == want


def test_spelling_of_nothing(spark):
    empty = spelling.spelling_variants(docs_of(spark, []))
    assert empty.columns == ["word", "form", "root", "n", "n_near", "form_n"] and empty.count() == 0
    assert spelling.spelling_variants(docs_of(spark, [(1, None), (2, "12 .. short")])).count() == 0
    with pytest.raises(ValueError):
        spelling.spelling_variants(docs_of(spark, []), ratio=1)


# -- decontamination --------------------------------------------------------------


def brute_matches(docs, items, window, slop=0):
    """{(doc, words): (n_words, hit, items)} and the occurrences, by looking everywhere."""
    tokens = [words_of(t) for _, t in docs]
    n = Counter(w for t in tokens for w in t)
    grams = {}
    for i, t in items:
        w = words_of(t)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            grams.setdefault(tuple(w[k : k + window]), set()).add(i)
    out = []
    for (d, _), t in zip(docs, tokens):
        hit, named = set(), set()
        for g, ids in grams.items():
            rare = min(range(len(g)), key=lambda k: (n[g[k]], k))
            for s in range(len(t)):
                at = [range(max(0, s + k - (k != rare) * slop), s + k + (k != rare) * slop + 1) for k in range(len(g))]
                if s + rare < len(t) and all(any(p < len(t) and t[p] == w for p in r) for r, w in zip(at, g)):
                    hit |= set(range(s, s + len(g)))
                    named |= {str(i) for i in ids if i is not None}
        out.append((d, len(t), len(hit), sorted(named), bool(hit)))
    return sorted(out, key=str)


def leaky(rng):
    word = lambda: rng.choice(["the", "of", "Straße", "Éa", "ab1"] + [a + b for a in "abcdefgh" for b in "xyz"])
    items = [(i, " ".join(word() for _ in range(rng.randint(1, 24)))) for i in range(25)]
    items += [(25, None), (26, "--"), (None, items[3][1]), (27, items[4][1]), (4, items[5][1]), (28, "the the the the the the")]
    docs = []
    for i in range(40):
        words = [word() for _ in range(rng.randint(0, 60))]
        if i % 2:
            leak = (items[rng.randrange(25)][1] or "").split()
            words[len(words) // 2 : len(words) // 2] = leak[rng.randint(0, 3) :]
        docs.append((i, rng.choice([" ", "\n", ", ", "-"]).join(words)))
    docs += [(40, None), (41, ""), (41, docs[1][1]), (41, docs[1][1]), (None, docs[3][1]), (42, "The " * 400), (43, "the " * 5)]
    return docs, items


@pytest.mark.parametrize("slop", [0, 1, 3])
def test_matches_equal_brute_force(spark, slop, monkeypatch):
    rng = random.Random(11 + slop)
    docs, items = leaky(rng)
    want = brute_matches(docs, items, 5, slop)
    table = spark.createDataFrame([(i, t, "z") for i, t in items], "item_id int, text string, doc_id string")
    for few in (1 << 18, 0):  # with terms broadcast, and with all joins shuffled
        monkeypatch.setattr(decontam, "FEW", few)
        got = decontam.decontaminate(docs_of(spark, docs).repartition(3), table, window=5, slop=slop).collect()
        found = sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in got), key=str)
        if slop == 0:
            assert found == want
        else:  # hits may reach beyond the document's ends there, where no word is
            assert [(f[0], f[1], f[3], f[4]) for f in found] == [(w[0], w[1], w[3], w[4]) for w in want]
    assert sum(w[4] for w in want) >= 15


def test_decontamination_of_nothing(spark):
    docs, none = docs_of(spark, [(1, "a b c"), (2, None)]), spark.createDataFrame([], "item_id long, text string")
    assert sorted((r.doc_id, r.n_words, r.n_hit, r["items"], r.contaminated) for r in decontam.decontaminate(docs, none).collect()) == [(1, 3, 0, [], False), (2, 0, 0, [], False)]
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert decontam.decontaminate(docs_of(spark, []), items).count() == 0
    assert decontam.decontaminate(docs, items).where("doc_id = 1").first().n_hit == 3
    with pytest.raises(ValueError):
        decontam.decontaminate(docs, items, slop=-1)


def test_decontamination_runs_no_python(spark, sf):
    plan = entry.op12_decontam(spark, sf)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|ArrowEval|MapInArrow", plan)


# -- filters ----------------------------------------------------------------------


def brute_audit(docs, labels):
    fails = []
    for d, t, lang in docs:
        t = t or ""
        w = re.findall("[^\x20\x09-\x0d]+", t)
        f = ""
        f += "A" * (len(w) < 200) + "B" * (100 * len(set(w)) < 50 * len(w)) + "C" * (100 * len(re.findall("[A-Z]", t)) > 3 * len(t)) + "D" * bool(re.search("[#$%&*|]", t))
        f += "E" * (d is not None and any(o is not None and o < d and (x or "") == t for o, x, _ in docs))
        told = [(q, x) for i, q, x in labels if i == d and i is not None]
        fails.append((lang or "", f, any(q == 1 for q, _ in told), any(x == 1 for _, x in told)))
    out = {}
    for part in {f[0] for f in fails}:
        removed_by = Counter()
        for order in map("".join, permutations("ABCDE")):
            for step in range(1, 6):
                c, before = order[step - 1], set(order[: step - 1])
                own = [f for f in fails if f[0] == part]
                gone = [f for f in own if c in f[1] and not before & set(f[1])]
                removed_by[c] += len(gone)
                out[part, order, step] = [
                    sum(not set(order[:step]) & set(f[1]) for f in own), len(gone), sum(c in f[1] and bool(before & set(f[1])) for f in own), sum(f[1] == c for f in own),
                    sum(f[2] for f in gone), sum(f[3] for f in gone), c,
                ]
        for (p, _, _), row in out.items():
            if p == part:
                row[6] = removed_by[row[6]]
    return sorted((*k, *v) for k, v in out.items())


def test_audit_equals_brute_force(spark):
    rng = random.Random(3)
    texts = ["w%d " * 250 % tuple(rng.randrange(k) for _ in range(250)) + x for k in (3, 900) for x in ("", "#", "ABCDEFGH" * 40)] + [None, "", " \t", "a b", "Ü É  x"]
    docs = [(rng.randrange(60), rng.choice(texts), rng.choice(["de", "", None, "en"])) for _ in range(70)] + [(None, None, "en"), (None, "a b", "de"), (5, "a b", "de"), (5, "a b", "de")]
    labels = [(rng.randrange(60), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(60)] + [(None, 1, 1)]
    table = spark.createDataFrame([(d, t, lang, "x", True) for d, t, lang in docs], "doc_id long, text string, lang string, flags string, good boolean").repartition(3)
    told = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert sorted(map(tuple, filteraudit.audit(table, told).collect())) == brute_audit(docs, labels)


def test_audit_of_nothing(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    empty = filteraudit.audit(spark.createDataFrame([], "doc_id long, text string, lang string"), labels)
    assert empty.count() == 0 and empty.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    one = filteraudit.audit(spark.createDataFrame([(1, None, None)], "doc_id long, text string, lang string"), labels)
    assert one.count() == 600 and {r.part for r in one.collect()} == {""}


def test_new_queries_equal_sql(spark, sf):
    for name in ("op11_spelling", "op12_decontam", "op13_filteraudit"):
        against_sql(spark, sf, name)


# -- cells that are read in pieces ------------------------------------------------


def test_cells_are_cut_whole_or_handed_on_in_pieces():
    import pyarrow as pa

    rng = np.random.default_rng(9)
    for trial in range(60):
        sizes = rng.choice([1, 2, 3, 9, 40], rng.integers(1, 12))
        cells = np.repeat(np.cumsum(rng.integers(1, 4, len(sizes))), sizes)
        rows, at, batches = np.arange(len(cells)), 0, []
        while at < len(cells):
            n = int(rng.integers(0, 12))
            batches.append(pa.RecordBatch.from_arrays([pa.array(cells[at : at + n]), pa.array(rows[at : at + n])], names=["c", "r"]))
            at += n
        seen, done = [], set()
        for (c, r), whole in common.cell_runs(batches, 7):
            assert len(c) == len(r) > 0 and (c == cells[r]).all() and (whole or len(set(c)) == 1)
            if whole:  # cells in here are whole, and were not seen before
                assert not done & set(c.tolist()) and all((c == x).sum() == (cells == x).sum() for x in set(c.tolist()))
            else:
                assert (cells == c[0]).sum() > 7 and len(c) <= 7 + 12 + 12
            done |= set(c.tolist())
            seen += r.tolist()
        assert seen == rows.tolist()
    with pytest.raises(ValueError):
        list(common.cell_runs([pa.RecordBatch.from_arrays([pa.array([2, 1])], names=["c"])], 7))


# -- searches that must be whole, shards on other file systems -----------------------


def test_ann_finds_k_rows_in_clusters_smaller_than_k(spark):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((14, 24)) * 6
    sizes = [150] * 8 + [15] * 6
    x = np.concatenate([c + rng.standard_normal((n, 24)) * 0.3 for c, n in zip(centres, sizes)]).astype("float32")
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(4)
    got = {}
    for r in ann.search(rows, F.col("vec_id") % 20 == 0, k=20).collect():
        got.setdefault(r.query_id, []).append(r)
    y, hit = x.astype(float), 0
    for q in range(0, len(x), 20):
        s = np.einsum("ij,j->i", y, y[q])
        near = [j for j in np.lexsort((np.arange(len(x)), -s)) if j != q][:20]
        assert sorted(r.rank for r in got[q]) == list(range(1, 21))
        hit += len({r.vec_id for r in got[q]} & set(near))
    assert hit >= 0.9 * 20 * len(got) and len(got) == -(-len(x) // 20)
    few = rows.where("vec_id < 12")  # fewer rows than k: all candidates
    assert ann.search(few, F.col("vec_id") == 0, k=20).count() == 11


def test_shards_by_a_view_of_file_systems_and_after_lost_attempts(spark, tmp_path):
    docs = docs_of(spark, [(i, f"text number {i} " * 9) for i in range(60)])
    (tmp_path / "real").mkdir()
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.shards.link./out", f"file://{tmp_path}/real")
    first = sorted(trainorder.training_order(docs, "viewfs://shards/out/x", stride=16, per_shard=8).collect())
    raw = {m.path: open(m.path, "rb").read() for m in first}
    assert first and all(p.startswith(f"{tmp_path}/real/x/") for p in raw)
    (tmp_path / "real" / "x" / "shard-00000001.bin.77").write_bytes(b"rest of a lost attempt")
    (tmp_path / "real" / "x" / "shard-00000002.bin").write_bytes(b"half")
    assert sorted(trainorder.training_order(docs, "viewfs://shards/out/x", stride=16, per_shard=8).collect()) == first
    assert {m.path: open(m.path, "rb").read() for m in first} == raw and len(list((tmp_path / "real" / "x").glob("*.bin.*"))) == 0
    assert trainorder._file("dbfs:/a/b", 3)[1] == "/dbfs/a/b/shard-00000003.bin" and trainorder._file("file:/a", 0)[1] == "/a/shard-00000000.bin"
    assert [trainorder._uri(x) for x in ("s3a://b/a", "gs://b/a", "/a/b", "file:///a")] == ["s3://b/a", "gs://b/a", "/a/b", "file:///a"]


def test_op5_with_cells_on_axes_equals_sql(spark, sf, monkeypatch):
    """The plan that labels of more than 65,536 vectors get, on the registered query's whole table."""
    monkeypatch.setattr(embdedup, "BLOCK", 2)
    against_sql(spark, sf, "op5_embdedup")
