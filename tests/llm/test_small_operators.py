"""Operators against brute force on small fixtures, and their defined edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import ann, bwt, embdedup, linededup, mixing, packing, simhash, suffix, tokens, toxicity, trainorder, urlfilter
from tessera.llm.graph import connected_components

DOCS = "doc_id long, text string, score string, rule string"  # extra columns with clashing names


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in rows], DOCS)


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


def components(edges, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


# -- components ---------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(i, i + 1) for i in range(0, 30)] + [(100, i) for i in range(101, 160)] + [(rng.randint(200, 300), rng.randint(200, 300)) for _ in range(60)] + [(5, 5)]
    df = spark.createDataFrame(edges + edges[:5] + [(None, 3)], "a long, b long")
    got = {r.node: r.component for r in connected_components(df).collect()}
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    assert got == components(edges, nodes)
    assert connected_components(df.where("false")).count() == 0


# -- 1: URL filters ------------------------------------------------------------------------


def link(h):
    return f'<html><LINK rel="canonical" href="{h}">'


def hop(h):
    return f"<meta http-equiv=refresh content='0; url={h}'>"


PAGES = [
    (1, "http://a.net/x", None), (2, "https://B.example.com/p/q?z=1#f", link("http://a.net/x")), (3, "http://c.example.org/fr/1", hop("//b.example.com/p/q?z=1")),
    (4, "http://d.org/k/l.html", hop("m.html?a=1&amp;b=2")), (5, "http://d.org/k/m.html?a=1&b=2", link("http://www.zz.net/")), (6, None, None), (7, "nothing", link("/x")),
    (8, "http://e.com", link("/de/")), (9, "http://example.com/de/", ""), (10, "http://e.com/de/", link("mailto:x@a.net")), (11, "http://q.example.net/en/1", link("http://q.net/")),
    (12, "http://q.net/", ""), (13, "http://f.com/#top", link("#here")), (None, "http://g.com/a?b", link("?c")), (14, "http://g.com/a?c", link("http://x.example.com/de/")), (14, "http://g.com/a?c", None),
    (15, "http://fexample.net/en/1", None), (16, "HTTP://Sub.ORG/fr/" + "x" * 5000, None),
    (17, "http://h.com/1", link("") + link("#x") + link("mailto:a@b.c") + hop("http://two.net/") + link("http://h.com/2")), (18, "http://h.com/2", None),
    (19, "http://i.com/a/b/c", link("../../z/./y/..") + "<!-- " + link("http://three.net/") + " -->"), (20, "http://i.com/z/", hop("/../../w?p=/../q&#38;r")), (21, "http://i.com/w?p=/../q&r", link("http://four.net/.")),
]


def test_url_filter_equals_sql(spark):
    df = spark.createDataFrame([(*r, "old", 3) for r in PAGES], "page_id long, url string, html string, verdict string, host int")
    rows = urlfilter.filter_urls(df).collect()
    got = sorted(str((r.page_id, r.host, r.path, r.rule, r.verdict)) for r in rows)
    pages = pd.DataFrame(PAGES, columns=["page_id", "url", "html"]).astype({"page_id": "Int64"})
    con = duckdb.connect()
    con.register("pages", pages)
    assert got == sorted(map(str, con.sql(urlfilter.oracle()).fetchall()))
    clash = spark.createDataFrame([(*r, "a", "b", "c") for r in PAGES], "page_id long, url string, html string, node string, row string, __x string")
    assert sorted(str((r.page_id, r.host, r.path, r.rule, r.verdict)) for r in urlfilter.filter_urls(clash).collect()) == got
    assert urlfilter.filter_urls(clash).columns == ["page_id", "url", "node", "row", "__x", "host", "path", "rule", "verdict"]
    verdict = {r.page_id: r.verdict for r in rows}
    assert verdict[17] == verdict[18] == verdict[20] == verdict[21] == "block"
    assert verdict[2] == verdict[4] == verdict[5] == verdict[14] == verdict[None] == "block"
    assert verdict[3] == verdict[11] == verdict[6] == verdict[13] == "allow" and verdict[15] == "block"


def test_url_filter_with_links_at_scale(spark):
    """Thousands of pages in chains, stars and pairs, against recursive SQL."""
    rng = random.Random(16)
    hosts = [f"h{i}.{t}" for i in range(60) for t in ("com", "org", "example.com")] + ["a.net", "b.example.net"]
    urls = [f"http://{rng.choice(hosts)}/{rng.choice(['de', 'en', 'fr', 'x'])}/{i}" for i in range(3000)]
    rows = []
    for i, u in enumerate(urls):
        body = None if i % 5 == 0 else ""
        if i % 5 == 1:
            body = link(urls[i - 1]) + (hop(urls[i + 1]) if i % 3 else "")
        if i % 5 == 2 and i > 2000:
            body = link(urls[2000]) + link(f"../{rng.choice(['de', 'fr'])}/{i - 1}")
        rows.append((i, u, body))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    got = sorted(str((r.page_id, r.host, r.path, r.rule, r.verdict)) for r in urlfilter.filter_urls(pages).collect())
    con = duckdb.connect()
    con.register("pages", pd.DataFrame(rows, columns=["page_id", "url", "html"]))
    assert got == sorted(map(str, con.sql(urlfilter.oracle()).fetchall()))


def test_url_filter_shield_and_limits(spark):
    df = spark.createDataFrame([(1, "http://a.net/", None), (2, "http://b.com/", link("http://a.net/")), (3, "http://org/fr/", link("http://b.com/"))], "page_id long, url string, html string")
    plain = {r.page_id: r.verdict for r in urlfilter.filter_urls(df).collect()}
    freed = {r.page_id: r.verdict for r in urlfilter.filter_urls(df, shield=True).collect()}
    assert plain == {1: "block", 2: "block", 3: "allow"} and freed == {1: "block", 2: "allow", 3: "allow"}
    assert urlfilter.filter_urls(df.where("false")).count() == 0
    with pytest.raises(ValueError):
        urlfilter.filter_urls(df, rules=[("a", "/", "block")] * 600)


# -- 2: line dedup ----------------------------------------------------------------------------


def brute_lines(rows, min_docs=5, depth=3, similarity=0.7, long_tokens=20):
    """Templates of a leaf one after the other, with plain dictionaries and a tokeniser of its own."""
    star = "<*>"
    cut = lambda s: tuple(star if re.search(r"\d", w) else w for w in s.split())
    leaves, low = {}, {}
    for d, t in rows:
        if d is not None:
            low[t] = min(d, low.get(t, d))
            for k in {cut(s) for s in (t or "").split("\n")} - {()}:
                leaves.setdefault((len(k), k[:depth]), {}).setdefault(k, []).append(t)
    least = lambda texts: min(texts, key=low.get)
    keeper, long = {}, {}
    for lines in leaves.values():
        support, context, general = Counter(), {}, {}
        for k, ds in lines.items():
            support.update({(p, k[p]): len(ds) for p in range(depth, len(k))})
        for k, ds in lines.items():
            general[k] = one = tuple(w if p < depth or w != star and support[p, w] >= min_docs else star for p, w in enumerate(k))
            for p in range(depth, len(k)):
                if k[p] != star:
                    found = context.setdefault((p, one[:p], one[p + 1 :]), [set(), 0])
                    found[0].add(k[p])
                    found[1] += len(ds)
        groups = {}
        for k, ds in lines.items():
            one = general[k]
            vary = {p for p in range(depth, len(k)) if one[p] != star and len((c := context[p, one[:p], one[p + 1 :]])[0]) > 1 and c[1] >= min_docs}
            two = tuple(star if p in vary else w for p, w in enumerate(one))
            enough = lambda t: sum(w != star for w in t[depth:]) >= similarity * max(0, len(t) - depth) - 1e-9
            own = [("", k)] + [(n, t) for n, t in (("*", one), ("**", two)) if enough(t)]
            for name in own:
                groups.setdefault(name, {}).setdefault(k, set()).update(ds)
        for members in groups.values():
            found = set().union(*members.values())
            if len(found) >= min_docs:
                for k in members:
                    keeper[k] = least(found | {keeper.get(k, least(found))})
        long |= {k: least(ds) for k, ds in lines.items() if len(k) >= long_tokens and len(set(ds)) > 1 and k not in keeper}

    def rest(t):
        lines = [(s, cut(s)) for s in t.split("\n")]
        shared = sum(len(k) for _, k in lines if long.get(k, t) != t)
        go = {**keeper, **(long if 2 * shared < sum(len(k) for _, k in lines) else {})}
        return "\n".join(s for s, k in lines if go.get(k, t) == t)

    return [(d, t if t is None or d is None else rest(t)) for d, t in rows]


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(4)
    rows = [(None, "Page 7 of 9 here now"), (900, None), (901, ""), (902, "short\nlines\n\nonly")]
    for i in range(60):
        lines = [prose(rng, rng.randint(3, 12)) for _ in range(4)]
        lines.insert(rng.randint(0, 4), f"Page {i} of {i + 2} here now")
        if i % 3 == 0:
            lines.append("All rights are reserved by " + rng.choice(["us", "them", "nobody"]) + " in this land of ours")
        rows.append((i, "\n".join(lines)))
    rows.append((5, rows[9][1]))
    got = linededup.drop_lines(docs_of(spark, rows).withColumn("n_dropped", F.lit("clash")), min_docs=5)
    assert got.schema["n_dropped"].dataType.simpleString() == "int"
    assert sorted(map(str, ((r.doc_id, r.text) for r in got.collect()))) == sorted(map(str, brute_lines(rows, 5)))
    assert got.where("doc_id = 0").first().n_dropped == 0 and got.where("doc_id = 3").first().n_dropped == 2
    assert len({r.text for r in got.where("doc_id in (5, 9)").collect()}) == 2  # id 5 also has the text of 9
    clash = spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], "doc_id long, text string, row string, lines string, h string, doc string")
    assert sorted(map(str, ((r.doc_id, r.text) for r in linededup.drop_lines(clash).collect()))) == sorted(map(str, brute_lines(rows, 5)))
    assert linededup.drop_lines(docs_of(spark, rows).where("false")).count() == 0


def test_line_templates_of_one_large_leaf(spark):
    """Thousands of lines of one leaf, with fields of few and of many values."""
    rng = random.Random(14)
    words = [prose(rng, 1) for _ in range(40)]
    rows = []
    for i in range(900):
        lines = ["we all know " + " ".join(rng.choice(words) for _ in range(7)) for _ in range(6)]
        if i % 9 == 0:
            lines.append(f"we all know that {rng.choice(words[:3])} of {prose(rng, 1)} went away home")
        if i % 50 == 0:
            lines.append("we all know nothing of this at all friend")
        if i % 300 == 7:
            lines.append(" ".join(["we all know", *words[:20]]))
        rows.append((i, "\n".join(lines)))
    passage = " ".join(["we all know", *words[10:35]])
    rows += [(1000, passage + "\nshort end"), (1001, passage + "\nother end"), (1002, passage + "\nshort end"), (1003, passage + "\n" + prose(rng, 60))]  # near copies stay whole
    got = linededup.drop_lines(docs_of(spark, rows).repartition(5)).collect()
    want = brute_lines(rows)
    assert sorted((r.doc_id, r.text) for r in got) == sorted(want)
    assert sum("we all know that" in t for _, t in rows) == 100 and sum("we all know that" in t for _, t in want) <= 6
    assert sum("nothing of this" in t for _, t in want) == sum(" ".join(words[:20]) in t for _, t in want) == 1
    assert [passage in t for d, t in want if d >= 1000] == [True, True, True, False]


def test_lines_alike_only_in_leading_tokens_stay(spark):
    rows = [(i, f"Was erlytion that. word{chr(97 + i)}\nonce upon a x{chr(97 + i)} y{chr(97 + i // 2)} z") for i in range(20)]
    assert linededup.drop_lines(docs_of(spark, rows)).where("n_dropped > 0").count() == 0


def test_copies_come_out_alike(spark):
    page = "\n".join(["one two three four five six seven", " ".join(f"w{chr(97 + i)}" for i in range(25)), "the end of it all now"])
    rows = [(i, page) for i in range(8)] + [(i, f"the end of it all now\nalone {chr(97 + i)}") for i in range(8, 14)]
    got = {r.doc_id: r.text for r in linededup.drop_lines(docs_of(spark, rows)).collect()}
    assert got == dict(brute_lines(rows)) and {got[i] for i in range(8)} == {page} and all("end" not in got[i] for i in range(8, 14))


def test_short_recurring_lines_are_dropped(spark):
    rows = [(i, f"All rights reserved.\n\n版权所有不得转载\nAll rights word{chr(97 + i)}") for i in range(6)]
    got = {r.doc_id: r.text for r in linededup.drop_lines(docs_of(spark, rows)).collect()}
    assert got == {i: t if i == 0 else "\n" + t.split("\n")[3] for i, t in rows}


# -- 3: nearest neighbours ----------------------------------------------------------------------


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], lab, "s") for i, v, lab in rows], "vec_id long, embedding array<float>, label int, score string")


def test_ann_recall_and_scores(spark):
    rng = np.random.default_rng(1)
    x = (rng.standard_normal((3000, 24)) * rng.uniform(0.5, 2, (3000, 1))).astype(np.float32)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    got = ann.search(vectors_of(spark, rows), F.col("vec_id") % 20 == 0, 10, recall=0.98).collect()
    d = x.astype(np.float64)
    want, found = set(), {}
    for q in range(0, 3000, 20):
        s = d @ d[q]
        s[q] = -np.inf
        want |= {(q, int(j)) for j in np.argsort(-s, kind="stable")[:10]}
    for r in got:
        found.setdefault(r.query_id, []).append((r.rank, -r.score, r.vec_id))
        assert r.score == pytest.approx(float(d[r.query_id] @ d[r.vec_id]), abs=1e-12)
    assert len(want & {(r.query_id, r.vec_id) for r in got}) / len(want) >= 0.93
    for items in found.values():
        items.sort()
        assert [i[0] for i in items] == list(range(1, 11)) and items == sorted(items, key=lambda t: (t[1], t[2]))


def test_ann_edges(spark):
    rows = [(0, [1, 0], 0), (20, [0, 1], 0), (5, [1, 0], 0), (3, [1, 0], 0), (7, [0, 0], 0), (8, None, 0), (9, [None, 1], 0), (11, [math.nan, 1], 0), (12, [math.inf, 1], 0), (13, [1, 2, 3], 0), (40, [0, 0], 0), (None, [1, 1], 0), (60, [1, 0, 1], 0), (80, [5], 0)]
    got = ann.search(vectors_of(spark, rows), F.col("vec_id") % 20 == 0, 20).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in got] == [(0, 1, 3, 1.0), (0, 2, 5, 1.0), (0, 3, 20, 0.0), (20, 1, 0, 0.0), (20, 2, 3, 0.0), (20, 3, 5, 0.0), (60, 1, 13, 4.0)]
    assert ann.search(vectors_of(spark, rows).where("false"), F.lit(True)).count() == 0
    assert ann.search(vectors_of(spark, rows), F.lit(False)).count() == 0


def test_ann_copies_and_rows_of_one_id(spark):
    """A third of the rows are one vector; query rows share an id. Everything found equals brute force."""
    rng = np.random.default_rng(5)
    x = rng.standard_normal((240, 6)).astype(np.float32)
    x[:80] = x[0]
    ids = list(range(240))
    ids[100] = ids[120]
    got = ann.search(vectors_of(spark, [(i, v.tolist(), 0) for i, v in zip(ids, x)]).repartition(3), F.col("vec_id") % 20 == 0, 5, recall=1.0, alpha=0.0).collect()
    d, want = x.astype(float), []
    for q in range(240):
        if ids[q] % 20 == 0:
            s = np.einsum("ij,j->i", d, d[q])
            near = sorted((j for j in range(240) if j != q), key=lambda j: (-s[j], ids[j]))[:5]
            want += [(ids[q], k + 1, ids[j], round(s[j], 9)) for k, j in enumerate(near)]
    assert sorted((r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in got) == sorted(want)


def test_ann_finds_alike_whatever_the_chunks(spark, monkeypatch):
    rng = np.random.default_rng(6)
    vectors = vectors_of(spark, [(i, v.tolist(), 0) for i, v in enumerate(rng.standard_normal((600, 16)).astype(np.float32))])
    found = []
    for chunk in (8192, 40):
        monkeypatch.setattr(ann, "CHUNK", chunk)
        rows = ann.search(vectors.repartition(3), F.col("vec_id") % 20 == 0, 5, alpha=0.0).collect()
        found.append(sorted((r.query_id, r.rank, r.vec_id) for r in rows))
    assert found[0] == found[1] and len(found[0]) == 150


def test_adaptive_scan_keeps_the_near_and_abandons_the_far():
    rng = np.random.default_rng(2)
    turn = ann.Index(rng.standard_normal((30, 64)), rng.standard_normal((5, 64)), 20.0, 30, 5, 3, 0.9, 0.002, 1)
    q, x = rng.standard_normal((5, 65)), rng.standard_normal((2000, 65))
    d = ((q[:, None] - x[None]) ** 2).sum(2)
    who, which, gone, kth = ann.adaptive_scan(q, x, 10, turn.edges, turn.shares, np.full(5, np.inf))
    for i in range(5):
        near = set(np.argsort(d[i])[:10].tolist())
        assert len(near & set(which[who == i].tolist())) >= 9 and gone[i] > 1200 and kth[i] >= np.sort(d[i])[9] - 1e-9


def test_share_quantiles():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((200_000, 20)) ** 2
    for t in (2, 5, 10, 18):
        share = x[:, :t].sum(1) / x.sum(1)
        assert ann.shares(np.array([t]), 20, 0.01)[0] == pytest.approx(np.quantile(share, 0.99), abs=0.01)


# -- 4: SimHash ------------------------------------------------------------------------------


def slow_fingerprint(text):
    words = [w for w in (text or "").encode().lower().translate(bytes.maketrans(b"\t\n\v\f\r", b"     ")).split(b" ") if w]
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints(spark):
    rng = random.Random(1)
    texts = [None, "", " \t\n", "One", "ÀB c d e", "a b c d e", prose(rng, 300), "x " * 70000]
    assert [simhash.fingerprint(t) for t in texts] == [slow_fingerprint(t) for t in texts[:-1]] + [simhash.fingerprint("x x x x")]
    spark_hash = spark.createDataFrame([("a b c d",)], "t string").select(F.xxhash64("t")).first()[0]
    assert simhash.fingerprint("A b c D") == spark_hash % 2**64


def brute_classes(rows, bits=4):
    fps = [slow_fingerprint(t) for _, t in rows]
    near = [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= bits]
    comp = components(near, range(len(rows)))
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[comp[i]] = min(d, low.get(comp[i], d))
    return sorted(str((d, f"{fps[i]:016x}", low.get(comp[i]))) for i, (d, _) in enumerate(rows))


def test_simhash_equals_brute_force(spark):
    rng = random.Random(5)
    rows = [(1, None), (2, ""), (3, "a"), (3, "a"), (None, "b c"), (77, "b c"), (None, "q r s t u v")]
    for i in range(40):
        words = prose(rng, 200).split()
        for j in range(rng.choice([1, 1, 2, 6])):
            copy = words.copy()
            for _ in range(j):
                copy[rng.randrange(200)] = "edit"
            rows.append((100 + 10 * i + j, " ".join(copy)))
    df = docs_of(spark, rows)
    got = simhash.simhash_components(df).collect()
    assert sorted(str((r.doc_id, r.fingerprint, r.component_id)) for r in got) == brute_classes(rows)
    assert simhash.simhash_components(df.where("false")).count() == 0


@pytest.mark.parametrize("limit", [16384, 20])
def test_links_find_every_pair(spark, monkeypatch, limit):
    monkeypatch.setattr(simhash, "CELL_LIMIT", limit)
    monkeypatch.setattr(simhash, "BLOCK", 16)
    rng = random.Random(9)
    fps = {rng.getrandbits(64) for _ in range(50)}
    centre = rng.getrandbits(64)
    for _ in range(150):
        fps.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))))
    fps = sorted(fps)
    near = [(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 4]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    got = [(r.a % 2**64, r.b % 2**64) for r in simhash.links(df, 4).collect()]
    assert components(got, fps) == components(near, fps)
    with pytest.raises(ValueError):
        simhash.links(df, 6)


# -- 5: embedding near-dedup --------------------------------------------------------------------


def brute_links(rows, cosine):
    ok = lambda v: v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)
    x = [np.array(v, np.float32).astype(float) if ok(v) and lab is not None else None for _, v, lab in rows]
    near = [(i, j) for i in range(len(rows)) for j in range(i) if x[i] is not None and x[j] is not None and rows[i][2] == rows[j][2] and len(x[i]) == len(x[j]) and x[i] @ x[j] / math.sqrt(x[i] @ x[i]) / math.sqrt(x[j] @ x[j]) >= cosine]
    comp = components(near, range(len(rows)))
    low = {}
    for i, r in enumerate(rows):
        low[comp[i]] = min(r[0], low.get(comp[i], r[0]))
    n = [0] * len(rows)
    for i, j in near:
        n[i] += 1
        n[j] += 1
    return sorted((r[0], n[i], low[comp[i]], r[0] == low[comp[i]]) for i, r in enumerate(rows))


@pytest.mark.parametrize("block,strip", [(4096, 512), (32, 24), (4, 512)])
def test_embedding_dedup_equals_brute_force(spark, monkeypatch, block, strip):
    """One cell for a label; one in pairs of blocks; cells on all axes of the groups, also in pairs of blocks."""
    monkeypatch.setattr(embdedup, "BLOCK", block)
    monkeypatch.setattr(embdedup, "STRIP", strip)
    rng = np.random.default_rng(3)
    base = rng.standard_normal((60, 16))
    rows = [(i, (base[i % 60] * rng.uniform(1, 3) + rng.standard_normal(16) * rng.choice([0, 0.05, 0.15, 0.3])).astype(np.float32).tolist(), int(i % 60 % 2)) for i in range(420)]
    rows += [(900 + i, base[0].astype(np.float32).tolist(), 0) for i in range(30)]
    rows += [(1000, None, 0), (1001, [0.0] * 16, 0), (1002, [math.nan] + [1.0] * 15, 0), (1003, base[0].tolist(), None), (1004, [None] + [1.0] * 15, 1), (1005, [1.0, 2.0], 1), (1006, [2.0, 4.0], 1), (1007, [1.0, 2.0], 0), (1008, [3.0], 1), (1009, [9.0], 1)]
    got = embdedup.embedding_dedup(vectors_of(spark, rows), 0.98).collect()
    assert sorted(map(tuple, got)) == brute_links(rows, 0.98)
    assert embdedup.embedding_dedup(vectors_of(spark, rows).where("false")).count() == 0


def test_a_close_pair_counts_in_one_cell_only():
    rng = np.random.default_rng(7)
    x = rng.standard_normal((400, 64))
    y = x + rng.standard_normal((400, 64)) * 0.022 * np.linalg.norm(x, axis=1)[:, None]
    x, y = embdedup.projected(x), embdedup.projected(y)
    close = np.flatnonzero(np.einsum("ij,ij->i", x, y) >= 0.98)
    times = np.zeros(400, int)
    mine, theirs = (dict() for _ in range(2))
    for rows, out in ((x, mine), (y, theirs)):
        for r, g, c in zip(*embdedup.cells(rows, 0.98, 6)):
            out.setdefault(int(r), set()).add((int(g), int(c)))
    for i in close:
        times[i] = sum(bool(embdedup.counted_here(x[i : i + 1], y[i : i + 1], 0.98, 6, g, c)[0]) for g, c in mine[i] & theirs[i])
    assert len(close) > 100 and (times[close] == 1).all()


def test_collisions_reach_every_close_pair():
    rng = np.random.default_rng(4)
    turn = embdedup.rotation(64)
    x = rng.standard_normal((300, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    y = x + rng.standard_normal((300, 64)) * 0.018
    y /= np.linalg.norm(y, axis=1)[:, None]
    ok = embdedup.collisions(x @ turn, y @ turn, math.sqrt(0.04) / 2 * 1.0001, 4)
    assert ok[(x @ y.T) >= 0.98].all() and ok.mean() < 0.2


# -- 6: mixing ------------------------------------------------------------------------------------


def test_rates_match_targets(spark):
    rng = np.random.default_rng(6)
    p = rng.dirichlet([0.5, 0.5, 0.5], 400)
    t = rng.integers(1, 500, 400)
    df = spark.createDataFrame([(i, int(a), b.tolist()) for i, (a, b) in enumerate(zip(t, p))], "doc_id long, tokens long, posterior array<double>")
    model = mixing.Classifier(["a", "b", "c"])
    with pytest.raises(RuntimeError):
        mixing.fit_rates(df, model, {"a": 0.5, "b": 0.3, "c": 0.2}, tolerance=1e-9, max_rounds=2)
    one_sided = spark.createDataFrame([(i, 10, [0.5, 0.5, 0.0]) for i in range(20)], "doc_id long, tokens long, posterior array<double>")
    nearest = mixing.fit_rates(one_sided, model, {"a": 0.8, "b": 0.2, "c": 0.0})  # no document can tell a from b
    assert nearest.totals == pytest.approx([100, 100, 0], rel=1e-3) and nearest.residual == pytest.approx(0.6, rel=1e-2)
    fitted = mixing.fit_rates(df, model, {"a": 0.5, "b": 0.3, "c": 0.2}, tolerance=1e-6, max_rounds=300)
    r = fitted.rates(p)
    assert (r >= 0).all() and np.allclose((r * t) @ p, np.array([0.5, 0.3, 0.2]) * t.sum(), rtol=1e-4)
    jvm = [x[0] for x in df.orderBy("doc_id").select(mixing._rate(fitted.steps, 3)).collect()]
    assert np.allclose(jvm, r)
    slow = np.ones(400)  # plain projected gradient with the same metric
    mass = (p * t[:, None]).T @ p
    scale = 1 / np.diag(mass)
    step = 1 / np.linalg.eigvalsh(np.sqrt(scale)[:, None] * mass * np.sqrt(scale)[None]).max()
    for _ in range(len(fitted.steps)):
        slow = np.maximum(0, slow - p @ (step * scale * ((slow * t) @ p - np.array(fitted.targets))))
    assert np.allclose(slow, r)


def test_mix(spark):
    rng = random.Random(8)
    rows = [(i, prose(rng, 60) if i % 4 else " ".join(["%%% $$$"] * 40)) for i in range(300)] + [(300, None), (301, ""), (302, "ab" * 30000), (None, "x y")]
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(200)] + [(5, 1, 0), (7, None, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    df = docs_of(spark, rows)
    rated, fitted = mixing.mix(df, labels, {"0": 0.5, "1": 0.5})
    got = rated.collect()
    assert len(got) == len(rows) and all(abs(sum(r.posterior) - 1) < 1e-9 and r.residual <= 1e-4 for r in got)
    clash = df.withColumnsRenamed({"score": "u", "rule": "row"})
    assert mixing.apply_mixture(clash, fitted).columns == ["doc_id", "text", "u", "row"]
    held = [r for r in got if r.doc_id is not None and 200 <= r.doc_id < 300]
    assert sum((r.posterior[1] > 0.5) == (r.doc_id % 4 > 0) for r in held) >= 98
    total = sum(r.tokens for r in got)
    assert fitted.totals == pytest.approx([total / 2] * 2, rel=0.01)
    out = mixing.apply_mixture(df, fitted).collect()
    copies = {r.doc_id: r.copies for r in got}
    assert {k: sum(o.doc_id == k for o in out) for k in copies} == copies and out[0].score == "x"
    assert mixing.mix(df.where("false"), labels)[0].count() == 0
    flat, _ = mixing.mix(df, labels.where("false"), {"0": 0.5, "1": 0.5})
    assert all(r.posterior == [0.5, 0.5] and r.copies == 1 for r in flat.collect())
    with pytest.raises(ValueError):
        mixing.mix(df, labels, {})


# -- 7 and 8: tokens ----------------------------------------------------------------------------------


def test_token_ids():
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(tokens.vocabulary("byte_bpe_50k.json"))
    rng = random.Random(2)
    texts = ["", "a", " lead  two\n\n\ttabs ", "don't we'll I'M", "日本語 ñandú ÀÉ 🙂👍🏽", "<|endoftext|> x<|endoftext|>", "x" * 3000, " " * 500 + "y", "  a\r\n", "1234567 3.14", "%%%*** &&&$$$"]
    texts += ["".join(rng.choice(["ab", " ", "\n", "é", "9", "!", "中", "<|endoftext|>", "'s", "\t"]) for _ in range(80)) for _ in range(150)]
    texts += [" " * 1_200_000 + "y", "\n" * 1_200_000]  # on which the faster engine panics
    for t in texts:
        assert tokens.encode(t).tolist() == exact.encode(t, add_special_tokens=False).ids
    assert len(tokens.encode(None)) == 0


@pytest.mark.parametrize("n", [1, 2, 3, 10, 1000, 4097])
def test_slots_are_a_permutation(n):
    slots = trainorder.slot_of(np.arange(n), n, 7)
    assert sorted(slots.tolist()) == list(range(n)) and (trainorder.number_of(slots, n, 7) == np.arange(n)).all()
    assert n < 1000 or (slots != trainorder.slot_of(np.arange(n), n, 8)).any()


def slow_order(rows, keys, groups, stride, key):
    """The sequences by number and by slot, from plain lists. keys: (group, text hash) of each row."""
    streams = {}
    order = sorted(range(len(rows)), key=lambda i: (keys[i][0], rows[i][0] is not None, rows[i][0] or 0, keys[i][1]))
    for i in order:
        streams.setdefault(keys[i][0], []).extend([*tokens.encode(rows[i][1]).tolist(), 50256])
    numbered = []
    for g in sorted(streams):
        s = streams[g]
        numbered += [s[i : i + stride] for i in range(0, len(s), stride)]
    slots = trainorder.slot_of(np.arange(len(numbered)), len(numbered), key)
    laid = [None] * len(numbered)
    for n, s in zip(numbered, slots.tolist()):
        laid[s] = n + [50256] * (stride - len(n))
    return laid, sum(map(len, numbered))


def test_training_order_equals_plain_lists_on_any_layout(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, prose(rng, rng.randint(0, 90))) for i in range(120)] + [(120, None), (5, "again"), (5, "again"), (121, ""), (None, "z" * 20000), (None, "q")]
    docs = docs_of(spark, rows)
    hashed = docs.select("doc_id", "text", F.xxhash64("text").alias("key"), F.pmod(F.xxhash64(F.lit(11), "doc_id", F.xxhash64("text")), F.lit(-(-len(rows) // 20))).alias("grp")).collect()
    want, total = slow_order([(r.doc_id, r.text) for r in hashed], [(r.grp, r.key) for r in hashed], 0, 16, 7)
    sums = []
    for k, parts in enumerate((1, 3, 7)):
        folder = f"file://{tmp_path}/out{k}"
        meta = sorted(trainorder.training_order(docs.repartition(parts), folder, stride=16, per_shard=8, group_docs=20, waves=k + 1).collect())
        n = sum(m.n_sequences for m in meta)
        assert [m.first_slot for m in meta] == list(range(0, n, 8)) and sum(m.n_ids for m in meta) == total and n == len(want)
        for m in meta:
            raw = open(m.path, "rb").read()
            assert len(raw) == m.n_bytes == 32 * m.n_sequences and zlib.crc32(raw) == m.crc32
        assert [x.tolist() for x in trainorder.read_slots(folder, 0, n, 16, 8)] == want
        assert [x.tolist() for x in trainorder.read_slots(folder, 13, 9, 16, 8)] == want[13:22]
        sums.append([m.crc32 for m in meta])
    assert sums[0] == sums[1] == sums[2]
    assert trainorder.training_order(docs.where("false")).count() == 0


def test_training_order_resumes(spark, tmp_path):
    """A repeated wave leaves the same files, also over leftovers of a lost task."""
    docs = docs_of(spark, [(i, f"text number {i} " * 9) for i in range(60)])
    folder = f"file://{tmp_path}/out"
    first = sorted(trainorder.training_order(docs, folder, stride=16, per_shard=8).collect())
    files = {m.path: open(m.path, "rb").read() for m in first}
    open(first[0].path, "wb").write(b"half")
    open(first[1].path + ".99", "wb").write(b"rest of a lost task")
    assert sorted(trainorder.training_order(docs, folder, stride=16, per_shard=8).collect()) == first
    assert {m.path: open(m.path, "rb").read() for m in first} == files


def naive_ffd(lengths, capacity):
    free, bins = [], []
    for i in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        b = next((k for k, f in enumerate(free) if f >= lengths[i]), len(free))
        free[b:] = free[b:] or [capacity]
        free[b] -= lengths[i]
        bins.append((i, b))
    return dict(bins)


def test_tournament_equals_naive_first_fit():
    rng = random.Random(1)
    for _ in range(40):
        lengths = [rng.randint(1, 64) for _ in range(rng.randint(0, 90))]
        bins, offsets = packing.first_fit_decreasing(lengths, 64)
        assert dict(enumerate(bins)) == naive_ffd(lengths, 64)
        for b in set(bins):
            parts = sorted((offsets[i], lengths[i]) for i in range(len(bins)) if bins[i] == b)
            assert parts[0][0] == 0 and all(x[0] + x[1] == y[0] for x, y in zip(parts, parts[1:])) and sum(parts[-1]) <= 64


def check_packing(rows, got, capacity):
    want = sorted((str(d), len(ids := np.append(tokens.encode(t), 0).astype("<u4")), zlib.crc32(ids.tobytes())) for d, t in rows)
    by_doc, bins = {}, {}
    for r in got:
        by_doc.setdefault((str(r.doc_id), r.doc_tokens), []).append(r)
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sum(r.length for r in got) == sum(w[1] for w in want)
    for parts in bins.values():
        parts.sort()
        at = 0
        for o, n in parts:
            assert o == at and n > 0
            at += n
        assert at <= capacity
    return want, by_doc, bins


def test_packing(spark):
    rng = random.Random(7)
    rows = [(i, prose(rng, rng.choice([0, 3, 40, 300]))) for i in range(150)] + [(150, None), (3, "again"), (None, "x y z"), (152, "long " * 30000)]
    got = packing.pack(docs_of(spark, rows).repartition(3), 128, 50).collect()
    assert sorted(map(str, packing.pack(docs_of(spark, rows).repartition(7), 128, 50).collect())) == sorted(map(str, got))
    _, by_doc, bins = check_packing(rows, got, 128)
    ids = {(str(d), len(tokens.encode(t)) + 1): np.append(tokens.encode(t), 0).astype("<u4") for d, t in rows}
    for key, parts in by_doc.items():
        if len({p.start for p in parts}) == len(parts):
            parts.sort(key=lambda p: p.start)
            assert [p.start for p in parts] == [0, *np.cumsum([p.length for p in parts])[:-1]]
        for p in parts:
            assert p.ids_crc32 == zlib.crc32(ids[key][p.start : p.start + p.length].tobytes())
    used = sum(n for b in bins.values() for _, n in b)
    assert used / (128 * len(bins)) > 0.93
    assert packing.pack(docs_of(spark, rows).where("false")).count() == 0


# -- 9: suffix dedup ------------------------------------------------------------------------------------


def brute_groups(text, n):
    ring, out = bytes(text) * (2 + n // len(text)), {}
    for i in range(len(text)):
        out.setdefault(ring[i : i + n], []).append(i)
    return sorted(map(tuple, out.values()))


def test_interval_expansion():
    rng = np.random.default_rng(1)
    for trial in range(150):
        t = rng.integers(0, rng.integers(1, 5), rng.integers(1, 200)).astype(np.uint8)
        t = np.concatenate([t, t[: len(t) // 2], t[len(t) // 3 :]]) if trial % 2 else t
        n = int(rng.integers(1, 60))
        order, starts = bwt.common_prefix_groups(t, n)
        assert sorted(tuple(sorted(g.tolist())) for g in np.split(order, starts[1:])) == brute_groups(t, n)


def brute_suffix(rows, n):
    key = lambda d: math.inf if d is None else d
    low = {}
    texts = [(d, (t or "").encode()) for d, t in rows]
    for d, t in texts:
        for i in range(len(t) - n + 1):
            low[t[i : i + n]] = min(key(d), low.get(t[i : i + n], math.inf))
    out = []
    for d, t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - n + 1):
            if low[t[i : i + n]] < key(d):
                gone[i : i + n] = True
        edge = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8))).reshape(-1, 2).tolist()
        out.append(str((d, len(t), hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest(), edge)))
    return sorted(out)


@pytest.mark.parametrize("chunk,block,entries", [(768 << 10, 1 << 16, 4096), (1500, 64, 4096), (700, 64, 3)])
def test_suffix_dedup_equals_brute_force(spark, monkeypatch, chunk, block, entries):
    """Whole chunks; small ones; ranges whose entries meet in parts first."""
    monkeypatch.setattr(suffix, "BLOCK", block)
    monkeypatch.setattr(suffix, "ENTRIES", entries)
    monkeypatch.setattr(suffix, "GROUP", 400)
    real = suffix.chunks
    monkeypatch.setattr(suffix, "chunks", lambda d, i, t: real(d, i, t, chunk))
    rng = random.Random(6)
    parts = [prose(rng, 25) for _ in range(12)] + ["aaaa " * 40, "é" * 70]
    rows = [(i, " ".join(rng.choice([prose(rng, 8), rng.choice(parts), rng.choice(parts)[3:90]]) for _ in range(rng.randint(0, 6)))) for i in range(70)]
    rows += [(70, None), (71, ""), (72, "x" * 49), (73, "x" * 50), (74, "x" * 51), (None, parts[0]), (None, parts[0] + "!"), (9, parts[1] * 2), (9, parts[1]), (-5, parts[2])]
    got = suffix.suffix_dedup(docs_of(spark, rows).repartition(3), 50).collect()
    assert sorted(str((r.doc_id, r.n_bytes, hashlib.sha256(bytes(r.kept)).hexdigest(), [[s.start, s.end] for s in r.spans])) for r in got) == brute_suffix(rows, 50)
    assert suffix.suffix_dedup(docs_of(spark, rows).where("false")).count() == 0
    with pytest.raises(ValueError):
        suffix.suffix_dedup(docs_of(spark, rows), 4)


# -- 10: toxicity ------------------------------------------------------------------------------------


def dense_marginals(chain, extra):
    n = len(extra)
    u = np.stack([np.ones(n), np.exp(chain.bias + np.array(extra))], 1)
    a = np.exp(chain.trans)
    f, b = np.zeros((n, 2)), np.ones((n, 2))
    f[0] = np.exp(chain.start) * u[0]
    for t in range(1, n):
        f[t] = (f[t - 1] @ a) * u[t]
        f[t] /= f[t].sum()
    for t in range(n - 2, -1, -1):
        b[t] = a @ (u[t + 1] * b[t + 1])
        b[t] /= b[t].sum()
    g = f * b
    return g[:, 1] / g.sum(1)


def test_sparse_forward_backward_is_exact():
    rng = np.random.default_rng(2)
    for _ in range(20):
        chain = toxicity.Chain(bias=-2.0, trans=rng.standard_normal((2, 2)), start=rng.standard_normal(2))
        n = int(rng.integers(1, 60))
        extra = np.where(rng.random(n) < 0.2, rng.normal(3, 1, n), 0)
        at = np.flatnonzero(extra)
        if len(at):
            assert np.allclose(toxicity.marginals(chain, at, extra[at], n), dense_marginals(chain, extra)[at])


def toxic_rows(rng, n):
    bad = ["idiot", "moron", "scum", "worthless", "vilestuff", "vilething", "vileword"]
    rows, labels = [], []
    for i in range(n):
        words = prose(rng, rng.randint(20, 200)).split()
        toxic = rng.random() < 0.2
        for _ in range(rng.randint(3, 8) if toxic else 0):
            words[rng.randrange(len(words))] = rng.choice(bad)
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_toxicity_held_out(spark):
    rows, labels = toxic_rows(random.Random(11), 900)
    extra = [(5000, None), (5001, ""), (5002, "idiot " * 20000), (None, "You MORON, scum!"), (3, rows[3][1])]
    df = docs_of(spark, rows + extra)
    lab = spark.createDataFrame([(i, t, "z") for i, t in labels[:700]] + [(1, 0, "z"), (2, None, "z"), (None, 1, "z")], "doc_id long, toxic int, text string")
    chain = toxicity.train(df, lab)
    got = toxicity.score_documents(df, chain).collect()
    truth = dict(labels)
    held = [(r.score >= 0.5, truth[r.doc_id]) for r in got if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert sum(a == bool(b) for a, b in held) / len(held) > 0.98 and all(0 <= r.score <= 1 for r in got)
    one = next(r for r in got if r.doc_id is None)
    assert one.score > 0.5 and ["You MORON, scum!"[s.start : s.end] for s in one.spans] in (["MORON, scum"], ["MORON", "scum"])
    assert {r.score for r in got if r.doc_id in (5000, 5001)} == {next(r.score for r in got if r.doc_id == 5000)}
    left = toxicity.drop_toxic(df, chain).collect()
    assert len(left) == sum(r.score < 0.5 for r in got) and left[0].rule == "y"
    assert toxicity.score_documents(df.where("false"), chain).count() == 0
    blind = toxicity.train(df, lab.where("toxic = 0"))
    assert {r.score for r in toxicity.score_documents(df, blind).collect()} == {0.0}


def slow_score(chain, text):
    """Score and spans of a text from dense forward-backward over all its words."""
    found = [(m.start(), m.end(), m.group().lower()) for m in re.finditer(r"\w+", text or "")]
    extra = [chain.weights.get(w, 0.0) + sum(chain.weights.get(w[:n] + "^", 0.0) for n in (3, 4, 5, 6) if len(w) > n) for _, _, w in found]
    p = np.where(np.array(extra) != 0, dense_marginals(chain, extra), 0.0) if found else np.zeros(0)
    spans, last = [], -2
    for i in np.flatnonzero(p >= 0.5).tolist():
        if i == last + 1:
            spans[-1] = (spans[-1][0], found[i][1])
        else:
            spans.append(found[i][:2])
        last = i
    z = chain.platt @ np.array([1, p.max(initial=0), math.log1p(p.sum())])
    return 1 / (1 + math.exp(-z)), spans


def test_toxicity_equals_dense_scoring(spark):
    rows, labels = toxic_rows(random.Random(13), 500)
    rows += [(900, None), (901, ""), (902, "\u0130stanbul: you are a moron today"), (903, "\u0130\u0130\u0130 scum, vileword moron. fine idiot!"), (904, "MORON"), (905, "moron " * 300)]
    df = docs_of(spark, rows)
    chain = toxicity.train(df, spark.createDataFrame(labels, "doc_id long, toxic int"))
    texts, shown = dict(rows), {}
    for r in toxicity.score_documents(df, chain).collect():
        score, spans = slow_score(chain, texts[r.doc_id])
        assert r.score == pytest.approx(score, abs=1e-9) and [(s.start, s.end) for s in r.spans] == spans
        shown[r.doc_id] = [texts[r.doc_id][s.start : s.end] for s in r.spans]
    assert shown[902] == ["moron"] and "scum" in shown[903][0]


def test_feature_counts_are_exact():
    rng = random.Random(15)
    texts = [prose(rng, 60) + " \u0130stanbul" for _ in range(40)]
    plain = Counter(f for t in texts for f in {f for w in re.findall(r"\w+", t) for f in toxicity.features(w.lower())})
    assert toxicity._presence(texts, 5) == {f: n for f, n in plain.items() if n >= 5}
    some = set(list(plain)[::3])
    assert toxicity._presence(texts, 1, some) == {f: n for f, n in plain.items() if f in some}


def test_training_never_sees_the_held_out_fold(spark):
    rows, labels = toxic_rows(random.Random(12), 300)
    out = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    a = spark.createDataFrame(labels, "doc_id long, toxic int")
    b = spark.createDataFrame([(i, 1 - t if out(i) else t) for i, t in labels], "doc_id long, toxic int")
    x, y = (toxicity.train(docs_of(spark, rows), z) for z in (a, b))
    assert x.weights == y.weights and (x.platt == y.platt).all()
