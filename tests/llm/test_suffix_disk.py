"""What suffix removal moves and keeps on disk."""

import random

from tessera.llm import suffix

from test_small_operators import brute_suffix, docs_of, prose


def test_texts_are_not_shuffled_again(spark):
    """The joins on chunks find the texts bucketed; only hashes and answers move."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = suffix.suffix_dedup(docs_of(spark, [(i, "the same words again " * 9) for i in range(9)]), 50)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "Bucketed: true" in plan
    assert plan.count("Exchange") == 2, plan  # hashes and answers


def test_entries_in_parts_are_dropped_round_by_round(spark, monkeypatch):
    """Beyond ``ENTRIES`` chunks the entries take a share of the ranges at a time, and go when it is answered."""
    open_, most, real_drop, real_make = set(), [], suffix.drop, suffix.materialise
    made = {}

    def make(df, label, *a):
        out = real_make(df, label, *a)
        if label in ("suffix-entries", "suffix-parts"):
            open_.add(id(out))
            made[label] = made.get(label, 0) + 1
            most.append(len(open_))
        return out

    def drop(*tables):
        open_.difference_update(map(id, tables))
        real_drop(*tables)

    monkeypatch.setattr(suffix, "materialise", make)
    monkeypatch.setattr(suffix, "drop", drop)
    monkeypatch.setattr(suffix, "ENTRIES", 3)
    real = suffix.chunks
    monkeypatch.setattr(suffix, "chunks", lambda d, i, t: real(d, i, t, 700))
    rng = random.Random(3)
    parts = [prose(rng, 20) for _ in range(6)]
    rows = [(i, " ".join([prose(rng, 5), rng.choice(parts), rng.choice(parts)])) for i in range(40)]
    got = suffix.suffix_dedup(docs_of(spark, rows), 50).collect()
    assert sorted((r.doc_id, r.n_bytes, [[s.start, s.end] for s in r.spans]) for r in got) == sorted((d, n, e) for d, n, _, e in map(eval, brute_suffix(rows, 50)))
    assert made["suffix-entries"] == 1 + suffix.ROUNDS  # hashes once, fragments by shares
    assert not open_ and max(most) == 2
