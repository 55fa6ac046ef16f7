"""Benchmark decontamination by a distributed positional inverted index.

DataFrame functions only. Every token of the training documents becomes a
posting (term, document, place). Postings stay with the task that read their
document, sorted by term within it, so a stored file is the index of a segment
of documents: building it shuffles nothing, and a term's places are one run of
a segment's file, which takes a few bytes a posting.

Phrases are looked up from their rarest term: its postings, moved back by the
term's offset, are the places where a phrase may start. Those are intersected
with the postings of the second rarest term, moved likewise; what is left is
intersected with all other terms' lists at once, and an occurrence is a start
that every list holds (a bit a term, combined on the map side). Lists of common
terms are read only near surviving starts: a set of at most ``GATE`` hashes of
(document, stretch of 64 places) is broadcast and drops all other postings
before they are shuffled. Postings and starts meet by document and place, so a
term or a document that is a third of the corpus is no hot key.

With ``slop`` the match is one of proximity: every word lies within ``slop``
places of where the phrase, put at its rarest word, has it.

A term is a 64-bit hash of its word; a collision with a test word needs some
10^13 distinct words a million test words, and would count only if the rest of
the phrase stood around it.

Defined cases: null and blank texts have no words and no matches; an item
shorter than a window but not blank is one window; rows of equal id and text
come out alike, rows of one id and different texts by their own text; a null id
is an id like any other for documents, and items without id hit words but are
not counted or named; an empty table on either side gives no matches, and one
row per document all the same; extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop, materialise

#: words in lower case, and before capitals (A-Z only) are lowered
WORD, CASED = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WINDOW = 10
#: rows up to which terms are broadcast (32 bytes each); more are shuffled
FEW = 1 << 18
#: hashes of the set that lets postings through, and places in a stretch
GATE, STRETCH = 1 << 20, 64


def _lower(word: Column) -> Column:
    """A-Z only; other letters stay. Words in ASCII take the fast way."""
    plain = F.octet_length(word) == F.length(word)
    return F.when(plain, F.lower(word)).when(~word.rlike("[A-Z]"), word).otherwise(F.translate(word, UPPER, LOWER))


def _words(text: Column) -> Column:
    """The words of a text; their capitals are lowered one word at a time, not the whole text at once."""
    return F.regexp_extract_all(text, F.lit(CASED), F.lit(0))


def _key(id_col: str, text_col: str) -> list[Column]:
    text = F.col(f"`{text_col}`").cast("string")
    return [F.col(f"`{id_col}`").cast("long").alias("doc"), F.xxhash64(text).alias("body"), text.alias("text")]


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(term, doc, body, place): the postings of every token; ``body`` is a hash of the text, for ids that repeat."""
    rows = docs.select(*_key(id_col, text_col)).select("doc", "body", F.posexplode(_words(F.col("text"))).alias("place", "word"))
    rows = rows.select(F.xxhash64(_lower(F.col("word"))).alias("term"), "doc", "body", "place")
    return materialise(rows.sortWithinPartitions("term", "doc", "body", "place"), "postings")


def phrases(items: DataFrame, window: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The distinct windows of the items, (phrase, n, k, term) with a row a word, and which items have them, (phrase, item)."""
    words = items.select(F.col(f"`{id_col}`").alias("item"), _words(F.col(f"`{text_col}`").cast("string")).alias("words")).where("size(words) > 0")
    words = words.withColumn("words", F.transform("words", _lower))
    at = F.explode(F.sequence(F.lit(0), F.greatest(F.size("words") - window, F.lit(0)))).alias("at")
    cut = words.select("item", "words", at).select("item", F.slice("words", F.col("at") + 1, window).alias("words")).distinct()
    cut = materialise(cut, "phrases-cut")
    ids = materialise(cut.select("words").distinct().withColumn("phrase", F.monotonically_increasing_id()), "phrases")
    terms = ids.select("phrase", F.size("words").alias("n"), F.posexplode("words").alias("k", "word")).select("phrase", "n", "k", F.xxhash64("word").alias("term"))
    return materialise(terms, "phrases-terms"), materialise(cut.join(ids, "words").select("phrase", "item"), "phrases-items")


def _near(place: Column) -> Column:
    return F.pmod(F.xxhash64("doc", "body", F.floor(place / STRETCH)), F.lit(GATE)).alias("gate")


def matches(index: DataFrame, terms: DataFrame, slop: int = 0) -> DataFrame:
    """(phrase, n, doc, body, start): where the phrases of ``terms`` (phrase, n, k, term) occur.

    Exactly, or with every word within ``slop`` places of its own, counted from
    the place of the phrase's rarest word. Phrases have at most 62 words.
    """
    if slop < 0:
        raise ValueError("slop must not be negative")
    if terms.where("n > 62").limit(1).count():
        raise ValueError("phrases have at most 62 words")
    small = F.broadcast if terms.limit(FEW + 1).count() <= FEW else (lambda table: table)

    def lists(of: DataFrame) -> DataFrame:
        return index.join(small(of.select("term").distinct()), "term", "left_semi")

    def probes(starts: DataFrame, of: DataFrame) -> DataFrame:
        place = F.col("start") + F.col("k")
        place = F.explode(F.sequence(place - slop, place + slop)) if slop else place
        return starts.join(small(of.select("phrase", "k", "term")), "phrase").select(*starts.columns, "k", "term", place.alias("place"))

    def held(asked: DataFrame, postings: DataFrame) -> DataFrame:
        same = [asked[c] == postings[c] for c in ("body", "place", "term")]
        return asked.join(postings, reduce(and_, same, asked["doc"].eqNullSafe(postings["doc"])), "left_semi")

    counts = materialise(lists(terms).groupBy("term").agg(F.count("*").alias("n_postings")), "phrases-counts")
    rarity = F.expr("row_number() over (partition by phrase order by n_postings, k)").alias("rarity")
    # a phrase with a term that the corpus lacks can't occur
    whole = F.expr("count(n_postings) over (partition by phrase)") == F.col("n")
    ranked = terms.join(counts, "term", "left").withColumn("whole", whole).where("whole").select("phrase", "n", "k", "term", rarity)
    ranked = materialise(ranked, "phrases-ranked")
    first, second, rest = ranked.where("rarity = 1"), ranked.where("rarity = 2"), ranked.where("rarity > 2")

    key = ["phrase", "n", "doc", "body", "start"]
    starts = index.join(small(first), "term").select("phrase", "n", "doc", "body", (F.col("place") - F.col("k")).alias("start")).where("start >= 0")
    starts = materialise(starts, "phrases-starts")
    two = held(probes(starts.where("n > 1"), second), lists(second)).select(*key)
    left = materialise(two.unionByName(starts.where("n = 1")).distinct(), "phrases-survivors")
    asked = probes(left, rest)
    near = lists(rest).withColumn("gate", _near(F.col("place"))).join(F.broadcast(asked.select(_near(F.col("place"))).distinct()), "gate", "left_semi")
    found = held(asked, near).groupBy(*key).agg(F.bit_or(F.expr("shiftleft(1L, k)")).alias("held")).where("bit_count(held) = n - 2").drop("held")
    out = materialise(found.unionByName(left.where("n <= 2")), "phrases-matches")
    drop(counts, ranked, starts, left)
    return out


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, slop: int = 0, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """(id, n_words, n_hit, items, contaminated) for every row of ``docs``.

    ``n_hit`` counts the words within occurrences (from start to start + length
    - 1), ``items`` lists the items with such windows, sorted as strings.
    """
    index = build_index(docs, id_col, text_col)
    terms, of = phrases(items, window, item_col)
    found = matches(index, terms, slop)
    hit = found.select("doc", "body", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n") - 1)).alias("place")).distinct()
    hit = hit.groupBy("doc", "body").agg(F.count("*").alias("n_hit"))
    named = found.select("doc", "body", "phrase").distinct().join(of, "phrase").where("item is not null")
    named = named.select("doc", "body", F.col("item").cast("string").alias("item")).distinct().groupBy("doc", "body").agg(F.sort_array(F.collect_list("item")).alias("items"))
    words = index.groupBy("doc", "body").agg((F.max("place") + 1).alias("n_words"))
    stats = words
    for table in (hit, named):
        table = materialise(table, "decontam-hits")
        same = stats["doc"].eqNullSafe(table["doc"]) & (stats["body"] == table["body"])
        stats = stats.join(table, same, "left").select(*[stats[c] for c in stats.columns], table[table.columns[-1]])
    stats = materialise(stats, "decontam-documents")
    rows = docs.select(*_key(id_col, text_col)).drop("text")
    none = F.lit(0).cast("long")
    return rows.join(stats, rows["doc"].eqNullSafe(stats["doc"]) & (rows["body"] == stats["body"]), "left").select(
        rows["doc"].alias(id_col), F.coalesce(F.col("n_words").cast("long"), none).alias("n_words"), F.coalesce("n_hit", none).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.col("n_hit").isNotNull().alias("contaminated"),
    )


def oracle(window: int = WINDOW) -> str:
    """The digest of ``op12_decontam`` as DuckDB SQL."""
    words = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}')"
    return rf"""
with doc as (select row_number() over () as r, doc_id, {words} as w from documents),
item as (select item_id::varchar as item, {words} as w from benchmark),
size as (select distinct least(len(w), {window}) as n from item where len(w) > 0),
asked as (select distinct item, list_slice(w, i + 1, i + {window}) as words from (select item, w, unnest(range(greatest(len(w) - {window - 1}, 1))) as i from item where len(w) > 0)),
gram as (select r, i, list_slice(w, i + 1, i + n) as words from (select r, w, n, unnest(range(len(w) - n + 1)) as i from doc, size where len(w) >= n)),
found as (select r, i, words, item from gram join asked using (words)),
hit as (select r, count(distinct place) as n from (select r, unnest(range(i, i + len(words))) as place from found) group by r),
named as (select r, list_sort(list(distinct item)) as items from found where item is not null group by r)
select doc_id, len(w)::bigint as n_words, coalesce(hit.n, 0)::bigint as n_hit, coalesce(len(items), 0)::bigint as n_items,
  sha256(coalesce(list_aggregate(items, 'string_agg', ','), '')) as items_sha256, coalesce(hit.n, 0) > 0 as contaminated
from doc left join hit using (r) left join named using (r)"""
