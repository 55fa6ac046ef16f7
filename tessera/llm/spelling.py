"""Spelling variants of a corpus's words, by full neighbourhood generation.

Every word of the vocabulary emits all distinct strings that one deletion, one
replacement or one insertion over the observed alphabet makes of it; a hash
join of these candidates with the vocabulary gives its near words exactly, and
no distance is computed. An insertion next to an equal letter is made at the
run's end only, a deletion from a run of equal letters at its start only, so no
candidate comes twice.

A word of ten letters has some nine hundred candidates, of which a handful are
words. So the candidates are tested where they are made: their polynomial
hashes follow from the word's prefix and suffix hashes by array arithmetic, and
only those whose bits are set in a Bloom filter of the vocabulary become
strings and rows of the join. The filter has 16 bits a word and at most
``MAX_BITS``; one that is too small for the vocabulary lets more rows through
and changes no result.

Words are counted by task in a bounded counter, then summed with map-side
combining, so a word that makes up a third of a corpus costs a row a task.

Defined cases: a null or blank text has no words; a null id counts as an empty
one where the id enters a hash; repeated rows and ids count once each; ties of
the largest count go to the smallest word in code-point order; an empty table
gives an empty result; extra columns are ignored. Words may be of any length.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop, materialise

RUN = re.compile("[A-Za-zÀ-ÿ]+")
#: a run loses a code point where this divides its checksum
TYPO = 199
MIN_LENGTH, MIN_COUNT, RATIO = 6, 5, 5
#: distinct words that a task holds before it hands its counts on
HELD = 400_000
#: bits of the filter: a word, and at most (16 MiB)
WORD_BITS, MAX_BITS = 16, 1 << 27
PROBES = 4
BASE = np.uint64(0x9E3779B97F4A7C15)
#: array elements of a chunk of candidates, and code points beyond which a word's candidates are not made strings
CHUNK, LONG = 1 << 20, 64


def word_counts(text: str | None, doc_id: int | None, typo: int = TYPO, min_length: int = MIN_LENGTH) -> Counter:
    """Words of one whole text with their counts, after the deletions that the checksums ask for."""
    out: Counter = Counter()
    if not text:
        return out
    low = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")  # bytes: A to Z only
    salt = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, n in Counter(RUN.findall(low)).items():
        if len(run) < min_length:
            continue
        h = zlib.crc32(run.encode(), salt)
        if h % typo == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
            if len(run) < min_length:
                continue
        out[run] += n
    return out


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, typo: int = TYPO) -> DataFrame:
    """(word, n): the words of at least ``min_length`` code points that occur ``min_count`` times or more."""
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def rows(held: Counter):
        items = list(held.items())
        for i in range(0, len(items), 50_000):
            words, counts = zip(*items[i : i + 50_000])
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(counts, pa.int64())], schema=schema)

    def run(batches):
        held: Counter = Counter()
        for b in batches:
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                held.update(word_counts(t, d, typo, min_length))
                if len(held) > HELD:
                    yield from rows(held)
                    held.clear()
        yield from rows(held)

    plain = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return plain.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def _mix(h: np.ndarray, probe: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9 + 2 * probe)
    return h ^ (h >> np.uint64(29))


def _powers(n: int) -> np.ndarray:
    return np.multiply.accumulate(np.r_[np.uint64(1), np.full(n, BASE)])


def _by_length(words: list[str]):
    """(indices, matrix of code points) of the words of each length."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        step = max(1, CHUNK // max(size, 1))
        for i in range(0, len(at), step):
            part = at[i : i + step]
            yield part, np.frombuffer("".join(words[k] for k in part.tolist()).encode("utf-32-le"), "<u4").reshape(-1, size).astype(np.uint64)


def word_hashes(words: list[str]) -> np.ndarray:
    out = np.zeros(len(words), np.uint64)
    for at, codes in _by_length(words):
        out[at] = (codes * _powers(codes.shape[1])[:-1][::-1]).sum(1, dtype=np.uint64)
    return out


def _filter(words: DataFrame, n: int) -> tuple:
    """(bits, broadcast): a Bloom filter of the column ``word``; at most one row for every 64 bits reaches the driver."""
    size = min(MAX_BITS, 1 << max(10, int(WORD_BITS * n - 1).bit_length()))
    schema = pa.schema([("cell", pa.int64()), ("bit", pa.int64())])

    def run(batches):
        for b in batches:
            h = word_hashes(b.column(0).to_pylist())
            at = np.concatenate([_mix(h, k) & np.uint64(size - 1) for k in range(PROBES)])
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], schema=schema)

    cells = words.select("word").mapInArrow(run, "cell long, bit long").groupBy("cell").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(size >> 6, np.int64)
    out[cells.column("cell").to_numpy()] = cells.column("bits").to_numpy()
    return size, words.sparkSession.sparkContext.broadcast(out.tobytes())


CUT, PUT, SWAP = 0, 1, 2


def edits(words: list[str], alphabet: str, seen=lambda h: np.ones(h.shape, bool)):
    """Arrays (index of the word, kind, place, letter, hash, length) of all distinct strings at one edit over ``alphabet`` whose hash ``seen`` lets through."""
    letters = np.frombuffer(alphabet.encode("utf-32-le"), "<u4").astype(np.uint64)

    def found(kind, hit, hashes, at, places, size):
        where = np.nonzero(hit)
        r, k, a = where if len(where) == 3 else (*where, np.zeros(len(where[0]), np.int64))
        if len(r):
            yield at[r], np.full(len(r), kind, np.int8), places[k], a, hashes[where], np.full(len(r), size)

    for at, codes in _by_length(words):
        m, size = codes.shape
        power = _powers(size + 1)
        before = np.zeros((m, size + 1), np.uint64)  # hash of the first i letters
        for i in range(size):
            before[:, i + 1] = before[:, i] * BASE + codes[:, i]
        after = np.zeros((m, size + 2), np.uint64)  # share of the letters from i on
        after[:, :size] = (codes * power[:size][::-1])[:, ::-1].cumsum(1, dtype=np.uint64)[:, ::-1]
        step = max(1, CHUNK // (m * max(1, len(letters))))
        for lo in range(0, size + 1, step):
            i = np.arange(lo, min(lo + step, size + 1))
            j = i[i < size]
            put = before[:, i, None] * power[size + 1 - i][None, :, None] + letters * power[size - i][None, :, None] + after[:, i, None]
            own = np.zeros((m, len(i)), np.uint64)  # no letter after the last
            own[:, : len(j)] = codes[:, j]
            other = letters != own[:, :, None]  # neither the letter that is there, nor one more of a run before its end
            yield from found(PUT, other & seen(put), put, at, i, size + 1)
            if not len(j):
                continue
            swap = before[:, j, None] * power[size - j][None, :, None] + letters * power[size - 1 - j][None, :, None] + after[:, j + 1, None]
            yield from found(SWAP, other[:, : len(j)] & seen(swap), swap, at, j, size)
            cut = before[:, j] * power[size - 1 - j][None, :] + after[:, j + 1]
            first = np.ones((m, len(j)), bool)
            inner = j > 0
            first[:, inner] = codes[:, j[inner]] != codes[:, j[inner] - 1]
            yield from found(CUT, first & seen(cut), cut, at, j, size - 1)


def neighbourhood(words: list[str], alphabet: str, seen=lambda h: np.ones(h.shape, bool)):
    """(index of the word, candidate) of the same strings."""
    for at, kind, place, letter, _, _ in edits(words, alphabet, seen):
        for i, what, k, a in zip(at.tolist(), kind.tolist(), place.tolist(), letter.tolist()):
            w = words[i]
            yield i, w[:k] + ("" if what == CUT else alphabet[a]) + w[k + (what != PUT) :]


def _passing(size: int, raw: bytes):
    """The test of a Bloom filter of ``size`` bits."""
    bits = np.frombuffer(raw, np.int64).view(np.uint64)

    def seen(h):
        flat, where = h.reshape(-1), np.arange(h.size)
        for k in range(PROBES):
            at = _mix(flat[where], k) & np.uint64(size - 1)
            where = where[(bits[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)]
        out = np.zeros(h.size, bool)
        out[where] = True
        return out.reshape(h.shape)

    return seen


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n): every ordered pair of words of ``words`` (word, n; a stored table) at one edit.

    Candidates are strings, but for those of words beyond ``LONG`` code points,
    which would repeat such a word thousands of times: they are joined by hash
    and length, made of the word they came from only then, and compared.
    """
    n = words.count()
    alphabet = "".join(sorted(r[0] for r in words.select(F.explode(F.split("word", "")).alias("letter")).where("letter <> ''").distinct().collect()))  # at most 90 letters
    size, held = _filter(words, n)
    schema = pa.schema([("near", pa.string()), ("word", pa.string()), ("n", pa.int64())])

    def run(batches):
        seen = _passing(size, held.value)
        for b in batches:
            for lo in range(0, b.num_rows, 2048):
                part = b.slice(lo, 2048)
                own, counts = part.column(0).to_pylist(), part.column(1).to_pylist()
                made = neighbourhood(own, alphabet, seen)
                while out := [(c, own[i], counts[i]) for i, c in islice(made, 50_000)]:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    of = words.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    made = words.where(F.length("word") <= LONG).select("word", "n").mapInArrow(run, "near string, word string, n long")
    near = made.join(of, "near").select("word", "n", "near", "near_n")
    long = words.where(F.length("word") > LONG)
    return near.unionByName(_near_long(words, long, alphabet, size, held)) if long.limit(1).count() else near


def _near_long(words: DataFrame, long: DataFrame, alphabet: str, size: int, held) -> DataFrame:
    """:func:`near_words` for the words of ``long``."""
    keyed = pa.schema([("h", pa.int64()), ("size", pa.int32()), ("word", pa.string()), ("n", pa.int64())])
    edit = pa.schema([("h", pa.int64()), ("size", pa.int32()), ("own", pa.int64()), ("own_size", pa.int32()), ("kind", pa.int8()), ("place", pa.int32()), ("letter", pa.int32())])

    def name(batches):
        for b in batches:
            own = b.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(word_hashes(own).view(np.int64)), pa.array(list(map(len, own)), pa.int32()), *b.columns], schema=keyed)

    def run(batches):
        seen = _passing(size, held.value)
        for b in batches:
            own = b.column(0).to_pylist()
            names, sizes = word_hashes(own).view(np.int64), np.array(list(map(len, own)))
            for at, kind, place, letter, h, length in edits(own, alphabet, seen):
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((h.view(np.int64), length, names[at], sizes[at], kind, place, letter), edit)], schema=edit)

    named = materialise(words.where(F.length("word") >= LONG).select("word", "n").mapInArrow(name, "h long, size int, word string, n long"), "spelling-long")
    made = long.select("word").mapInArrow(run, "h long, size int, own long, own_size int, kind byte, place int, letter int")
    met = made.join(named.withColumnsRenamed({"word": "near", "n": "near_n"}), ["h", "size"]).drop("h", "size")
    met = met.join(named.withColumnsRenamed({"h": "own", "size": "own_size"}), ["own", "own_size"])
    letter = F.when(F.col("kind") == CUT, "").otherwise(F.substr(F.lit(alphabet), F.col("letter") + 1, F.lit(1)))
    rest = F.col("place") + F.when(F.col("kind") == PUT, 1).otherwise(2)
    same = F.concat(F.substr("word", F.lit(1), F.col("place")), letter, F.substr("word", rest)) == F.col("near")
    return met.where(same).select("word", "n", "near", "near_n").distinct()


def _larger(ratio: int) -> Column:
    return F.when(F.col("best.n") >= ratio * F.col("n"), F.col("best.near"))


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of ``words`` (word, n; a stored table)."""
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best")
    near = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), best).select("word", "n_near", F.struct(F.col("best.near").alias("near"), (-F.col("best.less")).alias("n")).alias("best"))
    own = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), _larger(ratio).alias("form"), "best")
    own = materialise(own.select("word", "n", "n_near", "form", F.when(F.col("form").isNotNull(), F.col("best.n")).alias("form_n")), "spelling-forms")
    # a form occurs ratio times as often as its word, so a chain has at most log(largest count) links; every round doubles the way
    ways = materialise(own.where("form is not null").select("word", F.col("form").alias("root")), "spelling-ways")
    while True:
        on = ways.select(F.col("word").alias("root"), F.col("root").alias("further"))
        new = materialise(ways.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-ways")
        drop(ways)
        ways = new
        if not ways.where("moved").limit(1).count():
            break
    return own.join(ways.select("word", "root"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, ratio: int = RATIO, typo: int = TYPO) -> DataFrame:
    """The vocabulary of ``docs`` with the commoner form of each word, its root, and the counts."""
    if ratio < 2:
        raise ValueError("ratio must be 2 or more: a word's form must be the commoner one")
    return variants(materialise(vocabulary(docs, id_col, text_col, min_length, min_count, typo), "spelling-words"), ratio)


def oracle() -> str:
    """The same as DuckDB SQL: checksums as sums of the bytes' shares, pairs by common deletions."""
    return rf"""
with recursive
byte(b, c) as (select b::bigint, list_reduce(list_prepend(b::bigint, range(8)), lambda c, i: xor(c >> 1, 3988292384 * (c & 1))) from range(256) r(b)),
low as (select doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
run as (
  select coalesce(doc_id::varchar, '') || ':' || run as s, run, count(*) as n
  from (select doc_id, unnest(regexp_extract_all(t, '[A-Za-z\x{{C0}}-\x{{FF}}]+')) as run from low) group by all
),
long as (select * from run where length(run) >= {MIN_LENGTH}),
share(d, b, c) as (
  select 0, b, c from byte
  union all
  select d + 1, s.b, xor(s.c >> 8, t.c) from share s join byte t on t.b = s.c & 255 where d < (select max(octet_length(encode(s))) from long)
),
head(d, c) as (select 0, 4294967295 union all select d + 1, xor(h.c >> 8, t.c) from head h join byte t on t.b = h.c & 255 where d < (select max(octet_length(encode(s))) from long)),
piece as (select s, unnest(range(octet_length(encode(s)))) as i, octet_length(encode(s)) as size, hex(encode(s)) as x from long),
code as (select s, any_value(size) as size, bit_xor(h.c) as c from piece join share h on h.d = size - 1 - i and h.b = ('0x' || substring(x, 2 * i + 1, 2))::bigint group by s),
summed as (select s, xor(xor(code.c, head.c), 4294967295) as h from code join head on d = size),
typed as (
  select case when h % {TYPO} = 0 then substring(run, 1, (h % length(run))::bigint) || substring(run, (h % length(run))::bigint + 2) else run end as word, n
  from long join summed using (s)
),
vocab as (select word, sum(n)::bigint as n from typed where length(word) >= {MIN_LENGTH} group by word having sum(n) >= {MIN_COUNT}),
cut as (select distinct word, n, i, substring(word, 1, i) || substring(word, i + 2) as rest from (select word, n, unnest(range(length(word))) as i from vocab)),
pair as (
  select distinct a.word, a.n, b.word as near, b.n as near_n from cut a join cut b on a.rest = b.rest and a.i = b.i and a.word <> b.word
  union
  select a.word, a.n, b.word, b.n from cut a join vocab b on a.rest = b.word
  union
  select b.word, b.n, a.word, a.n from cut a join vocab b on a.rest = b.word
),
best as (select word, n_near, near as form, near_n as form_n from (select *, count(*) over (partition by word) as n_near, row_number() over (partition by word order by near_n desc, encode(near)) as r from pair) where r = 1),
formed as (
  select word, n, coalesce(n_near, 0) as n_near, case when form_n >= {RATIO} * n then form end as form, case when form_n >= {RATIO} * n then form_n end as form_n
  from vocab left join best using (word)
),
way(word, root, step) as (
  select word, word, 0 from formed
  union all
  select way.word, f.form, step + 1 from way join formed f on f.word = way.root where f.form is not null
)
select f.word, f.form, w.root, f.n, f.n_near, f.form_n::bigint as form_n
from formed f join (select word, arg_max(root, step) as root from way group by word) w using (word)"""
