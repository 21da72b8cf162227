"""Spelling variant grouping: near words by PartEnum signatures of letter multisets.

A word's letters are a binary vector: one dimension per letter and occurrence
("the second e").  Words one edit apart differ in at most two dimensions (a
replaced letter: two, an inserted or deleted one: one), so with the dimensions
dealt into d + 1 parts, words that differ in d of them agree on one part at
least: each part's content is a signature, and signatures are equi-joined
(thirds and halves of six parts here).
Words of one length can differ in two dimensions, words whose lengths differ by
one in one, so each kind has signatures of its own.

Anagrams are common, and no multiset tells them apart.  An edit leaves the
first or the last half of the shorter word unchanged, so every signature also
holds one half (the other signature holds the other).  Words that meet at a
key are verified by their edit distance, and a pair counts at the first of its
common signatures only, so pairs need no ``distinct``.

A key can hold any number of words.  Keys with more than ``HOT`` words are split
exactly: their words meet again by (key, word without one letter, place of that
letter), which at most one word per letter of the alphabet shares, so no key
puts out all pairs of its words.

Counting words is one scan: tasks add up what they read and one aggregate adds
the sums.  A word's form is its near word with the largest count (see
:func:`spelling_forms`); roots follow forms by pointer doubling, each round a
written table; counts at least double from word to form, so few rounds do.

Defined cases: NULL and empty texts have no words; a NULL doc_id is written as
the empty text; repeated rows count each time; an empty table gives an empty
result; words that tie in count go by code points; other columns aren't read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statlens.llm.common import forget, written
from statlens.llm.resampling import CRC_SQL, crc_of

MIN_LETTERS, MIN_COUNT = 5, 3
#: One run in EVERY, by its hash, loses a letter before it is counted.
EVERY = 97
#: The letter dimensions are dealt into PARTS parts; a signature is (dimensions that may differ, parts that must agree).
#: Words of one length agree on one third of the parts at least, others on one half.
PARTS = 6
SIGNATURES = ((2, (0, 1)), (2, (2, 3)), (2, (4, 5)), (1, (0, 1, 2)), (1, (3, 4, 5)))
#: Hash bits of a part; above them, LETTERS bits hold the parity of each letter's number (letters by hash).
BITS, LETTERS = 8, 16
#: Words of a key above which it is split; keys with more than a share of 1 / TASKS of all rows are
#: split before the exchange (at most TASKS such keys can be).
HOT, TASKS = 96, 1 << 14
#: Distinct words a task adds up before it passes them on.
HELD = 1 << 18

#: Of Latin-1, in which a letter is one byte: A-Z in lower case, letters as they are, all else a blank.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))


def word_counts(docs: DataFrame, every: int = EVERY) -> DataFrame:
    """(word, n) over the letter runs of all whole texts, A-Z in lower case; of a run whose
    crc32 with its doc_id is a multiple of ``every``, the letter at crc32 modulo length is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            words = pa.array([w.decode("latin-1") for w in held], pa.string())
            made = pa.RecordBatch.from_arrays([words, pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return made

        for b in batches:
            for doc_id, text in zip(b.column(0), b.column(1)):
                doc_id = doc_id.as_py()
                start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                letters = text.as_py().encode("latin-1", "replace").translate(_LETTERS)
                for w, n in Counter(letters.split()).items():
                    h = zlib.crc32(w if w.isascii() else w.decode("latin-1").encode(), start)
                    if h % every == 0:
                        k = h % len(w)
                        w = w[:k] + w[k + 1:]
                    held[w] += n
                if len(held) > HELD:
                    yield out()
        if held:
            yield out()

    return (docs.filter("text IS NOT NULL").select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "word string, n long")
            .groupBy("word").agg(F.sum("n").alias("n")))


def _letter_parts(words: DataFrame) -> DataFrame:
    """(word, n) with ``parts``: hashes of the letter dimensions in each part and the letters' parities, in one long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dims: dict[tuple[str, int], int] = {}  # hash of a letter's i-th occurrence
        for b in batches:
            packed = []
            for word in b.column(0).to_pylist():
                sums, parity = [0] * PARTS, 0
                seen: dict[str, int] = {}
                for c in word:
                    seen[c] = i = seen.get(c, 0) + 1
                    h = dims.get((c, i))
                    if h is None:
                        h = dims[c, i] = xxhash.xxh3_64_intdigest(f"{c}{i}")
                    sums[h % PARTS] += h >> 8  # a sum does not depend on the letters' order
                    parity ^= 1 << (ord(c) * 0x9E37 >> 4) % LETTERS
                bits = parity
                for x in sums:
                    bits = bits << BITS | (x * 0x9E3779B97F4A7C15 >> 40) & (1 << BITS) - 1
                packed.append(bits - (1 << 64) if bits >> 63 else bits)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(packed, pa.int64())], ["word", "n", "parts"])

    return words.select("word", "n").mapInArrow(run, "word string, n long, parts long")


def _mask(keep: tuple[int, ...]) -> int:
    return sum(((1 << BITS) - 1) << BITS * p for p in keep)


def _half(word: Column, size: Column, last: bool) -> Column:
    return F.right(word, size) if last else F.left(word, size)


def _halves(d: int, m: Column) -> Column:
    """Letters that stay at one end at least when the shorter word has ``m``: with a replaced
    letter the longer part of m - 1, else of m."""
    return F.floor(m / 2).cast("int") if d == 2 else F.ceil(m / 2).cast("int")


def signature_rows(words: DataFrame) -> DataFrame:
    """One row per word and signature: (key, code, m, word, n, len, parts).

    ``m`` is the length of the shorter word of the pairs looked for, ``code``
    numbers signature and half, ``parts`` packs the hashes of the letter parts and the letters' parities.
    """
    w = _letter_parts(words).withColumn("len", F.length("word"))
    length, rows = F.col("len"), []
    for s, (d, keep) in enumerate(SIGNATURES):
        for m in ((length,) if d == 2 else (length, length - 1)):
            for last in (False, True):
                code = F.lit(2 * s + last)
                key = F.xxhash64(code, m, _half(F.col("word"), _halves(d, m), last), F.col("parts").bitwiseAND(F.lit(_mask(keep))))
                rows.append(F.struct(key.alias("key"), code.alias("code"), m.alias("m")))
    return w.select(F.inline(F.array(*rows)), "word", "n", "len", "parts")


def _first_meeting() -> Column:
    """The smallest code whose signature both words of a pair (a, b) share."""
    x, y, m, one = F.col("a.word"), F.col("b.word"), F.col("a.m"), F.col("a.len") == F.col("b.len")
    differ, codes = F.col("a.parts").bitwiseXOR(F.col("b.parts")), []
    for s, (d, keep) in enumerate(SIGNATURES):
        agree = (one if d == 2 else ~one) & (differ.bitwiseAND(F.lit(_mask(keep))) == 0)
        codes += [F.when(agree & (_half(x, _halves(d, m), last) == _half(y, _halves(d, m), last)), F.lit(2 * s + last)) for last in (False, True)]
    return F.coalesce(*codes)


def _without_one_letter() -> Column:
    """What a word of a split key meets by, (at, rest): the word without one letter and, where letters
    may be replaced, its place; of two lengths, the shorter word as it is."""
    word, size = F.col("word"), F.col("len")

    def rest(i):
        return F.concat(F.left(word, i - 1), F.substring(word, i + 1, size))

    places = F.sequence(F.lit(1), size)
    replaced = F.lit(2 * sum(d == 2 for d, _ in SIGNATURES))
    return (F.when(F.col("code") < replaced, F.transform(places, lambda i: F.struct(i.alias("at"), rest(i).alias("rest"))))
            .when(size > F.col("m"), F.transform(F.array_distinct(F.transform(places, rest)), lambda x: F.struct(F.lit(0).alias("at"), x.alias("rest"))))
            .otherwise(F.array(F.struct(F.lit(0).alias("at"), word.alias("rest")))))


def near_pairs(rows: DataFrame) -> DataFrame:
    """Every pair of words one edit apart, once, as (a, na, b, nb), from a written :func:`signature_rows`."""
    hot = (rows.groupBy("key").agg(F.count("*").alias("c"))
           .filter(F.col("c") > max(HOT, rows.count() // TASKS)).select("key"))
    hot = written(hot, "hot")  # at most TASKS keys
    rest = rows.join(F.broadcast(hot), "key", "left_anti").withColumn("c", F.count("*").over(Window.partitionBy("key")))
    few = rest.filter(F.col("c").between(2, HOT)).drop("c")
    split = (rows.join(F.broadcast(hot), "key", "left_semi").union(rest.filter(F.col("c") > HOT).drop("c"))
             .select("*", F.inline(_without_one_letter())))
    a, b = F.col("a.word"), F.col("b.word")
    # Cheap tests first: as many letters as an edit changes, the words in order, their first meeting; then the edit.
    odd = F.bit_count(F.shiftrightunsigned(F.col("a.parts").bitwiseXOR(F.col("b.parts")), BITS * PARTS))
    near = ((F.col("a.code") == F.col("b.code")) & (odd <= F.when(F.col("a.len") == F.col("b.len"), 2).otherwise(1)) & (a < b)
            & (F.col("a.code") == _first_meeting()) & (F.levenshtein(a, b, 1) == 1))
    out = []
    for part, on in ((few, ["key"]), (split, ["key", "at", "rest"])):
        met = part.alias("a").join(part.alias("b"), [F.col(f"a.{c}") == F.col(f"b.{c}") for c in on] + [near])
        out.append(met.select(a.alias("a"), F.col("a.n").alias("na"), b.alias("b"), F.col("b.n").alias("nb")))
    return out[0].union(out[1])


def roots(forms: DataFrame) -> DataFrame:
    """(word, form) with forms not NULL to (word, root): the last word reached by following forms."""
    at = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = written(at.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        forget(at)
        at = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            return at


def spelling_forms(docs: DataFrame, min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT, every: int = EVERY) -> DataFrame:
    """Words of ``docs`` with at least ``min_letters`` letters and ``min_count`` occurrences.

    ``n`` occurrences, ``n_near`` words one edit away, ``form``: the near word
    with the largest count (ties: the first by code points) if that is at least
    twice the word's, with its count ``form_n``; ``root``: the last word reached
    by following forms, the word itself without one.
    """
    words = written(word_counts(docs, every).filter((F.col("n") >= min_count) & (F.length("word") >= min_letters)), "words")
    rows = written(signature_rows(words), "signatures")
    pairs = near_pairs(rows)
    both = F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("o"), F.col("nb").alias("no")),
                   F.struct(F.col("b").alias("word"), F.col("a").alias("o"), F.col("na").alias("no")))
    best = (pairs.select(F.inline(both)).groupBy("word")
            .agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("no")).alias("less"), F.col("o").alias("o"))).alias("best")))
    known = words.join(best, "word", "left").withColumn("_is", -F.col("best.less") >= 2 * F.col("n"))
    known = written(known.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
                                 F.when(F.col("_is"), F.col("best.o")).alias("form"),
                                 F.when(F.col("_is"), -F.col("best.less")).alias("form_n")), "forms")
    forget(rows)
    found = known.join(roots(known.filter("form IS NOT NULL")), "word", "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


#: The same result in DuckDB SQL: words that share the rest after leaving out one letter.
ORACLE_SQL = f"""WITH RECURSIVE {CRC_SQL},
runs AS (SELECT coalesce(doc_id::VARCHAR, '') AS d, translate(unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents),
hashed AS (SELECT w, c, {crc_of("d || ':' || w")} AS h FROM (SELECT d, w, count(*) AS c FROM runs GROUP BY d, w) CROSS JOIN steps),
cut AS (SELECT CASE WHEN h % {EVERY} = 0 THEN left(w, (h % length(w))::INT) || substr(w, (h % length(w))::INT + 2) ELSE w END AS word, c FROM hashed),
words AS (SELECT word, sum(c)::BIGINT AS n FROM cut GROUP BY word HAVING sum(c) >= {MIN_COUNT} AND length(word) >= {MIN_LETTERS}),
less AS (SELECT word, n, i, left(word, i::INT - 1) || substr(word, i::INT + 1) AS rest FROM words, range(1, 1 + length(word)) r(i)),
near AS (SELECT a.word AS word, b.word AS o, b.n AS no FROM less a JOIN less b USING (i, rest) WHERE a.word <> b.word
        UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.rest = b.word
        UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, min({{'less': -no, 'o': o}}) AS best FROM near GROUP BY word),
known AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.less >= 2 * n THEN best.o END AS form,
        CASE WHEN -best.less >= 2 * n THEN -best.less END AS form_n FROM words LEFT JOIN best USING (word)),
follow(word, far, depth) AS (SELECT word, word, 0 FROM known
        UNION ALL SELECT f.word, k.form, depth + 1 FROM follow f JOIN known k ON k.word = f.far WHERE k.form IS NOT NULL),
last AS (SELECT word, max_by(far, depth) AS root FROM follow GROUP BY word)
SELECT word, form, root, n, n_near, form_n::BIGINT AS form_n FROM known JOIN last USING (word)"""
