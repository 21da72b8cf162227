"""Substring dedup by recompression: every word of a passage that occurs twice goes.

A window is ``size`` consecutive words of one document.  Words covered by a window
that also starts anywhere else are removed, at all its places.

*Rounds.*  Each document is a sequence of symbols, at first its words.  A round
names every run of equal symbols, then every pair (x, y) with x of the left and y of the
right class; classes and names are hashes of what is named, so all tasks give the same
content the same name without a dictionary.  A symbol's *context* is the stretch of
words that fixes it: wherever these words occur, the same symbol stands at the same
place.  Each window gets an *anchor*: of the symbols whose contexts lie inside it, one of
the highest round with the smallest hash (a window without any, as inside a long run, is
its own anchor).  Equal windows have equal anchors at the same place, and an anchor is
named by its whole context.

*Counting.*  Consecutive windows share an anchor, so a document has one record for about
15 words: the anchor's name and a 128-bit hash of the whole stretch of its windows.
Spark counts the names over all documents.  A name seen once ends all its windows.  Of
names seen twice or more, stretches that occur twice are repeated as a whole; windows of
the others are hashed one by one (with one copy of each repeated stretch of that
name) and counted, which finds the exact ends of a repeat.

Counts are aggregates that combine before the exchange; they return to the rows by a
broadcast for keys with more than 1 / ``TASKS`` of all rows (at most ``TASKS`` keys)
and by a join for the others, so a passage in every document loads no single task.
All texts with one text hash get one answer; a text that more than 1 / ``TASKS``
of the rows hold is known to go whole and joins nothing.  Words are compared by 128-bit
hashes of their stretches, names by 64 bits, which can only add work.

Defined cases: a NULL or empty text has no words and keeps none; a text with fewer than
``size`` words keeps all; repeated rows are places of their own, so their words go if
the text has a window; NULL doc_ids stay; other columns pass unchanged.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statlens.llm.common import forget, hot_join, written

SIZE = 35
#: Keys with more than 1 / TASKS of all rows are broadcast.
TASKS = 1 << 13
#: Characters a task works on at once: small arrays stay in the cache.
CHARS = 1 << 18
#: Rounds; in the last, a context has ten words or so.
ROUNDS = 4
_KEY = "_sd_key"
_FAR = np.int64(1) << 40
_U = np.uint64


def _mix(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A 64-bit hash of two 64-bit numbers (multiply, rotate, shift)."""
    z = x * _U(0x9E3779B97F4A7C15) + y * _U(0xC2B2AE3D27D4EB4F)
    z = (z ^ (z >> _U(32))) * _U(0xD6E8FEB86659FD93)
    z = (z ^ (z >> _U(29)) ^ (x << _U(1))) * _U(0xA0761D6478BD642F)
    return z ^ (z >> _U(32))


def _words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """128-bit hashes (two columns) of all words and the number of words of each text."""
    known: dict[bytes, int] = {}
    at, sizes = [], []
    for text in texts:
        words = text.split()  # bytes: blank and the control characters from tab to carriage return
        sizes.append(len(words))
        at += [known.setdefault(w, len(known)) for w in words]
    names = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, known)), ">u8").astype(_U).reshape(-1, 2)
    return names[np.array(at, np.int64)], np.array(sizes, np.int64)


class _Ranges:
    """128-bit hashes of ranges of words: polynomials, from running sums."""

    def __init__(self, words: np.ndarray):
        self.lanes = []
        for lane, base in enumerate((0x9FB21C651E98DF25, 0xE7037ED1A0B428DB)):
            def powers(b):
                return np.cumprod(np.concatenate([[_U(1)], np.full(len(words), b, _U)]))
            sums = np.concatenate([[_U(0)], np.cumsum(words[:, lane] * powers(_U(base))[:-1])])
            self.lanes.append((sums, powers(_U(pow(base, -1, 1 << 64)))))

    def of(self, start: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
        return [_mix((sums[end] - sums[start]) * back[start], (end - start).astype(_U)).view(np.int64) for sums, back in self.lanes]


def _rounds(words: np.ndarray, sizes: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Name, context start and context end of the symbols of each round, in text order,
    as far as their contexts fit into a window.  ``sizes`` are the documents' words, none 0."""
    name = words.copy()
    start = np.arange(len(words))
    end, c0, c1 = start + 1, start.copy(), start + 1
    first = np.zeros(len(words), bool)
    first[np.cumsum(sizes) - sizes] = True
    for turn in range(ROUNDS + 1):
        fits = (c0 >= 0) & (c1 - c0 <= size)
        if not fits.any():
            return
        yield name[fits], c0[fits], c1[fits]
        if turn == ROUNDS:
            return
        # Runs.  Their ends are known once the words beside them differ or else the symbols there are fixed.
        new = np.concatenate([[True], (name[1:] != name[:-1]) | first[1:]])
        a = np.flatnonzero(new)
        b = np.append(a[1:], len(name)) - 1
        k = b - a + 1
        left, right = np.maximum(a - 1, 0), np.minimum(b + 1, len(name) - 1)
        before, after = np.maximum(start[a] - 1, 0), np.minimum(end[b], len(words) - 1)
        r0 = np.where(words[before] != words[end[a] - 1], np.minimum(c0[a], before), c0[left])
        r1 = np.where(words[after] != words[start[b]], np.maximum(c1[b], after + 1), c1[right])
        final = np.append(first[1:], True)
        c0, c1 = np.where(first[a], -_FAR, r0), np.where(final[b], _FAR, r1)
        name, start, end, first = np.where(k > 1, _mix(name[a], k.astype(_U)), name[a]), start[a], end[b], first[a]
        # Pairs.  A symbol that pairs with none is known once its neighbour is fixed.
        final = np.append(first[1:], True)
        lefts = (_mix(name, np.array([turn + 1], _U)) >> _U(63)).astype(bool)
        pair = np.append(lefts[:-1] & ~lefts[1:], False) & ~final
        second = np.concatenate([[False], pair[:-1]])
        n0 = np.where(~lefts & ~second, np.where(first, -_FAR, np.concatenate([c0[:1], c0[:-1]])), c0)
        n1 = np.where(lefts & ~pair, np.where(final, _FAR, np.append(c1[1:], c1[-1:])), c1)
        a = np.flatnonzero(~second)
        b = a + pair[a]
        name = np.where(pair[a], _mix(name[a], name[b] ^ _U(0x5851F42D4C957F2D)), name[a])
        c0, c1 = n0[a], np.where(pair[a], c1[b], n1[a])
        start, end, first = start[a], end[b], first[a]


def _least(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Place of the smallest of ``values[first..last]`` (ties: the leftmost), for many ranges: the
    better of the two longest power-of-two ranges inside."""
    def better(a, b):
        return np.where(values[b] < values[a], b, a)

    steps = [np.arange(len(values))]
    while (2 << len(steps) - 1) <= (last - first + 1).max(initial=1):
        half = 1 << len(steps) - 1
        steps.append(better(steps[-1][:-half], steps[-1][half:]))
    out = np.empty(len(first), np.int64)
    k = np.frexp((last - first + 1).astype(np.float64))[1] - 1
    for d, step in enumerate(steps):
        at = np.flatnonzero(k == d)
        out[at] = better(step[first[at]], step[last[at] - (1 << d) + 1])
    return out


def _anchored(words: np.ndarray, sizes: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """Stretches of windows with one anchor: first and end word of what names the anchor, first
    window, number of windows (windows go by their first word; no document is shorter than one)."""
    n = len(words)
    inside = np.ones(n, bool)
    for k in range(1, size):
        inside[np.cumsum(sizes) - k] = False
    p = np.flatnonzero(inside)
    # a window without a fixed symbol is its own anchor
    a0, a1 = p.copy(), p + size
    left = np.arange(len(p))
    for name, c0, c1 in reversed(list(_rounds(words, sizes, size))[1:]):
        name = _mix(name, np.array([0xFF51AFD7ED558CCD], _U))
        # symbols whose context starts at the window's first word or later and ends with it or before
        first = np.concatenate([[0], np.cumsum(np.bincount(c0, minlength=n))])[p[left]]
        last = np.cumsum(np.bincount(c1, minlength=n + 1))[p[left] + size] - 1
        some = last >= first
        at, best = left[some], _least(name, first[some], last[some])
        a0[at], a1[at] = c0[best], c1[best]
        left = left[~some]
        if not len(left):
            break
    new = np.concatenate([[True], (np.diff(a0) != 0) | (np.diff(a1) != 0) | (np.diff(p) > 1)])
    a = np.flatnonzero(new)
    return a0[a], a1[a], p[a], np.diff(np.append(a, len(p)))


def _slices(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[pa.RecordBatch]:
    """Rows whose texts (column ``at``) have about ``CHARS`` characters together."""
    for b in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(b.column(at)), 0).to_numpy(zero_copy_only=False)) // CHARS
        cuts = [0, *(np.flatnonzero(np.diff(size)) + 1).tolist(), b.num_rows]
        for a, z in zip(cuts[:-1], cuts[1:]):
            if z > a:
                yield b.slice(a, z - a)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("*", F.unhex(F.md5(F.col("text").cast("binary"))).alias(_KEY))


def stretches(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """(name, s1, s2, key, p, n) of every stretch of ``n`` windows from word ``p`` with one anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches, 1):
            words, sizes = _words(b.column(1).cast(pa.binary()).to_pylist())
            rows = np.flatnonzero(sizes >= size)
            words, sizes = words[np.repeat(sizes >= size, sizes)], sizes[rows]
            if len(rows) == 0:
                continue
            a0, a1, p, n = _anchored(words[:, 0], sizes, size)
            ranges = _Ranges(words)
            name, (s1, s2) = ranges.of(a0, a1)[0], ranges.of(p, p + n - 1 + size)
            doc = np.searchsorted(np.cumsum(sizes), p, "right")
            own = p - (np.cumsum(sizes) - sizes)[doc]
            yield pa.RecordBatch.from_arrays(
                [pa.array(name), pa.array(s1), pa.array(s2), b.column(0).take(pa.array(rows[doc])), pa.array(own), pa.array(n)],
                ["name", "s1", "s2", "key", "p", "n"])

    return (_keyed(docs.select("text").filter("text IS NOT NULL")).select(F.col(_KEY).alias("key"), "text")
            .mapInArrow(run, "name long, s1 long, s2 long, key binary, p long, n long"))


def of_keys(rows: DataFrame, keys: DataFrame, on: list[str], total: int) -> DataFrame:
    """The rows whose ``on`` is among ``keys`` (distinct, with their number of rows ``c``; written)."""
    return hot_join(rows, keys.select(*on, "c"), on, total, TASKS).select(rows.columns)


def frequent_texts(docs: DataFrame) -> DataFrame | None:
    """Hashes of the texts that more than 1 / TASKS of all rows hold, if there are any (at most TASKS)."""
    texts = _keyed(docs.select("text")).groupBy(_KEY).agg(F.count("*").alias("c"))
    hot = written(texts.filter((F.col("c") > max(1, docs.count() // TASKS)) & F.col(_KEY).isNotNull()).select(_KEY), "often")
    return None if hot.isEmpty() else F.broadcast(hot)


def _windows(docs: DataFrame, todo: DataFrame, size: int, hot: DataFrame | None) -> DataFrame:
    """(w1, w2, key, p): hashes of the single windows of the stretches ``todo`` (key, p, n), of one copy of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches, 2):
            words, sizes = _words(b.column(2).cast(pa.binary()).to_pylist())
            before, ranges = np.cumsum(sizes) - sizes, _Ranges(words)
            parts = b.column(1)
            doc = np.repeat(np.arange(b.num_rows), np.diff(parts.offsets.to_numpy()))
            p, n = (parts.flatten().field(k).to_numpy() for k in (0, 1))
            each = np.repeat(p - np.cumsum(n) + n, n) + np.arange(n.sum())
            doc = np.repeat(doc, n)
            at = before[doc] + each
            w1, w2 = ranges.of(at, at + size)
            yield pa.RecordBatch.from_arrays([pa.array(w1), pa.array(w2), b.column(0).take(pa.array(doc)), pa.array(each)], ["w1", "w2", "key", "p"])

    lists = todo.groupBy("key").agg(F.collect_list(F.struct("p", "n")).alias("parts"))  # of one text
    lists = lists.withColumnRenamed("key", _KEY)
    texts = _keyed(docs.select("text"))
    few = texts if hot is None else texts.join(hot, _KEY, "left_anti")
    one = few.join(lists, _KEY).dropDuplicates([_KEY]).select(_KEY, "parts", "text")
    if hot is not None:  # copies go before the exchange
        one = one.union(texts.join(hot, _KEY, "left_semi").dropDuplicates([_KEY]).join(lists, _KEY).select(_KEY, "parts", "text"))
    return one.mapInArrow(run, "w1 long, w2 long, key binary, p long")


def repeated(docs: DataFrame, size: int = SIZE, hot: DataFrame | None = None) -> DataFrame:
    """(key, p, n): ``n`` words from word ``p`` of the texts with hash ``key`` are covered by repeated windows."""
    rows = written(stretches(docs, size), "stretches")
    total = rows.count()
    names = written(rows.groupBy("name").agg(F.count("*").alias("c")).filter("c > 1"), "names")
    shared = written(of_keys(rows, names, ["name"], total), "shared")
    forget(rows)
    forget(names)
    own = ["name", "s1", "s2"]
    kinds = written(shared.groupBy(own).agg(F.count("*").alias("c"), F.min(F.struct("key", "p", "n")).alias("one")), "kinds")
    twice = kinds.filter("c > 1")
    mixed = written(kinds.filter("c = 1").groupBy("name").agg(F.count("*").alias("c")), "mixed")
    # of names with a single stretch: that one, and one copy of each repeated one
    todo = kinds.filter("c = 1").select("one.*").union(of_keys(twice.drop("c"), mixed, ["name"], total).select("one.*"))
    windows = written(_windows(docs, todo, size, hot), "windows")
    seen = written(windows.groupBy("w1", "w2").agg(F.count("*").alias("c")).filter("c > 1"), "seen")
    found = (of_keys(shared, twice, own, total).select("key", "p", (F.col("n") + size - 1).alias("n"))
             .union(of_keys(windows, seen, ["w1", "w2"], total).select("key", "p", F.lit(size).cast("long").alias("n"))))
    found = written(found.distinct(), "found")
    for t in (shared, kinds, mixed, windows, seen):
        forget(t)
    return found


def substring_dedup(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """``docs`` with ``text`` cut to the kept words, joined by one blank, and the columns
    ``_sd_words``, ``_sd_removed`` (numbers of words) and ``_sd_sha256`` (of the kept text).  A NULL text stays NULL."""
    hot = frequent_texts(docs)
    found = repeated(docs, size, hot)
    gone = (found.groupBy(F.col("key").alias("_sd_text")).agg(F.collect_list(F.struct("p", "n")).alias("_sd_parts")))  # of one text
    keyed, own = _keyed(docs), docs.columns
    at, kept_columns = own.index("text"), [F.col(f"`{c}`") for c in own]
    few = keyed if hot is None else keyed.join(hot, _KEY, "left_anti")
    parts = few.join(gone, F.col(_KEY) == F.col("_sd_text"), "left").select(*kept_columns, "_sd_parts")
    if hot is not None:  # these go whole
        whole = F.array(F.struct(F.lit(0).cast("long").alias("p"), F.lit(-1).cast("long").alias("n")))
        parts = parts.union(keyed.join(hot, _KEY, "left_semi").select(*kept_columns, whole))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches, at):
            texts, counts, removed, digests = [], [], [], []
            cuts = b.column(b.num_columns - 1)
            p, n = (cuts.flatten().field(k).to_pylist() for k in (0, 1))
            ends = np.cumsum(pc.fill_null(pc.list_value_length(cuts), 0).to_numpy(zero_copy_only=False)).tolist()
            last = 0
            for text, end in zip(b.column(at).cast(pa.binary()).to_pylist(), ends):
                words = (text or b"").split()
                keep = np.ones(len(words), bool)
                for k in range(last, end):
                    if n[k] >= 0:
                        keep[p[k]:p[k] + n[k]] = False
                    elif len(words) >= size:
                        keep[:] = False
                kept = b" ".join(words if last == end else [words[k] for k in np.flatnonzero(keep).tolist()])
                last = end
                texts.append(None if text is None else kept.decode())
                counts.append(len(words))
                removed.append(len(words) - int(keep.sum()))
                digests.append(hashlib.sha256(kept).hexdigest())
            columns = [pa.array(texts, pa.string()) if k == at else b.column(k) for k in range(len(own))]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests)],
                                             [*own, "_sd_words", "_sd_removed", "_sd_sha256"])

    added = T.StructType().add("_sd_words", "long").add("_sd_removed", "long").add("_sd_sha256", "string")
    return parts.mapInArrow(run, T.StructType(docs.schema.fields + added.fields))


#: The same result in DuckDB SQL.
ORACLE_SQL = f"""WITH raw AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
starts AS (SELECT r, p, md5(array_to_string(list_slice(w, p, p + {SIZE - 1}), ' ')) AS h FROM raw, range(1, len(w) - {SIZE - 2}) s(p)),
twice AS (SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY h) AS c FROM starts) WHERE c > 1),
gone AS (SELECT DISTINCT r, unnest(range(p, p + {SIZE})) AS i FROM twice),
words AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM raw),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS text FROM words ANTI JOIN gone USING (r, i) GROUP BY r),
n AS (SELECT r, count(*) AS n FROM gone GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM raw LEFT JOIN kept USING (r) LEFT JOIN n USING (r)"""
