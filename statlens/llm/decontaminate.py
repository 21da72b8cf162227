"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman.

Words are the runs of letters, digits and non-ASCII bytes, A-Z in lower case.  A
local alignment of an item's words with a document's (match 1, else -1) scores
the pair; a document is contaminated where the score reaches the item's *need*:
``SHARE`` of its words, and ``LEAST`` or all of them.

*Seeds.*  An alignment with score s has m matches and m - s edits, so its matches
form at most m - s + 1 runs and at least s - 1 of the item's word pairs stand in
the passage.  Of an item's n - 1 pairs the n + 1 - need rarest in the corpus are its
seeds: the others are too few to reach the need without one of them.  So **every**
alignment that reaches the need holds a seed, whatever the edits, and lies within
2 n - need words of it.

*Scans.*  One scan counts the items' word pairs in the corpus.  The second looks seeds up
in every document; around each, for its item, the passage is cut, held against
s - 1 pairs, and aligned.  Passages are never exchanged: the items are with
every task, in shards of about ``SHARD`` words; a larger benchmark takes more scans
instead of a larger broadcast, with the same result, as an item is in one shard.

Defined cases: NULL or empty texts and items take part in nothing; items with
fewer than ``SHORTEST`` words can't be told from chance and are left out; repeated rows and equal ids
with other texts are judged on their own text; an empty benchmark finds nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statlens.llm.common import written
from statlens.llm.shingles import U, gram_hashes

SHORTEST = 4
SHARE = 0.5
LEAST = 8
#: Words of test items that one scan looks for, about.
SHARD = 2_000_000
_KEEP = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().translate(_KEEP).split()


def hashed(w: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, w), U, len(w))


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """Smith-Waterman: best score of a local alignment, and where it ends."""
    steps = np.arange(1, len(passage) + 1)
    row = np.zeros(len(passage) + 1, np.int64)
    best, end = 0, 0
    for w in item:
        open_ = np.maximum(row[:-1] + np.where(passage == w, 1, -1), row[1:] - 1)
        open_ = np.maximum(open_, 0)
        row = np.concatenate(([0], np.maximum.accumulate(open_ + steps) - steps))
        k = int(row.argmax())
        if row[k] > best:
            best, end = int(row[k]), k
    return best, end


def need_of(n: int) -> int:
    """The lowest score, a whole number, that contaminates by an item of ``n`` words."""
    return max(math.ceil(SHARE * n), min(n, LEAST))


def item_words(benchmark: DataFrame) -> DataFrame:
    """(item_id, n, words): hashes of the words of each distinct item that is long enough."""

    def rows(batches):
        for b in batches:
            found = [(item, hashed(words(text))) for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            found = [(item, w) for item, w in found if len(w) >= SHORTEST]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([len(w) for _, w in found], pa.int64()),
                                              pa.array([w.tobytes() for _, w in found], pa.binary())], ["item_id", "n", "words"])

    return (benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
            .mapInArrow(rows, "item_id long, n long, words binary"))


def _pair_counts(docs: DataFrame, grams: np.ndarray) -> np.ndarray:
    """How often each of the word pairs ``grams`` (sorted) stands in ``docs``."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(grams), np.int64)
        for b in batches:
            for text in b.column(0):
                g = gram_hashes(hashed(words(text.as_py())), 2)
                at = np.minimum(np.searchsorted(grams, g), len(grams) - 1)
                np.add.at(total, at[grams[at] == g], 1)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["at", "n"])

    got = docs.select("text").filter("text IS NOT NULL").mapInArrow(rows, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(len(grams), np.int64)  # at most one row a pair of the shard
    out[got["at"].to_numpy()] = got["n"].to_numpy()
    return out


class Seeds:
    """The items of a shard, and which items each seed stands for."""

    def __init__(self, items: list[np.ndarray], pairs: list[np.ndarray], grams: np.ndarray, counts: np.ndarray):
        self.items, self.pairs, self.need = items, pairs, [need_of(len(w)) for w in items]
        seeds, owner = [], []
        for k, (own, need) in enumerate(zip(pairs, self.need)):
            rare = np.argsort(counts[np.searchsorted(grams, own)], kind="stable")[:len(own) + 2 - need]
            own = np.unique(own[rare])
            seeds.append(own)
            owner.append(np.full(len(own), k))
        seeds, owner = np.concatenate(seeds), np.concatenate(owner)
        order = np.argsort(seeds, kind="stable")
        self.owner = owner[order]
        self.grams, self.first, self.count = np.unique(seeds[order], return_index=True, return_counts=True)

    def found(self, w: np.ndarray) -> list[tuple[int, int, int]]:
        """(item, score, end) of each item whose best alignment with the words ``w`` reaches its need."""
        if len(w) < 2:
            return []
        g = gram_hashes(w, 2)
        at = np.minimum(np.searchsorted(self.grams, g), len(self.grams) - 1)
        places = np.flatnonzero(self.grams[at] == g)
        if not len(places):
            return []
        at, out = at[places], []
        n = self.count[at]
        item = self.owner[np.repeat(self.first[at] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        place = np.repeat(places, n)
        order = np.lexsort((place, item))
        item, place = item[order], place[order]
        cuts = np.flatnonzero(np.concatenate([[True], item[1:] != item[:-1]]))
        for a, z in zip(cuts, [*cuts[1:], len(item)]):
            k = int(item[a])
            need, reach = self.need[k], 2 * len(self.items[k]) - self.need[k]
            best = (0, 0)
            lo, hi = np.maximum(place[a:z] - reach, 0), np.minimum(place[a:z] + reach + 2, len(w))
            start = np.flatnonzero(np.concatenate([[True], lo[1:] > hi[:-1]]))
            for x, y in zip(start, [*start[1:], z - a]):
                p, q = int(lo[x]), int(hi[y - 1])
                if np.isin(self.pairs[k], g[p:q - 1]).sum() < need - 1:
                    continue
                score, end = align(self.items[k], w[p:q])
                best = max(best, (score, p + end))
            if best[0] >= need:
                out.append((k, *best))
        return out


def _scan(docs: DataFrame, ids: list, seeds: Seeds) -> DataFrame:
    """(doc_id, th, item_id, score, item_words, end_word) of the documents and items of one shard."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc, th, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                out += [(doc, th, ids[k], score, len(seeds.items[k]), end) for k, score, end in seeds.found(hashed(words(text.as_py())))]
            cols = list(zip(*out)) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in cols], ["doc_id", "th", "item_id", "score", "item_words", "end_word"])

    return (docs.filter(F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
            .mapInArrow(rows, "doc_id long, th long, item_id long, score long, item_words long, end_word long"))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, th, item_id, score, item_words, similarity, end_word): the best
    alignment of each document and item that reaches the item's need."""
    items = written(item_words(benchmark), "items")
    shards, found = -(-(items.agg(F.sum("n")).first()[0] or 0) // SHARD), None
    for shard in range(shards):
        own = items.filter(F.pmod(F.xxhash64("words"), F.lit(shards)) == shard).toPandas()  # bounded by SHARD
        if not len(own):
            continue
        texts = [np.frombuffer(x, U) for x in own["words"]]
        pairs = [gram_hashes(w, 2) for w in texts]
        grams = np.unique(np.concatenate(pairs))
        part = written(_scan(docs, own["item_id"].tolist(), Seeds(texts, pairs, grams, _pair_counts(docs, grams))), "aligned")
        found = part if found is None else found.union(part)
    if found is None:
        return items.selectExpr("0L AS doc_id", "0L AS th", "item_id", "0L AS score", "n AS item_words", "0D AS similarity", "0L AS end_word").limit(0)
    best = found.groupBy("doc_id", "th", "item_id").agg(F.max(F.struct("score", "item_words", "end_word")).alias("m"))
    return best.select("doc_id", "th", "item_id", "m.score", "m.item_words",
                       (F.col("m.score") / F.col("m.item_words")).alias("similarity"), "m.end_word")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no test item."""
    bad = contaminated(docs, benchmark).select(F.col("doc_id").alias("_dc_d"), F.col("th").alias("_dc_t")).distinct()
    keyed = docs.withColumn("_dc_th", F.xxhash64("text"))
    return (keyed.join(written(bad, "contaminated"), F.col("doc_id").cast("long").eqNullSafe(F.col("_dc_d")) & (F.col("_dc_th") == F.col("_dc_t")), "left_anti")
            .select(*[F.col(f"`{c}`") for c in docs.columns]))
