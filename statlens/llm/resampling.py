"""Target-distribution importance resampling with bit-sliced weights.

A document's features are its runs of 1 to ``width`` words, hashed into
``buckets`` buckets.  A bucket's gain is the log ratio of its smoothed shares
in the target and in the corpus, in whole thousandths, floored:

    gain = floor(1000 * ln((t + 1) * (S + buckets) / ((s + 1) * (T + buckets))))

A document's weight is the sum of the gains over its features.  It is computed
bit-sliced: the counts of a document's buckets are written as bit planes of
``buckets`` bits (plane j holds bit j of every count), the gains as planes of
their positive and of their negative parts, and

    weight = sum over j, k of 2^(j + k) * (|count_j AND plus_k| - |count_j AND minus_k|)

with popcounts, so it is exact whatever the order of the features.  The score
adds Gumbel noise from a hash of the doc_id; the highest scores are drawn,
which is sampling without replacement in proportion to exp(weight / 1000).

Two scans of the texts: one counts the buckets of the corpus (each task sends at
most ``buckets`` rows), one weighs the documents.  Only the gains, one number
per bucket, go to the driver and back.  Ranks come from a range partitioning of
(score, doc_id) of the documents that can be drawn.

Defined cases: a NULL or empty text has no words, no features, weight 0 and is
never drawn; repeated rows are documents of their own (same score; their ranks
follow each other); a NULL doc_id is hashed as the empty text and ranks before
others of its score; an empty target or corpus gives gains from the smoothing
alone; other columns are not read, so their names can't clash.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statlens.llm.common import written
from statlens.plans.ordered import dense_index

BUCKETS = 10_000
MIN_WORDS = 20
SEED = 2024
#: Texts whose planes a task holds at once; known words a task remembers.
ROWS, MEMO = 64, 1 << 20

#: A-Z to a-z; ASCII other than letters and digits to a blank; all else stays.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words of a text as UTF-8."""
    return text.encode().translate(_LETTERS).split(b" ") if text else []


def _buckets(text: str | None, width: int, buckets: int, memo: dict[bytes, int]) -> tuple[int, list[int]]:
    """Number of words and the bucket of every feature."""
    words = [w for w in words_of(text) if w]
    if len(memo) > MEMO:
        memo.clear()
    ids = []
    for k in range(1, width + 1):
        for f in words if k == 1 else (b" ".join(words[i:i + k]) for i in range(len(words) - k + 1)):
            b = memo.get(f)
            if b is None:
                b = memo[f] = zlib.crc32(f) % buckets
            ids.append(b)
    return len(words), ids


def bucket_counts(texts: DataFrame, width: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs in all of ``texts`` (column ``text``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, memo = np.zeros(buckets, np.int64), {}
        for b in batches:
            for text in b.column(0):
                total += np.bincount(np.array(_buckets(text.as_py(), width, buckets, memo)[1], np.int64), minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["bucket", "n"])

    rows = (texts.select("text").filter("text IS NOT NULL").mapInArrow(run, "bucket long, n long")
            .groupBy("bucket").agg(F.sum("n").alias("n")).collect())  # at most one row a bucket
    out = np.zeros(buckets, np.int64)
    for r in rows:
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Each bucket's gain from its counts in the corpus and in the target."""
    n = len(corpus)
    S, T = float(corpus.sum()) + n, float(target.sum()) + n
    return np.array([math.floor(1000 * math.log((t + 1.0) * S / ((s + 1.0) * T))) for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def planes(numbers: np.ndarray) -> np.ndarray:
    """Bit planes of non-negative integers: (..., buckets) to (bits, ..., words of 64 buckets)."""
    bits = max(int(numbers.max(initial=0)).bit_length(), 1)
    packed = np.stack([np.packbits(((numbers >> j) & 1).astype(np.uint8), axis=-1) for j in range(bits)])
    spare = -packed.shape[-1] % 8
    return np.ascontiguousarray(np.pad(packed, [(0, 0)] * (packed.ndim - 1) + [(0, spare)])).view(np.uint64)


def plane_weights(counts: np.ndarray, gain_planes: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Weights of documents (rows of bucket counts) by AND and popcount over planes."""
    weight = np.zeros(len(counts), np.int64)
    for j, plane in enumerate(planes(counts)):
        some = np.flatnonzero(plane.any(axis=1))  # few documents have high counts
        for sign, side in zip((1, -1), gain_planes):
            for k, gain in enumerate(side):
                weight[some] += sign * (np.bitwise_count(plane[some] & gain).sum(axis=1, dtype=np.int64) << (j + k))
    return weight


def noise(doc_id: int | None, seed: int) -> int:
    """Gumbel noise of a document in whole thousandths, from a hash of its id."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def importance_weights(docs: DataFrame, target: DataFrame, width: int = 1, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """doc_id, ``n_words``, ``n_features``, ``weight`` and ``score`` of every row of ``docs``."""
    gain = gains(bucket_counts(docs, width, buckets), bucket_counts(target, width, buckets))
    sides = planes(np.maximum(gain, 0)), planes(np.maximum(-gain, 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[bytes, int] = {}
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                b = whole.slice(start, ROWS)
                found = [_buckets(text.as_py(), width, buckets, memo) for text in b.column(1)]
                counts = np.stack([np.bincount(np.array(ids, np.int64), minlength=buckets) for _, ids in found])
                weight = plane_weights(counts, sides)
                score = weight + np.array([noise(d, seed) for d in b.column(0).to_pylist()], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array([n for n, _ in found], pa.int64()), pa.array([len(ids) for _, ids in found], pa.int64()),
                     pa.array(weight), pa.array(score)], ["doc_id", "n_words", "n_features", "weight", "score"])

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
            .mapInArrow(run, "doc_id long, n_words long, n_features long, weight long, score long"))


def importance_resample(docs: DataFrame, target: DataFrame, percent: int = 10, width: int = 1, buckets: int = BUCKETS,
                        min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """:func:`importance_weights` with ``rank`` (1, 2, ... by falling score, ties to the
    smaller doc_id) of the drawn rows: ``percent`` of those with ``min_words`` words; NULL for all others."""
    # The row number tells repeated rows apart; it is written, so it is the same in every use.
    scored = written(importance_weights(docs, target, width, buckets, seed).withColumn("_row", F.monotonically_increasing_id()), "weights")
    can = F.col("n_words") >= min_words
    drawn = scored.filter(can).count() * percent // 100
    order = scored.filter(can).withColumn("_down", -F.col("score"))
    placed = dense_index(order, ["_down", "doc_id", "_row"], idx="_place").withColumn(
        "rank", F.when(F.col("_place") < drawn, F.col("_place") + 1))
    rest = scored.filter(~can).withColumn("rank", F.lit(None).cast("long"))
    out = ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    return placed.select(out).union(rest.select(out))


#: The same result in DuckDB SQL, which has no crc32: a table of 256 steps, folded over each word's bytes.
CRC_SQL = """steps(l) AS (SELECT list(c ORDER BY i) FROM (SELECT i, list_reduce([i::UBIGINT, 0, 0, 0, 0, 0, 0, 0, 0],
        lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::UBIGINT) ELSE a >> 1 END) AS c FROM range(256) r(i)))"""


def crc_of(text: str) -> str:
    """SQL for the crc32 of the UTF-8 bytes of the expression ``text`` (needs ``steps``)."""
    return f"""xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT,
        list_transform(range(octet_length(encode({text}))), lambda i: ('0x' || substr(hex(encode({text})), 2 * i::INT + 1, 2))::UBIGINT)),
        lambda a, b: xor(a >> 8, l[(xor(a, b) & 255)::INT + 1])))"""


ORACLE_SQL = f"""WITH {CRC_SQL},
raw AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
w AS (SELECT r, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS w FROM raw),
bw AS (SELECT unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS w FROM benchmark),
ids AS (SELECT w, ({crc_of("w")} % {BUCKETS})::INT AS b FROM (SELECT w FROM w UNION SELECT w FROM bw) CROSS JOIN steps),
s AS (SELECT b, count(*) AS n FROM w JOIN ids USING (w) GROUP BY b),
t AS (SELECT b, count(*) AS n FROM bw JOIN ids USING (w) GROUP BY b),
g AS (SELECT b, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM s) + {BUCKETS})::DOUBLE
        / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM t) + {BUCKETS})::DOUBLE)))::BIGINT AS gain
        FROM (SELECT unnest(range({BUCKETS}))::INT AS b) LEFT JOIN s USING (b) LEFT JOIN t USING (b)),
weights AS (SELECT r, count(*) AS n, sum(gain) AS weight FROM w JOIN ids USING (w) JOIN g USING (b) GROUP BY r),
scored AS (SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0)::BIGINT AS weight,
        coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || left(sha256('{SEED}:' || doc_id), 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
        FROM raw LEFT JOIN weights USING (r)),
placed AS (SELECT *, row_number() OVER (PARTITION BY n_features >= {MIN_WORDS} ORDER BY score DESC, doc_id) AS p,
        count(*) FILTER (n_features >= {MIN_WORDS}) OVER () AS n FROM scored)
SELECT doc_id, n_features::BIGINT AS n_features, weight, score,
        CASE WHEN n_features >= {MIN_WORDS} AND p <= 10 * n // 100 THEN p END AS rank FROM placed"""
