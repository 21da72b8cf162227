"""Language-model scores by stupid backoff, computed relationally.

The model is the corpus itself: counts of its words and word pairs, without the
pairs seen only once.  A word after another scores count(pair) / count(first
word); where the pair isn't kept, or at the start of a text, it backs off to
``ALPHA`` (1 at the start) * count(word) / count(all words).  Logarithms are
summed per document.

Documents are read in batches of ``BATCH_CHARS``.  A batch explodes into its
distinct n-grams with counts, which go to the count table's buckets by a uniform
hash; there all batches' counts are added and each batch gets the totals of its
own n-grams back, to be joined to its words.  So an n-gram that stands in every
document costs one entry a batch, and no bucket grows with it.  Batches are cut
where rows stand in a partition, which the two scans must see alike: a table that
comes out of a shuffle is written first, and each batch's totals carry a checksum of
their n-grams, so a batch that differs between the scans raises an error.

N-grams are 64-bit hashes.  Words are as in ``shingles``: runs of bytes other
than white space, A-Z in lower case.

Defined cases: NULL, empty and blank texts have no words, log_score 0 and a NULL
mean; repeated rows are counted as often as they stand there and scored alike;
texts of any length are whole in one batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statlens.llm.common import written
from statlens.llm.shingles import U, mix, word_hashes

ALPHA = 0.4
LEAST = 2
BATCH_CHARS = 10_000_000
#: Characters of the corpus for each bucket of the count table.
BUCKET_CHARS = 8_000_000
PAIR = U(0x9E3779B97F4A7C15)


def planes(a: np.ndarray) -> bytes:
    """Whole numbers as byte planes, which compress."""
    return np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def unplaned(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(8, -1).T).view("<u8").reshape(-1)


def batches(found: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list, list]]:
    """(batch, doc_ids, texts) of a partition, in the order of its rows."""
    number, chars, ids, texts = TaskContext.get().partitionId() << 32, 0, [], []
    for b in found:
        for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
            text = text.as_py() or ""
            if texts and chars + len(text) > BATCH_CHARS:
                yield number, ids, texts
                number, chars, ids, texts = number + 1, 0, [], []
            ids.append(doc), texts.append(text)
            chars += len(text)
    if texts:
        yield number, ids, texts


def exploded(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words in each text, keys of all words, keys of all pairs (0: a text's first word)."""
    words = [word_hashes(t) for t in texts]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    h = np.concatenate(words) if words else np.empty(0, U)
    pairs = np.zeros(len(h), U)
    pairs[1:] = mix(h[:-1] * PAIR + mix(h[1:])) | U(1)
    starts = (np.cumsum(sizes) - sizes)[sizes > 0]
    pairs[starts] = 0
    return sizes, mix(h ^ PAIR) & ~U(1), pairs


def checksum(keys: np.ndarray) -> int:
    return int(np.bitwise_xor.reduce(mix(keys)).view(np.int64)) if len(keys) else 0


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> U(32)) * U(buckets) >> U(32)).astype(np.int64)


def requests(docs: DataFrame, buckets: int) -> DataFrame:
    """(bucket, batch, keys, counts): the distinct n-grams of each batch."""

    def rows(found):
        for batch, _, texts in batches(found):
            _, words, pairs = exploded(texts)
            keys, counts = np.unique(np.concatenate([words, pairs[pairs > 0]]), return_counts=True)
            cuts = np.searchsorted(bucket_of(keys, buckets), np.arange(buckets + 1))
            for at in range(0, buckets, 64):
                own = [b for b in range(at, min(at + 64, buckets)) if cuts[b] < cuts[b + 1]]
                if own:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(own, pa.int32()), pa.array([batch] * len(own), pa.int64()),
                         pa.array([planes(np.diff(keys[cuts[b]:cuts[b + 1]], prepend=U(0))) for b in own], pa.binary()),
                         pa.array([planes(counts[cuts[b]:cuts[b + 1]]) for b in own], pa.binary())],
                        ["bucket", "batch", "keys", "counts"])

    return docs.mapInArrow(rows, "bucket int, batch long, keys binary, counts binary")


def totals(asked: DataFrame) -> DataFrame:
    """(batch, bucket, totals, checksum): the corpus's counts of each batch's n-grams."""

    def rows(t: pa.Table) -> pa.Table:
        keys = [np.cumsum(unplaned(b), dtype=U) for b in t["keys"].to_pylist()]
        counts = np.concatenate([unplaned(b) for b in t["counts"].to_pylist()])
        _, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(inverse, weights=counts).astype(U)[inverse]  # exact below 2**53
        parts = np.split(total, np.cumsum([len(k) for k in keys])[:-1])
        return pa.table([t["batch"], t["bucket"], pa.array([planes(p) for p in parts], pa.binary()), pa.array([checksum(k) for k in keys], pa.int64())],
                        ["batch", "bucket", "totals", "checksum"])

    return asked.groupBy("bucket").applyInArrow(rows, "batch long, bucket int, totals binary, checksum long")


def tagged(docs: DataFrame) -> DataFrame:
    """(batch, doc_id, text), the rows of each batch."""

    def rows(found):
        for batch, ids, texts in batches(found):
            yield pa.RecordBatch.from_arrays([pa.array([batch] * len(ids), pa.int64()), pa.array(ids, pa.int64()), pa.array(texts, pa.string())],
                                             ["batch", "doc_id", "text"])

    return docs.mapInArrow(rows, "batch long, doc_id long, text string")


def _scored(left: pa.Table, right: pa.Table) -> pa.Table:
    """Joins a batch's words to their totals and sums per document."""
    sizes, words, pairs = exploded(left["text"].to_pylist())
    keys = np.unique(np.concatenate([words, pairs[pairs > 0]]))
    order = np.argsort(right["bucket"].to_numpy())
    answer = right["totals"].to_pylist()
    total = np.concatenate([unplaned(answer[k]) for k in order] or [np.empty(0, U)]).astype(np.float64)
    told = np.bitwise_xor.reduce(right["checksum"].to_numpy()) if right.num_rows else 0
    if len(total) != len(keys) or told != checksum(keys):
        raise RuntimeError("a batch changed between two scans; write the table before scoring it")
    if not len(keys):
        logs, backed = np.zeros(0), np.zeros(0, bool)
    else:
        c1 = total[np.searchsorted(keys, words)]
        c2 = np.where(pairs > 0, total[np.minimum(np.searchsorted(keys, pairs), len(keys) - 1)], 0)
        first = pairs == 0
        back = c2 < LEAST
        before = np.concatenate(([1.0], c1[:-1]))
        logs = np.log(np.where(back, c1 * np.where(first, 1, ALPHA), c2 / before))
        backed = back
    ends = np.cumsum(sizes)
    missed = np.concatenate(([0], np.cumsum(backed.astype(np.int64))))
    sums = np.zeros(len(sizes))
    if len(logs):
        sums[sizes > 0] = np.add.reduceat(logs, (ends - sizes)[sizes > 0])
    missed = missed[ends] - missed[ends - sizes]
    return pa.table([left["doc_id"], pa.array(sizes), pa.array(sums), pa.array(missed)], ["doc_id", "n_words", "logs", "backed_off"])


def lm_score(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, log_score, mean_log_score, backed_off) of each row."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if "Exchange" in own._jdf.queryExecution().executedPlan().toString():
        own = written(own, "texts")
    chars = own.agg(F.sum(F.length("text"))).first()[0] or 0
    answers = totals(requests(own, max(1, -(-chars // BUCKET_CHARS))))
    rows = written(tagged(own).groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(
        _scored, "doc_id long, n_words long, logs double, backed_off long"), "scores")
    n = rows.agg(F.sum("n_words")).first()[0] or 1
    score = F.col("logs") - F.col("backed_off") * F.log(F.lit(float(n)))
    return rows.select("doc_id", "n_words", score.alias("log_score"), F.when(F.col("n_words") > 0, score / F.col("n_words")).alias("mean_log_score"), "backed_off")


#: The same in DuckDB SQL, to 4 and 6 places.
ORACLE_SQL = f"""WITH d AS (SELECT doc_id, row_number() OVER () AS r, list_filter(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws
    FROM documents),
t AS (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM d),
p AS (SELECT r, w, lag(w) OVER (PARTITION BY r ORDER BY i) AS v FROM t),
c1 AS (SELECT w, count(*) AS c FROM t GROUP BY w),
c2 AS (SELECT v, w, count(*) AS c FROM p WHERE v IS NOT NULL GROUP BY v, w HAVING count(*) >= {LEAST}),
s AS (SELECT p.r, count(*) AS n, count(*) FILTER (WHERE c2.c IS NULL) AS b,
        sum(CASE WHEN c2.c IS NOT NULL THEN ln(c2.c / f.c::DOUBLE)
            ELSE ln(u.c * CASE WHEN p.v IS NULL THEN 1 ELSE {ALPHA} END / (SELECT count(*) FROM t)::DOUBLE) END) AS logs
      FROM p JOIN c1 u ON u.w = p.w LEFT JOIN c1 f ON f.w = p.v LEFT JOIN c2 ON c2.v = p.v AND c2.w = p.w GROUP BY p.r)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_words, round(coalesce(logs, 0), 4) AS log_score,
    round(logs / n, 6) AS mean_log_score, CAST(coalesce(b, 0) AS BIGINT) AS backed_off
FROM d LEFT JOIN s USING (r)"""
