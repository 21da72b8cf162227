"""Quality scores by Bradley-Terry ranking.

Each text has a vector of features (``FEATURES``), made once and written.  A document
labelled 1 is preferred to one labelled 0; the weights minimise the logistic loss of
feature differences over all such pairs of all labelled rows.  The loss of a pair depends
on its two scores alone, so Spark adds up, per label, the rows and their features in
fine bins of the score (each row shared between its two nearest ones), and the driver
takes a Newton step from these sums; a few scans find the weights.  The threshold is the
quantile of the scores of all labelled rows that leaves below it the share labelled 0; a
logistic curve through it, fitted to all of them, maps scores to 0..1, with 0.3 there.
A label that comes n times counts n times for each row of its document.

``fit`` with ``sample`` learns on the driver from a bounded sample instead (at most that many
rows per label, chosen by hashes of ids and texts, drawn pairs); ``quality`` doesn't.

Defined cases: a NULL text counts as empty and both get a score; with no pair
to learn from, every score is 0.5; features cover the whole text; rows are
scored one by one, so repeated rows and other columns don't matter.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statlens.llm.common import bounded_sample, crc_mod, forget, with_text_columns, written
from statlens.plans.ordered import dense_index, running_sums

FEATURES = ("log_words", "word_length", "upper", "digits", "symbols", "other_marks", "bars", "shouts", "spaces",
            "distinct_words", "repeated_word", "top_word", "distinct_pairs", "repeated_lines", "line_words",
            "ends", "capital_words", "marked_words", "long_words", "empty")
PAIRS = 200_000
STEPS = 400
BIN = 1 / 32
PENALTY = 1e-4
ROUNDS = 40
CUT = 0.3
_KINDS = np.zeros(256, np.uint8)  # classes of bytes: 1 lower, 2 upper, 3 digit, 4 space, 5 .,;:'"()- , 6 ! ?, 7 |, 8 other marks, 0 beyond ASCII
for _k, _chars in ((1, b"abcdefghijklmnopqrstuvwxyz"), (2, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (3, b"0123456789"), (4, b" \t\n\r\f\v"),
                   (5, b".,;:'\"()-"), (6, b"!?"), (7, b"|"), (8, b"#$%&*+/<=>@[\\]^_`{}~")):
    _KINDS[list(_chars)] = _k


def features(text: str | None) -> np.ndarray:
    """The features of a whole text, in the order of ``FEATURES``."""
    text = text or ""
    words = text.split()
    n = len(words)
    x = np.zeros(len(FEATURES))
    if not n:
        x[-1] = 1
        return x
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    kinds = np.zeros(9)
    for at in range(0, len(raw), 1 << 20):
        kinds += np.bincount(_KINDS[raw[at:at + (1 << 20)]], minlength=9)
    size = kinds.sum()
    upper_high = sum(c.isupper() for c in text if c > "\x7f") if kinds[0] else 0
    tally = Counter(words)
    lines = [y for y in text.split("\n") if y.strip()]
    starts = [w[0] for w in words]
    ends = [w[-1] for w in words]
    x[:] = (
        np.log1p(n), np.log1p(len(text) / n), (kinds[2] + upper_high) / size, kinds[3] / size,
        kinds[8] / size, kinds[5] / size, kinds[7] / n, kinds[6] / n, kinds[4] / size,
        len(tally) / n ** 0.8, sum(a == b for a, b in zip(words, words[1:])) / n, max(tally.values()) / n,
        len(set(zip(words, words[1:]))) / n, 1 - len(set(lines)) / len(lines), np.log1p(n / len(lines)),
        sum(c in ".!?" for c in ends) / n, sum(c.isupper() for c in starts) / n,
        sum(not (c.isalnum() or c in ".,") for c in ends) / n, sum(len(w) > 20 for w in words) / n, 0)
    return x


def wide(x: np.ndarray) -> np.ndarray:
    """The features with their roots and squares, which bend a linear score."""
    return np.concatenate([x, np.sqrt(np.abs(x)), x * x], axis=-1)


def standard(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.clip((wide(x) - mean) / scale, -6, 6)


@dataclass
class Ranking:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float
    slope: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Bradley-Terry scores of rows of features."""
        return (standard(x, self.mean, self.scale) * self.weights).sum(axis=-1)  # row by row, so copies score alike

    def chances(self, x: np.ndarray) -> np.ndarray:
        z = self.slope * (self.scores(x) - self.threshold) + np.log(CUT / (1 - CUT)) * (self.slope > 0)
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def learn(x: np.ndarray, y: np.ndarray, seed: int = 11, stands: dict[int, float] | None = None) -> Ranking:
    """Weights from features ``x`` and labels ``y`` (1 preferred to 0); ``stands``
    has the number of labelled rows of each label, where ``x`` is a sample."""
    k = 3 * len(FEATURES)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return Ranking(np.zeros(k), np.ones(k), np.zeros(k), 0.0, 0.0)
    w = wide(x)
    mean, scale = w.mean(axis=0), w.std(axis=0)
    scale[scale < 1e-9] = 1
    z = np.clip((w - mean) / scale, -6, 6)
    rng = np.random.default_rng(seed)
    i, j = rng.choice(good, PAIRS), rng.choice(bad, PAIRS)
    b, m, v = np.zeros(k), np.zeros(k), np.zeros(k)
    for step in range(1, STEPS + 1):  # Adam on batches of pairs
        at = rng.integers(0, PAIRS, 4000)
        d = z[i[at]] - z[j[at]]
        g = -(d * (1 / (1 + np.exp(np.clip(d @ b, -40, 40))))[:, None]).mean(axis=0) + 1e-4 * b
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        b -= 0.05 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    s = z @ b
    return Ranking(mean, scale, b, 0.0, 1.0) if not s.std() else _cut(Ranking(mean, scale, b, 0.0, 1.0), s, y, stands)


def _cut(model: Ranking, s: np.ndarray, y: np.ndarray, stands: dict[int, float] | None = None) -> Ranking:
    """Threshold at the quantile of the share labelled 0; slope by logistic loss.
    Rows of a label count for all that ``stands`` says there are."""
    n = {label: (y == label).sum() for label in (0, 1)}
    of_row = np.where(y == 0, *((stands or n)[label] / n[label] for label in (0, 1)))
    order = np.argsort(s, kind="stable")
    upto = np.cumsum(of_row[order]) - of_row[order]
    # As np.quantile: the first score at 0, the last at 1, and straight lines between.
    model.threshold = float(np.interp(of_row[y == 0].sum() / of_row.sum(), upto / upto[-1], s[order]))
    model.slope = float(min(np.geomspace(0.02, 20, 40) / s.std(), key=lambda a: np.average(np.logaddexp(
        0, -(2 * y - 1) * (a * (s - model.threshold) + np.log(CUT / (1 - CUT)))), weights=of_row)))
    return model


def featured(docs: DataFrame) -> DataFrame:
    """doc_id and features (x, as bytes) of each row, written."""
    def made(texts):
        return [[features(t).tobytes() for t in texts]]

    return written(with_text_columns(docs.select("doc_id", "text"), made, [("x", "binary")]).select("doc_id", "x"), "quality-features")


def _matrix(x: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(x.to_pylist())).reshape(len(x), len(FEATURES))


def _sums(examples: DataFrame, make: Callable, width: int) -> dict[int, np.ndarray]:
    """Sums by key over all ``examples`` of what ``make(x, n0, n1)`` gives: keys and a row of ``width`` numbers each."""
    names = [f"s{i}" for i in range(width)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, rows = make(_matrix(b.column(0)), *(c.to_numpy(zero_copy_only=False).astype(float) for c in b.columns[1:]))
            order = np.argsort(keys, kind="stable")
            found, first = np.unique(keys[order], return_index=True)
            if len(found):
                yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int64)), *map(pa.array, np.add.reduceat(rows[order], first, axis=0).T)], ["key", *names])

    parts = examples.mapInArrow(run, "key long, " + ", ".join(f"{c} double" for c in names))
    return {r[0]: np.array(r[1:]) for r in parts.groupBy("key").agg(*[F.sum(c) for c in names]).orderBy("key").collect()}


def _weights(examples: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Mean, scale and weights of the loss over all pairs of ``examples`` (x, n0, n1: labels 0 and 1); None without a pair."""
    k = 3 * len(FEATURES)
    whole = _sums(examples, lambda x, n0, n1: (np.zeros(len(x), int), np.c_[n0, n1, (n0 + n1)[:, None] * wide(x)]), k + 2).get(0)
    if whole is None or not whole[:2].all():
        return None
    n = whole[:2]
    mean = whole[2:] / n.sum()
    square = _sums(examples, lambda x, n0, n1: (np.zeros(len(x), int), (n0 + n1)[:, None] * (wide(x) - mean) ** 2), k)[0]
    scale = np.sqrt(square / n.sum())
    scale[scale < 1e-9] = 1

    def products(x, n0, n1):
        z = standard(x, mean, scale)
        return np.arange(2 * k), np.concatenate([(z * c[:, None]).T @ z for c in (n0, n1)])

    def binned(x, n0, n1):
        z = standard(x, mean, scale)
        at = (z * b).sum(axis=1) / BIN
        low = np.floor(at)
        rows = np.c_[np.ones(len(z)), z]
        keys, sums = zip(*((2 * (low + up) + label, (c * share)[:, None] * rows) for label, c in enumerate((n0, n1))
                           for up, share in enumerate((low + 1 - at, at - low))))
        keys, sums = np.concatenate(keys), np.concatenate(sums)
        return keys[sums[:, 0] > 0].astype(np.int64), sums[sums[:, 0] > 0]

    gram = _sums(examples, products, k)
    gram = [np.array([gram[label * k + i] for i in range(k)]) for label in (0, 1)]
    b, kept, step, least = np.zeros(k), np.zeros(k), np.zeros(k), np.inf
    for _ in range(ROUNDS):
        bins = _sums(examples, binned, k + 1)
        (c0, m0, z0), (c1, m1, z1) = ((np.array([key // 2 * BIN for key in bins if key % 2 == label]),
                                       *np.split(np.array([v for key, v in bins.items() if key % 2 == label]), [1], axis=1)) for label in (0, 1))
        m0, m1, pairs = m0[:, 0], m1[:, 0], n[0] * n[1]
        loss, bend = PENALTY / 2 * b @ b, PENALTY * np.eye(k)
        pull0, pull1, of0, of1 = np.zeros(len(c0)), np.zeros(len(c1)), np.zeros(len(c0)), np.zeros(len(c1))
        for i in range(0, len(c1), 256):
            part = slice(i, i + 256)
            gap = np.clip(c1[part, None] - c0, -40, 40)
            p = 1 / (1 + np.exp(gap))
            loss += m1[part] @ np.logaddexp(0, -gap) @ m0 / pairs
            pull0, pull1[part] = pull0 + m1[part] @ p, p @ m0
            p *= 1 - p
            of0, of1[part] = of0 + m1[part] @ p, p @ m0
            both = z1[part].T @ p @ z0 / pairs
            bend -= both + both.T
        if loss > least + 1e-5:  # too far
            step = step / 2
            b = kept + step
            continue
        kept, least = b, loss
        slope = (pull0 @ z0 - pull1 @ z1) / pairs + PENALTY * b
        for z, m, of, total, whole in ((z0, m0, of0, n[0], gram[0]), (z1, m1, of1, n[1], gram[1])):
            inside = (whole - (z / m[:, None]).T @ z) / total  # the spread inside bins, taken as alike in all
            bend += ((z * (of / m)[:, None]).T @ z + (of @ m) * inside) / pairs
        step = -np.linalg.solve(bend, slope)
        b = kept + step
        if np.abs(step).max() < 1e-3:
            break
    return mean, scale, kept


def _cut_whole(model: Ranking, examples: DataFrame) -> Ranking:
    """As :func:`_cut`, of all ``examples``: their scores are ordered, counted and averaged by Spark."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(model.scores(_matrix(b.column(0)))), *b.columns[1:]], ["s", "n0", "n1"])

    scores = examples.mapInArrow(run, "s double, n0 long, n1 long").groupBy("s").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    scores = written(scores.withColumn("n", F.col("n0") + F.col("n1")), "quality-scores")
    total = scores.agg(F.sum("n").alias("n"), F.sum("n0").alias("n0"), (F.sum(F.col("n") * F.col("s")) / F.sum("n")).alias("mean")).first()
    spread = scores.agg((F.sum(F.col("n") * (F.col("s") - total["mean"]) ** 2) / total["n"]).alias("v")).first()["v"] ** 0.5
    if spread:
        upto = running_sums(dense_index(scores.select("s", "n"), ["s"]), ["n"])
        last, after = upto.agg(*[F.min(F.when(F.col("cum_n") >= total["n0"] + i, F.col("s"))) for i in (0, 1)]).first()
        model.threshold = last + (1 - total["n0"] / total["n"]) * (after - last)  # np.quantile at the share n0 / n
        slopes = np.geomspace(0.02, 20, 40) / spread

        def plus(z: Column) -> Column:
            return F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))

        z = [float(a) * (F.col("s") - model.threshold) + float(np.log(CUT / (1 - CUT))) for a in slopes]
        losses = scores.agg(*[F.sum(F.col("n1") * plus(-c) + F.col("n0") * plus(c)) for c in z]).first()
        model.slope = float(slopes[int(np.argmin(losses))])
    forget(scores)
    return model


def learn_whole(rows: DataFrame, labels: DataFrame, learnt: Column) -> Ranking:
    """A ranking from all ``labels`` (doc_id, quality 0 or 1) of rows where ``learnt`` holds
    and their features (``rows``, of :func:`featured`)."""
    marks = labels.filter(learnt & F.col("quality").isin(0, 1)).groupBy(F.col("doc_id").alias("_qu_id")).agg(
        *[F.count(F.when(F.col("quality") == y, 1)).alias(f"n{y}") for y in (0, 1)])
    examples = written(rows.join(marks, F.col("doc_id") == F.col("_qu_id")).select("x", "n0", "n1"), "quality-examples")
    k = 3 * len(FEATURES)
    found = _weights(examples)
    model = Ranking(np.zeros(k), np.ones(k), np.zeros(k), 0.0, 0.0) if found is None else _cut_whole(Ranking(*found, 0.0, 1.0), examples)
    forget(examples)
    return model


def fit(docs: DataFrame, labels: DataFrame, learnt: Column, sample: int | None = None) -> Ranking:
    """A ranking from all ``labels`` (doc_id, quality 0 or 1) of rows where ``learnt``
    holds or, if ``sample`` is given, from at most so many labelled rows, and as many texts, of each label."""
    if sample is None:
        return learn_whole(featured(docs), labels, learnt)
    rows = labels.filter(learnt & F.col("quality").isin(0, 1)).select(F.col("doc_id").alias("_qu_id"), F.col("quality").alias("_qu_y"))
    sizes = {r["_qu_y"]: r["n"] for r in rows.groupBy("_qu_y").agg(F.count("*").alias("n")).collect()}
    # The sample is bounded, so it may be broadcast and no text is shuffled.
    chosen = F.broadcast(bounded_sample(rows, "_qu_y", F.xxhash64("_qu_id"), sizes, sample).select("_qu_id", "_qu_y"))
    here = F.col("doc_id") == F.col("_qu_id")
    texts = {r["_qu_y"]: r["n"] for r in docs.select("doc_id").join(chosen, here).groupBy("_qu_y").agg(F.count("*").alias("n")).collect()}
    both = docs.select("doc_id", "text").join(chosen, here)
    both = bounded_sample(both, "_qu_y", F.xxhash64("doc_id", "text"), texts, sample).select("doc_id", "text", "_qu_y")

    def made(texts):
        return [[features(t).tobytes() for t in texts]]

    got = with_text_columns(both, made, [("x", "binary")]).select("doc_id", "_qu_y", "x").toPandas()
    got = got.sort_values(["doc_id", "_qu_y", "x"], kind="stable")
    x = np.array([np.frombuffer(b) for b in got["x"]]).reshape(len(got), len(FEATURES))
    return learn(x, got["_qu_y"].to_numpy(np.int64) if len(got) else np.empty(0, np.int64), stands=sizes)


FOLDS, HELD = 5, 0


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of each row; labels of the rows held
    out (crc32 of the id modulo 5 is 0) aren't learnt from."""
    held = crc_mod(F.col("doc_id"), FOLDS) == HELD
    rows = featured(docs)
    model = learn_whole(rows, labels, ~held)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.chances(_matrix(b.column(1))))], ["doc_id", "score"])

    return (rows.mapInArrow(scored, T.StructType([rows.schema["doc_id"], T.StructField("score", T.DoubleType())]))
            .select("doc_id", held.alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted")))
