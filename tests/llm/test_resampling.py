"""Importance resampling against plain sums, one feature at a time."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from helpers_llm import docs_of, prose
from statlens.llm.resampling import gains, importance_resample, plane_weights, planes


def features(text, width, buckets):
    words = re.findall("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    runs = [" ".join(words[i:i + k]) for k in range(1, width + 1) for i in range(len(words) - k + 1)]
    return len(words), [zlib.crc32(x.encode()) % buckets for x in runs]


def by_hand(rows, target, percent=10, width=1, buckets=10_000, min_words=20, seed=2024):
    docs = [(r[0], *features(r[1], width, buckets)) for r in rows]
    s, t = Counter(b for *_, f in docs for b in f), Counter(b for x in target for b in features(x, width, buckets)[1])
    S, T = sum(s.values()), sum(t.values())
    scored = []
    for d, n, f in docs:
        w = sum(math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in f)
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        scored.append((d, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), n))
    can = sorted((x for x in scored if x[4] >= min_words), key=lambda x: (-x[3], -math.inf if x[0] is None else x[0]))
    drawn = len(can) * percent // 100
    return ([(*x[:4], k + 1) for k, x in enumerate(can[:drawn])] + [(*x[:4], None) for x in can[drawn:]]
            + [(*x[:4], None) for x in scored if x[4] < min_words])


def result(df):
    return sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in df.collect()), key=str)


def test_against_plain_sums(spark):
    r = random.Random(1)
    rows = [(k, prose(k, r.choice((0, 5, 19, 20, 60, 400)), 900 if k % 3 else 40)) for k in range(200)]
    rows.append((500, "The the THE " * 3000 + "Éé x_y z9"))  # high counts: many planes
    target = [prose(9000 + k, 50, 40) for k in range(20)] + [None, ""]
    bench = spark.createDataFrame([(k, x) for k, x in enumerate(target)], "item_id long, text string")
    assert result(importance_resample(docs_of(spark, rows), bench)) == sorted(by_hand(rows, target), key=str)
    other = dict(percent=37, width=2, buckets=97, min_words=5, seed=7)
    assert result(importance_resample(docs_of(spark, rows), bench, **other)) == sorted(by_hand(rows, target, **other), key=str)


def test_planes_are_exact():
    r = np.random.default_rng(0)
    counts = r.integers(0, 2, (9, 1000)) * r.integers(0, 1 << 40, (9, 1000))
    gain = r.integers(-30_000, 30_000, 1000)
    assert (plane_weights(counts, (planes(np.maximum(gain, 0)), planes(np.maximum(-gain, 0)))) == counts @ gain).all()
    assert (gains(np.zeros(10, int), np.zeros(10, int)) == 0).all()


def test_edge_rows(spark, edge_rows, empty_docs):
    target = [prose(3, 30)]
    bench = spark.createDataFrame([(1, target[0])], "item_id long, text string")
    rows = [*edge_rows, *[(5, edge_rows[0][1])] * 20]  # repeated rows tie: each has a rank of its own
    got, want = (sorted(x, key=str) for x in (result(importance_resample(docs_of(spark, rows), bench, percent=60)), by_hand(rows, target, percent=60)))
    assert got == want
    assert importance_resample(empty_docs, bench).count() == 0
    none = importance_resample(docs_of(spark, rows), bench.filter("false")).collect()
    assert len(none) == len(rows) and {r.weight for r in none if r.n_features == 0} == {0}
    clash = docs_of(spark, rows).withColumn("n_words", F.lit(1)).withColumn("weight", F.lit("x"))
    assert result(importance_resample(clash, bench, percent=60)) == want
