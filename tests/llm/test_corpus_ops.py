"""Nearest neighbours, LM scores, packing, decontamination and the pipeline."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from helpers_llm import docs_of, prose
from pyspark.sql import functions as F
from statlens.llm import decontaminate as D
from statlens.llm import lm_score as LM
from statlens.llm import nearest as N
from statlens.llm import packing as P
from statlens.llm.secrets import _path

SF = "/root/testdata/sf0.01"


# -- nearest neighbours -----------------------------------------------------

def exact(rows, k):
    """Nearest by brute force, of (vec_id, embedding) rows."""
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = []
    for q in sorted({i for i, _ in ok if i % 20 == 0}):
        best = {}
        for _, x in ((i, v) for i, v in ok if i == q):
            for i, v in ok:
                if i != q and len(v) == len(x):
                    best[i] = max(best.get(i, -np.inf), float((v * x).sum()))
        out += [(q, r, i, s) for r, (i, s) in enumerate(sorted(best.items(), key=lambda t: (-t[1], t[0]))[:k], 1)]
    return out


@pytest.mark.parametrize("kw, fan", [({}, 64), ({"rows": 40, "queries": 3}, 2)])
def test_neighbours(spark, monkeypatch, kw, fan):
    monkeypatch.setattr(N, "FAN", fan)
    r = random.Random(2)
    rows = [(k, [r.gauss(0, 1) for _ in range(6)]) for k in range(200)]
    rows += [(300 + k, rows[0][1]) for k in range(30)]  # ties
    rows += [(20, rows[5][1]), (400, None), (420, [0.0] * 6), (440, [1.0, None] * 3), (460, [float("nan")] * 6), (480, [float("inf")] * 6),
             (500, [1.0, 2.0]), (501, [2.0, 1.0]), (None, [1.0] * 6), (520, [1e-30] * 6), (540, [1e30] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1)).withColumn("v", F.lit("x"))
    got = sorted((x.query_id, x["rank"], x.vec_id, x.score) for x in N.nearest(df, F.col("vec_id") % 20 == 0, k=7, **kw).collect())
    want = sorted(exact(rows, 7))
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], rtol=1e-12)
    assert N.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_many_vectors_of_one_id(spark):
    """An id with more vectors near the query than there are neighbours takes one place."""
    r = random.Random(3)
    rows = [(0, [5.0] * 6)] + [(7, [4 + r.random() for _ in range(6)]) for _ in range(25)] + [(100 + 20 * k + 1, [r.random() for _ in range(6)]) for k in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((x.query_id, x["rank"], x.vec_id, x.score) for x in N.nearest(df, F.col("vec_id") % 20 == 0, k=20).collect())
    want = sorted(exact(rows, 20))
    assert len(got) == 20 and [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], rtol=1e-12)


# -- LM scores --------------------------------------------------------------

def slow_scores(rows):
    docs = [re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c < "\x80" else c for c in t or "")) for _, t, *_ in rows]
    one = Counter(w for d in docs for w in d)
    two = Counter(p for d in docs for p in zip(d, d[1:]))
    n = sum(one.values())
    return [(r[0], len(d), sum(math.log(two[p] / one[p[0]]) if k and two[p := (d[k - 1], w)] >= 2 else math.log((LM.ALPHA if k else 1) * one[w] / n)
                               for k, w in enumerate(d))) for r, d in zip(rows, docs)]


@pytest.mark.parametrize("size", [10_000_000, 700])
def test_scores(spark, edge_rows, monkeypatch, size):
    """Small batches and buckets give what one batch gives."""
    monkeypatch.setattr(LM, "BATCH_CHARS", size)
    monkeypatch.setattr(LM, "BUCKET_CHARS", size)
    rows = [r for r in edge_rows if r[0] != 7] + [(100 + k, prose(k % 5, 20 + k, 30) + ("" if k % 3 else "\n \t")) for k in range(40)] + [(999, "")]
    got = LM.lm_score(docs_of(spark, rows).repartition(3)).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    for g, w in zip(sorted(got, key=key), sorted(slow_scores(rows), key=key), strict=True):
        assert (g.doc_id, g.n_words) == w[:2] and g.log_score == pytest.approx(w[2], abs=1e-8)
        assert (g.mean_log_score is None) == (w[1] == 0)


def test_scores_of_nothing(spark, empty_docs):
    assert LM.lm_score(empty_docs).count() == 0


# -- packing ----------------------------------------------------------------

def verify(pieces, ids):
    """Each id of each document once, gapless sequences within the limit."""
    for doc, own in pieces.groupby("doc_id"):
        own = own.sort_values("start")
        assert (own.start.to_numpy() == np.r_[0, own.length.cumsum().to_numpy()[:-1]]).all() and own.length.sum() == len(ids[doc])
        for p in own.itertuples():
            assert p.doc_tokens == len(ids[doc]) and p.ids_crc32 == zlib.crc32(ids[doc][p.start:p.start + p.length].tobytes())
    for _, seq in pieces.groupby("sequence_id"):
        seq = seq.sort_values("offset")
        assert (seq.offset.to_numpy() == np.r_[0, seq.length.cumsum().to_numpy()[:-1]]).all() and seq.length.sum() <= P.LENGTH


def test_packing_against_the_tokenizers_library(spark):
    """Ids are those of the `tokenizers` file; padding is below one sequence a batch."""
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    texts |= {-1: "<|endoftext|> a  b\r\n\t x y 日本語 🙂 don't 12345 ___ ", -2: " " * 3000, -3: "a" * 5000, -4: "",
              -5: "a <|endoftext|> b", -6: "<|endoftext|>" * 3, -7: "x<|endoftext|>y <|endoftext|", -8: "<|endof<|endoftext|>text|>"}
    ids = {k: np.array(t.encode(v, add_special_tokens=False).ids + [1], "<u4") for k, v in texts.items()}
    got = P.pack(docs_of(spark, list(texts.items())).coalesce(1)).toPandas()
    verify(got, ids)
    sizes = got.groupby("sequence_id").length.sum()
    assert len(sizes) * P.LENGTH - sizes.sum() < P.LENGTH


def test_packing_edge_rows(spark, edge_rows, empty_docs, monkeypatch):
    rows = [(k, t) for k, (_, t, *_) in enumerate(edge_rows)]
    encoder = P.encoder_of(_path(), P._tokenizer())
    ids = {k: P.encode(t, encoder) for k, t in rows}
    verify(P.pack(docs_of(spark, rows)).toPandas(), ids)
    monkeypatch.setattr(P, "BATCH", 2)
    monkeypatch.setattr(P, "BATCH_TOKENS", 100)
    verify(P.pack(docs_of(spark, rows)).toPandas(), ids)
    again = P.pack(docs_of(spark, edge_rows)).toPandas()
    assert again.length.sum() == sum(map(len, ids.values()))
    assert P.pack(empty_docs).count() == 0


def test_assign_fills_and_balances():
    r = random.Random(8)
    for lengths in ([], [1], [2047] * 9, [1500, 1500, 1500], [r.randrange(1, 2048) for _ in range(500)], [1] * 5000, [1025] * 300):
        got = P.assign(lengths)
        assert len(got) == -(-sum(lengths) // P.LENGTH)
        assert all(sum(n for _, _, n in s) <= P.LENGTH for s in got)
        parts = sorted((i, a, n) for s in got for i, a, n in s)
        for i, n in enumerate(lengths):
            own = [(a, m) for j, a, m in parts if j == i]
            assert sum(m for _, m in own) == n and [a for a, _ in own] == list(np.cumsum([0] + [m for _, m in own])[:-1])
    costs = [sum(P.cost(n) for _, _, n in s) for s in P.assign([r.randrange(100, 900) for _ in range(400)])]
    assert max(costs) < 1.6 * np.median(costs)


# -- decontamination --------------------------------------------------------

def slow_align(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            h[i + 1, j + 1] = max(0, h[i, j] + (1 if x == y else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
    return int(h.max())


def test_alignment():
    r = np.random.default_rng(1)
    for _ in range(200):
        a, b = r.integers(0, 5, r.integers(1, 25)), r.integers(0, 5, r.integers(1, 40))
        assert D.align(a.astype(np.uint64), b.astype(np.uint64))[0] == slow_align(a, b)


def plain(text):
    low = "".join(c.lower() if c < "\x80" else c for c in text or "")
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", low)


def leaks(docs, items):
    """Every pair whose whole-text alignment reaches the share, by brute force."""
    code = {}
    num = lambda t: np.array([code.setdefault(w, len(code)) for w in plain(t)], np.uint64)
    out = set()
    for item, text in items:
        w = num(text)
        if len(w) >= D.SHORTEST:
            out |= {(d, item, s) for d, t, *_ in docs if (s := D.align(w, num(t))[0] if t and plain(t) else 0) >= max(D.SHARE * len(w), min(len(w), D.LEAST))}
    return out


def test_copies_edited_copies_and_clean_documents(spark, monkeypatch):
    r = random.Random(6)
    items = [(k, prose(700 + k, r.randrange(12, 60), 3000).replace(" ", r.choice((" ", ", ", "\n")))) for k in range(25)] + [(90, "too short"), (91, ""), (92, None)]
    docs = [(k, prose(k, 150, 3000)) for k in range(40)]
    for k in range(60):
        w = plain(r.choice(items[:25])[1])
        for _ in range(len(w) // r.choice((6, 9, 100))):  # words replaced, dropped and added
            at = r.randrange(len(w))
            w[at:at + 1] = r.choice(([f"new{k}"], [], [w[at], "more"]))
        if k % 4 == 0:
            w = w[:len(w) // 3]
        docs.append((100 + k, prose(3 * k, 40, 3000) + " " + " ".join(w).upper() + ". " + prose(k, r.randrange(0, 90), 3000)))
    docs += [(None, items[0][1]), (300, items[1][1]), (300, items[1][1]), (300, "other text"), (301, None), (302, "")]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("n", F.lit(1)).withColumn("gram", F.lit("x"))
    df = docs_of(spark, docs)
    want = leaks(docs, items)
    for shard in (2_000_000, 300):  # one scan, and several
        monkeypatch.setattr(D, "SHARD", shard)
        got = {(x.doc_id, x.item_id, x.score) for x in D.contaminated(df, bench).collect()}
        assert got == want
    kept = D.clean(df, bench)
    assert kept.schema == df.schema
    bad = {d for d, _, _ in got}
    assert sorted((x.doc_id, x.text or "") for x in kept.collect() if x.doc_id is not None) == sorted(
        (d, t or "") for d, t in docs if d is not None and not (d in bad and (d != 300 or t == items[1][1])))


def test_regular_edits_leave_a_seed(spark):
    """Words replaced, added and dropped at every few places, in items of all lengths, beside many exact copies."""
    items = [(n, " ".join(f"i{n}x{j}" if j % 3 else "of" for j in range(n))) for n in (4, 5, 8, 9, 12, 16, 20, 33, 40, 60)]
    docs = [(10_000 + n * 10 + c, f"the {text} end of it") for n, text in items for c in range(4)]
    for n, text in items:
        w = text.split()
        for every in (2, 3, 4, 5, 7):
            docs.append((n * 100 + every, "x " + " ".join(f"new{j}" if j % every == every - 1 else x for j, x in enumerate(w)) + " y"))
            docs.append((n * 100 + 10 + every, "x " + " ".join(x + (f" more{j}" if j % every == every - 1 else "") for j, x in enumerate(w)) + " y"))
            docs.append((n * 100 + 20 + every, "x " + " ".join(x for j, x in enumerate(w) if j % every != every - 1) + " y"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = leaks(docs, items)
    assert {(n * 100 + 4, n) for n in (20, 40, 60)} <= {(d, i) for d, i, _ in want}  # every 4th word replaced
    assert {(x.doc_id, x.item_id, x.score) for x in D.contaminated(docs_of(spark, docs), bench).collect()} == want


def test_edited_copies_beside_exact_ones(spark):
    """Exact copies make the n-grams that an edited copy kept the more frequent ones."""
    items = [(k, " ".join(f"i{k}x{j}" for j in range(24 + k))) for k in range(12)]
    docs = [(10 * k + c, f"before{k} {text} after{c}") for k, text in items for c in range(3)]
    for k, text in items:
        docs.append((10 * k + 5, " ".join(f"new{j}" if j % 6 == 5 else w for j, w in enumerate(text.split()))))
    bench = spark.createDataFrame(items, "item_id long, text string")
    df, want = docs_of(spark, docs), leaks(docs, items)
    assert {d for d, _, _ in want} == {d for d, _ in docs}
    assert {(x.doc_id, x.item_id, x.score) for x in D.contaminated(df, bench).collect()} == want
    assert D.clean(df, bench).count() == 0


def test_decontamination_of_nothing(spark, empty_docs, edge_rows):
    bench = spark.createDataFrame([(1, prose(5999, 30))], "item_id long, text string")
    assert D.contaminated(empty_docs, bench).count() == 0
    df = docs_of(spark, edge_rows)
    assert D.contaminated(df, bench.limit(0)).count() == 0 and D.clean(df, bench.limit(0)).count() == len(edge_rows)
    assert D.clean(df, bench).count() == len(edge_rows)


# -- pipeline ---------------------------------------------------------------

def test_pipeline_against_brute_force(spark):
    """Each stage on its own input, against the rule that it is to follow."""
    import corpus_pipeline
    from test_line_dedup import later_runs
    from test_ngram_join import brute

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "ngram_join", "decontaminate", "packing"]

    def run(name, df):
        out = stages[name](spark, df, sf)
        rows = out.collect()
        return (spark.createDataFrame(rows, out.schema) if rows else out), rows

    a, rows = run("language_id", docs)
    assert a.columns == columns and a.count() >= 0.99 * docs.count()
    before = {r.doc_id: r for r in docs.collect()}
    assert all(before[r.doc_id] == r for r in rows)

    b, out = run("line_dedup", a)
    need = later_runs([(r.doc_id, r.text) for r in rows])
    want = {}
    for r in rows:
        kept = "\n".join(x for k, x in enumerate(r.text.split("\n")) if k not in need[r.doc_id])
        if kept.strip(" ") or not need[r.doc_id]:
            want[r.doc_id] = kept
    got = {r.doc_id: r.text for r in out}
    assert set(got) == set(want)
    assert sum(got[d] != want[d] for d in want) == 0 and all(r.n_chars == len(r.text) for r in out)

    c, kept = run("ngram_join", b)
    comps = brute([(r.doc_id, r.text) for r in out], 5, 80)
    assert sorted(r.doc_id for r in kept) == sorted(d for d, n, comp in comps if d == comp)

    d, clean = run("decontaminate", c)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    near = {x[0] for x in leaks([(r.doc_id, r.text) for r in kept], items)}
    assert {r.doc_id for r in clean} == {r.doc_id for r in kept} - near

    pieces = stages["packing"](spark, d, sf).toPandas()
    encoder = P.encoder_of(_path(), P._tokenizer())
    verify(pieces, {r.doc_id: P.encode(r.text, encoder) for r in clean})


def test_pipeline_runs_whole(spark):
    import corpus_pipeline

    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert got.columns == list(P.COLUMNS) and got.count() > 0


def test_lm_scores_of_a_shuffled_table_and_of_changed_batches(spark):
    """A table out of a shuffle scores like the same rows from a file; other n-grams with as many keys raise."""
    import pyarrow as pa

    from statlens.llm import lm_score as LM

    rows = [(k, prose(k, 30, 200)) for k in range(80)]
    docs = docs_of(spark, rows)
    want = {r.doc_id: (r.n_words, round(r.log_score, 6), r.backed_off) for r in LM.lm_score(docs).collect()}
    mixed = docs.repartition(5, "text")
    assert {r.doc_id: (r.n_words, round(r.log_score, 6), r.backed_off) for r in LM.lm_score(mixed).collect()} == want
    _, words, pairs = LM.exploded(["one two three"])
    keys = np.unique(np.concatenate([words, pairs[pairs > 0]]))
    left = pa.table({"batch": [0], "doc_id": [1], "text": ["one two four"]})
    right = pa.table({"bucket": [0], "totals": [LM.planes(np.ones(len(keys), np.uint64))], "checksum": [LM.checksum(keys)]})
    with pytest.raises(RuntimeError, match="changed"):
        LM._scored(left, right)
    assert LM._scored(pa.table({"batch": [0], "doc_id": [1], "text": ["one two three"]}), right)["n_words"].to_pylist() == [3]
