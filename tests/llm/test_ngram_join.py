"""The n-gram Jaccard join against all pairs by brute force."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from helpers_llm import docs_of, prose
from statlens.llm import ngram_join as N
from statlens.llm import shingles as S
from statlens.llm.components import components


def words(text):
    low = "".join(c.lower() if c < "\x80" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def sets_of(rows, width):
    out = []
    for _, text, *_ in rows:
        w = words(text)
        out.append({tuple(w[k:k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} - {()})
    return out


def brute(rows, width, percent):
    """component_id of each row."""
    sets, inverted, parent = sets_of(rows, width), {}, list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, s in enumerate(sets):
        for other, both in Counter(j for g in s for j in inverted.get(g, ())).items():
            if 100 * both >= percent * (len(s) + len(sets[other]) - both):
                parent[root(k)] = root(other)
        for g in s:
            inverted.setdefault(g, []).append(k)
    least = {}
    for k, r in enumerate(rows):
        if r[0] is not None and sets[k]:
            least[root(k)] = min(r[0], least.get(root(k), r[0]))
    return [(r[0], len(sets[k]), least.get(root(k)) if sets[k] else r[0]) for k, r in enumerate(rows)]


def edited(text, share, r):
    return " ".join(f"x{r.randrange(10**9)}" if r.random() < share else w for w in text.split())


def copies(seed, families, size):
    """Families of near copies around the threshold, chains of edits, and shared passages."""
    r, rows = random.Random(seed), []
    common = prose(0, 25)
    for f in range(families):
        base = prose(1000 * seed + f, r.choice((4, 12, 60, 200, 700)), 5000)
        last = base
        for k in range(size):
            text = edited(base, r.choice((0, 0.005, 0.02, 0.05)), r)
            if k % 3 == 0:
                last = text = edited(last, 0.01, r)  # a chain
            if k % 4 == 0:
                text += " " + common
            rows.append((len(rows), text.upper() if k % 5 == 0 else text))
    r.shuffle(rows)
    return rows


def check(spark, rows, width, percent):
    got = N.ngram_join(docs_of(spark, rows), width, percent).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1], x[2] is None, x[2] or 0)
    assert sorted([(g.doc_id, g.n_shingles, g.component_id) for g in got], key=key) == sorted(brute(rows, width, percent), key=key)
    return got


@pytest.mark.parametrize("width, percent", [(3, 90), (5, 80)])
def test_components_of_near_copies(spark, width, percent):
    check(spark, copies(width, 12, 25), width, percent)


def test_unsettled_keys_are_compared_in_blocks(spark, monkeypatch):
    """Near copies below the threshold share keys without links; small blocks must find each link."""
    monkeypatch.setattr(N, "BLOCK", 7)
    r = random.Random(5)
    base = prose(77, 400, 5000)
    rows = [(k, edited(base, 0.022, r)) for k in range(60)]
    rows += [(100 + k, edited(rows[k][1], 0.004, r)) for k in range(0, 60, 7)]
    got = check(spark, rows, 3, 90)
    assert len({g.component_id for g in got}) > 20


def test_edge_rows(spark, edge_rows):
    got = check(spark, edge_rows, 3, 90)
    assert sum(g.n_shingles == 0 for g in got) == 4
    assert N.ngram_join(docs_of(spark, edge_rows)).count() == len(edge_rows)


def test_one_of_each_group_stays(spark, edge_rows):
    docs = docs_of(spark, edge_rows)
    kept = N.one_of_each(docs)
    assert kept.schema == docs.schema
    ids = sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect())
    # 5 (twice) and the NULL id have one text: 5 stays, once; 8 stays for 9; the NULL text stays.
    assert ids == sorted((x is None, x or 0) for x in (None, 1, 2, 3, 4, 5, 6, 7, 8, 2**62, -3))


def test_empty_table(spark, empty_docs):
    assert N.ngram_join(empty_docs).count() == 0 and N.one_of_each(empty_docs).count() == 0


@pytest.mark.parametrize("percent", [70, 80, 90, 95])
def test_similar_sets_share_a_key_and_sketches_bound_the_difference(percent):
    r = np.random.default_rng(percent)
    for n in [*range(1, 60), 100, 255, 256, 257, 600, 1500]:
        for _ in range(8):
            a = np.unique(r.integers(0, 2**63, n).astype(np.uint64))
            room = S.most_apart(2 * n, percent) + 1
            gone, new = r.integers(0, room + 1, 2)
            b = np.unique(np.concatenate([r.permutation(a)[min(gone, n - 1):], r.integers(0, 2**63, new).astype(np.uint64)]))
            if S.linked(a, b, percent):
                keys, of = S.segment_keys([a, b[:0], b], percent)
                assert np.intersect1d(keys[of == 0], keys[of == 2]).size, (n, gone, new)
                assert not (of == 1).any() and (keys[of == 2] == S.segment_keys([b], percent)[0]).all()
                assert S.may_link(len(a), S.sketch(a), len(b), S.sketch(b), percent)


def test_members_across_batches():
    """Keys cut by batches: hubs and edges are those of the whole partition."""
    r = random.Random(3)
    rows = sorted((r.randrange(40), r.randrange(30)) for _ in range(300))
    for step in (1, 2, 7, 300):
        got, edges = set(), []
        parts = [pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows[k:k + step])], ["key", "node"]) for k in range(0, 300, step)]
        for b in N._members(iter(parts)):
            for k, v, h, e in zip(*(c.to_pylist() for c in b.columns)):
                edges.append((k, h)) if e else got.add((k, v, h))
        want = set()
        for key in {k for k, _ in rows}:
            nodes = {v for k, v in rows if k == key}
            want |= {(key, v, min(nodes)) for v in nodes} if len(nodes) > 1 else set()
        assert got == want, step
        first, last = rows[0], rows[-1]
        assert edges == [(first[0], first[1]), (last[0], min(v for k, v in rows if k == last[0]))]


def test_components(spark):
    r = random.Random(1)
    chain = [(k, k + 1) for k in range(0, 200)]
    star = [(1000, 1000 + k) for k in range(1, 300)]
    rand = [(2000 + r.randrange(300), 2000 + r.randrange(300)) for _ in range(200)]
    links = chain + star + rand
    r.shuffle(links)
    parent = {x: x for e in links for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = {x.node: x.label for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: root(x) for e in links for x in e if e[0] != e[1]}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
