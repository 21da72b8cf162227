"""Substring dedup against a table of all windows."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from helpers_llm import docs_of, prose
from statlens.llm import substring_dedup as S
from statlens.llm.substring_dedup import substring_dedup


def by_hand(rows, size=35):
    docs = [re.findall("[^\\x20\\x09-\\x0D]+", r[1] or "") for r in rows]
    seen = Counter(tuple(w[k:k + size]) for w in docs for k in range(len(w) - size + 1))
    out = []
    for r, w in zip(rows, docs):
        gone = {i for k in range(len(w) - size + 1) if seen[tuple(w[k:k + size])] > 1 for i in range(k, k + size)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((r[0], None if r[1] is None else kept, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def result(df):
    return sorted(((r.doc_id, r.text, r["_sd_words"], r["_sd_removed"], r["_sd_sha256"]) for r in df.collect()), key=str)


def corpus(seed):
    """Copies, near copies, passages around a core, repeats in one document, runs and periods."""
    r = random.Random(seed)
    core, passage = prose(1, 30), prose(2, 60)
    rows = [(k, prose(100 + k, r.randrange(0, 200))) for k in range(60)]
    rows += [(200 + k, " ".join([prose(300 + k, r.randrange(0, 40)), r.choice((core, passage, passage[9:], core + " " + passage)), prose(400 + k, r.randrange(0, 40))]))
             for k in range(60)]
    base = prose(5, 150).split()
    for k in range(30):
        w = list(base)
        for _ in range(r.randrange(0, 4)):
            w[r.randrange(len(w))] = r.choice(("new", "", "two words"))
        rows.append((500 + k, " ".join(w)))
    rows += [(600, prose(7, 36)), (601, "x " + prose(7, 36)), (602, prose(8, 34)), (603, prose(8, 34)), (604, prose(9, 35)), (605, prose(9, 35) + "\n\tz")]
    rows.append((610, prose(11, 50) + " mid " + prose(11, 50)))
    for k, (unit, n) in enumerate([("a", 35), ("a", 36), ("a", 90), ("a b", 18), ("b a", 40), ("a b", 17), ("a b c d e f g h i j", 4), ("a b c d e f g h i j", 6)]):
        rows.append((620 + k, " ".join([prose(700 + k, 5), *[unit] * n, prose(710 + k, 5)])))
    rows += [(650, "café x " * 40), (651, "café y " * 40)]  # a no-break space is part of a word
    return rows


@pytest.mark.parametrize("tasks", [1 << 13, 8])  # 8: keys with an eighth of the rows are broadcast
def test_against_all_windows(spark, monkeypatch, tasks):
    monkeypatch.setattr(S, "TASKS", tasks)
    rows = corpus(1)
    want = by_hand(rows)
    assert result(substring_dedup(docs_of(spark, rows))) == want
    assert sum(x[3] > 0 for x in want) > 80
    assert result(substring_dedup(docs_of(spark, rows), size=5)) == by_hand(rows, size=5)


def test_equal_windows_have_equal_anchors():
    r = random.Random(3)
    for _ in range(60):
        size, many = r.choice((3, 8, 35)), r.choice((1, 2, 3, 60))
        docs = [b" ".join(b"w%d" % r.randrange(many) for _ in range(r.randrange(size, 150))) for _ in range(6)]
        docs.append(docs[0] + b" " + docs[1])
        words, sizes = S._words(docs)
        text, anchor = b" ".join(docs).split(), {}
        a0, a1, p, n = S._anchored(words[:, 0], sizes, size)
        assert n.sum() == (sizes - size + 1).sum()
        for x, y, first, k in zip(a0, a1, p, n):
            for w in range(first, first + k):
                assert w <= x < y <= w + size
                assert anchor.setdefault(tuple(text[w:w + size]), (x - w, y - w)) == (x - w, y - w)


def test_least_in_ranges():
    r = np.random.default_rng(1)
    values = r.integers(0, 9, 50)
    first = r.integers(0, 50, 300)
    last = np.minimum(first + r.integers(0, 20, 300), 49)
    assert S._least(values, first, last).tolist() == [a + int(np.argmin(values[a:b + 1])) for a, b in zip(first, last)]


def test_edge_rows(spark, edge_rows, empty_docs):
    docs = docs_of(spark, edge_rows)
    out = substring_dedup(docs)
    assert out.columns == [*docs.columns, "_sd_words", "_sd_removed", "_sd_sha256"] and len(docs.schema) == len(docs.columns)
    assert result(out) == by_hand(edge_rows)
    assert substring_dedup(empty_docs).count() == 0
