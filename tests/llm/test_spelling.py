"""Spelling forms against a comparison of all pairs of words."""

import random
import re
import zlib
from collections import Counter

from helpers_llm import docs_of
from statlens.llm import spelling
from statlens.llm.spelling import near_pairs, signature_rows, spelling_forms


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def forms_by_hand(rows, every=97):
    counts = Counter()
    for r in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", r[1] or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if r[0] is None else r[0]}:{w}".encode())
            if h % every == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            counts[w] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    out, form = {}, {}
    for w in words:
        beside = [x for x in words if abs(len(x) - len(w)) < 2 and near(w, x)]
        best = min(beside, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 2 * words[w] else None
        out[w] = [form[w], None, words[w], len(beside), words[form[w]] if form[w] else None]
    for w in words:
        r = w
        while form[r]:
            r = form[r]
        out[w][1] = r
    return {w: tuple(x) for w, x in out.items()}


def texts(seed, n):
    """Words over few letters, so that most have near words and anagrams, some accented."""
    r = random.Random(seed)
    pool = ["".join(r.choice("abcéÉ÷") for _ in range(r.randrange(3, 9))) for _ in range(150)]
    pool += [w[:k] + w[k + 1:] for w in pool for k in (0, len(w) // 2)] + ["ab" * 20 + w for w in pool[:20]]
    weight = [1 / (1 + k % 40) for k in range(len(pool))]
    out = []
    for k in range(n):
        words = r.choices(pool, weight, k=120)
        out.append((k, " ".join(w.title() if r.random() < 0.1 else w for w in words) + "-x\ty2z"))
    return out


def result(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def test_forms_against_all_pairs(spark):
    rows = texts(1, 60)
    want = forms_by_hand(rows)
    assert result(spelling_forms(docs_of(spark, rows))) == want
    assert sum(x[0] is not None for x in want.values()) > 50
    assert any(x[1] not in (w, x[0]) for w, x in want.items())  # a form of a form


def test_split_keys_find_the_same_pairs(spark, monkeypatch):
    rows = texts(2, 40)
    want = forms_by_hand(rows)
    for hot, tasks in ((2, 1 << 14), (2, 1 << 30), (1, 7)):
        monkeypatch.setattr(spelling, "HOT", hot)
        monkeypatch.setattr(spelling, "TASKS", tasks)
        assert result(spelling_forms(docs_of(spark, rows))) == want


def test_each_pair_once(spark):
    r = random.Random(3)
    words = sorted({"".join(r.choice("ab") for _ in range(r.randrange(1, 9))) for _ in range(300)})
    rows = spark.createDataFrame([(w, 1) for w in words], "word string, n long")
    got = [(x.a, x.b) for x in near_pairs(signature_rows(rows)).collect()]
    assert len(got) == len(set(got))
    assert set(got) == {(a, b) for a in words for b in words if a < b and near(a, b)}


def test_edge_rows(spark, edge_rows, empty_docs):
    rows = [*edge_rows, (None, "house house house houses"), (9, "houses houses mouse mouse mouse"), (10, "a" * 70_000 + " "), (10, "a" * 70_000), (11, "a" * 70_000)]
    assert result(spelling_forms(docs_of(spark, rows))) == forms_by_hand(rows)
    assert spelling_forms(empty_docs).count() == 0
