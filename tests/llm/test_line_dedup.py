"""Line dedup against a brute-force search for repeated runs."""

import random
from collections import defaultdict

from helpers_llm import docs_of, prose
from statlens.llm.line_dedup import MIN_WORDS, dedup_stage, line_dedup


def later_runs(rows):
    """Lines inside runs of MIN_WORDS words or more that stand earlier too."""
    seen, need = set(), defaultdict(set)
    for doc, text in sorted(rows):
        lines = [(k, x.strip(" ")) for k, x in enumerate(text.split("\n")) if x.strip(" ")]
        for a in range(len(lines)):
            words, run = 0, 0
            for b in range(a, len(lines)):
                words += lines[b][1].count(" ") + 1
                run = hash((run, lines[b][1]))
                if words >= MIN_WORDS:
                    if run in seen:
                        need[doc] |= set(range(lines[a][0], lines[b][0] + 1))
                    seen.add(run)
    return need


def test_later_runs_go_and_first_stay(spark):
    passage = [prose(1, 20), prose(2, 18), prose(3, 25)]
    short = [prose(4, 15), prose(5, 20)]  # 35 words: stays everywhere
    rows = [(k, "\n".join([prose(50 + k, 12), *passage, prose(80 + k, 30), "", *short, prose(90 + k, 9)])) for k in range(6)]
    rows += [(20, "\n".join([prose(6, 60)] * 3)), (21, "\n".join(short)), (22, prose(6, 60))]
    got = {r.doc_id: r for r in line_dedup(docs_of(spark, rows)).collect()}
    need = later_runs(rows)
    for doc, text in rows:
        kept = "\n".join(x for k, x in enumerate(text.split("\n")) if k not in need[doc])
        assert got[doc].text == kept, doc
        assert got[doc]["_ld_deleted"] == len(need[doc])
    assert got[0].text == rows[0][1] and got[22].text == ""


def test_every_later_run_around_a_common_core(spark):
    """Passages around a core that stands alone in many documents, and lines of all lengths."""
    r = random.Random(4)
    core = [prose(600 + k, 3) for k in range(15)]  # 45 words
    passage = [prose(700, 3), prose(701, 3), *core, prose(702, 3), prose(703, 3)]
    rows = []
    for k in range(300):
        part = passage if k % 33 == 20 else core if k % 3 == 0 else []
        rows.append((k, "\n".join([prose(1000 + k, r.randrange(5, 40)), *part, prose(2000 + k, r.randrange(5, 40))])))
    pool = [prose(3000 + k, r.choice((1, 2, 3, 10, 30, 45, 50, 60))) for k in range(40)]
    for k in range(120):  # runs out of a pool, with blank lines between some
        at = r.randrange(len(pool))
        own = [x for y in pool[at:at + r.randrange(1, 15)] for x in ([y, ""] if r.random() < 0.3 else [y])]
        rows.append((400 + k, "\n".join([prose(4000 + k, 20), *own, *own[:r.randrange(3)], prose(5000 + k, 20)])))
    got = {x.doc_id: x for x in line_dedup(docs_of(spark, rows)).collect()}
    need = later_runs(rows)
    assert sum(len(need[k]) > 0 for k in range(300)) == 8
    for doc, text in rows:
        assert got[doc].text == "\n".join(x for k, x in enumerate(text.split("\n")) if k not in need[doc]), doc
        assert got[doc]["_ld_deleted"] == len(need[doc])


def test_edge_rows_and_columns(spark, edge_rows):
    docs = docs_of(spark, edge_rows)
    rows = line_dedup(docs).collect()
    assert len(rows) == len(edge_rows)
    out = {(r.doc_id, r.text) for r in rows}
    assert {(1, None), (2, ""), (3, " \n\t \n"), (None, None), (None, edge_rows[0][1]), (5, "")} <= out
    stage = dedup_stage(docs)
    assert stage.columns == docs.columns and stage.schema == docs.schema
    kept = stage.collect()
    assert {r.doc_id for r in kept} >= {None, 1, 2, 3, 4, 6, 7, 8, 9} and 5 not in {r.doc_id for r in kept}
    assert all(r.text is None or r.n_chars == len(r.text) for r in kept)


def test_empty_table(spark, empty_docs):
    assert line_dedup(empty_docs).count() == 0
