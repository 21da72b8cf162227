"""N-gram Jaccard join by parity sketches.

The distinct word shingles of a text are XOR-hashed into bit sketches, in which
each shingle flips one bit: two sketches differ in no more bits than the sets
differ in shingles.  The sketch of a size band has more segments than two sets
of the wanted similarity can spoil, so similar sets share a whole segment
(``shingles.segment_keys``), on which they are joined; no similar pair is lost.
Pairs are then held against the bound of a folded sketch and at last verified
on the whole texts.

A hot key (a large group of near copies, a passage in a third of all texts) is
never expanded into all pairs: range partitioning by (key, node) splits it, the
members of a key are tried against its smallest one, and the components found
so are labelled.  Where a key still holds several, they are tried against
``HUBS`` more of them; what then is left apart is compared in blocks of
``BLOCK``, members of different components only, which closes the search exactly.

A node is a distinct set of shingles, known by a 64-bit hash (at 3e10 different
texts some 25 pairs are expected to share one), so exact copies cost one row.

Defined cases: NULL, empty and blank texts have no shingles and link with
nothing; rows with equal texts, or equal sets, are always in one component;
NULL doc_ids count as no id (a component of such rows only has a NULL id).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from statlens.llm import shingles as S
from statlens.llm.common import forget, hot_join, written
from statlens.llm.components import components, merged
from statlens.llm.shingles import U

#: Nodes of a block: their sketches are compared as one matrix.
BLOCK = 2048
#: Further hubs that a key's members are tried against before blocks.
HUBS = 2
#: Texts that a task holds as numpy arrays at once.
ROWS = 256


def _node(s: np.ndarray) -> int | None:
    return int(np.int64(np.uint64(xxhash.xxh64_intdigest(s.tobytes())))) if len(s) else None


def set_table(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, th, n, node, sketch) of each row; ``th`` is the text's hash."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                b = whole.slice(at, ROWS)
                sets = [S.shingle_set(t.as_py(), width) for t in b.column(2)]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), pa.array([len(s) for s in sets], pa.int64()),
                     pa.array([_node(s) for s in sets], pa.int64()), pa.array([S.sketch(s) for s in sets], pa.binary())],
                    ["doc_id", "th", "n", "node", "sketch"])

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
            .mapInArrow(rows, "doc_id long, th long, n long, node long, sketch binary"))


def key_table(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(key, node): the segments under which a node is joined."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                found = {}  # copies in a slice are keyed once
                for t in whole.column(0).slice(at, ROWS):
                    s = S.shingle_set(t.as_py(), width)
                    if len(s):
                        found[_node(s)] = s
                keys, of = S.segment_keys(list(found.values()), percent)
                nodes = np.fromiter(found, np.int64, len(found))
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(nodes[of])], ["key", "node"])

    return docs.filter(F.col("text").isNotNull()).select("text").mapInArrow(rows, "key long, node long")


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (key, node): keys with several nodes, each row with the
    key's smallest node in this partition; ``edge`` marks the hub of the first
    and last key, which may go on in another partition."""
    key = hub = None  # the key that was open at the end of the last batch
    told = first = True  # told: its hub's own row is out
    seen = None
    for b in batches:
        k, v = b.column(0).to_numpy(), b.column(1).to_numpy()
        if not len(k):
            continue
        start = np.r_[k[0] != key, k[1:] != k[:-1]]
        group = np.cumsum(start) - 1  # -1: goes on from the batch before
        heads = v[start]
        hubs = heads[group] if group[0] >= 0 else np.where(group < 0, v[0] if hub is None else hub, heads[np.maximum(group, 0)] if len(heads) else v[0])
        again = ~start & (v != hubs)
        again[1:] &= (v[1:] != v[:-1]) | start[1:]
        if group[0] < 0:
            again[0] &= v[0] != seen
        size = np.bincount(group[again] + 1, minlength=(group[-1] if len(group) else 0) + 2)
        own = start & (size[group + 1] > 0)
        if group[0] < 0 and size[0] and not told:
            yield _batch([key], [hub], [hub], [False])
            told = True
        take = again | own
        if take.any():
            yield _batch(k[take], v[take], hubs[take], np.zeros(take.sum(), bool))
        if first:
            yield _batch(k[:1], v[:1], v[:1], [True])
            first = False
        told = bool(size[group[-1] + 1]) or (group[-1] < 0 and told)
        key, hub, seen = k[-1], hubs[-1], v[-1]
    if key is not None:
        yield _batch([key], [hub], [hub], [True])


def _batch(key, node, hub, edge) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(node, pa.int64()), pa.array(hub, pa.int64()), pa.array(edge, pa.bool_())],
                                      ["key", "node", "hub", "edge"])


def member_table(keys: DataFrame, parts: int) -> DataFrame:
    """(key, node, hub) of keys with several nodes."""
    found = written(keys.repartitionByRange(parts, "key", "node").sortWithinPartitions("key", "node")
                    .mapInArrow(_members, "key long, node long, hub long, edge boolean"), "members")
    # A key that a range boundary cuts has a hub in each part: at most one row a partition.
    cut = (found.filter("edge").select("key", F.col("hub").alias("node")).distinct()
           .withColumn("hub", F.min("node").over(Window.partitionBy("key")))
           .withColumn("n", F.count("*").over(Window.partitionBy("key"))).filter("n > 1"))
    return found.filter("NOT edge").select("key", "node", "hub").union(cut.select("key", "node", "hub"))


def _sketched(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that sizes and folded sketches don't rule out."""
    a = nodes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    b = nodes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))

    def rows(batches):
        for x in batches:
            c = [x.column(j).to_pylist() for j in range(6)]
            ok = [S.may_link(na, sa, nb, sb, percent) for na, sa, nb, sb in zip(*c[2:])]
            yield x.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    near = pairs.join(a, "a").join(b, "b").filter(
        f"100 * least(na, nb) >= {percent} * greatest(na, nb)")
    return near.select("a", "b", "na", "sa", "nb", "sb").mapInArrow(rows, "a long, b long")


def _verified(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs whose whole texts are as similar as wanted."""

    def rows(batches):
        last, sa = None, None
        for x in batches:
            ok = []
            for a, ta, tb in zip(x.column(0).to_pylist(), x.column(2), x.column(3)):
                if a != last:
                    last, sa = a, S.shingle_set(ta.as_py(), width)
                ok.append(S.linked(sa, S.shingle_set(tb.as_py(), width), percent))
            yield x.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    a = texts.select(F.col("node").alias("a"), F.col("text").alias("ta"))
    b = texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "ta", "tb").mapInArrow(rows, "a long, b long")


def _texts(pairs: DataFrame, sets: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, text) of the nodes in ``pairs``."""
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    which = sets.filter("node IS NOT NULL").groupBy("node").agg(F.min("th").alias("th")).join(nodes, "node")
    return (docs.select(F.xxhash64("text").alias("th"), "text").join(which, "th")
            .groupBy("node").agg(F.first("text").alias("text")))


def _unsettled(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, node, label) of the keys whose members are in several components;
    of keys with the same members, one."""
    m = written(members.select("key", "node").distinct().join(labels, "node", "left")
                .select("key", "node", F.coalesce("label", "node").alias("label")), "marked")
    same = ["low", "high", "c", "x", "y"]
    keys = (m.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("c"),
                                 F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"))
            .filter("low <> high").groupBy(*same).agg(F.min("key").alias("key")))
    open_ = written(hot_join(m, written(keys.select("key", "c"), "wanted"), ["key"], m.count()), "open")
    forget(m)
    return open_


def _second_hubs(open_: DataFrame) -> DataFrame:
    """Pairs (a, b) of each key's members with another hub: of those outside the
    key's largest component, the node that stands under most keys."""
    total = open_.count()
    often = open_.groupBy("node").agg(F.count("*").alias("often"))
    main = (open_.groupBy("key", "label").agg(F.count("*").alias("n"))
            .groupBy("key").agg(F.max(F.struct("n", "label")).alias("m"), F.sum("n").alias("c")))
    main = written(main.select("key", F.col("m.label").alias("main"), "c", F.col("c").alias("size")), "main")
    out = hot_join(open_, main, ["key"], total).filter("label <> main").join(often, "node")
    hubs = written(out.groupBy("key").agg(F.max(F.struct("often", "node", "label")).alias("hub"), F.max("size").alias("c")), "hubs")
    return (hot_join(open_, hubs, ["key"], total).filter("label <> hub.label")
            .select(F.least("node", "hub.node").alias("a"), F.greatest("node", "hub.node").alias("b")).distinct())


def _apart(open_: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs of members of one key whose components still differ, held against
    their sketches block by block."""
    keys = open_.groupBy("key").agg(F.count("*").alias("c"))
    # Large keys are dealt to blocks at random; a block meets each block of its key.
    keys = written(keys.select("key", "c", F.ceil(F.col("c") / BLOCK).cast("int").alias("blocks")), "blocks")
    held = hot_join(open_, keys, ["key"], open_.count())
    held = held.withColumn("block", F.pmod(F.xxhash64("node", F.lit(2)), F.col("blocks")).cast("int"))
    held = held.join(nodes.select("node", "n", "sketch"), "node")
    sent = held.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    sent = sent.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "label", "n", "sketch")
    sent = (sent.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
            .select(F.xxhash64("key", "i", "j").alias("run"), "i", "j", "block", "node", "label", "n", "sketch"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: pa.Table | None = None  # the run that may go on in the next batch
        for b in batches:
            t = pa.Table.from_batches([b] if left is None else [*left.to_batches(), b])
            run = t["run"].to_numpy()
            cuts = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
            left = t.slice(cuts[-1]).combine_chunks()
            yield from _compared(t.slice(0, cuts[-1]), cuts, percent)
        if left is not None:
            yield from _compared(left, np.zeros(1, np.int64), percent)

    return sent.mapInArrow(rows, "a long, b long").distinct()


def _compared(t: pa.Table, cuts: np.ndarray, percent: int) -> Iterator[pa.RecordBatch]:
    """The pairs of each run (rows from one cut to the next) that may link."""
    if not t.num_rows:
        return
    i, j, block, node, label, n = (t[c].to_numpy() for c in ("i", "j", "block", "node", "label", "n"))
    sketch = t["sketch"].to_pylist()
    ends = [*cuts[1:], t.num_rows] if len(cuts) == 1 else cuts[1:]
    out = [np.empty((0, 2), np.int64)]
    for start, end in zip(cuts, ends):
        own = np.arange(start, end)
        size = min(len(sketch[x]) for x in own)
        bits = np.array([S.folded(sketch[x], size) for x in own]).view(U)
        names, times = np.unique(label[own], return_counts=True)
        main = label[own] == names[times.argmax()]  # its members needn't be compared with each other
        first, second = block[own] == i[start], block[own] == j[start]
        for x, y in ((first & ~main, second), (first & main, second & ~main)):
            x, y = np.flatnonzero(x), np.flatnonzero(y)
            step = max(1, 4_000_000 // (max(1, len(y)) * bits.shape[1]))
            for at in range(0, len(x) if len(y) else 0, step):
                p = x[at:at + step]
                apart = np.bitwise_count(bits[p, None] ^ bits[None, y]).sum(axis=2, dtype=np.int64)
                na, nb = n[own[p], None], n[None, own[y]]
                near = (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)) & (apart <= (na + nb) * (100 - percent) // (100 + percent))
                u, v = np.nonzero(near & (label[own[p], None] != label[None, own[y]]))
                out.append(np.column_stack([node[own[p[u]]], node[own[y[v]]]]))
    pairs = np.unique(np.sort(np.concatenate(out), axis=1), axis=0)
    yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])


def ngram_join(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, th (the text's hash),
    n_shingles, node, component_id (smallest doc_id of its component)."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sets = written(set_table(docs, width), "sets")
    members = written(member_table(key_table(docs, width, percent), parts), "keys")
    nodes = sets.filter("node IS NOT NULL").groupBy("node").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"))

    pairs = members.filter("node <> hub").select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()
    tried = written(_sketched(pairs, nodes, percent), "tried")
    texts = written(_texts(tried, sets, docs), "texts")
    links = written(_verified(tried, texts, width, percent), "links")
    spent = [texts]  # written tables that the result doesn't read

    labels = components(links)
    open_ = _unsettled(members, labels)
    for step in range(HUBS + 1):
        spent.append(open_)
        if open_.isEmpty():
            break
        # Some more hubs settle most of what is left; then all that may link is tried.
        near = _sketched(_second_hubs(open_), nodes, percent) if step < HUBS else _apart(open_, nodes, percent)
        near = written(near.join(tried, ["a", "b"], "left_anti"), "near")
        new = written(_verified(near, _texts(near, sets, docs), width, percent), "links")
        labels, links = merged(labels, new), links.union(new)
        if step < HUBS:
            spent += [near, tried]
            tried = written(tried.union(near), "tried")
            open_ = _unsettled(open_, labels)
    for df in [*spent, members, tried]:
        forget(df)

    # A text or a component can have a third of all rows: those come by broadcast.
    named = sets.filter("node IS NOT NULL").select("doc_id", "th", "n", "node")
    total = named.count()
    own = written(named.groupBy("node").agg(F.count("*").alias("c")).join(labels, "node", "left")
                  .select("node", "c", F.coalesce("label", "node").alias("label")), "own")
    known = written(hot_join(named, own, ["node"], total), "known")
    least = written(known.groupBy("label").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("c")), "least")
    found = hot_join(known, least, ["label"], total).select("doc_id", "th", F.col("n").alias("n_shingles"), "node",
                                                            F.coalesce("component_id", "doc_id").alias("component_id"))
    return found.union(sets.filter("node IS NULL").select("doc_id", "th", "n", "node", "doc_id"))


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each component: that with the smallest
    doc_id (then the smallest text hash).  Documents without words all stay,
    once each if whole rows of them repeat; NULL doc_ids go last."""
    found = ngram_join(docs, width, percent)
    # No words: the component is the document itself. NULL ids: one of each set at most.
    group = F.when(F.col("n_shingles") == 0, F.xxhash64("doc_id", "th")).otherwise(
        F.coalesce(F.xxhash64(F.lit("c"), "component_id"), F.xxhash64(F.lit("n"), "node")))
    stay = (found.groupBy(group.alias("g"))
            .agg(F.min(F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("d"), "th")).alias("s"), F.count("*").alias("c"))
            .select(F.col("s.d").alias("_nj_d"), F.col("s.th").alias("_nj_t"), F.col("c").alias("_nj_c")))
    stay = stay.groupBy("_nj_d", "_nj_t").agg(F.max("_nj_c").alias("_nj_c"))
    keyed = docs.withColumns({"_nj_id": F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)), "_nj_th": F.xxhash64("text")})
    kept = keyed.join(stay, (F.col("_nj_id") == F.col("_nj_d")) & (F.col("_nj_th") == F.col("_nj_t")))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    alone = kept.filter("_nj_c = 1").select(*columns)
    return alone.union(kept.filter("_nj_c > 1").dropDuplicates(["_nj_id", "_nj_th"]).select(*columns))


#: op1 (three words, 90 per cent) in DuckDB SQL.
ORACLE_SQL = """WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'),
        lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE list_transform(generate_series(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_have AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM both_have JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 90 * (x.n + y.n - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
c AS (SELECT a, least(min(b), a) AS component FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.component, d.doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.a = d.doc_id"""
