"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from statlens.llm.common import forget, hot_join, written


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Each node ``u`` hands its neighbours the smallest of them and itself:
    the larger neighbours (large) or itself and the smaller ones (small)."""
    if large:
        near = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = near.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    out = near.join(low, near.u == low.w)
    if large:
        out = out.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = out.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select(F.col("w").alias("u"), F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def _measured(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """``edges`` written, with their count and a hash of their set (taken on the way)."""
    seen = Observation()
    edges = written(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")), "edges")
    return edges, (seen.get["n"], seen.get["x"])


def components(links: DataFrame) -> DataFrame:
    """``links`` (a, b) to (node, label): label is the smallest node reachable.

    Nodes without links don't appear.  Each round is a written table; a round
    halves the depth of the trees, so rounds grow with the logarithm of the
    longest chain.
    """
    edges, state = _measured(links.select(F.col("a").alias("u"), F.col("b").alias("v")).filter("u <> v").distinct())
    before = None
    while state != before and state[0]:
        last, before = edges, state
        edges, state = _measured(_stars(_stars(edges, large=True), large=False))
        forget(last)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).union(edges.select("v", "v").distinct())


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Components after more ``links`` (a, b), from the ``labels`` before them:
    only the labels that the links join are searched."""
    ends = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    known = written(labels.union(ends.join(labels, "node", "left_anti").select("node", F.col("node").alias("label"))), "labels")
    a, b = (known.select(F.col("node").alias(x), F.col("label").alias(f"l{x}")) for x in ("a", "b"))
    joined = components(links.join(a, "a").join(b, "b").select(F.col("la").alias("a"), F.col("lb").alias("b")))
    joined = joined.select(F.col("node").alias("label"), F.col("label").alias("new"))
    all_labels = written(known.groupBy("label").agg(F.count("*").alias("c")).join(joined, "label", "left")
                         .select("label", "c", F.coalesce("new", "label").alias("new")), "renamed")
    # a component can hold a third of all nodes
    return written(hot_join(known, all_labels, ["label"], known.count()).select("node", F.col("new").alias("label")), "labels")
