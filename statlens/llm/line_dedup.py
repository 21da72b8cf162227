"""Line dedup by winnowing over line hashes (native: DataFrame operations only).

Lines are the non-blank pieces of a text between line feeds.  The *gram* at a
line is the shortest run of lines from there that has ``gram_words`` words.
Of all grams that start within ``min_words - gram_words`` words of a line, the
one with the smallest hash is selected, so equal runs of whole lines with
``min_words`` words select equal grams (the winnowing guarantee, with words as
the unit because lines differ so much in length), and only runs whose gram is
selected at two places or more are looked at further.  Of those, the shortest
runs with ``min_words`` words from each first line, and to each last line, are
hashed whole (a run's name is two hashes over two hashes of its lines, 124 bits in all) and
joined with the first place of the hash in the order of (doc_id,
text hash, line).  The lines of a later run go; the earliest copy stays.  Any
longer repeated run is made up of such shortest ones, so no repeat is missed.  Fingerprints
and runs that a large share of all rows have are joined by broadcast (:func:`common.hot_join`).

Defined cases: a NULL text stays NULL; an empty text stays empty; rows with
the same doc_id and text count as one document and get the same text; NULL
doc_ids sort first; a document all of whose lines repeat becomes the empty
text; blank lines go only inside a deleted run; other columns pass unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statlens.llm.common import hot_join, written

GRAM_WORDS = 25
MIN_WORDS = 50
_D, _K = "_ld_doc", "_ld_key"


def _hash(text: Column) -> Column:
    """60 bits of md5, which other engines have as well."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def _key(doc_id: Column, text: Column) -> tuple[Column, Column]:
    return (F.coalesce(doc_id.cast("long"), F.lit(-(1 << 63))).alias(_D),
            F.xxhash64(text).alias(_K))


def line_table(docs: DataFrame) -> DataFrame:
    """One row per non-blank line: document key, ordinal ``p``, place ``i``
    among all lines, hashes ``h`` and ``x``, words ``w`` and words before it ``s``."""
    text = F.col("text")
    one = docs.filter(text.isNotNull()).select(*_key(F.col("doc_id"), text), F.split(text, "\n", -1).alias("lines"))
    rows = one.select(_D, _K, F.posexplode("lines").alias("i", "line")).withColumn("t", F.trim("line")).filter("t <> ''")
    rows = rows.select(_D, _K, "i", _hash(F.col("t")).alias("h"), F.xxhash64("t").alias("x"),
                       (F.length("t") - F.length(F.replace("t", F.lit(" "), F.lit(""))) + 1).cast("long").alias("w"))
    # Repeated rows would double each line of a document: keep one of each place.
    rows = rows.groupBy(_D, _K, "i").agg(F.min("h").alias("h"), F.min("x").alias("x"), F.min("w").alias("w"))
    o = Window.partitionBy(_D, _K).orderBy("i")
    return rows.select("*", F.row_number().over(o).alias("p"),
                       (F.sum("w").over(o.rowsBetween(Window.unboundedPreceding, 0)) - F.col("w")).alias("s"))


def run_table(lines: DataFrame, gram_words: int = GRAM_WORDS, min_words: int = MIN_WORDS) -> DataFrame:
    """The shortest runs of each document: place ``p`` of the first line, places
    ``i0`` and ``i1`` among all lines, hashes ``run`` and ``run2`` and the fingerprint ``fp``
    selected at the first line; ``new`` where no line before selected that place."""
    doc = Window.partitionBy(_D, _K)
    o = doc.orderBy("s")
    gram = o.rangeBetween(0, gram_words - 1)
    near = o.rangeBetween(0, min_words - gram_words)
    long = o.rangeBetween(0, min_words - 1)
    def name(pairs):
        """Two hashes of a run from its lines' pairs of hashes."""
        return F.struct(F.xxhash64(pairs.getField("h")).alias("run"), F.xxhash64(F.lit(1), pairs.getField("x")).alias("run2"))

    both = F.struct("h", "x")
    x = lines.select("*", F.when(F.sum("w").over(gram) >= gram_words, _hash(F.concat_ws(",", F.collect_list("h").over(gram)))).alias("fp"),
                     F.when(F.sum("w").over(long) >= min_words, name(F.collect_list(both).over(long))).alias("ahead"),
                     F.last("i").over(long).alias("i1"),
                     F.lag(both).over(o).alias("b0"), F.lag("w").over(o).alias("w0"), F.lag("i").over(o).alias("i0"))
    best = F.min(F.when(F.col("fp").isNotNull(), F.struct("fp", "p"))).over(near)
    x = x.withColumn("fp", best).withColumn("ends", F.col("s") + F.col("w"))
    x = x.withColumn("new", F.coalesce(F.lag("fp.p").over(o) != F.col("fp.p"), F.lit(True))).withColumn("fp", F.col("fp.fp"))
    x = x.withColumn("fp0", F.lag("fp").over(o))
    back = doc.orderBy("ends").rangeBetween(-(min_words - 1), 0)
    # A last line with min_words words of its own: only the pair with another such line says that both are one run.
    pair = (F.col("w") >= min_words) & (F.col("w0") >= min_words)
    # Where the run without its last line has too few words, it is the shortest from its first line as well.
    other = F.sum("w").over(back) - F.col("w") >= min_words
    x = x.select(_D, _K, "p", "i", "fp", "ahead", "i1", "new",
                 F.when(pair, name(F.array(F.col("b0"), both))).when(other, name(F.collect_list(both).over(back))).alias("behind"),
                 F.when(pair, F.lit(2)).otherwise(F.count("*").over(back)).alias("n"),
                 F.when(pair, F.col("i0")).otherwise(F.first("i").over(back)).alias("i0"),
                 F.when(pair, F.col("fp0")).otherwise(F.first("fp").over(back)).alias("fp0"))

    def run(fp, h, p, i0, i1, new):
        return F.struct(fp.alias("fp"), h["run"].alias("run"), h["run2"].alias("run2"), p.cast("long").alias("p"), i0.alias("i0"), i1.alias("i1"), new.alias("new"))

    found = F.array(run(F.col("fp"), F.col("ahead"), F.col("p"), F.col("i"), F.col("i1"), F.col("new")),
                    run(F.col("fp0"), F.col("behind"), F.col("p") - F.col("n") + 1, F.col("i0"), F.col("i"), F.lit(False)))
    return x.select(_D, _K, F.inline(F.filter(found, lambda r: r["run"].isNotNull())))


def repeated_runs(runs: DataFrame) -> DataFrame:
    """Stretches of later runs as (document, first and last line place)."""
    place = F.struct(F.col(_D).alias("d"), F.col(_K).alias("k"), F.col("p").alias("p"))
    # A passage can be in a third of all documents: counts and first places come from
    # combined aggregates.
    total, name = runs.count(), ["run", "run2"]
    shared = runs.groupBy("fp").agg(F.count("*").alias("c"), F.count_if("new").alias("places")).filter("places > 1").select("fp", "c")
    tried = written(hot_join(runs, written(shared, "shared"), ["fp"], total).select(_D, _K, "p", "i0", "i1", *name), "tried")
    firsts = written(tried.groupBy(*name).agg(F.min(place).alias("a"), F.count("*").alias("c")).filter("c > 1"), "firsts")
    later = hot_join(tried, firsts, name, total).filter(place != F.col("a")).select(_D, _K, "i0", "i1")
    o = Window.partitionBy(_D, _K).orderBy("i0", "i1")
    reach = F.max("i1").over(o.rowsBetween(Window.unboundedPreceding, -1))
    isles = later.withColumn("fresh", F.coalesce(F.col("i0") > reach, F.lit(True)).cast("int")).withColumn(
        "isle", F.sum("fresh").over(o.rowsBetween(Window.unboundedPreceding, 0)))
    return isles.groupBy(_D, _K, "isle").agg(F.min("i0").alias("i0"), F.max("i1").alias("i1"))


def line_dedup(docs: DataFrame, gram_words: int = GRAM_WORDS, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with later repeated runs of lines deleted from ``text``.

    Adds ``_ld_deleted``, the number of lines deleted.  See the module's text
    for the rules.
    """
    runs = repeated_runs(written(run_table(line_table(docs), gram_words, min_words), "runs"))
    gone = (runs.groupBy(_D, _K)
            .agg(F.array_distinct(F.flatten(F.collect_set(F.sequence("i0", "i1")))).alias("_ld_gone"))
            .withColumnsRenamed({_D: _D + "_g", _K: _K + "_g"}))
    d, k = _key(F.col("doc_id"), F.col("text"))
    keyed = docs.select("*", d, k)
    joined = keyed.join(gone, (F.col(_D) == F.col(_D + "_g")) & (F.col(_K) == F.col(_K + "_g")), "left")
    lines_of = F.split(F.col("text"), "\n", -1)
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines_of) - 1), F.col("_ld_gone"))
    text = F.when(F.col("_ld_gone").isNull() | F.col("text").isNull(), F.col("text")).otherwise(
        F.array_join(F.transform(kept, lambda j: F.get(lines_of, j)), "\n"))
    return joined.select(*[text.alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns],
                         F.coalesce(F.size("_ld_gone"), F.lit(0)).cast("long").alias("_ld_deleted"))


#: The same result in DuckDB SQL, for a table whose doc_ids are unique: all shortest runs from each first and to each
#: last line, by their texts, and all but the first place of each.
ORACLE_SQL = f"""WITH raw AS (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i
    FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, i, trim(line, ' ') AS t, length(trim(line, ' ')) - length(replace(trim(line, ' '), ' ', '')) + 1 AS w,
        row_number() OVER (PARTITION BY doc_id ORDER BY i) AS p FROM raw WHERE trim(line, ' ') <> ''),
ls AS (SELECT *, CAST(sum(w) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS e FROM l),
ahead AS (SELECT doc_id, p, i AS i0, last_value(i) OVER fr AS i1, sum(w) OVER fr AS n, md5(array_to_string(list(t) OVER fr, chr(10))) AS run FROM ls
        WINDOW fr AS (PARTITION BY doc_id ORDER BY e - w RANGE BETWEEN CURRENT ROW AND {MIN_WORDS - 1} FOLLOWING)),
behind AS (SELECT doc_id, first_value(p) OVER fr AS p, first_value(i) OVER fr AS i0, i AS i1, sum(w) OVER fr AS n, md5(array_to_string(list(t) OVER fr, chr(10))) AS run FROM ls
        WINDOW fr AS (PARTITION BY doc_id ORDER BY e RANGE BETWEEN {MIN_WORDS - 1} PRECEDING AND CURRENT ROW)),
runs AS (SELECT *, min({{'d': doc_id, 'p': p}}) OVER (PARTITION BY run) AS a FROM (SELECT * FROM ahead UNION ALL SELECT * FROM behind) WHERE n >= {MIN_WORDS}),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(i0, i1)) AS i FROM runs WHERE a <> {{'d': doc_id, 'p': p}}),
kept AS (SELECT r.doc_id, string_agg(r.line, chr(10) ORDER BY r.i) AS text FROM raw r LEFT JOIN gone g USING (doc_id, i)
        WHERE g.i IS NULL GROUP BY r.doc_id),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL WHEN n.n IS NULL THEN d.text ELSE coalesce(k.text, '') END AS text,
    CAST(coalesce(n.n, 0) AS BIGINT) AS deleted_lines
FROM documents d LEFT JOIN kept k USING (doc_id) LEFT JOIN n USING (doc_id)"""


def dedup_stage(docs: DataFrame) -> DataFrame:
    """:func:`line_dedup` as a pipeline stage: the columns of ``docs``, and no
    document whose every line was a repeat (a text that was empty before stays)."""
    out = line_dedup(docs)
    out = out.filter((F.col("_ld_deleted") == 0) | (F.trim("text") != ""))
    return out.select(*[F.length("text").cast(docs.schema["n_chars"].dataType).alias(c)
                        if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])
