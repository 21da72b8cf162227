"""Tables for the tests of statlens.llm."""

import random

from pyspark.sql import functions as F
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
#: Extra columns with the names that operators use for their own.
EXTRA = ["th", "node", "key", "label", "p", "i", "h", "w", "s", "score", "rank", "batch", "bucket", "_ld_gone_", "gram", "lines", "b"]


def docs_of(spark, rows, extra=True):
    """Rows (doc_id, text[, lang]) as a documents table, with clashing columns."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else None, None, None if r[1] is None else len(r[1])) for r in rows]
    df = spark.createDataFrame(full, DOCS)
    if extra:
        df = df.select("*", *[F.lit(k).alias(c) for k, c in enumerate(EXTRA)])
    return df


def prose(seed, n, vocabulary=400):
    r = random.Random(seed)
    words = [f"w{r.randrange(vocabulary)}{'abcdefgh'[r.randrange(8)] * r.randrange(1, 4)}" for _ in range(n)]
    return " ".join(words)
