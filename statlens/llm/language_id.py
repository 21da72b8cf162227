"""Language ID: averaged hashed subword embeddings with a linear softmax.

A text is the average of the embeddings of its hashed character grams (2 to 4
letters of a word, its ends marked); a linear layer and a softmax give the
language.  Both are trained by stochastic gradient descent in numpy on a bounded
sample of labelled rows (at most ``SAMPLE`` per language, chosen by a hash of
id and text; repeated rows count once).

The score is the softmax's probability, with a temperature fitted on a third of the
sample that the descent hasn't seen.  It can't tell an unknown language, because one
class always wins.  What rejects a text is the share of its grams that the training
texts have: in a learnt language, or a mix of them, nearly all; elsewhere clearly
fewer.  The lowest share that passes is calibrated on the held third: ``REJECT`` of
its texts fall below.  ``FORGIVEN`` unknown grams and ``PRIOR`` known ones are
given to every text, so that a rare word doesn't reject a short one.

As average and layer are linear, prediction needs one table of class scores for
each bucket; a text costs a gather and a sum, over all of its characters.

Defined cases: NULL texts and texts without a letter are `und`, score 0,
rejected; with no labelled row, so is every text; rows are judged one by one, so
repeated rows, ties and other columns don't matter; equal scores go to the
language first in the alphabet.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statlens.llm.common import bounded_sample, crc_mod, with_text_columns
from statlens.llm.shingles import mix

BUCKETS = 1 << 16
DIM = 16
SAMPLE = 1000
EPOCHS = 8
RATE = 4.0
REJECT = 0.001
FORGIVEN, PRIOR = 3, 30
CHUNK = 1 << 20  # characters held as numpy arrays at once
U = np.uint64
_LETTER: np.ndarray | None = None


def _letters() -> np.ndarray:
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _LETTER


def subwords(text: str) -> np.ndarray:
    """Buckets of the character grams of a piece of text, in order."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    c = np.where(_letters()[c], c, 32)
    c = np.concatenate(([32], c, [32])).astype(U)
    space = c == 32
    keep = np.ones(len(c), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    c = c[keep]
    if len(c) < 3:
        return np.empty(0, np.int64)
    space = c == 32
    out, h = [], c
    for n in (2, 3, 4):
        if len(c) < n:
            break
        m = len(c) - n + 1
        h = h[:m] * U(0x9E3779B97F4A7C15) + c[n - 1:]
        inside = np.zeros(m, bool)
        for j in range(1, n - 1):
            inside |= space[j:j + m]
        out.append(h[~inside] + U(n))
    return (mix(np.concatenate(out)) >> U(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


def pieces(text: str):
    """A very long text in pieces that end at a space where there is one."""
    at = 0
    while at < len(text):
        end = min(len(text), at + CHUNK)
        if end < len(text) and (cut := text.rfind(" ", at, end)) > at:
            end = cut
        yield text[at:end]
        at = end


def counts(text: str) -> np.ndarray:
    total = np.zeros(BUCKETS, np.int64)
    for piece in pieces(text):
        total += np.bincount(subwords(piece), minlength=BUCKETS)
    return total


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # scores of each bucket and language
    known: np.ndarray  # whether a training text has the bucket
    threshold: float  # of the share of known grams

    def predict(self, texts: list[str | None]) -> tuple[list, list, list]:
        """Language, score and whether it is rejected, for each text."""
        langs, scores, rejected = [], [], []
        for text in texts:
            total, n, known = np.zeros(len(self.languages)), 0, 0
            for piece in pieces(text or ""):
                g = subwords(piece)
                total += self.table[g].sum(axis=0, dtype=np.float64)
                known += int(self.known[g].sum())
                n += len(g)
            if not n or not self.languages:
                langs.append("und"), scores.append(0.0), rejected.append(True)
                continue
            p = softmax(total / n)
            k = int(p.argmax())
            langs.append(self.languages[k]), scores.append(float(p[k])), rejected.append(bool(share(known, n) < self.threshold))
        return langs, scores, rejected


def share(known, n):
    """The share of known grams, after what every text is given."""
    return np.minimum(1.0, (known + FORGIVEN + PRIOR) / (n + PRIOR))


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(rows: list[tuple[np.ndarray, np.ndarray, str]], seed: int = 7, reject: float = REJECT) -> Model:
    """Rows: buckets, their counts and the language of a text."""
    languages = sorted({lang for _, _, lang in rows})
    if not languages:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(BUCKETS, bool), 0.0)
    where = {lang: k for k, lang in enumerate(languages)}
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(rows))
    held, fit = np.split(order, [len(rows) // 3])
    E = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    W = np.zeros((DIM, len(languages)), np.float32)
    seen = np.zeros(BUCKETS, bool)
    steps, done = EPOCHS * len(fit), 0
    for _ in range(EPOCHS):
        for r in rng.permutation(fit):
            ids, n, lang = rows[r]
            w = (n / n.sum()).astype(np.float32)
            x = E[ids]
            h = w @ x
            g = softmax(h @ W)
            g[where[lang]] -= 1
            rate = np.float32(RATE * (1 - done / steps))
            back = W @ g
            W -= rate * 0.1 * np.outer(h, g)
            E[ids] = x - rate * np.outer(w, back)
            seen[ids] = True
            done += 1
    table = E @ W
    table[~seen] = 0  # grams that no labelled text has say nothing
    held = held if len(held) else fit
    logits = np.array([(rows[r][1] / rows[r][1].sum()) @ table[rows[r][0]] for r in held], np.float64)
    truth = np.array([where[rows[r][2]] for r in held])

    def loss(scale: float) -> float:
        return -np.log(softmax(logits * scale)[np.arange(len(held)), truth] + 1e-12).mean()

    scale = min(np.geomspace(0.1, 20, 60), key=loss)
    threshold = float(np.quantile([share(rows[r][1][seen[rows[r][0]]].sum(), rows[r][1].sum()) for r in held], reject))
    for r in held:  # known from here on
        seen[rows[r][0]] = True
    return Model(languages, (table * scale).astype(np.float32), seen, threshold)


def fit(docs: DataFrame, learn, sample: int = SAMPLE) -> Model:
    """Model from the rows of ``docs`` (doc_id, text, lang) under ``learn``."""
    labelled = docs.filter(learn & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return train([])
    chosen = bounded_sample(labelled.select("text", "lang", "doc_id"), "lang", F.xxhash64("doc_id", "lang", "text"), sizes, sample)

    def features(texts):
        found = [counts(t) for t in texts]
        ids = [np.flatnonzero(c) for c in found]
        return [[i.astype(np.uint16).tobytes() for i in ids],
                [np.minimum(c[i], 65535).astype(np.uint16).tobytes() for c, i in zip(found, ids)]]

    # Arrow keeps the sample in two buffers; the rows are views of them.
    made = with_text_columns(chosen, features, [("ids", "binary"), ("n", "binary")], rows=32)
    got = made.select("_draw", "lang", "ids", "n").toArrow().sort_by([("_draw", "ascending"), ("lang", "ascending")]).combine_chunks()
    ids, n = (got[c].combine_chunks() for c in ("ids", "n"))
    rows = [(np.frombuffer(ids[k].as_buffer(), np.uint16), np.frombuffer(n[k].as_buffer(), np.uint16), lang)
            for k, lang in enumerate(got["lang"].to_pylist())]
    return train([r for r in rows if len(r[0])])


FOLDS, HELD = 4, 2


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``_li_lang``, ``_li_score`` and ``_li_rejected``."""
    return with_text_columns(docs, model.predict, [("_li_lang", "string"), ("_li_score", "double"), ("_li_rejected", "boolean")])


def language_id(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected of each row; the rows
    held out (crc32 of the id modulo 4 is 2) aren't learnt from."""
    held = crc_mod(F.col("doc_id"), FOLDS) == HELD
    model = fit(docs, ~held)
    return (predict(docs.select("doc_id", "text"), model)
            .select("doc_id", held.alias("held_out"), F.col("_li_lang").alias("lang_pred"),
                    F.col("_li_score").alias("score"), F.col("_li_rejected").alias("rejected")))


def known_language(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose language isn't rejected."""
    model = fit(docs, crc_mod(F.col("doc_id"), FOLDS) != HELD)
    return predict(docs, model).filter("NOT _li_rejected").select(*[F.col(f"`{c}`") for c in docs.columns])
