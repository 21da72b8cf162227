"""Cost-balanced packing of token sequences.

A document's ids are cut into pieces of ``LENGTH``; a full piece is a sequence
by itself.  The rests of ``BATCH`` documents are packed together: the number of
sequences is the smallest that holds them, and rests in descending length go to
the sequence with the lowest cost (``LINEAR`` * tokens + ``QUADRATIC`` * tokens
squared, for attention within the piece) that has room.  A rest that fits
nowhere is cut over the emptiest sequences, so a batch pads less than one
sequence in all.

Packing happens where the documents are: batches follow the order of rows in a
partition and nothing is shuffled; sequence ids are the partition's number and a
count.  The ids are those of the tokenizer file ``VOCABULARY`` of `tokenizers`;
they are made by tiktoken from the same vocabulary and the file's added tokens (a
text that spells ``<|endoftext|>`` gets its id, as the file reads it), which is
tested to agree and takes a quarter of the time.

Defined cases: a NULL text is empty, and an empty text has the end id alone;
repeated rows are packed like any other; an empty table gives no piece; batches
are bounded in tokens as well, so very long texts don't pile up.
"""

from __future__ import annotations

import heapq
import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statlens.llm.secrets import _path

#: The tokenizer file whose added tokens count.
TOKENIZER = "byte_bpe_50k.json"
LENGTH = 2048
END = 1
BATCH = 4096
BATCH_TOKENS = 8_000_000
LINEAR = 1.0
QUADRATIC = 1.0 / LENGTH
COLUMNS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def cost(tokens: int) -> float:
    return LINEAR * tokens + QUADRATIC * tokens * tokens


def assign(lengths: list[int], capacity: int = LENGTH) -> list[list[tuple[int, int, int]]]:
    """For each sequence its pieces (item, start in the item, length)."""
    total = sum(lengths)
    count = -(-total // capacity)
    room = np.full(count, capacity)
    spent = np.zeros(count)
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(count)]

    def put(s: int, item: int, start: int, n: int) -> None:
        out[s].append((item, start, n))
        room[s] -= n
        spent[s] += cost(n)

    heap = [(0.0, s) for s in range(count)]  # sequences by cost; entries may be out of date
    late = []
    for item in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        n, aside, done = lengths[item], [], False
        while heap:
            c, s = heapq.heappop(heap)
            if c != spent[s] or not room[s]:
                continue
            if room[s] >= n:
                put(s, item, 0, n)
                heapq.heappush(heap, (spent[s], s))
                done = True
                break
            aside.append((c, s))
            if len(aside) == 64:  # few of the cheapest have room: look at all at once
                fits = np.flatnonzero(room >= n)
                if len(fits):
                    s = int(fits[np.argmin(spent[fits])])
                    put(s, item, 0, n)
                    heapq.heappush(heap, (spent[s], s))
                    done = True
                break
        for x in aside:
            heapq.heappush(heap, x)
        if not done:
            late.append(item)
    for item in late:  # cut over the emptiest sequences
        start = 0
        while start < lengths[item]:
            s = int(np.argmax(room))
            n = int(min(room[s], lengths[item] - start))
            put(s, item, start, n)
            start += n
    return out


def pieces(ids: np.ndarray) -> tuple[int, list[tuple[int, int]]]:
    """Where the rest begins, and the full pieces (start, crc32)."""
    rest = len(ids) // LENGTH * LENGTH
    return rest, [(a, zlib.crc32(ids[a:a + LENGTH].tobytes())) for a in range(0, rest, LENGTH)]


@lru_cache(maxsize=2)
def encoder_of(path: str, tokenizer: str):
    """tiktoken's encoder of the vocabulary ``path`` with the added tokens of the file ``tokenizer``."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    with open(tokenizer, encoding="utf-8") as f:
        added = json.load(f)["added_tokens"]
    if any(a["single_word"] or a["lstrip"] or a["rstrip"] for a in added):
        raise ValueError(f"{tokenizer}: an added token takes more than its own text")
    return tiktoken.Encoding("vocabulary", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                             special_tokens={a["content"]: a["id"] for a in added})


def _tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path(TOKENIZER))


def encode(text: str | None, encoder) -> np.ndarray:
    """The ids of a whole text and the end id."""
    return np.append(encoder.encode_to_numpy(text or "", allowed_special="all"), END).astype("<u4")


def pack(docs: DataFrame, path: str | None = None, tokenizer: str | None = None) -> DataFrame:
    """One row per piece of each document: ``COLUMNS``."""
    path, tokenizer = path or _path(), tokenizer or _tokenizer()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, base, made = encoder_of(path, tokenizer), TaskContext.get().partitionId() << 36, 0
        rests: list[tuple[object, int, int, np.ndarray]] = []  # doc_id, start, tokens, ids
        out: list[tuple] = []
        held = 0

        def flush():
            nonlocal made, held
            for seq in assign([len(r[3]) for r in rests]):
                at = 0
                for item, start, n in seq:
                    doc, begin, tokens, ids = rests[item]
                    out.append((doc, begin + start, n, zlib.crc32(ids[start:start + n].tobytes()), tokens, base + made, at))
                    at += n
                made += 1
            rests.clear()
            held = 0

        def batch():
            b = pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], list(COLUMNS))
            out.clear()
            return b

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids = encode(text.as_py(), encoder)
                rest, full = pieces(ids)
                for start, crc in full:
                    out.append((doc, start, LENGTH, crc, len(ids), base + made, 0))
                    made += 1
                if rest < len(ids):
                    rests.append((doc, rest, len(ids), ids[rest:].copy()))
                    held += len(ids) - rest
                if len(rests) >= BATCH or held >= BATCH_TOKENS:
                    flush()
                if len(out) >= 10_000:
                    yield batch()
        flush()
        if out:
            yield batch()

    schema = ", ".join(f"{c} long" for c in COLUMNS)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rows, schema)
