"""Secret scans by token efficiency.

Patterns give the base spans (assignments, access keys, long hex runs).  The
method adds `random` spans: runs of key characters that a tiktoken vocabulary
can only spell out, with ``RATIO`` characters per token or fewer.  The ratio decides for
whole runs, and for the longer pieces between their marks, so that a path doesn't hide
a key.  Words, names and paths need no rule: the vocabulary has their parts.
Left out before are what is as dense as a key but known: digests (hex of a usual
length), UUIDs, runs without a letter (dates, numbers) and runs of mostly marks.

Spans count code points, the end exclusive, and are listed by start, then kind.

Defined cases: a NULL text is empty; no span gives empty lists; whole texts are
read, however long; rows are scanned one by one.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statlens.llm.common import with_text_columns

#: Characters per token up to which a run counts as random; share of marks from which it counts as none.
RATIO, MARKS = 2.0, 0.25
#: Shortest piece that the ratio is taken of.
PIECE = 16
VOCABULARY = "byte_bpe_50k.tiktoken"

# The patterns of the contract, in its order.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # [0-9a-f]+ of 24 characters or more: runs are whole either way
KINDS = ("assign", "access", "hex", "random")
KEYWORDS = ("passw", "secret", "token", "apikey", "api_key")

RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
DIGEST = re.compile(r"(?:[0-9a-f]+|[0-9A-F]+)")
DIGEST_CHARS = {32, 40, 48, 56, 64, 96, 128}
UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")


@lru_cache(maxsize=2)
def _encoder(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("vocabulary", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path(VOCABULARY))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns' matches."""
    out = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def is_random(run: str, encoder) -> bool:
    """Whether a run of key characters is spelt out by the vocabulary."""
    pieces = [x for x in re.split(r"([/_=+-]+)", UUID.sub("", run)) if not (len(x) in DIGEST_CHARS and DIGEST.fullmatch(x))]
    for part in ("".join(pieces), *pieces):
        letters, digits = sum(map(str.isalpha, part)), sum(map(str.isdigit, part))
        if len(part) >= PIECE and letters and letters + digits >= (1 - MARKS) * len(part):
            if len(part) <= RATIO * len(encoder.encode_ordinary(part)):
                return True
    return False


def random_spans(text: str, taken: list[tuple[int, int, int]], encoder) -> list[tuple[int, int, int]]:
    """Runs that are random and lie outside the spans taken."""
    merged: list[list[int]] = []
    for s, _, e in taken:  # by start
        if merged and s <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e])
    out, at = [], 0
    for m in RUN.finditer(text):
        while at < len(merged) and merged[at][1] <= m.start():
            at += 1
        if (at == len(merged) or merged[at][0] >= m.end()) and is_random(m[0], encoder):
            out.append((m.start(), 3, m.end()))
    return out


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def scan(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``docs`` with ``_se_n_assign``, ``_se_n_access``, ``_se_n_hex``, ``_se_n_random``,
    ``_se_base`` and ``_se_spans`` (lists as kind:start:end)."""
    path = path or _path()

    def make(texts):
        encoder, out = _encoder(path), [[] for _ in range(6)]
        for t in texts:
            base = base_spans(t or "")
            extra = random_spans(t or "", base, encoder)
            for k in range(3):
                out[k].append(sum(x[1] == k for x in base))
            out[3].append(len(extra)), out[4].append(listed(base)), out[5].append(listed(base + extra))
        return out

    fields = [(f"_se_n_{k}", "long") for k in KINDS] + [("_se_base", "string"), ("_se_spans", "string")]
    return with_text_columns(docs, make, fields)


def digest(listing: str) -> str:
    return hashlib.sha256(listing.encode()).hexdigest()


def secrets(docs: DataFrame) -> DataFrame:
    """One row per document with the counts and spans of its secrets."""
    found = scan(docs.select("doc_id", "text"))
    return found.select("doc_id", *[F.col(f"_se_n_{k}").alias(f"n_{k}") for k in KINDS],
                        F.sha2("_se_base", 256).alias("base_sha256"), F.col("_se_spans").alias("spans"))
