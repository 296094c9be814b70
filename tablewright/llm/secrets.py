"""Secret scan: base patterns, and random strings that a tokenizer's vocabulary cannot shorten.

Written words and identifiers are long pieces of a byte-pair vocabulary, random strings are short ones. A run of
at least MIN_RUN key characters with fewer than MAX_RATIO characters a token is a secret, unless it is a known form
of something public: a digest (hex digits of a usual digest's length), a UUID, a plain number, or an identifier or path
whose parts are words of the vocabulary. The form of an identifier alone is none: keys have it too.

Defined cases: a null text is empty and has no spans; offsets are code points, the end exclusive; a run inside a
base span is not reported twice; rows that repeat are scanned alike; an empty table gives an empty result. Only the
two named columns are read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship, table

#: Ranks of the vocabulary, a line of base64 and number each; read on the driver and sent along, 16 MB at most.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
MOST_BYTES = 16 << 20
MIN_RUN = 20
MAX_RATIO = 2.2

# The published splitting pattern of byte-level BPE, and the contract's base patterns.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "random")

# Runs that are too short are passed over by a longer least repetition: the longest run starts where any would.
_LONG_HEX = re.compile(r"[0-9a-f]{24,}")
_RUN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % MIN_RUN)
_KEYWORDS = ("passw", "secret", "token", "api")
_DIGEST = re.compile(r"(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{48}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}|[0-9a-fA-F]{128})")
_UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
_WORDS = re.compile(r"[/_=+-]*(?:(?:[A-Z]?[a-z]{2,}|[A-Z]+|[0-9]{1,4}|[a-z])(?:[/_=+-]+|$))+")
_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
# One way only to cut a run into words, so that a long run is matched or refused in one pass.
_CAMEL = re.compile(r"[A-Z]?[a-z]{3,}(?:[A-Z][a-z]{3,}){0,7}[0-9]{0,4}")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, in order."""
    out = []
    low = text.lower()
    if any(k in low for k in _KEYWORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in _LONG_HEX.finditer(text)]
    return sorted(out)


def is_known(run: str) -> bool:
    """Whether a run is of a public form, whatever the vocabulary."""
    return bool(run.isdigit() or len(set(run)) < 6 or _DIGEST.fullmatch(run) or _UUID.fullmatch(run))


def is_identifier(run: str, encoding, max_ratio: float = MAX_RATIO) -> bool:
    """Whether a run has the form of an identifier and its parts are words: each of three letters or more is one token or
    has the ratio, with or without a space before it, as it is or in lower case; and these have half of all letters."""
    if not (_WORDS.fullmatch(run) or _CAMEL.fullmatch(run)):
        return False
    parts = _PART.findall(run)
    long = [p for p in parts if len(p) > 2]
    if 2 * sum(map(len, long)) < sum(map(len, parts)):
        return False

    def is_word(part: str) -> bool:
        n = min(len(encoding.encode_ordinary(space + p)) for p in (part, part.lower()) for space in ("", " "))
        return n == 1 or len(part) >= max_ratio * n

    return all(map(is_word, long))


@lru_cache(maxsize=2)
def encoder(raw: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
    return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def random_spans(text: str, base: list[tuple[int, int, int]], encoding, max_ratio: float = MAX_RATIO) -> list[tuple[int, int, int]]:
    out, starts, ends = [], sorted(s for s, _, _ in base), list(accumulate((e for _, _, e in sorted(base)), max))
    for m in _RUN.finditer(text):
        run, before = m[0], bisect_right(starts, m.start())
        if is_known(run) or (before and m.end() <= ends[before - 1]):
            continue
        if len(run) < max_ratio * len(encoding.encode_ordinary(run)) and not is_identifier(run, encoding, max_ratio):
            out.append((m.start(), 3, m.end()))
    return out


def _join(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, max_ratio: float = MAX_RATIO, redact: bool = False) -> DataFrame:
    """id, n_assign, n_access, n_hex, n_random, base (its spans), spans (all), and with redact the text, each span
    replaced by its kind in angle brackets."""
    ship(docs.sparkSession)
    with open(vocabulary, "rb") as f:
        raw = f.read(MOST_BYTES + 1)
    if len(raw) > MOST_BYTES:
        raise ValueError(f"{vocabulary} has over {MOST_BYTES} bytes")
    shared = docs.sparkSession.sparkContext.broadcast(raw)
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    counts = [f"n_{k}" for k in KINDS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = encoder(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, rows = batch.slice(at, 256), []
                for value in part.column(1):
                    text = value.as_py() or ""
                    base = base_spans(text)
                    every = base + random_spans(text, base, encoding, max_ratio)
                    kinds = [k for _, k, _ in every]
                    rows.append([*(kinds.count(k) for k in range(4)), _join(base), _join(every), redacted(text, every) if redact else None])
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, pa.int64()) for c in columns[:4]), *(pa.array(c, pa.string()) for c in columns[4:])], names=["id", *counts, "base", "spans", "text"])

    out = source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, {', '.join(f'{c} long' for c in counts)}, base string, spans string, text string")
    return out if redact else out.drop("text")


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    out, at = [], 0
    for start, kind, end in sorted(spans):
        if end > at:
            out += [text[at : max(at, start)], f"<{KINDS[kind]}>" if start >= at else ""]
            at = end
    return "".join([*out, text[at:]])


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_assign", "n_access", "n_hex", "n_random", F.sha2("base", 256).alias("base_sha256"), "spans")
