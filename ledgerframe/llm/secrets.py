"""Secret scans: fixed patterns, and a token-efficiency test for random strings.

Three fixed kinds are found by pattern (assign, access, hex). Beyond them, every run of 16 or more token characters is
encoded with a public byte-pair vocabulary: natural words and names need one token for about four characters,
random strings one for about two or less. A run under `ratio` characters per token is a span of kind `random`, and so is a segment of it between / and _
that is judged alone. Left out are known shapes: digests (hex of 32, 40, 56, 64, 96 or 128 digits), UUIDs, numbers, dates and times, e-mail addresses, hosts of web
addresses, and what overlaps a base span.

Positions are code points of the whole text, end exclusive. Null text counts as empty; an empty text has no spans. Extra columns are ignored; a
null doc_id stays null. Every row gives one row. The vocabulary is read once per Python worker from `vocabulary`, which must lie at the same path on every host.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The base patterns, in the order of their kinds, and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LEAST = 6
KINDS = ("assign", "access", "hex", "random")
#: Characters encoded at once.
CHUNK = 4096

CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
DIGEST = re.compile(r"(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}|[0-9a-fA-F]{128})\Z")
SHAPE = re.compile(r"(?:[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}|[0-9][0-9TZ:/_+-]*)\Z")
NAME = re.compile(r"[A-Za-z]++[0-9]{0,4}+(?:[/_-][A-Za-z]*+[0-9]{0,4}+)*+\Z")  # possessive: no way back, so linear
#: An address, but not what stands between :// and a host; the host of a web address.
ADDRESS = re.compile(r"(?<![A-Za-z0-9._%+:/-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}|(?<=://)[a-z0-9-]+(?:\.[a-z0-9-]+)*\.[a-z]{2,}(?![A-Za-z0-9@._-])")
SEGMENT, PART = re.compile(r"[A-Za-z0-9+-]{16,}(?:=+\Z)?"), re.compile("[A-Za-z0-9]{6,}")
DIGIT, LETTER = re.compile("[0-9]"), re.compile("[A-Za-z]")
#: Public location of the vocabulary and the pattern that parts text into pieces before merging.
VOCABULARY = os.environ.get("LEDGERFRAME_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
PIECES = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_ENCODINGS: dict = {}


def encoding(path: str = VOCABULARY):
    if path not in _ENCODINGS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _ENCODINGS[path] = tiktoken.Encoding(os.path.basename(path), pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[path]


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the fixed patterns, by start, then kind as listed."""
    found = []
    lower = text.lower() if not text.isascii() else text.casefold()
    if "pass" in lower or "secret" in lower or "token" in lower or "api" in lower:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return [(a, KINDS[k], b) for a, k, b in sorted(found)]


def tokens(word: str, vocabulary: str) -> int:
    """Number of tokens of word; those over CHUNK characters are encoded in parts."""
    return sum(len(encoding(vocabulary).encode_ordinary(word[i : i + CHUNK])) for i in range(0, len(word), CHUNK))


def random_parts(run: str, ratio: float, vocabulary: str) -> list[tuple[int, int]]:
    """Spans of a run that are random strings: the whole run, or those of its segments between / and _ that are."""
    word = run.rstrip("=")
    if DIGEST.match(word) or SHAPE.match(word):
        return []
    if DIGIT.search(word) and LETTER.search(word) and not NAME.match(word) and len(word) < ratio * tokens(word, vocabulary):
        return [(0, len(run))]
    out = []
    for m in SEGMENT.finditer(run):
        part = m.group().rstrip("=")
        # Parts between hyphens are judged without them, so that a chain of short words is no random string.
        bare = part if "-" not in part and "+" not in part else "".join(PART.findall(part))
        if len(bare) >= 16 and LETTER.search(bare) and not (DIGEST.match(part) or SHAPE.match(part)) and len(bare) < ratio * tokens(bare, vocabulary):
            out.append(m.span())
    if out:
        return out
    # A run whose segments are all too short to be judged alone.
    parts = [p for p in PART.findall(word) if LETTER.search(p) and not DIGEST.match(p)]
    size = sum(map(len, parts))
    return [(0, len(run))] if size >= 16 and size < ratio * sum(tokens(p, vocabulary) for p in parts) else []


def random_spans(text: str, base: list[tuple[int, str, int]], ratio: float, vocabulary: str) -> list[tuple[int, str, int]]:
    out, at, far = [], 0, 0
    ends = [0]
    for _, _, e in base:
        ends.append(max(ends[-1], e))
    known = [m.span() for m in ADDRESS.finditer(text)] if "@" in text or "://" in text else []
    for m in CANDIDATE.finditer(text):
        while far < len(known) and known[far][1] < m.end():
            far += 1
        if far < len(known) and known[far][0] <= m.end() - len(m.group().lstrip("/")):
            continue
        for a, b in random_parts(m.group(), ratio, vocabulary):
            a, b = m.start() + a, m.start() + b
            while at < len(base) and base[at][0] < b:
                at += 1
            if ends[at] <= a:
                out.append((a, "random", b))
    return out


def _joined(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, kind, b in spans)


def scan(docs: DataFrame, ratio: float = 2.2, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per row of docs(doc_id, text): spans array<struct<kind, start, end>> by start, kind as in KINDS."""

    kind_of = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = []
            for text in batch.column("text").to_pylist():
                text = text or ""
                base = base_spans(text)
                more = random_spans(text, base, ratio, vocabulary)
                spans.append([{"kind": k, "start": a, "end": b} for a, k, b in sorted(base + more, key=lambda s: (s[0], KINDS.index(s[1])))])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, kind_of)], names=["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, spans array<struct<kind string, start int, end int>>")


def digest(found: DataFrame) -> DataFrame:
    """Counts by kind, the digest of the base spans and all spans as text, from scan()'s rows."""
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(text(F.filter("spans", lambda s: s["kind"] != "random")), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"),
    )


def redact(docs: DataFrame, mask: str = "[SECRET]", ratio: float = 2.2, vocabulary: str = VOCABULARY) -> DataFrame:
    """docs with every span of its text replaced by mask; other columns as they are."""
    schema = docs.schema

    place = schema.names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(place).to_pylist():
                if text:
                    base = base_spans(text)
                    parts, at = [], 0
                    for a, _, b in sorted(base + random_spans(text, base, ratio, vocabulary)):
                        if a >= at:
                            parts += [text[at:a], mask]
                        at = max(at, b)
                    text = "".join([*parts, text[at:]])
                out.append(text)
            columns = list(batch.columns)
            columns[place] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(run, schema)
