"""Secret scan of whole texts: named patterns, and a token-efficiency test for random strings.

A byte-pair vocabulary was fitted to language, so words and identifiers take few tokens for their length
and random strings take many. A run of key characters whose characters per token fall below a threshold
is reported as ``random``, unless it is a plain digest, a UUID or a number, or lies over a span
of a named pattern. Readable neighbours lift a run's average (a key at the end of a path), so what is left
of any other run is tested again without its named spans, UUIDs, digests and numbers: every part between
``/ = _ -`` by itself, then stretches of ``STRETCH`` characters at every token. Stretches below the
threshold that overlap are one span, if together they are below it too; else the densest of them is reported.

Everything runs per row on the text's bytes; places are converted to code points for what was found.

Defined results: a null or empty text has no spans; rows are independent, so repeated rows, ties and an
empty table need nothing special; other columns pass through, ``spans`` is added.
"""

from __future__ import annotations

import base64
import bisect
import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.text import byte_texts

# The named patterns, their order and least lengths.
KINDS = ("assign", "access", "hex", "random")
_ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
_ASSIGN_VALUE = 6
_NAMES = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(rb"[0-9a-f]{24,}")

#: Shorter than every match of the access and hex patterns, whose characters it includes.
_RUN = re.compile(rb"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")

# Lengths of hexadecimal digests (MD5, SHA-1, SHA-224, SHA-256, SHA-384, SHA-512).
_DIGESTS = frozenset({32, 40, 56, 64, 96, 128})
_PART = re.compile(rb"[^/=_-]+")
#: Least characters of a part or stretch that is judged by itself.
STRETCH = 20
_UUID = re.compile(rb"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")


class Vocabulary:
    """Token counts under a tiktoken rank file."""

    def __init__(self, path: str, pattern: str) -> None:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.lengths = {rank: len(token) for token, rank in ranks.items()}

    def _pieces(self, part: bytes) -> Iterator[list[int]]:
        """Tokens of a run, encoded in pieces so that a blob of any length costs in proportion to it."""
        return (self.encoding.encode_ordinary(part[i : i + 4096].decode()) for i in range(0, len(part), 4096))

    def tokens(self, part: bytes) -> int:
        return sum(map(len, self._pieces(part)))

    def edges(self, part: bytes) -> list[int]:
        """Where each token of a run begins, and the end of the last."""
        return list(itertools.accumulate((self.lengths[t] for piece in self._pieces(part) for t in piece), initial=0))


_VOCABULARIES: dict[str, Vocabulary] = {}


def _known(part: bytes) -> bool:
    """Digests, UUIDs and numbers are identifiers of something, not keys."""
    if re.fullmatch(rb"[0-9A-Fa-f]+", part) and len(part) in _DIGESTS:
        return True
    return bool(_UUID.fullmatch(part) or part.isdigit())


def _random(part: bytes, vocabulary: Vocabulary, least: float) -> bool:
    return len(part) >= STRETCH and not _known(part) and len(part) < least * vocabulary.tokens(part)


def _outside(run: bytes, cuts: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """What of a run no cut reaches, where it is long enough to be judged."""
    at = 0
    for start, end in [*sorted(cuts), (len(run), len(run))]:
        if start - at >= STRETCH:
            yield at, start
        at = max(at, end)


def _stretches(part: bytes, vocabulary: Vocabulary, least: float) -> Iterator[tuple[int, int]]:
    """Places of a text without gaps where it is random, though as a whole it is not."""
    edges, groups, j = vocabulary.edges(part), [], 0
    for i, start in enumerate(edges):
        while j < len(edges) and edges[j] - start < STRETCH:
            j += 1
        if j == len(edges):
            break
        ratio = (edges[j] - start) / (j - i)
        if ratio < least:
            if groups and start < groups[-1][1]:
                groups[-1][1] = edges[j]
                groups[-1][2] = min(groups[-1][2], (ratio, start, edges[j]))
            else:
                groups.append([start, edges[j], (ratio, start, edges[j])])
    for start, end, (_, first, last) in groups:
        for a, b in ((start, end), (first, last)):
            if _random(part[a:b], vocabulary, least):
                yield a, b
                break


def _hidden(run: bytes, named: list[tuple[int, int]], vocabulary: Vocabulary, least: float) -> Iterator[tuple[int, int]]:
    """Random parts and stretches of a run that is not reported whole, away from named spans and identifiers."""
    for first, last in _outside(run, [*named, *(m.span() for m in _UUID.finditer(run))]):
        rest, cuts = run[first:last], []
        for m in _PART.finditer(rest):
            found = _random(m[0], vocabulary, least)
            if found:
                yield first + m.start(), first + m.end()
            if found or m[0].isdigit() or len(m[0]) in _DIGESTS and _known(m[0]):
                cuts.append(m.span())
        for start, end in _outside(rest, cuts):
            for a, b in _stretches(rest[start:end], vocabulary, least):
                yield first + start + a, first + start + b


def scan(text: bytes, vocabulary: Vocabulary, least: float) -> list[tuple[int, int, int]]:
    """(start, kind, end) of every span of a text, in bytes, by start and kind."""
    found = []
    low = text.lower()
    if any(name in low for name in _NAMES):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= _ASSIGN_VALUE]
    runs = []
    for run in _RUN.finditer(text):
        part, at = run[0], run.start()
        found += [(at + m.start(), 1, at + m.end()) for m in _ACCESS.finditer(part)]
        found += [(at + m.start(), 2, at + m.end()) for m in _HEX.finditer(part)]
        if not _known(part):
            runs.append((at, part))
    taken = sorted((s, e) for s, _, e in found)
    ends = list(itertools.accumulate((e for _, e in taken), max))
    for at, part in runs:
        # the named spans that end behind the run's start and begin before its end reach into it
        named = taken[bisect.bisect_right(ends, at) : bisect.bisect_left(taken, (at + len(part),))]
        named = [(max(s - at, 0), e - at) for s, e in named if e > at]
        if not named and _random(part, vocabulary, least):
            found.append((at, 3, at + len(part)))
        else:
            found += [(at + s, 3, at + e) for s, e in _hidden(part, named, vocabulary, least)]
    return sorted(found)


def find_secrets(rows: DataFrame, ranks: str, pattern: str, text: str = "text", least: float = 1.9) -> DataFrame:
    """``rows`` with ``spans``, an array of (kind, start, end) in code points, end exclusive.

    ``ranks`` is a tiktoken rank file, ``pattern`` its splitting pattern, ``least`` the characters per
    token below which a run, part or stretch of 20 or more key characters counts as random.
    """
    columns = [c for c in rows.columns if c != "spans"]

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if ranks not in _VOCABULARIES:
            _VOCABULARIES[ranks] = Vocabulary(ranks, pattern)
        vocabulary = _VOCABULARIES[ranks]
        for batch in batches:
            out = []
            for body in byte_texts(batch.column(text)):
                here = []
                for start, kind, end in scan(body, vocabulary, least) if body else ():
                    first = len(body[:start].decode())
                    here.append({"kind": KINDS[kind], "start": first, "end": first + len(body[start:end].decode())})
                out.append(here)
            kept = [batch.column(c) for c in columns]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([*kept, pa.array(out, kind)], names=[*columns, "spans"])

    schema = rows.select(*columns, F.array().cast("array<struct<kind:string,start:int,end:int>>").alias("spans")).schema
    return rows.select(*columns).mapInArrow(spans, schema)
