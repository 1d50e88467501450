"""Substring dedup: documents are factored against an index of reference blocks of earlier documents.

Reference blocks are cut by content. In every window of ``window`` words the run of ``ANCHOR_WORDS`` words
with the least hash is its anchor; neighbouring windows with one anchor form a block, which reaches from the
first word of its first window to the last word of its last. Equal windows have equal anchors at equal
places, wherever they stand, so a document's window can only be found in blocks with its anchor.

The index maps an anchor and a whole block to the earliest document that has the block. It is joined with all
blocks by hash: a block that an earlier document has is a duplicate whole, and adjoining duplicates make one
long factor. Where a block is known whole to no earlier document but its anchor is, each window of the block
is joined by hash with all windows of the blocks with that anchor. No document is parsed from left to right. Nothing else can
hold a duplicate window, so the factors of at least ``window`` words are exactly the duplicate spans.

Only anchors shared by documents with different ids go on after the first pass. An anchor or block of any
frequency is first combined where it is read, and joins keep the index side unique, so a passage in a third
of all documents is no hot group; no two occurrences of it are ever paired.

Defined results: a null or empty text has no words; documents of fewer words than a window keep all; words
stay as they are; a null id counts as later than all ids; rows with equal ids never remove each other's words;
repeated rows give repeated results; an empty table gives no rows; further columns are ignored. Blocks and
windows are compared by two independent 64-bit hashes each. Texts under one id (all rows without an id have
one) are told apart by a 128-bit hash in two halves, ``t`` and ``u``; rows equal in all three share one list
of runs, so any number of them costs in proportion.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.text import WordHashes, byte_texts, flat_lists, mixed, signed
from touchline.session import materialize

#: Words of an anchor.
ANCHOR_WORDS = 8

#: Stands for a null id.
_NO_ID = (1 << 63) - 1

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BLOCKS = "id long, t long, u long, starts array<int>, counts array<int>, anchors array<long>, blocks array<long>"
_WINDOWS = "anchor long, win long, id long, t long, u long, start int"
#: What tells documents apart.
_KEY = ["id", "t", "u"]


class _Rolling:
    """Hashes of word ranges of one document in constant time each, by sums of powers modulo 2**64."""

    _powers = np.ones(1, np.uint64)
    _inverses = np.ones(1, np.uint64)

    def __init__(self, hashes: np.ndarray) -> None:
        n = len(hashes)
        if len(_Rolling._powers) <= n:
            size = max(n + 1, 2 * len(_Rolling._powers))
            for name, base in (("_powers", _BASE), ("_inverses", _INVERSE)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(_Rolling, name, np.cumprod(steps, dtype=np.uint64))
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(hashes * _Rolling._powers[:n], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of the words from each start up to, not including, each end."""
        return mixed((self.sums[ends] - self.sums[starts]) * _Rolling._inverses[starts])


def blocks_of(hashes: np.ndarray, window: int, anchor: int = ANCHOR_WORDS) -> tuple[np.ndarray, ...]:
    """First window, number of windows, anchor hash and block hash of every block, in order."""
    none = np.zeros(0, np.int64)
    if len(hashes) < window:
        return none, none, none.astype(np.uint64), none.astype(np.uint64)
    rolling = _Rolling(hashes)
    n, span = len(hashes) - anchor + 1, window - anchor + 1
    at = np.arange(n)
    grams = rolling.of(at, at + anchor)
    # the leftmost least gram of each window: upper half hash, lower half place, least of doubled runs
    least = (grams & np.uint64(0xFFFF_FFFF_0000_0000)) | at.astype(np.uint64)
    run = 1
    while run * 2 <= span:
        least = np.minimum(least[:-run], least[run:])
        run *= 2
    if run < span:
        least = np.minimum(least[: len(least) - (span - run)], least[span - run :])
    place = (least & np.uint64(0xFFFF_FFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    last = np.concatenate([first[1:], [len(place)]]) - 1
    where = place[first]
    block = mixed(rolling.of(first, last + window) ^ mixed(((last - first) << 32 | (where - first)).astype(np.uint64)))
    return first, last - first + 1, grams[where], block


def _columns(documents: DataFrame, key: str, text: str) -> DataFrame:
    return documents.select(F.coalesce(F.col(key).cast("long"), F.lit(_NO_ID)).alias("id"), F.col(text).alias("text"))


def _index_rows(rows: DataFrame, window: int) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordHashes()
        for batch in batches:
            bodies, parts = list(byte_texts(batch.column(1))), [[], [], [], []]
            for body in bodies:
                found = blocks_of(table.of(body.split()) if body else np.zeros(0, np.uint64), window)
                for part, values in zip(parts, found, strict=True):
                    part.append(values)
            lengths = [len(x) for x in parts[0]]
            joined = [np.concatenate(p) if p else np.zeros(0, np.int64) for p in parts]
            lists = [flat_lists(v.astype(np.int32), lengths, pa.int32()) for v in joined[:2]] + [flat_lists(signed(v.astype(np.uint64)), lengths, pa.int64()) for v in joined[2:]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *_marks(bodies), *lists], names=[*_KEY, "starts", "counts", "anchors", "blocks"])

    return rows.mapInArrow(cut, _BLOCKS)


def _marks(bodies: list[bytes | None]) -> list[pa.Array]:
    """Two halves of a hash that tells texts under one id apart."""
    digests = b"".join(hashlib.blake2b(body or b"", digest_size=16).digest() for body in bodies)
    halves = np.frombuffer(digests, np.int64).reshape(-1, 2)
    return [pa.array(halves[:, i].copy()) for i in (0, 1)]


def _packed(rows: DataFrame) -> DataFrame:
    """Id, marks and compressed words of every document: what is shuffled instead of the text."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            bodies = list(byte_texts(batch.column(1)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *_marks(bodies), pa.array([press.compress(b" ".join(b.split()) if b else b"") for b in bodies], pa.binary())],
                names=[*_KEY, "words"],
            )

    return rows.mapInArrow(pack, "id long, t long, u long, words binary")


def _lists(column: pa.Array, field: str) -> tuple[np.ndarray, np.ndarray]:
    """Values of one field of a column of lists of structures, and where each row's begin and end."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.values.field(field).to_numpy(zero_copy_only=False), column.offsets.to_numpy()


def _single_windows(open_blocks: DataFrame, packed: DataFrame, window: int) -> DataFrame:
    """Every window of the given blocks: anchor, hash, id, marks, first word."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, press = WordHashes(), zstandard.ZstdDecompressor()
        for batch in batches:
            (start, at), (count, _), (anchor, _) = (_lists(batch.column(4), f) for f in ("start", "count", "anchor"))
            out = [[], [], [], [], [], []]
            keys = [batch.column(k).to_numpy() for k in range(3)]
            for i, words in enumerate(batch.column(3).to_pylist()):
                rolling = _Rolling(table.of(press.decompress(words).split()))
                a, c, h = (x[at[i] : at[i + 1]] for x in (start, count, anchor))
                starts = np.repeat(a, c) + np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
                for part, values in zip(
                    out,
                    (np.repeat(h, c), signed(rolling.of(starts, starts + window)), *(np.full(len(starts), k[i]) for k in keys), starts.astype(np.int32)),
                    strict=True,
                ):
                    part.append(values)
                if sum(map(len, out[0])) > 100_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(p)) for p in out], names=["anchor", "win", *_KEY, "start"])
                    out = [[], [], [], [], [], []]
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(p)) for p in out], names=["anchor", "win", *_KEY, "start"])

    lists = open_blocks.groupBy(*_KEY).agg(F.collect_set(F.struct("start", "count", "anchor")).alias("open"))
    return packed.join(lists, _KEY).select(*_KEY, "words", "open").mapInArrow(look, _WINDOWS)


def factors(documents: DataFrame, window: int = 50, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Runs of duplicate windows: id, marks, first window, number of windows, an earlier document.

    Runs may adjoin or repeat; ``parsed`` joins them into factors.
    """
    rows = _columns(documents, key, text)
    occurrences = _index_rows(rows, window).select(*_KEY, F.explode(F.arrays_zip("starts", "counts", "anchors", "blocks")).alias("x")).select(
        *_KEY, F.col("x.starts").alias("start"), F.col("x.counts").alias("count"), F.col("x.anchors").alias("anchor"), F.col("x.blocks").alias("block")
    )
    occurrences = materialize(occurrences)
    # the unique sides are written before they are joined: a join on the key of an aggregation would gather a
    # frequent key in one task, while two shuffled tables can be split there
    shared = materialize(occurrences.groupBy("anchor").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("anchor"))
    known = materialize(occurrences.join(shared, "anchor", "left_semi"))
    index = materialize(known.groupBy("anchor", "block").agg(F.min("id").alias("source")))
    several = materialize(index.groupBy("anchor").agg(F.min("source").alias("low"), F.max("source").alias("high")).where("low < high").select("anchor"))
    found = materialize(known.join(index, ["anchor", "block"]))
    whole = found.where("source < id").select(*_KEY, "start", "count", "source")
    boundary = found.where("source = id").join(several, "anchor", "left_semi")
    windows = materialize(_single_windows(boundary, _packed(rows), window))
    earliest = materialize(windows.groupBy("anchor", "win").agg(F.min("id").alias("source"), F.max("id").alias("high")).where("source < high").select("anchor", "win", "source"))
    single = windows.join(earliest, ["anchor", "win"]).where("source < id").select(*_KEY, "start", F.lit(1).alias("count"), "source")
    return whole.union(single)


def parsed(documents: DataFrame, window: int = 50, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every document with its factors and what is left of it.

    Returns id, n_words, n_removed, kept_sha256 (of the words left, joined by one blank) and factors, an
    array of (start, length) in words, ascending and disjoint.
    """
    rows = _columns(documents, key, text)
    runs = materialize(factors(documents, window, key, text).groupBy(*_KEY).agg(F.collect_set(F.struct("start", "count")).alias("runs")))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor()
        for batch in batches:
            (start, at), (count, _) = (_lists(batch.column(2), f) for f in ("start", "count"))
            valid = batch.column(2).is_valid().to_pylist()
            totals, removed, digests, spans = [], [], [], []
            for i, packed in enumerate(batch.column(1).to_pylist()):
                body = press.decompress(packed)
                words = body.split()
                a, c = (x[at[i] : at[i + 1]].astype(np.int64) if valid[i] else np.zeros(0, np.int64) for x in (start, count))
                own = []
                if len(a):
                    change = np.zeros(len(words) + 1, np.int64)
                    np.add.at(change, a, 1)
                    np.add.at(change, a + c + window - 1, -1)
                    inside = np.cumsum(change[:-1]) > 0
                    edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
                    own = [{"start": int(s), "length": int(e - s)} for s, e in zip(edges[::2], edges[1::2], strict=True)]
                    body = b" ".join([words[j] for j in np.flatnonzero(~inside)])
                totals.append(len(words))
                removed.append(sum(s["length"] for s in own))
                digests.append(hashlib.sha256(body).hexdigest())
                spans.append(own)
            kind = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(totals, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string()), pa.array(spans, kind)],
                names=["id", "n_words", "n_removed", "kept_sha256", "factors"],
            )

    joined = _packed(rows).join(runs, _KEY, "left").select("id", "words", "runs")
    out = joined.mapInArrow(parse, "id long, n_words long, n_removed long, kept_sha256 string, factors array<struct<start:int,length:int>>")
    return out.withColumn("id", F.when(F.col("id") != _NO_ID, F.col("id")))
