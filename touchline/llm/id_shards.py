"""Token ids of whole texts in raw shard files, with a minimal perfect hash index for keyed access.

A shard is two files. ``<name>.ids`` holds the ids of its documents one after another, little endian, two
bytes each where the vocabulary allows and else four. ``<name>.idx`` holds a minimal perfect hash of the
documents' keys: bit levels in which each key owns the one set bit that no other key claimed, so its rank
among all set bits is its slot. A slot stores a fingerprint of the key, which tells other keys apart, and
the document's place; places store where the ids end. A lookup reads one slot and one run of ids however
large the shard is.

Shards are ranges of the key, so their order is the order of the keys. A task writes files under names
of its own and returns one row; only the shards named by the committed manifest table count, so retried
or lost tasks leave nothing that is read. Files go through ``pyarrow.fs`` to whatever store the folder's
address names.

Defined results: null and empty texts have the end id alone; null keys come first; repeated keys are kept
and told apart by their number of occurrence in the shard; an empty table gives an empty manifest; further
columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.text import byte_texts, mixed
from touchline.session import shared_folder

#: Ids that are read from a payload in one piece, and the rest of the last document of them.
PIECE_IDS = 1 << 20
#: Blank-separated parts whose ids a Python worker remembers; emptied beyond this.
CACHE_PARTS = 600_000

_MANIFEST = "shard long, name string, width int, n_docs long, n_tokens long"
_READ = "doc_id long, start long, n_tokens long, ids_crc32 long"
_MAGIC = b"TLIDX001"
_SLACK = 1.6

# The normalizer and the splitting pattern for which words can be encoded one by one.
_NORMALIZERS = ["NFC", "Replace", "Lowercase"]
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]*)")
_SIMPLE = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ.,;:!?]*")


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes as themselves, the others from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)}


class Encoder:
    """Ids of whole texts by a tokenizers file; parts between blanks are encoded once while remembered.

    That is the same as encoding the text whole where the file's normalizer and splitter never look
    across blanks; other files encode whole texts.
    """

    def __init__(self, path: str, end_id: int) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.whole = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2" if max(self.whole.get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4")
        self.end = np.array([end_id], self.kind).tobytes()
        self.parts: dict[bytes, bytes] = {}
        self.words: dict[str, bytes] = {}
        steps = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        split = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0].get("pattern", {}).get("Regex")
        added = [x for x in spec.get("added_tokens", []) if re.search(r"\s", x["content"]) or x["lstrip"] or x["rstrip"] or x["single_word"] or _SIMPLE.fullmatch(x["content"])]
        self.by_word = steps == _NORMALIZERS and split == _SPLIT and not added and not spec.get("post_processor")
        self.letters = _byte_letters()

    def _word(self, word: str) -> bytes:
        if (ids := self.words.get(word)) is None:
            if len(self.words) > CACHE_PARTS:
                self.words.clear()
            found = self.whole.model.tokenize(word.encode().decode("latin-1").translate(self.letters))
            ids = self.words[word] = np.array([x.id for x in found], self.kind).tobytes()
        return ids

    def _part(self, part: bytes) -> bytes:
        text = part.decode()
        if len(text) <= 64 and (plain := _PLAIN.fullmatch(text)):
            ids = self._word(plain[1].lower()) + (self._word(plain[2]) if plain[2] else b"")
        else:
            ids = np.array(self.whole.encode(text, add_special_tokens=False).ids, self.kind).tobytes()
        if len(part) <= 64:
            self.parts[part] = ids
        return ids

    def of(self, text: bytes | None) -> bytes:
        """The ids of one whole text, and the end id, as little-endian bytes."""
        if not text:
            return self.end
        if not self.by_word:
            return np.array(self.whole.encode(text.decode(), add_special_tokens=False).ids, self.kind).tobytes() + self.end
        if len(self.parts) > CACHE_PARTS:
            self.parts.clear()
        known, out = self.parts.get, []
        for part in text.split():
            out.append(known(part) or self._part(part))
        out.append(self.end)
        return b"".join(out)


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, end_id: int) -> Encoder:
    """One encoder per file and Python worker."""
    if (path, end_id) not in _ENCODERS:
        _ENCODERS[path, end_id] = Encoder(path, end_id)
    return _ENCODERS[path, end_id]


def key_hash(key: int | None, occurrence: int = 0) -> int:
    return xxhash.xxh3_64_intdigest(struct.pack("<?qq", key is None, key or 0, occurrence))


def key_hashes(keys: list[int | None]) -> np.ndarray:
    """The hashes of a shard's keys; a repeated key counts its occurrences."""
    seen: dict[int | None, int] = {}
    hashes = np.zeros(len(keys), np.uint64)
    for i, key in enumerate(keys):
        hashes[i] = key_hash(key, seen.get(key, 0))
        seen[key] = seen.get(key, 0) + 1
    return hashes


def _slots(hashes: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mixed(hashes ^ np.uint64(level * 0x51_7CC1_B727_2205)) % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit hashes: bit levels with ranks."""

    def __init__(self, sizes: list[int], bits: np.ndarray) -> None:
        self.sizes, self.bits = sizes, bits
        self.firsts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        words = np.bitwise_count(bits.view("<u8")) if len(bits) else np.zeros(0, np.uint8)
        self.ranks = np.concatenate([[0], np.cumsum(words)]).astype(np.int64)

    @classmethod
    def build(cls, hashes: np.ndarray) -> PerfectHash:
        sizes, levels, todo = [], [], hashes
        while len(todo):
            size = max(64, -(-int(len(todo) * _SLACK) // 64) * 64)
            slots = _slots(todo, len(sizes), size)
            own = np.bincount(slots, minlength=size) == 1
            levels.append(own)
            sizes.append(size)
            todo = todo[~own[slots]]
            if len(sizes) > 60:
                raise ValueError("two keys of a shard have one hash")
        return cls(sizes, np.packbits(np.concatenate(levels), bitorder="little") if levels else np.zeros(0, np.uint8))

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        """The slot of each key, or -1 where no key has set a bit for it."""
        out, todo = np.full(len(hashes), -1, np.int64), np.arange(len(hashes))
        words = self.bits.view("<u8")
        for level, size in enumerate(self.sizes):
            at = self.firsts[level] + _slots(hashes[todo], level, size)
            own = (self.bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
            mine = at[own]
            below = words[mine >> 6] & ((np.uint64(1) << (mine & 63).astype(np.uint64)) - np.uint64(1))
            out[todo[own]] = self.ranks[mine >> 6] + np.bitwise_count(below)
            todo = todo[~own]
        return out


class Index:
    """The contents of an ``.idx`` file."""

    def __init__(self, keys: list[int | None], ends: np.ndarray, width: int) -> None:
        self.keys, self.ends, self.width = keys, ends, width
        hashes = key_hashes(keys)
        self.hash = PerfectHash.build(hashes)
        slots = self.hash.slots(hashes)
        self.prints, self.places = np.zeros(len(keys), "<u4"), np.zeros(len(keys), "<u4")
        self.prints[slots] = (hashes >> np.uint64(32)).astype("<u4")
        self.places[slots] = np.arange(len(keys))

    def to_bytes(self) -> bytes:
        nulls = np.packbits(np.array([k is None for k in self.keys], bool))
        keys = np.array([k or 0 for k in self.keys], "<i8")
        head = struct.pack("<qqq", len(self.keys), self.width, len(self.hash.sizes))
        parts = [np.array(self.hash.sizes, "<i8"), self.hash.bits, self.prints, self.places, self.ends.astype("<i8"), keys, nulls]
        return _MAGIC + head + b"".join(p.tobytes() for p in parts)

    @classmethod
    def from_bytes(cls, data: bytes) -> Index:
        if data[:8] != _MAGIC:
            raise ValueError("not an index file")
        n, width, levels = struct.unpack_from("<qqq", data, 8)
        at = 32

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, count, at)
            at += out.nbytes
            return out

        self = cls.__new__(cls)
        sizes = take("<i8", levels).tolist()
        self.width, self.hash = width, PerfectHash(sizes, take("u1", sum(sizes) // 8))
        self.prints, self.places, self.ends, keys = take("<u4", n), take("<u4", n), take("<i8", n), take("<i8", n)
        nulls = np.unpackbits(take("u1", (n + 7) // 8), count=n)
        self.keys = [None if null else key for key, null in zip(keys.tolist(), nulls.tolist(), strict=True)]
        return self

    def spans(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place in the shard, first and end id of each key hash; place -1 for a key that is not stored."""
        slots = self.hash.slots(hashes)
        at = np.flatnonzero(slots >= 0)
        at = at[self.prints[slots[at]] == (hashes[at] >> np.uint64(32))]
        places, firsts, ends = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int64)
        places[at] = self.places[slots[at]]
        ends[at] = self.ends[places[at]]
        later = at[places[at] > 0]
        firsts[later] = self.ends[places[later] - 1]
        return places, firsts, ends

    def span(self, key: int | None, occurrence: int = 0) -> tuple[int, int] | None:
        """First and end place of a key's ids in the payload; None for a key that is not stored."""
        places, firsts, ends = self.spans(np.array([key_hash(key, occurrence)], np.uint64))
        return None if places[0] < 0 else (int(firsts[0]), int(ends[0]))


def _store(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder)


def write_shards(documents: DataFrame, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text", folder: str | None = None) -> tuple[str, DataFrame]:
    """Encode and write all texts in ascending key order; the folder and its manifest (one row per shard)."""
    spark = documents.sparkSession
    folder = folder or shared_folder(spark, "ids")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, name = TaskContext.get().partitionId(), f"shard-{uuid.uuid4().hex}"
        encode, (store, path), sink = encoder(tokenizer, end_id), _store(folder), None
        keys, counts, width = [], [], 0
        for batch in batches:
            if sink is None:
                width = encode.kind.itemsize
                store.create_dir(path, recursive=True)
                sink = store.open_output_stream(f"{path}/{name}.ids")
            for number, body in zip(batch.column(0).to_pylist(), byte_texts(batch.column(1)), strict=True):
                ids = encode.of(body)
                sink.write(ids)
                keys.append(number)
                counts.append(len(ids) // width)
        if sink is None:
            return
        sink.close()
        ends = np.cumsum(counts, dtype=np.int64)
        with store.open_output_stream(f"{path}/{name}.idx") as out:
            out.write(Index(keys, ends, width).to_bytes())
        yield pa.RecordBatch.from_pylist(
            [{"shard": shard, "name": name, "width": width, "n_docs": len(keys), "n_tokens": int(ends[-1]) if keys else 0}],
            pa.schema([("shard", pa.int64()), ("name", pa.string()), ("width", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]),
        )

    rows = documents.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    ordered = rows.repartitionByRange(F.col("key").asc_nulls_first(), F.crc32(F.col("text").cast("binary"))).sortWithinPartitions(F.col("key").asc_nulls_first())
    ordered.mapInArrow(write, _MANIFEST).write.parquet(f"{folder}/manifest")
    return folder, spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest")


def read_shards(folder: str, manifest: DataFrame) -> DataFrame:
    """Every document of the written files: key, ids before it, number of ids, checksum of its ids.

    Each key is looked up through the perfect hash, and its ids are read where its slot says; the stored order
    only checks that no slot leads to another document. Neighbours in the payload are read in one piece.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _store(folder)
        for batch in batches:
            for shard in batch.to_pylist():
                with store.open_input_file(f"{path}/{shard['name']}.idx") as f:
                    index = Index.from_bytes(f.read())
                hashes, kind = key_hashes(index.keys), f"<u{index.width}"
                with store.open_input_file(f"{path}/{shard['name']}.ids") as ids:
                    for low in range(0, len(hashes), 10_000):
                        places, firsts, ends = index.spans(hashes[low : low + 10_000])
                        if not np.array_equal(places, np.arange(low, low + len(places))):
                            raise ValueError("a key's slot leads to another document")
                        rows = []
                        for run in np.split(np.arange(len(places)), np.flatnonzero(np.diff(firsts // PIECE_IDS)) + 1):
                            start = firsts[run[0]]
                            ids.seek(int(start) * index.width)
                            values = np.frombuffer(ids.read(int(ends[run[-1]] - start) * index.width), kind).astype("<u4")
                            for i in run.tolist():
                                own = values[firsts[i] - start : ends[i] - start]
                                rows.append((index.keys[low + i], shard["before"] + int(firsts[i]), len(own), zlib.crc32(own.tobytes())))
                        yield _rows(rows)

    placed = manifest.selectExpr("name", "sum(n_tokens) OVER (ORDER BY shard) - n_tokens AS before", "n_tokens")
    # a number of its own keeps small manifests from being gathered into one task
    return placed.repartition(max(1, manifest.count()), F.col("name")).mapInArrow(read, _READ)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def reader(folder: str, name: str) -> Callable[[int | None], np.ndarray | None]:
    """Keyed access to one shard: a key's ids, or None; reads the index once and then one run a key."""
    store, path = _store(folder)
    with store.open_input_file(f"{path}/{name}.idx") as f:
        index = Index.from_bytes(f.read())

    def get(key: int | None, occurrence: int = 0) -> np.ndarray | None:
        if (span := index.span(key, occurrence)) is None:
            return None
        with store.open_input_file(f"{path}/{name}.ids") as f:
            f.seek(span[0] * index.width)
            return np.frombuffer(f.read((span[1] - span[0]) * index.width), f"<u{index.width}")

    return get
