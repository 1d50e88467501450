"""Spelling variants by permuterm rotations.

A word with a terminator is written in all its rotations. An edit at one place leaves the rotation that
begins behind that place unchanged up to its end: words that differ in one replaced character share a
rotation without its last character, and a word that lacks one character is, as a rotation, the whole of that
prefix. So every word gives

* for each of its characters the rotation behind it without the character (``skip``), and
* for each gap between characters its whole rotation there (``whole``).

Sorting all of these brings the words of one prefix together. Such a group holds words that differ
in one character at one place, so it has at most as many members as the alphabet has characters and one
more. A scan gives each member its number of neighbours in the group and the best of them; pairs are never
written. Where a letter is doubled, dropping either of the two gives one word; only the first counts.

Words are numbered in code-point order, and rotations carry the number. Prefixes of more than ``LONG``
characters are replaced by a 127-bit polynomial hash, made for each place from its neighbour's, so a run of
a million letters costs a million short rows and not their square.

Defined results: a null text has no words; a null id counts as empty in the hash that damages words; rows with
equal ids are rows of their own; ties go to the smallest word in code-point order; an empty table gives no
rows; further columns are ignored.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.text import byte_texts
from touchline.session import materialize

#: Characters of a prefix that is kept as it is; longer ones are hashed.
LONG = 64
#: Distinct words, and their characters, that a task counts before it passes them on.
_WORDS, _CHARACTERS = 200_000, 20_000_000

_MODULUS, _BASE, _MARK = (1 << 127) - 1, 0x5851F42D4C957F2D14057B7EF767814F, ord("$")


def lettered_words(documents: DataFrame, damage: int, letters: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): maximal runs of Latin letters of at least ``letters`` characters, A-Z lower-cased.

    Let h be the crc32 of ``<id>:<run>``; where ``damage`` divides h, the character h % length is missing.
    """
    run = re.compile(f"[a-zÀ-ÿ]{{{letters},}}")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        size = 0

        def counted() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for name, body in zip(batch.column(0).to_pylist(), byte_texts(batch.column(1)), strict=True):
                if not body:
                    continue
                start = zlib.crc32(f"{name or ''}:".encode())
                for word, n in Counter(run.findall(body.lower().decode())).items():
                    h = zlib.crc32(word.encode(), start)
                    if h % damage == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < letters:
                            continue
                    held[word] += n
                    size += len(word)
                if len(held) > _WORDS or size > _CHARACTERS:
                    yield counted()
                    size = 0
        if held:
            yield counted()

    rows = documents.select(F.col(key).cast("string").alias("id"), F.col(text).alias("text")).mapInArrow(count, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n"))


def numbered(words: DataFrame) -> DataFrame:
    """``words`` (word, n), a written table, with ``id``, which grows in code-point order."""
    placed = words.select("word", "n").repartitionByRange("word").sortWithinPartitions("word")
    return materialize(placed.withColumn("id", F.monotonically_increasing_id()))


def _short(words: DataFrame) -> DataFrame:
    """(prefix, whole, first, n, id) of the rotations with prefixes of at most ``LONG`` characters and the terminator."""
    size = F.length("word")
    behind = lambda i: F.substring("word", i + 1, size)
    before = lambda i: F.substring("word", F.lit(1), i)
    whole = F.transform(
        F.sequence(F.lit(0), size), lambda i: F.struct(F.concat(behind(i), F.lit("$"), before(i)).alias("prefix"), F.lit(True).alias("whole"), F.lit(True).alias("first"))
    )
    new = lambda i: (i == 0) | (F.substring("word", i, F.lit(1)) != F.substring("word", i + 1, F.lit(1)))
    skip = F.transform(
        F.sequence(F.lit(0), size - 1), lambda i: F.struct(F.concat(behind(i + 1), F.lit("$"), before(i)).alias("prefix"), F.lit(False).alias("whole"), new(i).alias("first"))
    )
    made = lambda rows, x: rows.select("n", "id", F.explode(x).alias("r")).select("r.prefix", "r.whole", "r.first", "n", "id")
    return made(words.where(size <= LONG), F.concat(whole, skip)).union(made(words.where(size == LONG + 1), skip))


def hashed_prefixes(word: str) -> Iterator[tuple[str, bool, bool]]:
    """(prefix, whole, first) of the rotations of a long word with prefixes above ``LONG`` characters."""
    n = len(word)
    # head is the hash of word[:i], power its weight in front of it; tail that of word[i:], left the weight of its first character
    head, power, tail = 0, 1, 0
    for c in word:
        tail = (tail * _BASE + ord(c)) % _MODULUS
    left, back = pow(_BASE, n - 1, _MODULUS), pow(_BASE, -1, _MODULUS)
    for i in range(n + 1):
        yield f"\x00{n:x}:{((tail * _BASE + _MARK) * power + head) % _MODULUS:x}", True, True
        if i == n:
            return
        c = ord(word[i])
        tail = (tail - c * left) % _MODULUS
        if n - 1 > LONG:
            yield f"\x00{n - 1:x}:{((tail * _BASE + _MARK) * power + head) % _MODULUS:x}", False, i == 0 or word[i] != word[i - 1]
        left = left * back % _MODULUS
        head, power = (head + c * power) % _MODULUS, power * _BASE % _MODULUS


def _long(words: DataFrame) -> DataFrame:
    """The rotations of words of more than ``LONG`` characters, with hashed prefixes."""

    def rotate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64())
        for batch in batches:
            made = ((*prefix, n, number) for word, n, number in zip(*(c.to_pylist() for c in batch.columns), strict=True) for prefix in hashed_prefixes(word))
            while rows := list(itertools.islice(made, 20_000)):
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["prefix", "whole", "first", "n", "id"])

    return words.where(F.length("word") > LONG).select("word", "n", "id").mapInArrow(rotate, "prefix string, whole boolean, first boolean, n long, id long")


def scanned(group: np.ndarray, whole: np.ndarray, first: np.ndarray, n: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbours of every member in its group, and n and id of the most frequent (n is -1 where there is none).

    The words of a group that skip a character are near each other; the whole word, of which a group has one at
    most, is near those whose skipped character is the first of its run.
    """
    groups = int(group[-1]) + 1

    def top(rows: np.ndarray, place: int) -> tuple[np.ndarray, np.ndarray]:
        rows = rows[np.lexsort((number[rows], -n[rows], group[rows]))]
        start = np.searchsorted(group[rows], np.arange(groups)) + place
        there = np.minimum(start, max(len(rows) - 1, 0))
        best_n, best = np.full(groups, -1), np.full(groups, -1)
        if len(rows):
            has = (start < len(rows)) & (group[rows][there] == np.arange(groups))
            best_n[has], best[has] = n[rows][there[has]], number[rows][there[has]]
        return best_n, best

    skips, firsts, wholes = np.flatnonzero(~whole), np.flatnonzero(~whole & first), np.flatnonzero(whole)
    (one_n, one), (two_n, two), (first_n, first_id), (whole_n, whole_id) = top(skips, 0), top(skips, 1), top(firsts, 0), top(wholes, 0)
    others = np.bincount(group[skips], minlength=groups)[group] - 1
    own = one[group] == number
    best_n, best = np.where(own, two_n[group], one_n[group]), np.where(own, two[group], one[group])
    meets = first & (whole_n[group] >= 0)
    better = meets & ((whole_n[group] > best_n) | ((whole_n[group] == best_n) & (whole_id[group] < best)))
    near = np.where(whole, np.bincount(group[firsts], minlength=groups)[group], others + meets)
    best_n = np.where(whole, first_n[group], np.where(better, whole_n[group], best_n))
    return near, best_n, np.where(whole, first_id[group], np.where(better, whole_id[group], best))


def neighbours(words: DataFrame) -> DataFrame:
    """(id, n_near, best) of every numbered word that has a near word; best is (-n, id) of the most frequent one."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in itertools.chain(batches, [None]):
            if batch is not None and not batch.num_rows:
                continue
            parts = [held] if held is not None else []
            rows = pa.concat_tables([*parts, pa.Table.from_batches([batch])] if batch is not None else parts).combine_chunks() if parts or batch is not None else None
            if rows is None:
                return
            prefix = rows.column("prefix").combine_chunks()
            prefix = prefix.chunk(0) if isinstance(prefix, pa.ChunkedArray) else prefix
            changes = np.concatenate([[True], pc.not_equal(prefix[1:], prefix[:-1]).to_numpy(zero_copy_only=False)])
            if batch is not None:  # the last group may go on in the next batch
                last = int(np.flatnonzero(changes)[-1])
                rows, held, changes = rows.slice(0, last), rows.slice(last), changes[:last]
            starts = np.flatnonzero(changes)
            sizes = np.diff(np.append(starts, len(changes)))
            rows = rows.filter(pa.array(np.repeat(sizes > 1, sizes)))
            if not rows.num_rows:
                continue
            several = sizes[sizes > 1]
            whole, first, n, number = (rows.column(c).to_numpy() for c in ("whole", "first", "n", "id"))
            near, best_n, best = scanned(np.repeat(np.arange(len(several)), several), whole, first, n, number)
            some = near > 0
            yield pa.RecordBatch.from_arrays([pa.array(number[some]), pa.array(near[some]), pa.array(-best_n[some]), pa.array(best[some])], names=["id", "near", "less", "best"])

    rotations = _short(words).union(_long(words)).repartition("prefix").sortWithinPartitions("prefix")
    near = rotations.mapInArrow(scan, "id long, near long, less long, best long")
    return near.groupBy("id").agg(F.sum("near").alias("n_near"), F.min(F.struct("less", F.col("best").alias("id"))).alias("best"))


def _last(links: DataFrame) -> DataFrame:
    """(id, root): the end of the chain of forms of every id of ``links`` (id, to), a written table.

    Pointers are doubled each round. A form is ``ratio`` times as frequent as its word, so chains are short.
    """
    pointers, ends = links.select("id", "to"), None
    while True:
        onward = links.select(F.col("id").alias("to"), F.col("to").alias("next")) if ends is None else ends.select(F.col("id").alias("to"), F.col("to").alias("next"))
        moved = materialize(pointers.join(onward, "to", "left").select("id", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("open")))
        if moved.where("open").isEmpty():
            return moved.select("id", F.col("to").alias("root"))
        pointers = ends = moved.select("id", "to")


def variants(words: DataFrame, ratio: int = 10) -> DataFrame:
    """``words`` (word, n) with n_near, form (its most frequent near word, if that is ``ratio`` times as frequent),
    form_n and root, where following forms ends."""
    known = numbered(words)
    near = materialize(neighbours(known))
    usual = near.join(known.select("id", "n"), "id").where(-F.col("best.less") >= F.col("n") * ratio)
    links = materialize(usual.select("id", F.col("best.id").alias("to"), (-F.col("best.less")).alias("form_n")))
    named = lambda c: known.select(F.col("id").alias(c), F.col("word").alias(f"{c}_word"))
    ends = links.join(_last(links), "id").join(named("to"), "to").join(named("root"), "root").select("id", "form_n", F.col("to_word").alias("form"), F.col("root_word").alias("root"))
    return known.join(near.select("id", "n_near"), "id", "left").join(ends, "id", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form", "form_n", F.coalesce("root", "word").alias("root")
    )
