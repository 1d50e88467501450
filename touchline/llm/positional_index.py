"""Benchmark decontamination with a positional inverted index of the training tokens.

The index is cut by documents: a segment is a run of whole documents of about ``SEGMENT_WORDS`` words
with, for each term, the sorted places where it stands. Places count through the whole segment with a
gap after each document, so one subtraction turns a term's list into possible starts of a phrase. A
phrase is found by taking the list of its rarest term (by counts over the whole corpus), shifting it to
the phrase's start and intersecting it with the shifted lists of the other terms, rarest first.

Test phrases are a query set against all segments: they are taken in chunks of a bounded number, each
of which may travel to every task. Segments are independent, so nothing is shuffled but what was found.

Defined results: null or empty texts have no words and never match; repeated documents are judged one by
one, also with equal or null ids; repeated items count once by id; tables may be empty and may have more
columns, which are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.llm.text import WordHashes, byte_texts, flat_lists, mixed, signed
from touchline.session import shared_folder

#: Words after which a segment is closed, and phrases that travel to the tasks at once.
SEGMENT_WORDS = 250_000
CHUNK_PHRASES = 20_000

#: ASCII that is neither letter nor digit separates words; A-Z counts as a-z.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

_SEGMENT = "segment long, ids array<long>, firsts array<int>, lengths array<int>, terms array<long>, counts array<int>, places binary"
_PHRASE = "item string, phrase long, terms array<long>"
_FOUND = "segment long, row int, start int, length int, phrase long"


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-cased words of a whole text: letters, digits and everything beyond ASCII."""
    return text.translate(_FOLD).split() if text else []


def _segment(number: int, ids: list, hashes: list[np.ndarray], gap: int) -> pa.RecordBatch:
    lengths = np.array([len(h) for h in hashes], np.int32)
    firsts = np.zeros(len(lengths), np.int32)
    np.cumsum(lengths[:-1] + gap, out=firsts[1:])
    every = np.concatenate(hashes)
    places = np.arange(len(every), dtype=np.int32) + np.repeat(np.arange(len(lengths), dtype=np.int32) * gap, lengths)
    order = np.argsort(every, kind="stable")
    terms, counts = np.unique(every[order], return_counts=True)
    one = lambda values, kind: flat_lists(values, [len(values)], kind)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([number], pa.int64()),
            pa.array([ids], pa.list_(pa.int64())),
            one(firsts, pa.int32()),
            one(lengths, pa.int32()),
            one(signed(terms), pa.int64()),
            one(counts.astype(np.int32), pa.int32()),
            pa.array([places[order].tobytes()], pa.binary()),
        ],
        names=["segment", "ids", "firsts", "lengths", "terms", "counts", "places"],
    )


def build_index(documents: DataFrame, key: str = "doc_id", text: str = "text", gap: int = 64) -> DataFrame:
    """Postings of every word of every document, written to the shared folder and read back.

    ``gap`` must be at least the longest phrase, with its slop.
    """

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, table = TaskContext.get().partitionId() << 32, WordHashes()
        ids, hashes, held = [], [], 0
        for batch in batches:
            for name, body in zip(batch.column(0).to_pylist(), byte_texts(batch.column(1)), strict=True):
                hashes.append(table.of(words_of(body)))
                ids.append(name)
                held += len(hashes[-1]) + 1
                if held >= SEGMENT_WORDS:
                    yield _segment(number, ids, hashes, gap)
                    number, ids, hashes, held = number + 1, [], [], 0
        if ids:
            yield _segment(number, ids, hashes, gap)

    spark, folder = documents.sparkSession, shared_folder(documents.sparkSession, "index")
    rows = documents.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    rows.mapInArrow(segments, _SEGMENT).write.option("parquet.block.size", 8 << 20).option("compression", "zstd").parquet(folder)
    return spark.read.schema(_SEGMENT).parquet(folder)


def phrases_of(items: DataFrame, window: int, key: str = "item_id", text: str = "text") -> DataFrame:
    """Every window of ``window`` consecutive words of every item; an item of fewer words is one window."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordHashes()
        for batch in batches:
            names, keys, terms = [], [], []
            for name, body in zip(batch.column(0).to_pylist(), byte_texts(batch.column(1)), strict=True):
                hashes = table.of(words_of(body))
                for i in range(max(min(len(hashes), 1), len(hashes) - window + 1)):
                    part = hashes[i : i + window]
                    value = np.array([len(part)], np.uint64)
                    for h in part:
                        value = mixed(value ^ h)
                    names.append(name)
                    keys.append(int(signed(value)[0]))
                    terms.append(signed(part))
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array(keys, pa.int64()), flat_lists(np.concatenate(terms) if terms else np.zeros(0, np.int64), [len(t) for t in terms], pa.int64())],
                names=["item", "phrase", "terms"],
            )

    return items.select(F.col(key).cast("string").alias("item"), F.col(text).alias("text")).mapInArrow(cut, _PHRASE)


def _starts(terms: np.ndarray, order: np.ndarray, postings: Callable[[int], np.ndarray | None], slop: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last places of a phrase's occurrences; ``order`` names its terms from the rarest on."""
    lists = {}
    for i in order:
        if (places := postings(int(terms[i]))) is None:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        lists[int(i)] = places
    rare = int(order[0])
    if not slop:
        start = lists[rare] - rare
        for i in order[1:]:
            places, want = lists[int(i)], start + int(i)
            at = np.minimum(np.searchsorted(places, want), len(places) - 1)
            start = start[places[at] == want]
            if not len(start):
                break
        return start, start + len(terms) - 1
    first = last = lists[rare].astype(np.int64)
    for i in range(rare + 1, len(terms)):  # the nearest place after the one before
        at = np.searchsorted(lists[i], last, side="right")
        inside = at < len(lists[i])
        first, last = first[inside], lists[i][at[inside]]
    for i in range(rare - 1, -1, -1):  # the nearest place before the one after
        at = np.searchsorted(lists[i], first) - 1
        inside = at >= 0
        last, first = last[inside], lists[i][at[inside]]
    near = last - first < len(terms) + slop
    return first[near], last[near]


def find_phrases(index: DataFrame, phrases: DataFrame, slop: int = 0) -> DataFrame:
    """Every occurrence of every phrase: segment, document's row in it, first word, words, phrase.

    With ``slop`` the terms stand in order with at most that many other words among them: of the
    occurrences around one place of the rarest term, the tightest. ``phrases`` has ``phrase`` and ``terms``.
    """
    spark = index.sparkSession
    folder = shared_folder(spark, "phrases")
    phrases.select("phrase", "terms").dropDuplicates(["phrase"]).write.parquet(folder)
    phrases = spark.read.parquet(folder)
    chunks = max(1, -(-phrases.count() // CHUNK_PHRASES))
    used = phrases.select(F.explode("terms").alias("term")).distinct()
    corpus = index.select(F.explode(F.arrays_zip("terms", "counts")).alias("x")).select(F.col("x.terms").alias("term"), F.col("x.counts").alias("n"))
    counts = shared_folder(spark, "counts")
    corpus.groupBy("term").agg(F.sum("n").alias("n")).join(used, "term").write.parquet(counts)
    found = spark.createDataFrame([], _FOUND)
    for chunk in range(chunks):
        part = phrases.where(F.pmod("phrase", F.lit(chunks)) == chunk)
        collected = part.collect()
        # at most one entry per distinct term of the chunk
        rank = dict(part.select(F.explode("terms").alias("term")).distinct().join(spark.read.parquet(counts), "term").collect())
        plan = []
        for name, terms in collected:
            if all(t in rank for t in terms):
                plan.append((name, np.array(terms, np.int64), np.argsort([rank[t] for t in terms], kind="stable")))
        plan_of = spark.sparkContext.broadcast(plan)

        def search(batches: Iterator[pa.RecordBatch], plan_of=plan_of) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in range(batch.num_rows):
                    segment = batch.column("segment")[r].as_py()
                    firsts, terms, counts = (batch.column(c)[r].values.to_numpy() for c in ("firsts", "terms", "counts"))
                    places = np.frombuffer(batch.column("places")[r].as_py(), np.int32)
                    ends = np.cumsum(counts)
                    at_of = dict(zip(terms.tolist(), range(len(terms)), strict=True))

                    def postings(term: int, at_of=at_of, ends=ends, counts=counts, places=places) -> np.ndarray | None:
                        at = at_of.get(term)
                        return None if at is None else places[ends[at] - counts[at] : ends[at]]

                    rows, starts, lengths, names = [], [], [], []
                    for name, wanted, order in plan_of.value:
                        if int(wanted[order[0]]) not in at_of:
                            continue
                        first, last = _starts(wanted, order, postings, slop)
                        if len(first):
                            row = np.searchsorted(firsts, first, side="right") - 1
                            same = row == np.searchsorted(firsts, last, side="right") - 1
                            rows.append(row[same])
                            starts.append((first - firsts[row])[same])
                            lengths.append((last - first + 1)[same])
                            names.append(np.full(int(same.sum()), name, np.int64))
                    if rows:
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(np.full(sum(map(len, rows)), segment, np.int64)),
                                *(pa.array(np.concatenate(x).astype(np.int32)) for x in (rows, starts, lengths)),
                                pa.array(np.concatenate(names)),
                            ],
                            names=["segment", "row", "start", "length", "phrase"],
                        )

        found = found.union(index.select("segment", "firsts", "terms", "counts", "places").mapInArrow(search, _FOUND))
    return found


def document_rows(index: DataFrame) -> DataFrame:
    """One row per indexed document: segment, row, id, n_words."""
    return index.select("segment", F.posexplode(F.arrays_zip("ids", "lengths")).alias("row", "x")).select(
        "segment", "row", F.col("x.ids").alias("id"), F.col("x.lengths").cast("long").alias("n_words")
    )


def contamination(documents: DataFrame, items: DataFrame, window: int = 13, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """Words of every document that lie inside an occurrence of an item's window, and the items found.

    Returns id, n_words, n_hit, items (array of item ids as strings, sorted).
    """
    spark = documents.sparkSession
    index = build_index(documents, key, text, gap=max(64, window))
    folder = shared_folder(spark, "windows")
    phrases_of(items, window, item_key, item_text).write.parquet(folder)
    phrases = spark.read.schema(_PHRASE).parquet(folder)
    found_folder = shared_folder(spark, "found")
    find_phrases(index, phrases).write.parquet(found_folder)
    found = spark.read.schema(_FOUND).parquet(found_folder)
    hit = (
        found.groupBy("segment", "row")
        .agg(F.collect_set(F.struct("start", "length")).alias("spans"))
        .select("segment", "row", F.size(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s.start, s.start + s.length - 1))))).cast("long").alias("n_hit"))
    )
    named = (
        found.select("segment", "row", "phrase").distinct().join(phrases.select("phrase", "item").distinct(), "phrase")
        .groupBy("segment", "row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    )
    rows = document_rows(index)
    return rows.join(hit.join(named, ["segment", "row"], "left"), ["segment", "row"], "left").select(
        "id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items")
    )


def contaminated(n_hit: Column, n_words: Column) -> Column:
    """At least one word and a twentieth of the words lie in test passages."""
    return (n_hit > 0) & (20 * n_hit >= n_words)
