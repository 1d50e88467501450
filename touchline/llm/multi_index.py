"""Nearest vectors by inner product: learned binary codes, an index per part of the code, exact reranking.

Vectors are scaled into the unit ball by the largest length and lifted onto the sphere by one more
coordinate, so that the largest inner product is the smallest angle. A rotation is learned on a bounded sample
(principal axes, then iterative quantisation: signs and the rotation that fits them best, in turn). The
signs of the rotated vector are its code of ``BITS`` bits.

Blocks of rows, dealt by hash, hold the codes, one index per ``PART`` bits of the code, and the
vectors. A code within a radius of the query's is, in at least one part, within that part's share of the
radius (the shares sum to the radius less the parts but one), so the values within that share are looked up
in every part's index. What is found is compared by its whole code, and the vectors of all codes within the
radius are compared in double precision. Queries, a stated share of the rows, pass through every block in
batches; each block answers with its ``k`` nearest, and the answers are merged.

The radius is learned: ``TRIALS`` rows are answered exactly in one pass over all rows, and the radius is
the smallest within which ``recall`` of their neighbours lie. A query with fewer than ``k`` codes in the radius of a
block looks further there until it has them, so a result is short only where there are no more candidates.

Defined results: vectors that are null or zero, or hold a null or non-finite component, take no part, nor do
vectors of another length than the most common (the shorter of equally common ones); rows equal in id and vector are one;
rows of one id are not each other's candidates, and each of their vectors is a query; a null id is no query and
comes after all others among ties; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.session import materialize

#: Bits of a code and of one part of it, and expected rows of a block.
BITS, PART, BLOCK_ROWS = 64, 8, 16_384
#: Rows and values of the sample that the rotation is learned on, and rows that set the radius.
SAMPLE_ROWS, SAMPLE_VALUES, TRIALS = 16_384, 4_194_304, 256

_PARTS = BITS // PART
_COUNTS = np.array([v.bit_count() for v in range(1 << PART)])
#: Differences of a part by number of bits, and how many there are up to each number.
_NEAR = np.argsort(_COUNTS, kind="stable")
_WITHIN = np.cumsum(np.bincount(_COUNTS))

_NO_ID = (1 << 63) - 1


@dataclass(frozen=True)
class Codes:
    """Rotation of lifted vectors to the axes whose signs are the code."""

    scale: float
    centre: np.ndarray
    rotation: np.ndarray

    def _signs(self, lifted: np.ndarray) -> np.ndarray:
        bits = lifted @ self.rotation > 0
        return np.packbits(bits, axis=1, bitorder="little").view(np.uint64).reshape(-1)

    def of_rows(self, vectors: np.ndarray) -> np.ndarray:
        return self._signs(lift(vectors, self.scale) - self.centre)

    def of_queries(self, vectors: np.ndarray) -> np.ndarray:
        # the centre adds the same to every candidate's product
        return self._signs(np.hstack([vectors, np.zeros((len(vectors), 1))]))


def lift(vectors: np.ndarray, scale: float) -> np.ndarray:
    """Vectors in the unit ball with the coordinate that puts them on the sphere."""
    inside = vectors / scale
    return np.hstack([inside, np.sqrt(np.maximum(0.0, 1.0 - (inside * inside).sum(axis=1, keepdims=True)))])


def learned_codes(sample: np.ndarray, scale: float, rounds: int = 30, seed: int = 5) -> Codes:
    """Codes fitted to a sample. Where vectors have fewer axes than a code has bits, several rotations share them."""
    lifted = lift(sample, scale)
    centre = lifted.mean(axis=0)
    centred = lifted - centre
    axes = np.linalg.eigh(centred.T @ centred)[1][:, ::-1]
    rng, made = np.random.default_rng(seed), []
    while sum(m.shape[1] for m in made) < BITS:
        own = axes[:, : min(BITS, axes.shape[1])]
        placed = centred @ own
        turn = np.linalg.qr(rng.standard_normal((own.shape[1], own.shape[1])))[0]
        for _ in range(rounds):
            u, _, v = np.linalg.svd(np.where(placed @ turn > 0, 1.0, -1.0).T @ placed)
            turn = (u @ v).T
        made.append(own @ turn)
    return Codes(scale, centre, np.hstack(made)[:, :BITS])


def products(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products in double precision, the same for equal vectors wherever they stand."""
    return (vectors * query).sum(axis=1)


def best_first(score: np.ndarray, number: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties to the smaller number."""
    if len(score) > k:
        least = np.partition(score, len(score) - k)[len(score) - k]
        some = np.flatnonzero(score >= least)
        return some[np.lexsort((number[some], -score[some]))][:k]
    return np.lexsort((number, -score))


class Block:
    """Codes, part indexes and vectors of a bounded number of rows."""

    def __init__(self, numbers: np.ndarray, codes: np.ndarray, vectors: np.ndarray) -> None:
        self.numbers, self.codes, self.vectors = numbers, codes, vectors
        # for a first look; single precision errs by less than this, relative to the lengths of both vectors
        self.longest = float(np.sqrt((vectors * vectors).sum(axis=1).max()))
        self.light = (vectors / self.longest).astype(np.float32)
        self.error = (vectors.shape[1] + 4) * float(np.finfo(np.float32).eps)
        parts = codes.view(np.uint8).reshape(-1, _PARTS)
        self.rows = [np.argsort(parts[:, j], kind="stable") for j in range(_PARTS)]
        self.starts = [np.searchsorted(parts[self.rows[j], j], np.arange((1 << PART) + 1)) for j in range(_PARTS)]

    def within(self, code: np.uint64, radius: int) -> np.ndarray:
        """Rows whose code differs from ``code`` in at most ``radius`` bits."""
        found = np.zeros(len(self.codes), bool)
        own = np.array([code], np.uint64).view(np.uint8)
        for j in range(_PARTS):
            # shares that sum to radius - _PARTS + 1: a code beyond all of them differs in more than the radius
            share = (radius + 1 + j) // _PARTS - 1
            if share < 0:
                continue
            values = _NEAR[: _WITHIN[min(share, PART)]] ^ own[j]
            first, size = self.starts[j][values], self.starts[j][values + 1] - self.starts[j][values]
            ends = np.cumsum(size)
            found[self.rows[j][np.repeat(first - ends + size, size) + np.arange(ends[-1])]] = True
        rows = np.flatnonzero(found)
        return rows[np.bitwise_count(self.codes[rows] ^ code) <= radius]

    def nearest(self, number: int, code: np.uint64, vector: np.ndarray, radius: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and scores of the k nearest candidates found."""
        while True:
            rows = self.within(code, radius)
            rows = rows[self.numbers[rows] != number]
            if len(rows) >= k or radius >= BITS:
                break
            radius = min(BITS, radius + _PARTS)
        if len(rows) > k:
            rough = self.light[rows] @ (vector / np.linalg.norm(vector)).astype(np.float32)
            rows = rows[rough >= np.partition(rough, len(rough) - k)[len(rough) - k] - 2 * self.error]
        score = products(self.vectors[rows], vector)
        order = best_first(score, self.numbers[rows], k)
        return self.numbers[rows][order], score[order]


def usable(rows: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, vector) of the vectors that take part, as doubles."""
    plain = rows.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    finite = ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("vector", lambda x: x != 0)
    sound = plain.where(F.col("vector").isNotNull() & F.coalesce(finite, F.lit(False)))
    lengths = sound.groupBy(F.size("vector").alias("length")).agg(F.count("*").alias("c"))
    common = lengths.agg(F.max(F.struct("c", (-F.col("length")).alias("less"))).alias("x")).select((-F.col("x.less")).alias("length"))
    return sound.join(F.broadcast(common), F.size("vector") == F.col("length"), "left_semi")


def _hash() -> Column:
    return F.xxhash64("id", "vector")


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _once(numbers: np.ndarray, codes: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, ...]:
    """Rows without those equal to an earlier one in number and vector."""
    names = list(zip(numbers.tolist(), map(np.ndarray.tobytes, vectors + 0.0), strict=True))
    one = np.fromiter({name: i for i, name in enumerate(names)}.values(), np.int64)
    return numbers[one], codes[one], vectors[one]


@dataclass(frozen=True)
class Index:
    """A written table (block, id, code, vector) and what it was made with."""

    table: DataFrame
    codes: Codes
    blocks: int
    radius: int


def build(rows: DataFrame, k: int = 20, recall: float = 0.95) -> Index | None:
    """Index of all (id, vector) rows of ``usable``, none where there are no rows."""
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
    size = rows.agg(F.count("*").alias("n"), F.max(length).alias("scale"), F.max(F.size("vector")).alias("width")).first()
    if not size["n"]:
        return None
    # at most SAMPLE_ROWS rows, and SAMPLE_VALUES values or TRIALS rows of long vectors, those with the lowest hashes
    bound = min(SAMPLE_ROWS, max(TRIALS, SAMPLE_VALUES // size["width"]))
    picked = rows.orderBy(_hash(), "id").limit(bound).toArrow()
    sample, numbers = _matrix(picked.column("vector").combine_chunks()), picked.column("id").fill_null(_NO_ID).to_numpy()
    codes = learned_codes(sample, size["scale"])
    blocks = -(-size["n"] // BLOCK_ROWS)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = codes.of_rows(_matrix(batch.column("vector"))).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.int64())], names=["block", "id", "vector", "code"])

    dealt = rows.select(F.pmod(_hash(), F.lit(blocks)).alias("block"), "id", "vector")
    table = materialize(dealt.mapInArrow(code, "block long, id long, vector array<double>, code long"))
    return Index(table, codes, blocks, _radius(table, codes, numbers[:TRIALS], sample[:TRIALS], k, recall))


def _radius(table: DataFrame, codes: Codes, numbers: np.ndarray, vectors: np.ndarray, k: int, recall: float) -> int:
    """Smallest radius that holds ``recall`` of the exact neighbours of the given rows."""
    own = codes.of_queries(vectors)

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = [(np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in numbers]
        for batch in batches:
            ids, here, there = batch.column("id").fill_null(_NO_ID).to_numpy(), _matrix(batch.column("vector")), batch.column("code").to_numpy().view(np.uint64)
            score = here @ vectors.T
            for i, number in enumerate(numbers):
                mine = np.where(ids == number, -np.inf, score[:, i])
                rows = best_first(mine, ids, k)
                rows = rows[mine[rows] > -np.inf]
                apart = np.bitwise_count(there[rows] ^ own[i]).astype(np.int64)
                both = [np.concatenate(x) for x in zip(held[i], (mine[rows], ids[rows], apart), strict=True)]
                keep = best_first(both[0], both[1], k)
                held[i] = tuple(x[keep] for x in both)
        for i, (score, ids, apart) in enumerate(held):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), i)), pa.array(ids), pa.array(score), pa.array(apart)], names=["trial", "id", "score", "apart"])

    found = table.select("id", "vector", "code").mapInArrow(exact, "trial long, id long, score double, apart long")
    place = F.row_number().over(Window.partitionBy("trial").orderBy(F.desc("score"), "id"))
    share = found.withColumn("place", place).where(F.col("place") <= k).groupBy("apart").agg(F.count("*").alias("c")).orderBy("apart").collect()  # one row per distance
    counts = np.cumsum([r["c"] for r in share])
    return next((r["apart"] for r, c in zip(share, counts, strict=True) if c >= recall * counts[-1]), 0)


def search(index: Index, queries: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest rows found for every (id, vector) query, nearest first."""
    codes, radius = index.codes, index.radius
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(index.blocks - 1).cast("long")))
    asked = queries.distinct().select(every.alias("block"), F.lit(1).alias("kind"), "id", "vector", F.lit(0).cast("long").alias("code"))
    stream = index.table.select("block", F.lit(0).alias("kind"), "id", "vector", "code").union(asked)
    # the rows of a block come before the queries that are put to it
    stream = stream.repartition("block").sortWithinPartitions("block", "kind")
    names = ["query_id", "query", "id", "score"]

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, block = None, [], None
        for batch in batches:
            blocks, kinds = batch.column("block").to_numpy(), batch.column("kind").to_numpy()
            cuts = [0, *(np.flatnonzero((np.diff(blocks) != 0) | (np.diff(kinds) != 0)) + 1), batch.num_rows]
            for first, last in zip(cuts, cuts[1:], strict=False):
                if first == last:
                    continue
                rows = batch.slice(first, last - first)
                ids, vectors = rows.column("id").fill_null(_NO_ID).to_numpy(), _matrix(rows.column("vector"))
                if blocks[first] != at:
                    at, parts, block = blocks[first], [], None
                if kinds[first] == 0:
                    parts.append((ids, rows.column("code").to_numpy().view(np.uint64), vectors))
                    continue
                if not parts and block is None:
                    continue
                if block is None:
                    block, parts = Block(*_once(*[np.concatenate(x) for x in zip(*parts, strict=True)])), []
                own, out = codes.of_queries(vectors), []
                for i, number in enumerate(ids):
                    found, score = block.nearest(number, own[i], vectors[i], radius, k)
                    out.append((np.full(len(found), number), np.full(len(found), xxhash.xxh3_64_intdigest(vectors[i].tobytes()) >> 1), found, score))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=names)

    found = stream.mapInArrow(answer, "query_id long, query long, id long, score double")
    place = F.row_number().over(Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "id"))
    ranked = found.withColumn("rank", place).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.nullif("id", F.lit(_NO_ID)).alias("vec_id"), "score")


def nearest(rows: DataFrame, queries: Column, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest rows of each of the (id, vector) rows that fit ``queries``."""
    index = build(rows, k)
    if index is None:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return search(index, rows.where(queries), k)
