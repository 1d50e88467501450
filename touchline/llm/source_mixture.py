"""Mixing sources to target weights with exact quotas of blocks.

The rows of a source are ordered by a hash and dealt into blocks of ``BLOCK_ROWS`` rows by rank. An epoch of a
source is a seeded permutation of its blocks; its target is some whole epochs and the first blocks of one more,
whose last block is cut at the word where the target is reached. All draws of a source, in that order, are its
quota. A splitting tree divides the quotas among the output shards: at each node the draws of all sources
together are halved by one multivariate hypergeometric draw, so every shard gets its number of blocks and
a random, exact share of each source. A shard takes the next blocks of each source's permutation, so shards
share no draw. What is taken of a row is the sum over the shards' draws of its block; ``write_shards`` writes
every shard's rows in their local random order.

What travels to the driver is one row per source. Ranks of rows are computed in range parts, ranks and running
sums of blocks in ranges of the permutation with one small row per range, so no task holds a large source, and no
block is larger than the others however many rows are alike.

Defined results: a null or empty text has size 0; null is a source of its own, after all others; rows with
null or repeated ids, and repeated rows, are rows of their own; equal hashes are ordered by id and size; rows alike
in all of these are interchangeable; an empty table gives an empty mix; reruns agree. Internal columns begin
with ``_m_``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.operators.sequences import rank_within
from touchline.session import materialize

#: Rows of a block, and blocks of a range of the permutation (an expected number).
BLOCK_ROWS, RANGE_BLOCKS = 256, 1024

#: Sources whose totals the driver may hold.
MOST_SOURCES = 100_000

_BLANKS = "[ \\t-\\r]+"


def word_list(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), _BLANKS), lambda w: w != "")


def targets(sizes: list[int], weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> list[float]:
    """Words wanted of each source, in order: by weight, at most ``cap`` times its size, the excess shared anew."""
    weight = [float(weights[i % len(weights)]) for i in range(len(sizes))]
    out, left, open_ = [0.0] * len(sizes), share * sum(sizes), set(range(len(sizes)))
    while open_:
        each = left / sum(weight[i] for i in open_)
        above = [i for i in sorted(open_) if each * weight[i] > cap * sizes[i]]
        for i in above:
            out[i] = cap * sizes[i]
            left -= out[i]
        open_ -= set(above)
        if not above:
            for i in open_:
                out[i] = each * weight[i]
            break
    return out


def split_quotas(quotas: list[int], shards: int, seed: int) -> np.ndarray:
    """Quotas of each source in each shard: shards hold equally many draws, at most one apart."""
    out = np.zeros((len(quotas), shards), np.int64)
    total = int(sum(quotas))
    before = [total * p // shards for p in range(shards + 1)]
    todo = [(0, shards, np.array(quotas, np.int64))]
    while todo:
        first, last, held = todo.pop()
        if last - first == 1:
            out[:, first] = held
            continue
        middle = (first + last) // 2
        rng = np.random.default_rng([seed, first, last])
        left = rng.multivariate_hypergeometric(held, before[middle] - before[first], method="marginals")
        todo += [(first, middle, left), (middle, last, held - left)]
    return out


def mixture(documents: DataFrame, keep: list[str], key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, shards: int = 16, seed: int = 17) -> DataFrame:
    """Every row with what the mix takes of it.

    Columns ``keep``, then ``_m_size`` (words), ``_m_source_size``, ``_m_target``, ``_m_full`` (whole copies),
    ``_m_part`` (words of one more copy) and ``_m_draws`` (an array of epoch and output shard).
    """
    spark = documents.sparkSession
    of, block = ["_m_null", "_m_source"], ["_m_null", "_m_source", "_m_block"]
    size = F.size(word_list(F.col(text))).cast("long")
    # written before it is used, so that the number of a row stays the same
    rows = materialize(
        documents.select(
            *keep,
            F.col(key).alias("_m_key"),
            size.alias("_m_size"),
            F.col(source).isNull().alias("_m_null"),
            F.coalesce(F.col(source).cast("string"), F.lit("")).alias("_m_source"),
            F.xxhash64(F.col(key), size, F.col(text), F.lit(seed)).alias("_m_turn"),
            F.monotonically_increasing_id().alias("_m_row"),
        )
    )
    plain = rows.select("_m_key", "_m_size", *of, "_m_turn", "_m_row")
    totals = plain.groupBy(*of).agg(F.sum("_m_size").alias("size"), F.count("*").alias("n")).limit(MOST_SOURCES + 1).collect()
    if len(totals) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    totals.sort(key=lambda r: (r["_m_null"], r["_m_source"]))
    wanted = targets([r["size"] for r in totals], weights, share, cap)
    plan = []
    for r, target in zip(totals, wanted, strict=True):
        whole = int(target // r["size"]) if r["size"] else 0
        plan.append((r["_m_null"], r["_m_source"], r["size"], target, whole, round(target - whole * r["size"]), -(-r["n"] // BLOCK_ROWS)))
    # at most MOST_SOURCES rows
    sources = F.broadcast(spark.createDataFrame(plan, "_m_null boolean, _m_source string, _m_source_size long, _m_target double, _m_epochs int, _m_rest long, _m_blocks long"))

    order = [F.col(c) for c in ("_m_turn", "_m_key", "_m_size", "_m_row")]
    ranked = rank_within(plain, of, order, rank="_m_rank").withColumn("_m_block", F.expr(f"(_m_rank - 1) div {BLOCK_ROWS}"))
    dealt = materialize(ranked.select("_m_row", "_m_size", *block, "_m_rank"))
    blocks = dealt.groupBy(*block).agg(F.sum("_m_size").alias("words"), F.count("*").alias("n"))
    draws = (
        blocks.join(sources, of)
        .withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("_m_epochs"))))
        .withColumn("turn", F.pmod(F.xxhash64("_m_block", "_m_source", "_m_null", "epoch", F.lit(seed)), F.lit(1 << 62)))
        .withColumn("range", F.floor(F.col("turn") / F.lit(float(1 << 62)) * F.ceil(F.col("_m_blocks") / F.lit(RANGE_BLOCKS))))
    )
    draws = materialize(draws)
    ranges = draws.groupBy(*of, "epoch", "range").agg(F.sum("words").alias("w"), F.count("*").alias("c")).selectExpr(
        *of, "epoch", "range",
        "sum(w) OVER (PARTITION BY _m_null, _m_source, epoch ORDER BY range) - w AS words_before",
        "sum(c) OVER (PARTITION BY _m_null, _m_source, epoch ORDER BY range) - c AS blocks_before",
    )
    ordered = draws.join(ranges, [*of, "epoch", "range"]).selectExpr(
        *block, "words", "epoch", "_m_epochs", "_m_rest", "_m_blocks",
        "words_before + sum(words) OVER (PARTITION BY _m_null, _m_source, epoch, range ORDER BY turn, _m_block ROWS UNBOUNDED PRECEDING) - words AS at",
        "blocks_before + row_number() OVER (PARTITION BY _m_null, _m_source, epoch, range ORDER BY turn, _m_block) - 1 AS place",
    )
    taken = materialize(
        ordered.withColumn("part", F.when(F.col("epoch") == F.col("_m_epochs"), F.greatest(F.lit(0), F.least(F.col("words"), F.col("_m_rest") - F.col("at")))))
        .where(F.col("part").isNull() | (F.col("part") > 0))
    )
    quotas = {(r[0], r[1]): r[2] for r in taken.groupBy(*of).count().collect()}
    shares = split_quotas([quotas.get((r["_m_null"], r["_m_source"]), 0) for r in totals], shards, seed)
    cuts = F.broadcast(spark.createDataFrame(
        [(r["_m_null"], r["_m_source"], np.cumsum(own).tolist()) for r, own in zip(totals, shares, strict=True)], "_m_null boolean, _m_source string, cuts array<long>"
    ))
    numbered = taken.join(cuts, of).withColumn("rank", F.col("epoch") * F.col("_m_blocks") + F.col("place"))
    by_block = numbered.groupBy(*block).agg(
        F.count(F.when(F.col("part").isNull(), 1)).cast("int").alias("_m_full"),
        F.coalesce(F.sum("part"), F.lit(0)).alias("_m_limit"),
        F.sort_array(F.collect_list(F.struct("epoch", F.size(F.filter("cuts", lambda c: c <= F.col("rank"))).alias("shard")))).alias("_m_draws"),
    )
    inside = dealt.selectExpr(
        "_m_row", *block, "_m_size AS _size",
        "sum(_m_size) OVER (PARTITION BY _m_null, _m_source, _m_block ORDER BY _m_rank ROWS UNBOUNDED PRECEDING) - _m_size AS _before",
    )
    drawn = inside.join(by_block, block, "left").join(sources, of).select(
        "_m_row",
        "_m_source_size",
        "_m_target",
        F.coalesce("_m_full", F.lit(0)).alias("_m_full"),
        F.greatest(F.lit(0), F.least(F.col("_size"), F.coalesce(F.col("_m_limit"), F.lit(0)) - F.col("_before"))).alias("_m_part"),
        F.coalesce("_m_draws", F.array().cast("array<struct<epoch:int,shard:int>>")).alias("_m_draws"),
    )
    return rows.join(drawn, "_m_row").select(*keep, "_m_size", "_m_source_size", "_m_target", "_m_full", "_m_part", "_m_draws")


def _words_of(draw: Column) -> Column:
    """Words of a row in one draw of its block: all of them, or those before the target's end."""
    return F.when(draw["epoch"] < F.col("_m_full"), F.col("_m_size")).otherwise(F.col("_m_part"))


def taken_words() -> Column:
    """Words the mix takes of a row of ``mixture``, repeats counted: the sum over the shards' draws."""
    return F.aggregate("_m_draws", F.lit(0).cast("long"), lambda total, draw: total + _words_of(draw))


def mixed_rows(mixed: DataFrame, keep: list[str], text: str = "text", seed: int = 17) -> DataFrame:
    """The mix itself: the kept columns once for every copy taken, with ``_m_shard`` and ``_m_order``.

    The row at the target's end has its first words only, joined by one blank. Sorting each shard by
    ``_m_order`` is the local shuffle.
    """
    draws = mixed.withColumn("_m_draw", F.explode("_m_draws"))
    drawn = draws.withColumn("_m_words", _words_of(F.col("_m_draw"))).where(F.col("_m_words") > 0)
    cut = F.when(F.col("_m_words") < F.col("_m_size"), F.array_join(F.slice(word_list(F.col(text)), 1, F.col("_m_words").cast("int")), " ")).otherwise(F.col(text))
    order = F.xxhash64(F.lit(seed + 2), "_m_draw.shard", "_m_draw.epoch", F.crc32(F.col(text).cast("binary")), "_m_size")
    return drawn.select(*[cut.alias(c) if c == text else F.col(c) for c in keep], F.col("_m_draw.shard").alias("_m_shard"), order.alias("_m_order"))


def write_shards(drawn: DataFrame, folder: str) -> None:
    """Write rows of ``mixed_rows`` as Parquet, a folder ``shard=N`` each, every file in the shard's random order.

    Rows are range partitioned by shard and order, so a shard is spread over as many files as its rows fill.
    """
    placed = drawn.withColumnRenamed("_m_shard", "shard").repartitionByRange("shard", "_m_order")
    placed.sortWithinPartitions("shard", "_m_order").write.partitionBy("shard").parquet(folder)
