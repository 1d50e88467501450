"""Ordered look-back and look-ahead that does not put a whole sequence into one task.

A window over ``(replay)`` would sort one match in one task, and one match may hold a large part of
all rows. Sequences are therefore cut by rank: rows are range partitioned by key and order, so parts hold about
as many rows each, however dense or spread the order's values are. Inside a part an ordinary
window does the work; what has to cross a border is one row per key and part, found by a partial
aggregate and passed on by a window over the (few) parts of a key.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.session import materialize

#: Width of a chunk of ids that Spark numbered itself: they are dense within each task's rows.
ID_SPAN = 1 << 18


def cut(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], parts: int | None = None) -> DataFrame:
    """``df`` in range parts of keys and order, with the part's number as ``_chunk``.

    Without ``parts`` the session's number of shuffle partitions holds, and small parts are put together. Numbers
    depend on sampled bounds, so the rows are written before anything uses them twice.
    """
    by = [*[F.col(k) for k in keys], *order]
    placed = df.repartitionByRange(parts, *by) if parts else df.repartitionByRange(*by)
    return materialize(placed.withColumn("_chunk", F.spark_partition_id()))


def _chunked(df: DataFrame, keys: Sequence[str], order: str, parts: int | None) -> DataFrame:
    """A frame that carries ``_chunk`` is in parts already and keeps them between passes."""
    return df if "_chunk" in df.columns else cut(df, keys, [order], parts)


def look_around(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    *,
    before: Mapping[str, Column] | None = None,
    after: Mapping[str, Column] | None = None,
    parts: int | None = None,
) -> DataFrame:
    """Add the nearest non-null value strictly before and strictly after each row.

    Every value must be a struct whose first field is ``order`` (or null where a row contributes
    nothing), so that "nearest" is a plain maximum or minimum. ``order`` must be unique per key.
    """
    before, after = dict(before or {}), dict(after or {})
    keys = list(keys)
    rows = _chunked(df, keys, order, parts)
    borders = rows.groupBy(*keys, "_chunk").agg(
        *[F.max(value).alias(f"_edge_{name}") for name, value in before.items()],
        *[F.min(value).alias(f"_edge_{name}") for name, value in after.items()],
    )
    across_up = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    across_down = Window.partitionBy(*keys).orderBy(F.desc("_chunk")).rowsBetween(Window.unboundedPreceding, -1)
    borders = borders.select(
        *keys,
        "_chunk",
        *[F.max(f"_edge_{name}").over(across_up).alias(f"_carry_{name}") for name in before],
        *[F.min(f"_edge_{name}").over(across_down).alias(f"_carry_{name}") for name in after],
    )
    inside_up = Window.partitionBy(*keys, "_chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    inside_down = Window.partitionBy(*keys, "_chunk").orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, -1)
    near = rows.select(
        "*",
        *[F.last(value, ignorenulls=True).over(inside_up).alias(f"_near_{name}") for name, value in before.items()],
        *[F.last(value, ignorenulls=True).over(inside_down).alias(f"_near_{name}") for name, value in after.items()],
    )
    joined = near.join(borders, [*keys, "_chunk"], "left")
    return joined.select(
        *df.columns,
        *[F.coalesce(f"_near_{name}", f"_carry_{name}").alias(name) for name in [*before, *after]],
    )


def running_total(
    df: DataFrame, keys: Sequence[str], order: str, value: Column, name: str, *, span: int = ID_SPAN
) -> DataFrame:
    """Running sum of ``value`` up to and including each row, in chunks of ids that Spark numbered itself.

    Such ids need no parts by rank: a key has a chunk per ``span`` rows and one per task that numbered them.
    For any other order there is :func:`running_sum`.
    """
    keys = list(keys)
    rows = df.withColumn("_chunk", F.expr(f"`{order}` div {int(span)}"))
    across = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy(*keys, "_chunk")
        .agg(F.sum(value).alias("_part"))
        .select(*keys, "_chunk", F.coalesce(F.sum("_part").over(across), F.lit(0)).alias("_offset"))
    )
    inside = Window.partitionBy(*keys, "_chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumn("_local", F.sum(value).over(inside))
    return local.join(offsets, [*keys, "_chunk"]).select(
        *df.columns, (F.col("_local") + F.col("_offset")).alias(name)
    )


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[Column], weight: Column, total: str, size: str | None = None) -> DataFrame:
    """Sum of ``weight`` up to and including each row per key, and over the whole key; ``order`` must be total.

    The rows are range partitioned by key and order, which splits a large key over many tasks, summed inside
    each part and shifted by the sums of the parts before it. What a key adds across parts is one row a part.
    """
    keys, columns = list(keys), df.columns
    ordered = cut(df.withColumn("_weight", weight), keys, order).withColumnRenamed("_chunk", "_part")
    by_key = Window.partitionBy(*keys)
    across = by_key.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = (
        ordered.groupBy(*keys, "_part")
        .agg(F.sum("_weight").alias("_sum"))
        .select(*keys, "_part", F.coalesce(F.sum("_sum").over(across), F.lit(0)).alias("_offset"), F.sum("_sum").over(by_key).alias("_size"))
    )
    inside = Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = ordered.withColumn("_local", F.sum("_weight").over(inside))
    same = [summed[k].eqNullSafe(parts[k]) for k in keys] + [summed["_part"] == parts["_part"]]
    return summed.join(parts, same).select(
        *[summed[c] for c in columns],
        (F.col("_local") + F.col("_offset")).cast("long").alias(total),
        *([F.col("_size").cast("long").alias(size)] if size else []),
    )


def rank_within(df: DataFrame, keys: Sequence[str], order: Sequence[Column], *, rank: str = "rank", size: str | None = None) -> DataFrame:
    """Row number (from 1) and group size per key; ``order`` must be a total order."""
    return running_sum(df, keys, order, F.lit(1), rank, size)


def column_facts(df: DataFrame, keys: Sequence[str], values: Mapping[str, Column]) -> DataFrame:
    """Mean, count and population deviation of several columns per key, a struct of each, written out."""
    facts = [F.struct(F.avg(v).alias("mean"), F.count(v).alias("n"), F.stddev_pop(v).alias("sd")).alias(f"_{name}") for name, v in values.items()]
    return materialize(df.groupBy(*keys).agg(*facts).coalesce(1))


def exact_medians(
    df: DataFrame,
    keys: Sequence[str],
    values: Sequence[str],
    *,
    accuracy: int = 1_000,
    facts: DataFrame | None = None,
) -> DataFrame:
    """Exact median, row count and population deviation of several columns: (keys, name, median, n, sd).

    No group is ever gathered. A median is at most one deviation from the mean, so ``accuracy`` bins of one
    width over that stretch, and some on each side, are counted first; whatever the bins are, they follow the
    order of the values. Just the values of the bins that hold the middle ranks, a small share, are grouped
    and summed in order. ``facts`` are those of :func:`column_facts`, if they are known: counts must be right,
    while any mean and deviation that enclose the median serve the bins.
    """
    keys = list(keys)
    facts = column_facts(df, keys, {v: F.col(v) for v in values}) if facts is None else facts
    facts = materialize(facts.withColumn("_key", F.monotonically_increasing_id()))

    width = 2 * accuracy + 1

    def bin_of(i: int, v: str) -> Column:
        """Key, column and bin as one number, null for a null: short rows to count and to join."""
        place = F.try_divide(F.col(v) - F.col(f"_{v}")["mean"], F.col(f"_{v}")["sd"]) * (accuracy / 2)
        limited = F.least(F.greatest(F.floor(F.coalesce(place, F.lit(0.0))), F.lit(-accuracy)), F.lit(accuracy))
        return F.when(F.col(v).isNotNull(), (F.col("_key") * len(values) + i) * width + accuracy + limited)

    marked = df.select(*keys, *values).join(F.broadcast(facts), keys)
    bins = marked.select(F.explode(F.array(*[bin_of(i, v) for i, v in enumerate(values)])).alias("_bin"))
    binned = bins.where("_bin IS NOT NULL").groupBy("_bin").agg(F.count(F.lit(1)).alias("count"))
    binned = binned.withColumns({"_key": F.expr(f"_bin div {width * len(values)}"), "_name": F.expr(f"_bin div {width} % {len(values)}")})
    order = Window.partitionBy("_key", "_name").orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    counts = binned.withColumn("_upto", F.sum("count").over(order))
    long = facts.select(
        *keys, "_key",
        F.inline(F.array(*[F.struct(F.lit(i).cast("long").alias("_name"), F.lit(v).alias("name"), F.col(f"_{v}")["n"].alias("n"), F.col(f"_{v}")["sd"].alias("sd")) for i, v in enumerate(values)])),
    )
    lower, upper = F.floor((F.col("n") + 1) / 2), F.floor((F.col("n") + 2) / 2)
    middle = (
        counts.join(F.broadcast(long), ["_key", "_name"])
        .groupBy(*keys, "name")
        .agg(
            F.min(F.when(F.col("_upto") >= lower, F.struct("_bin", (F.col("_upto") - F.col("count")).alias("below")))).alias("_from"),
            F.min(F.when(F.col("_upto") >= upper, F.col("_bin"))).alias("_to"),
            F.first("n").alias("n"),
            F.first("sd").alias("sd"),
        )
    )
    middle = materialize(middle.select(*keys, "name", F.col("_from._bin").alias("low"), "_from.below", F.col("_to").alias("high"), "n", "sd").coalesce(1))
    # Bins between the two are empty, so one or two of a column are asked for.
    asked = middle.select(*keys, "name", F.explode(F.array_distinct(F.array("low", "high"))).alias("_bin"))
    entries = marked.select(F.inline(F.array(*[F.struct(bin_of(i, v).alias("_bin"), F.col(v).cast("double").alias("_v")) for i, v in enumerate(values)])))
    counted = entries.join(F.broadcast(asked), "_bin").groupBy(*keys, "name", "_v").agg(F.count(F.lit(1)).alias("_c"))
    ranks = running_sum(counted, [*keys, "name"], [F.col("_v")], F.col("_c"), "_upto").join(F.broadcast(middle), [*keys, "name"])
    upto = F.col("_upto") + F.col("below")
    return (
        ranks.groupBy(*keys, "name")
        .agg(
            F.min(F.when(upto >= lower, F.col("_v"))).alias("_a"),
            F.min(F.when(upto >= upper, F.col("_v"))).alias("_b"),
            F.first("n").alias("n"),
            F.first("sd").alias("sd"),
        )
        .select(*keys, "name", ((F.col("_a") + F.col("_b")) / 2).alias("median"), "n", "sd")
    )


def recent_values(
    df: DataFrame, keys: Sequence[str], order: str, value: Column, size: int, name: str, *, parts: int | None = None
) -> DataFrame:
    """The last ``size`` values up to and including each row, oldest first, as an array.

    A part passes on its own last values; every part of a key has at least one row, so the ``size - 1`` parts
    before it are enough.
    """
    keys = list(keys)
    before = size - 1
    rows = _chunked(df.withColumn("_value", value), keys, order, parts)
    inside = Window.partitionBy(*keys, "_chunk").orderBy(order)
    newest = Window.partitionBy(*keys, "_chunk").orderBy(F.desc(order))
    tails = (
        rows.withColumn("_n", F.row_number().over(newest))
        .filter(F.col("_n") <= before)
        .groupBy(*keys, "_chunk")
        .agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("_o"), "_value"))).alias("_tail"))
    )
    across = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(-before, -1)
    carried = tails.select(*keys, "_chunk", F.flatten(F.collect_list("_tail").over(across)).alias("_carry"))
    local = rows.withColumn("_local", F.collect_list(F.struct("_value")).over(inside.rowsBetween(-before, 0)))
    joined = local.join(carried, [*keys, "_chunk"], "left")
    old = F.transform(F.coalesce("_carry", F.array().cast(carried.schema["_carry"].dataType)), lambda s: s["_value"])
    both = F.concat(old, F.transform("_local", lambda s: s["_value"]))
    keep = F.least(F.size(both), F.lit(size))
    return joined.select(*df.columns, F.slice(both, F.size(both) - keep + 1, keep).alias(name))
