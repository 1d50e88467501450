"""Near-duplicate documents by MinHash with tensored banding, verified on full shingle sets.

A document has ``collections`` small collections of ``per_collection`` minhashes. Every pair of
collections makes one table, whose key combines both, so the number of tables grows with the square of
the number of collections while minhashes are computed for the collections alone. Two documents are
candidates where they agree in two or more collections.

Links are wanted up to reachability, so candidates are never expanded into all pairs of a bucket:

1. Documents with equal shingle sets are one class; one of them stands for it.
2. Collection values that one class alone has cannot match; only shared ones are combined into keys.
3. In a round, every class is compared with one class that leads a bucket, that which it meets in most
   buckets. Links are contracted. Buckets that lie inside one component are done.
4. What is left after ``LEADER_ROUNDS`` is compared exactly (``_rest``): every two classes of different components that
   meet in a bucket. Classes are put into blocks of bounded size. Of two blocks that meet the heavier is the host, and a task
   gets a host and as many of its guests as fill a block (``_tasks``), with their texts, so no pair of classes is ever a
   row and a large block is not sent again for every small one it meets. Blocks of one component are not compared.

A link is missed only if no table is shared (at the threshold itself with a chance below ``1e-4``, which falls
quickly with the similarity, ``missed``). Comparisons of the last step grow with the square of a crowd whose sets meet in
buckets but are not linked.

Defined results: a document without words has an empty set and links with nothing; documents of fewer
words than a shingle have their whole sequence as one; equal texts link; rows with a null id are judged by
their set but never stand for it unless no row with an id has that set; classes whose smallest ids are
equal (repeated ids) count as one; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.components import roots
from touchline.llm.text import WordHashes, byte_texts, flat_lists, mixed, shingles, signed
from touchline.session import materialize

#: Rounds with leaders before all that is left is compared.
LEADER_ROUNDS = 2
#: Shingles of a block of classes; every class counts ``CLASS_WEIGHT`` more, so a block has few of them.
BLOCK_WEIGHT, CLASS_WEIGHT = 1_000_000, 1_000

_SIGNATURE = "id long, n_shingles long, a long, b long, signature array<long>"
_ROWS_AT_ONCE = 2048


def missed(similarity: float, collections: int, per_collection: int) -> float:
    """Chance that two documents of this similarity share no table."""
    p = similarity**per_collection
    return sum(comb(collections, i) * p**i * (1 - p) ** (collections - i) for i in (0, 1))


def shingle_set(text: bytes | None, width: int, table: WordHashes) -> np.ndarray:
    """The distinct shingles of a whole text, A-Z lower-cased, sorted."""
    words = text.lower().split() if text else []
    return np.unique(shingles(table.of(words), width)) if words else np.zeros(0, np.uint64)


def _hash_family(n: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = mixed(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E37_79B9))
    return seeds[:n] | np.uint64(1), seeds[n:]


def signatures(documents: DataFrame, width: int, collections: int, per_collection: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Id, size and 128-bit hash of the shingle set, and one combined value per collection."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordHashes()
        factor, shift = _hash_family(collections * per_collection)
        for batch in batches:
            sizes, ids, kept, lengths = [], [], [], []
            for body in byte_texts(batch.column(1)):
                own = shingle_set(body, width, table)
                sizes.append(len(own))
                ids.append(xxhash.xxh3_128_intdigest(own.tobytes()))
                if not len(own):
                    lengths.append(0)
                    continue
                least = np.full(len(factor), np.iinfo(np.uint64).max, np.uint64)
                for i in range(0, len(own), _ROWS_AT_ONCE):
                    np.minimum(least, (own[i : i + _ROWS_AT_ONCE, None] * factor + shift).min(axis=0), out=least)
                value = np.arange(collections, dtype=np.uint64)
                for part in least.reshape(collections, per_collection).T:
                    value = mixed(value ^ part)
                kept.append(signed(value))
                lengths.append(collections)
            a, b = (np.array([i >> s & 0xFFFF_FFFF_FFFF_FFFF for i in ids], np.uint64) for s in (0, 64))
            values = np.concatenate(kept) if kept else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(signed(a)), pa.array(signed(b)), flat_lists(values, lengths, pa.int64())],
                names=["id", "n_shingles", "a", "b", "signature"],
            )

    return documents.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(sign, _SIGNATURE)


def _buckets(classes: DataFrame) -> DataFrame:
    """(id, n, key) for every pair of collections in which the class shares both values with others."""
    values = classes.select("id", "n", F.posexplode("signature").alias("collection", "value"))
    shared = values.groupBy("collection", "value").agg(F.count("*").alias("c")).where("c > 1").select("collection", "value")
    lists = values.join(shared, ["collection", "value"]).groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("collection", "value"))).alias("s"))
    pairs = F.flatten(
        F.transform("s", lambda x, i: F.transform(F.slice("s", i + 2, F.size("s")), lambda y: F.xxhash64(x["collection"], x["value"], y["collection"], y["value"])))
    )
    return lists.where(F.size("s") > 1).select("id", "n", F.explode(pairs).alias("key"))


def _linked(own: np.ndarray, other: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union of two sorted sets."""
    if min(len(own), len(other)) * 100 < percent * max(len(own), len(other)):
        return False
    common = int((other[np.minimum(np.searchsorted(other, own), len(other) - 1)] == own).sum())
    return common > 0 and 100 * common >= percent * (len(own) + len(other) - common)


def _verified(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (u, v) with 100 * intersection >= percent * union, on the full sets of both texts."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, last, held = WordHashes(), None, None
        for batch in batches:
            out = []
            names = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            for (u, v), left, right in zip(names, byte_texts(batch.column(2)), byte_texts(batch.column(3)), strict=True):
                if v != last or right != held[0]:  # rows come sorted by v
                    last, held = v, (right, shingle_set(right, width, table))
                if _linked(shingle_set(left, width, table), held[1], percent):
                    out.append((u, v))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["u", "v"])

    with_left = pairs.join(texts.select(F.col("id").alias("u"), F.col("text").alias("left")), "u")
    with_both = with_left.join(texts.select(F.col("id").alias("v"), F.col("text").alias("right")), "v")
    return materialize(with_both.select("u", "v", "left", "right").mapInArrow(check, "u long, v long"))


def near_duplicates(
    documents: DataFrame, width: int = 5, percent: int = 80, collections: int = 18, per_collection: int = 3, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per document: id, n_shingles, and component, the smallest id reachable by links.

    Two documents are linked where ``100 * intersection >= percent * union`` of their shingle sets.
    """
    signed_rows = materialize(signatures(documents, width, collections, per_collection, key, text))
    sets = signed_rows.where("n_shingles > 0 AND id IS NOT NULL").groupBy("a", "b").agg(F.min(F.struct("id", "n_shingles", "signature")).alias("x"))
    classes = materialize(sets.select("a", "b", F.col("x.id").alias("id"), F.col("x.n_shingles").alias("n"), F.col("x.signature").alias("signature")))
    buckets = materialize(_buckets(classes))
    # the texts of candidates alone
    rows = documents.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    texts = materialize(rows.join(buckets.select("id").distinct(), "id", "left_semi"))
    labels, left = None, buckets
    for turn in range(LEADER_ROUNDS):
        open_ = _open_buckets(left, labels, turn)
        if turn:
            open_ = materialize(open_)
        links = _verified(materialize(_leader_pairs(open_, percent)), texts, width, percent)
        labels = _relabelled(labels, links)
        left = open_.select("key", "id", "n")
    labels = _relabelled(labels, _rest(left, labels, classes, texts, width, percent))
    members = classes.join(labels, "id", "left").select("a", "b", F.coalesce("label", "id").alias("component"))
    return signed_rows.join(members, ["a", "b"], "left").select("id", "n_shingles", F.coalesce("component", "id").alias("component"))


def _labelled(buckets: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return buckets.withColumn("label", F.col("id"))
    return buckets.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))


def _open_buckets(buckets: DataFrame, labels: DataFrame | None, turn: int) -> DataFrame:
    """(key, id, n, label, head) of the buckets that hold several components; the head is a class of the bucket,
    in the first turn the smallest, then one by a hash."""
    known = _labelled(buckets, labels)
    order = (F.xxhash64("id", F.lit(turn)) if turn else F.lit(0)).alias("order")
    found = known.groupBy("key").agg(F.min(F.struct(order, "id", "n", "label")).alias("head"), F.min("label").alias("low"), F.max("label").alias("high"))
    return known.join(found.where("low < high").select("key", "head"), "key")


def _leader_pairs(open_: DataFrame, percent: int) -> DataFrame:
    """Every class outside the heads' components with the head that it meets in most buckets."""
    n, m = F.col("n"), F.col("head.n")
    alike = F.least(n, m) * 100 >= percent * F.greatest(n, m)
    met = open_.where((F.col("label") != F.col("head.label")) & alike).select("id", F.col("head.id").alias("head"))
    best = met.groupBy("id", "head").agg(F.count("*").alias("times")).groupBy("id").agg(F.max(F.struct("times", "head")).alias("x"))
    return best.select(F.least("id", "x.head").alias("u"), F.greatest("id", "x.head").alias("v")).distinct()


def _blocks(open_: DataFrame) -> DataFrame:
    """(id, label, block, low, high, weight) of the classes of open buckets, with the labels that bound the block and its weight.

    Classes with the same smallest class in their buckets are a crowd. A component that fills a block of a
    crowd has blocks of its own; the others share blocks, a component in one.
    """
    first = open_.groupBy("id", "label").agg(F.max("n").alias("n"), F.min("head.id").alias("crowd"))
    weight = F.sum(F.col("n") + CLASS_WEIGHT).alias("weight")
    sums = first.groupBy("crowd", "label").agg(weight).withColumn("own", F.col("weight") >= BLOCK_WEIGHT)
    shared = sums.where("NOT own").groupBy("crowd").agg(F.sum("weight").alias("shared"))
    parts = sums.join(shared, "crowd", "left").select(
        "crowd", "label", "own", F.ceil(F.when(F.col("own"), F.col("weight")).otherwise(F.col("shared")) / BLOCK_WEIGHT).alias("parts")
    )
    dealt = F.when(F.col("own"), F.xxhash64("id")).otherwise(F.xxhash64("label"))
    block = F.xxhash64("crowd", F.when(F.col("own"), F.col("label")), F.pmod(dealt, "parts"))
    placed = materialize(first.join(parts, ["crowd", "label"]).select("id", "label", "n", block.alias("block")))
    span = placed.groupBy("block").agg(F.min("label").alias("low"), F.max("label").alias("high"), weight)
    return placed.drop("n").join(span, "block")


def _tasks(meet: DataFrame) -> DataFrame:
    """(host, part, block): the blocks of every task, from (block_i, weight_i, block_j, weight_j) of those that meet.

    The heavier of two is the host of the other; the guests of a host are dealt into parts of about ``BLOCK_WEIGHT``.
    A block that meets itself is a task alone, of part -1.
    """
    i, j = (F.struct(F.col(f"weight_{x}").alias("weight"), F.col(f"block_{x}").alias("block")) for x in "ij")
    pairs = meet.select(F.greatest(i, j).alias("h"), F.least(i, j).alias("g")).select(F.col("h.block").alias("host"), F.col("g.block").alias("guest"), "g.weight")
    parts = pairs.where("host <> guest").groupBy("host").agg(F.ceil(F.sum("weight") / BLOCK_WEIGHT).alias("parts"))
    part = F.when(F.col("host") == F.col("guest"), -1).otherwise(F.pmod(F.xxhash64("guest"), "parts")).alias("part")
    dealt = pairs.join(parts, "host", "left").select("host", part, "guest")
    return dealt.select("host", "part", F.explode(F.array_distinct(F.array("host", "guest"))).alias("block")).distinct()


def _rest(buckets: DataFrame, labels: DataFrame | None, classes: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (u, v) that connect all classes which are linked, meet in a bucket and lie in different components."""
    open_ = materialize(_open_buckets(buckets, labels, 0).select("key", "id", "n", "label", "head"))
    placed = materialize(_blocks(open_))
    columns = ["block", "low", "high", "weight"]
    held = open_.select("key", "id").join(placed, "id").select("key", *columns).distinct()
    left, right = (held.select("key", *[F.col(c).alias(f"{c}_{side}") for c in columns]) for side in "ij")
    several = (F.least("low_i", "low_j") < F.greatest("high_i", "high_j")) & (F.col("block_i") <= F.col("block_j"))
    meet = materialize(left.join(right, "key").where(several).select("block_i", "weight_i", "block_j", "weight_j").distinct())
    whole = placed.select("block", "id", "label").join(classes.select("id", "n", "signature"), "id").join(texts, "id")

    def compare(rows: pa.Table) -> pa.Table:
        host, block, ids, label, n = (rows.column(c).to_numpy() for c in ("host", "block", "id", "label", "n"))
        signature = rows.column("signature").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        hosts, guests = np.flatnonzero(block == host), np.flatnonzero(block != host)
        met = []
        for at, i in enumerate(hosts):
            others = guests if len(guests) else hosts[at + 1 :]
            near = (label[others] != label[i]) & (np.minimum(n[others], n[i]) * 100 >= percent * np.maximum(n[others], n[i]))
            others = others[near]
            others = others[(signature[others] == signature[i]).sum(axis=1) > 1]
            if len(others):
                met.append((i, others))
        found = _common(met, rows.column("text"), width, percent) if met else []
        root, out = {}, []

        def top(x: int) -> int:
            while x in root:
                x = root[x]
            return x

        for i, j in found:
            a, b = top(label[i]), top(label[j])
            if a != b:
                root[max(a, b)] = min(a, b)
                out.append((ids[i], ids[j]))
        return pa.table({"u": pa.array([min(x) for x in out], pa.int64()), "v": pa.array([max(x) for x in out], pa.int64())})

    sent = _tasks(meet).join(whole, "block")
    return materialize(sent.groupBy("host", "part").applyInArrow(compare, "u long, v long"))


def _common(met: list[tuple[int, np.ndarray]], texts: pa.ChunkedArray, width: int, percent: int) -> Iterator[tuple[int, int]]:
    """The linked ones among (a row, rows that it meets), by the full sets of their texts.

    Shingles are numbered, so that one look-up counts what a set has in common with all those it meets.
    """
    table, bodies = WordHashes(), texts.combine_chunks()
    used = np.unique(np.concatenate([np.append(others, i) for i, others in met]))
    sets = [shingle_set(next(byte_texts(bodies.slice(int(i), 1))), width, table) for i in used]
    size = np.array([len(x) for x in sets])
    shingle, number = np.unique(np.concatenate(sets), return_inverse=True)
    numbers, marked = np.split(number, np.cumsum(size)[:-1]), np.zeros(len(shingle), np.int64)
    for i, others in met:
        own, at = np.searchsorted(used, i), np.searchsorted(used, others)
        kept = size[at] > 0
        others, at = others[kept], at[kept]
        if not size[own] or not len(at):
            continue
        marked[numbers[own]] = 1
        common = np.add.reduceat(marked[np.concatenate([numbers[k] for k in at])], np.cumsum(size[at]) - size[at])
        marked[numbers[own]] = 0
        linked = (common > 0) & (100 * common >= percent * (size[own] + size[at] - common))
        yield from ((i, j) for j in others[linked])


def _relabelled(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """(id, label) of the classes whose component has a smaller id than theirs, after these links too."""
    if labels is None:
        return materialize(roots(links).select(F.col("node").alias("id"), F.col("root").alias("label")).where("id <> label"))
    if links.isEmpty():
        return labels
    u, v = (labels.select(F.col("id").alias(c), F.col("label").alias(f"l_{c}")) for c in "uv")
    between = links.join(u, "u", "left").join(v, "v", "left").select(F.coalesce("l_u", "u").alias("u"), F.coalesce("l_v", "v").alias("v"))
    moved = roots(materialize(between.distinct())).where("node <> root")
    onward = moved.select(F.col("node").alias("label"), F.col("root").alias("next"))
    old = labels.join(onward, "label", "left").select("id", F.coalesce("next", "label").alias("label"))
    # a label that moves was the smallest of its component and had none itself
    return materialize(old.union(moved.select("node", "root")))
