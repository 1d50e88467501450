"""Repair of conversation structure by weighted CYK parsing with a repair grammar.

A conversation is right if its role initials read ``(s?(ua)+)?``. Its rows may be kept (cost 0), given the
role user or assistant (1) or deleted (2); empty user and assistant turns may be inserted anywhere (5).
Blank and duplicate rows must be deleted; a truncated row that stays adds 5.

The grammar is in Chomsky normal form. Its symbols are ``[p, q]``: what leads from place ``p`` of the pattern
to place ``q`` (0 at the start, 1 after a system, 2 after a user, 3 after an assistant turn). The rules are
``[p, q] -> [p, r] [r, q]``, the edits of one row, and insertions, which every cell is closed under. A cell
holds for each symbol the least (cost, audit) over a span of rows, where the audit is the initials of its
edits. Cells are combined bottom-up by span length: rows to pairs, pairs to fours and so on, up to the
conversation. Each rule holds at every split of a span, so one split gives the same cell as all of them,
and spans that lie apart can be parsed in different tasks. Audits of equal cost over one span are never
prefixes of each other (more insertions would cost more), so the least one of a part is in the least whole.

Work is split by rank in the order, not by conversation: rows are range partitioned by conversation and
turn, chunks of ``CHUNK`` ranks are parsed by themselves, then the chunks of a part, then the parts of a
conversation. Only what the contract itself makes sequential is done in one task, in batches: the digest of
a conversation's repaired text. An audit is as long as its conversation.

Defined results: ``turn`` orders the rows, nulls first, then role and two hashes of the text (equal rows are
interchangeable); a null role or text is one blank, a null ``conv_id`` is a conversation of its own; a row without
a role initial can't be kept; a conversation without rows has cost 0, an empty audit and the digest of nothing; an
empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.session import materialize

#: Ranks of a chunk and of a run of chunks, as powers of two.
CHUNK, RUN = 7, 20

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5

_BLANKS = " \t\n\x0b\x0c\r"

#: Place after a turn with this initial, and the turn that a change or an insertion makes at a place.
_AFTER = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
_MADE = {0: (2, "user"), 1: (2, "user"), 2: (3, "assistant"), 3: (2, "user")}
_LEGAL = ("su", "ua", "au")

#: Least (cost, audit) of each symbol, ``[p, q]`` at ``4 * p + q``, or none.
Cell = tuple[tuple[int, str] | None, ...]


def combined(left: Cell, right: Cell) -> Cell:
    """The cell of two neighbouring spans."""
    out: list[tuple[int, str] | None] = [None] * 16
    for p in range(4):
        for r in range(4):
            first = left[4 * p + r]
            if first is None:
                continue
            for q in range(4):
                second = right[4 * r + q]
                if second is not None:
                    both, at = (first[0] + second[0], first[1] + second[1]), 4 * p + q
                    if out[at] is None or both < out[at]:
                        out[at] = both
    return tuple(out)


def _closure() -> Cell:
    out: list[tuple[int, str] | None] = [None] * 16
    for p in range(4):
        q, audit = p, ""
        while out[4 * p + q] is None:
            out[4 * p + q] = (INSERT * len(audit), audit)
            q, audit = _MADE[q][0], audit + "I"
    return tuple(out)


_INSERTED = _closure()


@functools.cache
def _row(code: str) -> Cell:
    """The cell of one row. Codes: the initial (``o`` for any other), upper case where truncated, a digit where it must go."""
    out: list[tuple[int, str] | None] = [None] * 16
    extra = TRUNCATED if code.isupper() else 0
    for p in range(4):
        edits = [(p, (DELETE, "D"))]
        if not code.isdigit():
            edits.append((_MADE[p][0], (REROLE + extra, "R")))
            if (p, code.lower()) in _AFTER:
                edits.append((_AFTER[p, code.lower()], (KEEP + extra, "K")))
        for q, edit in edits:
            out[4 * p + q] = min(edit, out[4 * p + q] or edit)
    return combined(combined(_INSERTED, tuple(out)), _INSERTED)


def parse(cells: list[Cell]) -> Cell:
    """The cell over a row of spans, bottom-up by length."""
    while len(cells) > 1:
        pairs = [combined(cells[i], cells[i + 1]) for i in range(0, len(cells) - 1, 2)]
        cells = pairs + cells[len(cells) - len(cells) % 2 :]
    return cells[0] if cells else _INSERTED


def best(cell: Cell) -> tuple[int, str]:
    """Cheapest edits that give a whole conversation or none."""
    return min(x for x in (cell[0], cell[3]) if x is not None)


def damaged(rows: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text) with every twentieth (conversation, turn) dropped, emptied, stripped of sentence ends,
    repeated or given to the user, by a hash."""
    h = F.crc32(F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (conversation, turn)]).cast("binary")) % 20
    plain = rows.select(
        F.col(conversation).alias("conv"), F.col(turn).alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in (role, text)], h.alias("h")
    ).toDF("conv", "turn", "role", "text", "h")
    words = F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    kept = plain.where("h <> 0").select("conv", "turn", F.when(F.col("h") == 4, "user").otherwise(F.col("role")).alias("role"), words.alias("text"), "h")
    return kept.withColumn("copy", F.explode(F.sequence(F.lit(0), (F.col("h") == 3).cast("int")))).drop("h", "copy")


def _tie() -> list[Column]:
    return [F.crc32(F.col("text").cast("binary")).alias("t1"), F.xxhash64("text").alias("t2")]


_ORDER = ["conv", "turn", "role", "t1", "t2"]


def _codes(rows: DataFrame) -> DataFrame:
    """(conv, rank, code, blank, duplicate, truncated) of every row; ranks grow in the order of all rows."""
    bare = F.rtrim(F.col("text"), F.lit(_BLANKS))
    light = rows.select(
        "conv", "turn", "role", *_tie(), F.xxhash64("text", "role", F.lit(1)).alias("t3"),
        (bare == "").alias("blank"), (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("cut"),
    )
    # equal rows of a conversation may lie in different parts
    spread = light.withColumn("salt", F.xxhash64(F.monotonically_increasing_id()))
    placed = spread.repartitionByRange(*_ORDER, "salt").sortWithinPartitions(*_ORDER)
    placed = materialize(placed.withColumn("rank", F.monotonically_increasing_id()).select("conv", "role", "t2", "t3", "blank", "cut", "rank"))
    often = placed.groupBy("conv", "role", "t2", "t3").agg(F.min("rank").alias("first"), F.count("*").alias("c")).where("c > 1").drop("c")
    same = [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in ("conv", "role", "t2", "t3")]
    both = placed.alias("x").join(often.alias("y"), same, "left").select("x.*", (F.col("rank") > F.coalesce("first", "rank")).alias("again"))
    initial = F.left("role", F.lit(1))
    at = F.when(initial == "u", 1).when(initial == "a", 2).when(initial == "s", 3).otherwise(4)
    truncated = ~F.col("blank") & ~F.col("again") & F.col("cut")
    letters = F.when(F.col("blank") | F.col("again"), F.lit("1234")).when(truncated, F.lit("UASO")).otherwise(F.lit("uaso"))
    return both.select(
        "conv", "rank", F.substring(letters, at, F.lit(1)).alias("code"), F.col("blank").cast("long").alias("blank"),
        (~F.col("blank") & F.col("again")).cast("long").alias("duplicate"), truncated.cast("long").alias("truncated"),
    )


_COUNTS = ("blank", "duplicate", "truncated")
_SPAN = "first string, last string, illegal long, cells array<struct<cost:long,audit:string>>"


def _initial(code: str) -> str:
    return "uaso"["1234".index(code)] if code.isdigit() else code.lower()


def _joined(left: tuple, right: tuple) -> int:
    return int(left[1] + right[0] not in _LEGAL)


@functools.lru_cache(maxsize=50_000)
def _leaf(codes: str) -> tuple:
    """(first, last, illegal, cell) of the rows of a chunk."""
    own = [_initial(c) for c in codes]
    illegal = sum(a + b not in _LEGAL for a, b in zip(own, own[1:], strict=False))
    return own[0], own[-1], illegal, parse([_row(c) for c in codes])


def _folded(spans: list[tuple]) -> tuple:
    illegal = sum(s[2] for s in spans) + sum(map(_joined, spans, spans[1:]))
    return spans[0][0], spans[-1][1], illegal, parse([s[3] for s in spans])


def _mapped(rows: DataFrame, name: str, span: Callable[[object], tuple]) -> DataFrame:
    """``rows`` with the column ``name`` replaced by the span made of it."""
    others = [c for c in rows.columns if c != name]
    schema = rows.select(*others).schema
    for field in rows.sparkSession.createDataFrame([], _SPAN).schema.fields:
        schema = schema.add(field)

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell = pa.list_(pa.struct([("cost", pa.int64()), ("audit", pa.string())]))
        for batch in batches:
            found = [span(x) for x in batch.column(name).to_pylist()]
            cells = [[None if x is None else {"cost": x[0], "audit": x[1]} for x in s[3]] for s in found]
            columns = [pa.array([s[0] for s in found], pa.string()), pa.array([s[1] for s in found], pa.string()), pa.array([s[2] for s in found], pa.int64()), pa.array(cells, cell)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in others], *columns], names=[*others, "first", "last", "illegal", "cells"])

    return rows.select(*others, name).mapInArrow(spans, schema)


def _of_codes(items: list[dict]) -> tuple:
    return _leaf("".join(x["code"] for x in items))


def _of_spans(items: list[dict]) -> tuple:
    return _folded([(x["first"], x["last"], x["illegal"], tuple(None if c is None else (c["cost"], c["audit"]) for c in x["cells"])) for x in items])


def _parsed(codes: DataFrame) -> DataFrame:
    """One row per conversation with rows: counts, illegal, and the cells of the whole."""
    sums = [F.sum(c).alias(c) for c in _COUNTS]
    chunks = codes.groupBy("conv", F.shiftright("rank", CHUNK).alias("at")).agg(F.sort_array(F.collect_list(F.struct("rank", "code"))).alias("items"), *sums)
    spans = _mapped(chunks, "items", _of_codes)
    listed = F.sort_array(F.collect_list(F.struct("at", "first", "last", "illegal", "cells"))).alias("items")
    runs = spans.groupBy("conv", F.shiftright("at", RUN - CHUNK).alias("run")).agg(listed, *sums).withColumnRenamed("run", "at")
    whole = _mapped(runs, "items", _of_spans).groupBy("conv").agg(listed, *sums)
    return _mapped(whole, "items", _of_spans)


def repaired(rows: DataFrame) -> DataFrame:
    """One row per conversation of (conv, turn, role, text): conv, counts of faults, gaps, illegal, cost, audit, digest of the repaired text."""
    cells = [F.col("cells")[i] for i in (0, 3)]
    best_of = F.array_min(F.filter(F.array(*cells), lambda x: x.isNotNull()))
    parsed = _parsed(_codes(rows)).select("conv", *_COUNTS, "illegal", best_of["cost"].alias("cost"), best_of["audit"].alias("audit"))
    turns = rows.groupBy("conv", "turn").agg(F.lit(1)).groupBy("conv").agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).cast("long").alias("gaps"))
    facts = parsed.unionByName(turns, allowMissingColumns=True).groupBy("conv").agg(*[F.max(c).alias(c) for c in (*_COUNTS, "illegal", "cost", "audit", "gaps")])
    return _digested(facts, rows)


def with_all(found: DataFrame, rows: DataFrame, conversation: str = "conv_id") -> DataFrame:
    """``found`` and a row of zeros for every conversation of ``rows`` that has none."""
    ids = rows.select(F.col(conversation).alias("conv")).distinct()
    names = ["gaps", *_COUNTS, "illegal", "cost"]
    blank = [F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c) for c in names]
    nothing = hashlib.sha256(b"").hexdigest()
    both = found.unionByName(ids, allowMissingColumns=True)
    return both.groupBy("conv").agg(*blank, F.coalesce(F.max("audit"), F.lit("")).alias("audit"), F.coalesce(F.max("repaired_sha256"), F.lit(nothing)).alias("repaired_sha256"))


class Repair:
    """The repaired conversation, edit by edit, as a digest."""

    def __init__(self, audit: str) -> None:
        self.audit, self.at, self.place, self.empty = audit, 0, 0, True
        self.digest = hashlib.sha256()

    def _put(self, role: str, text: str) -> None:
        self.digest.update(("" if self.empty else "\n").encode() + f"{role}:{text}".encode())
        self.empty = False

    def _made(self, text: str) -> None:
        self.place, role = _MADE[self.place]
        self._put(role, text)

    def insert(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            self._made("")

    def row(self, role: str, text: str) -> None:
        self.insert()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "R":
            self._made(text)
        elif edit == "K":
            self.place = _AFTER[self.place, role[:1]]
            self._put(role, text)

    def end(self) -> str:
        self.insert()
        return self.digest.hexdigest()


def _digested(facts: DataFrame, rows: DataFrame) -> DataFrame:
    """``facts`` with the digest; a conversation's audit comes before its rows, which are read in batches."""
    names = facts.columns
    text = rows.select("conv", "turn", "role", "text", *_tie())
    stream = facts.withColumn("kind", F.lit(0)).unionByName(text.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    stream = stream.repartition("conv").sortWithinPartitions("conv", "kind", "turn", "role", "t1", "t2").select(*names, "kind", "role", "text")
    schema = facts.schema.add("repaired_sha256", "string")

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, fact = None, None

        def closed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*fact.columns, pa.array([held.end()])], names=[*names, "repaired_sha256"])

        for batch in batches:
            kinds, roles, texts, audits = (batch.column(c).to_pylist() for c in ("kind", "role", "text", "audit"))
            done = []
            for i, kind in enumerate(kinds):
                if kind:
                    held.row(roles[i], texts[i])
                    continue
                if held is not None:
                    done.append(closed())
                held, fact = Repair(audits[i]), batch.slice(i, 1).select(names)
            if done:
                yield from pa.Table.from_batches(done).combine_chunks().to_batches()
        if held is not None:
            yield closed()

    return stream.mapInArrow(digests, schema)
