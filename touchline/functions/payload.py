"""Decoding of binary payloads, in Arrow batches where Spark has no function for it."""

from __future__ import annotations

import gzip
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline.functions.scalars import HEADER_BYTES

INFLATE_STEP = 1 << 20
ROWS_PER_FRAME = 50_000

# The columns of a feature shard, in file order.
SHARD_COLUMNS = (
    ["frame", "player_index", "team_id", "own_x", "own_y", "own_vx", "own_vy"]
    + ["ball_dx", "ball_dy", "ball_dvx", "ball_dvy"]
    + [f"{who}_{what}" for who in ("tm1", "tm2", "op1", "op2", "op3") for what in ("dx", "dy", "dvx", "dvy", "present")]
    + ["dir_x", "dir_y", "kick"]
)

_PAYLOAD = T.StructType([T.StructField("size", T.LongType()), T.StructField("error", T.StringType())])


def _inflated_size(data: bytes) -> tuple[int | None, str | None]:
    """Size of a raw DEFLATE stream, read in bounded steps; or why it cannot be read."""
    stream = zlib.decompressobj(-zlib.MAX_WBITS)
    total, rest = 0, data
    try:
        while not stream.eof:
            step = stream.decompress(rest, INFLATE_STEP)
            total += len(step)
            rest = stream.unconsumed_tail
            if not step and not rest and not stream.eof:
                return None, "deflate_error:incomplete_stream"
    except zlib.error as problem:
        return None, f"deflate_error:{problem}"
    return (None, "deflate_trailing_data") if stream.unused_data else (total, None)


@F.pandas_udf(_PAYLOAD)
def _payload_size(contents: pd.Series) -> pd.DataFrame:
    found = [_inflated_size(bytes(c[HEADER_BYTES:])) if c is not None else (None, None) for c in contents]
    return pd.DataFrame(found, columns=["size", "error"]).astype({"size": "Int64"})


def payload_probe(content: Column) -> Column:
    """struct(size, error) of the compressed part of a replay (PRJ-02)."""
    return _payload_size(content)


def decode_shards(files: DataFrame) -> DataFrame:
    """Rows of gzip float32 shards: (path, 39 columns, error) (SRC-05).

    Files are decoded where they lie; rows leave in bounded frames. A shard whose size does not fit the
    row width gives a single row with an error.
    """
    width = len(SHARD_COLUMNS)

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    values = np.frombuffer(gzip.decompress(content), dtype="<f4")
                    problem = None if values.size % width == 0 else f"row_width:{values.size}"
                except (OSError, EOFError, ValueError, zlib.error) as failure:
                    values, problem = np.empty(0, "<f4"), f"gzip:{type(failure).__name__}"
                if problem:
                    yield pd.DataFrame({"path": [path], **{c: [None] for c in SHARD_COLUMNS}, "error": [problem]})
                    continue
                table = values.reshape(-1, width)
                for start in range(0, len(table), ROWS_PER_FRAME):
                    frame = pd.DataFrame(table[start : start + ROWS_PER_FRAME], columns=SHARD_COLUMNS)
                    frame.insert(0, "path", path)
                    frame["error"] = None
                    yield frame

    schema = ", ".join(["path string", *[f"{c} float" for c in SHARD_COLUMNS], "error string"])
    return files.select("path", "content").mapInPandas(decode, schema)
