"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from screenflow.sources.scratch import scratch_folder

#: White space between words; a word is a run of anything else.
GAP = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table below ``spark.checkpoint.dir`` and read again.

    Cuts the lineage in storage that outlives an executor, and gives the
    planner true sizes to choose joins by.
    """
    path = scratch_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores in front while a column of that name exists."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def col(name: str) -> Column:
    """A column by its literal name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


#: Bytes of text for each shard of packed rows, which one task loads whole.
SHARD_BYTES = 32 << 20


def shards(df: DataFrame, text_col: str, per_partition: int = 4) -> int:
    """How many shards to cut packed rows into: by the bytes of all texts, and a few for each shuffle partition at least."""
    size = df.agg(F.coalesce(F.sum(F.octet_length(col(text_col))), F.lit(0)).alias("n")).first()["n"]
    return max(per_partition * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))


def binary_column(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a binary Arrow array, all rows in one buffer, and the row offsets into it."""
    array = array.combine_chunks() if isinstance(array, pa.ChunkedArray) else array
    array = array.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = array.buffers()
    ends = np.frombuffer(offsets, np.int64)[array.offset : array.offset + len(array) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


def joined_rows(column: pa.ChunkedArray, dtype) -> np.ndarray:
    """All numbers packed into the rows of a binary column, one after another."""
    data, _ = binary_column(column)
    return np.frombuffer(data.tobytes(), dtype)


def packed_by(shard: np.ndarray, arrays: list[np.ndarray]) -> tuple[np.ndarray, list[list[bytes]]]:
    """The arrays cut into one packed value for each shard; rows must be sorted by shard."""
    starts = np.flatnonzero(np.diff(shard, prepend=-1))
    ends = [*starts[1:], len(shard)][: len(starts)]
    return shard[starts], [[a[i:j].tobytes() for i, j in zip(starts, ends, strict=True)] for a in arrays]


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit mix of every number (the splitmix finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
