"""Broadcasts behind a check of the side's size in bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, StringType, StructType

BROADCAST_BYTES = 32 << 20


def size_in_bytes(df: DataFrame) -> int:
    """Bytes of all rows (one small aggregate): text by its length, nested values as JSON."""
    size = F.lit(0)
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (StringType, BinaryType)):
            size = size + F.coalesce(F.octet_length(c), F.lit(0)) + 16
        elif isinstance(f.dataType, (ArrayType, MapType, StructType)):
            size = size + F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0))
        else:
            size = size + 16
    return df.agg(F.sum(size)).first()[0] or 0


def small(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if all its rows together are small, else as it is
    (a sort-merge join, whose hot partitions AQE splits). Both joins give the same rows."""
    return F.broadcast(df) if size_in_bytes(df) <= max_bytes else df
