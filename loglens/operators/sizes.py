"""Size checks before a broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: bytes that are broadcast at most
BROADCAST_BYTES = 64 << 20


def bytes_of(df: DataFrame) -> int:
    """About how many bytes the rows hold (one small job: a partial sum of lengths)."""
    each = F.lit(16)
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            each = each + 16 + F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0))
        elif isinstance(f.dataType, T.ArrayType):
            each = each + 16 + 16 * F.greatest(F.size(F.col(f"`{f.name}`")), F.lit(0))
        else:
            each = each + 16
    return df.agg(F.sum(each.cast("long"))).first()[0] or 0


def broadcast_if_small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """The frame with a broadcast hint when its checked size allows it; otherwise as
    it is, for a shuffled join that adaptive execution splits where keys are hot."""
    return F.broadcast(df) if bytes_of(df) <= most else df
