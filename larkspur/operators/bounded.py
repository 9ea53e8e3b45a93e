"""Joins with a side that is sent to all tasks: counted and weighed first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, StringType, StructType

#: Rows and bytes up to which a side is sent to all tasks.
MOST_SENT = 100_000
MOST_BYTES = 64 << 20


def sent(df: DataFrame, most: int = MOST_SENT, most_bytes: int = MOST_BYTES) -> DataFrame:
    """``df`` marked for broadcasting if it has at most ``most`` rows of ``most_bytes`` together; else the join is left to Spark."""
    # numbers are what rows have many of: eight bytes each; of the others their text is counted
    wide = [f for f in df.schema.fields if isinstance(f.dataType, (ArrayType, BinaryType, MapType, StringType, StructType))]
    size = F.lit(8 * (len(df.columns) - len(wide)))
    for f in wide:
        text = F.col(f"`{f.name}`") if isinstance(f.dataType, (StringType, BinaryType)) else F.to_json(F.struct(F.col(f"`{f.name}`")))
        size = size + F.coalesce(F.octet_length(text), F.lit(0))
    n, total = df.limit(most + 1).agg(F.count("*"), F.sum(size.cast("long"))).first()
    return F.broadcast(df) if n <= most and (total or 0) <= most_bytes else df
