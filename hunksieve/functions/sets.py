"""Sets of keys as bit sets of fixed size, for filters before a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys are told apart by so many hash buckets: 1,024 words of 64 bits.
BUCKETS = 1 << 16


def may_be_in(rows: DataFrame, *keys: str) -> Column:
    """Whether a row's keys may be among those of `rows`, by a bit set of fixed size: what is surely not goes no further."""
    bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS))
    words = rows.select(bucket.alias("b")).groupBy(F.shiftright("b", 6).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("b") % 64).cast("int"))).alias("bits"))
    held = words.agg(F.map_from_entries(F.collect_list(F.struct("w", "bits"))).alias("m"))
    row = held.select(F.transform(F.sequence(F.lit(0), F.lit(BUCKETS // 64 - 1)), lambda w: F.coalesce(F.try_element_at("m", w.cast("long")), F.lit(0).cast("long"))))
    return F.getbit(F.get(row.scalar(), F.shiftright(bucket, 6).cast("int")), (bucket % 64).cast("int")) == 1
