"""Sharding by a two-pass external shuffle, in DataFrame functions only.

Pass 1 scatters the records uniformly over memory-sized buckets by a seeded hash; the exchange is the external
store. Pass 2 holds one bucket at a time as an array, permutes it by Fisher-Yates (Spark's `shuffle`), and cuts the
sequence of all buckets into shards whose row counts differ by at most one.

No shuffle has more than about `fan_out` reducers: beyond that many buckets the records are first written in ranges of
buckets, and each range is a shuffle of its own.
"""

from __future__ import annotations

import math
import uuid
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, shared_dir, text_bytes


def in_ranges(scattered: DataFrame, ranges: int, size: int) -> DataFrame:
    """`scattered` written to the shared folder by ranges of `size` buckets, `range` being the number of a bucket's; a file holds `ranges` buckets."""
    path = f"{shared_dir(scattered.sparkSession)}/scatter-{uuid.uuid4().hex}"
    dealt = scattered.withColumn("range", F.floor(F.col("bucket") / size).cast("int"))
    dealt = dealt.repartitionById(size, F.floor(F.col("bucket") / ranges).cast("int"))
    dealt.write.option("compression", "zstd").partitionBy("range").parquet(path)
    return scattered.sparkSession.read.schema(dealt.schema).parquet(path)


def mix_buckets(records: DataFrame, heads: DataFrame, buckets: int, seed: int) -> DataFrame:
    """(first, rows, pos, one): the records of each bucket (from 0) in random order, with the bucket's head. A task holds one bucket."""
    by_place = lambda a, b: F.when(a["_at"] < b["_at"], -1).when(a["_at"] > b["_at"], 1).otherwise(0)
    # A partition for each bucket: a task holds one, and the random numbers go by its number alone. Where a bucket
    # begins comes with its records, so that they are shuffled once.
    full = records.unionByName(heads).repartitionById(buckets, F.col("bucket")).groupBy("bucket")
    full = full.agg(F.collect_list("one").alias("recs"), F.max("first").alias("first"), F.max("rows").alias("rows"))
    mixed = full.withColumn("recs", F.shuffle(F.array_sort("recs", by_place), F.lit(seed)))
    return mixed.select("first", "rows", F.posexplode("recs").alias("pos", "one"))


def shuffle_into_shards(
    docs: DataFrame,
    shards: int = 16,
    seed: int = 42,
    bucket_bytes: int = 32 << 20,
    min_buckets: int = 64,
    fan_out: int = 1 << 15,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """All rows of `docs` with `shard` (0 to shards-1) and `slot` (gapless from 0 in each shard), in random order.

    The hash takes the id and the row's place in the scan, so repeated rows and null ids spread over all buckets as
    well, and no bucket outgrows its size but by chance or by one long record. The place must be the same when a task
    is run again: `docs` has to be a scan or a written table, not the output of a shuffle. Null texts count as no
    bytes. An empty table gives an empty result. Columns of `docs` named shard or slot are replaced. The permutation
    doesn't depend on the order in which rows or buckets come in: a bucket is put in the order of the scan before
    Fisher-Yates, and has a task of its own. More than `fan_out` buckets are first written to the shared folder in ranges.
    """
    names = [c for c in docs.columns if c not in ("shard", "slot")]
    total = docs.agg(F.sum(text_bytes(text_col) + 1)).first()[0] or 0
    buckets = max(min_buckets, math.ceil(total / bucket_bytes))
    ranges = math.ceil(buckets / fan_out)
    size = buckets if ranges == 1 else ranges * math.ceil(buckets / ranges**2)  # buckets of a range
    buckets = ranges * size
    place = docs.select(F.struct(*(F.col(c) for c in names)).alias("rec"), F.col(id_col).alias("_id"), F.monotonically_increasing_id().alias("_at"))
    scattered = place.select("rec", "_at", F.pmod(F.xxhash64(F.lit(seed), "_id", "_at"), F.lit(buckets)).cast("int").alias("bucket"))

    if ranges > 1:
        scattered = in_ranges(scattered, ranges, size)
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # over one row a bucket
    offsets = scattered.groupBy("bucket").agg(F.count("*").alias("n")).select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"), F.sum("n").over(Window.partitionBy()).alias("rows"))
    if ranges > 1:
        offsets = cut(offsets)

    one = F.struct("_at", "rec").alias("one")
    heads = offsets.select("bucket", F.lit(None).cast(scattered.select(one).schema["one"].dataType).alias("one"), "first", "rows")
    parts = []
    for i in range(ranges):
        bucket = (F.col("bucket") - i * size).alias("bucket")
        records = (scattered.where(F.col("range") == i) if ranges > 1 else scattered).select(bucket, one, *(F.lit(None).cast("long").alias(c) for c in ("first", "rows")))
        own = (heads.where(F.col("bucket").between(i * size, (i + 1) * size - 1)) if ranges > 1 else heads).select(bucket, "one", "first", "rows")
        parts.append(mix_buckets(records, own, size, seed + i))
    ranked = reduce(DataFrame.unionByName, parts)

    rank, base, extra = F.col("first") + F.col("pos"), F.floor(F.col("rows") / shards), F.col("rows") % shards
    ranked = ranked.select("one.rec.*", rank.alias("_rank"), base.alias("_base"), (extra * (base + 1)).alias("_large"), extra.alias("_extra"))
    large = F.col("_rank") < F.col("_large")
    shard = F.when(large, F.floor(F.col("_rank") / (F.col("_base") + 1))).otherwise(F.col("_extra") + F.floor((F.col("_rank") - F.col("_large")) / F.col("_base")))
    slot = F.when(large, F.col("_rank") % (F.col("_base") + 1)).otherwise((F.col("_rank") - F.col("_large")) % F.col("_base"))
    return ranked.select(*names, shard.cast("int").alias("shard"), slot.cast("long").alias("slot"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder a shard, each file sorted by slot."""
    sharded.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
