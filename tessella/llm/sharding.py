"""Sharding (operator 10): Karmarkar-Karp differencing over indivisible groups of equal texts.

Groups of more than a small share of all bytes are items of their own: there can be only `shards * FINE` of
them. All others are first put together by a hash of their text into `shards * FINE` items. So the
differencing sees a bounded number of items, whatever the input, and equal texts always stay together.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

SHARDS = 40
FINE = 128
#: What a row takes besides its text.
OVERHEAD = 16


def karmarkar_karp(sizes: list[int], ways: int) -> list[int]:
    """A part from 0 to ways - 1 for each size, by repeatedly joining the two partial partitions of largest spread in opposite order."""
    heap, part_of = [], [0] * len(sizes)
    for i, size in enumerate(sizes):
        sums = np.zeros(ways, dtype=np.int64)
        sums[-1] = size
        heap.append((-size, i, sums, [[] for _ in range(ways - 1)] + [[i]]))
    heapq.heapify(heap)
    serial = len(sizes)
    while len(heap) > 1:
        _, _, a, in_a = heapq.heappop(heap)
        _, _, b, in_b = heapq.heappop(heap)
        total = a + b[::-1]
        order = np.argsort(total, kind="stable")
        # the longer list takes up the shorter one, so that an item moves only a logarithmic number of times
        met = [x + y if len(x) >= len(y) else y + x for x, y in zip(in_a, in_b[::-1], strict=True)]
        total = total[order]
        heapq.heappush(heap, (-int(total[-1] - total[0]), serial, total, [met[k] for k in order]))
        serial += 1
    if heap:
        for part, members in enumerate(heap[0][3]):
            for i in members:
                part_of[i] = part
    return part_of


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The law is `bytes`: sizes of the shards are as near to equal as the groups allow; a group that is larger
    than a shard's share fills one alone. A null text has no bytes and is a group with the empty text.
    Repeated rows each take a slot. grown_shard is null: a change of the number of shards deals anew.
    Other columns of docs are not read. An empty table gives no rows.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # two 64-bit hashes name a group; should they ever collide, two groups share a shard, which breaks no law
    keyed = common.stage(
        docs.select(
            "doc_id",
            (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.xxhash64(text).alias("_h"),
            F.xxhash64(text, F.lit(1)).alias("_g"),
            F.monotonically_increasing_id().alias("_row"),
        ),
        "shard-keys",
    )
    fine = shards * FINE
    total = keyed.agg(F.sum("size")).first()[0] or 0
    bucket: Column = F.pmod("_h", F.lit(fine))
    groups = keyed.groupBy("_h", "_g").agg(F.sum("size").alias("_size")).withColumn("_big", F.col("_size") * fine > F.lit(total))
    items = (
        groups.select(F.when(F.col("_big"), F.col("_h")).otherwise(bucket).alias("_h"), F.when(F.col("_big"), F.col("_g")).alias("_g"), "_size")
        .groupBy("_h", "_g")
        .agg(F.sum("_size").alias("size"))
        .orderBy("_h", "_g")
        .collect()
    )  # 2 * fine rows at most: no more than fine groups have over 1/fine of all bytes
    to = karmarkar_karp([r["size"] for r in items], shards)
    big = F.broadcast(spark.createDataFrame([(r["_h"], r["_g"], s) for r, s in zip(items, to, strict=True) if r["_g"] is not None], "_h long, _g long, _own int"))
    small = F.broadcast(spark.createDataFrame([(r["_h"], s) for r, s in zip(items, to, strict=True) if r["_g"] is None], "_bucket long, _shared int"))
    dealt = (
        keyed.withColumn("_bucket", bucket)
        .join(big, ["_h", "_g"], "left")
        .join(small, "_bucket", "left")
        .select("doc_id", "size", "text_crc32", "_row", F.coalesce("_own", "_shared").alias("shard"))
    )
    return common.number_slots(dealt, "shard", ["doc_id", "text_crc32", "size", "_row"], "slot").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
