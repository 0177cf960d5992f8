"""Minimum-cost-flow resharding: move the fewest bytes from an old layout to new capacities, then rewrite what changed.

Old shards are sources with their bytes, new shards are sinks with their capacities, and an arc costs what a byte pays for
the move (0 where it stays). Successive shortest paths solve it exactly; the graph has as many nodes as shards, whatever
the corpus. Each flow is a block: a byte range of the old shard's running order. A row goes where its middle byte lies.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import common as C


def min_cost_flow(supply: list[int], capacity: list[int], cost: list[list[int]]) -> list[list[int]]:
    """Integer flow from each source to each sink that ships all supply at the least cost. Costs are not negative."""
    a, b = len(supply), len(capacity)
    if sum(supply) > sum(capacity):
        raise ValueError("the capacities do not hold the supply")
    flow = [[0] * b for _ in range(a)]
    left, room = list(supply), list(capacity)
    high = [0] * (a + b)  # potentials keep reduced costs from falling below 0
    while any(left):
        far = [float("inf")] * (a + b)
        came = [-1] * (a + b)
        heap = []
        for i in range(a):
            if left[i]:
                far[i] = 0
                heap.append((0, i))
        heapq.heapify(heap)
        while heap:
            d, v = heapq.heappop(heap)
            if d > far[v]:
                continue
            if v < a:
                steps = ((a + j, cost[v][j]) for j in range(b))
            else:
                steps = ((i, -cost[i][v - a]) for i in range(a) if flow[i][v - a])
            for w, c in steps:
                if (e := d + c + high[v] - high[w]) < far[w]:
                    far[w], came[w] = e, v
                    heapq.heappush(heap, (e, w))
        end = min((far[a + j] + high[a + j], j) for j in range(b) if room[j])[1]
        path, v = [], a + end
        while came[v] >= 0:
            path.append((came[v], v))
            v = came[v]
        n = min(left[v], room[end], *(flow[y][x - a] for x, y in path if x >= a))
        for x, y in path:
            if x < a:
                flow[x][y - a] += n
            else:
                flow[y][x - a] -= n
        left[v] -= n
        room[end] -= n
        high = [h + min(f, far[a + end]) for h, f in zip(high, far, strict=True)]
    return flow


def blocks(sizes: dict, capacity: list[int], cost=None) -> list[tuple[object, int, int]]:
    """(old shard, end of the byte range, new shard) of every block; an old shard that is also a new one keeps its first bytes.
    cost(old, new): what a byte pays, 1 for any move unless given."""
    old = sorted(sizes, key=lambda x: (x is None, x))
    price = cost or (lambda x, y: int(x != y))
    flow = min_cost_flow([sizes[x] for x in old], capacity, [[price(x, y) for y in range(len(capacity))] for x in old])
    out = []
    for x, row in zip(old, flow, strict=True):
        at = 0
        for y in sorted(range(len(row)), key=lambda y: (price(x, y), y)):
            if row[y]:
                at += row[y]
                out.append((x, at, y))
    return out


def even(total: int, shards: int) -> list[int]:
    return [total // shards + (i < total % shards) for i in range(shards)]


def reshard(rows: DataFrame, old_shard: Column, shards: int, key: str = "doc_id", size: str = "size", capacity: list[int] | None = None, cost=None, bucket_rows: int = 50_000) -> DataFrame:
    """rows with old_shard, shard (0 to shards - 1), slot (gapless from 0 in its shard) and moved.

    size: bytes of a row, at least 1. capacity: bytes of each new shard; even by default, so shards are within about two
    rows of each other. Positions come from prefix sums in two steps, by bucket of the key and within it, so one old shard
    may hold any part of all rows. An empty table gives an empty result. Rows of equal keys are ranked by size and placed
    one by one; null keys come first. old_shard may be null: a shard of its own. Columns of rows that are named like the
    new ones are replaced, all others are carried along.
    """
    bucket, low, nth, lead, way = C.free([*rows.columns, "old_shard", "shard", "slot", "moved"], "bucket", "low", "nth", "lead", "way")
    dealt = rows.withColumn(bucket, old_shard.cast("int")).drop("old_shard", "shard", "slot", "moved").withColumnRenamed(bucket, "old_shard")
    columns = [c for c in dealt.columns if c != "old_shard"]
    total = dealt.groupBy("old_shard").agg(F.sum(size).alias("b"), F.count(F.lit(1)).alias("n")).collect()  # one row for each old shard
    sizes = {r["old_shard"]: int(r["b"]) for r in total}
    buckets = max(1, -(-sum(r["n"] for r in total) // bucket_rows))
    capacity = capacity or even(sum(sizes.values()), shards)
    # bounded: old + new - 1 blocks at most
    plan = rows.sparkSession.createDataFrame(blocks(sizes, capacity, cost), "o int, upto bigint, to int").groupBy("o").agg(F.array_sort(F.collect_list(F.struct("upto", "to"))).alias(way))
    dealt = dealt.withColumn(bucket, F.pmod(F.xxhash64(key), F.lit(buckets)))
    prior = lambda w, v: F.coalesce(F.sum(v).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = dealt.groupBy("old_shard", bucket).agg(F.sum(size).alias("b"))
    starts = starts.select(F.col("old_shard").alias("o"), F.col(bucket).alias("k"), prior(Window.partitionBy("old_shard").orderBy(bucket), "b").alias(lead))
    in_bucket = Window.partitionBy("old_shard", bucket).orderBy(key, size)
    placed = dealt.withColumn(low, F.sum(size).over(in_bucket.rowsBetween(Window.unboundedPreceding, 0)) - F.floor((F.col(size) + 1) / 2))
    placed = placed.join(starts, placed["old_shard"].eqNullSafe(starts["o"]) & (placed[bucket] == starts["k"])).drop(starts["o"], starts["k"])
    placed = placed.join(F.broadcast(plan), placed["old_shard"].eqNullSafe(plan["o"])).drop(plan["o"])
    placed = placed.withColumn("shard", F.element_at(F.filter(way, lambda t: t["upto"] > F.col(lead) + F.col(low)), 1)["to"])
    in_shard = Window.partitionBy("old_shard", bucket, "shard").orderBy(key, size)
    placed = C.save(placed.select(*columns, "old_shard", bucket, "shard", F.row_number().over(in_shard).alias(nth)), "placed")
    counts = placed.groupBy("shard", "old_shard", bucket).agg(F.count(F.lit(1)).alias("b"))
    before = counts.select(F.col("shard").alias("s"), F.col("old_shard").alias("o"), F.col(bucket).alias("k"), prior(Window.partitionBy("shard").orderBy("old_shard", bucket), "b").alias(lead))
    out = placed.join(before, (placed["shard"] == before["s"]) & placed["old_shard"].eqNullSafe(before["o"]) & (placed[bucket] == before["k"]))
    return out.select(*[placed[c] for c in columns], placed["old_shard"], placed["shard"], (F.col(lead) + F.col(nth) - 1).cast("bigint").alias("slot"), (~placed["old_shard"].eqNullSafe(placed["shard"])).alias("moved"))


def rewrite(resharded: DataFrame, folder: str, file_rows: int = 500_000) -> list[int]:
    """Write the shards that gain or lose a row to folder/shard=N, in slot order; shards without a change are left alone, and the
    folders of shards that lost their last row are removed. folder may be the one that resharded is read from. Returns the
    shards changed (as many as there are shards at most). Each file holds file_rows rows."""
    spark = resharded.sparkSession
    changed = {r["s"] for r in resharded.where("moved").select(F.explode(F.array("old_shard", "shard")).alias("s")).distinct().collect()}
    ids = sorted(s for s in changed if s is not None)
    # the rows may come from the folder itself, so they are saved before it changes
    rows = C.save(resharded.where(F.col("shard").isin(ids)).withColumn("_file", F.floor(F.col("slot") / file_rows)), "rewrite")
    filled = {r["shard"] for r in rows.select("shard").distinct().collect()}
    rows.repartition("shard", "_file").sortWithinPartitions("shard", "slot").drop("_file").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(folder)
    for s in changed - filled:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/shard={'__HIVE_DEFAULT_PARTITION__' if s is None else s}")
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return ids
