"""Approximate nearest neighbours by multi-index hashing.

A rotation is learned on a bounded sample (principal directions, then the rotation that brings them closest to signs); a
vector's code is the signs of its rotated components. All rows are dealt to shards. In a shard the codes are cut into substrings, and
each substring has a table from its value to the rows that hold it. By the pigeonhole principle two codes within `radius`
differ in at least one substring by no more than its share of radius - substrings + 1 bits, so probing all values that near to
the query's own, in every table, meets every code within the radius. Their full Hamming distance decides, and what passes is ranked
by Euclidean distance in double precision. The radius is learned on the sample; it grows for a query that finds too few.

A row is shipped once, whatever the number of queries and tables; a query is shipped once for each shard.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import common as C
from tidemark.llm.vectors import matrix, usable

#: Rows that the rotation and the radius are learned on, at most, and rows of it that are taken as queries for the radius.
SAMPLE, TRIALS = 10_000, 200
BITS, SEED = 64, 20_023
#: Share of the sample's true neighbours that the radius must hold.
HELD = 0.98
#: Rows of a shard: at most, and as few as the aim of 64 shards may make it. Queries that one task answers on a shard.
SHARD, LEAST_SHARD, QUERIES = 65_536, 2_048, 65_536


class Rotation:
    """Mean and projection that give a code of `bits` signs."""

    def __init__(self, sample: np.ndarray, bits: int, rounds: int = 30):
        d = sample.shape[1]
        rng = np.random.default_rng(SEED)
        self.bits = bits
        self.mean = sample.mean(0) if len(sample) else np.zeros(d)
        z = sample - self.mean
        _, v = np.linalg.eigh(z.T @ z)
        v = v[:, ::-1]
        if bits > d:  # more bits than components: further directions at random
            v = np.hstack([v, rng.normal(size=(d, bits - d)) / np.sqrt(d)])
        v = v[:, :bits]
        z = z @ v
        r = np.linalg.qr(rng.normal(size=(bits, bits)))[0]
        for _ in range(rounds if len(sample) else 0):
            s = np.where(z @ r >= 0, 1.0, -1.0)
            u, _, w = np.linalg.svd(s.T @ z)
            r = (u @ w).T
        self.project = v @ r

    def codes(self, x: np.ndarray) -> np.ndarray:
        """Codes as 64-bit words; bit i is the sign of rotated component i."""
        on = ((x - self.mean) @ self.project) >= 0
        full = np.zeros((len(x), 64), bool)
        full[:, : self.bits] = on
        return np.packbits(full, axis=1, bitorder="little").view("<u8")[:, 0].astype(C.U)


@lru_cache(maxsize=128)
def near_values(width: int, most: int) -> np.ndarray:
    """All masks of `width` bits with at most `most` bits set: what a query's substring is XORed with."""
    if most * 2 > width:  # most of all values: cheaper to count the bits of each
        return np.flatnonzero(np.bitwise_count(np.arange(1 << width, dtype=np.uint32)) <= most)
    return np.array([sum(1 << b for b in c) for n in range(most + 1) for c in combinations(range(width), n)], dtype=np.int64)


def width_for(rows: int) -> int:
    """Bits of a substring: about the logarithm of the rows, so that a table has about as many values as rows."""
    return 16 if rows >= 1 << 14 else 8 if rows >= 1 << 6 else 4


class Tables:
    """The substring tables of some codes."""

    def __init__(self, codes: np.ndarray, bits: int = BITS, width: int | None = None):
        self.codes, self.bits = codes, bits
        self.width = width or width_for(len(codes))
        self.parts = -(-bits // self.width)
        values = self.values(codes)
        self.order = [np.argsort(v, kind="stable") for v in values]
        self.start = [np.searchsorted(v[o], np.arange((1 << self.width) + 1)) for v, o in zip(values, self.order)]

    def values(self, codes: np.ndarray) -> list[np.ndarray]:
        return [((codes >> C.U(self.width * j)) & C.U((1 << self.width) - 1)).astype(np.int64) for j in range(self.parts)]

    def within(self, code, radius: int) -> np.ndarray:
        """All rows whose code differs from this one in at most `radius` bits, in order."""
        spare = radius - self.parts + 1  # the thresholds of the substrings add up to this; below 0 a table is not probed
        found = []
        for j, value in enumerate(self.values(np.array([code], C.U))):
            most = min(self.width, spare // self.parts + (j < spare % self.parts)) if spare >= 0 else (0 if j <= radius else -1)
            if most < 0:
                continue
            at = value[0] ^ near_values(self.width, most)
            a, n = self.start[j][at], self.start[j][at + 1] - self.start[j][at]
            a, n = a[n > 0], n[n > 0]
            if len(a):
                found.append(self.order[j][np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum())])
        if not found:
            return np.zeros(0, np.int64)
        hit = np.zeros(len(self.codes), bool)
        hit[np.concatenate(found)] = True
        rows = np.flatnonzero(hit)
        return rows[np.bitwise_count(self.codes[rows] ^ C.U(code)) <= radius]


def nearest(tables: Tables, ids: np.ndarray, x: np.ndarray, own, code, v: np.ndarray, k: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and distances of the k nearest of those within the radius, which grows until there are k or all rows are in it. ids must rise."""
    while True:
        at = tables.within(code, radius)
        at = at[ids[at] != own]
        if len(at) >= k or radius >= tables.bits:
            break
        radius = min(tables.bits, radius + 4)
    score = np.sqrt(((x[at] - v) ** 2).sum(axis=1))
    top = np.argsort(score, kind="stable")[:k]
    return at[top], score[top]


def learned_radius(rotation: Rotation, sample: np.ndarray, k: int, held: float = HELD) -> int:
    """The Hamming distance that holds a share `held` of the true k nearest among the sample. All rows are denser than the sample and
    their neighbours nearer, so they are held at least as well."""
    n = len(sample)
    if n < 2:
        return rotation.bits
    codes, far = rotation.codes(sample), []
    for q in np.linspace(0, n - 1, min(TRIALS, n)).astype(int):
        d = ((sample - sample[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        best = np.argpartition(d, min(k, n - 1) - 1)[:k]
        far.append(np.bitwise_count(codes[best[best != q]] ^ codes[q]))
    return int(np.quantile(np.concatenate(far), held, method="higher"))


def search(rows: DataFrame, is_query: str, key: str = "vec_id", vector: str = "embedding", k: int = 10, bits: int = BITS, radius: int | None = None, sample: int = SAMPLE, shard: int = SHARD, least_shard: int = LEAST_SHARD) -> DataFrame:
    """query_id, rank (from 1), id, score (Euclidean distance): the k nearest rows found for each query row, itself left out.

    is_query: SQL condition over the columns of rows that marks the queries; candidates are all rows. In each shard the radius (learned,
    unless given) grows until k codes are within it, so a query gets k neighbours if there are that many. Ties go to the
    smaller key. Null keys and vectors that are null, empty, zero or hold null or non-finite components take no part; only
    vectors of as many components as most of the sample are comparable, others are left out. Repeated keys are rows of
    their own: each query row gets its own k neighbours, and none of the rows of a key is a candidate of that key. An empty table gives
    an empty result.
    """
    spark = rows.sparkSession
    src = rows.select(F.col(key).alias("id"), F.col(vector).alias("v"), F.coalesce(F.expr(is_query), F.lit(False)).alias("asks"))
    kind, vkind = src.schema["id"].dataType.simpleString(), src.schema["v"].dataType.simpleString()
    fine = src.where(F.col("id").isNotNull() & usable("v"))
    # keys are picked before vectors are fetched, so tasks send the driver `sample` keys each and not as many vectors
    chosen = fine.select(F.xxhash64("id").alias("h"), F.col("id").alias("p")).orderBy("h", "p").limit(sample).select("p").distinct()
    picked = fine.join(F.broadcast(chosen), F.col("id") == F.col("p")).limit(sample).select("v").toArrow().column("v").to_pylist()
    if not picked:
        return spark.createDataFrame([], f"query_id {kind}, rank int, {key} {kind}, score double")
    dims = np.array([len(v) for v in picked])
    d = int(np.bincount(dims).argmax())
    learned = np.array([v for v in picked if len(v) == d], dtype=np.float64)
    rotation = Rotation(learned, bits)
    reach = learned_radius(rotation, learned, k) if radius is None else radius

    def coded(batches):
        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            code = C.as_long(rotation.codes(matrix(batch.column(1)))) if len(batch) else np.zeros(0, np.int64)
            number = (part << 40) + n + np.arange(len(batch), dtype=np.int64)
            n += len(batch)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(code), pa.array(number)], ["id", "v", "asks", "code", "row"])

    codes = C.save(fine.where(F.size("v") == d).mapInArrow(coded, f"id {kind}, v {vkind}, asks boolean, code bigint, row bigint"), "codes")
    count = codes.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("asks"), 1)).alias("q")).first()
    shards = max(1, -(-count["n"] // shard), min(64, count["n"] // max(1, least_shard)))
    blocks = max(1, -(-count["q"] // QUERIES))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    index = codes.withColumn("s", F.pmod(F.hash("row"), F.lit(shards))).withColumn("b", spread(blocks)).select("s", "b", "id", "v", "code")
    asked = codes.where("asks").withColumn("b", F.pmod(F.hash("row", F.lit(1)), F.lit(blocks))).withColumn("s", spread(shards)).select("s", "b", "row", "id", "v", "code")

    def answer(t: pa.Table, q: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], []]
        if len(t) and len(q):
            ids = np.array(t.column("id").to_pylist())
            order = np.argsort(ids, kind="stable")
            ids, x = ids[order], matrix(t.column("v").combine_chunks())[order]
            tables = Tables(t.column("code").to_numpy()[order].view(C.U), bits)
            asked_ = zip(q.column("row").to_pylist(), q.column("id").to_pylist(), q.column("code").to_numpy().view(C.U), matrix(q.column("v").combine_chunks()), strict=True)
            for row, own, code, v in asked_:
                at, score = nearest(tables, ids, x, own, code, v, k, reach)
                out[0] += [row] * len(at)
                out[1] += [own] * len(at)
                out[2] += ids[at].tolist()
                out[3] += score.tolist()
        types = (pa.int64(), q.schema.field("id").type, q.schema.field("id").type, pa.float64())
        return pa.table({c: pa.array(o, t_) for c, o, t_ in zip(("row", "query_id", "id", "score"), out, types, strict=True)})

    found = index.groupBy("s", "b").cogroup(asked.groupBy("s", "b")).applyInArrow(answer, f"row bigint, query_id {kind}, id {kind}, score double")
    order = Window.partitionBy("row").orderBy("score", "id")
    out = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(key), "score")
