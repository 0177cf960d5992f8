"""Near-duplicate vectors by Euclidean p-stable hashing.

Vectors are scaled to length 1, where cosine c is Euclidean distance sqrt(2 - 2c). In each table, `projections` Gaussian
projections are shifted and cut into steps of `width`; vectors whose steps all agree share a bucket. With 8 projections
of width 2 and 24 tables, a pair at cosine 0.93 meets with probability 0.9995. Every pair that meets is checked by its
cosine in double precision and counted in the first table where it meets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common as C
from tidemark.llm.vectors import matrix, usable

TABLES, PROJECTIONS, WIDTH, SEED = 24, 8, 2.0, 60_013
#: Vectors of a block; a larger bucket is compared block by block, so memory is bounded and no bucket lies in one task.
BLOCK = 512


def bucket_keys(x: np.ndarray, tables: int, projections: int, width: float) -> np.ndarray:
    """A 64-bit key for each row of x (length 1) and table."""
    rng = np.random.default_rng(SEED)
    a = rng.normal(size=(x.shape[1], tables * projections))
    shift = rng.uniform(0, width, size=tables * projections)
    step = np.floor((x @ a + shift) / width).astype(np.int64).view(C.U).reshape(len(x), tables, projections)
    key = np.zeros((len(x), tables), C.U)
    for j in range(projections):
        key = C.mix(key * C.U(31) + step[:, :, j])
    return key


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow or underflow in the squares
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def compare(ids: list, weight: np.ndarray, x: np.ndarray, block: np.ndarray, own: bool, table: int, least: float, tables: int, projections: int, width: float) -> list[tuple]:
    """(id, copies linked, a smaller id of its component or null) for rows of one bucket that link here first.
    own: compare all rows with each other; else only those of different blocks."""
    cos = x @ x.T
    hit = cos >= least
    np.fill_diagonal(hit, False)
    if not own:
        hit &= block[:, None] != block[None, :]
    i, j = np.nonzero(np.triu(hit))
    if not len(i):
        return []
    used = np.unique(np.concatenate([i, j]))
    if table:
        keys = np.zeros((len(ids), table), C.U)
        keys[used] = bucket_keys(x[used], tables, projections, width)[:, :table]
        fresh = np.ones(len(i), bool)
        for a in range(0, len(i), 65536):
            fresh[a : a + 65536] = ~(keys[i[a : a + 65536]] == keys[j[a : a + 65536]]).any(axis=1)
        i, j = i[fresh], j[fresh]
        if not len(i):
            return []
    count = np.bincount(i, weights=weight[j], minlength=len(ids)) + np.bincount(j, weights=weight[i], minlength=len(ids))
    low = np.arange(len(ids))
    while True:  # smallest row number next to each, until it settles; rows come in order of ids
        before = low.copy()
        np.minimum.at(low, i, low[j])
        np.minimum.at(low, j, low[i])
        low = low[low]
        if (low == before).all():
            break
    return [(ids[r], int(count[r]), ids[low[r]] if low[r] != r else None) for r in np.flatnonzero(count)]


def near_vectors(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", least: float = 0.93, tables: int = TABLES, projections: int = PROJECTIONS, width: float = WIDTH) -> DataFrame:
    """key, n_links (other vectors linked directly), component_id (smallest key reachable), kept (key = component_id).

    Vectors are compared only with those of an equal label that is not null and of as many components. Vectors that are
    null, empty, zero or hold null or non-finite components, and those of a null label or key, link with nothing. Equal
    vectors of a label form one class that is compared once and counted as often as it occurs. Rows of equal keys are
    counted one by one and are one node of the components. Only the three columns are read.
    """
    src = rows.select(F.col(key).alias("id"), F.col(label).alias("label"), F.col(vector).alias("v"))
    kind = src.schema["id"].dataType.simpleString()
    fine = F.col("id").isNotNull() & F.col("label").isNotNull() & usable("v")
    good = src.where(fine).select("id", "label", F.size("v").alias("d"), F.xxhash64("v").alias("p"), F.hash("v").alias("q"), "v")
    classes = C.save(good.groupBy("label", "d", "p", "q").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"), F.first("v").alias("v")), "classes")
    lab = classes.schema["label"].dataType.simpleString()

    def keyed(batches):
        for batch in batches:
            dims = batch.column(2).to_numpy()
            for d in np.unique(dims):
                part = batch.filter(pa.array(dims == d))
                keys = bucket_keys(unit(matrix(part.column(3))), tables, projections, width)
                n = len(part)
                take = pa.array(np.repeat(np.arange(n), tables))
                yield pa.RecordBatch.from_arrays([part.column(0).take(take), part.column(1).take(take), part.column(2).take(take), pa.array(np.tile(np.arange(tables, dtype=np.int32), n)), pa.array(C.as_long(keys).ravel())], ["id", "label", "d", "t", "key"])

    buckets = C.save(classes.select("id", "label", "d", "v").mapInArrow(keyed, f"id {kind}, label {lab}, d int, t int, key bigint"), "buckets")
    names = ["label", "d", "t", "key"]
    sizes = buckets.groupBy(names).agg(F.count(F.lit(1)).alias("c")).where("c > 1").withColumn("parts", F.ceil(F.col("c") / BLOCK).cast("int")).drop("c")
    # a bucket of one block is one group; of more, each pair of blocks is a group, and a row goes to as many as there are blocks
    part = F.pmod(F.hash("id"), F.col("parts"))
    dealt = buckets.join(sizes, names).withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select(*names, "id", "part", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"))
    full = dealt.join(classes.select("id", "label", "d", "n", "v"), ["id", "label", "d"])
    group = [*names, "lo", "hi"]

    def run(batches):
        held = None

        def solve(t: pa.Table, last: bool):
            codes = np.zeros(len(t), bool)
            codes[0] = True
            for g in group:
                col = t.column(g).to_numpy(zero_copy_only=False)
                codes[1:] |= col[1:] != col[:-1]
            cuts = np.append(np.flatnonzero(codes), len(t))
            end = len(cuts) - 1 if last else len(cuts) - 2
            out = []
            ids, n, part_, lo, hi, table_ = t.column("id").to_pylist(), t.column("n").to_numpy().astype(float), t.column("part").to_numpy(), t.column("lo").to_numpy(), t.column("hi").to_numpy(), t.column("t").to_numpy()
            for a, b in zip(cuts[:end], cuts[1 : end + 1], strict=True):
                if b - a > 1:
                    x = unit(matrix(t.column("v").slice(a, b - a).combine_chunks()))
                    out += compare(ids[a:b], n[a:b], x, part_[a:b], bool(lo[a] == hi[a]), int(table_[a]), least, tables, projections, width)
            arrays = [pa.array([o[k] for o in out], type_) for k, type_ in enumerate((t.schema.field("id").type, pa.int64(), t.schema.field("id").type))]
            return pa.RecordBatch.from_arrays(arrays, ["id", "links", "low"]), (None if last else t.slice(int(cuts[end])))

        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if held is None else pa.concat_tables([held, t]).combine_chunks()
            if len(t):
                out, held = solve(t, False)
                yield out
        if held is not None and len(held):
            yield solve(held, True)[0]

    ordered = full.repartition(*group).sortWithinPartitions(*group, "id")
    hits = C.save(ordered.select(*group, "id", "n", "part", "v").mapInArrow(run, f"id {kind}, links bigint, low {kind}"), "hits")
    count = hits.groupBy("id").agg(F.sum("links").alias("links"))
    comps = C.components(hits.where("low is not null"), "id", "low").select(F.col("node").alias("id"), "component")
    named = classes.select("id", *[F.col(c).alias(f"c{c}") for c in ("label", "d", "p", "q")], "n").join(count, "id", "left").join(comps, "id", "left")
    # saved, so that the join has plain shuffles on both sides and a large group of equal vectors is split
    named = C.save(named.select("clabel", "cd", "cp", "cq", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("component", "id").alias("component")), "named")
    same = (F.col("label") == F.col("clabel")) & (F.col("d") == F.col("cd")) & (F.col("p") == F.col("cp")) & (F.col("q") == F.col("cq"))
    linked = good.drop("v").join(named, same).select("id", "links", "component")
    bad = src.where(~fine).select("id", F.lit(0).cast("bigint").alias("links"), F.col("id").alias("component"))
    out = linked.unionByName(bad)
    return out.select(F.col("id").alias(key), F.col("links").alias("n_links"), F.col("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))
