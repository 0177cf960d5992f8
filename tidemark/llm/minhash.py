"""MinHash near-duplicates with tensored banding.

A document has `collections` small hashes, each of `rows` minima. A table's key joins the hashes of one pair of collections,
so m collections make m(m-1)/2 tables of 2*rows minima each from only m*rows minhash functions: about the square root of
what separate tables would need. With 10 collections of 2, a pair at similarity 0.8 meets in a table with probability 0.9993.
Documents with equal shingle sets form one class first; classes that meet are compared on their full sets.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common as C
from tidemark.llm.linking import link, meetings, verify_sets

SEED = 20_011


def _sets(column: pa.Array, k: int):
    """(first row, sets, counts) of ranges of rows, so that working memory stays bounded."""
    data, offsets = C.string_parts(column)
    for i, j in C.pieces(offsets):
        h, per, _, _ = C.words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        yield i, *C.shingles(h, per, k)


def signatures(docs: DataFrame, key: str, text: str, k: int, collections: int, rows: int) -> DataFrame:
    """id, n, p1, p2 (print of the set), half (one long for each collection)."""
    import numpy as np

    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            n, prints, halves = [], [], []
            for _, sets, count in _sets(batch.column(1), k):
                m = C.minhashes(sets, count, collections * rows, SEED)
                half = np.zeros((len(count), collections), C.U)
                for r in range(rows):
                    half = C.mix(half * C.U(3) + m[:, r::rows])
                n.append(count)
                prints.append(C.set_prints(sets, count))
                halves.append(half)
            if not n:
                continue
            n, p, h = np.concatenate(n), C.as_long(np.concatenate(prints)), C.as_long(np.concatenate(halves))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * collections, pa.int32()), pa.array(h.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(p[:, 0].copy()), pa.array(p[:, 1].copy()), lists], ["id", "n", "p1", "p2", "half"])

    return docs.select(F.col(key).alias("id"), F.col(text).alias("t")).mapInArrow(run, f"id {kind}, n bigint, p1 bigint, p2 bigint, half array<bigint>")


def shingle_sets(docs: DataFrame, k: int) -> DataFrame:
    """id and set (sorted distinct shingle hashes) of rows (id, t) with at least one word."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches):
        import numpy as np

        for batch in batches:
            for i, sets, count in _sets(batch.column(1), k):
                ends = np.concatenate([[0], np.cumsum(count)])
                out = pa.RecordBatch.from_arrays([batch.column(0).slice(i, len(count)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(C.as_long(sets)))], ["id", "set"])
                yield out.filter(pa.array(count > 0))

    return docs.select("id", "t").mapInArrow(run, f"id {kind}, set array<bigint>")


def list_members(column: pa.Array):
    """Members of a list column, one row after the other, and how many each row has."""
    return column.flatten().to_numpy(), column.value_lengths().to_numpy()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80, collections: int = 10, rows: int = 2) -> DataFrame:
    """key, n_shingles, component_id (smallest key reachable by links), kept (key = component_id): one row per input row.

    Links join documents whose sets of k-word shingles have 100 * intersection >= percent * union, found by tensored banding
    and confirmed on the full sets. Null or wordless texts have an empty set and link with nothing: their component is
    their own key. Rows of one key are one node, so they are kept or not together. A null key links with nothing and
    has a null component and a null kept. Only key and text are read, so other columns cannot clash.
    """
    sig = C.save(signatures(docs, key, text, k, collections, rows), "signatures")
    known = sig.where("n > 0 and id is not null")
    classes = C.save(known.groupBy("n", "p1", "p2", "half").agg(F.min("id").alias("rep")), "classes")
    keys = F.array(*[F.xxhash64(F.lit(i * collections + j), F.col("half")[i], F.col("half")[j]) for i in range(collections) for j in range(i + 1, collections)])
    reps = classes.select(F.col("rep").alias("id"), keys.alias("keys"))
    texts = docs.select(F.col(key).alias("id"), F.col(text).alias("t"))
    # a key may have several rows: each of its sets is there to be compared
    found = link(meetings(reps), lambda ids: shingle_sets(texts.join(ids, "id", "left_semi"), k), lambda edges, sets: verify_sets(edges, sets, percent), "set", list_members, percent)
    # nodes of several sets (repeated keys) are joined through the key as well
    named = classes.join(found.withColumnRenamed("node", "rep"), "rep", "left").select(F.col("n").alias("cn"), F.col("p1").alias("c1"), F.col("p2").alias("c2"), F.coalesce("component", "rep").alias("component"))
    # saved, so that the join has plain shuffles on both sides and a large group of equal texts is split
    named = C.save(named, "named")
    out = sig.join(named, (F.col("id").isNotNull()) & (F.col("n") == F.col("cn")) & (F.col("p1") == F.col("c1")) & (F.col("p2") == F.col("c2")), "left")
    out = out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))
    return out.withColumn("kept", F.col(key) == F.col("component_id"))
