"""Packing token sequences by minimum bin slack over the histogram of piece lengths.

A document longer than a window is cut into whole windows and one rest. All rests form a histogram over the lengths below
the window, which is bounded by the window whatever the corpus. For each window the planner takes the longest rest left
and, by subset-sum dynamic programming on a bitset, the multiset of other lengths whose sum comes closest to the room left;
the counts are found by walking the bitset's layers back. A pattern is used as often as the histogram allows, so the plan has
about as many patterns as there are lengths. Only the plan is made on the driver; pieces find their place by rank.
"""

from __future__ import annotations

import base64
import json
import os
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import common as C

WINDOW = 2048


@lru_cache(maxsize=4)
def encoder(ranks_path: str, pattern: str):
    """The same ids as the tokenizers library gives by the file of the same vocabulary (.json beside the ranks), its added tokens
    included, at several times its speed."""
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    added, whole = {}, os.path.splitext(ranks_path)[0] + ".json"
    if os.path.exists(whole):
        with open(whole, encoding="utf-8") as f:
            added = {t["content"]: t["id"] for t in json.load(f).get("added_tokens", [])}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens=added)


def pieces_of(docs: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id", text: str = "text", window: int = WINDOW, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """The pieces of each document: its ids and the end id, cut at every multiple of window. Null text is empty, and an
    empty document is its end id alone. Columns: key, start, length, ids_crc32, doc_tokens (and ids, if asked for)."""
    schema = f"{key} {docs.schema[key].dataType.simpleString()}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint" + ", ids array<int>" * with_ids

    def run(batches):
        enc = encoder(ranks_path, pattern)
        encode, added = enc._core_bpe.encode_to_tiktoken_buffer, enc.special_tokens_set
        for batch in batches:
            rows, start, length, crc, total, out = [], [], [], [], [], []
            for i, value in enumerate(batch.column(1)):
                x = value.as_py() or ""
                try:
                    buffer = encode(x, added)
                except UnicodeEncodeError:  # half a surrogate pair
                    buffer = encode(x.encode("utf-16", "surrogatepass").decode("utf-16", "replace"), added)
                ids = np.append(np.frombuffer(buffer, dtype="<u4"), np.uint32(end_id)).astype("<u4")
                for a in range(0, len(ids), window):
                    part = ids[a : a + window]
                    rows.append(i)
                    start.append(a)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
                    total.append(len(ids))
                    if with_ids:
                        out.append(part.astype(np.int32))
            columns = [batch.column(0).take(pa.array(rows, pa.int64()))] + [pa.array(c, pa.int64()) for c in (start, length, crc, total)] + [pa.array(out, pa.list_(pa.int32()))] * with_ids
            yield pa.RecordBatch.from_arrays(columns, [key, "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids)

    return docs.select(key, text).mapInArrow(run, schema)


def best_fill(room: int, counts: dict[int, int]) -> dict[int, int]:
    """The multiset of lengths, within counts, whose sum is the largest that is at most room.

    Bit s of the bitset says that a sum of s can be reached. Counts are split in powers of two, so a length takes
    logarithmically many shift-or steps; the layers are kept and walked back for the counts. Longer lengths go first,
    which leaves the short ones, that fit anywhere, for later windows."""
    mask, reach = (1 << (room + 1)) - 1, 1
    layers: list[tuple[int, int, int]] = []
    goal = 1 << room
    for length in sorted((x for x in counts if x <= room and counts[x] > 0), reverse=True):
        left, take = min(counts[length], room // length), 1
        while left > 0:
            take = min(take, left)
            layers.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            left -= take
            take *= 2
        if reach & goal:
            break
    total, used = reach.bit_length() - 1, {}
    for length, take, was in reversed(layers):
        if not (was >> total) & 1:
            used[length] = used.get(length, 0) + take
            total -= length * take
    return used


def plan(histogram: dict[int, int], window: int = WINDOW) -> list[tuple[dict[int, int], int]]:
    """Patterns (length -> pieces in one sequence) and how many sequences each makes. Uses every piece exactly once."""
    counts, out = {k: v for k, v in histogram.items() if v > 0}, []
    while counts:
        longest = max(counts)
        counts[longest] -= 1
        pattern = best_fill(window - longest, counts)
        counts[longest] += 1
        pattern[longest] = pattern.get(longest, 0) + 1
        times = min(counts[x] // n for x, n in pattern.items())
        for x, n in pattern.items():
            counts[x] -= n * times
            if not counts[x]:
                del counts[x]
        out.append((pattern, times))
    return out


def intervals(patterns: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """length, first rank, pieces in a sequence, first sequence, sequences, offset: where the ranks of a length go."""
    seen: dict[int, int] = {}
    out, sequence = [], 0
    for pattern, times in patterns:
        at = 0
        for length in sorted(pattern, reverse=True):
            n = pattern[length]
            out.append((length, seen.get(length, 0), n, sequence, times, at))
            seen[length] = seen.get(length, 0) + n * times
            at += n * length
        sequence += times
    return out


def pack(pieces: DataFrame, window: int = WINDOW, key: str = "doc_id", bucket_rows: int = 50_000) -> DataFrame:
    """pieces with sequence_id and offset: each sequence holds at most window ids, without gaps.

    pieces needs key, start and length (1 to window). Ranks within a length are made in two steps, so a length that a
    third of all pieces share is spread over many tasks: counts by (length, bucket) give the offsets, and a window ranks
    the rows of a bucket. The histogram on the driver has at most `window` rows. Repeated rows are pieces of their own;
    columns named sequence_id and offset are replaced, all others kept; without pieces the result is empty.
    """
    spark = pieces.sparkSession
    pieces = pieces.drop("sequence_id", "offset")
    bucket, nth, prior, places, at = C.free(pieces.columns, "bucket", "nth", "prior", "places", "at")
    buckets = max(1, -(-pieces.count() // bucket_rows))
    dealt = pieces.withColumn(bucket, F.pmod(F.xxhash64(key, "start"), F.lit(buckets)))
    sizes = dealt.groupBy("length", bucket).agg(F.count(F.lit(1)).alias(nth))
    before = Window.partitionBy("length").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("length", bucket, F.coalesce(F.sum(nth).over(before), F.lit(0)).alias(prior))
    histogram = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum(nth).alias("n")).collect()}
    if bad := [x for x in histogram if x is None or not 0 < x <= window]:
        raise ValueError(f"pieces of length {bad[:3]} do not fit a window of {window}")
    schema = "length bigint, first bigint, each bigint, sequence bigint, times bigint, at bigint"
    spread = spark.createDataFrame(intervals(plan(histogram, window)), schema)
    by_length = spread.groupBy("length").agg(F.array_sort(F.collect_list(F.struct("first", "each", "sequence", "at"))).alias(places))
    # two small tables, joined before they meet the pieces: one row for each (length, bucket)
    lookup = offsets.join(by_length, "length")
    order = Window.partitionBy("length", bucket).orderBy(key, "start")
    ranked = dealt.withColumn(nth, F.row_number().over(order) - 1).join(lookup, ["length", bucket]).withColumn(nth, F.col(prior) + F.col(nth))
    # the last place that starts at or before the rank
    found = ranked.withColumn(at, F.element_at(F.filter(places, lambda p: p["first"] <= F.col(nth)), -1))
    rank = F.col(nth) - F.col(at)["first"]
    sequence = F.col(at)["sequence"] + F.floor(rank / F.col(at)["each"])
    place = F.col(at)["at"] + rank % F.col(at)["each"] * F.col("length")
    return found.select(*pieces.columns, sequence.cast("bigint").alias("sequence_id"), place.cast("bigint").alias("offset"))


def pack_documents(docs: DataFrame, ranks_path: str, pattern: str, window: int = WINDOW, end_id: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Tokenize whole texts, cut, and pack: one row per piece (see pieces_of and pack). Texts are read once and never shuffled."""
    return pack(C.save(pieces_of(docs, ranks_path, pattern, key, text, window, end_id), "pieces"), window, key)


def materialize(pieces_with_ids: DataFrame, window: int = WINDOW, pad_id: int = 0) -> DataFrame:
    """sequence_id and its `window` ids, padded, from packed pieces that carry ids. A sequence is bounded by the window."""
    rows = pieces_with_ids.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    ids = F.flatten(F.transform("p", lambda x: x["ids"]))
    return rows.select("sequence_id", F.concat(ids, F.array_repeat(F.lit(pad_id), F.lit(window) - F.size(ids))).alias("ids"))
